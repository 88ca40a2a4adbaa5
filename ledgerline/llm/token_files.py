"""Token-id files: documents in ascending id order as one concatenated id array with Elias-Fano boundaries.

A data set is a folder that Spark writes (so its commit covers lost and repeated tasks, on any store Spark reads).
Each row is a block of whole documents:

    shard        the writing task; shards are disjoint ranges of document ids
    block        0, 1, ... within the shard
    shard_start  ids of the shard before this block
    n_ids        ids in this block
    doc_ids      the block's document ids, ascending
    width        bytes of an id, 2 or 4 (little-endian)
    ids          the ids of all documents, end ids included, one after the other
    bounds       Elias-Fano list of where each document ends

Defined results: a null text is an empty text, whose only id is the end id; rows with the same id stay separate
documents, in the order of their texts; a null document id sorts first; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from . import chunks, tokens
from .common import id_and_text, lean, ship, steps, written
from .elias_fano import EliasFano

#: The shards' starts (16 bytes each) are broadcast up to so many; beyond, the blocks are shuffled to them.
BROADCAST_SHARDS = 500_000

BLOCK_SCHEMA = "shard int, block int, shard_start long, n_ids long, doc_ids array<long>, width int, ids binary, bounds binary"
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary())])


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 0, block_ids: int = 1 << 20) -> None:
    """Encode whole texts and write them to `path`; a block closes at `block_ids` ids or after the document that passes it."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = tokens.vocabulary(spark, vocabulary_path)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary.value)
        wide = len(encode.bytes) > 1 << 16 or end_id >= 1 << 16
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal doc_ids, parts, ends, held, block, before
            data = np.concatenate(parts).astype("<u4" if wide else "<u2")
            row = [shard, block, before, held, doc_ids, 4 if wide else 2, data.tobytes(), EliasFano.build(np.concatenate(ends)).to_bytes()]
            block, before = block + 1, before + held
            doc_ids, parts, ends, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for b in steps(batches, "text"):
            flat, starts = chunks.encoded(b.column(1), encode)
            n = b.num_rows
            lens = np.diff(starts) + 1
            out = np.full(len(flat) + n, end_id, np.uint32)
            out[np.arange(len(flat)) + np.repeat(np.arange(n), lens - 1)] = flat
            last = np.cumsum(lens)
            own, at = b.column(0).to_pylist(), 0
            while at < n:
                base = int(last[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(last, base + block_ids - held, side="right")))
                parts.append(out[base : int(last[to - 1])])
                ends.append(last[at:to] - base + held)
                doc_ids += own[at:to]
                held += int(last[to - 1]) - base
                at = to
                if held >= block_ids:
                    yield close()
        if held:
            yield close()

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lean(blocks, keep=True), BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, unsigned 32-bit little-endian), from the files."""
    ship(spark)
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row for each shard: as many as the writing job had tasks
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min(F.when(F.col("block") == 0, F.col("doc_ids")[0])).alias("first"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]  # one block at a time
                ends = EliasFano.from_bytes(r["bounds"]).all()
                starts = np.concatenate(([0], ends[:-1]))
                ids = np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4").astype("<u4")
                cells = [ids[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["base"] + r["shard_start"]), pa.array(ends - starts), pa.array(cells, pa.binary())], schema=out)

    bases = written(bases, "shards")
    few = bases.count() <= BROADCAST_SHARDS
    one = files.join(F.broadcast(bases) if few else bases, files["shard"] == bases["s"]).drop("s")
    # the vocabularies of the stage that wrote the files go
    return one.mapInArrow(lean(documents), "doc_id long, start long, n_tokens long, ids binary")


def document_ids(spark: SparkSession, path: str, place: int, shard: int = 0, block: int = 0) -> list[int]:
    """The ids of one document of a block by two select calls, without decoding the other boundaries."""
    r = spark.read.schema(BLOCK_SCHEMA).parquet(path).filter(f"shard = {shard} and block = {block}").first()
    ends = EliasFano.from_bytes(r["bounds"])
    a, z = ends.select(place - 1) if place else 0, ends.select(place)
    return np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4")[a:z].tolist()


def checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_token_files returns."""
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
