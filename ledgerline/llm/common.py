"""What the operators share: tables, the shared work folder, code shipping, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.shipping import ship  # noqa: F401

#: The texts of one step inside a task, in bytes; a longer text is a step of its own.
STEP_BYTES = 6 << 20
#: A table of ids (8 bytes each) is broadcast up to so many rows.
BROADCAST_IDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


#: Vocabularies and their memories that a worker keeps from task to task.
kept: dict[tuple[str, str], object] = {}

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def forget() -> None:
    kept.clear()


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Work, keep: bool = False) -> Work:
    """A task function for mapInArrow that leaves its worker small. Spark keeps workers alive for the tasks of later stages,
    and what they hold counts against the executor. Unless `keep`, vocabularies that earlier tasks left go first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset a temporary one, if Spark runs on
    this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def spent(*tables: DataFrame) -> None:
    """Remove tables that `written` made and nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is small; else joins with it shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no step holds more than `most` bytes of text, or else a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        n = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        at, ends = 0, np.cumsum(n)
        while at < len(n):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def strings(col: pa.Array) -> pa.Array:
    """A string array without nulls: a null text is an empty text."""
    col = pc.fill_null(col, "")
    return col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text, and where each text's words begin (one more at the end). Every different word
    of the array is hashed once."""
    parts = pc.ascii_split_whitespace(strings(texts))
    at = np.asarray(parts.offsets, np.int64)
    flat = parts.flatten().dictionary_encode()
    words, code = flat.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(flat.indices, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words))
    there = np.fromiter(map(len, words), np.int64, len(words))[code] > 0  # white space at an end leaves an empty piece
    return h[code[there]], np.concatenate(([0], np.cumsum(there)))[at - at[0]]


def rolled(words: np.ndarray, places: list[int]) -> np.ndarray:
    """A hash of the words at the given places from each word on."""
    n = len(words) - places[-1]
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(places), np.uint64)
    for j in places:
        h *= ODD
        h += words[j : j + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the ranges, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep].astype(np.int64), lens[keep].astype(np.int64)
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    at = np.cumsum(lens)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(out)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; whatever else the table has, under whatever name, stays out of the plan."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
