"""Exact top-k inner products by MaxScore over shards.

A vector is a sparse document whose terms are its dimensions. Within a shard each term has its posting list (a row of
values) and the range of its values, so a query knows the most that each term can add. Terms are taken in descending
order of that bound: the essential ones are those that are needed before the rest alone can't reach the k-th best score;
their postings are traversed, and the others are probed one by one for the candidates that still compete. Shards are
merged at the end. Ties go to the smaller id, so a candidate competes while it can equal the k-th score.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector has zeros
for what it lacks; rows with a query's own id aren't its candidates; fewer candidates than k give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ship

#: Candidates of a shard and queries of a tile, at most about.
SHARD_ROWS, TILE_QUERIES = 200_000, 4_000

class Shard:
    """Posting lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(values[order].T)
        n = self.postings.shape[1]
        self.high = self.postings.max(axis=1) if n else np.zeros(len(self.postings))
        self.low = self.postings.min(axis=1) if n else np.zeros(len(self.postings))

    def best(self, query: int, q: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores that can stand against the scores known so far."""
        width = min(len(q), len(self.postings))
        q = q[:width]
        bound = np.maximum(q * self.high[:width], q * self.low[:width])
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate((np.cumsum(bound[terms][::-1])[::-1][1:], [0])) if width else np.zeros(0)
        least = np.sort(known)[-k] if len(known) >= k else -np.inf
        # essential: until the remaining terms together can't reach the k-th score
        essential = int(np.searchsorted(-rest, -least, side="right")) + 1 if np.isfinite(least) and least > 0 else (width + 1) // 2
        essential = min(max(essential, 1), width)
        own = terms[:essential]
        score = q[own] @ self.postings[own] if width else np.zeros(len(self.ids))
        alive = np.flatnonzero(self.ids != query)
        score = score[alive]
        if not np.isfinite(least) and len(alive) > k:
            # no score known yet: the best partial scores' full scores give one
            first = np.argpartition(-score, k - 1)[:k]
            least = (q @ self.postings[:width, alive[first]]).min()
        for i in range(essential, width):
            keep = score + rest[i - 1] >= least
            if not keep.all():
                alive, score = alive[keep], score[keep]
            score = score + q[terms[i]] * self.postings[terms[i], alive]
        order = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[order]], score[order]


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shards: int | None = None, tiles: int | None = None, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the rows that is_query (a Column) holds for, against all rows.

    Components become floor(scale * x). Candidates are dealt into shards and queries into tiles, whose numbers follow from
    the table's rows; each tile meets each shard in one task, which reads the shard's candidates in blocks and holds the
    tile's queries with their best and one block.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), whole.alias("v"))
    if shards is None or tiles is None:
        n = rows.agg(F.count("*").alias("rows"), F.count_if("query").alias("queries")).first()
        shards, tiles = shards or max(16, -(-n["rows"] // SHARD_ROWS)), tiles or max(1, -(-n["queries"] // TILE_QUERIES))
    # candidates to every tile of the shard of their id; queries to every shard of their tile
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(own(shards).alias("s"), every(tiles).alias("t"), F.lit(1).alias("kind"), "id", "v")
    asked = rows.filter("query").select(every(shards).alias("s"), own(tiles).alias("t"), F.lit(0).alias("kind"), "id", "v")
    dealt = candidates.union(asked).select((F.col("s") * tiles + F.col("t")).alias("shard"), "kind", "id", "v")
    dealt = dealt.repartition(shards * tiles, "shard").sortWithinPartitions("shard", "kind", "id")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(col: pa.ListArray) -> np.ndarray:
        lens = np.asarray(pa.compute.list_value_length(col), np.int64)
        flat = np.asarray(col.flatten(), np.float64)
        m = np.zeros((len(lens), int(lens.max(initial=0))))
        m[np.repeat(np.arange(len(lens)), lens), np.concatenate([np.arange(n) for n in lens]) if len(lens) else np.zeros(0, int)] = flat
        return m

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queries, best = None, [], {}

        def against(ids: np.ndarray, values: np.ndarray):
            if float(np.abs(values).max(initial=0)) * max((float(np.abs(q).max(initial=0)) for _, q in queries), default=0) * max(values.shape[1], 1) >= 2.0**53:
                values = np.vectorize(int, otypes=[object])(values)  # beyond exact doubles: Python's integers
            block_ = Shard(ids, values)
            for n, (i, q) in enumerate(queries):
                had_ids, had = best.get(n, (np.zeros(0, np.int64), np.zeros(0)))
                new_ids, new = block_.best(i, q if values.dtype != object else np.vectorize(int, otypes=[object])(q), k, had.astype(np.float64) if values.dtype != object else had)
                ids_, scores = np.concatenate((had_ids, new_ids)), np.concatenate((had, new))
                order = np.lexsort((ids_, -scores))[:k]
                best[n] = ids_[order], scores[order]

        def close():
            found = [(queries[n][0], a, int(s)) for n, (ids, scores) in best.items() for a, s in zip(ids.tolist(), scores.tolist())]
            cols = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

        for b in batches:
            kinds, of, ids = np.asarray(b.column("kind")), np.asarray(b.column("shard")), np.asarray(b.column("id"))
            for s in np.unique(of).tolist():
                if s != shard:
                    if best:
                        yield close()
                    shard, queries, best = s, [], {}
                for i in np.flatnonzero((of == s) & (kinds == 0)).tolist():
                    queries.append((int(ids[i]), np.array(b.column("v")[i].as_py(), np.float64)))
                at = np.flatnonzero((of == s) & (kinds == 1))
                for x in range(0, len(at), block):
                    own = at[x : x + block]
                    against(ids[own], matrix(b.column("v").take(pa.array(own))))
        if best:
            yield close()

    found = dealt.mapInArrow(lean(search), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
