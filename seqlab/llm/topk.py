"""Exact top-k by inner product: aggregation without random access.

Vectors are floored to integers. A cell holds some candidates and some queries. Within a cell each
component is a list of the candidates, sorted by value; a query reads every list from the end that
serves its sign, a stretch at a time. Of a candidate it then knows the sum of what it has read and,
for each list where the candidate has not come up, that the value lies between the list's far end
and the place reached: a lower and an upper bound of the score. Queries of a cell read in step, so that
the bounds of all candidates for all of them are a few matrix products. A query stops reading when no
outsider, seen or unseen, below the k-th lower bound can still qualify and few are left in doubt; their
scores are then resolved exactly in integers. At equal bounds a candidate stays, so ties are whole.

Each cell gives its k best for a query, and the k best of these are the answer. Cells are dealt by a
hash of the id, candidates once for every block of queries and queries once for every cell: blocks
of a stated query set against all rows.

Vectors that are null, or hold a null, NaN or infinity, take no part; shorter vectors count as if
zeros followed. Where numbers are so large that the bounds would not be exact, all scores are resolved.
Rows that repeat an id are candidates each;
of equal scores the smaller id comes first. Null ids take no part. Empty tables give no rows, and other
columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Candidates of a cell and queries of a block, about. Bounds leave out more in large cells, whose k-th best is higher.
CELL, BLOCK = 8192, 4096
#: Shares of each list after which bounds are looked at; stretches are short where many candidates leave.
SHARES = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8)
#: Queries of a cell that read in step.
STEP = 64
#: Integers below this are exact as floats.
EXACT = 2.0**53


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


class SortedLists:
    """Candidates of a cell with a sorted list for each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.n, self.width = self.vectors.shape
        self.floats = self.vectors.astype(np.float64)
        self.values = np.sort(self.floats, axis=0)
        order = np.argsort(self.vectors, axis=0, kind="stable")
        #: Each candidate's place in each list, from the low end.
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)
        self.largest = float(np.abs(self.floats).max(initial=0))
        #: Of each query the share of the lists that was read and the candidates that were left then, for those who want to know.
        self.read: dict[int, tuple[float, int]] = {}

    def bounds(self, up: np.ndarray, down: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (candidates x queries) when so much of each list is read: from the high end for the positive parts of queries, up, from the low end for the negative ones, down."""
        high, low = self.place >= self.n - read, self.place < read
        known = np.where(high, self.floats, 0.0) @ up.T + np.where(low, self.floats, 0.0) @ down.T
        not_high, not_low = (~high).astype(np.float64), (~low).astype(np.float64)
        ends = [not_high @ (up * a).T + not_low @ (down * b).T for a, b in ((self.values[0], self.values[-1]), (self.values[self.n - read], self.values[read - 1]))]
        return known + ends[0], known + ends[1]

    def best(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the ids and scores of the k best besides its id own (all, if fewer), ties to smaller ids."""
        doubt: list = [np.flatnonzero(self.ids != o) for o in own]
        few = max(4 * k, self.n // 16)
        if self.largest * float(np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)) < EXACT:
            for at in range(0, len(queries), STEP):
                live = np.arange(at, min(at + STEP, len(queries)))
                for share in SHARES:
                    live = live[[len(doubt[q]) > few for q in live]]
                    read = math.ceil(self.n * share)
                    if not len(live) or read >= self.n:
                        break
                    part = queries[live].astype(np.float64)
                    lower, upper = self.bounds(np.maximum(part, 0), np.minimum(part, 0), read)
                    for column, q in enumerate(live):
                        at_least = lower[doubt[q], column]
                        cut = len(at_least) - k
                        doubt[q] = doubt[q][upper[doubt[q], column] >= np.partition(at_least, cut)[cut]]
                        self.read[int(q)] = share, len(doubt[q])
        out = []
        for q, rest in zip(queries, doubt, strict=True):
            scores = self.vectors[rest] @ q
            top = np.lexsort((self.ids[rest], -scores))[:k]
            out.append((self.ids[rest][top], scores[top]))
        return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: for every query its k best candidates besides its own id. Vectors are arrays of integers."""
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("vector")).filter("id is not null and vector is not null")
    q, c = named(queries), named(candidates)
    cells, blocks = max(1, -(-c.count() // CELL)), max(1, -(-q.count() // BLOCK))
    dealt = c.select(F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "id", "vector")
    asked = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            a, b = matrix(left.column("vector")), matrix(right.column("vector"))
            width = max(a.shape[1], b.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
            lists = SortedLists(left.column("id").to_numpy(), a)
            own = right.column("id").to_numpy()
            found = lists.best(b, k, own)
            out = [np.repeat(own, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    near = dealt.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def floored(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col and vector: floor(scale * x) of every component; vectors with nulls or without finite values are left out."""
    x = F.col(vector_col).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(whole).select(id_col, F.transform(x, lambda v: F.floor(v * scale)).alias("vector"))


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = floored(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


OP1_SQL = """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select * from v where vec_id % 100 = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum([q.e[i] * v.e[i] for i in range(1, len(v.e) + 1)]) as bigint) as score from q join v on q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
