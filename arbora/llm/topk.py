"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become integers floor(256 x). A block's index holds, for every
level of |x|, the postings of that level; levels are processed from the
greatest down. After each level a vector's score is known up to its unprocessed
postings, whose part is at most the product of the lengths of the query and of
the vector over them, so it has a lower and an upper bound. A query block stops
at a level only if the vectors whose upper bound reaches a query's k-th best
lower bound are few; all of those are rescored exactly, so the result does not
depend on where it stops. Scores of whole blocks of queries are accumulated at
once, hence a level's postings are a matrix with zeros elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import only, partitions, stash

SCALE = 256
#: Vectors of an index, and queries that are searched at once.
BLOCK = 8192
QUERIES = 256
#: Lower ends of the levels of |x|, as shares of the block's greatest.
LEVELS = (0.3, 0.18, 0.1, 0.05)
#: A query block stops when the possible members are at most this share of its scores.
FEW = 0.08


class ImpactIndex:
    """The postings of a block of integer vectors by level of impact; reach is the greatest |component| of a query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: int) -> None:
        size = np.abs(vectors)
        most = vectors.shape[1] * int(size.max(initial=1)) * max(reach, 1)
        # sums of products below 2^24 are exact in float32, below 2^53 in float64; beyond, scores are known up to an error
        self.type = np.float32 if most < 1 << 24 else np.float64
        self.error = 0.0 if most < 1 << 53 else most * 2.0**-44
        self.ids, self.vectors = ids, vectors if most < 1 << 62 else vectors.astype(object)
        top = max(int(size.max(initial=0)), 1)
        ends = sorted({int(top * x) for x in LEVELS} - {0}, reverse=True) + [0]
        self.segments, above = [], top + 1
        for low in ends:
            # postings with low < |x| < above; what is left after them is at most low
            here = (size < above) & (size > low) if low else size < above
            left = np.where(size <= low, vectors, 0).astype(np.float64)
            self.segments.append((low, np.where(here, vectors, 0).astype(self.type), (size <= low).astype(self.type), np.sqrt((left * left).sum(axis=1))))
            above = low + 1

    def search(self, rows: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query's place, vector id, score) of each query's k best, ties to the smaller id; own and rows are row ids, and a query's own row takes no part."""
        q = queries.astype(self.type)
        square = queries.astype(np.float64) ** 2
        score = np.zeros((len(q), len(self.ids)), dtype=self.type)
        same = own[:, None] == rows[None, :]
        k_, possible = min(k, len(self.ids)), ~same
        for low, values, left, length in self.segments:
            score += q @ values.T
            # by Cauchy and Schwarz over the postings that are left; a little more than rounding can lose
            slack = np.sqrt(square @ left.T.astype(np.float64)) * length * (1 + 1e-9) + (1 if low else 0) + self.error
            floor_ = np.where(same, -np.inf, score - slack)
            kth = np.partition(floor_, len(self.ids) - k_, axis=1)[:, len(self.ids) - k_][:, None]
            possible = (score + slack >= kth) & ~same
            if possible.mean() <= FEW:
                break
        out = []
        for r in range(len(q)):
            at = np.nonzero(possible[r])[0]
            exact = self.vectors[at] @ queries[r].astype(self.vectors.dtype)
            best = sorted(zip((-exact).tolist(), self.ids[at].tolist(), strict=True))[:k]
            out += [(r, i, -s) for s, i in best]
        return out


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): integer vectors of the rows without nulls and non-finite components; row tells rows with one vec_id apart.

    Rows with a null id, a null or an empty vector take no part.
    """
    rows = only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    sound = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**54, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component beyond 2^54 has no exact integer"))))
    return sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.cast("array<bigint>").alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row whose vec_id is divisible by every.

    Score: the integer inner product over the components that both have,
    exact for components of any size; one beyond a long raises an error. Ties go
    to the smaller vec_id; fewer rows than k give fewer. Rows that share a
    vec_id are rows of their own, as queries and as candidates; an empty table
    gives no rows; other columns are ignored. Every block of vectors is indexed
    once and streams all queries; it returns at most k rows a query, and these
    are merged.
    """
    rows = stash(quantised(vectors), "vectors")
    n, width, reach = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(1))).first()
    blocks = max(1, -(-n // BLOCK))
    parts = min(blocks, max(32, 2 * partitions(vectors.sparkSession)))
    pool = rows.select((F.pmod(F.xxhash64("row"), F.lit(blocks))).alias("b"), F.lit(False).alias("asks"), "row", "vec_id", "v")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(every_block.alias("b"), F.lit(True).alias("asks"), "row", "vec_id", "v")
    dealt = pool.unionByName(asked).repartitionById(parts, (F.col("b") % parts).cast("int")).sortWithinPartitions("b", "asks", "row")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, own = None, [], None, None
        for batch in batches:
            found = []
            b, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.nonzero((b[1:] != b[:-1]) | (asks[1:] != asks[:-1]))[0] + 1, [len(b)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                ids, vec = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (2, 3))
                values = _matrix(batch.column(4).slice(lo, hi - lo), width)
                if b[lo] != at:
                    at, held, index = b[lo], [], None
                if not asks[lo]:
                    held.append((ids, vec, values))
                    continue
                if index is None and held:
                    own = np.concatenate([x[0] for x in held])
                    index = ImpactIndex(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), reach)
                    held = []
                for s in range(0, len(ids) if index else 0, QUERIES):
                    piece = slice(s, s + QUERIES)
                    found += [(ids[piece][r], vec[piece][r], i, x) for r, i, x in index.search(own, ids[piece], values[piece], k)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), pa.int64()) for c in columns], ["row", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(walk, "row long, query_id long, vec_id long, score long")
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
