"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every 3-word sequence of an item is a seed. One pass over the documents finds
where seeds occur; a document and an item are a pair if they share two seeds,
however frequent: what an edit leaves of an item can be just its frequent
phrases, while one shared phrase of three words is mostly chance. Around the
seeds the words that both have are counted, which bounds the score from above;
where it can be high enough, the item is aligned with the surrounding words.
The score is that of the best local alignment over that of a full copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, only, stash
from .shingles import gram_hashes, word_hashes, words_of

SEED_WORDS = 3
#: Distinct seeds that a pair shares at least; all of them, if an item has fewer.
SHARED = 2
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: An item of fewer words must be found whole.
SHORT = 5
#: Seeds of items that are sent to all executors at most (16 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
_EDGE = b".,;:!?\"'()[]"


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without the marks at their ends; marks alone are no words."""
    return [w for w in (w.strip(_EDGE) for w in words_of(text)) if w]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score, and its first and last word in doc, inclusive."""
    n = len(doc)
    at = np.arange(n)
    h, start, best = np.zeros(n, dtype=np.int64), at.copy(), (0, 0, 0)
    for w in item:
        diagonal = np.concatenate(([0], h[:-1])) + np.where(doc == w, MATCH, MISMATCH)
        from_ = np.where(np.concatenate(([0], h[:-1])) > 0, np.concatenate(([0], start[:-1])), at)
        up = h + GAP
        cell, begun = np.where(diagonal >= up, diagonal, up), np.where(diagonal >= up, from_, start)
        begun = np.where(cell > 0, begun, at)
        cell = np.maximum(cell, 0)
        # gaps along doc: the best earlier cell less one for each step
        lifted = cell - GAP * at
        top = np.maximum.accumulate(lifted)
        lead = np.maximum.accumulate(np.where(lifted == top, at, 0))
        h, start = top + GAP * at, begun[lead]
        h, start = np.where(h > 0, h, 0), np.where(h > 0, start, at)
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(start[k]), k)
    return best


def shared_words(doc: np.ndarray, item: np.ndarray) -> int:
    """As many words as an alignment can match at most."""
    return min(int(np.isin(doc, item).sum()), int(np.isin(item, doc).sum()))


def _items(benchmark: DataFrame) -> DataFrame:
    return only(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item"))


def _seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, j, n): the seeds of all items, their places and their words; an item of fewer words is one seed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, ids, places, sizes = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = word_hashes(plain_words(text))
                g = _signed(gram_hashes(h, SEED_WORDS))
                seeds += g.tolist()
                ids += [i] * len(g)
                places += range(len(g))
                sizes += [min(SEED_WORDS, len(h))] * len(g)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], ["seed", "item_id", "j", "n"])

    return items.mapInArrow(cut, "seed long, item_id long, j int, n int")


def _grams(text: str | None, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All seeds-to-be of a text and their places, for each of the seeds' lengths."""
    h = word_hashes(plain_words(text))
    grams = [_signed(gram_hashes(h, n)) for n in lengths if n <= len(h)]
    if not grams:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(grams), np.concatenate([np.arange(len(g)) for g in grams])


class SeedTable:
    """The seeds of all items, ascending, with their items' numbers and how many of its seeds each item needs."""

    def __init__(self, seeds: np.ndarray, items: np.ndarray) -> None:
        order = np.lexsort((items, seeds))
        both = np.stack([seeds[order], items[order]])
        first = np.ones(both.shape[1], dtype=bool)
        first[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
        self.seeds, self.items = both[:, first]
        self.need = np.minimum(SHARED, np.bincount(self.items, minlength=1))

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """Places among grams of the seeds of items that the grams hold enough seeds of."""
        held, inverse = np.unique(grams, return_inverse=True)
        lo, hi = np.searchsorted(self.seeds, held, "left"), np.searchsorted(self.seeds, held, "right")
        n = hi - lo
        if not n.any():
            return np.zeros(0, dtype=np.int64)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        enough = np.bincount(self.items[at], minlength=len(self.need)) >= self.need
        good = np.zeros(len(held), dtype=bool)
        np.logical_or.at(good, np.repeat(np.arange(len(held)), n), enough[self.items[at]])
        return np.nonzero(good[inverse])[0]


def _hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, text, seeds, at): the rows of docs in which seeds occur, and where."""
    rows = dealt(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    lengths = sorted(r[0] for r in seeds.select("n").distinct().collect())  # SEED_WORDS values at most
    few = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    table = None
    if few:
        got = seeds.select("seed", "item_id").toArrow()
        numbers = np.unique(got.column("item_id").to_numpy(), return_inverse=True)[1]
        table = SeedTable(got.column("seed").to_numpy(), numbers)
    wanted = rows.sparkSession.sparkContext.broadcast(table)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = wanted.value
        for batch in batches:
            take, found, places = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                g, p = _grams(text, lengths)
                at = np.arange(len(g)) if sought is None else sought.shared(g)
                if len(at):
                    take.append(k)
                    found.append(g[at])
                    places.append(p[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(take, pa.int64())) for c in batch.columns), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "text", "seeds", "at"])

    return rows.mapInArrow(find, "doc_id long, text string, seeds array<long>, at array<int>")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, item_id, score, first_word, last_word): documents and the items that they hold, wholly, in part or edited.

    Score: the best local alignment of words over a full copy's (six decimals);
    pairs from least on, and for items of fewer than five words only full
    copies. A pair is found if it shares two distinct runs of three words (an
    item with fewer: all of them). Words are lower-cased and lose the marks at
    their ends. Null and empty texts and items hold nothing; a document row that
    is repeated gives its pairs once; rows with null ids are left out; empty
    tables give no rows; other columns are ignored. Whole documents are
    searched, however long.
    """
    items = stash(_items(benchmark).where("item_id IS NOT NULL").dropDuplicates(["item_id"]), "items")
    seeds = stash(_seeds(items), "seeds")
    hits = stash(_hits(docs.where("doc_id IS NOT NULL"), seeds).withColumn("row", F.monotonically_increasing_id()), "hits")
    each = hits.select("row", F.explode(F.arrays_zip("seeds", "at")).alias("x")).select("row", F.col("x.seeds").alias("seed"), F.col("x.at").alias("p"))
    needs = seeds.select("seed", "item_id").distinct().groupBy("item_id").agg(F.least(F.lit(SHARED), F.count("*")).alias("need"))
    met = each.join(seeds, "seed").select("row", "item_id", "seed", (F.col("p") - F.col("j")).alias("d")).distinct()
    pairs = met.groupBy("row", "item_id").agg(F.array_sort(F.collect_set("d")).alias("d"), F.size(F.collect_set("seed")).alias("n")).join(needs, "item_id").where("n >= need")
    both = pairs.join(hits.select("row", "doc_id", "text"), "row").join(items, "item_id").select("doc_id", "item_id", "text", "item", "d")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, dtype=np.uint64))
        for batch in batches:
            out: list[tuple] = []
            for doc, item_id, text, item, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] is not text:
                    last = (text, word_hashes(plain_words(text)))
                words, sought = last[1], word_hashes(plain_words(item))
                # an alignment of the least score has at most pad words more than the item
                pad, best, windows = 1 + math.ceil(MATCH * len(sought) * (1 - least) / -GAP), (0, 0, 0), []
                for d in at:  # ascending; windows that overlap become one
                    lo, hi = max(0, d - pad), min(len(words), d + len(sought) + pad)
                    if windows and lo <= windows[-1][1]:
                        windows[-1][1] = max(hi, windows[-1][1])
                    else:
                        windows.append([lo, hi])
                for lo, hi in windows:
                    if MATCH * shared_words(words[lo:hi], sought) < least * MATCH * len(sought):
                        continue
                    got = align(words[lo:hi], sought)
                    if got[0] > best[0]:
                        best = (got[0], got[1] + lo, got[2] + lo)
                value = best[0] / (MATCH * len(sought))
                if value >= (1.0 if len(sought) < SHORT else least):
                    out.append((doc, item_id, round(value, 6), best[1], best[2]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return both.mapInArrow(score, "doc_id long, item_id long, score double, first_word long, last_word long").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all of their columns, whatever their names; see contaminated.

    Texts are known by 64-bit hashes, so that rows with null or repeated ids are
    judged by their own texts; repeated rows stay or go alike; rows with null or
    empty texts stay; empty tables drop nothing.
    """
    known = F.xxhash64(docs["`text`"].cast("string"))
    texts = docs.select(known.alias("doc_id"), docs["`text`"].alias("text"))
    found = stash(contaminated(texts, benchmark, least).select(F.col("doc_id").alias("_leaks")).distinct(), "leaks")
    return docs.join(found, known == found["_leaks"], "left_anti")
