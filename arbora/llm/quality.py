"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text.
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of labellers, whatever the corpus) estimates each labeller's accuracy and
the share of good texts, and thereby every pattern's posterior. The posteriors
of a sample of at most TRAIN_ROWS documents train a linear scorer on hashed
words and word shapes; it then scores every whole text.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, only, stash

#: The bound on the sample that trains the scorer, taken by a hash of doc_id and text.
TRAIN_ROWS = 6000
#: The bound on the sample's features together, which are some 50 MB; of very long texts fewer train.
TRAIN_FEATURES = 4_000_000
FEATURES = 1 << 15
KEEP = 0.5
GOOD, BAD, NONE = 1, -1, 0
#: What is believed of a labeller beforehand, by class (bad, good) and vote (bad, good), and the share of the rows that it counts for:
#: a vote of bad is rarely wrong, a vote of good says little, and no vote says nothing.
PRIOR = np.array([[0.5, 0.5], [0.005, 0.995]])
PRIOR_SHARE = 0.1

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(b"the of and to in is that it for was on are as with be by this at from or an der die das und ist von zu den mit sich des auf dem ein eine nicht le la les et un une est que des du dans pour par sur el los las de y en es por con para del se su al lo como".split())

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|<>{}[]~^=\\@_+!")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


class Memo:
    """What a function gives for words; the memory is emptied when it is full."""

    def __init__(self, of: Callable[[bytes], int], most: int = 200_000) -> None:
        self.of, self.most, self.known = of, most, {}

    def get(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[word] = self.of(word)
        return found

    def all(self, words: list[bytes]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) >= self.most:
                self.known.clear()
            for w in set(words).difference(self.known):
                self.known[w] = self.of(w)
            return list(map(self.known.__getitem__, words))


#: What a word's flags say of it.
_ENDS, _STOPS, _MARK = 1, 2, 4
_flags = Memo(lambda word: _ENDS * (word[-1:] in (b".", b"!", b"?")) + _STOPS * (word.lower() in STOP_WORDS) + _MARK * (len(word) == 1 and not word.isalnum()))


class Words:
    """A text's words, with their flags."""

    def __init__(self, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.raw, self.words = np.frombuffer(raw, dtype=np.uint8), raw.split()
        self.lines = [x for x in raw.split(b"\n") if x.strip()]
        self.flags = np.array(_flags.all(self.words), dtype=np.int8)

    def share(self, flag: int) -> float:
        """The share of words that have a flag."""
        return np.count_nonzero(self.flags & flag) / len(self.words)


def _between(x: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    return BAD if x < bad_below or x > bad_above else GOOD if good_from <= x <= good_to else NONE


def _symbols(t: Words) -> int:
    return _between(np.count_nonzero(_SYMBOL[t.raw]) / len(t.raw), -1, 0, 0.01, 0.05) if len(t.raw) >= 20 else NONE


def _capitals(t: Words) -> int:
    letters = np.count_nonzero(_LETTER[t.raw])
    return _between(np.count_nonzero(_UPPER[t.raw]) / letters, -1, 0, 0.2, 0.4) if letters >= 20 else NONE


def _repeats(t: Words) -> int:
    return _between(1 - len(set(t.lines)) / len(t.lines), -1, 0, 0.1, 0.3) if len(t.lines) >= 4 else NONE


def _length(t: Words) -> int:
    return BAD if not t.words else GOOD if len(t.words) >= 40 else NONE


def _sentences(t: Words) -> int:
    return _between(t.share(_ENDS), 0.01, 0.02, 0.3, 0.5) if len(t.words) >= 20 else NONE


def _stop_words(t: Words) -> int:
    return _between(t.share(_STOPS), 0.04, 0.1, 1, 1) if len(t.words) >= 20 else NONE


def _bare_marks(t: Words) -> int:
    """Words without any letter or digit."""
    return _between(t.share(_MARK), -1, 0, 0.03, 0.15) if len(t.words) >= 20 else NONE


def _variety(t: Words) -> int:
    return _between(len(set(t.words)) / len(t.words) ** 0.8, 0.5, 0.7, 99, 99) if len(t.words) >= 50 else NONE


def _stutter(t: Words) -> int:
    """Words that repeat the word before them."""
    return _between(sum(map(operator.eq, t.words, itertools.islice(t.words, 1, None))) / len(t.words), -1, 0, 0.05, 0.2) if len(t.words) >= 5 else NONE


LABELLERS: tuple[Callable[[Words], int], ...] = (_symbols, _capitals, _repeats, _length, _sentences, _stop_words, _bare_marks, _variety, _stutter)


def votes(text: str | Words | None) -> list[int]:
    """Each labeller's vote on a whole text; a null text is an empty one."""
    t = text if isinstance(text, Words) else Words(text)
    return [f(t) for f in LABELLERS]


_LOWER, _CAPS, _DIGITS = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")
HALF = FEATURES // 2
#: The shape of a word that repeats the word before it.
_AGAIN = HALF + xxhash.xxh3_64_intdigest("again") % HALF
#: A code has the place of the word's shape in its low bits, then that of the word.
_BITS = 15
_KINDS = bytes(97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58 else c for c in range(256))


def _shape(kinds: bytes) -> int:
    shape = _DIGITS.sub(b"0", _CAPS.sub(b"A", _LOWER.sub(b"a", kinds)))[:12]
    return HALF + xxhash.xxh3_64_intdigest(b"s" + shape) % HALF


_shapes = Memo(_shape)
_codes = Memo(lambda word: _shapes.get(word.translate(_KINDS)) | xxhash.xxh3_64_intdigest(b"w" + word.lower()) % HALF << _BITS)


def features(text: str | Words | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text's hashed words and word shapes; each half is scaled to length 1."""
    words = text.words if isinstance(text, Words) else (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    codes = np.array(_codes.all(words), dtype=np.int64)
    word, shape = codes >> _BITS & HALF - 1, codes & FEATURES - 1
    shape[1:][word[1:] == word[:-1]] = _AGAIN
    n = np.bincount(np.concatenate([word, shape]), minlength=FEATURES)
    at = np.nonzero(n)[0]
    v = np.sqrt(n[at].astype(np.float32))
    cut = np.searchsorted(at, HALF)
    for half in (slice(0, cut), slice(cut, None)):
        v[half] /= np.linalg.norm(v[half]) or 1
    return at.astype(np.int32), v


def fit_labellers(patterns: list[tuple[list[int], int]], rounds: int = 100) -> tuple[np.ndarray, dict[tuple[int, ...], float], float]:
    """EM over (votes, count): each labeller's probabilities [labeller, class, vote] of the votes bad and good if it votes, each pattern's posterior of good, and the prior."""
    votes_ = np.array([p for p, _ in patterns], dtype=np.int64).reshape(len(patterns), len(LABELLERS))
    n = np.array([c for _, c in patterns], dtype=np.float64)
    post = np.where((votes_ == BAD).any(axis=1), 0.05, 0.95)
    belief = PRIOR_SHARE * n.sum() * PRIOR
    hot = np.stack([votes_ == v for v in (BAD, GOOD)], axis=2)
    for _ in range(rounds):
        prior = (1 + n @ post) / (2 + n.sum())
        table = np.stack([b + np.einsum("p,plv->lv", n * w, hot) for b, w in zip(belief, (1 - post, post), strict=True)], axis=1)
        table = (1 + table) / (2 + table.sum(axis=2, keepdims=True))
        logs = np.einsum("plv,lcv->pc", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return table, {tuple(int(x) for x in p): float(w) for p, w in zip(votes_, post, strict=True)}, float(prior)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by Adagrad over the whole sample; rows have at least one feature each."""
    w, b = np.zeros(FEATURES), 0.0
    if not rows:
        return w, b
    size = np.array([len(r[0]) for r in rows])
    at, v, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64), np.array([r[2] for r in rows])
    begins = np.cumsum(size) - size
    # the same entries by feature
    order = np.argsort(at, kind="stable")
    row, by_feature = np.repeat(np.arange(len(rows)), size)[order], v[order]
    known, firsts = np.unique(at[order], return_index=True)
    gw, gb = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(v * w[at], begins) + b, -30, 30)))
        e = (p - y) / len(rows)
        g = decay * w
        g[known] += np.add.reduceat(by_feature * e[row], firsts)
        gw, gb = gw + g * g, gb + e.sum() ** 2
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.5 * e.sum() / np.sqrt(gb)
    return w, float(b)


class QualityModel:
    """The fitted labellers and scorer."""

    def __init__(self, table: np.ndarray, posteriors: dict[tuple[int, ...], float], prior: float, weights: np.ndarray, bias: float) -> None:
        self.table, self.posteriors, self.prior, self.weights, self.bias = table, posteriors, prior, weights.astype(np.float32), bias

    def score(self, text: str | None) -> float:
        at, v = features(text)
        return float(1 / (1 + np.exp(-np.clip(float(v @ self.weights[at]) + self.bias, -30, 30)))) if len(at) else 0.0


def _rows(docs: DataFrame) -> DataFrame:
    return dealt(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _sample(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(places, values, votes) of the rows of the smallest hashes: TRAIN_ROWS rows with TRAIN_FEATURES features at most, but one at least."""
    first = rows.select("h", F.size("at").alias("n")).orderBy("h").limit(TRAIN_ROWS).collect()
    many = max(1, int(np.searchsorted(np.cumsum([r.n for r in first]), TRAIN_FEATURES, side="right")))
    if not first:
        return []
    got = rows.where(F.col("h") <= first[:many][-1].h).limit(many).select("h", "at", "v", "pattern").toArrow()
    columns = [got.column(c).combine_chunks() for c in ("at", "v", "pattern")]
    lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in columns]
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    return [(*(x[o[k] : o[k + 1]] for o, x in lists[:2]), lists[2][1][lists[2][0][k] : lists[2][0][k + 1]].tolist()) for k in order]


def fit(docs: DataFrame) -> QualityModel:
    """The model: all rows vote and count in the EM; a bounded sample, by a hash of id and text, trains the scorer."""
    n = docs.count()
    below = F.lit(min(2**63 - 1, -(2**63) + int(2**64 * 0.9 * TRAIN_ROWS) // max(n, 1)))
    rows = _rows(docs).withColumn("h", F.xxhash64(F.lit("train"), "doc_id", "text")).select("text", "h", (F.col("h") <= below).alias("chosen"))

    def vote(everything: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                patterns, at, v = [], [], []
                for text, chosen in zip(batch.column(0), batch.column(2).to_pylist(), strict=True):
                    t = Words(text.as_py())
                    got = features(t) if (chosen or everything) and t.words else (None, None)
                    patterns.append(votes(t))
                    at.append(got[0])
                    v.append(got[1])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(patterns, pa.list_(pa.int8())), pa.array(at, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32()))], ["h", "pattern", "at", "v"])

        return read

    schema = "h long, pattern array<tinyint>, at array<int>, v array<float>"
    voted = stash(rows.mapInArrow(vote(False), schema), "votes")
    counted = voted.groupBy("pattern").count().collect()
    table, posteriors, prior = fit_labellers(sorted((list(r[0]), r[1]) for r in counted))
    sample = _sample(voted.where("at IS NOT NULL"))
    if not sample and n:  # all rows with words share a few hashes: they are copies of a few rows
        sample = _sample(stash(rows.where("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").limit(TRAIN_ROWS).mapInArrow(vote(True), schema).where("at IS NOT NULL"), "votes"))
    weights, bias = fit_scorer([(at, v, posteriors[tuple(p)]) for at, v, p in sample])
    return QualityModel(table, posteriors, prior, weights, bias)


def quality(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1, six decimals), kept (score >= keep).

    Null and empty texts score 0 and aren't kept. Repeated rows and null ids
    come out as they come in, an empty table gives no rows, other columns are
    ignored. Very long texts are read whole, by labellers and scorer.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(shared.value.score(t.as_py()), 6) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return _rows(docs).mapInArrow(score, "doc_id long, score double").withColumn("kept", F.col("score") >= keep)


def keep_good(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the classifier keeps, with all of their columns, whatever their names; see quality.

    Rows with a null or empty text go; of repeated rows and rows with null ids
    all stay or go alike; an empty table stays empty.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([shared.value.score(t.as_py()) >= keep for t in texts], pa.bool_()))

    return dealt(docs).mapInArrow(good, docs.schema)
