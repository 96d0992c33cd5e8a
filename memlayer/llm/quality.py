"""Quality classification by supervised subword embeddings.

A word's vector is the mean of learned vectors of the hashed word and of its hashed character n-grams; each pair of neighbouring
words adds that of a bigram, the mean of the hashed pair and of the hashed pair of their first ``HEAD`` characters. A document's
vector is the mean over its words and bigrams; a linear softmax layer gives the class. Training is plain stochastic gradient descent
in numpy over at most ``SAMPLE`` labelled documents of each label, chosen by a hash of their id; a fifth of them is kept apart to
calibrate the score, so that the threshold parts the labels best. The whole model is linear up to the softmax, so scoring needs one number per word and
one per bigram bucket; whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import training_row

#: Buckets of words and character n-grams, and, behind them, of word bigrams.
BUCKETS = 1 << 16
PAIRS = 1 << 17
DIM = 10
GRAMS = (3, 4)
HEAD = 2
EPOCHS = 12
RATE = 8.0
#: Documents of each label that a model is trained on, at most, and the bytes of the longest one.
SAMPLE = 1500
LONGEST = 1 << 20
THRESHOLD = 0.7
#: Words that a worker remembers, at most.
MEMO = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at both ends."""
    marked = f"<{word}>"
    digest = xxhash.xxh32_intdigest
    out = [digest(marked, 1) % BUCKETS]
    for n in GRAMS:
        out += [digest(marked[i : i + n], 2) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def names(word: str) -> tuple[int, int]:
    """Hashes of a word and of its first characters."""
    return xxhash.xxh64_intdigest(word, 5), xxhash.xxh64_intdigest(word[:HEAD], 6)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """(words - 1, 2): buckets of the bigrams of words that follow each other, from the words' ``names``."""
    with np.errstate(over="ignore"):
        x = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (BUCKETS + (x >> np.uint64(32)) % np.uint64(PAIRS)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which sum to 1 (none for a text without words)."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    total = 2 * len(words) - 1
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    index, weight = [], []
    for w, n in kinds.items():
        f = features(w)
        index += f
        weight += [n / total / len(f)] * len(f)
    pairs = pair_buckets(np.array([names(w) for w in words], np.uint64)).ravel()
    at, inverse = np.unique(np.concatenate([np.array(index, np.int64), pairs]), return_inverse=True)
    return at, np.bincount(inverse, np.concatenate([np.array(weight), np.full(len(pairs), 0.5 / total)]), len(at))


def fit(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 7) -> np.ndarray:
    """Train and return each bucket's log-odds for label 1; zeros for one label or no rows."""
    bags = [(bag(t), y) for t, y in rows if t and t.split()]
    if len({y for _, y in bags}) < 2:
        return np.zeros(BUCKETS + PAIRS)
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / dim, 1 / dim, (BUCKETS + PAIRS, dim))
    out = np.zeros((dim, 2))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in r.permutation(len(bags)):
            (at, weight), y = bags[k]
            lr = rate * (1 - done / steps)
            hidden = weight @ vectors[at]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * 0.25 * np.outer(hidden, p)
            vectors[at] -= lr * np.sqrt(weight)[:, None] * back * 0.25
            done += 1
    return vectors @ (out[:, 1] - out[:, 0])


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(_id, _h, _y, _text)``: at most ``size`` learnable documents of each label, by a hash of their id.

    An id whose labels differ teaches nothing; rows that repeat both id and text count once, texts of over ``LONGEST`` bytes not.
    Ids are chosen before any text is read, by a top-k over all partitions, so no task sees a whole label.
    """
    rows = labels.where(training_row(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    rows = rows.where("_y = _z").drop("_z")

    def first(df: DataFrame, *more: str) -> DataFrame:
        each = [df.where(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(3)), "_id", *more).limit(size) for y in (0, 1)]
        return each[0].union(each[1])

    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where(F.octet_length("_text") <= LONGEST)
    found = texts.join(F.broadcast(first(rows)), F.col("_doc") == F.col("_id")).withColumn("_h", F.xxhash64("_text"))
    return first(found.dropDuplicates(["_id", "_h"]).select("_id", "_h", "_y", "_text"), "_h")


def odds(model: np.ndarray, text: str | None) -> float:
    at, weight = bag(text)
    return float(weight @ model[at])


def calibrated(scores: np.ndarray, labels: np.ndarray, threshold: float = THRESHOLD) -> float:
    """What to add to log-odds so that ``threshold`` parts the labels with the fewest errors (ties: the middle of the widest gap)."""
    if len(np.unique(labels)) < 2:
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    # errors with the cut before each place: ones below it, zeros from it on
    errors = np.r_[0, np.cumsum(y)] + (len(y) - y.sum()) - np.r_[0, np.cumsum(1 - y)]
    inner = np.arange(1, len(s))
    best = inner[errors[inner] == errors[inner].min()]
    cut = best[np.argmax(s[best] - s[best - 1])]
    return float(np.log(threshold / (1 - threshold)) - (s[cut] + s[cut - 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, **columns: str) -> np.ndarray:
    """Fit on the labelled rows that may be learned from: log-odds of each bucket, and last the shift that calibrates."""
    chosen = sorted(sample(docs, labels, size, **columns).toLocalIterator(), key=lambda x: (x._id, x._h))
    apart = [x for x in chosen if x._h % 5 == 0]
    model = fit([(x._text, x._y) for x in chosen if x._h % 5])
    return np.append(model, calibrated(np.array([odds(model, x._text) for x in apart]), np.array([x._y for x in apart])))


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: the softmax output for label 1 of every whole text.

    Null and empty texts and texts of white space have no vector and score 0.5. One row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shift, memo = shared.value[:-1], shared.value[-1], Words(shared.value)
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            for at in range(0, batch.num_rows, 256):
                split = [(t or "").split() for t in batch.column(1).slice(at, 256).to_pylist()]
                size = np.array([len(words) for words in split])
                if not size.sum():
                    continue
                own, hashes = memo(split)
                ends = np.cumsum(size)
                pairs = np.append(table[pair_buckets(hashes)].mean(axis=1), 0.0)
                pairs[ends[size > 0] - 1] = 0.0  # no bigram reaches over two texts
                some = size > 0
                z = shift + np.add.reduceat(own + pairs, (ends - size)[some]) / (2 * size[some] - 1)
                out[at + np.flatnonzero(some)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, score double")


class Words:
    """The log-odds and hash of each word, remembered over the batches of a task."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.place: dict[str, int] = {}
        self.odds, self.names = np.zeros(0), np.zeros((0, 2), np.uint64)

    def __call__(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > MEMO:
            self.__init__(self.table)
        missing = list(dict.fromkeys(w for words in split for w in words if w not in self.place))
        if missing:
            each = [features(w) for w in missing]
            size = np.array([len(f) for f in each])
            flat = np.fromiter((i for f in each for i in f), np.int64, int(size.sum()))
            self.odds = np.append(self.odds, np.add.reduceat(self.table[flat], np.cumsum(size) - size) / size)
            self.names = np.concatenate([self.names, np.array([names(w) for w in missing], np.uint64)])
            first = len(self.place)
            self.place.update((w, first + k) for k, w in enumerate(missing))
        at = np.fromiter((self.place[w] for words in split for w in words), np.int64)
        return self.odds[at], self.names[at]
