"""Retrieval of cases within their own corpora: many small ones, each scored as a whole where its chunks and cases meet."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from memlayer.functions.text import raw_tokens, whitespace_tokens
from memlayer.functions.vectors import hashed_rows
from memlayer.operators.retrieval import B, K1

#: Cases of a corpus that meet in one task, roughly; its chunks are copied for each such part.
PART = 2048
#: Scores and terms of them that are held at once, roughly.
HELD_CELLS = 1 << 19


def corpora(chunks: DataFrame) -> DataFrame:
    """``chunks(corpus, id, text)`` -> ``(corpus, texts)``, a corpus's texts in the order of their ids."""
    rows = chunks.where("corpus is not null").groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("s"))
    return rows.select("corpus", F.col("s.text").alias("texts"))


def best_places(corpora: DataFrame, cases: DataFrame, k: int, hybrid: bool = False) -> DataFrame:
    """``(corpus, texts)`` and ``cases(case_id, corpus, question)`` -> ``(case_id, corpus, places)``: best ``k`` places in ``texts``, best first.

    By BM25 over the corpus or, if ``hybrid``, its weighted sum with the cosine of hashing embeddings (RET2, RET6); each case is in the
    result. Scores are ranked by 9 digits, ties by place. No row for a pair of chunk and case leaves its task.
    """
    counted = cases.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    parts = F.broadcast(counted.select("corpus", F.ceil(F.col("n") / PART).cast("int").alias("parts")))  # a row for PART cases at most
    parted = lambda rows: rows.join(parts, "corpus", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    texts = corpora.select("corpus", F.posexplode("texts").alias("place", "text"))
    texts = parted(texts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("corpus", "part", "place", "text")
    asked = parted(cases).select("corpus", F.pmod(F.xxhash64("case_id"), F.col("parts")).cast("int").alias("part"), "case_id", F.col("question").alias("text"))
    rows = texts.unionByName(asked, allowMissingColumns=True)
    rows = rows.repartition("corpus", "part").sortWithinPartitions(F.col("corpus"), F.col("part"), F.asc_nulls_last("place"))
    tokens = lambda of: F.coalesce(of("text"), F.array().cast("array<string>"))
    columns = ["corpus", "part", F.col("place").isNull().alias("asked"), "case_id", tokens(whitespace_tokens).alias("tokens")]
    rows = rows.select(*columns, *([tokens(raw_tokens).alias("raw")] if hybrid else []))
    schema = StructType([rows.schema["case_id"], rows.schema["corpus"]]).add("places", ArrayType(IntegerType()))
    return rows.mapInArrow(lambda batches: best_batches(batches, k, hybrid), schema)


def best_batches(batches: Iterator[pa.RecordBatch], k: int, hybrid: bool) -> Iterator[pa.RecordBatch]:
    """Rows in runs, the chunks of a part of a corpus and then its cases -> a row for each case; a corpus's chunks are kept, cases pass."""
    key, held, index = None, [], None
    for batch in batches:
        tokens = _whole(batch.column("tokens"))
        vectors = hashed_rows(_whole(batch.column("raw"))) if hybrid else None
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("corpus", "part", "asked")), strict=True))
        rows, sizes, places = [], [], []
        starts = [n for n in range(len(marks)) if not n or marks[n] != marks[n - 1]]
        for a, b in pairwise([*starts, len(marks)]):
            if marks[a][:2] != key:
                key, held, index = marks[a][:2], [], None
            part = tokens.slice(a, b - a), vectors[a:b] if hybrid else None
            if not marks[a][2]:
                held.append(part)
                continue
            index = index or CorpusIndex(held)
            held = []
            rows.append(np.arange(a, b))
            for found in index.best(*part, k):
                sizes.append(found[0])
                places.append(found[1])
        if rows:
            at = pa.array(np.concatenate(rows))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(places).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("case_id").take(at), batch.column("corpus").take(at), lists], names=["case_id", "corpus", "places"])


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class CorpusIndex:
    """Postings of one corpus by term, with the weight of each, and its chunks' vectors."""

    def __init__(self, held: list[tuple[pa.Array, np.ndarray | None]]):
        tokens = pa.concat_arrays([t for t, _ in held]) if held else pa.array([], pa.list_(pa.string()))
        self.vectors = np.concatenate([v for _, v in held]) if held and held[0][1] is not None else None
        self.chunks = n = len(tokens)
        dl = tokens.value_lengths().to_numpy()
        coded = tokens.flatten().dictionary_encode()
        self.terms = coded.dictionary
        cells, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
        term, self.chunk = np.divmod(cells, max(n, 1))
        self.df = np.bincount(term, minlength=len(self.terms))
        self.first = np.cumsum(self.df) - self.df
        df, avgdl = self.df[term], max(dl.mean(), 1.0) if n else 1.0
        self.weight = np.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[self.chunk] / avgdl))

    def best(self, tokens: pa.Array, vectors: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of hits of some cases and their places, some cases at a time."""
        known = pc.index_in(tokens.flatten(), value_set=self.terms)
        case = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())[known.is_valid().to_numpy(zero_copy_only=False)]
        terms = max(len(self.terms), 1)
        cells, qf = np.unique(case * terms + known.drop_null().to_numpy(), return_counts=True)
        case, term = np.divmod(cells, terms)
        cost = np.bincount(case, weights=self.df[term], minlength=len(tokens)) + self.chunks
        cuts = np.flatnonzero(np.diff(np.cumsum(cost) // HELD_CELLS)) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(tokens)]):
            of = slice(*np.searchsorted(case, [a, b]))
            yield self._ranked(self._keyword(case[of] - a, term[of], qf[of], b - a), vectors[a:b] if vectors is not None else None, k)

    def _keyword(self, case: np.ndarray, term: np.ndarray, qf: np.ndarray, cases: int) -> np.ndarray:
        """BM25 of each case and chunk; 0 where they share no token."""
        df = self.df[term]
        at = np.repeat(self.first[term] - np.cumsum(df) + df, df) + np.arange(df.sum())
        cells = np.repeat(case, df) * self.chunks + self.chunk[at]
        return np.bincount(cells, np.repeat(qf, df) * self.weight[at], cases * self.chunks).reshape(cases, self.chunks)

    def _ranked(self, scores: np.ndarray, vectors: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = scores > 0
        if vectors is not None and self.chunks:
            legs, scores, found = (scores, vectors @ self.vectors.T), np.zeros(scores.shape), np.zeros(scores.shape, bool)
            for leg in legs:  # as retrieval.fuse
                top, kept = _first(leg, leg > 0, 4 * k)
                mask = np.zeros(leg.shape, bool)
                np.put_along_axis(mask, top, kept, axis=1)
                scores += np.where(mask, 0.5 * leg / np.maximum(leg.max(axis=1, keepdims=True), 1e-6), 0)
                found |= mask
        places, kept = _first(scores, found, k)
        return kept.sum(axis=1), places[kept]


def _first(scores: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best scores in each row, ties by place, and which of them are hits."""
    places = np.argsort(np.where(found, -np.round(scores, 9), np.inf), axis=1, kind="stable")[:, :k]
    return places, np.take_along_axis(found, places, axis=1)
