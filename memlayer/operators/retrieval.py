"""Retrieval: a BM25 index kept as tables, cosine search and weighted fusion, for one query or many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlayer.functions.text import Tokenizer, whitespace_tokens
from memlayer.sources.steps import materialize

K1, B = 1.2, 0.75


#: Distinct query terms that are broadcast to filter postings, at most; more are joined.
LISTED_TERMS = 200_000


@dataclass(frozen=True)
class Index:
    """Documents as ``(id, dl, tokens)``, or their saved postings ``(term, id, tf, dl)``, and the corpus row ``(n, avgdl)``.

    Only the postings of asked terms are ever formed from documents: their tokens are filtered before they are counted.
    """

    documents: DataFrame | None
    corpus: DataFrame
    saved: DataFrame | None = None
    tokenizer: Tokenizer = whitespace_tokens

    @property
    def postings(self) -> DataFrame:
        """All postings (AGG1)."""
        if self.saved is not None:
            return self.saved
        return _counted(self.documents.select("id", "dl", F.explode("tokens").alias("term")))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """``terms(term)``, each once -> ``(term, id, tf, dl, df)``."""
        few = terms.limit(LISTED_TERMS + 1).count() <= LISTED_TERMS
        asked = F.broadcast(terms) if few else terms
        if self.saved is not None:
            found = self.saved.join(asked, "term")
        else:
            found = _counted(self.documents.select("id", "dl", F.explode("tokens").alias("term")).join(asked, "term"))
        # document frequencies of asked terms only: one row each
        found = materialize(found, "postings")
        frequencies = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return found.join(F.broadcast(frequencies) if few else frequencies, "term")

    def save(self, path: str) -> None:
        """Write the tables; postings are sorted by term so that scans for a few terms skip row groups."""
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def load(spark: SparkSession, path: str, tokenizer: Tokenizer = whitespace_tokens) -> Index:
        return Index(None, spark.read.parquet(f"{path}/corpus"), spark.read.parquet(f"{path}/postings"), tokenizer)


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def build_index(docs: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer = whitespace_tokens) -> Index:
    """RET1, AGG1-3: each text is tokenised once, into a table of the shared folder; documents without tokens count in the number
    and mean length."""
    tokens = docs.select(F.col(id_col).alias("id"), tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    tokens = materialize(tokens.select("id", F.size("tokens").alias("dl"), "tokens"), "tokens")
    corpus = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return Index(tokens, corpus, None, tokenizer)


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1.0))))


def bm25_scores(index: Index, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """``(query_id, id, score)`` of every document that shares a token (RET2, JN2, FLT4); repeated query tokens count each time."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(index.tokenizer(F.coalesce(F.col(query_text), F.lit("")))).alias("term"))
    terms = materialize(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")), "asked")
    hits = terms.join(index.postings_of(terms.select("term").distinct()), "term").crossJoin(F.broadcast(index.corpus))  # the corpus is one row
    weight = F.col("qf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return hits.groupBy("query_id", "id").agg(F.sum(weight).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The best ``k`` rows for each query with their rank; ties by id (RET3, WIN1)."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_retrieve(index: Index, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    return top_k(bm25_scores(index, queries, query_id, query_text), k)


def bm25_one(index: Index, spark: SparkSession, query: str, k: int) -> DataFrame:
    """One query string: ``(id, score)``, best first.

    Scores are ranked by 9 digits: sums of copies differ by their order, and ties go by id.
    """
    one = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("q"))
    return bm25_scores(index, one, "query_id", "q").orderBy(F.round("score", 9).desc(), F.asc("id")).limit(k).select("id", "score")


def fuse(keyword: DataFrame, vector: DataFrame, k: int, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted sum of two legs, each over its best score and cut to 4k (RET6, JN3, AGG4-5, SET1); ties by id."""
    legs = []
    for leg, weight in zip((keyword, vector), weights, strict=True):
        best = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-6))
        legs.append(top_k(leg, 4 * k).select("query_id", "id", (F.lit(float(weight)) * F.col("score") / best).alias("score")))
    merged = legs[0].unionByName(legs[1]).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    return top_k(merged, k)


def drop_current(hits: DataFrame, current: Column) -> DataFrame:
    """Leave the current item out of hits already cut to k (FLT5): the pool shrinks, it is not refilled."""
    return hits.where(F.col("id") != current)
