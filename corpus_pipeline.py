"""The training-corpus pipeline: documents in, packed sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame. All but the last return the columns of ``documents``, whatever they are. Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlayer.llm import language, near_copies, privacy
from memlayer.llm.common import materialize, table, training_row
from memlayer.llm.decontaminate import find_leaks
from memlayer.llm.packing import pack_sequences


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in no known language: without a letter, or with a code longer than their language's texts have.

    Models and limits come from the labelled rows of the whole table ``documents``, not from what is left of it.
    """
    whole = table(spark, sf_dir, "documents")
    model = language.train(whole)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    return language.identify(rows, model).where(language.fits(language.limits(whole, model))).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, exact Jaccard similarity of 0.8 at least.

    Pairs are proposed by SimHash under covering masks and, as those cannot reach 0.8, by MinHash. The row with the smallest id
    stays, then the one with the smallest text hash; rows without an id cannot be named and stay as they are.
    """
    return near_copies.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a benchmark item within the edit budget, with all rows of its id.

    Rows without an id are judged each by its text, under the text's hash as their key.
    """
    key = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"], F.lit("no id")))
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaked = materialize(leaks.select("doc_id").distinct(), "leaked")
    return docs.join(leaked, key == leaked.doc_id, "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows the new text. No document is dropped."""
    learnable = table(spark, sf_dir, "documents").where(training_row("doc_id"))
    found = privacy.find_personal_data(docs, privacy.fit(spark, learnable))
    found = found.select("row", privacy.redacted(F.col("row.text")).alias("new"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens; a row per piece."""
    import public_tokenizers

    return pack_sequences(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_redaction", redact_personal_data),
    ("best_fit_packing", pack),
]

#: Language models, fingerprints, alignments and tokenisers have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
