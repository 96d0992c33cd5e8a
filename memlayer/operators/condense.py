"""Compressors and summarisers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlayer.functions.text import column, sentences, whitespace_tokens, words
from memlayer.operators.retrieval import K1, B

#: Summary methods. Fixed values.
METHODS = ("None", "ExtractiveBM25", "DistilBart", "LlmFull", "LlmLazy", "UserManual")


def truncate(text: Column | str, budget: int, tail: int) -> Column:
    """Keep the first and last words with a mark between them, if the text is over budget (CMP1)."""
    text = column(text)
    w = words(text)
    tail = min(tail, budget)
    head = budget - tail
    first = F.array_join(F.slice(w, 1, head), " ") if head else F.lit("")
    last = F.array_join(F.slice(w, -tail, tail), " ") if tail else F.lit("")
    cut = F.concat(F.lit("… "), last) if head == 0 else F.concat(first, F.lit(" …")) if tail == 0 else F.concat(first, F.lit(" … "), last)
    return F.when(F.size(w) <= budget, text).otherwise(cut)


def sentence_scores(tokens: list) -> np.ndarray:
    """BM25 self-information of each sentence (its tokens) among the sentences of one text (AGG7)."""
    sizes = np.array([len(t) for t in tokens], float)
    df = Counter(term for t in tokens for term in set(t))
    n, mean = len(tokens), max(sizes.mean(), 1.0) if len(tokens) else 1.0
    out = np.zeros(n)
    for k, t in enumerate(tokens):
        room = K1 * (1 - B + B * sizes[k] / mean)
        out[k] = sum(math.log((n - df[term] + 0.5) / (df[term] + 0.5) + 1) * tf * (K1 + 1) / (tf + room) for term, tf in Counter(t).items())
    return out


def best_sentences(tokens: list, most: int) -> list[int]:
    """Places of the best sentences in order (WIN3); scores are compared to nine decimals, ties by place."""
    scores = sentence_scores(tokens).round(9)
    return sorted(sorted(range(len(tokens)), key=lambda k: (-scores[k], k))[:most])


def selected_sentences(tokens: list, budget: int, tail: int) -> list[int]:
    """Places kept of a text over budget: the tail from the end (WIN6), then of the rest the best that fit (WIN7), in order (SET3)."""
    costs, kept, used, back = [len(t) for t in tokens], [], 0, 0
    for k in range(len(costs) - 1, -1, -1):
        back += costs[k]
        if back > tail:
            break
        if costs[k]:
            kept.append(k)
            used += costs[k]
    forced, taken, room = set(kept), 0, max(budget - used, 0)
    scores = sentence_scores(tokens).round(9)
    for k in sorted((k for k in range(len(costs)) if k not in forced), key=lambda k: (-scores[k], k)):
        if taken + costs[k] <= room:
            kept.append(k)
            taken += costs[k]
            if taken >= room:
                break
    return sorted(kept)


def _by_text(df: DataFrame, id_col: str, text_col: str, name: str, kind: str, one) -> DataFrame:
    """``(id, s, t, <name>)``: each text's sentences, their tokens and ``one(tokens)``; a row stays a row, nothing is shuffled."""

    @F.pandas_udf(kind)
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one([list(x) for x in t]) for t in tokens])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), sentences(text_col).alias("s"))
    rows = rows.withColumn("t", F.transform("s", whitespace_tokens))
    return rows.withColumn(name, run("t"))


def scored_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, sentence, cost, score)``: BM25 self-information of each sentence in its text (AGG7).

    ``cost`` is the number of tokens; frequencies and the mean length are of the text's own sentences.
    """
    rows = _by_text(df, id_col, text_col, "z", "array<double>", lambda t: sentence_scores(t).tolist())
    zipped = F.arrays_zip(F.col("s").alias("sentence"), F.transform("t", lambda t: F.size(t)).alias("cost"), F.col("z").alias("score"))
    return rows.select("id", F.posexplode(zipped).alias("pos", "x")).select("id", "pos", "x.sentence", "x.cost", "x.score")


def _chosen() -> Column:
    return F.array_join(F.transform("kept", lambda k: F.get(F.col("s"), k)), " ")


def extractive_summary(df: DataFrame, id_col: str, text_col: str, max_sentences: int = 3) -> DataFrame:
    """``(id, summary)``: the best sentences in their order (SUM1); at most the limit: all of them. A null text has an empty summary."""
    rows = _by_text(df, id_col, text_col, "kept", "array<int>", lambda t: best_sentences(t, max(max_sentences, 1)))
    return rows.select("id", F.coalesce(_chosen(), F.lit("")).alias("summary"))


def selective_context(df: DataFrame, id_col: str, text_col: str, budget: int, tail: int) -> DataFrame:
    """``(id, compressed)``: keep the last sentences within ``tail`` tokens and the most informative of the rest (CMP2).

    No sentence gives an empty text, a total within the budget the text as it is, and none kept a mark.
    """
    rows = _by_text(df, id_col, text_col, "kept", "array<int>", lambda t: selected_sentences(t, budget, tail))
    total = F.aggregate("t", F.lit(0), lambda n, t: n + F.size(t))
    out = F.when(F.size("kept") == 0, F.lit("…")).otherwise(_chosen())
    return rows.select("id", F.when(F.coalesce(F.size("s"), F.lit(0)) <= 0, F.lit("")).when(total <= budget, F.col("text")).otherwise(out).alias("compressed"))


def keep_pieces(pieces: DataFrame, budgets: DataFrame, tail_words: int, min_keep: float = 0.05) -> DataFrame:
    """``pieces(id, pos, piece, prob)`` and ``budgets(id, target_words, words)`` -> the kept ``(id, pos, piece)`` (CMP3, WIN8, SET5).

    The last ``tail_words`` words stay (pieces starting with ``##`` continue a word); of the others as many of the
    highest probability as bring the total to the target.
    """
    back = Window.partitionBy("id").orderBy(F.desc("pos"))
    begins = (~F.startswith("piece", F.lit("##"))).cast("int")
    done = F.coalesce(F.sum(begins).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("forced", done < tail_words)
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("forced").cast("int")).alias("f")).join(budgets, "id")
    ratio = F.least(F.greatest(F.col("target_words") / F.greatest(F.col("words"), F.lit(1)), F.lit(min_keep)), F.lit(1.0))
    target = F.greatest(F.round(F.col("n") * ratio), F.ceil(F.col("n") * F.lit(min_keep)))
    sizes = sizes.select("id", F.greatest(target - F.col("f"), F.lit(0)).alias("extra"))
    best = Window.partitionBy("id", "forced").orderBy(F.desc("prob"), "pos")
    return rows.withColumn("r", F.row_number().over(best)).join(sizes, "id").where("forced or r <= extra").select("id", "pos", "piece")


def dispatch(level: Column | str, methods: dict[int, str], default: str | None = None) -> Column:
    """The method registered for the greatest level at most the requested one, levels under 1 counting as 1 (SUM2, WIN9)."""
    level = F.greatest(column(level), F.lit(1))
    out = F.lit(default)
    for at in sorted(methods):
        out = F.when(level >= at, F.lit(methods[at])).otherwise(out)
    return F.coalesce(out, F.raise_error(F.lit("no summarizer for this level"))) if default is None else out


def method_for(level: int, methods: dict[int, str], default: str | None = None) -> str | None:
    """The method registered for exactly this level, else the default's (SUM2)."""
    return methods.get(level, default)


def summarize(df: DataFrame, id_col: str, text_col: str, level_col: str, summarizers: dict[int, tuple[str, Callable]], default: tuple[str, Callable] | None = None) -> DataFrame:
    """``(id, method, summary)``: each text by the summariser of its level (SUM2).

    ``summarizers`` maps a level to a method's name and ``(df, id, text) -> (id, summary)``; a row goes to the greatest level at
    most its own, levels under 1 counting as 1, else to the default; without one that is an error. Each summariser sees its own
    rows only.
    """
    chosen = dispatch(level_col, {at: str(at) for at in summarizers}, "default" if default else None)
    rows = df.withColumn("_which", chosen)
    out = None
    for which, (method, run) in {**{str(at): s for at, s in summarizers.items()}, **({"default": default} if default else {})}.items():
        part = run(rows.where(F.col("_which") == which), id_col, text_col).select("id", F.lit(method).alias("method"), "summary")
        out = part if out is None else out.union(part)
    return out


def protection(locked: Column | str, edited: Column | str, force: Column | bool) -> Column:
    """Whether a new summary applies (SUM3): a lock beats force, an edit yields to it."""
    forced = F.lit(force) if isinstance(force, bool) else force
    return F.when(column(locked), F.lit("SkippedLocked")).when(column(edited) & ~forced, F.lit("SkippedUserEdited")).otherwise(F.lit("Applied"))


def apply_summaries(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``updates(id, new_summary, new_method, force)``; adds ``outcome`` (null where no update came)."""
    both = chunks.join(updates, "id", "left")
    outcome = F.when(F.col("new_method").isNotNull(), protection("auto_update_locked", "edited_by_user", F.coalesce("force", F.lit(False))))
    applied = F.coalesce(outcome == "Applied", F.lit(False))
    changed = {
        "summary": F.when(applied, F.col("new_summary")).otherwise(F.col("summary")),
        "summary_method": F.when(applied, F.col("new_method")).otherwise(F.col("summary_method")),
        "edited_by_user": F.when(applied & F.coalesce("force", F.lit(False)), F.lit(False)).otherwise(F.col("edited_by_user")),
    }
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in chunks.columns], outcome.alias("outcome"))
