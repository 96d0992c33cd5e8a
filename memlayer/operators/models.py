"""Model-backed operators. Each takes a factory that a Python worker calls once; files are opened by onnxruntime.

Weights are not part of this repository: with a factory of one's own every operator runs on any function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.functions.text import fill, words

MAX_TOKENS = 512


def onnx_session(model_path: str, tokenizer_path: str) -> Callable[[], tuple]:
    """A factory for (tokenizer, forward) of a model file; ``forward`` takes named arrays and gives the first output."""

    def make() -> tuple:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        names = [i.name for i in session.get_inputs()]

        def forward(arrays: dict[str, np.ndarray]) -> np.ndarray:
            fed = {"token_type_ids": np.zeros_like(arrays["input_ids"]), **arrays}
            return session.run(None, {n: fed[n] for n in names})[0]

        return Tokenizer.from_file(tokenizer_path), forward

    return make


#: Texts of one forward pass.
BATCH = 32


def _mapped(df: DataFrame, id_col: str, columns: list[str], make: Callable, many: Callable, schema: str) -> DataFrame:
    """``many(model, rows)`` gives an output for each row of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = list(zip(*(batch[c] for c in batch.columns[1:]), strict=True))
            yield pd.DataFrame({"id": batch["id"], "out": pd.Series(many(model, rows), dtype=object, index=batch.index)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), *columns).mapInPandas(run, f"id {kind}, out {schema}")


def _each(one: Callable) -> Callable:
    return lambda model, rows: [one(model, *row) for row in rows]


def forwarded(forward: Callable, encodings: list, names: tuple[str, ...] = ("input_ids", "attention_mask")) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, output, mask) of each encoding: those of like length go through the model together, padded with zeros."""
    get = {"input_ids": "ids", "attention_mask": "attention_mask", "token_type_ids": "type_ids"}
    order = sorted(range(len(encodings)), key=lambda k: len(encodings[k].ids))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        width = min(max(len(encodings[k].ids) for k in some), MAX_TOKENS)
        arrays = {n: np.zeros((len(some), width), np.int64) for n in names}
        for row, k in enumerate(some):
            for n in names:
                values = getattr(encodings[k], get[n])[:width]
                arrays[n][row, : len(values)] = values
        out = forward(arrays)
        for row, k in enumerate(some):
            yield k, out[row], arrays["attention_mask"][row]


def pooled(states: np.ndarray, mask: np.ndarray, dim: int) -> list[float]:
    """Mean over unmasked tokens, norm 1."""
    mean = (states * mask[:, None]).sum(axis=0) / max(mask.sum(), 1e-9)
    if len(mean) != dim:
        raise ValueError(f"the model gives {len(mean)} dimensions, not {dim}")
    n = np.linalg.norm(mean)
    return (mean / n if n > 0 else mean).astype(float).tolist()


def encode(df: DataFrame, id_col: str, text_col: str, make: Callable, dim: int, prefix: str = "") -> DataFrame:
    """``(id, embedding)`` by an encoder (EMB3, EMB4): prefix, truncate, forward in batches, pool, normalise."""

    def many(model: tuple, rows: list) -> list:
        tokenizer, forward = model
        out: list = [None] * len(rows)
        for k, states, mask in forwarded(forward, [tokenizer.encode(prefix + (text or "")) for (text,) in rows]):
            out[k] = pooled(states, mask, dim)
        return out

    return _mapped(df, id_col, [text_col], make, many, "array<double>").withColumnRenamed("out", "embedding")


def embeddings(df: DataFrame, id_col: str, text_col: str, provider: str | None = None, dim: int = 64, make: Callable | None = None) -> DataFrame:
    """``(id, embedding)`` by the provider that is named, or that the session's key ``memlayer.embedding.provider`` names (EMB6):
    ``hash`` (the default), or ``onnx`` with a factory."""
    provider = provider or df.sparkSession.conf.get("memlayer.embedding.provider", "hash")
    if provider == "onnx" and make is not None:
        return encode(df, id_col, text_col, make, dim)
    if provider != "hash":
        raise ValueError(f"no embedding provider {provider}")
    from memlayer.functions.vectors import hash_embedding

    return hash_embedding(df, id_col, text_col, dim)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def entailments(df: DataFrame, id_col: str, text_col: str, labels: list[str], template: str, make: Callable, entail: int, least: float = 0.5, premise: str = "{text}", turn_col: str | None = None) -> DataFrame:
    """``(id, label, score, matched)`` of labels whose hypothesis the text entails (DET3); no labels load no model.

    ``premise`` and ``template`` may name ``{text}``, ``{new_turn}`` (the turn's payload) and ``{label}``. Premises are cut from
    the end, so a long one may lose its hypothesis.
    """
    if not labels:
        return df.sparkSession.createDataFrame([], f"id {df.schema[id_col].dataType.simpleString()}, label string, score double, matched string")
    values = {"text": F.coalesce(F.col(text_col), F.lit("")), "new_turn": F.coalesce(F.col(turn_col), F.lit("")) if turn_col else F.lit("")}
    pairs = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), *[v.alias(n) for n, v in values.items()])
    named = {n: F.col(n) for n in (*values, "label")}
    pairs = pairs.select(F.struct("id", "label").alias("key"), fill(premise, **named).alias("premise"), fill(template, **named).alias("hypothesis"))

    def many(model: tuple, rows: list) -> list:
        tokenizer, forward = model
        out: list = [None] * len(rows)
        for k, logits, _ in forwarded(forward, [tokenizer.encode(a, b) for a, b in rows], ("input_ids", "attention_mask", "token_type_ids")):
            out[k] = float(softmax(logits)[entail])
        return out

    scored = _mapped(pairs, "key", ["premise", "hypothesis"], make, many, "double")
    found = scored.select("id.id", "id.label", F.col("out").alias("score")).where(F.col("score") >= least)
    return found.withColumn("matched", F.format_string("entailment=%.3f", "score"))


def keep_probabilities(ids: list[int], special: list[bool], forward: Callable, keep: int, window: int = MAX_TOKENS, first: int = 101, last: int = 102) -> np.ndarray:
    """Keep probability of each token, by windows of content tokens between the model's end marks; 0 for special ones (CMP3)."""
    out = np.zeros(len(ids))
    content = [i for i, s in enumerate(special) if not s]
    for at in range(0, len(content), window - 2):
        part = content[at : at + window - 2]
        array = np.array([[first, *(ids[i] for i in part), last]], np.int64)
        out[part] = softmax(forward({"input_ids": array, "attention_mask": np.ones_like(array)})[0])[1:-1, keep]
    return out


def token_probabilities(df: DataFrame, id_col: str, text_col: str, make: Callable, keep: int = 1) -> DataFrame:
    """``(id, pos, piece, prob)`` for :func:`memlayer.operators.condense.keep_pieces`."""

    def one(model: tuple, text: str | None) -> list[tuple]:
        tokenizer, forward = model
        e = tokenizer.encode(text or "")
        special = [bool(m) for m in e.special_tokens_mask]
        p = keep_probabilities(e.ids, special, forward, keep)
        return [(i, e.tokens[i], float(p[i])) for i in range(len(e.ids)) if not special[i]]

    rows = _mapped(df, id_col, [text_col], make, _each(one), "array<struct<pos:int,piece:string,prob:double>>")
    return rows.select("id", F.explode("out").alias("x")).select("id", "x.*")


def pruned(df: DataFrame, id_col: str, text_col: str, make: Callable, budget: int, tail: int, keep: int = 1, min_keep: float = 0.05) -> DataFrame:
    """``(id, compressed)``: texts of over ``budget`` words keep the tokens most worth it (CMP3).

    Texts within the budget stay; the others' tokens are scored, selected by :func:`memlayer.operators.condense.keep_pieces` and
    joined again, pieces that continue a word without a space. Where nothing is kept the text stays.
    """
    from memlayer.operators.condense import keep_pieces

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.size(words(text_col)), F.lit(0)).alias("words"))
    over = rows.where(F.col("words") > budget)
    kept = keep_pieces(token_probabilities(over, "id", "text", make, keep), over.select("id", F.lit(budget).alias("target_words"), "words"), tail, min_keep)
    joined = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    joined = joined.select("id", F.replace(F.array_join(F.transform("p", lambda x: x["piece"]), " "), F.lit(" ##"), F.lit("")).alias("out"))
    return rows.join(joined, "id", "left").select("id", F.coalesce(F.when(F.col("out") != "", F.col("out")), "text").alias("compressed"))


def greedy_decode(step: Callable[[list[int]], np.ndarray], start: int, end: int, longest: int = 142, shortest: int = 56) -> list[int]:
    """Greedy tokens from a step function giving the next logits (SUM4).

    The end token is barred until ``shortest`` tokens exist; of equal logits the last one wins.
    """
    out = [start]
    while len(out) - 1 < longest:
        z = np.asarray(step(out), float).copy()
        if len(out) - 1 < shortest:
            z[end] = -np.inf
        token = len(z) - 1 - int(np.argmax(z[::-1]))
        if token == end:
            break
        out.append(token)
    return out[1:]


def abstractive(df: DataFrame, id_col: str, text_col: str, make: Callable, start: int = 2, end: int = 2, longest: int = 142, shortest: int = 56, longest_input: int = 1024) -> DataFrame:
    """``(id, summary)``; the factory gives (tokenizer, begin) where ``begin(ids)`` encodes once and returns a step function."""

    def one(model: tuple, text: str | None) -> str:
        tokenizer, begin = model
        if not (text or "").strip():
            return ""
        ids = tokenizer.encode(text).ids[:longest_input]
        return tokenizer.decode(greedy_decode(begin(ids), start, end, longest, shortest)).strip()

    return _mapped(df, id_col, [text_col], make, _each(one), "string").withColumnRenamed("out", "summary")
