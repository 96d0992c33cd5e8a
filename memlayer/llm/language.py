"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (0 to ``order``) with symbol counts. The
probability of a byte after a context is n(byte) / (total + kinds); the escape to the next shorter
context has probability kinds / (total + kinds); a context never seen is skipped; below order 0 all
256 bytes are equally likely. Counts are frozen after training, so the code length of a text is a sum
over its bytes and the language with the shortest code wins.

Training counts the (order + 1)-grams of every learnable text where Spark holds them: each task sums up its own, Spark adds
them by language and gram, and the driver gets one row for each gram of a language, whatever the number of documents. The
counts of shorter contexts are sums of these. Scoring covers every whole text. A worker remembers the cost of each
(order + 1)-gram it has met, so one byte costs a table look-up a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlayer.llm.common import training_row

ORDER = 3
#: Documents of each language that :func:`sample` takes, at most.
SAMPLE = 300
#: Bytes of the longest text that :func:`sample` takes; with SAMPLE it bounds what passes the driver.
LONGEST = 1 << 20
#: Bytes that a task counts at once, and grams whose counts it holds before it hands them on.
PIECE, HELD = 1 << 22, 1_000_000
#: Cells of a bit in which code lengths a byte are counted for the limits.
CELLS = 1024
#: Grams that a worker remembers, at most; beyond it starts anew.
MEMO = 4_000_000
UNDETERMINED = "und"
#: A text is foreign to a language if its code is longer than MARGIN times the rate that 99 of 100 held-out texts reach,
#: and by more than SLACK bits (a token of some 16 unseen bytes).
MARGIN = 1.5
SLACK = 128.0
_LETTER = r"\p{L}"


def grams_of(texts: list[bytes], order: int) -> np.ndarray:
    """The (order + 1)-gram that ends in each byte, but for the first ``order`` bytes of each text, which are context only."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) <= order:
        return np.zeros(0, np.uint64)
    gram = data[order:].astype(np.uint32 if order <= 3 else np.uint64)
    for j in range(1, order + 1):
        gram |= data[order - j : len(data) - j].astype(gram.dtype) << gram.dtype.type(8 * j)
    # drop the grams that end in another text's context
    starts = np.cumsum([len(t) for t in texts])[:-1] - order
    keep = np.ones(len(gram), bool)
    for j in range(order):
        keep[starts + j] = False
    return gram[keep]


def added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, with the sums of their counts."""
    if not len(grams):
        return grams, counts
    order = np.argsort(grams, kind="stable")
    kinds, first = np.unique(grams[order], return_index=True)
    return kinds, np.add.reduceat(counts[order], first)


class ContextTree:
    """Frozen counts of one language: per order, sorted grams with counts and contexts with totals."""

    def __init__(self, texts: list[bytes], order: int = ORDER) -> None:
        # a document starts after `order` zero bytes, as it does when scored
        self._count(*np.unique(grams_of([b"\0" * order + t for t in texts], order), return_counts=True), order)

    @classmethod
    def of_counts(cls, grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> ContextTree:
        """The tree of texts whose distinct (order + 1)-grams are known with their counts."""
        tree = cls.__new__(cls)
        tree._count(grams, counts, order)
        return tree

    def _count(self, top: np.ndarray, times: np.ndarray, order: int) -> None:
        self.order, self.levels = order, []
        for k in range(order + 1):
            grams, counts = added(top.astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1), times.astype(np.int64))
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts
            kinds = np.diff(np.r_[first, len(grams)])
            self.levels.append((grams, counts, contexts, totals, kinds.astype(np.int64)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each (order + 1)-gram after the bytes before it."""
        cost = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        for k in range(self.order, -1, -1):
            known, counts, contexts, totals, kinds = self.levels[k]
            if not len(known):
                continue
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            gram = grams & mask
            at = np.minimum(np.searchsorted(contexts, gram >> np.uint64(8)), len(contexts) - 1)
            seen = open_ & (contexts[at] == gram >> np.uint64(8))
            place = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            hit = seen & (known[place] == gram)
            whole = np.log2(totals[at] + kinds[at])
            cost[hit] += whole[hit] - np.log2(counts[place[hit]])
            escape = seen & ~hit
            cost[escape] += whole[escape] - np.log2(kinds[at[escape]])
            open_ &= ~hit
        cost[open_] += 8.0
        return cost


class Scorer:
    """Code lengths of whole texts under every language."""

    def __init__(self, model: dict[str, ContextTree], memo: int = MEMO) -> None:
        self.names = sorted(model)
        self.trees = [model[n] for n in self.names]
        self.order = self.trees[0].order if self.trees else ORDER
        self.memo = memo
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.costs = np.zeros((0, len(self.trees)), np.float64)

    def _look_up(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, grams)
        if len(self.known):
            missing = self.known[np.minimum(at, len(self.known) - 1)] != grams
        else:
            missing = np.ones(len(grams), bool)
        if missing.any():
            if len(self.known) > self.memo:
                self._forget()
                return self._look_up(grams)
            new = grams[missing]
            costs = np.stack([t.bits(new) for t in self.trees], axis=1)
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.known, self.costs = known[order], np.concatenate([self.costs, costs])[order]
            at = np.searchsorted(self.known, grams)
        return self.costs[at]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Bits, one row per text and one column per language."""
        size = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.trees)))
        if not size.sum() or not self.trees:
            return out
        data = np.frombuffer(b"".join(b"\0" * self.order + t for t in texts), np.uint8)
        gram = data[self.order :].astype(np.uint32 if self.order == 3 else np.uint64)
        for j in range(1, self.order + 1):
            gram |= data[self.order - j : len(data) - j].astype(gram.dtype) << gram.dtype.type(8 * j)
        # drop the grams that end in another text's padding
        ends = np.cumsum(size + self.order) - self.order
        keep = np.ones(len(gram), bool)
        for j in range(self.order):
            pads = ends[:-1] + j
            keep[pads] = False
        gram = gram[keep]
        kinds, which = np.unique(gram, return_inverse=True)
        costs = self._look_up(kinds.astype(np.uint64))
        first = np.cumsum(size) - size
        some = size > 0
        for k in range(len(self.trees)):
            out[some, k] = np.add.reduceat(costs[which, k], first[some])
        return out


def sample(docs: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: bool = False) -> DataFrame:
    """``(lang, text)``: at most ``per_language`` labelled documents of each language, by a hash of the id; ``held_out``: of those never learned from.

    Rows that repeat id, text and language count once; texts of over ``LONGEST`` bytes are not taken.
    """
    of = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    learnable = training_row(of[0])
    rows = docs.where((~learnable if held_out else learnable) & of[1].isNotNull() & (F.octet_length(of[2]) <= LONGEST))
    rows = rows.select(of[0].alias("id"), of[1].alias("lang"), of[2].alias("text"), F.xxhash64(of[2]).alias("h"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(5)), "id", "h")
    # keys and languages only are ranked; the texts of the chosen follow
    chosen = rows.select("id", "lang", "h").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    again = (F.lag("id").over(order) == F.col("id")) & (F.lag("h").over(order) == F.col("h"))
    chosen = chosen.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").select("id", "lang", "h")
    return rows.join(F.broadcast(chosen), ["id", "lang", "h"]).dropDuplicates(["id", "lang", "h"]).select("lang", "text")


def _labelled(docs: DataFrame, held_out: bool, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, text)``, the text as bytes, of all labelled rows that are learned from, or of those held out."""
    learnable, lang, text = training_row(F.col(f"`{id_col}`")), F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    return docs.where((~learnable if held_out else learnable) & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.cast("binary").alias("text"))


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``rows(lang, text)`` -> ``(lang, gram, n)``: how often each (order + 1)-gram of a language ends in a byte of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def count() -> None:
            nonlocal size
            for lang, texts in waiting.items():
                kinds, n = np.unique(grams_of(texts, order), return_counts=True)
                known = held.get(lang)
                held[lang] = (kinds, n) if known is None else added(np.concatenate([known[0], kinds]), np.concatenate([known[1], n]))
            waiting.clear()
            size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (kinds, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.astype(np.uint64).view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = b"\0" * order + text.as_py()
                for at in range(0, max(1, len(text) - order), PIECE):  # a long text goes on after its last bytes
                    waiting.setdefault(lang, []).append(text[at : at + PIECE + order])
                    size += len(waiting[lang][-1])
                    if size >= PIECE:
                        count()
                if sum(len(k) for k, _ in held.values()) > HELD:
                    yield from flush()
        count()
        yield from flush()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int | None = None, order: int = ORDER, **columns: str) -> dict[str, ContextTree]:
    """Fit the trees to all learnable labelled texts, or to :func:`sample`'s ``per_language``; empty where no row is labelled."""
    if per_language is None:
        rows = _labelled(docs, False, **columns)
    else:
        rows = sample(docs, per_language, **columns).select("lang", F.col("text").cast("binary").alias("text"))
    found = gram_counts(rows, order).toArrow()
    names = np.array(found.column("lang").to_pylist(), object)
    grams, counts = (found.column(c).to_numpy() for c in ("gram", "n"))
    return {lang: ContextTree.of_counts(grams[names == lang].view(np.uint64), counts[names == lang], order) for lang in sorted(set(names))}


def limits(docs: DataFrame, model: dict[str, ContextTree], **columns: str) -> dict[str, float]:
    """The most bits a byte of each language: MARGIN times the 0.99 quantile over all its held-out labelled texts.

    Rates are counted in cells of 1 / ``CELLS`` bit, each at its upper end, so the driver gets their counts whatever the number of
    texts. A language without such texts takes the largest limit of the others; without any there is no limit.
    """
    if not model:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            low = coded(scorer, batch.column(1)).min(axis=1)
            cell = np.ceil(low / pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) * CELLS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int64))], names=["lang", "cell"])

    rows = _labelled(docs, True, **columns).where(F.col("lang").isin(sorted(model)) & (F.octet_length("text") > 0))
    cells: dict[str, list[tuple[int, int]]] = {}
    for row in rows.mapInArrow(run, "lang string, cell long").groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        cells.setdefault(row.lang, []).append((row.cell, row.n))
    known = {lang: MARGIN * quantile(sorted(found), 0.99) / CELLS for lang, found in cells.items()}
    return {lang: known.get(lang, max(known.values(), default=float("inf"))) for lang in model}


def quantile(counted: list[tuple[int, int]], q: float) -> float:
    """The quantile of sorted values with their counts, interpolated as numpy does."""
    values, ends = np.array([v for v, _ in counted], float), np.cumsum([n for _, n in counted])
    place = q * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, at, side="right")] for at in (int(np.floor(place)), int(np.ceil(place))))
    return float(low + (high - low) * (place - np.floor(place)))


def coded(scorer: Scorer, texts: pa.Array, chunk: int = 1 << 21) -> np.ndarray:
    """Bits of each text of a column under each language, about ``chunk`` bytes at a time; one text is never cut."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    ends, bits, at = np.cumsum(sizes), [np.zeros((0, len(scorer.names)))], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + chunk, side="right")))
        bits.append(scorer([t or b"" for t in texts.slice(at, to - at).to_pylist()]))
        at = to
    return np.concatenate(bits)


def fits(limit: dict[str, float], text_col: str = "text") -> Column:
    """Whether the predicted language's model explains the text: ``_bits`` within its limit, or over it by SLACK bits at most.

    ``_score`` compares languages only and nears 1 on any longer text, gibberish included, so it does not decide.
    """
    of = F.lit(None).cast("double")
    for lang, most in sorted(limit.items()):
        of = F.when(F.col("_lang_pred") == lang, F.lit(most)).otherwise(of)
    return F.coalesce((F.col("_bits") - of) * F.octet_length(F.col(f"`{text_col}`")) <= SLACK, F.lit(False))


def identify(docs: DataFrame, model: dict[str, ContextTree], id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 21) -> DataFrame:
    """Predict every whole text: all columns of ``docs`` with ``_held_out``, ``_lang_pred``, ``_score``, ``_bits``.

    ``_score`` is the posterior of the predicted language for equal priors, ``_bits`` its code length per
    byte. A null text, one without a letter, and every text under an empty model is ``und`` with
    score 0 and null bits. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [0, place]).cast(pa.binary())
            bits = coded(scorer, texts, chunk)
            names, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if scorer.names:
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(bits)), best]
                score = 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                names = [scorer.names[b] for b in best]
                rate = low / np.maximum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)), 1)
            extra = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["l", "s", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), extra], names=["row", "p"])

    # the columns ride along as one struct, whatever their names; the text is read there
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    letter = F.coalesce(F.col(f"`{text_col}`").rlike(_LETTER), F.lit(False))
    held = ~training_row(F.col(f"`{id_col}`"))
    rows = docs.select(F.struct(row.alias("d"), letter.alias("letter"), held.alias("held")).alias("row"))
    from pyspark.sql.types import StructField, StructType

    schema = StructType([rows.schema["row"], StructField("p", StructType.fromDDL("l string, s double, b double"))])
    out = rows.mapInArrow(run, schema)
    known = F.col("row.letter") & (F.col("p.l") != UNDETERMINED)
    return out.select(
        *[F.col(f"row.d.c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.coalesce("row.held", F.lit(False)).alias("_held_out"),
        F.when(known, F.col("p.l")).otherwise(UNDETERMINED).alias("_lang_pred"),
        F.when(known, F.col("p.s")).otherwise(0.0).alias("_score"),
        F.when(known, F.col("p.b")).alias("_bits"),
    )
