"""Text functions: tokenisers, sentence and word splitting, chunking, matching, paths and identifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"
Tokenizer = Callable[[Column], Column]

#: Scripts whose runs are tokens. Fixed values.
HIRAGANA, KATAKANA = r"[\x{3040}-\x{309F}]+", r"[\x{30A0}-\x{30FF}]+"
HAN, LATIN, DIGIT = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]+", "[A-Za-z]+", "[0-9]+"
SENTENCE_ENDS = ".!?。！？"
JUDGE_SEPARATOR = "\n\n---\n\n"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokens(text: Column | str) -> Column:
    """Lower-case tokens between runs of Unicode white space and ASCII punctuation (TOK1)."""
    return F.filter(F.split(F.lower(column(text)), rf"[{SPACE}\p{{Punct}}]+"), lambda t: t != "")


def raw_tokens(text: Column | str) -> Column:
    """As :func:`whitespace_tokens`, case kept."""
    return F.filter(F.split(column(text), rf"[{SPACE}\p{{Punct}}]+"), lambda t: t != "")


def script_tokens(text: Column | str) -> Column:
    """Runs of one script; Han runs of two or more become bigrams, Latin is lower-cased, the rest is dropped (TOK2, TOK3)."""
    runs = F.regexp_extract_all(column(text), F.lit("|".join((HIRAGANA, KATAKANA, HAN, LATIN, DIGIT))), F.lit(0))

    def split(run: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^{HAN}$") & (F.length(run) > 1), grams).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, split))


def sentences(text: Column | str) -> Column:
    """Break after every sentence mark, trim, drop what is empty, keep the rest of the text (TOK5)."""
    parts = F.split(column(text), f"(?<=[{SENTENCE_ENDS}])")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def words(text: Column | str) -> Column:
    """Words between runs of white space (TOK6)."""
    return F.filter(F.split(column(text), rf"{SPACE}+"), lambda w: w != "")


def contains_folded(answer: Column | str, expected: Column | str) -> Column:
    """Case-insensitive substring match (FLT7)."""
    return F.contains(F.lower(column(answer)), F.lower(column(expected)))


def contains_any(answer: Column | str, candidates: Column | str) -> Column:
    """Whether any candidate is contained; none gives false (FLT8)."""
    folded = F.lower(column(answer))
    return F.coalesce(F.exists(column(candidates), lambda c: F.contains(folded, F.lower(c))), F.lit(False))


def fill(template: Column | str, **values: Column) -> Column:
    """Replace ``{name}`` by each value in turn (SF12)."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def similarity_note(name: str, x: Column) -> Column:
    """``name=0.123`` (SF11)."""
    return F.format_string(f"{name}=%.3f", x)


def payload_text(text: Column, payload: Column) -> Column:
    """A text with its JSON payload after it (SF6)."""
    return F.concat_ws(" ", text, payload)


def loose_string(value: Column | str) -> Column:
    """A JSON scalar of any kind as its text (SF8): strings without quotes, other values as written."""
    return column(value).cast("string")


def render_turns(turns: Column) -> Column:
    """``role: content`` lines of an array of (order, role, content) in order (SF19)."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Compressed over original size; 1 for an empty original (SF13)."""
    return F.when(original == 0, F.lit(1.0)).otherwise(compressed.cast("double") / original)


def path_parts(path: Column | str) -> Column:
    return F.split(column(path), "/")


def path_depth(path: Column | str) -> Column:
    """Number of non-empty components (SF15)."""
    return F.size(F.filter(path_parts(path), lambda p: p != ""))


def is_uuid(value: Column | str) -> Column:
    """8-4-4-4-12 hexadecimal digits (SF16, SRC7)."""
    return column(value).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def label_class(label: Column | str, default: str = "Unknown") -> Column:
    """A label's query class; unknown labels give the default (SF17)."""
    known = F.lower(F.trim(column(label)))
    out = F.lit(default)
    for name in ("Literal", "Narrative", "Analytical", "Unknown"):
        out = F.when(known == name.lower(), F.lit(name)).otherwise(out)
    return out


def parse_names(text: str) -> list[str]:
    """Comma-separated names, trimmed, blanks skipped (SF21)."""
    return [p.strip() for p in text.split(",") if p.strip()]


def byte_tail(text: Column | str, n: int) -> Column:
    """The longest end of a text that has at most ``n`` bytes, in whole characters (TOK8)."""
    text = column(text)
    sizes = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda k: F.octet_length(F.right(text, k)) <= n)
    return F.right(text, F.array_max(sizes))


#: Marks that no chunk ends right after. Fixed values.
NO_CUT_AFTER = ".!?\n"


def cut_chunks(text: str, target: int) -> list[str]:
    """Chunks of at least ``target`` bytes, none ending right after a sentence mark or line end (TOK7).

    Each cut is the first allowed place from the target on, found among the places after any other character by their byte
    offsets; the chunks concatenate to the text.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return []
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    allowed = np.flatnonzero(~np.isin(points, [ord(c) for c in NO_CUT_AFTER]))
    # a cut behind the last character would leave an empty chunk; no chunk is empty even for a target of 0
    allowed = allowed[allowed < len(points) - 1]
    places, cuts, at = ends[allowed], [0], 0
    while (k := int(np.searchsorted(places, at + max(target, 1)))) < len(places):
        cuts.append(int(allowed[k]) + 1)
        at = int(places[k])
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


#: Characters of the chunks that are held at once, roughly.
HELD_CHARS = 1 << 20


def chunk_batches(batches: Iterator[pa.RecordBatch], target: int, held_chars: int = HELD_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches ``(id, text)`` -> batches ``(id, position, text)`` of bounded size, one text at a time."""
    for batch in batches:
        rows, places, chunks, size = [], [], [], 0
        for n in range(len(batch)):
            for k, chunk in enumerate(cut_chunks(batch.column(1)[n].as_py() or "", target)):
                rows.append(n)
                places.append(k)
                chunks.append(chunk)
                size += len(chunk)
                if size >= held_chars:
                    yield _chunk_batch(batch, rows, places, chunks)
                    rows, places, chunks, size = [], [], [], 0
        if rows:
            yield _chunk_batch(batch, rows, places, chunks)


def _chunk_batch(batch: pa.RecordBatch, rows: list[int], places: list[int], chunks: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], names=["id", "position", "text"])


def chunk_documents(df: DataFrame, target: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, position, text)``, one row per chunk; each cut depends on the one before, so it runs in Python."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(lambda batches: chunk_batches(batches, target), f"id {kind}, position int, text string")
