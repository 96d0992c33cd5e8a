"""Conversation structure repair by signature deduplication.

Each turn becomes one letter (its role and its first fault), each conversation a string of them, cut where a block of ``CHUNK``
positions of the sorted table ends. Each distinct string is solved once, by memoised recursion, for every state of the role
grammar in which it can begin and end. The solutions are joined back and chained over a conversation's strings from its
end, and the edits so chosen are replayed on the turns. Only the letters of a conversation ever meet, one byte a turn; its texts
stay spread over the range-sorted table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import materialize

#: log2 of the positions of one block: a string has at most so many turns.
CHUNK_BITS = 8
#: Letters by role (system, user, assistant, other) and fault (none, blank, duplicate, truncated).
LETTERS = "abcdefghijklmnop"
SPACE = r"\x20\x09-\x0D"
#: Role states: start, after a system turn, after a user turn, after an assistant turn. The next turn's role follows from the
#: state, but for a system turn at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: What an end in each state still needs: cost and inserts.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: Bytes of solutions that are broadcast, at most; more are joined.
LISTED_BYTES = 16 << 20


class Repair(NamedTuple):
    """``audits(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``; ``turns(conv, at, pos, role, text)`` in order."""

    audits: DataFrame
    turns: DataFrame


def conversation_key(conv_id: Column | str) -> Column:
    """A conversation's id as text that is never null: null ids are one conversation."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def solve(signature: str) -> list[tuple[int, str, str] | None]:
    """For each state before and after (16 pairs) the cheapest edits: cost, initials, and a script, a word for each turn.

    Of equally cheap edits the ASCII-least initials win. Two that end in one state are never a prefix of each other, so the choice
    holds whatever follows. A word of the script lists the inserted roles (``u``, ``a``), then ``K`` (keep), ``U`` or
    ``A`` (new role) or ``D`` (delete).
    """
    rows = [divmod(LETTERS.index(x), 4) for x in signature]

    @cache
    def best(i: int, state: int) -> tuple:
        if i == len(rows):
            return tuple((0, "", "") if state == end else None for end in range(4))
        role, fault = rows[i]
        options, inserted = [], ""
        for count in range(3):
            after, extra = EXPECTED[state], CUT * (fault == 3)
            options.append((count * INSERT + DELETE, "I" * count + "D", inserted + "D", state))
            if fault not in (1, 2):
                if role + 1 == after or role == 0 and state == START:
                    options.append((count * INSERT + extra, "I" * count + "K", inserted + "K", role + 1))
                options.append((count * INSERT + extra + REROLE, "I" * count + "R", inserted + " UA"[after - 1], after))
            inserted, state = inserted + " ua"[after - 1], after
        out: list = [None] * 4
        for cost, letters, word, after in options:
            for end, rest in enumerate(best(i + 1, after)):
                if rest is not None:
                    found = (cost + rest[0], letters + rest[1], f"{word} {rest[2]}")
                    if out[end] is None or found < out[end]:
                        out[end] = found
        return tuple(out)

    return [x for state in range(4) for x in best(0, state)]


def faults(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbouring roles that may not follow each other."""
    rows = [divmod(LETTERS.index(x), 4) for x in signature]
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum((a[0], b[0]) not in legal for a, b in zip(rows, rows[1:], strict=False))
    return *(sum(f == k for _, f in rows) for k in (1, 2, 3)), illegal


def chain(signatures: list[str], solutions: list[list]) -> tuple[int, str, list[str]]:
    """The cheapest edits of a whole conversation: cost, initials, and the script of each of its strings."""
    after = [(*x, None) for x in CLOSING]
    steps = []
    for solved in reversed(solutions):
        now = []
        for state in range(4):
            options = [(s[0] + after[end][0], s[1] + after[end][1], end) for end in range(4) if (s := solved[4 * state + end]) is not None]
            now.append(min(options))
        steps.append(now)
        after = now
    state, scripts = START, []
    for now, solved in zip(reversed(steps), solutions, strict=True):
        end = now[state][2]
        scripts.append(solved[4 * state + end][2].rstrip())
        state = end
    if signatures:
        scripts[-1] += {SYSTEM: " ua", USER: " a"}.get(state, "")
    return after[START][0], after[START][1], scripts


def letter(role: Column, text: Column, repeated: Column) -> Column:
    """A turn's letter: the class of its role's initial and its first fault."""
    kind = F.instr(F.lit("sua"), F.when(role == "", F.lit("?")).otherwise(F.substring(role, 1, 1)))
    blank = ~text.rlike(rf"[^{SPACE}]")
    cut = ~text.rlike(rf"[.!?][{SPACE}]*+\z")
    fault = F.when(blank, 1).when(repeated, 2).when(cut, 3).otherwise(0)
    return F.substring(F.lit(LETTERS), 4 * F.when(kind == 0, 3).otherwise(kind - 1) + fault + 1, F.lit(1))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        solved = [[None if x is None else {"cost": x[0], "audit": x[1], "script": x[2]} for x in solve(s)] for s in signatures]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(solved, SOLUTIONS), pa.array([list(faults(s)) for s in signatures], pa.list_(pa.int64()))], names=["signature", "solution", "faults"])


SOLUTIONS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("script", pa.string())]))
SOLVED = "signature string, solution array<struct<cost:long,audit:string,script:string>>, faults array<long>"
CHAINED = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, scripts array<struct<chunk:long,first:long,last:long,script:string>>"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            signatures = [p["signature"] for p in parts]
            cost, audit, scripts = chain(signatures, [[None if x is None else (x["cost"], x["audit"], x["script"]) for x in p["solution"]] for p in parts])
            counts = [sum(p["faults"][k] for p in parts) for k in range(4)]
            counts[3] += sum(faults(a[-1] + b[0])[3] for a, b in zip(signatures, signatures[1:], strict=False))
            kept = [{"chunk": p["chunk"], "first": p["first"], "last": p["last"], "script": s} for p, s in zip(parts, scripts, strict=True)]
            out.append(dict(zip(("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "scripts"), (conv, *counts, cost, audit, kept), strict=True)))
        if out:
            scripts = pa.list_(pa.struct([("chunk", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("script", pa.string())]))
            longs = [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), *longs, ("audit", pa.string()), ("scripts", scripts)]))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Find each conversation's faults and its cheapest edits to the roles ``(s?(ua)+)?``, and apply them.

    Turns are taken by number, nulls first, then by role and text; null roles and texts are one space, null ids one
    conversation. Blank and duplicate turns are deleted; Keep costs 0, Rerole 1, Delete 2, Insert 5, a truncated turn
    that stays 5 more. Turns that come twice count twice (the second is a duplicate). An empty table gives empty results; other
    columns are ignored, whatever their names. ``conv`` is :func:`conversation_key` of the id.
    """
    name = lambda c: F.col(f"`{c}`")
    whole = lambda c: F.coalesce(name(c).cast("string"), F.lit(" "))
    rows = turns.select(conversation_key(name(conv)).alias("conv"), name(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text"))
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    # the beginning of a text keeps the sample of the ranges small and orders as the text does
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    rows = materialize(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("digest", F.md5("text")), "turns")
    rows = rows.withColumn("chunk", F.shiftright("at", CHUNK_BITS))
    # who came first among equal turns is found by partial aggregation, as one text may fill a conversation
    same = ["conv", "role", "digest"]
    first = rows.groupBy(*same).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lettered = rows.join(first, same, "left").select("conv", "chunk", "at", letter(F.col("role"), F.col("text"), F.coalesce(F.col("at") > F.col("first"), F.lit(False))).alias("l"))
    strings = lettered.groupBy("conv", "chunk").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", "l"))).alias("ls"))
    strings = materialize(strings.select("conv", "chunk", "first", "last", F.array_join(F.col("ls.l"), "").alias("signature")), "signatures")
    solved = materialize(strings.select("signature").distinct().mapInArrow(_solved, SOLVED), "solutions")
    size = solved.agg(F.sum(F.length("signature") * 40 + 400)).first()[0] or 0
    part = F.struct("first", "chunk", "last", "signature", "solution", "faults")
    chained = strings.join(F.broadcast(solved) if size <= LISTED_BYTES else solved, "signature").groupBy("conv").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    audits = materialize(chained.mapInArrow(_chained, CHAINED), "audits")

    scripts = audits.select("conv", F.explode("scripts").alias("s")).select("conv", "s.chunk", "s.first", "s.last", F.split("s.script", " ").alias("words"))
    scripts = materialize(scripts, "scripts")
    word = F.get("words", (F.col("at") - F.col("first")).cast("int"))
    # one step of a script: what it writes, or nothing for a deleted turn
    step = rows.join(scripts, ["conv", "chunk"]).select("conv", "at", "role", "text", F.posexplode(F.split(word, "")).alias("pos", "step")).where("step in ('u', 'a', 'K', 'U', 'A')")
    own, by = F.col("step").isin("K", "U", "A"), F.upper("step")
    new_role = F.when(by == "U", "user").when(by == "A", "assistant").otherwise(F.col("role"))
    kept = step.select("conv", "at", "pos", new_role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))
    last = F.get("words", (F.col("last") - F.col("first") + 1).cast("int"))
    closing = scripts.select("conv", F.col("last").alias("at"), F.posexplode(F.split(F.coalesce(last, F.lit("")), "")).alias("pos", "step")).where("step <> ''")
    closing = closing.select("conv", "at", F.col("pos") + 3, F.when(F.col("step") == "u", "user").otherwise("assistant"), F.lit(""))
    return Repair(audits.drop("scripts").join(gaps, "conv"), kept.union(closing))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    for batch in batches:
        done = []
        for conv, role, text in zip(*batch.columns[:3], strict=True):
            if (c := conv.as_py()) != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(role.as_py().encode("utf-8", "surrogatepass") + b":")
            state.update(text.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["conv", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of a repair's turns, ``role:text`` joined by newlines.

    A SHA-256 has no parallel form, so the turns of one conversation stream through one task, which holds a batch of them.
    """
    dealt = turns.repartition("conv").sortWithinPartitions("conv", "at", "pos")
    return dealt.select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The turns with the query's stated faults, by the remainder of a CRC of ``conv_id:turn`` over 20; nulls are one space."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn")).cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"), k.alias("k")).where("k <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
