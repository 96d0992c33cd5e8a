import hashlib
import itertools
import random
import re
import zlib

import pytest

from memlayer.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_edits(rows):
    """All edit sequences tried one after the other: rows of (role, text, fault) -> (cost, initials, repaired).

    Deleting all rows costs 2 each, so more inserts than that pays for need no try.
    """
    best, slots = None, [(at, x) for at in range(len(rows) + 1) for x in "ua"]
    inserts = [i for n in range(2 * len(rows) // 5 + 1) for i in itertools.combinations_with_replacement(slots, n)]
    inserts += [tuple(reversed(i)) for i in inserts if len(i) == 2 and i[0][0] == i[1][0] and i[0] != i[1]]
    for edits in itertools.product("KUAD", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, _, f) in zip(edits, rows, strict=True)):
            continue
        for chosen in inserts:
            out, cost, letters = [], 0, ""
            for k in range(len(rows) + 1):
                for _, x in (i for i in chosen if i[0] == k):
                    out.append(("user" if x == "u" else "assistant", ""))
                    cost, letters = cost + 5, letters + "I"
                if k == len(rows):
                    break
                role, text, fault = rows[k]
                if edits[k] == "D":
                    cost, letters = cost + 2, letters + "D"
                    continue
                cost += 5 * (fault == "truncated") + (edits[k] != "K")
                letters += "K" if edits[k] == "K" else "R"
                out.append((role if edits[k] == "K" else {"U": "user", "A": "assistant"}[edits[k]], text))
            if (best is None or (cost, letters) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                best = (cost, letters, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    """(turn, role, text) rows of one conversation -> what a repair says of it."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    faulty = plain_faults([x[1:] for x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")]
    initials = [r[:1] for r, _, _ in faulty]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *count, illegal, *plain_edits(faulty)


def repaired(spark, rows):
    done = dialogue.repair(spark.createDataFrame(rows, SCHEMA))
    texts = {}
    for x in done.turns.orderBy("conv", "at", "pos").collect():
        texts.setdefault(x.conv, []).append(f"{x.role}:{x.text}")
    return {x.conv: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, "\n".join(texts.get(x.conv, []))) for x in done.audits.collect()}, done


def test_repair_equals_trying_all_edits(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        for k in range(rng.randint(1, 4)):
            rows.append((conv, rng.choice([None, k, k, k + rng.randint(0, 3)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No", " \t", "", "Why?", "Yes.", None, "x! "])))
    rows.append((7, *rows[0][1:]))
    got, done = repaired(spark, rows)
    for conv in {r[0] for r in rows}:
        assert got[f"={conv}"] == expected([r[1:] for r in rows if r[0] == conv]), conv
    shas = {x.conv: x.repaired_sha256 for x in dialogue.digests(done.turns).collect()}
    assert shas == {c: hashlib.sha256(x[-1].encode()).hexdigest() for c, x in got.items() if x[-1]}


@pytest.mark.parametrize("bits", [1, 2])
def test_long_conversations_are_chained_over_their_strings(spark, bits, monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = [(c, k, rng.choice(["system", "user", "assistant"]), rng.choice(["Yes.", "No", "", f"{k}."])) for c in (1, 2, 3, None) for k in range(5)]
    got, _ = repaired(spark, rows)
    for conv in (1, 2, 3, None):
        assert got["" if conv is None else f"={conv}"] == expected([r[1:] for r in rows if r[0] == conv])


def test_one_solution_for_strings_cut_anywhere():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice(dialogue.LETTERS) for _ in range(rng.randint(1, 12)))
        whole = dialogue.chain([s], [dialogue.solve(s)])
        cut = sorted(rng.randrange(len(s) + 1) for _ in range(2))
        parts = [p for p in (s[: cut[0]], s[cut[0] : cut[1]], s[cut[1] :]) if p]
        split = dialogue.chain(parts, [dialogue.solve(p) for p in parts])
        assert split[:2] == whole[:2]
        assert " ".join(split[2]) == whole[2][0]


def test_empty_tables_and_clashing_columns(spark):
    done = dialogue.repair(spark.createDataFrame([], SCHEMA))
    assert done.audits.count() == 0 and done.turns.count() == 0 and dialogue.digests(done.turns).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 3, 4), (1, 1, "assistant", "x" * 100_000 + ".", 3, 4)], SCHEMA + ", at long, conv long")
    (audit,) = dialogue.repair(rows).audits.collect()
    assert (audit.cost, audit.audit) == (0, "KK")


def test_the_damage_of_the_query(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(3)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [tuple(x) for x in dialogue.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
