import hashlib
import random

from memlayer.llm import substrings

SCHEMA = "doc_id long, text string, start int, doc string"


def brute(rows, length):
    """Every string of every document in order, by a plain set."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40, alphabet="abcdefghij é"):
    r = random.Random(seed)
    word = lambda k: "".join(r.choices(alphabet, k=k))
    passages = [word(k) for k in (99, 100, 101, 150, 400, 60)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            if r.random() < 0.4:  # an edit, or a piece
                k = r.randrange(len(p))
                p = r.choice([p[:k] + "X" + p[k + 1 :], p[k:], p[:k]])
            parts.append(r.choice([p, word(r.randrange(200))]))
        rows.append((i * 3 - 20, "".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "a" * 5000), (1003, "ab" * 2000), (1004, "a" * 99), (1005, "a" * 100), (1006, rows[3][1]), (1007, rows[3][1]), (1008, "\0" * 300 + "x"), (1009, "\0" * 150)]
    return rows


def result(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(x) for x in substrings.digest(substrings.remove_repeats(df, **how)).collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows, 100)


def test_hot_anchors_equal_brute_force(spark):
    rows = corpus(2)
    assert result(spark, rows, hot=1) == brute(rows, 100)


def test_other_lengths_and_tiny_alphabet(spark):
    rows = corpus(3, alphabet="ab")
    assert result(spark, rows, length=30, anchor=10) == brute(rows, 30)


def test_repeated_and_null_ids(spark):
    text = "".join(random.Random(9).choices("abcdefgh", k=150))
    own = "".join(random.Random(10).choices("abcdefgh", k=160))
    got = result(spark, [(5, text), (5, text), (None, text + "z"), (7, "q" + text), (5, "short"), (9, own), (9, own)])
    n = {(x[0], x[1]): x[2] for x in got}
    # null ids come first; rows equal in id and text are one document
    assert n == {(None, 151): 0, (5, 150): 150, (7, 151): 150, (5, 5): 0, (9, 160): 0} and len(got) == 7
    assert result(spark, [])  == []


def test_maximal_repeats_have_all_occurrences():
    data = b"xABCDy-zABCDw-ABC"
    starts = [i for i in range(len(data))]
    got = {(n, tuple(sorted(at))) for n, at in substrings.maximal_repeats(data, starts, [len(data)] * len(starts), 3)}
    assert got == {(4, (1, 8)), (3, (1, 8, 14))}


def test_interval_groups_equal_brute_force():
    """All maximal repeats of random texts by trying every substring; the removed bytes by every pair of places."""
    r = random.Random(4)
    for _ in range(150):
        data = "".join(r.choices("ab", k=r.randrange(4, 22))).encode()
        least, starts = 2, list(range(len(data)))
        want = {}
        for n in range(least, len(data)):
            for a in range(len(data) - n + 1):
                at = tuple(i for i in range(len(data) - n + 1) if data[i : i + n] == data[a : a + n])
                before, after = ({data[i + d] if 0 <= i + d < len(data) else -i - 1 for i in at} for d in (-1, n))
                if len(at) > 1 and len(before) > 1 and len(after) > 1:
                    want[n, at] = True
        got = {(n, tuple(sorted(at))) for n, at in substrings.maximal_repeats(data, starts, [len(data)] * len(data), least)}
        assert got == set(want)
        _, groups = substrings.interval_groups([(data[i:], (i,)) for i in starts], [data[i - 1] if i else -1 for i in starts], least)
        gone = {k for depth, _, _, _, rest in groups for i in rest for k in range(i, i + depth)}
        assert gone == {k for i in starts for k in range(i, i + least) if i + least <= len(data) and data.find(data[i : i + least]) < i}


def test_common_anchors_equal_brute_force(spark):
    """One line in all documents among different neighbours, common in the sample."""
    line = "This very common line stands in every document of the table, with other words before and after it. " * 2
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdef ", k=r.randrange(80, 300)))
    rows = [(i, word() + line + word()) for i in range(150)] + [(500 + i, rows_) for i, rows_ in enumerate([line * 30, word() * 20])]
    assert result(spark, rows, sampled=1) == brute(rows, 100)
    assert result(spark, rows, sampled=1, hot=1) == brute(rows, 100)


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """A rolling hash of a few bits: groups mix different strings, and the bytes decide."""
    real = substrings.Rolling.of
    rows = corpus(5, n=25)
    monkeypatch.setattr(substrings.Rolling, "of", lambda self, *a: real(self, *a) & substrings._U(7))
    rolling = substrings.Rolling()
    contexts = [t.encode()[:300] for _, t in rows if t and len(t.encode()) >= 100]
    place = [(i, 0) for i in range(len(contexts))]
    gone = {}
    for c, a, b in substrings._later(rolling, substrings.np.zeros(len(contexts), substrings._U), contexts, place, 100):
        gone.setdefault(c, set()).update(range(a, b))
    seen = set()
    for c, text in enumerate(contexts):
        want = set()
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                want |= set(range(i, i + 100))
            seen.add(text[i : i + 100])
        assert gone.get(c, set()) == want


def test_groups_of_a_table(spark):
    body = "".join(random.Random(3).choices("abcdefgh", k=130))
    rows = [(1, "x" + body + "1"), (2, "yy" + body + "2"), (3, "z" + body[:110])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.length, tuple(sorted(tuple(o) for o in x.occurrences))) for x in substrings.repeat_groups(df).collect()}
    assert (130, ((1, 1), (2, 2))) in got and (110, ((1, 1), (2, 2), (3, 1))) in got


def test_windows_find_the_anchors_of_the_whole_text(monkeypatch):
    text = substrings.np.frombuffer("".join(random.Random(7).choices("abcd", k=5000)).encode(), substrings.np.uint8)
    whole = substrings.anchors(substrings.Rolling(), text, 100, 40)
    monkeypatch.setattr(substrings, "WINDOW", 97)
    parts = substrings.anchors(substrings.Rolling(), text, 100, 40)
    assert len(whole[0]) > 50 and all((a == b).all() for a, b in zip(whole, parts, strict=True))
