import random

from memlayer.llm import decontaminate as d


def best_match(item, data):
    """Semi-global edit distance by the plain table."""
    row = [0] * (len(data) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(data, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def edited(r, s, k):
    s = list(s)
    for _ in range(k):
        p = r.randrange(len(s))
        r.choice([lambda p=p: s.__setitem__(p, "q"), lambda p=p: s.insert(p, "z"), lambda p=p: s.pop(p)])()
    return "".join(s)


def words(r, n):
    return " ".join("".join(r.choices("abcdefé", k=r.randrange(2, 8))) for _ in range(n))


def test_equals_brute_force(spark):
    r = random.Random(3)
    items = [(i, words(r, r.randrange(8, 30)) + "?") for i in range(12)] + [(50, "tiny"), (51, None), (52, ""), (None, "null id of an item here")]
    docs = []
    for i in range(60):
        item = r.choice(items[:12])[1]
        k = r.choice([0, 1, len(item) // 12, len(item) // 9, len(item) // 7])
        docs.append((i, r.choice([words(r, 40), ""]) + " " + r.choice([edited(r, item, k), item.upper().replace(" ", "  --  "), words(r, 20), item[: len(item) // 2]]) + ". " + words(r, r.randrange(30)), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (7, items[0][1], "x"), (None, items[1][1] * 3, "x"), (102, "ab " * 60000 + items[2][1], "x")]
    got = {}
    for x in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault((x.doc_id, x.item_id), []).append(x.edits)
    index = d.Items([(i, d.fold(t)) for i, t in items if i is not None and len(d.fold(t)) >= d.Q])
    want = {}
    for doc_id, text, _ in docs:
        data = d.fold(text)
        for item, t, budget in zip(index.ids, index.text, index.budget.tolist(), strict=True):
            e = (0 if t in data else best_match(t, data)) if len(data) < 5000 else (0 if t in data else 99)
            if e <= budget:
                want[doc_id, item] = min(e, want.get((doc_id, item), e))
    assert {k: min(v) for k, v in got.items()} == want
    assert len(got[None, 1]) == 3 and (7, 0) in got and (102, 2) in got


def test_blocks_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one passage of some length here"), (2, "another passage of such length too")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "passage of some length"), (6, "passage of such length")], "item_id long, text string")
    monkeypatch.setattr(d, "BLOCK_BYTES", 10)
    assert sorted((x.doc_id, x.item_id, x.edits) for x in d.find_leaks(docs, items).collect() if x.edits == 0) == [(1, 5, 0), (2, 6, 0)]
    assert d.find_leaks(docs, items.limit(0)).count() == 0 and d.find_leaks(docs.limit(0), items).count() == 0


def ends(item, data, budget):
    """Every (edits, end) within the budget by the plain table."""
    row = [0] * (len(data) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(data, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return [(e, j) for j, e in enumerate(row) if e <= budget]


def test_regions_do_not_depend_on_other_items(spark):
    r = random.Random(5)
    item, long_item = words(r, 16), words(r, 1000)
    places = [edited(r, item, k) for k in (0, 1, 3, 5, 0, 2, 4, 0)]
    docs = spark.createDataFrame([(1, " ".join(places)), (2, (item + " ") * 8), (3, " zz ".join(places[1:4]))], "doc_id long, text string")
    alone = spark.createDataFrame([(1, item)], "item_id long, text string")
    both = spark.createDataFrame([(1, item), (2, long_item)], "item_id long, text string")
    one, two = (sorted(map(tuple, d.find_leaks(docs, x).collect())) for x in (alone, both))
    assert one == two
    text, budget = d.fold(item), int(d.Items([(1, d.fold(item))]).budget[0])
    for x in docs.collect():
        mine = [g for g in one if g[0] == x.doc_id]
        found = ends(text, d.fold(x.text), budget)
        # each place within the budget is one region, with the fewest edits among the ends near it
        groups, last = [], -(10**9)
        for e, j in found:
            if j - last > len(text) // 2:
                groups.append([])
                last = j
            groups[-1].append(e)
        assert [g[2] for g in sorted(mine, key=lambda g: g[4])] == [min(g) for g in groups]
        assert len(mine) == {1: 8, 2: 8, 3: 3}[x.doc_id]
