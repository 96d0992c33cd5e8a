import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlayer.operators import nearest, postings
from memlayer.sources import commits


def clouds(n, centres, dim=16, seed=1, spread=0.1):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dim)) * 3
    return c[r.integers(0, centres, n)] + spread * r.standard_normal((n, dim))


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]


def cosines(x, q):
    return (x @ q.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1000])
def test_nearest_equals_all_pairs(spark, block_bytes):
    x, q = clouds(600, 12), clouds(70, 12, seed=2)
    x[100:130] = x[100]  # ties
    more = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 15), (9005, [None] + [1.0] * 15)]
    v = spark.createDataFrame(rows_of(x) + more, "id long, v array<double>").repartition(5)
    asked = spark.createDataFrame(rows_of(q) + [(800, None), (801, [0.0] * 16), (802, [1.0] * 15)], "q long, w array<double>")
    got = nearest.nearest(v, "id", "v", asked, "q", "w", 7, digits=6, block_bytes=block_bytes).collect()
    want = []
    s = np.round(cosines(x, q), 6)
    for j in range(len(q)):
        best = sorted((-s[i, j], i) for i in range(len(x)) if s[i, j] > 0)[:7]
        want += [(j, i, -c, n + 1) for n, (c, i) in enumerate(best)]
    other = [g for g in got if g.query_id >= 800]
    got = {(g.query_id, g.rank): (g.id, g.score) for g in got if g.query_id < 800}
    assert {k: v[0] for k, v in got.items()} == {(j, n): i for j, i, _, n in want}
    assert all(abs(got[j, n][1] - c) < 2e-6 for j, _, c, n in want)
    assert [(g.id, g.rank) for g in other] == [(9004, 1)]


def test_threshold_join_is_exact_and_compares_few_pairs(spark):
    x, q = clouds(4000, 40, seed=3), clouds(400, 40, seed=3)
    v, refs = spark.createDataFrame(rows_of(x), "id long, v array<double>"), spark.createDataFrame([(f"r{i}", w) for i, w in rows_of(q)], "label string, w array<double>")
    compared = spark.sparkContext.accumulator(0)
    got = {(g.id, g.label) for g in nearest.within(nearest.clustered(v, "id", "v"), "id", "v", refs, "label", "w", 0.9, compared).collect()}
    s = cosines(x, q)
    sure = {(int(i), f"r{j}") for i, j in zip(*np.nonzero(s >= 0.9 + 1e-12), strict=True)}
    assert sure <= got <= {(int(i), f"r{j}") for i, j in zip(*np.nonzero(s >= 0.9 - 1e-12), strict=True)} and len(got) > 4000
    assert compared.value < x.shape[0] * len(q) / 5
    assert nearest.within(v, "id", "v", refs.limit(0), "label", "w", 0.9).count() == 0
    with pytest.raises(ValueError):
        nearest.within(v, "id", "v", refs, "label", "w", 0.0)


WORDS = [f"w{i}" for i in range(300)]


def texts(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=r.randrange(0, 60)))) for i in range(n)]


def plain_bm25(docs, query, k):
    tokens = {i: t.split() for i, t in docs}
    n, avg = len(docs), max(sum(map(len, tokens.values())) / max(len(docs), 1), 1)
    df = Counter(w for t in tokens.values() for w in set(t))
    scores = []
    for i, t in tokens.items():
        tf = Counter(t)
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * 2.2 * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if tf[w])
        if s > 0:
            scores.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(scores)[:k]]


def searched(index, spark, asked, k=5, counts=None):
    q = spark.createDataFrame(asked, "q long, text string")
    out = {}
    for x in index.search(q, "q", "text", k, counts=counts).orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.id, x.score))
    return out


def same(index, spark, docs, asked, k=5):
    got = searched(index, spark, asked, k)
    for q, text in asked:
        want = plain_bm25(docs, text, k)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want], q
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-9)


def test_index_through_adds_updates_deletes_and_merges(spark, tmp_path):
    docs = dict(texts(900))
    asked = [(i, " ".join(random.Random(i).choices(WORDS, k=8))) for i in range(12)] + [(50, ""), (51, "zebra"), (52, "w0 w0 w1"), (53, "unknown w250")]
    index = postings.PostingIndex.build(spark.createDataFrame(texts(900), "id long, text string").repartition(3), "id", "text", str(tmp_path / "i"), size=64)
    same(index, spark, list(docs.items()), asked)
    r = random.Random(9)
    for step in range(3):
        new = {r.randrange(1000): f"zebra w{step} " + " ".join(r.choices(WORDS, k=20)) for _ in range(60)} | {r.randrange(1000): None for _ in range(40)}
        rows = [(i, "stale", 0) for i in new] + [(i, t, 1) for i, t in new.items()]
        changes = spark.createDataFrame(rows, "id long, text string, n int")
        for _ in range(2):  # a repeated batch changes nothing
            index.apply(changes, "id", "text", "n", ("s", step))
        docs = {i: t for i, t in (docs | new).items() if t is not None}
        if step == 1:
            index.merge()
            assert len(index.commits.latest()[1]["generations"]) == 1
        assert index.corpus() == (len(docs), sum(len(t.split()) for t in docs.values()))
    again = postings.PostingIndex(spark, str(tmp_path / "i"), size=64)
    same(again, spark, list(docs.items()), asked)
    df = Counter(w for t in docs.values() for w in set(t.split()))
    assert {x.term: x.df for x in again.frequencies().collect()} == dict(df)
    assert sorted(x.id for x in again.documents().collect()) == sorted(docs)


def test_search_reads_few_postings_where_bounds_tell(spark, tmp_path):
    """Two rare words and four common ones: the common ones are looked up in few blocks."""
    r = random.Random(4)
    docs = [(i, " ".join(r.choices([f"c{k}" for k in range(40)], k=60)) + (f" rare{i % 1000} odd{i % 1000}" * 8)) for i in range(4000)]
    index = postings.PostingIndex.build(spark.createDataFrame(docs, "id long, text string").coalesce(1), "id", "text", str(tmp_path / "i"))
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    asked = [(k, f"rare{k} odd{k} c1 c2 c3 c4") for k in range(20)]
    got = searched(index, spark, asked, 3, counts)
    assert all(len(x) == 3 and all(i % 1000 == k for i, _ in x) for k, x in got.items())
    assert counts[0].value < counts[1].value / 10
    same(index, spark, docs, asked[:4], 3)


def test_empty_index_and_null_texts(spark, tmp_path):
    none = postings.PostingIndex(spark, str(tmp_path / "none"))
    assert searched(none, spark, [(1, "a")]) == {}
    index = postings.PostingIndex.build(spark.createDataFrame([("a", None), ("b", "x")], "id string, text string"), "id", "text", str(tmp_path / "i"))
    assert index.corpus() == (2, 1) and [x[0] for x in searched(index, spark, [(1, "x")])[1]] == ["b"]
    index.apply(spark.createDataFrame([("b", None)], "id string, text string"), "id", "text")
    assert searched(index, spark, [(1, "x")]) == {} and index.corpus() == (1, 0)


def test_of_two_writers_one_begins_again(spark, tmp_path):
    log = commits.Commits(spark, str(tmp_path / "c"))
    assert log.latest() == (0, {})
    log.commit(0, {"n": 1})
    with pytest.raises(commits.Conflict):
        log.commit(0, {"n": 2})
    seen = []

    def change(state):
        seen.append(state["n"])
        if len(seen) == 1:
            log.commit(1, {"n": 5})  # another writer in between
        return {"n": state["n"] + 1}

    assert log.update(change) == 3 and seen == [1, 5] and log.latest() == (3, {"n": 6})
    assert log.update(lambda state: None) == 3
