import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from memlayer.llm import near_copies


def test_stage_equals_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for base in range(12):
        text = r.choices(words, k=150)
        rows.append((base * 10, " ".join(text)))
        for k in range(1, 6):  # from 0.97 down to below 0.8
            near = list(text)
            for at in r.sample(range(150), k):
                near[at] = "new"
            rows.append((base * 10 + k, " ".join(near)))
    rows += [(0, "another text under an id that is taken " * 4), (500, rows[7][1]), (None, rows[0][1]), (501, "one"), (502, "ONE"), (503, None)]
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked += i < 72
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert linked > 50
    want = []
    for g in set(group):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == g]
        want.append(min(ids, key=lambda x: -1 if x is None else x))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(map(str, [x.doc_id for x in out])) == sorted(map(str, want))
    assert len([x for x in out if x.doc_id == 0]) == 2  # two texts under one id


def test_blocks_find_what_stars_find(spark):
    r = random.Random(4)
    texts = []
    for _ in range(3):
        t = r.choices([f"w{i}" for i in range(500)], k=200)
        texts += [" ".join([*t[:k], "x", *t[k + 1 :]]) for k in range(5)]
    s = [near_copies.sketch(t) for t in texts]
    nodes = spark.createDataFrame([(int(x[0]), [int(k) for k in x[2:]]) for x in s], "node long, keys array<long>")
    named = spark.createDataFrame([(int(x[0]), t) for x, t in zip(s, texts)], "node long, text string")
    for rounds in (1, 2, 4):
        groups = near_copies.components(near_copies.links(near_copies.buckets(nodes), named, rounds=rounds).distinct())
        assert groups.select("component").distinct().count() == 3 and groups.count() == 15


def hubs(copies, groups=3):
    """Each group: a text and copies that each differ from it elsewhere (similarity 0.81), and from each other too much."""
    rows = []
    for g in range(groups):
        r = random.Random(g)
        hub = [f"w{r.randrange(10**6)}" for _ in range(300)]
        texts = [hub]
        for k in range(copies):
            near = list(hub)
            at = k % 50 * 5
            near[at : at + 28] = [f"x{g}.{k}.{j}" for j in range(28)]
            texts.append(near)
        # the hub is in the middle, so it is not the first of its buckets by id
        order = list(range(1, copies // 2)) + [0] + list(range(copies // 2, copies + 1))
        rows += [(g * 10_000 + n, " ".join(texts[k])) for n, k in enumerate(order)]
    return rows


def test_copies_of_a_hub_stay_one_group(spark):
    for copies in (200,):
        rows = hubs(copies)
        a, b, c = (near_copies.shingles(rows[copies // 2 - 1 + k][1]) for k in (0, 1, 2))
        assert near_copies.similarity(a, b) >= 0.8 > near_copies.similarity(b, c)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 10_000, 20_000]


def test_rows_that_come_twice_and_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "g h i j k l m", 3), (None, None, 4), (None, "a b c d e f", 5)]
    out = near_copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, node int").withColumnRenamed("node", "t")).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in out) == [("1", "a b c d e f"), ("2", "g h i j k l m"), ("None", "None"), ("None", "a b c d e f")]
    assert near_copies.drop_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_of_few_and_many_stragglers(spark, monkeypatch):
    """Small limits, so that stars, stragglers and blocks all have work; every bucket holds every node."""
    monkeypatch.setattr(near_copies, "BLOCK", 6)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(40):
        t = list(base)
        for at in r.sample(range(0, 120, 6), 1 + k % 4):
            t[at] = f"x{k}"
        texts.append(" ".join(t))
    texts += [" ".join(r.choices(base, k=120)) for _ in range(10)]
    sets = [near_copies.shingles(t) for t in texts]
    group = list(range(50))
    for i in range(50):
        for j in range(i):
            if near_copies.similarity(sets[i], sets[j]) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    met = spark.createDataFrame([(i, key) for i in range(50) for key in (1, 2)], "node long, key long")
    named = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for rounds, few in ((1, 64), (2, 0)):
        monkeypatch.setattr(near_copies, "FEW", few)
        got = {x.id: x.component for x in near_copies.components(near_copies.links(met, named, rounds=rounds).distinct()).collect()}
        assert [got.get(i, i) for i in range(50)] == group


def test_stars_need_no_step_and_a_step_leaves_no_shuffle_files(spark, monkeypatch):
    """Links that are stars already are recognised, and a written step's shuffle files do not wait for the driver's garbage."""
    from memlayer.llm import components
    from memlayer.sources import steps

    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or steps.materialize(df, name))
    star = spark.createDataFrame([(n, n % 3) for n in range(3, 60)], "a long, b long")
    assert {x.id: x.component for x in components.components(star).collect()} == {n: n % 3 for n in range(60)}
    assert written == ["edges"]
    r = random.Random(6)
    edges = [(n, n + 1) for n in range(100, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    group = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges:
        group = {n: min(group[a], group[b]) if g in (group[a], group[b]) else g for n, g in group.items()} if a != b else group
    assert {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == group

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    out = steps.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # they are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7


def test_many_stragglers_and_later_small_buckets_join_one_group(spark, monkeypatch):
    """Large buckets of both kinds beside small ones: the links of each step count in the next."""
    monkeypatch.setattr(near_copies, "BLOCK", 6)
    monkeypatch.setattr(near_copies, "FEW", 8)
    texts, met, group = [], [], []
    for key, size, families in ((1, 30, 1), (2, 30, 2), (3, 30, 15), (4, 4, 2)):
        for k in range(size):
            base = [f"k{key}f{k % families}w{i}" for i in range(120)]
            base[k // families % 16 * 5] = f"x{k}"
            met.append((len(texts), key))
            group.append(len(texts) - k + k % families)
            texts.append(" ".join(base))
    met += [(0, 5), (len(texts), 5), (len(texts) - 1, 6), (len(texts) + 1, 6)]
    group += [0, group[-1]]
    texts += [texts[0] + " more", texts[-1] + " more"]
    named = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sets = [near_copies.shingles(t) for t in texts]
    assert all((near_copies.similarity(sets[a], sets[b]) >= 0.8) == (group[a] == group[b]) for a in range(len(texts)) for b in range(a))
    for rounds in (1, 3):
        found = near_copies.links(spark.createDataFrame(met, "node long, key long"), named, rounds=rounds)
        got = {x.id: x.component for x in near_copies.components(found).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == group
