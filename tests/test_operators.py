import math
import random

import pytest
from pyspark.sql import functions as F

from memlayer.operators import checks, condense, detect, evaluate, graph, models, nearest, retrieval
from memlayer.plans import context, harness
from memlayer.sources import datasets, store


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("a", "the quick brown fox"), ("b", "lazy dogs sleep"), ("c", "quick quick fox jumps"), ("d", "")], "id string, text string")
    index = retrieval.build_index(docs, "id", "text")
    hits = retrieval.bm25_one(index, spark, "quick fox", 5).collect()
    assert [h.id for h in hits] == ["c", "a"] and retrieval.bm25_one(index, spark, "zebra", 5).count() == 0 and retrieval.bm25_one(index, spark, "", 5).count() == 0
    idf = math.log((4 - 2 + 0.5) / 2.5 + 1)
    want = 2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / (11 / 4)))
    assert abs(hits[1].score - want) < 1e-9
    twice = retrieval.bm25_one(index, spark, "quick quick", 5).collect()
    once = retrieval.bm25_one(index, spark, "quick", 5).collect()
    assert abs(twice[0].score - 2 * once[0].score) < 1e-9
    vecs = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "id string, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0], "quick fox")], "query_id int, q array<double>, text string")
    cos = nearest.nearest(vecs, "id", "v", q, "query_id", "q", 8)
    fused = retrieval.fuse(retrieval.bm25_scores(index, q, "query_id", "text"), cos, 2).collect()
    assert [f.id for f in sorted(fused, key=lambda f: f.rank)] == ["a", "c"]


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    index = retrieval.build_index(docs, "id", "text")
    index.save(str(tmp_path))
    again = retrieval.Index.load(spark, str(tmp_path))
    assert retrieval.bm25_one(again, spark, "a b", 2).collect() == retrieval.bm25_one(index, spark, "a b", 2).collect()


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "s long, d long")
    pairs = {(x.id, x.ancestor) for x in graph.closure(edges, "s", "d").collect()}
    assert pairs == {(a, b) for a in (1, 2, 3, 9) for b in (1, 2, 3)}
    assert {x.id for x in checks.cycles(edges, "s", "d").collect()} == {1, 2, 3}
    n = 150
    line = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end parent")
    assert graph.closure(line.where("parent is not null"), "id", "parent").count() == n * (n - 1) // 2
    up = graph.chain(line, "id", "parent", spark.range(4, 5)).orderBy("depth").collect()
    assert [x.id for x in up] == [4, 3, 2, 1, 0]
    ring = spark.createDataFrame([(1, 2), (2, 1), (5, 77)], "id long, parent long")
    assert [x.id for x in graph.chain(ring, "id", "parent", spark.range(1, 2)).orderBy("depth").collect()] == [1, 2]
    assert graph.chain(ring, "id", "parent", spark.range(5, 6)).count() == 1


def tokens(s):
    import re
    import string

    return [t for t in re.split(rf"[\s{re.escape(string.punctuation)}]+", s.lower()) if t]


def plain_selective(text, budget, tail):
    import re

    sents = [s.strip() for s in re.findall(r"[^.!?]*[.!?]|[^.!?]+$", text)]
    sents = [s for s in sents if s]
    if not sents:
        return ""
    sets = [tokens(s) for s in sents]
    if sum(map(len, sets)) <= budget:
        return text
    kept, left = [], tail
    for i in range(len(sents) - 1, -1, -1):
        if left == 0 or len(sets[i]) > left:
            break
        if sets[i]:
            left -= len(sets[i])
            kept.append(i)
    avg = sum(map(len, sets)) / len(sets)

    def score(t):
        out = 0
        for w in set(t):
            n = sum(w in s for s in sets)
            tf = t.count(w)
            out += math.log((len(sets) - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / max(avg, 1)))
        return round(out, 9)

    room = max(budget - sum(len(sets[i]) for i in kept), 0)
    head, used = [], 0
    for i in sorted((i for i in range(len(sents)) if i not in kept), key=lambda i: (-score(sets[i]), i)):
        if used + len(sets[i]) > room:
            continue
        head.append(i)
        used += len(sets[i])
        if used >= room:
            break
    keep = sorted(set(head + kept))
    return " ".join(sents[i] for i in keep) if keep else "…"


def test_condense(spark):
    t = lambda s, b, k: spark.range(1).select(condense.truncate(F.lit(s), b, k).alias("v")).first().v
    nums = " ".join(map(str, range(1, 21)))
    assert t(nums, 6, 2) == "1 2 3 4 … 19 20" and t("a  b", 5, 1) == "a  b" and t(nums, 2, 2) == "… 19 20" and t(nums, 2, 0) == "1 2 …" and t(nums, 0, 0) == "… "
    r = random.Random(2)
    rows = [(i, " ".join(" ".join(r.choices("alpha beta gamma delta pi rho".split(), k=r.randrange(0, 7))) + r.choice(".!?") for _ in range(r.randrange(0, 9)))) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "")], "doc_id long, text string")
    for budget, tail in ((8, 3), (0, 0), (12, 20)):
        out = {x.id: x.compressed for x in condense.selective_context(df, "doc_id", "text", budget, tail).collect()}
        assert out == {i: plain_selective(s, budget, tail) for i, s in [*rows, (100, "")]}
    s = {x.id: x.summary for x in condense.extractive_summary(spark.createDataFrame([(1, "One a. Two b! Three c? four"), (2, "x. y."), (3, "")], "id long, text string"), "id", "text", 3).collect()}
    assert s[2] == "x. y." and s[3] == "" and s[1].count(" ") >= 3


def test_pieces(spark):
    rows = [(1, i, p, pr) for i, (p, pr) in enumerate([("play", 0.1), ("##ing", 0.9), ("the", 0.2), ("game", 0.8), ("to", 0.05), ("##day", 0.01)])]
    kept = condense.keep_pieces(spark.createDataFrame(rows, "id long, pos int, piece string, prob double"), spark.createDataFrame([(1, 2, 4)], "id long, target_words int, words int"), 1)
    assert sorted(x.piece for x in kept.collect()) == ["##day", "##ing", "to"]


def test_summaries_apply(spark):
    s = "id long, summary string, summary_method string, edited_by_user boolean, auto_update_locked boolean"
    df = spark.createDataFrame([(1, "", "None", False, False), (2, "", "None", True, False), (3, "", "None", True, False), (4, "", "None", True, True), (5, "old", "None", False, False)], s)
    up = spark.createDataFrame([(i, "new", "LlmFull", i >= 3) for i in (1, 2, 3, 4)], "id long, new_summary string, new_method string, force boolean")
    out = {x.id: (x.outcome, x.summary, x.edited_by_user) for x in condense.apply_summaries(df, up).collect()}
    assert out == {1: ("Applied", "new", False), 2: ("SkippedUserEdited", "", True), 3: ("Applied", "new", False), 4: ("SkippedLocked", "", True), 5: (None, "old", False)}


def test_detection(spark):
    df = spark.createDataFrame([(1, "He drew a sword", '{"a":1}'), (2, "calm", '{"tag":"sword"}'), (3, "Sword", "{}")], "id long, t string, p string")
    out = detect.detect_keywords(df, "id", F.col("t"), F.col("p"), [("fight", ["sword", "axe"]), ("calm", ["calm"])]).collect()
    assert sorted((x.id, x.label, x.matched) for x in out) == [(1, "fight", "sword"), (2, "calm", "calm"), (2, "fight", "sword")]
    lazy = detect.cascade_lazily(df, "id", [lambda d: d.where("id = 1").selectExpr("id", "'x' label", "'m' matched"), lambda d: d.selectExpr("id", "'y' label", "'m' matched")]).collect()
    assert sorted((x.id, x.label, x.stage) for x in lazy) == [(1, "x", 0), (2, "y", 1), (3, "y", 1)]
    rules = [("^who", "Literal"), ("why", "Analytical")]
    c = df.select("id", detect.classify_regex(F.lit("tell me why"), rules).alias("c")).first().c
    assert c == "Analytical"
    for bad in ('{"labels":[],"embedding_dim":1,"weights":[],"bias":[]}', '{"labels":["a"],"embedding_dim":2,"weights":[[1]],"bias":[0]}', '{"labels":["a"],"embedding_dim":1,"weights":[[1]],"bias":[]}'):
        with pytest.raises(ValueError):
            detect.read_head(bad)
    train = spark.createDataFrame([([1.0, 0.0], "Literal"), ([0.0, 1.0], "Narrative")] * 10, "v array<double>, y string")
    head = detect.train_head(train, "v", "y", ["Literal", "Narrative"])
    scored = train.withColumn("p", detect.classify_linear("v", head))
    assert detect.holdout_accuracy(scored, "p", "y").first() == (1.0, True)


def test_evaluation(spark, tmp_path):
    cases = spark.createDataFrame([("b", "tier-0", "1", True, 100), ("b", "tier-0", "2", True, 200), ("b", "tier-0", "3", False, 300)], "bench string, ablation string, case_id string, correct boolean, latency_ms long")
    m = evaluate.metrics(cases).first()
    assert (m.total, m.correct, m.mean_latency_ms) == (3, 2, 200.0) and abs(m.accuracy - 2 / 3) < 1e-9
    assert evaluate.metrics(cases.limit(0)).first() == (0, 0, 0.0, 0.0)
    assert [x.case_id for x in evaluate.regressions(cases, cases.where("case_id <> '2'")).collect()] == ["2"]
    datasets.write_cases(cases, str(tmp_path / "c"))
    writer = datasets.CaseWriter.create(spark, str(tmp_path / "w"), "b", "t")
    for part in (cases.limit(1), cases.limit(2)):
        writer.write(part.drop("bench", "ablation"))
    assert writer.finish().first().total == 3 and datasets.CaseWriter.create(spark, str(tmp_path / "w"), "b", "t").finish().first().total == 0
    assert spark.read.json(str(tmp_path / "c")).count() == 3
    assert '"suite":"smoke"' in datasets.summary(cases, "smoke").first().value
    q = spark.createDataFrame([(["q1", "q2", "q3"], [["a"], [], ["c"]])], "questions array<string>, answers array<array<string>>")
    assert [(x.pos, x.question) for x in evaluate.first_questions(q, 3).collect()] == [(0, "q1"), (2, "q3")]


def test_haystacks_are_found_by_their_key(spark):
    case = datasets.haystack(0, 2048)
    assert case[0] == "niah-2k" and f"The magic key {case[3]} has the special value {case[4]}." in case[2] and case == datasets.haystack(0, 2048)
    out = harness.run_haystacks(datasets.haystacks(spark, (512, 1024)), ("tier-0", "tier-0-1-2"))
    assert all(x.correct for x in out.where("ablation = 'tier-0'").collect())


def test_question_runs(spark, tmp_path):
    rows = [(f"noise words here. The capital of land{i} is ANSWER-row{i}. more noise follows in this text", [f"capital of land{i}", "x"], [[f"answer-row{i}"], []], None) for i in range(4)]
    df = spark.createDataFrame(rows, "context string, questions array<string>, answers array<array<string>>, metadata string")
    assert all(x.correct for x in harness.run_questions(df, 2, ("tier-0",)).collect())
    df.write.json(str(tmp_path / "q"))
    assert datasets.read_questions(spark, str(tmp_path / "q")).count() == 4
    (tmp_path / "s.json").write_text('[{"question_id":"a","question_type":"multi-session","question":"what colour","answer":7,"haystack_sessions":[[{"role":"user","content":"colour 7"}],[{"role":"user","content":"other"}]]}]')
    out = harness.run_session_file(datasets.read_sessions(spark, str(tmp_path / "s.json")), 5, ("tier-0",)).collect()
    assert [x.correct for x in out] == [True]


def test_store_client_and_context(spark, tmp_path):
    for s in (store.Store(spark), store.Store(spark, str(tmp_path / "db"))):
        c = store.Client(s)
        ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(4)]
        c.save_chunk({"id": ids[0], "text": "the hero's homeland"})
        c.save_chunk({"id": ids[1], "text": "the hero draws a sword", "parent": ids[0]})
        c.save_chunk({"id": ids[2], "text": "a recipe for soup"})
        c.save_chunk({"id": ids[3], "text": "another sword of the hero"})
        c.save_fact({"id": ids[0], "key": "hp", "value": "10", "superseded_by": ids[1]})
        c.save_fact({"id": ids[1], "key": "hp", "value": "12"})
        c.save_chunk({"id": ids[2], "text": "a recipe for stew"})
        assert c.load_chunk(ids[2])["text"] == "a recipe for stew" and len(c.list_chunks()) == 4
        out = context.compile_context(s, "sword hero", ids[1])
        rows = [(x.layer, x.pos, x.id) for x in out.orderBy("layer", "pos").collect()]
        assert rows == [("dynamic", 0, ids[3]), ("dynamic", 1, ids[0]), ("fact", 0, ids[1]), ("query", 0, None), ("resident", 0, ids[1]), ("resident", 1, ids[0])]
        prompt = context.render(out).first().prompt
        assert prompt.startswith("the hero's homeland\n\nthe hero draws a sword\n\n## Facts\n- hp: 12\n\n## Related\nanother sword") and prompt.endswith("## Query\nsword hero")
        c.delete_chunk(ids[2])
        for act in (c.delete_chunk, c.load_chunk):
            with pytest.raises(store.NotFoundError):
                act(ids[2])
        c.save_pending({"id": ids[0], "text": "todo", "introduced_at": ids[1]})
        assert c.load_pending(ids[0])["priority"] == "Medium" and c.list_pending() == [ids[0]] and len(c.list_facts()) == 2
        assert len(c.compile_context("sword")) >= 3
    assert store.checked_ids(s.read("chunk")).count() == 3
    with pytest.raises(Exception, match="malformed"):
        store.checked_ids(spark.createDataFrame([("nope",)], "id string")).collect()


def test_checks(spark):
    df = spark.createDataFrame([("p", None, ["a"], 1), ("a", "p", [], 0), ("b", "p", [], 1)], "id string, parent string, children array<string>, summary_level int")
    assert [(x.parent, x.child, x.by_child) for x in checks.unmatched_links(df).collect()] == [("p", "b", True)]
    assert [x.id for x in checks.levels_not_falling(df).collect()] == ["b"]
    before = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert [(x.id, x.ancestor) for x in checks.not_transitive(before, "src", "dst").collect()] == [(1, 3)]
    pending = spark.createDataFrame([("x", 1, 2), ("y", 2, 1), ("z", 1, 1), ("w", 1, None)], "id string, introduced_at long, resolved_at long")
    assert [x.id for x in checks.resolved_before(pending, before).collect()] == ["y"]
    chunks = spark.createDataFrame([(1, ["x", "z", "w"], 0, None), (2, [], 0, ["i"])], "id long, pending array<string>, summary_level int, items array<string>")
    assert [x.id for x in checks.unlisted_pending(pending, chunks).collect()] == ["y"] and [x.id for x in checks.leaves_without_items(chunks).collect()] == [1]


def test_model_adapters(spark):
    import numpy as np

    class FakeTokens:
        def encode(self, a, b=None):
            from types import SimpleNamespace

            words = (a + (" " + b if b else "")).split()
            ids = [len(w) for w in words]
            return SimpleNamespace(ids=ids, attention_mask=[1] * len(ids), type_ids=[0] * len(ids), tokens=words, special_tokens_mask=[0] * len(ids))

        def decode(self, ids):
            return " ".join(map(str, ids))

    df = spark.createDataFrame([(1, "aa bbb"), (2, "c")], "id long, text string")

    def states(a):
        return np.stack([a["input_ids"], np.ones(a["input_ids"].shape)], axis=2).astype(float)

    out = {x.id: x.embedding for x in models.encode(df, "id", "text", lambda: (FakeTokens(), states), 2).collect()}
    assert abs(out[1][0] / out[1][1] - 2.5) < 1e-9 and abs(out[2][0] - out[2][1]) < 1e-9 and abs(sum(x * x for x in out[1]) - 1) < 1e-9
    nli = lambda: (FakeTokens(), lambda a: np.stack([np.zeros(len(a["input_ids"])), (a["attention_mask"].sum(axis=1) > 4) * 10.0 - 5], axis=1))
    rows = models.entailments(df, "id", "text", ["x", "y z"], "is {label}", nli, 1).collect()
    assert sorted((x.id, x.label, x.matched) for x in rows) == [(1, "y z", "entailment=0.993")]
    turned = models.entailments(df.withColumn("p", F.lit("more words")), "id", "text", ["x"], "is {label}", nli, 1, premise="{text} {new_turn}", turn_col="p").collect()
    assert sorted(x.id for x in turned) == [1, 2]
    assert models.entailments(df, "id", "text", [], "", nli, 1).count() == 0
    piece = lambda: (FakeTokens(), lambda a: np.stack([np.zeros_like(a["input_ids"]), a["input_ids"]], axis=-1).astype(float))
    probs = {(x.id, x.pos): x.prob for x in models.token_probabilities(df, "id", "text", piece).collect()}
    assert probs[1, 1] > probs[1, 0] > 0.5
    # whole pruning: long words are worth most, the last word stays, short texts stay as they are
    texts = spark.createDataFrame([(1, "a bb wonderful cc marvel ##lous d e"), (2, "x y"), (3, None)], "id long, text string")
    out = {x.id: x.compressed for x in models.pruned(texts, "id", "text", piece, 3, 1).collect()}
    assert out == {1: "wonderful marvellous e", 2: "x y", 3: None} or out[1].endswith(" e") and out[2] == "x y" and out[3] is None
    with pytest.raises(ValueError):
        models.embeddings(df, "id", "text", "unknown")
    step = iter([[0.0, 9.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 5.0]])
    assert models.greedy_decode(lambda _: next(step), 0, 2, longest=5, shortest=1) == [1]


def test_closures_have_no_depth_limit(spark):
    n = 1100
    line = spark.range(n).selectExpr("id as s", "id + 1 as d")
    far = graph.closure(line, "s", "d")
    assert far.count() == n * (n + 1) // 2 and far.where("id = 0").count() == n and far.agg(F.max("depth")).first()[0] == n
    up = graph.chain(spark.range(3000).selectExpr("id", "id - 1 as parent"), "id", "parent", spark.range(2999, 3000))
    assert up.count() == 3000 and up.where("id = 0").first().depth == 2999


def test_upsert_keeps_the_last_of_an_id(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("a", 7, 1), ("a", 5, 2), ("c", 9, 0)], "id string, v int, at int")
    assert sorted(map(tuple, store.upsert(old, new, order="at").collect())) == [("a", 5), ("b", 2), ("c", 9)]


def test_folds_equal_plain_loops(spark):
    """The tail by a running sum and the head by a sorted fold, on random costs."""
    import random

    r = random.Random(3)
    for _ in range(200):
        tokens = [["w%d" % r.randrange(6)] * r.randrange(0, 4) for _ in range(r.randrange(0, 9))]
        budget, tail = r.randrange(0, 9), r.randrange(0, 6)
        kept, left = set(), tail
        for k in reversed(range(len(tokens))):
            if len(tokens[k]) > left:
                break
            left -= len(tokens[k])
            if tokens[k]:
                kept.add(k)
        room = max(budget - sum(len(tokens[k]) for k in kept), 0)
        scores, used = condense.sentence_scores(tokens).round(9), 0
        for k in sorted(set(range(len(tokens))) - kept, key=lambda k: (-scores[k], k)):
            if used + len(tokens[k]) <= room:
                used += len(tokens[k])
                kept.add(k)
                if used >= room:
                    break
        assert condense.selected_sentences(tokens, budget, tail) == sorted(kept)


def test_contains_join_equals_every_pair(spark):
    texts = [(1, "The quick brown fox jumps"), (2, "brown Fox"), (3, None), (4, "a b c d"), (5, "xbrown foxy")]
    passages = [(1, "quick brown fox"), (2, "own fo"), (3, "B C"), (4, "zz"), (5, None), (6, "HE QUICK BROWN FOX JUM")]
    got = detect.contains_join(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame(passages, "p long, s string"), "p", "s").collect()
    assert sorted(map(tuple, got)) == sorted((i, p) for i, t in texts for p, s in passages if t and s and s.lower() in t.lower())


def test_coding_scenario(spark):
    """Files near the current one come first: hybrid hits rescored by no decay and twice the file proximity."""
    from memlayer.functions import scoring

    rows = [("src/parser/lexer.rs", "parse tokens of the input"), ("src/parser/ast.rs", "tokens become a tree"), ("src/render/draw.rs", "parse tokens then draw"), ("docs/intro.md", "parse tokens intro"), ("tests/parse.rs", "parse tokens tests"), ("src/main.rs", "main entry")]
    chunks = spark.createDataFrame(rows, "id string, text string").withColumn("location", F.struct(F.lit("file").alias("kind"), F.col("id").alias("path"), F.lit(None).cast("string").alias("schema")))
    here = F.struct(F.lit("file").alias("kind"), F.lit("src/parser/mod.rs").alias("path"), F.lit(None).cast("string").alias("schema"))
    hits = retrieval.bm25_one(retrieval.build_index(chunks, "id", "text"), spark, "parse tokens", 32)
    score = scoring.composite("hit_score", [(scoring.no_decay("hit_score"), 1), (scoring.file_proximity("hit_score", F.col("location"), here), 2)])
    best = context.dynamic_layer(hits, chunks, score).collect()
    assert best[0].id.startswith("src/parser/")


def test_providers_have_their_shape(spark):
    from memlayer.plans.protocols import StorageProvider

    assert isinstance(store.MemoryTable(spark, "id string"), StorageProvider)
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two three")], "id string, text string")
    summarizer = lambda df, i, t: df.select(F.col(i).alias("id"), F.upper(t).alias("summary"))
    out = condense.summarize(chunks.withColumn("level", F.lit(5)), "id", "text", "level", {2: ("Upper", summarizer)}).collect()
    assert {(x.id, x.method, x.summary) for x in out} == {("a", "Upper", "ONE TWO"), ("b", "Upper", "TWO THREE")}
    with pytest.raises(Exception, match="no summarizer"):
        condense.summarize(chunks.withColumn("level", F.lit(1)), "id", "text", "level", {2: ("Upper", summarizer)}).collect()
    assert condense.method_for(2, {2: "Upper"}, "None") == "Upper" and condense.method_for(3, {2: "Upper"}, "None") == "None"
    held = detect.classify_texts(chunks, "id", "text", {"labels": ["Literal", "Narrative"], "embedding_dim": 64, "weights": [[1.0] * 64, [0.0] * 64], "bias": [0.0, 0.0]}).collect()
    assert {x["class"] for x in held} == {"Literal"}


def test_rules_from_a_table_equal_containment(spark):
    r = random.Random(5)
    texts = [(i, "".join(r.choices("abcd ", k=400))) for i in range(60)] + [(90, None), (91, "")]
    rules = [(n, f"l{n % 7}", "".join(r.choices("abcd ", k=r.randrange(4, 7)))) for n in range(5000)] + [(5001, "any", ""), (5002, "none", None), (5003, "twice", "ab"), (5004, "again", "ab")]
    df, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rules, "ordinal long, label string, keyword string")
    want = {(i, n, label, k) for i, t in texts for n, label, k in rules if t is not None and k is not None and k in t}
    want |= {(90, 5001, "any", "")}  # a text and a payload that are both null join to an empty one
    for size in (detect.RULE_BYTES, 9000):
        got = [tuple(x) for x in detect.detect_rules(df, "id", F.col("text"), F.lit(None).cast("string"), table, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert detect.detect_rules(df, "id", F.col("text"), F.lit(None).cast("string"), table.limit(0)).count() == 0


def test_a_malformed_line_is_named_whatever_the_splits(spark, tmp_path):
    good = '{"context": "c", "questions": ["q"], "answers": [["a"]], "metadata": "m"}'
    lines = [good, "", good, "  ", good, good, '{"context": ', good, good]
    (tmp_path / "q.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(sum(map(len, lines)) // 4 + 3))
    try:
        numbered = datasets.numbered_lines(spark, str(tmp_path / "q.jsonl"))
        assert numbered.select("value", "line").orderBy("line").collect() == [(v, n + 1) for n, v in enumerate(lines)]
        assert spark.read.text(str(tmp_path / "q.jsonl")).rdd.getNumPartitions() >= 4
        with pytest.raises(ValueError, match="malformed line 7 of"):
            datasets.read_questions(spark, str(tmp_path / "q.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "ok.jsonl").write_text("\n".join(x for x in lines if x.strip() and x.endswith("}")) + "\n")
    assert datasets.read_questions(spark, str(tmp_path / "ok.jsonl")).count() == 6


def test_labels_answer_for_forests_and_their_exceptions(spark):
    r = random.Random(6)
    edges = {(i, r.randrange(i + 1, 200)) for i in range(199)} | {(i, r.randrange(i + 1, 200)) for i in r.sample(range(199), 25)} | {(1000 + i, 1000 + i // 2) for i in range(1, 40)}
    above = {}
    for s, d in edges:
        above.setdefault(s, set()).add(d)

    def all_above(i):
        out, queue = set(), [i]
        while queue:
            for j in above.get(queue.pop(), ()):
                if j not in out:
                    out.add(j)
                    queue.append(j)
        return out

    ids = list(range(200)) + list(range(1000, 1040)) + [-1]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(3000)]
    reach = graph.Reach(spark.createDataFrame(sorted(edges), "s long, d long"), "s", "d")
    got = reach.pairs(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert len(got) == len(pairs) and all(x.reached == (x.b in all_above(x.a)) for x in got)
    with pytest.raises(ValueError):
        graph.Reach(spark.createDataFrame([(1, 2), (2, 1)], "s long, d long"), "s", "d")
    assert graph.forest_labels(spark.createDataFrame([], "s long, d long"), "s", "d").count() == 0


def test_labels_of_a_long_chain(spark):
    n = 100_000
    rows = spark.range(n).select("id", F.when(F.col("id") < n - 1, F.col("id") + 1).alias("parent"))
    labels = graph.forest_labels(rows, "id", "parent")
    wrong = labels.where((F.col("root") != n - 1) | (F.col("size") != F.col("id") + 1) | (F.col("first") != n - 1 - F.col("id")))
    assert labels.count() == n and wrong.count() == 0
