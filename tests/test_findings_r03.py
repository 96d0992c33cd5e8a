"""One test for each finding of the third round."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from memlayer.functions import text
from memlayer.operators import graph, postings, retrieval
from memlayer.plans import harness
from memlayer.streaming import turns


def test_session_hits_are_cut_within_shards(spark, monkeypatch):
    """no row for each pair of case and session that share a token; ties by id after rounding."""
    chunks = spark.range(400).select("id", F.concat(F.lit("common words here n"), F.col("id") % 7).alias("text"))
    cases = spark.range(40).select(F.col("id").alias("case_id"), F.concat(F.lit("common n"), F.col("id") % 9).alias("question"), F.array(F.concat(F.lit("n"), F.col("id") % 9)).alias("accepted"))

    def refused(*_):
        raise AssertionError("all pairs are scored")

    monkeypatch.setattr(retrieval, "bm25_scores", refused)
    out = {r.case_id: (r.correct, r.context.count("---") + 1) for r in harness.run_sessions(cases, chunks, 5).collect()}
    assert out == {i: (i % 9 < 7, 5) for i in range(40)}


def test_scores_are_rounded_before_ties_go_by_id(spark, monkeypatch):
    """the last bits of a sum, which depend on its order, decide nothing."""
    scored = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0 - 1e-13), (0, "c", 0.5)], "query_id int, id string, score double")
    monkeypatch.setattr(retrieval, "bm25_scores", lambda *_: scored)
    assert [r.id for r in retrieval.bm25_one(None, spark, "q", 2).collect()] == ["a", "b"]


def test_closure_of_chains_writes_each_pair_once(spark, monkeypatch):
    """rounds add the farther pairs only; forks and cycles give what they gave."""
    written = []
    kept = graph.materialize

    def counted(df, name):
        out = kept(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    line = spark.range(19).select("id", (F.col("id") + 1).alias("up"))
    want = {(a, b, b - a) for a in range(19) for b in range(a + 1, 20)}
    assert {tuple(r) for r in graph.closure(line, "id", "up").collect()} == want and sum(written) == len(want)
    odd = [(0, 1), (1, 2), (2, 0), (3, 0), (4, 4), (5, 6), (5, 7), (7, 6), (None, 1), (1, None)]
    for edges in (odd, odd[:4], odd[4:5], odd[5:8], odd[8:]):
        near = {(a, b) for a, b in edges if a is not None and b is not None}
        depth = {}
        for start in {a for a, _ in near}:
            seen, level = {start}, 0
            front = {start}
            while front:
                level += 1
                front = {b for a, b in near if a in front}
                front = {b for b in front if (start, b) not in depth}
                depth.update({(start, b): level for b in front})
        got = {(r.id, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(edges, "s int, d int"), "s", "d").collect()}
        assert got == depth


def test_labels_of_paths_take_no_walk(spark, monkeypatch):
    """trees without a fork are labelled by depth; the labels are those of the walk."""
    rows = [(3, None), (1, 3), (2, 1), (9, 8), (7, None), (6, 7), (5, 7), (4, 6), (20, 21), (21, 20)]
    nodes = spark.createDataFrame(rows, "id int, parent int")
    got = {r.id: tuple(r)[1:] for r in graph.forest_labels(nodes, "id", "parent").collect()}
    assert got == {3: (3, 0, 5, 3), 1: (3, 1, 4, 2), 2: (3, 2, 3, 1), 9: (9, 0, 1, 1), 7: (7, 0, 7, 4), 5: (7, 1, 2, 1), 6: (7, 3, 6, 2), 4: (7, 4, 5, 1), 20: (None,) * 4, 21: (None,) * 4}

    def refused(_):
        raise AssertionError("walked around a path")

    monkeypatch.setattr(graph, "_walk_labels", refused)
    reach = graph.Reach(spark.createDataFrame([(1, 3), (2, 1)], "s int, d int"), "s", "d")
    asked = spark.createDataFrame([(2, 3), (3, 2), (2, 2), (2, 3), (2, 99), (None, 3)], "a int, b int")
    assert sorted((r.a or 0, r.b, r.reached) for r in reach.pairs(asked, "a", "b").collect()) == [(0, 3, False), (2, 2, False), (2, 3, True), (2, 3, True), (2, 99, False), (3, 2, False)]


def test_late_facts_call_the_state_once_a_key():
    """a key's input reads one value, writes one, and sets a timer only for a new first event."""
    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    facts = turns.LateFacts()
    facts.init(Handle())
    turn = lambda at, event, kind: Row(micros=at, event_id=event, event_type=kind)
    come = lambda *rows: [(r.event_id, r.value, r.superseded, r.active, r.change) for r in facts.handleInputRows((7,), iter(rows), Times())]
    assert come(turn(2000, 2, "b"), turn(1000, 1, "a")) == [(1, "a", None, True, 1), (2, "b", 1, True, 1)] and calls == ["get", "update", "timer"]
    calls.clear()
    assert come(turn(1500, 3, "b")) == [(3, "b", 1, True, 2), (2, "b", 1, False, 2)] and calls == ["get", "update"]
    calls.clear()
    assert come(turn(1500, 3, "b")) == [] and calls == ["get"]


def test_chunks_leave_in_bounded_batches():
    """a worker holds the chunks of about ``held_chars`` characters, whatever its input batch holds."""
    texts = ["abcde fghij " * 50, None, "", "x" * 10] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(texts)], names=["i", "t"])
    out = list(text.chunk_batches(iter([batch]), 64, 1000))
    assert max(sum(map(len, b.column(2).to_pylist())) for b in out) < 1100
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(text.cut_chunks(t or "", 64))]


def test_shards_are_built_from_flat_arrays(monkeypatch):
    """F8: no Python row for each posting list of a new shard; order, blocks and bounds are those of a plain loop."""

    def refused(*_):
        raise AssertionError("a posting list became a row")

    monkeypatch.setattr(postings, "_posting", refused)
    docs = [[f"w{k}" for k in range(12) if i % (k + 1) == 0] * (1 + i % 3) for i in range(300)]
    lengths = np.array([len(d) for d in docs], np.int32)
    tokens = pa.array([t for d in docs for t in d])
    rows = [r for b in postings._shard_batches("s", list(range(300)), tokens, lengths, postings._schema(LongType()), 5) for r in b.to_pylist()]
    assert (rows[0]["kind"], rows[0]["n"], rows[0]["length"], rows[0]["docs"]) == (postings.HEADER, 300, int(lengths.sum()), lengths.tolist())
    assert [r["term"] for r in rows[1:]] == sorted(f"w{k}" for k in range(12))
    for r in rows[1:]:
        held = [(i, d.count(r["term"])) for i, d in enumerate(docs) if r["term"] in d]
        parts = [held[a : a + postings.BLOCK] for a in range(0, len(held), postings.BLOCK)]
        assert (r["docs"], r["tfs"]) == ([i for i, _ in held], [n for _, n in held])
        assert (r["tops"], r["lows"]) == ([max(n for _, n in p) for p in parts], [min(len(docs[i]) for i, _ in p) for p in parts])


def test_language_models_and_limits_come_from_all_texts(spark, monkeypatch):
    """every labelled text counts, whatever the number and length of the texts."""
    import random

    from memlayer.llm import language
    from memlayer.llm.common import training_row

    r = random.Random(2)
    rows = [(i, "".join(r.choices("abcd é" if i % 2 else "bcde", k=r.randrange(1, 40))), "x" if i % 2 else "y") for i in range(1600)]
    rows += [(4001, "ab ñ" * (1 << 19), "x"), (None, "qqq", "x"), (4002, None, "x"), (4003, "qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "HELD", 100)
    model = language.train(docs)
    kept = {x.doc_id for x in docs.where(training_row("doc_id")).select("doc_id").collect()}
    learned = {lang: [t.encode() for i, t, of in rows if i in kept and t and of == lang] for lang in "xy"}
    assert len(learned["x"]) > 500 and sorted(model) == ["x", "y"] and any(len(t) > 1 << 20 for t in learned["x"])
    for lang, texts in learned.items():
        for got, want in zip(model[lang].levels, language.ContextTree(texts).levels, strict=True):
            assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    scorer = language.Scorer(model)
    held = {lang: [scorer([t.encode()])[0].min() / len(t.encode()) for i, t, of in rows if i is not None and i not in kept and t and of == lang] for lang in "xy"}
    limits = language.limits(docs, model)
    for lang, rates in held.items():
        assert len(rates) > 150
        assert 0 <= limits[lang] / language.MARGIN - np.quantile(rates, 0.99) <= 1 / language.CELLS


def test_near_copy_sketches_keep_no_rows_waiting(spark, monkeypatch):
    """pipeline: no Python expression beside the texts, whose rows would wait in memory for their sketches."""
    from memlayer.llm import near_copies

    plans, kept = {}, near_copies.materialize

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(near_copies, "materialize", seen)
    docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(6)] + [(7, None), (8, "")], "doc_id int, text string")
    assert sorted(x.doc_id for x in near_copies.drop_copies(docs).collect()) == [0, 2, 4, 7]
    assert "EvalPython" not in plans["sketches"]


def test_cases_of_one_corpus_share_its_chunks(spark):
    """chunks of a corpus are not copied for each of its cases; hits are those of a copy for each."""
    import random

    r = random.Random(5)
    text_of = lambda n: " ".join(r.choices(["a", "b", "c", "d", "e", "f", "g"], k=n))
    chunks = spark.createDataFrame([(c, i, text_of(r.randrange(1, 30))) for c in range(4) for i in range(15)], "corpus int, id int, text string")
    cases = spark.createDataFrame([(f"{c}-{q}", c, text_of(3)) for c in range(5) for q in range(3)] + [("none", 0, "zzz")], "case_id string, corpus int, question string")
    copied = cases.join(chunks, "corpus").select("case_id", "id", "text")
    for hybrid in (False, True):
        hits = lambda *x: sorted(map(tuple, harness.retrieve_within(*x, k=4, hybrid=hybrid).collect()))
        shared = hits(chunks, cases)
        assert len(shared) >= 4 * 12 and shared == hits(copied, cases.drop("corpus"))
