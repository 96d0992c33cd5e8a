"""Tests for the findings of the fourth round."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from memlayer.functions.hashing import fnv1a_int
from memlayer.operators import evaluate, within
from memlayer.plans import harness
from memlayer.store_queries import conflict_recall


def test_every_turn_of_a_conversation_is_asked(spark, tmp_path):
    """F1: conflict_recall asked the first two turns only."""
    rows = [(c, t, "user", f"turn{t} of conversation{c} has word{c * 10 + t}") for c, n in ((0, 1), (1, 3), (2, 7)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.ablation: (r.total, r.correct, r.accuracy) for r in conflict_recall(spark, str(tmp_path)).collect()}
    assert out == dict.fromkeys(evaluate.ABLATIONS, (11, 11, 1.0))


def test_all_questions_with_answers_are_cases(spark):
    """no number of questions drops the rest; those without an answer are no cases, as before."""
    entries = spark.createDataFrame([("a context with a0 a1 and a3", ["a0", "a1", "a2", "a3", "zz"], [["a0"], ["A1"], [], ["x", "a3"], ["none"], ["more"]])], "context string, questions array<string>, answers array<array<string>>")
    asked = evaluate.first_questions(entries, None).orderBy("pos").collect()
    assert [(x.pos, x.question) for x in asked] == [(0, "a0"), (1, "a1"), (3, "a3"), (4, "zz")]
    out = {r.case_id.split("-")[1]: (r.correct, r.retrieved_chunks, r.retrieval_chars) for r in harness.run_questions(entries, None, ("tier-0",)).collect()}
    assert out == {"0": (True, 1, 27), "1": (True, 1, 27), "3": (True, 1, 27), "4": (False, 0, None)}


def plain(texts, question, k, hybrid):
    """Places by plain loops: BM25, or its fusion with the cosine of hashing embeddings."""
    docs = [t.split() for t in texts]
    df, mean = Counter(w for d in docs for w in set(d)), max(sum(map(len, docs)) / len(docs), 1)
    idf = lambda w: math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1)
    keyword = [sum(idf(w) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in question.split() if w in d) for d in docs]

    def vector(words):
        v = np.bincount([fnv1a_int(w.encode()) % 64 for w in words], minlength=64)
        return v / (np.linalg.norm(v) or 1)

    best = lambda scores, n: sorted((-round(s, 9), i) for i, s in enumerate(scores) if s > 0)[:n]
    if not hybrid:
        return [i for _, i in best(keyword, k)]
    fused = [0.0] * len(docs)
    for leg in (keyword, [float(vector(d) @ vector(question.split())) for d in docs]):
        for _, i in best(leg, 4 * k):
            fused[i] += 0.5 * leg[i] / max(leg)
    return [i for _, i in best(fused, k)]


@pytest.mark.parametrize("hybrid", [False, True])
def test_places_are_those_of_plain_loops(spark, monkeypatch, hybrid):
    """corpora over many batches and parts, longer than the pools of 4k, with copies, empty texts and none at all."""
    r = random.Random(11)
    text_of = lambda n: " ".join(r.choices("a b c d e f g h i j".split(), k=n))
    texts = {c: [text_of(r.choice([0, 1, 4, 9])) for _ in range(n)] for c, n in enumerate((1, 5, 23, 40))}
    texts[3][20:30] = texts[3][:10]
    cases = [(f"{c}-{q}", c, text_of(r.randrange(5))) for c in range(5) for q in range(12)] + [("none", 0, "zzz"), ("null", 1, None), ("lost", None, "a b")]
    monkeypatch.setattr(within, "PART", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunks = spark.createDataFrame([(c, i, t) for c, ts in texts.items() for i, t in enumerate(ts)], "corpus int, id int, text string").repartition(3)
        asked = spark.createDataFrame(cases, "case_id string, corpus int, question string")
        out = {x.case_id: x.places for x in within.best_places(within.corpora(chunks), asked, 2, hybrid).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {i: plain(texts[c], q or "", 2, hybrid) if c in texts else [] for i, c, q in cases}


def test_scores_are_held_in_bounded_blocks(monkeypatch):
    """as many cases at a time as fit, with the same hits."""
    import pyarrow as pa

    r = random.Random(3)
    lists = lambda n: pa.array([r.choices("abcdefgh", k=r.randrange(6)) for _ in range(n)], pa.list_(pa.string()))
    held, cases = lists(9), lists(30)
    index = within.CorpusIndex([(held, None)])
    whole = list(index.best(cases, None, 4))
    monkeypatch.setattr(within, "HELD_CELLS", 40)
    parts = list(index.best(cases, None, 4))
    assert len(whole) == 1 and len(parts) > 5
    for n in range(2):
        assert np.concatenate([p[n] for p in parts]).tolist() == whole[0][n].tolist()
