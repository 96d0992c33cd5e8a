import math
import random
from collections import Counter, defaultdict

import numpy as np

from memlayer.llm import language
from memlayer.llm.common import training_row


def brute_bits(train, text, order):
    """Counts in plain dicts, one byte after the other."""
    counts = defaultdict(Counter)
    for t in train:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k, t[i - k : i]][t[i]] += 1
    total, t = 0.0, b"\0" * order + text
    for i in range(order, len(t)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            c = counts.get((k, t[i - k : i]))
            if not c:
                continue
            n = sum(c.values()) + len(c)
            if t[i] in c:
                total -= math.log2(c[t[i]] / n)
                break
            total -= math.log2(len(c) / n)
    return total


def test_code_lengths_equal_brute_force():
    r = random.Random(4)
    make = lambda a: "".join(r.choices(a, k=r.randrange(60))).encode()
    train = {"x": [make("abc é") for _ in range(9)], "y": [make("bcd\0") for _ in range(7)], "z": [b""]}
    texts = [make("abcde é\0ñ") for _ in range(25)] + [b"", b"a", b"", b"q" * 50]
    for order in (1, 2, 3):
        got = language.Scorer({k: language.ContextTree(v, order) for k, v in train.items()}, memo=10)(texts)
        want = [[brute_bits(train[k], t, order) for k in "xyz"] for t in texts]
        assert np.allclose(got, want)


def test_predictions_and_odd_rows(spark):
    r = random.Random(1)
    vocab = {"aa": ["the", "thing", "with"], "bb": ["das", "und", "nicht"]}
    rows = [(i, " ".join(r.choices(vocab[x], k=20)), x, "s") for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa", None), (901, "", None, "s"), (902, "12 34 !?", "bb", "s"), (None, "the thing", "aa", "s"), (903, "the thing with " * 20000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    model = language.train(df, per_language=20)
    out = {x.doc_id: x for x in language.identify(df, model).collect()}
    assert len(out) == len(rows) and out[903]._lang_pred == "aa" and out[900].lang == "aa" and out[903].row is None
    assert [(out[i]._lang_pred, out[i]._score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(x._lang_pred == x.lang and 0.5 < x._score <= 1 for i, x in out.items() if i is not None and i < 120)
    assert language.identify(df.limit(0), model).count() == 0
    assert {x._lang_pred for x in language.identify(df, language.train(df.limit(0))).collect()} == {"und"}


def test_held_out_rows_are_never_learned_from(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {x.doc_id for x in df.where(training_row("doc_id")).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_pipeline_rejects_foreign_and_gibberish(spark):
    import base64
    import random

    import corpus_pipeline

    r = random.Random(1)
    bad = [
        base64.b64encode(r.randbytes(600)).decode(),
        "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=600)),
        "Wczoraj wieczorem poszliśmy do kina, żeby zobaczyć nowy film o podróżach kosmicznych, ale biletów już nie było.",
        "Вчера вечером мы пошли в кино, чтобы посмотреть новый фильм.",
        '<div class="nav"><ul><li><a href="/x1">Home</a></li><li><a href="/q?z=3">News</a></li></ul></div>',
    ]
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    planted = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(bad)], "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.keep_languages(spark, docs.select("doc_id", "text").union(planted), d).collect()}
    assert got == {x.doc_id for x in docs.where("text rlike '\\\\p{L}'").collect()}


def test_repeated_ids_are_sampled_once(spark):
    df = spark.createDataFrame([(1, f"text {k % 2}", "aa") for k in range(300)] + [(3, "other", "aa")], "doc_id long, text string, lang string")
    assert language.sample(df, 300).count() <= 3
