import hashlib
import random
import re

from pyspark.sql import functions as F

from memlayer.llm import privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    """The plain patterns with Python's own engine."""
    out = []
    for n, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and kind == "card" and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def odd_texts():
    r = random.Random(8)
    bits = ["a.b@c.d", "@", "x@y.z_q@w.e.r", "1.2.3.4", "999.1.2.3.4", "001.002.3.255", "256.1.1.1", "+1 (974) 555-3436", "+", "4111111111111111", "4111 1111-1111 1111", "7086638319846192", " ", "-", ".", "é", "😀", "12", "+49 30 1234567", "\n", "(", "_", "%", "0" * 30, "a" * 40, "..", "--"]
    return ["".join(r.choices(bits, k=r.randrange(1, 14))) for _ in range(1500)]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [*odd_texts(), None, "", "x" * 200000, "a@b" + ".c" * 20000, "1" * 100000, "1.2.3.4 😀 " * 3000, "+1" + " " * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = privacy._base(df.withColumn("_t", F.coalesce("text", F.lit("")))).select("doc_id", "_base").collect()
    got = {x.doc_id: [tuple(s) for s in x._base] for x in out}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)


def test_additions_redaction_and_odd_rows(spark):
    rows = [
        (1, "please email jane.doe at example dot com now", "k"),
        (2, "call (555) 123-4567 or mail a@b.de, order 555-123-4567", None),
        (3, None, "k"),
        (4, "", "k"),
        (None, "1.2.3.4 and 1.2.3.4", "k"),
        (5, "nothing here at all. we meet at noon", "k"),
        (5, "nothing here at all. we meet at noon", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    model = privacy.fit(spark)
    found = privacy.find_personal_data(df, model).select("row.doc_id", "row.kind", privacy.listed("spans").alias("spans"), privacy.redacted(F.col("row.text")).alias("text"), privacy.count_of("base", "ip").alias("n"))
    out = {x.doc_id: x for x in found.collect()}
    assert found.count() == 7 and out[None].n == 2 and out[None].spans == "ip:0:7,ip:12:19"
    assert out[None].text == "[IP] and [IP]" and out[3].text is None and out[4].text == "" and out[5].text == rows[5][1]
    assert out[1].spans == "email:13:40" and out[1].text == "please email [EMAIL] now"
    assert out[2].text == "call [PHONE] or mail [EMAIL], order 555-123-4567"
    assert privacy.find_personal_data(df.limit(0), model).count() == 0


def test_clashing_names_and_many_spans(spark):
    text = "a@b.de 1.2.3.4 " * 3000 + "mail jo at example dot com " * 500
    df = spark.createDataFrame([(1, text, 7, "q", [1])], "doc_id long, text string, _t int, _spans string, _base array<int>")
    x = privacy.find_personal_data(df, privacy.fit(spark)).first()
    assert (x.row._t, x.row._spans, x.row._base, len(x.base)) == (7, "q", [1], 6000) and len(x.spans) == 6500


def test_wide_needs_are_implied_by_the_patterns():
    r = random.Random(2)
    for kind, name in enumerate(privacy.KINDS):
        wide, needs = (re.compile(p.replace("}+", "}")) for p in (privacy.WIDE[name], privacy.WIDE_NEEDS[name]))
        hits = 0
        for _ in range(2000):
            hit = {0: "jane.doe@example.co.uk", 1: "10.0.0.255", 2: "4111111111111111", 3: "+1 974 555 3436"}[kind]
            text = r.choice(["", "contact ", "x ", "\n"]) + r.choice([privacy.respelt(r, kind, hit), privacy.look_alike(r, kind)]) + r.choice(["", " now", ","])
            if wide.search(text):
                hits += 1
                assert needs.search(text), text
        assert hits > 1500


def test_the_trees_fit_their_examples_and_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for given in (None, docs):
        rows = privacy.learn(spark, given)
        model = privacy.grown(rows)
        assert all(m[1] < float("inf") for m in model.values())
        for n in range(4):
            mine = [(y, sum(privacy._walk(t, x) for t in model[n][0]) >= model[n][1]) for k, y, part, x in rows if k == n and part == 1]
            right = [a for a, chosen in mine if chosen]
            assert sum(right) / len(right) >= 0.97 and sum(right) / sum(y for y, _ in mine) > 0.8


def test_query_on_the_documents(spark):
    from memlayer.llm.queries import op9_privacy

    d = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for x in op9_privacy(spark, d).collect():
        spans = brute(texts[x.doc_id])
        want = ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))
