import re

from pyspark.sql import functions as F
from test_decontaminate import ends

import corpus_pipeline
from memlayer.llm import decontaminate, near_copies

D = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    now = [x.asDict() for x in docs.collect()]
    extra = [{"doc_id": 10**6, "text": None}, {"doc_id": 10**6 + 1, "text": "12 !?"}, {"doc_id": None, "text": now[0]["text"]}, {"doc_id": 10**6 + 2, "text": now[0]["text"]}]
    now += [{**now[0], **x} for x in extra]
    items = [decontaminate.fold(x.text) for x in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    df = spark.createDataFrame(now, docs.schema)

    df = corpus_pipeline.STAGES[0][1](spark, df, D)
    assert df.columns == columns
    want = [x for x in now if re.search(r"[^\W\d_]", x["text"] or "")]
    assert sorted(map(str, [x.doc_id for x in df.collect()])) == sorted(map(str, [x["doc_id"] for x in want]))

    df = corpus_pipeline.STAGES[1][1](spark, df, D)
    sets = {x["doc_id"]: set(near_copies.shingles(x["text"]).tolist()) for x in want if x["doc_id"] is not None}
    group = {}
    for i in sorted(sets):  # by increasing id; groups are closed over links
        near = {group[j] for j in group if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        name = min(near | {i})
        group[i] = name
        group = {j: name if g in near else g for j, g in group.items()}
    kept = {i for i in group if group[i] == i} | {None}
    assert df.columns == columns and {x.doc_id for x in df.collect()} == kept

    df = corpus_pipeline.STAGES[2][1](spark, df, D)
    index = decontaminate.Items(list(enumerate(items)))
    leaks = lambda text: any(ends(t, decontaminate.fold(text), int(b)) for t, b in zip(index.text, index.budget, strict=True))
    clean = {x["doc_id"] for x in want if x["doc_id"] in kept and not any(t in decontaminate.fold(x["text"]) for t in items)}
    got = {x.doc_id for x in df.collect()}
    texts = {x["doc_id"]: x["text"] for x in want}
    assert df.columns == columns and got <= clean
    # what went beyond exact passages holds one within the budget, by the plain table
    assert all(leaks(texts[i]) for i in clean - got)

    df = corpus_pipeline.STAGES[3][1](spark, df, D)
    rows = df.collect()
    assert df.columns == columns and {x.doc_id for x in rows} == got
    assert not any(re.search(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]", x.text) for x in rows) and all(x.n_chars == len(x.text) for x in rows)

    out = corpus_pipeline.STAGES[4][1](spark, df, D)
    assert {x.doc_id for x in out.select("doc_id").collect()} == got
    tokens = out.groupBy("sequence_id").sum("length").collect()
    assert max(x[1] for x in tokens) <= 2048


def test_columns_of_any_name(spark):
    """Every stage but the last passes on columns that are named like its own, with a null in each and repeated rows."""
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 30")
    names = ["_t", "_lang_pred", "_spans", "_id", "row", "_s", "node", "i", "t", "new", "base", "text_", "a.b"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    wide = wide.union(wide.where("doc_id = 3")).union(wide.where("doc_id = 4").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, D)
        rows = out.collect()
        assert out.columns == wide.columns and rows
        assert all(x[n] == f"{n}{x.doc_id}" for x in rows if x.doc_id is not None for n in names)


def test_empty(spark):
    empty = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, D)
        assert out.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 100


def test_rows_without_an_id_are_judged_each_for_itself(spark):
    leak = spark.read.parquet(f"{D}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(None, leak), (None, "two clean words"), (None, "some other clean words"), (None, None), (5, leak), (5, "an id that leaks goes whole"), (6, "stays")]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    assert sorted(map(str, [(x.doc_id, x.text) for x in out])) == sorted(map(str, [rows[1], rows[2], rows[3], rows[6]]))
