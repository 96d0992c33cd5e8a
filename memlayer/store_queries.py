"""Registered queries of stores, files, locations, contexts and streams, with their SQL. Files go to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlayer.functions import scoring, text, vectors
from memlayer.operators import checks, condense, detect, evaluate, graph, models, postings, retrieval
from memlayer.plans import context
from memlayer.queries import BM25, CASES, FACTS, FLAT, HASHED, KEYWORDS, SCORED, WORDS, _cases, _facts, fit, query, table
from memlayer.sources import datasets, schema, store
from memlayer.sources.steps import shared_dir
from memlayer.streaming import turns


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/memlayer/{name}-{uuid.uuid4().hex}"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks in pairs: an odd one is the child of the even one before it."""
    docs = table(spark, d, "documents")
    parent = F.when(F.col("doc_id") % 2 == 1, (F.col("doc_id") - 1).cast("string"))
    given = {"id": F.col("doc_id").cast("string"), "text": F.col("text"), "parent": parent, "order_in_parent": F.col("doc_id") % 100, "summary_level": (F.col("doc_id") % 2 == 0).cast("int"), "summary_method": F.when(F.col("doc_id") % 2 == 0, "UserManual").otherwise("None")}
    fields = spark.createDataFrame([], schema.CHUNK).schema
    return docs.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@query("select cast(doc_id as varchar) id, case when doc_id % 10 = 0 then '#' || text else text end text from documents where doc_id <> 3")
def store_table(spark: SparkSession, d: str) -> DataFrame:
    """A written table: save all, save a tenth anew (each id twice, the last one wins), load one, delete one, read (SRC2-5)."""
    held = store.Table(spark, _path(spark, "table"), "id string, text string, n bigint")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(0).cast("long").alias("n"))
    held.save(rows)
    tenth = rows.where("cast(id as bigint) % 10 = 0")
    held.save(tenth.withColumn("n", F.lit(1).cast("long")).union(tenth.select("id", F.concat(F.lit("#"), "text"), F.lit(2).cast("long"))), order="n")
    if held.load("3")["id"] != "3":
        raise ValueError("loaded another row")
    held.delete("3")
    return held.read().select("id", "text")


@query("select cast(event_id as varchar) id from events where event_type <> 'click' or event_id % 2 = 0")
def store_memory(spark: SparkSession, d: str) -> DataFrame:
    """The store of one session: two saves and a listing (SRC1, SRC6)."""
    held = store.MemoryTable(spark, "id string, kind string")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"))
    held.save(rows.where("kind <> 'click'"))
    held.save(rows.where("cast(id as bigint) % 2 = 0"))
    return held.list()


UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


def _uuids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).select("doc_id", F.expr(UUID).alias("id"))


@query(f"select {UUID} id from (select md5(cast(doc_id as varchar)) h from documents)")
def checked_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the right form pass, another form would be an error (SRC7)."""
    return store.checked_ids(_uuids(spark, d).select("id"))


@query("select doc_id, doc_id % 3 <> 0 valid from documents")
def uuid_check(spark: SparkSession, d: str) -> DataFrame:
    """SF16: every third id is cut short."""
    ids = _uuids(spark, d).withColumn("id", F.when(F.col("doc_id") % 3 == 0, F.expr("substr(id, 1, 35)")).otherwise(F.upper("id")))
    return ids.select("doc_id", text.is_uuid("id").alias("valid"))


@query("select cast(conv_id as varchar) question_id, cast(conv_id as varchar) answer, count(*) n from conversations group by conv_id")
def sessions_file(spark: SparkSession, d: str) -> DataFrame:
    """Session questions written as JSON arrays, a file for each part, with numbers as answers, and read back (SRC8, SF8)."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("s"))
    entry = F.struct(F.col("conv_id").cast("string").alias("question_id"), F.lit("multi-session").alias("question_type"), F.lit("?").alias("question"), F.col("conv_id").alias("answer"), F.array(F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))).alias("haystack_sessions"))
    # as many parts as keep an array to some 50 conversations
    parts = max(1, convs.count() // 50)
    path = _path(spark, "sessions")
    lines = convs.select(F.pmod(F.xxhash64("conv_id"), F.lit(parts)).alias("part"), F.to_json(entry).alias("j")).groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    lines.write.partitionBy("part").text(path)
    read = datasets.read_sessions(spark, f"{path}/part=*")
    return read.select("question_id", "answer", F.size(F.flatten("haystack_sessions")).cast("long").alias("n"))


@query(
    "with q as (select conv_id, unnest(range(0, len(ts))) pos, unnest(ts) question from (select conv_id, list(text order by turn) ts from conversations group by 1)) "
    "select conv_id, pos, question, case when pos % 2 = 0 then question end accepted from q where pos < 3 and pos % 2 = 0"
)
def questions_file(spark: SparkSession, d: str) -> DataFrame:
    """Contexts with questions written as JSON lines and read back; the first three of each that have answers (SRC9, WIN5, FLT11)."""
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    asked = F.transform("s", lambda t: t["text"])
    answers = F.transform("s", lambda t, i: F.when(i % 2 == 0, F.array(t["text"])).otherwise(F.array().cast("array<string>")))
    path = _path(spark, "questions")
    convs.select(F.lit("").alias("context"), asked.alias("questions"), answers.alias("answers"), F.col("conv_id").cast("string").alias("metadata")).write.json(path)
    out = evaluate.first_questions(datasets.read_questions(spark, path), 3)
    return out.select(F.col("metadata").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "question", F.col("accepted")[0].alias("accepted"))


@query("select item_id, text from benchmark")
def parquet_to_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """SRC10."""
    path = _path(spark, "converted")
    datasets.parquet_to_json_lines(spark, f"{d}/benchmark.parquet", path)
    return spark.read.schema("item_id long, text string").json(path)


@query("select text, lang as label from documents where text is not null")
def labelled_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC12."""
    path = _path(spark, "labelled")
    table(spark, d, "documents").where("text is not null").select("text", F.col("lang").alias("label")).write.json(path)
    return datasets.read_labelled(spark, path)


@query(f"select bench, ablation, case_id, correct, nullif(latency_ms, 0) latency_ms from ({CASES})")
def cases_file(spark: SparkSession, d: str) -> DataFrame:
    """Case metrics as JSON lines by bench and configuration, null fields left out and null again when read (SNK1, SNK4)."""
    path = _path(spark, "cases")
    datasets.write_cases(_cases(spark, d).withColumn("latency_ms", F.nullif("latency_ms", F.lit(0))), path)
    return spark.read.schema("case_id string, correct boolean, latency_ms bigint, bench string, ablation string").json(path).select("bench", "ablation", "case_id", "correct", "latency_ms")


@query(f"select count(*) total, count_if(correct) correct, round(avg(latency_ms), 6) mean_latency_ms, round(count_if(correct) / count(*), 6) accuracy from ({CASES}) where bench = 'b1'")
def case_writer(spark: SparkSession, d: str) -> DataFrame:
    """Create over an earlier run, add in two steps, finish (SNK3)."""
    path, cases = _path(spark, "writer"), _cases(spark, d).where("bench = 'b1'").drop("bench", "ablation")
    datasets.CaseWriter.create(spark, path, "b1", "tier-0").write(cases)
    writer = datasets.CaseWriter.create(spark, path, "b1", "tier-0")
    for part in (0, 1):
        writer.write(cases.where(F.col("case_id").cast("long") % 2 == part))
    return writer.finish().select("total", "correct", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("accuracy", 6).alias("accuracy"))


@query(f"select 'suite' suite, bench, ablation, count(*) n_cases, count_if(correct) correct from ({CASES}) group by 2, 3")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """A report's sections, written as lines of JSON and read back (SNK2)."""
    path = _path(spark, "report")
    datasets.write_summary(_cases(spark, d), "suite", path)
    read = spark.read.schema("suite string, bench string, ablation string, aggregate struct<total:bigint,correct:bigint>, cases array<struct<case_id:string>>").json(path)
    return read.select("suite", "bench", "ablation", F.size("cases").cast("long").alias("n_cases"), F.col("aggregate.correct").alias("correct"))


@query("select cast(r_regionkey as varchar) id, r_name value from region where r_regionkey <> 2")
def client_verbs(spark: SparkSession, d: str) -> DataFrame:
    """The client's verbs on a few facts: save, load, delete, list (SNK5); what is left is read from its store."""
    held = store.Store(spark)
    client = store.Client(held)
    for row in table(spark, d, "region").collect():  # one verb for each of five rows, as an application would
        client.save_fact({"id": str(row.r_regionkey), "key": "name", "value": row.r_name})
    client.delete_fact("2")
    if client.load_fact("3")["key"] != "name" or len(client.list_facts()) != 4:
        raise ValueError("the store lost a fact")
    return held.read("fact").select("id", "value")


LETTERS, HAN_LETTERS = "abcdefghij", "東京都日本語漢字文中"
RUNS = r"[\x{3040}-\x{309F}]+|[\x{30A0}-\x{30FF}]+|[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]+|[A-Za-z]+|[0-9]+"
HAN_TOKENS = rf"flatten(list_transform(regexp_extract_all(translate(text, '{LETTERS}', '{HAN_LETTERS}'), '{RUNS}'), lambda r: case when length(r) > 1 and regexp_matches(r, '^[\x{{4E00}}-\x{{9FFF}}]') then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) else [lower(r)] end))"


@query(f"select doc_id, array_to_string({HAN_TOKENS}, ' ') tokens from documents")
def tokens_han(spark: SparkSession, d: str) -> DataFrame:
    """Script runs with bigrams, over texts whose first ten letters are Han characters (TOK2, TOK3)."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.script_tokens(F.translate("text", LETTERS, HAN_LETTERS)), " ").alias("tokens"))


@query(f"select term, count(distinct doc_id) df from (select doc_id, unnest({HAN_TOKENS}) term from documents) group by 1")
def index_by_script(spark: SparkSession, d: str) -> DataFrame:
    """An index with another tokeniser (TOK4)."""
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", LETTERS, HAN_LETTERS).alias("text"))
    return retrieval.build_index(docs, "doc_id", "text", text.script_tokens).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("select doc_id, right(text, list_max(list_filter(range(0, 17), lambda k: strlen(right(text, k)) <= 16))) tail from documents")
def byte_tails(spark: SparkSession, d: str) -> DataFrame:
    """TOK8."""
    return table(spark, d, "documents").select("doc_id", text.byte_tail("text", 16).alias("tail"))


@query(f"with {fit(HASHED, 'benchmark', 'item_id')} select id item_id, bucket, round(weight, 6) weight from w")
def embedding_provider(spark: SparkSession, d: str) -> DataFrame:
    """The provider that the session names, by default the hashing one; its dense vectors' components (EMB6)."""
    out = models.embeddings(table(spark, d, "benchmark"), "item_id", "text")
    return out.select(F.col("id").alias("item_id"), F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0").select("item_id", "bucket", F.round("weight", 6).alias("weight"))


@query("select cast(doc_id as varchar) id, doc_id % 2 = 1 leaf, doc_id % 2 = 0 node, doc_id % 2 = 0 method from documents")
def node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """FLT1, FLT9."""
    return _chunks(spark, d).select("id", checks.is_raw_leaf().alias("leaf"), checks.is_summary_node().alias("node"), checks.has_method().alias("method"))


@query("select cast(o_orderkey as varchar) id, case when o_orderkey % 4 = 0 then 'c' || o_custkey end resolved_at from orders")
def resolved_pending(spark: SparkSession, d: str) -> DataFrame:
    """FLT3."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("resolved_at"), "o_custkey", "o_orderkey")
    done = orders.where("o_orderkey % 4 = 0").select("id", F.concat(F.lit("c"), "o_custkey").alias("chunk"))
    return store.resolve(orders.select("id", "resolved_at"), done)


@query("select vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (case when label % 2 = 0 then 4 * cast(embedding[i] as double) else 3 * cast(embedding[i] as double) end) * i)) / (case when label % 2 = 0 then 2 else 1 end), 5) total from embeddings")
def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Masked mean of two token vectors, one of them masked for odd labels; summed with the places as weights (AGG9)."""
    rows = F.array(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: 3 * x.cast("double")))
    pooled = vectors.mean_pooled(rows, F.array((F.col("label") % 2 == 0).cast("int"), F.lit(1)))
    weighted = F.aggregate(F.transform(pooled, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(weighted, 5).alias("total"))


@query("select round(avg(cast(quality <> toxic as int)), 6) accuracy, avg(cast(quality <> toxic as int)) >= 4 / 6e0 passed from labels")
def holdout_gate(spark: SparkSession, d: str) -> DataFrame:
    """AGG13."""
    out = detect.holdout_accuracy(table(spark, d, "labels").withColumn("predicted", 1 - F.col("toxic")), "predicted", "quality")
    return out.select(F.round("accuracy", 6).alias("accuracy"), "passed")


@query("select conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) context from conversations group by 1")
def judge_context(spark: SparkSession, d: str) -> DataFrame:
    """AGG14, JN11."""
    return evaluate.judge_text(table(spark, d, "conversations"), "conv_id", "turn")


LOCATIONS = "select page_id, case when page_id % 7 = 0 then null when page_id % 5 = 0 then 'custom' else 'file' end kind, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages"


@query(
    f"with l as ({LOCATIONS}), p as (select *, string_split(path, '/') x, string_split('/en/100', '/') y from l), n as (select *, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) shared, len(list_filter(x, lambda c: c <> '')) depth from p) "
    "select page_id, round(case when kind is null then 0.25e0 when kind = 'custom' then 0.25e0 when path = '/en/100' then 1 else 0.25e0 + 0.75e0 * shared / greatest(depth, 2, 1) end, 6) score from n"
)
def score_location(spark: SparkSession, d: str) -> DataFrame:
    """File and other locations against a current file, with a weight of 0.75; some pages have none (SCO4, SCO6)."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    custom = F.col("page_id") % 5 == 0
    place = F.struct(F.when(custom, "custom").otherwise("file").alias("kind"), F.when(~custom, path).alias("path"), F.when(custom, "s").alias("schema"))
    current = F.struct(F.lit("file").alias("kind"), F.lit("/en/100").alias("path"), F.lit(None).cast("string").alias("schema"))
    return table(spark, d, "pages").select("page_id", F.round(scoring.file_proximity(F.lit(1.0), F.when(F.col("page_id") % 7 != 0, place), current, 0.75), 6).alias("score"))


@query("select vec_id, printf('similarity=%.3f', cast(label as double) / 8) note from embeddings")
def similarity_notes(spark: SparkSession, d: str) -> DataFrame:
    """SF11."""
    return table(spark, d, "embeddings").select("vec_id", text.similarity_note("similarity", F.col("label").cast("double") / 8).alias("note"))


@query("select event_id, replace(replace('{text} / {new_turn} / {text}', '{text}', event_type), '{new_turn}', props) filled from events")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    """SF12."""
    return table(spark, d, "events").select("event_id", text.fill("{text} / {new_turn} / {text}", text=F.col("event_type"), new_turn=F.col("props")).alias("filled"))


@query("select event_id, case event_id % 3 when 0 then cast(event_id as varchar) when 1 then 'true' else event_type end answer from events")
def loose_strings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, booleans and strings of a JSON field as text (SF8)."""
    value = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.lit("true")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    json = F.concat(F.lit('{"answer": '), value, F.lit("}"))
    return table(spark, d, "events").select("event_id", text.loose_string(F.variant_get(F.parse_json(json), "$.answer", "string")).alias("answer"))


@query("select event_id from events where event_type in ('click', 'view')")
def csv_option(spark: SparkSession, d: str) -> DataFrame:
    """SF21."""
    return table(spark, d, "events").where(F.col("event_type").isin(text.parse_names(" click, ,view,"))).select("event_id")


PIECES = f"with w as (select item_id id, {fit(WORDS, 'text')} w from benchmark), u as (select id, unnest(range(0, len(w))) pos, unnest(w) word, len(w) n from w), p as (select id, pos, n, case when pos % 4 = 3 then '##' || word else word end piece, (pos * 37 % 101) / 101e0 prob from u)"


@query(
    f"{PIECES}, f as (select *, coalesce(sum(cast(not starts_with(piece, '##') as int)) over (partition by id order by pos desc rows between unbounded preceding and 1 preceding), 0) < 3 forced from p), "
    "s as (select id, count(*) n, count_if(forced) f, greatest(round(count(*) * least(greatest(10e0 / count(*), 0.05), 1)), ceil(count(*) * 0.05e0)) target from f group by 1), "
    "r as (select f.*, row_number() over (partition by f.id, forced order by prob desc, pos) r, greatest(target - s.f, 0) extra from f join s on f.id = s.id) select id item_id, pos, piece from r where forced or r <= extra"
)
def kept_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Token selection by given probabilities (WIN8, SET5, the relational half of CMP3)."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.words("text").alias("w"))
    rows = words.select("id", F.posexplode("w").alias("pos", "word")).select("id", "pos", F.when(F.col("pos") % 4 == 3, F.concat(F.lit("##"), "word")).otherwise(F.col("word")).alias("piece"), (F.col("pos") * 37 % 101 / F.lit(101.0)).alias("prob"))
    budgets = words.select("id", F.lit(10).alias("target_words"), F.size("w").alias("words"))
    return condense.keep_pieces(rows, budgets, 3).select(F.col("id").alias("item_id"), F.col("pos").cast("long").alias("pos"), "piece")


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), F.lit("total").alias("key"), F.col("o_totalprice").cast("string").alias("value"), F.lit(None).cast("struct<kind:string,chunk:string>").alias("scope"), F.lit("User").alias("origin"), F.col("superseded_by").cast("string").alias("superseded_by"), F.lit(None).cast("timestamp").alias("created_at"))


@query(
    f"with {fit(BM25, '(select * from benchmark where item_id = 0)')}, pool as (select doc_id, score from sc order by round(score, 9) desc, cast(doc_id as varchar) limit 32), best as (select doc_id, row_number() over (order by score desc, cast(doc_id as varchar)) - 1 pos from pool where doc_id <> 1 order by 2 limit 8) "
    "select 'query' layer, 0 pos, cast(null as varchar) id, (select text from benchmark where item_id = 0) as text, 'Unknown' query_class "
    "union all select 'resident', 0, '1', text, null from documents where doc_id = 1 union all select 'resident', 1, '0', text, null from documents where doc_id = 0 "
    f"union all select 'fact', 0, cast(o_orderkey as varchar), cast(o_totalprice as varchar), null from ({FACTS}) where successor is null "
    "union all select 'dynamic', pos, cast(doc_id as varchar), text, null from best join documents using (doc_id)"
)
def compile_context(spark: SparkSession, d: str) -> DataFrame:
    """A whole context: query with its class, resident chunks, active facts, related chunks (CTX1-3, CTX5)."""
    held = store.Store(spark, _path(spark, "store"))
    held.tables["chunk"].save(_chunks(spark, d))
    held.tables["fact"].save(_stated(spark, d))
    asked = table(spark, d, "benchmark").where("item_id = 0").first().text
    out = context.compile_context(held, asked, "1", classifier=lambda q: detect.classify_regex(q, [("^zzz", "Literal")]))
    return out.select("layer", F.col("pos").cast("long").alias("pos"), "id", "text", "query_class")


@query(
    f"with {fit(BM25, '(select * from benchmark where item_id % 50 = 0)')}, pool as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, cast(doc_id as varchar)) r from sc) where r <= 32), "
    "best as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by round(score, 9) desc, cast(doc_id as varchar)) - 1 pos from pool where doc_id <> 1) where pos < 8) "
    "select item_id query_id, 'query' layer, 0 pos, cast(null as varchar) id, text, 'Unknown' query_class from benchmark where item_id % 50 = 0 "
    "union all select item_id, 'resident', 1 - doc_id, cast(doc_id as varchar), d.text, null from documents d, benchmark where doc_id in (0, 1) and item_id % 50 = 0 "
    f"union all select null, 'fact', 0, cast(o_orderkey as varchar), cast(o_totalprice as varchar), null from ({FACTS}) where successor is null "
    "union all select item_id, 'dynamic', pos, cast(doc_id as varchar), text, null from best join documents using (doc_id)"
)
def compile_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Whole contexts of every fiftieth item from a kept index, all in one plan (CTX1-3, CTX5)."""
    held = store.Store(spark, _path(spark, "store"))
    held.tables["chunk"].save(_chunks(spark, d))
    held.tables["fact"].save(_stated(spark, d))
    index = postings.PostingIndex.build(held.read("chunk"), "id", "text", _path(spark, "index"))
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("1").alias("current"))
    out = context.compile_contexts(held, asked, index, classifier=lambda q: detect.classify_regex(q, [("^zzz", "Literal")]))
    return out.select("query_id", "layer", F.col("pos").cast("long").alias("pos"), "id", "text", "query_class")


@query(f"with f as ({FACTS}), r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) r from orders) select a.o_orderkey id, b.o_orderkey other, a.o_custkey = b.o_custkey and a.r < b.r reached from r a join r b on b.o_orderkey = a.o_orderkey + 1 union all select a.o_orderkey, b.o_orderkey, a.r < b.r from r a join r b on a.o_custkey = b.o_custkey where a.o_orderkey % 50 = 0 and a.o_orderkey <> b.o_orderkey + 1 and b.o_orderkey <> a.o_orderkey + 1 and a.o_orderkey <> b.o_orderkey")
def superseded_by(spark: SparkSession, d: str) -> DataFrame:
    """Whether an order's fact was superseded, at once or later, by another's: for neighbours by key, and for every fiftieth with all of
    its customer's, from labels of the chains and without their closure (JN8)."""
    facts = _facts(spark, d)
    reach = graph.Reach(facts, "o_orderkey", "superseded_by")
    keys = facts.select(F.col("o_orderkey").alias("id"), "o_custkey")
    others = keys.select(F.col("id").alias("other"), "o_custkey")
    near = keys.select("id", (F.col("id") + 1).alias("other")).join(others.select("other"), "other").select("id", "other")
    own = keys.where("id % 50 = 0").join(others, "o_custkey").where("abs(id - other) > 1").select("id", "other")
    return reach.pairs(near.union(own), "id", "other").select("id", "other", "reached")


@query("select doc_id, ordinal, label, matched from documents, (select item_id * 10 + k ordinal, 'item' || item_id as label, substr(text, 1 + 30 * k, 12) matched from benchmark, range(10) r(k) where length(text) >= 30 * k + 12) where contains(text, matched)")
def detect_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules from a table, ten of each benchmark item, found by one automaton in every document (DET1, JN6)."""
    items = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).where("length(text) >= 30 * k + 12")
    rules = items.select((F.col("item_id") * 10 + F.col("k")).alias("ordinal"), F.concat(F.lit("item"), "item_id").alias("label"), F.substring("text", 1 + 30 * F.col("k"), F.lit(12)).alias("keyword"))
    found = detect.detect_rules(table(spark, d, "documents"), "doc_id", F.col("text"), F.lit(None).cast("string"), rules)
    return found.withColumnRenamed("id", "doc_id")


@query("select doc_id, row_number() over (partition by doc_id // 300 order by doc_id) line, lang from documents where text is not null")
def numbered_file(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files of JSON lines, 300 ids each, read with each line's number in its file (SRC9)."""
    path = _path(spark, "numbered")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.floor(F.col("doc_id") / 300).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").json(path)
    lines = datasets.numbered_lines(spark, f"{path}/part=*")
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "line", F.get_json_object("value", "$.lang").alias("lang"))


@query(f"with e as (select event_id, ts, label from events, (values {FLAT}) r(ordinal, label, matched) where contains(concat_ws(' ', event_type, props), matched)) select date_trunc('hour', ts) as start, label, count(*) n from e group by 1, 2")
def stream_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as a stream: keyword events counted by hour and label."""
    found = turns.detected(turns.read_turns(spark, f"{d}/events*.parquet"), KEYWORDS)
    return _drained(turns.label_counts(found, "1 hour", "4000 days"), "complete").select("start", "label", "n")


@query("select user_id as key, event_type as value, event_id, lag(event_id) over (partition by user_id order by ts, event_id) superseded from (select *, lag(event_type) over (partition by user_id order by ts, event_id) before from events) where before is null or before <> event_type")
def stream_facts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as a stream: each user's last event type as a fact; a change supersedes the one before."""
    return _drained(turns.latest_facts(turns.read_turns(spark, f"{d}/events*.parquet")), "append")


@query("select user_id as key, event_type as value, event_id, lag(event_id) over (partition by user_id order by ts, event_id) superseded from (select *, lag(event_type) over (partition by user_id order by ts, event_id) before from events) where before is null or before <> event_type")
def stream_late_facts(spark: SparkSession, d: str) -> DataFrame:
    """The same from turns that come in no order, in four micro-batches: each corrects what those before have said."""
    turns.stateful(spark)
    path = _path(spark, "dealt")
    table(spark, d, "events").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).repartition("part").write.partitionBy("part").parquet(path)
    stream = turns.read_turns(spark, f"{path}/part=*")
    return turns.current_facts(_drained(turns.late_facts(stream, "4000 days"), "append"))


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, min(ts) as start, count(*) n from s group by user_id, k")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as a stream: the turns of each user's sessions."""
    return _drained(turns.session_counts(turns.read_turns(spark, f"{d}/events*.parquet"), "12 hours", "4000 days"), "complete").select("user_id", "start", "n")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; each micro-batch's rows become a table of the shared folder, and the last (complete) or all (append) are read."""
    path = _path(stream.sparkSession, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query(f"with c as ({CASES}), b as (select ablation, count_if(correct) n from c group by 1), a as (select ablation, count_if(correct and latency_ms < 40) n from c group by 1) select ablation, b.n as before, a.n as now, a.n - b.n delta from a join b using (ablation)")
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    """AGG12."""
    cases = _cases(spark, d)
    return evaluate.snapshot_delta(cases, cases.withColumn("correct", F.col("correct") & (F.col("latency_ms") < 40)))


@query(
    f"with {SCORED}, r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, pos) r from sx), lv as (select doc_id, greatest(doc_id % 4, 1) lvl from documents) "
    "select doc_id, case when lvl >= 3 then 'short' else 'long' end as method, coalesce((select string_agg(sentence, ' ' order by pos) from r where r.doc_id = lv.doc_id and r <= case when lvl >= 3 then 1 else 3 end), '') summary from lv"
)
def summaries_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Each text by the summariser of its level (SUM2, WIN9)."""
    docs = table(spark, d, "documents").withColumn("level", F.col("doc_id") % 4)
    of = lambda n: lambda df, i, t: condense.extractive_summary(df, i, t, n)
    return condense.summarize(docs, "doc_id", "text", "level", {1: ("long", of(3)), 3: ("short", of(1))}).withColumnRenamed("id", "doc_id")


@query()
def conflict_recall(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as contexts with a question for each turn, all of them asked, under every configuration (EVL3)."""
    from memlayer.plans.harness import run_questions

    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    asked = F.transform("s", lambda t: t["text"])
    entries = convs.select(F.array_join(asked, "\n").alias("context"), asked.alias("questions"), F.transform(asked, lambda t: F.array(t)).alias("answers"))
    return evaluate.metrics(run_questions(entries), "ablation").select("ablation", "total", "correct", "accuracy")


@query()
def trained_head(spark: SparkSession, d: str) -> DataFrame:
    """A head trained on the vectors' labels, written, read and applied to all of them (CLS3)."""
    v = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("string"))
    kinds = v.where("label is not null").select("label").distinct()
    if kinds.limit(1001).count() > 1000:
        raise ValueError("more than 1000 labels")
    names = sorted(x.label for x in kinds.collect())
    path = _path(spark, "head")
    detect.write_head(spark, detect.train_head(v, "embedding", "label", names, steps=10), path)
    head = detect.read_head_file(spark, path)
    place = vectors.head_argmax("embedding", head["weights"], head["bias"])
    rows = v.select("label", F.get(F.array(*[F.lit(n) for n in names]), place).alias("predicted"))
    return detect.holdout_accuracy(rows, "predicted", "label")
