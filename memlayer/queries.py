"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlayer.functions import hashing, scoring, text, vectors
from memlayer.operators import checks, condense, detect, evaluate, graph, nearest, postings, retrieval
from memlayer.plans import context
from memlayer.sources import datasets, store
from memlayer.sources.steps import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def fit(sql: str, *parts: object) -> str:
    for n, part in enumerate(parts):
        sql = sql.replace("{%d}" % n, str(part))
    return sql


# SQL parts
TOK = r"list_filter(string_split_regex(lower({0}), '[\x09-\x0d\x{85}\p{Z}[:punct:]]+'), lambda t: t <> '')"
RAW = r"list_filter(string_split_regex({0}, '[\x09-\x0d\x{85}\p{Z}[:punct:]]+'), lambda t: t <> '')"
SENT = r"list_filter(list_transform(regexp_extract_all({0}, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda s: regexp_replace(s, '^[\x09-\x0d\x{85}\p{Z}]+|[\x09-\x0d\x{85}\p{Z}]+$', '', 'g')), lambda s: s <> '')"
WORDS = r"list_filter(string_split_regex({0}, '[\x09-\x0d\x{85}\p{Z}]+'), lambda t: t <> '')"
# the low six bits of FNV-1a, and all 64 as an unsigned number
BUCKET = "list_reduce(list_prepend(37, list_transform(range(1, cast(octet_length(encode({0})) as bigint) + 1), lambda i: cast(('0x' || substr(hex(encode({0})), 2 * i - 1, 2)) as int))), lambda h, b: (xor(h, b) * 51) & 63)"
FNV = "list_reduce(list_prepend(cast({1} as hugeint), list_transform(range(1, cast(octet_length(encode({0})) as bigint) + 1), lambda i: cast(cast(('0x' || substr(hex(encode({0})), 2 * i - 1, 2)) as int) as hugeint))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
BM25 = f"""
tok as (select doc_id, {fit(TOK, "text")} t from documents),
post as (select doc_id, term, count(*) tf, any_value(dl) dl from (select doc_id, len(t) dl, unnest(t) term from tok) group by 1, 2),
freq as (select term, count(*) df from post group by 1),
corp as (select count(*) n, avg(len(t)) avgdl from tok),
qt as (select item_id, term, count(*) qf from (select item_id, unnest({fit(TOK, "text")}) term from {{0}}) group by 1, 2),
sc as (select item_id, doc_id, sum(qf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1)))) score
       from qt join freq using (term) join post using (term), corp group by 1, 2)"""


#: The rows a search takes as queries.
ASKED = "{0} % 50 = 0"


@query(f"with {fit(BM25, '(select * from benchmark where item_id % 50 = 0)')}, r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) r from sc) select item_id, doc_id, round(score, 6) score from r where r <= 8")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """From an index in a folder that was built, reopened and merged (RET1-3)."""
    index = _index(table(spark, d, "documents"))
    index.merge()
    asked = table(spark, d, "benchmark").where(fit(ASKED, "item_id"))
    return _ranked(postings.PostingIndex(spark, index.path).search(asked, "item_id", "text", 8)).drop("rank")


def _index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> postings.PostingIndex:
    path = f"{shared_dir(docs.sparkSession)}/memlayer/index-{uuid.uuid4().hex}"
    return postings.PostingIndex.build(docs, id_col, text_col, path)


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"with {fit(BM25, 'benchmark')}, r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) rank from sc) select item_id, doc_id, rank, round(score, 6) score from r where rank <= 10")
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_index(table(spark, d, "documents")).search(table(spark, d, "benchmark"), "item_id", "text", 10))


CHANGED = "documents as (select doc_id, case when doc_id % 5 = 1 then text || ' ' || lang || ' zebra' else text end as text from main.documents where doc_id % 7 <> 3)"


@query(f"with {CHANGED}, {fit(BM25, 'benchmark')}, r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) rank from sc) select item_id, doc_id, rank, round(score, 6) score from r where rank <= 10")
def bm25_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The index after additions, replacements and deletions in later commits: as one built anew from what is left (RET1-3)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    index = _index(docs.where("doc_id % 3 <> 0"))
    index.apply(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    new = docs.where("doc_id % 5 = 1").withColumn("text", F.concat("text", F.lit(" "), "lang", F.lit(" zebra")))
    gone = docs.where("doc_id % 7 = 3").withColumn("text", F.lit(None).cast("string"))
    index.apply(new.withColumn("n", F.lit(1)).union(gone.withColumn("n", F.lit(2))), "doc_id", "text", order="n")
    return _ranked(index.search(table(spark, d, "benchmark"), "item_id", "text", 10))


@query(f"select doc_id, cast(len(t) as bigint) n, cast(len(list_distinct(t)) as bigint) kinds from (select doc_id, {fit(TOK, 'text')} t from documents)")
def tokens_whitespace(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.whitespace_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query(r"select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\x{3040}-\x{309F}]+|[\x{30A0}-\x{30FF}]+|[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]+|[A-Za-z]+|[0-9]+'), lambda t: lower(t)), ' ') tokens from documents")
def tokens_cjk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.script_tokens("text"), " ").alias("tokens"))


@query(f"select term, count(distinct doc_id) df, count(*) tf from (select doc_id, unnest({fit(TOK, 'text')}) term from documents) group by 1")
def df_stats(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.build_index(table(spark, d, "documents"), "doc_id", "text")
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v, v.where(fit(ASKED, "vec_id")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


COS = "with s as (select q.vec_id query_id, v.vec_id, list_cosine_similarity({0}, {1}) score from embeddings v, embeddings q where q.vec_id % 50 = 0) select query_id, vec_id, round(score, 5) score from (select *, row_number() over (partition by query_id order by round(score, 5) desc, vec_id) r from s where score > 0) where r <= 5"


@query(fit(COS, "cast(v.embedding as double[])", "cast(q.embedding as double[])"))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return nearest.nearest(v, "vec_id", "embedding", q, "query_id", "q", 5, digits=5).select("query_id", F.col("id").alias("vec_id"), "score")


@query(fit(COS, "list_transform(v.embedding, lambda x: cast(sign(x) as double))", "list_transform(q.embedding, lambda x: cast(sign(x) as double))"))
def cosine_binarized(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    v, q = v.withColumn("embedding", vectors.binarized("embedding")), q.withColumn("q", vectors.binarized("q"))
    return nearest.nearest(v, "vec_id", "embedding", q, "query_id", "q", 5, digits=5).select("query_id", F.col("id").alias("vec_id"), "score")


HASHED = f"""tk as (select {{1}} id, unnest({fit(RAW, "text")}) token from {{0}}), tb as (select token, {fit(BUCKET, "token")} bucket from (select distinct token from tk)),
bc as (select id, bucket, count(*) n from tk join tb using (token) group by 1, 2), nm as (select id, sqrt(sum(n * n)) norm from bc group by 1), w as (select id, bucket, n / norm weight from bc join nm using (id))"""


@query(f"with {fit(HASHED, 'documents', 'doc_id')} select id doc_id, bucket, round(weight, 6) weight from w")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hash_weights(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "bucket", F.round("weight", 6).alias("weight"))


@query(
    f"with {fit(BM25, 'benchmark')}, {fit(HASHED, 'documents', 'doc_id')}, {fit(HASHED.replace('tk', 'qk').replace('tb as', 'qb as').replace('join tb', 'join qb').replace('bc', 'qc').replace('nm', 'qn').replace('w as', 'qw as'), 'benchmark', 'item_id')}, "
    "cs as (select qw.id item_id, w.id doc_id, sum(w.weight * qw.weight) score from w join qw using (bucket) group by 1, 2), "
    "k as (select * from (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) r from (select item_id, doc_id, score from sc)) where r <= 40), "
    "c as (select * from (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) r from cs) where r <= 40), "
    "u as (select item_id, doc_id, 0.5e0 * score / greatest(max(score) over (partition by item_id), 1e-6) s from k union all select item_id, doc_id, 0.5e0 * score / greatest(max(score) over (partition by item_id), 1e-6) from c), "
    "f as (select item_id, doc_id, sum(s) score from u group by 1, 2) "
    "select item_id, doc_id, round(score, 6) score from (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) r from f) where r <= 10"
)
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    keyword = _index(docs).search(items, "item_id", "text", 40)
    a, b = vectors.hash_embedding(docs, "doc_id", "text"), vectors.hash_embedding(items, "item_id", "text")
    cosine = nearest.nearest(a, "id", "embedding", b, "id", "embedding", 40, digits=9)
    return retrieval.fuse(keyword, cosine, k=10).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


NOW = "timestamp '2030-01-01 00:00:00'"


@query(f"select event_id, round(value * exp(-ln(2) * greatest(trunc(epoch_us({NOW} - ts) / 1e6), 0) / 31536000.0), 6) score from events")
def score_temporal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(scoring.temporal_decay("value", "ts", F.expr(f"cast({NOW} as timestamp)"), 31_536_000), 6).alias("score"))


@query("select conv_id, turn, round(greatest(0, 1 - 0.25e0 * abs(2 - turn)), 6) score from conversations")
def score_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(scoring.order_decay(F.lit(1.0), "turn", F.lit(2), 0.25), 6).alias("score"))


PATHS = "select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages"
PATH_SQL = """with p as ({0}), q as (select *, string_split(path, '/') x, string_split('/en/100', '/') y from p), e as (select *, list_filter(x, lambda c: c <> '') xs, ['en', '100'] ys from q),
n as (select *, len(list_filter(range(1, least(len({1}), len({2})) + 1), lambda i: {1}[1:i] = {2}[1:i])) shared from e)
select page_id, round(case when path = '/en/100' then 1.0e0 else shared / cast(greatest(len(xs), 2, 1) as double) end, 6) score from n"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query(fit(PATH_SQL, PATHS, "x", "y"))
def score_path(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", F.round(scoring.path_proximity("path", F.lit("/en/100")), 6).alias("score"))


@query(fit(PATH_SQL, PATHS, "xs", "ys"))
def score_path_strict(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", F.round(scoring.path_proximity("path", F.lit("/en/100"), strict=True), 6).alias("score"))


@query(f"with p as ({PATHS}) select page_id, cast(len(list_filter(string_split(path, '/'), lambda c: c <> '')) as int) depth from p")
def path_depth(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", text.path_depth("path").alias("depth"))


@query(f"select event_id, round((value + 2 * value * exp(-ln(2) * greatest(trunc(epoch_us({NOW} - ts) / 1e6), 0) / 31536000.0)) / 3, 6) score from events")
def score_composite(spark: SparkSession, d: str) -> DataFrame:
    decayed = scoring.temporal_decay("value", "ts", F.expr(f"cast({NOW} as timestamp)"), 31_536_000)
    return table(spark, d, "events").select("event_id", F.round(scoring.composite("value", [(scoring.no_decay("value"), 1), (decayed, 2)]), 6).alias("score"))


@query(
    f"with {fit(BM25, '(select * from benchmark where item_id = 1)')}, pool as (select doc_id, score from sc order by round(score, 9) desc, doc_id limit 32) "
    "select doc_id, round(score * greatest(0, 1 - 0.001e0 * abs(10 - doc_id % 100)), 6) score from pool where doc_id <> 10 order by round(pool.score * greatest(0, 1 - 0.001e0 * abs(10 - doc_id % 100)), 9) desc, pool.score desc, doc_id limit 8"
)
def compile_dynamic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("order_in_parent"))
    scored = retrieval.bm25_scores(retrieval.build_index(docs, "doc_id", "text"), table(spark, d, "benchmark").where("item_id = 1"), "item_id", "text")
    hits = scored.withColumn("k", F.round("score", 9)).orderBy(F.desc("k"), "id").limit(context.POOL).select("id", "score")
    out = context.dynamic_layer(hits, chunks, F.round(scoring.order_decay("hit_score", "order_in_parent", F.lit(10), 0.001), 9), F.lit(10))
    return out.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


TREE = "select 'r' || r_regionkey id, cast(null as varchar) parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"))
    return regions.union(nations).union(table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent")))


@query(f"with recursive t as ({TREE}), c as (select id start, id, parent, 0 depth from t where id like 'c%' union all select c.start, t.id, t.parent, c.depth + 1 from c join t on t.id = c.parent) select start, id, depth from c")
def resident_chain(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return graph.chain_fixed(tree, "id", "parent", tree.where("id like 'c%'").select("id"), 3)


FACTS = "select o_orderkey, o_custkey, o_totalprice, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) successor from orders"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lead("o_orderkey").over(order).alias("superseded_by"))


@query(f"with recursive f as ({FACTS}), c as (select o_orderkey id, successor ancestor, 1 depth from f where successor is not null union all select c.id, f.successor, c.depth + 1 from c join f on f.o_orderkey = c.ancestor where f.successor is not null) select * from c")
def supersession_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_facts(spark, d), "o_orderkey", "superseded_by")


@query(f"select o_orderkey, o_custkey, o_totalprice from ({FACTS}) where successor is null")
def active_facts(spark: SparkSession, d: str) -> DataFrame:
    return store.active_facts(_facts(spark, d)).drop("superseded_by")


@query("select a.conv_id * 1000 + a.turn id, b.conv_id * 1000 + b.turn ancestor from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn")
def happens_before_closure(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    edges = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.lead("turn").over(order)).alias("dst"))
    return graph.closure(edges, "src", "dst").select("id", "ancestor")


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) text from conversations group by 1")
def session_text(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))).alias("t"))
    return turns.select("conv_id", text.render_turns(F.col("t")).alias("text"))


@query("select conv_id, string_agg(case when role <> 'user' then text || chr(10) || chr(10) else '' end, '' order by turn) || '## Facts' || chr(10) || '- conv: ' || conv_id || chr(10) || chr(10) || '## Query' || chr(10) || min_by(text, turn) prompt from conversations group by conv_id")
def render_context(spark: SparkSession, d: str) -> DataFrame:
    resident = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text")))), lambda t: t["text"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(resident.alias("r"), F.min_by("text", "turn").alias("q"))
    facts = F.array(F.struct(F.lit("conv").alias("key"), F.col("conv_id").cast("string").alias("value")))
    return rows.select("conv_id", context.rendered(F.col("r"), facts, F.array().cast("array<string>"), F.col("q")).alias("prompt"))


@query(f"select doc_id, unnest(range(0, len(s))) pos, unnest(s) sentence from (select doc_id, {fit(SENT, 'text')} s from documents)")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


SCORED = f"""ss as (select doc_id, unnest(range(0, len(s))) pos, unnest(s) sentence from (select doc_id, {fit(SENT, "text")} s from documents)),
st as (select doc_id, pos, sentence, {fit(TOK, "sentence")} t from ss), sz as (select doc_id, count(*) n, avg(len(t)) avgdl from st group by 1),
tf as (select doc_id, pos, term, count(*) tf, any_value(dl) dl from (select doc_id, pos, len(t) dl, unnest(t) term from st) group by 1, 2, 3), td as (select *, count(*) over (partition by doc_id, term) df from tf),
ws as (select doc_id, pos, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1)))) score from td join sz using (doc_id) group by 1, 2),
sx as (select st.doc_id, st.pos, sentence, len(t) cost, coalesce(score, 0) score from st left join ws using (doc_id, pos))"""


@query(f"with {SCORED}, r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, pos) r from sx) select doc_id, coalesce((select string_agg(sentence, ' ' order by pos) from r where r.doc_id = documents.doc_id and r <= 3), '') summary from documents")
def summary_extractive(spark: SparkSession, d: str) -> DataFrame:
    return condense.extractive_summary(table(spark, d, "documents"), "doc_id", "text", 3).withColumnRenamed("id", "doc_id")


@query("select doc_id, case when greatest(doc_id % 7, 1) >= 5 then 'LlmFull' when greatest(doc_id % 7, 1) >= 3 then 'DistilBart' else 'ExtractiveBM25' end method_name from documents")
def summary_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", condense.dispatch(F.col("doc_id") % 7, {3: "DistilBart", 5: "LlmFull"}, "ExtractiveBM25").alias("method_name"))


@query("select doc_id, case when quality = 0 then 'SkippedLocked' when toxic = 1 and doc_id % 2 = 1 then 'SkippedUserEdited' else 'Applied' end outcome from labels")
def summary_protection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", condense.protection(F.col("quality") == 0, F.col("toxic") == 1, F.col("doc_id") % 2 == 0).alias("outcome"))


@query(f"select doc_id, case when len(w) <= 12 then text else array_to_string(w[1:8], ' ') || ' … ' || array_to_string(w[-4:], ' ') end compressed from (select doc_id, text, {fit(WORDS, 'text')} w from documents)")
def compress_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", condense.truncate("text", 12, 4).alias("compressed"))


@query(
    f"with {SCORED}, b as (select *, cost > 0 and sum(cost) over (partition by doc_id order by pos desc) <= 20 forced from sx), "
    "g as (select doc_id, sum(cost) total, greatest(60 - coalesce(sum(cost) filter (forced), 0), 0) room, list({'cost': cast(cost as bigint), 'used': cast(0 as bigint), 'done': false, 'kept': cast([] as bigint[]), 'pos': pos} order by round(score, 9) desc, pos) filter (not forced) l from b group by 1), "
    "h as (select doc_id, total, list_reduce(list_prepend({'cost': cast(0 as bigint), 'used': cast(0 as bigint), 'done': false, 'kept': cast([] as bigint[]), 'pos': cast(-1 as bigint)}, coalesce(l, [])), "
    "lambda s, x: case when not s.done and s.used + x.cost <= room then {'cost': x.cost, 'used': cast(s.used + x.cost as bigint), 'done': s.used + x.cost >= room, 'kept': list_append(s.kept, x.pos), 'pos': x.pos} else s end).kept kept from g), "
    "j as (select b.doc_id, string_agg(sentence, ' ' order by pos) out from b join h using (doc_id) where forced or list_contains(kept, pos) group by 1) "
    "select d.doc_id, case when h.doc_id is null then '' when total <= 60 then text else coalesce(out, '…') end compressed from documents d left join h using (doc_id) left join j using (doc_id)"
)
def compress_selective(spark: SparkSession, d: str) -> DataFrame:
    return condense.selective_context(table(spark, d, "documents"), "doc_id", "text", 60, 20).withColumnRenamed("id", "doc_id")


RULES = [("(?i)licen[sc]e", "Literal"), (r"\bthe\b.*\band\b", "Narrative"), ("[0-9]{4,}", "Analytical")]


@query(r"select doc_id, case when regexp_matches(text, '(?i)licen[sc]e') then 'Literal' when regexp_matches(text, '\bthe\b.*\band\b') then 'Narrative' when regexp_matches(text, '[0-9]{4,}') then 'Analytical' else 'Unknown' end class from documents")
def classify_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", detect.classify_regex("text", RULES).alias("class"))


HEAD = detect.read_head(json.dumps({"labels": ["literal", "narrative", "analytical"], "embedding_dim": 64, "weights": [[((i * k + k) % 7 - 3) / 4 for i in range(64)] for k in (3, 5, 11)], "bias": [0.0, 0.05, -0.05]}))


@query(
    "with h(k, bias, name, w) as (values " + ", ".join(f"({k}, {b}e0, '{n.title()}', {w})" for k, (n, b, w) in enumerate(zip(HEAD["labels"], HEAD["bias"], HEAD["weights"], strict=True))) + "), "
    "s as (select vec_id, name, k, list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * w[i])) + bias z from embeddings, h) select vec_id, arg_max(name, (round(z, 9), -k)) class from s group by 1"
)
def classify_linear(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", detect.classify_linear("embedding", HEAD).alias("class"))


KEYWORDS = [("commerce", ["purchase", "cart"]), ("visit", ["view", "click"]), ("payload", ['"k": 1', "{"])]
FLAT = ", ".join(f"({n}, '{label}', '{k}')" for n, (label, k) in enumerate((label, k) for label, ks in KEYWORDS for k in ks))


@query(f"select event_id, ordinal, label, matched from events, (values {FLAT}) r(ordinal, label, matched) where contains(concat_ws(' ', event_type, props), matched)")
def detect_keyword(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect_keywords(table(spark, d, "events"), "event_id", F.col("event_type"), F.col("props"), KEYWORDS).withColumnRenamed("id", "event_id")


SIMILAR = "select v.vec_id, r.label, list_cosine_similarity(cast(v.embedding as double[]), cast(r.embedding as double[])) s from embeddings v, (select 'ref' || vec_id as label, embedding from embeddings where vec_id % 50 = 0) r"


def _similar(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    references = v.where(fit(ASKED, "vec_id")).select(F.concat(F.lit("ref"), F.col("vec_id")).alias("label"), "embedding")
    return detect.detect_similar(v, "vec_id", "embedding", references, 0.25)


@query(f"select vec_id, label, round(s, 5) score from ({SIMILAR}) where s >= 0.25")
def detect_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select(F.col("id").alias("vec_id"), "label", F.round("score", 5).alias("score"))


@query("with a as (select event_id, 'rare' label, 0 stage from events where value > 90), b as (select event_id, event_type label, 1 stage from events where event_type in ('click', 'purchase')) select * from a union all select * from b where event_id not in (select event_id from a)")
def detect_cascade(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    first = events.where("value > 90").select(F.col("event_id").alias("id"), F.lit("rare").alias("label"), F.lit("").alias("matched"))
    second = events.where("event_type in ('click', 'purchase')").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.lit("").alias("matched"))
    return detect.cascade([first, second]).select(F.col("id").alias("event_id"), "label", "stage")


@query(f"select event_id, event_type, r sample_rank from (select *, row_number() over (partition by event_type order by h, event_id) r from (select event_id, event_type, {fit(FNV, 'cast(event_id as varchar)', evaluate.SAMPLE_SEED ^ hashing.BASIS)} h from events where event_type in ('click', 'purchase', 'view'))) where r <= 5")
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.stratified_sample(table(spark, d, "events"), "event_id", "event_type", 5, ("click", "purchase", "view"))
    return out.select("event_id", "event_type", F.col("sample_rank").cast("long").alias("sample_rank"))


@query(f"select item_id, lower(lpad(to_hex(cast({fit(FNV, 'text', hashing.BASIS)} as uhugeint)), 16, '0')) h from benchmark")
def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", hashing.fnv1a_hex("text").alias("h"))


@query()
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_documents(table(spark, d, "documents"), 512, "doc_id", "text").withColumnRenamed("id", "doc_id")


CASES = "select 'b' || (doc_id % 3) bench, 'tier-' || (doc_id % 2) ablation, cast(doc_id as varchar) case_id, quality = 1 correct, doc_id % 50 latency_ms from labels"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p, n: F.concat(F.lit(p), (F.col("doc_id") % n).cast("string"))
    return table(spark, d, "labels").select(part("b", 3).alias("bench"), part("tier-", 2).alias("ablation"), F.col("doc_id").cast("string").alias("case_id"), (F.col("quality") == 1).alias("correct"), (F.col("doc_id") % 50).alias("latency_ms"))


@query(f"select bench, ablation, count(*) total, count_if(correct) correct, round(avg(latency_ms), 6) mean_latency_ms, round(count_if(correct) / count(*), 6) accuracy from ({CASES}) group by 1, 2")
def recall_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.metrics(_cases(spark, d), "bench", "ablation")
    return out.select("bench", "ablation", "total", "correct", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("accuracy", 6).alias("accuracy"))


@query(f"select bench, ablation, count(*) total, count_if(correct) correct from ({CASES}) group by rollup (bench, ablation)")
def ablation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).rollup("bench", "ablation").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))


@query(f"with c as ({CASES}) select ablation, case_id from c where correct except all select ablation, case_id from c where correct and latency_ms < 40")
def snapshot_regressions(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return evaluate.regressions(cases, cases.withColumn("correct", F.col("correct") & (F.col("latency_ms") < 40)))


@query("with c as (select doc_id, doc_id % 3 lvl, case doc_id % 2 when 0 then 'None' else 'UserManual' end m, doc_id % 5 kids from documents) select doc_id, case when lvl = 0 and m <> 'None' then 'raw leaf (summary_level = 0) must have SummaryMethod::None' when lvl > 0 and kids = 0 then 'summary node (summary_level > 0) must have children' when lvl > 0 and m = 'None' then 'summary node must have a non-None SummaryMethod' end violation from c where violation is not null")
def validate_invariants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("summary_level"), F.when(F.col("doc_id") % 2 == 0, "None").otherwise("UserManual").alias("summary_method"), F.array_repeat(F.lit("x"), (F.col("doc_id") % 5).cast("int")).alias("children"))
    return rows.select("doc_id", checks.summary_violation().alias("violation")).where("violation is not null")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end status from orders union all select -o_orderkey - 1, 'N' from orders where o_orderkey % 3 = 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    third = old.where("o_orderkey % 3 = 0")
    return store.upsert(old, third.withColumn("status", F.lit("X")).union(third.select(-F.col("o_orderkey") - 1, F.lit("N"))), "o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def delete_antijoin(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.without(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("select doc_id, text, lang from documents where doc_id = 7")
def load_point(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "text", "lang")


@query("select doc_id from documents")
def list_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id")


@query("select vec_id, round(1 / list_sum(list_transform(embedding, lambda x: exp(cast(x as double) - list_max(cast(embedding as double[]))))), 6) top from embeddings")
def softmax_probs(spark: SparkSession, d: str) -> DataFrame:
    head = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(vectors.softmax(head)), 6).alias("top"))


@query("select item_id, doc_id from benchmark b join documents d on contains(lower(d.text), lower(b.text))")
def judge_substring(spark: SparkSession, d: str) -> DataFrame:
    """Which documents hold which benchmark passage: a stated set of passages against all documents."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return detect.contains_join(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "passage").select("item_id", "doc_id")


@query("select conv_id, turn, abs(turn - 2) distance, row_number() over (partition by conv_id order by abs(turn - 2), turn) rank from conversations")
def rank_neighbours(spark: SparkSession, d: str) -> DataFrame:
    distance = F.abs(F.col("turn") - 2)
    order = Window.partitionBy("conv_id").orderBy(distance, "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", distance.alias("distance"), F.row_number().over(order).cast("long").alias("rank"))


@query("select doc_id, array_to_string(list_sort(list_distinct([lang, source, 'en'])), ',') all_words, cast(lang = 'en' as int) shared from documents")
def keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    own = F.array("lang", "source")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_union(own, F.array(F.lit("en")))), ",").alias("all_words"), F.size(F.array_intersect(own, F.array(F.lit("en")))).alias("shared"))


@query("select event_id, json_extract_string(props, '$.k') k, event_type || ' ' || props whole from events")
def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), text.payload_text(F.col("event_type"), F.col("props")).alias("whole"))


@query()
def niah_recall(spark: SparkSession, d: str) -> DataFrame:
    """A needle set into every fiftieth document under every configuration: chunk, retrieve by the key, judge by the value (EVL1, EVL4)."""
    from memlayer.plans.harness import run_haystacks

    docs = table(spark, d, "documents").where(fit(ASKED, "doc_id")).where("text is not null")
    key, value = hashing.fnv1a_hex(F.concat(F.lit("key"), "doc_id")), hashing.fnv1a_hex(F.concat(F.lit("value"), "doc_id"))
    needle = text.fill(datasets.NEEDLE, key=key, value=value)
    half = (F.length("text") / 2).cast("int")
    hay = F.concat(F.substring("text", F.lit(1), half), F.lit(" "), needle, F.lit(" "), F.substring("text", half + 1, F.length("text")))
    cases = docs.select(F.col("doc_id").cast("string").alias("case_id"), hay.alias("haystack"), key.alias("needle_key"), value.alias("needle_value"))
    return evaluate.metrics(run_haystacks(cases), "ablation").select("ablation", "total", "correct", "accuracy")


@query(
    f"with ct as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) text from conversations group by 1), {fit(BM25, 'qs').replace('documents', 'dx').replace('tok as', 'qs as (select conv_id * 1000 + turn item_id, text from conversations where conv_id % 50 = 0), dx as (select conv_id doc_id, text from ct), tok as')}, "
    "r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) r from sc) "
    "select q.item_id case_id, coalesce(bool_or(contains(lower(ct.text), lower(q.text))), false) correct from qs q left join r on r.item_id = q.item_id and r.r <= 10 left join ct on ct.conv_id = r.doc_id group by 1"
)
def session_recall(spark: SparkSession, d: str) -> DataFrame:
    """Does retrieval by a whole turn find its conversation: every turn of each fiftieth one against all (EVL2, FLT8)."""
    from memlayer.plans.harness import run_sessions

    turns = table(spark, d, "conversations").where(fit(ASKED, "conv_id")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("text").alias("question"), F.array("text").alias("accepted"))
    chunks = session_text(spark, d).select(F.col("conv_id").alias("id"), "text")
    return run_sessions(turns, chunks).select("case_id", "correct")


@query(f"select doc_id, cast(len({fit(WORDS, 'text')}) as bigint) n from documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.words("text")).cast("long").alias("n"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) length from embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("length"))


@query(f"select doc_id, round(case when length(text) = 0 then 1.0e0 else length(case when len(w) <= 12 then text else array_to_string(w[1:8], ' ') || ' … ' || array_to_string(w[-4:], ' ') end) / cast(length(text) as double) end, 6) ratio from (select doc_id, text, {fit(WORDS, 'text')} w from documents)")
def compression_ratios(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(text.compression_ratio(F.length("text"), F.length(condense.truncate("text", 12, 4))), 6).alias("ratio"))


@query("with e as (select conv_id * 1000 + turn id, lead(conv_id * 1000 + turn) over (partition by conv_id order by turn) nxt from conversations), p as (select * from e where nxt is not null) select a.id, b.nxt ancestor from p a join p b on a.nxt = b.id")
def transitive_violations(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), F.lead(F.col("conv_id") * 1000 + F.col("turn")).over(order).alias("dst"))
    return checks.not_transitive(turns.where("dst is not null"), "src", "dst")


@query("select r_regionkey || '' parent, n_nationkey || '' child from region, nation where n_regionkey = r_regionkey and n_nationkey % 5 = 0")
def unmatched_links(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose region does not list them: every fifth is left out of the lists."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("p"))
    listed = nations.where("cast(id as int) % 5 <> 0").groupBy("p").agg(F.collect_list("id").alias("children"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("p")).join(listed, "p", "left")
    chunks = regions.select(F.col("p").alias("id"), F.lit(None).cast("string").alias("parent"), "children").union(nations.select("id", "p", F.array().cast("array<string>")))
    return checks.unmatched_links(chunks).select("parent", "child")
