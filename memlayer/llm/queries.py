"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlayer.llm import dialogue, language, privacy, quality, url_filter
from memlayer.llm.common import table, training_row
from memlayer.llm.decontaminate import find_leaks
from memlayer.llm.html_text import extract_text
from memlayer.llm.lattice import lattice_near_dedup
from memlayer.llm.mixing import mix
from memlayer.llm.packing import pack_sequences
from memlayer.llm.simhash import simhash_near_dedup
from memlayer.llm.substrings import digest, remove_repeats
from memlayer.llm.whitening import whiten


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_near_dedup(table(spark, sf_dir, "embeddings"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~training_row("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def url_lists(pages: DataFrame) -> DataFrame:
    """A dated list made of all pages' hosts and first path segments, as the tables hold none.

    A host with smallest page id m is blocked from day 53m mod 300 of 2024 to 90 days later, and again from day 400 on.
    The first path segment of a host with smallest page id m is allowed from day 31m mod 250 to 120 days later.
    The domain of the last two labels is under review for the first 30 days.
    """
    url, start = F.col("url"), F.lit("2024-01-01").cast("date")
    rows = pages.select("page_id", url_filter.host_of(url).alias("host"), F.element_at(F.filter(F.split(url_filter.path_of(url), "/"), lambda p: p != ""), 1).alias("segment")).where("host is not null")
    day = lambda d: F.date_add(start, d.cast("int"))
    entry = lambda name, kind, pattern, action, at: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("at"))
    hosts = rows.groupBy("host").agg(F.min("page_id").alias("m"))
    began = F.col("m") * 53 % 300
    domain = F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2))
    of_host = hosts.select(F.explode(F.array(
        entry("block", "host", F.col("host"), "add", day(began)),
        entry("block", "host", F.col("host"), "remove", day(began + 90)),
        entry("block", "host", F.col("host"), "add", day(F.lit(400))),
        entry("review", "domain", domain, "add", day(F.lit(0))),
        entry("review", "domain", domain, "remove", day(F.lit(30))),
    )).alias("e"))
    first = F.col("m") * 31 % 250
    prefix = F.concat_ws("/", "host", "segment")
    of_path = rows.where("segment is not null").groupBy("host", "segment").agg(F.min("page_id").alias("m")).select(F.explode(F.array(entry("allow", "prefix", prefix, "add", day(first)), entry("allow", "prefix", prefix, "remove", day(first + 120)))).alias("e"))
    return of_host.union(of_path).select("e.*")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 500).cast("int")))
    return url_filter.filter_urls(captures, url_lists(pages))


OP7_SQL = """
with p as (
  select page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') parts,
         date '2024-01-01' + cast(page_id * 37 % 500 as int) fetched
  from pages),
h as (select host, min(page_id) m from p where host is not null group by 1),
f as (select host, parts[1] segment, min(page_id) m from p where host is not null and len(parts) >= 1 group by 1, 2),
spans as (
  select 'block' list, 'host' kind, host pattern, date '2024-01-01' + cast(m * 53 % 300 as int) a, date '2024-01-01' + cast(m * 53 % 300 + 90 as int) b from h
  union all select 'block', 'host', host, date '2024-01-01' + 400, null from h
  union all select distinct 'review', 'domain', array_to_string(string_split(host, '.')[-2:], '.'), date '2024-01-01', date '2024-01-01' + 30 from h
  union all select 'allow', 'prefix', host || '/' || segment, date '2024-01-01' + cast(m * 31 % 250 as int), date '2024-01-01' + cast(m * 31 % 250 + 120 as int) from f),
u as (select distinct url, fetched, host, parts, string_split(host, '.') labels from p where host is not null),
asked as (
  select url, fetched, 'host' kind, host pattern, 100 rank from u
  union all select url, fetched, 'domain', array_to_string(labels[-k:], '.'), k from (select *, unnest(range(1, len(labels) + 1)) k from u)
  union all select url, fetched, 'prefix', host || '/' || array_to_string(parts[1:k], '/'), 200 + k from (select *, unnest(range(1, len(parts) + 1)) k from u)),
active as (select asked.*, list, a from asked join spans using (kind, pattern) where fetched >= a and (b is null or fetched < b)),
best as (select *, count(*) over (partition by url, fetched) n, row_number() over (partition by url, fetched order by rank desc, a desc, list, pattern) r from active)
select page_id, p.url, p.fetched, coalesce(list, 'allow') verdict, kind, pattern, a active_from, coalesce(n, 0) n_active
from p left join best on p.url = best.url and p.fetched = best.fetched and r = 1
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = privacy.find_personal_data(docs, privacy.fit(spark, docs.where(training_row("doc_id"))))
    return found.select(
        "row.doc_id",
        *[privacy.count_of("base", k).alias(f"n_{k}") for k in privacy.KINDS],
        F.sha2(privacy.listed("base"), 256).alias("base_sha256"),
        privacy.listed("spans").alias("spans"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents")))

def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = dialogue.repair(dialogue.damage(turns))
    key = dialogue.conversation_key("conv_id")
    every = turns.groupBy(key.alias("conv")).agg(F.first("conv_id").alias("conv_id"))
    out = every.join(done.audits, "conv", "left").join(dialogue.digests(done.turns), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# the damage's CRC-32 bit by bit; turns as letters r (0 system, 1 user, 2 assistant, 3 other) and f (fault); bests by state (1 start,
# 2 after system, 3 after user, 4 after assistant) from the last turn to the first; then the replay of the initials
OP11_SQL = r"""
with m as (
  select conv_id, coalesce('=' || conv_id, '') conv, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ascii(c) as bigint))),
             lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 k
  from conversations),
x as (
  select conv, turn, case k when 4 then 'user' else role end role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
  from (select *, unnest(range(case k when 3 then 2 else 1 end)) from m where k <> 0)),
p as (
  select *, row_number() over (partition by conv order by turn nulls first, role, text) i,
         case left(role, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end r from x),
q as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by conv, role, text order by i) > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end f,
         lag(r) over (partition by conv order by i) b from p),
g as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(f = 1) blank, count_if(f = 2) duplicate, count_if(f = 3) truncated,
         count_if(b is not null and (b, r) not in ((0, 1), (1, 2), (2, 1))) illegal, list({'role': role, 'text': text, 'r': r} order by i) l,
         list({'r': r, 'f': f, 'b': cast([] as struct(c bigint, a varchar)[])} order by i desc) d
  from q group by conv),
h as (
  select *, list_reduce(list_prepend({'r': 0, 'f': 0, 'b': [{'c': cast(0 as bigint), 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}]}, d), lambda s, t: {'r': 0, 'f': 0, 'b':
    list_transform([list_transform([1, 2, 3, 4], lambda z: list_sort(list_filter([
      {'c': s.b[z].c + 2, 'a': 'D' || s.b[z].a},
      case when t.f not in (1, 2) and (t.r + 2 = [3, 3, 4, 3][z] or t.r = 0 and z = 1) then {'c': s.b[t.r + 2].c + case t.f when 3 then 5 else 0 end, 'a': 'K' || s.b[t.r + 2].a} end,
      case when t.f not in (1, 2) then {'c': s.b[[3, 3, 4, 3][z]].c + 1 + case t.f when 3 then 5 else 0 end, 'a': 'R' || s.b[[3, 3, 4, 3][z]].a} end], lambda o: o is not null))[1])],
    lambda e: list_transform([1, 2, 3, 4], lambda z: list_sort([e[z], {'c': e[[3, 3, 4, 3][z]].c + 5, 'a': 'I' || e[[3, 3, 4, 3][z]].a}, {'c': e[[4, 4, 3, 4][z]].c + 10, 'a': 'II' || e[[4, 4, 3, 4][z]].a}])[1]))[1]}).b[1] best
  from g),
w as (
  select *, list_reduce(list_prepend({'i': 0, 'z': 1, 'e': '', 'o': cast([] as varchar[])}, list_transform(list_filter(string_split(best.a, ''), lambda e: e <> ''), lambda e: {'i': 0, 'z': 0, 'e': e, 'o': cast([] as varchar[])})), lambda s, t: case t.e
    when 'I' then {'i': s.i, 'z': [3, 3, 4, 3][s.z], 'e': '', 'o': list_append(s.o, case [3, 3, 4, 3][s.z] when 3 then 'user:' else 'assistant:' end)}
    when 'K' then {'i': s.i + 1, 'z': l[s.i + 1].r + 2, 'e': '', 'o': list_append(s.o, l[s.i + 1].role || ':' || l[s.i + 1].text)}
    when 'R' then {'i': s.i + 1, 'z': [3, 3, 4, 3][s.z], 'e': '', 'o': list_append(s.o, case [3, 3, 4, 3][s.z] when 3 then 'user:' else 'assistant:' end || l[s.i + 1].text)}
    else {'i': s.i + 1, 'z': s.z, 'e': '', 'o': s.o} end).o out
  from h)
select c.conv_id, coalesce(gaps, 0) gaps, cast(coalesce(blank, 0) as bigint) blank, cast(coalesce(duplicate, 0) as bigint) duplicate, cast(coalesce(truncated, 0) as bigint) truncated, cast(coalesce(illegal, 0) as bigint) illegal,
       coalesce(best.c, 0) cost, coalesce(best.a, '') audit, sha256(coalesce(array_to_string(out, chr(10)), '')) repaired_sha256
from (select distinct conv_id, conv from m) c left join w using (conv)
"""

# the rate by rounds, then each source's walk in hash order, which takes what still fits
OP12_SQL = r"""
with recursive d as (
  select row_number() over () id, doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) h
  from documents),
s as (select source, cast(sum(size) as bigint) total, [5e0, 2e0, 1e0][1 + (row_number() over (order by source nulls last) - 1) % 3] weight from d group by source),
r as (
  select 1.5e0 * sum(total) / sum(weight) rate, cast(-1 as bigint) closed from s
  union all
  select (1.5e0 * (select sum(total) from s) - q.held) / q.rest, q.n from r, lateral (
    select coalesce(sum(2e0 * total) filter (weight * r.rate > 2e0 * total), 0) held, sum(weight) filter (weight * r.rate <= 2e0 * total) rest, count(*) filter (weight * r.rate > 2e0 * total) n from s) q
  where q.n <> r.closed and q.rest > 0),
t as (select source, total, least(weight * (select max(rate) from r), 2e0 * total) target from s),
u as (select *, case when total > 0 then cast(floor(target / total) as bigint) else 0 end whole from t),
w as (select *, cast(floor(target) as bigint) - whole * total budget from u),
k as (
  select w.source, unnest(list_reduce(list_prepend({'size': cast(0 as bigint), 'id': cast(0 as bigint), 'rest': any_value(budget), 'room': any_value(budget), 'done': false, 'kept': cast([] as bigint[])},
    list({'size': cast(size as bigint), 'id': id, 'rest': budget, 'room': budget, 'done': false, 'kept': cast([] as bigint[])} order by h)), lambda a, x: case
      when a.done or x.size = 0 or x.size > a.room then a
      when x.size <= a.rest then {'size': x.size, 'id': x.id, 'rest': a.rest - x.size, 'room': a.room, 'done': false, 'kept': list_append(a.kept, x.id)}
      else {'size': x.size, 'id': x.id, 'rest': a.rest, 'room': a.rest, 'done': a.rest * 10000 <= x.room, 'kept': a.kept} end).kept) id
  from d join w on d.source is not distinct from w.source group by w.source)
select doc_id, cast(size as bigint) size, total source_size, target, cast(size * (whole + case when k.id is null then 0 else 1 end) as bigint) taken
from d join w on d.source is not distinct from w.source left join k on k.id = d.id
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lattice": op1_lattice,
        "op2_html": op2_html,
        "op3_simhash": op3_simhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_language": op5_language,
        "op6_quality": op6_quality,
        "op7_url_filter": op7_url_filter,
        "op8_packing": op8_packing,
        "op9_privacy": op9_privacy,
        "op10_substrings": op10_substrings,
        "op11_dialogue": op11_dialogue,
        "op12_mixing": op12_mixing,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op11_dialogue": OP11_SQL, "op12_mixing": OP12_SQL}
