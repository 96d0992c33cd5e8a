"""A BM25 index of document shards: postings in blocks with their greatest impact, incremental, searched with pruning.

A shard holds some thousand documents and the postings of their terms, formed in one task, so building shuffles nothing but
document frequencies. Shards never change: additions are new generations of shards, deletions are tombstones with the document
frequencies they take away, and a merge writes one generation from all. Counts of all parts add up, so scores are always those of
an index built anew from the living documents.

A search runs all queries of a batch over each shard within a task. Of a query's terms those with the greatest bounds are
summed whole; once the k-th best score exceeds what the other terms can give, these are looked up for the remaining
candidates only, block by block, and a candidate is dropped as soon as its blocks' bounds cannot lift it to the k-th score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from memlayer.functions.arrow import record_batch
from memlayer.functions.text import Tokenizer, whitespace_tokens
from memlayer.operators.retrieval import B, K1, top_k
from memlayer.sources.commits import Commits

#: Documents and tokens of a shard, postings of a block.
SHARD_DOCS, SHARD_TOKENS, BLOCK = 4096, 4_000_000, 64
#: Distinct terms of the queries of one pass, roughly; more queries take more passes.
PASS_TERMS = 200_000
HEADER, GONE, POSTING = range(3)


def _schema(id_type: DataType) -> StructType:
    """Headers: ``n`` documents, their ``ids`` and lengths (``docs``). Postings: ``n`` documents ``docs`` with ``tfs``, and by
    block the greatest tf and the least length."""
    ints = ArrayType(IntegerType())
    head = [("shard", StringType()), ("kind", IntegerType()), ("term", StringType()), ("n", LongType()), ("length", LongType()), ("ids", ArrayType(id_type))]
    return StructType([StructField(n, t) for n, t in head] + [StructField(n, ints) for n in ("docs", "tfs", "tops", "lows")])


def _posting(shard: str, term: str, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> tuple:
    starts = np.arange(0, len(docs), BLOCK)
    return shard, POSTING, term, len(docs), None, None, docs, tfs, np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[docs], starts)


def _shard_batches(shard: str, ids: list, tokens: pa.Array, lengths: np.ndarray, schema: StructType, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """A shard's header and its postings by term, from the tokens of its documents one after the other.

    Postings stay in flat arrays, cut into lists by offsets, ``size`` terms a batch; none becomes a Python object.
    """
    n = len(ids)
    head = record_batch([(shard, HEADER, None, n, int(lengths.sum()), ids, lengths, None, None, None)], schema)
    yield head
    if not len(tokens):
        return
    coded = tokens.dictionary_encode()
    sorted_ = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(sorted_), np.int64)
    rank[sorted_.to_numpy()] = np.arange(len(sorted_))
    terms = coded.dictionary.take(sorted_)
    cells, tfs = np.unique(rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    edges = np.searchsorted(cells, np.arange(len(terms) + 1, dtype=np.int64) * n)
    docs, tfs = (cells % n).astype(np.int32), tfs.astype(np.int32)
    counts = np.diff(edges)
    parts = np.append(0, np.cumsum(-(-counts // BLOCK)))
    starts = np.repeat(edges[:-1] - BLOCK * parts[:-1], np.diff(parts)) + BLOCK * np.arange(parts[-1])
    tops, lows = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[docs], starts)
    kinds = dict(zip(head.schema.names, head.schema.types, strict=True))

    def lists(name: str, values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        flat = pa.array(values[cuts[0] : cuts[-1]])
        return pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), flat).cast(kinds[name])

    for a in range(0, len(terms), size):
        b = min(a + size, len(terms))
        columns = {
            "shard": pa.repeat(shard, b - a),
            "kind": pa.array(np.full(b - a, POSTING, np.int32)),
            "term": terms.slice(a, b - a),
            "n": pa.array(counts[a:b].astype(np.int64)),
            "docs": lists("docs", docs, edges[a : b + 1]),
            "tfs": lists("tfs", tfs, edges[a : b + 1]),
            "tops": lists("tops", tops, parts[a : b + 1]),
            "lows": lists("lows", lows, parts[a : b + 1]),
        }
        yield pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(b - a, t) for c, t in kinds.items()], names=list(kinds))


def _batches(rows: Iterator[tuple], schema: StructType, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield record_batch(held, schema)
            held = []
    if held:
        yield record_batch(held, schema)


def sharded(docs: DataFrame, name: str, tokenizer: Tokenizer = whitespace_tokens, size: int = SHARD_DOCS) -> DataFrame:
    """``docs(id, text)`` -> shard rows; each partition cuts its documents into shards, whose names begin with ``name``."""
    rows = docs.select("id", tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
    schema = _schema(docs.schema["id"].dataType)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held = 0

        def shard() -> Iterator[pa.RecordBatch]:
            return _shard_batches(f"{name}.{task}.{count}", ids, pa.concat_arrays(tokens), np.concatenate(lengths).astype(np.int32), schema)

        for batch in batches:
            at = 0
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < len(batch):
                # as many documents as the shard still takes, one at least
                base = ends[at - 1] if at else 0
                room = int(np.searchsorted(ends, base + SHARD_TOKENS - held, "right")) - at
                take = max(1, min(size - len(ids), room, len(batch) - at))
                ids += batch.column(0).slice(at, take).to_pylist()
                tokens.append(batch.column(1).slice(at, take).flatten())
                lengths.append(sizes[at : at + take])
                held += int(ends[at + take - 1] - base)
                at += take
                if len(ids) >= size or held >= SHARD_TOKENS or at < len(batch):
                    yield from shard()
                    count, held, ids, tokens, lengths = count + 1, 0, [], [], []
        if ids:
            yield from shard()

    return rows.mapInArrow(shards, schema)


class _Terms:
    """A term's postings in a shard under a mean length: documents, weights, and the bounds of their blocks."""

    __slots__ = ("docs", "weights", "bounds", "top")

    def __init__(self, docs: np.ndarray, tfs: np.ndarray, tops: np.ndarray, lows: np.ndarray, lengths: np.ndarray, avgdl: float) -> None:
        weigh = lambda tf, dl: tf / (tf + K1 * (1 - B + B * dl / max(avgdl, 1.0)))
        self.docs, self.weights, self.bounds = docs, weigh(tfs, lengths[docs]), weigh(tops, lows)
        self.top = self.bounds.max()


def best_of_shard(terms: list[tuple[float, _Terms]], living: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``k`` best, with their exact scores, and how many postings were read.

    ``terms``: a factor and the postings of each. Scores within ``margin`` of the k-th best are kept.
    """
    terms = sorted(terms, key=lambda t: -t[0] * t[1].top)
    rest = np.append(np.cumsum([f * t.top for f, t in terms][::-1])[::-1], 0.0)
    scores = np.where(living, 0.0, -np.inf)
    least, read, n = 0.0, 0, len(scores)
    i = 0
    while i < len(terms) and (least == 0.0 or rest[i] + margin >= least):
        factor, t = terms[i]
        scores[t.docs] += factor * t.weights
        read += len(t.docs)
        if n >= k:
            least = max(least, float(np.partition(scores, n - k)[n - k]))
        i += 1
    chosen = np.flatnonzero((scores > 0) & (scores >= least - rest[i] - margin))
    for j in range(i, len(terms)):
        factor, t = terms[j]
        at = np.searchsorted(t.docs, chosen)
        block = np.minimum(at // BLOCK, len(t.bounds) - 1)
        able = scores[chosen] + factor * t.bounds[block] + rest[j + 1] >= least - margin
        chosen, at, block = chosen[able], at[able], block[able]
        read += min(len(t.docs), BLOCK * len(np.unique(block)))
        inside = np.minimum(at, len(t.docs) - 1)
        hit = t.docs[inside] == chosen
        scores[chosen[hit]] += factor * t.weights[inside[hit]]
        if len(chosen) >= k:
            least = max(least, float(np.partition(scores[chosen], len(chosen) - k)[len(chosen) - k]))
    chosen = chosen[scores[chosen] >= least - margin]
    return chosen, scores[chosen], read


class PostingIndex:
    """An index in a folder. ``id_type`` is taken from the first documents."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = whitespace_tokens, size: int = SHARD_DOCS) -> None:
        self.spark, self.path, self.tokenizer, self.size = spark, path.rstrip("/"), tokenizer, size
        self.commits = Commits(spark, path)

    @staticmethod
    def build(docs: DataFrame, id_col: str, text_col: str, path: str, tokenizer: Tokenizer = whitespace_tokens, size: int = SHARD_DOCS) -> PostingIndex:
        """A new index of all ``docs``, ids as they are (they should be distinct)."""
        index = PostingIndex(docs.sparkSession, path, tokenizer, size)
        index.commits.update(lambda state: {"generations": [*state.get("generations", []), index._generation(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))], "gone": state.get("gone", []), "batches": state.get("batches", {})})
        return index

    def _generation(self, docs: DataFrame) -> dict:
        name = f"gen-{uuid.uuid4().hex}"
        return self._written(name, sharded(docs, name, self.tokenizer, self.size))

    def _written(self, name: str, rows: DataFrame) -> dict:
        rows.write.parquet(f"{self.path}/{name}/postings")
        postings = self.spark.read.parquet(f"{self.path}/{name}/postings")
        postings.where(F.col("kind") == POSTING).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{self.path}/{name}/terms")
        n, length = postings.where(F.col("kind") == HEADER).agg(F.sum("n"), F.sum("length")).first()
        return {"name": name, "n": n or 0, "length": length or 0}

    def _read(self, state: dict, table: str, of: str = "generations") -> DataFrame | None:
        paths = [f"{self.path}/{g['name']}/{table}" for g in state.get(of, [])]
        return self.spark.read.parquet(*paths) if paths else None

    def corpus(self, state: dict | None = None) -> tuple[int, int]:
        """The number of living documents and the sum of their lengths."""
        state = self.commits.latest()[1] if state is None else state
        parts = [*state.get("generations", []), *state.get("gone", [])]
        return sum(g["n"] for g in parts), sum(g["length"] for g in parts)

    def frequencies(self, state: dict | None = None) -> DataFrame:
        """``(term, df)`` of the living documents."""
        state = self.commits.latest()[1] if state is None else state
        parts = [t for t in (self._read(state, "terms"), self._read(state, "terms", "gone")) if t is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def documents(self, state: dict | None = None) -> DataFrame:
        """``(id, shard, at, dl)`` of the living documents."""
        state = self.commits.latest()[1] if state is None else state
        heads = self._read(state, "postings").where(F.col("kind") == HEADER)
        docs = heads.select("shard", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("docs").alias("dl"))).alias("at", "d")).select("d.id", "shard", "at", "d.dl")
        gone = self._read(state, "docs", "gone")
        return docs if gone is None else docs.join(gone, ["shard", "at"], "left_anti").select("id", "shard", "at", "dl")

    def apply(self, changes: DataFrame, id_col: str, text_col: str, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Add, replace or (null text) delete documents in one commit; returns the version.

        Of several rows of an id the last by ``order`` counts; without an order ids have to be distinct. ``batch`` names a stream
        and its micro-batch: one that was committed before changes nothing. Written is what changes: new shards, places of
        replaced documents, and the document frequencies these take away (their shards are read for that).
        """
        rows = changes.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(order).alias("_o")] if order else []))
        if order:
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_o")))).where("_r = 1").select("id", "text")
        rows = rows.persist()

        def change(state: dict) -> dict | None:
            batches = dict(state.get("batches", {}))
            if batch and batches.get(batch[0], -1) >= batch[1]:
                return None
            if batch:
                batches[batch[0]] = batch[1]
            gone = list(state.get("gone", []))
            if state.get("generations"):
                name = f"gone-{uuid.uuid4().hex}"
                self.documents(state).join(rows.select("id"), "id", "left_semi").select("shard", "at", "dl").write.parquet(f"{self.path}/{name}/docs")
                old = self.spark.read.parquet(f"{self.path}/{name}/docs")
                n, length = old.agg(F.count(F.lit(1)), F.sum("dl")).first()
                if n:
                    postings = self._read(state, "postings").where(F.col("kind") == POSTING).join(F.broadcast(old.select("shard").distinct()), "shard")
                    lost = postings.select("shard", "term", F.explode("docs").alias("at")).join(old, ["shard", "at"]).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
                    lost.write.parquet(f"{self.path}/{name}/terms")
                    gone.append({"name": name, "n": -n, "length": -length})
            return {"generations": [*state.get("generations", []), self._generation(rows.where("text is not null"))], "gone": gone, "batches": batches}

        try:
            return self.commits.update(change)
        finally:
            rows.unpersist()

    def _parts(self, state: dict, postings: DataFrame) -> DataFrame:
        """Shard rows with the places of deleted documents between headers and postings."""
        gone = self._read(state, "docs", "gone")
        if gone is None:
            return postings
        places = gone.groupBy("shard").agg(F.collect_list("at").alias("docs")).select("shard", F.lit(GONE).alias("kind"), "docs")
        return postings.unionByName(places, allowMissingColumns=True)

    def merge(self) -> int:
        """Write all living documents as one generation of full shards and commit it; readers of older versions are not disturbed."""

        def change(state: dict) -> dict | None:
            if len(state.get("generations", [])) <= 1 and not state.get("gone"):
                return None
            groups = max(1, -(-self.corpus(state)[0] // self.size))
            postings = self._read(state, "postings")
            name, schema = f"gen-{uuid.uuid4().hex}", postings.schema
            parts = self._parts(state, postings).withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
            columns = ["group", *schema.names]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return _batches(_merged(batches, name), schema)

            dealt = parts.select(columns).repartition(groups, "group").sortWithinPartitions("group", "kind", "term", "shard")
            return {"generations": [self._written(name, dealt.mapInArrow(run, schema))], "gone": [], "batches": state.get("batches", {})}

        return self.commits.update(change)

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, digits: int = 9, counts: tuple[Accumulator, Accumulator] | None = None, pass_terms: int = PASS_TERMS) -> DataFrame:
        """``(query_id, id, score, rank)``: the ``k`` best documents of each query (RET3), scores rounded to ``digits``, ties by id.

        ``counts`` add up the postings read and those of all query terms. The queries are read when this is called, in passes of
        bounded size over the index; repeated query tokens count each time.
        """
        state = self.commits.latest()[1]
        n, length = self.corpus(state)
        tokens = queries.select(F.col(query_id).alias("q"), self.tokenizer(F.coalesce(F.col(query_text), F.lit(""))).alias("t"))
        out = None
        schema = None
        if n:
            postings = self._read(state, "postings")
            schema = StructType([StructField("query_id", queries.schema[query_id].dataType), StructField("id", postings.schema["ids"].dataType.elementType)]).add("score", "double")
            held: list = []
            terms: set[str] = set()
            for row in tokens.toLocalIterator(prefetchPartitions=True):
                if row.t:
                    held.append((row.q, Counter(row.t)))
                    terms |= set(row.t)
                if len(terms) >= pass_terms:
                    part = self._pass(state, postings, held, terms, k, digits, n, length / n, schema, counts)
                    out, held, terms = part if out is None else out.union(part), [], set()
            if held:
                part = self._pass(state, postings, held, terms, k, digits, n, length / n, schema, counts)
                out = part if out is None else out.union(part)
        if out is None:
            out = queries.select(F.col(query_id).alias("query_id"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score")).where("false")
        return top_k(out, k)

    def _pass(self, state: dict, postings: DataFrame, queries: list, terms: set, k: int, digits: int, n: int, avgdl: float, schema: StructType, counts) -> DataFrame:
        asked = F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string"))
        found = {r.term: r.df for r in self.frequencies(state).join(asked, "term").collect()}  # at most the terms of one pass
        idf = {t: float(np.log((n - df + 0.5) / (df + 0.5) + 1)) * (K1 + 1) for t, df in found.items()}
        weighed = [(q, [(t, qf * idf[t]) for t, qf in c.items() if t in idf]) for q, c in queries]
        shared = self.spark.sparkContext.broadcast(weighed)
        parts = self._parts(state, postings.where(F.col("kind") == HEADER).unionByName(postings.where(F.col("kind") == POSTING).join(asked, "term", "left_semi").select(postings.columns)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches):
                found = list(_best(shard, shared.value, avgdl, k, digits, counts))
                if found:
                    yield record_batch(found, schema)

        return parts.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, dict]]:
    """Whole shards from their sorted rows: ids, lengths, who lives, and the postings by term."""
    ints = lambda c, i: c[i].values.to_numpy()
    now, ids, lengths, living, terms = None, [], np.zeros(0), np.zeros(0, bool), {}
    for batch in batches:
        c = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i, (shard, kind, term) in enumerate(zip(c["shard"].to_pylist(), c["kind"].to_pylist(), c["term"].to_pylist(), strict=True)):
            if kind == HEADER:
                if now is not None:
                    yield ids, lengths, living, terms
                now, ids, lengths, terms = shard, c["ids"][i].as_py(), ints(c["docs"], i), {}
                living = np.ones(len(ids), bool)
            elif kind == GONE:
                if shard == now:
                    living[ints(c["docs"], i)] = False
            else:
                terms[term] = tuple(ints(c[x], i) for x in ("docs", "tfs", "tops", "lows"))
    if now is not None:
        yield ids, lengths, living, terms


def _best(shard: tuple, queries: list, avgdl: float, k: int, digits: int, counts) -> Iterator[tuple]:
    ids, lengths, living, postings = shard
    ready = {t: _Terms(*p, lengths, avgdl) for t, p in postings.items()}
    margin = 0.51 * 10.0**-digits + 1e-9
    for query, terms in queries:
        mine = [(f, ready[t]) for t, f in terms if t in ready]
        if not mine:
            continue
        chosen, scores, read = best_of_shard(mine, living, k, margin)
        if counts:
            counts[0].add(read)
            counts[1].add(sum(len(t.docs) for _, t in mine))
        ranked = sorted((-round(s, digits), ids[d] is not None, ids[d]) for d, s in zip(chosen.tolist(), scores.tolist(), strict=True))
        yield from ((query, i, -s) for s, _, i in ranked[:k])


def _merged(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple]:
    """Rows sorted by group, kind, term and shard -> rows of one new shard for each group, without deleted documents."""
    group, heads, gone = None, [], {}
    places: dict[str, dict[int, int]] = {}
    lengths: list[int] = []
    term, docs, tfs = None, [], []

    def header() -> Iterator[tuple]:
        ids: list = []
        for shard, some, dl in heads:
            lost = gone.get(shard, ())
            places[shard] = {}
            for at, (id_, n) in enumerate(zip(some, dl, strict=True)):
                if at not in lost:
                    places[shard][at] = len(ids)
                    ids.append(id_)
                    lengths.append(n)
        if ids:
            yield f"{name}.{group}", HEADER, None, len(ids), sum(lengths), ids, list(lengths), None, None, None

    def posting() -> Iterator[tuple]:
        if docs:
            order = np.argsort(docs)
            yield _posting(f"{name}.{group}", term, np.array(docs, np.int32)[order], np.array(tfs, np.int32)[order], np.array(lengths, np.int32))

    for batch in batches:
        for row in batch.to_pylist():
            if row["group"] != group:
                yield from posting()
                if group is not None and heads and not places:
                    yield from header()
                group, heads, gone, term, docs, tfs = row["group"], [], {}, None, [], []
                places.clear()
                lengths.clear()
            if row["kind"] == HEADER:
                heads.append((row["shard"], row["ids"], row["docs"]))
            elif row["kind"] == GONE:
                gone[row["shard"]] = set(row["docs"])
            else:
                if not places:
                    yield from header()
                if row["term"] != term:
                    yield from posting()
                    term, docs, tfs = row["term"], [], []
                where = places[row["shard"]]
                for d, tf in zip(row["docs"], row["tfs"], strict=True):
                    if d in where:
                        docs.append(where[d])
                        tfs.append(tf)
    yield from posting()
    if group is not None and heads and not places:
        yield from header()
