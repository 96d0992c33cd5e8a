"""Entity tables: upserts, point look-ups, deletes and listings over Parquet, and a client with one verb for each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from memlayer.functions.text import is_uuid
from memlayer.sources.commits import Commits
from memlayer.sources.schema import ENTITIES
from memlayer.sources.steps import discard, materialize


class NotFoundError(KeyError):
    """No row has the id."""


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their id (SRC3).

    Of several new rows of an id the one with the greatest ``order`` stays (ties, and without an order: the greatest row by its
    columns); ``order`` may be a column of ``new`` that ``old`` does not have.
    """
    columns = old.columns
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*columns)))
    last = new.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("r")).select("r.*")
    return old.join(last.select(key), key, "left_anti").select(*columns).unionByName(last.select(*columns))


def upsert_latest(old: DataFrame, new: DataFrame, version: str, key: str = "id") -> DataFrame:
    """As :func:`upsert` where a version column says which row of an id wins."""
    both = old.unionByName(new)
    row = F.max_by(F.struct(*both.columns), F.col(version))
    return both.groupBy(key).agg(row.alias("r")).select("r.*")


def without(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not listed (SRC5)."""
    return old.join(ids.select(key).distinct(), key, "left_anti")


def checked_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """The ids; a malformed one is an error (SRC7)."""
    bad = F.raise_error(F.concat(F.lit("malformed id: "), F.coalesce(F.col(key), F.lit("null"))))
    return df.select(F.when(is_uuid(F.coalesce(F.col(key), F.lit(""))), F.col(key)).otherwise(bad).alias(key))


#: Buckets of a table by the hash of the id, and changes after which a table is compacted.
BUCKETS, CHANGES = 16, 16


class Table:
    """One entity's rows in a directory, merged when read (SRC2-6).

    A change writes only its own rows, deletions as marks, in folders by bucket of the id with Bloom filters; a commit adds them to
    the table's state. Reading takes the last change of each id; a look-up reads one bucket. Commits are atomic, and
    of two writers at once the second commits on top of the first, so neither loses rows. After ``CHANGES`` changes the
    table is written anew; readers of older states are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, StructType.fromDDL(schema)
        self.commits = Commits(spark, path)

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_gone", BooleanType()), StructField("bucket", IntegerType())])

    @staticmethod
    def _bucket(id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names, "_gone", self._bucket(F.col("id")).alias("bucket")).repartition("bucket")
        dealt.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def _merged(self, parts: list[str], of: Column | None = None) -> DataFrame:
        """The living rows of a state, or those that ``of`` selects by id and bucket."""
        out = None
        for n, name in enumerate(parts):
            rows = self.spark.read.schema(self._stored()).parquet(f"{self.path}/{name}").withColumn("_n", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], self.schema)
        out = out if of is None else out.where(of)
        if len(parts) > 1:
            out = out.groupBy("id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("_n", "bucket")]), "_n").alias("r")).select("r.*")
        return out.where("not _gone").select(*self.schema.names)

    def _change(self, rows: DataFrame, check: Column | None = None, missing: str = "") -> None:
        written = []

        def add(state: dict) -> dict:
            parts = state.get("parts", [])
            if check is not None and self._merged(parts, check).isEmpty():
                raise NotFoundError(missing)
            if not written:
                written.append(self._write(rows))
            return {"parts": [*parts, written[0]]}

        self.commits.update(add)
        if len(self.commits.latest()[1]["parts"]) > CHANGES:
            self.compact()

    def compact(self) -> None:
        """Write the living rows as one part; a change that is committed meanwhile stays on top of it."""
        before = self.commits.latest()[1].get("parts", [])
        if len(before) < 2:
            return
        whole = self._write(self._merged(before).withColumn("_gone", F.lit(False)))
        self.commits.update(lambda state: {"parts": [whole, *state["parts"][len(before) :]]} if state.get("parts", [])[: len(before)] == before else None)

    def read(self) -> DataFrame:
        return self._merged(self.commits.latest()[1].get("parts", []))

    def save(self, rows: DataFrame, order: str | None = None) -> None:
        """Insert or replace; of several rows of an id the one with the greatest ``order`` stays, as :func:`upsert` says."""
        rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*self.schema.names)))
        last = rows.groupBy("id").agg(F.max_by(F.struct(*self.schema.names), rank).alias("r")).select("r.*")
        self._change(last.withColumn("_gone", F.lit(False)))

    def _only(self, id_: str) -> Column:
        return (F.col("bucket") == self._bucket(F.lit(id_))) & (F.col("id") == id_)

    def load(self, id_: str) -> dict:
        row = self._merged(self.commits.latest()[1].get("parts", []), self._only(id_)).first()
        if row is None:
            raise NotFoundError(id_)
        return row.asDict(recursive=True)

    def delete(self, id_: str) -> None:
        empty = [F.lit(id_).cast(f.dataType).alias(f.name) if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self._change(self.spark.range(1).select(*empty, F.lit(True).alias("_gone")), self._only(id_), id_)

    def list(self) -> DataFrame:
        return self.read().select("id")


class MemoryTable:
    """The same for one session (SRC1): each change is a table in the shared folder, so neither lineage nor cache grows."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self._df = spark, StructType.fromDDL(schema), spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._df

    def _write(self, df: DataFrame) -> None:
        before, self._df = self._df, materialize(df.select(*self.schema.names), "memory")
        discard(before)

    def save(self, rows: DataFrame, order: str | None = None) -> None:
        self._write(upsert(self.read(), rows.select(*self.schema.names, *([order] if order and order not in self.schema.names else [])), order=order))

    def load(self, id_: str) -> dict:
        row = self.read().where(F.col("id") == id_).first()
        if row is None:
            raise NotFoundError(id_)
        return row.asDict(recursive=True)

    def delete(self, id_: str) -> None:
        if self.read().where(F.col("id") == id_).isEmpty():
            raise NotFoundError(id_)
        self._write(self.read().where(F.col("id") != id_))

    def list(self) -> DataFrame:
        return self.read().select("id")


class Store:
    """Chunks, facts and pending items."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.tables = {n: MemoryTable(spark, s) if path is None else Table(spark, f"{path}/{n}", s) for n, s in ENTITIES.items()}

    def read(self, entity: str) -> DataFrame:
        return self.tables[entity].read()


class Client:
    """Thirteen verbs over a store: save, load, delete and list each entity, and compile a context (SNK5)."""

    def __init__(self, store: Store, **compile_options) -> None:
        self.store, self.compile_options = store, compile_options

    def _save(self, entity: str, row: dict) -> None:
        held = self.store.tables[entity]
        filled = {**dict.fromkeys(held.schema.names), "id": str(uuid.uuid4()), **row}
        held.save(self.store.spark.createDataFrame([filled], held.schema))

    def save_chunk(self, row: dict) -> None:
        self._save("chunk", {"items": [], "summary": "", "keywords": [], "facts": [], "pending": [], "children": [], "metadata": {}, "order_in_parent": 0, "summary_level": 0, "summary_method": "None", "edited_by_user": False, "auto_update_locked": False, **row})

    def load_chunk(self, id_: str) -> dict:
        return self.store.tables["chunk"].load(id_)

    def delete_chunk(self, id_: str) -> None:
        self.store.tables["chunk"].delete(id_)

    def list_chunks(self) -> list[str]:
        return [r.id for r in self.store.tables["chunk"].list().toLocalIterator()]

    def save_fact(self, row: dict) -> None:
        self._save("fact", {"scope": {"kind": "global", "chunk": None}, "origin": "User", **row})

    def load_fact(self, id_: str) -> dict:
        return self.store.tables["fact"].load(id_)

    def delete_fact(self, id_: str) -> None:
        self.store.tables["fact"].delete(id_)

    def list_facts(self) -> list[str]:
        return [r.id for r in self.store.tables["fact"].list().toLocalIterator()]

    def save_pending(self, row: dict) -> None:
        self._save("pending", {"priority": "Medium", **row})

    def load_pending(self, id_: str) -> dict:
        return self.store.tables["pending"].load(id_)

    def delete_pending(self, id_: str) -> None:
        self.store.tables["pending"].delete(id_)

    def list_pending(self) -> list[str]:
        return [r.id for r in self.store.tables["pending"].list().toLocalIterator()]

    def compile_context(self, query: str, current_chunk_id: str | None = None) -> dict:
        from memlayer.plans.context import compile_context

        return compile_context(self.store, query, current_chunk_id, **self.compile_options).collect()


def resolve(pending: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Set ``resolved_at`` from ``resolutions(id, chunk)`` (FLT3)."""
    both = pending.join(resolutions.select("id", F.col("chunk").alias("_chunk")), "id", "left")
    return both.withColumn("resolved_at", F.coalesce("_chunk", "resolved_at")).select(*pending.columns)


def active_facts(facts: DataFrame) -> DataFrame:
    """Facts without a successor, whatever their scope (FLT2, CTX3)."""
    return facts.where("superseded_by is null")
