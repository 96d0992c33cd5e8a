"""Turns as a stream: stateless detection, windowed counts, upserts and index changes by micro-batch, and facts with supersession."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memlayer.operators.detect import detect_keywords
from memlayer.operators.postings import PostingIndex
from memlayer.sources.store import Table

TURN = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_turns(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detected(turns: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Keyword events of each turn's type and payload, with its time."""
    found = detect_keywords(turns.withColumn("_key", F.struct("event_id", "ts")), "_key", F.col("event_type"), F.col("props"), rules)
    return found.select(F.col("id.event_id").alias("event_id"), F.col("id.ts").alias("ts"), "ordinal", "label", "matched")


def label_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each label by window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "label", "n")


def session_counts(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns of each user's sessions."""
    return turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def upsert_stream(rows: DataFrame, table: Table, checkpoint: str, order: str | None = None, once: bool = True) -> StreamingQuery:
    """Upsert each micro-batch into an entity table, an id's last row by ``order``; a batch that is repeated changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        table.save(batch, order)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_facts(turns: DataFrame) -> DataFrame:
    """``(key, value, event_id, superseded)``: each user's last event type as a fact; a change supersedes the one before."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, event = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if row.event_type != value:
                out.append((key[0], row.event_type, int(row.event_id), event))
                value, event = row.event_type, int(row.event_id)
        state.update((value, event))
        yield pd.DataFrame(out, columns=["key", "value", "event_id", "superseded"]).astype({"superseded": "Int64"})

    return turns.groupBy("user_id").applyInPandasWithState(update, "key long, value string, event_id long, superseded long", "value string, event long", "append", GroupStateTimeout.NoTimeout)


def index_stream(rows: DataFrame, index: PostingIndex, name: str, id_col: str, text_col: str, checkpoint: str, order: str | None = None, merge_every: int = 16, once: bool = True) -> StreamingQuery:
    """Add, replace or (null text) delete documents of an index by micro-batch, one commit each.

    A batch that is repeated after a failure changes nothing: the index remembers the last one of the stream ``name``. After
    ``merge_every`` batches the generations are merged.
    """

    def write(batch: DataFrame, n: int) -> None:
        index.apply(batch, id_col, text_col, order, (name, n))
        if n % merge_every == merge_every - 1:
            index.merge()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def facts_of(last: tuple, events: list[tuple]) -> dict[int, tuple]:
    """``{event: (micros, value, superseded)}`` of ordered events ``(micros, event, value)`` that follow the fact ``last``."""
    value, event = last
    out = {}
    for micros, id_, new in events:
        if new != value:
            out[id_] = (micros, new, event)
            value, event = new, id_
    return out


class LateFacts(StatefulProcessor):
    """Keeps a key's events that can still be preceded, in order, and the last fact before them.

    Each input says at once which facts it adds, changes or takes back. Once the watermark has passed an event no other can
    come before it: a timer then drops it, and only the last fact stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a key: each call of the state server costs about as much as the rest of a key's work
        self.state = handle.getValueState("state", "value string, event long, changes long, micros array<long>, events array<long>, kinds array<string>")

    def _held(self) -> tuple[tuple, int, list[tuple]]:
        """The last settled fact, the number of changes, and the open events in order."""
        held = self.state.get()
        if held is None:
            return (None, None), 0, []
        value, event, changes, *columns = held
        return (value, event), changes, list(zip(*columns, strict=True))

    def _hold(self, last: tuple, changes: int, events: list[tuple]) -> None:
        self.state.update((*last, changes, *([e[i] for e in events] for i in range(3))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, changes, old = self._held()
        now = sorted({*old, *((x.micros, x.event_id, x.event_type) for x in rows if x.micros > 1000 * mark)})
        before, after = facts_of(last, old), facts_of(last, now)
        if now != old:
            self._hold(last, changes + 1, now)
            if not old or now[0][0] != old[0][0]:
                self.handle.registerTimer(now[0][0] // 1000 + 1)
        for e, x in after.items():
            if before.get(e) != x:
                yield Row(key=key[0], event_id=e, micros=x[0], value=x[1], superseded=x[2], active=True, change=changes + 1)
        for e, x in before.items():
            if e not in after:
                yield Row(key=key[0], event_id=e, micros=x[0], value=x[1], superseded=x[2], active=False, change=changes + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        (value, event), changes, events = self._held()
        past, rest = [x for x in events if x[0] <= 1000 * mark], [x for x in events if x[0] > 1000 * mark]
        for id_, (_, new, _) in facts_of((value, event), past).items():
            value, event = new, id_
        self._hold((value, event), changes, rest)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        yield from ()


FACT = "key long, event_id long, micros long, value string, superseded long, active boolean, change long"


def late_facts(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """As :func:`latest_facts` for turns in any order within the watermark: a stream of changes ``FACT`` that ends as the batch result.

    Changes of a fact are numbered; :func:`current_facts` takes the last of each. The session needs a state store with column
    families (:func:`stateful`).
    """
    keyed = turns.withWatermark("ts", late).select("user_id", "ts", "event_id", "event_type", F.unix_micros("ts").alias("micros"))
    return keyed.groupBy("user_id").transformWithState(statefulProcessor=LateFacts(), outputStructType=FACT, outputMode="Append", timeMode="EventTime")


def stateful(spark: SparkSession) -> None:
    """Choose the RocksDB state store for the streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def current_facts(changes: DataFrame) -> DataFrame:
    """``(key, value, event_id, superseded)`` after all changes."""
    last = changes.groupBy("key", "event_id").agg(F.max_by(F.struct("value", "superseded", "active"), "change").alias("f"))
    return last.where("f.active").select("key", "f.value", "event_id", "f.superseded")
