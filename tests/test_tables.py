import itertools
import random

import pytest
from pyspark.sql import functions as F

from memlayer.sources import store
from memlayer.streaming import turns

SCHEMA = "id string, n long, tags array<string>"


def contents(table):
    return {r.id: (r.n, r.tags) for r in table.read().collect()}


def test_changes_write_their_own_size_and_merge_when_read(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"), SCHEMA)
    assert contents(table) == {}
    table.save(spark.createDataFrame([(f"k{i}", i, ["a"]) for i in range(2000)], SCHEMA))
    before = {p: p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet")}
    table.save(spark.createDataFrame([("k7", 70, None), ("new", 1, []), ("k7", 69, ["x"])], SCHEMA), order="n")
    table.delete("k8")
    added = [p for p in (tmp_path / "t").rglob("*.parquet") if p not in before]
    assert len(added) == 3 and sum(p.stat().st_size for p in added) < sum(before.values())
    now = contents(table)
    assert len(now) == 2000 and now["k7"] == (70, None) and now["new"] == (1, []) and "k8" not in now
    assert table.load("k7")["n"] == 70
    for missing in (lambda: table.load("k8"), lambda: table.delete("k8"), lambda: table.load("nope")):
        with pytest.raises(store.NotFoundError):
            missing()
    plan = table._merged(table.commits.latest()[1]["parts"], table._only("k7"))._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket#") == 3  # one bucket of each part is read
    table.compact()
    assert len(table.commits.latest()[1]["parts"]) == 1 and contents(table) == now


def test_many_changes_compact_and_a_change_meanwhile_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHANGES", 3)
    table, want = store.Table(spark, str(tmp_path / "t"), SCHEMA), {}
    r = random.Random(2)
    for step in range(6):
        rows = {f"k{r.randrange(5)}": step for _ in range(2)}
        table.save(spark.createDataFrame([(k, v, None) for k, v in rows.items()], SCHEMA))
        want |= {k: (v, None) for k, v in rows.items()}
        if step == 3 and "k1" in want:
            table.delete("k1")
            del want["k1"]
        assert contents(table) == want and len(table.commits.latest()[1]["parts"]) <= 3
    monkeypatch.setattr(store, "CHANGES", 99)
    for n in (7, 8):
        table.save(spark.createDataFrame([("k9", n, None)], SCHEMA))
    want["k9"] = (8, None)
    other, write = store.Table(spark, str(tmp_path / "t"), SCHEMA), table._write

    def slow(rows):
        name = write(rows)
        other.save(spark.createDataFrame([("late", 1, None)], SCHEMA))
        return name

    monkeypatch.setattr(table, "_write", slow)
    table.compact()
    assert contents(other) == want | {"late": (1, None)}


def test_two_writers_lose_no_rows(spark, tmp_path):
    a, b = (store.Table(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    write = a._write

    def slow(rows):
        name = write(rows)
        b.save(spark.createDataFrame([("x", 2, None), ("y", 2, None)], SCHEMA))
        return name

    a._write = slow
    a.save(spark.createDataFrame([("x", 1, None), ("z", 1, None)], SCHEMA))
    assert contents(b) == {"x": (1, None), "y": (2, None), "z": (1, None)}


def test_facts_of_late_turns_end_as_the_batch_result(spark, tmp_path):
    turns.stateful(spark)
    r = random.Random(7)
    rows = [(i, 60 * r.randrange(400), i % 3, r.choice("abc")) for i in range(240)]
    want = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda x: (x[2], x[1], x[0])), key=lambda x: x[2]):
        value = event = None
        for i, _, _, kind in group:
            if kind != value:
                want[key, i] = (kind, event)
                value, event = kind, i
    for seed, parts in ((1, 4), (2, 2)):
        shuffled = random.Random(seed).sample(rows, len(rows))
        for n in range(parts):
            frame = spark.createDataFrame(shuffled[n::parts], "event_id long, s long, user_id long, event_type string")
            frame = frame.select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("").alias("props"))
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{seed}"))
        stream = turns.late_facts(turns.read_turns(spark, str(tmp_path / f"in{seed}")), "7 hours")
        name = f"late{seed}"
        stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{seed}")).trigger(availableNow=True).start().awaitTermination(120)
        got = {(x.key, x.event_id): (x.value, x.superseded) for x in turns.current_facts(spark.table(name)).collect()}
        assert got == want


def test_settled_facts_are_dropped_and_late_turns_ignored(spark, tmp_path):
    turns.stateful(spark)
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))

    def put(*events):
        for i, s, kind in events:
            spark.range(1).select(F.lit(i).cast("long").alias("event_id"), at(s).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit(kind).alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = turns.late_facts(turns.read_turns(spark, str(tmp_path / "in")), "1 minute")
            q = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        return {x.event_id: (x.value, x.superseded) for x in turns.current_facts(spark.read.schema(turns.FACT).parquet(str(tmp_path / "out"))).collect()}

    assert put((1, 0, "a"), (2, 30, "b")) == {1: ("a", None), 2: ("b", 1)}
    assert put((3, 10, "c")) == {1: ("a", None), 3: ("c", 1), 2: ("b", 3)}  # late, within the watermark
    assert put((4, 1000, "b"), (5, 20, "d")) == {1: ("a", None), 3: ("c", 1), 2: ("b", 3)}  # the last one came too late, and 4 repeats b
    assert put((6, 1010, "e"))[6] == ("e", 2)
