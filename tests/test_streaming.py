from memlayer.sources.store import Table
from memlayer.streaming import turns

D = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    for n, part in enumerate(events.orderBy("ts").randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, turns.read_turns(spark, str(tmp_path / "in"))


def test_detection_and_counts(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    rules = [("view", ["view"]), ("buy", ["purchase"])]
    found = drain(turns.detected(stream, rules), "found")
    assert found.count() == events.where("event_type like '%view%' or event_type like '%purchase%'").count()
    counts = drain(turns.label_counts(turns.detected(stream, rules), "1 hour", "400 days"), "counts", "complete")
    assert sum(x.n for x in counts.collect()) == found.count()


def test_upserts_and_facts(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    table = Table(spark, str(tmp_path / "t"), "id string, event_type string")
    turns.upsert_stream(stream.selectExpr("cast(user_id as string) id", "event_type"), table, str(tmp_path / "cp")).awaitTermination(180)
    assert table.read().count() == events.select("user_id").distinct().count()
    facts = drain(turns.latest_facts(stream), "facts").collect()
    assert {f.key for f in facts} == {x.user_id for x in events.select("user_id").distinct().collect()}
    assert all(f.superseded is not None for f in facts) is False
