import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from memlayer.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(totals):
    """Shares again and again what lies above a ceiling, as the rule is stated."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    aim, open_, left = {}, set(names), 1.5 * sum(totals.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * rate > 2 * totals[s]]
        if not over:
            return aim | {s: weight[s] * rate for s in open_}
        for s in over:
            aim[s] = 2.0 * totals[s]
            left -= aim[s]
        open_ -= set(over)
    return aim


def plain_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    totals = {}
    for (_, _, s), n in zip(rows, size, strict=True):
        totals[s] = totals.get(s, 0) + n
    aim, out = plain_targets(totals), []
    for source in totals:
        whole = int(aim[source] // totals[source]) if totals[source] else 0
        budget = int(aim[source]) - whole * totals[source]
        mine = [(int(hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15], 16), d, n) for (d, t, s), n in zip(rows, size, strict=True) if s == source]
        rest = room = budget
        done = False
        for _, d, n in sorted(mine, key=lambda x: x[0]):
            take = False
            if not done and 0 < n <= room:
                if n <= rest:
                    rest, take = rest - n, True
                else:
                    room, done = rest, rest * mixing.NEAR <= budget
            out.append((d, n, totals[source], round(aim[source], 6), n * (whole + take)))
    return out


def test_mix_equals_the_walk_in_hash_order(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 2, 5, 40, 200]))), rng.choice([None, "a", "a", "a", "b", "c", "d", "ä"])) for i in range(400)]
    rows += [(400 + i, None, "a") for i in range(3)] + [(None, "\x85 no\xa0break \t\n", "e"), (500, "one two", "f")]
    got = [(x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(plain_mix(rows), key=repr)


def test_taken_words_come_near_targets_whatever_the_layout(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, "w " * rng.randint(1, 300), f"s{min(i % 9, 3)}") for i in range(3000)], SCHEMA)
    once = mixing.mix(rows)
    again = mixing.mix(rows.orderBy(F.rand(1)).repartition(5))
    assert sorted(once.collect()) == sorted(again.collect())
    sums = once.join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("aim"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    for x in sums.collect():
        assert x.aim - x.t <= max(1.0, 0.001 * x.aim) and x.t <= x.aim and x.over <= 0


def test_equal_rows_share_a_threshold(spark):
    rows = [(None, "one two three", "a")] * 100 + [(i, "w " * 400, "b") for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    mine = [x for x in got if x.source_size == 300]
    assert len(mine) == 100 and mine[0].target == 600 and all(x.taken == 6 for x in mine)
    one = mixing.mix(spark.createDataFrame([(1, "w", "b")] * 7 + [(2, "w", "a")] * 7, SCHEMA), share=1.1).collect()
    assert sum(x.taken for x in one if x.doc_id == 1) == 4 and {x.taken for x in one if x.doc_id == 1} == {0, 1}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " \n", "b")]])
def test_no_words(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("size", F.lit("x"))).collect()
    assert [(x["size"], x.source_size, x.target, x.taken) for x in got] == [(0, 0, 0.0, 0)] * len(rows)


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LISTED_SOURCES", 2)
    rows = [(i, "w " * (1 + i % 7), f"s{i % 11}") for i in range(200)]
    got = [(x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(plain_mix(rows))
