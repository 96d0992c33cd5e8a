import datetime as dt
import math
import random

from pyspark.sql import functions as F

from memlayer.functions import hashing, scoring, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokenisers(spark):
    assert value(spark, text.whitespace_tokens(F.lit("Hello, World!  foo-bar"))) == ["hello", "world", "foo", "bar"]
    assert value(spark, text.whitespace_tokens(F.lit(" 　\t"))) == []
    assert value(spark, text.script_tokens(F.lit("東京都へ行くRust2024カナé"))) == ["東京", "京都", "へ", "行", "く", "rust", "2024", "カナ"]
    assert value(spark, text.script_tokens(F.lit(""))) == []
    assert value(spark, text.sentences(F.lit("One. Two!  三。rest 3.14 ..."))) == ["One.", "Two!", "三。", "rest 3.", "14 .", ".", "."]


def plain_chunks(t, target):
    out = [""]
    for c in t:
        if out[-1] and len(out[-1].encode()) >= target and out[-1][-1] not in ".!?\n":
            out.append("")
        out[-1] += c
    return out if out != [""] else []


def test_byte_tails(spark):
    for s, n, want in (("aé東", 3, "東"), ("aé東", 4, "東"), ("aé東", 5, "é東"), ("ab", 9, "ab"), ("", 3, "")):
        assert value(spark, text.byte_tail(F.lit(s), n)) == want


def test_chunks():
    assert text.cut_chunks("aaaa. bbbb. cccc", 5) == ["aaaa. ", "bbbb. ", "cccc"]
    assert text.cut_chunks("abcdefghij", 3) == ["abc", "def", "ghi", "j"]
    r = random.Random(1)
    for _ in range(50):
        t = "".join(r.choices("ab é東.!\n", k=r.randrange(60)))
        assert "".join(text.cut_chunks(t, 7)) == t
        assert text.cut_chunks(t, 7) == plain_chunks(t, 7) and text.cut_chunks(t, 0) == plain_chunks(t, 0)


def test_hashes(spark):
    for w in ("", "a", "é", "東京", "longer text"):
        h = hashing.fnv1a_int(w.encode())
        assert value(spark, hashing.fnv1a_hex(F.lit(w))) == f"{h:016x}"
        assert value(spark, hashing.fnv1a_bucket(F.lit(w), 64)) == h % 64
        assert value(spark, hashing.fnv1a_bucket(F.lit(w), 100)) == h % 100
    assert value(spark, hashing.fnv1a_hex(F.lit("x"), 77)) == f"{hashing.fnv1a_int(b'x', 77):016x}"


def test_scores(spark):
    t = lambda d: F.lit(dt.datetime(2024, 1, d))
    assert abs(value(spark, scoring.temporal_decay(F.lit(1.0), t(1), t(8), 7 * 86400)) - 0.5) < 1e-9
    assert value(spark, scoring.temporal_decay(F.lit(2.0), t(9), t(8), 60)) == 2.0
    assert value(spark, scoring.order_decay(F.lit(1.0), F.lit(5), F.lit(3), 0.25)) == 0.5
    assert value(spark, scoring.order_decay(F.lit(1.0), F.lit(50), F.lit(3), 0.25)) == 0.0
    assert value(spark, scoring.order_decay(F.lit(None).cast("double"), F.lit(50), None, 0.25)) == 1.0
    near = lambda a, b, **k: value(spark, scoring.path_proximity(F.lit(a), F.lit(b), **k))
    assert near("src/a/x", "src/a/y") == 2 / 3 and near("a/b", "c/d") == 0 and near("/a/b", "/a/c") == 1.0 and near("/a//b", "/a//c") == 1.5
    assert near("/a/b", "/a/c", strict=True) == 0.5 and near("q", "q") == 1.0
    place = lambda kind, path, schema: F.struct(F.lit(kind).alias("kind"), F.lit(path).cast("string").alias("path"), F.lit(schema).cast("string").alias("schema"))
    prox = lambda a, b: value(spark, scoring.location_proximity(a, b))
    assert prox(place("custom", None, "s"), place("custom", None, "s")) == 1 and prox(place("custom", None, "s"), place("file", "a", None)) == 0
    assert value(spark, scoring.composite(F.lit(None), [])) == 0.0 and value(spark, scoring.composite(F.lit(0.3), [])) == 0.3
    assert value(spark, scoring.composite(F.lit(1.0), [(F.lit(1.0), 1), (F.lit(0.5), 3)])) == 0.625
    assert value(spark, scoring.composite(F.lit(1.0), [(F.lit(1.0), 0)])) == 0.0
    far = F.lit(None).cast("struct<kind:string,path:string,schema:string>")
    assert value(spark, scoring.file_proximity(F.lit(2.0), far, place("file", "a", None), 0.25)) == 1.5


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert abs(value(spark, vectors.cosine(v(1, 1), v(1, 0))) - math.sqrt(0.5)) < 1e-12
    assert value(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0 and value(spark, vectors.cosine(v(1), v(1, 0))) == 0
    assert value(spark, vectors.binarized(v(2, -3, 0))) == [1, -1, 0]
    p = value(spark, vectors.softmax(v(1000, 1000)))
    assert p == [0.5, 0.5]
    assert value(spark, vectors.mean_pooled(F.array(v(1, 2), v(3, 4), v(9, 9)), F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2, 3]
    assert value(spark, vectors.head_argmax(v(1, 0), [[0, 1], [1, 0], [1, 0]], [0, 0, 0])) == 1
    df = spark.createDataFrame([(1, "a A a"), (2, "...")], "id long, text string")
    out = {r.id: r.embedding for r in vectors.hash_embedding(df, "id", "text").collect()}
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-9 and out[2] == [0.0] * 64
    assert abs(out[1][hashing.fnv1a_int(b"a") % 64] - 2 / math.sqrt(5)) < 1e-9


def test_small_helpers(spark):
    assert value(spark, text.contains_any(F.lit("The KEY is here"), F.array(F.lit("x"), F.lit("key")))) and not value(spark, text.contains_any(F.lit("a"), F.array().cast("array<string>")))
    assert value(spark, text.fill("{text} | {label}", text=F.lit("a {label}"), label=F.lit("b"))) == "a b | b"
    assert value(spark, text.similarity_note("similarity", F.lit(0.12345))) == "similarity=0.123"
    assert value(spark, text.compression_ratio(F.lit(0), F.lit(5))) == 1.0
    assert value(spark, text.is_uuid(F.lit("550E8400-e29b-41d4-a716-446655440000"))) and not value(spark, text.is_uuid(F.lit("x")))
    assert value(spark, text.label_class(F.lit(" LITERAL "))) == "Literal" and value(spark, text.label_class(F.lit("?"))) == "Unknown"
    assert text.parse_names("a, ,b ") == ["a", "b"]
    assert value(spark, text.loose_string(F.parse_json(F.lit("3")))) == "3" and value(spark, text.loose_string(F.parse_json(F.lit('"x"')))) == "x"
