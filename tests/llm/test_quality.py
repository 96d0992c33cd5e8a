import random

import numpy as np

from memlayer.llm import quality


def rows(seed, n=400):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        w = r.choices(words, k=r.randrange(5, 60))
        kind = i % 4
        if kind == 0:
            w = [x + "***" for x in w]
        if kind == 1:
            w = [x for x in w for _ in range(8)]
        out.append((i, " ".join(w), int(kind > 1)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (None, "abc", "x"), (1003, "z" * 100000, "x"), (1, data[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(2, None, 0), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = {}
    for x in quality.score(docs, model).collect():
        out.setdefault(x.doc_id, []).append(x.score)
    assert all(0 <= s <= 1 for v in out.values() for s in v) and len(out[1]) == 2 and out[1000] == out[1001] == out[1002] == [0.5]
    import zlib

    held = [(out[i][0] >= 0.7) == y for i, _, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    assert quality.score(docs.limit(0), model).count() == 0
    assert not quality.train(docs, labels.limit(0)).any()


def test_scores_equal_the_plain_model(spark):
    data = rows(2, 60)
    model = np.append(quality.fit([(t, y) for _, t, y in data]), 0.25)
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    for x in quality.score(df, model).collect():
        at, weight = quality.bag(data[x.doc_id][1])
        assert abs(x.score - 1 / (1 + np.exp(-(weight @ model[at] + 0.25)))) < 1e-9


def test_training_equals_the_plain_loop():
    """The same steps over dense vectors, one bucket after the other."""
    data = [(t, y) for _, t, y in rows(3, 12)]
    got = quality.fit(data, epochs=2, dim=3, seed=1)
    r = np.random.default_rng(1)
    n, dim = quality.BUCKETS + quality.PAIRS, 3
    vectors, out = r.uniform(-1 / dim, 1 / dim, (n, dim)), np.zeros((dim, 2))
    done, steps = 0, 2 * len(data)
    for _ in range(2):
        for k in r.permutation(len(data)):
            text, y = data[k]
            words = text.split()
            weight: dict[int, float] = {}
            for w in words:
                f = quality.features(w)
                for b in f:
                    weight[b] = weight.get(b, 0) + 1 / (2 * len(words) - 1) / len(f)
            for x, z in zip(words, words[1:]):
                for b in quality.pair_buckets(np.array([quality.names(x), quality.names(z)], np.uint64))[0].tolist():
                    weight[b] = weight.get(b, 0) + 0.5 / (2 * len(words) - 1)
            lr = quality.RATE * (1 - done / steps)
            hidden = sum(v * vectors[b] for b, v in weight.items())
            z = hidden @ out
            p = np.exp(z) / np.exp(z).sum()
            p[y] -= 1
            back = out @ p
            out = out - lr * 0.25 * np.outer(hidden, p)
            for b, v in weight.items():
                vectors[b] = vectors[b] - lr * np.sqrt(v) * back * 0.25
            done += 1
    assert np.allclose(got, vectors @ (out[:, 1] - out[:, 0]))


def test_the_sample_is_bounded_and_conflicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(40)] + [(3, "a"), (4, "b"), (5, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (3, 1, 0), (4, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    import zlib

    learn = {i for i in (1, 3, 4, 5) if zlib.crc32(str(i).encode()) % 4 != 2}
    got = [(x._id, x._y) for x in quality.sample(docs, labels, 2).collect()]
    assert got.count((1, 1)) == (2 if 1 in learn else 0) and all(i in learn and i != 3 for i, _ in got) and sum(y == 0 for _, y in got) <= 2


def test_calibration_has_the_fewest_errors():
    r = np.random.default_rng(0)
    for _ in range(50):
        y = r.integers(0, 2, 30)
        s = r.normal(size=30) + y
        shift = quality.calibrated(s, y)
        errors = lambda cut: ((s >= cut) != y).sum()
        if 0 < y.sum() < 30:
            assert errors(np.log(0.7 / 0.3) - shift) == min(errors(c) for c in np.sort(s)[1:])
