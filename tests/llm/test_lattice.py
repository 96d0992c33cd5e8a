import numpy as np

from memlayer.llm import lattice


def near(r, v, c):
    z = r.normal(size=len(v))
    z -= z @ v * v
    return c * v + np.sqrt(1 - c * c) * z / np.linalg.norm(z)


def brute(rows):
    """All pairs by cosine, then plain union-find."""
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root, links = {k: k for k in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(ok)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.sqrt(ok[a] @ ok[a]) * np.sqrt(ok[b] @ ok[b])) >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    low = {}
    for k in range(len(rows)):
        low[find(k)] = min(low.get(find(k), 1 << 60), rows[k][0])
    return [(rows[k][0], links[k], low[find(k)], rows[k][0] == low[find(k)]) for k in range(len(rows))]


def data(seed=0):
    r = np.random.default_rng(seed)
    rows, base = [], []
    for k in range(300):
        v = r.normal(size=64)
        v /= np.linalg.norm(v)
        if k % 3 == 0 and base:
            v = near(r, base[r.integers(len(base))], [0.96, 0.97, 0.99, 0.999][k % 4])
        base.append(v)
        rows.append((1000 - k, [float(np.float32(x)) for x in v]))
    hot = base[5]
    rows += [(2000 + k, [float(np.float32(x)) for x in near(r, hot, 0.985)]) for k in range(60)]
    rows += [(3000 + k, rows[7][1]) for k in range(20)]
    rows += [(4000, None), (4001, [0.0] * 64), (4002, [None] + [1.0] * 63), (4003, [float("nan")] * 64), (4004, []), (4005, [1.0, 2.0]), (4006, [1.0, 2.0]), (4007, [float("inf")] * 64), (4008, [1e30 * x for x in rows[7][1]]), (4009, [1.0])]
    return rows


def test_equals_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string").repartition(5)
    want = sorted(brute(rows))
    for block in (2048, 8):  # 8: cells count as hot
        assert sorted(tuple(x) for x in lattice.lattice_near_dedup(df, block=block).collect()) == want
    assert lattice.lattice_near_dedup(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    cases = [
        [(None, [1.0, 0.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01]), (None, [0.0, 1.0])],
        [(3, [1.0, 0.0]), (3, [1.0, 0.01])],
        [(3, [1.0, 0.0]), (3, [0.0, 1.0]), (7, [1.0, 0.01])],
        [(None, [1.0, 0.0]), (7, [1.0, 0.01])],
    ]
    want = [
        [("3", 2, 3, True), ("3", 2, 3, True), ("None", 0, None, False), ("None", 2, 3, False)],
        [("3", 1, 3, True), ("3", 1, 3, True)],
        [("3", 0, 3, True), ("3", 1, 3, True), ("7", 1, 3, False)],
        [("7", 1, 7, True), ("None", 1, 7, False)],
    ]
    for rows, expected in zip(cases, want, strict=True):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted(((str(x.vec_id), x.n_links, x.component_id, x.kept) for x in lattice.lattice_near_dedup(df).collect()), key=str)
        assert got == expected


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    for dim in (24, 64, 200):
        x = r.normal(size=(1500, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = np.array([near(r, v, 0.95) for v in x])
        for _, *settings in lattice.LEVELS:
            h = lattice.Hasher(dim, *settings)
            a, b = h.cells(x), h.cells(y)
            assert np.concatenate([a[:, :, :1] == b, a == b[:, :, :1]], axis=2).any(axis=(1, 2)).mean() > 0.995
            if dim == 64:
                z = np.roll(a, 1, 0)
                assert np.concatenate([a[:, :, :1] == z, a == z[:, :, :1]], axis=2).any(axis=(1, 2)).mean() < 0.005


def test_every_level_equals_brute_force(spark):
    rows = data(3)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string").repartition(5)
    want = sorted(brute(rows))
    for n in (100_000, 1_000_000, 1 << 40):
        assert sorted(tuple(x) for x in lattice.lattice_near_dedup(df, settings=lattice.settings_for(n)).collect()) == want


def test_a_full_block_of_near_vectors_is_compared_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    base = r.normal(size=64)
    base /= np.linalg.norm(base)
    n = lattice.BLOCK
    vectors = np.array([near(r, base, 0.9995) for _ in range(n)])
    settings = lattice.settings_for(n)
    cells = lattice.Hasher(64, *settings).cells(vectors)[:, 0, 0]
    group = {k: np.zeros(n, np.int64) for k in ("part", "t", "i", "j", "own")} | {"cell": np.full(n, cells[0]), "cid": np.arange(n), "home": np.ones(n, bool), "n": np.ones(n, np.int64)}
    tracemalloc.start()
    root, links = lattice._compare(group, vectors, 0.95, settings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all() and peak < 400 << 20


def test_decoding_finds_the_nearest_point():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 8)) * 2
    p = lattice.decode_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    others = ((x[:, None] - (p[:, None] + lattice.least_vectors())) ** 2).sum(axis=2).min(axis=1)
    assert (d <= others + 1e-9).all() and (d <= 1 + 1e-9).all()
    assert len(lattice.least_vectors()) == 240 and np.allclose((lattice.least_vectors() ** 2).sum(axis=1), 2)
