import random
import re

import numpy as np
import xxhash

from memlayer.llm import simhash
from memlayer.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node string"


def brute(rows):
    """Every fingerprint against every other, then plain union-find."""
    fps = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        bits = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), seed=42)
            for i in range(64):
                bits[i] += h >> i & 1
        fps[doc_id] = sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def texts(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            t = (r.choice(rows)[1] or "x").split(" ")
            t[r.randrange(len(t))] = r.choice(words)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(r.choices(words, k=r.choice([1, 2, 30, 400])))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\x0b\n"), (n + 3, "ÉÀ  B c"), (n + 4, rows[3][1]), (n + 5, rows[3][1].upper()), (n + 6, "long " * 70000)]


def test_equals_brute_force(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows], SCHEMA)
    want = brute(rows)
    for block in (4096, 2):  # 2: every bucket counts as hot
        monkeypatch.setattr(simhash.near_links, "__defaults__", (3, block))
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_near_dedup(df).collect()}
        assert got == want


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks()]
    r = random.Random(0)
    for _ in range(2000):
        diff = sum(1 << i for i in r.sample(range(64), 3))
        assert any(diff & m == 0 for m in masks)


def test_empty_and_null_ids(spark):
    assert simhash.simhash_near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "only here")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in simhash.simhash_near_dedup(df).collect()), key=str)
    assert got == [("5", 5, True), ("5", 5, True), ("None", 5, False), ("None", None, False)]


def test_components_of_long_chains(spark):
    r = np.random.default_rng(3)
    ids = r.permutation(300)
    edges = [(int(a), int(b)) for a, b in zip(ids[:199], ids[1:200], strict=True)] + [(int(ids[250]), int(ids[251])), (4, 4), (None, 3)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[int(i)] for i in ids[:200]} == {int(ids[:200].min())}
    assert got[int(ids[250])] == int(min(ids[250], ids[251])) and len(got) == 202
