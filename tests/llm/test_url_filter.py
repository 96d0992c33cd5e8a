import datetime as dt
import random

from memlayer.llm import url_filter as u

DAY = dt.date(2024, 1, 1)


def brute(captures, entries):
    """Every entry replayed for every capture."""
    out = []
    for pid, url, day in captures:
        state = {}
        for at, action, lst, kind, pattern in sorted((e[4], 0 if e[3] == "remove" else 1, *e[:3]) for e in entries if None not in e and e[3] in ("add", "remove")):
            if day is not None and at <= day:
                key = (lst, kind, pattern)
                if action:
                    state.setdefault(key, at)
                elif not any(e[:3] == key and e[4] == at and e[3] == "add" for e in entries):
                    state.pop(key, None)
        host = (url or "").split("/")[2].lower() if "://" in (url or "") else None
        path = [p for p in (url or "").split("?")[0].split("/")[3:] if p]
        best = None
        n = 0
        for (lst, kind, pattern), since in state.items():
            labels = host.split(".") if host else []
            rank = None
            if host and kind == "host" and pattern == host:
                rank = 100
            if host and kind == "domain" and pattern in [".".join(labels[-k:]) for k in range(2, len(labels) + 1)]:
                rank = pattern.count(".") + 1
            if host and kind == "prefix":
                for k in range(1, len(path) + 1):
                    if pattern == host + "/" + "/".join(path[:k]):
                        rank = 200 + k
            if rank is not None:
                n += 1
                key = (-rank, -since.toordinal(), lst, pattern)
                if best is None or key < best[0]:
                    best = (key, lst, kind, pattern, since)
        out.append((pid, url, day, best[1] if best else "allow", *(best[2:] if best else (None,) * 3), n))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "x.y.example.org", "example.com", "h.net"]
    urls = [f"http://{r.choice([h, h.upper()])}{r.choice(['', '/', '/p', '/p/q?z=1', '/r/s/t'])}" for h in hosts for _ in range(5)] + ["/relative", "", None, "mailto:x@y", "http:///nohost"]
    captures = [(i, r.choice(urls), DAY + dt.timedelta(r.randrange(100)) if r.random() < 0.95 else None) for i in range(300)]
    captures += captures[:5] + [(None, urls[0], DAY)]
    entries = []
    for _ in range(250):
        h = r.choice(hosts)
        kind, pattern = r.choice([("host", h), ("domain", ".".join(h.split(".")[-2:])), ("domain", h), ("prefix", h + "/p"), ("prefix", h + "/p/q"), ("prefix", h + "/r")])
        entries.append((r.choice(["block", "allow", "ads"]), kind, pattern, r.choice(["add", "add", "remove"]), DAY + dt.timedelta(r.randrange(-20, 110))))
    entries += [(None, "host", "h.net", "add", DAY), ("x", "host", None, "add", DAY), ("x", "host", "h.net", "other", DAY), ("x", "host", "h.net", "add", None), entries[0]]
    c = spark.createDataFrame([(*x, "v") for x in captures], "page_id long, url string, fetched date, verdict string")
    e = spark.createDataFrame([(*x, "v") for x in entries], "list string, kind string, pattern string, action string, at date, bucket string")
    got = sorted((tuple(x) for x in u.filter_urls(c, e).collect()), key=str)
    assert got == brute(captures, entries)
    assert u.filter_urls(c.limit(0), e).count() == 0
    assert {x.verdict for x in u.filter_urls(c, e.limit(0)).collect()} == {"allow"}


def test_long_prefix_and_any_domain_length(spark):
    path = "/".join("abcdefghi")
    deep = ".".join(["l"] * 13)
    entries = [("p", "prefix", f"h.net/{path}", "add", DAY), ("one", "domain", "internal", "add", DAY), ("deep", "domain", deep, "add", DAY)]
    captures = [(1, f"http://h.net/{path}/j", DAY), (2, "http://wiki.internal/", DAY), (3, "http://internal/x", DAY), (4, f"http://www.{deep}/", DAY), (5, "http://h.net/a", DAY)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at date")
    assert {x.page_id: x.verdict for x in u.filter_urls(c, e).collect()} == {1: "p", 2: "one", 3: "one", 4: "deep", 5: "allow"}
