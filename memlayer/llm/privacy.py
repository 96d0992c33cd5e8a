"""Personal data by gradient boosting over candidate spans, in DataFrame functions only.

Generators propose spans by pattern. Those of the four base patterns that pass their format test always
stay. Wider patterns (spelt-out addresses, bracketed dots, short and long IPv6, national numbers, any card grouping) propose
more, over each other and with little regard for what they hit; boosted trees over format and context features score these, and a
threshold for each kind, calibrated to a precision, selects what is added.

The trees learn from the documents themselves: the surroundings of base matches, where the match is spelt in another way
(personal data), and surroundings without any, where look-alikes are set in (dates, versions, times, failed checksums) or the wide
patterns hit by themselves (none). Half of the documents grow the trees, the other half calibrates. What passes the driver is
bounded: ``WINDOWS`` short windows of text. The features come from the same expressions as those that score, and the trees are
applied as CASE expressions.
"""

from __future__ import annotations

import json
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlayer.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")

# Each base pattern finds the same matches as the plain form beside it, without its backtracking: a match can
# start only where a run starts or the last match ended, and repeats are possessive (what follows cannot match).
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      card [0-9]([\x20-]?[0-9])+
#   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)                       phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of 12 to 19 digits; shorter and longer runs fail and never overlap others
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this holds no base match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

_AT = r"(?:\x20?[(\[{<]\x20?(?:[Aa][Tt]|@)\x20?[)\]}>]\x20?|\x20[Aa][Tt]\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[(\[{<]\x20?(?:[Dd][Oo][Tt]|\.)\x20?[)\]}>]\x20?|\x20[Dd][Oo][Tt]\x20|\.)"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?[(\[{](?:[Dd][Oo][Tt]|\.)[)\]}]\x20?[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._/-])[0-9]{4}(?:(?:[._/\x20-]{1,3}[0-9]{4}){2}[._/\x20-]{1,3}[0-9]{1,7}|[._/\x20-]{1,3}[0-9]{6}[._/\x20-]{1,3}[0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+._/-])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z_/-])",
}
#: A text without a match of this holds no wide match of the kind: each is a part of its pattern.
WIDE_NEEDS = {
    "email": rf"{_AT}[A-Za-z0-9-]{{1,63}}+{_DOT}[A-Za-z0-9-]",
    "ip": r"[0-9]\x20?[(\[{](?:[Dd][Oo][Tt]|\.)[)\]}]|:[0-9A-Fa-f]{1,4}:",
    "card": r"[0-9]{4}[._/\x20-]{1,3}[0-9]{4}",
    "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{2,5}[\x20./-]{1,2}[0-9]{2}",
}

#: Words near a span that speak for a kind, or against any. Fixed values.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|send|reply)\b",
    "ip": r"(?i)\b(?:ip|ipv6|address|host|server|login|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment|pay|charge)\b",
    "phone": r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|dial|text|whatsapp|ring)\b",
}
AGAINST = r"(?i)\b(?:order|part|serial|version|isbn|doi|invoice|model|ref|reference|id|ticket|tracking|item|sku|build|section|chapter|meet|look|arrive)\b"
FEATURES = ("size", "digits", "separators", "brackets", "for", "against", "luhn", "letters", "ending", "joined", "low", "groups", "head", "tail", "date", "colons")
CONTEXT = 32
#: Windows of the documents' text that the trees learn from, at most, and documents that are looked at for them.
WINDOWS, LOOKED_AT = 1200, 2000


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(items: Column, kind: str, state: dict[str, Column], step) -> Column:
    """A left fold that builds an array of ``kind``: ``step(state, x)`` gives the next state and an array to add.

    Arrays grow in blocks of 512, so the work stays linear in the items.
    """
    blocks = _let(items, lambda xs: F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / 512).cast("int")), lambda k: F.slice(xs, k * 512 + 1, F.lit(512)))))
    fields = lambda s: [s[n].alias(n) for n in state]

    def one(s: Column, x: Column) -> Column:
        now, out = step(s, x)
        return F.struct(*[now[n].alias(n) for n in state], F.concat(s["out"], out).alias("out"))

    def block(s: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(*fields(s), F.array().cast(f"array<{kind}>").alias("out")), one)
        return _let(inner, lambda i: F.struct(*fields(i), F.concat(s["out"], F.array(i["out"])).alias("out")))

    start = F.struct(*[c.alias(n) for n, c in state.items()], F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, block, lambda s: s["out"]))


def _prefixes(segments: Column, hits: Column) -> Column:
    """(start, end, hit) of each hit, in code points, by running sums."""
    pairs = F.zip_with(F.slice(segments, 1, F.size(hits)), hits, lambda s, h: F.struct(F.length(s).alias("gap"), h.alias("hit")))

    def step(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = state["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return {"at": end}, F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))

    return _fold(pairs, "struct<start:int,end:int,hit:string>", {"at": F.lit(0)}, step)


def _apart(spans: Column, base: Column) -> Column:
    """The spans (start, end, hit) that overlap none of ``base``, by a sweep from either side."""
    kind = "struct<at:int,end:int,hit:string>"
    mine = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), s["end"].alias("end"), s["hit"].alias("hit")))
    other = F.transform(base, lambda b: F.struct(b["start"].alias("at"), b["end"].alias("end"), F.lit(None).cast("string").alias("hit")))
    none = F.array().cast(f"array<{kind}>")

    def right(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["hit"].isNull()
        return {"reach": F.when(is_base, F.greatest(s["reach"], x["end"])).otherwise(s["reach"])}, F.when(is_base | (x["at"] >= s["reach"]), F.array(x)).otherwise(none)

    def left(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["hit"].isNull()
        return {"next": F.when(is_base, x["at"]).otherwise(s["next"])}, F.when(~is_base & (x["end"] <= s["next"]), F.array(x)).otherwise(none)

    rising = _fold(F.sort_array(F.concat(other, mine)), kind, {"reach": F.lit(0)}, right)
    kept = F.reverse(_fold(F.reverse(rising), kind, {"next": F.lit(2**31 - 1)}, left))
    named = F.transform(kept, lambda s: F.struct(s["at"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))
    return F.when(F.size(base) > 0, named).otherwise(spans)


def _find(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """What lies between matches and the matches, computed only where the text can hold one."""
    can = text.rlike(needs)
    return F.when(can, F.split(text, pattern, -1)), F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _base(df: DataFrame) -> DataFrame:
    """``_t`` -> ``_base``: array of (start, kind, end), kind by its place in KINDS, sorted."""
    df = df.select("*", *[c.alias(f"_{x}_{k}") for k in KINDS for x, c in zip("sh", _find(F.col("_t"), BASE[k], NEEDS[k]), strict=True)])

    def spans(n: int, k: str) -> Column:
        hits = F.when(F.size(f"_h_{k}") > 0, _prefixes(F.col(f"_s_{k}"), F.col(f"_h_{k}")))
        return F.transform(F.filter(hits, lambda s: _valid(k, s["hit"])), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    found = [spans(n, k) for n, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    df = df.withColumn("_base", F.sort_array(F.concat(*[F.coalesce(f, none) for f in found])))
    return df.drop(*[f"_{x}_{k}" for k in KINDS for x in "sh"])


def _candidates(df: DataFrame) -> DataFrame:
    """``_t, _base`` -> ``_wide``: array of wider proposals with features, none overlapping a base span."""
    df = df.select("*", *[c.alias(f"_{x}_{k}") for k in KINDS for x, c in zip("sh", _find(F.col("_t"), WIDE[k], WIDE_NEEDS[k]), strict=True)])

    def proposals(n: int, k: str) -> Column:
        spans = F.when(F.size(f"_h_{k}") > 0, _prefixes(F.col(f"_s_{k}"), F.col(f"_h_{k}")))
        free = F.when(F.size(f"_h_{k}") > 0, _apart(spans, F.col("_base")))
        return F.coalesce(F.transform(free, lambda s: _features(F.col("_t"), s, n, k)), F.array().cast(_wide_type()))

    df = df.withColumn("_wide", F.concat(*[proposals(n, k) for n, k in enumerate(KINDS)]))
    return df.drop(*[f"_{x}_{k}" for k in KINDS for x in "sh"])


def _wide_type() -> str:
    return "array<struct<start:int,kind:int,end:int," + ",".join(f"`{f}`:int" for f in FEATURES) + ">>"


def _features(text: Column, s: Column, n: int, kind: str) -> Column:
    hit = s["hit"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    around = F.struct(
        F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))).alias("before"),
        F.substring(text, s["end"] + 1, F.lit(CONTEXT)).alias("after"),
    )
    count = lambda pattern: F.length(F.regexp_replace(hit, pattern, ""))
    values = lambda before, after: {
        "size": F.length(hit),
        "digits": F.length(digits),
        "separators": count(r"[^\x20._/:-]"),
        "brackets": count(r"[^()\[\]{}]"),
        "for": (before.rlike(FOR[kind]) | after.rlike(FOR[kind])).cast("int"),
        "against": before.rlike(AGAINST).cast("int"),
        "luhn": F.coalesce(F.call_function("luhn_check", F.when(digits == "", "1").otherwise(digits)), F.lit(False)).cast("int"),
        "letters": count("[^A-Za-z]"),
        "ending": hit.rlike(r"(?i)(?:com|net|org|edu|gov|io|info|de|fr|es|uk|eu)$").cast("int"),
        "joined": (before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")).cast("int"),
        "low": (F.lower(hit) == hit).cast("int"),
        "groups": F.size(F.regexp_extract_all(hit, F.lit("[0-9A-Za-z]+"), F.lit(0))),
        "head": F.length(F.regexp_extract(hit, "[0-9A-Za-z]+", 0)),
        "tail": F.length(F.regexp_extract(hit, "([0-9A-Za-z]+)[^0-9A-Za-z]*$", 1)),
        "date": hit.rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)").cast("int"),
        "colons": count("[^:]"),
    }

    def row(w: Column) -> Column:
        found = values(w["before"], w["after"])
        return F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), *[found[f].cast("int").alias(f) for f in FEATURES])

    return _let(around, row)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = WINDOWS) -> list[tuple[int, int | None, str, str, str]]:
    """(part, kind, before, hit, after): surroundings of base matches, and of places without any (kind None).

    From at most ``LOOKED_AT`` documents, chosen by a hash; part 0 grows trees, part 1 calibrates.
    """
    hashed = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(23)), F.lit(1 << 30))
    # a share of the ids that holds enough documents is cut out first, so no more than that is ever sorted
    share = min(1.0, 2 * LOOKED_AT / max(docs.count(), 1))
    rows = docs.where(hashed < int(share * (1 << 30)) + 1).select(hashed.alias("_h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    rows = rows.where("length(_t) > 0").orderBy("_h", "_t").limit(LOOKED_AT)
    place = F.struct(F.lit(None).cast("int").alias("kind"), F.lit(CONTEXT).alias("start"), F.lit(CONTEXT).alias("end"))
    found = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    each = _base(rows).select("_h", "_t", F.explode(F.when(F.size("_base") > 0, F.slice(found, 1, 8)).otherwise(F.array(place))).alias("s"))
    before = F.substring("_t", F.greatest(F.col("s.start") - CONTEXT, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(CONTEXT)))
    cut = each.select("_h", "s.kind", "s.start", before.alias("before"), F.substring("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("hit"), F.substring("_t", F.col("s.end") + 1, F.lit(CONTEXT)).alias("after"))
    cut = materialize(cut, "windows")
    of_kind = [cut.where("kind is null").orderBy("_h", "start").limit(most // 2), *[cut.where(F.col("kind") == n).orderBy("_h", "start").limit(most // 8) for n in range(len(KINDS))]]
    return [(x._h % 2, x.kind, x.before, x.hit, x.after) for x in sorted(reduce(DataFrame.union, of_kind).collect(), key=lambda x: (x._h, x.start))]


def respelt(r: random.Random, kind: int, hit: str) -> str:
    """A base match written in a way that only the wide patterns know."""
    digits = [c for c in hit if c.isdigit()]
    num = "".join(digits)
    if kind == 0:
        local, _, host = hit.partition("@")
        at = r.choice([" at ", " (at) ", "[at]", " AT ", " {at} ", "@"])
        dot = r.choice([" dot ", "(dot)", "[.]", " DOT ", " [dot] "] + ["."] * (2 if at != "@" else 0))
        return local + at + host.replace(".", dot)
    if kind == 1:
        if r.random() < 0.5:
            return hit.replace(".", r.choice(["[.]", "(dot)", " [dot] ", "{.}"]))
        groups = [f"{r.randrange(1, 65536):x}" for _ in range(8)]
        k, n = r.randrange(1, 4), r.randrange(2, 5)
        return ":".join(groups) if r.random() < 0.5 else ":".join(groups[:k]) + "::" + ":".join(groups[k : k + n])
    if kind == 2:
        cuts = [4, 10] if len(num) == 15 else [4, 8, 12]
        return r.choice([".", "_", "/", " - ", "  ", " . "]).join(num[a:b] for a, b in zip([0, *cuts], [*cuts, len(num)], strict=True) if num[a:b])
    own = (num + num)[-10:]
    form = r.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "0044 {0} {1} {2}", "{0}/{1}-{2}", "{a} {b} {c} {d} {e}"])
    return form.format(own[:3], own[3:6], own[6:], **{k: own[2 * i : 2 * i + 2] for i, k in enumerate("abcde")})


def look_alike(r: random.Random, kind: int) -> str:
    """A string that a wide pattern hits and that is nobody's data."""
    num = lambda k: "".join(r.choices("0123456789", k=k))
    name = lambda: "".join(r.choices("abcdefghijklmnoprstu", k=r.randrange(2, 9)))
    year, month = r.randrange(1950, 2031), f"{r.randrange(1, 13):02d}"
    if kind == 0:
        return r.choice([f"{name()} at {name()}.{name().title()}", f"{name()} at {name()} dot {name()}", f"{name()} @ {name()}.{name()}", f"look at {name()}.{name()}"])
    if kind == 1:
        clock = f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}"
        return r.choice([clock, ":".join(f"{r.randrange(256):02x}" for _ in range(6)), f"{r.randrange(9)}:{r.randrange(9)}:{r.randrange(9)}", "version 1[.]2[.]3[.]4"])
    if kind == 2:
        failed = num(15)
        failed += str((-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(failed)) + r.randrange(1, 10)) % 10)
        return r.choice([*"._/-", "  "]).join(failed[i : i + 4] for i in range(0, 16, 4))
    return r.choice([f"{year}-{month}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 29):02d}.{month}.{year}", f"{num(3)} {num(3)} {num(3)} {num(3)}", f"order {num(3)}-{num(3)}-{num(4)}", f"{num(2)}/{num(2)}/{num(2)}", f"isbn {num(3)}-{num(2)}-{num(4)}-{num(2)}"])


#: Surroundings used where no documents are given, or a kind has no base match in them. Fixed values.
PLAIN = ("please use ", " from now on", "it says ", " on the last page", "there was ", " and nothing else")
CUES = (("email ", "write to ", "contact: "), ("server ", "ip address ", "from host "), ("card ", "visa ", "paid by card "), ("call ", "phone: ", "tel. "))


def examples(found: list[tuple[int, int | None, str, str, str]], seed: int = 11, each: int = 160) -> list[tuple[str, int, int, int, int, int]]:
    """Windows with one known place each: (text, kind, label, part, start, end)."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))

    def made(kind: int) -> str:
        if kind == 2:
            d = "4" + num(14)
            return d + str(-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10)
        return ["".join(r.choices("abcdefgh", k=6)) + "@" + "".join(r.choices("ijklmnop", k=6)) + r.choice([".com", ".org", ".de"]), ".".join(str(r.randrange(256)) for _ in range(4)), "", f"+1 {num(3)} {num(3)} {num(4)}"][kind]

    bare = [(p, b, a) for p, k, b, _, a in found if k is None]
    out = []
    for kind in range(len(KINDS)):
        real = [x for x in found if x[1] == kind]
        for n in range(each):
            cue, plain = r.choice(CUES[kind]), r.randrange(0, len(PLAIN), 2)
            part, before, hit, after = (real[n % len(real)][0], *real[n % len(real)][2:]) if real and n % 2 else (n // 2 % 2, cue, made(kind), PLAIN[plain + 1])
            new = respelt(r, kind, hit)
            out.append((before + new + after, kind, 1, part, len(before), len(before) + len(new)))
            part, before, after = bare[r.randrange(len(bare))] if bare and n % 2 else (n // 2 % 2, PLAIN[plain], PLAIN[plain + 1])
            new = look_alike(r, kind)
            out.append((f"{before} {new} {after}", kind, 0, part, 0, 0))
    out += [(b + a, -1, 0, p, 0, 0) for p, b, a in bare]
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3) -> list[tuple]:
    """Gradient boosting of depth-2 trees on the logistic loss: (feature, cut, [left, right]) nodes."""

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        top = (0.0, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                if gain > top[0] + 1e-9:
                    top = (gain, f, int(cut))
        return top

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        _, f, cut = best(rows, g, h) if depth else (0, None, None)
        if f is None:
            return round(float(rate * g[rows].sum() / (h[rows].sum() + 1)), 6)
        return (f, cut, grow(rows[x[rows, f] <= cut], g, h, depth - 1), grow(rows[x[rows, f] > cut], g, h, depth - 1))

    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), 2))
        score += [_walk(trees[-1], row) for row in x]
    return trees


def _walk(node, row) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def score_of(trees: list, value) -> Column:
    """The boosted score as one expression; ``value(feature)`` gives a column."""

    def branch(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        return F.when(value(FEATURES[node[0]]) <= node[1], branch(node[2])).otherwise(branch(node[3]))

    return reduce(lambda a, b: a + b, map(branch, trees), F.lit(0.0))


def learn(spark: SparkSession, docs: DataFrame | None = None, **columns: str) -> list[tuple[int, int, int, list[int]]]:
    """(kind, label, part, features) of what the wide patterns propose in the examples; a proposal is personal if it covers the
    known place or lies in it for the most part."""
    cases = examples(windows(docs, **columns) if docs is not None else [])
    rows = [{"i": i, "t": c[0]} for i, c in enumerate(cases)]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,t:string>>")).alias("x")).select("x.i", F.col("x.t").alias("_t"))
    out = []
    for x in sorted(_candidates(_base(table)).select("i", F.explode("_wide").alias("w")).select("i", "w.*").collect(), key=lambda x: (x.i, x.start, x.kind)):
        _, kind, label, part, a, b = cases[x.i]
        shared = min(b, x.end) - max(a, x.start)
        out.append((x.kind, int(label == 1 and x.kind == kind and 5 * shared >= 4 * max(b - a, x.end - x.start)), part, [x[f] for f in FEATURES]))
    return out


def fit(spark: SparkSession, docs: DataFrame | None = None, precision: float = 0.98, **columns: str) -> dict[int, tuple[list, float]]:
    """Trees and threshold of each kind, learned from windows of ``docs``."""
    return grown(learn(spark, docs, **columns), precision)


def grown(rows: list[tuple[int, int, int, list[int]]], precision: float = 0.98) -> dict[int, tuple[list, float]]:
    """Trees of each kind from part 0 of the rows, and the lowest score from which on the precision holds in part 1.

    A kind that cannot reach ``precision`` gets no additions.
    """
    out = {}
    for n in range(len(KINDS)):
        x, y, part = (np.array([v[k] for v in rows if v[0] == n], float) for k in (3, 1, 2))
        grow, check = part == 0, part == 1
        trees = boost(x[grow], y[grow])
        score = np.array([sum(_walk(t, row) for t in trees) for row in x[check]])
        cuts = [c for c in np.unique(score) if y[check][score >= c].mean() >= precision]
        out[n] = (trees, round(float(min(cuts)), 6) - 1e-6 if cuts else float("inf"))
    return out


def find_personal_data(docs: DataFrame, model: dict[int, tuple[list, float]], text_col: str = "text") -> DataFrame:
    """``(row, base, spans)``: each row of ``docs`` as a struct, with sorted arrays of (start, kind, end).

    Places are code points, ends exclusive, ``kind`` a place in ``KINDS``. A null text is empty and
    has no spans. ``spans`` holds the base spans and each wider proposal whose score reaches its kind's threshold,
    unless it overlaps a base span or, from the left, another selected proposal that scores higher (ties: the first by start, then
    kind). The columns of ``docs`` may have any names.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    df = _candidates(_base(df))

    def by_kind(w: Column, of) -> Column:
        return reduce(lambda rest, n: F.when(w["kind"] == n, of(n)).otherwise(rest), range(len(KINDS)), F.lit(float("inf")))

    kinds = lambda w: by_kind(w, lambda n: score_of(model[n][0], lambda f: w[f]))
    limits = lambda w: by_kind(w, lambda n: F.lit(model[n][1]))
    scored = F.transform("_wide", lambda w: F.struct(w["start"].alias("start"), w["kind"].alias("kind"), w["end"].alias("end"), kinds(w).alias("score"), limits(w).alias("least")))
    df = df.withColumn("_wide", F.when(F.size("_wide") > 0, F.sort_array(F.filter(scored, lambda w: w["score"] >= w["least"]))))
    kind = "struct<start:int,kind:int,end:int>"
    fields = ("start", "kind", "end", "score")

    def sweep(s: Column, w: Column) -> tuple[dict[str, Column], Column]:
        """Keep the better of overlapping neighbours; the held one goes out when the next does not overlap it."""
        clear = w["start"] >= s["end"]
        take = clear | (w["score"] > s["score"])
        out = F.when(clear & (s["end"] > 0), F.array(F.struct(*[s[f].alias(f) for f in fields[:3]]))).otherwise(F.array().cast(f"array<{kind}>"))
        return {f: F.when(take, w[f]).otherwise(s[f]) for f in fields}, out

    # a last entry behind all others sends the held one out
    end = F.lit(2**31 - 1)
    closed = F.concat(F.transform("_wide", lambda w: F.struct(*[w[f].alias(f) for f in fields])), F.array(F.struct(end.alias("start"), F.lit(0).alias("kind"), end.alias("end"), F.lit(0.0).alias("score"))))
    chosen = _fold(closed, kind, {"start": F.lit(0), "kind": F.lit(0), "end": F.lit(0), "score": F.lit(0.0)}, sweep)
    return df.select("row", F.col("_base").alias("base"), F.when(F.size("_wide") > 0, F.sort_array(F.concat("_base", chosen))).otherwise(F.col("_base")).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: str = "spans") -> Column:
    """The text with each run of overlapping spans replaced by its first span's kind in brackets; null stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    whole = F.aggregate(F.col(spans), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
