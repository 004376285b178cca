"""Personal data: candidates of high recall, boosted trees over format and context, calibrated thresholds.

Base spans (e-mail, IP, card, phone) come from exact patterns, leftmost and without overlap a kind;
a match that fails its check is dropped.  Generators of higher recall then propose further spans that
may overlap: addresses spelled with "at" and "dot", IPv6 and spaced IP addresses, cards in other
groupings, phones without a plus, and secrets (keys, tokens, passwords that are given a value).
Boosted trees score these from their format and the words around them; those at or over their kind's
calibrated threshold that touch no base span are added.  Base spans always stay.  Spans of different
kinds may overlap; ``redact`` covers them all.

All of it is DataFrame functions on one scan: nothing is shuffled, and a document's candidates are an
array in its row.  The trees are fitted on ``TRAINING_TEXTS`` sentences made from a fixed rule (no
labelled corpus of personal data exists here), with features from the very expressions that score;
every threshold of every feature is tried.

Patterns are possessive where a greedy repeat can't give back, positions and overlaps come from scans
by doubling distances, so a text of n characters with k matches takes n + k log k steps.

Positions are code points, ends exclusive.  Defined results: null and empty texts have no spans; rows
that repeat give equal rows; whole texts are read, of any length; an empty table gives an empty one;
other columns are left alone, and a column named as one that ``find_pii`` adds raises ValueError.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans; secrets have no base pattern.
ALL_KINDS = (*KINDS, "secret")
#: Size of the made-up training set; a quarter is held out for calibration.
TRAINING_TEXTS = 6000
ROUNDS, RATE = 60, 0.3
#: Precision on held-out candidates that a threshold must reach.
PRECISION = 0.98
_LEFT, _RIGHT = 32, 12

# \G: a match may begin where the last one ended, inside a run of its class
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_AT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?|＠)"
_DOT = r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)"
WIDE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|[0-9]{1,3}(?:\x20?(?:\.|[\[(]\.[\])])\x20?[0-9]{1,3}){3}(?![0-9.]))",
    "card": r"(?<![0-9])[0-9]{3,6}(?:[\x20.-]{1,3}[0-9]{2,6}){1,5}(?![0-9])|(?<![0-9])[0-9]{13,15}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{0,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[A-Za-z0-9+/_=.!#$%&*-]{6,}+|(?<![A-Za-z0-9])(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{12,}+",
}
# each gate is implied by its pattern
_GATE = {"email": r"@|＠|(?i:[\[({]\x20?at\x20?[\])}]|\x20at\x20)", "ip": r"[0-9][\x20.\[(]|[0-9A-Fa-f]:", "card": r"[0-9]{3}", "phone": r"[0-9]{3}", "secret": r"(?i:key|secret|token|passw|pwd)[\"'\x20]{0,4}[:=]|AKIA|ghp_|sk-|xox[bp]-"}
WORDS = {
    "email": "mail|contact|write|reach|address|send",
    "ip": "ip|host|server|addr|ping|connect|from",
    "card": "card|visa|master|amex|credit|debit|payment|account",
    "phone": "call|phone|tel|mobile|cell|fax|reach|contact|dial|ring",
    "secret": "export|config|env|login|auth|credential|bearer|set",
}
AGAINST = "order|invoice|isbn|version|part|serial|model|ref|no\\.|number|item|page|total|ticket|sku|build"


#: Distances of a scan: enough for as many matches as a text can have.
_DISTANCES = [1 << k for k in range(30)]


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of all values up to each, by doubling distances."""
    steps = F.filter(F.array(*(F.lit(d) for d in _DISTANCES)), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, combine(F.get(acc, i - d), x)).otherwise(x)))


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """Matches as an array of struct(s, e, m, left, right): from the pieces between them."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    p = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,left:string,right:string>>)")

    def placed(x: Column) -> Column:
        ends = _scan(F.zip_with(x["m"], F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda m, p: F.length(p) + F.length(m)), lambda a, b: a + b)
        return F.zip_with(
            x["m"],
            ends,
            lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")),
        )

    def described(x: Column) -> Column:
        around = lambda c, i: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), F.lower(F.right(F.get(x["p"], i), F.lit(_LEFT))).alias("left"), F.lower(F.left(F.get(x["p"], i + 1), F.lit(_RIGHT))).alias("right"))
        return F.transform(placed(x), around)

    # arrays of one, so that the text is searched once
    return F.when(gate, F.flatten(F.transform(F.array(F.struct(m.alias("m"), p.alias("p"))), described))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; every second digit from the right counts double."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(F.filter(d, lambda x: x != ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")), lambda acc, x: F.struct((acc["i"] + 1).alias("i"), (acc["t"] + F.when(acc["i"] % 2 == 0, x.cast("int")).when(x.cast("int") > 4, 2 * x.cast("int") - 9).otherwise(2 * x.cast("int"))).alias("t")))
    return (total["t"] % 10) == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans as an array of struct(kind, s, e), by kind and start."""
    gates = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")}

    def of(i: int, kind: str) -> Column:
        good = F.filter(_matches(text, BASE[kind], gates[kind]), lambda x: _passes(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    return F.concat(*(of(i, kind) for i, kind in enumerate(KINDS)))


FEATURES = ("kind", "digits", "length", "seps", "luhn", "parens", "groups334", "spelled", "tld", "octets", "hex", "words", "against", "glued", "dots", "spaces", "upper")


def wide_candidates(text: Column) -> Column:
    """Proposed spans with their features: array of struct(kind, s, e, x)."""

    def of(i: int, kind: str) -> Column:
        def described(x: Column) -> Column:
            m, d = x["m"], _digits(x["m"])
            values = {
                "digits": F.length(d),
                "length": F.length(m),
                "seps": F.length(F.regexp_replace(m, r"[^\x20./-]", "")),
                "luhn": F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)).cast("int"),
                "parens": m.contains("(").cast("int"),
                "groups334": m.rlike(r"^\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[.-][0-9]{4}$").cast("int"),
                "spelled": m.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]|＠").cast("int") + m.rlike(r"(?i)[\[({]\x20?dot\x20?[\])}]|\x20dot\x20").cast("int"),
                "tld": m.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info|example)$").cast("int"),
                "octets": m.rlike(rf"^{_OCTET}(?:\x20?[\[(]?\.[\])]?\x20?{_OCTET}){{3}}$").cast("int"),
                "hex": m.rlike("[A-Fa-f]").cast("int") + m.contains(":").cast("int"),
                "words": x["left"].rlike(rf"(?:{WORDS[kind]})[^.!?]*$").cast("int"),
                "against": x["left"].rlike(rf"(?:{AGAINST})[^.!?]*$").cast("int"),
                "glued": (x["left"].rlike(r"[\p{L}0-9_/#=-]$") | x["right"].rlike(r"^[\p{L}0-9_/=-]")).cast("int"),
                "dots": F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))),
                "spaces": F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))),
                "upper": F.length(F.regexp_replace(m, "[^A-Z]", "")),
            }
            return F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.array(F.lit(i), *(values[n].cast("int") for n in FEATURES[1:])).alias("x"))

        return F.transform(_matches(text, WIDE[kind], text.rlike(_GATE[kind])), described)

    return F.concat(*(of(i, kind) for i, kind in enumerate(ALL_KINDS)))


def _made(n: int, seed: int = 11) -> list[tuple[int, str, int, int]]:
    """The training rule: (id, text, start, end) with the personal span, or -1, -1."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 9)))

    def with_check(k: int) -> str:
        base = dig(k - 1)
        for c in "0123456789":
            t = sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(base + c)))
            if t % 10 == 0:
                return base + c
        return base

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    rows = []
    for i in range(n):
        kind = ALL_KINDS[i % len(ALL_KINDS)]
        good = r.random() < 0.5
        lead, cue = "", r.random()
        if kind == "phone":
            a, b, c = dig(3), dig(3), dig(4)
            if good:
                m = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b}-{c}", f"00{r.choice(['1', '44', '49'])} {a} {b} {c}", f"{a} {b} {c}"])
                lead = r.choice(["call ", "phone: ", "tel ", "mobile ", "fax ", "reach me at "]) if cue < 0.5 or not ("(" in m or "-" in m) else ""
            else:
                m = r.choice([f"{a}{b}{c}", f"{a} {b} {c}", f"{dig(4)}-{b}-{dig(3)}", f"{dig(4)} {dig(4)}", f"{a}-{b}-{c}", f"{dig(2)}-{b}-{c}", f"{dig(4)}/{dig(4)}"])
                lead = r.choice(["order ", "invoice no. ", "isbn ", "part number ", "ref ", "serial "]) if cue < 0.6 or m == f"{a}-{b}-{c}" else ""
        elif kind == "email":
            u, h, t = word(), word(), r.choice(["com", "org", "net", "de", "fr"])
            if good:
                m = r.choice([f"{u}[at]{h}[dot]{t}", f"{u} (at) {h} (dot) {t}", f"{u} at {h} dot {t}", f"{u} [at] {h}.{t}", f"{u} @ {h}.{t}", f"{u}＠{h}.{t}"])
                lead = r.choice(["mail ", "write to ", "contact: "]) if cue < 0.5 else ""
            else:
                m = r.choice([f"{u} at {h}.{word()}", f"{u} at {h} dot {word()}", f"{u} at {h}. {word()}", f"{u} at {word()}.{word()}", f"{u} @ {h}.{word()}"])
        elif kind == "card":
            if good:
                d = with_check(r.choice([15, 16, 14, 13]))
                m = r.choice([f"{d[:4]} {d[4:10]} {d[10:]}", grouped(d, "."), grouped(d, "  "), d])
                lead = r.choice(["card ", "visa ", "credit card: ", "payment card "])
            else:
                d = dig(r.choice([9, 12, 13, 14, 15, 16]))
                m = r.choice([d, grouped(d, " "), grouped(d, "-"), f"{d[:4]} {d[4:]}"])
                lead = r.choice(["order ", "serial ", "isbn ", "total ", "sku "]) if cue < 0.6 else ""
        elif kind == "secret":
            name = r.choice(["token", "api_key", "secret", "password", "access-key", "pwd"])
            mark, quote = r.choice([" = ", "=", ": "]), r.choice(['"', "'", ""])
            mixed = "".join(r.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(r.randrange(12, 41)))
            if good:
                m = name + mark + quote + r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), mixed + "4", word() + dig(3) + "!"])
                if r.random() < 0.15:
                    m = r.choice(["AKIA" + mixed.upper()[:12].ljust(12, "7") + "7", "ghp_" + mixed.ljust(20, "x"), "sk-" + mixed.ljust(20, "9")])
            else:
                m = name + mark + quote + r.choice([word() + word() + "ing", "required", "xxxxxxxx", "undefined", "placeholder", word() + "." + word() + "ed"])
        else:
            if good:
                m = ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randrange(2, 5))) for _ in range(8)) if cue < 0.6 else r.choice(["[.]", " . ", "(.)"]).join(str(r.randrange(1, 255)) for _ in range(4))
                lead = r.choice(["host ", "ip ", "server at ", ""])
            else:
                m = r.choice([":".join(dig(2) for _ in range(4)), ". ".join(str(r.randrange(1, 300)) for _ in range(4)), ".".join(dig(3) for _ in range(4)), f"{dig(1)}.{dig(1)}.{dig(3)}.{dig(3)}"])
                lead = r.choice(["version ", "build ", "at ", ""])
        pre = " ".join(word() for _ in range(r.randrange(1, 5))) + " " + lead
        rows.append((i, f"{pre}{m} {word()} {word()}.", len(pre) if good else -1, len(pre) + len(m) if good else -1))
    return rows


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, float] | None:
    """The feature and threshold that gain most; all thresholds are tried."""
    best, most = None, grad.sum() ** 2 / (hess.sum() + 1.0) + 1e-6
    for f in range(x.shape[1]):
        values, at = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        g, h = np.bincount(at, grad).cumsum(), np.bincount(at, hess).cumsum()
        gain = g[:-1] ** 2 / (h[:-1] + 1.0) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1.0)
        if gain.max() > most:
            best, most = (f, float(values[int(gain.argmax())])), float(gain.max())
    return best


def _fit_tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
    """A tree of depth 2: (f, t, f of the left, t, f of the right, t, four leaves); no split is a threshold of infinity."""

    def leaf(on: np.ndarray) -> float:
        return float(grad[on].sum() / (hess[on].sum() + 1.0))

    def split(on: np.ndarray) -> tuple[int, float]:
        return _best_split(x[on], grad[on], hess[on]) or (0, math.inf) if on.sum() >= 20 else (0, math.inf)

    f, t = split(np.ones(len(x), bool))
    left = x[:, f] <= t
    (fa, ta), (fb, tb) = split(left), split(~left)
    parts = [left & (x[:, fa] <= ta), left & (x[:, fa] > ta), ~left & (x[:, fb] <= tb), ~left & (x[:, fb] > tb)]
    return (f, t, fa, ta, fb, tb, *(leaf(p) for p in parts))


def _tree_value(tree: tuple, x: np.ndarray) -> np.ndarray:
    f, t, fa, ta, fb, tb, a, b, c, d = tree
    return np.where(x[:, f] <= t, np.where(x[:, fa] <= ta, a, b), np.where(x[:, fb] <= tb, c, d))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Boosted trees for the log odds."""
    p = float(np.clip(y.mean(), 0.01, 0.99))
    start = math.log(p / (1 - p))
    f, trees = np.full(len(y), start), []
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-f))
        tree = _fit_tree(x, y - q, q * (1 - q))
        trees.append(tree)
        f = f + RATE * _tree_value(tree, x)
    return start, trees


def margin(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    return model[0] + RATE * sum(_tree_value(t, x) for t in model[1])


def calibrated(scores: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on held-out precision reaches ``PRECISION``; infinity if none does."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    ok = [i for i in range(len(s)) if hits[i] >= PRECISION * (i + 1) and i >= 9 and (i + 1 == len(s) or s[i + 1] < s[i])]
    return float(s[max(ok)]) if ok else math.inf


@functools.lru_cache(maxsize=4)
def _trained(app: str):
    """Trees and thresholds; fitted once an application from the made-up sentences."""
    spark = SparkSession.getActiveSession()
    made = _made(TRAINING_TEXTS)
    df = spark.createDataFrame([(i, t) for i, t, _, _ in made], "id int, text string")
    rows = df.select("id", F.explode(wide_candidates(F.col("text"))).alias("c")).select("id", "c.*").orderBy("id", "kind", "s").collect()
    span = {i: (s, e) for i, _, s, e in made}
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    # a candidate is personal if it covers most of the personal span of its own kind
    y = np.array([span[r.id][0] >= 0 and r.id % len(ALL_KINDS) == r.kind and min(r.e, span[r.id][1]) - max(r.s, span[r.id][0]) >= 0.8 * (max(r.e, span[r.id][1]) - min(r.s, span[r.id][0])) for r in rows], float)
    held = np.array([r.id // len(ALL_KINDS) % 4 == 0 for r in rows])
    model = boost(x[~held], y[~held])
    scores = margin(model, x)
    limits = [calibrated(scores[held & (x[:, 0] == k)], y[held & (x[:, 0] == k)]) for k in range(len(ALL_KINDS))]
    return model, limits


def _over(c: Column, start: float, trees: list, limits: list[float]) -> Column:
    """A candidate's score over its kind's threshold; the trees are a table of constants."""
    names = ("f", "t", "fa", "ta", "fb", "tb", "a", "b", "c", "d")
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, tree, strict=True))) for tree in trees))
    x = lambda i: F.get(c["x"], i)

    def value(t: Column) -> Column:
        return F.when(x(t["f"]) <= t["t"], F.when(x(t["fa"]) <= t["ta"], t["a"]).otherwise(t["b"])).otherwise(F.when(x(t["fb"]) <= t["tb"], t["c"]).otherwise(t["d"]))

    score = F.aggregate(table, F.lit(float(start)), lambda acc, t: acc + value(t) * RATE)
    return score - F.get(F.array(*(F.lit(float(x)) for x in limits)), c["kind"])


def _untouched(wide: Column, base: Column) -> Column:
    """The spans of ``wide`` that no base span overlaps: the furthest end before and the nearest start after each tell."""
    far = 1 << 30
    mark = lambda of, own: F.transform(of, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), F.lit(own).alias("own")))
    both = F.array_sort(F.concat(mark(base, False), mark(wide, True)))

    def kept(x: Column) -> Column:
        before = _scan(F.transform(x, lambda c: F.when(c["own"], -1).otherwise(c["e"])), F.greatest)
        after = F.reverse(_scan(F.transform(F.reverse(x), lambda c: F.when(c["own"], far).otherwise(c["s"])), F.least))
        told = F.zip_with(F.zip_with(x, before, lambda c, b: F.struct(c.alias("c"), b.alias("b"))), after, lambda y, a: F.struct(y["c"].alias("c"), (y["c"]["own"] & (y["b"] <= y["c"]["s"]) & (a >= y["c"]["e"])).alias("free")))
        return F.transform(F.filter(told, lambda y: y["free"]), lambda y: F.struct(y["c"]["kind"].alias("kind"), y["c"]["s"].alias("s"), y["c"]["e"].alias("e")))

    return F.flatten(F.transform(F.array(both), kept))


def find_pii(docs: DataFrame, text: str = "text", base: str = "__base", spans: str = "__spans") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of struct(kind, s, e) by kind and start."""
    if {base.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {base} or {spans} already")
    spark = docs.sparkSession
    (start, trees), limits = _trained(spark.sparkContext.applicationId)
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    t = F.coalesce(F.col(f"c{names.index(text)}").cast("string"), F.lit(""))
    step1 = plain.withColumn("base", base_spans(t)).withColumn("wide", wide_candidates(t))
    # most documents have no candidate: their trees aren't evaluated
    selected = F.filter("wide", lambda c: _over(c, start, trees, limits) >= 0)
    added = F.when(F.size("selected") > 0, F.concat("base", _untouched(F.col("selected"), F.col("base")))).otherwise(F.col("base"))
    step2 = step1.withColumn("selected", selected).withColumn("spans", F.array_sort(added))
    return step2.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("base").alias(base), F.col("spans").alias(spans))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "█") -> DataFrame:
    """``text`` with the characters of all spans replaced; lengths and positions stay."""
    base, spans, chars = free_names(docs.columns, "base", "spans", "chars")
    found = find_pii(docs, text, base, spans)
    t = F.col(f"`{text}`").cast("string")

    def covered(x: Column) -> Column:
        ends = _scan(F.transform(x, lambda c: c["e"]), F.greatest)
        # the part of each span beyond all before it, and the text between that and the next
        starts = F.transform(x, lambda c, i: F.greatest(c["s"], F.coalesce(F.get(ends, i - 1), F.lit(0))))
        pieces = F.transform(x, lambda c, i: F.concat(F.substring(t, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, F.get(starts, i) - F.coalesce(F.get(ends, i - 1), F.lit(0))), F.repeat(F.lit(mark), F.greatest(c["e"] - F.get(starts, i), F.lit(0)))))
        return F.concat(F.array_join(pieces, ""), F.substring(t, F.coalesce(F.element_at(ends, -1), F.lit(0)) + 1, F.length(t)))

    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))))
    out = F.when(F.size(spans) == 0, t).otherwise(F.element_at(F.transform(F.array(order), covered), 1))
    return found.withColumn(chars, out).select(*(F.col(f"`{chars}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
