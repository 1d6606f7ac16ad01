"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Generators of high recall propose
further, overlapping spans: addresses written with (at) and (dot), numbers in national or dotted forms, IPv6 addresses,
account numbers. Trees score each from its format and from the text around it; what reaches the threshold of its kind
joins the base spans, unless it overlaps one; of overlapping ones the best stays.

The trees are trained on the driver on EXAMPLES made-up spans and on what the generators propose in LINES everyday
lines of another maker, fixed numbers both; their features come from the same DataFrame expressions as those of the
candidates, and the trees run as nested CASE expressions. Thresholds are calibrated on as many further lines, which the
trees have not seen: the least score from which PRECISION of what is proposed there is personal.

Offsets are code points, ends exclusive. Matches of a pattern are leftmost and don't overlap; those that fail their
check are dropped without a further try. Patterns start only where a run of their characters does, or where the last
match ended, and take runs whole; the one for cards takes only runs of 12 to 19 digits, as no other run can pass. That
changes no span and keeps the time linear in a text's length. What follows a row's matches one after another, as places
and what is settled between neighbours do, goes through them in chunks, so that long lists are not copied for each entry.

The numbers of digits and groups in the generators' patterns are those of the formats; parts of addresses have no limit.

Defined results: a null text is empty; a text without spans has counts 0, the digest of the empty string and empty spans;
rows that repeat have equal spans; columns that are there already stay, unless they are called base or spans, which the
result's replace (``redact`` keeps all).
"""

from __future__ import annotations

import random
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

KINDS = ("email", "ip", "card", "phone", "account")
EXAMPLES, LINES = 3000, 4000
PRECISION = 0.995
AROUND = 24
TREES, DEPTH, RATE = 32, 4, 0.3

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all, by kind: few texts need the pattern itself.
NEEDED = {"email": "@", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: (kind, pattern) of the generators.
GENERATORS = (
    ("email", r"(?<!\S)[^\s@\[\]()]++(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]++(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]++)*+"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z._-])[0-9](?:[ ._-]?[0-9]){11,18}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.,-])(?:00|\()?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
)
#: Words that tell what a number or address is, in four languages.
CUES = {
    "email": "mail|contact|write|schreib|escrib|courriel|correo|kontakt",
    "ip": "\\bip\\b|host|address|adresse|server|dirección|login",
    "card": "card|visa|karte|carte|tarjeta|credit|debit",
    "phone": "phone|tel|call|mobil|cell|fax|ruf|appel|llam|whatsapp",
    "account": "iban|account|konto|compte|cuenta|bank|bic",
}
AGAINST = "isbn|version|build|order|ticket|page|sku|serial|id\\b|ref|total|error|line|build"


def _luhn(digits: Column) -> Column:
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: Entries of an array that are folded at a time: a fold copies what it has for each entry it adds.
CHUNK = 64


def _bound(x: Column, f) -> Column:
    """f of x, with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _chunks(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))


def running(x: Column, join) -> Column:
    """For each entry of an array of at least one int join of all up to it, for an associative join whose zero is 0."""

    def folded(a: Column) -> Column:
        zero = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, y: _bound(join(acc["all"], y), lambda t: F.struct(t.alias("all"), F.concat(acc["out"], F.array(t)).alias("out")))
        return F.aggregate(a, zero, step)

    def whole(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), folded(F.transform(parts, lambda p: p["all"]))["out"])
        return _bound(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(p["out"], lambda y: join(F.get(b, i), y)))))

    return _bound(F.transform(_chunks(x), folded), whole)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matches(df: DataFrame, text: str, name: str, pattern: str, needed: str | None = None) -> DataFrame:
    """Adds ``name``: array of (start, end, match, before, after) of all matches; the gaps between matches give places."""
    found, gaps, starts = f"{name}_m", f"{name}_g", f"{name}_s"
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(found, all_ if needed is None else F.when(F.contains(F.col(text), F.lit(needed)), all_).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
    steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
    df = df.withColumn(starts, F.when(F.size(found) > 0, running(steps, _sum)))

    def span(m: Column, i: Column) -> Column:
        start = F.get(starts, i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.right(F.get(gaps, i), F.lit(AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("after"))

    return df.withColumn(name, F.transform(found, span)).drop(found, gaps, starts)


def features(kind: Column, s: Column) -> list[Column]:
    """Numbers that describe a candidate (match, before, after) of a kind: its format first, then what stands around it."""
    m = s["match"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    before = F.lower(s["before"])
    cue = reduce(lambda a, k: F.when(kind == k, before.rlike(CUES[k])).otherwise(a), CUES, F.lit(False))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    sizes = F.transform(F.filter(F.split(m, "[^0-9A-Za-z]+"), lambda g: g != ""), lambda g: F.length(g))
    return [
        F.length(m).cast("double"),
        n.cast("double"),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        F.regexp_count(m, F.lit(r"[ ().\-/_]+")).cast("double"),
        yes(m.rlike(r"^\(?0|^\(")),
        yes(F.when(n.between(12, 19), _luhn(digits)).otherwise(False)),
        yes(m.rlike(r"^[A-Za-z0-9._%+-]+\s?(@|[\[(]at[\])])\s?[A-Za-z0-9-]+(\s?(\.|[\[(]dot[\])])\s?[A-Za-z0-9-]+)*\s?(\.|[\[(]dot[\])])\s?[A-Za-z]{2,}$")),
        yes(m.rlike(r"[\[(](at|dot)[\])]")),
        yes(m.rlike(r"^[0-9]{4}([ ._-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^\(?[0-9]{3,4}\)?[ .\-/]{1,2}[0-9]{3,4}[ .\-/][0-9]{3,4}$")),
        yes(m.rlike(r"^[0-9]{4}[.\-/][0-9]{2}[.\-/][0-9]{2}|^[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{4}")),
        F.regexp_count(m, F.lit("[:]")).cast("double"),
        yes(m.rlike("[a-fA-F]") & m.rlike("::|:[0-9A-Fa-f]*:")),
        yes(cue),
        yes(before.rlike(AGAINST)),
        yes(before.rlike(r"[#$€£=\"']\s?$") | s["after"].rlike(r"^[%#$€£\"'=]")),
        F.size(sizes).cast("double"),
        F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
        yes(digits.rlike("^[4-6]")),
        yes(m.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5,7}[0-9A-Fa-f]{2}$")),
        yes(m.rlike(r"(?:^|[ ().\-/])(?:1[5-9]|20)[0-9]{2}[ ().\-/]+(?:1[5-9]|20)[0-9]{2}(?:$|[ ().\-/])")),
        kind_number(kind),
    ]


def kind_number(kind: Column) -> Column:
    return reduce(lambda a, k: F.when(kind == k, float(KINDS.index(k))).otherwise(a), KINDS, F.lit(-1.0))


# --- examples, trees, thresholds: on the driver -----------------------------------------------------------------


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(kind, match, before, after, personal) of made-up candidates, half of them personal."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    w = lambda k=0: "".join(r.choices("aeiorntslhdcmu", k=k or r.randint(2, 9)))
    hexa = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    cue = {"email": ["mail me at", "contact:", "Kontakt"], "ip": ["ip", "host", "login from"], "card": ["card", "visa no", "Karte"], "phone": ["call", "tel.", "phone:", "mobile"], "account": ["IBAN", "Konto", "account"]}

    def luhn(k: int) -> str:
        s = r.choice("456") + d(k - 2)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s))))
        return s + str(-total % 10)

    out = []
    for _ in range(n):
        kind, good = r.choice(KINDS), r.random() < 0.5
        before, after = w() + " " + w() + " ", " " + w()
        if good and r.random() < 0.7:
            before = w() + " " + r.choice(cue[kind]) + " "
        if not good and r.random() < 0.5:
            before = w() + r.choice([" order ", " version ", " isbn ", " ref #", " id=", " total $", ' "', " page "])
        if kind == "email":
            at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", ".")])
            m = f"{w()}.{w()}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if good else r.choice([f"{w()}@{w()}", f"{w()} (at) {w()}", f"@@@{w()}@{w()}", f"{w()}!!@{w()}", f"{w()}[at]{w()}"])
        elif kind == "ip":
            m = ":".join(hexa(4) for _ in range(8)) if good and r.random() < 0.6 else f"{hexa(4)}:{hexa(3)}::{hexa(4)}:{hexa(2)}" if good else ":".join(d(2) for _ in range(r.randint(4, 6)))
        elif kind == "card":
            s = luhn(16)
            m = r.choice("._").join(s[i : i + 4] for i in range(0, 16, 4)) if good else r.choice([d(r.randint(12, 18)), f"{d(4)}_{d(4)}_{d(4)}_{d(2)}", f"{d(4)}.{d(8)}"])
        elif kind == "phone":
            m = r.choice([f"({d(3)}) {r.randint(2, 9)}{d(2)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}-{r.randint(2, 9)}{d(2)}-{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)}/{d(7)}"]) if good else r.choice([f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{d(3)} {d(3)} {d(3)}", d(r.randint(7, 14)), f"{d(1)}.{d(2)}.{d(5)}", f"{d(3)}-{d(1)}-{d(2)}-{d(6)}"])
            if good and "-" in m[:5] and r.random() < 0.8:
                before = w() + " " + r.choice(cue[kind]) + " "
        else:
            m = r.choice(["DE", "FR", "ES", "GB"]) + d(2) + " " + " ".join(d(4) for _ in range(4)) + " " + d(2) if good else r.choice([f"{w(2).upper()}{d(2)}{w(4).upper()}{d(4)}", f"AB{d(2)}{d(8)}"])
            if not good and r.random() < 0.2:
                before = 'key = "'
        out.append((kind, m, before[-AROUND:], after[:AROUND], int(good)))
    return out


def lines(n: int, seed: int) -> list[tuple[str, list[tuple[str, str]]]]:
    """(line, personal spans (kind, text)) of another maker: everyday lines of numbers, times, rows of tables, lists, codes, and contacts.

    Most hold nothing personal, as most numbers in texts are not."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    up = lambda a, z, step=1: [str(x) for x in range(a, z, step)]
    some = lambda top, k: [str(r.randrange(top)) for _ in range(k)]
    hexa = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    word = lambda: "".join(r.choices("abdeghilmnoprstu", k=r.randint(3, 9)))
    gap = lambda: r.choice([" ", " ", " ", "  ", " / ", "-", "."])

    def card() -> str:
        s = r.choice(["4", "51", "55", "6011"])
        s += d(15 - len(s))
        # the last digit makes the sum of all, every second one doubled, a multiple of ten
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s + "0"))))
        return s + str(-total % 10)

    def clean() -> str:
        y = r.randint(1800, 2030)
        return r.choice(
            [
                lambda: f"from {gap().join(up(y, y + r.randint(3, 6)))}",
                lambda: f"{word()} in {' '.join(str(r.randint(1700, 2040)) for _ in range(r.randint(2, 5)))} and later",
                lambda: f"{word()}: {' '.join(some(r.choice([2, 10, 100]), r.randint(7, 16)))}",
                lambda: f"row {gap().join(some(r.choice([10, 100, 1000]), r.randint(4, 9)))}",
                lambda: f"{word()} {' '.join(f'{a} {b}' for a, b in zip(up(r.randint(1, 30), 60), some(9, r.randint(4, 6))))}",
                lambda: f"mac {':'.join(hexa(2).upper() if r.random() < 0.5 else hexa(2) for _ in range(r.choice([6, 6, 8])))}",
                lambda: f"at {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}:{d(2)} {word()}",
                lambda: f"{r.randint(1, 999)} {d(3)} {d(3)} {d(3)} people",
                lambda: f"{r.randint(1, 28):02} {r.randint(1, 12):02} {y} {r.randint(0, 23):02} {r.randint(0, 59):02}",
                lambda: f"scores {' '.join(f'{r.randrange(9)}-{r.randrange(9)}' for _ in range(r.randint(4, 7)))}",
                lambda: f"isbn 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
                # a number that passes every check of a card is one, so these begin as none does
                lambda: f"lot {r.choice('0123789')}{d(3)}{r.choice('._ ')}{d(4)}{r.choice('._ ')}{d(4)}{r.choice('._ ')}{d(4)}",
                lambda: f"serial {r.choice('456')}{d(3)}_{d(4)}.{d(4)}_{d(4)}",
                lambda: f"pi is 3.{d(r.randint(8, 20))}",
                lambda: f"{d(r.randint(7, 18))} bytes",
                lambda: f"{word()} {d(2)}.{d(4)} {d(2)}.{d(4)} {d(3)}.{d(2)}",
                lambda: f"chapters {'-'.join(some(30, r.randint(4, 8)))}",
                lambda: f"primes {' '.join(['2', '3', '5', '7', '11', '13', '17', '19', '23'][: r.randint(6, 9)])}",
                lambda: f"code {word()[:2].upper()}{d(2)} {word().upper()[:4].ljust(4, 'X')} {d(4)}",
                lambda: f"@{word()}@{word()} and {word()}@{word()}",
                lambda: f"{hexa(1)}:{hexa(1)}:{hexa(1)}:{hexa(1)} ratio",
                lambda: f"uuid {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
                lambda: f"commit {hexa(7)}:{hexa(4)}:{d(3)}:{d(2)}",
                lambda: f"{d(3)}-{d(3)} and {d(4)}-{d(4)} and {d(2)}-{d(2)}-{d(2)}",
            ]
        )()

    def personal() -> tuple[str, str, str]:
        a, b = word(), word()
        s = card()
        quad = r.choice("._").join(s[i : i + 4] for i in range(0, 16, 4))
        return r.choice(
            [
                lambda: ("phone", f"({r.randint(2, 9)}{d(2)}) {r.randint(2, 9)}{d(2)}-{d(4)}", r.choice(["call {}", "tel. {}", "{} is my phone", "fax {}"])),
                lambda: ("phone", f"{r.randint(2, 9)}{d(2)}-{r.randint(2, 9)}{d(2)}-{d(4)}", r.choice(["call {}", "phone: {}", "mobile {} or so"])),
                lambda: ("phone", f"00{r.randint(30, 49)} {d(3)} {d(7)}", r.choice(["ring {}", "Tel {}", "whatsapp {}"])),
                lambda: ("phone", f"0{r.randint(100, 999)}/{d(r.choice([6, 7]))}", r.choice(["Telefon {}", "Ruf {}"])),
                lambda: ("card", quad, r.choice(["card {}", "my visa {}", "paid with {}", "Karte {}"])),
                lambda: ("ip", ":".join(hexa(r.choice([3, 4, 4])) for _ in range(8)), r.choice(["host {}", "login from {}", "{} answered"])),
                lambda: ("ip", f"2{hexa(3)}:{hexa(4)}::{hexa(r.randint(1, 4))}:{hexa(r.randint(1, 4))}", r.choice(["host {}", "server {}", "ping {}"])),
                lambda: ("email", f"{a}{r.choice([' (at) ', '[at]', ' [at] ', '(at)'])}{b}{r.choice([' (dot) ', '[dot]', '.'])}{r.choice(['com', 'org', 'de', 'fr'])}", r.choice(["mail {}", "write to {}", "{}"])),
                lambda: ("account", f"{r.choice(['DE', 'FR', 'ES', 'GB', 'IT'])}{d(2)} {' '.join(d(4) for _ in range(4))} {d(2)}", r.choice(["IBAN {}", "Konto {}", "pay to {}"])),
            ]
        )()

    out = []
    for _ in range(n):
        if r.random() < 0.6:
            out.append((f"{word()} {clean()} {word()}", []))
        else:
            kind, m, around = personal()
            out.append((f"{word()} {around.format(m)}, {word()}", [(kind, m)]))
    return out


def proposals(made: list[tuple[str, list[tuple[str, str]]]]) -> list[tuple[str, str, str, str, int]]:
    """What the generators propose in lines, as examples: personal if the whole of a personal span, of its kind, is proposed."""
    out = []
    for line, meant in made:
        for kind, pattern in GENERATORS:
            for x in re.finditer(pattern, line):
                out.append((kind, x[0], line[max(0, x.start() - AROUND) : x.start()], line[x.end() : x.end() + AROUND], int((kind, x[0].rstrip(",")) in meant)))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """(feature, at most, then, else) or a leaf's value: the splits of largest gain, second order."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if not depth or len(g) < 20:
        return leaf
    best = (1e-6, None, None)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1][:64]:
            on = x[:, f] <= t
            gain = g[on].sum() ** 2 / (h[on].sum() + 1.0) + g[~on].sum() ** 2 / (h[~on].sum() + 1.0) - base
            if gain > best[0]:
                best = (gain, f, float(t))
    _, f, t = best
    if f is None:
        return leaf
    on = x[:, f] <= t
    return f, t, _tree(x[on], g[on], h[on], depth - 1), _tree(x[~on], g[~on], h[~on], depth - 1)


def _value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _value(a, x), _value(b, x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Trees whose values, RATE times each, add up to the log-odds of y."""
    s, out = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-s))
        out.append(_tree(x, p - y, p * (1 - p), DEPTH))
        s += RATE * _value(out[-1], x)
    return out


def score(trees: list, x: np.ndarray) -> np.ndarray:
    return sum(RATE * _value(t, x) for t in trees)


def threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The least score from which at least PRECISION of the examples are personal; none may pass where there is none."""
    order = np.argsort(-s, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero((right >= PRECISION) & np.append(s[order][1:] < s[order][:-1], True))
    return float(s[order][ok[-1]]) if len(ok) else float("inf")


_MODEL: tuple[list, dict[str, float]] | None = None


def model(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """The trees, and the threshold of each kind. Trained once in a driver."""
    global _MODEL
    if _MODEL is None:
        # trees learn from both makers, thresholds from lines of the second that the trees have not seen
        learned = examples() + proposals(lines(LINES, 7))
        rows = learned + proposals(lines(LINES, 11))
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, kind string, match string, before string, after string, y int").coalesce(1)
        got = sorted(df.select("i", F.array(*features(F.col("kind"), F.struct("match", "before", "after")))).collect())
        x, y = np.array([r[1] for r in got]), np.array([r[4] for r in rows])
        fit = np.arange(len(y)) < len(learned)
        trees = boost(x[fit], y[fit])
        s = score(trees, x)
        kinds = np.array([r[0] for r in rows])
        _MODEL = trees, {k: threshold(s[~fit & (kinds == k)], y[~fit & (kinds == k)]) for k in KINDS}
    return _MODEL


def _as_column(tree: tuple | float, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(RATE * tree)
    i, t, a, b = tree
    return F.when(F.get(f, F.lit(i)) <= t, _as_column(a, f)).otherwise(_as_column(b, f))


# --- the operator ------------------------------------------------------------------------------------------------

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,base:boolean,score:double>>"


def settled(spans: Column) -> Column:
    """Of base spans and proposals, in order: all base ones, the proposals that touch none, of overlapping ones the best.

    The last proposal waits until nothing more can overlap it. A fold's state goes from chunk to chunk."""
    one, none = SPAN[6:-1], F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("end"), F.lit(None).cast(one).alias("last"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        apart = last.isNotNull() & (x["start"] >= last["end"])
        put = F.when(apart, F.array(last)).otherwise(none)
        free = x["start"] >= acc["end"]
        base = F.struct(F.greatest(acc["end"], x["end"]).alias("end"), F.lit(None).cast(one).alias("last"), F.concat(acc["out"], put, F.array(x)).alias("out"))
        new = F.struct(acc["end"].alias("end"), F.when(last.isNull() | apart | (x["score"] > last["score"]), x).otherwise(last).alias("last"), F.concat(acc["out"], put).alias("out"))
        return F.when(x["base"], base).when(free, new).otherwise(acc)

    def chunk(acc: Column, part: Column) -> Column:
        start = F.struct(acc["end"].alias("end"), acc["last"].alias("last"), none.alias("out"))
        return _bound(F.aggregate(part, start, step), lambda got: F.struct(got["end"].alias("end"), got["last"].alias("last"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    first = F.struct(F.lit(0).alias("end"), F.lit(None).cast(one).alias("last"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return _bound(F.aggregate(_chunks(spans), first, chunk), lambda got: F.concat(F.flatten(got["out"]), F.when(got["last"].isNotNull(), F.array(got["last"])).otherwise(none)))


def _span(s: Column, kind: str, base: bool, score: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"), score.alias("score"))


def _base_spans(name: str, kind: str) -> Column:
    return F.transform(F.filter(name, lambda s: _valid(kind, s["match"])), lambda s: _span(s, kind, True, F.lit(0.0)))


def _described(name: str, kind: str) -> Column:
    return F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*features(F.lit(kind), s)).alias("f")))


def _scored(name: str, kind: str, trees: list, least: float) -> Column:
    spans = F.transform(name, lambda s: _span(s, kind, False, reduce(lambda a, b: a + b, [_as_column(t, s["f"]) for t in trees])))
    return F.filter(spans, lambda s: s["score"] >= F.lit(least))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with base and spans: arrays of (start, rank, kind, end, base, score) by start, then kind as in KINDS."""
    trees, least = model(docs.sparkSession)
    mine = "pii_" + "_" * max(map(len, docs.columns), default=0)  # no column of docs begins like that
    own = f"{mine}text"
    df = docs.drop(base, spans).withColumn(own, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names, proposed = [], []
    for kind, pattern in BASE.items():
        name = f"{mine}base_{kind}"
        df = _matches(df, own, name, pattern, NEEDED.get(kind))
        df = df.withColumn(name, _base_spans(name, kind))
        names.append(name)
    for i, (kind, pattern) in enumerate(GENERATORS):
        name = f"{mine}more_{i}"
        df = _matches(df, own, name, pattern)
        df = df.withColumn(name, F.when(F.size(name) > 0, _described(name, kind)))
        df = df.withColumn(name, F.coalesce(_scored(name, kind, trees, least[kind]), F.array().cast(SPAN)))
        proposed.append(name)
    more = f"{mine}more"
    df = df.withColumn(base, F.array_sort(F.concat(*names))).withColumn(more, F.concat(*proposed)).drop(*names, *proposed)
    both = F.array_sort(F.concat(base, more))
    return df.withColumn(spans, F.when(F.size(more) > 0, settled(both)).otherwise(F.col(base))).drop(more, own)


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points in a piece of a text: what lies between spans is cut from pieces, not from the whole.
PIECE = 4096


def _between(pieces: Column, a: Column, z: Column) -> Column:
    """The code points from a to z, if a < z."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor((z - 1) / PIECE).cast("int")
    first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
    apart = F.concat(F.substring(first, a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), (z - 1) % PIECE + 1))
    return F.when(a >= z, "").when(i == j, F.substring(first, a % PIECE + 1, z - a)).otherwise(apart)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with <KIND> for each span of personal data in the text; of overlapping ones the first names the whole."""
    mine = "red_" + "_" * max(map(len, docs.columns), default=0)
    base, spans, ends, pieces = (f"{mine}{x}" for x in ("base", "spans", "ends", "pieces"))
    df = find_pii(docs, text_col, base, spans).drop(base)
    some = F.size(spans) > 0
    #: how far the spans before each one reach
    df = df.withColumn(ends, F.when(some, F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), _most))))
    df = df.withColumn(pieces, F.when(some, F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def part(s: Column, i: Column) -> Column:
        reached = F.get(ends, i)
        return F.when(s["start"] >= reached, F.concat(_between(F.col(pieces), reached, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

    rest = _between(F.col(pieces), F.element_at(ends, -1), F.length(text_col))
    return df.withColumn(text_col, F.when(some, F.concat(F.array_join(F.transform(spans, part), ""), rest)).otherwise(F.col(text_col))).select(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    df = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def python_base(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text by the plain patterns; for tests."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, p) in enumerate(plain.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(d))) % 10 == 0):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, a, z) for a, _, k, z in sorted(out)]
