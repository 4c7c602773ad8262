"""Operator 7: personal data by candidate gradient boosting, in DataFrame functions.

Four patterns find e-mail and IP addresses, card and phone numbers whose form
suffices. For the rest, generators with high recall propose spans that may
overlap: spelled-out addresses, local phone numbers, account and identity
numbers, IBANs, birth dates, street addresses, IPv6. Boosted regression trees
score each from its format and its context, the scores are calibrated on
samples of their own, and a span is taken if its probability reaches its
kind's threshold; of spans that overlap, the most probable kind wins. The trees are trained on the driver
from a bounded set of labelled samples, with features computed by the same
expressions that the scan uses, and run as nested CASE expressions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick
from .spans import listed, no_spans, number, spans, without_overlaps

# The patterns of the base, in forms that run in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

_WORD, _OPEN, _CLOSE = r"[A-Za-z0-9_%+-]{1,64}", r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
_AT = rf"(?:{_OPEN}(?:at|@|arroba|arobase){_CLOSE}|\x20(?:at|@|arroba|arobase)\x20)"
_DOT = rf"(?:\.|{_OPEN}(?:dot|punkt|punto|point){_CLOSE}|\x20(?:dot|punkt|punto|point)\x20)"
_STREET = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Way|Place|St|Ave|Rd|Ln|Dr|Blvd"

#: Generators of further candidates: kind, pattern, and a text without which there is no match (empty: none is known).
GENERATORS = (
    ("spelled_email", rf"(?i)(?<![A-Za-z0-9._%+-]){_WORD}(?:{_DOT}{_WORD}){{0,3}}+{_AT}{_WORD}(?:{_DOT}{_WORD}){{1,4}}+", ""),
    ("local_phone", r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{1,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,8}+){1,4}+(?![0-9A-Za-z])", ""),
    ("social_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])", ""),
    ("account", r"(?<![0-9A-Za-z.-])[0-9]{8,19}+(?![0-9A-Za-z-])", ""),
    ("identity", r"(?<![A-Za-z0-9-])(?:[0-9]{8}-?[A-Z]|[XYZ][0-9]{7}-?[A-Z]|[A-Z]{1,2}[0-9]{6,8})(?![A-Za-z0-9-])", ""),
    ("birth_date", r"(?<![0-9./-])(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))(?![0-9./-])", ""),
    ("address", rf"(?<![A-Za-z0-9])(?:[0-9]{{1,5}}\x20(?:[A-Z][a-z]{{1,20}}\x20){{1,3}}(?:{_STREET})(?![A-Za-z])|[A-ZÄÖÜ][a-zäöüß]{{2,20}}?(?:straße|strasse|weg|platz|allee)\x20[0-9]{{1,4}}[a-z]?(?![A-Za-z0-9]))", ""),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:.])", ":"),
)
CONTEXT = 32
# Words around a candidate that the features look for.
WORDS = (
    r"phone|phones|call|tel|fax|mobile|cell|text me|whatsapp|telephone|telefon|telefonnummer|rufnummer|handy|téléphone|tél|appel|appelez|teléfono|móvil",
    r"e-mail|email|mail|contact|write|reach|send|correo|schreib|schreiben|mailto|écrire",
    r"ssn|social|insurance|security|customer|member|patient|versicherung|versicherungsnummer",
    r"iban|account|bank|konto|kontonummer|compte|cuenta|transfer|card|karte",
    r"passport|identity|id|dni|nie|ausweis|ausweisnummer|licen[cs]e|pasaporte|reisepass|passeport",
    r"born|birth|birthday|birthdate|dob|geboren|née?|naissance|nacido|nacida|nacimiento|geburtsdatum|geburtstag",
    r"live|lives|living|address|home|deliver|ship|wohnt|wohnhaft|wohne|anschrift|adresse|dirección|vive|habite",
    r"host|server|ping|network|address|interface|ip",
    r"version|isbn|order|invoice|page|part|serial|sku|ref|build|model|figure|table|chapter|log|commit|doi",
    r"total|sum|price|amount|eur|usd|population|year|years|result|results|rows|lines|between|since|from|published|updated",
)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _card(m: Column) -> Column:
    return F.length(digits(m)).between(14, 19) & luhn(digits(m))


def base_spans(t: Column) -> Column:
    return F.concat(
        F.when(F.contains(t, F.lit("@")), spans(t, EMAIL, KINDS[0], 0, lambda m: F.lit(True))).otherwise(no_spans()),
        spans(t, IP, KINDS[1], 1, lambda m: m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")),
        spans(t, CARD, KINDS[2], 2, _card),
        spans(t, PHONE, KINDS[3], 3, lambda m: F.length(digits(m)).between(10, 15)),
    )


def mod97(m: Column) -> Column:
    """Remainder of an IBAN's number by 97 (1 if its check digits are right)."""
    plain = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def features(text: Column, s: Column) -> list[Column]:
    """Format and context of a candidate span, as numbers."""
    m, before = s["match"], F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    after = F.lower(F.substring(text, s["end"] + 1, F.lit(CONTEXT)))
    d = digits(m)
    n = F.length(d)
    parts = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    size = lambda i: F.coalesce(F.length(F.get(parts, i)), F.lit(0))
    kind = lambda k: (s["rank"] == len(KINDS) + k).cast("int")
    return [
        *[kind(k) for k in range(len(GENERATORS))], F.length(m), n, F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.size(parts), size(F.lit(0)), size(F.size(parts) - 1),
        F.size(F.array_distinct(F.split(d, ""))), F.contains(m, F.lit("(")).cast("int"), m.rlike(r"^\(?0").cast("int"), m.rlike(r"(?i)[\[({<]|\x20(dot|punkt|punto|point)\x20").cast("int"),
        m.rlike(r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$").cast("int"), m.rlike(r"^(19|20)[0-9]{2}\b|\b(19|20)[0-9]{2}$").cast("int"), F.contains(m, F.lit(".")).cast("int"), F.contains(m, F.lit("/")).cast("int"),
        *[before.rlike(rf"(?U)\b(?:{w})\b").cast("int") for w in WORDS], *[after.rlike(rf"(?U)\b(?:{w})\b").cast("int") for w in WORDS[5:]],
        before.rlike(r"[:#=]\x20?$").cast("int"), before.rlike(r"[0-9a-z][0-9]\x20$|[0-9],?\x20$").cast("int"), after.rlike(r"^[\x20,;]{1,2}[0-9]").cast("int"), after.rlike(r"^[\x20]?[%€$]|^\x20(km|kg|mb|gb|m|cm|people|items)\b").cast("int"),
        m.rlike(r"^[09]00-|^666|-00-|-0000$").cast("int"), (n.between(13, 19) & luhn(d)).cast("int"), (kind(3) * (mod97(F.upper(m)) == 1).cast("int")),
    ]


def _iban(r: random.Random) -> str:
    """A made-up number with right check digits, as one word or in groups of four."""
    land, size = r.choice((("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14), ("IT", 23), ("AT", 16), ("CH", 17)))
    letters = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=4)) if land in ("GB", "NL") else ""
    rest = letters + "".join(r.choices("0123456789", k=size - len(letters)))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{rest}{land}00")) % 97
    plain = f"{land}{check:02d}{rest}"
    return plain if r.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))


def labelled_samples(n: int = 400, seed: int = 7) -> list[tuple[str, str, int]]:
    """(text, kind, label): n texts for each generator and label, the same at each call; each holds one candidate of the kind."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    near = lambda *at: r.choice([w for i in at for w in WORDS[i].replace("?", "").replace("[cs]", "s").split("|")])
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
    day, month, year = lambda: r.randint(1, 28), lambda: r.randint(1, 12), lambda: r.randint(1920, 2024)

    def date() -> str:
        return r.choice((f"{day():02d}.{month():02d}.{year()}", f"{day()}/{month()}/{year()}", f"{year()}-{month():02d}-{day():02d}"))

    def phone() -> str:
        s = r.choice((" ", " ", ".", "-", "/"))
        return r.choice((
            f"({num(3)}) {r.randint(2, 9)}{num(2)}-{num(4)}", f"{num(3)}{s}{num(3)}{s}{num(4)}", f"0{num(r.randint(2, 4))}{s}{num(r.randint(5, 8))}", f"(0{num(r.randint(2, 4))}) {num(r.randint(5, 8))}",
            s.join([f"0{r.randint(1, 9)}", *(num(2) for _ in range(4))]), f"{r.choice('69')}{num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)} {num(3)} {num(4)}", f"0049 {num(2)} {num(7)}",
        ))

    def numbers() -> str:
        s = r.choice((" ", ", ", " ", "-"))
        return r.choice((
            f"{num(3)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}-{num(4)}", f"{num(2)}.{num(4)}.{num(3)}", f"{r.randint(1, 12)} {num(3)} {num(3)}", date(), f"{year()}-{year()}", f"{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(2)}",
            f"{num(3)}-{r.choice('0123')}-{num(2)}-{num(6)}-{num(1)}"[4:], f"{year()}/{num(4)}", s.strip().join((num(2), num(2), num(2))) if s != ", " else f"{num(2)} {num(2)} {num(2)}",
        ))

    def spelled() -> str:
        at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", "."), (" (at) ", "."), (" AT ", " DOT "), (" @ ", "."), ("(arroba)", "."), (" [at] ", ".")))
        name = r.choice((word(), f"{word()}{r.choice('._-')}{word()}", f"{word()}{num(2)}", f"{word()}{dot}{word()}"))
        return f"{name}{at}{word()}{r.choice(('', '-' + word()))}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'co' + dot + 'uk', 'edu', 'io'))}"

    def no_iban() -> str:
        while True:
            m = "".join(r.choices("ABCDEFGHXYZ", k=2)) + num(2) + "".join(r.choices("ABCDEF0123456789", k=4 * r.randint(2, 7)))
            if int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 != 1:
                return m

    street = lambda: r.choice((f"{r.randint(1, 9999)} {' '.join(word().capitalize() for _ in range(r.randint(1, 2)))} {r.choice(_STREET.split('|'))}", f"{word().capitalize()}{r.choice(('straße', 'weg', 'platz', 'allee'))} {r.randint(1, 200)}{r.choice(('', '', 'a'))}"))
    hexa = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    clock = lambda: ":".join(f"{r.randint(0, 59):02d}" for _ in range(r.choice((4, 6))))
    # For each kind: what it looks like, which words are near it, and the same for what only looks like it.
    make = {
        "spelled_email": (spelled, (1,), lambda: r.choice((f"{r.choice(('look', 'was', 'is', 'meet', word()))} at {word()}.{r.choice((word(), 'and', 'the', 'then'))}", f"{word()} at {word()} point {word()}", f"{word()} at {word()} dot {word()}")), (6, 8, 9)),
        "local_phone": (phone, (0,), numbers, (8, 9, 9)),
        "social_number": (lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", (2, 4), lambda: r.choice((f"{r.choice(('000', '666', '900'))}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}")), (8, 9)),
        "iban": (lambda: _iban(r), (3,), no_iban, (8,)),
        "account": (lambda: num(r.randint(8, 16)), (2, 3, 4), lambda: num(r.randint(8, 16)), (8, 9)),
        "identity": (lambda: r.choice((f"{num(8)}{r.choice(('', '-'))}{r.choice('TRWAGMYFPDXBNJZSQVHLCKE')}", f"{r.choice('XYZ')}{num(7)}{r.choice('TRWAGMYFPD')}", f"{r.choice('ABCDEFGHKLMNPRSTUVWXYZ')}{num(r.choice((7, 8)))}", f"{''.join(r.choices('ABCDEFGHJKLMNPRSTVWXYZ', k=2))}{num(r.choice((6, 7)))}")), (4,),
                     lambda: r.choice((f"{''.join(r.choices('ABCDEFGHJKLMNPRSTVWXYZ', k=2))}{num(r.choice((6, 7, 8)))}", f"{num(8)}{r.choice('ABCDEFGHX')}")), (8,)),
        "birth_date": (date, (5,), date, (8, 9, 9)),
        "address": (street, (6,), lambda: f"{r.randint(1, 999)} {' '.join(word().capitalize() for _ in range(r.randint(1, 2)))} {r.choice(('Way', 'Court', 'Drive', 'Square', 'Place'))}", (8, 9)),
        "ip6": (lambda: r.choice((":".join(hexa(r.randint(1, 4)) for _ in range(8)), "fe80::" + ":".join(hexa(4) for _ in range(4)), "2001:db8:" + ":".join(hexa(r.randint(1, 4)) for _ in range(2)) + "::" + hexa(1))), (7,), clock, (8, 9)),
    }
    out = []
    for _ in range(n):
        for kind, (is_, near_is, isnt, near_isnt) in make.items():
            plain = kind in ("spelled_email", "iban", "ip6", "local_phone", "address")  # told by their form, so words near them may be absent
            out.append((_framed(r, prose, is_(), near(*near_is) if r.random() < (0.7 if plain else 1.0) else prose(), prose()), kind, 1))
            words_near = near(*near_isnt) if r.random() < 0.6 or kind == "address" else prose()
            if kind == "iban" and r.random() < 0.3:
                words_near = near(3)
            out.append((_framed(r, prose, isnt(), words_near, near(*near_isnt) if r.random() < 0.3 else prose()), kind, 0))
    for _ in range(n // 2):  # pieces of longer numbers are none by themselves
        out.append((f"{prose()} {near(3)} {_iban(r)} {prose()}", "local_phone", 0))
        out.append((f"{prose()} {near(3)}: {num(4)} {num(4)} {num(4)} {num(4)} {prose()}", "local_phone", 0))
        out.append((f"{prose()} {near(2)} {r.choice(('', 'is '))}{num(3)}-{num(2)}-{num(4)} {prose()}", "local_phone", 0))
    return out


def _framed(r: random.Random, prose, m: str, before: str, after: str) -> str:
    return f"{prose()} {before}{r.choice(('', ':', ' is', ' #', ' =', ' my', ' number'))} {m}{r.choice((' ', '. ', ', ', ''))}{' ' if after else ''}{after}"


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, least: int = 10) -> tuple[float, list]:
    """Gradient boosting with logistic loss: the prior and the trees, each (feature, limit, left, right) or a leaf's value."""
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), prior)
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best, G, H = (1e-6, None, None), g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]) if left else ():
            for v in limits[j]:
                go = x[rows, j] <= v
                if least <= go.sum() <= len(rows) - least:
                    a, b = g[rows][go].sum(), h[rows][go].sum()
                    gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                    if gain > best[0]:
                        best = (gain, j, float(v))
        if best[1] is None:
            value = rate * float(G / (H + 1))
            score[rows] += value
            return value
        go = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[go], g, h, left - 1), grow(rows[~go], g, h, left - 1))

    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return prior, out


def applied(model: tuple[float, list], row: np.ndarray) -> float:
    total = model[0]
    for t in model[1]:
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t
    return total


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's logistic calibration, by Newton's method."""
    a, b = 1.0, 0.0
    up = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((up - p) * score).sum(), (up - p).sum()])
        h = np.array([[(w * score * score).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def _column(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.get(f, F.lit(tree[0])) <= tree[1], _column(tree[2], f)).otherwise(_column(tree[3], f))


class Model:
    """Trees, calibration and each kind's threshold, fitted on the driver from labelled samples.

    Half of the samples fit the trees; a quarter calibrates them and sets the
    thresholds; precision and recall are those of the last quarter, which had
    no part in either.
    """

    def __init__(self, spark: SparkSession, samples: list[tuple[str, str, int]] | None = None, precision: float = 0.98):
        samples = samples or labelled_samples()
        df = spark.createDataFrame([(i, *s) for i, s in enumerate(samples)], "i int, text string, kind string, label int").repartition(4, "i")
        df = df.select("i", "kind", "label", "text", candidates(F.col("text")).alias("c"))
        mine = F.element_at(F.filter("c", lambda s: s["kind"] == F.col("kind")), 1)
        df = df.where(F.exists("c", lambda s: s["kind"] == F.col("kind"))).select("i", "kind", "label", "text", mine.alias("s"))
        rows = sorted(df.select("i", "kind", "label", F.array(*[c.cast("double") for c in features(F.col("text"), F.col("s"))]).alias("f")).collect())
        x, y, kind = np.array([r.f for r in rows]), np.array([float(r.label) for r in rows]), np.array([r.kind for r in rows])
        part = np.random.default_rng(11).permutation(len(y)) % 4
        fit, tune, held = part < 2, part == 2, part == 3
        self.trees = boosted(x[fit], y[fit])
        self.slope, self.offset = calibrated(np.array([applied(self.trees, r) for r in x[tune]]), y[tune])
        p, self.limits = np.array([self.estimate(r) for r in x]), {}
        for k, *_ in GENERATORS:
            own = tune & (kind == k)
            good = [v for v in np.unique(p[own]) if y[own][p[own] >= v].mean() >= precision] if own.any() else []
            self.limits[k] = max(float(min(good)) if good else 1.0, 0.5)
        taken = p >= np.array([self.limits[k] for k in kind])
        self.precision = float(y[held & taken].mean()) if (held & taken).any() else 0.0
        self.recall = float(taken[held & (y > 0)].mean())
        self.recall_of = {k: float(taken[held & (y > 0) & (kind == k)].mean()) for k, *_ in GENERATORS}

    def estimate(self, row: np.ndarray) -> float:
        """The calibrated probability of one row of features, in plain Python."""
        return 1 / (1 + float(np.exp(-(self.slope * applied(self.trees, row) + self.offset))))

    def probability(self, f: Column) -> Column:
        """The calibrated probability of one array of features."""
        score = F.lit(self.trees[0])
        for tree in self.trees[1]:
            score = score + _column(tree, f)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * score + F.lit(self.offset))))


def candidates(t: Column) -> Column:
    each = [(spans(t, p, k, len(KINDS) + i, lambda m, k=k: F.length(digits(m)).between(7, 13) if k == "local_phone" else F.lit(True)), need) for i, (k, p, need) in enumerate(GENERATORS)]
    return F.concat(*[F.when(F.contains(t, F.lit(need)), c).otherwise(no_spans()) if need else c for c, need in each])


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, found: arrays of spans (start, rank, end, kind, match) of each text by start, then kind.

    base has what the four patterns find, found also the generators' spans
    that the trees accept; such a span overlaps no base span, and of accepted
    spans that overlap each other the most probable stays. A null text is
    empty and has no spans. Rows that repeat an id are scanned one by one, null
    ids stay, an empty table gives no rows, extra columns are ignored.
    """
    model = model or Model(docs.sparkSession)
    t = F.col("text")
    df = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    df = df.select("doc_id", "text", base_spans(t).alias("base"), candidates(t).alias("proposed"))
    free = F.filter("proposed", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = df.withColumn("proposed", free)
    limit = F.create_map(*[F.lit(v) for kv in model.limits.items() for v in kv])
    vectors = F.transform("proposed", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), F.array(*[c.cast("double") for c in features(t, s)]).alias("f")))
    df = df.withColumn("proposed", vectors)
    scored = F.transform("proposed", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), model.probability(s["f"]).alias("score")))
    df = df.withColumn("proposed", F.when(F.size("proposed") > 0, scored))
    taken = without_overlaps(F.filter("proposed", lambda s: s["score"] >= F.element_at(limit, s["kind"])))
    df = df.withColumn("taken", F.when(F.size("proposed") > 0, taken))
    added = F.transform(F.coalesce("taken", F.filter("taken", lambda s: F.lit(False))), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    found = F.when(F.size("taken") > 0, F.concat("base", added)).otherwise(F.col("base"))
    return df.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(found).alias("found"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[number(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
