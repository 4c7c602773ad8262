"""Operator 3: secret scans with character Markov models, in DataFrame functions.

Three patterns find credentials whose form gives them away. Beyond those, each
long and varied run of credential characters is scored by two first-order character
Markov models, one of random strings and one of ordinary identifiers, trained
from labelled samples; runs whose log-likelihood ratio per text exceeds the
threshold are secrets too. The models are two tables of log probabilities,
merged into one table of differences that the expression looks up.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick
from .spans import listed, no_spans, number, spans, table

# The patterns of the base.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ with 24 characters or more
KINDS = ("assign", "access", "hex", "random")

#: Characters of the models' alphabet.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Candidates of the method: whole runs of at least this many characters.
SHORTEST = 20
#: ... with so many different ones: repeats of a few characters are no secrets, and say little to the models.
DISTINCT = 8
#: UUIDs are random, yet they name things: what has their form is no candidate.
UUID = r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
CANDIDATE = rf"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"

# Ordinary words from which sample identifiers are made.
ORDINARY = (
    "account action active address adapter agent album amount angle apple archive array article author average background balance base basic "
    "batch beauty before begin between block board body border bottom branch breadth bridge bright buffer build button cache calendar camera "
    "candidate capital capture category center chain change channel chapter character child choice circle class clean client clock cloud code "
    "column command comment common community company complete component condition config connection constant container content context control "
    "convert copy corner count country course create current customer data database date debug default delete delivery deployment depth design "
    "detail develop device dialog difference direct directory display distance district document domain download draft driver duration dynamic "
    "edge editor education effect element email empty enable encode engine entity entry environment error event example exchange execute "
    "expense experience export express extension factor family feature field figure file filter final finger first flight floor folder font "
    "forest format forward frame freedom function future garden general generate global government gradient graph green group guide handler "
    "header health height history holiday house human image import income index industry input insert instance interface internal island item "
    "journey kernel keyboard kitchen label language large layer layout leader length letter level library limit line list listener local "
    "location logger machine manager margin market master match material maximum measure member memory message method middle minimum minute "
    "mirror mobile model module moment monitor month morning motion mountain name nation nature network number object office offset operation "
    "option orange order origin output owner package page paper parameter parent party password path pattern payment people period permission "
    "person phone picture place plan player point policy popular position power present pressure previous price print private problem process "
    "product profile program project property protocol provider public purchase quality quantity query question queue random range reader reason "
    "receiver record refresh region register relation release remote remove render repeat report request resource response result return review "
    "river role root round route sample scale schedule school science screen script search season second section select sender sequence series "
    "server service session setting shadow shape share sheet signal simple single size social source space special speed stage standard start "
    "state station status storage store stream street string structure student style subject summary summer surface switch symbol system table "
    "target task team template test text theme thread thunder ticket time title token total touch track traffic train transfer transport tree "
    "type unit update upload user value variable vector vehicle version video view village volume warning water weather website weight width "
    "window winter word worker world writer year zone verantwortung gesellschaft entwicklung wissenschaft verschiedene unabhaengigkeit "
    "geschwindigkeit moeglichkeit aufmerksamkeit bedeutung naturellement developpement communication aujourdhui responsabilite fonctionnement "
    "maintenant independance desarrollo conocimiento importancia particularmente responsabilidad investigacion administracion"
).split()


def labelled_samples(n: int = 8000, seed: int = 3) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary ones (label 0), the same at each call.

    Ordinary are identifiers of words in many styles, paths, slugs, runs of one
    character, alphabets and keyboard rows, dates and long
    numbers.
    """
    r = random.Random(seed)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    sets = [ALPHABET[:62], ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:62], ALPHABET[:26] + digits, letters]
    heads = ("", "", "", "", "key-", "sk_live_", "sk-", "ghp_", "xoxb-", "npm_", "eyJ", "AIza", "glpat-", "tok_")
    out = []
    for _ in range(n):
        s = r.choice(heads) + "".join(r.choices(r.choice(sets), k=r.randint(SHORTEST, 64)))
        out.append((s + r.choice(("", "", "=", "==")), 1))
    join = {0: "_", 1: "-", 2: "/", 6: ""}
    for _ in range(n):
        words = [r.choice(ORDINARY) for _ in range(r.randint(2, 9))]
        while len("".join(words)) < SHORTEST:
            words.append(r.choice(ORDINARY))
        if r.random() < 0.3:
            words.insert(r.randrange(len(words) + 1), str(r.choice((1, 2, 3, 10, 64, 100, 2024, 1999))))
        style = r.randrange(13)
        if style in join:
            s = join[style].join(words)
        elif style == 3:
            s = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 4:
            s = "".join(w.capitalize() for w in words)
        elif style == 5:
            s = "_".join(words).upper()
        elif style == 7:  # runs of one character
            s = "".join(c * r.randint(6, 30) for c in r.choices(ALPHABET, k=r.randint(4, 8)))
        elif style in (8, 9):
            s = "-".join(f"{r.randint(1, 9999):0{r.choice((2, 4))}d}" for _ in range(r.randint(6, 9)))
        elif style == 10:
            s = "".join(r.choices(digits, k=r.randint(SHORTEST, 40)))
        elif style == 11:  # stretches of the alphabet, the digits or a keyboard's rows
            s = "".join(x[r.randrange(4) :] for x in r.choices(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890"), k=4))
        else:
            s = "/".join([*words[:3], f"{words[-1]}_{r.randint(1, 99)}"]) + r.choice(("", "/", "-v2"))
        out.append((s, 0))
    return out


def trained(samples: Iterable[tuple[str, int]], most_false: float = 0.0005, most_missed: float = 0.01) -> tuple[list[float], float]:
    """Differences of log probabilities, by first and second character, and the threshold.

    The models are smoothed counts of character pairs from every other sample.
    On the rest, the threshold on the mean difference per pair lies half-way
    between what ``most_false`` of the ordinary samples exceed and what
    ``most_missed`` of the random ones don't reach; it is never below the
    former, and never below 0.
    """
    at = {c: i for i, c in enumerate(ALPHABET)}
    k = len(ALPHABET)
    samples = [(s, y) for s, y in samples if len(s) > 1]
    counts = [[[0.2] * k for _ in range(k)] for _ in range(2)]
    for s, y in samples[::2]:
        for a, b in zip(s, s[1:]):
            counts[y][at[a]][at[b]] += 1
    diff = []
    for i in range(k):
        rows = [counts[y][i] for y in (0, 1)]
        tops = [sum(r) for r in rows]
        diff += [math.log(rows[1][j] / tops[1]) - math.log(rows[0][j] / tops[0]) for j in range(k)]
    means = [sorted(sum(diff[at[a] * k + at[b]] for a, b in zip(s, s[1:])) / (len(s) - 1) for s, y in samples[1::2] if y == label) for label in (0, 1)]
    if not all(means):
        return diff, 0.0
    low, high = means[0][-1 - int(len(means[0]) * most_false)], means[1][int(len(means[1]) * most_missed)]
    return diff, max(low, (low + high) / 2, 0.0)


def ratio(match: Column, diff: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of a run of ALPHABET's characters."""
    chars = F.split(match, "")
    place = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        place,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.when(a["last"] >= 0, F.get(table(diff), a["last"] * len(ALPHABET) + i)).otherwise(0.0)).alias("sum"), (a["n"] + 1).alias("n")),
        lambda a: F.when(a["n"] > 1, a["sum"] / (a["n"] - 1)).otherwise(-1.0),
    )


def varied(match: Column) -> Column:
    return (F.size(F.array_distinct(F.filter(F.split(match, ""), lambda c: c != ""))) >= DISTINCT) & ~match.rlike(UUID)


def secrets(docs: DataFrame, samples: list[tuple[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: the array of spans (start, rank, end, kind, match) of each text, by start, then kind.

    Base kinds are kept as they match; runs that the models find random are
    added as kind ``random`` where they overlap no base span. A null text is
    empty and has no spans. Rows that repeat an id are scanned one by one, null
    ids stay, an empty table gives no rows, extra columns are ignored.
    """
    diff, threshold = trained(samples or labelled_samples())
    t = F.col("text")
    df = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    base = F.concat(
        spans(t, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        F.when(F.contains(t, F.lit("AKIA")), spans(t, ACCESS, "access", 1, lambda m: F.length(m) >= 20)).otherwise(no_spans()),
        spans(t, HEX, "hex", 2, lambda m: F.length(m) >= 24),
    )
    df = df.select("doc_id", base.alias("base"), spans(t, CANDIDATE, "random", 3, lambda m: varied(m) & (ratio(m, diff) > threshold)).alias("random"))
    new = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return df.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", new)).alias("found"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every span of secrets() replaced by mark; overlapping spans are replaced as one."""
    found = secrets(docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("f_id"), "found")
    df = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    joined = df.join(found, df["doc_id"].eqNullSafe(found["f_id"]))
    folded = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return joined.select("doc_id", F.when(F.size("found") > 0, folded).otherwise(F.col("text")).alias("text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    return found.select("doc_id", *[number(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
