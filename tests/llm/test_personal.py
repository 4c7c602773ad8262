import re

import pytest

from lorewell.llm import personal as P

from .cases import ROWS, clashing, docs, empty

TEXTS = [
    "mail a.b+c@d-e.example.com, x@y z@w.q_d@e.fg a@b.c.d@e.f", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.1.1.1 " + "9" * 300 + ".1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 12 3  4",
    "+1 (017) 555-7713 +44 20 7946 0958. +1 2 +123456789012345678", "call (212) 555-0187 now", "my ssn is 123-45-6789", "version 4.10.2 order 12345678", "write to jane [at] mail [dot] com", "",
    None, "é\U0001f600 a@b.co 10.0.0.1", "1 " * 20000, "a." * 20000 + "@b.c" + ".d" * 20000,
]


@pytest.fixture(scope="module")
def model(spark):
    return P.Model(spark)


def luhn(d):
    x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in x) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15])


def test_base_matches_plain_regular_expressions(spark, model):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in P.personal_data(docs(spark, rows), model).collect()}
    for i, t, _ in rows:
        assert [(s.start, s.rank, s.end) for s in got[i].base] == base(t or "")
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].found}
    kinds = {i: [s.kind for s in r.found if s.rank > 3] for i, r in got.items()}
    assert kinds[4] == ["local_phone"] and kinds[5] == ["social_number"] and kinds[6] == [] and kinds[7] == ["spelled_email"]


# Texts written by hand, unlike the samples: what is personal in each, and its kind.
REAL = [
    ("john dot smith at gmail dot com", "spelled_email"), ("Tel: 030 1234567", "local_phone"), ("IBAN DE89 3704 0044 0532 0130 00", "iban"), ("please pay to GB82WEST12345698765432 today", "iban"),
    ("call (212) 555-0187 now", "local_phone"), ("my ssn is 123-45-6789", "social_number"), ("Handy 0171/1234567 ab 18 Uhr", "local_phone"), ("appel au 06 12 34 56 78", "local_phone"), ("born on 12.03.1984 in Kiel", "birth_date"),
    ("DNI 12345678Z de Madrid", "identity"), ("passport no C01X00T47 or AB1234567", "identity"), ("I live at 221 Baker Street now", "address"), ("Wohnt in der Hauptstraße 5, 10115 Berlin", "address"),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 replied", "ip6"), ("account number 12345678901 at the bank", "account"), ("mi teléfono es 612 34 56 78", "local_phone"), ("reach me: maria(arroba)correo.es", "spelled_email"),
    ("phone 555-123-4567", "local_phone"), ("date of birth: 1990-07-21", "birth_date"), ("write to jane [at] mail [dot] com", "spelled_email"),
]
PLAIN = [
    "version 4.10.2 order 12345678", "between 1999-2004 and 2010", "look at home.then go", "results 123 456 789 rows", "ISBN 978-3-16-148410-0", "published 12.03.2019 by us", "at 10:20:30:40 it began", "page 12 34 56 of the log",
    "price 1 200 000 usd", "order AB123456 was sent", "figure 12.34.56 shows", "see section 3.14 15.92", "updated 2020-01-02", "the part 123-45-6789 is out", "invoice 20240102", "a team at work point being", "total 12 500 000",
    "the years 1914 1918", "12 Monkeys Court case version", "build 20230405",
]


def test_every_shape_is_proposed_and_most_are_taken(spark, model):
    rows = [(i, t, "s") for i, t in enumerate([t for t, _ in REAL] + PLAIN)]
    proposed = {r.doc_id: {s.kind for s in r.c} for r in docs(spark, rows).select("doc_id", P.candidates(P.F.col("text")).alias("c")).collect()}
    assert all(kind in proposed[i] for i, (_, kind) in enumerate(REAL))
    found = {r.doc_id: [s.kind for s in r.found] for r in P.personal_data(docs(spark, rows), model).collect()}
    assert sum(found[i] == [kind] for i, (_, kind) in enumerate(REAL)) >= 0.9 * len(REAL)
    assert sum(bool(found[i]) for i in range(len(REAL), len(rows))) <= 1


def test_probabilities_are_those_of_plain_python(spark, model):
    rows = [(i, t, "s") for i, t in enumerate([t for t, _ in REAL] + PLAIN)]
    each = docs(spark, rows).select("text", P.F.explode(P.candidates(P.F.col("text"))).alias("s"))
    each = each.select(P.F.array(*[c.cast("double") for c in P.features(P.F.col("text"), P.F.col("s"))]).alias("f"))
    got = each.select("f", model.probability(P.F.col("f")).alias("p")).collect()
    assert len(got) > len(REAL)
    for r in got:
        assert abs(r.p - model.estimate(r.f)) < 1e-9


def test_figures_of_samples_that_had_no_part_in_the_fit(spark, model):
    assert model.precision >= 0.98 and model.recall >= 0.9


def test_awkward_rows(spark, model):
    assert P.personal_data(clashing(docs(spark)), model).count() == len(ROWS)
    assert P.personal_data(empty(spark), model).collect() == []
