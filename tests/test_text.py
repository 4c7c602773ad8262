import re

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import chunk, excerpt


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


SECRETS = [
    "sk-abcdefghij and sk-ant-abcdefgh", "ghp_" + "a" * 20, "xoxb-1234567890-a", "sk_live_" + "A1" * 8, "AKIA" + "A" * 16, "AIza" + "x" * 32, "eyJabcdefghijk.abcdefghijk.abcdefghijk",
    "OPENAI_API_KEY=abcdefgh12", "token: 'quoted value here'", "password = \"longenough\" next", "my_secret=short", "Authorization: Bearer abcdefgh.ijk", None, "", "plain text",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "令牌 TOKEN=密码密码密码密码密",
]


def test_redaction_matches_plain_patterns(spark):
    def plain(t):
        for p, keep in T.SECRETS:
            t = re.sub(p, (r"\g<1>" if keep else "") + T.MARK, t)
        return t

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "i int, t string").select("i", T.redact(F.col("t")).alias("r")).collect()
    for i, r in rows:
        assert r == (None if SECRETS[i] is None else plain(SECRETS[i]))


@pytest.mark.parametrize("n", range(1, 14))
def test_byte_cap_cuts_between_characters(spark, n):
    text = "aé漢😀b"
    value, cut = T.byte_cap(F.col("t"), n)
    r = one(spark, text, value.alias("v"), cut.alias("c"))
    want = text.encode()[:n].decode(errors="ignore")
    assert (r.v, r.c) == (want, len(text.encode()) > n)


def test_names_tokens_and_lines(spark):
    r = one(spark, "  A　 B\t c ", T.normalize_name(F.col("t")).alias("n"), T.est_tokens(F.lit("漢字ab c")).alias("e"), T.first_line(F.lit("\n \n  x y \nz")).alias("f"), T.claim_tokens(F.lit("Foo_barz abc  ABCD abcd")).alias("c"))
    assert (r.n, r.e, r.f, r.c) == ("a b c", 3, "x y", ["barz", "abcd"])
    r = one(spark, "Developed", T.normalize_predicate(F.col("t"), T.PREDICATES).alias("p"), T.session_key(F.lit("k:s:msg:1")).alias("a"), T.session_key(F.lit("k:s:evt:1:x")).alias("b"), T.session_key(F.lit("doc")).alias("c"))
    assert tuple(r) == ("develops", "k:s", "k:s", "doc")


def test_tags_scores_and_vectors(spark):
    none = F.lit(None).cast("string")
    tags = [T.provenance_tag(F.lit("p"), F.lit("f.md"), F.lit("S"), F.lit("2024-01-01")), T.provenance_tag(none, none, none, none), T.provenance_tag(F.lit(""), F.lit("f"), none, none)]
    assert tuple(one(spark, "", *tags)) == ("p f.md ## S 2024-01-01", "unknown", "f")
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert tuple(one(spark, "", T.cosine(a, a).alias("x"), T.cosine(a, F.array(F.lit(0.0), F.lit(0.0))).alias("y"), T.cosine(a, F.array(F.lit(1.0))).alias("z"))) == (1.0, 0.0, None)
    assert tuple(one(spark, "", T.evolved_confidence(F.lit(0.9), F.lit(3)).alias("x"), T.evolved_confidence(F.lit(0.97), F.lit(1)).alias("y"))) == (0.95, 0.97)


def test_cjk_terms_and_scores(spark):
    terms = T.cjk_terms(F.lit("苏轼词 a 宋代"))
    r = one(spark, "", terms.alias("t"), T.maximal_match_score(F.lit("苏轼词人 宋"), terms).alias("s"), T.contains_cjk(F.lit("abc")).alias("n"))
    assert (r.t, r.s, r.n) == (["苏轼词", "苏轼", "轼词", "宋代"], 3, False)


def test_chunks():
    text = "intro\r\n\r\n## A\nbody\n```\n## not a heading\n\nstill\n```\n## B\n"
    assert chunk.chunks(text) == [(None, "intro"), ("A", "body\n```\n## not a heading\n\nstill\n```"), ("B", "")]
    assert chunk.chunks("") == [(None, "")]
    long = "\n\n".join("x" * 40 for _ in range(5))
    assert [t for t, _ in chunk.chunks("## T\n" + long, 20)] == ["T (1/3)", "T (2/3)", "T (3/3)"]
    assert chunk.chunks("## T\n" + long, 0) == [("T", long)]
    assert [t for t, _ in chunk.chunks(long, 20)] == ["(1/3)", "(2/3)", "(3/3)"]


def excerpt_of(spark, text, how):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, content string")
    got = {r.id: r.excerpt for r in how(df).collect()}
    assert got[2] == got[3] == ""
    return got[1]


def test_excerpts(spark):
    text = "a " * 2000 + "needle " + "b " * 2000
    of = lambda anchors, t: excerpt_of(spark, t, lambda df: excerpt.lexical(df, anchors))
    out = of(["needle"], text)
    assert out.startswith("[excerpt]\n") and "needle" in out and len(out) < 1100
    assert out == "[excerpt]\n" + text[4000 - 320 : 4006 + 680].strip()
    assert of(["needle"], "short needle") == "short needle"
    assert of([], text) == text and of(["zzz"], text) == text


def test_excerpt_takes_the_richest_window_then_one_that_adds(spark):
    gap = "x " * 1000
    text = f"Pin first {gap}pin and Needle here {gap}{gap}thread far {gap}needle again"
    out = excerpt_of(spark, text, lambda df: excerpt.lexical(df, ["pin", "needle", "thread"]))
    parts = out.removeprefix("[excerpt]\n").split("\n...\n")
    assert len(parts) == 2 and "pin and Needle here" in parts[0] and "thread far" in parts[1]
    near = "x " * 150
    out = excerpt_of(spark, f"{gap}pin {near}{near}{near}needle {gap}{gap}", lambda df: excerpt.lexical(df, ["pin", "needle"]))
    assert out.count("...") == 0 and "pin" in out and "needle" in out


def test_plug_ins(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, content string")

    def extract(t):
        if t == "bad":
            raise ValueError("no")
        return {"entities": [{"name": t, "type": "X", "description": ""}], "relations": []}

    got = {r.id: r for r in chunk.extracted(docs, extract).collect()}
    assert got[1].entities[0].name == "good" and got[1].error is None and got[2].error == "ValueError: no"
    v = chunk.embedded(docs.selectExpr("content AS text"), lambda ts: [chunk.hashed_embedding(t) for t in ts]).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in v) and len(v) == 2


def test_cjk_excerpts(spark):
    filler = "无关的句子在这里。" * 80
    text = filler + "苏轼是宋代的词人。" + filler
    of = lambda question, t: excerpt_of(spark, t, lambda df: excerpt.cjk(df, question))
    out = of("宋代词人", text)
    assert out.startswith("\n\n[excerpt]\n...") and "苏轼是宋代的词人。" in out and len(out) < len(text) / 2
    assert of("宋代", "短文宋代") == "短文宋代" and of("english", text) == text.strip()
    assert "current phase" in of("当前阶段是什么", filler + "The current phase is three." + filler)
    assert excerpt.cjk_anchors("苏轼词 a 宋代") == ["苏轼词", "苏轼", "轼词", "宋代"]


def test_wide_characters_are_the_same_everywhere(spark):
    from lorewell.functions.text import WIDE_RANGES

    odd = "".join(chr(c) for a, b in WIDE_RANGES for c in (a - 1, a, b, b + 1)) + "\u1100\u2e80\ufe30\u3131\u32c0\U00030000"
    r = one(spark, odd, T.est_tokens(F.col("t")).alias("n"))
    assert r.n == chunk.est_tokens(odd) and one(spark, "\u1100\u2e80\ufe30\u3131", T.est_tokens(F.col("t")).alias("n")).n == 1


def test_byte_cap_keeps_real_replacement_marks(spark):
    for t in ("a\ufffd" * 3, "é" * 9, "\U0001f600" * 5, "漢字" * 4, "ab\ufffd\ufffd\ufffd"):
        for n in range(1, 20):
            value, _ = T.byte_cap(F.col("t"), n)
            assert one(spark, t, value.alias("v")).v == t.encode()[:n].decode(errors="ignore")
