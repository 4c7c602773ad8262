"""Column functions on text: redaction, normalisation, tokens, excerpts, hashes. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
# The patterns of secrets, in order, and whether group 1 stays.
SECRETS = (
    (r"\bsk-[A-Za-z0-9_-]{8,}", False),
    (r"\bsk-ant-[A-Za-z0-9_-]{8,}", False),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", False),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", False),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", False),
    (r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", False),
    (r"\bAKIA[0-9A-Z]{16}\b", False),
    (r"\bAIza[0-9A-Za-z_-]{30,}", False),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", False),
    (r"(?i)\b([A-Z0-9_]*(?:API_?KEY|TOKEN|SECRET|PASSWORD|CREDENTIALS?)[A-Z0-9_]*\s*[=:]\s*)(['\"]?)[^\s'\"]{8,}\2", True),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", False),
    (r"(?i)\b(authorization\s*:\s*bearer\s+)[A-Za-z0-9._~+/=-]{8,}", True),
)

# Synonyms of predicates.
PREDICATES = {
    "develop": "develops",
    "developed": "develops",
    "developing": "develops",
    "creates": "develops",
    "create": "develops",
    "created": "develops",
    "creating": "develops",
    "authored": "develops",
    "authors": "develops",
    "wrote": "develops",
    "writes": "develops",
    "use": "uses",
    "used": "uses",
    "using": "uses",
    "utilizes": "uses",
    "utilize": "uses",
    "utilized": "uses",
    "employs": "uses",
    "employ": "uses",
    "build": "builds",
    "built": "builds",
    "building": "builds",
    "constructs": "builds",
    "construct": "builds",
    "constructed": "builds",
    "is based on": "based_on",
    "based on": "based_on",
    "relies on": "based_on",
    "rely on": "based_on",
    "relies upon": "based_on",
    "built on": "based_on",
    "built upon": "based_on",
    "integrate": "integrates",
    "integrated": "integrates",
    "integrating": "integrates",
    "powers": "powers",
    "powered by": "powered_by",
    "power": "powers",
    "part of": "part_of",
    "is part of": "part_of",
    "belongs to": "part_of",
    "belongs_to": "part_of",
    "member of": "part_of",
    "component of": "part_of",
    "depends on": "depends_on",
    "depend on": "depends_on",
    "dependent on": "depends_on",
    "requires": "depends_on",
    "require": "depends_on",
    "works at": "works_at",
    "work at": "works_at",
    "worked at": "works_at",
    "employed by": "works_at",
    "employed at": "works_at",
    "leads": "leads",
    "lead": "leads",
    "led": "leads",
    "manages": "leads",
    "manage": "leads",
    "managed": "leads",
    "heads": "leads",
    "head": "leads",
    "开发": "develops",
    "创建": "develops",
    "创造": "develops",
    "使用": "uses",
    "用": "uses",
    "利用": "uses",
    "基于": "based_on",
    "依赖": "depends_on",
    "集成": "integrates",
    "整合": "integrates",
    "构建": "builds",
    "搭建": "builds",
    "属于": "part_of",
    "是…的一部分": "part_of",
    "管理": "leads",
    "领导": "leads",
}


def redact(text: Column) -> Column:
    """Every secret replaced by a mark; the name and separator of an assignment stay. Null stays null."""
    for pattern, keep in SECRETS:
        text = F.regexp_replace(text, "(?U)" + pattern, ("$1" if keep else "") + MARK)
    return text


def byte_cap(text: Column, most: int = 16384) -> tuple[Column, Column]:
    """The longest prefix of whole characters within so many UTF-8 bytes, and whether anything was cut.

    Where the cut falls is told by the last bytes before it: a leading byte
    there says how many more belong to its character.
    """
    raw = F.encode(text, "UTF-8")
    tail = F.hex(F.substring(raw, max(most - 2, 1), min(most, 3)))  # two digits for each byte
    lone = F.when(tail.rlike("[C-F].$"), 1).when(tail.rlike("[EF].[89AB].$"), 2).when(tail.rlike("F.[89AB].[89AB].$"), 3).otherwise(0)
    over = F.octet_length(text) > most
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(most) - lone), "UTF-8")
    return F.when(over, cut).otherwise(text), F.coalesce(over, F.lit(False))


def normalize_name(name: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def normalize_predicate(predicate: Column, synonyms: dict[str, str]) -> Column:
    """normalize_name, then its synonym if it has one."""
    name = normalize_name(predicate)
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name) if pairs else name


# Ranges of characters that count as one token each.
WIDE_RANGES = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x3000, 0x303F),
    (0xFF00, 0xFFEF),
    (0x3041, 0x309F),
    (0x30A0, 0x30FF),
    (0xAC00, 0xD7AF),
)
#: The same as a character class, for Java's and RE2's patterns.
WIDE = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in WIDE_RANGES) + "]"


def est_tokens(text: Column) -> Column:
    """Estimated tokens: one for each wide character, one for each four others, rounded up."""
    rest = F.length(F.regexp_replace(text, WIDE, ""))
    return (F.length(text) - rest + F.ceil(rest / 4)).cast("long")


def claim_tokens(text: Column) -> Column:
    """The set of words of four characters or more, in lower case, underscores as spaces."""
    words = F.split(F.translate(F.lower(text), "_", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))


def distill_tokens(text: Column) -> Column:
    return claim_tokens(F.regexp_replace(text, r"[-./]+", " "))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection by the size of the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


#: Keywords that count only as whole words.
WHOLE_WORDS = ("resolved", "decision")


def has_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword is in the text, as one pattern."""
    return text.rlike("(?U)" + "|".join(rf"\b{k}\b" if k in WHOLE_WORDS else rf"\Q{k}\E" for k in keywords))


def first_line(text: Column, most: int = 200) -> Column:
    """The first line that isn't blank, trimmed, at most so many characters."""
    line = F.regexp_extract(text, r"(?U)^\s*([^\n\r]*)", 1)
    return F.left(F.regexp_replace(line, r"(?U)\s+$", ""), F.lit(most))


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def non_latin(text: Column) -> Column:
    return text.rlike(r"[^\x{0}-\x{2FF}]")


def contains_cjk(text: Column) -> Column:
    return text.rlike(r"[㐀-鿿]")


def session_key(ref: Column) -> Column:
    """The session part of a record id."""
    return F.when(F.contains(ref, F.lit(":msg:")), F.substring_index(ref, ":msg:", 1)).when(F.contains(ref, F.lit(":evt:")), F.substring_index(ref, ":evt:", 1)).otherwise(ref)


def synthesized_id(role: Column, stamp: Column, text: Column) -> Column:
    """Sixteen hex digits of the digest of role, time ("None" if null) and the first 256 characters."""
    return F.left(F.sha2(F.concat_ws("\u0000", role, F.coalesce(stamp, F.lit("None")), F.left(text, F.lit(256))), 256), F.lit(16))


def content_hash(unit_type: Column, title: Column, content: Column, context: Column, project: Column, blank: str = r"\s") -> Column:
    """Digest of a memory unit's trimmed, case-folded fields; ``blank`` is the pattern of a character that is trimmed."""
    clean = [F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)^(?:{blank})+|(?:{blank})+\z", "")) for c in (unit_type, title, content, context, project)]
    return F.sha2(F.concat_ws("\n", *clean), 256)


def recency(stamp: Column, as_of: Column, days: float = 30.0) -> Column:
    """1 / (1 + age in days / days), and 1 for a null or future time."""
    age = (F.unix_micros(as_of) - F.unix_micros(stamp)) / (86400.0 * 1e6)
    return F.coalesce(1.0 / (1.0 + F.greatest(age, F.lit(0.0)) / days), F.lit(1.0))


def evolved_confidence(confidence: Column, new_sources: Column, step: float = 0.05, cap: float = 0.95) -> Column:
    return F.when(new_sources <= 0, confidence).otherwise(F.greatest(confidence, F.least(F.lit(cap), confidence + step * new_sources)))


def parse_stamp(text: Column) -> Column:
    """Timestamp of ISO text (UTC unless it says otherwise); null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def since_bound(value: str | None, as_of: str) -> str | None:
    """The moment that a window (``30d``, ``4w``, ``12h``) before as_of, or an ISO time, stands for; ValueError for anything else."""
    import re
    from datetime import datetime, timedelta

    if value is None:
        return None
    span = re.fullmatch(r"(\d+)([dwh])", value)
    if span is None:
        datetime.fromisoformat(value)
        return value
    days = timedelta(**{{"d": "days", "w": "weeks", "h": "hours"}[span[2]]: int(span[1])})
    return (datetime.fromisoformat(as_of) - days).isoformat(timespec="seconds")


def payload_locator(source_ref: Column, external_id: Column, ordinal: Column | None = None) -> Column:
    """How to find a record in its log, as JSON: the log, the record's id there, and an event's number (if it has one)."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    parts = [F.lit('{"source_ref": '), quoted(source_ref), F.lit(', "external_id": '), quoted(external_id)]
    if ordinal is not None:
        parts.append(F.coalesce(F.concat(F.lit(', "ordinal": '), ordinal.cast("string")), F.lit("")))
    return F.concat(*parts, F.lit("}"))


def norm(v: Column) -> Column:
    """The Euclidean norm of a vector in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """Cosine of two vectors in double precision; 0 if a norm is 0, null if lengths differ. norms: theirs, if they are at hand."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    m, n = norms or (norm(a), norm(b))
    return F.when(F.size(a) == F.size(b), F.when((m > 0) & (n > 0), dot / (m * n)).otherwise(0.0))


def provenance_tag(project: Column, path: Column, section: Column, date: Column) -> Column:
    """``project path ## section date`` of what is there, or ``unknown``."""
    some = lambda c: F.nullif(c, F.lit(""))
    tag = F.concat_ws(" ", some(project), some(path), F.concat(F.lit("## "), some(section)), some(date))
    return F.coalesce(some(tag), F.lit("unknown"))


# Words that anchor nothing.
STOP_WORDS = (
    "about after are and core does for have into its main part projects project their the use uses using what which with"
).split()


def anchor_terms(text: Column, stop: Sequence[str] = tuple(STOP_WORDS), most: int = 24) -> Column:
    """Words of three characters or more without stop-words, once each in order."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9_#.+/-]+"), F.lit(0))
    words = F.transform(raw, lambda w: F.regexp_replace(w, r"^[._/-]+|[._/-]+$", ""))
    return F.slice(F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, stop))), 1, most)


def cjk_terms(text: Column, least: int = 2, longest: int = 4, most: int = 96) -> Column:
    """n-grams of each run of CJK characters, longest first, once each in order."""
    runs = F.regexp_extract_all(text, F.lit(r"[㐀-鿿]+"), F.lit(0))

    def grams(r: Column, k: int) -> Column:
        at = F.when(F.length(r) >= k, F.sequence(F.lit(1), F.greatest(F.length(r) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(r, i, F.lit(k)))

    each = F.transform(runs, lambda r: F.concat(*[grams(r, k) for k in range(longest, least - 1, -1)]))
    return F.slice(F.array_distinct(F.flatten(each)), 1, most)


def maximal_match_score(text: Column, terms: Column) -> Column:
    """Sum of lengths of the terms in the text that are in no longer matched term."""
    hit = F.filter(terms, lambda t: F.contains(text, t))
    top = F.filter(hit, lambda t: ~F.exists(hit, lambda o: (F.length(o) > F.length(t)) & F.contains(o, t)))
    return F.aggregate(top, F.lit(0), lambda s, t: s + F.length(t))


#: Accents that the word index folds.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def index_words(text: Column) -> Column:
    """All words of a text as the word index has them: runs of letters and digits, case and accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), *ACCENTS), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
