"""The memory lifecycle as column expressions and joins: triage, units, consolidation, recall, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import numbered, shared_dir, upserted, written
from . import blocks

# The closed vocabularies.
UNIT_TYPES = ("preference", "decision", "procedure", "fact", "learning", "plan", "event", "context")
STATUSES = ("unit_candidate", "active_unit", "crystal_candidate", "crystal", "archived", "superseded", "retracted")
LIVE = ("active_unit", "crystal_candidate", "crystal")
SOURCE_KINDS = ("history_message", "history_event", "document", "relation", "unit", "manual")
ALL_LABELS = ("architecture", "storage", "retrieval", "cli", "testing", "tooling", "workflow", "conventions", "dependencies", "performance", "security")
# Signals of the triage.
EXPLICIT = ("remember", "always", "never", "rule", "decision", "we decided", "use this going forward", "记住", "以后", "规则", "决定")
DURABLE = ("architecture", "schema", "migration", "api contract", "cli", "storage", "retrieval", "fts", "validation gate", "架构", "迁移", "存储", "检索")
FIX = ("error", "failed", "failure", "bug", "fixed", "resolved", "修复", "报错")
FIXED = ("fixed", "resolved", "pass", "green", "修复", "解决")
PROCEDURE = ("step", "first", "then", "verify", "run `", "command", "步骤", "先", "然后")
CORRECTION = ("correction", "actually", "instead", "不是", "纠正", "改成", "更正")
PLAN = ("plan", "todo", "next", "roadmap", "计划", "下一步")
FACT = ("fact:", "fact snapshot", "updated fact", "事实：", "事实:")
PLANNED = ("plan:", "roadmap:", "next step", "计划：", "计划:")
ONGOING = ("always", "never", "以后")
RANGE = ("next", "plan", "下一步")
LABELS = {
    "architecture": ("architecture", "schema", "migration", "架构", "迁移"),
    "storage": ("storage", "sqlite", "database", "存储"),
    "retrieval": ("retrieval", "fts", "query", "检索"),
    "cli": ("cli", "command", "命令"),
    "testing": ("test", "pytest", "eval", "gate", "测试", "验收"),
    "tooling": ("tool", "ruff", "mypy", "uv ", "工具"),
    "workflow": ("workflow", "process", "steps", "流程"),
    "conventions": ("convention", "rule", "style", "约定", "规则"),
    "dependencies": ("dependency", "package", "依赖"),
    "performance": ("performance", "cache", "batch", "latency", "性能"),
    "security": ("secret", "token", "redact", "安全"),
}
# Signals of the consolidation.
CORRECTED = ("correction", "corrected", "updated", "stale", "instead", "更正")
CONTRAST = ("instead of", "rather than", "conflict", "conflicting", "而不是", "冲突")
STRONG = ("correction", "corrected", "stale", "supersede", "更正", "作废")
CONFIRMED = ("user-confirmed", "owner confirmed", "explicitly confirmed")


def plain_any(text: Column, words) -> Column:
    """Whether any of the words is in the text, as one pattern."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def triage(traces: DataFrame, manual: bool = False) -> DataFrame:
    """traces (trace_kind, role, text) with should_extract, reason, importance, confidence, unit_type, temporal_type, labels, hint.

    One projection: the bands are tried in order, on the first 4000 characters.
    """
    names = {"explicit": EXPLICIT, "durable": DURABLE, "fact": FACT, "planned": PLANNED, "fix_word": FIX, "fixed": FIXED, "procedure": PROCEDURE, "correction": CORRECTION, "plan": PLAN}
    window = F.left(F.coalesce("text", F.lit("")), F.lit(4000))
    df = traces.withColumn("lw_t", F.lower(window))
    df = df.withColumn("s", F.struct(*[T.has_any(F.col("lw_t"), w).alias(n) for n, w in names.items()]))
    s = lambda n: F.col(f"s.{n}")
    t, event = F.col("lw_t"), F.col("trace_kind") == "event"
    fix = s("fix_word") & s("fixed")
    band = (
        F.when(F.lit(manual), "manual_intent")
        .when((s("explicit") & F.col("role").isin("user", "developer", "system")) | s("correction"), "explicit_decision_or_rule")
        .when(fix | (s("procedure") & ~event & (s("durable") | s("explicit") | s("fix_word"))), "failure_fix_or_procedure")
        .when(s("durable") & s("explicit"), "durable_change_with_intent")
        .when(s("durable") & s("fact"), "declared_durable_fact")
        .when(s("durable") & s("planned") & ~event, "declared_durable_plan")
        .otherwise("weak_context_only")
    )
    scores = {
        "manual_intent": (0.90, 0.85), "explicit_decision_or_rule": (0.80, 0.75), "failure_fix_or_procedure": (0.65, 0.65), "durable_change_with_intent": (0.65, 0.60),
        "declared_durable_fact": (0.65, 0.60), "declared_durable_plan": (0.55, 0.55), "weak_context_only": (0.35, 0.50),
    }
    score = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in scores.items() for x in (k, v[i])]), F.col("reason"))
    kind = (
        F.when(s("fix_word") & (s("procedure") | fix), F.when(s("procedure"), "procedure").otherwise("learning"))
        .when(s("correction"), "decision")
        .when(plain_any(t, ("preference", "always", "never", "以后")), "preference")
        .when(plain_any(t, ("decision", "we decided", "决定", "记住")), "decision")
        .when(s("procedure"), "procedure")
        .when(fix, "learning")
        .when(s("fact"), "fact")
        .when(s("plan"), "plan")
        .when(s("durable"), "fact")
        .otherwise("context")
    )
    labels = F.filter(F.array(*[F.when(plain_any(t, w), F.lit(n)) for n, w in LABELS.items()]), lambda x: x.isNotNull())
    df = df.withColumn("reason", band).withColumn("labels", labels)
    return df.select(
        *traces.columns, (F.col("reason") != "weak_context_only").alias("should_extract"), "reason", score(0).alias("importance"), score(1).alias("confidence"), kind.alias("unit_type"),
        F.when(plain_any(t, ONGOING), "ongoing").when(plain_any(t, RANGE), "range").otherwise("unknown").alias("temporal_type"),
        F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("workflow"))).alias("labels"), T.first_line(window).alias("hint"),
    )


def activates(has_source: Column, unit_type: Column, confidence: Column, importance: Column, manual: Column) -> Column:
    """Whether a triaged candidate becomes an active unit at once."""
    return has_source & unit_type.isin(*UNIT_TYPES) & (confidence >= 0.5) & ((importance >= 0.45) | manual)


def units_from(triaged: DataFrame) -> DataFrame:
    """Memory units of the traces (trace_kind, trace_id, project, text and triage's columns) that should be extracted."""
    t = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    good = activates(F.lit(True), F.col("unit_type"), F.col("confidence"), F.col("importance"), F.lit(False))
    return triaged.where("should_extract").select(
        "project", "unit_type", F.when(good, "active_unit").otherwise("unit_candidate").alias("status"), F.coalesce(F.nullif("hint", F.lit("")), F.lit("Memory unit")).alias("title"),
        F.left(t, F.lit(1200)).alias("content"), F.concat(F.lit("Extracted from "), F.col("trace_kind"), F.lit(" "), F.col("trace_id")).alias("context"),
        "importance", "confidence", "temporal_type", "labels",
        F.array(F.struct(F.concat(F.lit("history_"), F.col("trace_kind")).alias("source_kind"), F.col("trace_id").alias("source_ref"), F.left(t, F.lit(300)).alias("quote"))).alias("sources"), "trace_id",
    )


def new_units(units: DataFrame, *order: str, blank: str = r"\s") -> DataFrame:
    """Of units with equal type, title, content, context and project (by hash), the first in order; ``blank`` as in content_hash()."""
    h = T.content_hash(*[F.col(c) for c in ("unit_type", "title", "content", "context", "project")], blank=blank)
    w = Window.partitionBy("content_hash").orderBy(*order)
    return units.withColumn("content_hash", h).withColumn("lw_n", F.row_number().over(w)).where("lw_n = 1").drop("lw_n")


def uncovered(units: DataFrame, existing: DataFrame) -> DataFrame:
    """Units none of whose sources is already a source of an existing unit that isn't retracted."""
    keys = lambda df: df.select("*", F.explode("sources").alias("x")).select(*([c for c in ("id", "trace_id") if c in df.columns]), F.concat_ws(":", "x.source_kind", "x.source_ref").alias("k"))
    known = keys(existing.where("status <> 'retracted'")).select("k").distinct()
    taken = keys(units).join(known, "k", "left_semi").select("trace_id").distinct()
    return units.join(taken, "trace_id", "left_anti")


def transitions(units: DataFrame, wanted: DataFrame, command: str = "", first_log_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of units after wanted (id, to_status, superseded_by) as one batch, and the rows of its log.

    wanted may also hold from_status, the status that the unit is expected to
    have, and reason. Raises ValueError, and changes nothing, if a unit or the
    one that supersedes it is missing, a unit supersedes itself, a unit is in
    the batch twice, or one is not in the status that was expected. The log has
    log_id, id, from_status, to_status, command, reason, superseded_by, in
    order of the ids; a unit that already is in the wanted status has no row.
    """
    for c, kind in (("from_status", "string"), ("reason", "string")):
        if c not in wanted.columns:
            wanted = wanted.withColumn(c, F.lit(None).cast(kind))
    now = wanted.join(units.select("id", F.col("status").alias("now"), F.lit(True).alias("there")), "id", "left")
    now = now.join(units.select(F.col("id").alias("superseded_by"), F.lit(True).alias("target")), "superseded_by", "left")
    faults = now.agg(
        F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("superseded_by").isNotNull() & F.col("target").isNull()).alias("lost"), F.count_if(F.col("superseded_by") == F.col("id")).alias("own"),
        F.count_if(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("now"))).alias("moved"), (F.count("*") - F.count_distinct("id")).alias("twice"),
    ).first()
    for name, why in (("missing", "a unit is missing"), ("lost", "a superseding unit is missing"), ("own", "a unit can't supersede itself"), ("moved", "a unit is no longer in the status expected"), ("twice", "a unit is in the batch twice")):
        if faults[name]:
            raise ValueError(why)
    w = wanted.select("id", "to_status", F.col("superseded_by").alias("lw_by"))
    by = F.col("superseded_by") if "superseded_by" in units.columns else F.lit(None).cast("long")
    joined = units.join(w, "id", "left")
    after = joined.select(*[c for c in units.columns if c not in ("status", "superseded_by")], F.coalesce("to_status", "status").alias("status"), F.coalesce("lw_by", by).alias("superseded_by"))
    log = now.where("now <> to_status").select("id", F.col("now").alias("from_status"), "to_status", F.lit(command).alias("command"), "reason", "superseded_by")
    return after, numbered(log, F.col("id"), start=first_log_id - 1, name="log_id").select("log_id", "id", "from_status", "to_status", "command", "reason", "superseded_by")


def covering(sources: DataFrame, units: DataFrame) -> DataFrame:
    """(trace_id, unit_id): of sources (trace_id, source_kind, source_ref) the largest unit, not retracted, that already has one of them."""
    own = units.where("status <> 'retracted'").select(F.col("id").alias("unit_id"), F.explode("sources").alias("s")).select("unit_id", "s.source_kind", "s.source_ref")
    return sources.join(own, ["source_kind", "source_ref"]).groupBy("trace_id").agg(F.max("unit_id").alias("unit_id"))


#: Version of the triage's rules, part of the key of what it found.
GATE = "v2"


def triage_records(triaged: DataFrame, gate: str = GATE) -> DataFrame:
    """Rows of the triage table from triage()'s: one for each trace and version of the rules, not consumed yet."""
    cols = ["trace_kind", "trace_id", "project", "created_at", "should_extract", "reason", "importance", "confidence", "unit_type", "temporal_type", "labels", "hint"]
    return triaged.select(F.lit(gate).alias("gate_version"), *[F.col(c) if c in triaged.columns else F.lit(None).cast("timestamp").alias(c) for c in cols], F.lit(False).alias("consumed"))


TRIAGE_KEY = ("trace_kind", "trace_id", "gate_version")


def triage_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next triage table: new rows replace old ones of the same trace and rules, but what was consumed stays so."""
    return upserted(old, new.select(*old.columns), TRIAGE_KEY, keep_old=["consumed"])


def pending_triage(triage_table: DataFrame, project: str | None = None, gate: str = GATE, limit: int | None = None) -> DataFrame:
    """Rows worth extracting that no one has consumed, in order of kind and trace."""
    rows = triage_table.where(F.col("should_extract") & ~F.col("consumed") & (F.col("gate_version") == gate))
    if project is not None:
        rows = rows.where(F.col("project") == project)
    return rows.orderBy("trace_kind", "trace_id").limit(limit) if limit is not None else rows


def consumed(triage_table: DataFrame, done: DataFrame) -> DataFrame:
    """The triage table with the rows of done (trace_kind, trace_id, gate_version) marked as consumed."""
    hit = done.select(*TRIAGE_KEY).distinct().withColumn("lw_hit", F.lit(True))
    return triage_table.join(hit, list(TRIAGE_KEY), "left").select(*[(F.col("consumed") | F.coalesce("lw_hit", F.lit(False))).alias(c) if c == "consumed" else F.col(c) for c in triage_table.columns])


def rejections(found: DataFrame) -> DataFrame:
    """(reason, n): how often the validator (issues) rejects, by reason."""
    return found.where("rejects").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def scan(units: DataFrame, purpose: str, project: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Units to list (newest first), consolidate (neither archived, superseded nor retracted, oldest first) or distill (live procedures and learnings).

    since compares the time of the last change, else of the making; units
    without either are left out then.
    """
    if project is not None:
        units = units.where(F.col("project") == project)
    if since is not None:
        units = units.where(F.coalesce("updated_at", "created_at") >= since)
    if purpose == "list":
        rows = units.orderBy(F.desc("id"))
    elif purpose == "consolidate":
        rows = units.where(~F.col("status").isin("archived", "superseded", "retracted")).orderBy("id")
    elif purpose == "distill":
        rows = units.where(F.col("unit_type").isin("procedure", "learning") & F.col("status").isin(*LIVE) & F.col("superseded_by").isNull()).orderBy("id")
    else:
        raise ValueError(f"unknown purpose {purpose!r}")
    return rows if limit is None else rows.limit(limit)


def invalid(units: DataFrame) -> DataFrame:
    """(id, reason) of units outside the closed sets: type, status, labels, kinds of sources, empty references."""
    sets = lambda c, words: F.forall(c, lambda x: x.isin(*words))
    rows = F.array(
        F.when(~F.col("unit_type").isin(*UNIT_TYPES), "unknown type"), F.when(~F.col("status").isin(*STATUSES), "unknown status"), F.when(~sets("labels", ALL_LABELS), "unknown label"),
        F.when(~sets(F.transform("sources", lambda s: s["source_kind"]), SOURCE_KINDS), "unknown source kind"), F.when(F.exists("sources", lambda s: ~T.has_text(s["source_ref"])), "empty source reference"),
    )
    return units.select("id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("reason"))


def restored(units: DataFrame, log: DataFrame) -> DataFrame:
    """(id, status): archived units at the status they had before they were last archived, or active_unit."""
    last = log.where("to_status = 'archived'").groupBy("id").agg(F.max_by("from_status", "log_id").alias("before"))
    return units.where("status = 'archived'").join(last, "id", "left").select("id", F.coalesce("before", F.lit("active_unit")).alias("status"))


def independent_sources(sources: DataFrame, *by: str) -> DataFrame:
    """Distinct independent sources of (unit_id, source_kind, source_ref) per unit or other key: sessions, else kind and reference."""
    key = F.when(F.col("source_kind").isin("history_message", "history_event"), F.concat(F.lit("session:"), T.session_key(F.col("source_ref")))).otherwise(F.concat_ws(":", "source_kind", "source_ref"))
    return sources.groupBy(*(by or ("unit_id",))).agg(F.countDistinct(key).alias("n_sources"))


def _body(*columns: str) -> Column:
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def confirmed() -> Column:
    return F.exists("sources", lambda s: s["source_kind"] == "manual") | plain_any(_body("title", "content", "context"), CONFIRMED)


def crystal_policy(n_sources: Column) -> Column:
    """Why a unit is a crystal, or why not: eligible reasons are the middle three."""
    return (
        F.when(F.size("sources") == 0, "no_source").when(confirmed(), "explicit_user_confirmation").when(n_sources >= 3, "independent_source_count>=3")
        .when((F.col("unit_type") == "decision") & (F.col("confidence") >= 0.9) & (F.col("importance") >= 0.8), "high_confidence_decision").otherwise("below_crystal_threshold")
    )


ELIGIBLE = ("explicit_user_confirmation", "independent_source_count>=3", "high_confidence_decision")


def crystal_candidate() -> Column:
    signal = plain_any(_body("title", "content", "context"), ("failure", "failed", "error", "verify")) | (F.size("sources") > 1)
    return F.col("unit_type").isin("procedure", "learning") & signal


def unsupported_claim() -> Column:
    """Whether the quotes (20 characters or more in all) share fewer than two tokens with the content; not for manual sources."""
    quote = F.array_join(F.transform("sources", lambda s: F.coalesce(s["quote"], F.lit(""))), " ")
    quote = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    a, b = T.claim_tokens(F.coalesce("content", F.lit(""))), T.claim_tokens(quote)
    manual = F.exists("sources", lambda s: s["source_kind"] == "manual")
    return ~manual & (F.size(a) > 0) & (F.length(quote) >= 20) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) < 2)


def issues(units: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(id, reason, rejects): what the validator holds against each unit, in rows.

    paths: existing absolute paths (column path); without it no path is stale.
    """
    content = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", "")
    n = F.length(content)
    inside = n.between(3, 4000)
    tokens, title = T.claim_tokens(F.coalesce("content", F.lit(""))), T.claim_tokens(F.coalesce("title", F.lit("")))
    vague = inside & (F.size(tokens) > 0) & (n < 80) & ~T.non_latin(F.coalesce("content", F.lit(""))) & ((F.size(tokens) < 3) | ((F.size(title) > 0) & (F.size(tokens) < F.size(title)) & (F.size(tokens) < 12)))
    refs = F.array_distinct(F.filter(F.transform("sources", lambda s: s["source_ref"]), lambda r: r.isNotNull() & (r != "")))
    strong = F.exists("sources", lambda s: T.has_text(s["quote"])) | (F.size(refs) >= 2)
    some = F.size("sources") > 0
    first = F.min("id").over(Window.partitionBy("project", F.lower(F.regexp_replace("title", r"(?U)^\s+|\s+$", ""))).orderBy("id"))
    agent = F.exists("sources", lambda s: ~s["source_kind"].isin("history_message", "history_event"))
    lack = lambda c: ~T.has_text(F.col(c)) if c in units.columns else F.lit(True)
    kind = F.col("unit_type")
    issue = lambda when, reason, rejects=None: F.when(when, F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(True) if rejects is None else rejects).alias("rejects")))
    rows = F.array(
        issue(~some, "no source"), issue(~inside, "content length out of bounds"), issue(vague, "vague content (insufficient signal)"),
        issue(inside & (n > 1500), F.concat(F.lit("content exceeds crystal budget ("), n.cast("string"), F.lit(" > 1500 chars)"))),
        issue(some & ~strong, "insufficient provenance for crystal (needs a quote or ≥2 sources)"),
        issue(F.col("lw_first") < F.col("id"), F.concat(F.lit("duplicate title also used by "), F.col("lw_first").cast("string"))),
        issue(some & unsupported_claim(), "unsupported claim heuristic"),
        issue(kind.isin("decision", "learning", "procedure") & lack("why"), "decision missing rationale (why)", agent),
        issue(kind.isin("procedure", "plan") & lack("next_step"), "procedure/plan missing next_step", agent),
        issue((kind == "procedure") & lack("how_to_apply"), "procedure missing how_to_apply", agent),
    )
    out = units.withColumn("lw_first", first).select("id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("id", "x.reason", "x.rejects")
    if paths is None:
        return out
    each = units.select("id", F.explode(refs).alias("path")).where("path LIKE '/%'").join(paths, "path", "left_anti")
    return out.unionByName(each.select("id", F.concat(F.lit("stale source path: "), F.col("path")).alias("reason"), F.lit(True).alias("rejects")))


def paired(units: DataFrame) -> DataFrame:
    """What the searches for pairs need of live units, as a written table that all of them share: id, project, unit_type, status, labels, codes, and what the text says.

    Codes are those of the tokens that another unit of the project has too.
    """
    live = units.where(F.col("status").isin(*LIVE)).select("id", "project", "unit_type", "status", "labels", _body("title", "content").alias("body"))
    top, body = shared_dir(units.sparkSession), F.col("body")
    says = {"strong": plain_any(body, STRONG), "contrast": plain_any(body, CONTRAST), "maybe": F.contains(body, F.lit("maybe")), "replaces": plain_any(body, CORRECTED) | (F.contains(body, F.lit("old")) & plain_any(body, ("now", "updated")))}
    live = written(live.withColumn("all", T.claim_tokens(body)).select("*", *[c.alias(n) for n, c in says.items()]).drop("body"), f"{top}/live")
    each = live.select("id", "project", F.explode("all").alias("token"))
    codes = blocks.coded(each.groupBy("project", "token").agg(F.count("*").alias("df")).where("df > 1").select("project", "token"))
    own = each.join(codes, ["project", "token"]).groupBy("id").agg(F.collect_list("code").alias("codes"))
    return written(live.drop("all").join(own, "id"), f"{top}/paired")


def _met(live: DataFrame, left: Column, right: Column, shared_tokens: int, keep, schema: str) -> DataFrame:
    """What keep(x, y, hits) gives for blocks x of the left rows of paired() and y of the right ones, of one project.

    hits is a matrix of booleans, over x's rows and y's: whether they are two
    that share a label and so many tokens.
    """

    def found(x, y):
        import numpy as np

        names = {n: i for i, n in enumerate({n for side in (x, y) for labels in side["labels"] if labels is not None for n in labels})}

        def labelled(side):
            out = np.zeros((len(side), len(names)), "float32")
            for i, labels in enumerate(side["labels"]):
                out[i, [names[n] for n in (() if labels is None else labels)]] = 1
            return out

        a, b, id_y = labelled(x), labelled(y).T, y["id"].to_numpy()
        for k, shared in blocks.Block(y["codes"], kind="float32").scores(x["codes"]):
            rows = x.iloc[k : k + len(shared)]
            yield rows, (shared >= shared_tokens) & (a[k : k + len(shared)] @ b > 0) & (rows["id"].to_numpy()[:, None] != id_y)

    def run(x, y):
        import pandas as pd

        return pd.concat([keep(rows, y, hits) for rows, hits in found(x, y)])

    cols = ["id", "project", "unit_type", "labels", "codes", "contrast", "maybe", "replaces"]
    return blocks.across(live.where(left).select(*cols), live.where(right).select(*cols), run, schema, F.col("project"))


def conflicts(units: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: live units of one project that share a label and three tokens, contrast, and don't correct each other.

    One of the two says the contrast, so pairs start from those that do. live:
    paired(units), if it is at hand.
    """

    def pairs(x, y, hits):
        import numpy as np
        import pandas as pd

        a, b = x["id"].to_numpy(), y["id"].to_numpy()
        i, j = np.nonzero(hits & (~y["contrast"].to_numpy(bool) | (a[:, None] < b)))  # of two that both say it, once
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    plain = (paired(units) if live is None else live).where(~F.col("strong"))
    return _met(plain, F.col("contrast"), F.lit(True), 3, pairs, "a long, b long")


def conflicting(units: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(id): the units that conflicts() has in its pairs, without the pairs."""

    def ids(x, y, hits):
        import numpy as np
        import pandas as pd

        return pd.DataFrame({"id": np.concatenate((x["id"].to_numpy()[hits.any(axis=1)], y["id"].to_numpy()[hits.any(axis=0)]))})

    plain = (paired(units) if live is None else live).where(~F.col("strong"))
    return _met(plain, F.col("contrast"), F.lit(True), 3, ids, "id long").distinct()


def review_pairs(units: DataFrame, similar: DataFrame) -> DataFrame:
    """(a, b): pairs of similar (a, b) of one type that share four tokens with a Jaccard similarity of 0.35 or more.

    The pairs are given, so only their texts are fetched.
    """
    live = units.where(F.col("status").isin(*LIVE)).select("id", "project", "unit_type", "labels", _body("title", "content").alias("body")).withColumn("tokens", T.claim_tokens(F.col("body")))
    live = live.where(~plain_any(F.col("body"), STRONG) & (F.size("tokens") >= 4))
    side = lambda n: live.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("project", "unit_type", "labels", "tokens")])
    both = similar.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where("a_project <=> b_project AND a_unit_type = b_unit_type")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(F.arrays_overlap("a_labels", "b_labels") & (shared >= 4) & (T.jaccard(F.col("a_tokens"), F.col("b_tokens")) >= 0.35)).select("a", "b")


def supersessions(units: DataFrame, in_conflict: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """(id, superseded_by): units and the newest later one that replaces them.

    Either the newer one says so, or it is a decision and the older one a
    maybe. Of each block of newer ones only the newest goes on. live:
    paired(units), if it is at hand.
    """

    def newest(x, y, hits):
        import numpy as np
        import pandas as pd

        a, b = x["id"].to_numpy(), y["id"].to_numpy()
        a_type, b_type = x["unit_type"].to_numpy(object), y["unit_type"].to_numpy(object)
        hits = hits & (b > a[:, None]) & ((a_type[:, None] == b_type) | ((a_type == "plan")[:, None] & (b_type == "decision")))
        hits &= y["replaces"].to_numpy(bool) | (x["maybe"].to_numpy(bool)[:, None] & (b_type == "decision"))
        some = hits.any(axis=1)
        order = np.argsort(-b)
        return pd.DataFrame({"id": a[some], "by": b[order][np.argmax(hits[some][:, order], axis=1)]})

    live = paired(units) if live is None else live
    if in_conflict is not None:
        live = live.join(in_conflict, "id", "left_anti")
    live = live.where(F.col("status").isin("active_unit", "crystal"))
    pairs = _met(live, F.lit(True), F.col("replaces") | (F.col("unit_type") == "decision"), 2, newest, "id long, by long")
    return pairs.groupBy("id").agg(F.max("by").alias("superseded_by"))


def decay(units: DataFrame, as_of: Column) -> DataFrame:
    """(id, action): units past valid_to, archived, or to be reviewed if they are plans or contexts."""
    past = T.parse_stamp(F.col("valid_to")) < as_of
    return units.where(past).select("id", F.when(F.col("unit_type").isin("plan", "context"), "review").otherwise("archive").alias("action"))


def consolidation(units: DataFrame, n_sources: DataFrame, as_of: Column, scores: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, action, reason, superseded_by): one action per unit, by precedence reject, conflict, supersede, decay, promote, candidate, demote.

    scores (id, score): transitions of units that score below the threshold
    are left out; units without a score keep theirs.
    """
    top = shared_dir(units.sparkSession)
    units = written(units, f"{top}/units")
    held = written(issues(units).where("rejects").groupBy("id").agg(F.min("reason").alias("held_for")), f"{top}/held")
    good = units.join(held, "id", "left_anti")
    live = paired(good)
    ids = written(conflicting(good, live), f"{top}/clash")
    df = units.join(n_sources.select(F.col("unit_id").alias("id"), "n_sources"), "id", "left")
    df = df.join(held, "id", "left").join(ids.withColumn("clash", F.lit(True)), "id", "left").join(supersessions(good, ids, live).withColumnRenamed("superseded_by", "by"), "id", "left")
    past = decay(units, as_of).withColumnRenamed("action", "past") if "valid_to" in units.columns else None
    df = df.join(past, "id", "left") if past is not None else df.withColumn("past", F.lit(None).cast("string"))
    df = df.withColumn("policy", crystal_policy(F.coalesce("n_sources", F.lit(0)))).withColumn("likely", crystal_candidate())
    open_ = F.col("status").isin("active_unit", "crystal_candidate")
    action = (
        F.when(F.col("held_for").isNotNull(), "reject").when(F.col("clash"), "conflict").when(F.col("by").isNotNull(), "supersede").when(F.col("past").isNotNull(), F.col("past"))
        .when(open_ & F.col("policy").isin(*ELIGIBLE), "promote").when((F.col("status") == "active_unit") & F.col("likely"), "candidate")
        .when((F.col("status") == "crystal_candidate") & ~F.col("likely"), "demote")
    )
    df = df.withColumn("action", action).where("action IS NOT NULL")
    if scores is not None:
        low = scores.where(F.col("score") < threshold).select("id")
        moved = ["supersede", "archive", "promote", "candidate", "demote"]
        df = df.where(~F.col("action").isin(*moved)).unionByName(df.where(F.col("action").isin(*moved)).join(low, "id", "left_anti"))
    reason = F.when(F.col("action") == "reject", F.col("held_for")).when(F.col("action") == "promote", F.concat(F.lit("crystal policy: "), F.col("policy"))).otherwise(F.col("action"))
    return df.select("id", "action", reason.alias("reason"), F.when(F.col("action") == "supersede", F.col("by")).alias("superseded_by"))


#: Order in which a plan's transitions are applied.
APPLY_ORDER = ("supersede", "archive", "promote", "candidate", "demote")


def recall_score(relevance: Column, importance: Column, confidence: Column, recency: Column, crystal: Column) -> Column:
    """relevance * importance * confidence * recency, half as much again for crystals."""
    return relevance * F.greatest(importance, F.lit(0.0)) * F.greatest(confidence, F.lit(0.0)) * recency * F.when(crystal, 1.5).otherwise(1.0)


def export_section() -> Column:
    """The section of a written memory file in which a unit belongs; the first that fits."""
    kind = F.col("unit_type")
    return (
        F.when(F.arrays_overlap("labels", F.array(F.lit("security"), F.lit("performance"))) | unsupported_claim(), "Gotchas")
        .when(kind == "decision", "Architecture decisions")
        .when(kind.isin("preference", "procedure") | F.array_contains("labels", "conventions"), "Rules / Conventions")
        .when(kind.isin("fact", "learning"), "Discovered durable knowledge")
        .otherwise("Other")
    )
