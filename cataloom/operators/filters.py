"""Predicates and filters: search, eligibility, validation rules, gates. Rule tables are arguments; each rule is a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.functions import text
from cataloom.functions.nested import violations


def matches_query(query: str, title: Column, artist: Column, canonical: Column) -> Column:
    """Substring of title, artist or canonical artist, or of the accent-folded artist."""
    q = query.strip().lower()
    tests = [F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in (title, artist, canonical)]
    return tests[0] | tests[1] | tests[2] | text.ascii_fold(artist).contains(q)


def matches_artist(wanted: str, artist: Column, qid: Column, canonical: Column) -> Column:
    """Substring of the artist or of the canonical name, or the identifier itself."""
    w = wanted.strip().lower()
    by_name = F.lower(F.coalesce(artist, F.lit(""))).contains(w) | F.lower(F.coalesce(canonical, F.lit(""))).contains(w)
    return by_name | F.coalesce(F.lower(qid) == w, F.lit(False))


def since_epoch(first_ts: Column, cutoff: str) -> Column:
    """Whether the first event, compared as text, is at the cutoff or later; records without one aren't."""
    return (F.coalesce(first_ts, F.lit("")) != "") & (first_ts >= cutoff)


def reviewed_filter(reviewed: Column, wanted: str) -> Column:
    """yes, no or any."""
    return {"yes": reviewed, "no": ~reviewed, "any": F.lit(True)}[wanted]


def eligibility(derived: Column, resolved: Column, adjudicated: Column, source_ref: Column, plan_version: int) -> Column:
    """Why a record is or isn't in the queue. A retirement holds for its plan version only; an adjudication for good."""
    retired = F.regexp_extract(F.coalesce(source_ref, F.lit("")), r"v(\d+)", 1).try_cast("int")
    return F.when(derived, "derived").when(resolved, "resolved").when(adjudicated, "adjudicated").when(retired >= plan_version, "retired").otherwise("eligible")


def valid_identifier(work_id: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens; no path steps."""
    return F.coalesce(work_id.rlike(r"^[A-Za-z0-9._-]+$") & ~work_id.isin(".", ".."), F.lit(False))


def junk_title(title: Column, artist: Column) -> Column:
    """Empty, a bare number, file-like, or the artist's name."""
    t = F.trim(F.coalesce(title, F.lit("")))
    numbered = t.rlike(r"(?i)^(untitled|img|image|dsc|scan)?[ _-]*\d*$")
    return (t == "") | numbered | t.contains("_") | F.coalesce(F.lower(t) == F.lower(F.trim(artist)), F.lit(False))


def record_rules(title: Column, artist: Column, digest: Column, position: Column, part_of: Column) -> dict[str, Column]:
    """Conditions of violation of a catalogue record."""
    return {
        "title-missing": F.coalesce(F.trim(title), F.lit("")) == "",
        "artist-missing": F.coalesce(F.trim(artist), F.lit("")) == "",
        "digest-malformed": ~F.coalesce(digest.rlike(r"^[0-9a-f]{64}$"), F.lit(False)),
        "position-below-one": position < 1,
        "position-without-series": position.isNotNull() & part_of.isNull(),
    }


def metric_rules(record: Column, required: Sequence[str]) -> dict[str, Column]:
    """Conditions of violation of a metric record held as VARIANT: required fields, success against failure reason, zoned time."""
    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(record, f"$.{name}", kind)

    rules = {f"missing-{name}": field(name, "string").isNull() for name in required}
    success, reason = field("success", "boolean"), F.nullif(F.trim(field("failure_reason", "string")), F.lit(""))
    rules["success-with-reason"] = success & reason.isNotNull()
    rules["failure-without-reason"] = ~success & reason.isNull()
    rules["time-without-zone"] = ~field("timestamp", "string").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    rules["negative-duration"] = field("duration_ms", "double") < 0
    return rules


def with_violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return rows.withColumn("violations", violations({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}))


def glob_to_regex(pattern: Column) -> Column:
    """* stays within a path step, ** doesn't."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))


def select_scoped(scenarios: DataFrame, changed: DataFrame, force_full: bool = False) -> DataFrame:
    """Scenarios (name, patterns) that a changed path (path) touches, and those without patterns."""
    if force_full:
        return scenarios
    scoped = scenarios.where(F.size("patterns") > 0)
    globs = scoped.select("name", F.explode("patterns").alias("glob"))
    # A pattern with a literal first step meets the paths below that step only; the few others are configuration.
    matches = F.regexp_like("path", glob_to_regex(F.col("glob")))
    literal = globs.withColumn("head", F.regexp_extract("glob", r"^([^*?\[/]+)/", 1))
    paths = changed.select("path", F.regexp_extract("path", r"^([^/]+)/", 1).alias("head"))
    exact = literal.where("head <> ''").join(paths, "head").where(matches)
    wide = changed.select("path").join(literal.where("head = ''").select("name", "glob"), matches)
    hit = exact.select("name").union(wide.select("name")).distinct()
    return scoped.join(hit, "name", "left_semi").unionByName(scenarios.where(F.size("patterns") == 0))


def is_commercial(domain: Column, body: Column, blocked: Sequence[str], allowed: Sequence[str], phrases: str) -> Column:
    """A blocked host that isn't excepted, or two commerce phrases in the text."""
    def listed(hosts: Sequence[str]) -> Column:
        out = F.lit(False)
        for host in hosts:
            out = out | (domain == host) | domain.endswith(f".{host}")
        return out

    return ~listed(allowed) & (listed(blocked) | (F.regexp_count(F.lower(F.coalesce(body, F.lit(""))), F.lit(phrases)) >= 2))


def rating_rules(quality: Column, fit: Column, rating: Column, surface: Column, reasons: Column, surfaces: Sequence[str], chips: Sequence[str]) -> dict[str, Column]:
    """Conditions of violation of a rating event."""
    return {
        "quality-range": ~quality.between(1, 10),
        "fit-range": ~fit.between(1, 10),
        "rating-range": ~rating.between(-2, 2),
        "surface-unknown": ~surface.isin(*surfaces),
        "reason-unknown": F.size(F.array_except(reasons, F.array(*[F.lit(c) for c in chips]))) > 0,
        "nothing-rated": quality.isNull() & fit.isNull() & rating.isNull(),
    }


def breaks_identity_invariant(kind: Column, qid: Column, kinds: Sequence[str] = ("crop", "detail", "variant", "rendition")) -> Column:
    """A derived item must not carry an identifier of its own."""
    return F.coalesce(kind.isin(*kinds), F.lit(False)) & qid.isNotNull()


def derivation_title(title: Column, markers: Sequence[str]) -> Column:
    """Whether a parenthesis of the title holds one of the folded markers."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\(([^)]*)\)"), F.lit(1))
    return F.exists(found, lambda m: text.ascii_fold(m).isin(*markers))


def gated_models(registry: DataFrame, decisions: DataFrame, blocked: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Models (model_id, profile, status, lifecycle) with exactly one decision, with evidence, not blocked, current and allowed."""
    single = decisions.withColumn("n", F.count("*").over(Window.partitionBy("profile"))).where("n = 1 AND evidence IS NOT NULL").select("profile", "model_id")
    fit = registry.where(F.col("status").isin(*allowed) & (F.col("lifecycle") == "current"))
    return fit.join(single, ["profile", "model_id"]).join(blocked, "model_id", "left_anti")


def partition_findings(findings: DataFrame, blocking: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Blocking and advisory findings by their kind."""
    hard = F.coalesce(F.col("kind").isin(*blocking), F.lit(False))
    return findings.where(hard), findings.where(~hard)


def fitness(value: Column, fit_at: float, borderline_at: float) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= fit_at, "fit").when(value >= borderline_at, "borderline").otherwise("unfit")


#: Devices that a gate takes; more are an error.
MOST_DEVICES = 1_000


def device_gate(reports: DataFrame, devices: DataFrame, borderline: float = 0.75) -> DataFrame:
    """Each report (w_px, h_px) against each device (device, need_w, need_h); the device table is configuration of a few rows."""
    scale = F.least(F.col("w_px") / F.col("need_w"), F.col("h_px") / F.col("need_h"))
    held = F.collect_list(F.struct("device", "need_w", "need_h"))
    if devices.limit(MOST_DEVICES + 1).count() > MOST_DEVICES:
        raise ValueError(f"a device table has {MOST_DEVICES} rows at most")
    packed = devices.agg(held.alias("devices")).first()["devices"]
    literal = F.array(*[F.struct(F.lit(d["device"]).alias("device"), F.lit(d["need_w"]).alias("need_w"), F.lit(d["need_h"]).alias("need_h")) for d in packed])
    return reports.select("*", F.explode(literal).alias("d")).select("*", "d.device", "d.need_w", "d.need_h").drop("d").withColumn("gate", fitness(scale, 1.0, borderline))


def classify_crop_pair(a_aspect: Column, b_aspect: Column, a_bytes: Column, b_bytes: Column, a_pixels: Column, b_pixels: Column, tolerance: float = 0.02) -> Column:
    """redundant-a, redundant-b, distinct-crop or undecided, by the first rule that decides."""
    same = F.abs(a_aspect - b_aspect) <= tolerance * F.greatest(a_aspect, b_aspect)
    return (
        F.when(a_aspect.isNull() | b_aspect.isNull(), "undecided")
        .when(~same, "distinct-crop")
        .when((a_bytes == b_bytes) & (a_pixels == b_pixels), "redundant-b")
        .when(a_pixels < b_pixels, "redundant-a")
        .when(b_pixels < a_pixels, "redundant-b")
        .otherwise("undecided")
    )


def closest_schema(errors: DataFrame) -> DataFrame:
    """Per document (doc, schema, n_errors): passed if any schema has none, and the schema with the fewest."""
    return errors.groupBy("doc").agg(F.bool_or(F.col("n_errors") == 0).alias("passed"), F.min_by("schema", F.struct("n_errors", "schema")).alias("closest"), F.min("n_errors").alias("n_errors"))


def registry_findings(entries: DataFrame, known: DataFrame, item: str, slot: str, reference: str, due: str, today: Column) -> DataFrame:
    """item, finding: references that aren't known, slots that several items fill (the least is named) and entries past their date."""
    missing = entries.join(known.select(reference).distinct(), reference, "left_anti").select(item, F.lit("missing-reference").alias("finding"))
    doubled = entries.groupBy(slot).agg(F.min(item).alias(item), F.count("*").alias("n")).where("n > 1").select(item, F.lit("duplicate").alias("finding"))
    late = entries.where(F.col(due) < today).select(item, F.lit("overdue").alias("finding"))
    return missing.unionByName(doubled).unionByName(late)


def check_envelopes(envelopes: DataFrame, key: str, required: Sequence[str], versions: Sequence[str], unsafe: Sequence[str]) -> DataFrame:
    """key, violations of JSON envelopes (key, value): missing fields, unknown versions, and keys that must not appear at any depth."""
    record = F.try_parse_json("value")
    rules = {"not-json": record.isNull()}
    rules |= {f"missing-{name}": record.isNotNull() & F.try_variant_get(record, f"$.{name}", "string").isNull() for name in required}
    rules["unknown-version"] = ~F.try_variant_get(record, "$.version", "string").isin(*versions)
    names = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    rules["unsafe-key"] = F.arrays_overlap(F.transform(names, lambda n: F.lower(n)), F.array(*[F.lit(u) for u in unsafe]))
    return with_violations(envelopes, rules).select(key, "violations")
