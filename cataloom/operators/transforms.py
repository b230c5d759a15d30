"""Batch passes over records: scan, eligible, infer, apply, account. One template; each pass gives predicate and inference.

A pass returns the changed records and what became of every record, so that counts in and out can be reconciled. A limit
counts attempted records, in key order, before anything costly runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cataloom.functions import text
from cataloom.functions.nested import append_event, blank_to_null


@dataclass(frozen=True)
class Pass:
    """name: op of the event; eligible: predicate; infer: adds `inferred` and `reason`; field: what is set."""

    name: str
    eligible: Column
    infer: Callable[[DataFrame], DataFrame]
    field: str


def run_pass(records: DataFrame, plan: Pass, key: str, now: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records after the pass, and (key, outcome, reason) of all of them: not-eligible, not-attempted, applied or unresolved."""
    eligible = records.where(F.coalesce(plan.eligible, F.lit(False)))
    attempted = eligible.orderBy(key).limit(limit) if limit is not None else eligible
    inferred = plan.infer(attempted).select(key, "inferred", "reason")
    marks = records.select(key, F.coalesce(plan.eligible, F.lit(False)).alias("__eligible"))
    tried = attempted.select(key, F.lit(True).alias("__tried"))
    status = marks.join(tried, key, "left").join(inferred, key, "left")
    outcome = F.when(~F.col("__eligible"), "not-eligible").when(F.col("__tried").isNull(), "not-attempted").when(F.col("inferred").isNotNull(), "applied").otherwise("unresolved")
    outcomes = status.select(key, outcome.alias("outcome"), "reason")
    changed = records.join(inferred.where("inferred IS NOT NULL").select(key, "inferred"), key, "left")
    hit = F.col("inferred").isNotNull()
    if "history" in records.columns:
        event = append_event(F.col("history"), F.lit(now), F.lit("engine"), F.lit(plan.name), F.col("inferred").cast("string"))
        changed = changed.withColumn("history", F.when(hit, event).otherwise(F.col("history")))
    changed = changed.withColumn(plan.field, F.when(hit, F.col("inferred")).otherwise(F.col(plan.field)))
    return changed.drop("inferred"), outcomes


def pass_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def adopt_single_creator(works: DataFrame, claims: DataFrame, identities: DataFrame) -> DataFrame:
    """work_id, creator_qid, display_name, outcome for works that one creator claim names. claims: (work_qid, creator_qid)."""
    per_work = claims.distinct().groupBy("work_qid").agg(F.count("*").alias("n"), F.min("creator_qid").alias("creator_qid"))
    joined = works.join(per_work, "work_qid", "left").join(identities, "creator_qid", "left")
    named = text.ascii_fold(F.col("artist")).contains(text.ascii_fold(F.col("display_name"))) & (text.ascii_fold(F.col("display_name")) != "")
    outcome = F.when(F.col("n").isNull(), "no-claim").when(F.col("n") > 1, "several").when(F.coalesce(named, F.lit(False)), "already-named").otherwise("adopted")
    return joined.select("work_id", "creator_qid", "display_name", outcome.alias("outcome"))


def reciprocal_links(links: DataFrame) -> DataFrame:
    """a, b of links (owner, held) that go both ways: both are to be cut, or neither."""
    back = links.select(F.col("owner").alias("held"), F.col("held").alias("owner"))
    return links.where("owner < held").join(back, ["owner", "held"], "left_semi").select(F.col("owner").alias("a"), F.col("held").alias("b")).distinct()


def fold_unknown_keys(entry: Column, note: Column, known: Sequence[str]) -> tuple[Column, Column]:
    """A map without the unknown keys, and the note with them as key=value."""
    strange = F.map_filter(entry, lambda k, _: ~k.isin(*known))
    parts = F.transform(F.array_sort(F.map_keys(strange)), lambda k: F.concat_ws("=", k, F.try_element_at(strange, k)))
    return F.map_filter(entry, lambda k, _: k.isin(*known)), F.concat_ws("; ", blank_to_null(note), F.nullif(F.array_join(parts, "; "), F.lit("")))


def not_yet_applied(findings: DataFrame, applied: DataFrame, marker: str) -> DataFrame:
    return findings.join(applied.select(marker).distinct(), marker, "left_anti")


def upsert_runs(history: DataFrame, new: DataFrame, key: str = "run_id", order: Sequence[str] = ("run_number", "run_id")) -> DataFrame:
    """history with the rows of new in place of those with the same key, in order."""
    kept = history.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def alignment(tasks: DataFrame, infrastructure: Sequence[str]) -> DataFrame:
    """score per group: tenfold share of commits that share a word with the criteria, or are about infrastructure with two foreign words at most. tasks: group, criteria, commit."""
    def words(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(c, "_", " ")), F.lit(r"[a-z]{4,}"), F.lit(0)))

    w = tasks.select("group", words("criteria").alias("want"), words("commit").alias("did"))
    infra = F.array(*[F.lit(x) for x in infrastructure])
    foreign = F.size(F.array_except(F.array_except("did", "want"), infra))
    aligned = F.arrays_overlap("did", "want") | (F.arrays_overlap(F.col("did"), infra) & (foreign <= 2))
    return w.groupBy("group").agg((F.avg(aligned.cast("double")) * 10).alias("score"), F.count("*").alias("n"))


def near_duplicate_lines(lines: DataFrame, group: str, order: str, line: str, least: float) -> DataFrame:
    """lines (group, order, line) with `duplicate`: whether an earlier kept line of the group has the same words, or nearly so.

    Whether a line is kept depends on those kept before it, so a group, which is one document's list, is read in order."""
    import pandas as pd

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        held: list[set[str]] = []
        flags = []
        for value in rows[line]:
            words = set("".join(c if c.isalnum() else " " for c in (value or "").lower()).split())
            known = any(words == h or (words | h and len(words & h) / len(words | h) >= least) for h in held)
            flags.append(known)
            if not known:
                held.append(words)
        return rows.assign(duplicate=flags)

    return lines.groupBy(group).applyInPandas(keep, StructType([*lines.schema.fields, StructField("duplicate", BooleanType())]))


def grouped_jobs(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, jobs: names of the jobs whose slug a rule's prefix starts, or the rule's fallback. rules: (rule, prefix, fallback)."""
    # Names repeat and prefixes have few lengths: each distinct name is cut to those lengths only, and the cut names meet
    # the rules by equality, so that no job is held against every rule. Neither side is broadcast: the size that a plan
    # expects of the cut names is that of the file, which may be a small part of theirs.
    lengths = rules.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    slugged = jobs.where("job IS NOT NULL").select("job").distinct().select("job", F.regexp_replace(F.lower("job"), "[^a-z0-9]+", "-").alias("slug"))
    prefixes = slugged.join(F.broadcast(lengths)).select("job", "slug", F.explode("lengths").alias("n")).where(F.length("slug") >= F.col("n")).select("job", F.expr("left(slug, n)").alias("prefix"))
    hit = prefixes.join(rules.select("rule", "prefix").hint("merge"), "prefix").groupBy("rule").agg(F.array_sort(F.collect_set("job")).alias("jobs"))
    return rules.join(hit.hint("merge"), "rule", "left").select("rule", F.coalesce("jobs", F.array("fallback")).alias("jobs"))


def tag_state(actions: DataFrame) -> DataFrame:
    """work_id, tag, state after the last action: confirm, reject, add, reset."""
    last = actions.groupBy("work_id", "tag").agg(F.max_by("action", F.struct("ts", "row_id")).alias("action"))
    state = F.when(F.col("action").isin("confirm", "add"), "confirmed").when(F.col("action") == "reject", "rejected").otherwise("proposed")
    return last.select("work_id", "tag", state.alias("state"))


def policy_tags(scores: DataFrame, rules: DataFrame, margin: float) -> DataFrame:
    """work_id, tag of threshold rules, and of contrastive ones that beat all their negatives by a margin. scores: (work_id, label, score); rules: (tag, positive, negatives, threshold)."""
    positive = scores.join(rules, scores["label"] == F.col("positive")).select("work_id", "tag", "score", "negatives", "threshold")
    passed = positive.where(F.col("score") >= F.col("threshold"))
    rivals = passed.select("work_id", "tag", F.explode_outer("negatives").alias("label")).join(scores.withColumnRenamed("score", "rival"), ["work_id", "label"], "left").groupBy("work_id", "tag").agg(F.max("rival").alias("rival"))
    return passed.join(rivals, ["work_id", "tag"]).where(F.col("rival").isNull() | (F.col("score") > F.col("rival") + margin)).select("work_id", "tag", "score")


def fill_identities(records: DataFrame, identities: DataFrame) -> DataFrame:
    """records (artist_qid, display_name, lifespan, ...) whose empty name and lifespan come from identities by QID, with filled: whether any did."""
    known = identities.select(F.col("qid").alias("artist_qid"), F.col("display_name").alias("__name"), F.col("lifespan").alias("__span"))
    joined = records.join(known, "artist_qid", "left")
    name, span = F.coalesce(blank_to_null(F.col("display_name")), "__name"), F.coalesce(blank_to_null(F.col("lifespan")), "__span")
    filled = ~name.eqNullSafe(blank_to_null(F.col("display_name"))) | ~span.eqNullSafe(blank_to_null(F.col("lifespan")))
    return joined.withColumn("__filled", filled).withColumn("display_name", name).withColumn("lifespan", span).withColumn("filled", F.col("__filled")).drop("__name", "__span", "__filled")


def complete_fields(records: DataFrame, candidates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """records with empty fields set from candidates (key, field, value, tier), the least tier first, and completed: which were set, in the order of fields."""
    best = candidates.where(F.col("field").isin(*fields)).groupBy(key, "field").agg(F.min_by("value", F.struct("tier", "value")).alias("value"))
    per_record = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__found"))
    joined = records.join(per_record, key, "left")
    sets = [F.when(blank_to_null(F.col(f)).isNull() & F.try_element_at("__found", F.lit(f)).isNotNull(), F.lit(f)) for f in fields]
    joined = joined.withColumn("completed", F.array_compact(F.array(*sets)))
    return joined.select(*[F.coalesce(blank_to_null(F.col(c)), F.try_element_at("__found", F.lit(c))).alias(c) if c in fields else F.col(c) for c in [*records.columns, "completed"]])


def creator_status(kind: Column, qid: Column, decided_version: Column, version: int) -> Column:
    """resolved, settled, retired, due or reopened: persons without an identifier are due; a decision of an earlier version is open again; other kinds are settled."""
    return F.when(qid.isNotNull(), "resolved").when(kind != "person", "settled").when(decided_version.isNull(), "due").when(decided_version < version, "reopened").otherwise("retired")


def finalized(records: DataFrame, now: str) -> DataFrame:
    """records (title, body, width, height, history) with digest, size, dimensions and identifier computed anew, and an event that says so."""
    digest = F.sha2("body", 256)
    event = append_event(F.col("history"), F.lit(now), F.lit("engine"), F.lit("finalize"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))
    return records.select("*", digest.alias("sha256"), F.octet_length("body").cast("long").alias("size_bytes"), F.array("width", "height").alias("dimensions_px"), text.work_identifier(digest, F.col("title")).alias("work_id")).withColumn("history", event)


def merged_tags(existing: DataFrame, proposed: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """work_id, tag, state, source after a merge: what a person has decided stays; else the source of highest precedence wins. Both: work_id, tag, state, source."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col("source")), F.lit(0)), F.lit(len(precedence) + 1))
    old = existing.withColumn("__rank", F.when(F.col("state").isin("confirmed", "rejected"), 0).otherwise(rank)).withColumn("__new", F.lit(0))
    both = old.unionByName(proposed.withColumn("__rank", rank).withColumn("__new", F.lit(1)))
    best = F.min_by(F.struct("state", "source"), F.struct("__rank", "__new", "source"))
    return both.groupBy("work_id", "tag").agg(best.alias("b")).select("work_id", "tag", "b.state", "b.source")


def awaits_dossier(categories: Sequence[str]) -> Column:
    """Whether a record (category, holder, qid, artist_qid, summary) is of those categories, has a holder and any identifier, and no summary."""
    return F.col("category").isin(*categories) & F.col("holder").isNotNull() & F.coalesce("qid", "artist_qid").isNotNull() & blank_to_null(F.col("summary")).isNull()


#: Logical field -> where it lies in a record.
FIELD_PATHS = {"artist_qid": ("artist", "wikidata_q"), "work_qid": ("stable_identifiers", "wikidata_q"), "holder_name": ("holder", "name")}


def get_field(record: Column, field: str) -> Column:
    """A logical field of a record, wherever it lies."""
    for step in FIELD_PATHS.get(field, (field,)):
        record = record[step]
    return record


def set_field(record: Column, field: str, value: Column) -> Column:
    """The record with a logical field set; what lies beside it stays."""
    return record.withField(".".join(FIELD_PATHS.get(field, (field,))), value)


def triage(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: how many rows any rule flags, how many none does, and whether both together are all."""
    flagged = F.size(text.all_rules(F.col(column), rules)) > 0
    counts = rows.agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"), F.count_if(~flagged).alias("clean"))
    return counts.withColumn("conserved", F.col("flagged") + F.col("clean") == F.col("n"))
