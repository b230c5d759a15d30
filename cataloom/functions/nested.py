"""Functions on arrays, maps, structs and VARIANT values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty and blank strings are missing values."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*aliases: Column) -> Column:
    """The first alias that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(a) for a in aliases])


def append_event(history: Column, ts: Column, actor: Column, op: Column, notes: Column) -> Column:
    event = F.struct(ts.alias("ts"), actor.alias("actor"), op.alias("op"), notes.alias("notes"))
    return F.concat(F.coalesce(history, F.array().cast("array<struct<ts:string,actor:string,op:string,notes:string>>")), F.array(event))


def undo_events(history: Column, op: str) -> Column:
    return F.filter(history, lambda e: e["op"] != op)


def first_event_ts(history: Column) -> Column:
    """The least non-empty timestamp, compared as text."""
    return F.coalesce(F.array_min(F.filter(F.transform(history, lambda e: e["ts"]), lambda t: t.isNotNull() & (t != ""))), F.lit(""))


def first_actor(history: Column) -> Column:
    """The actor of the first entry that has the least timestamp."""
    return F.try_element_at(F.filter(history, lambda e: e["ts"] == first_event_ts(history)), F.lit(1))["actor"]


def latest_event(history: Column, op: str) -> Column:
    """The first of the events of an op with the greatest timestamp."""
    own = F.filter(history, lambda e: e["op"] == op)
    most = F.array_max(F.transform(own, lambda e: e["ts"]))
    return F.try_element_at(F.filter(own, lambda e: e["ts"] == most), F.lit(1))


def upsert_ledger(ledger: Column, field: Column, entry: Column) -> Column:
    """A map with one key set."""
    return F.map_concat(F.map_filter(ledger, lambda k, _: k != field), F.map_from_arrays(F.array(field), F.array(entry)))


def ledger_status(ledger: Column, field: str) -> Column:
    return F.try_element_at(ledger, F.lit(field))["status"]


#: Statuses of a field that ask for research, besides a missing one.
OPEN_STATUSES = ("not_researched", "unverified", "conflicting")


def needs_research(ledger: Column, field: str) -> Column:
    status = ledger_status(ledger, field)
    return status.isNull() | status.isin(*OPEN_STATUSES)


def inherit(own: Mapping[str, Column], parent: Mapping[str, Column]) -> tuple[dict[str, Column], Column, Column]:
    """Empty fields filled from a parent, and the arrays of filled and of conflicting field names."""
    filled = {f: F.coalesce(blank_to_null(own[f]), blank_to_null(parent[f])) for f in own}
    took = F.array(*[F.when(blank_to_null(own[f]).isNull() & blank_to_null(parent[f]).isNotNull(), F.lit(f)) for f in own])
    clash = F.array(*[F.when(blank_to_null(own[f]) != blank_to_null(parent[f]), F.lit(f)) for f in own])
    return filled, F.filter(took, lambda x: x.isNotNull()), F.filter(clash, lambda x: x.isNotNull())


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules whose condition of violation holds."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def canonical_map(m: Column) -> Column:
    """A map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def fingerprint(m: Column) -> Column:
    """SHA-256 of a map's canonical JSON."""
    return F.sha2(F.to_json(canonical_map(m)), 256)


def seeded_rank(seed: int, key: Column) -> Column:
    """A hexadecimal tie-break that a seed and a key fix."""
    return F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), F.lit(16))


def item_etag(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(16))


def combine_sets(a: Column, b: Column) -> Column:
    """(merged, conflict): the larger of two nested sets, the union otherwise; a conflict if neither holds the other."""
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    merged = F.array_sort(F.array_union(a, b))
    return F.struct(merged.alias("merged"), (~inside).alias("conflict"))


def merge_labels(existing: Column, incoming: Column, normalise: Callable[[Column], Column]) -> Column:
    """Both lists in order; of labels with one normal form the first stays."""
    both = F.concat(existing, incoming)
    keyed = F.transform(both, lambda x: normalise(x))
    return F.filter(both, lambda x, i: F.array_position(keyed, normalise(x)) == i + 1)


def language_map_value(labels: Column, languages: Sequence[str] = ("en", "none")) -> Column:
    """The joined values of the first language present in a map<language, array<string>>."""
    found = F.coalesce(*[F.try_element_at(labels, F.lit(x)) for x in languages], F.try_element_at(F.map_values(labels), F.lit(1)))
    return F.array_join(found, ", ")


def decayed_depth(counts: Mapping[str, tuple[Column, float]], full_at: int = 5) -> Column:
    """Weighted sum of counts that saturate at full_at, capped at 100."""
    total = F.lit(0.0)
    for n, weight in counts.values():
        total = total + weight * F.least(F.coalesce(n, F.lit(0)), F.lit(full_at)) / float(full_at)
    return F.least(total, F.lit(100.0))


def json_leaves(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, path, leaf (as text) of every scalar in JSON documents of any depth; null leaves and invalid documents drop out.

    Each round opens one level of all documents; what is a scalar by then goes to the result.
    """
    level = rows.select(key, F.lit("").alias("path"), F.try_parse_json(value).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        kind = F.schema_of_variant("v")
        nested_ = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.where(~nested_ & (kind != "VOID")).select(key, "path", F.try_variant_get("v", "$", "string").alias("leaf"))
        found = leaves if found is None else found.unionByName(leaves)
        deeper = level.where(nested_)
        if deeper.isEmpty():
            return found
        opened = deeper.lateralJoin(deeper.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat(F.lit("."), "name"))
        level = opened.select(key, F.concat("path", step).alias("path"), F.col("inner").alias("v"))
