"""Roll-ups: rates, cross-tabs, distributions, policies. One pass each; partial sums meet before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.functions.numbers import wilson_interval
from cataloom.operators.windows import running_totals
from cataloom.scratch import written

# Prior rates by tier, weights of the composite and its warm-up.
TIER_PRIORS: dict[int, dict[str, float]] = {
    1: {"verify_pass_rate": 0.95, "attribution_agreement": 0.95, "link_health_30d": 0.98, "metadata_completeness": 0.85},
    2: {"verify_pass_rate": 0.80, "attribution_agreement": 0.80, "link_health_30d": 0.95, "metadata_completeness": 0.65},
    3: {"verify_pass_rate": 0.65, "attribution_agreement": 0.65, "link_health_30d": 0.85, "metadata_completeness": 0.50},
}
COMPOSITE_WEIGHTS = {"verify_pass_rate": 0.40, "attribution_agreement": 0.25, "link_health_30d": 0.15, "metadata_completeness": 0.15}
CONFIDENCE_FLOOR_WEIGHT, CONFIDENCE_FULL_AT, WARMUP_DAYS = 0.05, 10, 30
STATUSES = ("available", "not_researched", "not_available", "unverified", "conflicting")


def grouped_examples(rows: DataFrame, key: Column, raw: str, k: int = 3) -> DataFrame:
    """Per key: rows, distinct raw spellings and the k most frequent of them."""
    per_raw = rows.select(key.alias("key"), F.col(raw).alias("raw")).groupBy("key", "raw").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "raw")
    ranked = per_raw.withColumn("rank", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "raw"))))
    return ranked.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_raw"), F.transform(top, lambda x: x["raw"]).alias("examples"))


def event_summary(events: DataFrame, axes: Sequence[str], surface: str) -> DataFrame:
    """axis, value, n: histograms of the axes without nulls, and of the surface with null as a value of its own. One scan."""
    pairs = [F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value"), F.col(a).isNotNull().alias("counts")) for a in axes]
    pairs.append(F.struct(F.lit(surface).alias("axis"), F.col(surface).cast("string").alias("value"), F.lit(True).alias("counts")))
    flat = events.select(F.explode(F.array(*pairs)).alias("p")).where("p.counts")
    return flat.groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))


def signal_rates(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the number acquired, pass rates without missing signals, mean completeness and first and last sighting.

    signals: verify, attribution, link (boolean), completeness (double), ts."""
    def rate(c: str) -> Column:
        return F.try_divide(F.count_if(c).cast("double"), F.count(c))

    return signals.groupBy(*keys).agg(
        F.count("*").alias("n_acquired"),
        rate("verify").alias("verify_pass_rate"),
        rate("attribution").alias("attribution_agreement"),
        rate("link").alias("link_health_30d"),
        F.avg("completeness").alias("metadata_completeness"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def verify_pass(overall: Column, *gates: Column) -> Column:
    """The overall result if there is one, else whether all known gates hold; null without any."""
    known = F.filter(F.array(*gates), lambda g: g.isNotNull())
    return F.coalesce(overall, F.when(F.size(known) > 0, F.forall(known, lambda g: g)))


def blended_score(rates: DataFrame, now: Column, tier: str = "host_tier") -> DataFrame:
    """rates with blended rates and composite. Observed rates count linearly more over the warm-up; missing ones are the prior's."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("first_seen"))) / 86_400e6
    t = F.when(F.col("first_seen").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), age / WARMUP_DAYS)))
    out = rates.withColumn("warmth", t)
    total = F.lit(0.0)
    for name, weight in COMPOSITE_WEIGHTS.items():
        prior = F.lit(TIER_PRIORS[1][name])
        for level in (2, 3):
            prior = F.when(F.col(tier) == level, TIER_PRIORS[level][name]).otherwise(prior)
        blended = F.when(F.col(name).isNull(), prior).otherwise(F.col("warmth") * F.col(name) + (1 - F.col("warmth")) * prior)
        out = out.withColumn(f"blended_{name}", blended)
        total = total + weight * F.col(f"blended_{name}")
    return out.withColumn("composite", total + CONFIDENCE_FLOOR_WEIGHT * F.least(F.lit(1.0), F.col("n_acquired") / float(CONFIDENCE_FULL_AT)))


def seeded_priors(rates: DataFrame, hosts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """rates and, for each host and class without one, a row without observations."""
    grid = hosts.select("source", F.explode(F.array(*[F.lit(c) for c in classes])).alias("work_class"))
    empty = grid.join(rates, ["source", "work_class"], "left_anti").withColumn("n_acquired", F.lit(0).cast("long"))
    return rates.unionByName(empty, allowMissingColumns=True)


def completeness(works: DataFrame, ledger: str, baseline: Sequence[str]) -> DataFrame:
    """field, one column per status, and the share available: ledger fields and baseline fields; a missing entry isn't researched."""
    n_works = works.count()
    entries = works.select(F.explode(ledger).alias("field", "entry")).select("field", F.col("entry.status").alias("status"))
    counts = entries.groupBy("field").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).fillna(0)
    base = works.sparkSession.createDataFrame([(f,) for f in baseline], "field string")
    full = counts.join(base, "field", "full_outer").fillna(0)
    recorded = sum((F.col(s) for s in STATUSES), F.lit(0))
    full = full.withColumn("not_researched", F.col("not_researched") + F.lit(n_works) - recorded)
    return full.withColumn("share_available", F.try_divide(F.col("available").cast("double"), F.lit(n_works)))


def cost_per_success(entries: DataFrame, keys: Sequence[str], cost: str, success: Column) -> DataFrame:
    """Cost, successes and their quotient; `modeled` where a cost is missing."""
    return entries.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(cost).alias("cost"),
        F.count_if(success).alias("n_success"),
        F.try_divide(F.sum(cost), F.count_if(success)).alias("cost_per_success"),
        F.when(F.count_if(F.col(cost).isNull()) > 0, "modeled").otherwise("measured").alias("basis"),
    )


def durations(entries: DataFrame, keys: Sequence[str], duration: str, success: Column) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(duration).alias("mean_ms"), F.max(duration).alias("max_ms"), F.count_if(success).alias("n_success"), F.count_if(~success).alias("n_failure"))


def benchmark_metrics(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy with its interval, false passes and fails, nearest-rank p95 latency and cost per success. cases: expected, actual, valid, cost, latency."""
    right = F.col("expected") == F.col("actual")
    stats = cases.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_right"),
        F.count_if((F.col("expected") == 0) & (F.col("actual") == 1)).alias("n_false_pass"),
        F.count_if((F.col("expected") == 1) & (F.col("actual") == 0)).alias("n_false_fail"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95_latency"),
        F.try_divide(F.sum("cost"), F.count_if(right)).alias("cost_per_right"),
    )
    bounds = wilson_interval(F.col("n_right"), F.col("n"))
    return stats.withColumn("lower", bounds["low"]).withColumn("upper", bounds["high"])


def distribution(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Linear median and p90, and the maximum."""
    return exact_quantiles(rows, keys, value, {"median": 0.5, "p90": 0.9})


#: Accuracy of the sketches that bracket a quantile: its rank is off by one in that many at most.
SKETCH = 10_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Per key n, the linearly interpolated quantiles of the non-null values, and the maximum (most).

    A first pass brackets each quantile by mergeable sketches, with three times their error on either side. A second one
    counts what lies below the bracket, and by value what lies within: a few thousandths of the values, or all of them
    where there are few. Only these are sorted, by key and quantile, and the result is exact.
    """
    names, margin = list(shares), 3.0 / SKETCH
    own = [f"__key_{k}" for k in keys]
    ends = [min(1.0, max(0.0, s + side)) for s in shares.values() for side in (-margin, margin)]
    v = F.col(value).cast("double")
    sketched = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.max(value).alias("most"), F.percentile_approx(v, ends, SKETCH).alias("ends")).toDF(*own, "n", "low", "high", "most", "ends")
    few = F.col("n") < 3 * SKETCH
    brackets = F.array(*[
        F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(shares[name]))).alias("place"), F.when(few, F.col("low")).otherwise(F.get("ends", F.lit(2 * i))).alias("start"), F.when(few, F.col("high")).otherwise(F.get("ends", F.lit(2 * i + 1))).alias("end"))
        for i, name in enumerate(names)
    ])
    per_key = written(sketched.withColumn("brackets", brackets), "brackets")
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    held = rows.where(v.isNotNull()).select(*keys, v.alias("__v"))
    met = held.join(per_key.select(*own, "brackets"), on) if keys else held.join(F.broadcast(per_key.select("brackets")))
    each = met.select(*own, "__v", F.explode("brackets").alias("b")).where(F.col("__v") <= F.col("b.end"))
    inside = F.when(F.col("__v") >= F.col("b.start"), F.col("__v"))
    counted = each.groupBy(*own, F.col("b.i").alias("i"), F.col("b.place").alias("place"), inside.alias("__v")).agg(F.count("*").alias("n"))
    # What lies below a bracket is one row without a value, which comes first.
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*own, "i").orderBy(F.col("__v").asc_nulls_first())))
    low, high = (F.min(F.when(F.col("upto") > step("place"), F.col("__v"))) for step in (F.floor, F.ceil))
    found = upto.groupBy(*own, "i").agg((low + F.first(F.col("place") - F.floor("place")) * (high - low)).alias("quantile"))
    wide = found.groupBy(*own).agg(*[F.max(F.when(F.col("i") == i, F.col("quantile"))).alias(name) for i, name in enumerate(names)])
    if not keys:
        return per_key.select("n", "most").join(F.broadcast(wide)).select("n", *names, "most") if names else per_key.select("n", "most")
    wide = wide.toDF(*[f"{o}_" for o in own], *names)
    out = per_key.join(wide, [F.col(o).eqNullSafe(F.col(f"{o}_")) for o in own], "left")
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "n", *names, "most")


def f1_sweep(scores: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, precision, recall, f1 at the midpoints between neighbouring distinct scores, and below the least. Sums run over distinct scores."""
    per_score = scores.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    totals = per_score.agg(F.sum("pos").alias("all_pos"))
    ranked = running_totals(per_score, [], [F.desc("s")], {"tp": F.col("pos"), "fp": F.col("neg"), "place": F.lit(1)})
    below = ranked.select((F.col("place") - 1).alias("place"), F.col("s").alias("below"))
    swept = ranked.join(below, "place", "left").withColumn("threshold", F.when(F.col("below").isNull(), F.col("s")).otherwise((F.col("s") + F.col("below")) / 2))
    swept = swept.join(F.broadcast(totals))
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("all_pos"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return swept.select("threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def verdict_policy(verdicts: DataFrame, keys: Sequence[str], severity: Mapping[str, int]) -> DataFrame:
    """Per key the worst verdict, the majority (ties to the worse, then the more confident), whether they split, and the greatest dissent. verdicts: verdict, confidence, provider."""
    rank = F.lit(0)
    for name, level in severity.items():
        rank = F.when(F.col("verdict") == name, level).otherwise(rank)
    ranked = verdicts.withColumn("sev", rank)
    worst = ranked.groupBy(*keys).agg(F.max_by("verdict", F.struct("sev", "confidence", "provider")).alias("worst"), F.count_distinct("verdict").alias("n_verdicts"))
    votes = ranked.groupBy(*keys, "verdict", "sev").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    major = votes.groupBy(*keys).agg(F.max_by("verdict", F.struct("n", "sev", "confidence")).alias("majority"))
    joined = worst.join(major, list(keys))
    dissent = votes.join(joined.select(*keys, "majority"), list(keys)).where("verdict <> majority").groupBy(*keys).agg(F.max("confidence").alias("dissent"))
    return joined.join(dissent, list(keys), "left").withColumn("split", F.col("n_verdicts") > 1).drop("n_verdicts")


def overall_status(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Any blocking FAIL fails; all skipped is unverified; any PASS passes. checks: status, blocking."""
    failed = F.bool_or((F.col("status") == "FAIL") & F.col("blocking"))
    return checks.groupBy(*keys).agg(F.when(failed, "FAIL").when(F.bool_and(F.col("status") == "SKIP"), "UNVERIFIED").when(F.bool_or(F.col("status") == "PASS"), "PASS").otherwise("UNVERIFIED").alias("overall"))


def combined_state(rows: DataFrame, keys: Sequence[str], state: str, priority: Mapping[str, int]) -> DataFrame:
    """The state of most severe precedence; skipped only if all are."""
    rank = F.lit(len(priority) + 1)
    for name, level in priority.items():
        rank = F.when(F.col(state) == name, level).otherwise(rank)
    return rows.groupBy(*keys).agg(F.min_by(state, F.struct(rank, F.col(state))).alias("combined"))


def bounded_errors(errors: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Error counts by key; the most frequent are named, the others fold into one overflow row with their sum."""
    counts = errors.groupBy(*keys).agg(F.count("*").alias("n"))
    named = counts.orderBy(F.desc("n"), *keys).limit(most)
    hit = named.select(*[F.col(k).alias(f"named_{k}") for k in keys], F.lit(True).alias("is_named"))
    ranked = counts.join(F.broadcast(hit), [F.col(k).eqNullSafe(F.col(f"named_{k}")) for k in keys], "left")
    return ranked.select(*[F.when(F.col("is_named"), F.col(k)).otherwise("(overflow)").alias(k) for k in keys], "n").groupBy(*keys).agg(F.sum("n").alias("n"))


def duplicate_positions(rows: DataFrame, keys: Sequence[str], position: str, item: str) -> DataFrame:
    return rows.where(F.col(position) > 0).groupBy(*keys, position).agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") > 1)


def position_gaps(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Per key the positions that repeat or are missing between 1 and the greatest."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(position)).alias("held"), F.count(position).alias("n"), F.max(position).alias("last"))
    gaps = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.col("last").cast("bigint")), F.transform("held", lambda x: x.cast("bigint")))
    return held.where("last >= 1").select(*keys, gaps.alias("gaps"), (F.col("n") - F.size("held")).alias("n_repeated"))


def relation_signature(rows: DataFrame, modified: str, size: str) -> DataFrame:
    """Sums and count that change when a relation does."""
    return rows.agg(F.sum(modified).alias("sum_modified"), F.sum(size).alias("sum_size"), F.count("*").alias("n"))


def lineage_counts(rows: DataFrame, sets: Sequence[str]) -> DataFrame:
    """level, value, n for each of several columns in one scan, by grouping sets."""
    grouped = rows.groupingSets([[s] for s in sets], *sets).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    level, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, s in enumerate(sets):
        own = (1 << len(sets)) - 1 - (1 << (len(sets) - 1 - i))
        level = F.when(F.col("gid") == own, F.lit(s)).otherwise(level)
        value = F.when(F.col("gid") == own, F.col(s).cast("string")).otherwise(value)
    return grouped.select(level.alias("level"), value.alias("value"), "n")


def ordered_tally(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """place, value, n for every value of a fixed list, zeros included."""
    spark = rows.sparkSession
    base = spark.createDataFrame(list(enumerate(values)), f"place int, {column} string")
    return F.broadcast(base).join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select("place", column, F.coalesce("n", F.lit(0)).alias("n"))


def coverage_delta(current: Column, baseline: Column, alert_drop: float) -> Column:
    delta = current - baseline
    return F.struct(F.round(delta, 4).alias("delta"), F.when(baseline.isNull(), "no-baseline").when(delta <= -alert_drop, "drop").when(delta < 0, "slight-drop").otherwise("ok").alias("status"))


def keepalive_summary(entries: DataFrame, pr: str, iterations: str, outcome: str, done: str, failed: str) -> DataFrame:
    """One row: entries, distinct pull requests, iterations (unreadable ones don't count), and what was completed or failed."""
    n = F.col(iterations).try_cast("int")
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_distinct(pr).alias("prs"),
        F.round(F.avg(n), 6).alias("avg_iterations"),
        F.count_if(F.col(outcome) == done).alias("completed"),
        F.round(F.try_divide(F.count_if(F.col(outcome) == done), F.count("*")), 6).alias("completion_rate"),
        F.count_if(F.col(outcome) == failed).alias("failed"),
        F.max(n).alias("most_iterations"),
    )


def autofix_summary(entries: DataFrame, trigger: str, applied: str, pr: str) -> DataFrame:
    """Per trigger: attempts, how many were applied, and distinct pull requests."""
    hit = F.coalesce(F.col(applied), F.lit(False))
    return entries.groupBy(F.col(trigger).alias("trigger")).agg(F.count("*").alias("attempts"), F.count_if(hit).alias("applied"), F.round(F.count_if(hit) / F.count("*"), 6).alias("applied_rate"), F.count_distinct(pr).alias("prs"))


def verifier_counters(entries: DataFrame, passed: str, failed: str, confident: int, doubtful: int) -> DataFrame:
    """One row of counters over verifier entries (run, pr, verdict, confidence, cost, ts)."""
    ok, bad = F.col("verdict") == passed, F.col("verdict") == failed
    sure = F.col("confidence") >= confident
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_distinct("run").alias("runs"),
        F.count_if(ok).alias("passed"),
        F.count_if(bad).alias("failed"),
        F.count_if(~ok & ~bad).alias("other"),
        F.count_if(F.col("confidence").isNull()).alias("unscored"),
        F.count_if(sure).alias("confident"),
        F.count_if(bad & sure).alias("confident_failures"),
        F.count_distinct(F.when(bad, F.col("run"))).alias("failing_runs"),
        F.count_distinct(F.when(F.col("confidence") < doubtful, F.col("pr"))).alias("doubtful_prs"),
        F.round(F.avg("cost"), 6).alias("mean_cost"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def freshness_summary(entries: DataFrame) -> DataFrame:
    """target, n, most_behind for each update target of entries (targets, behind, delta), and the greatest readable delta of all."""
    overall = entries.agg(F.max(F.coalesce(F.col("delta").try_cast("int"), F.lit(0))).alias("overall"))
    per_target = entries.select(F.explode("targets").alias("target"), "behind").groupBy("target").agg(F.count("*").alias("n"), F.max("behind").alias("most_behind"))
    return per_target.join(F.broadcast(overall))


def policy_basis(tags: DataFrame, rules: DataFrame, curated: DataFrame) -> DataFrame:
    """tag, basis: contrastive if its rule has negatives, curated if it stands in that list, provisional with a bare rule, inert without one."""
    ruled = rules.groupBy("tag").agg(F.max(F.size("negatives")).alias("n_negatives"))
    listed = curated.select("tag", F.lit(True).alias("listed")).distinct()
    basis = F.when(F.col("n_negatives").isNull(), "inert").when(F.col("n_negatives") > 0, "contrastive").when(F.col("listed"), "curated").otherwise("provisional")
    return tags.join(ruled, "tag", "left").join(listed, "tag", "left").select("tag", basis.alias("basis"))
