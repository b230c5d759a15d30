"""Queries over roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import nested, numbers
from cataloom.operators import aggregates
from cataloom.plans.catalogue import INVENTORY_SQL, RATINGS_SQL, inventory, rating_events, table
from cataloom.registry import register


@register(
    "artist_rollup_examples",
    "AGG-01",
    f"""WITH {INVENTORY_SQL}, c AS (SELECT artist AS key, title AS raw, count(*) AS n FROM inventory GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, raw) AS rn FROM c)
        SELECT key, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_raw, list(raw ORDER BY rn) FILTER (WHERE rn <= 3) AS examples FROM r GROUP BY key""",
)
def artist_rollup_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.grouped_examples(inventory(spark, sf_dir), F.col("artist"), "title")


@register(
    "rating_summary_sets",
    "AGG-02 AGG-18",
    f"""WITH {RATINGS_SQL} SELECT 'fit' AS axis, CAST(fit AS VARCHAR) AS value, count(*) AS n FROM ratings WHERE fit IS NOT NULL GROUP BY fit UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM ratings WHERE quality IS NOT NULL GROUP BY quality
        UNION ALL SELECT 'surface', surface, count(*) FROM ratings GROUP BY surface""",
)
def rating_summary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.event_summary(rating_events(spark, sf_dir), ["fit", "quality"], "surface")


@register(
    "lineage_grouping_sets",
    "AGG-18",
    """SELECT 'p_brand' AS level, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size""",
)
def lineage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.lineage_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.join(labels, "doc_id", "left")
    return joined.select(
        "source",
        F.col("lang").alias("work_class"),
        aggregates.verify_pass(F.lit(None).cast("boolean"), F.col("quality") == 1, F.col("toxic") == 0).alias("verify"),
        (F.col("toxic") == 0).alias("attribution"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") > 500).alias("link"),
        F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 101) / 100.0).alias("completeness"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("ts"),
    )


_SIGNALS_SQL = """signals AS (SELECT source, lang AS work_class, quality = 1 AND toxic = 0 AS verify, toxic = 0 AS attribution, CASE WHEN doc_id % 3 = 0 THEN n_chars > 500 END AS link,
    CASE WHEN doc_id % 2 = 0 THEN (n_chars % 101) / 100.0::DOUBLE END AS completeness, doc_id * 3600 AS ts FROM documents LEFT JOIN labels USING (doc_id)),
    rates AS (SELECT source, work_class, count(*) AS n_acquired, count(*) FILTER (verify) / nullif(count(verify), 0)::DOUBLE AS verify_pass_rate, count(*) FILTER (attribution) / nullif(count(attribution), 0)::DOUBLE AS attribution_agreement,
    count(*) FILTER (link) / nullif(count(link), 0)::DOUBLE AS link_health_30d, avg(completeness) AS metadata_completeness, min(ts) AS first_seen FROM signals GROUP BY ALL)"""


@register(
    "source_quality_rates",
    "AGG-03 PRJ-08 JOIN-24",
    f"""WITH {_SIGNALS_SQL} SELECT source, work_class, n_acquired, round(verify_pass_rate, 6) AS verify_pass_rate, round(attribution_agreement, 6) AS attribution_agreement, round(link_health_30d, 6) AS link_health_30d, round(metadata_completeness, 6) AS metadata_completeness FROM rates""",
)
def source_quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = aggregates.signal_rates(_signals(spark, sf_dir), ["source", "work_class"])
    return rates.select("source", "work_class", "n_acquired", *[F.round(c, 6).alias(c) for c in aggregates.COMPOSITE_WEIGHTS])


@register(
    "source_quality_composite",
    "AGG-04 MTH-05 JOIN-24 JOIN-25",
    f"""WITH {_SIGNALS_SQL}, tiers AS (SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 2 WHEN source = 'src2' THEN 3 ELSE 1 END AS tier FROM rates GROUP BY source),
        grid AS (SELECT DISTINCT t.source, c.work_class FROM tiers t, (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) c(work_class)),
        f AS (SELECT g.source, g.work_class, t.tier, coalesce(r.n_acquired, 0) AS n, CASE WHEN r.first_seen IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (30 * 86400 - r.first_seen) / 86400.0::DOUBLE / 30)) END AS t,
            verify_pass_rate v, attribution_agreement a, link_health_30d l, metadata_completeness m,
            CASE tier WHEN 1 THEN [0.95, 0.95, 0.98, 0.85] WHEN 2 THEN [0.80, 0.80, 0.95, 0.65] ELSE [0.65, 0.65, 0.85, 0.50] END::DOUBLE[] AS p FROM grid g JOIN tiers t USING (source) LEFT JOIN rates r USING (source, work_class))
        SELECT source, work_class, n AS n_acquired, round(0.40 * coalesce(t * v + (1 - t) * p[1], p[1]) + 0.25 * coalesce(t * a + (1 - t) * p[2], p[2]) + 0.15 * coalesce(t * l + (1 - t) * p[3], p[3]) + 0.15 * coalesce(t * m + (1 - t) * p[4], p[4])
            + 0.05 * least(1.0, n / 10.0::DOUBLE), 6)::DOUBLE AS composite FROM f""",
)
def source_quality_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = aggregates.signal_rates(_signals(spark, sf_dir), ["source", "work_class"])
    hosts = rates.select("source").distinct()
    seeded = aggregates.seeded_priors(rates, hosts, ["en", "de", "fr", "es", "it"])
    tier = F.when(F.col("source").isin("src0", "src1"), 2).when(F.col("source") == "src2", 3).otherwise(1)
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 30 * 86_400))
    scored = aggregates.blended_score(seeded.withColumn("host_tier", tier), now)
    return scored.select("source", "work_class", "n_acquired", F.round("composite", 6).alias("composite"))


@register(
    "completeness_crosstab",
    "AGG-05 SET-11 CPX-02",
    """WITH e AS (SELECT doc_id, 'medium' AS field, CASE doc_id % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'unverified' WHEN 2 THEN 'conflicting' END AS status FROM documents UNION ALL SELECT doc_id, 'year', CASE WHEN doc_id % 3 = 0 THEN 'not_available' END FROM documents
        UNION ALL SELECT doc_id, 'holder', NULL FROM documents)
        SELECT field, count(*) FILTER (status = 'available') AS available, count(*) FILTER (coalesce(status, 'not_researched') = 'not_researched') AS not_researched, count(*) FILTER (status = 'not_available') AS not_available, count(*) FILTER (status = 'unverified') AS unverified,
        count(*) FILTER (status = 'conflicting') AS conflicting, count(*) FILTER (status = 'available') / count(*)::DOUBLE AS share_available FROM e GROUP BY field""",
)
def completeness_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "map<string,struct<status:string,source:string>>"
    entry = F.struct(F.when(F.col("doc_id") % 4 == 0, "available").when(F.col("doc_id") % 4 == 1, "unverified").otherwise("conflicting").alias("status"), F.lit("scan").alias("source"))
    base = F.when(F.col("doc_id") % 4 < 3, F.map_from_arrays(F.array(F.lit("medium")), F.array(entry)).cast(kind)).otherwise(F.create_map().cast(kind))
    year = F.struct(F.lit("not_available").alias("status"), F.lit("scan").alias("source"))
    ledger = F.when(F.col("doc_id") % 3 == 0, nested.upsert_ledger(base, F.lit("year"), year)).otherwise(base)
    return aggregates.completeness(table(spark, sf_dir, "documents").select("doc_id", ledger.alias("ledger")), "ledger", ["medium", "year", "holder"])


@register(
    "cost_per_success",
    "AGG-15",
    """WITH e AS (SELECT event_type, user_id % 3 AS tier, CASE WHEN event_id % 17 <> 0 OR user_id % 3 = 1 THEN value END AS cost, event_id % 4 <> 0 AS ok FROM events)
        SELECT event_type, tier, count(*) AS n, round(sum(cost), 4) AS cost, count(*) FILTER (ok) AS n_success, round(sum(cost) / nullif(count(*) FILTER (ok), 0), 6) AS cost_per_success, CASE WHEN count(*) > count(cost) THEN 'modeled' ELSE 'measured' END AS basis FROM e GROUP BY ALL""",
)
def cost_per_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("tier"), F.when((F.col("event_id") % 17 != 0) | (F.col("user_id") % 3 == 1), F.col("value")).alias("cost"), (F.col("event_id") % 4 != 0).alias("ok"))
    out = aggregates.cost_per_success(e, ["event_type", "tier"], "cost", F.col("ok"))
    return out.withColumn("cost", F.round("cost", 4)).withColumn("cost_per_success", F.round("cost_per_success", 6))


@register(
    "step_durations",
    "AGG-16",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, max(value) AS max_ms, count(*) FILTER (event_id % 5 <> 0) AS n_success, count(*) FILTER (event_id % 5 = 0) AS n_failure FROM events GROUP BY event_type""",
)
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "False").when(F.col("event_id") % 2 == 0, "1").otherwise("TRUE")
    out = aggregates.durations(table(spark, sf_dir, "events"), ["event_type"], "value", numbers.coerced_bool(raw))
    return out.withColumn("mean_ms", F.round("mean_ms", 6))


@register(
    "verifier_summary",
    "AGG-16",
    """SELECT event_type, count(DISTINCT coalesce(nullif(CAST(user_id AS VARCHAR), '0'), 'none')) AS n_runs, count(*) FILTER (value >= 50) AS n_pass, CAST(len(list_distinct(list(user_id % 10))) AS INTEGER) AS n_traces FROM events GROUP BY event_type""",
)
def verifier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.coalesce(F.nullif(F.col("user_id").cast("string"), F.lit("0")), F.lit("none"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(run).alias("n_runs"), F.count_if(F.col("value") >= 50).alias("n_pass"), F.size(F.collect_set(F.col("user_id") % 10)).alias("n_traces"))


@register(
    "confusion_wilson_p95",
    "AGG-22 MTH-06",
    """WITH c AS (SELECT source, quality AS expected, CAST(n_chars % 3 <> 0 AS INTEGER) AS actual, doc_id % 10 <> 0 AS valid, n_chars / 1000.0::DOUBLE AS cost, n_chars AS latency FROM documents JOIN labels USING (doc_id)),
        s AS (SELECT source, count(*) AS n, count(*) FILTER (expected = actual) AS n_right, count(*) FILTER (expected = 0 AND actual = 1) AS n_false_pass, count(*) FILTER (expected = 1 AND actual = 0) AS n_false_fail, count(*) FILTER (NOT valid) AS n_invalid,
            CAST(quantile_disc(latency, 0.95) AS DOUBLE) AS p95_latency, sum(cost) / nullif(count(*) FILTER (expected = actual), 0) AS cost_per_right FROM c GROUP BY source)
        SELECT source, n, n_right, n_false_pass, n_false_fail, n_invalid, p95_latency, round(cost_per_right, 6) AS cost_per_right,
        round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS lower,
        round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS upper
        FROM (SELECT *, n_right / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM s)""",
)
def confusion_wilson_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cases = d.select("source", F.col("quality").alias("expected"), (F.col("n_chars") % 3 != 0).cast("int").alias("actual"), (F.col("doc_id") % 10 != 0).alias("valid"), (F.col("n_chars") / 1000).alias("cost"), F.col("n_chars").alias("latency"))
    out = aggregates.benchmark_metrics(cases, ["source"])
    for c in ("cost_per_right", "lower", "upper"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@register(
    "percentile_corpus",
    "AGG-11",
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, max(l_extendedprice) AS most FROM lineitem GROUP BY 1""",
)
def percentile_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumn("median", F.round("median", 4)).withColumn("p90", F.round("p90", 4))


@register(
    "threshold_f1_sweep",
    "AGG-32 ITR-05",
    """WITH s AS (SELECT CAST(n_chars % 50 AS DOUBLE) AS s, quality FROM documents JOIN labels USING (doc_id)), d AS (SELECT s, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM s GROUP BY s),
        w AS (SELECT s, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, lead(s) OVER (ORDER BY s DESC) AS below, (SELECT sum(pos) FROM d) AS allp FROM d WINDOW o AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT CASE WHEN below IS NULL THEN s ELSE (s + below) / 2 END AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / allp::DOUBLE AS recall FROM w)
        SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM p""",
)
def threshold_f1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") % 50).cast("double").alias("s"), "quality")
    out = aggregates.f1_sweep(d, "s", "quality")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register(
    "depth_score",
    "AGG-23",
    """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(DISTINCT role) AS r FROM conversations GROUP BY conv_id)
        SELECT conv_id, round(least(100.0, 40.0 * least(u, 5) / 5.0 + 40.0 * least(a, 5) / 5.0 + 30.0 * least(r, 5) / 5.0)::DOUBLE, 6) AS depth FROM c""",
)
def depth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"), F.count_distinct("role").alias("r"))
    depth = nested.decayed_depth({"u": (F.col("u"), 40.0), "a": (F.col("a"), 40.0), "r": (F.col("r"), 30.0)})
    return c.select("conv_id", F.round(depth, 6).alias("depth"))


@register(
    "verdict_policy",
    "AGG-25 MTH-10",
    """WITH v AS (SELECT o_custkey, o_orderstatus AS verdict, round(o_totalprice / 1000000, 6) AS confidence, o_orderkey AS provider, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS sev FROM orders),
        w AS (SELECT o_custkey, arg_max(verdict, (sev, confidence, provider)) AS worst, count(DISTINCT verdict) AS nv FROM v GROUP BY 1), t AS (SELECT o_custkey, verdict, sev, count(*) AS n, max(confidence) AS confidence FROM v GROUP BY ALL),
        m AS (SELECT o_custkey, arg_max(verdict, (n, sev, confidence)) AS majority FROM t GROUP BY 1)
        SELECT o_custkey, worst, majority, (SELECT max(confidence) FROM t WHERE t.o_custkey = w.o_custkey AND t.verdict <> m.majority) AS dissent, nv > 1 AS split FROM w JOIN m USING (o_custkey)""",
)
def verdict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("verdict"), F.round(F.col("o_totalprice") / 1_000_000, 6).alias("confidence"), F.col("o_orderkey").alias("provider"))
    return aggregates.verdict_policy(v, ["o_custkey"], {"F": 3, "P": 2, "O": 1})


@register(
    "overall_status",
    "AGG-26 AGG-29 UDX-08",
    """WITH c AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'SKIP' END AS status, o_orderkey % 3 = 0 AS blocking FROM orders)
        SELECT o_custkey, CASE WHEN bool_or(status = 'FAIL' AND blocking) THEN 'FAIL' WHEN bool_and(status = 'SKIP') THEN 'UNVERIFIED' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'UNVERIFIED' END AS overall,
        arg_min(status, (CASE status WHEN 'FAIL' THEN 1 WHEN 'PASS' THEN 2 ELSE 3 END, status)) AS combined FROM c GROUP BY 1""",
)
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("SKIP")
    c = table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("blocking"))
    return aggregates.overall_status(c, ["o_custkey"]).join(aggregates.combined_state(c, ["o_custkey"], "status", {"FAIL": 1, "PASS": 2, "SKIP": 3}), "o_custkey")


@register(
    "position_gaps",
    "AGG-30 BAT-13",
    """SELECT l_orderkey, list_sort(list_filter(range(1, max(l_linenumber) + 1), lambda x: NOT list_contains(list(CAST(l_linenumber AS BIGINT)), x))) AS gaps, CAST(count(*) - count(DISTINCT l_linenumber) AS BIGINT) AS n_repeated FROM lineitem GROUP BY 1""",
)
def position_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.position_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@register(
    "coverage_deltas",
    "AGG-36",
    """WITH b AS (SELECT p_brand, round(avg(p_retailprice) FILTER (p_partkey % 2 = 0), 4) AS cur, round(avg(p_retailprice) FILTER (p_partkey % 2 = 1), 4) AS base FROM part GROUP BY 1)
        SELECT p_brand, round(cur - base, 4) AS delta, CASE WHEN base IS NULL THEN 'no-baseline' WHEN cur - base <= -5 THEN 'drop' WHEN cur - base < 0 THEN 'slight-drop' ELSE 'ok' END AS status FROM b""",
)
def coverage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg(F.when(even, F.col("p_retailprice"))), 4).alias("cur"), F.round(F.avg(F.when(~even, F.col("p_retailprice"))), 4).alias("base"))
    return b.select("p_brand", aggregates.coverage_delta(F.col("cur"), F.col("base"), 5.0).alias("d")).select("p_brand", "d.delta", "d.status")


@register(
    "pricing_summary",
    "AGG-03",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
