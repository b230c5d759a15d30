"""Queries over preference models and image kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import images, preferences
from cataloom.plans.catalogue import WORKS_SQL, table, works
from cataloom.registry import register

_FEATURES_SQL = f"""{WORKS_SQL}, f AS (SELECT DISTINCT work_id, unnest(list_concat(tags, CASE WHEN artist IS NOT NULL THEN ['artist:' || artist] ELSE [] END)) AS feature FROM works), sc AS (SELECT doc_id AS work_id, n_chars % 10 AS score FROM documents JOIN labels USING (doc_id)),
    m AS (SELECT median(score) AS split FROM sc), cls AS (SELECT work_id, sign(score - split) AS cls FROM sc, m), z AS (SELECT count(*) AS n, count(*) FILTER (cls > 0) AS np, count(*) FILTER (cls < 0) AS nn FROM cls),
    d AS (SELECT feature, count(*) AS df, count(*) FILTER (cls > 0) AS pos, count(*) FILTER (cls < 0) AS neg FROM f JOIN cls USING (work_id) GROUP BY feature),
    w AS (SELECT feature, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf, pos / np::DOUBLE * (ln((n + 1)::DOUBLE / (df + 1)) + 1) - 0.5 * neg / nn::DOUBLE * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS weight FROM d, z)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("tags", F.filter(F.array(F.concat(F.lit("artist:"), "artist")), lambda a: a.isNotNull()))
    return works(spark, sf_dir).select("work_id", F.explode(both).alias("feature"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("work_id"), (F.col("n_chars") % 10).alias("score"))


@register("rocchio_weights", "AGG-08 ITR-03", f"""WITH {_FEATURES_SQL} SELECT feature, round(idf, 8) AS idf, round(weight, 8) AS weight FROM w WHERE abs(weight) > 1e-12""")
def rocchio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.rocchio_weights(_features(spark, sf_dir), _scores(spark, sf_dir))
    return out.select("feature", F.round("idf", 8).alias("idf"), F.round("weight", 8).alias("weight"))


@register("rocchio_scores", "ITR-03 MTH-05", f"""WITH {_FEATURES_SQL} SELECT work_id, round(coalesce(sum(weight), 0) / sqrt(count(*)), 6) AS score FROM f LEFT JOIN w USING (feature) GROUP BY work_id""")
def rocchio_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _features(spark, sf_dir)
    out = preferences.rocchio_scores(features, preferences.rocchio_weights(features, _scores(spark, sf_dir)))
    return out.select("work_id", F.round("score", 6).alias("score"))


_COMPARISONS_SQL = """c AS (SELECT arg_max(l_suppkey, (l_extendedprice, l_linenumber, l_partkey)) AS winner, arg_min(l_suppkey, (l_extendedprice, l_linenumber, l_partkey)) AS loser FROM lineitem GROUP BY l_orderkey)"""


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_extendedprice", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", order).alias("winner"), F.min_by("l_suppkey", order).alias("loser")).select("winner", "loser")


@register("bt_pair_counts", "AGG-09", f"""WITH {_COMPARISONS_SQL} SELECT least(winner, loser) AS a, greatest(winner, loser) AS b, count(*) + 1.0::DOUBLE AS n, count(*) FILTER (winner < loser) + 0.5::DOUBLE AS wins_a, count(*) FILTER (winner > loser) + 0.5::DOUBLE AS wins_b FROM c WHERE winner <> loser GROUP BY ALL""")
def bt_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.pair_counts(_comparisons(spark, sf_dir))


@register("bt_strengths", "ITR-01")
def bt_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative; tests compare with a loop."""
    return preferences.bradley_terry(_comparisons(spark, sf_dir))


@register(
    "bt_components",
    "AGG-10",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey ELSE s_suppkey + 7 END AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
        SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def bt_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every supplier."""
    k = F.col("s_suppkey")
    return preferences.components(table(spark, sf_dir, "supplier").select(k.alias("a"), F.when(k % 5 == 0, k).otherwise(k + 7).alias("b")))


@register("next_pairs", "ITR-02 SET-05")
def next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest unasked pairs by fitted strength; tests compare with a loop."""
    c = _comparisons(spark, sf_dir)
    return preferences.closest_unasked(preferences.bradley_terry(c), c, 5)


@register("diverse_selection", "ITR-04 WIN-12")
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy and order-dependent; tests compare with determinants taken directly."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.lit(0.5) + F.col("vec_id") % 10 / 20).alias("quality"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return preferences.select_diverse(e, "label", 5)


@register(
    "display_scores",
    "MTH-05 SRT-08 PRJ-17",
    """SELECT p_partkey, round((0.45 * least(p_size / 30.0::DOUBLE, 1.0) + 0.25 * CAST(p_partkey % 2 = 0 AS INTEGER) + 0.15 * CAST(p_partkey % 3 = 0 AS INTEGER) + 0.15 * least(greatest(p_partkey % 5 - 1, 0) / 2.0::DOUBLE, 1.0)) * CASE WHEN p_partkey % 7 = 0 THEN 0.4 ELSE 1.0 END, 6)::DOUBLE AS score FROM part""",
)
def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    score = preferences.display_score(F.when(k % 7 == 0, F.concat(F.lit("Study for "), "p_name")).otherwise(F.col("p_name")), F.when(k % 2 == 0, "url"), F.when(k % 3 == 0, "holder"), k % 5, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@register("image_kernels", "IMG-01 IMG-02")
def image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and sharpness of pixel arrays made from parts; tests compare with known images."""
    i = F.sequence(F.lit(0), F.lit(31))
    pixels = F.transform(i, lambda y: F.transform(i, lambda x: ((x * (F.col("p_size") % 7 + 1) + y * (F.col("p_partkey") % 5)) % 256).cast("int")))
    # A row of few bytes becomes an image of many, so rows are dealt out before.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    return images.image_report(parts.select(F.col("p_partkey").alias("id"), pixels.alias("pixels")))


@register(
    "render_strategy",
    "IMG-05",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'range-map' ELSE 'range-map-strong' END AS strategy FROM part""",
)
def render_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("p_size") % 3 == 0, "well-served").when(F.col("p_size") % 3 == 1, "compromised").otherwise("poorly-served")
    return table(spark, sf_dir, "part").select("p_partkey", images.render_strategy(verdict).alias("strategy"))
