"""Queries over batch passes, wide hashes, image kernels, resumable streams and what else needs an operator of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import text
from cataloom.operators import aggregates, images, joins, sets, transforms, windows
from cataloom.plans.catalogue import table
from cataloom.registry import register
from cataloom.scratch import folder
from cataloom.streaming import streams


@register(
    "hamming_wide",
    "JOIN-07 MTH-01",
    """WITH h AS (SELECT doc_id AS id, substr(sha256(text), 1, 63) AS head, doc_id % 16 AS digit FROM documents) SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.digit, b.digit)) AS INTEGER) AS distance FROM h a JOIN h b ON a.head = b.head AND a.id <> b.id""",
)
def hamming_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256-bit hashes, of which those of equal texts differ in four bits at most."""
    k = F.col("doc_id")
    h = table(spark, sf_dir, "documents").select(k.alias("id"), F.concat(F.substring(F.sha2("text", 256), 1, 63), F.lower(F.hex(k % 16))).alias("hash"))
    return joins.hamming_pairs_wide(h, h, 7)


@register(
    "identity_fill",
    "BAT-01",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'known' WHEN s_suppkey IS NOT NULL THEN s_name END AS display_name, CASE WHEN s_suppkey IS NOT NULL THEN '1800-1870' END AS lifespan, s_suppkey IS NOT NULL AS filled FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def identity_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    identities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("display_name"), F.lit("1800-1870").alias("lifespan"))
    records = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("artist_qid"), F.when(F.col("c_custkey") % 3 == 0, "known").otherwise(" ").alias("display_name"), F.lit(None).cast("string").alias("lifespan"))
    return transforms.fill_identities(records, identities).select("c_custkey", "display_name", "lifespan", "filled")


@register(
    "curated_categories",
    "BAT-05",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'print' WHEN p_size > 40 THEN 'sculpture' WHEN p_type = 'SMALL' THEN 'drawing' END AS category FROM part""",
)
def curated_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the record, else that of a curated map, else that of the creator."""
    p = table(spark, sf_dir, "part")
    curated = p.where("p_size > 40").select("p_partkey", F.lit("sculpture").alias("value"), F.lit(1).alias("tier"))
    creators = p.where("p_type = 'SMALL'").select("p_partkey", F.lit("drawing").alias("value"), F.lit(2).alias("tier"))
    records = p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "print").alias("category"))
    return transforms.complete_fields(records, curated.unionByName(creators).withColumn("field", F.lit("category")), "p_partkey", ["category"]).select("p_partkey", "category")


@register(
    "field_completion",
    "BAT-08",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN r IS NOT NULL THEN r ELSE NULL END AS medium, n AS year, list_filter([CASE WHEN o_orderkey % 2 = 1 AND r IS NOT NULL THEN 'medium' END, CASE WHEN n IS NOT NULL THEN 'year' END], lambda x: x IS NOT NULL) AS completed
        FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS r, min(CASE WHEN l_linenumber > 2 THEN l_linestatus END) AS n0, arg_min(l_linestatus, (l_linenumber, l_linestatus)) FILTER (l_linenumber > 2) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def field_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key, tier = F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("tier")
    candidates = lines.select(key, F.lit("medium").alias("field"), F.col("l_returnflag").alias("value"), tier).unionByName(lines.where("l_linenumber > 2").select(key, F.lit("year").alias("field"), F.col("l_linestatus").alias("value"), tier))
    records = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "own").otherwise("").alias("medium"), F.lit(None).cast("string").alias("year"))
    return transforms.complete_fields(records, candidates, "o_orderkey", ["medium", "year"])


@register(
    "creator_reopening",
    "BAT-09 STR-12",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'resolved' WHEN s_suppkey % 4 = 1 THEN 'settled' WHEN s_suppkey % 3 = 0 THEN 'due' WHEN s_suppkey % 3 = 1 THEN 'reopened' ELSE 'retired' END AS status FROM supplier""",
)
def creator_reopening(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = text.creator_kind(F.when(k % 4 == 1, "Unknown").otherwise("Jan Maler"))
    status = transforms.creator_status(kind, F.when(k % 7 == 0, "Q1"), F.when(k % 3 == 1, 1).when(k % 3 == 2, 2), 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", status.alias("status"))


@register(
    "finalized_records",
    "BAT-16 STR-18 SNK-01",
    """SELECT p_partkey, sha256(p_name) AS sha256, length(p_name) AS size_bytes, substr(sha256(p_name), 1, 7) || '-' || array_to_string(string_split(p_name, ' ')[1:6], '-') AS work_id, CAST(1 AS INTEGER) AS n_events, p_size || 'x40' AS notes FROM part""",
)
def finalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_name").cast("binary").alias("body"), F.col("p_size").alias("width"), F.lit(40).alias("height"), F.lit(None).cast("array<struct<ts:string,actor:string,op:string,notes:string>>").alias("history"))
    done = transforms.finalized(records, "2024-01-01T00:00:00Z")
    return done.select("p_partkey", "sha256", "size_bytes", "work_id", F.size("history").alias("n_events"), F.get("history", F.lit(0))["notes"].alias("notes"))


@register(
    "series_migration",
    "BAT-17 JOIN-36",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Q900' WHEN p_partkey % 3 = 1 THEN 'Q' || p_size ELSE 'Q' || p_size END AS part_of, CASE WHEN p_partkey % 3 = 0 THEN 'applied' WHEN p_partkey % 3 = 1 THEN 'refused' ELSE 'none' END AS outcome FROM part""",
)
def series_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series identifiers moved where the record still holds the expected one."""
    k, held = F.col("p_partkey"), F.concat(F.lit("Q"), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", held.alias("part_of"))
    fixes = table(spark, sf_dir, "part").where(k % 3 < 2).select("p_partkey", F.when(k % 3 == 0, held).otherwise("Q0").alias("expected"), F.lit("Q900").alias("value"))
    return joins.guarded_updates(rows, fixes, "p_partkey", "part_of").select("p_partkey", "part_of", "outcome")


@register(
    "dossier_slice",
    "BAT-15 FLT-09",
    """SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_size % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AND p_partkey % 7 <> 0""",
)
def dossier_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of certain categories with a holder, an identifier of any kind and no summary."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, "H").alias("holder"), F.when(k % 3 == 0, "Q1").alias("qid"), F.when(k % 5 == 0, "Q2").alias("artist_qid"), F.when(k % 7 == 0, "a summary").otherwise(" ").alias("summary"))
    return rows.where(transforms.awaits_dossier(["SMALL", "PROMO"])).select("p_partkey")


@register(
    "manifest_drift",
    "JOIN-31",
    """WITH m AS (SELECT l_suppkey % 7 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), h AS (SELECT l_suppkey % 9 AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT coalesce(m.k, h.k) AS k, coalesce(m.n, 0) AS n_manifest, coalesce(h.n, 0) AS n_held FROM m FULL JOIN h ON m.k = h.k WHERE coalesce(m.n, 0) <> coalesce(h.n, 0)""",
)
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return joins.drift(lines.where("l_returnflag = 'R'").select((F.col("l_suppkey") % 7).alias("k")), lines.where("l_linestatus = 'F'").select((F.col("l_suppkey") % 9).alias("k")), "k")


@register(
    "nested_fields",
    "PRJ-12",
    """SELECT s_suppkey, 'Q' || s_nationkey AS artist_qid, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'oil' END AS medium FROM supplier""",
)
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logical field set within a struct and read again; other fields of the struct stay."""
    record = F.struct(F.struct(F.col("s_name").alias("name"), F.lit("old").alias("wikidata_q")).alias("artist"), F.when(F.col("s_suppkey") % 2 == 0, "oil").alias("medium"))
    held = table(spark, sf_dir, "supplier").select("s_suppkey", transforms.set_field(record, "artist_qid", F.concat(F.lit("Q"), F.col("s_nationkey").cast("string"))).alias("r"))
    return held.select("s_suppkey", transforms.get_field(F.col("r"), "artist_qid").alias("artist_qid"), F.col("r.artist.name").alias("name"), transforms.get_field(F.col("r"), "medium").alias("medium"))


@register(
    "known_works_order",
    "SRT-16",
    """SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey % 6 = 0 THEN 9999 ELSE 1900 + p_size END, p_name, p_partkey) AS place FROM part""",
)
def known_works_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 6 != 0, F.lit(1900) + F.col("p_size")).alias("year"))
    return windows.numbered(p, [F.coalesce("year", F.lit(9999)), F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "place")


@register(
    "triage_conservation",
    "TXT-02 FLT-23",
    """SELECT count(*) AS n, count_if(contains(lower(text), ' the ')) AS flagged, count_if(NOT contains(lower(text), ' the ')) AS clean, true AS conserved FROM documents""",
)
def triage_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts dealt into flagged and clean ones by rules, and whether none was lost or doubled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return transforms.triage(d, "text", [(r"(?i) the ", "article")])


@register(
    "genre_picks",
    "WIN-11",
    """WITH c AS (SELECT l_orderkey, l_returnflag AS genre, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_min(genre, (-n, first, genre)) AS genre FROM c GROUP BY 1""",
)
def genre_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent genre of each record; of equal ones the first seen."""
    return windows.first_seen_mode(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber").select("l_orderkey", F.col("l_returnflag").alias("genre"))


@register(
    "tag_merge",
    "CPX-10",
    """SELECT s_suppkey AS work_id, 't' AS tag, CASE WHEN s_suppkey % 3 = 0 THEN 'rejected' ELSE 'proposed' END AS state, CASE WHEN s_suppkey % 3 = 0 THEN 'vision' WHEN s_suppkey % 3 = 1 THEN 'museum' ELSE 'vision' END AS source FROM supplier""",
)
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    existing = s.where(k % 3 < 2).select(k.alias("work_id"), F.lit("t").alias("tag"), F.when(k % 3 == 0, "rejected").otherwise("proposed").alias("state"), F.lit("vision").alias("source"))
    proposed = s.select(k.alias("work_id"), F.lit("t").alias("tag"), F.lit("proposed").alias("state"), F.when(k % 3 == 2, "vision").otherwise("museum").alias("source"))
    return transforms.merged_tags(existing, proposed, ["museum", "vision"])


@register(
    "budgeted_runs",
    "STM-07",
    """SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, CAST(2 AS INTEGER) AS runs FROM events""",
)
def budgeted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work on a folder in two budgeted runs, the second resuming where the first one ended."""
    root, done = folder(spark, "incoming"), folder(spark, "done")
    checkpoint = folder(spark, "progress")
    table(spark, sf_dir, "events").select("event_id", "value").repartition(4).write.parquet(root)
    batches = [streams.budgeted(spark, root, "event_id long, value double", 2, checkpoint, done) for _ in range(2)]
    return spark.read.parquet(done).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct")).select("n", "n_distinct", F.lit(sum(batches)).alias("runs"))


@register(
    "debounced_requests",
    "STM-05",
)
def debounced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user that go out; state goes by arrival, so tests compare with a loop."""
    source = folder(spark, "requests")
    table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("double").alias("at"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "done").otherwise("request").alias("kind")).coalesce(1).orderBy("at").write.parquet(source)
    stream = streams.tail(spark, source, "key string, at double, kind string")
    return _drained(streams.debounced(stream, 5.0).where("dispatch"), "update")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    from cataloom.plans.queries_streams import _drained as drained

    return drained(stream, mode)


@register("dithered_images", "IMG-03 IMG-04 IMG-05")
def dithered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small colour images dithered to a palette, with their gamut verdicts; tests compare the kernel with a loop."""
    i = F.sequence(F.lit(0), F.lit(15))
    pixels = F.transform(i, lambda y: F.transform(i, lambda x: F.array((x * F.col("p_size") % 256).cast("int"), (y * 16).cast("int"), ((x + y) * (F.col("p_partkey") % 8)).cast("int"))))
    palette = np.array([[0, 0, 0], [255, 255, 255], [200, 30, 30], [30, 160, 60], [40, 50, 190], [230, 210, 40]])
    # A row of few bytes becomes an image of many, so rows are dealt out before.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    return images.dithered(parts.select(F.col("p_partkey").alias("id"), pixels.alias("pixels")), palette)


@register(
    "tie_counts",
    "AGG-09 SRT-03",
    """SELECT l_shipmode AS value, count(*) AS n FROM (SELECT l_linestatus || l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1""",
)
def tie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return sets.most_common(rows, "value", "ord", 100).select("value", "n")


@register(
    "lineage_levels",
    "AGG-18",
    """SELECT 'l_returnflag' AS level, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""",
)
def lineage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.lineage_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"])
