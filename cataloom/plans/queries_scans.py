"""Queries over scans and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import dates, nested, text, vocabulary
from cataloom.operators import aggregates, sets, windows
from cataloom.plans.catalogue import INVENTORY_SQL, RATINGS_SQL, WORKS_SQL, inventory, rating_events, table, works
from cataloom.registry import register
from cataloom.sources import readers, sinks


@register(
    "scan_clean_projection",
    "PRJ-01 PRJ-09 DAT-01",
    f"""WITH {WORKS_SQL} SELECT work_id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, coalesce(artist, 'Unknown') AS creator,
        coalesce(CAST(year AS VARCHAR), '') AS date,
        CASE WHEN year IS NULL THEN 'western-painting-unknown-period' WHEN year < 1800 THEN 'western-painting-pre1800' WHEN year < 1900 THEN 'western-painting-19c' ELSE 'western-painting-modern' END AS work_class
        FROM works WHERE regexp_matches(CAST(work_id AS VARCHAR), '^[A-Za-z0-9._-]+$')""",
)
def scan_clean_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir)
    year = dates.best_year(F.col("year"))
    return w.where(F.col("work_id").cast("string").rlike("^[A-Za-z0-9._-]+$")).select(
        "work_id",
        F.coalesce(nested.blank_to_null(F.col("title")), F.lit("Untitled")).alias("title"),
        F.coalesce("artist", F.lit("Unknown")).alias("creator"),
        F.coalesce(year.cast("string"), F.lit("")).alias("date"),
        vocabulary.work_class(F.lit("painting"), year).alias("work_class"),
    )


_LINES = "CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN substr(props, 1, 4) WHEN 2 THEN '[1, 2]' ELSE props END"


@register(
    "corrupt_line_accounting",
    "SRC-05 AGG-20 STM-01",
    f"""SELECT reason, count(*) AS n FROM (SELECT {_LINES} AS value FROM events) l,
        LATERAL (SELECT CASE WHEN NOT json_valid(value) THEN 'invalid-json' WHEN json_type(CASE WHEN json_valid(value) THEN value END) <> 'OBJECT' THEN 'non-object-json' ELSE 'parsed' END AS reason)
        WHERE trim(value) <> '' GROUP BY reason""",
)
def corrupt_line_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_LINES).alias("value"))
    good, bad = readers.parse_lines(lines, "k int")
    return sets.union_all([good.select(F.lit("parsed").alias("reason")), bad.select("reason")]).groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "overflow_error_rollup",
    "AGG-20 AGG-28",
    """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (ORDER BY n DESC, event_type, user_id) AS rn FROM c)
        SELECT CASE WHEN rn <= 20 THEN event_type ELSE '(overflow)' END AS event_type, CASE WHEN rn <= 20 THEN CAST(user_id AS VARCHAR) ELSE '(overflow)' END AS user_id, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
)
def overflow_error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("bigint").alias("user_id"))
    counts = rows.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "event_type", "user_id").limit(20)
    rest = counts.join(top, ["event_type", "user_id"], "left_anti").agg(F.lit("(overflow)").alias("event_type"), F.lit("(overflow)").alias("user_id"), F.sum("n").alias("n"))
    return top.select("event_type", F.col("user_id").cast("string").alias("user_id"), "n").unionByName(rest.where("n IS NOT NULL"))


@register(
    "json_variant_bucket",
    "AGG-19",
    """SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 75 THEN 'high' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 25 THEN 'middle' ELSE 'low' END AS bucket,
        count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1""",
)
def json_variant_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    bucket = F.when(k >= 75, "high").when(k >= 25, "middle").otherwise("low").alias("bucket")
    return table(spark, sf_dir, "events").select(bucket, "ts").groupBy("bucket").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register(
    "path_domain_projection",
    "PRJ-13",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain,
        split_part(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/', 1) AS family, len(regexp_extract_all(lower(html), 'href')) >= 2 AS linked,
        1.0::DOUBLE + CASE WHEN regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '\.(edu|gov)(\.|$)') THEN 0.5 ELSE 0.0 END AS authority FROM pages""",
)
def path_domain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = text.domain_of(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        domain.alias("domain"),
        F.split_part(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), F.lit("/"), F.lit(1)).alias("family"),
        (F.regexp_count(F.lower("html"), F.lit("href")) >= 2).alias("linked"),
        text.authority_score(domain, {}).alias("authority"),
    )


@register(
    "list_page",
    "JOIN-01 PRJ-07 WIN-01 FLT-03",
    f"""WITH {INVENTORY_SQL}, {RATINGS_SQL},
        page AS (SELECT rel_id, title, artist FROM inventory WHERE contains(lower(title), 'ring') OR contains(lower(artist), 'ring') ORDER BY rel_id LIMIT 25 OFFSET 10),
        latest AS (SELECT work_id, arg_max(quality, (ts, row_id)) FILTER (WHERE quality IS NOT NULL) AS quality, count(*) AS n_ratings FROM ratings GROUP BY work_id)
        SELECT p.rel_id, p.title, p.artist, l.quality, coalesce(l.n_ratings, 0) AS n_ratings FROM page p LEFT JOIN latest l ON l.work_id = p.rel_id""",
)
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.operators.filters import matches_query

    found = inventory(spark, sf_dir).where(matches_query("ring", F.col("title"), F.col("artist"), F.lit(""))).select("rel_id", "title", "artist")
    page = sets.page(found, [F.col("rel_id")], 10, 25)
    latest = rating_events(spark, sf_dir).groupBy("work_id").agg(F.max_by("quality", F.when(F.col("quality").isNotNull(), F.struct("ts", "row_id"))).alias("quality"), F.count("*").alias("n_ratings"))
    return page.join(latest, page["rel_id"] == latest["work_id"], "left").select("rel_id", "title", "artist", "quality", F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"))


@register(
    "source_union_projection",
    "PRJ-04 PRJ-05 PRJ-11 SET-01",
    """SELECT 'supplier' AS source, s_suppkey AS id, s_name AS name, n_name AS place, NULL::DOUBLE AS amount, 'public-domain' AS rights FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 'customer', c_custkey, c_name, NULL, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'public-domain' ELSE 'rights-reserved' END FROM customer""",
)
def source_union_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey"))
    suppliers = s.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), nested.first_present(F.col("s_name")).alias("name"), F.col("n_name").alias("place"), F.lit("CC0").alias("raw"))
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), nested.first_present(F.col("c_name")).alias("name"), F.col("c_acctbal").alias("amount"), F.when(F.col("c_mktsegment") == "BUILDING", "Public_Domain").otherwise("all rights").alias("raw"))
    folded = F.lower(F.regexp_replace("raw", r"[\s_]+", " "))
    both = sets.union_all([suppliers, customers])
    return both.select("source", "id", "name", "place", "amount", F.when(folded.isin("cc0", "public domain", "pd"), "public-domain").otherwise("rights-reserved").alias("rights"))


@register(
    "display_hints",
    "PRJ-10 PRJ-14 MTH-03 FLT-26",
    """WITH d AS (SELECT p_partkey AS id, p_size * 10 AS w_px, CAST(1 + p_partkey % 400 AS INTEGER) AS h_px FROM part)
        SELECT id, CASE WHEN abs(w_px / h_px::DOUBLE - 1) <= 0.05 THEN 'square' WHEN w_px > h_px THEN 'landscape' ELSE 'portrait' END AS orientation,
        CASE WHEN abs(w_px / h_px::DOUBLE - 16 / 9.0::DOUBLE) / (16 / 9.0::DOUBLE) <= 0.005 THEN '16:9' WHEN abs(w_px / h_px::DOUBLE - 9 / 16.0::DOUBLE) / (9 / 16.0::DOUBLE) <= 0.005 THEN '9:16' END AS display_role,
        CASE WHEN least(w_px / 250.0::DOUBLE, h_px / 200.0::DOUBLE) >= 1.0 THEN 'fit' WHEN least(w_px / 250.0::DOUBLE, h_px / 200.0::DOUBLE) >= 0.75 THEN 'borderline' ELSE 'unfit' END AS gate FROM d""",
)
def display_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.operators.filters import device_gate

    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10).alias("w_px"), (F.lit(1) + F.col("p_partkey") % 400).cast("int").alias("h_px"))
    gated = device_gate(d, spark.createDataFrame([("wall", 250.0, 200.0)], "device string, need_w double, need_h double"))
    ratio = F.col("w_px") / F.col("h_px").cast("double")

    def role(target: float) -> object:
        return F.abs(ratio - target) / target <= 0.005

    orientation = F.when(F.abs(ratio - 1) <= 0.05, "square").when(F.col("w_px") > F.col("h_px"), "landscape").otherwise("portrait")
    return gated.select("id", orientation.alias("orientation"), F.when(role(16 / 9), "16:9").when(role(9 / 16), "9:16").alias("display_role"), "gate")


@register(
    "json_document_projection",
    "PRJ-16 CPX-07",
    """SELECT doc_id, '{"id":"' || doc_id || '","label":"' || source || '"' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"language":"' || lang || '"' END || '}' AS document,
        substr(sha256(doc_id || '|' || source || '|' || n_chars), 1, 16) AS etag FROM documents""",
)
def json_document_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    document = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("label"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("language")))
    return d.select("doc_id", document.alias("document"), nested.item_etag(F.col("doc_id"), F.col("source"), F.col("n_chars")).alias("etag"))


@register(
    "tag_projection",
    "PRJ-19 STR-27",
    """WITH r AS (SELECT doc_id, lower(text) AS t FROM documents)
        SELECT doc_id, list_filter([CASE WHEN contains(t, 'http') THEN 'has:link' END, CASE WHEN contains(t, 'license') THEN 'has:license' END, CASE WHEN contains(t, '@') THEN 'has:address' END], lambda x: x IS NOT NULL) AS tags,
        CASE WHEN contains(t, 'license') THEN 'legal' WHEN contains(t, '|') THEN 'table' ELSE 'prose' END AS category FROM r""",
)
def tag_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    rules = [("http", "has:link"), ("license", "has:license"), ("@", "has:address")]
    return table(spark, sf_dir, "documents").select("doc_id", text.all_rules(t, rules).alias("tags"), text.first_rule(t, [("license", "legal"), (r"\|", "table")], "prose").alias("category"))


@register(
    "fact_sentences",
    "PRJ-06",
    f"""WITH {WORKS_SQL} SELECT work_id, list_filter([CASE WHEN artist IS NOT NULL THEN 'By ' || artist || '.' END, CASE WHEN year IS NOT NULL THEN 'Made in ' || year || '.' END, CASE WHEN genre IS NOT NULL THEN 'A ' || genre || '.' END], lambda x: x IS NOT NULL) AS facts FROM works""",
)
def fact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.array(
        F.concat(F.lit("By "), "artist", F.lit(".")),
        F.concat(F.lit("Made in "), F.col("year").cast("string"), F.lit(".")),
        F.concat(F.lit("A "), "genre", F.lit(".")),
    )
    return works(spark, sf_dir).select("work_id", F.filter(facts, lambda f: f.isNotNull()).alias("facts"))


@register(
    "bag_manifest",
    "SNK-08 AGG-27 AGG-33",
    """SELECT sha256(text) || '  data/' || doc_id AS line, (SELECT CAST(sum(n_chars) AS VARCHAR) || '.' || count(*) FROM documents) AS oxum FROM documents""",
)
def bag_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("data/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"))
    lines, oxum = sinks.bag_manifest(files)
    return lines.join(F.broadcast(oxum.select("oxum"))).select(F.col("value").alias("line"), "oxum")


@register(
    "export_numbering",
    "SNK-09 WIN-09",
    """WITH i AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN url END AS master FROM pages),
        j AS (SELECT page_id, CASE WHEN master IS NULL THEN 'no-master' END AS skipped FROM i)
        SELECT page_id, skipped, CASE WHEN skipped IS NULL THEN lpad(CAST(row_number() OVER (PARTITION BY skipped IS NULL ORDER BY page_id) AS VARCHAR), 4, '0') || '.png' END AS file FROM j""",
)
def export_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("master"))
    return sinks.export_plan(items, ["page_id"]).select("page_id", "skipped", "file")


@register(
    "idempotent_upsert",
    "STM-06",
    """WITH h AS (SELECT o_orderkey AS run_id, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS run_id, -o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0)
        SELECT * FROM n UNION ALL SELECT * FROM h WHERE run_id NOT IN (SELECT run_id FROM n)""",
)
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.operators.transforms import upsert_runs

    o = table(spark, sf_dir, "orders")
    history = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("v"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"), (-F.col("o_totalprice")).alias("v"))
    return upsert_runs(history, new, "run_id", ("run_id",))


@register(
    "live_requests",
    "WIN-14 DAT-05",
    """WITH live AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)
        SELECT user_id, arg_max(event_id, event_id) AS event_id, count(*) AS n_live FROM live GROUP BY user_id""",
)
def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    live = e.where(dates.is_live(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 10))
    return live.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n_live"))


@register(
    "reference_names",
    "SRC-23",
    """WITH f AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 70), x AS (SELECT trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]+', ' ', 'g')) AS v FROM f)
        SELECT 'full' AS kind, v AS value FROM x UNION SELECT 'surname', split_part(v, ' ', -1) FROM x WHERE length(split_part(v, ' ', -1)) >= 4""",
)
def reference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.reference_names(table(spark, sf_dir, "part"), "p_brand", 70)


@register(
    "markdown_and_files",
    "SRC-16",
    r"""WITH l AS (SELECT n_nationkey, '| ' || n_name || ' | ' || n_nationkey || ' | ' || n_regionkey || ' | x |' AS value FROM nation)
        SELECT trim(string_split(trim(value, '|'), '|')[1]) AS name, CAST(trim(string_split(trim(value, '|'), '|')[2]) AS INTEGER) AS nation, 4 AS n_cells FROM l""",
)
def markdown_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" | x |")).alias("value"))
    rulers = spark.createDataFrame([("| --- | --- | --- | --- |",), ("prose",), ("| a | b |",)], "value string")
    rows = readers.markdown_rows(lines.unionByName(rulers))
    return rows.select(F.col("cells")[0].alias("name"), F.col("cells")[1].cast("int").alias("nation"), F.size("cells").alias("n_cells"))


@register(
    "relation_signature",
    "AGG-33",
    """SELECT CAST(sum(event_id) AS BIGINT) AS sum_modified, CAST(sum(user_id) AS BIGINT) AS sum_size, count(*) AS n FROM events""",
)
def relation_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.relation_signature(table(spark, sf_dir, "events"), "event_id", "user_id")


@register(
    "seek_page",
    "SRT-18",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100",
)
def seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.after_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 100)


@register(
    "series_order",
    "WIN-13 AGG-30",
    """WITH s AS (SELECT l_orderkey AS series, l_linenumber AS position, l_partkey AS arrival FROM lineitem),
        v AS (SELECT series, CASE WHEN position % 4 <> 0 THEN position END AS position, arrival FROM s)
        SELECT series, arrival, position, row_number() OVER (PARTITION BY series ORDER BY position IS NULL, coalesce(position, arrival), arrival) AS place FROM v
        QUALIFY count(*) OVER (PARTITION BY series, position, arrival) = 1""",
)
def series_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).alias("position"), F.col("l_partkey").alias("arrival"))
    placed = windows.series_order(li, ["series"], "position", "arrival")
    twins = F.count("*").over(Window.partitionBy("series", "position", "arrival"))
    return placed.withColumn("twins", twins).where("twins = 1").select("series", "arrival", "position", F.col("place").cast("bigint").alias("place"))
