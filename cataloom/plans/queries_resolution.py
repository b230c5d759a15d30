"""Queries over stem parsers, category inference, resolution strategies and their chain, and summaries of agent metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import parsers, vocabulary
from cataloom.operators import aggregates, resolution
from cataloom.plans.catalogue import table
from cataloom.registry import register

_STEMS_SQL = """stems AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN p_partkey || '. ' || p_name || '; Jan van ' || p_brand || '; ' || (1500 + p_size) || '; oil on canvas; ' || p_size || ' x 40 cm' WHEN 1 THEN p_name || ', Anna Maler, ' || (1500 + p_size) || '-' || lpad(CAST(p_size % 90 + 10 AS VARCHAR), 2, '0') || ', etching'
    WHEN 2 THEN p_name WHEN 3 THEN p_name || ', Anna Maler; ' || (1500 + p_size) || '; tempera' WHEN 4 THEN p_name || '; Anna Maler; 18' || (p_size % 10) || '0s' WHEN 5 THEN p_name || '; Anna Maler; wood; 12 x 14 in' ELSE p_name || ', ' || p_brand END AS stem, p_name, p_brand, p_size FROM part)"""


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    year = (F.lit(1500) + size).cast("string")
    stem = (
        F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit(". "), name, F.lit("; Jan van "), F.col("p_brand"), F.lit("; "), year, F.lit("; oil on canvas; "), size.cast("string"), F.lit(" x 40 cm")))
        .when(k % 7 == 1, F.concat(name, F.lit(", Anna Maler, "), year, F.lit("-"), F.lpad((size % 90 + 10).cast("string"), 2, "0"), F.lit(", etching")))
        .when(k % 7 == 2, name)
        .when(k % 7 == 3, F.concat(name, F.lit(", Anna Maler; "), year, F.lit("; tempera")))
        .when(k % 7 == 4, F.concat(name, F.lit("; Anna Maler; 18"), (size % 10).cast("string"), F.lit("0s")))
        .when(k % 7 == 5, F.concat(name, F.lit("; Anna Maler; wood; 12 x 14 in")))
        .otherwise(F.concat(name, F.lit(", "), "p_brand"))
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), stem.alias("stem"))


@register(
    "positional_stems",
    "STR-13",
    f"""WITH {_STEMS_SQL} SELECT k, CASE WHEN k % 7 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS number, CASE WHEN k % 7 = 6 THEN stem WHEN k % 7 = 3 THEN p_name ELSE p_name END AS title, CASE k % 7 WHEN 0 THEN 'Jan van ' || p_brand WHEN 2 THEN '' WHEN 6 THEN '' ELSE 'Anna Maler' END AS artist,
        CASE k % 7 WHEN 0 THEN 1500 + p_size WHEN 1 THEN 1500 + p_size WHEN 3 THEN 1500 + p_size WHEN 4 THEN 1800 + p_size % 10 * 10 END::INTEGER AS year_min,
        CASE k % 7 WHEN 0 THEN 1500 + p_size WHEN 1 THEN CASE WHEN 1500 + p_size % 90 + 10 < 1500 + p_size THEN 1600 + p_size % 90 + 10 ELSE 1500 + p_size % 90 + 10 END WHEN 3 THEN 1500 + p_size WHEN 4 THEN 1809 + p_size % 10 * 10 END::INTEGER AS year_max,
        CASE k % 7 WHEN 0 THEN 'oil on canvas' WHEN 1 THEN 'etching' WHEN 3 THEN 'tempera' WHEN 5 THEN 'wood; 12 x 14 in' ELSE '' END AS medium, CASE WHEN k % 7 = 0 THEN p_size || ' x 40 cm' ELSE '' END AS dimensions, CASE WHEN k % 7 = 1 THEN 'comma' WHEN k % 7 IN (2, 6) THEN 'single' ELSE 'semicolon' END AS strategy FROM stems""",
)
def positional_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _stems(spark, sf_dir).select("k", parsers.positional_stem(F.col("stem")).alias("p"))
    return parsed.select("k", *[f"p.{c}" for c in ("number", "title", "artist", "year_min", "year_max", "medium", "dimensions", "strategy")])


@register(
    "stem_fragments",
    "STR-14 UDX-07",
    r"""WITH f AS (SELECT p_partkey AS k, unnest([p_name, 'Jan van Maler', CAST(1500 + p_size AS VARCHAR), (1500 + p_size) || '-70', 'c. ' || (1500 + p_size), 'Oil on canvas', 'a long walk in oil', p_size || ' x 40 cm', '30 x ' || p_size, 'From the series of days', 'Solo', 'X', '1850s']) AS fragment FROM part)
        SELECT k, fragment, CASE WHEN regexp_matches(fragment, '^\d+ x \d+ cm$') THEN 'dimensions' WHEN regexp_matches(fragment, '^\d+ x \d+$') THEN 'dimensions' WHEN fragment = 'Oil on canvas' OR fragment = 'a long walk in oil' THEN 'medium' WHEN fragment LIKE 'From the series%' THEN 'series' WHEN fragment IN ('Jan van Maler', 'Solo') THEN 'name' WHEN regexp_matches(fragment, '\d{4}') THEN 'year' ELSE 'title' END AS type,
        CASE WHEN regexp_matches(fragment, '^\d+ x \d+ cm$') THEN 0.95 WHEN regexp_matches(fragment, '^\d+ x \d+$') THEN 0.7 WHEN fragment = 'Oil on canvas' THEN 0.95 WHEN fragment = 'a long walk in oil' THEN 0.85 WHEN fragment LIKE 'From the series%' THEN 0.9 WHEN fragment = 'Jan van Maler' THEN 0.85 WHEN fragment = 'Solo' THEN 0.55 WHEN fragment LIKE '%-70' THEN 0.95 WHEN fragment = '1850s' THEN 0.9 WHEN fragment LIKE 'c. %' THEN 0.85 WHEN regexp_matches(fragment, '\d{4}') THEN 0.8 ELSE 0.4 END::DOUBLE AS confidence FROM f""",
)
def stem_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    year = (F.lit(1500) + F.col("p_size")).cast("string")
    made = [F.col("p_name"), F.lit("Jan van Maler"), year, F.concat(year, F.lit("-70")), F.concat(F.lit("c. "), year), F.lit("Oil on canvas"), F.lit("a long walk in oil"), F.concat(size, F.lit(" x 40 cm")), F.concat(F.lit("30 x "), size), F.lit("From the series of days"), F.lit("Solo"), F.lit("X"), F.lit("1850s")]
    fragments = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(*made)).alias("fragment"))
    classed = fragments.withColumn("c", parsers.fragment_class(F.col("fragment")))
    return classed.select("k", "fragment", "c.type", "c.confidence")


@register(
    "slotted_stems",
    "STR-15",
    f"""WITH {_STEMS_SQL} SELECT k, CASE WHEN k % 7 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS number, CASE WHEN k % 7 = 0 THEN p_name || ', Jan van ' || p_brand WHEN k % 7 = 5 THEN p_name || ', wood' WHEN k % 7 = 6 THEN stem ELSE p_name END AS title, CASE k % 7 WHEN 1 THEN 'Anna Maler' WHEN 3 THEN 'Anna Maler' WHEN 4 THEN 'Anna Maler' WHEN 5 THEN 'Anna Maler' ELSE '' END AS artist,
        CASE k % 7 WHEN 0 THEN CAST(1500 + p_size AS VARCHAR) WHEN 1 THEN (1500 + p_size) || '-' || lpad(CAST(p_size % 90 + 10 AS VARCHAR), 2, '0') WHEN 3 THEN CAST(1500 + p_size AS VARCHAR) WHEN 4 THEN '18' || (p_size % 10) || '0s' ELSE '' END AS year,
        CASE k % 7 WHEN 0 THEN 'oil on canvas' WHEN 1 THEN 'etching' WHEN 3 THEN 'tempera' ELSE '' END AS medium, CASE WHEN k % 7 = 0 THEN p_size || ' x 40 cm' WHEN k % 7 = 5 THEN '12 x 14 in' ELSE '' END AS dimensions, false AS ambiguous FROM stems""",
)
def slotted_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _stems(spark, sf_dir).select("k", parsers.slotted_stem(F.col("stem"), ["anna maler"]).alias("p"))
    return parsed.select("k", *[f"p.{c}" for c in ("number", "title", "artist", "year", "medium", "dimensions", "ambiguous")])


@register(
    "category_tiers",
    "STR-17 BAT-04",
    """WITH t AS (SELECT p_partkey, lower(p_type) AS technique, lower(p_name) AS title, p_size % 4 AS c FROM part)
        SELECT p_partkey, CASE WHEN regexp_matches(technique, '\\b(promo|small)\\b') THEN 'print' WHEN c = 1 THEN 'sculpture' WHEN regexp_matches(title, '\\b(ring|bolt)\\b') THEN 'drawing' END AS category, CASE WHEN c = 2 AND NOT contains(title, 'red') THEN 'painting' END AS prior FROM t""",
)
def category_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tier that names a category: technique, class, title; and the creator's prior with the title's veto."""
    kind = F.when(F.col("p_size") % 4 == 1, "statue")
    tiers = [(F.col("p_type"), [("promo|small", "print")]), (kind, [("statue", "sculpture")]), (F.col("p_name"), [("ring|bolt", "drawing")])]
    prior = vocabulary.category_prior(F.when(F.col("p_size") % 4 == 2, "painting"), F.col("p_name").contains("red"))
    return table(spark, sf_dir, "part").select("p_partkey", vocabulary.infer_category(tiers).alias("category"), prior.alias("prior"))


_WORLD_SQL = """o AS (SELECT p_partkey AS qid, p_brand AS creator, p_name AS label, CAST(1900 + p_size AS INTEGER) AS inception, CASE WHEN p_partkey % 3 = 0 THEN 'H' || p_partkey % 5 END AS collection, CASE WHEN p_partkey % 2 = 0 THEN 'L' || p_partkey % 4 END AS location, p_type AS kind, p_size AS tall, 40 AS wide FROM part),
    w AS (SELECT c_custkey AS work_id, CASE WHEN c_custkey % 9 = 4 THEN 'no such title' ELSE 'The ' || upper(label) END AS title, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'nobody' ELSE creator END AS creator, CASE WHEN c_custkey % 4 <> 3 THEN inception + c_custkey % 3 * 2 END AS year, CASE WHEN c_custkey % 2 = 0 THEN collection END AS holder, CASE WHEN c_custkey % 5 < 2 THEN kind END AS medium, CASE WHEN c_custkey % 7 = 0 THEN tall END AS height, CASE WHEN c_custkey % 7 = 0 THEN wide END AS width, CASE WHEN c_custkey % 13 = 0 THEN 3 WHEN c_custkey % 13 = 1 THEN 1 END AS retired_at FROM customer JOIN o ON qid = c_custkey)"""

_BY_CREATOR_SQL = """c0 AS (SELECT w.*, o.qid, o.collection, o.inception, o.kind, o.tall, o.wide, w.year IS NULL OR abs(w.year - o.inception) <= 2 AS sane FROM w JOIN o ON o.creator = w.creator AND 'the ' || lower(o.label) = lower(w.title)),
    c1 AS (SELECT * FROM c0 QUALIFY coalesce(collection = holder, false) OR count_if(coalesce(collection = holder, false)) OVER (PARTITION BY work_id) = 0 OR count(*) OVER (PARTITION BY work_id) = 1),
    c2 AS (SELECT * FROM c1 QUALIFY sane OR count_if(sane) OVER (PARTITION BY work_id) = 0 OR count(*) OVER (PARTITION BY work_id) = 1),
    c3 AS (SELECT * FROM c2 QUALIFY coalesce(kind = medium, false) OR count_if(coalesce(kind = medium, false)) OVER (PARTITION BY work_id) = 0 OR count(*) OVER (PARTITION BY work_id) = 1),
    c4 AS (SELECT *, coalesce(abs(least(tall, wide) - least(height, width)) / greatest(least(tall, wide), least(height, width)) <= 0.05 AND abs(greatest(tall, wide) - greatest(height, width)) / greatest(greatest(tall, wide), greatest(height, width)) <= 0.05, false) AS fits FROM c3),
    c5 AS (SELECT * FROM c4 QUALIFY fits OR count_if(fits) OVER (PARTITION BY work_id) = 0 OR count(*) OVER (PARTITION BY work_id) = 1),
    m1 AS (SELECT work_id, count(*) AS n, min(qid) AS qid, bool_and(sane) AS sane FROM c5 GROUP BY 1),
    r1 AS (SELECT w.work_id, CASE WHEN n = 1 AND m1.sane THEN m1.qid END AS qid, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND NOT m1.sane THEN 'year-mismatch' WHEN n = 1 THEN 'match' WHEN w.creator IS NULL THEN 'no-creator' WHEN w.creator = 'nobody' THEN 'no-works' ELSE 'below-threshold' END AS reason FROM w LEFT JOIN m1 USING (work_id))"""

_BY_TITLE_SQL = """u AS (SELECT lower(label) AS folded, count(DISTINCT qid) AS n, min(qid) AS qid, min(inception) AS inception FROM o GROUP BY 1),
    r2 AS (SELECT work_id, CASE WHEN n = 1 AND NOT coalesce(abs(year - inception) > 2, false) THEN qid END AS qid, CASE WHEN n IS NULL THEN 'no-hit' WHEN n > 1 THEN 'ambiguous' WHEN coalesce(abs(year - inception) > 2, false) THEN 'year-mismatch' ELSE 'match' END AS reason FROM w LEFT JOIN u ON 'the ' || folded = lower(title))"""


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Works to be resolved, and the entities."""
    k = F.col("p_partkey")
    o = table(spark, sf_dir, "part").select(
        k.alias("qid"), F.col("p_brand").alias("creator"), F.col("p_name").alias("label"), (F.lit(1900) + F.col("p_size")).cast("int").alias("inception"),
        F.when(k % 3 == 0, F.concat(F.lit("H"), (k % 5).cast("string"))).alias("collection"), F.when(k % 2 == 0, F.concat(F.lit("L"), (k % 4).cast("string"))).alias("location"),
        F.col("p_type").alias("kind"), F.col("p_size").alias("tall"), F.lit(40).alias("wide"),
    )
    c = F.col("c_custkey")
    w = table(spark, sf_dir, "customer").join(o, c == F.col("qid")).select(
        c.alias("work_id"), F.when(c % 9 == 4, "no such title").otherwise(F.concat(F.lit("The "), F.upper("label"))).alias("title"),
        F.when(c % 10 == 0, F.lit(None)).when(c % 10 == 1, "nobody").otherwise(F.col("creator")).alias("creator"), F.when(c % 4 != 3, F.col("inception") + c % 3 * 2).alias("year"),
        F.when(c % 2 == 0, F.col("collection")).alias("holder"), F.when(c % 5 < 2, F.col("kind")).alias("medium"), F.when(c % 7 == 0, F.col("tall")).alias("height"), F.when(c % 7 == 0, F.col("wide")).alias("width"),
        F.when(c % 13 == 0, 3).when(c % 13 == 1, 1).alias("retired_at"),
    )
    return w, o


@register("creator_matches", "JOIN-13 JOIN-18", f"""WITH {_WORLD_SQL}, {_BY_CREATOR_SQL} SELECT * FROM r1""")
def creator_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, oeuvre = _world(spark, sf_dir)
    return resolution.match_by_creator(works, oeuvre)


@register("unique_titles", "JOIN-17", f"""WITH {_WORLD_SQL}, {_BY_TITLE_SQL} SELECT * FROM r2""")
def unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, oeuvre = _world(spark, sf_dir)
    return resolution.match_by_title(works, oeuvre)


@register(
    "holder_matches",
    "JOIN-14 BAT-06",
    f"""WITH {_WORLD_SQL}, {_BY_CREATOR_SQL} SELECT work_id, coalesce(collection, CASE WHEN work_id % 4 = 2 THEN location END) AS holder, CASE WHEN collection IS NOT NULL THEN 'collection' WHEN work_id % 4 = 2 AND location IS NOT NULL THEN 'location' ELSE 'no-collection' END AS kind FROM r1 JOIN o USING (qid)""",
)
def holder_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, oeuvre = _world(spark, sf_dir)
    return resolution.holders(resolution.match_by_creator(works, oeuvre), oeuvre, works.where("work_id % 4 = 2"))


@register(
    "title_locations",
    "JOIN-15",
    """WITH p AS (SELECT DISTINCT s_nationkey AS creator, s_suppkey % 3 AS location, CASE s_suppkey % 3 WHEN 0 THEN 'Chapel of Scrovegni' WHEN 1 THEN 'Great Hall' ELSE 'The old chapel' END AS label FROM supplier),
        w AS (SELECT c_custkey AS work_id, c_nationkey AS creator, CASE c_custkey % 4 WHEN 0 THEN 'Scrovegni - 20. Lament' WHEN 1 THEN 'In the great church' WHEN 2 THEN 'Scrovegni and the great' ELSE 'chapel' END AS title FROM customer),
        h AS (SELECT work_id, count(DISTINCT location) AS n, min(location) AS location FROM w JOIN p USING (creator) WHERE (location = 0 AND contains(title, 'Scrovegni')) OR (location = 1 AND contains(title, 'great')) GROUP BY 1)
        SELECT work_id, CASE WHEN n = 1 THEN location END AS location, CASE WHEN creator NOT IN (SELECT creator FROM p) THEN 'no-location' WHEN n IS NULL THEN 'no-location-in-title' WHEN n > 1 THEN 'ambiguous' ELSE 'match' END AS reason FROM w LEFT JOIN h USING (work_id)""",
)
def title_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("creator"), (k % 3).alias("location"), F.when(k % 3 == 0, "Chapel of Scrovegni").when(k % 3 == 1, "Great Hall").otherwise("The old chapel").alias("label")).distinct()
    c = F.col("c_custkey")
    title = F.when(c % 4 == 0, "Scrovegni - 20. Lament").when(c % 4 == 1, "In the great church").when(c % 4 == 2, "Scrovegni and the great").otherwise("chapel")
    works = table(spark, sf_dir, "customer").select(c.alias("work_id"), F.col("c_nationkey").alias("creator"), title.alias("title"))
    return resolution.locations_from_titles(works, places, ["chapel", "hall", "church"])


@register(
    "swapped_titles",
    "JOIN-33 BAT-10",
    """WITH p AS (SELECT s_suppkey AS creator, translate(s_name, '#0123456789', ' abcdefghij') AS name FROM supplier), o AS (SELECT p_partkey % 10 + 1 AS creator, p_partkey AS qid, p_name AS label FROM part),
        w AS (SELECT p.creator * 100 + x AS work_id, CASE WHEN x = 0 THEN upper(p.name) ELSE 'a title' END AS title, o.label AS artist, p.creator FROM p JOIN o ON o.qid = p.creator, (SELECT unnest([0, 1]) AS x))
        SELECT work_id, min(w.creator) AS creator, min(o.qid) AS qid FROM w JOIN o ON o.creator = w.creator AND o.label = w.artist WHERE title <> 'a title' GROUP BY work_id HAVING count(DISTINCT o.qid) = 1""",
)
def swapped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("creator"), F.translate("s_name", "#0123456789", " abcdefghij").alias("name"))
    oeuvre = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10 + 1).alias("creator"), F.col("p_partkey").alias("qid"), F.col("p_name").alias("label"))
    named = people.join(oeuvre.select(F.col("qid").alias("creator"), "label"), "creator")
    works = named.select((F.col("creator") * 100).alias("work_id"), F.upper("name").alias("title"), F.col("label").alias("artist"))
    works = works.unionByName(named.select((F.col("creator") * 100 + 1).alias("work_id"), F.lit("a title").alias("title"), F.col("label").alias("artist")))
    return resolution.swapped_columns(works, people, oeuvre)


@register(
    "person_matches",
    "JOIN-34 BAT-03",
    """SELECT 'Jan ' || translate(s_name, '#0123456789', ' abcdefghij') AS raw, s_suppkey AS qid, 1.0::DOUBLE AS score FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey % 3 <> 0""",
)
def person_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against humans of an art occupation, meeting on their last word."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Jan "), F.translate("s_name", "#0123456789", " abcdefghij"))
    s = table(spark, sf_dir, "supplier")
    people = s.select(k.alias("qid"), F.upper(name).alias("name"), (k % 4 != 1).alias("human"), F.when(k % 3 == 0, "politician").otherwise("painter").alias("occupation"))
    return resolution.match_people(s.select(name.alias("raw")), people, ["painter", "sculptor"])


@register(
    "resolution_chain",
    "ITR-07 UDX-03 FLT-07",
    f"""WITH {_WORLD_SQL}, {_BY_CREATOR_SQL}, {_BY_TITLE_SQL}
        SELECT work_id, coalesce(r1.qid, r2.qid) AS qid, CASE WHEN r1.qid IS NOT NULL THEN 'by-creator' WHEN r2.qid IS NOT NULL THEN 'title-search' END AS method, CASE WHEN r1.qid IS NOT NULL THEN ['by-creator:' || r1.reason] ELSE ['by-creator:' || r1.reason, 'title-search:' || r2.reason] END AS tried, CASE WHEN r1.qid IS NULL AND r2.qid IS NULL THEN 2 END AS retired_at
        FROM r1 JOIN r2 USING (work_id) JOIN w USING (work_id) WHERE coalesce(w.retired_at, -1) < 2""",
)
def resolution_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that no plan of this version has retired: by creator, then by title; the rest is retired."""
    works, oeuvre = _world(spark, sf_dir)
    strategies = {"by-creator": lambda rest: resolution.match_by_creator(rest, oeuvre), "title-search": lambda rest: resolution.match_by_title(rest, oeuvre)}
    return resolution.resolve(works, strategies, 2)


@register(
    "variant_matches",
    "JOIN-16 STR-10",
    """WITH o AS (SELECT p_partkey AS qid, p_brand AS creator, p_name AS label, 1900 + p_size AS inception FROM part), w AS (SELECT p_partkey AS work_id, p_brand AS creator, 1900 + p_size + p_partkey % 4 AS year, p_name AS t FROM part),
        h AS (SELECT work_id, count(DISTINCT o.qid) AS n, min(o.qid) AS qid FROM w JOIN o ON o.creator = w.creator AND abs(year - inception) <= 2 AND (label = t OR (len(list_distinct(string_split(t, ' '))) >= 2 AND list_distinct(string_split(label, ' ')) = list_distinct(string_split(t, ' ')))) GROUP BY 1)
        SELECT work_id, CASE WHEN n = 1 THEN qid END AS qid, CASE WHEN n IS NULL THEN 'no-hit' WHEN n > 1 THEN 'ambiguous' ELSE 'match' END AS reason FROM w LEFT JOIN h USING (work_id)""",
)
def variant_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with copy numbers and parentheses against the creator's works."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    oeuvre = p.select(k.alias("qid"), F.col("p_brand").alias("creator"), F.col("p_name").alias("label"), (F.lit(1900) + F.col("p_size")).alias("inception"))
    title = F.when(k % 2 == 0, F.concat("p_name", F.lit(" (after a print)"))).otherwise(F.concat("p_name", F.lit(" no. 3")))
    works = p.select(k.alias("work_id"), F.col("p_brand").alias("creator"), (F.lit(1900) + F.col("p_size") + k % 4).alias("year"), title.alias("title"))
    return resolution.match_by_variants(works, oeuvre, least=1.0)


_METRICS_SQL = """m AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@register(
    "keepalive_summary",
    "AGG-12",
    f"""WITH {_METRICS_SQL} SELECT count(*) AS entries, count(DISTINCT user_id) AS prs, round(avg(CASE WHEN event_id % 6 <> 0 THEN k END), 6) AS avg_iterations, count_if(event_type = 'purchase') AS completed, round(count_if(event_type = 'purchase') / count(*)::DOUBLE, 6) AS completion_rate, count_if(event_type = 'error') AS failed, max(k) AS most_iterations FROM m""",
)
def keepalive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("iterations", F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.col("k").cast("string")))
    return aggregates.keepalive_summary(m, "user_id", "iterations", "event_type", "purchase", "error")


@register(
    "autofix_summary",
    "AGG-13",
    f"""WITH {_METRICS_SQL} SELECT event_type AS trigger, count(*) AS attempts, count_if(k >= 50) AS applied, round(count_if(k >= 50) / count(*)::DOUBLE, 6) AS applied_rate, count(DISTINCT user_id) AS prs FROM m GROUP BY 1""",
)
def autofix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.autofix_summary(_metrics(spark, sf_dir).withColumn("applied", F.col("k") >= 50), "event_type", "applied", "user_id")


@register(
    "verifier_counters",
    "AGG-14",
    f"""WITH {_METRICS_SQL}, r AS (SELECT *, coalesce(CASE WHEN event_id % 3 = 0 THEN 'r' || user_id END, 'e' || event_id) AS run FROM m)
        SELECT count(*) AS entries, count(DISTINCT run) AS runs, count_if(event_type = 'view') AS passed, count_if(event_type = 'error') AS failed, count_if(event_type NOT IN ('view', 'error')) AS other, count_if(k IS NULL) AS unscored, count_if(k >= 50) AS confident, count_if(event_type = 'error' AND k >= 50) AS confident_failures, count(DISTINCT CASE WHEN event_type = 'error' THEN run END) AS failing_runs, count(DISTINCT CASE WHEN k < 10 THEN user_id END) AS doubtful_prs, round(avg(value), 6) AS mean_cost, min(ts) AS first_ts, max(ts) AS last_ts FROM r""",
)
def verifier_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    run = F.coalesce(F.when(e % 3 == 0, F.concat(F.lit("r"), F.col("user_id").cast("string"))), F.concat(F.lit("e"), e.cast("string")))
    rows = _metrics(spark, sf_dir).select(run.alias("run"), F.col("user_id").alias("pr"), F.col("event_type").alias("verdict"), F.col("k").alias("confidence"), F.col("value").alias("cost"), "ts")
    return aggregates.verifier_counters(rows, "view", "error", 50, 10)


@register(
    "freshness_summary",
    "AGG-17",
    f"""WITH {_METRICS_SQL}, t AS (SELECT unnest(CASE WHEN k % 3 = 0 THEN ['cli', event_type] WHEN k % 3 = 1 THEN ['cli'] ELSE [] END) AS target, k FROM m) SELECT target, count(*) AS n, max(k) AS most_behind, (SELECT max(CASE WHEN event_id % 4 <> 0 THEN k ELSE 0 END) FROM m) AS overall FROM t GROUP BY target""",
)
def freshness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    targets = F.when(F.col("k") % 3 == 0, F.array(F.lit("cli"), F.col("event_type"))).when(F.col("k") % 3 == 1, F.array(F.lit("cli"))).otherwise(F.array().cast("array<string>"))
    rows = m.select(targets.alias("targets"), F.col("k").alias("behind"), F.when(F.col("event_id") % 4 == 0, "unknown").otherwise(F.col("k").cast("string")).alias("delta"))
    return aggregates.freshness_summary(rows)


@register(
    "tag_basis",
    "AGG-31 CPX-10",
    """WITH t AS (SELECT s_suppkey AS tag, s_suppkey % 2 = 0 AS rule, s_suppkey % 3 = 0 AS negatives, s_suppkey % 5 = 0 AS curated FROM supplier) SELECT tag, CASE WHEN NOT rule THEN 'inert' WHEN negatives THEN 'contrastive' WHEN curated THEN 'curated' ELSE 'provisional' END AS basis FROM t""",
)
def tag_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    rules = s.where(k % 2 == 0).select(k.alias("tag"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("negatives"))
    return aggregates.policy_basis(s.select(k.alias("tag")), rules, s.where(k % 5 == 0).select(k.alias("tag")))


