"""Queries over filters, validation and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import nested, numbers, text
from cataloom.operators import aggregates, filters, joins, sets, windows
from cataloom.plans import playlist
from cataloom.plans.catalogue import RATINGS_SQL, WORKS_SQL, rating_events, table, works
from cataloom.registry import register

_SPEC = playlist.PlaylistSpec(genres=("painting/en", "painting/fr"), periods=("renaissance", "18th-century", "19th-century"), not_tags=("filter:death",), min_fit=2, sort="fit", limit=40)
_JUDGED_SQL = f"""WITH {WORKS_SQL}, {RATINGS_SQL}, axes AS (SELECT work_id, arg_max(fit, row_id) FILTER (WHERE fit IS NOT NULL) AS fit, arg_max(quality, row_id) FILTER (WHERE quality IS NOT NULL) AS quality FROM ratings GROUP BY work_id),
    j AS (SELECT w.*, a.fit, a.quality, CASE WHEN genre IS NULL THEN 'no genre' WHEN genre NOT IN ('painting/en', 'painting/fr') THEN 'filtered' WHEN year IS NULL THEN 'no year'
        WHEN NOT (year BETWEEN 1400 AND 1600 OR year BETWEEN 1700 AND 1800 OR year BETWEEN 1800 AND 1900) THEN 'filtered' WHEN list_contains(tags, 'filter:death') THEN 'filtered'
        WHEN fit IS NULL THEN 'unrated (fit)' WHEN fit < 2 THEN 'filtered' END AS verdict FROM works w LEFT JOIN axes a USING (work_id))"""


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_non_null(rating_events(spark, sf_dir), ["work_id"], ["fit", "quality"])


@register(
    "playlist_filter",
    "FLT-01 SRT-04 SRC-06 WIN-02 SET-07 JOIN-32",
    f"""{_JUDGED_SQL} SELECT work_id, artist, genre, year, title, fit, quality, tags FROM j WHERE verdict IS NULL ORDER BY coalesce(fit, -1) DESC, title, work_id LIMIT 40""",
)
def playlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlist.select_playlist(works(spark, sf_dir), _SPEC, _axes(spark, sf_dir))


@register(
    "playlist_by_fit",
    "FLT-01 SRT-04 SRC-06 WIN-02",
    f"""{_JUDGED_SQL} SELECT work_id, artist, genre, year, title, fit, quality, tags FROM j WHERE genre IN ('painting/en', 'painting/fr') AND year >= 1400 ORDER BY coalesce(fit, -1) DESC, title, work_id LIMIT 40""",
)
def playlist_by_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = playlist.PlaylistSpec(genres=("painting/en", "painting/fr"), year_from=1400, sort="fit", limit=40)
    return playlist.select_playlist(works(spark, sf_dir), spec, _axes(spark, sf_dir))


@register("playlist_drop_reasons", "FLT-01", f"""{_JUDGED_SQL} SELECT coalesce(verdict, 'matched') AS reason, count(*) AS n FROM j GROUP BY 1""")
def playlist_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlist.drop_reasons(works(spark, sf_dir), _SPEC, _axes(spark, sf_dir))


@register(
    "mood_predicate_tags",
    "FLT-02 SET-07 AGG-06",
    f"""WITH {WORKS_SQL}, m AS (SELECT unnest(list_filter([
        CASE WHEN list_contains(tags, 'setting:interior') AND NOT list_has_any(tags, ['filter:death', 'theme:war']) THEN 'quiet-interior' END,
        CASE WHEN list_contains(tags, 'setting:outdoor') AND NOT list_contains(tags, 'setting:night') THEN 'open-air' END,
        CASE WHEN list_contains(tags, 'setting:night') THEN 'nocturne' END, CASE WHEN list_contains(tags, 'palette:cool-toned') THEN 'cool-and-still' END,
        CASE WHEN list_contains(tags, 'subject:ship') THEN 'sea-and-ships' END], lambda x: x IS NOT NULL)) AS mood FROM works)
        SELECT mood, count(*) AS n FROM m GROUP BY mood""",
)
def mood_predicate_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlist.mood_facets(works(spark, sf_dir))


@register(
    "facet_rollup",
    "AGG-06 AGG-07 SRT-03",
    f"""WITH {WORKS_SQL}, p AS (SELECT split_part(t, ':', 1) AS family, substr(t, strpos(t, ':') + 1) AS value FROM (SELECT unnest(tags) AS t FROM works)
        UNION ALL SELECT 'genre', genre FROM works WHERE genre IS NOT NULL UNION ALL SELECT 'artist', artist FROM works WHERE artist IS NOT NULL)
        SELECT family, value, count(*) AS n FROM p GROUP BY ROLLUP (family, value) HAVING family IS NOT NULL""",
)
def facet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlist.facet_counts(works(spark, sf_dir))


@register(
    "period_range_join",
    "JOIN-32",
    """WITH p(name, lo, hi) AS (VALUES ('early', 1995, 1997), ('middle', 1997, 1999), ('late', 1999, 2001))
        SELECT o_orderkey, name FROM orders JOIN p ON year(o_orderdate) BETWEEN lo AND hi""",
)
def period_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("early", 1995, 1997), ("middle", 1997, 1999), ("late", 1999, 2001)], "name string, low int, high int")
    dated = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return joins.in_ranges(dated, ranges, "year").select("o_orderkey", "name")


@register(
    "eligibility_queue",
    "FLT-07 SRT-18",
    """WITH s AS (SELECT o_orderkey AS work_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'derived' WHEN o_orderpriority = '5-LOW' THEN 'resolved' WHEN o_orderkey % 5 = 0 THEN 'adjudicated'
        WHEN o_orderkey % 4 + 1 >= 3 THEN 'retired' ELSE 'eligible' END AS state FROM orders)
        SELECT * FROM s WHERE state = 'eligible' ORDER BY work_id LIMIT 500""",
)
def eligibility_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = filters.eligibility((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0), F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 5 == 0, F.concat(F.lit("plan v"), (F.col("o_orderkey") % 4 + 1).cast("string")), 3)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), state.alias("state"))
    return o.where("state = 'eligible'").orderBy("work_id").limit(500)


@register(
    "eligibility_counts",
    "FLT-07 AGG-24 AGG-35",
    """WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'derived' WHEN o_orderpriority = '5-LOW' THEN 'resolved' WHEN o_orderkey % 5 = 0 THEN 'adjudicated'
        WHEN o_orderkey % 4 + 1 >= 3 THEN 'retired' ELSE 'eligible' END AS state FROM orders), e(place, state) AS (VALUES (0, 'derived'), (1, 'resolved'), (2, 'adjudicated'), (3, 'retired'), (4, 'eligible'), (5, 'unknown'))
        SELECT place, e.state, count(s.state) AS n FROM e LEFT JOIN s USING (state) GROUP BY ALL""",
)
def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = filters.eligibility((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0), F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 5 == 0, F.concat(F.lit("plan v"), (F.col("o_orderkey") % 4 + 1).cast("string")), 3)
    rows = table(spark, sf_dir, "orders").select(state.alias("state"))
    return aggregates.ordered_tally(rows, "state", ["derived", "resolved", "adjudicated", "retired", "eligible", "unknown"])


@register(
    "validation_violations",
    "FLT-14 MTH-09",
    """WITH r AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS name, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
        v AS (SELECT event_id, list_filter([CASE WHEN name IS NULL THEN 'missing-name' END, CASE WHEN value < 1 THEN 'value-low' END, CASE WHEN k > 90 AND name = 'error' THEN 'error-high' END], lambda x: x IS NOT NULL) AS violations FROM r)
        SELECT event_id, violations FROM v WHERE len(violations) > 0""",
)
def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("name"), "value", k.alias("k"))
    rules = {"missing-name": F.col("name").isNull(), "value-low": F.col("value") < 1, "error-high": (F.col("k") > 90) & (F.col("name") == "error")}
    return filters.with_violations(rows, rules).where(F.size("violations") > 0).select("event_id", "violations")


@register(
    "metric_record_rules",
    "FLT-14 MTH-09 DAT-04",
    """WITH r AS (SELECT event_id, event_type = 'error' AS failed, event_id % 3 = 0 AS reasoned, event_id % 4 <> 0 AS zoned, event_id % 5 = 0 AS noname FROM events)
        SELECT event_id, list_filter([CASE WHEN noname THEN 'missing-step_name' END, CASE WHEN NOT failed AND reasoned THEN 'success-with-reason' END, CASE WHEN failed AND NOT reasoned THEN 'failure-without-reason' END,
        CASE WHEN NOT zoned THEN 'time-without-zone' END], lambda x: x IS NOT NULL) AS violations FROM r""",
)
def metric_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.when(e % 5 != 0, "step").alias("step_name"),
            (F.col("event_type") != "error").alias("success"),
            F.when(e % 3 == 0, "why").alias("failure_reason"),
            F.when(e % 4 != 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00").alias("timestamp"),
            F.lit(5).alias("duration_ms"),
        )
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).alias("record"))
    return filters.with_violations(rows, filters.metric_rules(F.col("record"), ["step_name"])).select("event_id", "violations")


@register(
    "epoch_members",
    "FLT-05 WIN-03",
    """WITH f AS (SELECT l_orderkey, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_ts, arg_min(l_suppkey, (l_shipdate, l_linenumber, l_partkey)) AS first_actor FROM lineitem GROUP BY 1)
        SELECT * FROM f WHERE first_ts >= '1997-06-01'""",
)
def epoch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"), "l_suppkey", F.struct("l_linenumber", "l_partkey").alias("tie"))
    first = windows.first_and_actor(li, ["l_orderkey"], "ts", "l_suppkey", "tie")
    return first.where(filters.since_epoch(F.col("first_ts"), "1997-06-01"))


@register(
    "junk_and_derivation_titles",
    "FLT-11 FLT-19 STR-09 STR-10",
    r"""WITH t AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 5 WHEN 0 THEN ' (copy)' WHEN 1 THEN ' (3)' WHEN 2 THEN '_final' ELSE '' END AS title FROM part)
        SELECT id, contains(title, '_') AS junk, regexp_matches(title, '\(copy\)') AS derivation,
        CASE WHEN title LIKE '%(copy)' THEN [title, regexp_replace(title, ' \(copy\)$', '')] WHEN title LIKE '%(3)' THEN [title, regexp_replace(title, ' \(3\)$', '')] ELSE [title] END AS variants FROM t""",
)
def junk_and_derivation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("p_partkey") % 5 == 0, " (copy)").when(F.col("p_partkey") % 5 == 1, " (3)").when(F.col("p_partkey") % 5 == 2, "_final").otherwise("")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", ending).alias("title"))
    return t.select("id", filters.junk_title(F.col("title"), F.lit("")).alias("junk"), filters.derivation_title(F.col("title"), ["copy", "detail"]).alias("derivation"), F.transform(text.title_variants(F.col("title")), lambda v: v["variant"]).alias("variants"))


@register(
    "scoped_selection",
    "FLT-15",
    """SELECT n_name AS name FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 IN (SELECT s_nationkey % 5 FROM supplier WHERE s_acctbal < 0)""",
)
def scoped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    patterns = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src/"), (F.col("n_nationkey") % 5).cast("string"), F.lit("/**"))))
    scenarios = n.select(F.col("n_name").alias("name"), patterns.alias("patterns"))
    changed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("src/"), (F.col("s_nationkey") % 5).cast("string"), F.lit("/a/b.py")).alias("path"))
    return filters.select_scoped(scenarios, changed).select("name")


@register(
    "model_gate",
    "FLT-21",
    """WITH r AS (SELECT s_suppkey AS model_id, s_nationkey AS profile, CASE WHEN s_acctbal > 0 THEN 'approved' ELSE 'trial' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'retired' ELSE 'current' END AS lifecycle FROM supplier),
        d AS (SELECT s_nationkey AS profile, s_suppkey AS model_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'report' END AS evidence FROM supplier WHERE s_suppkey % 6 < 2),
        o AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY profile) = 1)
        SELECT r.model_id, r.profile FROM r JOIN o USING (profile, model_id) WHERE evidence IS NOT NULL AND status = 'approved' AND lifecycle = 'current' AND model_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 = 0)""",
)
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    registry = s.select(F.col("s_suppkey").alias("model_id"), F.col("s_nationkey").alias("profile"), F.when(F.col("s_acctbal") > 0, "approved").otherwise("trial").alias("status"), F.when(F.col("s_suppkey") % 4 == 0, "retired").otherwise("current").alias("lifecycle"))
    decisions = s.where("s_suppkey % 6 < 2").select(F.col("s_nationkey").alias("profile"), F.col("s_suppkey").alias("model_id"), F.when(F.col("s_suppkey") % 3 != 0, "report").alias("evidence"))
    return filters.gated_models(registry, decisions, s.where("s_suppkey % 11 = 0").select(F.col("s_suppkey").alias("model_id")), ["approved"]).select("model_id", "profile")


@register(
    "injection_and_triage_rules",
    "FLT-23",
    r"""WITH r AS (SELECT doc_id, lower(text) AS t FROM documents)
        SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, 'ignore (all|previous)') THEN 'override' END, CASE WHEN regexp_matches(t, '\|') THEN 'table' END, CASE WHEN regexp_matches(t, '(stupid|worthless|trash)') THEN 'abuse' END], lambda x: x IS NOT NULL) AS findings,
        regexp_matches(t, '(stupid|worthless|trash)') AS blocking FROM r""",
)
def injection_and_triage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("ignore (all|previous)", "override"), (r"\|", "table"), ("(stupid|worthless|trash)", "abuse")]
    found = text.all_rules(F.lower("text"), rules)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("findings"), F.array_contains(found, "abuse").alias("blocking"))


@register(
    "dimension_compat",
    "FLT-24 MTH-04",
    """WITH p AS (SELECT p_partkey AS id, p_size AS a, p_partkey % 50 + 1 AS b FROM part),
        q AS (SELECT id, least(a, b) * 1.0::DOUBLE AS a1, greatest(a, b) * 1.0::DOUBLE AS a2, least(b + 1, a) * 1.0::DOUBLE AS b1, greatest(b + 1, a) * 1.0::DOUBLE AS b2 FROM p)
        SELECT id, CASE WHEN id % 9 = 0 THEN 'absent' WHEN greatest(abs(a1 - b1) / greatest(a1, b1), abs(a2 - b2) / greatest(a2, b2)) <= 0.05 THEN 'match' ELSE 'mismatch' END AS compat FROM q""",
)
def dimension_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("a"), (F.col("p_partkey") % 50 + 1).alias("b"))
    left = F.when(F.col("id") % 9 != 0, F.concat("a", F.lit(" x "), F.col("b").cast("string"), F.lit(" cm")))
    right = F.concat(F.lit("oil, "), "a", F.lit(" × "), (F.col("b") + 1).cast("string"), F.lit(" cm (framed)"))
    return p.select("id", numbers.dimension_compat(numbers.dimension_pair(left), numbers.dimension_pair(right)).alias("compat"))


@register(
    "crop_pairs",
    "FLT-27 JOIN-10",
    """WITH a AS (SELECT p_partkey AS id, p_size AS s, p_brand FROM part)
        SELECT x.id AS a_id, y.id AS b_id, CASE WHEN abs(x.s - y.s) > 0.02 * greatest(x.s, y.s) THEN 'distinct-crop' WHEN x.id % 7 = y.id % 7 AND x.id % 3 = y.id % 3 THEN 'redundant-b' WHEN x.id % 3 < y.id % 3 THEN 'redundant-a' WHEN y.id % 3 < x.id % 3 THEN 'redundant-b' ELSE 'undecided' END AS verdict
        FROM a x JOIN a y ON x.p_brand = y.p_brand AND y.id = x.id + 25 * (y.id - x.id) / 25 AND x.id < y.id WHERE y.id - x.id <= 100""",
)
def crop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"), "p_brand", F.floor(F.col("p_partkey") / 100).alias("cell"))
    a = p.select(F.col("id").alias("a_id"), F.col("s").alias("a_s"), "p_brand", "cell")
    b = p.select(F.col("id").alias("b_id"), F.col("s").alias("b_s"), "p_brand", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"))
    met = a.join(b, ["p_brand", "cell"]).where("a_id < b_id AND b_id - a_id <= 100")
    verdict = filters.classify_crop_pair(F.col("a_s"), F.col("b_s"), F.col("a_id") % 7, F.col("b_id") % 7, F.col("a_id") % 3, F.col("b_id") % 3)
    return met.select("a_id", "b_id", verdict.alias("verdict"))


@register(
    "dossier_probe",
    "FLT-20",
    """SELECT page_id FROM pages WHERE contains(html, '<article>') AND NOT contains(html, '<h1></h1>') AND page_id % 3 <> 0""",
)
def dossier_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("html").contains("<article>") & ~F.col("html").contains("<h1></h1>") & (F.col("page_id") % 3 != 0)).select("page_id")


@register(
    "artist_filter",
    "FLT-04",
    f"""WITH {WORKS_SQL} SELECT work_id FROM works WHERE coalesce(contains(lower(artist), 'src1'), false) OR coalesce(lower(genre) = 'painting/de', false)""",
)
def artist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = filters.matches_artist("src1", F.col("artist"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    by_id = filters.matches_artist("painting/de", F.lit(None).cast("string"), F.col("genre"), F.lit(None).cast("string"))
    return works(spark, sf_dir).where(by_name | by_id).select("work_id")


@register(
    "hot_spot_files",
    "SRT-07 AGG-36",
    """WITH f AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size - 40 ELSE 0 END AS missing, p_size AS total FROM part) SELECT * FROM f WHERE missing > 0 ORDER BY missing DESC, p_partkey LIMIT 15""",
)
def hot_spot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.col("p_size") - 40).otherwise(0).alias("missing"), F.col("p_size").alias("total"))
    return sets.hot_spots_first(f, "missing", "total", "p_partkey", 15)


@register(
    "inherit_fields",
    "CPX-03",
    """WITH p AS (SELECT a.p_partkey AS id, CASE WHEN a.p_partkey % 2 = 0 THEN a.p_name END AS own_name, a.p_type AS own_type, b.p_name AS up_name, b.p_type AS up_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1)
        SELECT id, coalesce(own_name, up_name) AS name, coalesce(own_type, up_type) AS type, list_filter([CASE WHEN own_name IS NULL THEN 'name' END], lambda x: x IS NOT NULL) AS took,
        list_filter([CASE WHEN own_name <> up_name THEN 'name' END, CASE WHEN own_type <> up_type THEN 'type' END], lambda x: x IS NOT NULL) AS clash FROM p""",
)
def inherit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("own_name"), F.col("p_type").alias("own_type"), (F.col("p_partkey") - 1).alias("up"))
    up = p.select(F.col("p_partkey").alias("up"), F.col("p_name").alias("up_name"), F.col("p_type").alias("up_type"))
    filled, took, clash = nested.inherit({"name": F.col("own_name"), "type": F.col("own_type")}, {"name": F.col("up_name"), "type": F.col("up_type")})
    return own.join(up, "up").select("id", filled["name"].alias("name"), filled["type"].alias("type"), took.alias("took"), clash.alias("clash"))
