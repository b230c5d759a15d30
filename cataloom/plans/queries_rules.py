"""Queries over validation rules, gates, nested values and small batch passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import dates, nested, numbers, text
from cataloom.operators import filters, joins, sets, transforms, windows
from cataloom.plans.catalogue import table
from cataloom.registry import register


@register(
    "identifier_checks",
    "FLT-10",
    r"""WITH t AS (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN s_name WHEN 1 THEN '../' || s_name WHEN 2 THEN '.' WHEN 3 THEN s_name || '.v1-_x' WHEN 4 THEN NULL ELSE '..' END AS wid FROM supplier)
        SELECT k, coalesce(regexp_full_match(wid, '[A-Za-z0-9._-]+') AND wid NOT IN ('.', '..'), false) AS valid FROM t""",
)
def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    wid = F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(F.lit("../"), name)).when(k % 6 == 2, ".").when(k % 6 == 3, F.concat(name, F.lit(".v1-_x"))).when(k % 6 == 5, "..")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), filters.valid_identifier(wid).alias("valid"))


@register(
    "record_violations",
    "FLT-13",
    """WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE ' ' END AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS artist, CASE WHEN p_partkey % 3 = 0 THEN sha256(p_name) ELSE md5(p_name) END AS digest, CASE WHEN p_partkey % 2 = 0 THEN p_size % 4 END AS pos, CASE WHEN p_partkey % 6 = 0 THEN 'Q1' END AS part_of FROM part)
        SELECT k, list_filter([CASE WHEN trim(title) = '' THEN 'title-missing' END, CASE WHEN artist IS NULL THEN 'artist-missing' END, CASE WHEN length(digest) <> 64 THEN 'digest-malformed' END, CASE WHEN pos < 1 THEN 'position-below-one' END, CASE WHEN pos IS NOT NULL AND part_of IS NULL THEN 'position-without-series' END], lambda x: x IS NOT NULL) AS violations FROM t""",
)
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.when(k % 4 != 0, F.col("p_name")).otherwise(" ").alias("title"),
        F.when(k % 5 != 0, F.col("p_brand")).alias("artist"),
        F.when(k % 3 == 0, F.sha2("p_name", 256)).otherwise(F.md5("p_name")).alias("digest"),
        F.when(k % 2 == 0, F.col("p_size") % 4).alias("pos"),
        F.when(k % 6 == 0, "Q1").alias("part_of"),
    )
    rules = filters.record_rules(*[F.col(c) for c in ("title", "artist", "digest", "pos", "part_of")])
    return filters.with_violations(rows, rules).select("k", "violations")


@register(
    "rating_violations",
    "FLT-17",
    """WITH t AS (SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(floor(value / 8) AS INTEGER) END AS q, CASE WHEN event_type = 'click' THEN CAST(floor(value / 8) AS INTEGER) END AS f, CASE WHEN event_type = 'error' THEN CAST(floor(value / 20) AS INTEGER) - 2 END AS r, event_type AS s FROM events)
        SELECT event_id, list_filter([CASE WHEN q NOT BETWEEN 1 AND 10 THEN 'quality-range' END, CASE WHEN f NOT BETWEEN 1 AND 10 THEN 'fit-range' END, CASE WHEN r NOT BETWEEN -2 AND 2 THEN 'rating-range' END, CASE WHEN s NOT IN ('view', 'click', 'error', 'signup') THEN 'surface-unknown' END, CASE WHEN event_id % 7 = 0 THEN 'reason-unknown' END, CASE WHEN q IS NULL AND f IS NULL AND r IS NULL THEN 'nothing-rated' END], lambda x: x IS NOT NULL) AS violations FROM t""",
)
def rating_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", F.floor(F.col("value") / 8).cast("int")).alias("q"),
        F.when(kind == "click", F.floor(F.col("value") / 8).cast("int")).alias("f"),
        F.when(kind == "error", F.floor(F.col("value") / 20).cast("int") - 2).alias("r"),
        kind.alias("s"),
        F.when(F.col("event_id") % 7 == 0, F.array(F.lit("colour"), F.lit("mood"))).otherwise(F.array(F.lit("colour"))).alias("reasons"),
    )
    rules = filters.rating_rules(F.col("q"), F.col("f"), F.col("r"), F.col("s"), F.col("reasons"), ["view", "click", "error", "signup"], ["colour", "light"])
    return filters.with_violations(rows, rules).select("event_id", "violations")


@register(
    "identity_invariant",
    "FLT-18",
    """SELECT p_partkey, p_partkey % 4 < 2 AND p_size % 3 = 0 AS breaks FROM part""",
)
def identity_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "crop").when(k % 4 == 1, "variant").when(k % 4 == 2, "original")
    return table(spark, sf_dir, "part").select("p_partkey", filters.breaks_identity_invariant(kind, F.when(F.col("p_size") % 3 == 0, "Q1")).alias("breaks"))


@register(
    "commercial_pages",
    "FLT-16",
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1), '^www\.', '') AS host, len(regexp_extract_all(lower(html), 'the|der|les')) AS n FROM pages)
        SELECT page_id, NOT (host = 'm.example.org' OR ends_with(host, '.m.example.org')) AND (host = 'example.com' OR ends_with(host, '.example.com') OR n >= 2) AS commercial FROM t""",
)
def commercial_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", filters.is_commercial(text.domain_of(F.col("url")), F.col("html"), ["example.com"], ["m.example.org"], "the|der|les").alias("commercial"))


@register(
    "finding_partition",
    "FLT-22 TXT-05",
    """SELECT event_id, event_type IN ('error', 'signup') AS blocking FROM events""",
)
def finding_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    hard, soft = filters.partition_findings(findings, ["error", "signup"])
    return hard.select("event_id", F.lit(True).alias("blocking")).unionByName(soft.select("event_id", F.lit(False).alias("blocking")))


@register(
    "reviewed_page",
    "FLT-06 SRT-01 PRJ-18",
    """WITH t AS (SELECT o_orderkey, o_orderstatus = 'F' AS reviewed, o_orderdate FROM orders), r AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM t WHERE NOT reviewed)
        SELECT o_orderkey, total FROM r WHERE rn > 20 AND rn <= 45""",
)
def reviewed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the records not reviewed, with their number before the cut."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("reviewed"))
    wanted = o.where(filters.reviewed_filter(F.col("reviewed"), "no"))
    cut = sets.page(wanted, [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 25)
    return cut.join(F.broadcast(wanted.agg(F.count("*").alias("total")))).select("o_orderkey", "total")


@register(
    "research_needs",
    "FLT-08 CPX-02",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'not_researched' WHEN 1 THEN 'available' WHEN 2 THEN 'conflicting' WHEN 3 THEN 'unverified' END AS status, s_suppkey % 5 <> 1 AS needed FROM supplier""",
)
def research_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(k % 5 == 0, "not_researched").when(k % 5 == 1, "available").when(k % 5 == 2, "conflicting").when(k % 5 == 3, "unverified")
    entry = F.struct(status.alias("status"), F.lit("x").alias("source"))
    ledger = F.when(k % 5 != 4, nested.upsert_ledger(F.create_map(F.lit("year"), entry), F.lit("medium"), entry)).otherwise(F.create_map(F.lit("year"), entry))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ledger.alias("ledger"))
    return s.select("s_suppkey", nested.ledger_status(F.col("ledger"), "medium").alias("status"), nested.needs_research(F.col("ledger"), "medium").alias("needed"))


@register(
    "last_decisions",
    "JOIN-04",
    """WITH d AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber)) AS decision FROM lineitem WHERE l_tax > 0.05 GROUP BY 1) SELECT o_orderkey, coalesce(decision, 'pending') AS decision FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""",
)
def last_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date or number that is null comes after all others, as in arg_max over pairs. Several lines of an order may share date and number; arg_max on one thread keeps the first of them in the table's own order, which is that of its files and their rows."""
    line = F.struct(F.isnull("l_shipdate").alias("no_date"), "l_shipdate", F.isnull("l_linenumber").alias("no_number"), "l_linenumber")
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    d = table(spark, sf_dir, "lineitem").where("l_tax > 0.05").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("decision"), line.alias("line"), place.alias("place"))
    judged = joins.last_decision(table(spark, sf_dir, "orders").select("o_orderkey"), d, "o_orderkey", "decision", "line", "place")
    return judged.select("o_orderkey", F.coalesce("decision", F.lit("pending")).alias("decision"))


@register(
    "unpaired_models",
    "JOIN-35",
    """WITH c AS (SELECT DISTINCT l_suppkey AS model_id, l_linenumber AS case_id FROM lineitem WHERE l_quantity > 49), n AS (SELECT count(DISTINCT case_id) AS n_all FROM c) SELECT model_id, n_all - count(*) AS n_missing FROM c, n GROUP BY model_id, n_all HAVING count(*) < n_all""",
)
def unpaired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("model_id"), F.col("l_linenumber").alias("case_id"))
    return joins.paired_cases(cases)


@register(
    "first_arrivals",
    "SET-03",
    """SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1""",
)
def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers by their first place in the order."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return sets.first_of_each(rows, F.col("l_suppkey").cast("string"), "ord")


@register(
    "set_merges",
    "SET-08",
    """WITH t AS (SELECT o_orderkey AS k, list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R')) AS a, list_sort(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'F')) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
        u AS (SELECT k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM t) SELECT k, list_sort(list_distinct(list_concat(a, b))) AS merged, NOT (list_has_all(b, a) OR list_has_all(a, b)) AS conflict FROM u""",
)
def set_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", line)).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "F", line)).alias("b"))
    return held.select("k", nested.combine_sets(F.col("a"), F.col("b")).alias("m")).select("k", "m.merged", "m.conflict")


@register(
    "label_merge",
    "SET-09",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['Red', 'Blue', 'green'] WHEN 1 THEN ['Red', 'Blue', upper(p_type)] ELSE ['Red', 'Blue'] END AS labels FROM part""",
)
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    strings = "array<string>"
    more = F.when(k % 3 == 0, F.array(F.lit("RED"), F.lit("green"), F.lit("Green"))).when(k % 3 == 1, F.array(F.lit("blue "), F.upper("p_type"), F.col("p_type"))).otherwise(F.array().cast(strings))
    return table(spark, sf_dir, "part").select("p_partkey", nested.merge_labels(F.array(F.lit("Red"), F.lit("Blue")), more, lambda x: F.lower(F.trim(x))).alias("labels"))


@register(
    "ordered_containments",
    "STR-07 JOIN-16",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_partkey % 3 AS m FROM part) SELECT p_partkey, round(CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 / len(w) + CASE WHEN list_distinct(w) = w THEN 0 ELSE 0 END ELSE 0.0 END, 6)::DOUBLE AS share FROM t WHERE len(list_distinct(w)) = len(w)""",
)
def ordered_containments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title within a longer one: in order, backwards, and not at all."""
    words = F.split("p_name", " ")
    k = F.col("p_partkey")
    longer = F.when(k % 3 == 0, F.concat(F.array(F.lit("zz")), F.transform(words, lambda w: w), F.array(F.lit("yy")))).when(k % 3 == 1, F.reverse(words)).otherwise(F.array(F.lit("zz"), F.lit("yy")))
    rows = table(spark, sf_dir, "part").where(F.size(F.array_distinct(words)) == F.size(words))
    return rows.select("p_partkey", F.round(text.ordered_containment(words, longer), 6).alias("share"))


@register(
    "name_repairs",
    "STR-12",
    r"""WITH t AS (SELECT p_partkey, p_name AS n, string_split(p_name, ' ') AS w FROM part), u AS (SELECT *, list_aggregate(list_transform(w, lambda x: regexp_replace(x, '(a{2,}|b{2,}|c{2,}|d{2,}|e{2,}|f{2,}|g{2,}|l{2,}|m{2,}|n{2,}|o{2,}|p{2,}|r{2,}|s{2,}|t{2,})', substr(regexp_extract(x, '(a{2,}|b{2,}|c{2,}|d{2,}|e{2,}|f{2,}|g{2,}|l{2,}|m{2,}|n{2,}|o{2,}|p{2,}|r{2,}|s{2,}|t{2,})', 1), 1, 1))), 'string_agg', ' ') AS runs FROM t)
        SELECT p_partkey, list_filter([CASE WHEN runs <> n THEN runs END, CASE WHEN len(w) = 2 THEN w[2] || ' ' || w[1] END], lambda x: x IS NOT NULL) AS spellings FROM u""",
)
def name_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.repaired_names(F.col("p_name")).alias("spellings"))


@register(
    "source_authority",
    "STR-19 SRT-11",
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1), '^www\.', '') AS host, html FROM pages)
        SELECT page_id, 1.0::DOUBLE + CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 1.0 ELSE 0.0 END AS authority, substr(trim(regexp_replace(html, '\s+', ' ', 'g')), 1, 280) AS excerpt, sha256(html) AS digest FROM t""",
)
def source_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.authority_score(text.domain_of(F.col("url")), {"example.org": 2.0}).alias("authority"), text.excerpt(F.col("html")).alias("excerpt"), text.content_hash(F.col("html")).alias("digest"))


@register(
    "keyword_labels",
    "STR-21",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS l, string_split(lower(p_type), ' ') AS k FROM part) SELECT p_partkey, CASE WHEN list_has_all(['small', 'red', 'ring', 'blue', 'green'], l) THEN 0.95 WHEN len(list_filter(k, lambda x: list_contains(['small', 'red', 'ring', 'blue', 'green'], x) OR (length(x) >= 4 AND (starts_with('small', x) OR starts_with(x, 'small') OR starts_with(x, 'ring') OR starts_with('ring', x) OR starts_with(x, 'blue') OR starts_with(x, 'green') OR starts_with('green', x))))) > 0 THEN 0.9 END::DOUBLE AS score FROM t""",
)
def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*[F.lit(w) for w in ("small", "red", "ring", "blue", "green")])
    return table(spark, sf_dir, "part").select("p_partkey", text.keyword_label_score(F.split("p_name", " "), F.split(F.lower("p_type"), " "), asked).alias("score"))


@register(
    "losing_values",
    "STR-20 CPX-05",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN CAST(s_nationkey AS VARCHAR) WHEN 2 THEN '["a", 1]' WHEN 3 THEN 'true' END AS value FROM supplier""",
)
def losing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    value = F.when(k % 5 == 0, F.concat(F.lit('"'), "s_name", F.lit('"'))).when(k % 5 == 1, F.col("s_nationkey").cast("string")).when(k % 5 == 2, '["a", 1]').when(k % 5 == 3, "true").otherwise("unquoted words")
    note = F.concat(F.lit("kept one; losing value: "), value, F.lit("; checked by hand"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.losing_value(note, "losing value:").alias("value"))


@register(
    "lifespans",
    "DAT-06 DAT-03",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(1600 + c_custkey % 300 AS VARCHAR) || '-' || CAST(1660 + c_custkey % 300 AS VARCHAR) WHEN 1 THEN CAST(1600 + c_custkey % 300 AS VARCHAR) || '-' WHEN 2 THEN '-' || CAST(1660 + c_custkey % 300 AS VARCHAR) END AS lifespan, CAST(1600 + c_custkey % 300 AS INTEGER) AS year FROM customer""",
)
def lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    born, died = (F.concat(F.lit("+"), (F.lit(y) + k % 300).cast("string"), F.lit("-01-01T00:00:00Z")) for y in (1600, 1660))
    span = dates.lifespan(F.when(k % 4 < 2, born), F.when((k % 4 == 0) | (k % 4 == 2), died))
    return table(spark, sf_dir, "customer").select("c_custkey", span.alias("lifespan"), dates.matching_year(F.concat(F.lit("painted in "), (F.lit(1600) + k % 300).cast("string"))).alias("year"))


@register(
    "comparison_budgets",
    "MTH-08",
    """SELECT n_nationkey, greatest(n_nationkey - 1, 0) AS least, CASE WHEN n_nationkey >= 2 THEN CAST(round_even(n_nationkey * log2(n_nationkey), 0) AS BIGINT) ELSE 0 END AS recommended FROM nation""",
)
def comparison_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", numbers.comparison_budget(F.col("n_nationkey")).alias("b"))
    return n.select("n_nationkey", "b.least", "b.recommended")


@register(
    "price_spreads",
    "AGG-34",
    """SELECT l_orderkey, min(l_quantity) AS least, max(l_quantity) AS most, max(l_quantity) - min(l_quantity) AS absolute, round((max(l_quantity) - min(l_quantity)) / min(l_quantity), 6) AS relative FROM lineitem GROUP BY 1""",
)
def price_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(F.min("l_quantity"), F.max("l_quantity")).alias("ends"))
    return held.select("l_orderkey", numbers.spread(F.col("ends")).alias("s")).select("l_orderkey", "s.least", "s.most", "s.absolute", F.round("s.relative", 6).alias("relative"))


@register(
    "latest_operations",
    "WIN-04 CPX-01",
    """WITH m AS (SELECT l_orderkey, max(l_shipdate) AS ts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT m.l_orderkey, strftime(ts, '%Y-%m-%d') AS ts, min(l_linenumber) AS line FROM m JOIN lineitem l ON l.l_orderkey = m.l_orderkey AND l.l_shipdate = m.ts AND l_returnflag = 'R' GROUP BY ALL""",
)
def latest_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the latest events of an operation in each record's history, which is kept in line order."""
    event = F.struct(F.col("l_linenumber").alias("line"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"), F.col("l_returnflag").alias("op"))
    records = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(event)).alias("history"))
    found = records.select("l_orderkey", nested.latest_event(F.col("history"), "R").alias("e"))
    return found.where("e IS NOT NULL").select("l_orderkey", "e.ts", "e.line")


@register(
    "seeded_ranks",
    "CPX-08 SRT-05",
    """SELECT p_partkey, substr(sha256('7:' || p_partkey), 1, 16) AS rank, substr(sha256(p_partkey || '|' || p_name), 1, 16) AS etag FROM part""",
)
def seeded_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", nested.seeded_rank(7, F.col("p_partkey")).alias("rank"), nested.item_etag(F.col("p_partkey"), F.col("p_name")).alias("etag"))


@register(
    "language_labels",
    "CPX-09",
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || ', also' WHEN 1 THEN 'ohne' ELSE n_name END AS label FROM nation""",
)
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.array(F.col("n_name"))
    labels = F.when(k % 3 == 0, F.create_map(F.lit("de"), F.array(F.lit("x")), F.lit("en"), F.array(F.col("n_name"), F.lit("also")))).when(k % 3 == 1, F.create_map(F.lit("none"), F.array(F.lit("ohne")), F.lit("fr"), name)).otherwise(F.create_map(F.lit("fr"), name))
    return table(spark, sf_dir, "nation").select("n_nationkey", nested.language_map_value(labels).alias("label"))


@register(
    "closest_schemas",
    "CPX-16",
    """WITH e AS (SELECT l_orderkey AS doc, 'v' || l_linenumber AS schema, CAST(l_quantity AS BIGINT) % 7 AS n_errors FROM lineitem) SELECT doc, bool_or(n_errors = 0) AS passed, arg_min(schema, (n_errors, schema)) AS closest, min(n_errors) AS n_errors FROM e GROUP BY doc""",
)
def closest_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("schema"), (F.col("l_quantity").cast("bigint") % 7).alias("n_errors"))
    return filters.closest_schema(errors)


@register(
    "reciprocal_unlinks",
    "BAT-11",
    """WITH l AS (SELECT DISTINCT s_suppkey AS owner, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey + 1 WHEN s_suppkey % 4 = 0 THEN s_suppkey - 1 ELSE s_suppkey + 2 END AS held FROM supplier) SELECT a.owner AS a, a.held AS b FROM l a JOIN l b ON a.owner = b.held AND a.held = b.owner WHERE a.owner < a.held""",
)
def reciprocal_unlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    held = F.when(k % 2 == 1, k + 1).when(k % 4 == 0, k - 1).otherwise(k + 2)
    return transforms.reciprocal_links(table(spark, sf_dir, "supplier").select(k.alias("owner"), held.alias("held")))


@register(
    "folded_keys",
    "BAT-12",
    """SELECT s_suppkey, ['source', 'status'] AS keys, CASE WHEN s_suppkey % 2 = 0 THEN 'seen; ' ELSE '' END || 'page=' || s_nationkey || '; zone=' || s_name AS note FROM supplier""",
)
def folded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.create_map(F.lit("status"), F.lit("ok"), F.lit("zone"), F.col("s_name"), F.lit("source"), F.lit("x"), F.lit("page"), F.col("s_nationkey").cast("string"))
    known, note = transforms.fold_unknown_keys(entry, F.when(F.col("s_suppkey") % 2 == 0, "seen").otherwise(" "), ["status", "source"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_sort(F.map_keys(known)).alias("keys"), note.alias("note"))


@register(
    "idempotent_findings",
    "BAT-14",
    """SELECT o_orderkey AS finding FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def idempotent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("finding"))
    return transforms.not_yet_applied(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding")), applied, "finding")


@register(
    "source_ranking",
    "SRT-09",
    """WITH t AS (SELECT s_nationkey, s_name, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE s_acctbal END AS score FROM supplier), u AS (SELECT *, score IS NOT NULL AND isfinite(score) AS ok FROM t)
        SELECT s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY ok DESC, CASE WHEN ok THEN score END DESC NULLS LAST, CASE WHEN isnan(score) THEN 3 WHEN score IS NULL THEN 1 ELSE 2 END DESC, s_name) AS INTEGER) AS rank FROM u""",
)
def source_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    score = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit(float("nan"))).when(k % 5 == 2, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", score.cast("double").alias("score"))
    return sets.ranked_sources(rows, ["s_nationkey"], "score", "s_name").select("s_name", "rank")


@register(
    "registry_findings",
    "CPX-12 FLT-12",
    """WITH r AS (SELECT s_suppkey AS model, s_nationkey AS profile, CASE WHEN s_suppkey % 9 <> 0 THEN s_nationkey END AS nat, s_acctbal < 0 AS old FROM supplier)
        SELECT model, 'missing-reference' AS finding FROM r WHERE nat IS NULL OR nat NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)
        UNION ALL SELECT min(model), 'duplicate' FROM r GROUP BY profile HAVING count(*) > 1 UNION ALL SELECT model, 'overdue' FROM r WHERE old""",
)
def registry_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing references by an anti-join, duplicates by a count and overdue entries, in one list."""
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("model"), F.col("s_nationkey").alias("profile"), F.when(k % 9 != 0, F.col("s_nationkey")).alias("ref"), F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("date").alias("due"))
    known = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("ref"))
    return filters.registry_findings(r, known, "model", "profile", "ref", "due", F.lit("2024-02-01").cast("date"))


@register(
    "envelope_checks",
    "FLT-25 CPX-14",
    """WITH t AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, list_filter([CASE WHEN event_id % 5 = 0 THEN 'missing-run_id' END, CASE WHEN k >= 90 THEN 'unknown-version' END, CASE WHEN event_id % 11 = 0 THEN 'unsafe-key' END], lambda x: x IS NOT NULL) AS violations FROM t""",
)
def envelope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes (JSON) against required fields, known versions and keys that must not appear at any depth."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    inner = F.when(e % 11 == 0, F.lit('{"a": [{"api_key": 1}]}')).otherwise(F.lit('{"a": [{"b": 1}], "token_count": 2}'))
    run = F.when(e % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"run_id": "r'), e.cast("string"), F.lit('", ')))
    value = F.concat(F.lit("{"), run, F.lit('"version": '), F.when(k >= 90, F.lit("2")).otherwise(F.lit("1")), F.lit(', "payload": '), inner, F.lit("}"))
    return filters.check_envelopes(table(spark, sf_dir, "events").select("event_id", value.alias("value")), "event_id", ["run_id", "version"], ["1"], ["api_key", "password", "secret"])


@register(
    "json_leaves",
    "CPX-14",
    """SELECT s_suppkey, p.path, p.leaf FROM supplier, LATERAL (SELECT unnest([{'path': 'claims[0].id', 'leaf': 'Q' || s_nationkey}, {'path': 'claims[1].note.lang', 'leaf': 'en'}, {'path': 'name', 'leaf': s_name}]) AS p) t""",
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit('{"name": "'), "s_name", F.lit('", "claims": [{"id": "Q'), F.col("s_nationkey").cast("string"), F.lit('"}, {"note": {"lang": "en"}}]}'))
    return nested.json_leaves(table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("value")), "s_suppkey", "value")


@register(
    "benchmark_ranking",
    "SRT-13 SRT-10",
    """WITH m AS (SELECT s_nationkey AS model, CASE WHEN s_nationkey % 3 <> 0 THEN round(min(s_acctbal), 2) END AS cost, max(s_suppkey) AS p95 FROM supplier GROUP BY 1) SELECT model, row_number() OVER (ORDER BY cost NULLS LAST, p95, model) AS place FROM m""",
)
def benchmark_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.round(F.min("s_acctbal"), 2).alias("cost"), F.max("s_suppkey").alias("p95"))
    known = m.withColumn("cost", F.when(F.col("model") % 3 != 0, F.col("cost")))
    return windows.numbered(known, [F.col("cost").asc_nulls_last(), F.col("p95"), F.col("model")]).select("model", "place")


@register(
    "slow_cases",
    "SRT-06 AGG-21",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 25""",
)
def slow_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the slowest cases beyond a least time."""
    slow = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")
    return slow.orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(25)
