"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import dates, nested, numbers, text, vocabulary
from cataloom.operators import filters
from cataloom.plans.catalogue import WORKS_SQL, table, works
from cataloom.registry import register

_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_ASCII = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@register(
    "fold_and_tokens",
    "STR-01 STR-02 STR-03 STR-04",
    r"""WITH t AS (SELECT doc_id, text AS s FROM documents)
        SELECT doc_id, """
    + _NORM.format("s")
    + " AS norm, "
    + _ASCII.format("s")
    + r""" AS folded, trim(regexp_replace(regexp_replace(lower(s), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
        CASE WHEN length(split_part("""
    + _NORM.format("s")
    + """, ' ', -1)) >= 4 THEN split_part("""
    + _NORM.format("s")
    + """, ' ', -1) ELSE '' END AS surname FROM t""",
)
def fold_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s"))
    s = F.col("s")
    return t.select("doc_id", text.norm_title(s).alias("norm"), text.ascii_fold(s).alias("folded"), text.plain_fold(s).alias("plain"), text.surname(s).alias("surname"))


@register(
    "year_parse",
    "DAT-01 DAT-02",
    r"""WITH t AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, CASE o_orderkey % 5 WHEN 0 THEN 'c. ' || year(o_orderdate) WHEN 1 THEN year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') WHEN 2 THEN (year(o_orderdate) // 10 * 10) || 's' WHEN 3 THEN 'undated' ELSE year(o_orderdate) || ' (1234)' END AS s FROM orders)
        SELECT id, CASE WHEN id % 5 IN (0, 1, 4) THEN CAST(y AS INTEGER) END AS best, CASE id % 5 WHEN 0 THEN CAST(y AS INTEGER) WHEN 1 THEN greatest(y, CAST(y // 100 * 100 + id % 90 + 10 AS INTEGER)) WHEN 2 THEN CAST(y // 10 * 10 + 9 AS INTEGER) WHEN 4 THEN CAST(y AS INTEGER) END::INTEGER AS year_max,
        CASE WHEN id % 5 = 4 THEN 1234 END AS in_parentheses FROM t""",
)
def year_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 0, F.concat(F.lit("c. "), y.cast("string"))).when(k % 5 == 1, F.concat(y.cast("string"), F.lit("-"), F.lpad((k % 90 + 10).cast("string"), 2, "0"))).when(k % 5 == 2, F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"))).when(k % 5 == 3, "undated").otherwise(F.concat(y.cast("string"), F.lit(" (1234)")))
    t = table(spark, sf_dir, "orders").select(k.alias("id"), s.alias("s"))
    return t.select("id", dates.best_year(F.col("s")).alias("best"), dates.year_range(F.col("s"))["year_max"].alias("year_max"), dates.parenthetical_year(F.col("s")).alias("in_parentheses"))


@register(
    "medium_vocab",
    "STR-16",
    """WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Oil on canvas' WHEN 1 THEN 'egg tempera and gold leaf on wood panel' WHEN 2 THEN 'Watercolor / paper' WHEN 3 THEN 'black chalk, ink (paper)' WHEN 4 THEN 'bronze' ELSE 'oils on linen' END AS s FROM part)
        SELECT id, CASE id % 6 WHEN 0 THEN 'Oil on canvas' WHEN 1 THEN 'Tempera and gold on panel' WHEN 2 THEN 'Watercolour on paper' WHEN 3 THEN 'Ink and chalk on paper' WHEN 5 THEN 'Oil on canvas' END AS medium FROM t""",
)
def medium_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = F.when(k % 6 == 0, "Oil on canvas").when(k % 6 == 1, "egg tempera and gold leaf on wood panel").when(k % 6 == 2, "Watercolor / paper").when(k % 6 == 3, "black chalk, ink (paper)").when(k % 6 == 4, "bronze").otherwise("oils on linen")
    parsed = table(spark, sf_dir, "part").select(k.alias("id"), vocabulary.parse_medium(s).alias("m"))
    return parsed.select("id", F.when(F.col("m").isNotNull(), vocabulary.render_medium(F.col("m"))).alias("medium"))


@register(
    "slug_ids",
    "STR-18",
    r"""WITH t AS (SELECT doc_id, sha256(text) AS h, list_filter(string_split("""
    + _ASCII.format("string_split(text, chr(10))[1]")
    + """, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, concat_ws('-', left(h, 7), array_to_string(w[1:6], '-')) AS work_id FROM t""",
)
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split("text", "\n")[0]
    return table(spark, sf_dir, "documents").select("doc_id", text.work_identifier(F.sha2("text", 256), first).alias("work_id"))


@register(
    "html_text_triage",
    "STR-24",
    """SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS n_targets, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        list_filter([CASE WHEN contains(html, 'track(') THEN 'tracker' END, CASE WHEN contains(html, 'class="ad"') THEN 'advert' END], lambda x: x IS NOT NULL) AS findings FROM pages""",
)
def html_text_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("n_paragraphs"), F.size(targets).cast("bigint").alias("n_targets"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), text.all_rules(F.col("html"), [(r"track\(", "tracker"), ('class="ad"', "advert")]).alias("findings"))


@register(
    "numeric_guards",
    "MTH-07 MTH-09 MTH-10 STR-23",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN value WHEN 2 THEN NULL ELSE value END AS finite, round(1 / (1 + value), 8) AS similarity, CASE WHEN event_id % 2 = 0 THEN round(least(1.0, value / 100), 6) ELSE round(least(1.0, CASE WHEN value > 1 THEN value / 100 ELSE value END), 6) END AS confidence,
        '4.' || (event_id % 7) AS version FROM events""",
)
def numeric_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    messy = F.when(e % 4 == 0, "NaN").when(e % 4 == 2, "n/a").otherwise(F.col("value").cast("string"))
    share = F.when(e % 2 == 0, F.concat(F.col("value").cast("string"), F.lit("%"))).otherwise(F.col("value").cast("string"))
    version = F.concat(F.lit("tool v4."), (e % 7).cast("string"), F.lit(" (beta)"))
    return table(spark, sf_dir, "events").select("event_id", numbers.finite(messy).alias("finite"), F.round(numbers.similarity_from_distance(F.col("value"), F.lit("distance")), 8).alias("similarity"), F.round(numbers.confidence(share), 6).alias("confidence"), text.version_text(version).alias("version"))


@register(
    "timestamps_and_durations",
    "DAT-04 DAT-05",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN to_timestamp(1700000000 + event_id)::TIMESTAMP WHEN 1 THEN ts END AS parsed, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS ms, greatest(date_diff('day', ts::DATE, DATE '2024-01-15'), 0) AS overdue FROM events""",
)
def timestamps_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, (e + 1_700_000_000).cast("string")).when(e % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("yesterday")
    start, sign = F.timestamp_seconds(F.lit(1_700_000_000)), F.when(e % 2 == 0, 1).otherwise(-1)
    ended = F.timestamp_millis(F.lit(1_700_000_000_000) + sign * (e * 10 + F.when(e % 2 == 0, 0).otherwise(1)))
    return table(spark, sf_dir, "events").select("event_id", dates.lenient_timestamp(raw).cast("timestamp_ntz").alias("parsed"), dates.duration_ms(start, ended).alias("ms"), dates.overdue_days(F.col("ts").cast("date"), F.lit("2024-01-15").cast("date")).cast("bigint").alias("overdue"))


@register(
    "map_ledger",
    "CPX-01 CPX-02 CPX-07 PRJ-16",
    """SELECT o_orderkey, [o_orderpriority, 'set'] AS ops, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""",
)
def map_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = F.array(F.struct(F.lit("2024").alias("ts"), F.lit("a").alias("actor"), F.col("o_orderpriority").alias("op"), F.lit("").alias("notes")))
    longer = nested.append_event(nested.append_event(history, F.lit("2025"), F.lit("b"), F.lit("undo-me"), F.lit("")), F.lit("2026"), F.lit("c"), F.lit("set"), F.lit(""))
    ledger = nested.upsert_ledger(F.create_map(F.lit("status"), F.lit("old"), F.lit("priority"), F.col("o_orderpriority")), F.lit("status"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.transform(nested.undo_events(longer, "undo-me"), lambda e: e["op"]).alias("ops"), nested.fingerprint(ledger).alias("fingerprint"))


@register(
    "tier_resolution",
    "CPX-04 CPX-15",
    """WITH c AS (SELECT l_orderkey AS work, l_linenumber AS ord, l_suppkey % 3 AS tier, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS candidate FROM lineitem)
        SELECT work, arg_min(candidate, (tier, ord, candidate)) FILTER (candidate IS NOT NULL) AS candidate, count(*) AS n_tried FROM c GROUP BY work""",
)
def tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 3).alias("tier"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("candidate"))
    order = F.when(F.col("candidate").isNotNull(), F.struct("tier", "ord", "candidate"))
    return c.groupBy("work").agg(F.min_by("candidate", order).alias("candidate"), F.count("*").alias("n_tried"))


@register(
    "tag_review_state",
    "CPX-13 CPX-11",
    """WITH a AS (SELECT user_id AS work_id, 'tag' || event_id % 3 AS tag, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'reject' WHEN 'signup' THEN 'add' ELSE 'reset' END AS action, ts, event_id FROM events)
        SELECT work_id, tag, CASE arg_max(action, (ts, event_id)) WHEN 'confirm' THEN 'confirmed' WHEN 'add' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE 'proposed' END AS state FROM a GROUP BY ALL""",
)
def tag_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.operators.transforms import tag_state

    action = F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "view", "reject").when(F.col("event_type") == "signup", "add").otherwise("reset")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), F.concat(F.lit("tag"), (F.col("event_id") % 3).cast("string")).alias("tag"), action.alias("action"), "ts", F.col("event_id").alias("row_id"))
    return tag_state(a)


@register(
    "policy_tags",
    "CPX-11",
    """WITH s AS (SELECT s_suppkey AS work_id, k AS label, ((s_suppkey * 7 + i * 31) % 100) / 100.0::DOUBLE AS score FROM supplier, (VALUES ('a', 1), ('b', 2), ('c', 3)) v(k, i)), r(tag, positive, negative, threshold) AS (VALUES ('A', 'a', 'b', 0.4), ('C', 'c', NULL, 0.7)),
        p AS (SELECT work_id, tag, score, negative FROM s JOIN r ON label = positive WHERE score >= threshold)
        SELECT p.work_id, p.tag, p.score FROM p LEFT JOIN s n ON n.work_id = p.work_id AND n.label = p.negative WHERE n.score IS NULL OR p.score > n.score + 0.1""",
)
def policy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.operators.transforms import policy_tags as evaluate

    labels = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(i).alias("i")) for k, i in (("a", 1), ("b", 2), ("c", 3))]))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", labels.alias("l")).select(F.col("s_suppkey").alias("work_id"), "l.label", ((F.col("s_suppkey") * 7 + F.col("l.i") * 31) % 100 / 100.0).alias("score"))
    rules = spark.createDataFrame([("A", "a", ["b"], 0.4), ("C", "c", [], 0.7)], "tag string, positive string, negatives array<string>, threshold double")
    return evaluate(s, rules, 0.1)


@register(
    "creator_strings",
    "STR-11",
    """WITH t AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Family, Given' WHEN 2 THEN 'A. One and B. Two' WHEN 3 THEN 'attributed to Jan Steen' ELSE '17th century' END AS s FROM supplier)
        SELECT id, CASE id % 5 WHEN 0 THEN ['Unknown'] WHEN 1 THEN ['Family, Given'] WHEN 2 THEN ['A. One', 'B. Two'] WHEN 3 THEN ['Jan Steen'] ELSE ['17th century'] END AS names, CASE id % 5 WHEN 0 THEN 'anonymous' WHEN 4 THEN 'era' ELSE 'person' END AS kind FROM t""",
)
def creator_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = F.when(k % 5 == 0, "Unknown").when(k % 5 == 1, "Family, Given").when(k % 5 == 2, "A. One and B. Two").when(k % 5 == 3, "attributed to Jan Steen").otherwise("17th century")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), text.split_creators(s).alias("names"), text.creator_kind(s).alias("kind"))


@register(
    "checklists",
    "STR-26",
    """SELECT conv_id, turn, ['Title ' || turn] AS headings, [turn % 2 = 0, true] AS done FROM conversations""",
)
def checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("## Title "), F.col("turn").cast("string"), F.lit("\ntext\n- ["), F.when(F.col("turn") % 2 == 0, "x").otherwise(" "), F.lit("] first\n* [X] second\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.headings(body).alias("headings"), F.transform(text.checklist(body), lambda c: c["done"]).alias("done"))


@register(
    "hash_bow",
    "UDX-06",
    r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: x <> '')) AS token FROM documents), c AS (SELECT doc_id, CAST('0x' || substr(sha256(token), 1, 2) AS INTEGER) AS cell, count(*) AS n FROM t GROUP BY 1, 2)
        SELECT doc_id, cell, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM c""",
)
def hash_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed bag of words: cell and weight of each token, the vector having length 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"\W+"), lambda t: t != "")).alias("token"))
    cells = d.groupBy("doc_id", numbers.hash_cell(F.col("token"), 256).alias("cell")).agg(F.count("*").alias("n"))
    norms = cells.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return cells.join(norms, "doc_id").select("doc_id", "cell", F.round(F.col("n") / F.col("norm"), 9).alias("weight"))


@register(
    "search_titles",
    "FLT-03 FLT-04",
    f"""WITH {WORKS_SQL} SELECT work_id FROM works WHERE contains(lower(title), 'on') AND coalesce(contains(lower(artist), '1'), false)""",
)
def search_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    w = works(spark, sf_dir)
    return w.where(filters.matches_query("on", F.col("title"), none, none) & filters.matches_artist("1", F.col("artist"), none, none)).select("work_id")
