"""Queries that write files to the shared folder and scan them again: the formats, their bad input, and the sinks.

Trees of single files are made from the small dimension tables by the driver; everything else is written by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import documents
from cataloom.functions.dates import is_live
from cataloom.operators import joins, sets, windows
from cataloom.plans.catalogue import table
from cataloom.registry import register
from cataloom.scratch import folder, put_text
from cataloom.sources import readers, sinks


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """A dimension of fixed size."""
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def _record_tree(spark: SparkSession, sf_dir: str) -> str:
    """works/<wid>/meta.json for each nation, some of them broken, and a top-level file."""
    root = folder(spark, "records")
    for n in _nations(spark, sf_dir):
        record = {"work_id": f"w{n.n_nationkey}", "title": n.n_name, "artist": {"name": f"painter {n.n_regionkey}"}, "year_min": 1500 + n.n_nationkey, "tags": ["a", "b"], "extra": 1}
        text = "{broken" if n.n_nationkey % 7 == 3 else "[1]" if n.n_nationkey % 7 == 5 else json.dumps(record)
        put_text(spark, f"{root}/w{n.n_nationkey}/meta.json", text)
    put_text(spark, f"{root}/loose.json", '{"work_id": "loose"}')
    return root


@register(
    "record_tree_scan",
    "SRC-01 SNK-01",
    """SELECT 'w' || n_nationkey AS wid, CASE WHEN n_nationkey % 7 NOT IN (3, 5) THEN n_name END AS title, CASE WHEN n_nationkey % 7 NOT IN (3, 5) THEN CAST(1500 + n_nationkey AS INTEGER) END AS year_min, n_nationkey % 7 NOT IN (3, 5) AS readable FROM nation""",
)
def record_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = readers.scan_works(spark, _record_tree(spark, sf_dir))
    out = good.select("wid", "title", "year_min", F.lit(True).alias("readable"))
    return out.unionByName(bad.select("wid", F.lit(False).alias("readable")), allowMissingColumns=True)


@register(
    "record_files",
    "SRC-03 SRC-02",
    """SELECT 'meta.json' AS name, count(*) AS n, CAST('w0' AS VARCHAR) AS first_id FROM nation UNION ALL SELECT 'loose.json', 1, 'w0'""",
)
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the tree by name, and the identifier of one that is loaded strictly."""
    root = _record_tree(spark, sf_dir)
    files = readers.scan_record_files(spark, root).groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("n"))
    loaded = readers.load_record(spark, f"{root}/w0/meta.json").select(F.col("work_id").alias("first_id"))
    return files.join(F.broadcast(loaded))


@register(
    "csv_round_trip",
    "SRC-04 SNK-05",
    """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'a, "quoted" name' ELSE s_name END AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier""",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and scanned as text; a file that is missing adds nothing."""
    report = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, 'a, "quoted" name').otherwise(F.col("s_name")).alias("s_name"), "s_nationkey")
    path = folder(spark, "report")
    sinks.write_report(report, path, ["s_suppkey"])
    columns = ["s_suppkey", "s_name", "s_nationkey"]
    return readers.scan_csv(spark, path, columns).unionByName(readers.scan_csv(spark, f"{path}-missing", columns))


@register(
    "ndjson_errors",
    "SRC-07 SRC-08",
    """SELECT 'parsed' AS reason, 25 + 3 + 1 AS n UNION ALL SELECT 'invalid-json', 1 + 2 UNION ALL SELECT 'non-object-json', 1 + 1 UNION ALL SELECT 'legacy-json-fallback-buffer-limit', 1 UNION ALL SELECT 'tolerated', 25""",
)
def ndjson_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-wise files with bad lines, whole documents, an array, garbage and one beyond the buffer."""
    root = folder(spark, "ndjson")
    lines = [json.dumps({"k": n.n_nationkey}) for n in _nations(spark, sf_dir)]
    put_text(spark, f"{root}/lines.ndjson", "\n".join([*lines[:10], "", "{bad", "[7]", *lines[10:]]))
    put_text(spark, f"{root}/array.json", "[\n" + ",\n".join(json.dumps({"a": [i, i]}) for i in range(3)).replace('"a"', '\n"a"') + "\n]")
    put_text(spark, f"{root}/document.json", '{\n"a": 1,\n"b": 2\n}')
    put_text(spark, f"{root}/garbage.json", "<html>\nno json\n</html>")
    put_text(spark, f"{root}/scalars.json", "1,\n2")
    put_text(spark, f"{root}/number.json", "17")
    put_text(spark, f"{root}/large.json", '{\n"a": "' + "x" * 5_000 + '"\n}')
    good, bad = readers.scan_ndjson(spark, root, largest=4_000)
    kinds = good.select(F.lit("parsed").alias("reason")).unionByName(bad.select("reason"))
    tolerated = readers.scan_tolerant(spark, f"{root}/lines.ndjson", "k int").where("k IS NOT NULL").select(F.lit("tolerated").alias("reason"))
    return kinds.unionByName(tolerated).groupBy("reason").agg(F.count("*").cast("int").alias("n"))


@register(
    "log_compaction",
    "SNK-02 SNK-03 SRC-06 SRC-09 STM-04",
    """WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS work_id FROM events, m WHERE ts >= now - INTERVAL 10 DAY""",
)
def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows by two appends, compacted to what is younger than ten days at its last event."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("work_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("event_kind"), F.col("value").alias("quality"))
    path, live = folder(spark, "log"), folder(spark, "live")
    for half in (0, 1):
        sinks.append_events(e.where(F.col("event_id") % 2 == half), path)
    log, _ = readers.scan_events(spark, path, "event_id long, work_id string, ts string, event_kind string, quality double")
    now = F.lit(log.agg(F.max("ts")).first()[0]).cast("timestamp")
    sinks.compact_live(log.drop("row_id"), "ts", now, 10, live)
    kept = spark.read.parquet(live)
    return kept.where(is_live(F.col("ts"), now, 10)).select(F.col("event_id").alias("row_id"), "work_id")


@register(
    "upserted_history",
    "SNK-04 STM-06",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN 'again' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1, 'new'""",
)
def upserted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    new = history.where("run_id % 4 = 0").withColumn("status", F.lit("again")).unionByName(spark.createDataFrame([(-1, "new")], history.schema))
    path = folder(spark, "history")
    sinks.write_upserted(history, new, path)
    return spark.read.schema(history.schema).json(path)


@register(
    "queue_documents",
    "SRC-10 JOIN-03",
    """SELECT r_name AS name, list('w' || n_nationkey ORDER BY n_nationkey) AS work_ids, CAST(count(*) AS INTEGER) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'invalid', NULL, 1""",
)
def queue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "queues")
    nations = _nations(spark, sf_dir)
    for r in table(spark, sf_dir, "region").collect():
        ids = [f"w{n.n_nationkey}" for n in nations if n.n_regionkey == r.r_regionkey]
        put_text(spark, f"{root}/q{r.r_regionkey}.json", json.dumps({"name": r.r_name, "description": "works of a region", "work_ids": ids}, indent=1))
    put_text(spark, f"{root}/broken.json", '{"name": ')
    good, bad = readers.scan_queues(spark, root)
    return good.select("name", "work_ids", "n").unionByName(bad.select(F.lit("invalid").alias("name"), F.lit(1).alias("n")), allowMissingColumns=True)


@register(
    "host_registry",
    "SRC-11 SNK-06",
    """SELECT n_name AS key, CAST(1 + n_nationkey % 3 AS BIGINT) AS tier FROM nation""",
)
def host_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small aggregate written as YAML and read as configuration."""
    path = folder(spark, "hosts") + ".yaml"
    sinks.write_yaml(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), (F.lit(1) + F.col("n_nationkey") % 3).cast("long").alias("tier")), path, "key")
    return readers.read_yaml(spark, path, "key string, tier long")


@register(
    "hash_cache",
    "SRC-12",
    """SELECT 'w' || n_nationkey AS key, substr(md5(n_name), 1, 16) AS dhash, n_name AS title FROM nation WHERE n_nationkey % 6 <> 1""",
)
def hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that is one JSON object; entries without a hash drop out."""
    n = table(spark, sf_dir, "nation")
    entry = F.to_json(F.struct(F.when(F.col("n_nationkey") % 6 != 1, F.substring(F.md5("n_name"), 1, 16)).alias("dhash"), F.col("n_name").alias("title")))
    path = folder(spark, "cache")
    packed = n.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"w'), F.col("n_nationkey").cast("string"), F.lit('": '), entry)), ", "), F.lit("}")).alias("value"))
    packed.write.text(path)
    return readers.explode_map_document(spark.read.text(path, wholetext=True), "struct<dhash:string,title:string>", "dhash")


@register(
    "junit_cases",
    "SRC-14 AGG-21",
    """SELECT n_name AS name, 'suite' || n_regionkey AS classname, n_nationkey / 4.0::DOUBLE AS time, CASE n_nationkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failure' WHEN 2 THEN 'error' ELSE 'skipped' END AS outcome, CASE n_nationkey % 4 WHEN 1 THEN 'expected 1' WHEN 2 THEN 'boom' END AS message FROM nation""",
)
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = {0: "", 1: '<failure message="expected 1" type="AssertionError">trace</failure>', 2: '<error message="boom" type="ValueError">trace</error>', 3: "<skipped/>"}
    cases = "".join(f'<testcase name="{n.n_name}" classname="suite{n.n_regionkey}" time="{n.n_nationkey / 4}">{ends[n.n_nationkey % 4]}</testcase>' for n in _nations(spark, sf_dir))
    root = folder(spark, "junit")
    put_text(spark, f"{root}/report.xml", f"<testsuites><testsuite>{cases}</testsuite></testsuites>")
    return readers.read_junit(spark, f"{root}/report.xml")


@register(
    "coverage_rows",
    "SRC-15 SRT-07",
    """SELECT 'src/' || n_name || '.py' AS file, CAST(n_nationkey * 3 AS BIGINT) AS covered, CAST(n_nationkey % 5 AS BIGINT) AS missing FROM nation WHERE n_nationkey % 5 > 0 ORDER BY missing DESC, file LIMIT 10""",
)
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {f"src/{n.n_name}.py": {"summary": {"covered_lines": n.n_nationkey * 3, "missing_lines": n.n_nationkey % 5, "percent_covered": 50.0}} for n in _nations(spark, sf_dir)}
    root = folder(spark, "coverage")
    put_text(spark, f"{root}/coverage.json", json.dumps({"meta": {}, "files": files}))
    return sets.hot_spots_first(readers.read_coverage(spark, f"{root}/coverage.json"), "missing", "covered", "file", 10).select("file", "covered", "missing")


@register(
    "sparql_rows",
    "SRC-17",
    """SELECT 'Q' || c_custkey AS w, c_name AS "wLabel", CASE WHEN c_custkey % 3 = 0 THEN 'H' || c_nationkey END AS coll FROM customer""",
)
def sparql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of many bindings, some variables unbound."""
    c = table(spark, sf_dir, "customer")

    def bound(value: object, name: str) -> object:
        return F.when(value.isNotNull(), F.struct(F.lit("literal").alias("type"), value.alias("value"))).alias(name)

    binding = F.struct(bound(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")), "w"), bound(F.col("c_name"), "wLabel"), bound(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("H"), F.col("c_nationkey").cast("string"))), "coll"))
    # A document a nation and hundred customers, so that none grows with the table.
    documents_ = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100)).agg(F.to_json(F.struct(F.struct(F.collect_list(binding).alias("bindings")).alias("results"))).alias("value"))
    return readers.sparql_bindings(documents_, ["w", "wLabel", "coll"])


@register(
    "entity_claims",
    "SRC-18 PRJ-15",
    """SELECT 'Q' || s_suppkey AS qid, 'P170' AS property, 'Q' || (1000 + s_nationkey) AS target, NULL::DOUBLE AS amount FROM supplier UNION ALL SELECT 'Q' || s_suppkey, 'P571', '+' || (1500 + s_nationkey) || '-01-01T00:00:00Z', NULL FROM supplier WHERE s_suppkey % 4 <> 0
        UNION ALL SELECT 'Q' || s_suppkey, 'P2048', NULL, s_nationkey + 0.5 FROM supplier UNION ALL SELECT 'Q' || s_suppkey, 'P245', '5000' || s_suppkey, NULL FROM supplier""",
)
def entity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of entity JSON, Getty identifiers among them; snaks without a value drop out."""
    def claim(prop: str, value: object, present: object | None = None) -> object:
        kind = F.lit("value") if present is None else F.when(present, "value").otherwise("novalue")
        snak = F.concat(F.lit('{"mainsnak": {"snaktype": "'), kind, F.lit('", "datavalue": {"value": '), value, F.lit("}}}"))
        return F.concat(F.lit(f'"{prop}": ['), snak, F.lit("]"))

    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    parts = [
        claim("P170", F.concat(F.lit('{"id": "Q'), (n + 1000).cast("string"), F.lit('"}'))),
        claim("P571", F.concat(F.lit('{"time": "+'), (n + 1500).cast("string"), F.lit('-01-01T00:00:00Z"}')), F.col("s_suppkey") % 4 != 0),
        claim("P2048", F.concat(F.lit('{"amount": "+'), n.cast("string"), F.lit('.5", "unit": "1"}'))),
        claim("P245", F.concat(F.lit('"5000'), k, F.lit('"'))),
        claim("P31", F.lit('{"id": "Q3305213"}')),
    ]
    entities = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Q"), k).alias("qid"), F.concat(F.lit('{"claims": {'), F.concat_ws(", ", *parts), F.lit("}}")).alias("value"))
    return readers.claim_values(entities, ["P170", "P571", "P2048", "P245"])


@register(
    "model_catalogs",
    "SRC-22",
    """SELECT 'p' || n_nationkey AS provider, 'm' || i AS model_id, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE '2024-01-0' || i END AS created FROM nation, (SELECT unnest([1, 2]) AS i)""",
)
def model_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = {
        0: '{"data": [{"id": "m1", "created": "2024-01-01"}, {"id": "m2", "created_at": "2024-01-02"}, {"object": "x"}]}',
        1: '{"models": [{"name": "m1", "created": "2024-01-01"}, {"name": "m2", "created_at": "2024-01-02"}]}',
        2: '[{"id": "m1"}, {"id": "m2"}]',
    }
    value = F.lit(shapes[2])
    for shape in (0, 1):
        value = F.when(F.col("n_nationkey") % 3 == shape, F.lit(shapes[shape])).otherwise(value)
    payloads = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("provider"), value.alias("value"))
    return readers.model_catalog(payloads)


@register(
    "runner_lines",
    "SRC-24",
    """SELECT event_id AS row_id, CASE WHEN event_id % 5 < 4 THEN event_type END AS message, CASE event_id % 5 WHEN 3 THEN 'slow' WHEN 4 THEN 'dead' END AS error FROM events""",
)
def runner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    value = (
        F.when(k % 5 == 0, F.concat(F.lit('{"text": "'), kind, F.lit('"}')))
        .when(k % 5 == 1, F.concat(F.lit('{"message": {"text": "'), kind, F.lit('"}}')))
        .when(k % 5 == 2, F.concat(F.lit('{"item": {"text": "'), kind, F.lit('"}}')))
        .when(k % 5 == 3, F.concat(F.lit('{"content": "'), kind, F.lit('", "error": {"message": "slow"}}')))
        .otherwise(F.lit('{"error": "dead"}'))
    )
    return readers.runner_messages(table(spark, sf_dir, "events").select(k.alias("row_id"), value.alias("value")))


@register(
    "bag_round_trip",
    "SRC-20 SRC-25 SNK-08 JOIN-26",
    """SELECT n_name || '.txt' AS name, CASE WHEN n_nationkey % 8 = 1 THEN 'mismatched' WHEN n_nationkey % 8 = 2 THEN 'unexpected' ELSE 'ok' END AS status, (SELECT CAST(sum(length(n_name)) AS VARCHAR) || '.' || count(*) FROM nation) AS oxum FROM nation UNION ALL SELECT 'gone.txt', 'missing', (SELECT CAST(sum(length(n_name)) AS VARCHAR) || '.' || count(*) FROM nation)""",
)
def bag_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload hashed by a file scan, its manifest written and read, and one held against the other after some damage."""
    root, tags = folder(spark, "payload"), folder(spark, "tags")
    for n in _nations(spark, sf_dir):
        put_text(spark, f"{root}/data/{n.n_name}.txt", n.n_name)
    files = readers.scan_files(spark, root).withColumn("path", F.element_at(F.split("path", "/"), -1))
    lines, oxum = sinks.bag_manifest(files)
    lines.write.text(tags)
    entries = readers.bag_entries(spark.read.text(tags))
    numbered = entries.join(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".txt")).alias("path"), (F.col("n_nationkey") % 8).alias("harm")), "path")
    manifest = numbered.where("harm <> 2").select("path", F.when(F.col("harm") == 1, F.lit("0" * 64)).otherwise(F.col("digest")).alias("digest"))
    manifest = manifest.unionByName(spark.createDataFrame([("gone.txt", "1" * 64)], "path string, digest string"))
    compared = joins.compare_manifest(manifest, files.select("path", F.col("sha256").alias("digest")))
    return compared.join(F.broadcast(oxum.select("oxum"))).select(F.col("path").alias("name"), "status", "oxum")


@register(
    "linked_art_documents",
    "PRJ-02 SNK-07",
    """SELECT 'w' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS artist, CASE WHEN p_partkey % 4 <> 0 THEN (1400 + p_size) || '-01-01' END AS begun, p_partkey % 3 <> 0 OR p_partkey % 4 <> 0 AS produced, p_partkey % 5 = 0 AS owned FROM part""",
)
def linked_art_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written a line each and read back; sub-objects only where something is known."""
    k = F.col("p_partkey")
    document = documents.linked_art(
        F.concat(F.lit("w"), k.cast("string")), F.col("p_name"), F.when(k % 3 != 0, F.col("p_brand")), F.when(k % 2 == 0, "Q1"),
        F.when(k % 4 != 0, F.lit(1400) + F.col("p_size")), F.lit(None).cast("int"), F.when(k % 2 == 0, "oil"), F.when(k % 5 == 0, "Museum"),
    )
    path = folder(spark, "linked-art")
    sinks.emit_documents(table(spark, sf_dir, "part"), document, path)
    v = F.parse_json("value")

    def at(p: str) -> object:
        return F.try_variant_get(v, p, "string")

    read = spark.read.text(path)
    return read.select(at("$.id").alias("id"), at("$.identified_by[0].content").alias("title"), at("$.produced_by.carried_out_by[0]._label").alias("artist"), at("$.produced_by.timespan.begin_of_the_begin").alias("begun"), F.get_json_object("value", "$.produced_by").isNotNull().alias("produced"), F.get_json_object("value", "$.current_owner").isNotNull().alias("owned"))


@register(
    "iiif_manifests",
    "PRJ-03 SNK-07",
    """SELECT 'http://x/w' || p_partkey || '/manifest' AS id, 'Manifest' AS type, CAST(p_size * 10 AS INTEGER) AS width, 'painting' AS motivation FROM part""",
)
def iiif_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("http://x/w"), F.col("p_partkey").cast("string"))
    made = table(spark, sf_dir, "part").select(F.to_json(documents.iiif_manifest(base, F.col("p_name"), F.concat(base, F.lit(".jpg")), (F.col("p_size") * 10).cast("int"), F.lit(50))).alias("value"))
    v = F.parse_json("value")
    return made.select(F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.items[0].width", "int").alias("width"), F.try_variant_get(v, "$.items[0].items[0].items[0].motivation", "string").alias("motivation"))


@register(
    "feed_documents",
    "SNK-11",
    """SELECT r_name AS feed, count(*) AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""",
)
def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = sinks.feed_manifest(items.withColumnRenamed("r_name", "feed"), "feed", "n_nationkey", ["n_nationkey", "n_name"])
    parsed = F.from_json("document", "n long, items array<struct<n_nationkey:long,n_name:string>>")
    return made.select("feed", parsed.alias("d")).select("feed", "d.n", F.array_join(F.transform("d.items", lambda i: i["n_name"]), "|").alias("names"))


@register(
    "mirror_writes",
    "SNK-12",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def mirror_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirror = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    path = folder(spark, "mirror")
    sinks.write_snapshot(sinks.mirror_existing(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), mirror, "o_orderkey"), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path)


@register(
    "catalogue_table",
    "SRC-16 SNK-05",
    """SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, CAST(count(*) AS VARCHAR) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def catalogue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as a Markdown table in a file, and its rows scanned from there."""
    report = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).agg(F.count("*").alias("n"))
    root = folder(spark, "markdown")
    put_text(spark, f"{root}/report.md", "# Report\n\n" + sinks.markdown_table(report, ["key"]) + "\n\nprose | with a bar\n")
    cells = readers.markdown_rows(spark.read.text(f"{root}/report.md"), least_columns=3)
    return cells.select(F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("n")).where("key <> 'key'")


@register(
    "events_last_state",
    "SRC-05 WIN-02",
    """SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS last_view, count(*) AS n FROM events GROUP BY 1""",
)
def events_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines, with blank and broken ones among them, and read as the last value of each key."""
    e = table(spark, sf_dir, "events")
    path = folder(spark, "lines")
    good = e.select(F.to_json(F.struct("event_id", "user_id", F.when(F.col("event_type") == "view", F.col("value")).alias("view"))).alias("value"))
    good.unionByName(spark.createDataFrame([("",), ("  ",), ("{oops",), ("[1]",)], "value string")).write.text(path)
    read, _ = readers.scan_events(spark, path, "event_id long, user_id long, view double")
    held = windows.last_non_null(read, ["user_id"], ["view"], "event_id")
    return held.join(read.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", F.col("view").alias("last_view"), "n")
