"""Scans. Schemas are given, never inferred; bad input goes to a side output with its reason instead of failing the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<ts:string,actor:string,op:string,notes:string>"
#: A catalogue record.
WORK_SCHEMA = (
    "work_id string, schema_version string, title string, title_alternate array<string>, "
    "artist struct<name:string,given:string,family:string,lifespan:string,nationality:string,wikidata_q:string,ulan:string,relation:string,canonical:struct<wikidata_q:string,display_name:string,lifespan:string,confidence:double,method:string>>, "
    "year string, year_min int, year_max int, medium string, category string, dimensions_original struct<h_cm:double,w_cm:double,raw:string>, "
    "holder struct<name:string,wikidata_q:string,ror:string,accession:string,url:string>, rights struct<status:string,evidence_url:string,evidence_wacz:string>, "
    "stable_identifiers struct<wikidata_q:string,part_of_q:string,museum_accession:string>, series struct<position:int>, "
    "subject struct<genre:string,genre_source:string,genre_confidence:double,needs_review:boolean,content_tags:array<struct<id:string,state:string,source:string,basis:string,evidence:string>>>, "
    "derived_from struct<work_id:string,kind:string,region:string,detected_by:string,image_correlation:double>, "
    "files struct<master:struct<filename:string,sha256:string,size_bytes:bigint,ingested_at:string,ingested_from:string,dimensions_px:array<int>>,variants:array<struct<rel_path:string,role:string>>>, "
    "acquisition_provenance struct<source:string,ts:string>, "
    "field_provenance map<string,struct<status:string,source:string,source_ref:string,checked_at:string,note:string>>, "
    f"history array<{EVENT}>, tags array<string>, description_short string"
)
RATING_SCHEMA = "work_id string, rater string, scheme string, surface string, ts string, event_kind string, quality double, fit double, rating double, dwell_seconds double, reason_code string, selected_reasons array<string>, freetext_by_group map<string,string>, notes string"


def scan_works(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Records below root (one meta.json a folder), keyed by folder, and the paths of unreadable ones."""
    raw = spark.read.options(recursiveFileLookup=True, pathGlobFilter="meta.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    keyed = raw.withColumn("wid", F.element_at(F.split("path", "/"), -2)).withColumn("__v", F.try_parse_json("value"))
    readable = F.col("__v").isNotNull() & F.schema_of_variant("__v").startswith("OBJECT")
    good = keyed.where(readable).withColumn("__r", F.from_json("value", WORK_SCHEMA)).select("wid", "path", "__r.*")
    return good, keyed.where(~F.coalesce(readable, F.lit(False))).select("wid", "path")


def scan_record_files(spark: SparkSession, root: str) -> DataFrame:
    """Text of each meta.json at any depth and of each top-level *.json, once: path, value."""
    deep = spark.read.options(recursiveFileLookup=True, pathGlobFilter="meta.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    top = spark.read.options(pathGlobFilter="*.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return deep.unionByName(top).dropDuplicates(["path"])


def load_record(spark: SparkSession, path: str) -> DataFrame:
    """One record; malformed input is an error."""
    return spark.read.schema(WORK_SCHEMA).options(multiLine=True, mode="FAILFAST").json(path)


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A headed CSV file, all columns text; a missing file is an empty relation."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(header=True, enforceSchema=False, multiLine=False).csv(path)


def scan_events(spark: SparkSession, path: str, schema: str = RATING_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Parsed lines with path and row_id, and the malformed ones. row_id orders the lines of a file that is read whole."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row_id"))
    return parse_lines(lines, schema)


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """lines (value, ...) without blank ones: parsed columns, and malformed or non-object lines with their reason."""
    rest = [c for c in lines.columns if c != "value"]
    full = lines.where(F.trim("value") != "").withColumn("__v", F.try_parse_json("value"))
    kind = F.when(F.col("__v").isNull(), "invalid-json").when(~F.schema_of_variant("__v").startswith("OBJECT"), "non-object-json")
    judged = full.withColumn("reason", kind)
    good = judged.where("reason IS NULL").withColumn("__p", F.from_json("value", schema)).select(*rest, "__p.*")
    return good, judged.where("reason IS NOT NULL").select(*rest, "value", "reason")


def scan_ndjson(spark: SparkSession, path: str, largest: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Records (path, record) of line-wise files as VARIANT, and errors (path, reason). A file of which no line parses is tried as one document, up to `largest` bytes."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    is_object = F.schema_of_variant("record").startswith("OBJECT")
    per_file = parsed.groupBy("path").agg(F.count_if(F.col("record").isNotNull() & is_object).alias("n_good"))
    whole_paths = per_file.where("n_good = 0").select("path")
    by_line = parsed.join(whole_paths, "path", "left_anti")
    bad = by_line.where(F.col("record").isNull() | ~is_object).select("path", F.when(F.col("record").isNull(), "invalid-json").otherwise("non-object-json").alias("reason"))
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).join(whole_paths, "path", "left_semi")
    judged = whole.withColumn("record", F.when(F.length("value") <= largest, F.try_parse_json("value")))
    reason = F.when(F.length("value") > largest, "legacy-json-fallback-buffer-limit").when(F.col("record").isNull(), "invalid-json").when(~F.schema_of_variant("record").rlike("^(OBJECT|ARRAY<OBJECT)"), "non-object-json")
    judged = judged.withColumn("reason", reason)
    documents = judged.where("reason IS NULL")
    single = documents.where(F.schema_of_variant("record").startswith("OBJECT")).select("path", "record")
    several = documents.where(F.schema_of_variant("record").startswith("ARRAY")).select("path", F.explode(F.try_variant_get("record", "$", "array<variant>")).alias("record"))
    good = by_line.where(F.col("record").isNotNull() & is_object).select("path", "record").unionByName(single).unionByName(several)
    return good, bad.unionByName(judged.where("reason IS NOT NULL").select("path", "reason"))


def scan_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-wise JSON; malformed lines drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def scan_queues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queue documents (name, description, work_ids, n) and the paths of invalid ones."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).withColumn("__v", F.try_parse_json("value"))
    good = raw.where("__v IS NOT NULL").withColumn("__q", F.from_json("value", "name string, description string, work_ids array<string>"))
    return good.select("path", "__q.*").withColumn("n", F.size("work_ids")), raw.where("__v IS NULL").select("path")


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A configuration file that holds a list of records, or a map of them by `key`; a dimension table."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml package") from missing

    held = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    loaded = yaml.safe_load(held) or []
    rows = [{"key": k, **v} for k, v in loaded.items()] if isinstance(loaded, dict) else loaded
    return spark.createDataFrame([], schema) if not rows else spark.createDataFrame(rows, schema)


def explode_map_document(documents: DataFrame, value_schema: str, required: str) -> DataFrame:
    """key and fields of one JSON object that maps keys to records (column value); entries without the required field drop out."""
    held = documents.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "entry"))
    return held.where(F.col(f"entry.{required}").isNotNull()).select("key", "entry.*")


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of JUnit files: name, classname, time, outcome, message. The first of failure, error and skipped counts."""
    child = "struct<_message:string,_type:string,_VALUE:string>"
    raw = spark.read.schema(f"_name string, _classname string, _time double, failure {child}, error {child}, skipped {child}").option("rowTag", "testcase").format("xml").load(path)
    outcome = F.when(F.col("failure").isNotNull(), "failure").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return raw.select(F.col("_name").alias("name"), F.col("_classname").alias("classname"), F.coalesce("_time", F.lit(0.0)).alias("time"), outcome.alias("outcome"), F.coalesce("failure._message", "error._message", "skipped._message").alias("message"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """file, covered, missing, percent of a coverage JSON document."""
    raw = spark.read.text(path, wholetext=True)
    files = F.from_json("value", "files map<string,struct<summary:struct<covered_lines:bigint,missing_lines:bigint,percent_covered:double>>>")["files"]
    return raw.select(F.explode(files).alias("file", "f")).select("file", F.col("f.summary.covered_lines").alias("covered"), F.col("f.summary.missing_lines").alias("missing"), F.col("f.summary.percent_covered").alias("percent"))


def markdown_rows(lines: DataFrame, least_columns: int = 4) -> DataFrame:
    """cells of table rows among lines (value): rulers and rows with too few cells drop out."""
    cells = F.transform(F.split(F.trim(F.trim("value"), F.lit("|")), r"\|"), lambda c: F.trim(c))
    return lines.where(F.ltrim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).select(cells.alias("cells")).where(F.size("cells") >= least_columns)


def sparql_bindings(documents: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The values of variables, a row a binding, of SPARQL JSON results (column value); unbound ones are null."""
    bindings = F.from_json("value", "results struct<bindings:array<map<string,struct<value:string>>>>")["results"]["bindings"]
    rows = documents.select(F.explode(bindings).alias("b"))
    return rows.select(*[F.try_element_at("b", F.lit(v))["value"].alias(v) for v in variables])


def claim_values(entities: DataFrame, properties: Sequence[str]) -> DataFrame:
    """qid, property, target, amount of entity JSON (qid, value); only snaks that hold a value."""
    snak = "struct<mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>"
    claims = F.from_json("value", f"claims map<string,array<{snak}>>")["claims"]
    flat = entities.select("qid", F.explode(claims).alias("property", "snaks")).where(F.col("property").isin(*properties))
    one = flat.select("qid", "property", F.explode("snaks").alias("s")).where("s.mainsnak.snaktype = 'value'")
    value = F.col("s.mainsnak.datavalue.value")
    return one.select("qid", "property", F.coalesce(F.get_json_object(value, "$.id"), F.get_json_object(value, "$.time"), F.when(~value.startswith("{"), value)).alias("target"), F.get_json_object(value, "$.amount").try_cast("double").alias("amount"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified, sha256 of every file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def reference_names(rows: DataFrame, name: str, least: int) -> DataFrame:
    """kind, value: full folded names and surnames of names that occur often enough."""
    from cataloom.functions import text

    frequent = rows.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pairs = F.array(F.struct(F.lit("full").alias("kind"), text.ascii_fold(F.col(name)).alias("value")), F.struct(F.lit("surname").alias("kind"), text.surname(F.col(name)).alias("value")))
    return frequent.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").distinct()


def bag_entries(lines: DataFrame) -> DataFrame:
    """digest, path of manifest lines (value)."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.where(F.trim("value") != "").select(parts[0].alias("digest"), parts[1].alias("path"))


def runner_messages(lines: DataFrame) -> DataFrame:
    """row_id, message, error of JSONL runner output (row_id, value); text may sit in several places."""
    v = F.try_parse_json("value")
    message = F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.text", "$.message.text", "$.content", "$.item.text")])
    return lines.select("row_id", message.alias("message"), F.coalesce(F.try_variant_get(v, "$.error.message", "string"), F.try_variant_get(v, "$.error", "string")).alias("error"))


def model_catalog(documents: DataFrame) -> DataFrame:
    """provider, model_id, created of catalogue payloads (provider, value) in any of three shapes."""
    shapes = [("data array<struct<id:string,created:string,created_at:string>>", "data", "id"), ("models array<struct<name:string,created:string,created_at:string>>", "models", "name")]
    out = None
    for schema, field, key in shapes:
        rows = documents.select("provider", F.explode(F.from_json("value", schema)[field]).alias("m")).select("provider", F.col(f"m.{key}").alias("model_id"), F.coalesce("m.created", "m.created_at").alias("created"))
        out = rows if out is None else out.unionByName(rows)
    bare = documents.where(F.ltrim("value").startswith("[")).select("provider", F.explode(F.from_json("value", "array<struct<id:string,created:string>>")).alias("m")).select("provider", F.col("m.id").alias("model_id"), F.col("m.created").alias("created"))
    return out.unionByName(bare).where("model_id IS NOT NULL")
