"""Queries that SQL can't express, against plain loops; parsers and labels."""

from __future__ import annotations

import hashlib
import inspect
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom import registry
from cataloom.functions import numbers, parsers, text
from cataloom.operators import images, transforms
from cataloom.streaming import streams
from tests.conftest import SMALL

PALETTE = np.array([[0, 0, 0], [255, 255, 255], [200, 30, 30], [30, 160, 60], [40, 50, 190], [230, 210, 40]])


def run(spark, name):
    return registry.queries()[name](spark, SMALL).collect()


def rows_of(spark, table):
    return spark.read.parquet(f"{SMALL}/{table}.parquet").collect()


def diffused(work, inks, kernel):
    height, width, _ = work.shape
    out = np.zeros((height, width), dtype=int)
    for y in range(height):
        for x in range(width):
            out[y, x] = ((inks - work[y, x]) ** 2).sum(axis=1).argmin()
            error = work[y, x] - inks[out[y, x]]
            for dx, dy, share in kernel:
                if 0 <= x + dx < width and y + dy < height:
                    work[y + dy, x + dx] += error * share
    return out


@pytest.mark.parametrize("method", list(images.KERNELS))
def test_fronts_are_the_pixel_loop(method):
    r = np.random.default_rng(3)
    for shape in ((9, 14, 3), (1, 7, 3), (12, 3, 3), (30, 31, 3), (1, 1, 3)):
        rgb = r.uniform(0, 255, shape)
        assert (images.quantise(rgb, PALETTE, method) == diffused(rgb.copy(), PALETTE.astype(float), images.KERNELS[method])).all()


def test_dithered_images(spark):
    parts = {r.p_partkey: r for r in rows_of(spark, "part")}
    got = {r.id: r for r in run(spark, "dithered_images")}
    assert got.keys() == parts.keys()
    for k in list(parts)[:12]:
        size = parts[k].p_size
        rgb = np.array([[[x * size % 256, y * 16, (x + y) * (k % 8)] for x in range(16)] for y in range(16)], dtype=float)
        picks = diffused(rgb.copy(), PALETTE.astype(float), images.KERNELS["floyd-steinberg"])
        assert got[k].mean_ink == pytest.approx(picks.mean()) and got[k].verdict == images.gamut_fit(rgb, PALETTE)["verdict"]


def test_debounced_requests(spark):
    status, out = {}, set()
    for e in sorted(rows_of(spark, "events"), key=lambda r: r.event_id):
        kind = {"error": "error", "view": "done"}.get(e.event_type, "request")
        before, since = status.get(e.user_id, (None, 0.0))
        if kind != "request":
            status[e.user_id] = (kind, e.event_id)
        elif before in (None, "error") or before == "pending" and e.event_id - since >= 5.0:
            out.add((str(e.user_id), float(e.event_id)))
            status[e.user_id] = ("pending", e.event_id)
    assert {(r.key, r.at) for r in run(spark, "debounced_requests")} == out and out


def test_seeded_sample(spark):
    drawn = [r.p_partkey for r in run(spark, "seeded_sample")]
    hashed = spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey", F.xxhash64(F.lit(7), "p_partkey").alias("h")).collect()
    assert drawn == [r.p_partkey for r in sorted(hashed, key=lambda r: (r.h, r.p_partkey))[:50]]


def test_entity_match_ratio(spark):
    parts = rows_of(spark, "part")
    folded = {r[0]: r[1] for r in spark.createDataFrame([(p.p_partkey, p.p_name) for p in parts], "k long, s string").select("k", text.score_fold(F.col("s"))).collect()}
    brands = {p.p_partkey: p.p_brand for p in parts}
    expected = set()
    for a in folded:
        scores = {b: SequenceMatcher(None, folded[a], folded[b]).ratio() for b in folded if a != b and brands[a] == brands[b]}
        best = max(scores.values(), default=0.0)
        if best >= 0.93:
            expected |= {(a, b) for b, s in scores.items() if s >= best - 0.04}
    rows = run(spark, "entity_match_ratio")
    members = [r for r in rows if r.kind == "member"]
    links = {(r.id, r.other_id) for r in rows if r.kind == "link"}
    assert sorted(r.id for r in members) == sorted(folded)
    assert {(a.id, b.id) for a in members for b in members if a.id != b.id and (a.other_id, b.other_id) in links} == expected
    assert {r.id: r.n_links for r in members} == {a: sum(x == a for x, _ in expected) for a in folded}


def test_image_kernels(spark):
    parts = {r.p_partkey: r for r in rows_of(spark, "part")}
    got = {r.id: r for r in run(spark, "image_kernels")}
    for k in list(parts)[:20]:
        grey = np.array([[(x * (parts[k].p_size % 7 + 1) + y * (k % 5)) % 256 for x in range(32)] for y in range(32)])
        assert got[k].dhash == f"{images.difference_hash(grey):016x}" and got[k].laplacian_variance == pytest.approx(images.laplacian_variance(grey))


def test_hash_cells(spark):
    words = ["", "a", "étude", "long words here"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(*[numbers.hash_cell(F.col("w"), n) for n in (256, 1000, 7)]).collect()
    assert [tuple(r) for r in got] == [tuple(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") % n for n in (256, 1000, 7)) for w in words]


def test_budgeted_batches_resume(spark, tmp_path):
    source, done, progress = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    spark.range(100).repartition(5).write.parquet(source)
    counts = []
    for _ in range(4):
        streams.budgeted(spark, source, "id long", 2, progress, done)
        counts.append(spark.read.parquet(done).count())
    assert counts[0] < counts[1] < counts[2] == counts[3] == 100
    assert spark.read.parquet(done).select("id").distinct().count() == 100


@pytest.mark.parametrize(
    ("stem", "expected"),
    [
        ("35. The Night; Jan Maler; 1888; oil on canvas; 40 x 50 cm", ("35", "The Night", "Jan Maler", "1888", 1888, 1888, "oil on canvas", "40 x 50 cm", "semicolon")),
        ("The Night, Jan Maler; 1888; tempera", ("", "The Night", "Jan Maler", "1888", 1888, 1888, "tempera", "", "semicolon")),
        ("Night, Maler, c. 1890s", ("", "Night", "Maler", "c. 1890s", 1890, 1899, "", "", "comma")),
        ("Night; Maler; 1888-92; ink", ("", "Night", "Maler", "1888-92", 1888, 1892, "ink", "", "semicolon")),
        ("Night; Maler; 1888–05", ("", "Night", "Maler", "1888–05", 1888, 1905, "", "", "semicolon")),
        ("Night; Maler; wood; 3 in", ("", "Night", "Maler", "", None, None, "wood; 3 in", "", "semicolon")),
        ("Just a title", ("", "Just a title", "", "", None, None, "", "", "single")),
        ("; ;a", ("", "; ;a", "", "", None, None, "", "", "single")),
        ("", ("", "", "", "", None, None, "", "", "single")),
        (None, ("", "", "", "", None, None, "", "", "single")),
    ],
)
def test_positional_stems(spark, stem, expected):
    p = spark.createDataFrame([(stem,)], "s string").select(parsers.positional_stem(F.col("s")).alias("p")).first().p
    assert tuple(p) == expected


@pytest.mark.parametrize(
    ("stem", "title", "artist", "ambiguous"),
    [
        ("Orchard in bloom, by the river, Camille Maler; 1880; oil", "Orchard in bloom, by the river", "Camille Maler", False),
        ("Anna Maler, masks and death; 1890; oil", "masks and death", "Anna Maler", False),
        ("Anna Maler; Jan Bildner; 1890", "Jan Bildner", "Anna Maler", True),
        ("no capitals at all", "no capitals at all", "", False),
        ("", "", "", False),
    ],
)
def test_slotted_stems(spark, stem, title, artist, ambiguous):
    p = spark.createDataFrame([(stem,)], "s string").select(parsers.slotted_stem(F.col("s")).alias("p")).first().p
    assert (p.title, p.artist, p.ambiguous) == (title, artist, ambiguous)


def test_merged_tags_keep_what_people_decided(spark):
    schema = "work_id long, tag string, state string, source string"
    old = spark.createDataFrame([(1, "a", "confirmed", "person"), (1, "b", "proposed", "vision"), (2, "c", "rejected", "person")], schema)
    new = spark.createDataFrame([(1, "a", "proposed", "museum"), (1, "b", "proposed", "museum"), (2, "c", "proposed", "museum"), (2, "d", "proposed", "vision")], schema)
    got = {(r.work_id, r.tag): (r.state, r.source) for r in transforms.merged_tags(old, new, ["museum", "vision"]).collect()}
    assert got == {(1, "a"): ("confirmed", "person"), (1, "b"): ("proposed", "museum"), (2, "c"): ("rejected", "person"), (2, "d"): ("proposed", "vision")}


#: Operator -> the function that a query with its label must mention.
FUNCTIONS = {
    "SRC-01": "scan_works", "SRC-02": "load_record", "SRC-03": "scan_record_files", "SRC-04": "scan_csv", "SRC-07": "scan_ndjson", "SRC-08": "scan_tolerant", "SRC-10": "scan_queues",
    "SRC-11": "read_yaml", "SRC-12": "explode_map_document", "SRC-14": "read_junit", "SRC-15": "read_coverage", "SRC-17": "sparql_bindings", "SRC-18": "claim_values", "SRC-20": "scan_files",
    "SRC-22": "model_catalog", "SRC-24": "runner_messages", "SRC-25": "bag_entries", "SNK-03": "compact_live", "SNK-04": "write_upserted", "SNK-06": "write_yaml", "SNK-07": "documents.",
    "SNK-11": "feed_manifest", "SNK-12": "mirror_existing", "FLT-06": "reviewed_filter", "FLT-08": "needs_research", "FLT-10": "valid_identifier", "FLT-13": "record_rules", "FLT-16": "is_commercial",
    "FLT-17": "rating_rules", "FLT-18": "breaks_identity_invariant", "FLT-22": "partition_findings", "FLT-25": "check_envelopes", "JOIN-04": "last_decision", "JOIN-07": "hamming_pairs_wide",
    "JOIN-14": "holders", "JOIN-15": "locations_from_titles", "JOIN-17": "match_by_title", "JOIN-18": "match_by_creator", "JOIN-31": "drift", "JOIN-33": "swapped_columns", "JOIN-34": "match_people",
    "JOIN-35": "paired_cases", "ITR-07": "resolve(", "SET-03": "first_of_each", "SET-08": "combine_sets", "SET-09": "merge_labels", "STR-07": "ordered_containment", "STR-12": "text.", "STR-13": "positional_stem",
    "STR-14": "fragment_class", "STR-15": "slotted_stem", "STR-17": "infer_category", "STR-20": "losing_value", "STR-21": "keyword_label_score", "DAT-06": "lifespan", "MTH-08": "comparison_budget",
    "AGG-12": "keepalive_summary", "AGG-13": "autofix_summary", "AGG-14": "verifier_counters", "AGG-17": "freshness_summary", "AGG-31": "policy_basis", "AGG-34": "spread", "WIN-04": "latest_event",
    "WIN-11": "first_seen_mode", "CPX-08": "seeded_rank", "CPX-09": "language_map_value", "CPX-12": "registry_findings", "CPX-16": "closest_schema", "BAT-01": "fill_identities", "BAT-08": "complete_fields",
    "BAT-09": "creator_status", "BAT-11": "reciprocal_links", "BAT-12": "fold_unknown_keys", "BAT-14": "not_yet_applied", "BAT-15": "awaits_dossier", "BAT-16": "finalized", "STM-07": "budgeted",
    "TXT-02": "triage", "IMG-04": "dithered", "PRJ-12": "set_field", "UDX-06": "hash_cell", "SRT-09": "ranked_sources",
}


def test_labels_name_what_a_query_runs():
    queries = registry.queries()
    for name, labels in registry.operators().items():
        body = inspect.getsource(inspect.unwrap(queries[name]))
        for label in labels.split():
            assert label not in FUNCTIONS or FUNCTIONS[label] in body, (name, label)
    assert FUNCTIONS.keys() <= set(" ".join(registry.operators().values()).split())
