"""Operators on small relations with known answers, and loops for what SQL can't express."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cataloom.functions import dates, numbers, text, vocabulary
from cataloom.operators import aggregates, filters, images, joins, preferences, sets, transforms, windows
from cataloom.plans import playlist
from cataloom.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("fold", "raw", "expected"),
    [
        (text.norm_title, "Café de l'Europe", "cafe de l europe"),
        (text.norm_title, "Pierre-Auguste  Renoir ", "pierre auguste renoir"),
        (text.norm_title, "東京 Über", "東京 uber"),
        (text.ascii_fold, "東京 Über!", "uber"),
        (text.plain_fold, "Über, Alles", "über alles"),
        (text.norm_title, None, ""),
        (text.surname, "Jan van Eyck", "eyck"),
        (text.surname, "Li Bo", ""),
        (text.slug, "The Night Watch of Captain Frans Banninck", "the-night-watch-of-captain-frans"),
        (text.domain_of, "https://WWW.Example.org:80/x", "example.org"),
        (text.version_text, "tool v1.22.3-beta", "1.22.3"),
        (text.creator_kind, "Unknown artist", "anonymous"),
        (text.creator_kind, None, "missing"),
        (dates.best_year, "c. 1665–67", 1665),
        (dates.best_year, "99999", None),
        (dates.lifespan, None, None),
    ],
)
def test_scalars(spark, fold, raw, expected):
    args = [F.lit(raw).cast("string")] * (2 if fold is dates.lifespan else 1)
    assert one(spark, fold(*args)) == expected


@pytest.mark.parametrize(("raw", "low", "high"), [("1885-90", 1885, 1890), ("1890s", 1890, 1899), ("1601 or 1606", 1601, 1606), ("", None, None), (None, None, None)])
def test_year_range(spark, raw, low, high):
    assert tuple(one(spark, dates.year_range(F.lit(raw).cast("string")))) == (low, high)


@pytest.mark.parametrize(("raw", "pair"), [("10 x 20 cm", [10.0, 20.0]), ("4 × 2 in", [5.08, 10.16]), ("oil", None), ("1,5 m x 2 m", [150.0, 200.0])])
def test_dimensions(spark, raw, pair):
    got = one(spark, numbers.dimension_pair(F.lit(raw)))
    assert got == pytest.approx(pair) if pair else got is None


def test_vocabulary(spark):
    def rendered(raw):
        return one(spark, F.when(vocabulary.parse_medium(F.lit(raw).cast("string")).isNotNull(), vocabulary.render_medium(vocabulary.parse_medium(F.lit(raw).cast("string")))))

    assert rendered("egg tempera and gold leaf on wood panel") == "Tempera and gold on panel" and rendered("bronze") is None and rendered(None) is None


@pytest.mark.parametrize(("a", "b", "d"), [(0, 0, 0), (0b1010, 0b1011, 1), (0, 2**256 - 1, 256)])
def test_hamming_of_256_bits(spark, a, b, d):
    limbs = [numbers.hash_limbs(F.lit(f"{x:064x}")) for x in (a, b)]
    assert one(spark, numbers.hamming_limbs(*limbs)) == d


def test_wilson_and_cosine(spark):
    low, high = one(spark, numbers.wilson_interval(F.lit(8), F.lit(10)))
    assert (low, high) == pytest.approx((0.4902, 0.9433), abs=1e-4)
    assert one(spark, numbers.wilson_interval(F.lit(0), F.lit(0))) is None
    v = [F.array(*[F.lit(float(x)) for x in xs]) for xs in ((1, 0), (1, 1), (0, 0), (1,))]
    assert one(spark, numbers.cosine(v[0], v[1])) == pytest.approx(0.5**0.5) and one(spark, numbers.cosine(v[0], v[2])) == 0 and one(spark, numbers.cosine(v[0], v[3])) == 0


def test_ratio_is_the_librarys(spark):
    pairs = [("abcd", "bcde"), ("night watch", "the night watch"), ("", ""), ("x" * 300, "x" * 250 + "y"), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.ratio("a", "b").alias("r")).collect()
    assert [r.r for r in rows] == [None if r.a is None else SequenceMatcher(None, r.a, r.b).ratio() for r in rows]


def test_ordered_containment(spark):
    short, long = (F.array(*[F.lit(x) for x in xs]) for xs in (("night", "watch"), ("the", "night", "great", "watch")))
    assert one(spark, text.ordered_containment(short, long)) == 1.0 and one(spark, text.ordered_containment(long, short)) == pytest.approx(0.0)


def test_playlist_counts_missing_fields(spark):
    works = spark.createDataFrame(
        [(1, "b", "X", "painting/portrait", 1500, ["setting:night"]), (2, "a", None, "painting/portrait", 1650, []), (3, "c", "x ", None, 1700, ["subject:ship"]), (4, "d", "y", "painting/seascape", None, [])],
        "work_id long, title string, artist string, genre string, year int, tags array<string>",
    )
    spec = playlist.PlaylistSpec(genres=["painting/portrait", "painting/seascape"], year_from=1500)
    assert {r.reason: r.n for r in playlist.drop_reasons(works, spec).collect()} == {"matched": 2, "no genre": 1, "no year": 1}
    assert [r.work_id for r in playlist.select_playlist(works, playlist.PlaylistSpec(sort="title")).collect()] == [2, 1, 3, 4]
    assert {r.mood: r.n for r in playlist.mood_facets(works).collect()} == {"nocturne": 1, "sea-and-ships": 2, "faces": 2}
    assert [r.work_id for r in playlist.select_playlist(works, playlist.PlaylistSpec(moods=["nocturne"], limit=0)).collect()] == [1]
    with pytest.raises(KeyError):
        playlist.verdict(playlist.PlaylistSpec(moods=["none such"]))
    with pytest.raises(ValueError):
        playlist.ordering(playlist.PlaylistSpec(sort="none such"))


def test_latest_takes_the_later_line_of_equal_times(spark):
    e = spark.createDataFrame([("w", "t1", 1, 5), ("w", "t2", 2, 6), ("w", "t2", 3, None)], "k string, ts string, row_id long, v int")
    assert windows.latest_per_key(e, ["k"]).first().v is None
    assert windows.last_non_null(e, ["k"], ["v"]).first().v == 6
    assert windows.top_per_key(e, ["k"], [F.col("row_id")], 0).count() == 0


def test_variant_edges(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "d", 3), ("e", "d", 4), ("f", "f", 5)], "owner string, held string, ord long")
    holdings, mutual, own = joins.variant_edges(e)
    assert {tuple(r) for r in holdings.collect()} == {("d", "c"), ("f", "f")} and [tuple(r) for r in mutual.collect()] == [("a", "b")] and [r.owner for r in own.collect()] == ["f"]


def test_closure_ends_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "root"), ("x", "gone")], "child string, parent string")
    assert {tuple(r) for r in joins.reachable_roots(e, ["root"]).collect()} == {("a", "root"), ("b", "root"), ("c", "root")}


def test_tiers(spark):
    c = spark.createDataFrame([(1, "Paris Street; Rainy Day", "Gustave Caillebotte")], "id long, title string, artist string")
    i = spark.createDataFrame([(10, "Paris Street", "G. Caillebotte"), (11, "paris street rainy day", "gustave caillebotte"), (12, "Paris Street, Rainy Day", "Other One"), (13, "Unrelated", "Caillebotte"), (14, "", "")], "id long, title string, artist string")
    got = {r.inventory_id: (r.tier, round(r.confidence, 4)) for r in joins.tiered_match(c, i, ["id", "title", "artist"], ["id", "title", "artist"]).collect()}
    assert got == {10: ("exact-artist+near-title", 0.95), 11: ("exact-title-artist", 0.99), 12: ("exact-title", 0.70)}


def test_hamming_bands_lose_nothing(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 2**62, 40)]
    values = base + [b ^ (1 << int(r.integers(62))) ^ (1 << int(r.integers(62))) for b in base]
    h = spark.createDataFrame(list(enumerate(values)), "id long, hash long")
    got = {(x.left_id, x.right_id) for x in joins.hamming_pairs(h, h, 5).collect()}
    assert got == {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= 5}


def bradley_terry(pairs):
    items = sorted({x for p in pairs for x in p})
    n, wins = {}, dict.fromkeys(items, 0.0)
    for w, l in pairs:
        n[min(w, l), max(w, l)] = n.get((min(w, l), max(w, l)), 0) + 1
        wins[w] += 1
    for a, b in n:
        n[a, b] += 1
        wins[a] += 0.5
        wins[b] += 0.5
    p = dict.fromkeys(items, 1.0)
    for _ in range(500):
        new = {i: wins[i] / sum(c / (p[a] + p[b]) for (a, b), c in n.items() if i in (a, b)) for i in items}
        total = sum(new.values())
        p = {i: v * len(items) / total for i, v in new.items()}
    return p


@pytest.mark.parametrize("fit_items", [20_000, 2])
def test_strengths(spark, monkeypatch, fit_items):
    monkeypatch.setattr(preferences, "FIT_ITEMS", fit_items)
    if fit_items == 2:
        monkeypatch.setattr(preferences, "TOLERANCE", 1e-2)
    pairs = [(1, 2)] * 4 + [(2, 3)] * 4 + [(1, 3)] * 3 + [(3, 1)]
    frame = spark.createDataFrame([*pairs, (4, 4)], "winner long, loser long")
    got = {r.item: r.strength for r in preferences.bradley_terry(frame).collect()}
    assert got == pytest.approx(bradley_terry(pairs), rel=1e-5 if fit_items > 2 else 0.1)


def test_next_pairs(spark):
    s = spark.createDataFrame([(i, 0, v) for i, v in enumerate((0.1, 0.2, 0.9, 1.0, 1.05))], "item long, component long, strength double")
    c = spark.createDataFrame([(3, 4)], "winner long, loser long")
    assert [(r.a, r.b) for r in preferences.closest_unasked(s, c, 3).orderBy("gap").collect()] == [(2, 3), (0, 1), (2, 4)]


def test_diverse_subset_takes_the_largest_determinant():
    r = np.random.default_rng(4)
    items = pd.DataFrame({"id": range(12), "quality": r.uniform(0.5, 1, 12), "vec": list(r.normal(size=(12, 6)))})
    unit = np.array(items.vec.tolist())
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    kernel = np.outer(items.quality, items.quality) * (unit @ unit.T)
    chosen = []
    for _ in range(5):
        chosen.append(max((i for i in range(12) if i not in chosen), key=lambda i: np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])])))
    assert preferences.diverse_subset(items, 5).id.tolist() == chosen
    near = pd.DataFrame({"id": ["near-a", "near-b", "diverse"], "quality": [1.0, 0.99, 0.85], "vec": [[1, 0], [0.999, 0.04], [0, 1]]})
    assert preferences.diverse_subset(near, 2).id.tolist() == ["near-a", "diverse"]


def test_images():
    ramp = np.tile(np.arange(256), (256, 1))
    assert images.difference_hash(ramp) == 2**64 - 1 and images.difference_hash(ramp[:, ::-1]) == 0
    assert images.laplacian_variance(np.full((8, 8), 7)) == 0 and images.high_frequency_share(np.full((8, 8), 7)) == 0
    palette = np.array([[0, 0, 0], [255, 255, 255]])
    assert len(images.mixtures(np.zeros((6, 3)))) == 462
    assert images.gamut_fit(np.zeros((4, 4, 3)), palette)["verdict"] == "well-served"
    assert images.gamut_fit(np.full((4, 4, 3), (255, 0, 0)), palette)["verdict"] == "poorly-served"
    grey = np.full((16, 16, 3), 128)
    for method in ("floyd-steinberg", "atkinson", "ordered"):
        assert 0.2 < images.quantise(grey, palette, method).mean() < 0.8
    assert images.structural_similarity(ramp, ramp) == pytest.approx(1)


def test_readers(spark, tmp_path):
    works = tmp_path / "works"
    for wid, body in (("a1", {"work_id": "other", "title": "T", "history": [{"ts": "2024", "actor": "x", "op": "add", "notes": ""}]}), ("b2", None)):
        (works / wid).mkdir(parents=True)
        (works / wid / "meta.json").write_text(json.dumps(body, indent=1) if body else "{broken")
    good, bad = readers.scan_works(spark, str(works))
    assert [(r.wid, r.title) for r in good.select("wid", "title").collect()] == [("a1", "T")] and [r.wid for r in bad.collect()] == ["b2"]
    lines = tmp_path / "events.jsonl"
    lines.write_text('{"work_id": "w", "quality": 3}\n\n{bad\n[1]\n')
    parsed, wrong = readers.scan_events(spark, str(lines))
    assert [r.quality for r in parsed.collect()] == [3.0] and sorted(r.reason for r in wrong.collect()) == ["invalid-json", "non-object-json"]
    metrics = tmp_path / "metrics"
    metrics.mkdir()
    (metrics / "lines.ndjson").write_text('{"a": 1}\nnope\n')
    (metrics / "whole.ndjson").write_text('[{"a":\n 2}, {"a":\n 3}]\n')
    records, errors = readers.scan_ndjson(spark, str(metrics))
    assert sorted(r.v for r in records.select(F.variant_get("record", "$.a", "int").alias("v")).collect()) == [1, 2, 3] and [r.reason for r in errors.collect()] == ["invalid-json"]
    assert readers.scan_csv(spark, str(tmp_path / "missing.csv"), ["a", "b"]).count() == 0
    (tmp_path / "m.csv").write_text("a,b\n1,x\n")
    assert [tuple(r) for r in readers.scan_csv(spark, str(tmp_path / "m.csv"), ["a", "b"]).collect()] == [("1", "x")]
    (tmp_path / "junit.xml").write_text('<testsuite><testcase name="a" classname="c" time="0.5"/><testcase name="b" classname="c" time="1"><failure message="no">x</failure></testcase></testsuite>')
    assert sorted((r.name, r.outcome) for r in readers.read_junit(spark, str(tmp_path / "junit.xml")).collect()) == [("a", "passed"), ("b", "failure")]


def test_json_shapes(spark):
    doc = spark.createDataFrame([(json.dumps({"results": {"bindings": [{"w": {"value": "Q1"}}, {"w": {"value": "Q2"}, "l": {"value": "x"}}]}}),)], "value string")
    assert [tuple(r) for r in readers.sparql_bindings(doc, ["w", "l"]).collect()] == [("Q1", None), ("Q2", "x")]
    claims = {"claims": {"P31": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {"snaktype": "novalue"}}]}}
    entity = spark.createDataFrame([("Q9", json.dumps(claims))], "qid string, value string")
    assert [tuple(r) for r in readers.claim_values(entity, ["P31"]).collect()] == [("Q9", "P31", "Q5", None)]
    catalog = spark.createDataFrame([("p", json.dumps({"data": [{"id": "m1", "created": "1"}]})), ("q", json.dumps({"models": [{"name": "m2"}]})), ("r", json.dumps([{"id": "m3"}]))], "provider string, value string")
    assert {r.model_id for r in readers.model_catalog(catalog).collect()} == {"m1", "m2", "m3"}
    index = spark.createDataFrame([(json.dumps({"w1": {"dhash": "ff", "size": 3}, "w2": {"size": 4}}),)], "value string")
    assert [tuple(r) for r in readers.explode_map_document(index, "struct<dhash:string,size:int>", "dhash").collect()] == [("w1", "ff", 3)]


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double")
    with pytest.raises(Exception, match="non-finite"):
        sinks.append_events(log, str(tmp_path / "log"))
    sinks.append_events(log.where("k = 'a'"), str(tmp_path / "log2"))
    sinks.append_events(log.where("k = 'a'"), str(tmp_path / "log2"))
    assert spark.read.json(str(tmp_path / "log2")).count() == 2
    assert sinks.markdown_table(log.where("k = 'a'"), ["k"]).splitlines()[2] == "| a | 1.0 |"
    feed = spark.createDataFrame([("f", 2, "y"), ("f", 1, "x")], "feed string, idx int, title string")
    assert json.loads(sinks.feed_manifest(feed, "feed", "idx", ["title"]).first().document)["items"] == [{"idx": 1, "title": "x"}, {"idx": 2, "title": "y"}]
    with pytest.raises(ValueError):
        sinks.export_plan(log, ["k"], "jpg")


def test_validation_and_batches(spark):
    record = spark.createDataFrame([('{"step_name": "s", "success": true, "failure_reason": "x", "timestamp": "2024-01-01T00:00:00", "duration_ms": -1}',)], "value string").select(F.parse_json("value").alias("record"))
    assert filters.with_violations(record, filters.metric_rules(F.col("record"), ["step_name", "issue"])).first().violations == ["missing-issue", "success-with-reason", "time-without-zone", "negative-duration"]
    rows = spark.createDataFrame([(1, 2), (1, 4), (1, 2)], "k int, p int")
    assert tuple(aggregates.position_gaps(rows, ["k"], "p").first()) == (1, [1, 3], 1)
    lines = spark.createDataFrame([("d", 1, "Fix the bug"), ("d", 2, "fix THE bug!"), ("d", 3, "other")], "g string, pos int, line string")
    assert [r.duplicate for r in transforms.near_duplicate_lines(lines, "g", "pos", "line", 0.9).orderBy("pos").collect()] == [False, True, False]
    merged = sets.first_of_each(spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, None, "c")], "o int, url string, v string"), F.col("url"), "o")
    assert sorted(r.v for r in merged.collect()) == ["a", "c"]


def test_glob(spark):
    def hit(glob, path):
        return one(spark, F.regexp_like(F.lit(path), filters.glob_to_regex(F.lit(glob))))

    assert hit("src/**", "src/a/b.py") and not hit("src/*", "src/a/b.py") and hit("*.md", "x.md") and not hit("a.b", "axb")


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_running_totals_over_range_partitions(spark, monkeypatch, one_task):
    monkeypatch.setattr(windows, "ONE_TASK_ROWS", one_task)
    rows = spark.createDataFrame([(i % 3, (i * 37) % 101, i) for i in range(300)], "k long, o long, i long").repartition(7)
    got = {r.i: (r.t, r.n) for r in windows.running_totals(rows, ["k"], ["o", "i"], {"t": F.col("o"), "n": F.lit(1)}).collect()}
    for k in range(3):
        held = sorted(((i * 37) % 101, i) for i in range(300) if i % 3 == k)
        assert [got[i] for _, i in held] == [(sum(o for o, _ in held[: n + 1]), n + 1) for n in range(len(held))]
    assert sorted(r.place for r in windows.numbered(rows, ["i"]).collect()) == list(range(1, 301))


def test_exact_quantiles(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 9, 4)] + [("b", 2.0), ("b", None), ("c", None), (None, 3.0)], "k string, v double")
    got = {r.k: (r.n, r.median, r.p90, r.most) for r in aggregates.distribution(rows, ["k"], "v").collect()}
    assert got == {"a": (5, 4.0, pytest.approx(7.4), 9.0), "b": (1, 2.0, 2.0, 2.0), "c": (0, None, None, None), None: (1, 3.0, 3.0, 3.0)}


def test_exact_quantiles_by_brackets(spark, monkeypatch):
    """Brackets that hold a part of the values only, with many ties and a hot key."""
    monkeypatch.setattr(aggregates, "SKETCH", 100)
    r = np.random.default_rng(2)
    frame = pd.DataFrame({"k": ["hot" if i % 3 else f"k{i % 2}" for i in range(30_000)], "v": np.round(r.exponential(50, 30_000), 1)})
    frame.loc[frame.index % 7 == 0, "v"] = 12.5
    got = {x.k: (x.n, x.q1, x.median, x.p99) for x in aggregates.exact_quantiles(spark.createDataFrame(frame).repartition(5), ["k"], "v", {"q1": 0.25, "median": 0.5, "p99": 0.99}).collect()}
    for k, rows in frame.groupby("k"):
        assert got[k] == (len(rows), *[pytest.approx(float(np.quantile(rows.v, q))) for q in (0.25, 0.5, 0.99)])
    alone = aggregates.exact_quantiles(spark.createDataFrame(frame), [], "v", {"m": 0.5}).first()
    assert alone.m == pytest.approx(float(np.median(frame.v)))


def test_similar_token_sets_lose_nothing(spark):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], sorted({f"t{int(x)}" for x in r.zipf(1.4, r.integers(1, 14)) if x < 60})) for i in range(150)]
    rows += [(200 + i, "a", rows[i][2][:-1] or ["x"]) for i in range(40)] + [(300, "a", [])]
    frame = spark.createDataFrame(rows, "i long, block string, t array<string>")
    got = {(x.left_id, x.right_id) for x in joins.similar_token_sets(frame.select(F.col("i").alias("left_id"), "block", F.col("t").alias("lt")), frame.select(F.col("i").alias("right_id"), "block", F.col("t").alias("rt")), "block", 0.85).collect()}
    expected = set()
    for i, b, t in rows:
        for j, c, u in rows:
            if b == c and t and u:
                shared = len(set(t) & set(u))
                sim = shared / len(set(t) | set(u))
                if min(len(t), len(u)) >= 2:
                    sim = max(sim, shared / min(len(t), len(u)))
                if sim >= 0.85:
                    expected.add((i, j))
    assert got == expected


def test_rules_beyond_any_cap(spark):
    """Every rule counts, however many there are."""
    rules = spark.createDataFrame([(f"r{i}", f"job-{i}-", f"f{i}") for i in range(1_100)], "rule string, prefix string, fallback string")
    jobs = spark.createDataFrame([("Job 1099 x",), ("job 3 y",), ("job 3 z",)], "job string")
    got = {r.rule: r.jobs for r in transforms.grouped_jobs(jobs, rules).collect()}
    assert len(got) == 1_100 and got["r1099"] == ["Job 1099 x"] and got["r3"] == ["job 3 y", "job 3 z"] and got["r7"] == ["f7"]
    tags = spark.createDataFrame([(f"t{i}", f"l{i}", [], 0.5) for i in range(10_001)], "tag string, positive string, negatives array<string>, threshold double")
    scores = spark.createDataFrame([(1, f"l{i}", 0.9) for i in range(10_001)], "work_id long, label string, score double")
    assert transforms.policy_tags(scores, tags, 0.1).count() == 10_001
    with pytest.raises(ValueError):
        filters.device_gate(jobs, spark.range(1_001).selectExpr("CAST(id AS string) AS device", "1.0 AS need_w", "1.0 AS need_h"))


def test_two_closures_in_one_session(spark):
    a = joins.reachable_roots(spark.createDataFrame([("x", "root"), ("y", "x"), ("x", "y"), ("z", "z")], "child string, parent string"), ["root"])
    b = joins.reachable_roots(spark.createDataFrame([("q", "root")], "child string, parent string"), ["root"])
    assert {tuple(r) for r in a.collect()} == {("x", "root"), ("y", "root")} and {tuple(r) for r in b.collect()} == {("q", "root")}
    c = joins.family_roots(spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "item long, parent long"))
    d = joins.family_roots(spark.createDataFrame([(i, i + 1) for i in range(20)], "item long, parent long"), 8)
    assert {tuple(r) for r in c.collect()} == {(1, 3, 2), (2, 3, 1), (3, 3, 0), (4, 5, 1), (5, 4, 1)}
    assert {r.item: (r.root, r.depth) for r in d.collect()} == {i: (min(i + 8, 20), min(8, 20 - i)) for i in range(20)}


def test_high_frequencies(spark):
    checks = np.indices((16, 16)).sum(axis=0) % 2 * 255
    ramp = np.tile(np.arange(16) * 16, (16, 1))
    assert images.high_frequency_share(checks) == pytest.approx(1.0) and images.high_frequency_share(ramp) < 0.05


def test_a_cluster_needs_a_shared_folder():
    """Without spark.checkpoint.dir only an application that runs on this machine alone has a scratch folder."""
    from types import SimpleNamespace

    from cataloom.scratch import shared_folder

    def session(master, root=None):
        conf = SimpleNamespace(get=lambda key, default: root or default)
        context = SimpleNamespace(master=master, applicationId="a", getConf=lambda: conf, getCheckpointDir=lambda: "x")
        return SimpleNamespace(sparkContext=context)

    assert shared_folder(session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert shared_folder(session("local[4]")).startswith("/tmp/")
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))
