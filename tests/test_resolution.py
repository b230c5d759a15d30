"""Matches within a creator's oeuvre and the chain of strategies, against loops; and that their work doesn't multiply."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from cataloom import registry
from cataloom.operators import resolution

WORK = "work_id long, title string, year int, creator string, holder string, medium string, height double, width double"
ENTITY = "qid long, creator string, label string, inception int, collection string, kind string, tall double, wide double"


def similarity(a: str | None, b: str | None) -> float:
    x, y = (set((t or "").lower().split()) for t in (a, b))
    if not x or not y:
        return 0.0
    shared, least = len(x & y), min(len(x), len(y))
    return max(shared / len(x | y), shared / least if least >= 2 else 0.0)


def fits(work: tuple, entity: tuple) -> bool:
    sizes = (*work[6:8], *entity[6:8])
    if None in sizes:
        return False
    pairs = zip(sorted(sizes[:2]), sorted(sizes[2:]), strict=True)
    return all(abs(a - b) / max(a, b) <= resolution.TOLERANCE for a, b in pairs)


def by_creator(works: list[tuple], oeuvre: list[tuple]) -> dict[int, tuple[int | None, str]]:
    """The plain definition: each tie-break in turn keeps the candidates that pass it, unless none does or one is left."""
    out = {}
    for w in works:
        scores = [(similarity(w[1], e[2]), e) for e in oeuvre if w[3] is not None and e[1] == w[3]]
        best = max((s for s, _ in scores if s >= resolution.LEAST_TITLE), default=math.inf)
        left = [e for s, e in scores if s >= resolution.LEAST_TITLE and s >= best - resolution.MARGIN]

        def sane(e: tuple, w: tuple = w) -> bool:
            return w[2] is None or e[3] is None or abs(w[2] - e[3]) <= resolution.YEARS

        for passes in (lambda e: None not in (w[4], e[4]) and w[4] == e[4], sane, lambda e: None not in (w[5], e[5]) and w[5] == e[5], lambda e: fits(w, e)):
            if len(left) > 1 and any(map(passes, left)):
                left = [e for e in left if passes(e)]
        if not left:
            reason = "no-creator" if w[3] is None else "below-threshold" if scores else "no-works"
        else:
            reason = "ambiguous" if len(left) > 1 else "match" if sane(left[0]) else "year-mismatch"
        out[w[0]] = (left[0][0] if reason == "match" else None, reason)
    return out


def made(n: int, m: int) -> tuple[list[tuple], list[tuple]]:
    """Titles of 0 to 22 words of few, so that many contain each other or lack a word or two; nulls in each field."""
    draw = random.Random(8)

    def maybe(*values):
        return draw.choice([None, *values])

    words = [f"w{'abcdefgh'[k % 8] * (k // 8 + 1)}" for k in range(40)]

    def title():
        return draw.choice([None, "", "w", *[" ".join(draw.sample(words[:6], k)) for k in (1, 2, 2, 3)], " ".join(words[: draw.randint(9, 22)]), " ".join(draw.sample(words[:22], 20))])

    oeuvre = [(k, maybe("a", "b", "b", "c"), title(), maybe(1900, 1901, 1905), maybe("x", "y"), maybe("oil", "ink"), maybe(10.0, 10.2, 20.0), maybe(10.0, 30.0)) for k in range(m)]
    works = [(k, title(), maybe(1899, 1902, 1903, 1907), maybe("a", "b", "b", "c", "d"), maybe("x", "y", "z"), maybe("oil", "ink"), maybe(10.0, 30.0), maybe(10.3, 20.5)) for k in range(n)]
    return works, oeuvre


def test_creator_matches_are_those_of_the_loop(spark):
    works, oeuvre = made(600, 150)
    out = resolution.match_by_creator(spark.createDataFrame(works, WORK), spark.createDataFrame(oeuvre, ENTITY)).collect()
    expected = by_creator(works, oeuvre)
    assert {r.work_id: (r.qid, r.reason) for r in out} == expected and len(out) == len(works)
    assert {reason for _, reason in expected.values()} == {"match", "ambiguous", "year-mismatch", "below-threshold", "no-works", "no-creator"}


def test_titles_of_a_creator_meet_on_tokens_and_are_folded_once(spark, tmp_path):
    """Titles don't all meet all labels of the creator, and a filter on the outcome doesn't unfold the tie-breaks (the plan had over 170,000 characters)."""
    parts = [(k, f"{'red' if k % 2 else 'blue'} cup n{k // 4}", "b", "t", k % 9 + 1) for k in range(200)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1)
    frame.write.parquet(f"{tmp_path}/part.parquet")
    frame.selectExpr("p_partkey AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    out = registry.queries()["holder_matches"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Join Inner" in line and "token" in line]
    assert pairs and len(plan) < 40_000


def test_a_chain_runs_no_strategy_again_for_its_hits(spark):
    """Each strategy judges what is left; one has no outcome for some works. The plan had the first of three strategies eleven times."""
    rows = [(k, k % 7, [None, 1, 2, 3][k % 4]) for k in range(120)]
    works = spark.createDataFrame(rows, "work_id long, a int, retired_at int")

    def strategy(name, condition):
        return lambda rest: rest.where("a <> 6").select("work_id", F.when(condition, F.col("work_id") + 1000).alias("qid"), F.concat(F.lit(f"mark-{name}"), F.when(condition, "").otherwise("-no")).alias("reason"))

    chain = {"one": strategy("one", F.col("a") < 2), "two": strategy("two", F.col("a") < 4), "three": strategy("three", F.col("a") == 4)}
    out = resolution.resolve(works, chain, 2)
    expected = {}
    for k, a, retired in rows:
        if (-1 if retired is None else retired) >= 2:
            continue
        tried, method = [], None
        for name, hit in (("one", a < 2), ("two", a < 4), ("three", a == 4)):
            if method is None:
                tried.append(f"{name}:" + ("skipped" if a == 6 else f"mark-{name}" + ("" if hit else "-no")))
                method = name if hit else None
        expected[k] = (None if method is None else k + 1000, method, tried, 2 if method is None else None)
    assert {r.work_id: (r.qid, r.method, r.tried, r.retired_at) for r in out.collect()} == expected and out.count() == len(expected)
    assert out.columns == ["work_id", "qid", "method", "tried", "retired_at"]
    runs = out.select("*", F.lit("x").alias("y"))._jdf.queryExecution().analyzed().toString()
    assert [runs.count(f"(mark-{name}, ") for name in chain] == [4, 2, 1]


def test_title_matches_of_copies_and_odd_titles(spark):
    """Works and entities of many copies, without a title or identifier, and titles that fold alike."""
    entities = [(k, label, year) for k, (label, year) in enumerate([("Red cup", 1900), ("the red cup 1888", 1900), ("Jar", 1950), ("Jar", None), ("Lone", 1900), ("A plate", None), ("", 1900), (None, 1900), ("!", 1900)])] + [(None, "Lid", 1900), (4, "lone", 1920)]
    titles = ["RED CUP", "jar", "The lone", "plate", "", None, "lid", "no such", "lone 1999"]
    rows = [(i * 10 + j, t, y) for i, t in enumerate(titles) for j, y in enumerate([None, 1901, 1960])]
    fold = {"RED CUP": "red cup", "The lone": "lone", "lone 1999": "lone", None: ""}
    known = {"red cup": ({0, 1}, 1900), "jar": ({2, 3}, 1950), "lone": ({4}, 1900), "plate": ({5}, None), "lid": (set(), 1900)}

    def outcome(title, year):
        ids, inception = known.get(fold.get(title, title), (None, None))
        if ids is None:
            return None, "no-hit"
        if len(ids) > 1:
            return None, "ambiguous"
        if year is not None and inception is not None and abs(year - inception) > resolution.YEARS:
            return None, "year-mismatch"
        return (min(ids) if ids else None), "match"

    out = resolution.match_by_title(spark.createDataFrame(rows, "work_id long, title string, year int"), spark.createDataFrame(entities, "qid long, label string, inception int"))
    assert {r.work_id: (r.qid, r.reason) for r in out.collect()} == {k: outcome(t, y) for k, t, y in rows}
    assert "Aggregate [label" in out._jdf.queryExecution().optimizedPlan().toString()
