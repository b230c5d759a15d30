"""Preference models: Rocchio vectors, Bradley-Terry strengths, quality-diverse selection, display ranking."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.operators.aggregates import exact_quantiles
from cataloom.scratch import written

# Centroid weights, prior games, fit limits, display weights.
BETA, GAMMA = 1.0, 0.5
PRIOR_STRENGTH, MAX_ITERATIONS, TOLERANCE = 0.5, 500, 1e-9
SITELINKS_FULL_AT = 30.0
DISPLAY_WEIGHTS = {"sitelinks": 0.45, "image": 0.25, "collection": 0.15, "corroboration": 0.15}
STUDY_WORDS = r"(?i)\b(stud(?:y|ies)|sketch|drawing|fragment|preparatory|cartoon|recto|verso)\b"
STUDY_DEMOTION = 0.4
#: Items of a group that are chosen from in one task; pairs of a component that are fitted in one. Larger ones are handled by joins, by the same rule.
FIT_ITEMS, FIT_PAIRS = 20_000, 1_000_000


def rocchio_weights(features: DataFrame, scores: DataFrame) -> DataFrame:
    """feature, idf, weight over features (work_id, feature) and scores (work_id, score); ties at the median teach nothing."""
    rated = scores.where("score IS NOT NULL")
    split = exact_quantiles(rated, [], "score", {"split": 0.5}).select("split")
    cls = rated.join(F.broadcast(split)).select("work_id", F.signum(F.col("score") - F.col("split")).alias("cls"))
    sizes = cls.agg(F.count("*").alias("n"), F.count_if(F.col("cls") > 0).alias("n_pos"), F.count_if(F.col("cls") < 0).alias("n_neg"))
    per_feature = features.distinct().join(cls, "work_id").groupBy("feature").agg(F.count("*").alias("df"), F.count_if(F.col("cls") > 0).alias("pos"), F.count_if(F.col("cls") < 0).alias("neg"))
    joined = per_feature.join(F.broadcast(sizes))
    idf = F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1.0
    pos, neg = (F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(n)), F.lit(0.0)) for c, n in (("pos", "n_pos"), ("neg", "n_neg")))
    weight = BETA * pos * idf - GAMMA * neg * idf
    return joined.select("feature", idf.alias("idf"), weight.alias("weight")).where(F.abs("weight") > 1e-12)


def rocchio_scores(features: DataFrame, weights: DataFrame) -> DataFrame:
    """work_id, score: summed weights over the root of the number of features."""
    joined = features.distinct().join(weights.select("feature", "weight"), "feature", "left")
    return joined.groupBy("work_id").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("score"))


def pair_counts(comparisons: DataFrame) -> DataFrame:
    """a, b, n, wins_a, wins_b with the symmetric prior, over comparisons (winner, loser); comparisons with oneself don't count."""
    a, b = F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")
    games = comparisons.where("winner <> loser").select(a, b, (F.col("winner") < F.col("loser")).alias("first"))
    won = games.groupBy("a", "b").agg(F.count("*").alias("games"), F.count_if("first").alias("won"))
    return won.select("a", "b", (F.col("games") + 2 * PRIOR_STRENGTH).alias("n"), (F.col("won") + PRIOR_STRENGTH).alias("wins_a"), (F.col("games") - F.col("won") + PRIOR_STRENGTH).alias("wins_b"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) over undirected edges (a, b). Labels spread to neighbours and take shortcuts, until none falls."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = written(labels, "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("before"))
        onward = lower.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        labels = written(lower.join(onward, "component", "left").select("node", F.coalesce("onward", "component").alias("component"), "before"), "labels", replaces=labels)
        if labels.where("component <> before").isEmpty():
            return labels.select("node", "component")


def _fit_component(rows: pd.DataFrame) -> pd.DataFrame:
    """Minorisation-maximisation over the pairs of one component."""
    items = np.unique(np.concatenate([rows["a"], rows["b"]]))
    a, b = np.searchsorted(items, rows["a"]), np.searchsorted(items, rows["b"])
    n = rows["n"].to_numpy()
    wins = np.bincount(a, rows["wins_a"], len(items)) + np.bincount(b, rows["wins_b"], len(items))
    strength = np.ones(len(items))
    steps, converged = 0, False
    while steps < MAX_ITERATIONS and not converged:
        steps += 1
        share = n / (strength[a] + strength[b])
        new = wins / (np.bincount(a, share, len(items)) + np.bincount(b, share, len(items)))
        new *= len(items) / new.sum()
        converged = bool(np.abs(new - strength).max() < TOLERANCE)
        strength = new
    return pd.DataFrame({"item": items, "component": rows["component"].iloc[0], "strength": strength, "iterations": steps, "converged": converged})


def bradley_terry(comparisons: DataFrame, fit_pairs: int = FIT_PAIRS) -> DataFrame:
    """item, component, strength, iterations, converged; strengths average 1 within a component.

    Each component is fitted by one task if no component has more pairs than that; else the same steps run as joins. Both
    stop at TOLERANCE, so their strengths agree to that.
    """
    pairs = pair_counts(comparisons)
    labels = components(pairs.select("a", "b"))
    held = pairs.join(labels.withColumnRenamed("node", "a"), "a")
    largest = held.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is not None and largest > fit_pairs:
        return _fit_by_joins(pairs, labels)
    return held.groupBy("component").applyInPandas(_fit_component, "item long, component long, strength double, iterations int, converged boolean")


def _fit_by_joins(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same update as joins and sums, a written table a step, for components that one task can't hold."""
    pairs = written(pairs, "pairs")
    sides = pairs.select("a", "b", "n", F.col("wins_a").alias("wins")).union(pairs.select("b", "a", "n", "wins_b"))
    wins = written(sides.groupBy(F.col("a").alias("item")).agg(F.sum("wins").alias("wins")).join(labels.withColumnRenamed("node", "item"), "item"), "wins")
    sizes = wins.groupBy("component").agg(F.count("*").alias("n_items"))
    current = wins.select("item", "component", F.lit(1.0).alias("strength"))
    for step in range(1, MAX_ITERATIONS + 1):
        p, q = current.select(F.col("item").alias("a"), F.col("strength").alias("pa")), current.select(F.col("item").alias("b"), F.col("strength").alias("pb"))
        denominators = sides.join(p, "a").join(q, "b").groupBy(F.col("a").alias("item")).agg(F.sum(F.col("n") / (F.col("pa") + F.col("pb"))).alias("d"))
        raw = wins.join(denominators, "item").select("item", "component", (F.col("wins") / F.col("d")).alias("raw"))
        scale = raw.groupBy("component").agg(F.sum("raw").alias("total")).join(sizes, "component")
        new = raw.join(scale, "component").join(current.select("item", F.col("strength").alias("before")), "item")
        current = written(new.select("item", "component", (F.col("raw") * F.col("n_items") / F.col("total")).alias("strength"), "before"), "strengths", replaces=current)
        moved = current.agg(F.max(F.abs(F.col("strength") - F.col("before")))).first()[0]
        if moved is None or moved < TOLERANCE:
            break
    return current.select("item", "component", "strength", F.lit(step).alias("iterations"), F.lit(moved is None or moved < TOLERANCE).alias("converged"))


def closest_unasked(strengths: DataFrame, comparisons: DataFrame, k: int = 1) -> DataFrame:
    """The k unasked pairs of a component with the least gap in strength.

    Pairs are taken from neighbours in the order of strength, at growing distance. They suffice when the k-th gap found
    is no greater than the least gap of the next distance, because gaps grow with distance.
    """
    asked = comparisons.select(F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).distinct()
    order = Window.partitionBy("component").orderBy("strength", "item")
    distance = 1
    while True:
        steps = range(1, distance + 1)
        ahead = F.array(*[F.struct(F.lead("item", d).over(order).alias("item"), F.lead("strength", d).over(order).alias("strength")) for d in steps])
        near = strengths.select("item", "strength", ahead.alias("ahead")).select("item", "strength", F.explode("ahead").alias("o")).where("o.item IS NOT NULL")
        pairs = near.select(F.least("item", "o.item").alias("a"), F.greatest("item", "o.item").alias("b"), F.abs(F.col("strength") - F.col("o.strength")).alias("gap"))
        found = written(pairs.join(asked, ["a", "b"], "left_anti").orderBy("gap", "a", "b").limit(k), "pairs")
        n, worst = found.agg(F.count("*"), F.max("gap")).first()
        beyond = strengths.select((F.lead("strength", distance + 1).over(order) - F.col("strength")).alias("gap")).agg(F.min("gap")).first()[0]
        if beyond is None or n == k and worst <= beyond:
            return found
        distance *= 2


def tie_break(work_id: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{work_id}".encode()).digest()[:8], "big")


def diverse_subset(items: pd.DataFrame, k: int, seed: int = 0) -> pd.DataFrame:
    """Greedy selection by the determinant of quality times similarity; items: id, quality, vec.

    The determinant grows by the squared rest of a candidate against the chosen ones, which one Cholesky row a step
    gives. Ties prefer quality, then a seeded digest.
    """
    ids, quality = items["id"].tolist(), items["quality"].to_numpy(dtype=float)
    vectors = np.array(items["vec"].tolist(), dtype=float)
    norms = np.linalg.norm(vectors, axis=1)
    usable = np.isfinite(quality) & (quality >= 0) & np.isfinite(vectors).all(axis=1) & (norms > 0)
    if not usable.all():
        raise ValueError("quality must be finite and not negative, embeddings finite and not zero")
    unit = vectors / norms[:, None]
    ties = [tie_break(str(i), seed) for i in ids]
    rest = quality**2
    rows = np.zeros((0, len(ids)))
    chosen: list[int] = []
    determinant, out = 1.0, []
    for _ in range(min(k, len(ids))):
        gains = [(0.0 if abs(determinant * max(rest[i], 0.0)) < 1e-12 else determinant * rest[i], quality[i], -ties[i], i) for i in range(len(ids)) if i not in chosen]
        gain, _, _, pick = max(gains)
        nearest = max((float(unit[pick] @ unit[j]) for j in chosen), default=None)
        out.append((ids[pick], len(chosen) + 1, quality[pick] ** 2, nearest, gain))
        pivot = np.sqrt(max(rest[pick], 1e-300))
        row = (quality[pick] * quality * (unit @ unit[pick]) - rows.T @ rows[:, pick]) / pivot
        rows, rest, determinant = np.vstack([rows, row]), rest - row**2, gain
        chosen.append(pick)
    return pd.DataFrame(out, columns=["id", "place", "quality_part", "nearest", "determinant"])


def select_diverse(items: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """k items of each group (id, quality, vec); a group is an exhibition's candidate list. A group, whose size is checked, is chosen from by one task."""
    largest = items.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is not None and largest > FIT_ITEMS:
        return _select_by_rounds(items, group, k, seed)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        return diverse_subset(rows, k, seed).assign(**{group: rows[group].iloc[0]})

    kind = dict(items.dtypes)
    return items.groupBy(group).applyInPandas(pick, f"id {kind['id']}, place int, quality_part double, nearest double, determinant double, {group} {kind[group]}")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _select_by_rounds(items: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """The same greedy steps with an aggregate a round, for groups too large for one task."""
    quality, vec = F.col("quality").cast("double"), F.col("vec").cast("array<double>")
    norm = F.sqrt(_dot(vec, vec))
    usable = quality.isNotNull() & ~F.isnan(quality) & (quality >= 0) & (quality < float("inf")) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    if items.where(~F.coalesce(usable, F.lit(False))).limit(1).count():
        raise ValueError("quality must be finite and not negative, embeddings finite and not zero")
    tie = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    none = F.array().cast("array<double>")
    unit = F.transform(vec, lambda x: x / norm)
    start = items.select(F.col(group).alias("g"), "id", quality.alias("quality"), unit.alias("unit"), F.substring(tie, 1, 16).alias("tie"), (quality * quality).alias("rest"), none.alias("row"))
    state = written(start.withColumn("at", F.monotonically_increasing_id()), "diverse")
    chosen = state.select("g").distinct().select("g", F.lit(1.0).alias("determinant"), F.array().cast("array<array<double>>").alias("units"))
    places = []
    for place in range(1, k + 1):
        c = chosen.select(F.col("g").alias("cg"), "determinant", "units")
        met = state.join(c, F.col("g").eqNullSafe(F.col("cg")))
        gain = F.when(F.abs(F.col("determinant") * F.greatest("rest", F.lit(0.0))) < 1e-12, 0.0).otherwise(F.col("determinant") * F.col("rest"))
        ranked = met.withColumn("gain", gain)
        best = F.min_by(F.struct("at", "id", "quality", "unit", "rest", "row", "gain", "units"), F.struct(-F.col("gain"), -F.col("quality"), "tie", -F.col("at")))
        picked = written(ranked.groupBy("g").agg(best.alias("p")), "picked")
        nearest = F.array_max(F.transform("p.units", lambda u: _dot(F.col("p.unit"), u)))
        places.append(picked.select("p.id", F.lit(place).alias("place"), (F.col("p.quality") * F.col("p.quality")).alias("quality_part"), nearest.alias("nearest"), F.col("p.gain").alias("determinant"), F.col("g").alias(group)))
        chosen = picked.select("g", F.col("p.gain").alias("determinant"), F.concat("p.units", F.array("p.unit")).alias("units"))
        if place < k:
            with_pick = state.join(picked.select(F.col("g").alias("pg"), "p"), F.col("g").eqNullSafe(F.col("pg"))).where("at <> p.at")
            step = (F.col("p.quality") * F.col("quality") * _dot(F.col("unit"), F.col("p.unit")) - _dot(F.col("row"), F.col("p.row"))) / F.sqrt(F.greatest("p.rest", F.lit(1e-300)))
            state = written(with_pick.withColumn("step", step).select("g", "id", "quality", "unit", "tie", (F.col("rest") - F.col("step") * F.col("step")).alias("rest"), F.concat("row", F.array("step")).alias("row"), "at"), "diverse")
    out = places[0]
    for held in places[1:]:
        out = out.unionByName(held)
    return out


def display_score(title: Column, image: Column, holder: Column, n_sources: Column, sitelinks: Column) -> Column:
    """0 to 1: demand, picture, collection and corroboration; studies are demoted."""
    demand = F.least(F.coalesce(sitelinks, F.lit(0)) / SITELINKS_FULL_AT, F.lit(1.0))
    corroboration = F.least(F.greatest(n_sources - 1, F.lit(0)) / 2.0, F.lit(1.0))
    has_image = F.when(F.coalesce(image, F.lit("")) != "", 1.0).otherwise(0.0)
    has_holder = F.when(F.coalesce(holder, F.lit("")) != "", 1.0).otherwise(0.0)
    w = DISPLAY_WEIGHTS
    score = w["sitelinks"] * demand + w["image"] * has_image + w["collection"] * has_holder + w["corroboration"] * corroboration
    return score * F.when(F.coalesce(title, F.lit("")).rlike(STUDY_WORDS), STUDY_DEMOTION).otherwise(1.0)
