"""Saved playlist specs compiled to plans: a filter, a sort and a limit over works, with an account of what was dropped.

A work that fails because the filtered field is missing is counted by reason, so that a small result can be read. The
compiled filter is one column of verdicts, computed in one pass: null for a match, a reason, or `filtered`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The moods, as tag and genre rules, and the periods, as inclusive years.
MOODS: dict[str, dict[str, tuple[str, ...]]] = {
    "quiet-interior": {"any": ("setting:interior",), "none": ("filter:violence", "filter:death", "theme:war"), "genres": ("painting/genre-scene", "painting/still-life")},
    "open-air": {"any": ("setting:outdoor", "setting:landscape-natural", "setting:rural"), "none": ("setting:night",)},
    "winter-light": {"any": ("setting:winter",)},
    "nocturne": {"any": ("setting:night", "palette:predominantly-dark")},
    "cool-and-still": {"any": ("palette:cool-toned", "palette:monochrome")},
    "warm-and-bright": {"any": ("palette:warm-toned", "palette:predominantly-light")},
    "festive": {"any": ("theme:celebration", "theme:leisure")},
    "labour": {"any": ("theme:labor", "subject:industrial-machinery", "era-depicted:industrial-era")},
    "sea-and-ships": {"any": ("subject:ship", "setting:water"), "genres": ("painting/seascape",)},
    "faces": {"any": ("subject:single-figure",), "genres": ("painting/portrait",)},
}
PERIODS: dict[str, tuple[int, int]] = {
    "medieval": (500, 1400),
    "renaissance": (1400, 1600),
    "golden-age": (1600, 1700),
    "18th-century": (1700, 1800),
    "19th-century": (1800, 1900),
    "modern": (1900, 2100),
}
SORTS = ("fit", "quality", "year", "artist", "title", "random", "as-filtered")


@dataclass(frozen=True)
class PlaylistSpec:
    artists: Sequence[str] = ()
    genres: Sequence[str] = ()
    moods: Sequence[str] = ()
    periods: Sequence[str] = ()
    any_tags: Sequence[str] = ()
    all_tags: Sequence[str] = ()
    not_tags: Sequence[str] = ()
    exclude_filters: Sequence[str] = ()
    year_from: int | None = None
    year_to: int | None = None
    min_fit: int | None = None
    min_quality: int | None = None
    limit: int | None = None
    seed: int = 0
    require_dossier: bool = False
    sort: str = "as-filtered"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mood_holds(mood: str, tags: Column, genre: Column) -> Column:
    """No excluded tag, and one of the positive clauses."""
    if mood not in MOODS:
        raise KeyError(f"unknown mood {mood!r}")
    rule = MOODS[mood]
    hit = F.lit(False)
    if "any" in rule:
        hit = hit | F.arrays_overlap(tags, _strings(rule["any"]))
    if "genres" in rule:
        hit = hit | F.coalesce(genre.isin(*rule["genres"]), F.lit(False))
    return hit & ~F.arrays_overlap(tags, _strings(rule["none"])) if "none" in rule else hit


def verdict(spec: PlaylistSpec) -> Column:
    """Null for a match; the reason for a missing field; `filtered` otherwise. The first test that fails counts."""
    tests: list[tuple[Column, str]] = []

    def demand(condition: Column) -> None:
        tests.append((~condition, "filtered"))

    tags = F.col("tags")
    artists = [a.strip().lower() for a in spec.artists if a.strip()]
    if artists:
        tests.append((F.coalesce(F.col("artist"), F.lit("")) == "", "no artist"))
        demand(F.lower("artist").isin(*artists))
    if spec.genres:
        tests.append((F.col("genre").isNull(), "no genre"))
        demand(F.col("genre").isin(*spec.genres))
    if spec.periods or spec.year_from or spec.year_to:
        tests.append((F.col("year").isNull(), "no year"))
        if spec.periods:
            inside = F.lit(False)
            for period in spec.periods:
                inside = inside | F.col("year").between(*PERIODS[period])
            demand(inside)
        if spec.year_from is not None:
            demand(F.col("year") >= spec.year_from)
        if spec.year_to is not None:
            demand(F.col("year") <= spec.year_to)
    if spec.any_tags:
        demand(F.arrays_overlap(tags, _strings(spec.any_tags)))
    if spec.all_tags:
        demand(F.size(F.array_except(_strings(spec.all_tags), tags)) == 0)
    if spec.not_tags:
        demand(~F.arrays_overlap(tags, _strings(spec.not_tags)))
    if spec.exclude_filters:
        demand(~F.arrays_overlap(tags, _strings([x if x.startswith("filter:") else f"filter:{x}" for x in spec.exclude_filters])))
    if spec.moods:
        any_mood = F.lit(False)
        for mood in spec.moods:
            any_mood = any_mood | mood_holds(mood, tags, F.col("genre"))
        demand(any_mood)
    for axis, least in (("fit", spec.min_fit), ("quality", spec.min_quality)):
        if least is not None:
            tests.append((F.col(axis).isNull(), f"unrated ({axis})"))
            demand(F.col(axis) >= least)
    if spec.require_dossier:
        demand(F.col("has_dossier"))
    out = F.lit(None).cast("string")
    for failed, reason in reversed(tests):
        out = F.when(failed, F.lit(reason)).otherwise(out)
    return out


def ordering(spec: PlaylistSpec) -> list[Column]:
    if spec.sort not in SORTS:
        raise ValueError(f"unknown sort {spec.sort!r}")
    keys = {
        "fit": [F.coalesce("fit", F.lit(-1)).desc(), F.col("title")],
        "quality": [F.coalesce("quality", F.lit(-1)).desc(), F.col("title")],
        "year": [F.coalesce("year", F.lit(9999)), F.col("title")],
        "artist": [F.lower(F.coalesce("artist", F.lit(""))), F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999))],
        "title": [F.lower("title")],
        "random": [F.xxhash64(F.lit(spec.seed), "work_id")],
        "as-filtered": [],
    }
    return [*keys[spec.sort], F.col("work_id")]


def judged(works: DataFrame, spec: PlaylistSpec, ratings: DataFrame | None = None, dossiers: DataFrame | None = None) -> DataFrame:
    """works with fit, quality and has_dossier, and the verdict. ratings: (work_id, fit, quality); dossiers: (work_id)."""
    if ratings is not None:
        works = works.join(ratings.select("work_id", "fit", "quality"), "work_id", "left")
    else:
        works = works.withColumns({"fit": F.lit(None).cast("int"), "quality": F.lit(None).cast("int")})
    if dossiers is not None:
        works = works.join(dossiers.select("work_id", F.lit(True).alias("has_dossier")).distinct(), "work_id", "left").fillna(False, ["has_dossier"])
    else:
        works = works.withColumn("has_dossier", F.lit(False))
    return works.withColumn("verdict", verdict(spec))


def select_playlist(works: DataFrame, spec: PlaylistSpec, ratings: DataFrame | None = None, dossiers: DataFrame | None = None) -> DataFrame:
    """The works that match, in order, up to the limit (0 and None: all)."""
    rows = judged(works, spec, ratings, dossiers).where("verdict IS NULL").select("work_id", "artist", "genre", "year", "title", "fit", "quality", "tags")
    rows = rows.orderBy(*ordering(spec))
    return rows.limit(spec.limit) if spec.limit else rows


def drop_reasons(works: DataFrame, spec: PlaylistSpec, ratings: DataFrame | None = None, dossiers: DataFrame | None = None) -> DataFrame:
    """reason, n: `matched`, `filtered` and one row for each missing field."""
    reason = F.coalesce("verdict", F.lit("matched")).alias("reason")
    return judged(works, spec, ratings, dossiers).groupBy(reason).agg(F.count("*").alias("n"))


def mood_facets(works: DataFrame) -> DataFrame:
    """mood, n over works; a work counts in every mood that it has."""
    held = F.filter(F.array(*[F.when(mood_holds(m, F.col("tags"), F.col("genre")), F.lit(m)) for m in MOODS]), lambda m: m.isNotNull())
    return works.select(F.explode(held).alias("mood")).groupBy("mood").agg(F.count("*").alias("n"))


def facet_counts(works: DataFrame) -> DataFrame:
    """family, value, n, with a null value for the family's total: artist, genre and the tag families."""
    pairs = F.concat(
        F.transform("tags", lambda t: F.struct(F.substring_index(t, ":", 1).alias("family"), F.substring(t, F.locate(":", t) + 1, F.length(t)).alias("value"))),
        F.filter(F.array(F.struct(F.lit("genre").alias("family"), F.col("genre").alias("value")), F.struct(F.lit("artist").alias("family"), F.col("artist").alias("value"))), lambda p: p["value"].isNotNull()),
    )
    flat = works.select(F.explode(pairs).alias("p")).select("p.family", "p.value")
    return flat.rollup("family", "value").agg(F.count("*").alias("n")).where("family IS NOT NULL")
