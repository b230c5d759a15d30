"""Parsers of file-name stems, as column expressions: the positional convention, and fragments by their strongest signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of years, dimensions, series and names, and material phrases in the order in which they are tried.
YEAR, DECADE = r"\b(1[0-9]{3}|2[0-9]{3})\b", r"\b([12][0-9]{3})s\b"
YEAR_RANGE, CIRCA = r"\b\d{4}\s*[-–—]\s*\d{2,4}\b", r"(?i)\bc\.?\s*\d{4}\b"
DIMENSION_WORD = r"(?i)\b(cm|mm|in|inches|×|x)\b"
DIMENSIONS = r"(?i)\b\d+(?:\.\d+)?\s*(?:cm|in|inches|mm)?\s*[×x]\s*\d+(?:\.\d+)?\s*(cm|in|inches|mm)\b"
BARE_DIMENSIONS = r"\b\d+(?:\.\d+)?\s*[×x]\s*\d+(?:\.\d+)?\b"
SERIES = r"(?i)\b(from the series|series|set|suite)\b"
NAME = r"^(?:[A-ZÄÖÜÉÈÊÀÁÂÇÑ][A-Za-zäöüéèêàáâçñ.\-'’]*\s+|(?:van|der|den|de|du|di|von|le|la|l['’]|d['’]|of)\s+){1,5}[A-ZÄÖÜÉÈÊÀÁÂÇÑ][A-Za-zäöüéèêàáâçñ.\-'’]*$"
MEDIUM_PHRASES = (
    "oil on canvas", "oil on panel", "oil on wood", "oil on cardboard", "oil on paper", "oil and tempera", "tempera on panel", "watercolor", "watercolour",
    "gouache", "pastel", "color woodblock print", "woodblock print", "etching", "lithograph", "engraving", "drypoint", "aquatint", "tempera", "fresco",
    "ink", "charcoal", "chalk", "graphite", "acrylic", "mixed media", "dispersion on fabric", "oil paint", "oil",
)


def _parts(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda p: F.trim(p)), lambda p: p != "")


def span_of_years(text: Column) -> Column:
    """(year_min, year_max): a decade alone, else a range whose end may be short and then follows the start, else all years."""
    decade = F.regexp_extract(text, DECADE, 1).try_cast("int")
    start, end = (F.regexp_extract(text, r"(\d{4})\s*[-–—]\s*(\d{2,4})\b", g).try_cast("int") for g in (1, 2))
    carried = F.floor(start / 100).cast("int") * 100 + end
    until = F.when(end >= 1000, end).when(carried < start, carried + 100).otherwise(carried)
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    alone = decade.isNotNull() & ~text.rlike(YEAR)
    low = F.when(alone, decade).when(start.isNotNull(), start).otherwise(F.array_min(years))
    high = F.when(alone, decade + 9).when(start.isNotNull(), until).otherwise(F.array_max(years))
    return F.struct(low.alias("year_min"), high.alias("year_max"))


def positional_stem(stem: Column) -> Column:
    """number, title, artist, year, year_min, year_max, medium, dimensions and strategy of "12. Title; Artist; Year; Medium; Size".

    Three parts by semicolons, or else by commas, are needed; what has fewer is a title. If the second part is a year,
    the first one is cut at its last comma into title and artist.
    """
    stem = F.coalesce(stem, F.lit(""))
    number = F.regexp_extract(stem, r"^(\d+)\.\s+(.*)$", 1)
    rest = F.when(number != "", F.regexp_extract(stem, r"^(\d+)\.\s+(.*)$", 2)).otherwise(stem)
    semicolons, commas = _parts(rest, ";"), _parts(rest, ",")
    strategy = F.when(F.size(semicolons) >= 3, "semicolon").when(F.size(commas) >= 3, "comma").otherwise("single")
    parts = F.when(strategy == "semicolon", semicolons).when(strategy == "comma", commas).otherwise(F.array(F.trim(rest)))
    first, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    more = F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))
    before, behind = (F.trim(F.regexp_extract(first, r"^(.*),([^,]*)$", g)) for g in (1, 2))
    dated = second.rlike(rf"^(?:{YEAR}|{DECADE}|{YEAR_RANGE})$")
    moved = dated & (before != "") & (behind != "")
    is_year = F.transform(more, lambda p: p.rlike(YEAR) | p.rlike(DECADE))
    at = F.when(moved, 0).otherwise(F.array_position(is_year, F.lit(True)))
    year = F.when(moved, second).when(at > 0, F.get(more, (at - 1).cast("int"))).otherwise("")
    left = F.filter(more, lambda p, i: i + 1 != at)
    sized = F.when(at > 0, F.filter(left, lambda p: p.rlike(DIMENSION_WORD))).otherwise(F.array().cast("array<string>"))
    plain = F.when(at > 0, F.filter(left, lambda p: ~p.rlike(DIMENSION_WORD))).otherwise(left)
    years = span_of_years(year)
    return F.struct(
        number.alias("number"),
        F.when(moved, before).otherwise(first).alias("title"),
        F.when(moved, behind).otherwise(second).alias("artist"),
        year.alias("year"),
        years["year_min"].alias("year_min"),
        years["year_max"].alias("year_max"),
        F.array_join(plain, "; ").alias("medium"),
        F.array_join(sized, "; ").alias("dimensions"),
        strategy.alias("strategy"),
    )


def fragment_class(fragment: Column, known: Column | None = None) -> Column:
    """(type, confidence) of a fragment by its strongest signal; of equal ones dimensions, year, medium, series, name, in this order.

    known: full or surname where a corpus of artists holds the fragment.
    """
    known = F.lit(None).cast("string") if known is None else known
    low = F.lower(F.trim(fragment))
    sized = F.when(fragment.rlike(DIMENSIONS), 0.95).when(fragment.rlike(BARE_DIMENSIONS), 0.70)
    lone = F.when((F.length(fragment) <= 30) & ~fragment.rlike(BARE_DIMENSIONS), 0.80).otherwise(0.60)
    dated = F.when(fragment.rlike(YEAR_RANGE), 0.95).when(fragment.rlike(DECADE) & ~fragment.rlike(YEAR), 0.90).when(fragment.rlike(CIRCA), 0.85).when(fragment.rlike(YEAR), lone)
    phrase = F.get(F.filter(F.array(*[F.lit(p) for p in MEDIUM_PHRASES]), lambda p: low.contains(p)), F.lit(0))
    medium = F.when(phrase.isNotNull(), F.when(F.length(phrase) / F.greatest(F.length(low), F.lit(1)) >= 0.70, 0.95).otherwise(0.85))
    words = F.filter(F.split(fragment, r"\s+"), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    may = (F.length(fragment) <= 60) & ~fragment.rlike(r"\p{Nd}") & (F.size(words) <= 6) & fragment.rlike(r"^\p{Lu}")

    def graded(full: float, surname: float, none: float) -> Column:
        return F.when(known == "full", full).when(known == "surname", surname).otherwise(none)

    named = F.when(fragment.rlike(NAME), graded(0.96, 0.93, 0.85)).when((capitals >= 2) & (F.size(words) <= 4), graded(0.90, 0.90, 0.65)).when((F.size(words) == 1) & F.length(fragment).between(4, 20), graded(0.92, 0.92, 0.55))
    signals = [("dimensions", sized), ("year", dated), ("medium", medium), ("series", F.when(fragment.rlike(SERIES), 0.90)), ("name", F.when(may, named))]
    ranked = F.array(*[F.struct(c.cast("double").alias("confidence"), F.lit(-i).alias("place"), F.lit(t).alias("type")) for i, (t, c) in enumerate(signals)])
    best = F.array_max(F.filter(ranked, lambda s: s["confidence"].isNotNull()))
    return F.struct(F.coalesce(best["type"], F.lit("title")).alias("type"), F.coalesce(best["confidence"], F.lit(0.40)).alias("confidence"))


SLOTS = ("year", "dimensions", "medium", "name", "series")


def slotted_stem(stem: Column, artists: Sequence[str] = ()) -> Column:
    """number, title, artist, year, medium, dimensions, series and ambiguous of a stem: its fragments by class, each slot to the most confident one, the residue being the title.

    A fragment with commas is cut at them if a piece is a year, a size or a medium, or if one piece is clearly its name:
    known where the others aren't, or more confident by 0.05. artists: folded full names of a small corpus; a larger one
    is joined to the fragments beforehand.
    """
    stem = F.coalesce(stem, F.lit(""))
    number = F.regexp_extract(stem, r"^(?i:No\.\s*)?(\d+)\.?\s+", 1)
    rest = F.regexp_replace(stem, r"^(?i:No\.\s*)?(\d+)\.?\s+", "")
    semicolons, commas = _parts(rest, ";"), _parts(rest, ",")
    fragments = F.when(F.size(semicolons) >= 3, semicolons).when(F.size(commas) >= 3, commas).when(F.size(semicolons) > 0, semicolons).otherwise(F.array(rest))

    def classed(fragment: Column) -> Column:
        known = F.when(F.lower(fragment).isin(*artists), "full") if artists else None
        return F.struct(fragment.alias("text"), fragment_class(fragment, known).alias("c"), (known.isNotNull() if artists else F.lit(False)).alias("known"))

    def cut(fragment: Column) -> Column:
        return F.get(F.transform(F.array(F.transform(_parts(fragment, ","), classed)), lambda pieces: chosen(fragment, pieces)), F.lit(0))

    def chosen(fragment: Column, pieces: Column) -> Column:
        structural = F.exists(pieces, lambda p: p["c"]["type"].isin("year", "dimensions", "medium") & (p["c"]["confidence"] >= 0.80))
        ranked = F.array_sort(F.filter(F.transform(pieces, lambda p, i: F.struct(p["known"].cast("int").alias("known"), p["c"]["confidence"].alias("confidence"), i.alias("i"), p["c"]["type"].alias("type"))), lambda r: r["type"] == "name"))
        best, second = F.get(ranked, F.size(ranked) - 1), F.get(ranked, F.size(ranked) - 2)
        clear = (F.size(ranked) == 1) | (best["known"] > second["known"]) | ((best["known"] == second["known"]) & (best["confidence"] >= second["confidence"] + 0.05))
        tied = (F.size(ranked) > 1) & (best["known"] == second["known"]) & (best["known"] >= 1)
        at = F.when(clear, best["i"]).when(tied, F.array_max(F.transform(ranked, lambda r: r["i"])))
        texts = F.transform(pieces, lambda p: p["text"])
        others = F.array_join(F.filter(texts, lambda p, i: i != at), ", ")
        pulled = F.filter(F.array(others, F.get(texts, at)), lambda p: p != "")
        return F.when(F.size(pieces) < 2, F.array(fragment)).when(structural, texts).when((F.size(ranked) > 0) & at.isNotNull(), pulled).otherwise(F.array(fragment))

    def slots(held: Column) -> Column:
        def best(kind: str) -> Column:
            own = F.filter(F.transform(held, lambda p, i: F.struct(p["c"]["confidence"].alias("confidence"), (-i).alias("place"), p["text"].alias("text"), p["c"]["type"].alias("type"))), lambda r: r["type"] == kind)
            return F.coalesce(F.array_max(own)["text"], F.lit(""))

        found = {kind: best(kind) for kind in SLOTS}
        used = F.array(*found.values())
        title = F.array_join(F.filter(F.transform(held, lambda p: p["text"]), lambda t: ~F.array_contains(used, t)), ", ")
        names = F.array_sort(F.transform(F.filter(held, lambda p: p["c"]["type"] == "name"), lambda p: p["c"]["confidence"]))
        close = (F.size(names) > 1) & (F.get(names, F.size(names) - 1) - F.get(names, F.size(names) - 2) < 0.20)
        return F.struct(number.alias("number"), title.alias("title"), found["name"].alias("artist"), *[found[k].alias(k) for k in SLOTS if k != "name"], F.coalesce(close, F.lit(False)).alias("ambiguous"))

    pieces = F.transform(F.flatten(F.transform(fragments, cut)), classed)
    return F.get(F.transform(F.array(pieces), slots), F.lit(0))
