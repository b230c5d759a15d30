"""Medium vocabulary and category inference, as lookups over arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions.text import first_rule

# Material synonyms and the order in which materials are named.
MEDIUMS = {
    "oil": "oil", "oils": "oil", "oil paint": "oil", "oil colour": "oil", "oil color": "oil", "tempera": "tempera", "egg tempera": "tempera",
    "acrylic": "acrylic", "acrylic paint": "acrylic", "watercolor": "watercolour", "watercolour": "watercolour", "watercolor paint": "watercolour",
    "watercolour paint": "watercolour", "gouache": "gouache", "distemper": "distemper", "encaustic": "encaustic", "wax": "encaustic", "ink": "ink",
    "chalk": "chalk", "charcoal": "charcoal", "pastel": "pastel", "pencil": "pencil", "graphite": "graphite", "crayon": "crayon", "gold": "gold",
    "gold leaf": "gold", "silver": "silver",
}
SUPPORTS = {
    "canvas": "canvas", "linen": "canvas", "panel": "panel", "wood": "panel", "wood panel": "panel", "timber": "panel", "poplar": "panel", "oak": "panel",
    "mahogany": "panel", "walnut": "panel", "board": "board", "paperboard": "board", "cardboard": "board", "millboard": "board", "hardboard": "board",
    "masonite": "board", "cardstock": "board", "paper": "paper", "copper": "copper", "vellum": "vellum", "parchment": "vellum", "ivory": "ivory", "plaster": "plaster",
}
MEDIUM_ORDER = ("oil", "tempera", "acrylic", "watercolour", "gouache", "distemper", "encaustic", "ink", "chalk", "charcoal", "pastel", "pencil", "graphite", "crayon", "gold", "silver")
SUPPORT_ORDER = ("canvas", "panel", "board", "paper", "copper", "vellum", "ivory", "plaster")


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _canonical(parts: Column, table: Mapping[str, str]) -> Column:
    """Each part by its whole text, else by its last word."""
    found = F.transform(parts, lambda p: F.coalesce(F.try_element_at(_lookup(table), p), F.try_element_at(_lookup(table), F.element_at(F.split(p, " "), -1))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def parse_medium(value: Column) -> Column:
    """(mediums, supports) as sorted arrays; null if nothing is known."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    parts = F.transform(F.split(F.regexp_replace(low, r" on | and |/|[()]", ","), ","), lambda p: F.trim(F.regexp_replace(p, r"^[ .]+|[ .]+$", "")))
    parts = F.filter(parts, lambda p: p != "")
    mediums, supports = _canonical(parts, MEDIUMS), _canonical(parts, SUPPORTS)
    return F.when((F.size(mediums) > 0) | (F.size(supports) > 0), F.struct(mediums.alias("mediums"), supports.alias("supports")))


def render_medium(parsed: Column) -> Column:
    """"Oil and gold on panel"."""
    def named(order: Sequence[str], held: Column) -> Column:
        return F.array_join(F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(held, x)), " and ")

    whole = F.concat_ws(" on ", F.nullif(named(MEDIUM_ORDER, parsed["mediums"]), F.lit("")), F.nullif(named(SUPPORT_ORDER, parsed["supports"]), F.lit("")))
    return F.concat(F.upper(F.left(whole, F.lit(1))), F.substring(whole, F.lit(2), F.length(whole)))


def infer_category(tiers: Sequence[tuple[Column, Sequence[tuple[str, str]]]]) -> Column:
    """The category that the first matching tier names; a tier is a text and its keyword rules."""
    return F.coalesce(*[first_rule(F.lower(F.coalesce(source, F.lit(""))), [(rf"\b(?:{words})\b", name) for words, name in rules]) for source, rules in tiers])


def category_prior(occupation_category: Column, title_veto: Column) -> Column:
    """The category of a creator's occupation, unless the title speaks against it."""
    return F.when(~F.coalesce(title_veto, F.lit(False)), occupation_category)


def work_class(category: Column, year: Column) -> Column:
    """The coarse class that source quality is counted by."""
    cat = F.lower(F.coalesce(category, F.lit("painting")))
    flat = F.when(year.isNull(), "western-painting-unknown-period").when(year < 1800, "western-painting-pre1800").when(year < 1900, "western-painting-19c").otherwise("western-painting-modern")
    return (
        F.when(cat == "photograph", "photograph")
        .when(cat == "sculpture", "sculpture")
        .when(cat.isin("illuminated_manuscript", "icon", "fresco", "mural", "altarpiece", "tapestry"), "manuscript-or-monumental")
        .when(cat.isin("painting", "drawing", "print"), flat)
        .otherwise("other")
    )
