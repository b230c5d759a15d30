"""Resolving works to entities: guarded matches within a creator's oeuvre, tie-breaks, holders, and a chain of strategies.

Every step is a join on a key (creator, folded title, token) and conditional counts over a work's few candidates. What a
strategy resolves leaves the chain; the rest flows on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.functions import numbers, text

# The least title similarity, the margin of a tie, years that may differ, tolerance of dimensions.
LEAST_TITLE, MARGIN, YEARS, TOLERANCE = 0.90, 0.04, 2, 0.05


#: The tie-breaks, in their order, and what each weighs: more than all later ones together.
_BREAKS = {"held": 8, "sane": 4, "kin": 2, "fits": 1}


def _alike(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """key, title, label, score of the distinct titles and labels of a key that are that similar.

    Each is folded once. Of two token sets so similar the smaller shares that part of its tokens with the larger, so of
    any of its tokens, as many as it may lack and one more, the larger holds one. Titles meet labels on such tokens of
    the smaller set (those in the fewest labels of the key) only, and each pair on the first that both have.
    """

    def worded(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, name).distinct().select(key, name, F.explode(text.tokens(text.score_fold(F.col(name)))).alias("token"))

    frequency = worded(right, "label").groupBy(key, "token").agg(F.count("*").alias("df"))

    def opened(rows: DataFrame, name: str, other: str) -> DataFrame:
        """A row a token: the leading ones meet all of the larger sets (lead: this side), all meet the leading ones of smaller sets."""
        ranked = worded(rows, name).join(frequency, [key, "token"], "left").groupBy(key, name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("ranked"))
        sets = ranked.select(key, name, F.col("ranked.token").alias(f"{name}_all"))
        size = F.size(f"{name}_all")
        sets = sets.select("*", F.slice(f"{name}_all", 1, size - F.ceil(size * least - 1e-9).cast("int") + 1).alias(f"{name}_leading"))
        met = F.concat(F.transform(f"{name}_leading", lambda t: F.struct(F.lit(name).alias("lead"), t.alias("token"))), F.transform(f"{name}_all", lambda t: F.struct(F.lit(other).alias("lead"), t.alias("token"))))
        return sets.select("*", F.explode(met).alias("met")).select(key, name, f"{name}_all", f"{name}_leading", "met.lead", "met.token")

    pairs = opened(left, "title", "label").join(opened(right, "label", "title"), [key, "lead", "token"])
    own, other, smaller = F.col("title_all"), F.col("label_all"), F.size("title_all") <= F.size("label_all")
    common = F.when(smaller, F.array_intersect("title_leading", other)).otherwise(F.array_intersect("label_leading", own))
    once = pairs.where((F.col("lead") == F.when(smaller, "title").otherwise("label")) & (F.try_element_at(common, F.lit(1)) == F.col("token")))
    return once.select(key, "title", "label", text.title_similarity(own, other).alias("score")).where(F.col("score") >= least)


def _sides(a: str, b: str) -> tuple[Column, Column]:
    """The shorter and the longer of two lengths, null if either is."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, F.least(x, y)), F.when(known, F.greatest(x, y))


def match_by_creator(works: DataFrame, oeuvre: DataFrame) -> DataFrame:
    """work_id, qid, reason for every work.

    works: work_id, title, year, creator, holder, medium, height, width; oeuvre: qid, creator, label, inception,
    collection, kind, tall, wide. Candidates share the creator and nearly the best title; ties are broken by the holder,
    the year, the medium and the dimensions, in this order. A single candidate whose year is off is refused.

    Titles repeat, so each pair of them is scored once a creator, and entities that no tie-break tells apart are one row
    with their number. A tie-break keeps the candidates that pass it, or all if none does, so those left in the end are
    those whose passes, read as a number with the first tie-break in front, are the greatest.
    """
    scored = _alike(works, oeuvre, "creator", LEAST_TITLE)
    near = scored.withColumn("best", F.max("score").over(Window.partitionBy("creator", "title"))).where(F.col("score") >= F.col("best") - MARGIN).select("creator", "title", "label")
    told = ["creator", "label", "inception", "collection", "kind", "tall", "wide"]
    entities = oeuvre.groupBy(*told).agg(F.count("*").alias("alike"), F.min("qid").alias("qid"))
    low, high = _sides("tall", "wide")
    entities = entities.select("creator", "label", "inception", "collection", "kind", low.alias("low"), high.alias("high"), "alike", "qid")
    low, high = _sides("height", "width")
    asked = works.select("work_id", "creator", "title", "year", "holder", "medium", low.alias("w_low"), high.alias("w_high"))
    # Dealt by work: equal titles spread over all tasks, and what follows needs no other order.
    met = asked.join(near, ["creator", "title"]).drop("title").repartition("work_id").join(entities, ["creator", "label"])
    passes = {
        "held": F.col("collection") == F.col("holder"),
        "sane": F.col("year").isNull() | F.col("inception").isNull() | (F.abs(F.col("year") - F.col("inception")) <= YEARS),
        "kin": F.col("kind") == F.col("medium"),
        "fits": F.greatest(numbers.relative_delta(F.col("w_low"), F.col("low")), numbers.relative_delta(F.col("w_high"), F.col("high"))) <= TOLERANCE,
    }
    code = F.lit(0)
    for name, weight in _BREAKS.items():
        code = code + F.when(passes[name], weight).otherwise(0)
    counted = met.select("work_id", "alike", "qid", code.alias("code")).groupBy("work_id", "code").agg(F.sum("alike").alias("n"), F.min("qid").alias("qid"))
    outcome = counted.groupBy("work_id").agg(F.max(F.struct("code", "n", "qid")).alias("left"))
    sane = F.col("left.code").bitwiseAND(_BREAKS["sane"]) != 0
    reason = F.when(F.col("left.n") > 1, "ambiguous").when(~sane, "year-mismatch").otherwise("match")
    judged = outcome.select("work_id", F.when(reason == "match", F.col("left.qid")).alias("qid"), reason.alias("found"))
    creators = oeuvre.select("creator", F.lit(True).alias("has_works")).distinct()
    out = works.select("work_id", "creator").join(creators, "creator", "left").join(judged, "work_id", "left")
    missing = F.when(F.col("creator").isNull(), "no-creator").when(F.col("has_works").isNull(), "no-works").otherwise("below-threshold")
    return out.select("work_id", "qid", F.coalesce("found", missing).alias("reason"))


def match_by_title(works: DataFrame, entities: DataFrame) -> DataFrame:
    """work_id, qid, reason: the one entity of that folded title. Uniqueness is judged among all, before the year is.

    Titles repeat, so each is folded once; more than one entity means that the least and the greatest differ.
    """
    labels = entities.groupBy("label").agg(F.min("qid").alias("qid"), F.max("qid").alias("high"), F.min("inception").alias("inception"))
    e = labels.select(text.score_fold(F.col("label")).alias("folded"), "qid", "high", "inception").where("folded <> ''")
    per_title = e.groupBy("folded").agg(F.min("qid").alias("qid"), F.max("high").alias("high"), F.min("inception").alias("inception"))
    titles = works.select("title").distinct().select("title", text.score_fold(F.col("title")).alias("folded")).join(per_title, "folded").select("title", F.lit(True).alias("hit"), "qid", "high", "inception")
    joined = works.select("work_id", "year", "title").join(titles, "title", "left")
    off = F.abs(F.col("year") - F.col("inception")) > YEARS
    reason = F.when(F.col("hit").isNull(), "no-hit").when(F.col("qid") != F.col("high"), "ambiguous").when(F.coalesce(off, F.lit(False)), "year-mismatch").otherwise("match")
    return joined.select("work_id", F.when(reason == "match", F.col("qid")).alias("qid"), reason.alias("reason"))


def match_by_variants(works: DataFrame, oeuvre: DataFrame, least: float = 0.75) -> DataFrame:
    """work_id, qid, reason: one entity of the creator with a variant of the title, equal or within it in order, and a year that agrees; the year is required."""
    # Titles repeat, so each variant meets each label of its creator once; then works meet the labels that were hit, by year.
    variants = works.select("creator", "title").distinct().select("creator", "title", F.explode(F.transform(text.title_variants(F.col("title")), lambda v: v["variant"])).alias("variant"))
    met = variants.select("creator", "variant").distinct().join(oeuvre.select("creator", "label").distinct(), "creator")
    own, other = text.tokens(text.score_fold(F.col("variant"))), text.tokens(text.score_fold(F.col("label")))
    contained = (F.size(own) >= 2) & (text.ordered_containment(own, other) >= least)
    hits = met.where((F.array_join(own, " ") == F.array_join(other, " ")) & (F.size(own) > 0) | contained)
    labels = variants.join(hits, ["creator", "variant"]).select("creator", "title", "label").distinct()
    # More than one entity hit means that the least and the greatest differ, so no list of them is needed.
    dated = labels.join(oeuvre.groupBy("creator", "label", "inception").agg(F.min("qid").alias("low"), F.max("qid").alias("high")), ["creator", "label"]).groupBy("creator", "title", "inception").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = works.select("creator", "title", "year").distinct()
    found = asked.join(dated, ["creator", "title"]).where(F.abs(F.col("year") - F.col("inception")) <= YEARS).groupBy("creator", "title", "year").agg(F.min("low").alias("qid"), F.max("high").alias("high"))
    reason = F.when(F.col("qid").isNull(), "no-hit").when(F.col("qid") != F.col("high"), "ambiguous").otherwise("match")
    return works.select("work_id", "creator", "title", "year").join(found, ["creator", "title", "year"], "left").select("work_id", F.when(reason == "match", F.col("qid")).alias("qid"), reason.alias("reason"))


def holders(matches: DataFrame, entities: DataFrame, immovable: DataFrame) -> DataFrame:
    """work_id, holder, kind of matched works: the collection, or for immovable works (work_id) the location. entities: qid, collection, location."""
    fixed = immovable.select("work_id", F.lit(True).alias("fixed")).distinct()
    joined = matches.where("qid IS NOT NULL").join(entities.select("qid", "collection", "location"), "qid").join(fixed, "work_id", "left")
    place = F.when(F.col("fixed"), F.col("location"))
    kind = F.when(F.col("collection").isNotNull(), "collection").when(place.isNotNull(), "location").otherwise("no-collection")
    return joined.select("work_id", F.coalesce("collection", place).alias("holder"), kind.alias("kind"))


def locations_from_titles(works: DataFrame, places: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """work_id, location, reason: the one place of the creator with a distinctive word (four letters or more, no stopword) in the title. places: creator, location, label."""
    known = places.where("location IS NOT NULL").select("creator", "location", F.explode(text.tokens(text.ascii_fold(F.col("label")))).alias("word"))
    known = known.where((F.length("word") >= 4) & ~F.col("word").isin(*stopwords))
    said = works.select("work_id", "creator", F.explode(text.tokens(text.ascii_fold(F.col("title")))).alias("word"))
    hits = said.join(known, ["creator", "word"]).groupBy("work_id").agg(F.count_distinct("location").alias("n"), F.min("location").alias("location"))
    any_place = places.where("location IS NOT NULL").select("creator", F.lit(True).alias("has_places")).distinct()
    out = works.select("work_id", "creator").join(any_place, "creator", "left").join(hits, "work_id", "left")
    reason = F.when(F.col("has_places").isNull(), "no-location").when(F.col("n").isNull(), "no-location-in-title").when(F.col("n") > 1, "ambiguous").otherwise("match")
    return out.select("work_id", F.when(reason == "match", F.col("location")).alias("location"), reason.alias("reason"))


def swapped_columns(works: DataFrame, people: DataFrame, oeuvre: DataFrame) -> DataFrame:
    """work_id, creator, qid of works whose title names a person and whose artist names one of that person's works. works: work_id, title, artist; people: creator, name; oeuvre: creator, qid, label."""
    named = works.withColumn("folded", text.ascii_fold(F.col("title"))).join(people.select(text.ascii_fold(F.col("name")).alias("folded"), "creator"), "folded")
    labels = oeuvre.select("creator", text.score_fold(F.col("label")).alias("label_folded"), "qid")
    confirmed = named.withColumn("label_folded", text.score_fold(F.col("artist"))).join(labels, ["creator", "label_folded"])
    found = confirmed.groupBy("work_id").agg(F.count_distinct("qid").alias("n"), F.min("creator").alias("creator"), F.min("qid").alias("qid"))
    return found.where("n = 1").select("work_id", "creator", "qid")


def match_people(names: DataFrame, people: DataFrame, occupations: Sequence[str], least: float = 0.88) -> DataFrame:
    """raw, qid, score: the one human of an art occupation with the most similar name. people: qid, name, human, occupation. Names meet on their last word."""
    artists = people.where(F.col("human") & F.col("occupation").isin(*occupations)).select("qid", "name", text.surname(F.col("name")).alias("last")).distinct()
    met = names.select("raw", text.surname(F.col("raw")).alias("last")).where("last <> ''").distinct().join(artists, "last")
    scored = met.withColumn("score", text.ratio(text.ascii_fold(F.col("raw")), text.ascii_fold(F.col("name")))).where(F.col("score") >= least)
    best = scored.groupBy("raw", "qid").agg(F.max("score").alias("score"))
    top = best.groupBy("raw").agg(F.max("score").alias("score"))
    found = best.join(top, ["raw", "score"]).groupBy("raw", "score").agg(F.count("*").alias("n"), F.min("qid").alias("qid"))
    return found.where("n = 1").select("raw", "qid", "score")


Strategy = Callable[[DataFrame], DataFrame]


def resolve(works: DataFrame, strategies: Mapping[str, Strategy], plan_version: int) -> DataFrame:
    """work_id, qid, method, tried, retired_at for every work that is due.

    A work is due unless an earlier plan of this version or a later one has retired it (retired_at). Strategies run in
    order over what is left; tried lists name:reason of each. What none resolves is retired at this plan's version.
    """
    due = works.where(F.coalesce(F.col("retired_at"), F.lit(-1)) < plan_version).drop("retired_at")
    chain = due.select("*", F.array().cast("array<string>").alias("tried"))
    done = None
    for name, strategy in strategies.items():
        # The outcomes join one chain of all due works: hits split from the rest would each run every strategy before.
        rest = chain if done is None else chain.where("found_qid IS NULL").drop("found_qid", "found_by")
        found = strategy(rest.drop("tried")).select("work_id", F.col("qid").alias("new_qid"), "reason")
        left, hit = F.lit(True) if done is None else F.col("found_qid").isNull(), F.col("new_qid").isNotNull()
        tried = F.when(left, F.concat("tried", F.array(F.concat(F.lit(f"{name}:"), F.coalesce("reason", F.lit("skipped")))))).otherwise(F.col("tried"))
        qid, by = (F.col("new_qid"), F.when(hit, name)) if done is None else (F.coalesce("found_qid", "new_qid"), F.coalesce("found_by", F.when(hit, name)))
        chain = done = chain.join(found, "work_id", "left").select(*due.columns, tried.alias("tried"), qid.alias("found_qid"), by.alias("found_by"))
    return done.select("work_id", F.col("found_qid").alias("qid"), F.col("found_by").alias("method"), "tried", F.when(F.col("found_qid").isNull(), plan_version).alias("retired_at"))
