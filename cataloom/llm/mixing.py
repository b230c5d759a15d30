"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with n rows whose target share is w of T rows gets the mean repetition rate w * T / n. Each row's count is the
inverse of the Poisson distribution at a number in [0, 1) that a digest of seed and identifier gives, so that counts
don't depend on order, partitioning or retries. Rows are exploded by their counts and shuffled globally: dealt to
partitions by a hash of identifier and copy, and sorted by that hash within each.

Rates per source come from counts that each task adds up before the shuffle. They are broadcast if there are few
sources; beyond BROADCAST_SOURCES the join is dealt by source and a salt, so that a hot source spreads over SALTS keys.

Defined results: rows without a source form a source of their own; a source that the weights don't name gets none; a
null identifier hashes as an empty one; rows that repeat an identifier get the same count; an empty table gives an
empty result; columns named like an output column (copy, n_copies, rate) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import fresh, replacing

BROADCAST_SOURCES, SALTS = 100_000, 32
#: A rate above this is split into equal parts, each inverted at a digest of its own: exp(-rate) must not vanish.
LARGEST_PART = 256.0


def seeded_uniform(seed: int, key: Column, part: Column) -> Column:
    """A double in [0, 1): the first 52 bits of the MD5 digest of seed, key and part."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... far into the tail."""
    last = (F.ceil(rate + 12 * F.sqrt(rate)) + 24).cast("int")
    p0 = F.exp(-rate)
    start = F.struct(p0.alias("p"), F.array(p0).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])


def source_rates(docs: DataFrame, source_col: str, weights: dict[str | None, float] | None, target_rows: int | None) -> tuple[DataFrame, int]:
    """Per source: rate, the number of parts it is split into and the distribution of a part; and the number of sources."""
    counts = docs.groupBy(docs[f"`{source_col}`"].cast("string").alias("source")).agg(F.count("*").alias("n"))
    n_sources, n_rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = float(n_rows if target_rows is None else target_rows)
    if weights is None:
        share = F.lit(1.0 / max(1, n_sources))
    else:
        scale = sum(weights.values())
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(weight / scale)).otherwise(share)
    rates = counts.select("source", (F.lit(total) * share / F.col("n")).alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / LARGEST_PART), F.lit(1)).cast("int"))
    return rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts"))), n_sources


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, target_rows: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """docs replicated to the target weights (None: equal for all sources; T: rows of docs), with copy, n_copies and rate, in random order."""
    rates, n_sources = source_rates(docs, source_col, weights, target_rows)
    name, rate, parts, cdf, salt, count, copy, place = internal = fresh(docs.columns, "source", "rate", "parts", "cdf", "salt", "count", "copy", "place")
    rates = rates.toDF(name, rate, parts, cdf)
    source, key = docs[f"`{source_col}`"].cast("string"), docs[f"`{id_col}`"]
    if n_sources <= broadcast_sources:
        joined = docs.join(F.broadcast(rates), source.eqNullSafe(rates[name]))
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)))
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, source.eqNullSafe(spread[name]) & (salted[salt] == spread[salt])).drop(salt)

    def drawn(part: Column) -> Column:
        u = seeded_uniform(seed, key, part)
        return F.size(F.filter(cdf, lambda c: c <= u))

    drawn_counts = F.transform(F.sequence(F.lit(1), F.col(parts)), drawn)
    counted = joined.withColumn(count, F.aggregate(drawn_counts, F.lit(0), lambda a, n: a + n)).where(F.col(count) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    placed = copies.withColumn(place, F.xxhash64(F.lit(seed), key, F.col(copy)))
    shuffled = placed.repartition(place).sortWithinPartitions(place)
    out = replacing(shuffled, {"copy": F.col(copy), "n_copies": F.col(count), "rate": F.col(rate)})
    return out.drop(*internal)
