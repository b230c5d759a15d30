"""String functions of the catalogue: folds, similarities, parsers. Column in, Column out; JVM-side except ratio()."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by the decomposition rule."""
    marked, bare = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _fold_table()


def strip_accents(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, _MARKED, _BARE), r"\p{M}+", "")


def _collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def norm_title(s: Column) -> Column:
    """Accents dropped, lower case, punctuation to spaces; letters of all scripts stay."""
    return _collapse(F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), r"[^\p{L}\p{N}_\s]", " "))


def ascii_fold(s: Column) -> Column:
    """Accents dropped, lower case, all but a-z and 0-9 to spaces; other scripts fold to nothing."""
    return _collapse(F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), r"[^a-z0-9 ]+", " "))


def plain_fold(s: Column) -> Column:
    """Lower case and punctuation to spaces; accents stay."""
    return _collapse(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def tokens(folded: Column) -> Column:
    """Distinct tokens of a folded string."""
    return F.array_distinct(F.filter(F.split(folded, " "), lambda t: t != ""))


def surname(artist: Column) -> Column:
    """The last token of the folded name, empty below four characters."""
    last = F.element_at(F.split(norm_title(artist), " "), -1)
    return F.when(F.length(last) >= 4, last).otherwise("")


def distinctive_surname(artist: Column, particles: Sequence[str]) -> Column:
    """The last token that is no particle or suffix."""
    own = F.filter(F.split(ascii_fold(artist), " "), lambda t: (t != "") & ~t.isin(*particles))
    return F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.size(F.array_union(a, b)))


def title_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and containment, the latter if both have two tokens at least."""
    least = F.least(F.size(a), F.size(b))
    contained = F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0))
    return F.when(least >= 2, F.greatest(jaccard(a, b), contained)).otherwise(jaccard(a, b))


def ordered_containment(short: Column, long: Column) -> Column:
    """Share of short's tokens that long holds in the same order, taken greedily."""
    found = F.aggregate(long, F.lit(1), lambda i, t: F.when((i <= F.size(short)) & (t == F.try_element_at(short, i)), i + 1).otherwise(i)) - 1
    return F.when(F.size(short) == 0, 0.0).otherwise(found / F.size(short))


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two strings; for candidates that an equi-join has blocked."""
    matcher = SequenceMatcher(None)
    for left, right in pairs:
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            matcher.set_seqs(a, b)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def score_fold(title: Column) -> Column:
    """A title for scoring: without a leading article and a trailing year."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_fold(title), r"^(the|a|an|la|le|les|el|il|der|die|das|de|het) ", ""), r" (1[0-9]{3}|20[0-9]{2})$", ""))


def title_variants(title: Column) -> Column:
    """Array of (variant, kind): as written, without a copy number, without parentheses; distinct, empty ones dropped."""
    plain = F.trim(F.coalesce(title, F.lit("")))
    uncounted = F.trim(F.regexp_replace(plain, r"\s*(?:[(#]\s*\d+\s*\)?|\bno\.?\s*\d+)\s*$", ""))
    unwrapped = F.trim(F.regexp_replace(plain, r"\s*\([^)]*\)", ""))
    made = [F.struct(v.alias("variant"), F.lit(k).alias("kind")) for v, k in ((plain, "as-written"), (uncounted, "copy-number"), (unwrapped, "parenthetical"))]
    first, second, third = made
    second = F.when(second["variant"] != first["variant"], second)
    third = F.when((third["variant"] != first["variant"]) & (third["variant"] != F.coalesce(second["variant"], F.lit(""))), third)
    return F.filter(F.array(first, second, third), lambda v: v.isNotNull() & (v["variant"] != ""))


def split_creators(name: Column) -> Column:
    """Names of a multi-creator string; one comma alone means family name first and stays whole."""
    whole = F.trim(F.coalesce(name, F.lit("")))
    commas = F.length(whole) - F.length(F.replace(whole, F.lit(","), F.lit("")))
    parts = F.split(whole, r"\s*(?:;|/|&|\band\b|\bwith\b)\s*")
    many = F.when(commas >= 2, F.split(whole, r"\s*(?:,|;|/|&|\band\b|\bwith\b)\s*")).otherwise(parts)
    bare = F.transform(many, lambda p: F.trim(F.regexp_replace(p, r"(?i)^(attributed to|after|follower of|circle of|workshop of|studio of|school of|manner of)\s+", "")))
    return F.filter(bare, lambda p: p != "")


def has_attribution_prefix(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"(?i)^\s*(attributed to|after|follower of|circle of|workshop of|studio of|school of|manner of)\b")


def repaired_names(name: Column) -> Column:
    """Conservative spellings: runs of a letter collapsed, two tokens swapped."""
    folded = ascii_fold(name)
    runs = F.regexp_replace(folded, r"([a-z])\1+", "$1")
    parts = F.split(folded, " ")
    swapped = F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0]))
    return F.filter(F.array_distinct(F.array(runs, swapped)), lambda v: v.isNotNull() & (v != folded))


def creator_kind(name: Column) -> Column:
    """anonymous, culture, era or person, by the first rule that holds."""
    folded = F.concat(F.lit(" "), ascii_fold(name), F.lit(" "))
    return (
        F.when(F.trim(folded) == "", "missing")
        .when(folded.rlike(r" (unknown|anonymous|unidentified|unattributed|artist unknown) "), "anonymous")
        .when(folded.rlike(r" (century|dynasty|period|era) "), "era")
        .when(folded.rlike(r" (school|culture|people|workshop) "), "culture")
        .when(F.size(F.split(F.trim(folded), " ")) >= 2, "person")
        .otherwise("single-name")
    )


def slug(title: Column, max_words: int = 6) -> Column:
    """The first words of the folded title, joined by hyphens."""
    words = F.filter(F.split(ascii_fold(title), " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, max_words), "-")


def work_identifier(digest: Column, title: Column) -> Column:
    """Seven hex digits of a digest and the slug."""
    return F.concat_ws("-", F.left(digest, F.lit(7)), slug(title))


def domain_of(url: Column) -> Column:
    """Host in lower case without www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def authority_score(domain: Column, trusted: Mapping[str, float]) -> Column:
    """Base score of a trusted host, else 1; more for educational and governmental hosts and museums."""
    base = F.lit(1.0)
    for host, score in trusted.items():
        base = F.when((domain == host) | domain.endswith(f".{host}"), float(score)).otherwise(base)
    return base + F.when(domain.rlike(r"\.(edu|gov)(\.|$)"), 0.5).otherwise(0.0) + F.when(domain.contains("museum"), 0.25).otherwise(0.0)


def excerpt(text: Column, limit: int = 280) -> Column:
    return F.left(_collapse(F.coalesce(text, F.lit(""))), F.lit(limit))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def losing_value(note: Column, marker: str) -> Column:
    """The JSON value that follows a marker in a note, up to where it parses; null if none does."""
    after = F.when(F.locate(marker, note) > 0, F.trim(F.substring_index(note, marker, -1)))
    quoted = F.nullif(F.regexp_extract(after, r'^("(?:[^"\\]|\\.)*"|-?[0-9.]+|true|false|null|\[[^\]]*\]|\{[^}]*\})', 1), F.lit(""))
    return F.when(quoted.startswith('"'), F.regexp_replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), r"\\(.)", "$1")).otherwise(quoted)


def keyword_label_score(label_tokens: Column, keywords: Column, query_tokens: Column) -> Column:
    """0.95 if all tokens of a label are asked for, 0.9 if a token and a keyword share a prefix of four, else null."""
    covered = (F.size(label_tokens) > 0) & (F.size(F.array_except(label_tokens, query_tokens)) == 0)
    near = F.exists(query_tokens, lambda t: F.exists(keywords, lambda k: (t == k) | ((F.length(t) >= 4) & (F.length(k) >= 4) & (t.startswith(k) | k.startswith(t)))))
    return F.when(covered, 0.95).when(near, 0.9)


def model_core(model: Column) -> Column:
    """A product's model name without brand noise: lower case, separators out, marketing words out."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(model, F.lit(""))), r"\b(frame|display|inch|color|colour|new|gen|edition)\b", ""), r"[^a-z0-9]+", "")


def version_text(value: Column) -> Column:
    """The dotted number of a version string, else the trimmed string; null if blank."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    found = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)+)", 1)
    return F.when(found != "", found).otherwise(text)


def token_text(value: Column) -> Column:
    """A token in lower case with hyphens for underscores and blanks."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[_\s]+", "-")


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first (pattern, name) rule that matches."""
    chosen = F.lit(default)
    for pattern, name in reversed(rules):
        chosen = F.when(text.rlike(pattern), F.lit(name)).otherwise(chosen)
    return chosen


def all_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of all (pattern, name) rules that match, in rule order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for p, n in rules]), lambda n: n.isNotNull())


def headings(markdown: Column) -> Column:
    """Heading texts of a markdown document."""
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1))


def checklist(markdown: Column) -> Column:
    """(done, item) of each task line."""
    lines = F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*[-*]\s+\[[ xX]\]\s+.+$"), F.lit(0))
    return F.transform(lines, lambda x: F.struct(x.rlike(r"\[[xX]\]").alias("done"), F.trim(F.regexp_extract(x, r"\]\s+(.+)$", 1)).alias("item")))
