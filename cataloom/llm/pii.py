"""Personal data by patterns, checksums and context, with DataFrame functions only.

A regular expression proposes the spans of each kind, leftmost and non-overlapping. A validator confirms them: the
Luhn sum for card numbers, mod 97 for IBANs, ranges for address parts, digit counts for phones. Words near a span, on
either side, raise or lower its score. The patterns of the base kinds are written so that no run of characters is scanned twice: possessive
quantifiers, and starts only at the head of a run or where the last match ended, which finds the same matches as the
plain patterns. An IBAN ends where the length of its country says, whatever word or number follows; that of a country
not listed ends at the first end of a word where mod 97 holds. Each head of an IBAN is tried, also within a candidate
that isn't confirmed.

Positions come from splitting at the pattern: the k-th match starts after k + 1 pieces and k matches. Their lengths are
summed in blocks of about the root of their number, so that a text of very many matches isn't quadratic. Positions count
code points; ends are exclusive. Defined results: a null text counts as empty; no spans give zero counts, an empty list
and the digest of the empty string; rows and texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import replacing

#: Length of an IBAN -> countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = [c for held in IBAN_LENGTHS.values() for c in held.split()]
_IBANS = "|".join(rf"(?:{held.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, held in IBAN_LENGTHS.items())
_IBANS += rf"|(?!{'|'.join(_LISTED)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
#: Code points of a candidate IBAN that its match takes; the rest is only looked at, so that later heads are tried too.
IBAN_HEAD = 2
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, cheap test that holds for every text with a match)
PATTERNS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (rf"(?<![A-Za-z0-9])(?=((?:{_IBANS})(?![A-Za-z0-9])))[A-Z]{{{IBAN_HEAD}}}", None),
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Words that raise the score of a span when they stand near it, and words that lower it.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|debit",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
}
AGAINST = {
    "email": "example|sample|dummy",
    "ip": "version|release|build|firmware|section",
    "card": "order|tracking|serial|isbn|invoice|article",
    "phone": "order|tracking|serial|isbn|invoice|article",
    "iban": "example|sample|dummy",
}
#: Score of a confirmed span by kind, before its context counts.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9}
#: Code points on either side of a span that count as near, and what a context word adds or takes.
NEAR, NEAR_BONUS = 40, 0.1
#: Code points that an IBAN takes at most, a space before each character.
IBAN_REACH = 68


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum; every second digit from the right is doubled."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def step(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(digits, -i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), step) % 10 == 0


def iban_valid(iban: Column) -> Column:
    """Mod 97 over the rearranged letters and digits, in whole numbers, a character at a time."""
    bare = F.replace(iban, F.lit(" "))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    at = F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(at, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(13, 19) & luhn_valid(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "))).between(15, 34) & iban_valid(match)
    return F.lit(True)


def _iban_of(candidate: Column) -> Column:
    """The candidate, cut at the first end of a word where it is valid if its country has no listed length; null if nowhere."""
    words = F.split(candidate, " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.when(F.substring(candidate, 1, 2).isin(_LISTED), candidate).otherwise(F.get(F.filter(cuts, lambda c: _confirmed("iban", c)), F.lit(0)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apart(spans: Column) -> Column:
    """spans in order without those that begin within an earlier one."""

    def alone(all_: Column) -> Column:
        def begins_within(s: Column, i: Column) -> Column:
            before = F.slice(all_, F.greatest(i - IBAN_REACH, F.lit(0)) + 1, F.least(i, F.lit(IBAN_REACH)))
            return ~F.exists(before, lambda p: p["end"] > s["start"])

        return F.filter(all_, begins_within)

    return _let(spans, alone)


def running_sums(lengths: Column) -> Column:
    """For each of an array's numbers the sum of those before it; the array isn't empty."""

    def grown(start: Column, numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(start), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def blocks_of(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda b: F.slice(xs, b * width + 1, width))

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x))
        return _let(grown(F.lit(0).cast("long"), totals), lambda starts: F.flatten(F.transform(blocks, lambda block, b: F.slice(grown(F.get(starts, b), block), F.lit(1), F.size(block)))))

    return _let(_let(lengths, blocks_of), summed)


def _fold(pieces: Column, matches: Column, kind: str) -> Column:
    """Spans of a kind: an array of (kind, start, end, match, score), start being the running length of pieces and matches."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    index = F.sequence(F.lit(1), F.size(matches))

    def length(i: Column) -> Column:
        taken = F.lit(IBAN_HEAD) if kind == "iban" else F.length(F.element_at(matches, i))
        return (F.length(F.element_at(pieces, i)) + taken).cast("long")

    def placed(sums: Column) -> Column:
        def span(i: Column) -> Column:
            piece, match = F.element_at(pieces, i), F.element_at(matches, i)
            begin = F.get(sums, i - 1) + F.length(piece)
            after = F.element_at(pieces, i + 1)
            if kind == "iban":  # the piece after its head begins with the rest of it
                after = F.substring(after, F.length(match) - IBAN_HEAD + 1, F.lit(NEAR))
            return F.struct(begin.alias("start"), (begin + F.length(match)).alias("end"), match.alias("match"), F.substring(piece, -NEAR, NEAR).alias("before"), F.substring(after, F.lit(1), F.lit(NEAR)).alias("after"))

        return F.transform(index, span)

    spans = F.when(F.size(matches) > 0, _let(running_sums(F.transform(index, length)), placed)).otherwise(empty)
    confirmed = F.filter(spans, lambda s: _confirmed(kind, s["match"]))

    def score(s: Column) -> Column:
        near = F.lower(F.concat_ws(" ", s["before"], s["after"]))
        return F.lit(PRIOR[kind]) + F.when(near.rlike(f"\\b(?:{CONTEXT[kind]})"), NEAR_BONUS).otherwise(0.0) - F.when(near.rlike(f"\\b(?:{AGAINST[kind]})"), NEAR_BONUS).otherwise(0.0)

    return F.transform(
        _apart(confirmed) if kind == "iban" else confirmed,
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score(s).alias("score")),
    )


def find_personal_data(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with pii_spans, an array of (kind, start, end, match, score) in the order of kinds, then start."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    taken = {c.lower() for c in docs.columns}
    prefix = "__pii"
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    found = docs
    # One projection proposes (pieces and matches), the next confirms: the expressions of the first are not repeated.
    proposals = []
    for kind in kinds:
        pattern, needs = PATTERNS[kind]
        may = text.contains(needs) if needs else text.rlike(r"[0-9]")
        none = F.array().cast("array<string>")
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind == "iban")))
        matches = F.transform(matches, _iban_of) if kind == "iban" else matches
        proposals += [
            F.when(may, matches).otherwise(none).alias(f"{prefix}_m_{kind}"),
        ]
    found = found.select("*", *proposals)
    found = found.select("*", *[F.when(F.size(f"{prefix}_m_{kind}") > 0, F.split(text, PATTERNS[kind][0], -1)).otherwise(F.array().cast("array<string>")).alias(f"{prefix}_p_{kind}") for kind in kinds])
    spans = F.concat(*[_fold(F.col(f"{prefix}_p_{kind}"), F.col(f"{prefix}_m_{kind}"), kind) for kind in kinds])
    return replacing(found, {"pii_spans": spans}).select(*[f"`{c}`" for c in docs.columns if c.lower() != "pii_spans"], "pii_spans")


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """docs with each span of at least that score replaced by its kind in brackets; of overlapping spans the first in order counts."""
    found = find_personal_data(docs, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ordered = F.array_sort(F.transform(F.filter("pii_spans", lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = s["start"]
        kept = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(begin < state["at"], state).otherwise(F.struct(s["end"].alias("at"), kept.alias("out")))

    redacted = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return replacing(found, {text_col: redacted}).select(*[f"`{c}`" for c in docs.columns])
