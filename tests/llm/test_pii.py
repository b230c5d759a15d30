"""Spans against plain patterns, with positions in code points."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from cataloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "no data", "a@b.c_d@e.f", "mail x.y+z@host-1.example.org, and a@b", "\U0001f600é me@x.de 中 10.0.0.1",
    "1.2.3.4.5.6.7.8", "256.1.1.1 and 001.002.003.004", "1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "4111  1111 1111 1111",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "call +49 (0)30 1234-567 now", "+1", "+12 3", "++49 170 1234567+1 22 33 44 55", "+1234567890123456789",
    "a@b.c." * 3000, "x" * 50_000 + "@y.z", "9" * 30_000, "1." * 20_000, "+1 " * 10_000, "@" * 5000, "a@@b.c", "5500005555555559", "user@1.2.3.4", "0000000000000000",
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.find_personal_data(frame).collect():
        got = [(s.kind, s.start, s.end, s.match) for s in r.pii_spans if s.kind in pii.BASE_KINDS]
        assert got == plain_spans(TEXTS[r.doc_id]), TEXTS[r.doc_id][:80]


@pytest.mark.parametrize(("text", "n"), [("IBAN DE89 3704 0044 0532 0130 00.", 1), ("GB82WEST12345698765432", 1), ("DE89 3704 0044 0532 0130 01", 0), ("XX00 ABCD", 0)])
def test_iban(spark, text, n):
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sum(s.kind == "iban" for s in r.pii_spans) == n


def test_context_raises_the_score(spark):
    frame = spark.createDataFrame([(1, "my phone: +49 30 1234567"), (2, "number +49 30 1234567")], "doc_id long, text string")
    near, far = (pii.find_personal_data(frame).where(f"doc_id = {i}").first().pii_spans[0].score for i in (1, 2))
    assert near == pytest.approx(far + pii.NEAR_BONUS)


def test_context_counts_on_both_sides_and_may_lower_the_score(spark):
    texts = ["+49 30 1234567 is my phone", "order +49 30 1234567", "number +49 30 1234567", "DE89370400440532013000 is the IBAN", "DE89370400440532013000"]
    scores = [r.pii_spans[0].score for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert scores == pytest.approx([0.7, 0.5, 0.6, 1.0, 0.9])


def test_running_sums(spark):
    for n in (1, 2, 3, 4, 5, 16, 17, 99, 1000):
        xs = [(i * 7919) % 13 for i in range(n)]
        got = spark.createDataFrame([(xs,)], "xs array<bigint>").select(pii.running_sums(F.col("xs"))).first()[0]
        assert got == [sum(xs[:i]) for i in range(n)]


def test_very_many_matches(spark):
    """Not quadratic: positions of 60,000 addresses and of 20,000 IBANs in one text."""
    texts = ["ab@cd.ef, " * 60_000, "DE89370400440532013000 " * 20_000]
    began = time.monotonic()
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [s.start for s in rows[0].pii_spans] == [10 * i for i in range(60_000)]
    assert [(s.start, s.end) for s in rows[1].pii_spans if s.kind == "iban"] == [(23 * i, 23 * i + 22) for i in range(20_000)]
    assert time.monotonic() - began < 60


def test_no_python_in_the_plan(spark, hostile):
    plan = pii.find_personal_data(hostile)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redact_and_hostile(spark, hostile, nothing):
    frame = spark.createDataFrame([(1, "to a@b.de or 10.0.0.1, ok"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(frame).collect()} == {1: "to [email] or [ip], ok", 2: ""}
    out = pii.find_personal_data(hostile)
    assert out.count() == hostile.count() and set(out.columns) == set(hostile.columns) and pii.find_personal_data(nothing).count() == 0
