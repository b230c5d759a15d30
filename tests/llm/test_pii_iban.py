"""IBANs followed by capitals and digits, and IBANs within candidates that fail."""

from __future__ import annotations

import pytest

from cataloom.llm import pii

DE, GB, NO = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"


def bare(iban):
    return iban.replace(" ", "")


def unlisted(country, body):
    digits = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


ZZ = unlisted("ZZ", "12345678901234")
CASES = [
    (f"{GB} The rest", [GB]), (f"{DE} Please", [DE]), (f"{bare(DE)} BIC COBADEFF", [bare(DE)]), (f"{DE} 5 items", [DE]), (f"{DE} 1234 5678 9012", [DE]),
    (f"{DE} {GB} {NO} A1", [DE, GB, NO]), (f"\U0001f600é {GB} I 中 {DE}", [GB, DE]), (f"SE12 {GB} AB", [GB]), (f"{ZZ} The rest", [ZZ]), (f"{ZZ} AND MORE 12", [ZZ]),
    (f"{bare(DE)}BIC", []), (f"x{GB} The", []), ("DE89 3704 0044 0532 0130 01 The", []), ("GB82WEST1234569876543 The", []), ("", []), (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: [(s.start, s.end, s.match) for s in r.pii_spans] for r in pii.find_personal_data(frame, kinds=("iban",)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_iban_spans(found, i):
    text, ibans = CASES[i]
    assert found[i] == [(text.index(m), text.index(m) + len(m), m) for m in ibans]


def test_every_listed_length(spark):
    """An IBAN of each country, before a capitalised word."""
    held = [unlisted(c, "0" * (n - 4)) for n, countries in pii.IBAN_LENGTHS.items() for c in countries.split()]
    r = pii.find_personal_data(spark.createDataFrame([(1, " Then ".join(held) + " Then")], "doc_id long, text string"), kinds=("iban",)).first()
    assert [s.match for s in r.pii_spans] == held
