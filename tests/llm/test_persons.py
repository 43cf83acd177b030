"""Personal data: coreference of persons, accounts and addresses of other forms, and detection next to punctuation."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from lumberline.llm import pii

DOCS = "doc_id long, text string"


def cleaned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(2)
    return {r.doc_id: r for r in pii.surrogates(df, **options).collect()}


def test_one_person_one_name(spark):
    texts = [
        "Mr. John Smith left. Smith said hi; John Smith agreed, and Smith's dog too. Mr. Smith, Smithson.",
        "Herr John Smith wrote to Mister John Smith.",
        "Smith and John are common words here, 12:30.",
        "Dr. Jane Roe met Prof. Roe. Roe left",
        "Frau Ода Ода and Господин Петров. Петров ушёл. Mrs. Smith and Mr. Smith",
    ]
    got = cleaned(spark, texts)
    first = re.fullmatch(r"Mr\. (\w+) (\w+) left\. (\w+) said hi; (\w+) (\w+) agreed, and (\w+)'s dog too\. Mr\. (\w+), Smithson\.", got[0].text)
    assert first and first[1] == first[4] and len({first[i] for i in (2, 3, 5, 6, 7)}) == 1 and first[1] in pii.MALE_NAMES["Latin"]
    assert got[1].text == f"Herr {first[1]} {first[2]} wrote to Mister {first[1]} {first[2]}."
    assert got[2].text == texts[2] and got[2].n_entities == 0
    roe = re.fullmatch(r"Dr\. (\w+) (\w+) met Prof\. (\w+)\. (\w+) left", got[3].text)
    assert roe and len({roe[2], roe[3], roe[4]}) == 1 and roe[2] != "Roe" and roe[1] in pii.MALE_NAMES["Latin"] + pii.FEMALE_NAMES["Latin"]
    last = re.fullmatch(r"Frau (\w+) (\w+) and Господин (\w+)\. (\w+) ушёл\. Mrs\. (\w+) and Mr\. (\w+)", got[4].text)
    assert last and last[3] == last[4] != "Петров" and [r.n_entities for r in got.values()] and got[0].n_entities == 2


def remainder(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def test_accounts_and_long_addresses(spark):
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]
    addresses = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:DB8::8A2E:370:7334", "fe80::1"]
    plain = ["at 12:30:45 or 1:2", "std::vector and a::b", "AB12", "see ISO8601:2004"]
    got = cleaned(spark, [f"see {x}. {x}," for x in accounts + addresses] + plain)
    for i, x in enumerate(accounts + addresses):
        a, b = re.fullmatch(r"see (.*)\. (.*),", got[i].text).groups()
        assert a == b != x and len(a) == len(x) and got[i].n_entities == 2, (x, got[i].text)
        assert re.sub(r"[0-9A-Za-z]", "", a) == re.sub(r"[0-9A-Za-z]", "", x)
        if i < len(accounts):
            assert a[:2] == x[:2] and remainder(x) == remainder(a) == 1, a
    assert [got[6 + i].text for i in range(len(plain))] == plain


def test_entities_next_to_punctuation(spark):
    """Every entity goes wherever it stands, and all else stays: against the text taken apart plainly."""
    rng = random.Random(11)
    made = {
        "email": lambda: f"{rng.choice(('ann', 'Bob.Lee', 'x_1'))}{rng.randrange(99)}@mail{rng.randrange(9)}.example.org",
        "phone": lambda: f"+{rng.randrange(1, 10)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
        "address": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "social": lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "person": lambda: f"{rng.choice(('Mr.', 'Frau', 'Dr.'))} {rng.choice(('Ada', 'Carl'))} {rng.choice(('Quimbly', 'Zorn'))}",
        "cloud_key": lambda: "AKIA" + "".join(rng.choice("ABCDEFGH2345") for _ in range(16)),
    }
    after = [".", ",", ")", '"', "'", "\n", ".\n", ";", "!", "?", " ", ". Next", ""]
    rows = []
    for i in range(240):
        kind = rng.choice(sorted(made))
        rows.append((kind, made[kind](), rng.choice(("see ", "(", '"', "it is: ", "\n")), after[i % len(after)]))
    got = cleaned(spark, [f"a b {before}{x}{end}" for _, x, before, end in rows])
    for i, (kind, x, before, end) in enumerate(rows):
        text = got[i].text
        assert got[i].n_entities == 1 and x not in text, (kind, x, end, text)
        assert text.startswith(f"a b {before}") and text.endswith(end), (x, text)
        inner = text[len(f"a b {before}") : len(text) - len(end) or None]
        assert regex.fullmatch(f"(?:{pii.PATTERNS[kind]})", inner), (kind, inner)


def test_collisions_end(spark, monkeypatch):
    """Where every attempt collides, it is an error and no endless loop."""
    monkeypatch.setattr(pii, "surrogate", lambda found, key=pii.KEY: F.transform(found, lambda x: F.lit("s@c.co")))
    monkeypatch.setattr(pii, "ROUNDS", 3)
    with pytest.raises(RuntimeError, match="3 attempts"):
        cleaned(spark, ["a@b.co x@y.co"])


def test_null_ids_and_key(spark):
    df = spark.createDataFrame([(None, "to a@b.co"), (None, None), (1, "")], DOCS)
    got = sorted((r.doc_id is None, r.text or "", r.n_entities) for r in pii.surrogates(df).collect())
    assert got[0] == (False, "", 0) and got[1] == (True, "", 0) and got[2][2] == 1 and "a@b" not in got[2][1]
    assert pii.secret(spark) == pii.KEY
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.secret(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
