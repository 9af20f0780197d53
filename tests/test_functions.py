"""Scalar functions against literal vectors."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from claimweave import schema
from claimweave.functions import places, scores, text
from claimweave.sources import files


def one(spark, column, *values, names="x"):
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names.split()))
    return rows.select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "raw", "expected"),
    [
        (text.email, "  John.Doe@Example.COM ", "john.doe@example.com"), (text.email, "nope", None), (text.email, "mailto:a@b.co", "a@b.co"), (text.email, None, None),
        (text.month, "2021-03", "2021-03"), (text.month, "March 2021", "2021-03"), (text.month, "03/2021", "2021-03"), (text.month, "Mar. 2021", "2021-03"), (text.month, "2021 Sept", "2021-09"),
        (text.month, "Present", None), (text.month, "2019", None), (text.month, "2021-03-15", None), (text.month, "13/2021", None), (text.month, "1899-01", None),
        (text.skill, "JS", "JavaScript"), (text.skill, "kafka", "Kafka"), (text.skill, "CSS", "CSS"), (text.skill, "  ", None), (text.skill, "node.js", "Node.js"),
        (text.name, "JOHN DOE", "John Doe"), (text.name, "  Jane   McDonald ", "Jane McDonald"), (text.name, "o'brien", "O'Brien"), (text.name, " ", None),
        (text.collapse, " a  b\n", "a b"), (text.fold, "Straße", "strasse"),
    ],
)
def test_text(spark, function, raw, expected):
    assert one(spark, function(F.col("x")), raw) == expected


@pytest.mark.parametrize(
    ("raw", "region", "expected"),
    [
        ("+1 (415) 555-2671", None, "+14155552671"), ("(415) 555-2671", "US", "+14155552671"), ("415 555 2671", None, None), ("not a phone", "US", None),
        ("+39 06 1234 5678", None, "+390612345678"), ("020 624 1111", "NL", "+31206241111"), ("2024-02-11", "US", None), ("+999 12345678", None, None),
        ("+27 82 555 0134", None, "+27825550134"), ("+380 44 555 0134", None, "+380445550134"), ("+7 912 555 01 34", None, "+79125550134"), ("+28 1234567", None, None), ("+27 1", None, None),
    ],
)
def test_phone(spark, raw, region, expected):
    assert one(spark, places.phone(F.col("x"), F.col("r")), raw, region, names="x r") == expected


@pytest.mark.parametrize(
    ("raw", "value", "fuzzy"),
    [("USA", "US", False), ("DE", "DE", False), ("deu", "DE", False), ("The Netherlands", "NL", True), ("Atlantis", None, False), ("U.K.", "GB", False), ("", None, False), (None, None, False)],
)
def test_country(spark, raw, value, fuzzy):
    got = one(spark, places.country(F.col("x")), raw)
    assert (got.value, got.fuzzy) == (value, fuzzy)


@pytest.mark.parametrize(
    ("source", "n", "fuzzy", "expected"),
    [("resume", 1, False, 0.65), ("resume", 3, False, 0.75), ("resume", 9, False, 0.75), ("resume", 0, True, 0.54), ("ats_json", 3, False, 0.99), ("recruiter_notes", 0, False, 0.35), ("recruiter_notes", 0, True, 0.315), ("other", -1, False, 0.3)],
)
def test_field_confidence(spark, source, n, fuzzy, expected):
    got = one(spark, scores.points(scores.field_points(scores.trust(F.col("x")), F.lit(n), F.lit(fuzzy))), source)
    assert got == expected


def test_round4_is_exact(spark):
    rng = random.Random(4)
    values = [sum(rng.choice([0.54, 0.9, 0.315, 0.855, 0.99]) for _ in range(n)) / n for n in range(1, 300) for _ in range(5)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", scores.round4(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [round(r.x, 4) for r in rows]


def test_trust_covers_every_source():
    assert set(schema.TRUST) == {"ats_json", "recruiter_csv", "resume", "github", "recruiter_notes"}


def test_csv_of_any_width_and_quoting(spark):
    wide = ",".join([f"x{i}" for i in range(68)] + ["Email", "Phone"]) + "\n" + "," * 68 + "a@b.co,+1 415 555 2671\n"
    bodies = {
        "wide": wide,
        "break": 'x,"E-\r\nmail",name,Company\r\n"one\ntwo, 3",c@d.co,"Ann ""A"", B",Acme\r\n\r\n1,2,3,4\r\n',
        "stray": 'name,email\n5" disk,e@f.co\n',
        "open": 'email,name\ng@h.co,"never closed, at all\n',
        "after": 'name,email\n"Jo"hn,i@j.co',
        "long": "name,email\n\"" + '""x' * 20_000 + "\",k@l.co",
    }
    rows = [(k, f"{k}.csv", f"{k}.csv", v) for k, v in bodies.items()]
    claims, warnings = files.csv(spark.createDataFrame(rows, "entity_key string, file_seq string, file string, text string"))
    got = {(r.entity_key, r.path): r for r in claims.collect()}
    expected = {
        ("wide", "emails"): "a@b.co", ("wide", "phones"): "+1 415 555 2671", ("break", "emails"): "c@d.co", ("break", "full_name"): 'Ann "A", B', ("stray", "full_name"): '5" disk',
        ("stray", "emails"): "e@f.co", ("open", "emails"): "g@h.co", ("open", "full_name"): "never closed, at all", ("after", "full_name"): "John", ("after", "emails"): "i@j.co",
        ("long", "full_name"): '"x' * 20_000, ("long", "emails"): "k@l.co",
    }
    assert {k: r.v for k, r in got.items() if r.path != "experience"} == expected
    job = got["break", "experience"]
    assert job.exp.company == "Acme" and job.claim_seq > got["break", "full_name"].claim_seq
    assert [(r.entity_key, r.warning) for r in warnings.collect()] == [("break", "recruiter_csv: 2 rows; using the first only in break.csv")]


def test_pdf_strings():
    mapped = b"/CIDInit begincmap 1 beginbfchar <0003> <0048> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange endcmap"
    shown = b"BT /F1 12 Tf 0 -14 Td <0003001000110012> Tj 0 -14 Td [<0010> -20 <0011>] TJ ET"
    stream = lambda data: b"1 0 obj << >>\nstream\n" + data + b"\nendstream\nendobj\n"
    assert files.pdf_text(stream(zlib.compress(mapped)) + stream(zlib.compress(shown))) == "Habc\nab"
    assert files.pdf_text(stream(b"BT (a\\(b\\)\\050 \\\\ (in) c) Tj T* <4A6F> Tj ET")) == "a(b)( \\ (in) c\nJo"
    assert files.pdf_text(b"%PDF broken") == ""
