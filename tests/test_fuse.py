"""Merging: winners, corroboration, unions, identity, and independence of the order of rows."""

import json

from pyspark.sql import functions as F

from claimweave import schema
from claimweave.operators.fuse import profiles
from claimweave.operators.normalize import normalize


def claims(spark, rows, key="e"):
    out = []
    for i, (path, v, source, method) in enumerate(rows):
        exp = v if path == "experience" else None
        edu = v if path == "education" else None
        out.append((key, "f", i, path, None if exp or edu else v, exp, edu, source, method, False))
    return spark.createDataFrame(out, schema.CLAIMS)


def merged(df):
    return [r.asDict(True) for r in profiles(df).orderBy("entity_key").collect()]


def test_trust_wins_and_case_corroborates(spark):
    (p,) = merged(claims(spark, [("full_name", "Jane McDonald", "resume", "direct"), ("full_name", "Jane Mcdonald", "ats_json", "mapped")]))
    assert p["full_name"] == "Jane Mcdonald"
    assert p["field_confidence"] == {"full_name": 0.95}
    assert [tuple(x.values()) for x in p["provenance"]] == [("full_name", "ats_json", "mapped")]


def test_same_source_does_not_corroborate(spark):
    (p,) = merged(claims(spark, [("headline", "x", "resume", "direct"), ("headline", "X", "resume", "direct")]))
    assert p["field_confidence"]["headline"] == 0.6


def test_union_is_sorted_and_provenance_complete(spark):
    (p,) = merged(claims(spark, [("emails", "b@x.y", "resume", "regex"), ("emails", "a@x.y", "ats_json", "mapped"), ("emails", "b@x.y", "recruiter_csv", "direct")]))
    assert p["emails"] == ["a@x.y", "b@x.y"]
    assert p["field_confidence"]["emails"] == 0.9
    assert len(p["provenance"]) == 3


def test_objects_take_missing_fields_from_less_trusted(spark):
    (p,) = merged(claims(spark, [
        ("experience", ("Acme", "Dev", "2020-01", None, None), "ats_json", "mapped"), ("experience", ("ACME ", "dev", "2019-01", "2021-01", "did"), "resume", "heuristic"),
        ("experience", ("Globex", "Dev", "2021-05", None, None), "ats_json", "mapped"),
    ]))
    assert p["experience"] == [
        {"company": "Globex", "title": "Dev", "start": "2021-05", "end": None, "summary": None},
        {"company": "Acme", "title": "Dev", "start": "2020-01", "end": "2021-01", "summary": "did"},
    ]
    assert p["field_confidence"]["experience"] == round((0.95 + 0.9) / 2, 4)


def test_order_and_partitioning_do_not_matter(spark):
    rows = [("skills", s, src, "api") for s in ("Go", "Rust", "SQL") for src in ("github", "resume")] + [("headline", "b", "resume", "direct"), ("headline", "a", "resume", "direct")]
    df = claims(spark, rows)
    assert merged(df) == merged(df.orderBy(F.desc("claim_seq")).repartition(3, "claim_seq"))


def test_identity_tiers(spark):
    def tier(*rows, key="e"):
        (p,) = merged(claims(spark, rows, key))
        return p["id_tier"], p["candidate_id"]

    mail, name, phone = ("emails", "a@x.y", "resume", "regex"), ("full_name", "Al B", "resume", "regex"), ("phones", "+1", "resume", "regex")
    assert tier(mail, name) == ("email", tier(mail, key="other")[1])
    assert tier(name, phone) == ("name+phone", tier(phone, name, key="other")[1])
    assert tier(name)[0] == "name+source" and tier(name)[1] != tier(name, key="other")[1]
    assert tier(("headline", "x", "resume", "regex"))[0] == "source-only"
    assert tier(("headline", "x", "resume", "regex"), key=None)[0] == "none"
    assert tier(("headline", "x", "resume", "regex"), key=None)[1] != tier(("headline", "y", "resume", "regex"), key=None)[1]


def test_normalize_drops_and_hints(spark):
    got = normalize(claims(spark, [
        ("phones", "415 555 2671", "resume", "regex"), ("location.country", "USA", "ats_json", "mapped"), ("emails", "nope", "resume", "regex"),
        ("years_experience", "nan", "ats_json", "mapped"), ("years_experience", "9", "ats_json", "mapped"), ("education", (None, " ", None, 1700), "ats_json", "mapped"),
    ]))
    assert sorted((r.path, r.v) for r in got.collect()) == [("location.country", "US"), ("phones", "+14155552671"), ("years_experience", "9.0")]


def test_entities_without_claims_have_empty_profiles(spark):
    (p,) = [r.asDict(True) for r in profiles(claims(spark, []), spark.createDataFrame([("alone",)], "entity_key string")).collect()]
    assert (p["overall_confidence"], p["emails"], p["provenance"], p["id_tier"]) == (0.0, [], [], "source-only")
    assert json.dumps(p["field_confidence"]) == "{}"
