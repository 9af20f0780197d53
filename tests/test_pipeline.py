"""Files to records: golden entities, projections, degraded inputs, the command line."""

import hashlib
import json

import pytest

from claimweave.plans import project, runner
from claimweave.sources import files
from tests.samples_data import BO, CHIDI


@pytest.fixture(scope="module")
def results(spark, samples):
    return {r.key: r for r in runner.run_pipeline(spark, [samples])}


def sure(trust, others=0, fuzzy=False):
    """The rule of one field, written out anew: trust of the best source, agreeing ones, and a discount."""
    return round(min(max((trust + 0.05 * min(others, 3)) * (0.9 if fuzzy else 1), 0.05), 0.99), 4)


def test_identity(results):
    parts = {"ada": "email|ada@quill.example", "bo": "name+phone|bo lindqvist|+31205550134", "chidi": "email|chidi@okoro.example", "dana": "email|dana@veres.example"}
    assert {k: r.candidate_id for k, r in results.items()} == {k: "cand_" + hashlib.sha1(p.encode()).hexdigest()[:12] for k, p in parts.items()}


def test_overall_confidence_by_hand(results):
    # bo: the name from one source; the number from two; a guessed country; years and two skills from notes alone.
    parts = [(3, sure(0.9)), (3, sure(0.9, 1)), (1.5, sure(0.9, fuzzy=True)), (1.5, sure(0.35, fuzzy=True)), (1, sure(0.35, fuzzy=True))]
    assert results["bo"].output["overall_confidence"] == round(sum(w * c for w, c in parts) / sum(w for w, _ in parts), 4)
    # chidi: the address from resume and notes, by patterns; the name, a job and skills from the resume; years from notes.
    skills = (sure(0.6, fuzzy=True) + sure(0.6, 1, True)) / 2
    parts = [(3, sure(0.6, 1, True)), (3, sure(0.6, fuzzy=True)), (1.5, sure(0.35, fuzzy=True)), (1, round(skills, 4)), (1.5, sure(0.6, fuzzy=True))]
    assert results["chidi"].output["overall_confidence"] == round(sum(w * c for w, c in parts) / sum(w for w, _ in parts), 4)


def test_five_sources_in_one_record(results):
    ada = results["ada"].output
    assert ada["full_name"] == "Ada QUILL-ROSS" and ada["emails"] == ["ada@quill.example"] and ada["phones"] == ["+442079460018"] and ada["years_experience"] == 12.0
    assert ada["location"] == {"city": "Leeds", "region": "West Yorkshire", "country": "GB"} and ada["headline"] == "Engineer of schedulers and queues."
    assert ada["links"] == {"linkedin": None, "github": "https://code.example/adaq", "portfolio": "https://quill.example", "other": []}
    assert {s["name"]: s["sources"] for s in ada["skills"]} == {
        "Erlang": ["ats_json", "github", "recruiter_notes", "resume"], "Kubernetes": ["ats_json"], "Python": ["ats_json", "github", "recruiter_notes", "resume"], "Terraform": ["resume"],
    }
    assert ada["skills"][0] == {"name": "Erlang", "confidence": sure(0.9, 3), "sources": ["ats_json", "github", "recruiter_notes", "resume"], "verified_in_code": True}
    assert ada["experience"] == [
        {"company": "Pinnace Ltd", "title": "Principal Engineer", "start": "2020-04", "end": None, "summary": "Principal Engineer at Pinnace Ltd Apr 2020 - Present"},
        {"company": "Gannet", "title": "Developer", "start": "2013-09", "end": "2020-03", "summary": None},
    ]
    assert ada["education"][0] == {"institution": "University College", "degree": "BA", "field": None, "end_year": 2012} and len(ada["education"]) == 2
    assert any("[Assessor, batch]" in w for w in results["ada"].warnings)


def test_references_and_projects_do_not_bleed(results):
    dana = results["dana"].output
    assert dana["emails"] == ["dana@veres.example"] and dana["phones"] == ["+15035550139"]
    assert [s["name"] for s in dana["skills"]] == ["Flask", "Java", "Rust", "SQL"]
    assert [e["company"] for e in dana["experience"]] == ["Osprey", "Sandpiper"]
    assert dana["education"] == [{"institution": "Reed College", "degree": "B.A", "field": None, "end_year": 2013}]


def test_degraded_sources_warn(results):
    chidi = results["chidi"]
    assert any("invalid JSON" in w for w in chidi.warnings) and any("empty file" in w for w in chidi.warnings)
    assert chidi.output["emails"] == ["chidi@okoro.example"]
    assert runner.report(list(results.values()))[-1].startswith("4 processed, 2 sources skipped, 0 crashes")


CONFIG = {
    "fields": [
        {"path": "id", "from": "candidate_id", "required": True}, {"path": "mail", "from": "emails[0]", "type": "string", "on_missing": "omit"},
        {"path": "a.b", "from": "location.country", "type": "string"}, {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "lower"}, {"path": "skill_rows", "from": "skills"},
    ], "include_confidence": False, "include_provenance": False,
}


def test_custom_projection(spark, samples):
    out = {r.key: r.output for r in runner.run_pipeline(spark, [samples], project.parse_config(CONFIG))}
    assert "mail" not in out["bo"] and out["ada"]["mail"] == "ada@quill.example"
    assert out["dana"]["a"] == {"b": None} and out["bo"]["a"] == {"b": "NL"}
    assert out["bo"]["skills"][0] == "css"
    assert set(out["bo"]["skill_rows"][0]) == {"name", "verified_in_code"}


def test_missing_required_field_fails_only_its_entity(spark, samples):
    config = project.parse_config({"fields": [{"path": "emails[0]".replace("[0]", ""), "from": "emails[0]", "type": "string", "required": True}]})
    out = {r.key: r for r in runner.run_pipeline(spark, [samples], config)}
    assert out["bo"].output is None and any(w.startswith("projection: ") for w in out["bo"].warnings)
    assert out["ada"].output["emails"] == "ada@quill.example"


def test_type_mismatch_is_an_error(spark, samples):
    config = project.parse_config({"fields": [{"path": "years_experience", "type": "string"}]})
    out = {r.key: r for r in runner.run_pipeline(spark, [samples], config)}
    assert out["ada"].output is None and out["dana"].output is not None


def test_schema_and_config_rules():
    config = project.parse_config({"fields": [{"path": "a", "type": "string", "on_missing": "omit"}, {"path": "b.c", "type": "number"}, {"path": "d", "type": "string", "required": True}], "include_provenance": False})
    built = project.build_schema(config)
    assert built["required"] == ["b", "d"] and built["properties"]["b"]["properties"]["c"] == {"type": ["number", "null"]}
    assert built["properties"]["d"] == {"type": "string"} and "overall_confidence" in built["properties"]
    for bad in ({"fields": [], "on_missing": "x"}, {"fields": [{"path": "a", "on_missing": "x"}]}):
        with pytest.raises(ValueError, match="on_missing"):
            project.parse_config(bad)
    for bad in ("a[0][]", "a..b", "a[x]"):
        with pytest.raises(ValueError, match="path"):
            project.tokens(bad)


def test_values_are_checked_one_by_one(spark, samples):
    config = project.parse_config({"fields": [{"path": "years", "from": "years_experience", "type": "integer"}, {"path": "b", "from": "skills", "type": "string[]"}, {"path": "a", "from": "full_name", "type": "object"}]})
    out = {r.key: r for r in runner.run_pipeline(spark, [samples], config)}
    wrong = [w.split(": ")[-1] for w in out["ada"].warnings if "schema validation" in w]
    assert wrong == ["'a' is not of type 'object'", "'b' is not of type 'string[]'"]  # by path; 12.0 is an integer


def test_command_line(tmp_path, spark, samples):
    entity = tmp_path / "chidi"
    entity.mkdir()
    for name, body in CHIDI.items():
        (entity / name).write_text(body, encoding="utf-8")
    (entity / "photo.png").write_bytes(b"x")
    out = tmp_path / "out.json"
    assert runner.main(["transform", "--inputs", str(entity), "--out", str(out), "--pretty"]) == 0
    assert json.loads(out.read_text())["full_name"] == "Chidi Okoro"
    assert runner.main([]) == 2
    with pytest.raises(FileNotFoundError):
        list(runner.run_pipeline(spark, [str(tmp_path / "absent")]))


def test_large_batches_go_to_a_folder(tmp_path, spark, samples):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"fields": [{"path": "name", "from": "full_name"}, {"path": "mail", "from": "emails[0]", "required": True}]}))
    assert runner.main(["transform", "--inputs", samples, "--config", str(config), "--out", f"{tmp_path}/out/"]) == 1
    records = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/records").collect()]
    assert sorted(r["mail"] for r in records) == ["ada@quill.example", "chidi@okoro.example", "dana@veres.example"]
    lines = [r.line for r in spark.read.parquet(f"{tmp_path}/out/report").collect()]
    assert "error: Bo Lindqvist: projection: required field 'mail' is missing" in lines and len(lines) == 4


def test_logins_are_fetched_into_the_cache(tmp_path, spark):
    for login in ("kim", "lost"):
        (tmp_path / "in" / login).mkdir(parents=True)
        (tmp_path / "in" / login / "github.url").write_text(f"https://code.example/{login}/\n")
    cache = tmp_path / "cache"

    def fetch(login):
        if login == "lost":
            raise OSError("no answer")
        return {"user": {"login": login, "name": "Kim Roe"}, "languages": ["Go"]}

    for how in (fetch, None):  # the second time from the cache
        out = {r.key: r for r in runner.run_pipeline(spark, [str(tmp_path / "in")], cache_dir=str(cache), fetch=how)}
        assert out["kim"].full_name == "Kim Roe" and any("no cached snapshot for lost" in w for w in out["lost"].warnings)
    (cache / "github_lost.json").write_text(json.dumps({"user": {"name": "Found Again"}}))
    assert {r.key: r.full_name for r in runner.run_pipeline(spark, [str(tmp_path / "in")], cache_dir=str(cache))} == {"kim": "Kim Roe", "lost": "Found Again"}
    assert {r.key: r.full_name for r in runner.run_pipeline(spark, [str(tmp_path / "in")], fetch=fetch)} == {"kim": "Kim Roe", "lost": None}


def test_one_entity(tmp_path, spark):
    for name, body in BO.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    (tmp_path / "x.json").write_text("[]")
    profile, warnings = runner.process_entity(spark, "b", [str(tmp_path / n) for n in (*BO, "x.json")])
    assert profile["full_name"] == "Bo Lindqvist" and profile["location"]["country"] == "NL" and warnings == ["ats_json: top-level JSON is not an object in x.json"]


def test_every_file_is_read_in_one_pass(spark, samples):
    claims, _ = files.extract(files.discover(spark, [samples]))
    plan = claims._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") + plan.count("Relation [") <= 2  # the scan, and its listing for files without bytes


def test_results_do_not_depend_on_the_cut(spark, samples, tmp_path, results):
    before = spark.conf.get("spark.checkpoint.dir", None)
    spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}/shared")
    try:
        assert {r.key: r.output for r in runner.run_pipeline(spark, [samples])} == {k: r.output for k, r in results.items()}
    finally:
        spark.conf.unset("spark.checkpoint.dir") if before is None else spark.conf.set("spark.checkpoint.dir", before)
