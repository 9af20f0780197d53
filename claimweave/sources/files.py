"""Input files as rows, and files as claims: one pass over all files, each reader a column that is an array of claims."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave import schema
from claimweave.functions import text
from claimweave.operators.normalize import year

# Key maps of the foreign formats, section headers, labels.
ATS_SCALARS = {
    "candidateName": "full_name", "fullName": "full_name", "emailAddress": "emails", "email": "emails", "mobile": "phones", "phone": "phones",
    "headline": "headline", "summary": "headline", "yearsOfExperience": "years_experience", "locationCity": "location.city",
    "locationRegion": "location.region", "locationState": "location.region", "locationCountry": "location.country",
    "linkedinUrl": "links.linkedin", "githubUrl": "links.github", "portfolioUrl": "links.portfolio",
}
ATS_SKILLS, ATS_EDUCATION, ATS_WORK = ("skillSet", "skills", "skillTags"), ("education", "educationHistory", "schools"), ("workHistory", "experience", "employmentHistory")
EDUCATION_KEYS = {"institution": ("school", "institution"), "degree": ("degree",), "field": ("fieldOfStudy", "major"), "end_year": ("gradYear", "graduationYear", "endYear")}
WORK_KEYS = {"company": ("employer", "company"), "title": ("role", "title"), "start": ("startDate",), "end": ("endDate",), "summary": ("description", "summary")}
CSV_HEADERS = {
    "name": "full_name", "full_name": "full_name", "candidate": "full_name", "candidate_name": "full_name", "email": "emails", "email_address": "emails", "e-mail": "emails",
    "phone": "phones", "phone_number": "phones", "mobile": "phones", "cell": "phones", "current_company": "company", "company": "company", "employer": "company",
    "title": "title", "job_title": "title", "role": "title", "position": "title",
}
SECTIONS = {
    "skills": "skills, technical skills, core skills, technologies, tech stack",
    "experience": "experience, work experience, professional experience, employment, employment history",
    "education": "education, academic background",
    "summary": "summary, profile, objective",
    "projects": "projects, personal projects, selected projects, side projects",
    "references": "references",
}
HEADERS = {name: section for section, names in SECTIONS.items() for name in names.split(", ")}
TIERS = "proficient experienced familiar expert advanced intermediate beginner skilled languages frameworks tools databases technologies libraries".split()
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(\+?\d[\d\s().\-]{7,}\d)"
YEARS = r"(?i)(\d{1,2})\+?\s*(?:years|yrs)\b"
SKILL_CONTEXT = r"(?i)(?:proficient in|skilled in|experience with|expertise in|strong in|knows|good at)\s+([^.\n;]+)"
WHEN = r"(?:[A-Za-z]{3,9}\.?\s+)?\d{4}|\d{1,2}[/-]\d{4}"
RANGE = rf"(?i)^(.*?)({WHEN})\s*(?:-|\x{{2013}}|\x{{2014}}|to)\s*({WHEN}|present|current)"
DEGREE = r"(?i)\b(b\.?s\.?|b\.?a\.?|bachelor|m\.?s\.?|m\.?a\.?|master|mba|ph\.?d\.?|doctorate)\b"
SCHOOL = r"[A-Z][\w.&'\- ]*(?:University|College|Institute|School)"
# A CSV cell: quoted (to the end if its quote is never closed) or not; a record of them. No step goes back or recurs.
CELL = r'(?>"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)|[^,\r\n]*+)'
RECORD = rf"((?:{CELL},)*+{CELL})(?:\r\n|\r|\n|\z)"
QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'


def discover(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """entity_key, file_seq, file, path, content. A directory of directories has an entity in each; a directory of
    files is one; files given one by one are the entity "candidate". Files are in the order of their names, which is
    what file_seq holds: nothing is numbered, so no content is shuffled."""
    context, found = spark._jvm.org.apache.hadoop.fs, None
    single = []
    for name in inputs:
        path = context.Path(name)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            raise FileNotFoundError(name)
        if store.getFileStatus(path).isFile():
            single.append(name)
            continue
        nested = any(s.isDirectory() for s in store.listStatus(path))
        read = spark.read.format("binaryFile").load(f"{name.rstrip('/')}/*/*" if nested else name)
        key = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
        rows = read.select(F.url_decode(key).alias("entity_key"), "path", "content")
        found = rows if found is None else found.unionByName(rows)
    if single:
        rows = spark.read.format("binaryFile").load(single).select(F.lit("candidate").alias("entity_key"), "path", "content")
        found = rows if found is None else found.unionByName(rows)
    # The scan passes over files without bytes; they are inputs too, and named by the listing that the scan itself holds on the driver.
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string")
    key = F.lit("candidate") if found is None or single and len(single) == len(inputs) else F.url_decode(F.substring_index(F.substring_index("path", "/", -2), "/", 1))
    plain = F.regexp_replace(F.url_decode("path"), "^([A-Za-z0-9]+):/+", "$1:/").alias("plain")  # the listing and the scan write URIs differently
    empty = listed.select("path", plain).join(found.select(plain), "plain", "left_anti").select(key.alias("entity_key"), "path", F.lit(b"").alias("content"))
    found = found.unionByName(empty)
    found = found.withColumn("file", F.url_decode(F.substring_index("path", "/", -1)))
    return found.withColumn("file_seq", F.col("file"))


def detect(file: Column) -> Column:
    """Source of a file by its name, or null."""
    low = F.lower(file)
    github = low.rlike(r"^(github|gh\.).*\.(json|url|txt)$")
    return (
        F.when(low.endswith(".csv"), "recruiter_csv").when(github, "github").when(low.endswith(".json"), "ats_json")
        .when(low.rlike(r"\.(pdf|docx)$") | low.startswith("resume."), "resume").when(low.endswith(".txt"), "recruiter_notes")
    )


_CLAIM = f"struct<claim_seq: int, path: string, v: string, exp: {schema.EXPERIENCE}, edu: {schema.EDUCATION}, method: string>"


def _none() -> Column:
    return F.array().cast(f"array<{_CLAIM}>")


def _claim(seq: Column, path: Column | str, v: Column | None, method: Column | str, exp: Column | None = None, edu: Column | None = None) -> Column:
    null, text_of = F.lit(None), lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        seq.cast("int").alias("claim_seq"), text_of(path).alias("path"), (null if v is None else v).cast("string").alias("v"), (null if exp is None else exp).cast(schema.EXPERIENCE).alias("exp"),
        (null if edu is None else edu).cast(schema.EDUCATION).alias("edu"), text_of(method).alias("method"),
    ).cast(_CLAIM)


def _some(x: Column) -> Column:
    """x, or null if it is empty; evaluated once."""
    return text.let(x, lambda v: F.when(v != "", v))


def _blank(x: Column) -> Column:
    return x.isNull() | (text.strip(x) == "")


def _lines(body: Column) -> Column:
    """Records of a CSV text; a line break inside quotes does not end one."""
    return F.filter(F.regexp_extract_all(F.regexp_replace(body, "^\ufeff", ""), F.lit(RECORD), F.lit(1)), lambda x: x != "")


def _cells(line: Column) -> Column:
    """Cells of a record, of any number; line breaks in quotes are dropped."""
    plain_of = lambda x: F.concat(F.replace(F.regexp_extract(x, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, QUOTED, 2))
    value = lambda x: F.when(x.startswith('"'), F.regexp_replace(plain_of(x), r"[\r\n]", "")).otherwise(x)
    found = F.regexp_extract_all(line, F.lit(rf"({CELL})(?:,|\z)"), F.lit(1))
    # The end of the text is matched once more after a last cell that is not empty.
    return text.let(found, lambda x: F.transform(F.when(line.endswith(",") | (F.size(x) < 2), x).otherwise(F.slice(x, F.lit(1), F.size(x) - 1)), value))


def csv_claims(body: Column) -> Column:
    """Claims of the first data row; company and title are one experience."""

    def of(row: Column) -> Column:
        each = F.zip_with(row["head"], row["cells"], lambda h, c: F.struct(text.mapped(CSV_HEADERS, F.lower(text.strip(h))).alias("path"), text.strip(c).alias("v")))
        each = F.filter(F.transform(each, lambda c, i: F.struct(i.alias("at"), c["path"].alias("path"), c["v"].alias("v"))), lambda c: c["path"].isNotNull() & (c["v"] != ""))
        return text.let(each, lambda found: claims(found, F.size(row["head"])))

    def claims(found: Column, cells: Column) -> Column:
        last = lambda name: F.try_element_at(F.filter(found, lambda c: c["path"] == name), F.lit(-1))["v"]
        none, job = F.lit(None).cast("string"), lambda c: c["path"].isin("company", "title")
        exp = F.struct(last("company").alias("company"), last("title").alias("title"), none.alias("start"), none.alias("end"), none.alias("summary"))
        plain = F.transform(F.filter(found, lambda c: ~job(c)), lambda c: _claim(c["at"], c["path"], c["v"], "direct"))
        return F.concat(plain, F.when(F.exists(found, job), F.array(_claim(cells, "experience", None, "direct", exp=exp))).otherwise(_none()))

    two = lambda lines: F.when(F.size(lines) > 1, text.let(F.struct(_cells(F.get(lines, F.lit(0))).alias("head"), _cells(F.get(lines, F.lit(1))).alias("cells")), of)).otherwise(_none())
    return text.let(_lines(body), two)


def csv_warning(body: Column) -> Column:
    def said(n: Column) -> Column:
        return F.when(_blank(body), "empty file").when(n < 2, "header but no data rows in").when(n > 2, F.concat((n - 1).cast("string"), F.lit(" rows; using the first only in")))

    return text.let(F.coalesce(F.size(_lines(body)), F.lit(0)), said)


def ats_claims(body: Column) -> Column:
    """Claims of an object with foreign keys."""

    def one(entry: Column, at: Column) -> Column:
        k, value, seq = entry["key"], entry["value"], at * 1000

        def scalar(path: Column) -> Column:
            # A list in a scalar's place counts as its elements.
            listed = F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), F.array(value))
            each = F.transform(listed, lambda v, i: _claim(seq + i, path, v, "mapped"))
            return F.when(path.isNotNull() & value.isNotNull() & ~value.isin("", "[]"), F.filter(each, lambda c: c["v"].isNotNull() & (c["v"] != ""))).otherwise(_none())

        kinds = F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]|\\.)*"|[^\s,\[\]"]+'), F.lit(0))
        skill = F.zip_with(F.from_json(value, "array<string>"), kinds, lambda v, kind: F.when(kind.startswith('"') & ~_blank(v), text.strip(v)))
        skill = F.filter(F.transform(skill, lambda v, i: _claim(seq + i, "skills", v, "mapped")), lambda c: c["v"].isNotNull())

        def objects(fields: dict[str, tuple[str, ...]], make: Callable[[dict[str, Column], Column], Column]) -> Column:
            own = lambda item, names: F.try_element_at(F.filter(F.map_entries(item), lambda e: e["key"].isin(*names) & e["value"].isNotNull() & (e["value"] != "")), F.lit(-1))["value"]
            got = F.transform(F.from_json(value, "array<map<string,string>>"), lambda item, i: F.struct(i.alias("i"), *(own(item, names).alias(f) for f, names in fields.items())))
            some = F.filter(got, lambda g: F.coalesce(*(g[f] for f in fields)).isNotNull())
            return F.transform(some, lambda g: make({f: g[f] for f in fields}, seq + g["i"]))

        work = objects(WORK_KEYS, lambda g, s: _claim(s, "experience", None, "mapped", exp=F.struct(*(c.alias(f) for f, c in g.items()))))
        school = objects(EDUCATION_KEYS, lambda g, s: _claim(s, "education", None, "mapped", edu=F.struct(*((year(c) if f == "end_year" else c).alias(f) for f, c in g.items()))))
        parts = (text.let(text.mapped(ATS_SCALARS, k), scalar), *(F.coalesce(F.when(k.isin(*names), found), _none()) for names, found in ((ATS_SKILLS, skill), (ATS_WORK, work), (ATS_EDUCATION, school))))
        return F.concat(*parts)

    return F.coalesce(F.flatten(F.transform(F.map_entries(F.from_json(body, "map<string,string>")), one)), _none())


def ats_warning(body: Column) -> Column:
    known = [*ATS_SCALARS, *ATS_SKILLS, *ATS_EDUCATION, *ATS_WORK]

    def said(object_: Column) -> Column:
        unmapped = F.array_sort(F.filter(F.map_keys(object_), lambda k: ~k.isin(*known)))
        return (
            F.when(_blank(body), "empty file").when(object_.isNull() & F.try_parse_json(body).isNotNull(), "top-level JSON is not an object in").when(object_.isNull(), "invalid JSON in")
            .when(F.size(unmapped) > 0, F.concat(F.lit("ignored unmapped fields ["), F.array_join(unmapped, ", "), F.lit("] in")))
        )

    return text.let(F.from_json(body, "map<string,string>"), said)


_SNAPSHOT = "user struct<login: string, name: string, bio: string, location: string, blog: string, html_url: string>, languages array<string>"


def login_of(body: Column) -> Column:
    """The login that the first line of a file names, plainly or as the end of an address."""
    line = F.regexp_replace(text.strip(F.get(F.split(text.strip(body), r"\r\n|\r|\n"), F.lit(0))), "/+$", "")
    return F.substring_index(line, "/", -1)


def _data(snapshot: Column) -> Column:
    object_ = F.try_parse_json(snapshot).isNotNull() & text.strip(snapshot).startswith("{")
    return F.when(object_, F.from_json(snapshot, _SNAPSHOT))


def github_claims(snapshot: Column) -> Column:
    """Claims of an API snapshot."""

    def of(data: Column) -> Column:
        user = data["user"]
        parts = F.filter(F.transform(F.split(user["location"], ","), text.strip), lambda p: p != "")
        cells = (
            ("full_name", user["name"], "api"), ("headline", user["bio"], "api"), ("links.github", user["html_url"], "api"), ("links.portfolio", user["blog"], "api"),
            ("location.city", F.get(parts, F.lit(0)), "regex"), ("location.country", F.try_element_at(parts, F.lit(-1)), "regex"),
        )
        each = F.filter(F.array(*(_claim(F.lit(i), p, v, m) for i, (p, v, m) in enumerate(cells))), lambda c: c["v"].isNotNull() & (c["v"] != ""))
        languages = F.transform(data["languages"], lambda v, i: _claim(i + 100, "skills", F.when(~_blank(v), text.strip(v)), "api"))
        return F.concat(each, F.coalesce(F.filter(languages, lambda c: c["v"].isNotNull()), _none()))

    return text.let(_data(snapshot), lambda data: F.when(data.isNotNull(), of(data)).otherwise(_none()))


def github_warning(direct: Column, login: Column, snapshot: Column) -> Column:
    return F.when(~direct & _blank(login), "no username/url in").when(~direct & snapshot.isNull(), F.concat(F.lit("no cached snapshot for "), login, F.lit(" of"))).when(_data(snapshot).isNull(), "bad fixture")


def _contacts(body: Column) -> Column:
    """Distinct addresses and numbers of a text, in order."""
    return F.concat(
        F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(EMAIL), F.lit(0))), lambda v, i: _claim(i, "emails", v, "regex")),
        F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(PHONE), F.lit(1))), lambda v, i: _claim(i + 10_000, "phones", text.strip(v), "regex")),
    )


def notes_claims(body: Column) -> Column:
    """Free text: contacts, the first mention of years, and skills after a phrase that announces them."""
    years = F.regexp_extract(body, YEARS, 1)
    found = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(SKILL_CONTEXT), F.lit(1)), lambda m: F.split(m, "[,/]| and ")))
    skills = F.transform(found, lambda t, i: _claim(i + 30_000, "skills", F.regexp_replace(t, r"^[ \t.]+|[ \t.]+$", ""), "regex"))
    skills = F.filter(skills, lambda c: (c["v"] != "") & (F.length(c["v"]) <= 40))
    some = F.when(years != "", F.array(_claim(F.lit(20_000), "years_experience", years.cast("int"), "regex"))).otherwise(_none())
    return F.when(_blank(body), _none()).otherwise(F.concat(_contacts(body), some, skills))


def _section(line: Column) -> Column:
    bare = F.lower(F.regexp_replace(text.strip(line), ":+$", ""))
    return F.when(F.length(text.strip(line)) <= 40, text.mapped(HEADERS, bare))


def sections(lines: Column) -> Column:
    """Lines as (at, line, header, section): each stands in the section of the last header above it; a header in its own."""

    def filled(rows: Column) -> Column:
        heads = F.filter(rows, lambda r: r["header"].isNotNull())
        return text.let(heads, lambda h: F.transform(rows, lambda r: F.struct(
            r["at"].alias("at"), r["line"].alias("line"), r["header"].alias("header"), F.try_element_at(F.filter(h, lambda x: x["at"] <= r["at"]), F.lit(-1))["header"].alias("section"),
        )))

    return text.let(F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line"), _section(line).alias("header"))), filled)


def resume_claims(body: Column) -> Column:
    """Prose with section headers. Contacts come from outside references and projects; the rest is heuristic."""
    trim = lambda x: F.regexp_replace(x, "^[ \t\\-•]+|[ \t\\-•]+$", "")

    def job(line: Column, at: Column) -> Column:
        head = F.regexp_replace(F.regexp_extract(line, RANGE, 1), "^[ \t\\-–—,]+|[ \t\\-–—,]+$", "")
        return text.let(F.struct(head.alias("head"), F.regexp_extract(line, RANGE, 3).alias("end")), lambda found: made(line, at, found["head"], found["end"]))

    def made(line: Column, at: Column, head: Column, end: Column) -> Column:
        company, title = F.nullif(head, F.lit("")), F.lit(None).cast("string")
        for sep in (" @ ", ", ", " at ", " - ", " – ", " — "):  # the last one tried first
            where = F.instr(head, sep)
            left, right = F.nullif(text.strip(head.substr(F.lit(1), where - 1)), F.lit("")), F.nullif(text.strip(head.substr(where + len(sep), F.length(head))), F.lit(""))
            company, title = F.when(where > 0, right if sep == " at " else left).otherwise(company), F.when(where > 0, left if sep == " at " else right).otherwise(title)
        exp = F.struct(company.alias("company"), title.alias("title"), F.regexp_extract(line, RANGE, 2).alias("start"), F.when(~F.lower(end).isin("present", "current"), end).alias("end"), line.alias("summary"))
        return _claim(1_000_000 + at, "experience", None, "heuristic", exp=exp)

    def school(line: Column, at: Column) -> Column:
        some = lambda pattern: _some(F.regexp_extract(line, pattern, 0))
        edu = F.struct(_some(text.strip(F.regexp_extract(line, SCHOOL, 0))).alias("institution"), some(DEGREE).alias("degree"), F.lit(None).cast("string").alias("field"), some(r"\b(19|20)\d{2}\b").cast("int").alias("end_year"))
        return _claim(2_000_000 + at, "education", None, "heuristic", edu=edu)

    def of(rows: Column) -> Column:
        return text.let(F.filter(rows, lambda r: r["header"].isNull()), lambda plain: parts(rows, plain))

    def parts(rows: Column, plain: Column) -> Column:
        inside = lambda name: F.filter(plain, lambda r: r["section"] == name)
        joined = lambda some: F.array_join(F.transform(some, lambda r: r["line"]), "\n")
        own = joined(F.filter(plain, lambda r: r["section"].isNull() | ~r["section"].isin("projects", "references")))
        bare = lambda r: text.strip(r["line"])
        person = F.filter(F.slice(rows, 1, 6), lambda r: r["header"].isNull() & ~bare(r).rlike(r"[@\d]") & bare(r).rlike(r"^[A-Za-z.\-']+(\s+[A-Za-z.\-']+){1,3}$") & ~bare(r).rlike(r"(^|\s)[a-z]"))
        tokens = F.flatten(F.transform(inside("skills"), lambda r: F.transform(F.split(r["line"], "[,;:•|/]+"), lambda t, i: _claim(30_000 + r["at"] * 100 + i, "skills", trim(t), "regex"))))
        skills = F.filter(tokens, lambda c: (c["v"] != "") & (F.length(c["v"]) <= 40) & ~F.lower(c["v"]).isin(*TIERS))
        jobs = F.filter(F.transform(inside("experience"), lambda r: F.struct(r["at"].alias("at"), trim(r["line"]).alias("line"))), lambda r: r["line"].rlike(RANGE))
        schools = F.transform(inside("education"), lambda r: text.let(trim(r["line"]), lambda line: school(line, r["at"])))
        about = F.substring(text.collapse(joined(inside("summary"))), 1, 200)
        return F.concat(
            text.let(own, _contacts),
            F.transform(F.slice(person, 1, 1), lambda r: _claim(F.lit(20_000), "full_name", bare(r), "heuristic")),
            skills,
            F.transform(jobs, lambda r: job(r["line"], r["at"])),
            F.filter(schools, lambda c: c["edu"]["end_year"].isNotNull() | c["edu"]["degree"].isNotNull()),
            F.filter(F.transform(F.array(about), lambda v: _claim(F.lit(3_000_000), "headline", v, "heuristic")), lambda c: c["v"].isNotNull()),
        )

    lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.when(_blank(body), _none()).otherwise(text.let(sections(lines), of))


def _readable(file: Column) -> Column:
    return F.lower(file).rlike(r"\.(txt|md|pdf|docx)$")


def resume_warning(file: Column, body: Column) -> Column:
    return F.when(~_readable(file), "unsupported resume type").when(_blank(body), "no extractable text in")


def _read(files: DataFrame, source: str, claims: Column, warning: Column) -> tuple[DataFrame, DataFrame]:
    """Claims and warnings of files (entity_key, file_seq, file) that are all of one source."""
    return both(files.select("entity_key", "file_seq", "file", F.lit(source).alias("source"), claims.alias("claims"), F.concat(F.lit(f"{source}: "), warning, F.lit(" "), F.col("file")).alias("warning")))


def both(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and warnings of ``read``. Both are generated so that no filter on them can move below what makes them, which would be done twice."""
    found = read.select("entity_key", "file_seq", "source", F.inline_outer("claims")).where("claim_seq is not null")
    found = found.select("entity_key", "file_seq", "claim_seq", "path", "v", "exp", "edu", "source", "method", F.lit(False).alias("fuzzy"))
    said = read.select("entity_key", "file_seq", "file", F.explode(F.array("warning")).alias("warning"))
    return found, said.where("warning is not null")


def csv(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and warnings of CSV files (entity_key, file_seq, file, text)."""
    return _read(files, "recruiter_csv", csv_claims(F.col("text")), csv_warning(F.col("text")))


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


_PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/([^\s/<>\[\]()]+)\s+[\d.]+\s+Tf\b", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _pdf_streams(data: bytes) -> Iterator[bytes]:
    """Contents of all streams, inflated where they are packed."""
    for raw in re.findall(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        try:
            yield zlib.decompressobj().decompress(raw)
        except zlib.error:
            yield raw


def _pdf_codes(stream: bytes) -> dict[bytes, str]:
    """Characters by code, of a stream that maps the codes of a font to Unicode."""
    codes: dict[bytes, str] = {}
    text = lambda digits: bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            codes[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = int(to, 16)
            for i in range(min(int(high, 16) - int(low, 16) + 1, 65536)):
                codes[(int(low, 16) + i).to_bytes(len(low) // 2, "big")] = text(f"{first + i:0{len(to)}x}".encode())
    return codes


def pdf_text(data: bytes) -> str:
    """Text of PDF files: shown strings of the content streams, literal or in hexadecimal digits, a line for each text
    position. Codes of fonts that map them to Unicode are read through those maps; other codes as Latin-1."""
    streams = list(_pdf_streams(data))
    codes: dict[bytes, str] = {}
    for stream in streams:
        codes |= _pdf_codes(stream)
    wide = 2 if any(len(c) == 2 for c in codes) else 1
    out = []
    for content in streams:
        if b"beginbf" in content or not re.search(rb"\b(?:Tj|TJ)\b", content):
            continue
        for line in re.split(rb"\b(?:Td|TD|Tm)\b|\bT\*", content):
            shown = ""
            for found in _PDF_STRING.finditer(line):
                if found[1] is not None:
                    continue
                if found[0][:1] == b"<":
                    digits = re.sub(rb"\s", b"", found[0][1:-1])
                    raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                else:
                    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), found[0][1:-1], flags=re.S)
                pieces = [raw[i : i + wide] for i in range(0, len(raw), wide)]
                shown += "".join(codes[p] for p in pieces) if codes and all(p in codes for p in pieces) else raw.decode("latin-1")
            if shown:
                out.append(shown)
    return "\n".join(out)


def _document(file: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Text of DOCX and PDF files, or what went wrong; null contents are passed over."""
    texts, bad = [], []
    for name, data in zip(file, content, strict=True):
        found = problem = None
        if data is not None:
            try:
                found = docx_text(bytes(data)) if name.lower().endswith(".docx") else pdf_text(bytes(data))
            except Exception as e:  # one bad file must not fail the batch
                problem = type(e).__name__
        texts.append(found)
        bad.append(problem)
    return pd.DataFrame({"text": texts, "problem": bad})


def read(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """entity_key, file_seq, file, source, claims, warning of every file, in one pass; a file that cannot be read gives a
    warning, and no more. cache: snapshots (login, text) for files that name a login."""
    low, source = F.lower("file"), F.col("source")
    rows = files.withColumn("source", detect(F.col("file")))
    packed = (source == "resume") & low.rlike(r"\.(pdf|docx)$")
    rows = rows.withColumn("packed", F.coalesce(packed, F.lit(False)))
    rows = rows.withColumn("document", F.pandas_udf(_document, "text string, problem string")("file", F.when(F.col("packed"), F.col("content"))))
    rows = rows.withColumn("text", F.when(F.col("packed"), F.col("document.text")).otherwise(F.col("content").cast("string")))
    named = (source == "github") & ~low.endswith(".json")
    rows = rows.withColumn("login", F.when(named, login_of(F.col("text"))))
    if cache is None:
        rows = rows.withColumn("cached", F.lit(None).cast("string"))
    else:
        # Files without a login have a key each, so that they do not meet in one task.
        key = F.coalesce("login", F.concat(F.lit("/"), F.xxhash64("entity_key", "file").cast("string")))
        rows = rows.withColumn("key", key).join(cache.select(F.col("login").alias("key"), F.col("text").alias("cached")), "key", "left").drop("key")
    body = F.col("text")
    snapshot = F.when(named, F.col("cached")).otherwise(body)
    claims, said = F, F
    for name, found, warning in (
        ("recruiter_csv", csv_claims(body), csv_warning(body)), ("ats_json", ats_claims(body), ats_warning(body)), ("github", github_claims(snapshot), github_warning(~named, F.col("login"), snapshot)),
        ("recruiter_notes", notes_claims(body), F.when(_blank(body), "empty file")), ("resume", F.when(_readable(F.col("file")), resume_claims(body)).otherwise(_none()), resume_warning(F.col("file"), body)),
    ):
        claims, said = claims.when(source == name, found), said.when(source == name, F.concat(F.lit(f"{name}: "), warning, F.lit(" "), F.col("file")))
    broken = F.concat(F.lit("resume: failed to read "), F.col("file"), F.lit(" ("), F.col("document.problem"), F.lit(")"))
    said = F.when(source.isNull(), F.concat(F.lit("ingest: skipped unrecognized file "), "file")).when(F.col("document.problem").isNotNull(), broken).otherwise(said)
    return rows.select("entity_key", "file_seq", "file", "source", F.coalesce(claims, _none()).alias("claims"), said.alias("warning"))


def extract(files: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims and warnings of all files."""
    return both(read(files, cache))
