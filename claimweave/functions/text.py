"""Scalar functions on strings, as Columns: a value that cannot be normalized honestly becomes null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of months, words for an ongoing role, canonical skills with their aliases.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_SHORT = {"sept": 9} | {m[:3]: i for i, m in enumerate(MONTHS, 1)}
ONGOING = ("present", "current", "now", "ongoing", "till date", "to date")
SKILLS = {
    "JavaScript": "js, javascript, ecmascript, java script", "TypeScript": "ts, typescript, type script", "Python": "python, py, python3", "Java": "java",
    "C++": "c++, cpp, cplusplus", "C#": "c#, csharp, c sharp", "Go": "go, golang", "Rust": "rust, rust-lang", "Ruby": "ruby", "PHP": "php", "SQL": "sql",
    "PostgreSQL": "postgres, postgresql, psql", "MySQL": "mysql", "MongoDB": "mongo, mongodb", "Redis": "redis", "React": "react, react.js, reactjs",
    "Node.js": "node, node.js, nodejs", "Django": "django", "Flask": "flask", "FastAPI": "fastapi, fast api", "Kubernetes": "k8s, kubernetes, kube",
    "Docker": "docker", "AWS": "aws, amazon web services", "GCP": "gcp, google cloud, google cloud platform", "Azure": "azure, microsoft azure",
    "Terraform": "terraform, tf", "Machine Learning": "ml, machine learning, machine-learning", "Deep Learning": "dl, deep learning",
    "TensorFlow": "tensorflow, tf2", "PyTorch": "pytorch, torch", "GraphQL": "graphql, gql", "REST": "rest, rest api, restful", "Git": "git",
}
SKILL_ALIASES = {alias: name for name, aliases in SKILLS.items() for alias in aliases.split(", ")}


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x evaluated once however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def mapped(table: dict[str, str | int], key: Column) -> Column:
    """Value of key in a small fixed table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def collapse(x: Column) -> Column:
    """Runs of white space (any of Unicode) to one space, trimmed; empty to null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def fold(x: Column) -> Column:
    """Case-folded, for comparison; the concatenation keeps the optimizer from taking ``upper`` out."""
    return F.lower(F.concat(F.upper(x), F.lit("")))


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first, whatever separates the runs."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda run: F.initcap(F.lower(run))), "")


def email(x: Column) -> Column:
    """Lower-cased address without mailto:, if it has the light shape a@b.c."""
    bare = F.regexp_replace(F.lower(strip(x)), "^mailto:", "")
    return F.when(bare.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), bare)


def month(x: Column) -> Column:
    """yyyy-MM, if year (1900 to 2100) and month are both known; null for ongoing roles, bare years and full dates."""
    iso, flipped, worded, last = r"^(\d{4})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{4})$", r"^([a-z]{3,9})\.?\s+(\d{4})$", r"^(\d{4})\s+([a-z]{3,9})\.?$"
    spelled = MONTH_SHORT | {m: i for i, m in enumerate(MONTHS, 1)}

    def parts(low: Column) -> Column:
        found = lambda pattern, group: F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))
        year = F.coalesce(found(iso, 1), found(flipped, 2), found(worded, 2), found(last, 1)).cast("int")
        which = F.coalesce(found(iso, 2).cast("int"), found(flipped, 1).cast("int"), mapped(spelled, F.coalesce(found(worded, 1), found(last, 2))))
        return F.struct(year.alias("year"), which.alias("month"))

    def shown(p: Column) -> Column:
        return F.when(p["year"].between(1900, 2100) & p["month"].between(1, 12), F.format_string("%04d-%02d", p["year"], p["month"]))

    return let(let(F.lower(strip(x)), parts), shown)


def name(x: Column) -> Column:
    """White space collapsed; re-cased only if it is all upper or all lower case."""

    def cased(t: Column) -> Column:
        uniform = (F.lower(t) != F.upper(t)) & ((t == F.upper(t)) | (t == F.lower(t)))
        return F.when(uniform, title_case(t)).otherwise(t)

    return let(collapse(x), cased)


def skill(x: Column) -> Column:
    """Canonical name of a known alias; else the text, re-cased only if it is all lower case."""

    def named(t: Column) -> Column:
        lower = (F.lower(t) != F.upper(t)) & (t == F.lower(t))
        return F.coalesce(mapped(SKILL_ALIASES, F.lower(t)), F.when(lower, title_case(t)).otherwise(t))

    return let(collapse(x), named)


def number(x: Column) -> Column:
    """Finite double, or null."""
    value = strip(x).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def short_hash(*parts: Column) -> Column:
    """cand_ and 12 hexadecimal digits of the SHA-1 of the parts, joined by bars."""
    return F.concat(F.lit("cand_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))
