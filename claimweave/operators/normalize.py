"""Raw claims to canonical ones: a projection and a filter, and one hint an entity for phones without a calling code;
claims that do not normalize are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import places, text


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df and the columns made, each done once a row: a generator keeps filters on them above it, which would be done with them again below a projection."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def hints(claims: DataFrame) -> DataFrame:
    """hint_key, region: of each entity the first country, in input order, that its claims name; added up on the map side."""
    named = once(claims.where(F.col("path") == "location.country"), region=places.country(F.col("v"))["value"]).where("region is not null")
    return named.groupBy(F.col("entity_key").alias("hint_key")).agg(F.min_by("region", F.struct("file_seq", "claim_seq")).alias("region"))


def normalize(claims: DataFrame) -> DataFrame:
    """claims (schema.CLAIMS) with canonical values. A phone without a calling code takes the region of the
    first country, in input order, that its entity's own claims name; only these phones meet the hints."""
    v, path = F.col("v"), F.col("path")
    bare = F.coalesce((path == "phones") & ~text.strip(v).rlike(r"^\(?\+"), F.lit(False))
    hinted = claims.where(bare).join(hints(claims), F.col("entity_key").eqNullSafe(F.col("hint_key")), "left").drop("hint_key").withColumnRenamed("region", "_region")
    claims = claims.where(~bare).withColumn("_region", F.lit(None).cast("string")).unionByName(hinted)
    claims = once(claims, _country=F.when(path == "location.country", places.country(v)))
    value = (
        F.when(path == "emails", text.email(v))
        .when(path == "phones", places.phone(v, F.col("_region")))
        .when(path == "full_name", text.name(v))
        .when(path == "skills", text.skill(v))
        .when(path == "years_experience", text.number(v).cast("string"))
        .when(path == "location.country", F.col("_country")["value"])
        .when(path.isin("experience", "education"), F.lit(None))
        .otherwise(text.collapse(v))
    )
    exp, edu = F.col("exp"), F.col("edu")
    exp = F.struct(*(text.collapse(exp[f]).alias(f) for f in ("company", "title")), text.month(exp["start"]).alias("start"), text.month(exp["end"]).alias("end"), text.collapse(exp["summary"]).alias("summary"))
    edu = F.struct(*(text.collapse(edu[f]).alias(f) for f in ("institution", "degree", "field")), F.when(edu["end_year"].between(1900, 2100), edu["end_year"]).alias("end_year"))
    out = once(
        claims, _v=F.nullif(value, F.lit("")), _exp=F.when(path == "experience", exp), _edu=F.when(path == "education", edu),
        _fuzzy=F.coalesce("fuzzy", F.lit(False)) | F.coalesce(F.col("_country")["fuzzy"], F.lit(False)),
    )
    some = lambda s, *names: F.when(F.coalesce(*(F.col(s)[n].cast("string") for n in names)).isNotNull(), F.col(s))
    out = out.select(
        "entity_key", "file_seq", "claim_seq", "path", F.col("_v").alias("v"), some("_exp", "company", "title", "start", "end", "summary").alias("exp"),
        some("_edu", "institution", "degree", "field", "end_year").alias("edu"), "source", "method", F.col("_fuzzy").alias("fuzzy"),
    )
    return out.where("v is not null or exp is not null or edu is not null")


def year(x: Column) -> Column:
    """The first four characters as a year, or null."""
    return F.substring(x, 1, 4).try_cast("int")
