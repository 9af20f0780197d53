"""Claims to one profile an entity: two shuffles, the first combined on the map side.

``grouped`` makes one row for each (entity, path, value key) with its best claim, sources and
provenance; ``profiles`` folds these rows into one record by conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave import schema
from claimweave.functions import scores, text

_EXP, _EDU = ("company", "title", "start", "end", "summary"), ("institution", "degree", "field", "end_year")


def _key() -> Column:
    """What makes claims of one path agree: the folded text of a scalar, the value of a list, the key fields of an object."""
    low = lambda c: F.coalesce(F.lower(text.strip(c.cast("string"))), F.lit(""))
    exp = F.to_json(F.array(low(F.col("exp.company")), low(F.col("exp.title"))))
    edu = F.to_json(F.array(low(F.col("edu.end_year")), low(F.col("edu.degree"))))
    return F.when(F.col("path").isin(*schema.SCALARS), text.fold(F.col("v"))).when(F.col("path") == "experience", exp).when(F.col("path") == "education", edu).otherwise(F.col("v"))


def grouped(claims: DataFrame) -> DataFrame:
    """entity_key, path, key with the best claim, the sources, whether all claims are fuzzy, and the merged object."""
    trust = scores.trust(F.col("source"))
    fuzzy = scores.effective_fuzzy(F.col("method"), F.col("fuzzy"))
    seq = F.struct("file_seq", "claim_seq")
    ranked = F.struct((-trust).alias("trust"), "file_seq", "claim_seq")
    # An object takes each field from its most trusted claim that has it.
    first = lambda of, name: F.min_by(F.col(f"{of}.{name}"), F.when(F.col(f"{of}.{name}").isNotNull(), ranked)).alias(name)
    out = claims.withColumn("key", _key()).groupBy("entity_key", "path", "key").agg(
        F.min(F.struct((-trust).alias("trust"), (-F.length("v")).alias("length"), "source", "file_seq", "claim_seq", "v", "method", fuzzy.alias("fuzzy"))).alias("best"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.bool_and(fuzzy).alias("all_fuzzy"),
        F.min(seq).alias("first"),
        F.collect_set(F.struct(F.col("path").alias("field"), "source", "method")).alias("provenance"),
        *(first("exp", n).alias(f"exp_{n}") for n in _EXP),
        *(first("edu", n).alias(f"edu_{n}") for n in _EDU),
    )
    corroborating = F.size("sources") - 1
    top = -F.col("best.trust")
    points = F.when(F.col("path").isin(*schema.SCALARS), scores.field_points(top, corroborating, F.col("best.fuzzy"))).otherwise(scores.field_points(top, corroborating, F.col("all_fuzzy")))
    return out.withColumn("points", points)


def mean(values: Column) -> Column:
    """Mean of an array of doubles, summed in its order, to four decimals; null if it is empty."""
    return F.when(F.size(values) > 0, scores.round4(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)))


def present(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def overall(confidence: dict[str, Column]) -> Column:
    """Mean of the group confidences by importance, over the groups that have one; 0 if none has."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for group, importance in schema.IMPORTANCE.items():
        c = confidence[group]
        total = total + F.coalesce(F.lit(importance) * c, F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), F.lit(importance)).otherwise(F.lit(0.0))
    return F.when(weight > 0, scores.round4(total / weight)).otherwise(F.lit(0.0))


def identity(entity: Column, best_name: Column, email: Column, phone: Column, signature: Column) -> Column:
    """Struct (id, tier): the first of email, name and phone, name and entity, entity, or the claims themselves."""
    low = F.lower(best_name)
    tiers = (
        ("email", email.isNotNull(), (F.lit("email"), email)),
        ("name+phone", best_name.isNotNull() & phone.isNotNull(), (F.lit("name+phone"), low, phone)),
        ("name+source", best_name.isNotNull() & entity.isNotNull(), (F.lit("name+source"), low, entity)),
        ("source-only", entity.isNotNull(), (F.lit("source"), entity)),
    )
    out = F.struct(text.short_hash(F.lit("anon"), signature).alias("id"), F.lit("none").alias("tier"))
    for tier, holds, parts in reversed(tiers):
        out = F.when(holds, F.struct(text.short_hash(*parts).alias("id"), F.lit(tier).alias("tier"))).otherwise(out)
    return out


def profiles(claims: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One canonical profile an entity, with id_tier and the map field_confidence beside it; of ``entities``
    (entity_key), those without claims have an empty one."""
    if entities is not None:  # a claim of no path and no value stands for the entity
        values = {"path": "", "source": "", "method": "", "fuzzy": False, "file_seq": "", "claim_seq": 0}
        marks = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in claims.schema.fields if f.name != "entity_key"]
        claims = claims.unionByName(entities.select("entity_key", *marks))
    path, points = F.col("path"), F.col("points")
    at = lambda name: path == name
    folded = grouped(claims).groupBy("entity_key").agg(
        # A scalar's value is that of the best claim of all; its agreeing sources are those of the same folded text.
        *(F.min(F.when(at(p), F.struct("best", "points"))).alias(p.replace(".", "_")) for p in schema.SCALARS),
        *(F.sort_array(F.collect_list(F.when(at(p), F.col("key")))).alias(p.replace(".", "_")) for p in schema.LISTS),
        # A list's confidence is that of its most corroborated value, then the most trusted, then the smallest.
        *(F.min(F.when(at(p), F.struct((-F.size("sources")).alias("n"), F.col("best.trust").alias("trust"), "key", "points"))).alias(p.replace(".", "_") + "_top") for p in schema.LISTS),
        F.sort_array(F.collect_list(F.when(at("skills"), F.struct(F.col("key").alias("name"), scores.points(points).alias("confidence"), "sources", F.array_contains("sources", "github").alias("verified_in_code"))))).alias("skills"),
        F.collect_list(F.when(at("experience"), F.struct(*(F.col(f"exp_{n}").alias(n) for n in _EXP), "first", scores.points(points).alias("confidence")))).alias("experience"),
        F.collect_list(F.when(at("education"), F.struct(*(F.col(f"edu_{n}").alias(n) for n in _EDU), "first", scores.points(points).alias("confidence")))).alias("education"),
        # The provenance of a scalar is its winner's alone, of lists and objects that of every claim.
        F.collect_list(F.when(~path.isin("", *schema.SCALARS), F.col("provenance"))).alias("provenance"),
        F.sort_array(F.collect_list(F.when(~at(""), F.struct("path", "key")))).alias("signature"),
    )
    scalar = {p: F.col(p.replace(".", "_")) for p in schema.SCALARS}
    value = {p: c["best"]["v"] for p, c in scalar.items()}
    conf = {p: scores.points(c["points"]) for p, c in scalar.items()}
    listed = {p: scores.points(F.col(p.replace(".", "_") + "_top")["points"]) for p in schema.LISTS}
    by_first = lambda rows: F.array_sort(rows, lambda a, b: F.when(a["first"] < b["first"], F.lit(-1)).when(a["first"] > b["first"], F.lit(1)).otherwise(F.lit(0)))
    confidences = lambda name: mean(F.transform(by_first(F.col(name)), lambda r: r["confidence"]))
    groups = {
        "full_name": conf["full_name"], "headline": conf["headline"], "years_experience": conf["years_experience"],
        "location": mean(present(conf["location.city"], conf["location.region"], conf["location.country"])),
        "links": mean(present(conf["links.linkedin"], conf["links.github"], conf["links.portfolio"], listed["links.other"])),
        "emails": listed["emails"], "phones": listed["phones"],
        "skills": mean(F.transform("skills", lambda s: s["confidence"])), "experience": confidences("experience"), "education": confidences("education"),
    }

    folded = folded.withColumns({f"_c_{g}": c for g, c in groups.items()})
    groups = {g: F.col(f"_c_{g}") for g in groups}

    def latest(rows: Column, *keys: tuple[str, object]) -> Column:
        """Descending by the keys (null as the given value), ties in input order."""

        def order(a: Column, b: Column) -> Column:
            out = F.when(a["first"] < b["first"], F.lit(-1)).when(a["first"] > b["first"], F.lit(1)).otherwise(F.lit(0))
            for name, null in reversed(keys):
                x, y = F.coalesce(a[name], F.lit(null)), F.coalesce(b[name], F.lit(null))
                out = F.when(x > y, F.lit(-1)).when(x < y, F.lit(1)).otherwise(out)
            return out

        return F.array_sort(rows, order)

    won = F.filter(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(p).alias("field"), c["best"]["source"].alias("source"), c["best"]["method"].alias("method"))) for p, c in scalar.items())), lambda x: x.isNotNull())
    quoted = F.array_join(F.transform("signature", lambda s: F.concat(F.lit("('"), s["path"], F.lit("', '"), s["key"], F.lit("')"))), ", ")
    who = identity(F.col("entity_key"), value["full_name"], F.get("emails", F.lit(0)), F.get("phones", F.lit(0)), F.concat(F.lit("["), quoted, F.lit("]")))
    return folded.withColumn("_who", who).select(
        "entity_key",
        F.col("_who.id").alias("candidate_id"),
        value["full_name"].alias("full_name"),
        "emails",
        "phones",
        F.struct(*(value[f"location.{n}"].alias(n) for n in ("city", "region", "country"))).alias("location"),
        F.struct(*(value[f"links.{n}"].alias(n) for n in ("linkedin", "github", "portfolio")), F.col("links_other").alias("other")).alias("links"),
        value["headline"].alias("headline"),
        value["years_experience"].cast("double").alias("years_experience"),
        "skills",
        F.transform(latest(F.col("experience"), ("start", ""), ("company", "")), lambda r: F.struct(*(r[n].alias(n) for n in _EXP))).alias("experience"),
        F.transform(latest(F.col("education"), ("end_year", 0), ("institution", "")), lambda r: F.struct(*(r[n].alias(n) for n in _EDU))).alias("education"),
        F.array_sort(F.array_distinct(F.concat(won, F.flatten("provenance")))).alias("provenance"),
        overall(groups).alias("overall_confidence"),
        F.map_filter(F.create_map(*(x for g, c in groups.items() for x in (F.lit(g), c))), lambda _, c: c.isNotNull()).alias("field_confidence"),
        F.col("_who.tier").alias("id_tier"),
    )
