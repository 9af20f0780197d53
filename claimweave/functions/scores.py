"""Confidence arithmetic, exact to four decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave import schema
from claimweave.functions.text import let, mapped


def trust(source: Column) -> Column:
    """Trust of a source, in ten-thousandths."""
    return F.coalesce(mapped(schema.TRUST, source), F.lit(schema.UNKNOWN_TRUST))


def effective_fuzzy(method: Column, fuzzy: Column) -> Column:
    return F.coalesce(fuzzy, F.lit(False)) | F.coalesce(method.isin(*schema.FUZZY_METHODS), F.lit(False))


def field_points(trust_: Column, corroborating: Column, fuzzy: Column) -> Column:
    """Confidence of a field, as whole ten-thousandths: trust and corroboration, discounted if fuzzy, within bounds."""
    raw = trust_ + schema.STEP * F.least(F.greatest(corroborating, F.lit(0)), F.lit(schema.CAP))
    return F.greatest(F.least(F.when(fuzzy, (raw * 9 / 10).cast("int")).otherwise(raw), F.lit(schema.HIGH)), F.lit(schema.LOW)).cast("int")


def points(p: Column) -> Column:
    return p / F.lit(10000.0)


def round4(x: Column) -> Column:
    """x to four decimals, rounded as the decimal value of the double demands (halves of the exact product to even).

    The product with 10000 is split by Veltkamp's method, so that its rounding error is known exactly."""

    def parts(x: Column) -> Column:
        c = x * F.lit(134217729.0)
        high = c - (c - x)
        scaled = x * F.lit(1e4)
        return F.struct(scaled.alias("scaled"), ((high * F.lit(1e4) - scaled) + (x - high) * F.lit(1e4)).alias("err"), F.floor(scaled).cast("double").alias("n"))

    def rounded(p: Column) -> Column:
        d, n, err = (p["scaled"] - p["n"]) - F.lit(0.5), p["n"], p["err"]
        even = F.when(F.pmod(n, F.lit(2.0)) == 0, n).otherwise(n + 1)
        return F.when((d > 0) | ((d == 0) & (err > 0)), n + 1).when((d < 0) | (err < 0), n).otherwise(even) / F.lit(1e4)

    return let(let(x, parts), rounded)
