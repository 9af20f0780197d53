"""Countries and phone numbers, as Columns."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import let, mapped, strip

# Informal spellings, and words that may stand before a country's name.
COUNTRY_ALIASES = {
    "usa": "US", "u.s": "US", "u.s.a": "US", "united states of america": "US", "uk": "GB", "u.k": "GB", "britain": "GB", "great britain": "GB", "england": "GB",
    "south korea": "KR", "korea": "KR", "north korea": "KP", "russia": "RU", "uae": "AE", "ksa": "SA", "ivory coast": "CI", "czech": "CZ",
}
BEFORE = r"^(the |kingdom of the |kingdom of |republic of the |republic of )+"

# Region, calling code, trunk prefix, pattern of the national number (public numbering plans).
PHONE_PLANS = (
    ("US", "1", "1", r"[2-9]\d{2}[2-9]\d{6}"), ("CA", "1", "1", r"[2-9]\d{2}[2-9]\d{6}"), ("NL", "31", "0", r"[1-9]\d{8}"), ("BE", "32", "0", r"[1-9]\d{7,8}"),
    ("FR", "33", "0", r"[1-9]\d{8}"), ("ES", "34", "", r"[6-9]\d{8}"), ("IT", "39", "", r"0\d{5,10}|3\d{8,9}"), ("CH", "41", "0", r"[2-9]\d{8}"),
    ("AT", "43", "0", r"[1-9]\d{5,12}"), ("GB", "44", "0", r"1\d{8,9}|[2378]\d{9}"), ("DK", "45", "", r"[2-9]\d{7}"), ("SE", "46", "0", r"[1-9]\d{6,8}"),
    ("NO", "47", "", r"[2-9]\d{7}"), ("PL", "48", "", r"[1-9]\d{8}"), ("DE", "49", "0", r"[1-9]\d{5,10}"), ("MX", "52", "", r"[2-9]\d{9}"),
    ("BR", "55", "0", r"[1-9]\d{9,10}"), ("AU", "61", "0", r"[23478]\d{8}"), ("SG", "65", "", r"[3689]\d{7}"), ("JP", "81", "0", r"[1-9]\d{8,9}"),
    ("CN", "86", "0", r"1[3-9]\d{9}|[2-9]\d{8,9}"), ("IN", "91", "0", r"[1-9]\d{9}"), ("PT", "351", "", r"[29]\d{8}"), ("IE", "353", "0", r"[1-9]\d{6,8}"),
)


# Fixed values (ITU E.164): calling codes of two digits. 1 and 7 stand alone; other codes have three digits, and those of 210, 28, 83, 89 and 99 are not assigned.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def foreign_number() -> str:
    """Pattern of a number with a calling code that no plan here has: a code that may be assigned, and eight to fifteen digits in all."""
    known = {code for _, code, _, _ in PHONE_PLANS}
    all_two = TWO_DIGIT_CODES.split()
    two, taken = [c for c in all_two if c not in known], [*all_two, *(c for c in known if len(c) == 3), "210", "28", "83", "89", "99"]
    return rf"7[3-9]\d{{9}}|(?:{'|'.join(two)})[1-9]\d{{5,12}}|(?!{'|'.join(sorted(taken))})[2-9]\d\d[1-9]\d{{4,11}}"


def phone(x: Column, region: Column) -> Column:
    """E.164 form of a number that fits the plan of its calling code, or, without one, that of the region; else null.
    Numbers of calling codes without a plan here are checked for the code and the length alone."""

    def parts(text: Column) -> Column:
        return F.struct(
            F.regexp_replace(F.regexp_replace(text, r"(?i)\s*(ext\.?|x|#)\s*\d+$", ""), r"[^0-9]", "").alias("digits"),
            text.rlike(r"^[+(]?[0-9\s().\-/+]+((?i)\s*(ext\.?|x|#)\s*\d+)?$").alias("plain"),
            (text.startswith("+") | text.startswith("(+")).alias("full"),
        )

    def planned(p: Column) -> Column:
        digits = p["digits"]
        out = F.when(p["full"] & digits.rlike(f"^({foreign_number()})$"), F.concat(F.lit("+"), digits))
        for where, code, trunk, pattern in reversed(PHONE_PLANS):
            foreign = F.substring(digits, len(code) + 1, 20)
            home = F.regexp_replace(digits, f"^{trunk}(?=({pattern})$)", "") if trunk else digits
            out = F.when(p["full"] & digits.startswith(code) & foreign.rlike(f"^({pattern})$"), F.concat(F.lit(f"+{code}"), foreign)).when(
                ~p["full"] & (region == where) & home.rlike(f"^({pattern})$"), F.concat(F.lit(f"+{code}"), home)
            ).otherwise(out)
        return F.when(p["plain"], out)

    return let(let(strip(x), parts), planned)


@lru_cache(maxsize=1)
def _countries() -> tuple[tuple[str, str, str], ...]:
    """(two letters, three letters, English name) of every ISO 3166 country, from the JVM's locale data."""
    locale = SparkSession.active()._jvm.java.util.Locale
    out = []
    for code in locale.getISOCountries():
        here = locale("", code)
        out.append((code, here.getISO3Country(), here.getDisplayCountry(locale.ENGLISH)))
    return tuple(sorted(out))


def country(x: Column) -> Column:
    """Struct (value: two letters or null, fuzzy): alias, code, exact name, else a name that holds the text."""
    exact = {c[0].lower(): c[0] for c in _countries()} | {c[1].lower(): c[0] for c in _countries()} | {c[2].lower(): c[0] for c in _countries()} | COUNTRY_ALIASES
    names = F.from_json(F.lit(json.dumps([{"name": n.lower(), "code": c} for c, _, n in _countries()])), "array<struct<name: string, code: string>>")

    def nearest(bare: Column) -> Column:
        near = F.transform(F.filter(names, lambda c: c["name"].contains(bare)), lambda c: F.struct(F.instr(c["name"], bare).alias("at"), c["code"].alias("code")))
        return F.when(F.length(bare) > 0, F.get(F.array_sort(near), F.lit(0))["code"])

    def either(p: Column) -> Column:
        return F.struct(F.coalesce(p["exact"], p["near"]).alias("value"), (p["exact"].isNull() & p["near"].isNotNull()).alias("fuzzy"))

    def both(low: Column) -> Column:
        found = mapped(exact, low)
        return F.struct(found.alias("exact"), F.when(found.isNull(), let(F.regexp_replace(low, BEFORE, ""), nearest)).alias("near"))

    return let(let(F.regexp_replace(F.lower(strip(x)), r"\.+$", ""), both), either)
