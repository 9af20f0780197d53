"""A projection config compiled to one select: output columns, errors, and JSON; nothing is done per entity."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions import places, text

POLICIES = ("null", "omit", "error")
# The declared types, as JSON Schema.
TYPES = {
    "string": {"type": "string"}, "string[]": {"type": "array", "items": {"type": "string"}}, "number": {"type": "number"}, "integer": {"type": "integer"},
    "boolean": {"type": "boolean"}, "object": {"type": "object"}, "object[]": {"type": "array", "items": {"type": "object"}}, "any": {},
}
FITS = {
    "string": ("string",), "number": ("double", "int", "bigint", "float"), "integer": ("int", "bigint"), "boolean": ("boolean",), "string[]": ("array<string>",),
}


class PathError(ValueError):
    """A path that the language does not have."""


@dataclass(frozen=True)
class FieldSpec:
    """One output field: its path, where it comes from, and what it must be."""

    path: str
    source: str | None = None
    type: str = "any"
    required: bool = False
    normalize: str | None = None
    on_missing: str | None = None

    def __post_init__(self) -> None:
        if self.on_missing not in (None, *POLICIES):
            raise ValueError(f"on_missing must be one of {POLICIES}: {self.on_missing!r}")

    def policy(self, default: str) -> str:
        """The field's own policy, else error if it is required, else the default."""
        return self.on_missing or ("error" if self.required else default)


@dataclass(frozen=True)
class Config:
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"

    def __post_init__(self) -> None:
        if self.on_missing not in POLICIES:
            raise ValueError(f"on_missing must be one of {POLICIES}: {self.on_missing!r}")


def parse_config(data: dict) -> Config:
    names = ("path", "type", "required", "normalize", "on_missing")
    fields = tuple(FieldSpec(source=f.get("from"), **{k: f[k] for k in names if k in f}) for f in data["fields"])
    return Config(fields, **{k: data[k] for k in ("include_confidence", "include_provenance", "on_missing") if k in data})


def load_config(path: str | Path) -> Config:
    return parse_config(json.loads(Path(path).read_text(encoding="utf-8")))


def default_config() -> Config:
    """The whole canonical record."""
    types = {"candidate_id": "string", "full_name": "string", "emails": "string[]", "phones": "string[]", "location": "object", "links": "object", "headline": "string", "years_experience": "number", "skills": "object[]", "experience": "object[]", "education": "object[]"}
    return Config(tuple(FieldSpec(p, type=t, required=p == "candidate_id") for p, t in types.items()))


def tokens(path: str) -> list[tuple[str, str | int | None]]:
    """Steps of a path like ``a.b``, ``a[0]`` or ``a[].b``: ("field", name), ("index", n), ("each", None)."""
    out: list[tuple[str, str | int | None]] = []
    for part in path.split("."):
        m = re.fullmatch(r"([A-Za-z_][A-Za-z0-9_]*)(\[(\d*)\])?", part)
        if not m:
            raise PathError(f"not a path: {path!r}")
        out.append(("field", m[1]))
        if m[2]:
            out.append(("index", int(m[3])) if m[3] else ("each", None))
    return out


def resolve(df: DataFrame, path: str) -> tuple[Column | None, T.DataType | None]:
    """Column and type of a path in df's record; (None, None) if a key does not exist."""

    def walk(c: Column | None, kind: T.DataType, steps: list) -> tuple[Column | None, T.DataType | None]:
        if not steps:
            return c, kind
        what, arg = steps[0]
        if what == "field":
            if not isinstance(kind, T.StructType) or arg not in kind.names:
                return None, None
            return walk(F.col(f"`{arg}`") if c is None else c[arg], kind[arg].dataType, steps[1:])
        if not isinstance(kind, T.ArrayType):
            return None, None
        if what == "index":
            return walk(F.get(c, F.lit(arg)), kind.elementType, steps[1:])
        inner = walk(F.lit(None), kind.elementType, steps[1:])[1]
        if inner is None:
            return None, None
        each = F.filter(F.transform(c, lambda x: walk(x, kind.elementType, steps[1:])[0]), lambda x: x.isNotNull())
        return each, T.ArrayType(inner)

    return walk(None, T.StructType([f for f in df.schema.fields if f.name not in ("field_confidence", "id_tier", "entity_key")]), tokens(path))


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "E164": lambda x: places.phone(x, F.lit(None).cast("string")),
    "canonical": text.skill,
    "iso3166": lambda x: places.country(x)["value"],
    "lower": F.lower,
}


def normalized(c: Column, kind: T.DataType, name: str | None) -> Column:
    """By name, each element of a list; an unknown name changes nothing."""
    how = NORMALIZERS.get(name or "")
    if how is None:
        return c
    if kind == T.StringType():
        return how(c)
    if kind == T.ArrayType(T.StringType()):
        return F.filter(F.transform(c, how), lambda x: x.isNotNull() & (x != ""))
    return c


def without(c: Column, kind: T.DataType, names: set[str]) -> tuple[Column, T.DataType]:
    """c without the fields of these names, at any depth."""
    if isinstance(kind, T.StructType):
        kept = [(f, *without(c[f.name], f.dataType, names)) for f in kind.fields if f.name not in names]
        return F.when(c.isNotNull(), F.struct(*(v.alias(f.name) for f, v, _ in kept))), T.StructType([T.StructField(f.name, k) for f, _, k in kept])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: without(x, kind.elementType, names)[0]), T.ArrayType(_pruned(kind.elementType, names))
    return c, kind


def _pruned(kind: T.StructType, names: set[str]) -> T.StructType:
    return T.StructType([f for f in kind.fields if f.name not in names])


def build_schema(config: Config) -> dict:
    """JSON Schema of the output; dotted paths are nested, as the output is."""
    root: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {}, "required": [], "additionalProperties": True}
    for spec in config.fields:
        *above, last = spec.path.split(".")
        policy, here = spec.policy(config.on_missing), root
        for name in above:
            if policy != "omit" and name not in here["required"]:
                here["required"].append(name)
            here = here["properties"].setdefault(name, {"type": "object", "properties": {}, "required": [], "additionalProperties": True})
        shape = dict(TYPES.get(spec.type, {}))
        if policy == "null" and "type" in shape:
            shape["type"] = [shape["type"], "null"]
        here["properties"][last] = shape
        if policy != "omit" and last not in here["required"]:
            here["required"].append(last)
    if config.include_confidence:
        root["properties"]["overall_confidence"] = {"type": "number"}
    if config.include_provenance:
        item = {"type": "object", "properties": {k: {"type": "string"} for k in ("field", "source", "method")}, "required": ["field", "source", "method"]}
        root["properties"]["provenance"] = {"type": "array", "items": item}

    def ordered(node: dict) -> dict:
        if "required" in node:
            node["required"] = sorted(node["required"])
        for child in node.get("properties", {}).values():
            ordered(child)
        return node

    return ordered(root)


def violates(value: Column, kind: T.DataType, declared: str) -> Column | None:
    """The condition under which a value of a column type is not of the declared type; null: never. Unknown types allow anything."""
    if declared not in TYPES or declared == "any" or kind == T.NullType():
        return None
    if declared.endswith("[]"):
        if not isinstance(kind, T.ArrayType):
            return F.lit(True)
        inner = isinstance(kind.elementType, T.StructType) if declared == "object[]" else kind.elementType == T.StringType()
        return None if inner else F.size(value) > 0  # an empty list is a list of anything
    if declared == "object":
        return None if isinstance(kind, (T.StructType, T.MapType)) else F.lit(True)
    if declared == "integer" and isinstance(kind, (T.DoubleType, T.FloatType)):
        return value != F.floor(value)  # whole numbers are integers, however they are held
    return None if kind.simpleString() in FITS[declared] else F.lit(True)


@dataclass
class Compiled:
    """A config against a profile's schema: per field its path, value, the condition under which it is left out, and errors."""

    fields: list[tuple[str, Column, Column]]
    errors: Column


def compile_config(df: DataFrame, config: Config) -> Compiled:
    names = (set() if config.include_confidence else {"confidence"}) | (set() if config.include_provenance else {"sources"})
    fields, errors, wrong = [], [], []
    for spec in config.fields:
        value, kind = resolve(df, spec.source or spec.path)
        policy = spec.policy(config.on_missing)
        if value is None:
            value, kind = F.lit(None).cast("string"), T.NullType()
        else:
            value = normalized(value, kind, spec.normalize)
            value, kind = without(value, kind, names)
        missing = value.isNull() | (value == "") if kind == T.StringType() else value.isNull()
        if policy == "error":
            errors.append(F.when(missing, F.lit(f"projection: required field {spec.path!r} is missing")))
        bad = violates(value, kind, spec.type)
        if bad is not None:
            wrong.append((spec.path, F.when(~missing & bad, F.lit(f"projection: output failed schema validation: {spec.path!r} is not of type {spec.type!r}"))))
        if kind == T.StringType():
            value = F.nullif(value, F.lit(""))
        fields.append((spec.path, value, missing if policy == "omit" else F.lit(False)))
    if config.include_confidence:
        fields.append(("overall_confidence", F.col("overall_confidence"), F.lit(False)))
    if config.include_provenance:
        fields.append(("provenance", F.col("provenance"), F.lit(False)))
    errors += [e for _, e in sorted(wrong, key=lambda w: w[0].split("."))]  # what is missing first, then what is wrong, by path
    return Compiled(fields, F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>"))


def _nested(fields: list[tuple[str, Column, Column]]) -> list[tuple[str, list | tuple]]:
    """Fields by first step of their path: (name, leaf) or (name, further fields)."""
    out: dict[str, list] = {}
    for path, value, left_out in fields:
        name, _, rest = path.partition(".")
        out.setdefault(name, []).append((rest, value, left_out))
    return [(name, group[-1][1:] if not group[-1][0] else _nested([g for g in group if g[0]])) for name, group in out.items()]


def _struct(tree: list) -> list[Column]:
    return [(F.struct(*_struct(sub)) if isinstance(sub, list) else sub[0]).alias(name) for name, sub in tree]


def _json(tree: list) -> Column:
    """JSON text of a tree; keys that are left out are absent, nulls are written."""
    parts = []
    for name, sub in tree:
        if isinstance(sub, list):
            inner = _json(sub)
            parts.append(F.when(inner != "{}", F.concat(F.lit(json.dumps(name) + ":"), inner)))
        else:
            one = F.to_json(F.struct(sub[0].alias(name)), {"ignoreNullFields": "false"})
            parts.append(F.when(~sub[1], one.substr(F.lit(2), F.length(one) - 2)))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}"))


def project(profiles: DataFrame, config: Config) -> DataFrame:
    """entity_key, output (struct; null on error), json (likewise), errors of each profile."""
    compiled = compile_config(profiles, config)
    tree = _nested(compiled.fields)
    good = F.size("errors") == 0
    out = profiles.withColumn("errors", compiled.errors)
    return out.select("entity_key", F.when(good, F.struct(*_struct(tree))).alias("output"), F.when(good, _json(tree)).alias("json"), "errors")
