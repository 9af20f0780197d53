"""Every registered query of the profile engine, with its DuckDB SQL where SQL can express it.

The queries apply the engine's operators to whole tables, read as claims: an order claims its
priority as its customer's headline, its parts' types as skills, and (priority, status) as a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave import schema
from claimweave.functions import places, scores, text
from claimweave.operators import fuse
from claimweave.plans import project as projecting
from claimweave.plans import runner
from claimweave.sources import files

SOURCES = tuple(schema.TRUST)
METHODS = {"ats_json": "mapped", "recruiter_csv": "direct", "resume": "heuristic", "github": "api", "recruiter_notes": "regex"}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[query.__name__] = query
        if sql:
            _SQL[query.__name__] = sql
        return query

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from claimweave.plans import catalog_files  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from claimweave.plans import catalog_files  # noqa: F401

    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table whose rows a task works on, where a row takes much more work than its bytes tell.
_TASK_BYTES = 262_144


def _spread(rows: DataFrame) -> DataFrame:
    """rows dealt to tasks by the work that follows. A scan cuts by bytes (and no finer than row groups), so that a
    table of a few megabytes, from whose rows whole files are made and read, would keep one or two cores busy."""
    spark, size = rows.sparkSession, int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES)))


def _claims(df: DataFrame, path: str, v: Column | None = None, exp: Column | None = None, edu: Column | None = None) -> DataFrame:
    """Claims of rows (o_custkey, o_orderkey, ...): the source goes round with the order's key."""
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    none = F.lit(None)
    return df.select(
        F.col("o_custkey").cast("string").alias("entity_key"), F.lit("orders").alias("file_seq"), F.col("o_orderkey").cast("int").alias("claim_seq"), F.lit(path).alias("path"),
        (none if v is None else v).cast("string").alias("v"), (none if exp is None else exp).cast(schema.EXPERIENCE).alias("exp"), (none if edu is None else edu).cast(schema.EDUCATION).alias("edu"),
        source.alias("source"), text.mapped(METHODS, source).alias("method"), F.lit(False).alias("fuzzy"),
    )


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "headline", F.col("o_orderpriority"))


def _typed(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    orders, parts = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return _claims(lines.join(parts, "p_partkey").join(orders, "o_orderkey"), path, F.col("p_type"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    exp = F.struct(
        F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 3 != 0, month).alias("start"),
        F.lit(None).cast("string").alias("end"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("summary"),
    )
    return _claims(orders, "experience", exp=exp)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.profiles(_headlines(spark, sf_dir).unionByName(_typed(spark, sf_dir, "skills")))


_LIST = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
_TRUST_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN {t}" for s, t in schema.TRUST.items()) + f" ELSE {schema.UNKNOWN_TRUST} END"
_FUZZY_SQL = "source IN ('resume', 'recruiter_notes')"  # by their methods
_METHOD_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in METHODS.items()) + " END"


def _points_sql(trust: str, n: str, fuzzy: str) -> str:
    raw = f"({trust} + {schema.STEP} * least(greatest({n}, 0), {schema.CAP}))"
    return f"CAST(greatest(least(CASE WHEN {fuzzy} THEN {raw} * 9 // 10 ELSE {raw} END, {schema.HIGH}), {schema.LOW}) AS INTEGER)"


def _round4_sql(x: str) -> str:
    """The exact rounding to four decimals, as scores.round4."""
    return f"""(SELECT CASE WHEN d > 0 OR (d = 0 AND err > 0) THEN n + 1 WHEN d < 0 OR err < 0 THEN n ELSE CASE WHEN n % 2 = 0 THEN n ELSE n + 1 END END / 1e4::DOUBLE FROM
  (SELECT n, err, (p - n) - 0.5::DOUBLE AS d FROM (SELECT p, floor(p) AS n, (h * 1e4::DOUBLE - p) + (x - h) * 1e4::DOUBLE AS err FROM
  (SELECT x, x * 1e4::DOUBLE AS p, (134217729::DOUBLE * x) - ((134217729::DOUBLE * x) - x) AS h FROM (SELECT {x} AS x)))))"""


_HEAD = f"""c AS (SELECT o_custkey::VARCHAR AS entity_key, o_orderkey AS seq, o_orderpriority AS v, {_LIST}[o_orderkey % 5 + 1] AS source FROM orders)"""
_TYPED = f"""t AS (SELECT o_custkey::VARCHAR AS entity_key, o_orderkey AS seq, p_type AS v, {_LIST}[o_orderkey % 5 + 1] AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_HEAD_WON = f"""ranked AS (SELECT *, {_TRUST_SQL} AS trust, row_number() OVER (PARTITION BY entity_key ORDER BY {_TRUST_SQL} DESC, length(v) DESC, source, seq) AS rn FROM c),
won AS (SELECT entity_key, v, source, trust, {_FUZZY_SQL} AS fuzzy FROM ranked WHERE rn = 1),
agreed AS (SELECT w.entity_key, count(DISTINCT c.source) AS n FROM won w JOIN c ON c.entity_key = w.entity_key AND lower(c.v) = lower(w.v) GROUP BY w.entity_key)"""


@_register(f"WITH {_HEAD}, {_HEAD_WON} SELECT entity_key, v AS headline, source, n AS n_sources, {_points_sql('trust', 'n - 1', 'fuzzy')} AS points FROM won JOIN agreed USING (entity_key)")
def scalar_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, A10: the most trusted value of a scalar, its corroboration and confidence."""
    groups = fuse.grouped(_headlines(spark, sf_dir))
    won = groups.groupBy("entity_key").agg(F.min(F.struct("best", F.size("sources").cast("long").alias("n"), "points")).alias("w"))
    return won.select("entity_key", F.col("w.best.v").alias("headline"), F.col("w.best.source").alias("source"), F.col("w.n").alias("n_sources"), F.col("w.points").alias("points"))


_VALUES = f"""g AS (SELECT entity_key, v, count(DISTINCT source) AS n, max({_TRUST_SQL}) AS trust, bool_and({_FUZZY_SQL}) AS fuzzy,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(seq) AS seq FROM t GROUP BY entity_key, v)"""


@_register(f"""WITH {_TYPED}, {_VALUES}, top AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY n DESC, trust DESC, v) AS rn FROM g)
SELECT entity_key, (SELECT array_to_string(list_sort(list(v)), '|') FROM g WHERE g.entity_key = top.entity_key) AS vals, v AS best, {_points_sql('trust', 'n - 1', 'fuzzy')} AS points FROM top WHERE rn = 1""")
def list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O2: the union of a list's values, and the confidence of its most corroborated one."""
    groups = fuse.grouped(_typed(spark, sf_dir, "emails"))
    order = F.struct((-F.size("sources")).alias("n"), F.col("best.trust").alias("trust"), "key", "points")
    out = groups.groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_list("key")), "|").alias("vals"), F.min(order).alias("top"))
    return out.select("entity_key", "vals", F.col("top.key").alias("best"), F.col("top.points").alias("points"))


@_register(f"WITH {_TYPED}, {_VALUES} SELECT entity_key, v AS name, sources, {_points_sql('trust', 'n - 1', 'fuzzy')} AS points, contains(sources, 'github') AS verified_in_code FROM g")
def skill_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a skill with its sources, confidence and whether code verifies it."""
    groups = fuse.grouped(_typed(spark, sf_dir, "skills"))
    return groups.select("entity_key", F.col("key").alias("name"), F.array_join("sources", ",").alias("sources"), "points", F.array_contains("sources", "github").alias("verified_in_code"))


_JOBS = f"""j AS (SELECT o_custkey::VARCHAR AS entity_key, o_orderkey AS seq, o_orderpriority AS company, o_orderstatus AS title, {_LIST}[o_orderkey % 5 + 1] AS source,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS start, CASE WHEN o_orderkey % 4 = 0 THEN 'order ' || o_orderkey END AS summary FROM orders),
jg AS (SELECT entity_key, min_by(company, [-({_TRUST_SQL}), seq]) AS company, min_by(title, [-({_TRUST_SQL}), seq]) AS title,
  min_by(start, [-({_TRUST_SQL}), seq]) FILTER (WHERE start IS NOT NULL) AS start, min_by(summary, [-({_TRUST_SQL}), seq]) FILTER (WHERE summary IS NOT NULL) AS summary,
  max({_TRUST_SQL}) AS trust, count(DISTINCT source) AS n, bool_and({_FUZZY_SQL}) AS fuzzy, min(seq) AS seq FROM j GROUP BY entity_key, lower(company), lower(title))"""


@_register(f"WITH {_JOBS} SELECT entity_key, company, title, start, summary, {_points_sql('trust', 'n - 1', 'fuzzy')} AS points FROM jg")
def keyed_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of equal key are one, each field from the most trusted claim that has it."""
    groups = fuse.grouped(_jobs(spark, sf_dir))
    return groups.select("entity_key", F.col("exp_company").alias("company"), F.col("exp_title").alias("title"), F.col("exp_start").alias("start"), F.col("exp_summary").alias("summary"), "points")


@_register(f"WITH {_JOBS} SELECT entity_key, string_agg(coalesce(start, '') || ':' || company || ':' || title, '|' ORDER BY coalesce(start, '') DESC, company DESC, seq) AS jobs FROM jg GROUP BY entity_key")
def experience_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by start and company, latest first, ties in input order."""
    found = fuse.profiles(_jobs(spark, sf_dir))
    shown = F.transform("experience", lambda e: F.concat(F.coalesce(e["start"], F.lit("")), F.lit(":"), e["company"], F.lit(":"), e["title"]))
    return found.select("entity_key", F.array_join(shown, "|").alias("jobs"))


@_register(f"""WITH {_HEAD}, {_HEAD_WON}, {_TYPED}, {_VALUES},
h AS (SELECT entity_key, {_points_sql('trust', 'n - 1', 'fuzzy')} / 10000.0::DOUBLE AS c FROM won JOIN agreed USING (entity_key)),
s AS (SELECT entity_key, list_reduce(list(p ORDER BY v), lambda a, b: a + b) / count(*) AS m FROM (SELECT entity_key, v, {_points_sql('trust', 'n - 1', 'fuzzy')} / 10000.0::DOUBLE AS p FROM g) GROUP BY entity_key),
sr AS (SELECT entity_key, {_round4_sql('m')} AS c FROM s),
both_ AS (SELECT entity_key, h.c AS headline, sr.c AS skills, CASE WHEN h.c IS NULL THEN sr.c WHEN sr.c IS NULL THEN h.c ELSE (h.c + sr.c) / 2.0::DOUBLE END AS m FROM h FULL JOIN sr USING (entity_key))
SELECT entity_key, headline, skills, {_round4_sql('m')} AS overall FROM both_""")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of groups and of the whole, exact to four decimals."""
    return _profile(spark, sf_dir).select("entity_key", F.col("field_confidence")["headline"].alias("headline"), F.col("field_confidence")["skills"].alias("skills"), F.col("overall_confidence").alias("overall"))


@_register(f"""WITH {_HEAD}, {_HEAD_WON}, {_TYPED}, p AS (SELECT entity_key, 'headline' AS field, source, {_METHOD_SQL} AS method FROM won
UNION SELECT entity_key, 'skills', source, {_METHOD_SQL} FROM t)
SELECT entity_key, string_agg(field || ':' || source || ':' || method, '|' ORDER BY field, source, method) AS provenance FROM p GROUP BY entity_key""")
def provenance_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's provenance of scalars, every claim's of lists."""
    shown = F.transform("provenance", lambda p: F.concat_ws(":", p["field"], p["source"], p["method"]))
    return _profile(spark, sf_dir).select("entity_key", F.array_join(shown, "|").alias("provenance"))


@_register("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@example.com' END AS email, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
CASE WHEN c_custkey % 5 <> 0 THEN '+1415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone, CASE WHEN c_custkey % 7 <> 0 THEN 'dir' || c_custkey END AS entity FROM customer),
p AS (SELECT c_custkey, CASE WHEN email IS NOT NULL THEN 'email' WHEN name IS NOT NULL AND phone IS NOT NULL THEN 'name+phone' WHEN name IS NOT NULL AND entity IS NOT NULL THEN 'name+source'
WHEN entity IS NOT NULL THEN 'source-only' ELSE 'none' END AS tier, email, lower(name) AS name, phone, entity FROM k)
SELECT c_custkey, tier, 'cand_' || substr(sha1(CASE tier WHEN 'email' THEN 'email|' || email WHEN 'name+phone' THEN 'name+phone|' || name || '|' || phone
WHEN 'name+source' THEN 'name+source|' || name || '|' || entity WHEN 'source-only' THEN 'source|' || entity ELSE 'anon|[' || c_custkey || ']' END), 1, 12) AS candidate_id FROM p""")
def identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of an entity from the best key that it has."""
    k = F.col("c_custkey")
    key = k.cast("string")
    who = fuse.identity(
        F.when(k % 7 != 0, F.concat(F.lit("dir"), key)), F.when(k % 3 != 0, F.col("c_name")), F.when(k % 2 == 0, F.concat(F.lit("c"), key, F.lit("@example.com"))),
        F.when(k % 5 != 0, F.concat(F.lit("+1415555"), F.lpad((k % 10000).cast("string"), 4, "0"))), F.concat(F.lit("["), key, F.lit("]")),
    )
    return _table(spark, sf_dir, "customer").select("c_custkey", who.alias("w")).select("c_custkey", F.col("w.tier").alias("tier"), F.col("w.id").alias("candidate_id"))


_NAMES = ("a.csv", "GitHub_x.JSON", "gh.me.url", "ats.json", "cv.PDF", "x.docx", "resume.md", "notes.txt", "resume_x.txt", "photo.png")


@_register(f"""SELECT page_id, name AS file, CASE WHEN low LIKE '%.csv' THEN 'recruiter_csv' WHEN regexp_matches(low, '^(github|gh\\.).*\\.(json|url|txt)$') THEN 'github' WHEN low LIKE '%.json' THEN 'ats_json'
WHEN low LIKE '%.pdf' OR low LIKE '%.docx' OR low LIKE 'resume.%' THEN 'resume' WHEN low LIKE '%.txt' THEN 'recruiter_notes' END AS source
FROM (SELECT page_id, {list(_NAMES)}[page_id % {len(_NAMES)} + 1] AS name, lower({list(_NAMES)}[page_id % {len(_NAMES)} + 1]) AS low FROM pages)""")
def detect_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a file by its name."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", name.alias("file"), files.detect(name).alias("source"))


@_register(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{files.EMAIL}'))) AS email FROM documents")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct addresses of a text."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(files.EMAIL), F.lit(0)))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email"))


@_register(f"SELECT doc_id, trim(unnest(list_distinct(regexp_extract_all(text, '{files.PHONE}', 1)))) AS phone FROM documents")
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct numbers of a text, loosely; ``phone_valid`` has those that a numbering plan allows."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(files.PHONE), F.lit(1)))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("phone")).select("doc_id", text.strip(F.col("phone")).alias("phone"))


@_register()
def phone_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the numbers of a text, as E.164, with the region US for those without a calling code."""
    found = phone_extract(spark, sf_dir).withColumn("e164", places.phone(F.col("phone"), F.lit("US")))
    return found.where("e164 is not null")


@_register("""WITH e AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || upper(c_name) || '@Example.COM ' WHEN 1 THEN 'mailto:' || replace(c_name, '#', '.') || '@x.org' WHEN 2 THEN c_name
ELSE 'a b@' || c_name || '.de' END AS raw FROM customer), b AS (SELECT c_custkey, regexp_replace(lower(trim(raw)), '^mailto:', '') AS bare FROM e)
SELECT c_custkey, CASE WHEN regexp_matches(bare, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN bare END AS email FROM b""")
def email_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    raw = F.when(k == 0, F.concat(F.lit("  "), F.upper(n), F.lit("@Example.COM "))).when(k == 1, F.concat(F.lit("mailto:"), F.replace(n, F.lit("#"), F.lit(".")), F.lit("@x.org"))).when(k == 2, n).otherwise(F.concat(F.lit("a b@"), n, F.lit(".de")))
    return _table(spark, sf_dir, "customer").select("c_custkey", text.email(raw).alias("email"))


@_register("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders""")
def month_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates in six spellings, of which a full date and a bare year name no month."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "yyyy/M")).when(k == 1, F.date_format(d, "MM-yyyy")).when(k == 2, F.date_format(d, "MMMM yyyy")).when(k == 3, F.concat(F.date_format(d, "yyyy "), F.upper(F.date_format(d, "MMM")), F.lit("."))).when(k == 4, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.month(raw).alias("month"))


@_register("""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) ELSE 'Mc' || p_name END AS raw FROM part),
w AS (SELECT p_partkey, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM r)
SELECT p_partkey, CASE WHEN lower(t) <> upper(t) AND (t = upper(t) OR t = lower(t))
THEN array_to_string(list_transform(regexp_extract_all(t, '(\\pL+|\\PL+)'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE t END AS name FROM w""")
def name_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F12."""
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    raw = F.when(k == 0, F.upper(n)).when(k == 1, F.lower(n)).otherwise(F.concat(F.lit("Mc"), n))
    return _table(spark, sf_dir, "part").select("p_partkey", text.name(raw).alias("name"))


_RAW_SKILLS = ("js", "  Type   Script ", "K8S", "kafka", "CSS", "gRPC", "rest api", "machine-learning", "c sharp", "apache  spark")


@_register("WITH a(alias, name) AS (VALUES " + ", ".join(f"('{a}', '{n}')" for a, n in text.SKILL_ALIASES.items()) + f"""),
r AS (SELECT p_partkey, trim(regexp_replace({list(_RAW_SKILLS)}[p_partkey % {len(_RAW_SKILLS)} + 1], '\\s+', ' ', 'g')) AS t FROM part)
SELECT p_partkey, coalesce(name, CASE WHEN t = lower(t) THEN array_to_string(list_transform(regexp_extract_all(t, '(\\pL+|\\PL+)'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE t END) AS skill FROM r LEFT JOIN a ON alias = lower(t)""")
def skill_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    raw = F.element_at(F.array(*map(F.lit, _RAW_SKILLS)), (F.col("p_partkey") % len(_RAW_SKILLS) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.skill(raw).alias("skill"))


_KEYS = {"k": "headline", "q": "full_name"}


@_register("SELECT event_id, key, json_extract_string(props, '$.' || key) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE key IN ('k', 'q')")
def json_key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped keys of an object and their values."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return rows.where(text.mapped(_KEYS, F.col("key")).isNotNull())


@_register("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('q') GROUP BY key")
def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that no map has."""
    rows = _table(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return rows.where(text.mapped({"q": "full_name"}, F.col("key")).isNull()).groupBy("key").agg(F.count("*").alias("n"))


@_register("""WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CASE role WHEN 'user' THEN 'skills' WHEN 'assistant' THEN 'education' END END AS header FROM conversations)
SELECT conv_id, turn, last_value(header IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM h""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines take the section of the header above them."""
    line = F.when(F.col("turn") % 3 == 0, F.when(F.col("role") == "user", " Tech Stack: ").when(F.col("role") == "assistant", "EDUCATION")).otherwise(F.lit("some other line"))
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce(line, F.lit("-")).alias("line")))).alias("turns"))
    placed = F.zip_with("turns", files.sections(F.transform("turns", lambda t: t["line"])), lambda t, s: F.struct(t["turn"].alias("turn"), s["section"].alias("section")))
    return turns.select("conv_id", F.inline(placed))


_TRUSTS = ", ".join(f"('{s}', {t})" for s, t in [*schema.TRUST.items(), ("elsewhere", schema.UNKNOWN_TRUST)])


@_register(f"SELECT source, n::INTEGER AS n, fuzzy, {_points_sql('trust', 'n', 'fuzzy')} / 10000.0::DOUBLE AS confidence FROM (VALUES {_TRUSTS}) s(source, trust), range(-1, 6) r(n), (VALUES (true), (false)) f(fuzzy)")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with every corroboration."""
    rows = spark.range(-1, 6).select(F.col("id").cast("int").alias("n"), F.explode(F.array(F.lit(True), F.lit(False))).alias("fuzzy"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, [*SOURCES, "elsewhere"]))).alias("source"))
    return rows.select("source", "n", "fuzzy", scores.points(scores.field_points(scores.trust(F.col("source")), F.col("n"), F.col("fuzzy"))).alias("confidence"))


_CONFIG = {
    "fields": [
        {"path": "who", "from": "candidate_id", "type": "string", "required": True}, {"path": "top.skill", "from": "skills[0].name", "type": "string"},
        {"path": "top.all", "from": "skills[].name", "type": "string[]", "normalize": "lower"}, {"path": "line", "from": "headline", "type": "string", "on_missing": "error"},
        {"path": "name", "from": "full_name", "type": "string", "on_missing": "omit"}, {"path": "skills", "type": "object[]"},
    ], "include_confidence": False, "include_provenance": False,
}


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projecting.project(_profile(spark, sf_dir), projecting.parse_config(_CONFIG))


_LOW = f"""{_HEAD}, {_TYPED}, e AS (SELECT entity_key FROM c UNION SELECT entity_key FROM t), n AS (SELECT entity_key, list_sort(list(DISTINCT v)) AS names FROM t GROUP BY entity_key),
hh AS (SELECT DISTINCT entity_key FROM c)"""


@_register(f"""WITH {_LOW}, {_HEAD_WON} SELECT entity_key, names[1] AS top_skill, coalesce(array_to_string(list_transform(names, lambda x: lower(x)), '|'), '') AS all_skills, won.v AS line FROM e LEFT JOIN n USING (entity_key) JOIN won USING (entity_key)""")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed, indexed, wildcard, normalized and nested outputs."""
    out = _projected(spark, sf_dir).where("output is not null")
    return out.select("entity_key", F.col("output.top.skill").alias("top_skill"), F.array_join("output.top.all", "|").alias("all_skills"), F.col("output.line").alias("line"))


@_register(f"WITH {_LOW} SELECT entity_key, CASE WHEN hh.entity_key IS NULL THEN 'projection: required field ''line'' is missing' END AS error FROM e LEFT JOIN hh USING (entity_key)")
def project_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity that lacks a required field has an error and no output, the others go on."""
    return _projected(spark, sf_dir).select("entity_key", F.get("errors", F.lit(0)).alias("error"))


@_register(f"WITH {_HEAD} SELECT count(DISTINCT entity_key) AS with_output, count(DISTINCT entity_key) AS without_name, 0::BIGINT AS with_confidence, 0::BIGINT AS with_sources FROM c")
def project_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omitted keys are absent from the JSON, toggled ones at every depth."""
    j = _projected(spark, sf_dir).where("json is not null")
    has = lambda key: F.count_if(F.col("json").contains(f'"{key}":'))
    return j.agg(F.count("*").alias("with_output"), (F.count("*") - has("name") + F.count_if(F.col("json").contains('"skills":[{"name":'))).alias("without_name"), has("confidence").alias("with_confidence"), has("sources").alias("with_sources"))


@_register()
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headline is no number, so every entity that has one fails validation."""
    config = projecting.parse_config({"fields": [{"path": "candidate_id", "type": "string"}, {"path": "headline", "type": "number"}]})
    return projecting.project(_profile(spark, sf_dir), config).select("entity_key", F.array_join("errors", "; ").alias("errors"))


@_register()
def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the whole record as JSON."""
    return projecting.project(_profile(spark, sf_dir), projecting.default_config()).select("entity_key", "json")


@_register("""WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ats_json: invalid JSON in a.json' WHEN 1 THEN 'projection: required field is missing' WHEN 2 THEN 'ats_json: ignored unmapped fields' ELSE 'recruiter_csv: Empty file b.csv' END AS warning FROM events)
SELECT string_split(warning, ': ')[1] AS stage, CASE WHEN warning LIKE 'projection%' THEN 'error' ELSE 'warning' END AS severity, lower(warning) LIKE '%empty file%' OR lower(warning) LIKE '%invalid json%' AS hard_skip, count(*) AS n FROM w GROUP BY ALL""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings by stage, severity and whether they skip their source."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, "ats_json: invalid JSON in a.json").when(k == 1, "projection: required field is missing").when(k == 2, "ats_json: ignored unmapped fields").otherwise("recruiter_csv: Empty file b.csv")
    return runner.classified(_table(spark, sf_dir, "events").select(said.alias("warning"))).groupBy("stage", "severity", "hard_skip").agg(F.count("*").alias("n"))
