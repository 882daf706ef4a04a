"""One query for each operator, over the driver's tables, with its SQL.

The tables hold no source code, so `part` stands for it. Two views make it a pair of
registries: R compares small parts with large ones in a few big modules; S makes of
each three parts a module of at most 3 x 3 features, the target's being edited copies,
so that SQL can try all assignments. For extraction each part is a source file.

Queries run the functions that the engine itself runs.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, types
from ..functions.similarity import EARLY_EXIT, Side, Weights, class_scores, jaro_winkler, name_scores, return_score, type_set_score
from ..operators import matching, metrics
from ..operators.assignment import best_assignment
from ..operators.reports import match_registries, matched_rows, ranked_modules, raw_lines
from ..schema import Registry, with_defaults
from ..sources import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_R = """r AS (SELECT p_partkey AS ord, p_size <= 25 AS is_base, replace(p_name, ' ', '_') AS name, lower(p_brand) AS member, lower(p_type) AS ns,
 CASE right(p_brand, 1) WHEN '1' THEN 'CONSTRUCTOR' WHEN '2' THEN 'FUNCTION' WHEN '3' THEN 'CLASS_METHOD' ELSE 'INSTANCE_METHOD' END AS kind,
 CASE right(p_brand, 1) WHEN '1' THEN 'C' WHEN '2' THEN 'F' WHEN '3' THEN 'F' ELSE 'M' END AS cls,
 CASE WHEN p_retailprice > 1000 THEN ['STRING', 'NULL'] WHEN p_size > 40 THEN ['MAP'] WHEN p_size > 10 THEN ['OBJECT'] ELSE [] END AS rets, p_size > 30 AS isa,
 CASE WHEN p_size > 20 THEN 'NUMBER' ELSE 'LIST' END AS t1, split_part(p_name, ' ', 1) AS p1, split_part(p_name, ' ', 2) AS p2 FROM part)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of part as features, with is_base."""
    p = table(spark, sf_dir, "part")
    last = F.right("p_brand", F.lit(1))
    words = F.split("p_name", " ")
    one = lambda name, t: F.struct(name.alias("original_name"), name.alias("normalized_name"), F.array(t).alias("original_types"), F.array(t).alias("normalized_types"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("is_optional"))
    rets = F.when(F.col("p_retailprice") > 1000, F.array(F.lit("STRING"), F.lit("NULL"))).when(F.col("p_size") > 40, F.array(F.lit("MAP"))).when(F.col("p_size") > 10, F.array(F.lit("OBJECT"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = p.select(
        F.col("p_partkey").alias("ord"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("normalized_name"),
        F.lower("p_brand").alias("normalized_member_of"),
        F.lower("p_type").alias("normalized_namespace"),
        F.when(last == "1", "CONSTRUCTOR").when(last == "2", "FUNCTION").when(last == "3", "CLASS_METHOD").otherwise("INSTANCE_METHOD").alias("type"),
        F.array(one(F.get(words, F.lit(0)), F.when(F.col("p_size") > 20, "NUMBER").otherwise("LIST")), one(F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit("STRING"))).alias("parameters"),
        rets.alias("normalized_return_types"),
        (F.col("p_size") > 30).alias("async"),
        (F.col("p_size") <= 25).alias("is_base"),
    )
    return with_defaults(rows).join(rows.select("ord", "is_base"), "ord")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = registry(spark, sf_dir)
    return rows.where("is_base").drop("is_base"), rows.where("not is_base").drop("is_base")


_UP = "([A-Z]"


@query(f"""SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_brand || 'HTTPServer-' || replace(p_name, ' ', 'X') || p_type, '-', '_'), '(.){_UP}[a-z]+)', '\\1_\\2', 'g'), '([0-9a-z]){_UP})', '\\1_\\2', 'g')) AS name FROM part""")
def normalize_name(spark, sf_dir):
    c = F.concat("p_brand", F.lit("HTTPServer-"), F.replace("p_name", F.lit(" "), F.lit("X")), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", names.normalize_name(c).alias("name"))


@query("""WITH p AS (SELECT page_id, regexp_replace(replace(regexp_replace(url, '^[a-z]+://[^/]*', '/site'), '?', '/'), '/[^/]*$', '') AS dir FROM pages)
SELECT page_id, CASE WHEN dir = '/site/fr' OR NOT starts_with(dir || '/', '/site/fr') THEN 'lib' WHEN starts_with(dir, '/site/fr/') THEN 'lib_' || replace(substr(dir, 10), '/', '_') ELSE 'lib_.._' || replace(substr(dir, 7), '/', '_') END AS ns FROM p""")
def normalize_namespace(spark, sf_dir):
    path = F.replace(F.regexp_replace("url", "^[a-z]+://[^/]*", "/site"), F.lit("?"), F.lit("/"))
    return table(spark, sf_dir, "pages").select("page_id", names.normalize_namespace(path, "/site/fr", "lib").alias("ns"))


@query("""SELECT CASE WHEN p_type <> '' AND p_size > 5 THEN lower(p_type) WHEN p_size > 2 THEN p_brand ELSE 'Unknown Module' END AS module, count(*) AS features, min(p_partkey) AS first FROM part GROUP BY 1""")
def module_key_group(spark, sf_dir):
    key = names.module_key(F.when(F.col("p_size") > 2, F.col("p_brand")).otherwise(""), F.when(F.col("p_size") > 5, F.lower("p_type")).otherwise(""))
    return table(spark, sf_dir, "part").groupBy(key.alias("module")).agg(F.count("*").alias("features"), F.min("p_partkey").alias("first"))


@query(f"""WITH {_R} SELECT ord, CASE kind WHEN 'CONSTRUCTOR' THEN 'constructor' WHEN 'INSTANCE_METHOD' THEN 'method' ELSE 'function' END AS shown, CASE kind WHEN 'CONSTRUCTOR' THEN 0 WHEN 'INSTANCE_METHOD' THEN 2 ELSE 1 END AS prio,
 member || '.' || name AS display, replace(member || '.x', '.', '_') || '.md' AS file, cls FROM r""")
def code_maps(spark, sf_dir):
    r = registry(spark, sf_dir)
    member = F.col("normalized_member_of")
    return r.select("ord", names.display_type(F.col("type")).alias("shown"), names.type_priority(F.col("type")).alias("prio"), names.display_name(F.lit(""), F.col("normalized_name"), member).alias("display"), names.module_file(F.concat(member, F.lit(".x"))).alias("file"), names.kind_class(F.col("type")).alias("cls"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice / 100000.0 = 1.0 THEN '✅' WHEN o_totalprice / 100000.0 >= 0.8 THEN '⚠️' ELSE '❌' END AS icon,
 CASE o_orderstatus WHEN 'O' THEN 'ts' WHEN 'F' THEN 'go' ELSE 'python' END AS code FROM orders""")
def status_icons(spark, sf_dir):
    lang = F.when(F.col("o_orderstatus") == "O", "TYPESCRIPT").when(F.col("o_orderstatus") == "F", "GO").otherwise("PYTHON")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.status_icon(F.col("o_totalprice") / F.lit(100000.0)).alias("icon"), names.language_code(lang).alias("code"))


@query("""SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS cell FROM documents""")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.csv_cell(F.col("text")).alias("cell"))


# types: texts are made of columns, so that each grammar meets all of its rules

_WORDS = "str int bool list dict set None any float bytes RunConfig Iterator".split()
_WORD_KINDS = "STRING NUMBER BOOLEAN LIST MAP SET NULL OBJECT NUMBER OBJECT OBJECT LIST".split()


def _pick(n: str, values: list[str]) -> str:
    """SQL for one of the values by a number."""
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _chosen(n: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


@query(f"""WITH b AS (SELECT p_partkey, {_pick('p_partkey', _WORDS)} AS a, {_pick('p_partkey // 3', _WORDS)} AS b, {_pick('p_partkey', _WORD_KINDS)} AS ka, {_pick('p_partkey // 3', _WORD_KINDS)} AS kb, p_size % 9 AS w FROM part),
t AS (SELECT p_partkey, CASE w WHEN 0 THEN a WHEN 1 THEN 'Optional[' || a || ']' WHEN 2 THEN 'Union[' || a || ', ' || b || ']' WHEN 3 THEN 'Tuple[' || a || ', ' || b || ']' WHEN 4 THEN a || ' | ' || b WHEN 5 THEN a || ' | None' WHEN 6 THEN a || '[' || b || ']' WHEN 7 THEN ' ' || upper(a) || ' ' ELSE '' END AS t,
 CASE WHEN w IN (0, 6, 7) THEN ka WHEN w = 1 THEN CASE ka WHEN 'NULL' THEN 'NULL' ELSE ka || ',NULL' END WHEN w IN (2, 3, 4) THEN CASE WHEN ka = kb THEN ka ELSE ka || ',' || kb END WHEN w = 5 THEN CASE ka WHEN 'NULL' THEN 'NULL' ELSE ka || ',NULL' END ELSE 'OBJECT' END AS kinds FROM b) SELECT * FROM t""")
def python_types(spark, sf_dir):
    a, b, w = _chosen(F.col("p_partkey"), _WORDS), _chosen(F.floor(F.col("p_partkey") / 3), _WORDS), F.col("p_size") % 9
    two = F.concat(a, F.lit(", "), b)
    t = F.when(w == 0, a).when(w == 1, F.concat(F.lit("Optional["), a, F.lit("]"))).when(w == 2, F.concat(F.lit("Union["), two, F.lit("]"))).when(w == 3, F.concat(F.lit("Tuple["), two, F.lit("]"))).when(w == 4, F.concat(a, F.lit(" | "), b))
    t = t.when(w == 5, F.concat(a, F.lit(" | None"))).when(w == 6, F.concat(a, F.lit("["), b, F.lit("]"))).when(w == 7, F.concat(F.lit(" "), F.upper(a), F.lit(" "))).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.array_join(types.normalized_types(t, "python"), ",").alias("kinds"))


_TS = [("string", "STRING"), ("number", "NUMBER"), ("boolean", "BOOLEAN"), ("any", "OBJECT"), ("unknown", "UNKNOWN"), ("void", "NULL"), ("Settings", "SET"), ("MapperConfig", "MAP"), ("RecordOf", "MAP"), ("Thing", "OBJECT"), ("{a: string}", "MAP")]
_TS_GENERIC = [("Array", "LIST"), ("Map", "MAP"), ("Set", "SET"), ("AsyncGenerator", "LIST"), ("Record", "OBJECT"), ("Box", "OBJECT")]


@query(f"""WITH b AS (SELECT p_partkey, {_pick('p_partkey', [a for a, _ in _TS])} AS a, {_pick('p_partkey // 2', [a for a, _ in _TS])} AS b, {_pick('p_partkey', [k for _, k in _TS])} AS ka, {_pick('p_partkey // 2', [k for _, k in _TS])} AS kb, {_pick('p_partkey', [a for a, _ in _TS_GENERIC])} AS g, {_pick('p_partkey', [k for _, k in _TS_GENERIC])} AS kg, p_size % 7 AS w FROM part)
SELECT p_partkey, CASE w WHEN 0 THEN a WHEN 1 THEN a || ' | ' || b WHEN 2 THEN a || '[]' WHEN 3 THEN g || '<' || a || '>' WHEN 4 THEN 'Promise<' || a || '>' WHEN 5 THEN g || '<' || a || '> | undefined' ELSE ' ' END AS t,
 CASE w WHEN 0 THEN ka WHEN 1 THEN CASE WHEN ka = kb THEN ka ELSE ka || ',' || kb END WHEN 2 THEN 'LIST' WHEN 3 THEN kg WHEN 4 THEN ka WHEN 5 THEN kg || ',NULL' ELSE 'OBJECT' END AS kinds FROM b""")
def typescript_types(spark, sf_dir):
    k, w = F.col("p_partkey"), F.col("p_size") % 7
    a, b, g = _chosen(k, [x for x, _ in _TS]), _chosen(F.floor(k / 2), [x for x, _ in _TS]), _chosen(k, [x for x, _ in _TS_GENERIC])
    generic = F.concat(g, F.lit("<"), a, F.lit(">"))
    t = F.when(w == 0, a).when(w == 1, F.concat(a, F.lit(" | "), b)).when(w == 2, F.concat(a, F.lit("[]"))).when(w == 3, generic).when(w == 4, F.concat(F.lit("Promise<"), a, F.lit(">"))).when(w == 5, F.concat(generic, F.lit(" | undefined"))).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.array_join(types.normalized_types(t, F.lit("typescript")), ",").alias("kinds"))


_JAVA = [("String", "STRING"), ("int", "NUMBER"), ("boolean", "BOOLEAN"), ("void", "NULL"), ("Object", "OBJECT"), ("Thing", "OBJECT"), ("BigDecimal", "NUMBER"), ("List", "OBJECT")]
_JAVA_GENERIC = [("List", "LIST"), ("Map", "MAP"), ("HashSet", "SET"), ("ImmutableList", "OBJECT")]
_GO = [("string", "STRING"), ("int64", "NUMBER"), ("bool", "BOOLEAN"), ("error", "OBJECT"), ("interface{}", "OBJECT"), ("rune", "STRING"), ("Event", "OBJECT"), ("float32", "NUMBER")]


@query(f"""WITH b AS (SELECT p_partkey, {_pick('p_partkey', [a for a, _ in _JAVA])} AS a, {_pick('p_partkey', [k for _, k in _JAVA])} AS ka, {_pick('p_partkey', [a for a, _ in _JAVA_GENERIC])} AS g, {_pick('p_partkey', [k for _, k in _JAVA_GENERIC])} AS kg, p_size % 6 AS w FROM part)
SELECT p_partkey, CASE w WHEN 0 THEN a WHEN 1 THEN a || '[]' WHEN 2 THEN g || '<' || a || '>' WHEN 3 THEN 'CompletableFuture<' || a || '>' WHEN 4 THEN 'Optional<' || a || '>' ELSE ' ' END AS t,
 CASE w WHEN 0 THEN ka WHEN 1 THEN 'LIST' WHEN 2 THEN kg WHEN 3 THEN ka WHEN 4 THEN CASE ka WHEN 'NULL' THEN ka ELSE ka || ',NULL' END ELSE 'OBJECT' END AS kinds FROM b""")
def java_types(spark, sf_dir):
    k, w = F.col("p_partkey"), F.col("p_size") % 6
    a, g = _chosen(k, [x for x, _ in _JAVA]), _chosen(k, [x for x, _ in _JAVA_GENERIC])
    t = F.when(w == 0, a).when(w == 1, F.concat(a, F.lit("[]"))).when(w == 2, F.concat(g, F.lit("<"), a, F.lit(">"))).when(w == 3, F.concat(F.lit("CompletableFuture<"), a, F.lit(">"))).when(w == 4, F.concat(F.lit("Optional<"), a, F.lit(">"))).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.array_join(types.normalized_types(t, "java"), ",").alias("kinds"))


@query(f"""WITH b AS (SELECT p_partkey, {_pick('p_partkey', [a for a, _ in _GO])} AS a, {_pick('p_partkey', [k for _, k in _GO])} AS ka, p_size % 8 AS w FROM part)
SELECT p_partkey, CASE w WHEN 0 THEN a WHEN 1 THEN '*' || a WHEN 2 THEN '[]' || a WHEN 3 THEN '[5]' || a WHEN 4 THEN '*[]' || a WHEN 5 THEN 'map[string]' || a WHEN 6 THEN '* ' || a ELSE '' END AS t, CASE WHEN w IN (0, 1, 6) THEN ka WHEN w IN (2, 3, 4) THEN 'LIST' WHEN w = 5 THEN 'MAP' ELSE 'OBJECT' END AS kinds FROM b""")
def go_types(spark, sf_dir):
    a, w = _chosen(F.col("p_partkey"), [x for x, _ in _GO]), F.col("p_size") % 8
    lead = F.when(w == 1, "*").when(w == 2, "[]").when(w == 3, "[5]").when(w == 4, "*[]").when(w == 5, "map[string]").when(w == 6, "* ").otherwise("")
    t = F.when(w == 7, "").otherwise(F.concat(lead, a))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.array_join(types.normalized_types(t, "go"), ",").alias("kinds"))


@query(f"""WITH b AS (SELECT p_partkey, {_pick('p_partkey', _WORDS)} AS a, {_pick('p_partkey', _WORD_KINDS)} AS ka FROM part) SELECT p_partkey, ' ' || upper(a) AS t, ka AS kinds FROM b""")
def keyword_types(spark, sf_dir):
    """Languages that aren't known have the keywords alone."""
    t = F.concat(F.lit(" "), F.upper(_chosen(F.col("p_partkey"), _WORDS)))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.array_join(types.normalized_types(t, "cobol"), ",").alias("kinds"))


# similarity

_SETS = """WITH f AS (SELECT l_orderkey, list(DISTINCT CASE l_returnflag WHEN 'R' THEN 'MAP' WHEN 'A' THEN 'STRING' ELSE 'UNKNOWN' END) AS a FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN ['OBJECT'] WHEN 'F' THEN ['STRING', 'NULL'] ELSE [] END AS b FROM orders)"""


@query(_SETS + """ SELECT o_orderkey, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 WHEN list_has_any(a, b) THEN 1.0 WHEN (list_contains(a, 'MAP') AND list_has_any(b, ['OBJECT', 'ANY'])) OR (list_contains(b, 'MAP') AND list_has_any(a, ['OBJECT', 'ANY'])) THEN 0.4
 WHEN list_has_any(a, ['UNKNOWN', 'ANY']) OR list_has_any(b, ['UNKNOWN', 'ANY']) THEN 0.3 WHEN list_contains(a, 'OBJECT') OR list_contains(b, 'OBJECT') THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM o JOIN f ON o_orderkey = l_orderkey""")
def type_set_scores(spark, sf_dir):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([type_set_score(frozenset(x), frozenset(y)) for x, y in zip(a, b)], dtype="float64")

    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", "MAP").when(F.col("l_returnflag") == "A", "STRING").otherwise("UNKNOWN")).alias("a"))
    b = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("OBJECT"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("STRING"), F.lit("NULL"))).otherwise(F.expr("cast(array() as array<string>)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", b.alias("b")).join(f, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", score("a", "b").alias("score"))


@query("""SELECT a.p_partkey, a.p_name AS a, b.p_name AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def jaro_winkler_pairs(spark, sf_dir):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.withColumnRenamed("p_name", "a").join(after, "p_partkey").select("p_partkey", "a", "b", F.round(score("a", "b"), 6).alias("score"))


_KEYS = """b AS (SELECT DISTINCT CASE WHEN p_size > 40 THEN lower(p_brand) || '.' || lower(p_type) ELSE lower(p_type) || '.core' END AS module FROM part WHERE p_size % 2 = 0),
t AS (SELECT DISTINCT CASE WHEN p_size > 40 THEN lower(p_brand) || '.' || lower(p_type) || CASE WHEN p_size % 4 = 1 THEN 's' ELSE '' END WHEN p_size > 30 THEN lower(p_type) || '.core' WHEN p_size > 20 THEN split_part(p_name, ' ', 1) ELSE 'x' || split_part(p_name, ' ', 2) || lower(p_type) END AS module FROM part WHERE p_size % 2 = 1)"""


@query(f"""WITH {_KEYS}, s AS (SELECT t.module, b.module AS base_module, jaro_winkler_similarity(t.module, b.module) AS score FROM t, b WHERE t.module NOT IN (SELECT module FROM b)),
k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY round(score, 9) DESC, base_module) AS rn FROM s)
SELECT module, module AS base_module FROM t WHERE module IN (SELECT module FROM b) UNION ALL SELECT module, base_module FROM k WHERE rn = 1 AND round(score, 9) > 0.8""")
def namespace_remap(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    both = F.concat(F.lower("p_brand"), F.lit("."), F.lower("p_type"))
    core = F.concat(F.lower("p_type"), F.lit(".core"))
    base = p.where(size % 2 == 0).select(F.when(size > 40, both).otherwise(core).alias("module")).distinct()
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    key = F.when(size > 40, F.concat(both, F.when(size % 4 == 1, "s").otherwise(""))).when(size > 30, core).when(size > 20, word(1)).otherwise(F.concat(F.lit("x"), word(2), F.lower("p_type")))
    return matching.remap_namespaces(base, p.where(size % 2 == 1).select(key.alias("module")).distinct())


_RET = """CASE WHEN len(x.rets) = 0 AND len(y.rets) = 0 THEN 1.0 WHEN len(x.rets) = 0 OR len(y.rets) = 0 THEN 0.0 WHEN list_has_any(x.rets, y.rets) THEN 1.0
 WHEN (list_contains(x.rets, 'MAP') AND list_contains(y.rets, 'OBJECT')) OR (list_contains(y.rets, 'MAP') AND list_contains(x.rets, 'OBJECT')) THEN 0.4 WHEN list_contains(x.rets, 'OBJECT') OR list_contains(y.rets, 'OBJECT') THEN 0.2 ELSE 0.0 END::DOUBLE"""


@query(f"""WITH {_R}, x AS (SELECT DISTINCT ns, rets, isa FROM r WHERE is_base), y AS (SELECT DISTINCT ns, rets, isa FROM r WHERE NOT is_base)
SELECT x.ns, array_to_string(x.rets, ',') AS a, x.isa AS isa_a, array_to_string(y.rets, ',') AS b, y.isa AS isa_b, round({_RET} * 0.7 + CASE WHEN x.isa = y.isa THEN 1.0 ELSE 0.0 END * 0.3, 6)::DOUBLE AS score FROM x JOIN y ON x.ns = y.ns""")
def return_scores(spark, sf_dir):
    @F.pandas_udf("double")
    def score(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([return_score(frozenset(p), bool(q), frozenset(r), bool(s)) for p, q, r, s in zip(a, x, b, y)], dtype="float64")

    cols = [F.col("normalized_namespace").alias("ns"), F.col("normalized_return_types").alias("rets"), F.col("async").alias("isa")]
    x, y = (d.select(*cols).distinct().toDF("ns", f"rets_{s}", f"isa_{s}") for d, s in zip(sides(spark, sf_dir), "ab"))
    return x.join(y, "ns").select("ns", F.array_join("rets_a", ",").alias("a"), "isa_a", F.array_join("rets_b", ",").alias("b"), "isa_b", F.round(score("rets_a", "isa_a", "rets_b", "isa_b"), 6).alias("score"))


_JW = "(CASE WHEN {0} = '' OR {1} = '' THEN 0.0 ELSE round(jaro_winkler_similarity({0}, {1}), 9) END)::DOUBLE"
_PRE = f"""{_R}, q AS (SELECT x.ns, x.cls, x.ord AS base_ord, y.ord AS target_ord, x.rets AS xr, y.rets AS yr, x.isa AS xi, y.isa AS yi, x.p1 AS xp1, x.p2 AS xp2, x.t1 AS xt, y.p1 AS yp1, y.p2 AS yp2, y.t1 AS yt,
 {_JW.format('x.name', 'y.name')} * (CASE x.cls WHEN 'C' THEN 0.0 WHEN 'F' THEN 0.3 + 0.15 ELSE 0.3 END)::DOUBLE AS n, {_JW.format('x.member', 'y.member')} * (CASE x.cls WHEN 'C' THEN 0.6 WHEN 'F' THEN 0.15 ELSE 0.3 END)::DOUBLE AS m, {_JW.format('x.ns', 'y.ns')} * 0.15::DOUBLE AS s
 FROM r x JOIN r y ON x.ns = y.ns AND x.cls = y.cls AND x.is_base AND NOT y.is_base), pre AS (SELECT *, round(n + m + s, 9) AS pre FROM q)"""


#: Pairs of distinct features that are scored at once.
_PAIRS_AT_ONCE = 1_000_000


def _by_module(spark: SparkSession, sf_dir: str, schema: str, score, result) -> DataFrame:
    """Sums over all pairs by module and class of kinds, where both sides have features.

    Equal features are counted by Spark and scored once. score(base sides, target sides,
    class) gives a matrix; result(parts) makes a row of (matrix, how often each base row
    and target column occurs), which come in blocks.
    """

    def run(key, left, right):
        ns, cls = (x.as_py() for x in key)
        rows = []
        if len(left) and len(right):
            (base, n), (target, m) = (([Side.of(r) for r in t.drop_columns("n").to_pylist()], t.column("n").to_numpy()) for t in (left, right))
            step = max(1, _PAIRS_AT_ONCE // len(target))
            rows = [result((score(base[i : i + step], target, cls), n[i : i + step], m) for i in range(0, len(base), step))]
        return pa.table({"ns": pa.array([ns] * len(rows), pa.string()), "cls": pa.array([cls] * len(rows), pa.string()), **{k: [r[k] for r in rows] for k in (rows[0] if rows else {})}}) if rows else pa.Table.from_batches([], empty)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(f"ns string, cls string, {schema}"))
    cols = ["ns", "cls", *(c for c in matching._NEEDED if c != "ord")]
    left, right = (d.select("*", F.col("normalized_namespace").alias("ns"), names.kind_class(F.col("type")).alias("cls")).groupBy(*[F.col(c).alias(c) for c in cols]).agg(F.count("*").alias("n")) for d in sides(spark, sf_dir))
    return left.groupBy("ns", "cls").cogroup(right.groupBy("ns", "cls")).applyInArrow(run, f"ns string, cls string, {schema}")


@query(f"""WITH {_PRE} SELECT ns, cls, count(*) AS pairs, sum(CASE WHEN pre < 0.6 THEN 1 ELSE 0 END)::BIGINT AS early, round(avg(pre), 6) AS mean, round(max(pre), 6) AS best FROM pre GROUP BY ns, cls""")
def pair_score_prelim(spark, sf_dir):
    limits = {cls: round(EARLY_EXIT * sum(Weights().for_class(cls)), 9) for cls in ("C", "F", "M")}

    def score(base, target, cls):
        s = np.round(name_scores(base, target, cls), 9)
        return s, s < limits[cls]

    def result(parts):
        pairs, early, total, best = 0, 0, 0.0, 0.0
        for (s, low), n, m in parts:
            pairs += int(n.sum()) * int(m.sum())
            early += int(n @ (low @ m))
            total += float(n @ (s @ m))
            best = max(best, float(s.max()))
        return {"pairs": pairs, "early": early, "mean": round(total / pairs, 6), "best": round(best, 6)}

    return _by_module(spark, sf_dir, "pairs long, early long, mean double, best double", score, result)


@query(f"""WITH {_PRE}, z AS (SELECT *, {_RET.replace('x.rets', 'xr').replace('y.rets', 'yr')} * 0.7 + CASE WHEN xi = yi THEN 1.0 ELSE 0.0 END * 0.3 AS ret,
 0.5 * {_JW.format('xp1', 'yp1')} + CASE WHEN xt = yt THEN 0.4 ELSE 0.0 END + 0.1 AS p11, 0.5 * {_JW.format('xp1', 'yp2')} + 0.1 AS p12, 0.5 * {_JW.format('xp2', 'yp1')} + 0.1 AS p21, 0.5 * {_JW.format('xp2', 'yp2')} + 0.4 + 0.1 AS p22 FROM pre)
SELECT ns, cls, round(avg(CASE WHEN pre <= 0.6 THEN pre ELSE pre + 0.15 * greatest(p11 + p22, p12 + p21) * 2.0 / 4.0 + 0.1 * ret END), 6)::DOUBLE AS mean FROM z GROUP BY ns, cls""")
def pair_score_full(spark, sf_dir):
    def result(parts):
        pairs, total = 0, 0.0
        for s, n, m in parts:
            pairs += int(n.sum()) * int(m.sum())
            total += float(n @ (s @ m))
        return {"mean": round(total / pairs, 6)}

    return _by_module(spark, sf_dir, "mean double", class_scores, result)


@query("""WITH p AS (SELECT a.n_regionkey AS r, a.n_nationkey AS i, b.n_nationkey AS j, jaro_winkler_similarity(a.n_name, b.n_name) AS s FROM nation a JOIN nation b ON (b.n_regionkey = a.n_regionkey + 1 OR (a.n_regionkey = 4 AND b.n_regionkey = 0))),
k AS (SELECT *, dense_rank() OVER (PARTITION BY r ORDER BY i) AS x FROM p)
SELECT a.r AS region, round(max(a.s + b.s + c.s + d.s + e.s), 6) AS total FROM k a JOIN k b ON a.r = b.r AND a.x = 1 AND b.x = 2 AND b.j <> a.j JOIN k c ON c.r = a.r AND c.x = 3 AND c.j NOT IN (a.j, b.j) JOIN k d ON d.r = a.r AND d.x = 4 AND d.j NOT IN (a.j, b.j, c.j) JOIN k e ON e.r = a.r AND e.x = 5 AND e.j NOT IN (a.j, b.j, c.j, d.j) GROUP BY a.r""")
def assign_small(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    before = F.when(F.col("n_regionkey") == 0, 4).otherwise(F.col("n_regionkey") - 1)

    def best(key, a, b):
        a, b = (t.sort_by("n_nationkey").column("n_name").to_pylist() for t in (a, b))
        grid = np.array([[jaro_winkler(x, y) for y in b] for x in a])
        rows, cols = best_assignment(grid)
        return pa.table({"region": pa.array([key[0].as_py()], pa.int32()), "total": [round(float(grid[rows, cols].sum()), 6)]})

    left, right = n.withColumn("g", F.col("n_regionkey").cast("int")), n.withColumn("g", before.cast("int"))
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(best, "region int, total double")


# matching over view S


_S = """s0 AS (SELECT p_partkey AS k, md5('g' || (p_partkey // 3)) AS module, p_size, p_size % 5 AS change, replace(p_name, ' ', '_') || '_' || substr(md5(p_partkey::VARCHAR), 1, 8) AS name, 'c' || substr(md5('m' || p_partkey), 1, 10) AS member,
 CASE WHEN p_size % 7 = 0 THEN 'INSTANCE_METHOD' WHEN (p_partkey // 3) % 3 = 0 THEN 'CONSTRUCTOR' WHEN (p_partkey // 3) % 3 = 1 THEN CASE WHEN p_partkey % 2 = 1 THEN 'CLASS_METHOD' ELSE 'FUNCTION' END ELSE 'INSTANCE_METHOD' END AS kind,
 CASE WHEN p_retailprice > 1000 THEN ['STRING', 'NULL'] WHEN p_size > 25 THEN ['MAP'] WHEN p_size > 10 THEN ['OBJECT'] ELSE [] END AS rets, p_size > 30 AS isa, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, CASE WHEN p_size > 20 THEN 'NUMBER' ELSE 'LIST' END AS t1, p_size % 2 = 0 AS o1 FROM part),
s AS (SELECT *, CASE kind WHEN 'CONSTRUCTOR' THEN 'C' WHEN 'INSTANCE_METHOD' THEN 'M' ELSE 'F' END AS cls, CASE WHEN k % 17 = 0 THEN 'null' ELSE member END AS shown FROM s0),
x AS (SELECT *, 2 * k AS ord, name || CASE WHEN p_size % 10 = 1 THEN '"q",' ELSE '' END AS original, w1 AS p1, t1 AS a1, o1 AS b1, w2 AS p2, 'STRING' AS a2, FALSE AS b2, row_number() OVER (PARTITION BY module, cls ORDER BY k) AS i FROM s WHERE p_size % 11 <> 0),
y0 AS (SELECT k, module, cls, kind, p_size, change, 2 * k + 1 AS ord, CASE change WHEN 1 THEN name || '_x' WHEN 3 THEN reverse(name) ELSE name END AS name, CASE change WHEN 2 THEN substr(md5('o' || k), 1, 10) WHEN 3 THEN reverse(member) ELSE member END AS member, shown, CASE WHEN change = 4 THEN ['OBJECT'] ELSE rets END AS rets, isa <> (change = 4) AS isa,
 CASE WHEN change = 4 THEN w2 ELSE w1 END AS p1, CASE WHEN change = 4 THEN 'STRING' ELSE t1 END AS a1, CASE WHEN change = 4 THEN TRUE ELSE o1 END AS b1, CASE change WHEN 4 THEN w1 WHEN 1 THEN w2 || 's' ELSE w2 END AS p2, CASE WHEN change = 4 THEN t1 ELSE 'STRING' END AS a2, CASE WHEN change = 4 THEN o1 ELSE FALSE END AS b2 FROM s WHERE p_size % 13 <> 0),
y AS (SELECT *, name AS original, row_number() OVER (PARTITION BY module, cls ORDER BY k) AS j FROM y0)"""


def _small(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """View S: base and target features."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    third = F.floor(k / 3)
    code = lambda lead, n: F.substr(F.md5(F.concat(F.lit(lead), k.cast("string")).cast("binary")), F.lit(1), F.lit(n))
    name, member = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), code("", 8)), F.concat(F.lit("c"), code("m", 10))
    kind = F.when(size % 7 == 0, "INSTANCE_METHOD").when(third % 3 == 0, "CONSTRUCTOR").when(third % 3 == 1, F.when(k % 2 == 1, "CLASS_METHOD").otherwise("FUNCTION")).otherwise("INSTANCE_METHOD")
    rets = F.when(F.col("p_retailprice") > 1000, F.array(F.lit("STRING"), F.lit("NULL"))).when(size > 25, F.array(F.lit("MAP"))).when(size > 10, F.array(F.lit("OBJECT"))).otherwise(F.expr("cast(array() as array<string>)"))
    w1, w2 = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    t1, o1, change = F.when(size > 20, "NUMBER").otherwise("LIST"), size % 2 == 0, size % 5
    one = lambda name, t, o: F.struct(name.alias("original_name"), name.alias("normalized_name"), F.array(t).alias("original_types"), F.array(t).alias("normalized_types"), F.lit(None).cast("string").alias("description"), o.alias("is_optional"))
    text, no = F.lit("STRING"), F.lit(False)
    shared = [F.md5(F.concat(F.lit("g"), third.cast("string")).cast("binary")).alias("normalized_namespace"), kind.alias("type"), F.when(k % 17 == 0, "null").otherwise(member).alias("member_of")]
    base = p.where(size % 11 != 0).select(
        *shared,
        (2 * k).alias("ord"),
        name.alias("normalized_name"),
        F.concat(name, F.when(size % 10 == 1, '"q",').otherwise("")).alias("original_name"),
        member.alias("normalized_member_of"),
        rets.alias("normalized_return_types"),
        (size > 30).alias("async"),
        F.array(one(w1, t1, o1), one(w2, text, no)).alias("parameters"),
    )
    other = F.when(change == 1, F.concat(name, F.lit("_x"))).when(change == 3, F.reverse(name)).otherwise(name)
    plain = F.array(one(w1, t1, o1), one(F.concat(w2, F.when(change == 1, "s").otherwise("")), text, no))
    target = p.where(size % 13 != 0).select(
        *shared,
        (2 * k + 1).alias("ord"),
        other.alias("normalized_name"),
        other.alias("original_name"),
        F.when(change == 2, code("o", 10)).when(change == 3, F.reverse(member)).otherwise(member).alias("normalized_member_of"),
        F.when(change == 4, F.array(F.lit("OBJECT"))).otherwise(rets).alias("normalized_return_types"),
        ((size > 30) != (change == 4)).alias("async"),
        F.when(change == 4, F.array(one(w2, text, F.lit(True)), one(w1, t1, o1))).otherwise(plain).alias("parameters"),
    )
    return with_defaults(base), with_defaults(target)


def _like(i: int, j: int) -> str:
    return f"(0.5 * {_JW.format(f'x.p{i}', f'y.p{j}')} + CASE WHEN x.a{i} = y.a{j} THEN 0.4 ELSE 0.0 END + CASE WHEN x.b{i} = y.b{j} THEN 0.1 ELSE 0.0 END)"


def _pass(n: int, pairs: str, above: float) -> str:
    """CTEs that assign the rows of `pairs` (module, cls, i, j, bo, tg, score) by trying all orders of three."""
    return f"""tot{n} AS (SELECT module, cls, perm.id, round(sum(score), 9) AS total FROM {pairs} JOIN perm ON j = perm.js[i] GROUP BY module, cls, perm.id),
won{n} AS (SELECT module, cls, id FROM (SELECT *, row_number() OVER (PARTITION BY module, cls ORDER BY total DESC, id) AS rn FROM tot{n}) WHERE rn = 1),
hit{n} AS (SELECT {pairs}.* FROM {pairs} JOIN won{n} USING (module, cls) JOIN perm ON perm.id = won{n}.id WHERE j = perm.js[i] AND score > {above})"""


_CASCADE = f"""{_S}, q AS (SELECT x.module, x.cls, i, j, x.ord AS bo, y.ord AS tg,
 {_JW.format('x.name', 'y.name')} * (CASE x.cls WHEN 'C' THEN 0.0 WHEN 'F' THEN 0.3 + 0.15 ELSE 0.3 END)::DOUBLE + {_JW.format('x.member', 'y.member')} * (CASE x.cls WHEN 'C' THEN 0.6 WHEN 'F' THEN 0.15 ELSE 0.3 END)::DOUBLE + 0.15::DOUBLE AS pre,
 0.15 * greatest({_like(1, 1)} + {_like(2, 2)}, {_like(1, 2)} + {_like(2, 1)}) * 2.0 / 4.0 + 0.1 * ({_RET} * 0.7 + CASE WHEN x.isa = y.isa THEN 0.3 ELSE 0.0 END) AS more FROM x JOIN y ON x.module = y.module AND x.cls = y.cls),
sc AS (SELECT module, cls, i, j, bo, tg, CASE WHEN round(pre, 9) <= 0.6 THEN pre ELSE pre + more END AS score FROM q),
perm AS (SELECT * FROM (VALUES (1, [1, 2, 3]), (2, [1, 3, 2]), (3, [2, 1, 3]), (4, [2, 3, 1]), (5, [3, 1, 2]), (6, [3, 2, 1])) v(id, js)),
{_pass(1, 'sc', 0.8)}, left_ AS (SELECT * FROM sc WHERE bo NOT IN (SELECT bo FROM hit1) AND tg NOT IN (SELECT tg FROM hit1)), {_pass(2, 'left_', 0.65)},
got AS (SELECT module, 'solid' AS kind, bo, tg, score FROM hit1 UNION ALL SELECT module, 'potential', bo, tg, score FROM hit2),
m0 AS (SELECT * FROM got UNION ALL SELECT module, 'base_only', ord, NULL, 0.0 FROM x WHERE ord NOT IN (SELECT bo FROM got) UNION ALL SELECT module, 'target_only', NULL, ord, 0.0 FROM y WHERE ord NOT IN (SELECT tg FROM got)),
mt AS (SELECT DISTINCT module FROM x),
m AS (SELECT *, row_number() OVER (PARTITION BY module, kind ORDER BY coalesce(bo, tg)) - 1 AS place FROM m0 WHERE module IN (SELECT module FROM mt)),
sm AS (SELECT *, CASE WHEN target > 0 THEN solid::DOUBLE / target ELSE 1.0 END AS precision, CASE WHEN base > 0 THEN solid::DOUBLE / base ELSE 1.0 END AS recall, CASE WHEN base + target - solid > 0 THEN solid::DOUBLE / (base + target - solid) ELSE 1.0 END AS jaccard
 FROM (SELECT module, count(bo) AS base, count(tg) AS target, count(CASE WHEN kind = 'solid' THEN 1 END) AS solid, count(CASE WHEN kind = 'potential' THEN 1 END) AS potential FROM m GROUP BY module)),
sf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1, replace(module, '.', '_') || '.md' AS file FROM sm)"""


def _small_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = (matching.with_module(d) for d in _small(spark, sf_dir))
    return matching.match_features(base, matching.remap_target(base, target))


@query(f"WITH {_CASCADE} SELECT module, kind, bo AS base_ord, tg AS target_ord, round(score, 6) AS score, place FROM m")
def match_cascade(spark, sf_dir):
    return _small_matches(spark, sf_dir).select("module", "kind", "base_ord", "target_ord", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_CASCADE} SELECT module, base, target, solid, potential, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(jaccard, 9) AS jaccard FROM sf")
def parity_summary(spark, sf_dir):
    m = metrics.module_summary(_small_matches(spark, sf_dir))
    return m.select("module", "base", "target", "solid", "potential", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


@query(f"""WITH {_CASCADE}, n AS (SELECT (SELECT count(*) FROM x) AS base, (SELECT count(*) FROM y) AS target, (SELECT sum(solid)::BIGINT FROM sm) AS solid), r AS (SELECT *, solid::DOUBLE / target AS p, solid::DOUBLE / base AS r FROM n)
SELECT base, target, solid, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round(solid::DOUBLE / (base + target - solid), 9) AS jaccard FROM r""")
def global_parity(spark, sf_dir):
    base, target = _small(spark, sf_dir)
    total = metrics.global_summary(metrics.module_summary(_small_matches(spark, sf_dir)), base.count(), target.count())
    return total.select("base", "target", "solid", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


_ICON = "CASE WHEN {0} = 1.0 THEN '✅' WHEN {0} >= 0.8 THEN '⚠️' ELSE '❌' END"
_CODES = "CASE WHEN base > 0 AND target > 0 THEN 'python, ts' WHEN base > 0 THEN 'python' ELSE 'ts' END"


@query(f"WITH {_CASCADE} SELECT module, round(jaccard, 9) AS score, {_ICON.format('jaccard')} AS icon, file, {_CODES} AS languages, base + target - solid AS features FROM sf")
def symmetric_modules(spark, sf_dir):
    m = ranked_modules(metrics.module_summary(_small_matches(spark, sf_dir)), "PYTHON", "TYPESCRIPT", True)
    return m.select("module", F.round("score", 9).alias("score"), "icon", "file", "languages", "features")


@query(f"WITH {_CASCADE} SELECT module, round(f1, 9) AS score, {_ICON.format('f1')} AS icon, file, base AS features FROM sf WHERE base > 0")
def directional_modules(spark, sf_dir):
    m = ranked_modules(metrics.module_summary(_small_matches(spark, sf_dir)), "PYTHON", "TYPESCRIPT", False)
    return m.select("module", F.round("score", 9).alias("score"), "icon", "file", "features")


_SIDES = f"""{_CASCADE}, cell AS (SELECT ord, module, kind AS type, name, shown, original, CASE kind WHEN 'CONSTRUCTOR' THEN 'constructor' WHEN 'INSTANCE_METHOD' THEN 'method' ELSE 'function' END AS word, CASE kind WHEN 'CONSTRUCTOR' THEN 0 WHEN 'INSTANCE_METHOD' THEN 2 ELSE 1 END AS prio,
 CASE WHEN shown = 'null' THEN original ELSE shown || '.' || original END AS display, module || ',' || CASE WHEN shown = 'null' THEN '' ELSE shown END || ',' || CASE WHEN contains(original, ',') THEN '"' || replace(original, '"', '""') || '"' ELSE original END AS csv
 FROM (SELECT ord, module, kind, name, shown, original FROM x UNION ALL SELECT ord, module, kind, name, shown, original FROM y)),
both_ AS (SELECT m.*, CASE m.kind WHEN 'solid' THEN 1 WHEN 'potential' THEN 2 WHEN 'base_only' THEN 3 ELSE 4 END AS rank, a.display AS bd, b.display AS td, coalesce(a.word, b.word) AS word, a.prio, a.name AS bn, coalesce(a.csv, ',,') || ',' || coalesce(b.csv, ',,') || ',' || coalesce(a.word, b.word) || ',' || printf('%.4f', score) AS line
 FROM m LEFT JOIN cell a ON a.ord = m.bo LEFT JOIN cell b ON b.ord = m.tg)"""


@query(f"WITH {_SIDES} SELECT module, rank, place, line FROM both_")
def raw_report_rows(spark, sf_dir):
    _, rows = matched_rows(*_small(spark, sf_dir), 0.8)
    return raw_lines(rows)


def _lines(spark: SparkSession, text: str) -> list[tuple[int, str]]:
    return list(enumerate(text.split("\n")))


def _report(spark: SparkSession, sf_dir: str, kind: str):
    base, target = _small(spark, sf_dir)
    return match_registries(Registry("PYTHON", "1.0", base), Registry("TYPESCRIPT", "2.0", target), 0.8, kind, "acme", datetime.datetime(2024, 1, 2))


def _summary_lines(spark: SparkSession, text: str) -> DataFrame:
    """Rows of the module table, in order, and other lines that hold a percentage or name a registry."""
    lines = [x for x in text.split("\n") if x.startswith(("| python", "| ts", "| `", "| **", "**", "Date"))]
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


_PCT = "printf('%.2f%%', 100 * {0})"


@query(f"""WITH {_CASCADE}, t AS (SELECT sum(solid)::DOUBLE / ((SELECT count(*) FROM x) + (SELECT count(*) FROM y) - sum(solid)) AS j FROM sm),
h AS (SELECT 0 AS n, 'Date: 2024-01-02 00:00:00' AS line UNION ALL SELECT 1, '| **Base** | PYTHON | 1.0 |' UNION ALL SELECT 2, '| **Target** | TYPESCRIPT | 2.0 |' UNION ALL SELECT 3, '**Jaccard Index:** ' || {_PCT.format('j')} FROM t)
SELECT n::INTEGER AS n, line FROM h UNION ALL SELECT (3 + row_number() OVER (ORDER BY jaccard DESC, module))::INTEGER, '| ' || {_CODES} || ' | `' || module || '` | ' || base || ' | ' || {_PCT.format('jaccard')} || ' | ' || {_ICON.format('jaccard')} || ' | [View Details]({{modules_dir}}/' || file || ') |' FROM sf""")
def symmetric_report(spark, sf_dir):
    return _summary_lines(spark, _report(spark, sf_dir, "symmetric").master_content)


@query(f"""WITH {_CASCADE}, t AS (SELECT sum(CASE WHEN base > 0 THEN solid ELSE 0 END)::DOUBLE / (SELECT count(*) FROM y) AS p, sum(CASE WHEN base > 0 THEN solid ELSE 0 END)::DOUBLE / (SELECT count(*) FROM x) AS r FROM sm),
h AS (SELECT 0 AS n, 'Date: 2024-01-02 00:00:00' AS line UNION ALL SELECT 1, '**Base:** PYTHON (1.0)' UNION ALL SELECT 2, '**Target:** TYPESCRIPT (2.0)' UNION ALL SELECT 3, '| **Precision** | ' || {_PCT.format('p')} || ' |' FROM t UNION ALL SELECT 4, '| **Recall** | ' || {_PCT.format('r')} || ' |' FROM t UNION ALL SELECT 5, '| **F1 Score** | ' || {_PCT.format('2 * p * r / (p + r)')} || ' |' FROM t)
SELECT n::INTEGER AS n, line FROM h UNION ALL SELECT (5 + row_number() OVER (ORDER BY f1 DESC, module))::INTEGER, '| `' || module || '` | ' || base || ' | ' || {_PCT.format('f1')} || ' | ' || {_ICON.format('f1')} || ' | [View Details]({{modules_dir}}/' || file || ') |' FROM sf WHERE base > 0""")
def directional_report(spark, sf_dir):
    return _summary_lines(spark, _report(spark, sf_dir, "directional").master_content)


@query(f"""WITH {_SIDES}, l AS (SELECT replace(module, '.', '_') || '.md' AS file, row_number() OVER (PARTITION BY module ORDER BY rank, CASE WHEN rank < 3 THEN prio END, CASE WHEN rank < 3 THEN bn END, place) - 1 AS n,
 CASE rank WHEN 3 THEN '| `' || bd || '` | Target |' WHEN 4 THEN '| `' || td || '` | Base |' ELSE '| ' || word || ' | `' || bd || '` | `' || td || '` | ' || printf('%.2f', score) || ' |' END AS line FROM both_)
SELECT file, n::INTEGER AS n, line FROM l UNION ALL SELECT file, -1, '**Score:** ' || {_PCT.format('jaccard')} || ' (' || {_ICON.format('jaccard')} || ')' FROM sf UNION ALL SELECT file, -2, '**Features:** ' || (base + target - solid) FROM sf UNION ALL SELECT file, -3, '[⬅️ Back to Master Report](../out.md)' FROM sf""")
def module_reports(spark, sf_dir):
    """Tables of the module reports, as written beside the main report."""
    import tempfile
    from pathlib import Path

    from ..operators.reports import write_report

    rows = []
    with tempfile.TemporaryDirectory() as d:
        write_report(_report(spark, sf_dir, "symmetric"), Path(d) / "out.md")
        for p in sorted((Path(d) / "out_modules").iterdir()):
            lines = p.read_text(encoding="utf-8").split("\n")
            rows += [(p.name, n, x) for n, x in enumerate(x for x in lines if x.startswith(("| constructor", "| function", "| method", "| `")))]
            rows += [(p.name, -1 - i, x) for i, lead in enumerate(("**Score", "**Features", "[")) for x in lines if x.startswith(lead)]
    return spark.createDataFrame(rows, "file string, n int, line string")


@query(f"""WITH {_SIDES} SELECT 0 AS n, 'python_namespace,python_member_of,python_name,ts_namespace,ts_member_of,ts_name,type,score' AS line UNION ALL SELECT row_number() OVER (ORDER BY module, rank, place)::INTEGER, line FROM both_""")
def command_line_raw_report(spark, sf_dir):
    """Registries written in text format, and the raw report that the command line makes of the files."""
    import tempfile
    from pathlib import Path

    from .. import cli
    from ..sources import textproto

    with tempfile.TemporaryDirectory() as d:
        for name, language, rows in zip(("base", "target"), ("PYTHON", "TYPESCRIPT"), _small(spark, sf_dir)):
            textproto.write_textproto(Registry(language, "1.0", rows), Path(d) / f"{name}.txtpb")
        code = cli.main(["report", "--base", f"{d}/base.txtpb", "--target", f"{d}/target.txtpb", "--output", d, "--report-type", "raw"])
        text = (Path(d) / "py_ts_raw.csv").read_text(encoding="utf-8") if code == 0 else f"exit {code}"
    return spark.createDataFrame(_lines(spark, text), "n int, line string")


@query(f"""WITH {_S}, n AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS n FROM x) SELECT f.form, n.n::INTEGER AS n, name, original, shown AS member, kind AS type, isa AS is_async, array_to_string(rets, ',') AS rets, p1 || ':' || a1 || ':' || b1 || ',' || p2 || ':' || a2 || ':' || b2 AS params FROM n, (VALUES ('json'), ('yaml'), ('txtpb'), ('parquet')) f(form)""")
def registry_formats(spark, sf_dir):
    """The base of view S in each format, read back. Rows stay with the executors, as files are gone when the query returns."""
    import tempfile
    from functools import reduce
    from pathlib import Path

    from ..sources import textproto

    registry = Registry("PYTHON", "1.0", _small(spark, sf_dir)[0])
    writers = {"json": textproto.write_json, "yaml": textproto.write_yaml, "txtpb": textproto.write_textproto}
    param = lambda p: F.concat(p["normalized_name"], F.lit(":"), F.array_join(p["normalized_types"], ","), F.lit(":"), p["is_optional"].cast("string"))
    found = []
    with tempfile.TemporaryDirectory() as d:
        for form in ("json", "yaml", "txtpb", "parquet"):
            at = Path(d) / f"r.{form}"
            if form == "parquet":
                textproto.write_parquet(registry, str(at))
                rows = textproto.read_registry(spark, str(at)).features.repartitionByRange("ord").withColumn("block", F.spark_partition_id().cast("long")).localCheckpoint()
                rows = textproto.numbered(rows, "block", ["ord"], "n")
            else:
                writers[form](registry, at)
                rows = textproto.read_written(spark, f"file://{at}", form).withColumn("n", F.col("ord"))
            found.append(
                rows.select(
                    F.lit(form).alias("form"), F.col("n").cast("int").alias("n"), F.col("normalized_name").alias("name"), F.col("original_name").alias("original"), F.col("member_of").alias("member"), "type",
                    F.col("async").alias("is_async"), F.array_join("normalized_return_types", ",").alias("rets"), F.array_join(F.transform("parameters", param), ",").alias("params"),
                ).localCheckpoint()
            )
    return reduce(DataFrame.unionByName, found)


@query("""SELECT count(CASE WHEN p_size <= 25 THEN 1 END) AS base_rows, count(CASE WHEN p_size > 25 THEN 1 END) AS target_rows, 0::BIGINT AS base_twice, 0::BIGINT AS target_twice, 0::BIGINT AS wrong_score FROM part""")
def match_invariants(spark, sf_dir):
    """View R, whose modules are too large for SQL to assign."""
    base, target = (matching.with_module(d) for d in sides(spark, sf_dir))
    m = matching.match_features(base, matching.remap_target(base, target))
    wrong = F.count_if(((F.col("kind") == "solid") & (F.col("score") <= 0.8)) | ((F.col("kind") == "potential") & ((F.col("score") <= 0.65 - 1e-9) | (F.col("score") > 1))))
    b, t = F.col("base_ord"), F.col("target_ord")
    return m.agg(F.count(b).alias("base_rows"), F.count(t).alias("target_rows"), (F.count(b) - F.countDistinct(b)).alias("base_twice"), (F.count(t) - F.countDistinct(t)).alias("target_twice"), wrong.alias("wrong_score"))


_PRF = "CASE WHEN target > 0 THEN solid::DOUBLE / target ELSE 1.0 END AS p, CASE WHEN base > 0 THEN solid::DOUBLE / base ELSE 1.0 END AS r"


@query(f"""WITH c AS (SELECT source, sum(quality)::BIGINT AS base, sum(toxic)::BIGINT AS target, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS solid FROM documents JOIN labels USING (doc_id) GROUP BY source), m AS (SELECT *, {_PRF} FROM c)
SELECT source, base, target, solid, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m""")
def precision_recall_f1(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    both = F.sum(F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).otherwise(0))
    c = j.groupBy("source").agg(F.sum("quality").alias("base"), F.sum("toxic").alias("target"), both.cast("long").alias("solid"))
    m = metrics.with_metrics(c)
    return m.select("source", "base", "target", "solid", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


_PATH = "replace(replace(replace(regexp_replace(url, '^[a-z]+://', '/'), '.example', '/.hidden'), '?page=', '/node_modules/page'), '?', '/a.') || CASE WHEN page_id < 100 THEN '.d.ts' ELSE '.ts' END"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, NOT ends_with(path, '.d.ts') AND NOT list_contains(string_split(path, '/'), 'node_modules') AND len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') AND x NOT IN ('.', '..'))) = 0 AS kept, list_has_any(string_split(path, '/'), ['en', 'fr']) AS excluded FROM p""")
def scan_predicates(spark, sf_dir):
    path = F.replace(F.replace(F.replace(F.regexp_replace("url", "^[a-z]+://", "/"), F.lit(".example"), F.lit("/.hidden")), F.lit("?page="), F.lit("/node_modules/page")), F.lit("?"), F.lit("/a."))
    path = F.concat(path, F.when(F.col("page_id") < 100, ".d.ts").otherwise(".ts"))
    return table(spark, sf_dir, "pages").select("page_id", scan.keeps(path, "typescript").alias("kept"), scan.excluded(path, ["en", "fr"]).alias("excluded"))


# extraction: each part is a source file


_LANGUAGES = ("python", "typescript", "java", "go")


@query(f"""WITH p AS (SELECT page_id, lang, '/r/' || {_pick('page_id', ['a', '.git', 'test', 'bin', 'node_modules', 'b.c'])} || '/' || {_pick('page_id // 2', ['x', 'build', '_y', '..'])} || '/' || {_pick('page_id // 3', ['__init__', 'setup', 'conftest', 'version', 'm', 'package-info', 'm_test', 'types.d', '.h'])} || '.' || {_pick('page_id // 4', ['py', 'ts', 'java', 'go'])} AS path FROM pages, (VALUES ('python'), ('typescript'), ('java'), ('go')) v(lang)),
s AS (SELECT *, string_split(path, '/') AS parts, parts[-1] AS name FROM p)
SELECT page_id, lang, ends_with(path, CASE lang WHEN 'python' THEN '.py' WHEN 'typescript' THEN '.ts' WHEN 'java' THEN '.java' ELSE '.go' END) AND len(list_filter(parts, lambda x: starts_with(x, '.') AND x NOT IN ('.', '..'))) = 0
 AND NOT (lang = 'python' AND name IN ('__init__.py', 'setup.py', 'conftest.py', 'version.py')) AND NOT (lang = 'typescript' AND (ends_with(name, '.d.ts') OR list_contains(parts, 'node_modules'))) AND NOT (lang = 'java' AND (name IN ('package-info.java', 'module-info.java') OR list_has_any(parts, ['bin', 'build', 'node_modules', 'out', 'target', 'test']))) AS kept,
 NOT (lang = 'go' AND ends_with(name, '_test.go')) AS holds FROM s""")
def scan_languages(spark, sf_dir):
    k = F.col("page_id")
    at = lambda n, *v: _chosen(F.floor(k / n), list(v))
    path = F.concat(F.lit("/r/"), at(1, "a", ".git", "test", "bin", "node_modules", "b.c"), F.lit("/"), at(2, "x", "build", "_y", ".."), F.lit("/"), at(3, "__init__", "setup", "conftest", "version", "m", "package-info", "m_test", "types.d", ".h"), F.lit("."), at(4, "py", "ts", "java", "go"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    each = [rows.select("page_id", F.lit(x).alias("lang"), scan.keeps(F.col("path"), x).alias("kept"), scan.holds_features(F.col("path"), x).alias("holds")) for x in _LANGUAGES]
    return each[0].union(each[1]).union(each[2]).union(each[3])


@query("""WITH f AS (SELECT 'f_' || replace(lower(n_name), ' ', '_') AS name, n_regionkey AS r, n_nationkey AS k FROM nation)
SELECT 'repo' AS mode, name FROM f WHERE r <> 3 AND k % 7 <> 0 UNION ALL SELECT 'dir', name FROM f WHERE r = 1 AND k % 7 <> 0 UNION ALL SELECT 'file', name FROM f WHERE k = 8 UNION ALL SELECT 'command line', name FROM f WHERE r = 2 AND k % 7 <> 0 UNION ALL SELECT 'version', '7.1' UNION ALL SELECT 'files', count(*)::VARCHAR FROM f WHERE r <> 3 AND k % 7 <> 0""")
def scan_tree(spark, sf_dir):
    """A tree of the nations' files: all of a repository but an excluded folder and hidden ones, one folder, one file, and the command line."""
    import tempfile
    from pathlib import Path

    from .. import cli
    from ..operators.extraction import extract
    from ..sources.textproto import parse_registry

    with tempfile.TemporaryDirectory() as d:
        root = Path(d)
        for r in table(spark, sf_dir, "nation").collect():
            name = r["n_name"].lower().replace(" ", "_")
            p = root / "src" / "pkg" / f"r{r['n_regionkey']}" / (".venv" if r["n_nationkey"] % 7 == 0 else "") / f"{name}.py"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(f"def f_{name}(a: int): pass\n")
            (p.parent / "notes.txt").write_text("def no(): pass")
        (root / "src/pkg/version.py").write_text("__version__ = '7.1'\n")
        (root / "config.yaml").write_text("python:\n  source_root: src\n  exclude: [r3]\n")
        project = scan.Project("lib", "pkg")
        whole = extract(spark, root, "python", "repo", None, project)
        one = table(spark, sf_dir, "nation").where("n_nationkey = 8").first()
        found = {"repo": whole, "dir": extract(spark, root / "src/pkg/r1", "python", "dir", {}), "file": extract(spark, root / f"src/pkg/r{one['n_regionkey']}/{one['n_name'].lower().replace(' ', '_')}.py", "python", "file", {})}
        rows = [(mode, r["original_name"]) for mode, x in found.items() for r in x.features.collect()] + [("version", whole.version), ("files", str(whole.files.count()))]
        code = cli.main(["extract", "--language", "python", "--input-dir", f"{d}/src/pkg/r2", f"{d}/out"])
        rows += [("command line", f["original_name"]) for f in (parse_registry((root / "out/py.txtpb").read_text())["features"] if code == 0 else [])]
    return spark.createDataFrame(rows, "mode string, name string")


@query("""WITH p AS (SELECT page_id AS n, page_id % 8 AS w, page_id || '.' || page_id % 5 AS v FROM pages)
SELECT n, CASE w WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'go' WHEN 5 THEN 'maven' WHEN 6 THEN 'maven' ELSE 'gradle' END AS kind, CASE WHEN w IN (1, 3) THEN '0.0.0' WHEN w = 4 THEN 'example.org/m' || v ELSE v END AS version FROM p""")
def version_scrape(spark, sf_dir):
    w = F.col("page_id") % 8
    v = F.concat(F.col("page_id").cast("string"), F.lit("."), (F.col("page_id") % 5).cast("string"))
    put = lambda before, after: F.concat(F.lit(before), v, F.lit(after))
    c = F.when(w == 0, put('import x\n__version__ = "', '"\n')).when(w == 1, "x = 1").when(w == 2, put('{"name": "a", "version": "', '"}')).when(w == 3, "{}").when(w == 4, put("// c\nmodule example.org/m", "\n\ngo 1.22"))
    c = c.when(w == 5, put("<project><parent><version>9</version></parent><version>", "</version></project>")).when(w == 6, put('<project xmlns="http://x"><parent><version>', "</version></parent></project>")).otherwise(put("plugins {}\nversion = '", "'\n"))
    kind = _chosen(w, ["python", "python", "typescript", "typescript", "go", "maven", "maven", "gradle"])
    df = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), kind.alias("kind"), c.alias("content"))
    c, kind = F.col("content"), F.col("kind")
    xml = F.when(kind == "maven", c).otherwise("<project/>")
    got = F.when(kind == "python", scan.python_version(c)).when(kind == "typescript", scan.typescript_version(F.when(kind == "typescript", c))).when(kind == "go", scan.go_module(c)).when(kind == "gradle", scan.gradle_version(c)).otherwise(scan.maven_version(xml))
    return df.select("n", "kind", got.alias("version"))


def _filled(template: str) -> Column:
    """The template with @names@ replaced by columns of _files."""
    return F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(template.split("@"))])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    # a part becomes a file of a hundred times its size, and the table may be a single row group: rows are spread before
    p = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string").alias("even"), F.col("p_size").alias("s"), F.lower("p_type").alias("t"), word(1).alias("w1"), word(2).alias("w2"))
    return p.select("*", F.initcap("w1").alias("W1x"), F.initcap("w2").alias("W2x"), F.when(F.col("s") % 2 == 0, "int").otherwise("Thing").alias("kind"))


_FILES = """f AS (SELECT p_partkey::VARCHAR AS k, p_size AS s, lower(p_type) AS t, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, upper(w1[1]) || w1[2:] AS u1, upper(w2[1]) || w2[2:] AS u2 FROM part)"""


def _flat(features: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    param = lambda p: F.concat_ws(":", p["original_name"], p["normalized_name"], F.array_join(p["normalized_types"], "+"), p["is_optional"].cast("string"), F.coalesce(p["description"], F.lit("-")))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("ord"))
    return features.select(
        F.col("file_path").alias("path"), place.alias("place"), F.col("original_name").alias("name"), "normalized_name", F.col("member_of").alias("member"), "normalized_member_of", "type", "namespace", "normalized_namespace", dash("maturity").alias("maturity"), F.coalesce("async", F.lit(False)).alias("is_async"), dash("description").alias("description"),
        F.array_join(F.transform("parameters", param), "|").alias("params"), F.array_join("original_return_types", "|").alias("returns"), F.array_join("normalized_return_types", "+").alias("kinds"),
    )


def _expected(path: str, namespace: str, key: str, rows: list[tuple], dropped: str = "FALSE") -> str:
    """SQL for features of each file: (name, normalized, member, normalized member, type, maturity, async, description, params, returns, kinds, condition)."""
    one = "SELECT path, {n} AS n, {0} AS name, {1} AS normalized_name, {2} AS member, {3} AS normalized_member_of, '{4}' AS type, {ns} AS namespace, {key} AS normalized_namespace, '{5}' AS maturity, {6} AS is_async, {7} AS description, {8} AS params, {9} AS returns, '{10}' AS kinds FROM g WHERE {11}"
    union = " UNION ALL ".join(one.format(*r, n=i, ns=namespace, key=key) for i, r in enumerate(rows))
    cols = "name, normalized_name, member, normalized_member_of, type, namespace, normalized_namespace, maturity, is_async, description, params, returns, kinds"
    return f"WITH {_FILES}, g AS (SELECT *, {path} AS path FROM f WHERE NOT ({dropped})), e AS ({union}) SELECT path, row_number() OVER (PARTITION BY path ORDER BY n)::INTEGER AS place, {cols} FROM e"


_PY = '''class Box@k@:
    """@w1@ box."""
    @w1@: int
    @w2@: list[str] = []
    _x: int = 0

class Run@k@:
    def __init__(self, a: @kind@, *, limit: int = 3, **kw): pass
    @AT@classmethod
    def make_@w1@(cls, p: Optional[str] = None) -> "Run": pass
    async def run@W2x@(self, q: str | None, *args: int) -> list[str]:
        """Runs @w2@.

        Args:
          q (str): The @w1@
            goes on.
          args: Rest of @w2@.
        Returns:
          things
        """
    def _private(self): pass
    @AT@deprecated
    def old_@w2@(self): pass

def free_@w1@(a, b=1) -> dict: pass
'''


def _source(template: str) -> Column:
    return F.replace(_filled(template.replace("@AT@", "@at@")), F.lit("\x01"), F.lit("@"))


def _extracted(sources: DataFrame, language: str, source_root: str) -> DataFrame:
    from ..operators import extraction
    from ..operators.ordering import boundaries

    sources = sources.select("path", F.col("content").cast("binary").alias("content"))
    edges = boundaries(sources.select("path"))
    if language == "typescript":
        sources = extraction.with_types(sources, extraction.type_map(sources))
    return _flat(extraction.to_features(extraction.parse(sources, language), language, "/repo", source_root, scan.Project("acme", "pkg", "com.acme"), edges))


_KIND = "CASE WHEN s % 2 = 0 THEN 'NUMBER' ELSE 'OBJECT' END"
_PY_PATH = "'/repo/src/pkg/' || CASE WHEN s % 8 = 0 THEN 'cli' ELSE t END || '/' || CASE WHEN s % 9 = 0 THEN '_' ELSE '' END || 'm' || k || '.py'"
_PY_ROWS = [
    ("'__init__'", "'__init__'", "'Run' || k", "'run' || k", "CONSTRUCTOR", "-", "FALSE", "'-'", f"'a:a:' || {_KIND} || ':false:-|limit:limit:NUMBER:true:-|kw:kw:OBJECT:false:-'", "''", "", "TRUE"),
    ("'make_' || w1", "'make_' || w1", "'Run' || k", "'run' || k", "CLASS_METHOD", "-", "FALSE", "'-'", "'p:p:NULL+STRING:true:-'", "'\"Run\"'", "OBJECT", "TRUE"),
    ("'run' || u2", "'run_' || w2", "'Run' || k", "'run' || k", "INSTANCE_METHOD", "-", "TRUE", "'Runs ' || w2 || '.'", "'q:q:NULL+STRING:false:The ' || w1 || ' goes on.|args:args:NUMBER:false:Rest of ' || w2 || '.'", "'list[str]'", "LIST", "TRUE"),
    ("'old_' || w2", "'old_' || w2", "'Run' || k", "'run' || k", "INSTANCE_METHOD", "DEPRECATED", "FALSE", "'-'", "''", "''", "", "TRUE"),
    ("'free_' || w1", "'free_' || w1", "'null'", "''", "FUNCTION", "-", "FALSE", "'-'", "'a:a:OBJECT:false:-|b:b:OBJECT:true:-'", "'dict'", "MAP", "s % 8 <> 0 AND s % 9 <> 0"),
    ("'Box' || k", "'box' || k", "'Box' || k", "'box' || k", "CONSTRUCTOR", "-", "FALSE", "w1 || ' box.'", "w1 || ':' || w1 || ':NUMBER:false:-|' || w2 || ':' || w2 || ':LIST:true:-'", "''", "", "TRUE"),
]


@query(_expected(_PY_PATH, "CASE WHEN s % 8 = 0 THEN 'cli' ELSE t END", "'acme_pkg_' || CASE WHEN s % 8 = 0 THEN 'cli' ELSE t END", _PY_ROWS))
def python_features(spark, sf_dir):
    """Classes, methods and functions; private files, the cli folder, and files with a syntax error."""
    f = _files(spark, sf_dir).withColumn("at", F.lit("\x01"))
    s = F.col("s")
    path = F.concat(F.lit("/repo/src/pkg/"), F.when(s % 8 == 0, "cli").otherwise(F.col("t")), F.when(s % 9 == 0, "/_m").otherwise("/m"), F.col("k"), F.lit(".py"))
    broken = F.when(s % 6 == 0, "\ndef (\n    return 1\n").otherwise("")
    return _extracted(f.select(path.alias("path"), F.concat(_source(_PY), broken).alias("content")), "python", "src")


_TS_FILE = '''export interface @W1x@Opts@k@ { a: string; b?: number }
type Alias@k@ = { c: boolean };
/**
 * Runs @w1@.
 * @AT@param {string} name The @w2@
 * @AT@param {string} [p1=default] Desc
 */
export async function run@W1x@(name: string, p1?: number, { a, b: c, d = 1 }: { a: string, b?: number, d: boolean } = {}): Promise<string> { return ""; }
function hidden(a: string) { return 1; }
export class @W2x@Box<T> extends Bar {
  constructor(private readonly opts: @W1x@Opts@k@, req?: string) { super(); }
  /** Does @w2@. */
  @AT@deprecated()
  static async doIt(...rest: string[]): Promise<void> { if (x) { y(); } }
  get val(): string { return ""; }
  private no() { }
  handle({ u, v }: MyRequest): Map<string, number> { return m; }
  take(z: Alias@even@): void { }
}
'''
_TS_ROWS = [
    ("'run' || u1", "'run_' || w1", "'null'", "''", "FUNCTION", "-", "TRUE", "'Runs ' || w1 || '.'", "'name:name:STRING:false:The ' || w2 || '|p1:p1:NUMBER:true:Desc|a:a:STRING:false:-|c:c:NUMBER:true:-|d:d:BOOLEAN:true:-'", "'Promise<string>'", "STRING", "TRUE"),
    ("'constructor'", "'constructor'", "u2 || 'Box'", "w2 || '_box'", "CONSTRUCTOR", "-", "FALSE", "'-'", "'a:a:STRING:false:-|b:b:NUMBER:true:-|req:req:STRING:true:-'", "''", "", "TRUE"),
    ("'doIt'", "'do_it'", "u2 || 'Box'", "w2 || '_box'", "CLASS_METHOD", "DEPRECATED", "TRUE", "'Does ' || w2 || '.'", "'rest:rest:LIST:false:-'", "'Promise<void>'", "NULL", "TRUE"),
    ("'handle'", "'handle'", "u2 || 'Box'", "w2 || '_box'", "INSTANCE_METHOD", "-", "FALSE", "'-'", "'request:request:OBJECT:false:-'", "'Map<string, number>'", "MAP", "TRUE"),
    ("'take'", "'take'", "u2 || 'Box'", "w2 || '_box'", "INSTANCE_METHOD", "-", "FALSE", "'-'", "'c:c:BOOLEAN:false:-'", "'void'", "NULL", "TRUE"),
]


@query(_expected("'/repo/core/src/' || t || '/f' || k || '.ts'", "t", "'acme_' || t", _TS_ROWS))
def typescript_features(spark, sf_dir):
    """Functions and methods; destructuring, and object types of this and of other files."""
    f = _files(spark, sf_dir).withColumn("at", F.lit("\x01"))
    return _extracted(f.select(F.concat(F.lit("/repo/core/src/"), "t", F.lit("/f"), "k", F.lit(".ts")).alias("path"), _source(_TS_FILE).alias("content")), "typescript", "core/src")


_JAVA_FILE = '''package com.acme.@t@;
public class A@k@ {
  private int f = g(3);
  /** Makes @w1@. */
  public A@k@(String x, List<String> ys) { this.x = x; }
  @AT@Beta
  public static CompletableFuture<Integer> run@W1x@(Map<String, Object> m, final int n) throws E { return null; }
  public String getName() { return ""; }
  public int hashCode() { return 1; }
  void testFoo() {}
  private <T extends B> T normal@W2x@(T t, String... more) { return "} (" + '{'; }
  interface Inner@k@ { void act(byte[] b); }
  static class MyBuilder { MyBuilder set(int a) { return this; } }
  enum Mode { ON { void go(int a) {} }, OFF; int rank() { return 1; } }
}
'''
_JAVA_ROWS = [
    ("'run' || u1", "'run_' || w1", "'A' || k", "'a' || k", "CLASS_METHOD", "EXPERIMENTAL", "TRUE", "'-'", "'m:m:MAP:false:-|n:n:NUMBER:false:-'", "'CompletableFuture<Integer>'", "NUMBER", "TRUE"),
    ("'normal' || u2", "'normal_' || w2", "'A' || k", "'a' || k", "INSTANCE_METHOD", "-", "FALSE", "'-'", "'t:t:OBJECT:false:-'", "'T'", "OBJECT", "TRUE"),
    ("'act'", "'act'", "'Inner' || k", "'inner' || k", "INSTANCE_METHOD", "-", "FALSE", "'-'", "'b:b:LIST:false:-'", "'void'", "NULL", "TRUE"),
    ("'go'", "'go'", "'Mode'", "'mode'", "INSTANCE_METHOD", "-", "FALSE", "'-'", "'a:a:NUMBER:false:-'", "'void'", "NULL", "TRUE"),
    ("'rank'", "'rank'", "'Mode'", "'mode'", "INSTANCE_METHOD", "-", "FALSE", "'-'", "''", "'int'", "NUMBER", "TRUE"),
    ("'A' || k", "'a' || k", "'A' || k", "'a' || k", "CONSTRUCTOR", "-", "FALSE", "'Makes ' || w1 || '.'", "'x:x:STRING:false:-|ys:ys:LIST:false:-'", "''", "", "TRUE"),
]


@query(_expected("'/repo/src/main/java/com/acme/' || t || '/A' || k || '.java'", "t", "'acme_com_acme_' || t", _JAVA_ROWS))
def java_features(spark, sf_dir):
    """Methods of classes, interfaces and enum constants, and constructors; accessors, tests and builders left out."""
    f = _files(spark, sf_dir).withColumn("at", F.lit("\x01"))
    return _extracted(f.select(F.concat(F.lit("/repo/src/main/java/com/acme/"), "t", F.lit("/A"), "k", F.lit(".java")).alias("path"), _source(_JAVA_FILE).alias("content")), "java", "src/main/java")


_GO_FILE = '''package agent

// Validate checks.
func (r *save@W1x@) Validate(ctx context.Context, a int, opts ...Opt) (*Event, error) {
	x := 1
	y := "}"
	return x, nil
}

func New@W2x@(name string, m map[string]interface{}) *Config {
	c := &Config{
		A: 1,
	}
	return c
}

func Tiny() int { return 1 }
func lower() int {
	a()
	return 1
}
'''
_GO_ROWS = [
    ("'New' || u2", "'new_' || w2", "''", "''", "CONSTRUCTOR", "-", "FALSE", "'-'", "'name:name:STRING:false:-|m:m:MAP:false:-'", "'*Config'", "OBJECT", "TRUE"),
    ("'Validate'", "'validate'", "'Save' || u1", "'save_' || w1", "INSTANCE_METHOD", "-", "FALSE", "'-'", "'a:a:NUMBER:false:-'", "'*Event'", "OBJECT", "TRUE"),
]


@query(_expected("'/repo/' || t || '/g' || k || '.go'", "t", "'acme_' || t", _GO_ROWS, "s % 6 = 0 OR s % 8 = 0"))
def go_features(spark, sf_dir):
    """Functions and methods; trivial and unexported ones, tests, and files with errors left out."""
    f, s = _files(spark, sf_dir), F.col("s")
    path = F.concat(F.lit("/repo/"), "t", F.lit("/g"), "k", F.when(s % 8 == 0, "_test").otherwise(""), F.lit(".go"))
    return _extracted(f.select(path.alias("path"), F.concat(_filled(_GO_FILE), F.when(s % 6 == 0, "}\n").otherwise("")).alias("content")), "go", ".")
