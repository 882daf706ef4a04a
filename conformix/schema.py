"""Data model: a registry is a table of features, each with nested parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAM_TYPES = ["OBJECT", "STRING", "NUMBER", "BOOLEAN", "LIST", "MAP", "SET", "UNKNOWN", "NULL"]
FEATURE_TYPES = ["FUNCTION", "INSTANCE_METHOD", "CLASS_METHOD", "CONSTRUCTOR"]
MATURITIES = ["EXPERIMENTAL", "BETA", "DEPRECATED"]

_strings = T.ArrayType(T.StringType(), False)

PARAM = T.StructType(
    [
        T.StructField("original_name", T.StringType(), False),
        T.StructField("normalized_name", T.StringType(), False),
        T.StructField("original_types", _strings, False),
        T.StructField("normalized_types", _strings, False),
        T.StructField("description", T.StringType(), True),
        T.StructField("is_optional", T.BooleanType(), False),
    ]
)

FEATURE = T.StructType(
    [
        T.StructField("original_name", T.StringType(), False),
        T.StructField("normalized_name", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("member_of", T.StringType(), False),
        T.StructField("normalized_member_of", T.StringType(), False),
        T.StructField("maturity", T.StringType(), True),
        T.StructField("type", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("namespace", T.StringType(), False),
        T.StructField("normalized_namespace", T.StringType(), False),
        T.StructField("parameters", T.ArrayType(PARAM, False), False),
        T.StructField("original_return_types", _strings, False),
        T.StructField("normalized_return_types", _strings, False),
        T.StructField("async", T.BooleanType(), True),
        T.StructField("ord", T.LongType(), False),
    ]
)

_PARAM_SQL = "struct<original_name:string,normalized_name:string,original_types:array<string>,normalized_types:array<string>,description:string,is_optional:boolean>"


@dataclass
class Registry:
    """Language (upper case), version and features with their order in `ord`; `files` lists what they were read from, if known."""

    language: str
    version: str
    features: DataFrame
    files: DataFrame | None = None


def with_defaults(df: DataFrame) -> DataFrame:
    """Any DataFrame with some feature columns as a full feature table.

    Absent columns and NULLs get the defaults of the model: empty strings and
    lists, FUNCTION, and NULL only for description, maturity and async. Without
    `ord` the order is that of names, which is deterministic.
    """
    have, cols = set(df.columns), []
    for f in FEATURE.fields:
        if f.name == "ord":
            continue
        if f.name == "parameters":
            c = F.col("parameters") if "parameters" in have else F.expr(f"cast(array() as array<{_PARAM_SQL}>)")
            c = F.coalesce(c, F.expr(f"cast(array() as array<{_PARAM_SQL}>)"))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(F.col(f.name) if f.name in have else F.lit(None).cast("array<string>"), F.expr("cast(array() as array<string>)"))
        else:
            c = F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)
            if not f.nullable:
                c = F.coalesce(c, F.lit("FUNCTION" if f.name == "type" else ""))
        cols.append(c.alias(f.name))
    if "ord" in have:
        return df.select(*cols, F.col("ord").cast("long").alias("ord"))
    from .operators.ordering import boundaries, ordered

    out = df.select(*cols)
    rest = ["normalized_namespace", "normalized_member_of", "normalized_name", "type"]
    return ordered(out, "file_path", rest, boundaries(out.select("file_path")))
