"""Request validation and the quarantine split.

Each request body is parsed once into VARIANT; field checks run in the
reference's field order (``contents``, then ``detector_params``). The error
branch is chosen by the FIRST error's type, and the message lists every error
of that branch, formatted like a Python list (``['contents']``, ``[0, 1]``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ERR_ARRAY = "array<struct<type:string,loc:string>>"


def _err(t: str, loc: Column | str) -> Column:
    return F.struct(F.lit(t).alias("type"), (loc if isinstance(loc, Column) else F.lit(loc)).alias("loc"))


def validation_errors(body: Column) -> Column:
    v = F.try_parse_json(body)
    contents = F.try_variant_get(v, "$.contents", "variant")
    ctype = F.schema_of_variant(contents)
    items = F.try_variant_get(v, "$.contents", "array<variant>")
    params = F.try_variant_get(v, "$.detector_params", "variant")
    ptype = F.schema_of_variant(params)
    empty = F.array().cast(ERR_ARRAY)
    item_errs = F.transform(
        F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.schema_of_variant(s["x"]) != F.lit("STRING")),
        lambda s: _err("string_type", s["i"].cast("string")),
    )
    c_errs = (
        F.when(contents.isNull(), F.array(_err("missing", "'contents'")))
        .when(~ctype.startswith("ARRAY"), F.array(_err("list_type", "'contents'")))
        .when(F.size(items) == 0, F.array(_err("too_short", "'contents'")))
        .otherwise(item_errs)
    )
    p_errs = (
        F.when(params.isNull(), F.array(_err("missing", "'detector_params'")))
        .when(ptype == F.lit("VOID"), empty)
        .when(~ptype.startswith("OBJECT"), F.array(_err("dict_type", "'detector_params'")))
        .otherwise(empty)
    )
    body_err = F.array(_err("json_invalid", "'body'"))
    return F.when(v.isNull(), body_err).otherwise(F.concat(c_errs, p_errs))


def _listing(errs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(errs, lambda e: e["loc"]), ", "), F.lit("]"))


def error_message(errs: Column) -> Column:
    first = F.get(errs, 0)["type"]
    missing = F.filter(errs, lambda e: e["type"] == "missing")
    typed = F.filter(errs, lambda e: e["type"].endswith("type"))
    return (
        F.when(F.size(errs) == 0, F.lit(None).cast("string"))
        .when(first == "missing", F.concat(F.lit("Missing required parameters: "), _listing(missing)))
        .when(first.endswith("type"), F.concat(F.lit("Parameters with invalid type: "), _listing(typed)))
        .otherwise(F.concat(F.lit("Invalid parameters: "), _listing(errs)))
    )


def allow_repeated_keys(spark: SparkSession) -> None:
    """Lets bodies repeat a key, as JSON does, the last one counting; Spark rejects them by default."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def checked(df: DataFrame, body_col: str = "body") -> DataFrame:
    """All rows with valid, code, message and contents, from one pass over the bodies."""
    allow_repeated_keys(df.sparkSession)
    rows = df.select("*", validation_errors(F.col(body_col)).alias("_errs"))
    valid = F.size("_errs") == 0
    texts = F.try_variant_get(F.try_parse_json(F.col(body_col)), "$.contents", "array<string>")
    return rows.select(
        *df.columns,
        valid.alias("valid"),
        F.when(~valid, F.lit(422)).alias("code"),
        error_message(F.col("_errs")).alias("message"),
        F.when(valid, texts).alias("contents"),
    )


def quarantine(df: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """(valid requests with their contents, rejected requests with code 422 and message)."""
    rows = checked(df, body_col)
    return rows.where("valid").select(*df.columns, "contents"), rows.where("NOT valid").select(*df.columns, "code", "message")
