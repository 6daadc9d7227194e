"""Marker names, metadata and training history in JSON files beside the graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom import schema


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``file``, ``value`` of whole files; no rows if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("content").cast("string").alias("value"))


def read_marker_names(spark: SparkSession, path: str) -> DataFrame:
    """``marker_id``, ``name`` of the first ``*_markers.json`` by name; no rows if there is none."""
    first = _texts(spark, path, "*_markers.json").orderBy("file").limit(1)
    return first.select(F.posexplode(F.from_json("value", "array<string>")).alias("marker_id", "name"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``graph_id``, ``organoid_id``, ``meta`` (map<string,double>) of every ``organoid_*_aux.json``.

    Numbers, booleans and one-element lists of them are kept; other values are left out; files that aren't
    JSON objects are skipped.  ``organoid_id`` defaults to the stem less ``organoid_``.
    """
    rows = _texts(spark, path, "organoid_*_aux.json").select(F.regexp_extract("file", r"^(.*)_aux\.json$", 1).alias("graph_id"), F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("raw"))
    rows = rows.where("raw is not null")
    # Strings arrive without quotes, so only what looks like a JSON number or boolean counts as one.
    one = lambda v: F.regexp_replace(F.trim(v), r"^\[\s*([^\[\],\"]*?)\s*\]$", "$1")
    number = lambda v: F.when(one(v) == "true", 1.0).when(one(v) == "false", 0.0).otherwise(one(v).try_cast("double"))
    meta = F.map_filter(F.transform_values("raw", lambda k, v: number(v)), lambda k, v: v.isNotNull() & (k != "organoid_id"))
    default = F.replace("graph_id", F.lit("organoid_"), F.lit(""))
    return rows.select("graph_id", F.coalesce(F.try_element_at("raw", F.lit("organoid_id")), default).alias("organoid_id"), meta.alias("meta"))


def read_metadata_values(spark: SparkSession, path: str) -> DataFrame:
    """``graph_id``, ``organoid_id``, ``meta`` (VARIANT: the whole object, nested values and text too) of every ``organoid_*_aux.json``.

    Files that aren't JSON objects are skipped.  ``organoid_id`` defaults to the stem less ``organoid_``.
    """
    rows = _texts(spark, path, "organoid_*_aux.json").select(F.regexp_extract("file", r"^(.*)_aux\.json$", 1).alias("graph_id"), F.try_parse_json("value").alias("meta"))
    rows = rows.where(F.schema_of_variant("meta").startswith("OBJECT"))
    default = F.replace("graph_id", F.lit("organoid_"), F.lit(""))
    return rows.select("graph_id", F.coalesce(F.try_variant_get("meta", "$.organoid_id", "string"), default).alias("organoid_id"), "meta")


def metadata_schema(values: DataFrame) -> str:
    """The merged schema of all objects in ``meta``, as Spark spells it for a VARIANT: what keys there are, and of what types."""
    return values.agg(F.schema_of_variant_agg("meta")).first()[0]


def promoted(values: DataFrame, **keys: str) -> DataFrame:
    """``values`` with a column for each key: ``name="type"``, or ``name="type $.path"`` for a nested one.

    Lists of one element are unwrapped; what is missing, longer or of another type is null.
    """

    def column(name: str, spelled: str):
        kind, _, at = spelled.partition(" ")
        at = at or f"$.{name}"
        whole = F.try_variant_get("meta", at, "variant")
        only = F.when(F.try_variant_get("meta", f"{at}[1]", "variant").isNull(), F.try_variant_get("meta", f"{at}[0]", kind))
        return F.when(F.schema_of_variant(whole).startswith("ARRAY"), only).otherwise(F.try_variant_get("meta", at, kind)).alias(name)

    return values.select("*", *[column(name, spelled) for name, spelled in keys.items()])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training curves (an object of four arrays) as one row per epoch from 0."""
    names = ["train_loss", "train_mae", "val_loss", "val_mae"]
    raw = spark.read.schema(", ".join(f"{n} array<double>" for n in names)).option("multiLine", True).json(path)
    each = raw.select(F.posexplode(F.arrays_zip(*names)).alias("epoch", "e"))
    return each.select("epoch", *[F.col(f"e.{n}").alias(n) for n in names])


def write_history(history: DataFrame, path: str) -> None:
    """One row per epoch, as Parquet in the columns of ``schema.HISTORY``."""
    columns = [c.split()[0] for c in schema.HISTORY.split(", ")]
    history.select(*columns).write.mode("overwrite").parquet(path)
