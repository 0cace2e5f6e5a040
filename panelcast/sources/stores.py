"""Result tables: profiles as documents, feature configs, and computing only what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.plans.profile import PROFILE_SCHEMA


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def profile_documents(profile: DataFrame) -> DataFrame:
    """(series_id, document): the profile as JSON text."""
    document = F.to_json(F.struct(*profile.columns), {"ignoreNullFields": "false"})
    return profile.select("series_id", document.alias("document"))


def profiles_from_documents(documents: DataFrame) -> DataFrame:
    """Validated on reading: a document that does not fit the schema gives no row."""
    parsed = F.from_json("document", PROFILE_SCHEMA, {"allowNonNumericNumbers": "true"})
    return documents.select(parsed.alias("p")).select("p.*").filter(F.col("series_id").isNotNull())


def upsert(current: DataFrame, new: DataFrame, key: str = "series_id") -> DataFrame:
    """New rows replace old ones with the same key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def compute_missing(
    panel: DataFrame,
    cache: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    refresh: bool = False,
) -> DataFrame:
    """The cached results and those computed now for series the cache lacks. With `refresh`, a cached
    result is also recomputed when the series' n_obs or end_timestamp differ from the cached ones."""
    kept = cache
    if refresh:
        state = panel.groupBy("series_id").agg(
            F.count(F.lit(1)).alias("n_obs"), F.max("timestamp").alias("end_timestamp")
        )
        kept = cache.join(state, ["series_id", "n_obs", "end_timestamp"], "left_semi").select(*cache.columns)
    missing = panel.join(kept.select("series_id"), "series_id", "left_anti")
    return kept.unionByName(compute(missing).select(*kept.columns))


def store_configs(switches: DataFrame) -> DataFrame:
    """(series_id, name, enabled) rows -> one `{name: bool}` map per series."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "enabled"))))
    return switches.groupBy("series_id").agg(pairs.alias("config"))


def read_configs(index: DataFrame, configs: DataFrame) -> DataFrame:
    """The config of every indexed series, empty where none is stored."""
    return index.select("series_id").join(configs, "series_id", "left").withColumn(
        "config", F.coalesce("config", F.create_map().cast("map<string,boolean>"))
    )
