"""Data side of diagnostic notes: the profile payload that goes out, the notes that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.holidays import holiday_dates
from panelcast.operators.explore import iso
from panelcast.operators.features import FEATURE_TYPES

DEFAULT_COUNTRY = "US"
SALTS = 16
NOTE_SCHEMA = """results ARRAY<STRUCT<series_id: STRING, narrative: STRING,
  suggested_features: ARRAY<STRUCT<name: STRING, feature_type: STRING, description: STRING, rationale: STRING,
    confidence: DOUBLE, holiday_country: STRING>>,
  suggested_models: ARRAY<STRUCT<name: STRING, rationale: STRING>>>>"""


def payload(profile: DataFrame) -> DataFrame:
    """One JSON document per series: the profile without the row-level parts."""
    document = F.to_json(
        F.struct(
            "series_id",
            "frequency",
            "n_obs",
            F.array(iso(F.col("start_timestamp")), iso(F.col("end_timestamp"))).alias("date_range"),
            "missing",
            "seasonality",
            "trend",
            "stationarity",
            "intermittency",
            "outliers",
        ),
        {"ignoreNullFields": "false"},
    )
    return profile.select("series_id", document.alias("payload"))


def payload_batches(payloads: DataFrame, per_batch: int, n_series: int) -> DataFrame:
    """JSON arrays of at most `per_batch` documents. Series are hashed into buckets of about a thousand
    batches and cut in id order there, so the batches are the same on every run and no task orders all
    series."""
    buckets = max(1, n_series // (per_batch * 1000))
    bucket = F.pmod(F.xxhash64("series_id"), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("series_id")) - 1
    return (
        payloads.withColumn("bucket", bucket)
        .withColumn("batch", F.floor(place / per_batch))
        .groupBy("bucket", "batch")
        .agg(
            F.count(F.lit(1)).alias("n_series"),
            F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("payload")), ","), F.lit("]")).alias("payload"),
        )
    )


def parse_notes(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per note of each answer text; a text that does not parse gives one row without a note."""
    parsed = F.from_json(column, NOTE_SCHEMA, {"mode": "PERMISSIVE"})
    return texts.select(F.col(column).alias("text"), F.explode_outer(parsed["results"]).alias("note")).select(
        "text", "note.*"
    )


def ingest_notes(texts: DataFrame, profile: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, features, rejects). Notes are those of known series; features their valid suggestions in
    order; rejects everything that fails validation, with the reason."""
    notes = parse_notes(texts, column)
    unreadable = F.col("series_id").isNull() | F.col("narrative").isNull()
    broken = notes.filter(unreadable).select(
        "series_id", F.lit(None).cast("string").alias("name"), F.lit("note is not readable").alias("reason")
    )
    # of several notes for one series the first in text order counts; answers have no order of their own
    one = F.min(F.struct("narrative", "suggested_features", "suggested_models")).alias("note")
    readable = notes.filter(~unreadable).groupBy("series_id").agg(one).select("series_id", "note.*")
    known = readable.join(profile.select("series_id", "start_timestamp", "end_timestamp"), "series_id")
    features = known.select(
        "series_id", "start_timestamp", "end_timestamp", F.posexplode("suggested_features").alias("ord", "f")
    ).select("series_id", "start_timestamp", "end_timestamp", "ord", "f.*")
    reason = (
        F.when(F.col("name").isNull() | F.col("description").isNull() | F.col("rationale").isNull(), "field missing")
        .when(~F.coalesce(F.col("feature_type").isin(*FEATURE_TYPES), F.lit(False)), "unknown feature type")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0..1")
    )
    checked = features.withColumn("reason", reason)
    rejects = broken.unionByName(checked.filter("reason IS NOT NULL").select("series_id", "name", "reason"))
    valid = checked.filter("reason IS NULL").drop("reason")
    whole = lambda m: m["name"].isNotNull() & m["rationale"].isNotNull()
    models = known.select("series_id", F.explode("suggested_models").alias("m")).filter(~whole(F.col("m")))
    rejects = rejects.unionByName(models.select("series_id", F.col("m.name").alias("name"), F.lit("model field missing").alias("reason")))
    return known.select("series_id", "narrative", F.filter("suggested_models", whole).alias("suggested_models")), valid, rejects


def cross_check(features: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Add holiday_confirmed and holiday_match_count: how many holidays of the suggested country fall
    into the series' dates. NULL for other features; an unknown country counts 0.

    A running count by (country, day) turns the range into two equal lookups, the count on the last day less the one
    on the day before the first: no range condition, and no span is taken apart. Many series can have the same dates, so the
    counts go back to the rows over a salted key.
    """
    holiday = F.col("feature_type") == "holiday"
    unchecked = features.filter(~holiday).withColumns(
        {"holiday_confirmed": F.lit(None).cast("boolean"), "holiday_match_count": F.lit(None).cast("int")}
    )
    country = F.coalesce(F.nullif(F.col("holiday_country"), F.lit("")), F.lit(DEFAULT_COUNTRY))
    rows = features.filter(holiday).withColumns(
        {
            "holiday_country": country,
            "from_day": F.col("start_timestamp").cast("date"),
            "to_day": F.col("end_timestamp").cast("date"),
            "salt": F.pmod(F.xxhash64("series_id"), F.lit(SALTS)).cast("int"),
        }
    )
    asked = rows.select("holiday_country", "from_day", "to_day").distinct()
    ends = asked.groupBy("holiday_country").agg(F.date_sub(F.min("from_day"), 1).alias("first"), F.max("to_day").alias("last"))
    days = ends.select("holiday_country", F.explode(F.sequence("first", "last")).alias("date"))  # a row a day, not a series
    years = days.select(F.year("date").alias("year")).distinct()
    dates = holiday_dates(years, calendar).select(F.col("country").alias("holiday_country"), "date", F.lit(1).alias("is"))
    running = F.count("is").over(Window.partitionBy("holiday_country").orderBy("date"))
    until = days.join(dates, ["holiday_country", "date"], "left").withColumn("until", running)
    on_last = until.select("holiday_country", F.col("date").alias("to_day"), F.col("until").alias("upto"))
    on_first = until.select("holiday_country", F.date_add("date", 1).alias("from_day"), F.col("until").alias("before"))
    counts = (
        asked.join(on_last, ["holiday_country", "to_day"])
        .join(on_first, ["holiday_country", "from_day"])
        .select("holiday_country", "from_day", "to_day", (F.col("upto") - F.col("before")).cast("int").alias("n"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    n = F.coalesce("n", F.lit(0))
    checked = (
        rows.join(counts, ["holiday_country", "from_day", "to_day", "salt"], "left")
        .withColumns({"holiday_confirmed": n > 0, "holiday_match_count": n})
        .drop("from_day", "to_day", "salt", "n")
    )
    return checked.unionByName(unchecked)


def feature_panel(catalog: DataFrame, notes: DataFrame, checked: DataFrame) -> DataFrame:
    """Per series: the catalog with its switches, the narrative, and the suggestions in their order. The
    lists are as long as a catalog or a note, not as a series."""
    spec = F.struct("ord", "name", "feature_type", "params", "enabled")
    specs = catalog.groupBy("series_id").agg(F.sort_array(F.collect_list(spec)).alias("catalog"))
    suggestion = F.struct(
        "ord", "name", "feature_type", "description", "rationale", "confidence",
        "holiday_country", "holiday_confirmed", "holiday_match_count",
    )
    suggested = checked.groupBy("series_id").agg(F.sort_array(F.collect_list(suggestion)).alias("suggested_features"))
    return specs.join(notes, "series_id", "left").join(suggested, "series_id", "left")
