"""Holdout, metrics, leaderboard. The forecasts scored here are the past-only feature columns
(previous value, same weekday last week, mean of the last week), which SQL can compute as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import scores as R
from panelcast.operators.explore import overlay
from panelcast.operators.features import FeatureSpec, apply_features
from panelcast.operators.layout import number_rows
from panelcast.queries.q_panel import index_of, index_sql, rounded
from panelcast.queries.registry import query
from panelcast.session import cut_lineage
from panelcast.sources.tables import panel, panel_sql

PREDICTORS = ("lag_1", "lag_7", "rolling_mean_7")
SPECS = [
    FeatureSpec("lag_1", "lag", k=1),
    FeatureSpec("lag_7", "lag", k=7),
    FeatureSpec("rolling_mean_7", "rolling_stat", window=7, stat="mean"),
]
HORIZON_SQL = "greatest(7, least(30, round_even((n * 0.1)::DOUBLE, 0)))::INT"


@query("horizon", f"SELECT series_id, n AS n_obs, {HORIZON_SQL} AS horizon FROM (SELECT series_id, count(*) AS n FROM ({panel_sql('part_monthly')}) GROUP BY 1)")
def horizon(spark, sf):
    return index_of(spark, sf, "part_monthly").select("series_id", "n_obs", R.horizon(F.col("n_obs")).alias("horizon"))


def split_sql(name: str) -> str:
    return f"""SELECT *, pos >= n - h AS is_test, CASE WHEN pos >= n - h THEN (pos - greatest(n - h, 0) + 1)::INT END AS step FROM (
    SELECT *, {HORIZON_SQL} AS h FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS pos,
      count(*) OVER (PARTITION BY series_id) AS n FROM ({panel_sql(name)})))"""


@query("holdout_split", f"SELECT series_id, timestamp, h AS horizon, is_test, step FROM ({split_sql('user_daily')})")
def holdout_split(spark, sf):
    return R.holdout(number_rows(panel(spark, sf, "user_daily"))).select(
        "series_id", "timestamp", "horizon", "is_test", "step"
    )


def forecasts(spark, sf, name):
    """(series_id, model_name, step, timestamp, actual, predicted) over the holdout."""
    wide = apply_features(number_rows(panel(spark, sf, name)), SPECS)
    test = R.holdout(wide).filter("is_test")
    return test.unpivot(
        ["series_id", "step", "timestamp", "value"], list(PREDICTORS), "model_name", "predicted"
    ).withColumnRenamed("value", "actual")


def forecasts_sql(name: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT series_id, step, timestamp, value AS actual, '{m}' AS model_name, {m} AS predicted FROM t WHERE is_test"
        for m in PREDICTORS
    )
    return f"""(WITH t AS (SELECT *, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7,
      CASE WHEN count(value) OVER r = 7 THEN avg(value) OVER r END AS rolling_mean_7
    FROM ({split_sql(name)}) WINDOW w AS (PARTITION BY series_id ORDER BY timestamp),
      r AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) {parts})"""


def scores_sql(name: str) -> str:
    return f"""(SELECT series_id, model_name, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted)**2)) AS rmse,
    100 * avg(CASE WHEN actual - predicted IS NULL THEN NULL WHEN abs(actual) + abs(predicted) <> 0
      THEN 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) ELSE 0 END) AS smape
  FROM {forecasts_sql(name)} GROUP BY 1, 2)"""


ROUNDED_SQL = "round_even(mae, 4) AS mae, round_even(rmse, 4) AS rmse, round_even(smape, 4) AS smape"


@query("forecast_metrics", f"SELECT series_id, model_name, {ROUNDED_SQL} FROM {scores_sql('user_daily')}")
def forecast_metrics(spark, sf):
    return rounded(R.metrics(forecasts(spark, sf, "user_daily")), 4, *R.METRICS)


def best_sql(name: str) -> str:
    order = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(PREDICTORS))
    return f"""(SELECT series_id, arg_min(model_name, (smape, CASE model_name {order} END)) AS best_model
  FROM {scores_sql(name)} WHERE smape IS NOT NULL GROUP BY 1)"""


@query("best_model", f"SELECT * FROM {best_sql('user_daily')}")
def best_model(spark, sf):
    return R.best_model(R.metrics(forecasts(spark, sf, "user_daily")), PREDICTORS)


BOARD_SQL = """SELECT model_name, round_even(avg(mae), 4) AS avg_mae, round_even(avg(rmse), 4) AS avg_rmse,
    round_even(avg(smape), 4) AS avg_smape, count(smape) AS n_series{rank} FROM {scores} GROUP BY model_name"""


@query("leaderboard", BOARD_SQL.format(scores=scores_sql("user_daily"), rank=""))
def leaderboard(spark, sf):
    return R.leaderboard(R.metrics(forecasts(spark, sf, "user_daily")))


@query(
    "leaderboard_ranked",
    BOARD_SQL.format(
        scores=scores_sql("user_daily"), rank=", row_number() OVER (ORDER BY avg(smape), model_name)::INT AS rank"
    ),
)
def leaderboard_ranked(spark, sf):
    return R.ranked_leaderboard(R.metrics(forecasts(spark, sf, "user_daily")))


@query(
    "leaderboard_upsert",
    f"""WITH a AS (SELECT * FROM {scores_sql("user_daily")}), b AS (SELECT * FROM {scores_sql("orders_daily")}),
  old AS (SELECT *, 'job1' AS job_id, TIMESTAMP '2024-01-01' AS stamp, 1 AS run FROM a
    UNION ALL SELECT *, 'job1', TIMESTAMP '2024-01-01', 1 FROM b),
  new AS (SELECT series_id, model_name, mae / 2 AS mae, rmse / 2 AS rmse, smape / 2 AS smape, 'job2' AS job_id, TIMESTAMP '2024-02-01' AS stamp, 2 AS run
    FROM a WHERE model_name <> 'lag_7'),
  u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
  SELECT series_id, model_name, {ROUNDED_SQL}, job_id, computed_at FROM (
    SELECT series_id, model_name, arg_max(mae, run) AS mae, arg_max(rmse, run) AS rmse, arg_max(smape, run) AS smape,
      arg_max(job_id, run) AS job_id, min(stamp) AS computed_at FROM u GROUP BY 1, 2)""",
)
def leaderboard_upsert(spark, sf):
    def entries(scores, job, at, seq):
        return scores.withColumns(
            {"job_id": F.lit(job), "computed_at": F.lit(at).cast("timestamp_ntz"), "run_seq": F.lit(seq)}
        )

    users = cut_lineage(R.metrics(forecasts(spark, sf, "user_daily")))
    orders = R.metrics(forecasts(spark, sf, "orders_daily"))
    old = entries(users.unionByName(orders), "job1", "2024-01-01", 1)
    halved = users.filter(F.col("model_name") != "lag_7").withColumns({m: F.col(m) / 2 for m in R.METRICS})
    out = R.upsert_scores(old, entries(halved, "job2", "2024-02-01", 2))
    return rounded(out.drop("run_seq"), 4, *R.METRICS)


@query(
    "run_status",
    f"""WITH i AS ({index_sql("part_monthly")}),
  o AS (SELECT series_id, CASE WHEN n_obs < 20 THEN 'series too short' END AS error FROM i WHERE n_obs <> 25)
  SELECT CASE WHEN count(error) > 0 THEN 'failed' ELSE 'succeeded' END AS status,
    round_even(100 * count(CASE WHEN o.series_id IS NOT NULL AND error IS NULL THEN 1 END) / count(*), 2) AS progress_pct,
    NULL::VARCHAR AS result_ref, min(error) AS error, count(*) AS total,
    count(CASE WHEN o.series_id IS NOT NULL AND error IS NULL THEN 1 END) AS done, count(error) AS failed
  FROM i LEFT JOIN o ON o.series_id = i.series_id""",
)
def run_status(spark, sf):
    index = index_of(spark, sf, "part_monthly")
    outcomes = index.filter("n_obs <> 25").select(
        "series_id", F.when(F.col("n_obs") < 20, "series too short").alias("error")
    )
    return R.run_status(index, outcomes)


SELECTED = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
IDS_SQL = "(" + ", ".join(f"'{s}'" for s in SELECTED) + ")"


@query(
    "overlay",
    f"""WITH f AS (SELECT * FROM {forecasts_sql("orders_daily")}), b AS (SELECT * FROM {best_sql("orders_daily")}),
  u AS (SELECT series_id, series_id || ' actual' AS label, timestamp, value FROM ({split_sql("orders_daily")}) WHERE series_id IN {IDS_SQL} AND pos >= n - 150
    UNION ALL SELECT f.series_id, f.series_id || ' forecast (' || model_name || ')', timestamp, predicted
    FROM f JOIN b ON b.series_id = f.series_id AND b.best_model = f.model_name WHERE f.series_id IN {IDS_SQL})
  SELECT series_id, label, floor(date_diff('second', TIMESTAMP '2013-01-01', timestamp) / 86400 + 0.5)::INT AS x,
    DATE '2013-01-01' + floor(date_diff('second', TIMESTAMP '2013-01-01', timestamp) / 86400 + 0.5)::INT AS day,
    strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS at, round_even(value, 4) AS value FROM u""",
)
def overlay_query(spark, sf):
    rows = cut_lineage(forecasts(spark, sf, "orders_daily"))
    best = R.best_model(R.metrics(rows), PREDICTORS)
    return rounded(overlay(number_rows(panel(spark, sf, "orders_daily")), rows, best, SELECTED), 4)
