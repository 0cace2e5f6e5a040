import json

import numpy as np
import pytest
from conftest import SF, by_id
from pyspark.sql import functions as F

from panelcast.operators import explore as X
from panelcast.operators import notes as N
from panelcast.operators.layout import Layout, number_rows
from panelcast.operators.profile_basic import missing
from panelcast.operators import scores as R
from panelcast.plans.profile import profile_panel
from panelcast.sources import panel as P
from panelcast.sources import stores as T
from panelcast.sources.tables import panel as table_panel

ENTRY = "series_id string, model_name string, mae double, rmse double, smape double, job_id string, computed_at int, run_seq int"


def entries(spark, *rows):
    return spark.createDataFrame(rows, ENTRY)


def test_upsert_replaces_and_keeps_the_first_time(spark):
    old = entries(spark, ("D1", "ARIMA", 1.0, 2.0, 3.0, "job1", 10, 1))
    new = entries(spark, ("D1", "ARIMA", 5.0, 6.0, 7.0, "job2", 20, 2))
    row = R.upsert_scores(old, new).collect()
    assert len(row) == 1 and (row[0].mae, row[0].job_id, row[0].computed_at) == (5.0, "job2", 10)


def test_leaderboard_averages_and_sorts(spark):
    board = R.leaderboard(
        entries(
            spark,
            ("D1", "ARIMA", 10.0, 12.0, 5.0, "j", 1, 1),
            ("D2", "ARIMA", 20.0, 22.0, 15.0, "j", 1, 1),
            ("D1", "GBT_leaf", 1.0, 1.5, 1.0, "j", 1, 1),
        )
    ).collect()
    assert [r.model_name for r in board] == ["GBT_leaf", "ARIMA"]
    assert board[1].avg_mae == pytest.approx(15.0) and [r.n_series for r in board] == [1, 2]


def test_run_status(spark):
    index = spark.createDataFrame([(f"s{i}",) for i in range(3)], "series_id string")
    done = lambda *rows: spark.createDataFrame(rows, "series_id string, error string")
    r = R.run_status(index, done(("s0", None))).first()
    assert (r.status, r.progress_pct, r.result_ref) == ("running", 33.33, None)
    r = R.run_status(index, done(*[(f"s{i}", None) for i in range(3)])).first()
    assert (r.status, r.progress_pct, r.result_ref) == ("succeeded", 100.0, "leaderboard:3_series")
    r = R.run_status(index, done(("s0", None), ("s1", "boom"))).first()
    assert (r.status, r.error, r.done) == ("failed", "boom", 1)
    assert R.run_status(index.limit(0), done(("x", None)).limit(0)).first().progress_pct == 100.0


def features(spark, *rows):
    schema = """series_id string, ord int, feature_type string, name string, holiday_country string,
      start_timestamp timestamp_ntz, end_timestamp timestamp_ntz"""
    from datetime import datetime

    return spark.createDataFrame([(*r, datetime(2020, 1, 1), datetime(2020, 12, 31)) for r in rows], schema)


def test_holiday_cross_check(spark):
    rows = features(
        spark,
        ("a", 0, "holiday", "us", "US"),
        ("a", 1, "holiday", "zz", "ZZ"),
        ("a", 2, "holiday", "none", None),
        ("a", 3, "lag", "lag_7", None),
        ("a", 4, "holiday", "empty", ""),
    )
    got = by_id(N.cross_check(rows), "name")
    assert got["us"].holiday_confirmed is True and got["us"].holiday_match_count == 11
    assert got["zz"].holiday_confirmed is False and got["zz"].holiday_match_count == 0
    assert got["none"].holiday_country == "US" and got["none"].holiday_confirmed is True
    assert got["empty"].holiday_country == "US"
    assert got["lag_7"].holiday_confirmed is None and got["lag_7"].holiday_match_count is None
    calendar = spark.sql("SELECT 'ZZ' AS country, DATE'2020-05-05' AS date")
    assert by_id(N.cross_check(rows, calendar), "name")["zz"].holiday_match_count == 1


def test_payload_is_json(spark, make_panel):
    profile = profile_panel(make_panel({"test_series": np.random.default_rng(0).normal(size=100), "b": np.zeros(20)}))
    batches = [r.payload for r in N.payload_batches(N.payload(profile), 1, 2).collect()]
    docs = {d["series_id"]: d for text in batches for d in json.loads(text.replace("Infinity", "1e999"))}
    assert set(docs) == {"test_series", "b"} and all(len(json.loads(t)) == 1 for t in batches)
    assert docs["test_series"]["frequency"] == "Daily" and len(docs["test_series"]["date_range"]) == 2


def test_notes_validation(spark, make_panel):
    index = P.series_index(make_panel({"a": np.arange(5.0)}), "d", "p")
    good = dict(name="x", feature_type="lag", description="d", rationale="r", confidence=0.5)
    note = lambda s, *f: dict(series_id=s, narrative="n", suggested_features=list(f), suggested_models=[])
    text = json.dumps({"results": [
        note("a", good, {**good, "feature_type": "magic"}, {**good, "confidence": 1.5}, {**good, "name": None}),
        note("nobody", good),
    ]})
    texts = spark.createDataFrame([(text,), ("{broken",)], "text string")
    notes, valid, rejects = N.ingest_notes(texts, index)
    assert [r.series_id for r in notes.collect()] == ["a"] and valid.count() == 1
    assert sorted(r.reason for r in rejects.collect()) == [
        "confidence outside 0..1", "field missing", "note is not readable", "unknown feature type",
    ]


def listing(spark):
    rows = [
        ("D10", "Daily", (True, False, None, True, "smooth")),
        ("d2", "Daily", (False, True, 7, False, "lumpy")),
        ("W1", "Weekly", None),
    ]
    return spark.createDataFrame(
        rows,
        """series_id string, frequency string, profile_summary struct<trend_detected: boolean,
      seasonality_detected: boolean, seasonality_period: int, stationary: boolean, intermittency_category: string>""",
    )


def test_filters(spark):
    rows = listing(spark)
    ids = lambda **kw: sorted(r.series_id for r in rows.filter(X.matches(**kw)).collect())
    assert ids() == ["D10", "W1", "d2"] and ids(search="d") == ["D10", "d2"]
    assert ids(seasonal_only=True) == ["d2"] and ids(trend_only=True) == ["D10"]
    assert ids(category="lumpy", search="D") == ["d2"] and ids(frequency="Weekly") == ["W1"]
    counts = X.filter_counts(rows, X.matches(category="smooth")).first()
    assert (counts.n_shown, counts.n_total) == (1, 3)
    assert [(r.facet, r.value) for r in X.facets(rows).collect()] == [
        ("frequency", "Daily"), ("frequency", "Weekly"),
        ("intermittency_category", "lumpy"), ("intermittency_category", "smooth"),
    ]


def test_compare_limits(make_panel):
    panel = make_panel({"a": [1.0]})
    with pytest.raises(ValueError):
        X.compare(panel, list("abcdef"))
    with pytest.raises(ValueError):
        X.compare(panel, ["a", "a"])


def test_day_offsets(spark):
    row = spark.sql("SELECT timestamp_ntz'2013-01-02 12:00:00' AS t").select(
        X.day_offset(F.col("t")).alias("x"), X.from_day_offset(X.day_offset(F.col("t"))).alias("d")
    ).first()
    assert row.x == 2 and str(row.d) == "2013-01-03"


# ---- sources --------------------------------------------------------------------------------


def test_files_round_trip(spark, tmp_path):
    rows = table_panel(spark, SF, "part_monthly")
    P.write_panel(rows, str(tmp_path / "panel"))
    again = P.read_panel(spark, str(tmp_path / "panel"))
    assert again.count() == rows.count()
    plan = P.select_series(again, ["7"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(series_id), EqualTo(series_id,7)]" in plan
    index = P.series_index(again, "d", "p")
    assert P.load_series(again, index, "7").count() == rows.filter("series_id = '7'").count()
    with pytest.raises(KeyError):
        P.load_series(again, index, "no such series")


def test_raw_steps_from_csv(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("unique_id,ds,y\nW1,1,5.5\nW1,2,NaN\nW10,1,1\nW2,1,2\n")
    raw = P.read_raw_steps(spark, str(tmp_path / "raw.csv"), "csv")
    out = P.normalize_steps(raw, "Weekly", limit=2).orderBy("series_id", "timestamp").collect()
    assert [(r.series_id, str(r.timestamp)[:10], r.value) for r in out] == [
        ("W1", "2013-01-06", 5.5), ("W1", "2013-01-13", None), ("W10", "2013-01-06", 1.0),
    ]
    with pytest.raises(ValueError):
        P.normalize_steps(raw, "Minutely")


def test_duplicates_are_refused(make_panel):
    panel = make_panel({"a": [1.0, 2.0]})
    assert P.require_unique_steps(panel) is panel
    twice = panel.unionByName(panel)
    for layout in (Layout(whole=True), Layout(chunk_rows=4, block_steps=3)):
        with pytest.raises(Exception, match="duplicate timestamp"):
            number_rows(twice, layout).collect()
    with pytest.raises(Exception, match="duplicate timestamps"):
        missing(twice).collect()
    with pytest.raises(ValueError):
        P.require_unique_steps(panel.unionByName(panel))


def test_long_grids_are_built_in_parts(make_panel):
    from panelcast.operators.layout import Layout

    panel = make_panel({"a": np.arange(50.0), "b": np.arange(3.0)}).filter("value % 7 <> 3")
    small = P.reindex(panel, Layout(chunk_rows=8)).orderBy("series_id", "timestamp").collect()
    assert small == P.reindex(panel).orderBy("series_id", "timestamp").collect() and len(small) == 53


def test_upsert_and_missing(spark, make_panel, tmp_path):
    panel = make_panel({"a": np.arange(5.0), "b": np.arange(6.0)})
    state = lambda p: p.groupBy("series_id").agg(
        F.count("*").alias("n_obs"), F.max("timestamp").alias("end_timestamp"), F.sum("value").alias("total")
    )
    cache = state(panel.filter("series_id = 'a' AND value < 3"))
    kept = by_id(T.compute_missing(panel, cache, state))
    assert kept["a"].total == 3 and kept["b"].total == 15
    fresh = by_id(T.compute_missing(panel, cache, state, refresh=True))
    assert fresh["a"].total == 10
    T.write_table(T.upsert(cache, state(panel)), str(tmp_path / "t"))
    assert by_id(T.read_table(spark, str(tmp_path / "t")))["a"].total == 10


def test_configs(spark):
    rows = spark.createDataFrame([("a", "lag_1", False), ("a", "lag_7", True)], "series_id string, name string, enabled boolean")
    index = spark.createDataFrame([("a",), ("b",)], "series_id string")
    got = by_id(T.read_configs(index, T.store_configs(rows)))
    assert got["a"].config == {"lag_1": False, "lag_7": True} and got["b"].config == {}


def test_one_note_a_series_and_whole_models(spark, make_panel):
    index = P.series_index(make_panel({"a": np.arange(9.0)}), "d", "p")
    good = dict(name="x", feature_type="lag", description="d", rationale="r", confidence=0.5, holiday_country=None)
    note = lambda text, *models: dict(series_id="a", narrative=text, suggested_features=[good], suggested_models=list(models))
    models = [{"name": "ETS", "rationale": "fits"}, {"name": None, "rationale": "r"}, {"name": "Theta", "rationale": None}]
    texts = [json.dumps({"results": [note("second")]}), json.dumps({"results": [note("first", *models)]})]
    notes, valid, rejects = N.ingest_notes(spark.createDataFrame([(t,) for t in texts], "text string"), index)
    row = notes.collect()
    assert [r.narrative for r in row] == ["first"] and [m.name for m in row[0].suggested_models] == ["ETS"]
    assert valid.count() == 1 and [r.reason for r in rejects.collect()] == ["model field missing"] * 2


def test_pieces_bound_padded_values():
    import pyarrow as pa

    from panelcast.functions.batch import padded, pieces

    lengths = [3000, 1, 2, 4000, 10, 0, 7, 2500] * 40
    batch = pa.RecordBatch.from_arrays([pa.array([np.arange(n, dtype=float) for n in lengths], pa.list_(pa.float64()))], ["values"])
    parts = list(pieces([batch], "values", 9000))
    assert sum(p.num_rows for p in parts) == len(lengths)
    assert all(p.num_rows == 1 or padded(p.column("values"))[0].size <= 9000 for p in parts)
    assert [len(v) for p in parts for v in p.column("values")] == lengths
