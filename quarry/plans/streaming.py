"""Registered streaming queries (S01–S04): ``events`` read as a file stream,
run with the availableNow trigger; each has a batch twin in SQL where the
streamed result is deterministic."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..sources.tables import table
from ..streaming import monitor as S
from .registry import query

BASELINE_DAYS = 7


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return S.read_stream(spark, sf.rstrip("/"), schema, max_files=1, file_glob="events.parquet")


@query("s01_windowed_drift", f"""
WITH b AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std FROM events
           WHERE ts < (SELECT min(ts) FROM events) + INTERVAL {BASELINE_DAYS} DAY GROUP BY event_type),
w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, avg(value) AS cm, stddev_samp(value) AS cs
      FROM events GROUP BY 1, 2),
s AS (SELECT w.*, abs(cm - mean) / (std + 1e-9) + abs(1 - cs / (std + 1e-9)) AS score FROM w JOIN b USING (event_type))
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, n, round(cm, 6) + 0.0 AS window_mean,
  round(cs, 6) + 0.0 AS window_std, round(score, 6) + 0.0 AS drift_score, score > 0.5 AS is_drifted FROM s""")
def s01(spark, sf):
    ev = table(spark, sf, "events")
    t0 = ev.agg(F.min("ts")).first()[0]
    base = S.baseline_stats(ev.where(F.col("ts") < F.lit(t0) + F.expr(f"INTERVAL {BASELINE_DAYS} DAYS")),
                            "event_type", "value")
    stats = S.windowed_stats(_stream(spark, sf), "ts", "event_type", "value", "1 day", "1 day")
    out = S.run_available(S.drift_against(stats, base, "event_type"), "s01", mode="update")
    res = S.latest(spark, out, ["window_start", "event_type"])
    return res.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", r6(F.col("window_mean")).alias("window_mean"),
                      r6(F.col("window_std")).alias("window_std"), r6(F.col("drift_score")).alias("drift_score"),
                      "is_drifted")


def _rules():
    return [("value_range", F.col("value").between(0, 300)),
            ("props_k", F.get_json_object("props", "$.k").cast("int") < 95)]


def _quarantine(spark, sf):
    v = S.validate_stream(_stream(spark, sf), _rules())
    from ..session import scratch_path
    good, bad = scratch_path(spark, "s02-good"), scratch_path(spark, "s02-bad")
    S.run_available(v, "s02", mode="append", sink=S.quarantine_sink(good, bad))
    return good, bad


_BAD_SQL = """SELECT event_id, array_to_string(list_filter(['value_range', 'props_k'], lambda r: (r = 'value_range' AND NOT coalesce(value BETWEEN 0 AND 300, false))
   OR (r = 'props_k' AND NOT coalesce(CAST(json_extract_string(props, '$.k') AS INT) < 95, false))), ',') AS reason FROM events"""


@query("s02_quarantine", f"""SELECT event_id, reason FROM ({_BAD_SQL}) WHERE reason <> ''""")
def s02(spark, sf):
    _, bad = _quarantine(spark, sf)
    return spark.read.parquet(bad).select("event_id", "reason")


@query("s02_accepted", f"""SELECT count(*) AS n_accepted, CAST(sum(value) AS DOUBLE) AS value_total FROM events
WHERE event_id IN (SELECT event_id FROM ({_BAD_SQL}) WHERE reason = '')""")
def s02a(spark, sf):
    good, _ = _quarantine(spark, sf)
    return spark.read.parquet(good).agg(F.count(F.lit(1)).alias("n_accepted"), F.sum("value").alias("value_total"))


@query("s03_running_totals", """
SELECT event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY event_type""")
def s03(spark, sf):
    out = S.run_available(S.running_totals(_stream(spark, sf), "event_type", "value"), "s03", mode="update")
    res = S.latest(spark, out, ["event_type"])
    return res.select("event_type", "n", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"))


@query("s03_stream_predict")
def s03p(spark, sf):
    ev = table(spark, sf, "events")
    pipe = Pipeline(stages=[StringIndexer(inputCol="event_type", outputCol="et", handleInvalid="keep"),
                            VectorAssembler(inputCols=["et", "user_id"], outputCol="features"),
                            LinearRegression(labelCol="value")])
    model = pipe.fit(ev)  # fitted once on the static table, applied per micro-batch
    scored = model.transform(_stream(spark, sf)).select("event_id", "ts", "event_type", "value", "prediction")
    out = S.run_available(scored, "s03p", mode="append")
    return spark.read.parquet(out).drop("batch_id")


@query("s04_ttl_dedupe_keys", """SELECT DISTINCT user_id, event_type FROM events""")
def s04(spark, sf):
    out = S.run_available(S.dedupe_within(_stream(spark, sf), "ts", ["user_id", "event_type"], "1 hour"), "s04")
    # one micro-batch holds the whole file: every key is served once in it
    return spark.read.parquet(out).select("user_id", "event_type")
