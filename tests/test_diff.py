import math

from probeloom.operators.diff import diff_tables

SCHEMA = "k string, m string, agg double, cov struct<fraction:double>, status string, at timestamp, extra int"
FIELDS = {"agg": ("number", "agg"), "fraction": ("number", "cov.fraction"), "status": ("text", "status")}
NAN, INF = float("nan"), float("inf")


def rows(spark, data):
    from datetime import datetime

    made = [(k, m, a, None if f == "none" else (f,), s, None if t is None else datetime(2030, 1, t), 1) for k, m, a, f, s, t in data]
    return spark.createDataFrame(made, SCHEMA)


def found(spark, left, right):
    out = diff_tables(rows(spark, left), rows(spark, right), ["k", "m"], FIELDS, order_by="at")
    return sorted((str(r.k), r.m, r.finding) for r in out.collect())


def test_missing_and_differing(spark):
    left = [("a", "x", 1.0, 0.5, "ok", 1), ("b", "x", 1.0, 0.5, "ok", 1), ("c", "x", 1.0, 0.5, "ok", 1)]
    right = [("a", "x", 1.0 + 1e-10, 0.5, "ok", 1), ("b", "x", 1.1, 0.4, "OK", 1), ("d", "x", 1.0, 0.5, "ok", 1)]
    assert found(spark, left, right) == [("b", "x", "agg"), ("b", "x", "fraction"), ("b", "x", "status"), ("c", "x", "only_left"), ("d", "x", "only_right")]


def test_latest_row_counts_and_repeats_cancel(spark):
    left = [("a", "x", 9.0, 0.5, "old", None), ("a", "x", 1.0, 0.5, "ok", 2), ("a", "x", 1.0, 0.5, "ok", 2), ("a", "x", 9.0, 0.5, "old", 1)]
    assert found(spark, left, [("a", "x", 1.0, 0.5, "ok", 1)]) == []


def test_null_nan_infinite(spark):
    left = [("a", "1", None, 0.5, None, 1), ("a", "2", NAN, None, "s", 1), ("a", "3", INF, "none", "s", 1), ("a", "4", None, 1.0, None, 1), ("a", "5", INF, 1.0, "s", 1), ("a", "6", NAN, 1.0, "s", 1)]
    right = [("a", "1", None, 0.5, None, 1), ("a", "2", NAN, None, "s", 1), ("a", "3", INF, None, "s", 1), ("a", "4", NAN, 1.0, "s", 1), ("a", "5", -INF, 1.0, "s", 1), ("a", "6", 1.0, 1.0, "s", 1)]
    assert found(spark, left, right) == [("a", "4", "agg"), ("a", "4", "status"), ("a", "5", "agg"), ("a", "6", "agg")]
    assert math.isnan(NAN)


def test_null_keys_and_empty_tables(spark):
    one = [(None, "x", 1.0, 0.5, "ok", 1)]
    assert found(spark, one, one) == []
    assert found(spark, one, []) == [("None", "x", "only_left")]
    assert found(spark, [], one) == [("None", "x", "only_right")]
    assert found(spark, [], []) == []
