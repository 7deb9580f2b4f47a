import json
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probeloom.llm import dedup, digest, queries, sampling, topn

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def sampled(df, state=None, rate=0.1):
    return {r.case_id for r in sampling.stable_sample(df, "case_id", F.col("w"), "wave", rate=rate, state=state).collect()}


def test_sample_is_stable_and_grows(spark):
    data = [(f"c{i % 400}", float(1 + i % 5), 1 + i * 5 // 2000) for i in range(2000)] + [(None, 9.0, 1), ("n", None, 1), ("m", NAN, 1), ("neg", -5.0, 2)]
    df = spark.createDataFrame(data, "case_id string, w double, wave int")
    before, state = set(), None
    for wave in range(1, 6):
        upto = sampled(df.where(f"wave <= {wave}"))
        assert before <= upto
        batch = df.where(f"wave = {wave}")
        assert sampled(batch, state) == upto
        state = sampling.running_weights(batch, "case_id", F.col("w"), "wave", 0.1, "sample", state)
        before = upto
    assert before == sampled(df.repartition(7)) and 0 < len(before) < 400 and not before & {None, "n", "m", "neg"}
    assert sampled(df.limit(0)) == set()


def test_sample_waves_of_cases(spark):
    cases = spark.read.parquet(f"{SF}/audit_cases.parquet")
    whole = {r.case_id: r.first_wave for r in queries.p2_sample(spark, SF).collect()}
    assert all(v is not None for v in whole.values())
    assert 0.02 < len(whole) / cases.select("case_id").distinct().count() < 0.5


values = st.floats(allow_nan=True, allow_infinity=True, width=32) | st.sampled_from([0.0, 1.0, -0.0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=3000), st.integers(1, 9))
def test_merged_digest_rank_error(data, parts):
    pieces = [digest.cluster(np.zeros(len(p), dtype=np.int64), p, np.ones(len(p)), 200) for p in np.array_split(np.array(data), min(parts, len(data)))]
    mean, weight = np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces])
    _, mean, weight = digest.cluster(np.zeros(len(mean), dtype=np.int64), mean, weight, 200)
    assert weight.sum() == len(data)
    ordered = np.sort(data)
    for q in (0.05, 0.5, 0.95):
        v = digest.quantile(mean, weight, ordered[0], ordered[-1], q)
        below, upto = np.searchsorted(ordered, v - 1e-7 * abs(v), "left") / len(data), np.searchsorted(ordered, v + 1e-7 * abs(v), "right") / len(data)
        assert max(0.0, below - q, q - upto) <= 0.02 + 1.0 / len(data)


@pytest.mark.parametrize("broadcast", [True, False])
def test_percentiles(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(digest, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(5)
    data = [(k, float(v), 1) for k, n in (("a", 20_000), ("b", 3), (None, 500)) for v in rng.lognormal(size=n)] + [("b", NAN, 1), ("b", None, 1), ("c", INF, 1), ("d", -INF, 1), ("e", 2.0, 1), *[("tie", 1.5, 1)] * 5000]
    df = spark.createDataFrame(data, "k string, x double, n int").repartition(6)
    got = {(r.k, r.percentile): r for r in digest.percentiles(df, ["k"], ["x"], (0.5, 0.95)).collect()}
    assert {k for k, _ in got} == {"a", "b", None, "e", "tie"}
    assert got["tie", 0.5].value == 1.5 and got["e", 0.95].value == 2.0 and got["b", 0.5].n == 3
    assert all(r.rank_error <= max(0.005, 1.0 / r.n) for r in got.values())
    assert digest.percentiles(df.limit(0), ["k"], ["x"], (0.5,)).count() == 0


def test_digests_of_batches_combine(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/probe_evidence.parquet").repartition(5)
    batches = digest.merge_digests(digest.partial_digests(df, ["metric_id", "batch_id"], ["signed_delta"]), ["metric_id", "batch_id"])
    for fan_in in (256, 2):
        monkeypatch.setattr(digest, "FAN_IN", fan_in)
        whole = digest.merge_digests(batches, ["metric_id"])
        got = digest.certify(df, digest.estimates(whole, ["metric_id"], [0.5, 0.9]), ["metric_id"], ["signed_delta"], [0.5, 0.9]).collect()
        assert len(got) == 2 * 4 and all(r.rank_error < 0.005 for r in got)


def test_coarse_digests_are_refined(spark, monkeypatch):
    """Estimates beyond the bound are made again from finer digests of their groups only."""
    rng = np.random.default_rng(8)
    data = [(k, float(v)) for k, n in (("a", 6000), (None, 4000), ("small", 20)) for v in rng.lognormal(sigma=2, size=n)]
    df = spark.createDataFrame(data, "k string, x double").repartition(4)
    coarse = digest.percentiles(df, ["k"], ["x"], (0.3, 0.95), compression=10).collect()
    assert max(r.rank_error for r in coarse) > 0.002
    fine = digest.percentiles(df, ["k"], ["x"], (0.3, 0.95), compression=10, max_error=0.002).collect()
    assert len(fine) == 6 and all(r.rank_error <= max(0.002, 1 / r.n) for r in fine)
    assert digest.percentiles(df.limit(0), ["k"], ["x"], (0.5,), max_error=0.01).count() == 0


def test_long_partitions_keep_one_digest(spark, monkeypatch):
    monkeypatch.setattr(digest, "CHUNK", 500)
    df = spark.range(20_000, numPartitions=2).selectExpr("id % 3 as k", "cast(id as double) as x")
    partials = digest.partial_digests(df, ["k"], ["x"])
    assert partials.count() == 6
    got = digest.certify(df, digest.estimates(digest.merge_digests(partials, ["k"]), ["k"], [0.5]), ["k"], ["x"], [0.5]).collect()
    assert len(got) == 3 and all(r.rank_error < 0.005 for r in got)


def payload(template, exact, paraphrase, **more):
    return json.dumps({"edit": {"prompt_template": template}, "probes": {"exact": exact, "paraphrase": paraphrase}, **more}, ensure_ascii=False)


def test_fold():
    assert dedup.fold("Façade, É 1!") == dedup.fold("FAÇADE é1") != dedup.fold("facade e1")
    assert dedup.fold("a­​b  C") == "abc"
    assert dedup.fold("́") == "" == dedup.fold(" \n")


def collapsed(members, heads):
    """(id, kept id, copies) of every member; one head per record."""
    copies = {r.kept_id: r.copies for r in heads.collect()}
    rows = sorted((r.id, r.kept_id, copies[r.kept_id]) for r in members.collect())
    assert heads.count() == len(copies) == len({k for _, k, _ in rows}) and sum(copies.values()) == len(rows)
    return rows


def test_spelling_copies(spark):
    p = lambda t: [{"prompt": x} for x in t]
    data = [
        (5, payload("The {subject}", p(["A b", "c"]), p(["d"]))), (3, payload("THE subject.", p(["C!", "a  B"]), p(["D", "d"]), z=1)), (4, payload("The {subject}", p(["A b"]), p(["d"]))),
        (9, None), (10, ""), (11, "{"), (12, "[]"), (13, "{}"), (14, payload(None, None, None)), (15, payload("", [], [])), (16, payload("x", None, [None, 3, {"prompt": None}])), (17, payload("X", [], {})),
        (None, payload("X", [], {})), (20, payload("y" * 100_000, [], [])), (21, payload("Y " * 100_000, [], [])),
    ]
    df = spark.createDataFrame([(i, t, "clash", "k") for i, t in data], "submission_id long, payload string, key string, id string")
    got = collapsed(*dedup.spelling_copies(df, "submission_id", "payload"))
    assert got == [(3, 3, 2), (4, 4, 1), (5, 3, 2), (16, 16, 2), (17, 16, 2), (20, 20, 2), (21, 20, 2)]
    assert collapsed(*dedup.spelling_copies(df.limit(0), "submission_id", "payload")) == []
    deep = '{"edit": {"prompt_template": "A"}, "more": ' + "[" * 100_000 + "]" * 100_000 + "}"
    assert dedup.canonical_record(deep) == dedup.canonical_record('{"edit": {"prompt_template": "a."}}') != None  # noqa: E711


def test_runs_across_partitions(spark, monkeypatch):
    keys = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(20_000)] + [(20_000 + i, f"u{i}") for i in range(20)]
    df = spark.createDataFrame(keys, "id long, key string")
    groups = defaultdict(list)
    for i, k in keys:
        groups[k].append(i)
    want = sorted((i, min(v), len(v)) for v in groups.values() for i in v)
    assert collapsed(*dedup.collapse(df)) == want
    monkeypatch.setattr(dedup, "PARTITION", 10_000)  # many partitions within one key
    assert collapsed(*dedup.collapse(df)) == want
    one = spark.createDataFrame([(i, "same") for i in range(3000)], "id long, key string")
    assert collapsed(*dedup.collapse(one)) == [(i, 0, 3000) for i in range(3000)]


def test_copies_of_table(spark):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/case_submissions.parquet").collect():
        groups[dedup.canonical_record(r.payload)].append(r.submission_id)
    want = sorted((min(v), i) for v in groups.values() for i in v if i != min(v))
    assert sorted((r.kept_id, r.copy_id) for r in queries.p4_found(spark, SF).collect()) == want
    assert sorted((r.submission_id, r.copies) for r in queries.p4_copies(spark, SF).collect()) == sorted((min(v), len(v)) for v in groups.values())


def best(data, n):
    groups = defaultdict(set)
    for k, s, t, i in data:
        if s is not None and math.isfinite(s):
            groups[k].add((-s, t is not None, t or "", i))
    return sorted(((k, *x) for k, v in groups.items() for x in sorted(v)[:n]), key=repr)


@pytest.mark.parametrize("hot_share, filled_rows, bands", [(5000, 500_000, (0.3,)), (4, 500_000, (0.04, 0.3)), (4, 0, (0.04, 0.3))])
def test_top_n(spark, monkeypatch, hot_share, filled_rows, bands):
    monkeypatch.setattr(topn, "HOT_SHARE", hot_share)
    monkeypatch.setattr(topn, "FILLED_ROWS", filled_rows)
    rng = np.random.default_rng(3)
    data = [(f"g{int(k)}" if k < 40 else "hot", float(round(v, 1)), "é" if v > 0.5 else "z", int(i)) for i, (k, v) in enumerate(zip(rng.integers(0, 70, 4000), rng.random(4000)))]
    data += data[:300] + [(None, 0.5, "a", 1), (None, 0.5, None, 2), ("g1", None, "a", 1), ("g1", NAN, "a", 1), ("g1", INF, "a", 1), ("only", 0.0, "a", 1), ("only", -0.0, "a", 1)] + [("hot", 0.9999, "copy", 7)] * 2000
    df = spark.createDataFrame([(*r, "clash") for r in data], "k string, s double, t string, i long, rank string").repartition(5)
    got = topn.top_n(df.drop("rank").withColumn("count", F.lit(1)), ["k"], "s", ["t", "i"], 3, bands=bands).collect()
    assert sorted(((r.k, -r.s, r.t is not None, r.t or "", r.i) for r in got), key=repr) == best(data, 3)
    assert topn.top_n(df.limit(0), ["k"], "s", ["t", "i"], 3).count() == 0
