import math

import pandas as pd
import pytest

from pyspark.sql import functions as F

from probeloom.operators import guards as G
from probeloom.operators import recorded as C

NAN = float("nan")


def rules(df, name):
    return sorted((r[name], r.rule) for r in df.collect())


def test_paired(spark, monkeypatch):
    data = [("ok", -1.0, -2.0, None), ("zero", 0.0, -1.0, None), ("up", 0.5, -1.0, None), ("nan", -1.0, NAN, None), ("gone", None, -1.0, "lost"), ("why", None, -1.0, None), ("blank", None, -1.0, " "), ("extra", -1.0, -1.0, "x"), ("twice", -1.0, -1.0, None), ("twice", -1.0, -1.0, None), ("-id", -1.0, -1.0, None)]
    df = spark.createDataFrame([("c", *r) for r in data], "k string, probe_id string, baseline double, edited double, missing_reason string")
    assert rules(G.paired_guards(df, ["k"]), "probe_id") == [("-id", "probe identifier"), ("blank", "missing reason"), ("extra", "missing reason"), ("nan", "edited score not finite and at most 0"), ("twice", "duplicate probe"), ("up", "baseline score not finite and at most 0"), ("why", "missing reason")]
    monkeypatch.setattr(G, "MAX_PROBES", 3)
    assert (None, "too many probes") in [(r.probe_id, r.rule) for r in G.paired_guards(df, ["k"]).collect()]
    assert G.paired_guards(df.limit(0), ["k"]).count() == 0


def test_logits(spark, monkeypatch):
    z = [[0.0, 1.0], [1.0, 0.0]]
    data = [("ok", z, z, None), ("pos", z, z[:1], None), ("voc", z, [[0.0, 1.0, 2.0]] * 2, None), ("thin", [[1.0]], [[1.0]], None), ("rag", [[1.0, 2.0], [1.0]], z, None), ("nan", [[NAN, 1.0]], [[0.0, 1.0]], None), ("none", [], [], None), ("gone", None, z, "lost"), ("why", None, z, None)]
    df = spark.createDataFrame([("c", *r) for r in data], "k string, probe_id string, baseline array<array<double>>, edited array<array<double>>, missing_reason string")
    got = rules(G.logits_guards(df, ["k"]), "probe_id")
    assert {n for n, _ in got} == {"pos", "voc", "thin", "rag", "nan", "none", "why"} and ("voc", "vocabulary sizes differ") in got and ("pos", "position counts differ") in got
    monkeypatch.setattr(G, "MAX_LOGITS", 5)
    assert "too many logits" in {r.rule for r in G.logits_guards(df, ["k"]).collect()}


def test_tensors(spark, monkeypatch):
    inventory = spark.createDataFrame([("c", n, s) for n, s in (("ok", [2, 2]), ("short", [3]), ("nan", [1]), ("twice", [1]), ("twice", [1]), ("flat", [0]), ("over", [1]), ("lost", [2]))], "k string, name string, shape array<bigint>")
    pairs = spark.createDataFrame([("c", *r) for r in (("ok", [1.0] * 4, [2.0] * 4, None), ("short", [1.0], [1.0], None), ("nan", [NAN], [1.0], None), ("odd", [1.0], [1.0], None), ("over", [-1e308], [1e308], None), ("lost", None, [1.0, 1.0], "gone"))], "k string, name string, baseline array<double>, edited array<double>, missing_reason string")
    got = rules(G.tensor_guards(inventory, pairs, ["k"]), "name")
    assert [n for n, _ in got] == ["flat", "nan", "nan", "odd", "over", "short", "short", "twice"] and ("odd", "not in the inventory") in got and ("over", "difference not finite") in got
    monkeypatch.setattr(G, "MAX_MULTIPLICATIONS", 10)
    assert "too much work for the spectral estimate" in {r.rule for r in G.tensor_guards(inventory, pairs, ["k"], iterations=5).collect()}


def test_budget(spark):
    df = spark.createDataFrame([("a", i, 3) for i in range(5)] + [("b", 0, 3)], "k string, pos int, w int")
    assert [(r.k, r.pos, r.running) for r in G.within_budget(df, [F.col("pos")], "w", 7, ["k"]).collect()] == [("a", 2, 9)]


def test_model_pairs_and_requests(spark):
    schema = "pair_id int, baseline_kind string, edited_kind string, baseline_state_id string, edited_state_id string, baseline_model_id string, edited_model_id string, baseline_tokenizer_id string, edited_tokenizer_id string"
    df = spark.createDataFrame([(1, "baseline", "edited", "a", "b", "m", "m", "t", "t"), (2, "edited", "edited", "a", "a", "m", "n", "t", "t")], schema)
    assert {r.pair_id for r in G.model_pair_guards(df).collect()} == {2} and G.model_pair_guards(df).count() == 3
    traces = spark.createDataFrame([(1, "p", "s", "t", ["a"], 0), (2, " ", "s", "t", ["a", "a"], -1), (3, "p", None, "t", [], 2**32)], "trace_id int, prompt string, subject string, target string, modules array<string>, seed bigint")
    assert rules(G.trace_guards(traces), "trace_id") == [(2, "module repeated"), (2, "prompt"), (2, "seed"), (3, "no module"), (3, "seed"), (3, "subject")]


def test_recorded_model(spark):
    tokens = spark.createDataFrame([("a b c a", [1, 2, 3, 1]), ("b c", [2, 3]), ("a", [1]), ("t", [1, 0])], "text string, ids array<int>")
    logits = spark.createDataFrame([("a b c a", "t", [[math.log(0.1), math.log(0.9)], [math.log(0.8), math.log(0.2)]]), ("a", "t", [[0.0, 0.0]])], "prompt string, target string, rows array<array<double>>")
    model = C.RecordedModel(tokens, logits)
    requests = spark.createDataFrame([("r1", "a b c a", "t", "b c"), ("r2", "a", "t", "a"), ("r3", "x", "y", "a"), ("r4", "a b c a", "t", "a")], "request_id string, prompt string, target string, subject string")
    got = {r.request_id: r.sum_log_probability for r in model.score(requests).collect()}
    assert got["r1"] == pytest.approx(math.log(0.9) + math.log(0.8)) and got["r2"] is None and "r3" not in got
    assert sorted((r.request_id, r.what) for r in model.unknown(requests).collect()) == [("r3", "logits"), ("r3", "target tokens")]
    assert {r.request_id: (r.start, r.end) for r in model.subject_spans(requests).collect()} == {"r1": (1, 3), "r2": (0, 1), "r3": (None, None), "r4": (None, None)}

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame({"request_id": b.request_id, "sum_log_probability": -1.0, "mean_log_probability": -1.0, "tokens": b.target.str.len()})

    assert C.score_live(requests, scorer).count() == 4


def test_traces(spark):
    runs = [("t", "clean", None, -1.0, None), ("t", "corrupted", None, -3.0, "c"), ("t", "restored", "m1", -2.0, "c"), ("t", "restored", "m2", -1.5, "c")]
    runs += [("u", "clean", None, -1.0, None), ("u", "corrupted", None, -3.0, "c"), ("u", "restored", "m1", NAN, "d")]
    modules = spark.createDataFrame([("t", "m1", 0), ("t", "m2", 1), ("u", "m2", 0)], "trace_id string, module string, ord int")
    good, issues = C.trace(spark.createDataFrame(runs, "trace_id string, kind string, module string, score double, corruption_id string"), modules)
    assert [(r.module, r.delta, r.recovery) for r in good.orderBy("ord").collect()] == [("m1", 1.0, 0.5), ("m2", 1.5, 0.75)]
    assert sorted(r.issue for r in issues.collect()) == ["modules missing: m2; unexpected: m1", "more than one corruption", "restored score is not finite"]
    assert {r.trace_id for r in issues.collect()} == {"u"}
