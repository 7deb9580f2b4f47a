import json

from hypothesis import given, settings
from hypothesis import strategies as st

from probeloom.operators.shred import REPORT, Number, Shredder, assemble, flatten_reports, leaves_of, parse_report, shred_leaves
from probeloom.plans import copies
from probeloom.sources import nested


def brute(raw):
    """Child rows by walking the objects."""
    out = []
    for i, text in raw:
        report = parse_report(text)
        if report is None:
            continue
        metrics = report.get("metrics")
        if isinstance(metrics, dict):
            metrics = [metrics] if "metric_id" in metrics else [{**m, "metric_id": m.get("metric_id") or k} for k, m in metrics.items()]
        for m in metrics or []:
            for kind, group, name in (("probe", "probes", "probe_id"), ("citation", "citations", "title")):
                children = m.get(group)
                children = children if isinstance(children, list) else [] if children is None else [children]
                out += [(i, m.get("metric_id"), kind, k, c.get(name)) for k, c in enumerate(children) if c]
    return sorted(out, key=repr)


def run(spark, raw):
    flat = flatten_reports(spark.createDataFrame(raw, "raw_id long, payload string"), "probe", "citation")
    return sorted(((r.raw_id, r.metric_id, r.kind, r.child_pos, r.probe_id if r.kind == "probe" else r.title) for r in flat.collect()), key=repr)


METRIC = {"metric_id": "m1", "coverage": {"fraction": "0.5"}, "probes": [{"probe_id": "p1", "values": {"signed_delta": "1.5"}}, {"probe_id": "p2", "values": None}, {"probe_id": "p3"}], "citations": {"title": "t"}}


def test_shapes(spark):
    report = {"report_id": "r", "metrics": [METRIC, {"metric_id": "m2", "probes": None, "citations": []}, {"metric_id": "m3", "probes": {"probe_id": "q"}}]}
    text = json.dumps(report)
    raw = [
        (1, text), (2, json.dumps(text)), (3, "﻿" + text), (4, json.dumps({"report": report})), (5, text[:-5]), (6, None), (7, ""), (8, "[]"), (9, "null"),
        (10, json.dumps({"metrics": {"m9": {k: v for k, v in METRIC.items() if k != "metric_id"}}})), (11, json.dumps({"metrics": METRIC})), (12, json.dumps({"metrics": None})), (13, text), (14, '{"metrics":' + "[" * 100_000),
    ]
    assert run(spark, raw) == brute(raw)
    assert len(brute(raw)) > 20
    probes = flatten_reports(spark.createDataFrame(raw[:1], "raw_id long, payload string"), "probe").collect()
    assert [(p.metric_pos, p.child_pos, p.signed_delta) for p in probes] == [(0, 0, 1.5), (0, 1, None), (0, 2, None), (2, 0, None)]
    metrics = flatten_reports(spark.createDataFrame(raw[:1], "raw_id long, payload string"), "metric").collect()
    assert [(m.metric_id, m.coverage_fraction) for m in metrics] == [("m1", 0.5), ("m2", None), ("m3", None)]


def test_empty(spark):
    assert run(spark, []) == []


def test_whole_table_against_walk(spark):
    sf = "/root/testdata/sf0.01"
    raw = [(r.raw_id, r.payload) for r in spark.read.parquet(f"{sf}/raw_reports.parquet").collect()]
    got = sorted(((r.raw_id, r.metric_id, r.child, r.child_pos, r.child_name) for r in copies.p5_found(spark, sf).collect()), key=repr)
    assert got == brute(raw)


probes = st.none() | st.lists(st.fixed_dictionaries({}, optional={"probe_id": st.sampled_from("abc"), "status": st.none() | st.just("ok")}), max_size=4)
metrics = st.none() | st.lists(st.fixed_dictionaries({}, optional={"metric_id": st.sampled_from("xyz"), "probes": probes}), max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.fixed_dictionaries({}, optional={"report_id": st.just("r"), "metrics": metrics}), max_size=5))
def test_levels_round_trip(records):
    shredder = Shredder(REPORT)
    for i, r in enumerate(records):
        shredder.add(i, r)
    path = ("metrics", "probes", "probe_id")
    made = assemble(shredder, ("metrics", "probes"), [path, ("metrics", "metric_id"), ("report_id",)])
    got = list(zip(made.record.tolist(), made.ordinals[0].tolist(), made.ordinals[1].tolist(), made.values[path], made.values[("metrics", "metric_id")], made.values[("report_id",)]))
    want = [(i, j, k, p.get("probe_id"), m.get("metric_id"), r.get("report_id")) for i, r in enumerate(records) for j, m in enumerate(r.get("metrics") or []) for k, p in enumerate(m.get("probes") or [])]
    assert got == want


json_values = st.recursive(st.none() | st.booleans() | st.integers(-10**20, 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(json_values)
def test_reading_without_recursion(value):
    for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
        assert nested._deep(text, None) == json.loads(text) == value
        for bad in (text[:-1], text + "x", "," + text):
            try:
                want = json.loads(bad)
            except ValueError:
                want = ValueError
            try:
                got = nested._deep(bad, None)
            except ValueError:
                got = ValueError
            assert got == want


def test_deep_and_often_quoted_payloads(spark):
    report = {"report_id": "r", "metrics": [METRIC]}
    text = json.dumps(report)
    deep = text[:-1] + ', "extra": ' + '{"a": [' * 100_000 + '"x"' + "]}" * 100_000 + "}"
    deep_status = text[:-2].replace('"m1"', '"m1", "status": ' + "[" * 50_000 + "]" * 50_000, 1) + "]}"
    quoted = text
    for _ in range(12):
        quoted = json.dumps(quoted)
    many = text
    for _ in range(3):
        many = json.dumps(many)
    raw = [(1, deep), (2, quoted), (3, deep_status), (4, deep[:-1]), (5, many)]
    assert [(r[0], r[3], r[4]) for r in run(spark, raw)] == sorted([(i, k, n) for i in (1, 2, 3, 5) for k, n in ((0, "p1"), (0, "t"), (1, "p2"), (2, "p3"))], key=lambda r: (r[0], r[2] != "t", r[1]))
    metrics = flatten_reports(spark.createDataFrame(raw, "raw_id long, payload string"), "metric").collect()
    assert {m.raw_id: m.status for m in metrics}[3] == "[" * 50_000 + "]" * 50_000
    leaves = shred_leaves(spark.createDataFrame(raw[:1], "raw_id long, payload string")).collect()
    assert len(leaves) == 10 and max(r["def"] for r in leaves) == 200_001


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_leaves_give_the_record_back(value):
    """Every leaf once, in its place, and the levels as a walk over the leaves counts them."""
    def walk(v, steps):
        if v and isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, (*steps, k))
        elif v and isinstance(v, list):
            for n, x in enumerate(v):
                yield from walk(x, (*steps, n))
        else:
            yield steps, v

    got, want = list(leaves_of(json.loads(json.dumps(value), parse_int=Number, parse_float=Number))), list(walk(value, ()))
    assert [(p, o, d) for p, o, _, d, _, _ in got] == [(".".join("[]" if isinstance(x, int) else x for x in s), [x for x in s if isinstance(x, int)], max(0, len(s) - (v is None))) for s, v in want]
    assert [t for *_, t in got] == [None if v is None or isinstance(v, dict | list) else json.dumps(v) if not isinstance(v, str) else v for _, v in want]
    seen = {}
    for path, ordinals, rep, *_ in got:
        before = seen.get(path)
        assert rep == 0 if before is None or before == ordinals else before[: rep - 1] == ordinals[: rep - 1] and before[rep - 1] != ordinals[rep - 1]
        seen[path] = ordinals
