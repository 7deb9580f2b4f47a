import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.functions import numeric as N
from probeloom.functions import text as T
from probeloom.operators import metrics as M
from probeloom.operators import rules as R
from probeloom.operators import spans as S

LN = math.log


def one(spark, expr, **columns):
    """The value of a column expression over one row."""
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in columns.items())
    return spark.createDataFrame([tuple(v for _, v in columns.values())], schema).select(expr.alias("x")).first().x


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


ROWS = "array<array<double>>"


def test_sequence_scores(spark):
    df = spark.createDataFrame([("s", 0, [LN(0.1), LN(0.9)], 1), ("s", 1, [LN(0.8), LN(0.2)], 0), ("big", 0, [1000.0, 999.0, 998.0], 0), ("big", 1, [-1000.0, -1001.0, -1002.0], 2), ("out", 0, [1.0, 2.0], 5)], "id string, pos int, z array<double>, t int")
    got = {r.id: r for r in M.sequence_log_probability(df, ["id"], "z", "t").collect()}
    assert got["s"].sum_log_probability == pytest.approx(LN(0.9) + LN(0.8)) and got["s"].tokens == 2
    n = LN(1 + math.exp(-1) + math.exp(-2))
    assert got["big"].sum_log_probability == pytest.approx(-n - 2 - n) and got["out"].sum_log_probability is None


@pytest.mark.parametrize("seed", range(5))
def test_log_softmax_against_numpy(spark, seed):
    z = np.random.default_rng(seed).normal(size=20) * 50
    want = (z / 0.7) - np.logaddexp.reduce(z / 0.7)
    assert one(spark, N.log_softmax(F.col("z"), 0.7), z=("array<double>", z.tolist())) == pytest.approx(want.tolist())


def test_paired_reduction(spark):
    data = [("a", -2.0, -1.0), ("a", -1.5, -1.75), ("a", -3.0, -2.5), ("b", -1.0, 0.0), ("b", None, -1.0), ("b", -1.0, None), ("c", None, None)]
    df = spark.createDataFrame(data, "g string, b double, e double")
    got = {r.g: r for r in M.reduce_paired(M.paired_evidence(df, "b", "e"), ["g"]).collect()}
    assert got["a"].aggregate == pytest.approx(1.25 / 3) and got["a"].warning is None and got["a"].fraction == 1.0
    assert (got["b"].aggregate, got["b"].total, got["b"].evaluated) == (1.0, 3, 1) and got["b"].warning == "partial coverage: evaluated 1 of 3 probes; aggregate excludes 2 missing probes"
    assert got["c"].aggregate is None and got["c"].fraction == 0.0 and got["c"].warning.startswith("aggregate unavailable: evaluated 0 of 1 probes")
    drift = spark.createDataFrame([("l", -1.0, -1.1), ("l", -2.0, -1.6)], "g string, b double, e double")
    assert M.reduce_paired(M.paired_evidence(drift, "b", "e", True), ["g"]).first().aggregate == pytest.approx(0.25)
    assert M.reduce_paired(M.paired_evidence(df.limit(0), "b", "e"), ["g"]).count() == 0


def test_divergence(spark):
    z = "array<double>"
    assert one(spark, N.directed_kl(F.col("a"), F.col("b")), a=(z, [1000.0, -1000.0]), b=(z, [-1000.0, 1000.0])) == 2000.0
    assert one(spark, N.directed_kl(F.col("a"), F.col("b")), a=(z, [0.3, 0.1, 7.0]), b=(z, [0.3, 0.1, 7.0])) == 0.0
    data = [("p", 0, [0.0, 0.0], [0.2, -0.2]), ("p", 1, [0.5, -0.5], [0.4, -0.4]), ("q", 0, [0.0, 0.0], [0.2, -0.2]), ("r", 0, None, [0.0, 0.0]), ("r", 1, [0.0, 0.0], [0.0, 0.0])]
    probes = M.probe_divergence(M.position_divergence(spark.createDataFrame(data, "id string, pos int, b array<double>, e array<double>"), "b", "e"), ["id"])
    means = {r.id: r.mean_kl for r in probes.collect()}
    assert means["p"] == pytest.approx(0.0119593830) and means["q"] == pytest.approx(0.0198680718) and means["r"] is None
    total = M.reduce_divergence(probes).first()
    assert total.aggregate == pytest.approx((means["p"] + means["q"]) / 2) and (total.total, total.evaluated, total.total_positions, total.evaluated_positions) == (3, 2, 5, 3)
    assert total.warning == "partial coverage: evaluated 2 of 3 control probes; aggregate excludes 1 missing probe"


def test_structure(spark):
    inventory = spark.createDataFrame([("m", 2), ("v", None), ("none", None), ("half", None)], "name string, width int")
    pairs = spark.createDataFrame([("m", [1.0, 0.0, 0.0, 1.0], [4.0, 0.0, 0.0, 5.0]), ("v", [0.0, 0.0], [1.0, 2.0]), ("half", [1.0], None)], "name string, b array<double>, e array<double>")
    tensors = M.tensor_differences(inventory, pairs, "name", "b", "e", columns="width", iterations=40)
    got = {r.name: r for r in tensors.collect()}
    assert got["m"].delta_norm == pytest.approx(5.0) and got["m"].spectral_norm == pytest.approx(4.0) and got["m"].relative_norm == pytest.approx(5 / math.sqrt(2))
    assert got["v"].relative_norm is None and got["v"].spectral_norm is None and got["v"].status == "evaluated"
    assert got["none"].status == got["half"].status == "missing" and got["half"].delta_norm is None
    total = M.structural_summary(tensors).first()
    assert total.aggregate_delta == pytest.approx(math.sqrt(30)) and total.aggregate_relative == pytest.approx(math.sqrt(30) / math.sqrt(2)) and (total.status, total.fraction) == ("incomplete", 0.5)
    assert total.warnings[0] == "partial structural coverage: evaluated 2 of 4 inventoried tensors; aggregates exclude 2 missing tensors" and len(total.warnings) == 2
    assert got["v"].warnings == [M.NO_RELATIVE, M.NOT_RANK_2] and got["m"].warnings == [M.ESTIMATE] and got["none"].warnings == [M.NO_EVIDENCE]
    for bad in (0, 1001, True):
        with pytest.raises(ValueError):
            M.tensor_differences(inventory, pairs, "name", "b", "e", iterations=bad)
    assert one(spark, N.euclidean(F.col("v")), v=("array<double>", [1e200, 1e200])) == pytest.approx(math.sqrt(2) * 1e200)


def iterated(m, steps):
    """Power iteration as it is defined, on vectors."""
    m = np.array(m)
    v = m[np.argmax(np.linalg.norm(m, axis=1))]
    v = v / np.linalg.norm(v)
    for _ in range(steps):
        v = m.T @ (m @ v)
        v = v / np.linalg.norm(v)
    return np.linalg.norm(m @ v)


@pytest.mark.parametrize("shape", [(5, 7), (7, 5), (1, 4), (4, 1), (3, 3)])
@pytest.mark.parametrize("steps", [1, 2, 20])
def test_power_iteration_against_numpy(spark, shape, steps):
    m = np.random.default_rng(2).normal(size=shape) * 1e6
    assert one(spark, N.power_iteration(F.col("m"), steps), m=(ROWS, m.tolist())) == pytest.approx(iterated(m, steps))


def test_power_iteration_of_odd_matrices(spark):
    norm = lambda m, n: one(spark, N.power_iteration(F.col("m"), n), m=(ROWS, m))
    assert norm([[0.0, 0.0], [0.0, 0.0]], 3) == 0.0
    assert norm([[1e200, 0.0], [0.0, 1e200]], 2) == pytest.approx(1e200)
    m = np.random.default_rng(3).normal(size=(5, 7))
    assert norm(m.tolist(), 300) == pytest.approx(np.linalg.norm(m, 2))


def test_tracing(spark):
    df = spark.createDataFrame([(1, -1.0, -3.0, -2.0), (2, -1.0, -3.0, -1.5), (3, -1.0, -1.0, -0.5)], "i int, c double, k double, r double")
    got = {r.i: (r.delta, r.recovery, r.warning is None) for r in M.causal_recovery(df, "c", "k", "r").collect()}
    assert got == {1: (1.0, 0.5, True), 2: (1.5, 0.75, True), 3: (0.5, None, False)}
    runs = spark.createDataFrame([("t", "c1"), ("t", "c1"), ("u", "c1"), ("u", "c2")], "t string, c string")
    assert rows_of(M.single_corruption(runs, "t", "c"), "t") == [("u",)]
    asked = spark.createDataFrame([("t", "b"), ("t", "a"), ("u", "a")], "t string, m string")
    given = spark.createDataFrame([("t", "c"), ("t", "b"), ("u", "a")], "t string, m string")
    assert rows_of(M.module_mismatch(asked, given, "t", "m"), "t", "missing", "unexpected") == [("t", "a", "c")]


def test_duplicates_coverage_and_states(spark):
    df = spark.createDataFrame([("d", "x", 2), ("d", "x", 1), ("d", "y", 1), ("e", "x", 1), ("d", "x", 3)], "doc string, id string, pos int")
    got = M.first_duplicates(df, ["doc", "id"], [F.col("pos")], F.concat(F.lit("$["), F.col("pos"), F.lit("]")))
    assert rows_of(got, "path", "first_path") == [("$[2]", "$[1]"), ("$[3]", "$[1]")]
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("aab", "bbc"))
    assert rows_of(M.coverage_gap(a, b, "k"), "k", "side") == [("a", "missing"), ("c", "extra")]
    events = spark.createDataFrame([("r", 1, "running"), ("r", 2, "completed"), ("r", 3, "failed"), ("s", 1, "completed"), ("t", 1, None)], "run string, n int, state string")
    assert rows_of(M.invalid_transitions(events, ["run"], "state", [F.col("n")]), "run", "n") == [("r", 3), ("s", 1), ("t", 1)]
    reads = spark.createDataFrame([(1, 1.0, 2.0, 1.0), (2, 1.0, 2.0, 3.0), (3, None, 2.0, None)], "i int, b double, e double, a double")
    assert rows_of(M.contaminated(reads, "b", "e", "a"), "i") == [(2,)]


def test_text_predicates(spark):
    text = ("string", None)
    for value, good in (("a", True), ("a.b-c_9", True), ("-a", False), ("a\n", False), ("", False), ("é", False), ("a" * 128, True), ("a" * 129, False), (None, False)):
        assert one(spark, T.is_identifier(F.col("t")), t=("string", value)) is good
    for value, blank in ((" \t\n", True), (" 　", True), ("\x1c\x1f", True), ("", True), (" x ", False), (None, False)):
        assert one(spark, T.is_blank(F.col("t")), t=("string", value)) is blank
    for value, good in (("2030-02-28T00:00:00Z", True), ("2030-02-28T00:00:00.123456Z", True), ("2030-02-30T00:00:00Z", False), ("2030-02-28 00:00:00Z", False), ("2030-02-28T00:00:00+00:00", False)):
        assert (one(spark, T.utc_time(F.col("t")), t=("string", value)) is not None) is good
    assert one(spark, T.escape_markdown(F.col("t")), t=("string", "<a href=\"x\">|`*_[]\\\r\n'&")) == T.escape_markdown_text("<a href=\"x\">|`*_[]\\\r\n'&")
    for complete, reason, good in ((True, None, True), (True, "x", False), (False, None, False), (False, " ", False), (False, "x", True), (False, "x" * 4097, False)):
        assert one(spark, T.valid_missing_reason(F.col("r"), F.col("c")), r=("string", reason), c=("boolean", complete)) is good
    assert text


def test_spans(spark):
    got = lambda e, **c: one(spark, e, **c)
    text = {"t": ("string", "aaa bab"), "p": ("string", "aa")}
    assert got(S.substring_starts(F.col("t"), F.col("p")), **text) == [0, 1] and got(S.unique_start(S.substring_starts(F.col("t"), F.col("p"))), **text) is None
    assert got(S.substring_starts(F.col("t"), F.col("p")), t=("string", "x"), p=("string", "")) == []
    tokens = {"t": ("array<int>", list(range(6))), "p": ("array<int>", [1, 2])}
    assert got(S.unique_start(S.token_starts(F.col("t"), F.col("p"))), **tokens) == 1
    assert got(S.token_starts(F.col("t"), F.col("p")), t=("array<int>", [1]), p=("array<int>", [1, 2])) == []
    offsets = ("array<struct<start:int,end:int>>", [(0, 0), (0, 3), (3, 4), (4, 9)])
    assert got(S.overlapping_tokens(F.col("o"), F.lit(2), F.lit(5)), o=offsets) == [1, 2, 3]
    assert got(S.covers(F.col("o"), F.lit(2), F.lit(5)), o=offsets) is True
    assert got(S.covers(F.col("o"), F.lit(2), F.lit(12)), o=offsets) is False
    assert got(S.contiguous(F.col("i")), i=("array<int>", [1, 2, 3])) is True and got(S.contiguous(F.col("i")), i=("array<int>", [1, 3])) is False and got(S.contiguous(F.col("i")), i=("array<int>", [])) is False
    ids = {"p": ("array<int>", [7, 8]), "w": ("array<int>", [7, 8, 9]), "z": (ROWS, [[0.0], [1.0], [2.0]])}
    assert got(S.target_rows(F.col("p"), F.col("w"), F.col("z")), **ids) == [[1.0]]
    assert got(S.target_rows(F.col("p"), F.col("w"), F.col("z")), **(ids | {"p": ("array<int>", [7, 9])})) is None


def test_module_paths(spark):
    edges = spark.createDataFrame([("root", "h", "module", "H"), ("root", "h", "field", "X"), ("H", "0", "sequence", "B0"), ("H", "10", "sequence", "B10"), ("B0", "attn", "module", "A"), ("B0", "null", "module", None)], "parent string, segment string, source string, child string")
    want = {"h.0.attn": ("A", None), "h": ("H", None), "h.10": ("B10", None), "h.2": (None, 1), "h.0.null": (None, 2), "x": (None, 0), "": (None, -1), "h..0": (None, -1), "h._p": (None, -1), "h.01": (None, -1), "h.-1": (None, -1), "x" * 5000: (None, -1), None: (None, -1)}
    df = spark.createDataFrame([(p, "root") for p in want], "path string, root string")
    assert {r.path: (r.node, r.failed_at) for r in S.resolve_paths(df, edges).collect()} == want


def test_rules_of_cases(spark):
    good = ("1.0.0", "c", None, ("s", "a {subject}", "n", None), ([("p", "q")], [], [], [], []), ("d", None, "l", "s", None, None))
    schema = """schema_version string, case_id string, description string, edit struct<subject:string,prompt_template:string,target_new:string,target_original:string>,
      probes struct<exact:array<struct<probe_id:string,prompt:string>>,paraphrase:array<struct<probe_id:string,prompt:string>>,locality:array<struct<probe_id:string,prompt:string>>,portability:array<struct<probe_id:string,prompt:string,expected_relationship:struct<relation:string,target:string>>>,control:array<struct<probe_id:string,prompt:string>>>,
      provenance struct<dataset_name:string,dataset_version:string,dataset_license:string,source:string,record_id:string,citation:string>"""
    bad = ("2", "-", "", ("", "no field", None, None), None, None)
    same = (*good[:3], ("s", "{subject}", "n", "n"), ([], [], [], [], None), good[5])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate((good, bad, same))], "i int, " + schema)
    paths = {}
    for r in R.violations(df, ["i"], R.case_rules()).collect():
        paths.setdefault(r.i, set()).add(r.path)
    assert 0 not in paths and paths[2] == {"$.edit.target_original", "$.probes.exact", "$.probes.control"}
    assert {"$.schema_version", "$.case_id", "$.description", "$.edit.subject", "$.edit.prompt_template", "$.edit.target_new", "$.probes.exact", "$.provenance.source"} <= paths[1]
    assert R.case_probes(df, ["i"]).count() == 1


def test_coverage_recount(spark):
    declared = spark.createDataFrame([("a", (2, 1, 1, 0.5)), ("b", (1, 1, 0, 1.0)), ("c", (0, 0, 0, 0.0))], "k string, coverage struct<total:bigint,evaluated:bigint,missing:bigint,fraction:double>")
    probes = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "k string, evaluated boolean")
    assert rows_of(R.coverage_recount(declared, probes, ["k"]), "k", "field", "counted") == [("b", "evaluated", 0), ("b", "missing", 1)]


def test_comparison_of_many(spark):
    rng = random.Random(1)
    a = [(r, f"m{i}", "u", rng.random(), "complete") for r in range(3) for i in range(4)]
    b = [(r, f"m{i}", "u" if i else "w", rng.random() if i != 2 else None, "incomplete") for r in range(3) for i in range(3)]
    schema = "report int, metric_id string, unit string, aggregate double, status string"
    got = M.reports_with(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["report", "metric_id"], ["unit"], "aggregate", "status").where("report = 1").orderBy("metric_id").collect()
    assert [(r.presence, r.comparable, r.aggregate_delta_b_minus_a is None, len(r.warnings)) for r in got] == [("both", False, True, 1), ("both", True, False, 1), ("both", True, True, 2), ("only-a", False, True, 1)]
