"""Columnar shredding of nested JSON records, and tables rebuilt from the shreds.

Every leaf path becomes a column of values with one repetition and one definition level per
entry. A repetition level names the repeated ancestor at which the entry starts a new element, a
definition level how much of the path is present. The table of a repeated ancestor is rebuilt
from the level sequences alone: an entry opens a new element where its repetition level is at
most the ancestor's and its definition level reaches it, so ordinals and links to the parent are
running counts over the levels.

Records are shredded one Arrow batch at a time; nothing but the batch is held in memory, and no
shuffle is needed, whatever the size or the nesting of a record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probeloom.sources.nested import dumps, loads_quoted


@dataclass(frozen=True)
class Node:
    """A field of the record. ``children`` empty: a leaf. ``repeated``: an array of such fields.

    ``key_as``: an object in the place of the array maps a key to an element; the key is that
    child's value where the element has none. ``lone``: the field that tells a single element
    standing in the place of the array from such a map. ``scalar_as``: the child that a bare
    scalar in the place of an element stands for.
    """

    name: str
    children: tuple["Node", ...] = ()
    repeated: bool = False
    key_as: str | None = None
    lone: str | None = None
    scalar_as: str | None = None


@dataclass
class Column:
    """Values and levels of one leaf; entry i belongs to ``record[i]``."""

    path: tuple[str, ...]
    record: list[int] = field(default_factory=list)
    rep: list[int] = field(default_factory=list)
    defn: list[int] = field(default_factory=list)
    value: list[object] = field(default_factory=list)


def _elements(node: Node, value: object) -> list[object]:
    """The elements of a repeated field, whatever shape the exporter chose."""
    if value is None:
        return []
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and node.key_as and not (node.lone and node.lone in value):
        named = []
        for key, item in value.items():
            if isinstance(item, dict):
                named.append(item if item.get(node.key_as) is not None else {**item, node.key_as: key})
            else:
                named.append(None)
        return named
    return [value]


class Shredder:
    """Shreds records of one schema into level columns."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.columns: list[Column] = []
        self.levels: dict[tuple[str, ...], tuple[int, int]] = {}  # repeated path -> its rep and def level
        self._plan = self._compile(root, (), 0, 0)

    def _compile(self, node: Node, path: tuple[str, ...], rep: int, defn: int):
        path = (*path, node.name) if node.name else path
        if node.name:
            defn += 1
        if node.repeated:
            rep += 1
            self.levels[path] = (rep, defn)
        if not node.children:
            self.columns.append(Column(path))
            return (node, rep, defn, len(self.columns) - 1, ())
        first = len(self.columns)
        below = tuple(self._compile(c, path, rep, defn) for c in node.children)
        return (node, rep, defn, (first, len(self.columns)), below)

    def _absent(self, where, record: int, rep: int, defn: int) -> None:
        for k in range(*where) if isinstance(where, tuple) else (where,):
            c = self.columns[k]
            c.record.append(record)
            c.rep.append(rep)
            c.defn.append(defn)
            c.value.append(None)

    def _write(self, plan, value: object, record: int, rep: int, parent_def: int) -> None:
        node, own_rep, own_def, where, below = plan
        if node.repeated:
            items = _elements(node, value)
            if not items:
                self._absent(where, record, rep, parent_def)
                return
            for i, item in enumerate(items):
                self._one(plan, item, record, rep if i == 0 else own_rep)
            return
        if value is None:
            self._absent(where, record, rep, parent_def)
            return
        self._one(plan, value, record, rep)

    def _one(self, plan, value: object, record: int, rep: int) -> None:
        node, _, own_def, where, below = plan
        if not below:
            c = self.columns[where]
            c.record.append(record)
            c.rep.append(rep)
            c.defn.append(own_def)
            c.value.append(value)
            return
        if not isinstance(value, dict):
            scalar = node.scalar_as if value is not None and not isinstance(value, list) else None
            # an element that is no object keeps its place; it has a value only where a bare scalar stands for a child
            value = {scalar: value} if scalar else {}
        for child in below:
            self._write(child, value.get(child[0].name), record, rep, own_def)

    def add(self, record: int, value: object) -> None:
        """Shred one record; ``record`` is its number within the batch."""
        self._one(self._plan, value, record, 0)


@dataclass
class Assembled:
    """Elements of a repeated ancestor: their record, the ordinals of the ancestors, leaf values."""

    record: np.ndarray
    ordinals: list[np.ndarray]
    values: dict[tuple[str, ...], list[object]]


def assemble(shredded: Shredder, ancestor: tuple[str, ...], leaves: list[tuple[str, ...]]) -> Assembled:
    """Rebuild the table of ``ancestor`` from the level sequences of ``leaves``.

    Leaves may lie at the ancestor or at repeated ancestors above it; all must be unrepeated
    below the element they belong to. One row per element; ordinals count from 0 within the
    next repeated ancestor above.
    """
    above = [p for p in shredded.levels if ancestor[: len(p)] == p]  # from the outermost
    columns = {c.path: c for c in shredded.columns}

    def located(leaf: tuple[str, ...]):
        c = columns[leaf]
        rep, defn = np.asarray(c.rep, dtype=np.int16), np.asarray(c.defn, dtype=np.int16)
        record = np.asarray(c.record, dtype=np.int64)
        ordinals, start = [], np.flatnonzero(np.diff(record, prepend=-1))
        inside = np.ones(len(record), dtype=bool)
        opened = np.zeros(len(record), dtype=bool)
        opened[start] = True
        for path in above:
            if leaf[: len(path)] != path:
                break
            r, d = shredded.levels[path]
            inside = inside & (defn >= d)
            outer = opened  # an entry that opens a new parent element
            opened = (rep <= r) & inside
            count = np.cumsum(opened)
            base = np.maximum.accumulate(np.where(outer, count - opened, 0))
            ordinals.append(count - base - 1)
        return record[opened], [o[opened] for o in ordinals], [c.value[i] for i in np.flatnonzero(opened)], len(ordinals)

    deepest = [leaf for leaf in leaves if leaf[: len(ancestor)] == ancestor]
    record, ordinals, _, _ = located(deepest[0])
    out: dict[tuple[str, ...], list[object]] = {}
    for leaf in leaves:
        r, o, values, depth = located(leaf)
        if depth == len(above):
            out[leaf] = values
            continue
        at = {key: v for key, v in zip(zip(r.tolist(), *(x.tolist() for x in o)), values)}
        out[leaf] = [at.get(key) for key in zip(record.tolist(), *(x.tolist() for x in ordinals[:depth]))]
    return Assembled(record, ordinals, out)


def parse_report(text: str | None, wrapper: str = "report") -> object:
    """The report in a payload, or None when the payload is not complete JSON.

    A byte order mark is skipped, a text that itself holds JSON is read again, however often, and
    an object of the single wrapping field is opened. A report may be nested to any depth.
    """
    value = loads_quoted(text)
    if isinstance(value, dict) and isinstance(value.get(wrapper), dict):
        value = value[wrapper]
    return value if isinstance(value, dict) else None


#: The fields of a completed report.
REPORT = Node("", (
    Node("report_id"), Node("generated_at"),
    Node("manifest", (Node("run_id"), Node("editor", (Node("adapter"), Node("hyperparameters"))), Node("seeds"), Node("failure"))),
    Node("audit_case", (Node("case_id"),)),
    Node("metrics", (
        Node("metric_id"), Node("status"), Node("direction"), Node("unit"), Node("aggregate"), Node("reduction"), Node("warnings"),
        Node("threshold", (Node("operator"), Node("value"), Node("passed"))),
        Node("coverage", (Node("fraction"), Node("total"), Node("evaluated"), Node("missing"))),
        Node("probes", (
            Node("probe_id"), Node("status"), Node("values", (
                Node("baseline_mean_log_probability"), Node("edited_mean_log_probability"), Node("signed_delta"), Node("absolute_delta"), Node("contribution"), Node("mean_kl_divergence"),
            )), Node("missing_reason"),
        ), repeated=True, key_as="probe_id", lone="probe_id"),
        Node("citations", (Node("title"), Node("source"), Node("identifier")), repeated=True, lone="title", scalar_as="title"),
    ), repeated=True, key_as="metric_id", lone="metric_id"),
))

_M = ("metrics",)
_P, _C = (*_M, "probes"), (*_M, "citations")

TABLES: dict[str, tuple[tuple[str, ...], dict[str, tuple[tuple[str, ...], str]]]] = {
    "metric": (_M, {
        "report_id": (("report_id",), "string"), "generated_at": (("generated_at",), "string"), "run_id": (("manifest", "run_id"), "string"), "adapter": (("manifest", "editor", "adapter"), "string"),
        "hyperparameters": (("manifest", "editor", "hyperparameters"), "string"), "seeds": (("manifest", "seeds"), "string"), "failure": (("manifest", "failure"), "string"),
        "case_id": (("audit_case", "case_id"), "string"), "metric_id": ((*_M, "metric_id"), "string"), "direction": ((*_M, "direction"), "string"), "unit": ((*_M, "unit"), "string"),
        "reduction": ((*_M, "reduction"), "string"), "warnings": ((*_M, "warnings"), "string"), "threshold_operator": ((*_M, "threshold", "operator"), "string"),
        "threshold_value": ((*_M, "threshold", "value"), "double"), "threshold_passed": ((*_M, "threshold", "passed"), "string"),
        "status": ((*_M, "status"), "string"), "aggregate": ((*_M, "aggregate"), "double"), "coverage_fraction": ((*_M, "coverage", "fraction"), "double"),
        "coverage_total": ((*_M, "coverage", "total"), "bigint"), "coverage_evaluated": ((*_M, "coverage", "evaluated"), "bigint"), "coverage_missing": ((*_M, "coverage", "missing"), "bigint"),
    }),
    "probe": (_P, {
        "report_id": (("report_id",), "string"), "metric_id": ((*_M, "metric_id"), "string"), "probe_id": ((*_P, "probe_id"), "string"), "status": ((*_P, "status"), "string"),
        **{n: ((*_P, "values", n), "double") for n in ("baseline_mean_log_probability", "edited_mean_log_probability", "signed_delta", "absolute_delta", "contribution", "mean_kl_divergence")}, "missing_reason": ((*_P, "missing_reason"), "string"),
    }),
    "citation": (_C, {
        "report_id": (("report_id",), "string"), "metric_id": ((*_M, "metric_id"), "string"), "title": ((*_C, "title"), "string"), "source": ((*_C, "source"), "string"), "identifier": ((*_C, "identifier"), "string"),
    }),
}

_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}


def _as_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return dumps(v)


def _as_double(v: object) -> float | None:
    """A number, also one written as text; anything else is unavailable."""
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v)
    except (TypeError, ValueError, OverflowError):
        return None


def _as_bigint(v: object) -> int | None:
    number = _as_double(v)
    return int(number) if number is not None and number == number and abs(number) < 2**63 else None


_CAST: dict[str, Callable[[object], object]] = {"string": _as_text, "double": _as_double, "bigint": _as_bigint}


def _real(assembled: Assembled, names: list[tuple[str, ...]]) -> np.ndarray:
    """Elements of which at least one leaf of their own is there (a null in an array is no child)."""
    n = len(assembled.record)
    there = np.zeros(n, dtype=bool)
    for name in names:
        there |= np.fromiter((v is not None for v in assembled.values[name]), dtype=bool, count=n)
    return there


def _with_leaves(node: Node, needed: set[tuple[str, ...]], path: tuple[str, ...] = ()) -> Node | None:
    """The part of a schema that leads to the needed leaves."""
    path = (*path, node.name) if node.name else path
    if not node.children:
        return node if path in needed else None
    below = tuple(c for c in (_with_leaves(c, needed, path) for c in node.children) if c is not None)
    return replace(node, children=below) if below else None


def flatten_reports(df: DataFrame, *tables: str, id_column: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Flat tables (``metric``, ``probe``, ``citation``) of the nested reports of ``df``.

    Columns: the id, ``metric_pos`` (and ``child_pos`` for children), the parents' identifiers
    and the leaves of :data:`TABLES`. Of several tables asked for at once, every payload is read
    only once; the rows then carry their table in ``kind`` and null in columns of the others.
    Null payloads, damaged JSON and payloads that hold no object give no rows; null, absent and
    empty groups give no children; an element standing alone is the only one of its group.
    Numbers written as text are read as numbers, values that are no numbers are null. Repeated
    payloads are flattened once each, under their own id. Extra columns of ``df`` are ignored.
    """
    columns: dict[str, str] = {}
    for t in tables:
        columns |= {n: kind for n, (_, kind) in TABLES[t][1].items()}
    positions = ["metric_pos"] if tables == ("metric",) else ["metric_pos", "child_pos"]
    names = [id_column, *(["kind"] if len(tables) > 1 else []), *positions, *columns]
    kinds = {id_column: "bigint", "kind": "string"} | dict.fromkeys(positions, "bigint") | columns

    schema = _with_leaves(REPORT, {path for t in tables for path, _ in TABLES[t][1].values()})

    def rows(ids: pa.Array, shredder: Shredder, t: str) -> pa.RecordBatch:
        ancestor, leaves = TABLES[t]
        made = assemble(shredder, ancestor, [p for p, _ in leaves.values()])
        keep = np.flatnonzero(_real(made, [p for p, _ in leaves.values() if p[: len(ancestor)] == ancestor]))
        have = {id_column: ids.take(pa.array(made.record[keep])), "kind": pa.array([t] * len(keep), type=pa.string())}
        have |= {p: pa.array(o[keep].astype(np.int64)) for p, o in zip(positions, made.ordinals)}
        for n, (path, kind) in leaves.items():
            values, cast = made.values[path], _CAST[kind]
            have[n] = pa.array([cast(values[i]) for i in keep], type=_ARROW[kind])
        return pa.RecordBatch.from_arrays([have[n] if n in have else pa.nulls(len(keep), _ARROW[kinds[n]]) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                shredder = Shredder(schema)
                for i, text in enumerate(part.column(1).to_pylist()):
                    report = parse_report(text)
                    if report is not None:
                        shredder.add(i, report)
                for t in tables:
                    yield rows(part.column(0), shredder, t)

    return df.selectExpr(f"cast({id_column} as bigint) as {id_column}", payload).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


class Number(str):
    """A number as it is written."""


def leaves_of(value: object) -> Iterator[tuple[str, list[int], int, int, str, str | None]]:
    """``(path, ordinals, rep, def, kind, value)`` of every leaf of a JSON value, in its order.

    The path names the fields from the top, ``[]`` the elements of an array; ``ordinals`` holds
    the places in these arrays. ``rep`` says at which of the arrays the leaf starts a new element
    against the leaf before it under the same path (0: none), ``def`` how many fields and
    elements of the path are there. Nulls and empty containers are leaves without a value.
    """
    last: dict[str, list[int]] = {}
    todo: list[tuple[object, tuple, str | int | None]] = [(value, (), None)]  # with the parent's chain and the own step
    while todo:
        item, parent, step = todo.pop()
        chain = (parent, step) if step is not None else ()
        if item and isinstance(item, dict):
            todo += [(v, chain, k) for k, v in reversed(item.items())]
            continue
        if item and isinstance(item, list):
            todo += [(v, chain, n) for n, v in reversed(list(enumerate(item)))]
            continue
        steps: list[str | int] = []
        while chain:
            chain, one = chain
            steps.append(one)
        steps.reverse()
        path = ".".join("[]" if isinstance(x, int) else x for x in steps)
        ordinals = [x for x in steps if isinstance(x, int)]
        before = last.get(path)
        rep = 0 if before is None else next((n for n, (a, b) in enumerate(zip(before, ordinals), 1) if a != b), 0)
        last[path] = ordinals
        if item is None or isinstance(item, dict | list):
            yield path, ordinals, rep, max(0, len(steps) - (item is None)), "null" if item is None else "object" if isinstance(item, dict) else "array", None
        else:
            kind = "boolean" if isinstance(item, bool) else "number" if isinstance(item, Number | int | float) else "string"
            yield path, ordinals, rep, len(steps), kind, ("true" if item else "false") if kind == "boolean" else str(item)


def shred_leaves(df: DataFrame, id_column: str = "raw_id", payload: str = "payload") -> DataFrame:
    """``(id, path, ordinals, rep, def, kind, value)``: every leaf of every payload with its levels.

    No schema is given: the leaf paths are those that the payloads have, to any depth. Values are
    texts as written. Null payloads and such as are not complete JSON have no leaves; a byte order
    mark is skipped and a text that holds JSON is opened. Rows come payload by payload.
    """
    kinds = {id_column: pa.int64(), "path": pa.string(), "ordinals": pa.list_(pa.int64()), "rep": pa.int32(), "def": pa.int32(), "kind": pa.string(), "value": pa.string()}

    def some(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = loads_quoted(text, Number)
                if value is None:
                    continue
                for leaf in leaves_of(value):
                    held.append((i, *leaf))
                    if len(held) >= 1 << 14:
                        yield some(held)
                        held = []
            if held:
                yield some(held)

    return df.selectExpr(f"cast({id_column} as bigint) as {id_column}", payload).mapInArrow(run, f"{id_column} bigint, path string, ordinals array<bigint>, rep int, def int, kind string, value string")
