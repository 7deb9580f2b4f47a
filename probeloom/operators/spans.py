"""Places of a subject in text and tokens, and paths of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def substring_starts(text: Column, part: Column) -> Column:
    """0-based starts of every occurrence of ``part``, overlapping ones too; none for an empty part."""
    width = F.length(part)
    last = F.length(text) - width
    places = F.when((width > 0) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(text, i + 1, width) == part)


def token_starts(tokens: Column, part: Column) -> Column:
    """0-based starts where ``part`` is a contiguous run of ``tokens``; none for an empty part."""
    width = F.size(part)
    last = F.size(tokens) - width
    places = F.when((width > 0) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(tokens, i + 1, width) == part)


def unique_start(starts: Column) -> Column:
    """The only start; null when there is none or more than one."""
    return F.when(F.size(starts) == 1, F.get(starts, F.lit(0)))


def overlapping_tokens(offsets: Column, start: Column, end: Column) -> Column:
    """Indexes of the tokens whose characters overlap ``[start, end)``; ``offsets`` holds structs start, end."""
    indexed = F.transform(offsets, lambda o, i: F.struct(i.alias("i"), (o["start"] < end).alias("a"), (o["end"] > start).alias("b"), (o["end"] > o["start"]).alias("c")))
    return F.transform(F.filter(indexed, lambda x: x["a"] & x["b"] & x["c"]), lambda x: x["i"])


def covers(offsets: Column, start: Column, end: Column) -> Column:
    """Whether the tokens cover every character of ``[start, end)`` without a gap."""
    inside = F.filter(offsets, lambda o: (o["end"] > start) & (o["start"] < end))
    reached = F.aggregate(inside, start, lambda at, o: F.when(o["start"] <= at, F.greatest(at, o["end"])).otherwise(at))
    return reached >= end


def contiguous(indexes: Column) -> Column:
    """Whether the indexes follow each other and there is at least one."""
    return (F.size(indexes) > 0) & (F.element_at(indexes, -1) - F.element_at(indexes, 1) == F.size(indexes) - 1)


def target_rows(prompt: Column, whole: Column, logits: Column) -> Column:
    """Rows of logits that predict the target, when the prompt's tokens begin those of the whole text; else null."""
    n = F.size(prompt)
    return F.when(F.slice(whole, 1, n) == prompt, F.slice(logits, n, F.size(whole) - n))


#: Longest path and segment.
MAX_PATH, MAX_SEGMENT = 4096, 256


def path_segments(path: Column) -> Column:
    return F.split(path, r"\.")


def valid_segment(segment: Column) -> Column:
    """A public name or an index without a leading zero."""
    name = segment.rlike(r"\A[A-Za-z][A-Za-z0-9_]*\z")
    index = segment.rlike(r"\A(?:0|[1-9][0-9]*)\z")
    return (name | index) & (F.length(segment) <= MAX_SEGMENT)


def valid_module_path(path: Column) -> Column:
    """Whether a dotted path may name a module; false for null."""
    return F.coalesce((F.length(path).between(1, MAX_PATH)) & F.forall(path_segments(path), valid_segment), F.lit(False))


#: Where a segment is looked up, in this order.
SOURCES = ("module", "mapping", "sequence", "field")


def resolve_paths(paths: DataFrame, edges: DataFrame, *, path: str = "path", root: str = "root") -> DataFrame:
    """Follow every dotted path from ``root`` through the tree ``edges(parent, segment, source, child)``.

    Adds ``node`` (null when the path is invalid or leads nowhere) and ``failed_at``, the index
    of the segment that could not be followed. Of several edges for a segment the source that
    comes first in :data:`SOURCES` counts. One join per level of the deepest path.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in SOURCES)), F.col("source"))
    best = edges.where(rank > 0).groupBy("parent", "segment").agg(F.min_by("child", rank).alias("child"))
    now = paths.withColumn("_ok", valid_module_path(F.col(path))).withColumn("_seg", F.when(F.col("_ok"), path_segments(F.col(path)))).withColumn("node", F.when(F.col("_ok"), F.col(root))).withColumn("failed_at", F.when(~F.col("_ok"), F.lit(-1)))
    depth = paths.agg(F.max(F.size(path_segments(F.col(path))))).first()[0] or 0
    for level in range(min(depth, MAX_PATH)):
        step = best.select(F.col("parent").alias("node"), F.col("segment").alias("_at"), F.col("child").alias("_child"))
        now = now.withColumn("_at", F.get(F.col("_seg"), F.lit(level))).join(step, ["node", "_at"], "left")
        more = F.col("_at").isNotNull() & F.col("node").isNotNull()
        now = now.withColumn("failed_at", F.when(more & F.col("_child").isNull(), F.lit(level)).otherwise(F.col("failed_at")))
        now = now.withColumn("node", F.when(more, F.col("_child")).otherwise(F.col("node"))).drop("_at", "_child")
    return now.drop("_ok", "_seg")
