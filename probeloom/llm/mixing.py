"""Sources combined so that each gives its target share of the tokens.

Every source first gets as many whole copies of its pages as its share asks for (up to its cap).
What is left of the share is a part of one more copy, drawn by Pareto order sampling: pages are
ranked by the odds of a random number over the odds of their inclusion probability, and taken
from the smallest rank until the source's token budget is met. The cut is found from a histogram
of ranks, so only the pages of one bin per source are ever ranked together.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 1 << 14
#: Characters that the tokenizer gets at once; longer texts are cut where the pattern cuts, whatever stands around.
PIECE = 1 << 16


@cache
def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of the whole text; null and empty texts have none."""
    if not text:
        return 0
    encode, total, at = encoder(path).encode_ordinary, 0, 0
    while len(text) - at > PIECE:
        end = _cut(text, at, at + PIECE)
        total += len(encode(text[at:end]))
        at = end
    return total + len(encode(text[at:] if at else text))


def _cut(text: str, at: int, end: int) -> int:
    """A place before white space that follows something else: no part of the pattern reaches over it.

    The last such place up to ``end``, else the first after it; the end of the text if there is none.
    """
    found = end + 1
    while found > at + 1:
        found = max(text.rfind(" ", at + 1, found), text.rfind("\n", at + 1, found))
        if found > at and not text[found - 1].isspace():
            return found
    for found in range(end + 1, len(text)):
        if text[found] in " \n" and not text[found - 1].isspace():
            return found
    return len(text)


def token_sizes(documents: DataFrame, *, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, weight, tokens)``; pages are preferred by their mean confidence, 0.75 where it is unknown.

    ``path`` is the tokenizer's rank file on the driver; it is sent to the executors with the job.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SparkFiles.get(name)
        for b in batches:
            sizes = pa.array([count_tokens(t, own) for t in b.column("text").to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("weight"), sizes], names=["doc_id", "source", "weight", "tokens"])

    conf = F.col("mean_conf").cast("double")
    weight = F.when(conf.isNull() | F.isnan(conf), F.lit(0.75)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.05), conf)))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", weight.alias("weight"), "text").mapInArrow(run, "doc_id bigint, source string, weight double, tokens bigint")


def source_plan(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per target: what its source has, what it must give, whole copies and the part of one more.

    ``sizes`` may hold any sources; only those with a target count. A source without pages, or
    whose pages hold no token, has 0 available and misses any positive target.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("weight")).alias("weighted"))
    plan = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(0)), F.lit(0)).alias("max_repeats")).join(have, "source", "left").fillna(0, ["available", "weighted"])
    plan = materialize(plan)
    total = plan.agg(F.sum("available")).first()[0] or 0  # one number
    wanted = F.col("target_share") * F.lit(float(total))
    plan = plan.withColumn("wanted", wanted)
    copies = F.when(F.col("available") == 0, F.lit(0)).otherwise(F.least("max_repeats", F.floor(F.col("wanted") / F.greatest("available", F.lit(1)))))
    plan = plan.withColumn("copies", copies.cast("bigint"))
    rest = F.when(F.col("copies") < F.col("max_repeats"), F.col("wanted") - F.col("copies") * F.col("available")).otherwise(F.lit(0.0))
    plan = plan.withColumn("rest", F.when(F.col("available") > 0, F.greatest(F.lit(0.0), rest)).otherwise(F.lit(0.0)))
    return plan.withColumn("reaches", F.col("max_repeats") * F.col("available") >= F.col("wanted"))


def mix(sizes: DataFrame, plan: DataFrame, *, salt: str = "mix") -> DataFrame:
    """``(doc_id, source, tokens, repeats)`` of every page used at least once.

    The random number of a page is a hash of its id, so the choice does not depend on the layout.
    Pages without tokens take no part in the drawing. Ties of rank go to the smaller id; repeated
    rows of a page are pages of their own with one rank.
    """
    u = (F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    budget = plan.select("source", "copies", "rest", "weighted")
    pages = sizes.join(budget, "source").withColumn("u", u)
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-300), F.col("rest") / F.greatest("weighted", F.lit(1e-300)) * F.col("weight")))
    pages = pages.withColumn("p", p).withColumn("rank", F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
    pages = pages.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    drawn = (F.col("rest") > 0) & (F.col("tokens") > 0)
    bins = pages.where(drawn).groupBy("source", "bin").agg(F.sum("tokens").alias("in_bin"), F.first("rest").alias("rest"))
    # at most BINS rows per source
    running = bins.withColumn("upto", F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin")))
    cut = running.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("in_bin") < F.col("rest"))).select("source", F.col("bin").alias("cut"), (F.col("rest") - F.col("upto") + F.col("in_bin")).alias("room"))
    marked = pages.join(cut, "source", "left").withColumn("drawn", drawn)
    below = marked.withColumn("more", (F.col("drawn") & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))).cast("bigint"))
    at_cut = F.col("drawn") & F.col("cut").isNotNull() & (F.col("bin") == F.col("cut"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id")
    last = below.where(at_cut).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # the page that crosses the budget is taken when at least half of it fits
    last = last.withColumn("more", (F.coalesce("before", F.lit(0)) + F.col("tokens") / 2 <= F.col("room")).cast("bigint")).drop("before")
    both = below.where(~at_cut).unionByName(last)
    return both.select("doc_id", "source", "tokens", (F.col("copies") + F.col("more")).alias("repeats")).where(F.col("repeats") > 0)


def shares(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per target the share it was to have and the share of the mix it has."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"))
    rows = plan.join(got, "source", "left").fillna(0, ["mixed"])
    rows = materialize(rows.select("source", "target_share", "max_repeats", "available", "wanted", "mixed", "reaches"))
    total = rows.agg(F.sum("mixed")).first()[0] or 0  # one number
    return rows.withColumn("share", F.when(F.lit(total) > 0, F.col("mixed") / F.lit(float(max(total, 1)))).otherwise(F.lit(0.0)))
