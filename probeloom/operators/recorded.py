"""Model states given as data: tokens and logits that were recorded, and sources that score live.

A live source is any callable of a pandas batch with the output columns of :data:`SCORED`; it
runs on the executors through ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.functions import numeric as N
from probeloom.operators import metrics as M
from probeloom.operators import spans as S

REQUEST = "request_id string, prompt string, target string"
SCORED = "request_id string, sum_log_probability double, mean_log_probability double, tokens bigint"
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_live(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores of requests by a source that runs a model; it may load the model once per task."""
    return requests.select("request_id", "prompt", "target").mapInPandas(scorer, SCORED)


@dataclass(frozen=True)
class RecordedModel:
    """``tokens(text, ids)`` and ``logits(prompt, target, rows)``, one row per recorded text or pair."""

    tokens: DataFrame
    logits: DataFrame

    def unknown(self, requests: DataFrame) -> DataFrame:
        """Requests that nothing was recorded for: ``(request_id, what)``."""
        texts = self.tokens.select(F.col("text").alias("target"))
        no_tokens = requests.join(texts, "target", "left_anti").select("request_id", F.lit("target tokens").alias("what"))
        return no_tokens.unionByName(requests.join(self.logits, ["prompt", "target"], "left_anti").select("request_id", F.lit("logits").alias("what")))

    def score(self, requests: DataFrame) -> DataFrame:
        """Log-probability of each target; requests that are unknown have no row.

        A target whose tokens and rows differ in number has null scores.
        """
        ids = self.tokens.select(F.col("text").alias("target"), "ids")
        rows = requests.join(ids, "target").join(self.logits, ["prompt", "target"])
        fits = (F.size("ids") == F.size("rows")) & (F.size("ids") > 0)
        each = F.explode_outer(F.when(fits, F.arrays_zip("ids", "rows")))
        steps = rows.select("request_id", each.alias("s")).select("request_id", F.col("s.ids").alias("id"), F.col("s.rows").alias("z"))
        steps = steps.withColumn("lp", N.selected_log_softmax(F.col("z"), F.col("id")))
        scored = steps.groupBy("request_id").agg(F.sum("lp").alias("sum_log_probability"), F.avg("lp").alias("mean_log_probability"), F.count("id").alias("tokens"), F.count("lp").alias("known"))
        whole = (F.col("tokens") > 0) & (F.col("known") == F.col("tokens"))
        return scored.select("request_id", *(F.when(whole, F.col(c)).alias(c) for c in ("sum_log_probability", "mean_log_probability")), "tokens")

    def subject_spans(self, requests: DataFrame) -> DataFrame:
        """``(request_id, start, end)``: tokens of ``subject`` within those of ``prompt``; null unless exactly one place."""
        prompt = self.tokens.select(F.col("text").alias("prompt"), F.col("ids").alias("p"))
        subject = self.tokens.select(F.col("text").alias("subject"), F.col("ids").alias("s"))
        rows = requests.select("request_id", "prompt", "subject").join(prompt, "prompt", "left").join(subject, "subject", "left")
        start = S.unique_start(S.token_starts(F.col("p"), F.col("s")))
        return rows.select("request_id", start.alias("start"), (start + F.size("s")).alias("end"))


def trace(runs: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recoveries of recorded traces and what is wrong with the traces.

    ``runs(trace_id, kind, module, score, corruption_id)`` holds a clean, a corrupted and, for
    every requested module, a restored run; ``modules(trace_id, module, ord)`` what was asked.
    The first result has a row per module in the order asked; traces with an issue (a score that
    is not finite, more than one corruption, missing or unexpected modules) are only in the second,
    ``(trace_id, issue)``.
    """
    score = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
    whole = runs.groupBy("trace_id").agg(score("clean").alias("clean"), score("corrupted").alias("corrupted"))
    restored = runs.where("kind = 'restored'").select("trace_id", "module", F.col("score").alias("restored"))
    issue = lambda df, text: df.select("trace_id", text.alias("issue"))
    infinite = issue(runs.where(~N.finite(F.col("score"))), F.concat(F.col("kind"), F.lit(" score is not finite")))
    lacking = issue(whole.where(F.col("clean").isNull() | F.col("corrupted").isNull()), F.lit("a clean or corrupted run is missing"))
    mixed = issue(M.single_corruption(runs.where("kind != 'clean'"), "trace_id", "corruption_id"), F.lit("more than one corruption"))
    odd = issue(M.module_mismatch(modules, restored, "trace_id", "module"), F.concat(F.lit("modules missing: "), F.col("missing"), F.lit("; unexpected: "), F.col("unexpected")))
    issues = infinite.unionByName(lacking).unionByName(mixed).unionByName(odd).distinct()
    rows = modules.join(restored, ["trace_id", "module"]).join(whole, "trace_id").join(issues.select("trace_id").distinct(), "trace_id", "left_anti")
    return M.causal_recovery(rows, "clean", "corrupted", "restored"), issues
