"""The points at which a caller plugs in what runs or loads a model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame


@runtime_checkable
class ModelState(Protocol):
    """A state of a model that scores a target after a prompt; equal scores mean an unchanged state."""

    state_id: str

    def score_target(self, prompt: str, target: str) -> Any: ...


@runtime_checkable
class Scorer(Protocol):
    """Scores batches of requests on the executors; columns as in ``operators.recorded``."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


@runtime_checkable
class ArtifactSource(Protocol):
    """Gives the artifact documents of an editor."""

    def artifacts(self) -> Iterator[dict]: ...


@runtime_checkable
class TraceSource(Protocol):
    """Gives recorded runs ``(trace_id, kind, module, score, corruption_id)`` of requested modules."""

    def runs(self, requests: DataFrame) -> DataFrame: ...
