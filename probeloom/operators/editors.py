"""Artifacts that editors export: gates by profile, and sessions that notice a changed baseline."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from probeloom.contracts.documents import require

# Limits of open settings.
MAX_DEPTH, MAX_VALUES, MAX_STRING, MAX_KEY = 8, 4096, 4096, 256


class EditorError(ValueError):
    """An artifact or a session is not acceptable."""


class BaselineChanged(RuntimeError):
    """The baseline did not score as before after the edited state was scored."""


@dataclass(frozen=True)
class Profile:
    """What an editor's artifact must hold: ``settings`` maps a hyperparameter to what is asked of it."""

    name: str
    repository: str
    architecture: str
    settings: dict[str, Callable[[Any], bool]]


# The editors that are known.
PROFILES = {p.name: p for p in (
    Profile("ROME", "https://github.com/kmeng01/rome", "GPT2LMHeadModel", {"layers": lambda v: True, "fact_token": lambda v: True}),
    Profile("EasyEdit", "https://github.com/zjunlp/EasyEdit", "GPT2LMHeadModel", {
        "algorithm": lambda v: isinstance(v, str) and bool(v.strip()), "sequential_edit": lambda v: isinstance(v, bool), "return_orig_weights": lambda v: v is True,
    }),
)}


def settings_issues(value: object, path: str = "$", depth: int = 0, budget: list[int] | None = None) -> Iterator[str]:
    """What is wrong with open settings: too deep, too many, too long, or no JSON."""
    budget = budget if budget is not None else [MAX_VALUES]
    budget[0] -= 1
    if budget[0] == -1:
        yield f"more than {MAX_VALUES} values"
    if budget[0] < 0:
        return
    if depth > MAX_DEPTH:
        yield f"{path} is nested deeper than {MAX_DEPTH}"
    elif isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str) or not 1 <= len(k) <= MAX_KEY:
                yield f"{path} has a key that is empty or too long"
            else:
                yield from settings_issues(v, f"{path}.{k}", depth + 1, budget)
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            yield from settings_issues(v, f"{path}[{i}]", depth + 1, budget)
    elif isinstance(value, float) and not math.isfinite(value):
        yield f"{path} is not finite"
    elif isinstance(value, str) and len(value) > MAX_STRING:
        yield f"{path} is too long"
    elif value is not None and not isinstance(value, (bool, int, float, str)):
        yield f"{path} is no JSON value"


def is_public_repository(url: object) -> bool:
    """An HTTPS address without credentials, query or fragment."""
    if not isinstance(url, str) or len(url) > 2048:
        return False
    try:
        parts = urlsplit(url)
    except ValueError:
        return False
    return parts.scheme == "https" and bool(parts.netloc) and "@" not in parts.netloc and not parts.query and not parts.fragment


def import_artifact(document: object, profile: str | None = None) -> dict:
    """A valid artifact; with ``profile`` one that its editor's gate lets through."""
    artifact = require("editor", document)
    editor = artifact["editor"]
    if not is_public_repository(editor["source_repository"]):
        raise EditorError("the source repository must be a public HTTPS address")
    wrong = list(settings_issues(editor["hyperparameters"]))
    if wrong:
        raise EditorError("hyperparameters: " + "; ".join(wrong))
    if profile is not None:
        gate = PROFILES[profile]
        for what, have, want in (("name", editor["name"], gate.name), ("source_repository", editor["source_repository"], gate.repository), ("architecture", artifact["model"]["architecture"], gate.architecture)):
            if have != want:
                raise EditorError(f"{what} must equal {want!r}")
        if not artifact["changed_tensors"]:
            raise EditorError("the artifact must report a changed tensor")
        lacking = [n for n, good in gate.settings.items() if n not in editor["hyperparameters"] or not good(editor["hyperparameters"][n])]
        if lacking:
            raise EditorError("hyperparameters are missing or unfit: " + ", ".join(lacking))
    return artifact


def inventory(spark: SparkSession, artifact: dict) -> DataFrame:
    """The changed tensors of an artifact as rows, in their order."""
    rows = [(t["name"], i, [int(n) for n in t["shape"]], t["dtype"], t["device"], t["baseline_sha256"], t["edited_sha256"]) for i, t in enumerate(artifact["changed_tensors"])]
    return spark.createDataFrame(rows, "name string, pos int, shape array<bigint>, dtype string, device string, baseline_sha256 string, edited_sha256 string")


#: What is read of a prompt, in this order; the first and the last are of the baseline.
READS = ("before", "edited", "after")


class EditorSession:
    """Scores prompts on both states and closes once the baseline is found changed."""

    def __init__(self, artifact: dict, baseline: Any, edited: Any) -> None:
        if baseline is edited:
            raise EditorError("the two states must be different objects")
        for side, state in (("baseline", baseline), ("edited", edited)):
            if state.state_id != artifact["model"][side]["state_id"]:
                raise EditorError(f"the {side} state is not the one of the artifact")
        self._baseline, self._edited, self.closed = baseline, edited, False

    def score(self, prompt: str, target: str) -> tuple[Any, Any]:
        """Scores of the baseline and the edited state.

        The two states are read in the order of :data:`READS`, whatever the second read does; the
        row of reads is then judged as :func:`probeloom.operators.metrics.contaminated` judges many.
        A baseline that is not what it was, or cannot be read again, closes the session.
        """
        if self.closed:
            raise EditorError("the session is closed")
        row: dict[str, Any] = {}
        errors: dict[str, Exception] = {}
        for name, state in zip(READS, (self._baseline, self._edited, self._baseline)):
            try:
                row[name] = state.score_target(prompt, target)
            except Exception as error:  # noqa: BLE001
                errors[name] = error
                if not row:
                    raise
        before, edited, after = READS
        self.closed = after in errors or row[after] != row[before]
        if not self.closed and not errors:
            return row[before], row[edited]
        if not self.closed:
            raise errors[edited]
        if len(errors) == 2:
            errors[edited].add_note(f"the baseline could not be checked: {type(errors[after]).__name__}")
            raise errors[edited]
        what = "could not be scored again" if after in errors else "changed while the edited state was scored"
        raise BaselineChanged(f"the baseline {what}") from next(iter(errors.values()), None)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> "EditorSession":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
