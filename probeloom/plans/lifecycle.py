"""A run with its manifest: running, then completed or failed.

The operation must run its Spark actions itself; a lazy plan that fails later would be recorded
as completed.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from probeloom.contracts.documents import ContractViolation, instant, require
from probeloom.functions.canonical import canonical_bytes
from probeloom.functions.text import IDENTIFIER
from probeloom.sources.writers import WriteError, write_atomically

MANIFEST_NAME = "run-manifest.json"
FAILED = "the run failed; details are kept out of the public record"


class LifecycleError(RuntimeError):
    """The manifest is not valid or could not be written."""


class RunFailed(RuntimeError):
    """The operation failed; a failed manifest was written."""

    def __init__(self, manifest_path: Path, manifest: dict) -> None:
        self.manifest_path, self.manifest = manifest_path, manifest
        super().__init__(f"the run failed; its manifest is {manifest_path}")


@dataclass(frozen=True)
class RunResult:
    value: Any
    manifest_path: Path
    manifest: dict


def read_clock(clock: Callable[[], datetime] | None = None) -> str:
    """UTC now with microseconds, as text."""
    now = clock() if clock else datetime.now(UTC)
    if not isinstance(now, datetime) or now.tzinfo is None:
        raise LifecycleError("the clock must give a time with a zone")
    return now.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def write_manifest(manifest: dict, out: str | Path) -> Path:
    try:
        require("manifest", manifest)
        return write_atomically(Path(out) / MANIFEST_NAME, canonical_bytes(manifest) + b"\n")
    except (ContractViolation, WriteError, TypeError, ValueError) as error:
        raise LifecycleError("the manifest is not valid or could not be written") from error


def _ended(manifest: dict, status: str, ended_at: str, failure: dict | None) -> dict:
    out = copy.deepcopy(manifest)
    out["status"], out["failure"] = status, failure
    out["timestamps"]["ended_at"] = ended_at
    return out


def _failure_time(manifest: dict, clock: Callable[[], datetime] | None) -> str:
    started = manifest["timestamps"]["started_at"]
    try:
        now = read_clock(clock)
    except Exception:  # the failure itself must still be recorded
        return started
    return max(now, started, key=instant)


def execute_run(manifest: dict, out: str | Path, operation: Callable[[], Any], finalize: Callable[[Any, dict], None] | None = None, *, stage: str = "evaluation", clock: Callable[[], datetime] | None = None) -> RunResult:
    """Write the running manifest, run, finalize, write the completed one; on an exception the failed one."""
    if not isinstance(stage, str) or not re.fullmatch(IDENTIFIER, stage):
        raise LifecycleError("the stage must be an identifier")
    if not isinstance(manifest, dict) or manifest.get("status") != "running":
        raise LifecycleError("a run starts with a running manifest")
    write_manifest(manifest, out)
    try:
        value = operation()
        completed = _ended(manifest, "completed", read_clock(clock), None)
        require("manifest", completed)
        if finalize is not None:
            finalize(value, completed)
        return RunResult(value, write_manifest(completed, out), completed)
    except Exception as error:
        name = type(error).__name__
        failure = {"stage": stage, "error_type": name if re.fullmatch(IDENTIFIER, name) else "Exception", "message": FAILED}
        failed = _ended(manifest, "failed", _failure_time(manifest, clock), failure)
        raise RunFailed(write_manifest(failed, out), failed) from error
