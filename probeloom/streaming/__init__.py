"""Documents that arrive over time."""

from probeloom.streaming.ingest import ingest, snapshot_stream

__all__ = [
    "ingest",
    "snapshot_stream",
]
