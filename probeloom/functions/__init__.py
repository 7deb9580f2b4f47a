"""Column builders, canonical JSON and identities."""

from probeloom.functions.canonical import canonical_bytes, canonical_column, canonical_text, file_identities, hash_file, hash_json, hash_of, report_id_column, run_id, run_id_column, with_identity
from probeloom.functions.numeric import directed_kl, euclidean, log_softmax, power_iteration, selected_log_softmax
from probeloom.functions.text import escape_markdown, is_identifier, threshold_holds, utc_text, utc_time, valid_missing_reason

__all__ = [
    "canonical_bytes",
    "canonical_column",
    "canonical_text",
    "directed_kl",
    "escape_markdown",
    "euclidean",
    "file_identities",
    "hash_file",
    "hash_json",
    "hash_of",
    "is_identifier",
    "log_softmax",
    "power_iteration",
    "report_id_column",
    "run_id",
    "run_id_column",
    "selected_log_softmax",
    "threshold_holds",
    "utc_text",
    "utc_time",
    "valid_missing_reason",
    "with_identity",
]
