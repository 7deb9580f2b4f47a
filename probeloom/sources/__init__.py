"""Documents, tables and files in and out."""

from probeloom.sources.documents import JsonDocumentError, parse_strict, read_document, rename, scan_documents
from probeloom.sources.nested import dumps, loads, loads_quoted
from probeloom.sources.tables import table
from probeloom.sources.writers import WriteError, write_atomically

__all__ = [
    "JsonDocumentError",
    "WriteError",
    "dumps",
    "loads",
    "loads_quoted",
    "parse_strict",
    "read_document",
    "rename",
    "scan_documents",
    "table",
    "write_atomically",
]
