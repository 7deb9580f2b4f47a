"""Contracts of the documents, as shapes and rules."""

from probeloom.contracts.documents import KINDS, ContractViolation, issues_of, require, validate_documents

__all__ = [
    "ContractViolation",
    "KINDS",
    "issues_of",
    "require",
    "validate_documents",
]
