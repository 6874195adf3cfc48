"""Operators over tables of versioned records."""

from tidemark.operators.envelope import from_versioned, inspect_envelopes, to_versioned
from tidemark.operators.quality import error_summary, split_ok_failed
from tidemark.operators.redaction import redact
from tidemark.operators.upgrade import upgrade

__all__ = ["error_summary", "from_versioned", "inspect_envelopes", "redact", "split_ok_failed", "to_versioned", "upgrade"]
