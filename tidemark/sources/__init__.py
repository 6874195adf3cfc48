"""Where versioned rows come from and go to."""

from tidemark.sources.tables import read_envelopes, read_payloads, write_envelopes

__all__ = ["read_envelopes", "read_payloads", "write_envelopes"]
