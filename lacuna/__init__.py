"""Span redaction analytics on Spark: detection, entity resolution, rule packs, redaction, audit and scoring."""
