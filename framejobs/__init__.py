"""Spark jobs for large media collections: catalogs, encode plans, frame tables, face redaction, progress and telemetry."""
