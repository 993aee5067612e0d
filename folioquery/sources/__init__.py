"""File scans: each returns the documents schema of ``folioquery.schema``."""
