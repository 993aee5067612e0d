"""Compositions a user calls: ingestion, answering, and the registered queries."""
