"""Scans and sinks: page-layout dialects, event logs, glossaries, tables."""
