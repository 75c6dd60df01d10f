"""Readers of manifests, score files, ledgers, listings and archives, and the sinks."""
