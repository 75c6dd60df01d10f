"""Relational operators over manifests, scores and pairs of views."""
