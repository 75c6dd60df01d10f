"""Scalar functions: hashes and ids, texts, URLs, intervals, nested JSON, page objects."""
