"""Operators for text corpora and entity resolution; nothing outside this subpackage imports it."""
