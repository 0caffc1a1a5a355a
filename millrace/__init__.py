"""Spark-first engine for collecting, resolving and ranking semi-structured postings."""
