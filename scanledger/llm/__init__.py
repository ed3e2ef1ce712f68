"""Operators for preparing large text corpora: mixing, filtering, deduplication, scanning and scoring of documents."""
