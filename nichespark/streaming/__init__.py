"""Incremental maintenance of additive partial results."""
