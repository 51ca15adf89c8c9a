"""Operators for training-corpus pipelines. Nothing outside this package imports it."""
