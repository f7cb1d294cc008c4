"""Whole pipelines: prepare, score, fuse, trace, report."""
