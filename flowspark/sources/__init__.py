"""Readers of flow tables, feature lists, metrics and stored predictions."""
