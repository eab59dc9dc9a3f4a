"""Readers of tables, manifests and configuration."""
