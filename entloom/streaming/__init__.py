"""Incremental resolution as a stream."""
