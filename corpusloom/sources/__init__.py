"""Readers, paged sources and sinks."""
