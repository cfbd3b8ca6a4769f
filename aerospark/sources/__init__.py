"""Readers, writers and event sinks."""
