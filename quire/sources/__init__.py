"""Readers and writers: tables, document files as bytes, sinks."""
