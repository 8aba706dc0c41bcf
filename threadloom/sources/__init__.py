"""Readers and writers: tables, request formats, state files."""
