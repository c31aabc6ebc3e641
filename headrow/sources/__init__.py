"""Readers and writers: archive tables and captured payloads."""
