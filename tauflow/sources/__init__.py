"""Readers: files, message tables, raw sensor text, audio."""
