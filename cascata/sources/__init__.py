"""Readers and writers of alarm, link, cache, model and group files."""
