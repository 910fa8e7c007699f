"""Readers, writers and the offline paper data source."""
