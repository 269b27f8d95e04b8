"""Readers, payload mappers, sinks and keyed writes."""
