"""Readers of raw payloads and published series."""
