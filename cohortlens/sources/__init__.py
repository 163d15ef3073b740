"""Readers, writers and the adapters over the driver's tables."""
