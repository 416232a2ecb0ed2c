"""Readers of snapshot files and writers of layered tables."""

from ledgerloom.sources.bronze import bronze_records, write_bronze
from ledgerloom.sources.snapshots import FAMILIES, read_any_snapshots, read_dimension, read_family, read_snapshots
from ledgerloom.sources.tables import publish_analytics, register, write_layer

__all__ = ["FAMILIES", "bronze_records", "publish_analytics", "read_any_snapshots", "read_dimension", "read_family", "read_snapshots", "register", "write_bronze", "write_layer"]
