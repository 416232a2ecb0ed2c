"""Arriving snapshots as a stream. An extension: batch runs need none of it."""

from ledgerloom.streaming.ingest import stream_snapshots, watermarked_counts

__all__ = ["stream_snapshots", "watermarked_counts"]
