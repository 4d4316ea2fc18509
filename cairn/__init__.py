"""Cairn: analytics over deduplicated, compressed filesystem images, on Spark."""
