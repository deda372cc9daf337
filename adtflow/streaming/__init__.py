"""Streams: frames whose schema is agreed once, and regeneration when schemas change."""
