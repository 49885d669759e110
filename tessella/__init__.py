"""Tile pyramids, tile queries and importance placement as Spark plans."""
