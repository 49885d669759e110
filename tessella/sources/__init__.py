"""Readers of text formats and writers and readers of tilesets."""
