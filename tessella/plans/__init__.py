"""Tile-serving plans: what a tile request turns into for each kind of tileset."""
