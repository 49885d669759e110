"""DataFrame operators: pyramids, placement, tile joins, matrices, points, sequences."""
