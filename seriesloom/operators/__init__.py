"""Operators by topic: columns, merge, series, windows, indices, ordering, encode,
split, balance, neighbors, models, report."""
