"""Mergeable sketches as tables: the state is rows, merging is a grouped
aggregate (``max``, ``sum``, ``min``, ``distinct``), so it pre-aggregates,
spills and stores like any other table."""
