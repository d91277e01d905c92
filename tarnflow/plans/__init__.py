"""Registered queries: each applies operators to the driver's tables or to a scene made of range()."""
