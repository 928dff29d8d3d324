"""Planners: a snapshot and a time in, proposed changes out. Nothing is mutated."""
