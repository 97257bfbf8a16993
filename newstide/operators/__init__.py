"""Distributed operators: ordering, timeline, scoring, corpus statistics."""
