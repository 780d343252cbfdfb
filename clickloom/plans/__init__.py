"""Whole jobs built from the sources, functions, operators and sinks."""
