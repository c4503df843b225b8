"""Composition: scatter and gather, dependency graphs, typed pipes."""
