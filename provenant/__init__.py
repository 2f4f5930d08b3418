"""Cell-level provenance tracking on Spark DataFrames.

Every DataFrame keeps its ordinary value columns; hidden sidecar columns carry
one tag per cell and are derived from Catalyst's analyzed plan.
"""
