"""Tag algebra as Spark columns."""

from .lattice import BOOL_OR, MIN_INT, MIN_LONG, BoolOr, LabelIntersection, LabelUnion, Lattice, MinLevel

__all__ = ["BOOL_OR", "MIN_INT", "MIN_LONG", "BoolOr", "LabelIntersection", "LabelUnion", "Lattice", "MinLevel"]
