"""Tracked results and operations on them."""

from .frame import Tracked
from .mapreduce import map_reduce, map_reduce_columns
from .scoring import precision_recall, score

__all__ = ["Tracked", "map_reduce", "map_reduce_columns", "precision_recall", "score"]
