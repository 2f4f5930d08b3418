"""Errors of provenance tracking."""


class ProvenanceError(Exception):
    """Base of all."""


class Untrackable(ProvenanceError):
    """A plan or expression whose tags can't be told cell by cell; tracking falls back to one tag for the table."""


class LabelError(ProvenanceError):
    """A label names no column or field."""
