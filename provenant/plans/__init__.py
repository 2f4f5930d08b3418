"""Tag propagation through Catalyst's analyzed plans."""

from .labels import from_cells, label, label_table
from .lineage import lineage, lineage_edges, save_lineage
from .walker import track

__all__ = ["from_cells", "label", "label_table", "lineage", "lineage_edges", "save_lineage", "track"]
