"""Ranks by hashed priority, as the core has them."""

from lurus.operators.ranking import CELLS, cell, cell_offsets, cut_by_rank, priority

__all__ = ["CELLS", "cell", "cell_offsets", "cut_by_rank", "priority"]
