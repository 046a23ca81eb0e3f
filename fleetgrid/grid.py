"""The grid of a map and the names that all tables share."""

from __future__ import annotations

import math
from typing import NamedTuple

#: Key of a frame in every table, and of a cell in every map.
FRAME = ["dataset", "scene_id", "frame_idx"]
CELL = ["row", "col"]

#: Evidence of a hit (that of a pass is its negative), and the bound of a cell's log-odds.
EVIDENCE = math.log(0.7 / 0.3)
LIMIT = 5.0


class Grid(NamedTuple):
    """A square map of ``size`` by ``size`` cells of ``cell`` metres, the ego vehicle in its middle, row 0 at the left (+y)."""

    size: int = 80
    cell: float = 0.5

    @property
    def half(self) -> float:
        return self.size * self.cell / 2

    @property
    def ego(self) -> tuple[int, int]:
        """Row and column of the ego vehicle."""
        return min(int(self.half / self.cell), self.size - 1), min(int(self.half / self.cell), self.size - 1)
