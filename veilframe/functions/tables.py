"""Table functions that SQL calls laterally."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: The name that :func:`register` gives the function in SQL.
CELLS = "veilframe_cells"


def _row(height: float, grid: int) -> int:
    """The first row whose center is at or below a height; ``grid`` where none is."""
    y = min(grid, max(0, math.ceil(height * grid - 0.5)))
    while y and (y - 0.5) / grid >= height:
        y -= 1
    while y < grid and (y + 0.5) / grid < height:
        y += 1
    return y


class Cells:
    """Runs of cells whose center lies in a polygon, as (y, first, last, height): ``LATERAL veilframe_cells(polygon, grid)``.

    ``height`` rows from y on have the run from first to last. Where a polygon's sides are upright, its rows are one run, so a box sends a
    single row; elsewhere a polygon sends as many as it is high. ``explode(sequence(...))`` of both makes cells.

    A polygon is an array of points, each an array of two numbers of the unit square. A null polygon, or one of fewer than two points, has
    no cells; a grid that is no positive constant is refused when the query is analyzed.
    """

    @staticmethod
    def analyze(polygon: AnalyzeArgument, grid: AnalyzeArgument) -> AnalyzeResult:
        kind = polygon.dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType) and isinstance(kind.elementType.elementType, T.NumericType)):
            raise ValueError("a polygon is an array of points, each an array of two numbers")
        if not (grid.isConstantExpression and isinstance(grid.value, int) and grid.value > 0):
            raise ValueError("the grid is a positive whole constant")
        return AnalyzeResult(T.StructType([T.StructField(c, T.IntegerType()) for c in ("y", "first", "last", "height")]))

    def eval(self, polygon: list[list[float]] | None, grid: int) -> Iterator[tuple[int, int, int, int]]:
        if polygon is None or len(polygon) < 2:
            return
        rows = {y: _row(y, grid) for y in {p[1] for p in polygon}}
        sides, bands, (x, y) = [], set(), polygon[-1]
        for x2, y2 in polygon:
            top, behind = rows[y], rows[y2]
            if top != behind:
                sides.append((top, behind, x, y, x2, y2) if top < behind else (behind, top, x, y, x2, y2))
                bands |= {top, behind}
            x, y = x2, y2
        bands = sorted(bands)
        for top, behind in zip(bands, bands[1:]):
            across = [side for side in sides if side[0] <= top < side[1]]
            upright = all([side[2] == side[4] for side in across])
            for now in range(top, behind, behind - top if upright else 1):
                at = (now + 0.5) / grid
                crossed = sorted([(x2 - x) * (at - y) / (y2 - y) + x for _, _, x, y, x2, y2 in across])
                for k in range(0, len(crossed), 2):
                    first, end = max(0, math.ceil(crossed[k] * grid - 0.5)), min(grid, math.ceil(crossed[k + 1] * grid - 0.5))
                    if first < end:
                        yield now, first, end - 1, behind - top if upright else 1


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register(CELLS, F.udtf(Cells))
