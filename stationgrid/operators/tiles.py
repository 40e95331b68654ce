"""Raster lines cut into spans, each with a halo of its neighbours' cells.

A window along a line looks only ``reach`` cells to either side. So a span with ``reach`` more cells at both ends gives its own
cells the values the whole line gives, and the size of a window partition is set by the span, not by the width of the raster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

#: Cells of a line that one window partition owns.
SPAN = 4096


def with_halo(cells: DataFrame, line: str, position: str, reach: int, span: int = SPAN) -> tuple[DataFrame, WindowSpec]:
    """Cells dealt to the spans that need them (``_span``), and the window along the spans of ``line``.

    Only cells within ``reach`` of a border of spans are dealt more than once; ``own_cells`` takes the copies away again.
    """
    first, last = (F.floor((F.col(position) + d) / F.lit(span)) for d in (-reach, reach))
    dealt = cells.withColumn("_span", F.explode(F.sequence(first, last)))
    return dealt, Window.partitionBy(line, "_span").orderBy(position)


def own_cells(dealt: DataFrame, position: str, span: int = SPAN) -> DataFrame:
    """Every cell once, from the span it lies in."""
    return dealt.filter(F.col("_span") == F.floor(F.col(position) / F.lit(span))).drop("_span")
