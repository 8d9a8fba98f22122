"""Cells of a hierarchical grid as Columns: bit arithmetic on hexagon ids, and a quadtree of our own.

The layout of a hexagon id (bits 52-55 its resolution, three bits a digit, unused
digits 7) is public; parents are exact.  Finding the cell of a point or a ring of
neighbours needs the icosahedron's tables, so :class:`Quad` is what runs without
them: id ``q<level>_<x>_<y>`` with x and y the floor of the scaled coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _c


def hex_resolution(cell) -> Column:
    return F.conv(F.substring(F.lpad(_c(cell), 16, "0"), 3, 1), 16, 10).cast("int")


def hex_parent(cell, level: int) -> Column:
    """The ancestor at ``level``: its resolution bits, and all finer digits 7."""
    v = F.conv(_c(cell), 16, -10).cast("long")
    fill = (1 << (3 * (15 - level))) - 1
    keep = ~(0xF << 52) & 0xFFFFFFFFFFFFFFFF
    keep = keep - (1 << 64) if keep >= 1 << 63 else keep
    out = v.bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(F.lit(level << 52).cast("long")).bitwiseOR(F.lit(fill).cast("long"))
    return F.when(hex_resolution(cell) >= level, F.lower(F.hex(out)))


class Quad:
    """A quadtree of the plane of longitude and latitude."""

    @staticmethod
    def cell(lat, lon, level: int) -> Column:
        n = 1 << level
        x = F.pmod(F.floor((_c(lon) + 180) / 360 * n), F.lit(n))
        y = F.least(F.floor((_c(lat) + 90) / 180 * n), F.lit(n - 1))
        return F.concat_ws("_", F.lit(f"q{level}"), x.cast("string"), y.cast("string"))

    @staticmethod
    def _part(cell, i: int) -> Column:
        return F.split_part(_c(cell), F.lit("_"), F.lit(i)).cast("long")

    @classmethod
    def level(cls, cell) -> Column:
        return F.substring(F.split_part(_c(cell), F.lit("_"), F.lit(1)), 2, 2).cast("int")

    @classmethod
    def parent(cls, cell, level: int, of_level: int) -> Column:
        s = of_level - level
        if s < 0:
            raise ValueError("a parent is coarser")
        return F.concat_ws("_", F.lit(f"q{level}"), F.shiftright(cls._part(cell, 2), s).cast("string"), F.shiftright(cls._part(cell, 3), s).cast("string"))

    @classmethod
    def disk(cls, cell, level: int, rings: int = 1) -> Column:
        """The cell and its neighbours, around the date line too."""
        n = 1 << level
        out = []
        for dx in range(-rings, rings + 1):
            for dy in range(-rings, rings + 1):
                y = cls._part(cell, 3) + dy
                x = F.pmod(cls._part(cell, 2) + dx, F.lit(n))
                out.append(F.when((y >= 0) & (y < n), F.concat_ws("_", F.lit(f"q{level}"), x.cast("string"), y.cast("string"))))
        return F.array_distinct(F.array_compact(F.array(*out)))
