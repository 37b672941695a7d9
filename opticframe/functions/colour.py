"""Channel and colour arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smear(red: Column) -> Column:
    """One channel as three."""
    return F.array(red, red, red)


def halved(v: Column) -> Column:
    """From [-1, 1] to [0, 1]."""
    return 0.5 * v + 0.5


def inverted(v: Column) -> Column:
    return 1.0 - v


def mapped(v: Column, colours: list[list[float]]) -> Column:
    """The colour of a value in [0, 1] (clamped) in a strip of colours."""
    at = F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (len(colours) - 1) + 0.5).cast("int")
    return F.element_at(F.lit([list(map(float, c)) for c in colours]), at + 1)


def oriented(data: Column, height: Column, width: Column, turns: int) -> Column:
    """Pixels of a frame turned by so many quarter turns clockwise (of an odd number the frame's sides change places)."""
    place = {0: lambda r, c: (r, c), 1: lambda r, c: (height - 1 - c, r), 2: lambda r, c: (height - 1 - r, width - 1 - c), 3: lambda r, c: (c, width - 1 - r)}[turns % 4]
    side = width if turns % 2 == 0 else height  # the turned frame's width

    def from_(p: Column) -> Column:
        row, column = place(F.floor(p / side).cast("int"), (p % side).cast("int"))
        return F.get(data, (row * width + column).cast("int"))

    return F.when(F.size(data) == height * width, F.transform(F.sequence(F.lit(0), height * width - 1), from_))
