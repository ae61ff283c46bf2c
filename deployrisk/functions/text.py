"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the services that send these texts understand it (fixed values).
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(value: Column | str) -> Column:
    """The text without white space at either end; ``trim`` alone takes off plain spaces only."""
    return F.btrim(F.col(value) if isinstance(value, str) else value, F.lit(BLANKS))
