"""Label provenance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions.scalars import lookup
from deployrisk.functions.text import strip


def normalise(source: Column) -> Column:
    """Canonical source name; unknown names pass through, empty means manual."""
    name = F.lower(strip(F.coalesce(source, F.lit(""))))
    return F.when(name == "", K.DEFAULT_LABEL_SOURCE).otherwise(
        F.coalesce(lookup(K.LABEL_ALIASES, name), name))


def weight(source: Column) -> Column:
    return F.coalesce(lookup(K.LABEL_WEIGHTS, normalise(source)), F.lit(K.DEFAULT_LABEL_WEIGHT))


def observed(source: Column) -> Column:
    return normalise(source).isin(*K.OBSERVED_SOURCES)
