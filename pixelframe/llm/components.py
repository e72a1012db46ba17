"""Connected components of links between documents or vectors, by the core's star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.connectivity import star_components


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another: component is the smallest node id it can reach.

    Loops, repeated links and rows with a null end are ignored; no edges give an empty table."""
    return star_components(edges.select(F.col(a).alias("u"), F.col(b).alias("v")), rounds)
