"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import stars


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of orderable ids: (id, component) with the least id of the component, for every id in a link; see stars()."""
    return stars(links)
