"""Small extracts of reference layers around given sites, for fixtures and for looking at a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.operators import overlay


def around(sites: list[DataFrame], layers: dict[str, DataFrame], margin: float = 500.0) -> dict[str, DataFrame]:
    """Each layer cut to what lies within `margin` of any site (geom) of any of the given frames. Layers keep their columns."""
    masks = sites[0].select("geom")
    for more in sites[1:]:
        masks = masks.unionByName(more.select("geom"))
    masks = masks.where(F.col("geom").isNotNull()).dropDuplicates(["geom"]).select(st.buffer("geom", margin).alias("geom"))
    return {name: overlay.clip(layer, masks) for name, layer in layers.items()}
