"""Endpoints and the calls that reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Shapes of calls that are sent at a time.
MAX_SHAPES = 50_000


def match_routes(routes: DataFrame, calls: DataFrame, max_shapes: int = MAX_SHAPES) -> DataFrame:
    """JN04: route shapes by call shapes with a confidence above 0.

    ``routes`` has route, pm, handler and rx, ``calls`` has call and cm, both
    distinct shapes.  A pattern cannot be joined by equality, so the calls are
    sent to all tasks, in blocks of about ``max_shapes`` rows; there are as
    many as their number asks for.
    """
    blocks = -(-calls.count() // max_shapes)
    out = None
    for b in range(max(1, blocks)):
        side = calls if blocks <= 1 else calls.filter(F.pmod(F.xxhash64("call", "cm"), F.lit(blocks)) == b)
        one = routes.join(F.broadcast(side), S.methods_match("pm", "cm")).withColumn("confidence", S.route_confidence("route", "rx", "call", "handler")).filter("confidence > 0")
        out = one if out is None else out.unionByName(one)
    return out
