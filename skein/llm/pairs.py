"""Items that appear together: a blocked Gram matrix over binary baskets.

Per group, the baskets form a sparse binary matrix B of records by items, and
B'B holds n_ab.  It is computed in blocks: items are cut into blocks of about
``item_block`` items, records into blocks of about ``record_block`` records,
and one task multiplies the two sparse item blocks of one record block.  Its nonzero
counts are added over record blocks, and the sums are compared with the
product of the marginals.  A hot group only has more blocks; no task ever
holds a whole group, and no pair of one basket is written as a row.

An item held by fewer than ``min_count`` records cannot be in a pair that
reaches ``min_count``, so such items leave before the product; the marginals
and N are counted before that, over all records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed

#: Cells of the count tile that one product fills at most, and pairs that are unfolded at a time.
_TILE = 4_000_000


#: Items that are sent to all tasks at most: each holds more than one of so many parts of all occurrences.
_HOT = 10_000


def _lists(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items of a side, and its occurrences as (record, item number), sorted by record."""
    items, at = np.unique(part["item"].to_numpy(), return_inverse=True)
    rec = part["rec"].to_numpy()
    order = np.argsort(rec, kind="stable")
    return items, rec[order], at[order]


def _gram(left: pd.DataFrame, right: pd.DataFrame | None, least: int):
    """Nonzero entries of L'R, or of the strict upper half of L'L, from the sparse rows.

    Each occurrence on the left meets those of its record on the right; the
    count tile is cut by items of the left, so that any number of items fits.
    """
    a_items, a_rec, a_at = _lists(left)
    b_items, b_rec, b_at = (a_items, a_rec, a_at) if right is None else _lists(right)
    height = max(1, _TILE // max(1, len(b_items)))
    found = []
    for top in range(0, len(a_items), height):
        use = (a_at >= top) & (a_at < top + height)
        rec, row = a_rec[use], a_at[use] - top
        first = np.searchsorted(b_rec, rec, "left")
        many = np.searchsorted(b_rec, rec, "right") - first
        rows = min(height, len(a_items) - top)
        total = np.zeros(rows * len(b_items), dtype=np.int64)
        ends = np.cumsum(many)
        lo = 0
        while lo < len(rec):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TILE, "right")))
            n = many[lo:hi]
            place = np.repeat(first[lo:hi] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            total += np.bincount(np.repeat(row[lo:hi] * len(b_items), n) + b_at[place], minlength=len(total))
            lo = hi
        at = np.flatnonzero(total >= least)
        i, j = at // len(b_items) + top, at % len(b_items)
        if right is None:
            at, i, j = at[i < j], i[i < j], j[i < j]
        found.append((a_items[i], b_items[j], total[at]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else None


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells arrive whole and in order, as their partition is sorted by cell."""
    held: list[pd.DataFrame] = []

    def emit(cell: pd.DataFrame):
        head = cell.iloc[0]
        got = _gram(cell, None, int(head["least"])) if head["bi"] == head["bj"] else _gram(cell[cell["side"] == 0], cell[cell["side"] == 1], int(head["least"]))
        if got is not None and len(got[0]):
            return pd.DataFrame({"gid": head["gid"], "a": got[0], "b": got[1], "n": got[2]})

    key = ["gid", "rb", "bi", "bj"]
    for pdf in batches:
        if not len(pdf):
            continue
        ids = pdf[key].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts, len(pdf)]
        for lo, hi in zip(bounds, bounds[1:]):
            part = pdf.iloc[lo:hi]
            if held and tuple(held[-1][key].iloc[-1]) != tuple(part[key].iloc[0]):
                if (out := emit(pd.concat(held))) is not None:
                    yield out
                held = []
            held.append(part)
    if held and (out := emit(pd.concat(held))) is not None:
        yield out


def pairs_above_chance(
    baskets: DataFrame, groups: list[str], record: str, items: str, min_count: int = 5, min_lift: int = 3, item_block: int = 1024, record_block: int = 16384, least_hot: int = 1_000_000
) -> DataFrame:
    """(groups, item_a, item_b, n_ab, n_a, n_b, n) with n_ab >= min_count and n_ab * n >= min_lift * n_a * n_b.

    One row of ``baskets`` is one record; ``record`` must be unique in its
    group.  Null or empty item arrays and null elements hold nothing, an item
    counts once a record, records with a null group or record key drop out,
    item_a < item_b by code points.  An empty input gives an empty result.
    Only the named columns are read.  An item of more than ``least_hot``
    occurrences is joined without a shuffle.
    """
    gk = [f"_g{i}" for i in range(len(groups))]
    clean = baskets.select(
        *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, gk)], F.col(f"`{record}`").cast("string").alias("_key"), F.array_distinct(F.array_compact(F.col(f"`{items}`"))).alias("_items")
    ).dropna(subset=[*gk, "_key"]).filter("size(_items) > 0")
    # From here on a record is a 64-bit number; only its equality matters.
    held = checkpointed(clean.select(*gk, F.xxhash64("_key").alias("rec"), "_items"))
    totals = held.groupBy(*gk).agg(F.count("*").alias("n"))
    each = held.select(*gk, "rec", F.explode("_items").alias("_item"))
    counts = each.groupBy(*gk, "_item").agg(F.count("*").alias("n_item")).filter(F.col("n_item") >= min_count)
    sized = totals.join(counts.groupBy(*gk).agg(F.count("*").alias("n_items")), gk)
    sized = sized.select("*", F.ceil(F.col("n_items") / item_block).cast("int").alias("ib"), F.ceil(F.col("n") / record_block).cast("int").alias("rbs"))
    # Ids are fixed in files, so that a task run again sees the same ones.
    named = checkpointed(
        counts.join(sized, gk).select(*gk, "_item", "n_item", "n", "ib", "rbs", F.monotonically_increasing_id().alias("item"), F.xxhash64(*gk).alias("gid"), F.pmod(F.xxhash64("_item"), "ib").cast("int").alias("blk"))
    )
    # An item of many occurrences would meet in one task of a shuffled join.  There are at most _HOT of them, whose names are sent.
    often = max(least_hot, (held.agg(F.sum(F.size("_items"))).first()[0] or 0) // _HOT)
    hot = named.filter(F.col("n_item") > often)
    if hot.isEmpty():
        met = each.join(named, [*gk, "_item"])
    else:
        met = each.join(F.broadcast(hot), [*gk, "_item"]).unionByName(each.join(F.broadcast(hot.select(*gk, "_item")), [*gk, "_item"], "left_anti").join(named, [*gk, "_item"]))
    rows = met.select(
        "gid", "item", "blk", "ib", "rec", F.pmod(F.xxhash64("rec"), "rbs").cast("int").alias("rb"), F.when(F.col("rbs") == 1, min_count).otherwise(1).alias("least")
    )
    # The blocks each occurrence takes part in: (blk, j) on the left and (i, blk) on the right, for the blocks j and i
    # its own record has items in.  So a group of many blocks costs what its baskets hold, not the square of its blocks.
    one = rows.filter("ib = 1").withColumn("other", F.lit(0))
    whole = rows.filter("ib > 1").groupBy("gid", "rb", "rec", "least").agg(F.collect_list(F.struct("item", "blk")).alias("xs"))
    several = whole.withColumn("x", F.explode("xs")).withColumn("other", F.explode(F.array_distinct(F.transform("xs", lambda x: x["blk"]))))
    put = ["gid", "rb", "rec", "least", "item", "blk", "other"]
    tiled = one.select(*put).unionByName(several.select("gid", "rb", "rec", "least", "x.item", "x.blk", "other")).select(
        "gid", "rb", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), (F.col("blk") > F.col("other")).cast("int").alias("side"), "rec", "item", "least"
    )
    cell = ["gid", "rb", "bi", "bj"]
    summed = (
        tiled.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(_cells, "gid long, a long, b long, n long").groupBy("gid", "a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    )
    one = named.select(F.col("item").alias("a"), F.col("_item").alias("_ia"), F.col("n_item").alias("_na"), "n", *gk)
    two = named.select(F.col("item").alias("b"), F.col("_item").alias("_ib"), F.col("n_item").alias("_nb"))
    out = summed.join(one, "a").join(two, "b")
    swap = F.col("_ia") > F.col("_ib")
    out = out.filter(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("_na") * F.col("_nb"))
    return out.select(
        *[F.col(k).alias(g) for g, k in zip(groups, gk)], F.least("_ia", "_ib").alias("item_a"), F.greatest("_ia", "_ib").alias("item_b"), "n_ab",
        F.when(swap, F.col("_nb")).otherwise(F.col("_na")).alias("n_a"), F.when(swap, F.col("_na")).otherwise(F.col("_nb")).alias("n_b"), "n",
    )
