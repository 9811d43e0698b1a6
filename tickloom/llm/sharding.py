"""Balanced shards by best-fit-decreasing bin packing.

Equal texts form a group that stays in one shard.  Groups sorted by size enter the shard with the least remaining
capacity that still holds them, found in a balanced tree; the capacity is the smallest one (within its step) at which
the asked number of shards is enough, so their sizes are near equal.

At scale, groups are not packed one by one: fewer than ``ITEMS`` groups can be larger than total / ``ITEMS``, and
those are packed as they are; the smaller ones are first put together by a hash of their text into ``ITEMS`` bundles
of about that size.  A group larger than a bin's share cannot stay whole; its rows are dealt out, whatever their ids, in
parts of about total / (shards * 16).  So one packing handles at most 2 * ITEMS + 16 * shards items, however many documents there are.

Defined cases: a missing text is an empty text; rows that repeat an id or a text are rows of their own; missing ids are
numbered first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store, whole_text
from tickloom.operators.series import index_rows

#: Bundles of small groups, and the most groups that can be packed as they are.
ITEMS = 8192


@dataclass
class Node:
    room: int
    bin: int
    left: Node | None = None
    right: Node | None = None
    height: int = 1


def height(n: Node | None) -> int:
    return n.height if n else 0


def balanced(n: Node) -> Node:
    """The subtree with its two sides at most one level apart."""
    n.height = 1 + max(height(n.left), height(n.right))
    if height(n.left) > height(n.right) + 1:
        if height(n.left.left) < height(n.left.right):
            n.left = lifted_right(n.left)
        return lifted_left(n)
    if height(n.right) > height(n.left) + 1:
        if height(n.right.right) < height(n.right.left):
            n.right = lifted_left(n.right)
        return lifted_right(n)
    return n


def lifted_left(n: Node) -> Node:
    top = n.left
    n.left, top.right = top.right, n
    n.height = 1 + max(height(n.left), height(n.right))
    top.height = 1 + max(height(top.left), height(top.right))
    return top


def lifted_right(n: Node) -> Node:
    top = n.right
    n.right, top.left = top.left, n
    n.height = 1 + max(height(n.left), height(n.right))
    top.height = 1 + max(height(top.left), height(top.right))
    return top


def inserted(n: Node | None, room: int, bin_: int) -> Node:
    if n is None:
        return Node(room, bin_)
    if (room, bin_) < (n.room, n.bin):
        n.left = inserted(n.left, room, bin_)
    else:
        n.right = inserted(n.right, room, bin_)
    return balanced(n)


def removed(n: Node, room: int, bin_: int) -> Node | None:
    if (room, bin_) < (n.room, n.bin):
        n.left = removed(n.left, room, bin_)
    elif (room, bin_) > (n.room, n.bin):
        n.right = removed(n.right, room, bin_)
    elif n.left is None or n.right is None:
        return n.left or n.right
    else:
        least = n.right
        while least.left:
            least = least.left
        n.room, n.bin = least.room, least.bin
        n.right = removed(n.right, least.room, least.bin)
    return balanced(n)


def tightest(n: Node | None, size: int) -> Node | None:
    """The bin with the least room that still holds ``size``."""
    best = None
    while n:
        best, n = (n, n.left) if n.room >= size else (best, n.right)
    return best


def pack(sizes: Iterable[tuple[object, int]], capacity: int) -> dict[object, int]:
    """Bin of each item, best fit, largest first (equal sizes by name); a new bin opens where none has room.

    An item larger than ``capacity`` gets a bin of its own.
    """
    root, bins, out = None, 0, {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        found = tightest(root, size)
        if found:
            room, bin_ = found.room, found.bin
            root = removed(root, room, bin_)
        else:
            room, bin_, bins = max(capacity, size), bins, bins + 1
        root = inserted(root, room - size, bin_)
        out[name] = bin_
    return out


def pack_into(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """At most ``shards`` bins of a capacity as small as best fit needs, tried in steps of 1/4096 of a fair share."""
    share = -(-sum(s for _, s in sizes) // shards)
    step = max(1, share >> 12)
    slack = 0
    while True:
        bins = pack(sizes, share + slack * step)
        if max(bins.values(), default=0) < shards:
            return bins
        slack += 1 + slack // 4


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, size, text_crc32, law, shard, slot (gapless from 0 by id), grown_shard."""
    text = whole_text(text_col)
    rows = store(
        docs.select(
            F.col(id_col).alias("doc"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    groups = store(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large, part = max(1, total // ITEMS), max(1, total // (shards * 16))
    # fewer than ITEMS groups are larger than total / ITEMS: this table is bounded
    big = store(groups.filter(F.col("bytes") > large).select("digest", F.when(F.col("bytes") > F.lit(total // shards), F.ceil(F.col("bytes") / part)).otherwise(1).cast("long").alias("parts")), "large")
    split = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(ITEMS)).cast("string")
    itemed = rows.join(F.broadcast(big), "digest", "left").withColumn("item", F.when(F.col("parts").isNull(), bundle).otherwise(F.concat_ws("/", "digest", split)))
    items = itemed.groupBy("item").agg(F.sum("size").alias("bytes"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = pack_into(list(zip(pdf["item"], pdf["bytes"].astype(int), strict=True)), shards)
        return pd.DataFrame({"item": list(bins), "shard": list(bins.values())})

    # bounded by the constants above: at most 2 * ITEMS + 16 * shards rows
    packed = store(items.withColumn("packing", F.lit(0)).groupBy("packing").applyInPandas(fit, "item string, shard int"), "packed")
    placed = itemed.join(F.broadcast(packed), "item").select("doc", "size", "text_crc32", "shard", "row")
    return index_rows(placed, ["shard"], ["doc", "text_crc32", "row"]).select(
        F.col("doc").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("row_idx").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
