"""Merkle manifest of a dataset: leaf digests, a tree of ``FAN`` children per node for each group, proofs and audits.

Coordinates.  The ids of every group become a compressed bitmap: one 64-bit word per run of 64 ids that holds any, merged by
bitwise or before and after the shuffle.  A directory of bit counts over the words, itself a tree of ``RADIX`` entries a node, gives
the number of rows before each word.  The place of a leaf in its group is that number plus the bits set below its own:
a rank query, so the leaves are not sorted and no group is gathered.  Bitmaps cannot hold rows without an id or with a repeated one; only
the rows of such words are numbered in order, by range partitions.

Levels.  A node at place p goes to slot p mod FAN of the slot array keyed by (group, p div FAN); the digest of a full array is the
node above.  Every level is written once and is a FAN-th of the one below.  The roots of the groups form one more tree.

Proofs.  From the root down every node carries what must be hashed left and right of it; a leaf's list of such sides is its proof.
``audit`` folds a leaf, which may have been tampered with, with its proof and compares the outcome with the root.

Defined cases: a missing field is ``-``; a missing group is a group of its own before all others; in a group, rows without an id come
first, and rows that repeat an id follow each other by their digest; rows alike in all fields are leaves of their own; rows without an id are
never tampered with; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store
from tickloom.operators.series import IDX, index_rows

FAN = 8
#: Entries of a directory node: a power of two.
RADIX_BITS = 10
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """Byte count, colon and value, so that no two rows of fields read the same."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame, fields: list[str], group_col: str, id_col: str, text_col: str) -> DataFrame:
    """(id, place_of_row, g, leaf, tampered) of every row; ``tampered`` is null where the row is left as it is."""
    lowered = F.translate(F.col(text_col), CAPITALS, SMALLS)
    whole = digest(F.concat(*[field(F.col(c)) for c in fields]))
    changed = digest(F.concat(*[field(lowered if c == text_col else F.col(c)) for c in fields]))
    named = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    return docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("nr"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"),
        whole.alias("leaf"), F.when(named, changed).alias("tampered"))


def directory(words: DataFrame) -> DataFrame:
    """Adds ``before`` (rows of the group in smaller words) and ``total`` (rows of the group) to words (g, word >= 0, n)."""
    top = words.agg(F.max("word")).first()[0] or 0
    levels = [words.select("g", F.col("word").alias("k0"), "n")]
    for _ in range(max(1, math.ceil(int(top).bit_length() / RADIX_BITS)) - 1):
        below = levels[-1]
        levels.append(below.groupBy("g", F.shiftright("k0", RADIX_BITS).alias("k0")).agg(F.sum("n").alias("n")))
    known = None
    for level in reversed(levels):
        node = level.withColumn("up", F.shiftright("k0", RADIX_BITS))
        here = Window.partitionBy("g", "up")
        node = node.withColumns({"inside": F.sum("n").over(here.orderBy("k0").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "sum": F.sum("n").over(here)})
        if known is None:
            known = node.select("g", "k0", F.col("inside").alias("before"), F.col("sum").alias("total"))
        else:
            above = known.select("g", F.col("k0").alias("up"), F.col("before").alias("base"), "total")
            known = node.join(above, ["g", "up"]).select("g", "k0", F.expr("base + inside").alias("before"), "total")
    return words.join(known.withColumnRenamed("k0", "word"), ["g", "word"])


def placed(rows: DataFrame) -> DataFrame:
    """(id, g, pos, total, digest, tampered): every leaf with its place among the ``total`` leaves of its group."""
    least = rows.agg(F.min(F.shiftright("id", 6))).first()[0] or 0
    # word 0 holds the rows without an id
    keyed = rows.withColumn("word", F.coalesce(F.shiftright("id", 6) - F.lit(least) + 1, F.lit(0)))
    keyed = keyed.withColumn("bit", F.expr("CAST(id & 63 AS INT)"))
    words = store(keyed.groupBy("g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n")), "words")
    loose = F.expr("bits IS NULL OR n > bit_count(bits)").alias("loose")
    known = store(directory(words).select("g", "word", "bits", "before", "total", loose), "directory")

    found = keyed.join(known, ["g", "word"])
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    columns = ["id", "g", "total", F.col("leaf").alias("digest"), "tampered"]
    ranked = found.filter("NOT loose").select(*columns, (F.col("before") + below).alias("pos"))
    if known.filter("loose").isEmpty():
        return ranked
    order = index_rows(found.filter("loose").withColumn("no", F.coalesce("id", F.lit(0))), ("g", "word"), ("no", "leaf", "nr"))
    return ranked.unionByName(order.select(*columns, (F.col("before") + F.col(IDX)).alias("pos")))


def n_levels(most: int) -> int:
    levels = 0
    while most > 1:
        most, levels = -(-most // FAN), levels + 1
    return levels


def reduced(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Slot arrays (g, pos, total, slots, digest) of every level from nodes (g, pos, total, digest, ...).

    ``slots`` holds structs (slot, digest, and the other columns of ``nodes``).  A group that is down to one node passes as it is.
    """
    out = []
    for _ in range(levels):
        others = [c for c in nodes.columns if c not in ("g", "pos", "total", "slots")]
        slot = F.struct(F.pmod("pos", F.lit(FAN)).cast("int").alias("slot"), *others)
        level = nodes.groupBy("g", F.expr(f"pos DIV {FAN}").alias("pos")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(slot)).alias("slots"))
        joined = digest(F.array_join(F.col("slots.digest"), ""))
        level = store(level.withColumn("digest", F.when(F.col("total") == 1, F.col("slots")[0]["digest"]).otherwise(joined)), "level")
        out.append(level)
        nodes = level.select("g", "pos", F.ceil(F.col("total") / FAN).cast("long").alias("total"), "digest")
    return out


def opened(level: DataFrame, above: DataFrame) -> DataFrame:
    """(g, pos, path, subroot, and the columns of the slots) of the children of ``level``, given (g, pos, path, subroot) of its nodes.

    ``path`` lists, from the bottom up, what is hashed left (``l``) and right (``r``) of the node.
    """
    each = level.join(above, ["g", "pos"]).select("g", "pos", "total", "path", "subroot", F.col("slots.digest").alias("all"), F.explode("slots").alias("own"))
    at = F.col("own.slot")
    sides = F.struct(F.array_join(F.slice("all", F.lit(1), at), "").alias("l"), F.array_join(F.slice("all", at + 2, F.lit(FAN)), "").alias("r"))
    path = F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(F.array(sides), F.col("path")))
    return each.select("g", (F.col("pos") * FAN + at).alias("pos"), path.alias("path"), "subroot", "own.*").drop("slot")


def audit(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row: the id, leaf, subroot, root, proof_sha256, folded_root and verified, with the proof ``path`` itself."""
    rows = store(leaves(docs, list(fields), group_col, id_col, text_col), "leaves")
    nodes = store(placed(rows), "placed")
    levels = reduced(nodes, max(1, n_levels(nodes.agg(F.max("total")).first()[0] or 0)))

    last = levels[-1].select("g", F.col("digest").alias("subroot"))
    ordered = index_rows(last.withColumn("all", F.lit(0)), ("all",), ("g",))
    groups = store(ordered.select(F.lit("").alias("g"), F.col(IDX).alias("pos"), F.col("subroot").alias("digest"), F.col("g").alias("of")), "groups")
    n_groups = groups.count()
    tree = reduced(groups.withColumn("total", F.lit(n_groups).cast("long")), max(1, n_levels(n_groups)))
    first = tree[-1].select("digest").first()
    root = F.lit(first[0] if first else None).cast("string")

    none = F.array().cast("array<struct<l:string,r:string>>")
    paths = tree[-1].select("g", "pos", none.alias("path"), F.lit("").alias("subroot"))
    for level in reversed(tree):
        paths = opened(level, paths).select("g", "pos", "path", "subroot", "digest", *(["of"] if level is tree[0] else []))
    paths = store(paths.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot")), "group-paths")
    for level in reversed(levels):
        paths = opened(level, paths)

    sides = F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda acc, p: digest(F.concat(p["l"], acc, p["r"])))
    return paths.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", root.alias("root"), digest(sides).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == root).alias("verified"), "path")
