"""Near-duplicates by SetSketch registers.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z in lower case); with fewer words, the whole
sequence.  Documents with equal sets form a class; classes are compared, copies are not expanded.

Sketch.  Register i holds floor(1 - log_b(min x_i)), cut to the range 0 .. q + 1, where x_i is an exponential variate
per shingle.  Registers merge by their maximum, and two sets agree in one with a probability close to their similarity.
Bands of ``ROWS`` registers give buckets of classes that may be similar.

Pairs.  In a bucket of up to ``SMALL`` classes all pairs are compared.  In a larger one every class is compared with
a pivot, the class that shares most with others.  Around a pivot, a class in another component than the pivot's can only be linked with a class that
differs from the pivot in the same places: were no difference shared, the two would differ by the sum of both differences, which is
beyond the threshold.  So those classes look for partners through an index of their differences, of which each puts in the rarest ones only (as many as it
can do without, and one).  Differences of one class alone are never shared, which bounds a pair before it is made: classes with no partner within
the bound, found by running minima, do not enter the index.  A pair is made only where it may still reach the threshold: the first difference that both share
says how many more they can share (those after it in the rarer list), and bits that all differences of a class flip tell how many the two do not share at least.

Verdict.  A pair's similarity is first estimated jointly, by the most likely value given how many registers are larger,
smaller and equal and given both set sizes; pairs five deviations below the threshold stop there.  The others
are decided on their full sets.  A pair at the threshold misses every band with a probability below 1e-7.

Defined cases: a missing text, or one without words, has an empty set and no links; rows that repeat an id or a text are
documents of their own; a missing id never names a component unless all ids of it are missing; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import begin, hashed, in_small_batches, mixed, runs, store, values_of, whole_text
from tickloom.llm.components import components

SHINGLE = 5
REGISTERS, BANDS, ROWS = 256, 24, 4
#: Base, rate and largest value of the registers.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
SMALL = 8
#: Pairs whose similarity is estimated at a time (about 16 MB).
ESTIMATED = 1024
#: Parts into which the members of one bucket are dealt where they meet its size and its pivot.
SALTS = 8
DEVIATIONS = 5
#: Words of 64 bits that the differences of a class flip.
FLIPS = 4
#: Classes (about 80 bytes each) whose texts are picked by a broadcast join; more are picked by a shuffled one.
MOST_BROADCAST = 200_000

_ODD = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = mixed(np.arange(REGISTERS + 1, 2 * REGISTERS + 1, dtype=np.uint64))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = hashed(text.encode().lower().split())
    return np.unique(runs(words, min(size, len(words)))) if len(words) else words


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 1024):
        # the smallest variate belongs to the smallest hash, so only that one is turned into a variate
        np.minimum(least, ((values[at : at + 1024, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype("<u2")


def merged(*sketches: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum.reduce(sketches)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches (rows of ``a`` and ``b``) with known set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 201) * np.minimum(u / v, v / u)[:, None]

    def exceeds(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    p, q = exceeds(u[:, None] - v[:, None] * grid), exceeds(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    likely = more[:, None] * np.log(p + tiny) + less[:, None] * np.log(q + tiny) + same[:, None] * np.log(np.maximum(1 - p - q, tiny))
    return np.take_along_axis(grid, likely.argmax(1)[:, None], 1)[:, 0]


def promising(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes and estimate allow the threshold."""
    t = percent / 100
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    out = np.zeros(len(a), bool)
    if sizes.any():
        out[sizes] = estimated(a[sizes], b[sizes], n_a[sizes], n_b[sizes]) >= t - DEVIATIONS * math.sqrt(t * (1 - t) / REGISTERS)
    return out


def name(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def sketched(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """doc, row, hash of the text, n_shingles, and for sets that are not empty the class name and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near dedup")
        for batch in batches:
            sizes, names, sketches = [], [], []
            for text in values_of(batch.column(2)):
                s = shingles(text)
                sizes.append(len(s))
                names.append(name(s) if len(s) else None)
                sketches.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0), "row": batch.column(1), "hash": batch.column(3), "n_shingles": pa.array(sizes, pa.int64()),
                "cls": pa.array(names, pa.binary()), "sketch": pa.array(sketches, pa.binary())})

    row = F.col(row_col) if row_col else F.lit(0)
    rows = docs.select(F.col(id_col).alias("doc"), row.alias("row"), whole_text(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in rows.schema[:2])
    return rows.mapInArrow(run, f"{kinds}, hash long, n_shingles long, cls binary, sketch binary")


def crowds(classes: DataFrame) -> DataFrame:
    """(key, cid, size, pivot): the buckets of two classes and more, with their most connected class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near dedup")
        for batch in batches:
            bands = sketches_of(batch.column(1))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            found = [[xxhash.xxh64_intdigest(bands[i, k].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)] for i in range(len(bands))]
            yield pa.RecordBatch.from_pydict({"cid": batch.column(0), "keys": pa.array(found, pa.list_(pa.int64()))})

    members = store(classes.select("cid", "sketch").mapInArrow(keys, "cid long, keys array<long>").select("cid", F.explode("keys").alias("key")), "members")
    sizes = store(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    shared = store(salted(members).join(dealt(sizes), ["key", "salt"]), "shared")
    weight = shared.groupBy("cid").agg(F.sum("size").alias("weight"))
    pivots = shared.filter(F.col("size") > SMALL).join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("top"))
    return store(shared.join(dealt(pivots), ["key", "salt"], "left").select("key", "cid", "size", F.col("top.cid").alias("pivot")), "crowds")


def salted(members: DataFrame) -> DataFrame:
    return members.withColumn("salt", F.pmod("cid", F.lit(SALTS)).cast("int"))


def dealt(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near dedup")
        for batch in batches:
            for part in (batch.slice(at, ESTIMATED) for at in range(0, batch.num_rows, ESTIMATED)):
                n_a, n_b = (part.column(i).to_numpy().astype(float) for i in (2, 3))
                keep = promising(sketches_of(part.column(4)), sketches_of(part.column(5)), n_a, n_b, percent)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    a, b = (classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, values) of the wanted classes, from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near dedup")
        for batch in batches:
            sets = [shingles(t) for t in values_of(batch.column(2))]
            # ids may repeat: only a text of the class itself counts
            good = [name(s) == c for s, c in zip(sets, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"cid": batch.column(0), "values": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(pa.array(good, pa.bool_()))

    chosen = store(classes.join(wanted, "cid").select("cid", "cls", "at.doc", "at.hash"), "chosen")
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col(id_col).alias("doc_"), whole_text(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    # rows without an id, or with the same one, are told apart by their texts
    same = (texts["hash"] == chosen["hash"]) & F.col("doc_").eqNullSafe(F.col("doc"))
    return texts.join(chosen, same).select("cid", "cls", "text").mapInArrow(run, "cid long, values binary").dropDuplicates(["cid"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near dedup")
        for batch in batches:
            keep = []
            for x, y in zip(*(values_of(batch.column(i)) for i in (2, 3)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("cid").alias(x), F.col("values").alias(f"values_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "values_a", "values_b").mapInArrow(run, "a long, b long")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, cid, d, h): the ``d`` hashes in which the set of a class differs from that of its pivot; a hash lost is not one gained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near dedup")
        for batch in batches:
            for pivot, cid, own, other in zip(*(values_of(c) for c in batch.columns), strict=True):
                own, other = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                h = np.concatenate([np.setdiff1d(own, other, assume_unique=True), ~np.setdiff1d(other, own, assume_unique=True)]).view(np.int64)
                same = {"pivot": pivot, "cid": cid, "d": len(h)}
                yield pa.RecordBatch.from_pydict({**{k: pa.array(np.full(len(h), v), pa.int64()) for k, v in same.items()}, "h": pa.array(h)})

    own, other = (sets.select(F.col("cid").alias(c), F.col("values").alias(v)) for c, v in (("cid", "own"), ("pivot", "other")))
    return members.join(own, "cid").join(other, "pivot").select("pivot", "cid", "own", "other").mapInArrow(run, "pivot long, cid long, d long, h long")


def within_reach(seats: DataFrame, of: Column, percent: int) -> DataFrame:
    """The seats (pivot, n, u, s, ...) that some seat with ``of`` of the same pivot may be linked with, as far as ``u`` and ``s`` tell.

    Of two sets of differences, the ``u`` that each has alone and the surplus of the shared ones tell the sets apart.
    """
    least = seats.groupBy("pivot", "s").agg(F.min(F.when(of, F.col("u"))).alias("u"))
    up = Window.partitionBy("pivot").orderBy("s")
    down = Window.partitionBy("pivot").orderBy(F.desc("s"))
    nearest = least.select("pivot", "s", F.least(F.min(F.expr("u - s")).over(up) + F.col("s"), F.min(F.expr("u + s")).over(down) - F.col("s")).alias("other"))
    # a partner has at most 100 / percent as many shingles
    return seats.join(nearest, ["pivot", "s"]).filter(f"{percent} * (u + other) <= {100 - percent} * n").drop("other")


def left_over(crowd: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of large buckets in different components whose differences from their pivot do not rule them out."""
    root = F.coalesce("root", "cid").alias("root")
    rooted = classes.select("cid", "n").join(labels, F.col("cid") == F.col("node"), "left").select("cid", "n", root)
    members = crowd.filter("pivot IS NOT NULL AND pivot <> cid").select("pivot", "cid").distinct().join(rooted, "cid")
    around = rooted.select(F.col("cid").alias("pivot"), F.col("root").alias("pivot_root"))
    members = store(members.join(around, "pivot").select("pivot", "cid", "n", "root", (F.col("root") != F.col("pivot_root")).alias("outside")), "around")
    open_ = store(members.filter("outside").select("pivot").distinct(), "open")
    members = members.join(open_, "pivot", "left_semi")

    diff = store(differences(members.select("pivot", "cid"), sets), "differences")
    often = store(diff.groupBy("pivot", "h").agg(F.count(F.lit(1)).alias("often"), F.min("cid").alias("cid"), F.min("d").alias("d")), "often")
    alone = often.filter("often = 1").groupBy("pivot", "cid").agg(F.count(F.lit(1)).alias("u"))
    flips = [f"flip_{k}" for k in range(FLIPS)]
    bit = f"CASE WHEN pmod(h >> 6, {FLIPS}) = {{}} THEN shiftleft(1L, CAST(h & 63 AS INT)) ELSE 0L END"
    size = diff.groupBy("pivot", "cid").agg(F.first("d").alias("d"), *[F.bit_xor(F.expr(bit.format(k))).alias(f) for k, f in enumerate(flips)])
    seats = members.join(size, ["pivot", "cid"]).join(alone, ["pivot", "cid"], "left").withColumn("u", F.coalesce("u", F.lit(0))).withColumn("s", F.expr("d - u"))
    # what a partner must share at least
    seats = store(seats.withColumn("must", F.greatest(F.lit(1), F.expr(f"d - ({100 - percent} * n) DIV {percent}"))).filter("must <= s"), "seats")
    asking = store(within_reach(seats, F.lit(True), percent).filter("outside").withColumn("asks", F.lit(True)).select("pivot", "cid", "asks"), "asking")
    seats = seats.join(asking, ["pivot", "cid"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    seats = store(within_reach(seats, F.col("asks"), percent), "able")
    # one of a pair asks, and two sets that share k differences differ in d_a + d_b - 2 * k places
    apart = F.expr(f"{100 + percent} * d - {100 - percent} * n")
    least = seats.groupBy("pivot").agg(F.min(apart).alias("any"), F.min(F.when(F.col("asks"), apart)).alias("asking"))
    partner = F.when(F.col("asks"), F.col("any")).otherwise(F.col("asking"))
    must = F.greatest("must", F.ceil((apart + partner) / (2 * (100 + percent))))
    seats = seats.join(least, "pivot").withColumn("must", must).filter("must <= s").drop("any", "asking")

    shared = diff.select("pivot", "cid", "h").join(seats, ["pivot", "cid"]).join(often.filter("often > 1").select("pivot", "h", "often"), ["pivot", "h"])
    rarest = Window.partitionBy("pivot", "cid").orderBy("often", "h")
    seat = ["cid", "n", "root", "d", "u", "s", "nr", *flips]
    index = store(shared.withColumn("nr", F.row_number().over(rarest)).filter("nr <= s - must + 1").select("pivot", "h", *seat, "asks"), "index")
    a = index.filter("asks").select("pivot", "h", *[F.col(c).alias(f"{c}_a") for c in seat])
    b = index.select("pivot", "h", *[F.col(c).alias(f"{c}_b") for c in seat])
    # places in which the two sets differ at least; of the differences that both share, one pair is made of the first, with those after it to come
    places = ["u_a + u_b + abs(s_a - s_b)", "d_a + d_b - 2 * (1 + least(s_a - nr_a, s_b - nr_b))", " + ".join(f"bit_count({f}_a ^ {f}_b)" for f in flips)]
    able = " AND ".join(["root_a <> root_b", *[f"{100 + percent} * ({p}) <= {100 - percent} * (n_a + n_b)" for p in places]])
    return a.join(b, ["pivot", "h"]).filter(able).select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


@in_small_batches
def groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id (smallest id reachable), kept, and ``row_col`` if given.

    With ``row_col`` exactly one row of a component is kept, missing ids last and then by row; without, the rows with its id.
    """
    prints = store(sketched(docs, id_col, text_col, row_col), "prints")
    classes = store(
        prints.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc").alias("doc"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc", "hash")).alias("at"),
             *([F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("keep")] if row_col else []))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    crowd = crowds(classes)
    few = crowd.filter(F.col("size") <= SMALL).select("key", "cid")
    pairs = few.select("key", F.col("cid").alias("a")).join(few.select("key", F.col("cid").alias("b")), "key").filter("a < b").select("a", "b")
    stars = crowd.filter("pivot IS NOT NULL AND pivot <> cid").select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b"))
    likely = store(likely_pairs(pairs.union(stars).distinct(), classes, percent), "likely")

    wanted = likely.select(F.col("a").alias("cid")).union(likely.select("b")).union(crowd.filter(F.col("size") > SMALL).select("cid")).distinct()
    sets = store(sets_of(docs, classes, wanted, id_col, text_col), "sets")
    links = store(verified(likely, sets, percent), "links")
    rest = store(left_over(crowd, components(links), classes, sets, percent), "left-over")
    labels = components(links.union(verified(rest, sets, percent)))

    keep = ["keep"] if row_col else []
    rooted = classes.join(labels, F.col("cid") == F.col("node"), "left").select("cls", "doc", F.coalesce("root", "cid").alias("root"), *keep)
    first = store(rooted.groupBy("root").agg(F.min("doc").alias("component"), *[F.min(k).alias(k) for k in keep]), "components")
    named = store(rooted.drop(*keep).join(first, "root").select("cls", "component", *[F.col(f"{k}.row").alias(k) for k in keep]), "named")
    kept = F.col("cls").isNull() | F.col("row").eqNullSafe(F.col("keep")) if row_col else F.col("doc").eqNullSafe(F.coalesce("component", "doc"))
    return prints.drop("sketch").join(named, "cls", "left").select(
        F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"), kept.alias("kept"),
        *([F.col("row").alias(row_col)] if row_col else []))
