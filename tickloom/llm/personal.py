"""Personal data: overlapping candidates from patterns, judged by gradient-boosted trees, selected by calibrated thresholds.

DataFrame functions and ``pyspark.ml`` only; no Python worker runs.

Candidates.  The base patterns of every kind, and generators with a higher recall, each mark their leftmost non-overlapping matches; together
they overlap.  The generators also propose what the base patterns lose when they run over neighbouring numbers, such as a telephone number
followed by a card number, and mail addresses written with (at).

Learning.  A base match that passes its rule is a positive example; one that fails it, and a candidate that overlaps a base span without being one,
is a negative one; all others are without a label.  Format features (digits, groups, separators, check digit, parts) and context features (neighbouring
characters, words that announce the kind) are small whole numbers, so all examples of all documents fall into a table of distinct feature rows with
their counts, and the trees learn from that table.  One document in ``HELD`` is kept out of the counts learnt from.

Selection.  For each kind the threshold is the lowest score from which on the examples held out (all examples of the kind, where none is held out)
have a precision of ``PRECISION`` or more.  Candidates without a label at or above it are added; of those that begin at one place the one with the highest score, then
the shortest, is added.  Base spans always stay.

All patterns run in time linear in the text: repeats are possessive or bounded and look behind for the start of a run.

Defined cases: a missing text is empty; a document without candidates has no spans; rows that repeat an id are rows of their own, a missing
id is reported as missing; where all examples have one label, or there is none, nothing is added; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store, whole_text

KINDS = ("email", "ip", "card", "phone")
MARK, INSTEAD = "\ue000", "\ue001"
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: The base patterns, so written that no run of characters is read twice from its middle.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further patterns by kind, each with a text without which it has no match (None: a digit is needed).
GENERATORS = [
    ("email", rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+ ?[\[(]at[\])] ?[{LABEL}]{{1,63}}+(?:(?: ?[\[(]dot[\])] ?|\.)[{LABEL}]{{1,63}}+){{1,4}}+", "at"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?!\.?[0-9])", "."),
    ("card", r"(?<![0-9])[0-9]{12,19}+(?![0-9])", None),
    ("card", r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])", None),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}(?![0-9])){1,4}", "+"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", "+"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", None),
]
BYTE = "(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?))"
CONTEXT, NEXT = 24, 8
#: Words that announce each kind.
ANNOUNCE = {
    "email": "mail|write|contact|escrib|schreib|courriel", "ip": r"\bip\b|address|host|server|adresse|dirección",
    "card": "card|visa|credit|karte|carte|tarjeta|payment", "phone": "phone|call|tel|fax|mobile|ruf|appel|llam",
}

HELD = 5
PRECISION = 0.98
TREES, DEPTH, STEP = 12, 3, 0.3


def pieces(text: Column, pattern: str) -> Column:
    """What lies between matches (even places) and the matches (odd): (n characters, s, head, tail)."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return F.transform(parts, lambda p, i: F.struct(
        F.length(p).cast("long").alias("n"), F.when(i % 2 == 1, p).alias("s"), F.left(p, F.lit(NEXT)).alias("head"), F.right(p, F.lit(CONTEXT)).alias("tail")))


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, parts) of every row: for each pattern with a match its number and pieces."""
    text = whole_text(text_col)
    plain = F.when(text.contains(MARK), F.translate(text, MARK, INSTEAD)).otherwise(text)
    patterns = [(p, {"email": "@", "ip": ".", "card": None, "phone": "+"}[k]) for k, p in BASE.items()] + [(p, needs) for _, p, needs in GENERATORS]
    each = []
    for number, (pattern, needs) in enumerate(patterns):
        able = plain.contains(needs) if needs else plain.rlike("[0-9]")
        each.append(F.when(able & plain.rlike(pattern), F.struct(F.lit(number).alias("gen"), pieces(plain, pattern).alias("pieces"))))
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.filter(F.array(*each), lambda x: x.isNotNull()).alias("parts"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def passes(kind: Column, s: Column) -> Column:
    """The rule of the kind, for the text of a match."""
    n = F.length(digits(s))
    return (
        F.when(kind == 0, True).when(kind == 1, s.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == 2, F.when(n.between(12, 19), F.call_function("luhn_check", digits(s))).otherwise(False)).otherwise(n.between(9, 15)))


def candidates(rows: DataFrame) -> DataFrame:
    """(row, id, kind, start, stop, s, before, after, base): distinct spans; ``base``: matched by the base pattern, and whether its rule passed."""
    kinds = [*range(len(BASE)), *[KINDS.index(k) for k, _, _ in GENERATORS]]
    flat = rows.select("row", "id", F.explode("parts").alias("p")).select("row", "id", "p.gen", F.posexplode("p.pieces").alias("at", "x")).repartition("row")
    lane = Window.partitionBy("row", "gen").orderBy("at")
    stop = F.sum("x.n").over(lane.rowsBetween(Window.unboundedPreceding, 0))
    spans = flat.select(
        "row", "id", F.element_at(F.array(*map(F.lit, kinds)), F.col("gen") + 1).alias("kind"), (F.col("gen") < len(BASE)).alias("base"), "at",
        (stop - F.col("x.n")).alias("start"), stop.alias("stop"), F.col("x.s").alias("s"), F.lag("x.tail").over(lane).alias("before"), F.lead("x.head").over(lane).alias("after"),
    ).filter("at % 2 = 1")
    once = spans.groupBy("row", "id", "kind", "start", "stop", "s").agg(F.max("base").alias("base"), F.max("before").alias("before"), F.max("after").alias("after"))
    return once.withColumn("good", F.col("base") & passes(F.col("kind"), F.col("s")))


def character(c: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 punctuation that may be part of a number, 5 any other."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3)
        .when(c.rlike("^[-+.()/]"), 4).otherwise(5))


def features(spans: DataFrame) -> DataFrame:
    """Adds the features, all small whole numbers."""
    s, kind = F.col("s"), F.col("kind")
    n = F.length(digits(s))
    groups = F.size(F.split(F.regexp_replace(s, "[0-9]+", "0"), "0")) - 1
    announced = F.coalesce(*[F.when(kind == i, F.lower(F.col("before")).rlike(ANNOUNCE[k])) for i, k in enumerate(KINDS)], F.lit(False))
    return spans.withColumns({
        **{f"f_{k}": (kind == i).cast("int") for i, k in enumerate(KINDS)},
        "f_digits": F.least(n, F.lit(24)), "f_groups": F.least(groups, F.lit(9)), "f_length": F.least(F.ceil(F.length(s) / 4).cast("int"), F.lit(15)),
        "f_check": F.when(n.between(12, 19), F.call_function("luhn_check", digits(s)).cast("int")).otherwise(0),
        "f_bytes": s.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$").cast("int"), "f_plus": s.startswith("+").cast("int"), "f_round": s.contains("(").cast("int"),
        "f_dots": F.least(F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))), F.lit(6)), "f_at": s.contains("@").cast("int"),
        "f_same": F.size(F.array_distinct(F.split(F.left(digits(s), F.lit(24)), ""))),
        "f_ending": F.least(F.length(F.regexp_extract(s, r"([A-Za-z]++)$", 1)), F.lit(8)),
        "f_before": character(F.right("before", F.lit(1))), "f_after": character(F.left("after", F.lit(1))),
        "f_cut": F.col("after").rlike(r"^[ .-]?[0-9]").cast("int"), "f_announced": announced.cast("int"),
    })


def overlapping(spans: DataFrame) -> Column:
    """Whether a base span of any kind shares a character with the span."""
    lane = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.when(F.col("good"), F.col("stop"))).over(lane.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("good"), F.col("start"))).over(lane.rangeBetween(0, Window.unboundedFollowing))
    return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("stop"), F.lit(False))


def judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, row), and the candidates with features, label (null: none) and ``held``."""
    rows = store(found(docs, id_col, text_col), "found")
    spans = candidates(rows)
    labelled = spans.withColumn("label", F.when(F.col("good"), 1).when(F.col("base") | overlapping(spans), 0))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % HELD == 0, F.lit(False))
    return rows.select("id", "row"), store(features(labelled).withColumn("held", held).drop("before", "after"), "candidates")


def learnt(spans: DataFrame):
    """The trees, and the least score to be added for each kind; None without examples of both labels."""
    names = [c for c in spans.columns if c.startswith("f_")]
    cells = store(
        spans.filter("label IS NOT NULL").groupBy("kind", "label", *names)
        .agg(F.count_if(~F.col("held")).cast("double").alias("n"), F.count_if("held").cast("double").alias("n_held")).orderBy("kind", "label", *names), "cells")
    if cells.filter("n > 0").select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=1)
    model = trees.fit(assembler.transform(cells.filter("n > 0")))

    scored = model.transform(assembler.transform(cells)).withColumn("score", vector_to_array("probability")[1])
    any_held = F.sum(F.col("label") * F.col("n_held")).over(Window.partitionBy("kind")) > 0
    steps = scored.withColumn("w", F.when(any_held, F.col("n_held")).otherwise(F.col("n"))).groupBy("kind", "score").agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("label")).alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    exact = steps.withColumns({"all": F.sum("all").over(down), "right": F.sum("right").over(down)}).filter(F.col("right") > 0).filter(F.col("right") >= PRECISION * F.col("all"))
    least = {r["kind"]: r["score"] for r in exact.groupBy("kind").agg(F.min("score").alias("score")).collect()}  # at most one row a kind
    return model, assembler, least


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, the number of base spans of each kind, base_sha256, spans, n_added."""
    rows, spans = judged(docs, id_col, text_col)
    fitted = learnt(spans)
    score = F.lit(None).cast("double")
    if fitted is not None:
        model, assembler, least = fitted
        limits = F.create_map(*[F.lit(x) for k in range(len(KINDS)) for x in (k, float(least.get(k, 2.0)))])
        spans = model.transform(assembler.transform(spans)).withColumn("score", vector_to_array("probability")[1])
        score = F.when(F.col("label").isNull() & (F.col("score") >= limits[F.col("kind")]), F.col("score"))
    best = Window.partitionBy("row", "kind", "start").orderBy(F.desc_nulls_last("take"), "stop")
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    kept = (
        spans.select("row", "kind", "start", "stop", "good", score.alias("take")).withColumn("first", F.row_number().over(best) == 1)
        .filter("good OR (take IS NOT NULL AND first)").withColumn("name", F.concat_ws(":", names, "start", "stop")))
    place = F.struct("start", "kind", "stop", "name")

    def joined(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(which, place)))["name"], ",")

    lists = kept.groupBy("row").agg(
        *[F.count_if(F.col("good") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        joined(F.col("good")).alias("base"), joined(F.lit(True)).alias("spans"), F.count_if(~F.col("good")).alias("n_added"))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.join(lists, "row", "left").select(
        F.col("id").alias(id_col), *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))
