"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers, names and units of a text give way to typed placeholders; what remains, in lower case and without punctuation,
is its template.  Windows of ``WINDOW`` template words of the documents are joined by hash with those of the benchmark.
For every document, item and offset between them the values behind the placeholders must be consistent: one value
of the item always stands for one value of the document.  So a question is found word for word as well as with other
numbers and names.  A capitalised word that need not be a name, as at the start of a sentence, is read both ways.

A document counts as contaminated by an item if consistent windows make up at least half of the item's, or if at least
``VERBATIM`` windows in a row of places, or half of all, repeat the item with the very same values.

The benchmark side of the join is broadcast while it has at most ``MOST_BROADCAST`` windows, and shuffled beyond; so are the ids of the
documents with hits, whose words are read once more to judge their slots.

Repeats in the patterns are possessive, which the engine matches in a loop, and character classes list what they hold, which is ten times as
fast as excluding the rest.

Defined cases: a missing text, in either table, has no windows; an item with fewer words than a window is one window of
its own length; a window with fewer than ``LITERALS`` words outside placeholders, so every item of fewer words, is searched for with its own
words and values only; an item without words is not searched for; items with equal
texts count as the one with the smallest id; rows that repeat an id are taken together; a missing id is reported as
missing; an empty table, on either side, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

WINDOW = 10
#: Words of a window that must not be placeholders, for values to differ.
LITERALS = 5
VERBATIM = 4
MOST_BROADCAST = 1_000_000

PLACE = "\ue000"
#: Units that may follow a number.
UNITS = (
    "mm|cm|km|m|in|ft|yd|mi|mg|kg|g|lb|lbs|oz|ml|l|ms|s|min|h|hr|hrs|kb|mb|gb|tb|hz|khz|mhz|ghz|kw|kwh|mph|kmh|"
    "meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|pounds?|ounces?|liters?|litres?|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|degrees?"
)
NUMBER = r"\d++(?:[.,:/]\d++)*+"
UNIT = rf"(?:%|(?i:{UNITS})(?!\p{{L}}))"
CURRENCY = r"[$€£](?= ?\d)"
#: Capitalised words that do not begin a sentence.
NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;:] \p{Lu})\p{Ll}\p{L}*+(?: \p{Lu}\p{Ll}\p{L}*+)*+"
#: All characters but white space and ASCII punctuation.
WITHIN = r"0-9A-Za-z\x7F-\x{10FFFF}"
#: Any other capitalised word, such as one that begins a sentence, up to the next gap or number.
FIRST = rf"(?<![{WITHIN}])[\x7F-\x{{10FFFF}}&&[^\p{{L}}\p{{N}}€£]]*+\p{{Lu}}\p{{Ll}}[A-Za-z\x7F-\x{{10FFFF}}&&[^\p{{N}}€£]]*+"
#: Names, numbers, units and (last) capitalised words that may be names: each is a group, so type and value come from one match.
SLOT = rf"({NAME})|({NUMBER})|({CURRENCY}|(?<=\d ?){UNIT})|({FIRST})"
#: A slot is written as PLACE, its groups with one of ENDS behind each, and END.
ENDS, END = "\ue001\ue002\ue003", "\ue004"
MARKS = PLACE + ENDS + END
WORD = rf"{PLACE}[^{END}]*+{END}|[0-9A-Za-z\x7F-\x{{D7FF}}\x{{E005}}-\x{{10FFFF}}]++"


def words(text: Column) -> Column:
    """Words and slots of a text, in lower case; see ``template`` and ``value``."""
    slot = PLACE + "".join(f"${i}{e}" for i, e in enumerate(ENDS + END, 1))
    holds = reduce(or_, [text.contains(m) for m in MARKS])  # hardly ever, and cheaper to see than to translate
    marked = F.regexp_replace(F.when(holds, F.translate(text, MARKS, " " * len(MARKS))).otherwise(text), SLOT, slot)
    return F.regexp_extract_all(F.lower(marked), F.lit(WORD), F.lit(0))


def value(word: Column) -> Column:
    """The word itself, or what stands behind the placeholder."""
    return F.when(word.startswith(PLACE), F.translate(word, MARKS, "")).otherwise(word)


def template(word: Column, named: bool) -> Column:
    """The word, or for a slot PLACE and one letter for its type; ``named``: words that may be names are."""
    name, number, unit = (F.lit(PLACE + t) for t in "anu")
    return (
        F.when(~word.startswith(PLACE), word)
        .when(word.startswith(PLACE + ENDS), name if named else value(word))
        .when(word.startswith(PLACE + ENDS[:2]), unit).when(word.startswith(PLACE + ENDS[0]), number).otherwise(name)
    )


def coded(words: str, read) -> Column:
    return F.transform(words, lambda w: F.xxhash64(read(w)))


def paired(a: Column, b: Column, skip: int) -> Column:
    """Hash of every entry of ``a`` with the entry of ``b`` that many places on."""
    return F.zip_with(a, F.slice(b, F.lit(skip + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))


def doubled(codes: DataFrame, names: list[str]) -> DataFrame:
    """Adds hashes of runs of 1, 2, 4 and 8 entries as name_1 to name_8, each made of two shorter ones."""
    codes = codes.select("*", *[F.col(c).alias(f"{c}_1") for c in names])
    for n in (2, 4, 8):
        codes = codes.select("*", *[paired(F.col(f"{c}_{n // 2}"), F.col(f"{c}_{n // 2}"), n // 2).alias(f"{c}_{n}") for c in names])
    return codes


def windows(name: str, size: int) -> Column:
    """The hash of every run of ``size`` entries, from the columns that ``doubled`` adds; empty when there are fewer."""
    parts = [n for n in (8, 4, 2, 1) if size & n]
    found, length = F.col(f"{name}_{parts[0]}"), parts[0]
    for n in parts[1:]:
        found, length = paired(found, F.col(f"{name}_{n}"), length), length + n
    return F.slice(found, F.lit(1), F.greatest(F.size(f"{name}_1") - (size - 1), F.lit(0)))


def places(names: list[str], size: int) -> Column:
    """(length, d_pos, and a hash for each name) of every window, from columns name_w<size>."""
    others = [F.col(f"{n}_w{size}") for n in names[1:]]
    return F.transform(f"{names[0]}_w{size}", lambda h, i: F.struct(
        F.lit(size).alias("length"), (i + 1).alias("d_pos"), h.alias(names[0]), *[F.get(o, i).alias(n) for n, o in zip(names[1:], others, strict=True)]))


def forms(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, form, words): every item as it stands, as it reads inside a sentence, where its first word, if
    capitalised, is a name, and in one case, where no word is; the first two also with every
    capitalised word a name.  A word is its template t and its value v."""
    items = benchmark.filter(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("text")).agg(F.min(item_col).alias("item"))
    after = words(F.concat(F.lit("a "), F.col("text")))
    inside = F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0)))  # without the word put in front
    read = [(words(F.col("text")), False), (inside, False), (words(F.lower("text")), False), (words(F.col("text")), True), (inside, True)]
    each = F.array(*[F.struct(F.lit(i).alias("form"), F.transform(r, lambda w: F.struct(template(w, named).alias("t"), value(w).alias("v"))).alias("words")) for i, (r, named) in enumerate(read)])
    # forms that read the same are one
    return items.select("item", F.inline(each)).groupBy("item", "words").agg(F.min("form").alias("form"))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item, form, length, exact, total, templates, h, i_pos) for items (item, form, words); of ``total`` windows so many are ``templates``."""
    length = F.least(F.size("words"), F.lit(WINDOW))
    cut = items.withColumn("length", length).filter("length >= 1")
    each = cut.select("item", "form", "length", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.slice("words", i, F.col("length")))).alias("i_pos", "run"))
    literal = F.size(F.filter("run", lambda w: ~w["t"].startswith(PLACE)))
    each = each.select("item", "form", "length", (F.col("i_pos") + 1).alias("i_pos"), (literal < LITERALS).alias("exact"), coded("run", lambda w: w["t"]).alias("t"), coded("run", lambda w: w["v"]).alias("v"))
    each = doubled(each, ["t", "v"])
    same, as_is = (F.coalesce(*[F.when(F.col("length") == n, F.get(windows(k, n), F.lit(0))) for n in range(1, WINDOW + 1)]) for k in "tv")
    kept = each.select("item", "form", "length", "exact", F.when(F.col("exact"), as_is).otherwise(same).alias("h"), "i_pos")
    totals = kept.groupBy("item", "form").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("exact")).alias("templates"))
    return kept.join(totals, ["item", "form"])


def pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document and item: ids, n_windows found, item_windows, verbatim."""
    items = store(forms(benchmark, item_col, item_text), "items")
    known = store(benchmark_windows(items), "item-windows")
    lengths = {r[0]: r[1] for r in known.groupBy("length").agg(F.max("exact")).collect()}  # at most WINDOW rows
    side = known.drop("total", "templates")
    if known.count() <= MOST_BROADCAST:
        side = F.broadcast(side)

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    codes = texts.select("doc", words(F.col("text")).alias("words")).select(
        "doc", coded("words", lambda w: template(w, False)).alias("plain"), coded("words", lambda w: template(w, True)).alias("named"), coded("words", value).alias("as_is"))
    sizes = sorted(lengths) or [WINDOW]
    read = ["plain", "named", *(["as_is"] if any(lengths.values()) else [])]
    codes = doubled(codes, read).select("doc", *[windows(r, n).alias(f"{r}_w{n}") for r in read for n in sizes])
    found = codes.select("doc", F.inline(F.concat(*[places(read, n) for n in sizes])))
    if len(read) == 2:
        hashes = F.when(F.col("plain") == F.col("named"), F.array("plain")).otherwise(F.array("plain", "named"))
    else:
        hashes = F.array_distinct(F.array(*read))
    found = found.select("doc", "length", "d_pos", F.explode(hashes).alias("h"))
    hits = found.join(side, ["length", "h"]).select("doc", "item", "form", "length", "exact", "d_pos", "i_pos")
    runs = store(
        hits.groupBy("doc", "item", "form", "length", (F.col("d_pos") - F.col("i_pos")).alias("offset")).agg(
            F.sort_array(F.collect_set(F.when(~F.col("exact"), F.col("i_pos")))).alias("at"),  # one entry per window of the item
            F.size(F.collect_set(F.when(F.col("exact"), F.col("i_pos")))).cast("long").alias("n_exact")),
        "aligned",
    )

    slot = F.transform("words", lambda w, i: F.when(w["t"].startswith(PLACE), F.struct((i + 1).alias("n"), w["v"].alias("v"))))
    asked = items.select("item", "form", F.filter(slot, lambda x: x.isNotNull()).alias("slots"))
    able = store(runs.select("doc").distinct(), "able")
    if able.count() <= MOST_BROADCAST:
        able = F.broadcast(able)
    kept = texts.select(F.col("doc").alias("d"), "text").join(able, F.col("d").eqNullSafe(F.col("doc")), "left_semi")
    read = store(kept.select("d", words(F.col("text")).alias("d_words")), "words")  # written, so that words are not made anew for every slot
    both = read.join(runs.join(asked, ["item", "form"]), F.col("d").eqNullSafe(F.col("doc"))).drop("d")
    # placeholders of the item inside a template window that was found, each with the value at its place in the document
    inside = F.filter("slots", lambda x: F.exists("at", lambda p: (x["n"] >= p) & (x["n"] < p + F.col("length"))))
    matched = F.transform(inside, lambda x: F.struct(x["v"].alias("i"), value(F.try_element_at("d_words", (x["n"] + F.col("offset")).cast("int"))).alias("d")))
    judged = both.withColumn("map", F.array_distinct(matched)).select(
        "doc", "item", "form", F.size("at").cast("long").alias("n_templates"), "n_exact",
        ((F.size("map") == F.size(F.array_distinct(F.transform("map", lambda x: x["i"])))) & F.forall("map", lambda x: x["d"].isNotNull())).alias("consistent"),
        F.forall("map", lambda x: x["i"].eqNullSafe(x["d"])).alias("verbatim"),
    )
    totals = known.groupBy("item", "form").agg(F.first("total").alias("item_windows"), F.first("templates").alias("templates"))
    counted = judged.join(totals, ["item", "form"]).withColumns(
        {"n_windows": F.expr("n_templates + n_exact"), "n_same": F.expr("n_exact + IF(verbatim, n_templates, 0)")})
    return (
        counted.filter(f"(consistent AND n_templates > 0 AND 2 * n_templates >= templates) OR (n_same > 0 AND (2 * n_same >= item_windows OR n_same >= {VERBATIM}))")
        .groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col))
        .agg(F.max("n_windows").cast("long").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("verbatim").alias("verbatim"))
    )
