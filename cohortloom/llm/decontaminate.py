"""Benchmark decontamination by template canonicalisation: finds benchmark items in documents even with other numbers, names
and units in their slots.

Texts become words, numbers, units and names; the last three are replaced by typed placeholders. Windows of `size` tokens of
the items are hashed and hash-joined with those of the documents. Where windows of an item are found, the slots are compared:
an item's value must always stand for the same value of the document and the other way round, so that a text that merely has
the item's shape with muddled slots is not taken for it. Windows are also compared word by word in lower case, so that
verbatim copies are found whatever their case and however few plain words an item has. A document may hold an item several times
with other slots each time, as worksheets do: slots are compared within each occurrence and over the whole document, and what
finds most counts. An item counts as found if its consistent or verbatim windows are at least `share` of its windows, or the
consistent ones of those with enough plain words, or if a run of `quote` words of it stands in the document, however long the item is.

All of it is built-in functions. Texts are read once for both kinds of windows; where a window has plain words alone, both
kinds have the same hash and mean the same. The items' windows are broadcast only if they are at most `most_broadcast`; beyond, the join
is Spark's choice. Documents are never joined with each other, and rows are only grouped per document and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import fixed

#: What counts as a unit after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles g kg mg lb lbs oz pound pounds gram grams ton tons l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent "
    "degree degrees kmh mph"
)
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
ONE_UNIT = f"(?i:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))})"


def _flat(text: Column) -> Column:
    """Words, a single space before each."""
    return F.regexp_replace(F.concat(F.lit(" "), text), r"[^\p{L}\p{N}]+", " ")


def _marked(flat: Column) -> Column:
    """The same with UNIT before a unit."""
    return F.regexp_replace(flat, rf"(\p{{N}}) (?={ONE_UNIT}(?: |$))", f"$1 {UNIT}")


def hashed_tokens(text: Column) -> Column:
    """One 64-bit hash per token of `tokens`, made by whole-text replacements."""
    return _hashed(_flat(text))


def _hashed(flat: Column) -> Column:
    t = F.regexp_replace(_marked(flat), rf"{UNIT}[^ ]+", UNIT)
    t = F.regexp_replace(t, r" \p{N}+(?= |$)", f" {NUMBER}")
    t = F.regexp_replace(t, r" \p{Lu}\p{Ll}[^ ]*", f" {NAME}")
    return F.transform(F.filter(F.split(F.lower(t), " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def literal_tokens(text: Column) -> Column:
    """The words as they are, in lower case, numbers and names too; as many as `tokens`."""
    return _words(_flat(text))


def _words(flat: Column) -> Column:
    return F.filter(F.split(F.lower(flat), " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Array of structs (token, value): value is the word in lower case, token is it or a placeholder.

    Digits alone are a number, one of UNITS after a digit is a unit. Any other capitalised word is a name, also one that starts a
    sentence: names often stand there, and words that do not change are consistent like names.
    """
    words = F.filter(F.split(_marked(_flat(text)), " "), lambda w: w != "")
    bare = lambda w: F.lower(F.ltrim(w, F.lit(UNIT)))
    token = lambda w: (
        F.when(w.startswith(UNIT), UNIT).when(w.rlike(r"^\p{N}+$"), NUMBER).when(w.rlike(r"^\p{Lu}\p{Ll}"), NAME).otherwise(bare(w))
    )
    return F.transform(words, lambda w: F.struct(token(w).alias("token"), bare(w).alias("value")))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    written,
    size: int = 8,
    share: float = 0.5,
    least_words: int = 4,
    quote: int = 25,
    most_broadcast: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it: id, item, n_windows (all of the item), n_found (of those, consistent or verbatim).

    Items of equal text are one, under their smallest id. Items shorter than `size` are matched as a whole among windows of
    their own length. A run of `quote` words is that many less `size` and one windows that follow each other in the item, all
    verbatim in the document. Windows with fewer than `least_words` words that are not placeholders match only verbatim unless they are
    a whole item. Null and empty texts, and rows with a null id, match nothing; repeated rows count as one document; other
    columns are ignored; empty tables give an empty result. `written` stores the items' windows and
    where documents meet them.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).dropna().groupBy("text").agg(F.min("item").alias("item"))
    toks = items.select("item", fixed(tokens(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    # per item its windows of `size`, or itself
    runs = F.array().cast(_WINDOWS)
    for n in range(1, size + 1):
        runs = F.when((F.size("t") == n) | ((n == size) & (F.size("t") > n)), _slot_windows(F.col("t"), n)).otherwise(runs)
    known = toks.select("item", F.size("t").alias("n"), F.explode_outer(runs).alias("w")).filter("w is not null")
    words = F.size(F.filter("w.slots", lambda t: ~t["token"].isin(NUMBER, UNIT, NAME)))
    known = known.filter((words >= least_words) | (F.col("n") <= size))
    known = written(known.select("w.h", F.size("w.slots").alias("len"), "item", "n", F.col("w.k").alias("at"), "w.slots"), "benchmark-windows")
    lits = items.select("item", fixed(_each_hashed(literal_tokens(F.col("text")))).alias("t")).filter(F.size("t") > 0)
    runs = F.array().cast("array<bigint>")
    for n in range(1, size + 1):
        runs = F.when((F.size("t") == n) | ((n == size) & (F.size("t") > n)), _windows(F.col("t"), n)).otherwise(runs)
    verbatim = lits.select("item", F.least(F.size("t"), F.lit(size)).alias("len"), F.posexplode_outer(runs).alias("at", "h")).filter("h is not null")
    verbatim = written(verbatim, "benchmark-literals")
    counted = known.groupBy("len").count().union(verbatim.groupBy("len").count()).collect()  # one row per window length, `size` at most
    small = sum(r["count"] for r in counted) <= most_broadcast
    lengths = sorted({r["len"] for r in counted})
    if not lengths:
        return docs.select(F.col(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias(item_col), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_found")).limit(0)

    own = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    flat = own.select("doc", fixed(_flat(F.col("text"))).alias("flat"))
    hashes = flat.select("doc", fixed(F.struct(_each_hashed(_words(F.col("flat"))).alias("words"), _hashed(F.col("flat")).alias("tokens"))).alias("p"))
    seen = hashes.select("doc", F.explode_outer(F.concat(*(_windows(F.col(kind), n) for kind in ("p.words", "p.tokens") for n in lengths))).alias("h"))
    # a shape says only that the document is to be looked at; a verbatim window says where in the item it is
    keys = known.select("h").distinct().withColumns({"item": F.lit(None).cast(verbatim.schema["item"].dataType), "at": F.lit(None).cast("int")})
    keys = verbatim.select("h", "item", "at").unionByName(keys)
    met = written(seen.filter("h is not null").join(F.broadcast(keys) if small else keys, "h").select("doc", "item", "at").distinct(), "benchmark-met")
    same = met.filter("at is not null")
    hit = met.filter("at is null").select("doc")

    # only documents that share a window are looked at closely; a list of them that is small spares the others a shuffle
    few = hit.count() <= most_broadcast
    close = own.join(F.broadcast(hit) if few else hit, "doc", "left_semi").dropDuplicates(["doc", "text"]).select("doc", F.xxhash64("text").alias("copy"), fixed(tokens(F.col("text"))).alias("t"))
    runs = [_slot_windows(F.col("t"), n) for n in lengths]
    spots = close.select("doc", "copy", F.explode_outer(F.concat(*runs)).alias("w")).select("doc", "copy", F.col("w.h").alias("h"), F.col("w.k").alias("place"), F.col("w.slots").alias("found"))
    met = spots.join(F.broadcast(known) if small else known, "h").filter(F.size("found") == F.col("len"))
    slots = F.filter(
        F.zip_with("slots", "found", lambda a, b: F.struct(a["token"].alias("type"), a["value"].alias("theirs"), b["value"].alias("ours"))), lambda s: s["type"].isin(NUMBER, UNIT, NAME)
    )
    met = written(met.select("doc", "copy", "item", "n", "at", (F.col("place") - F.col("at")).alias("start"), slots.alias("pairs")), "benchmark-hits")

    # where the item would start lies about its length further on in the next occurrence, and moves little within one; 0: the whole text
    one = ["doc", "copy", "item"]
    in_text = Window.partitionBy(*one).orderBy("start")
    apart = F.col("start") - F.lag("start", 1).over(in_text) > F.col("n") / 2
    turn = F.sum(F.col("_apart").cast("int")).over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    met = met.withColumn("_apart", F.coalesce(apart, F.lit(False))).withColumn("_turn", turn).select(*one, "at", "pairs", F.explode(F.array(F.lit(0).cast("long"), "_turn")).alias("turn"))

    # the value that most windows put into a slot is taken; windows that contradict it do not count
    one = [*one, "turn"]
    pair = met.select(*one, F.explode("pairs").alias("p")).select(*one, "p.*").groupBy(*one, "type", "theirs", "ours").agg(F.count("*").alias("n"))
    votes = F.struct(F.col("n"), F.col("theirs"), F.col("ours"))
    there = pair.groupBy(*one, "type", "theirs").agg(F.max(F.struct("n", "ours"))["ours"].alias("ours"))
    back = pair.groupBy(*one, "type", "ours").agg(F.max(votes)["theirs"].alias("theirs"))
    agreed = there.join(back, [*one, "type", "theirs", "ours"]).groupBy(*one).agg(F.collect_set(F.struct("type", "theirs", "ours")).alias("agreed"))
    checked = met.join(agreed, one, "left")
    consistent = F.forall("pairs", lambda p: F.array_contains(F.col("agreed"), p))
    fit = checked.filter((F.size("pairs") == 0) | F.coalesce(consistent, F.lit(False)))
    # lists of windows of one item: no longer than the item
    fit = fit.groupBy(*one).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    best = fit.groupBy("doc", "item").agg(F.max(F.struct(F.size("ats").alias("n"), F.col("ats"))).alias("best"))
    plain = same.groupBy("doc", "item").agg(F.collect_set("at").alias("same"))
    none = F.array().cast("array<int>")
    found = best.join(plain, ["doc", "item"], "full").select(
        "doc", "item", F.size(F.array_union(F.coalesce("best.ats", none), F.coalesce("same", none))).cast("long").alias("n_found"), F.coalesce("best.n", F.lit(0)).alias("n_shapes")
    )
    # windows that follow each other have the same distance from their rank
    place = F.col("at") - F.row_number().over(Window.partitionBy("doc", "item").orderBy("at"))
    runs = same.select("doc", "item", place.alias("run")).groupBy("doc", "item", "run").agg(F.count("*").alias("n"))
    quoted = runs.filter(F.col("n") > max(0, quote - size)).select("doc", "item", F.lit(True).alias("quoted")).distinct()
    total = verbatim.groupBy("item").agg(F.count("*").alias("n_windows"))
    shapes = known.groupBy("item").agg(F.count("*").alias("of_shapes"))
    whole = F.coalesce(F.col("n_shapes") >= share * F.col("of_shapes"), F.lit(False))
    out = found.join(total, "item").join(shapes, "item", "left").join(quoted, ["doc", "item"], "left")
    out = out.filter((F.col("n_found") >= share * F.col("n_windows")) | whole | F.coalesce("quoted", F.lit(False)))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_found")


_WINDOWS = "array<struct<h: bigint, k: int, slots: array<struct<token: string, value: string>>>>"


def _each_hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(hashes: Column, size: int) -> Column:
    """Hash of each run of `size` hashes, none if there are fewer. Runs are hashed from their halves, and each half serves two runs."""
    if size == 1:
        return hashes
    left = size // 2
    if size == 2 * left:
        return _let(_windows(hashes, left), lambda half: _side_by_side(half, half, left))
    return _let(_windows(hashes, left), lambda a: _let(_windows(hashes, size - left), lambda b: _side_by_side(a, b, left)))


def _side_by_side(a: Column, b: Column, step: int) -> Column:
    n = F.greatest(F.size(b) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, step + 1, n), lambda x, y: F.xxhash64(x, y))


def _slot_windows(toks: Column, size: int) -> Column:
    """The same with where a run starts and the tokens of it."""
    hashes = _windows(F.transform(toks, lambda t: F.xxhash64(t["token"])), size)
    return F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"), F.slice(toks, k + 1, size).alias("slots")))
