"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Texts become templates: numbers, names and units of measure turn into typed slots, other words are lower-cased and
punctuation falls away. Windows of templates are hashed, and the windows of all documents are joined by hash with those
of the benchmark. Over a band of neighbouring diagonals (place in the document minus place in the item), as words may have
been put in or left out, the slots that the windows cover are then checked: a re-parameterised question gives each value of the item one value throughout, and different values
different ones. Copies have every slot unchanged and pass as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import let, read_table, stored

WINDOW = 8
PARAMS = {
    "window": WINDOW,  # template words in a window
    "literals": 5,  # words of a window that must not be slots
    "coverage": 0.5,  # share of an item's windows that must lie in one band of diagonals; those across a break count
    "band": 8,  # diagonals that far apart are taken together
    "windows": 3,  # and their least number; items with fewer windows need all of them
    "consistency": 0.8,  # share of slot values that are mapped one to one
}
#: Windows of the benchmark are broadcast up to this number (some forty bytes each), ids of documents that are read again
#: up to three times as many, and rows with the words of items up to a tenth; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Different hashes of the benchmark's windows up to this number are looked up before windows become rows.
FILTER_HASHES = 20_000
NAME, UNIT = "\x01", "\x02"
#: Letters of scripts that write no spaces between words: each is a word.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&[\p{L}]"
#: Units of measure, and given names that count as names at the start of a sentence as well.
UNITS = ["km", "cm", "mm", "m", "miles", "mile", "inches", "feet", "ft", "kg", "g", "mg", "pounds", "lb", "litres", "liters", "l", "ml", "hours", "hour", "h", "minutes", "min", "seconds", "s", "days", "weeks", "months", "years", "euros", "dollars", "cents", "degrees", "percent", "kmh", "mph", "watts", "volts"]
GIVEN_NAMES = ["Alice", "Anna", "Ben", "Bob", "Carlos", "David", "Emma", "Eva", "Frank", "Hans", "James", "Jane", "John", "Juan", "Julia", "Lisa", "Lucas", "Luis", "Maria", "Mark", "Mary", "Max", "Michael", "Natalia", "Paul", "Peter", "Pierre", "Sam", "Sara", "Sofia", "Tom", "Weng"]


def template_words(text: Column) -> Column:
    """The words of a text, lower-cased, names and units marked by a leading control character."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{UNIT}]", " ")
    units = F.regexp_replace(plain, r"([0-9]) ?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", f"$1 {UNIT}$2")
    # the capital comes first, as it rules out most places at once
    named = r"(?=\p{Lu})(?:(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{L})|\b(?=(?:" + "|".join(GIVEN_NAMES) + r")\b))"
    names = F.regexp_replace(F.when(plain.rlike("[0-9]"), units).otherwise(plain), named, NAME)
    return F.regexp_extract_all(F.lower(names), F.lit(rf"[\x01\x02]?+(?:(?:[a-z]++|[[\p{{L}}\p{{M}}]&&[^{UNSPACED}]]++)++|[0-9]++(?:[.,][0-9]++)*+|[{UNSPACED}]\p{{M}}*+)"), F.lit(0))


def slot_of(word: Column) -> Column:
    """What stands for a word in its template: ``#``, ``@`` or ``%`` for a number, a name or a unit, else the word."""
    first = F.substring(word, 1, 1)
    return F.when((first >= "0") & (first <= "9"), F.lit("#")).when(first == NAME, F.lit("@")).when(first == UNIT, F.lit("%")).otherwise(word)


def window_hashes(words: Column, window: int) -> Column:
    """A hash for each run of ``window`` template words, in order; null where the text is shorter."""
    hashed = F.transform(words, lambda w: F.xxhash64(slot_of(w)))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda k: F.xxhash64(*[h[k + i] if i else h[k] for i in range(window)]))
    return let(hashed, lambda h: F.when(F.size(h) >= window, runs(h)))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item_key, item_words) of the items that have a word; equal items of one id count once."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), template_words(F.col("text").cast("string")).alias("item_words"))
    # items that share an id are kept apart by their words
    return rows.where(F.size("item_words") > 0).distinct().withColumn("item_key", F.xxhash64("item_words"))


def item_windows(words: DataFrame, p: dict) -> DataFrame:
    """(item_id, item_key, n_windows, coverable, at, hash): the items' windows that have enough literal words, how many those
    are, and how many words they cover."""
    w = p["window"]
    literal = lambda k: F.size(F.filter(F.slice(F.col("item_words"), k + 1, w), lambda x: ~slot_of(x).isin("#", "@", "%"))) >= p["literals"]
    numbered = F.transform(window_hashes(F.col("item_words"), w), lambda h, k: F.struct(k.alias("at"), h.alias("hash"), literal(k).alias("good")))
    rows = words.select("item_id", "item_key", F.filter(numbered, lambda x: x["good"]).alias("_w"))
    return rows.select("item_id", "item_key", F.size("_w").alias("n_windows"), F.size(_places(F.col("_w.at"), w)).alias("coverable"), F.explode("_w").alias("_w")).select("item_id", "item_key", "n_windows", "coverable", "_w.at", "_w.hash")


def _slotted(word: Column) -> Column:
    return slot_of(word).isin("#", "@", "%")


def items_alone(words: DataFrame, p: dict) -> DataFrame:
    """The items (of :func:`item_words`) that have no window with enough literal words."""
    w = p["window"]
    literals = lambda x: F.size(F.filter(x, lambda y: ~_slotted(y)))
    starts = F.when(F.size("item_words") >= w, F.sequence(F.lit(1), F.size("item_words") - w + 1)).otherwise(F.array().cast("array<int>"))
    return stored(words.where(~F.exists(starts, lambda k: literals(F.slice(F.col("item_words"), k, w)) >= p["literals"])), "alone")


def whole_items(texts: DataFrame, alone: DataFrame, p: dict, few) -> DataFrame:
    """A row for each place where a text holds an item that has no usable window, the item being one run of its own length.

    Its words must be the same; with enough literal words it may have other values in its slots.
    """
    slotted = _slotted
    literals = lambda x: F.size(F.filter(x, lambda y: ~slotted(y)))
    bare = lambda x: F.transform(x, lambda y: F.translate(y, NAME + UNIT, ""))
    template = lambda x: F.transform(x, slot_of)
    own = F.col("item_words")
    keys = F.array(F.xxhash64(F.lit(0), bare(own)), F.when(literals(own) >= p["literals"], F.xxhash64(F.lit(1), template(own))))
    keyed = alone.select("item_id", "item_key", "item_words", F.size(own).alias("size"), F.explode(keys).alias("hash")).where("hash IS NOT NULL")
    lengths = [r[0] for r in keyed.select("size").distinct().collect()]
    runs = texts.select("doc_id", template_words(F.col("_text")).alias("_words"))
    runs = runs.select("doc_id", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("_size"), "_words").where(F.size("_words") >= F.col("_size"))
    at = F.sequence(F.lit(1), F.size("_words") - F.col("_size") + 1)
    runs = runs.select("doc_id", "_size", F.posexplode(F.transform(at, lambda k: F.slice(F.col("_words"), k, F.col("_size")))).alias("place", "run"))
    runs = runs.select("doc_id", "_size", "place", "run", F.explode(F.array(F.xxhash64(F.lit(0), bare(F.col("run"))), F.xxhash64(F.lit(1), template(F.col("run"))))).alias("_hash"))
    met = runs.join(few(keyed, 0.1), (F.col("_hash") == F.col("hash")) & (F.col("_size") == F.col("size")))
    slots = F.array_distinct(F.filter(F.arrays_zip(bare("item_words").alias("item"), bare("run").alias("doc"), F.col("item_words").alias("kind")), lambda z: slotted(z["kind"])))
    once = lambda side: F.size(F.array_distinct(F.transform("slots", lambda z: z[side])))
    one = F.lit(1).cast("long")
    return met.withColumn("slots", slots).select(
        "doc_id", "item_id", "item_key", F.lit(0).alias("wide"), F.col("place").alias("diagonal"), one.alias("n_matched"), one.alias("n_windows"), F.lit(1.0).alias("coverage"), F.col("place").alias("doc_start"),
        F.size("slots").cast("long").alias("n_slots"),
        F.when(F.size("slots") > 0, (once("item") + once("doc")) / (2 * F.size("slots"))).otherwise(F.lit(1.0)).alias("consistency"),
        F.forall("slots", lambda z: z["item"] == z["doc"]).alias("exact"),
    )


def _places(ats: Column, window: int) -> Column:
    """The places that windows beginning at ``ats`` cover."""
    return F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + (window - 1)))))


def contaminated(docs: DataFrame, benchmark: DataFrame, params: dict | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, doc_start (template word), n_matched and
    n_windows (windows), coverage, n_slots, consistency, exact (all slots unchanged).

    The row is that of the item's best diagonal or band of diagonals. Where words are put in or left out, the windows across
    the break do not match; coverage counts them if the words on both sides are matched. Null texts have no windows; items shorter than a window, or with slots
    nearly throughout, are found as one run of their own length (one window of one); a null doc_id or item_id is kept as a value of its own. Repeated documents with one
    id give one row. Empty tables give none. Other columns are ignored.

    Windows go through the join as a number and a hash each. Only documents with enough windows of an item in one
    band are read a second time, for the words in their slots.
    """
    p = PARAMS | (params or {})
    w = p["window"]

    def few(df: DataFrame, share: float = 1.0) -> DataFrame:
        most = int(broadcast_rows * share)
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df

    items = stored(item_words(benchmark), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    hashes = texts.select("doc_id", template_words(F.col("_text")).alias("_words")).select("doc_id", window_hashes(F.col("_words"), w).alias("_hashes"))
    wanted = stored(item_windows(items, p), "windows")
    known = [r[0] for r in wanted.select("hash").distinct().limit(FILTER_HASHES + 1).collect()]
    if 0 < len(known) <= FILTER_HASHES:  # few enough to be looked up inside the array: only windows of some item become rows
        listed = ", ".join(f"{h}L" if h > -(1 << 63) else "bigint(-9223372036854775808)" for h in known)
        places = F.expr(f"filter(sequence(0, size(_hashes) - 1), k -> _hashes[k] IN ({listed}))")
        hits = F.when(F.size("_hashes") > 0, F.transform(places, lambda k: F.struct(k.alias("place"), F.get("_hashes", k).alias("_hash"))))
        windows = hashes.select("doc_id", F.explode_outer(hits).alias("_m")).where("_m IS NOT NULL").select("doc_id", "_m.place", "_m._hash")
    else:
        # the outer form, as the plain one would have the optimiser test and so compute the array twice
        windows = hashes.select("doc_id", F.posexplode_outer("_hashes").alias("place", "_hash"))
    met = windows.join(few(wanted), F.col("_hash") == F.col("hash"))
    # a match counts for its diagonal and for two overlapping bands, so that neighbours always share one
    diagonal = F.col("place") - F.col("at")
    band = F.floor(diagonal / p["band"]).cast("int")
    groups = F.array(*[F.struct(F.lit(k).alias("wide"), x.alias("line")) for k, x in enumerate((diagonal, band, band + 1)) for k in [min(k, 1)]])
    spread = met.select("doc_id", "item_id", "item_key", "n_windows", "coverable", F.struct("at", diagonal.alias("diagonal")).alias("hit"), F.explode(groups).alias("g"))
    lines = spread.groupBy("doc_id", "item_id", "item_key", "n_windows", "coverable", "g").agg(F.collect_set("hit").alias("hits"))
    lines = lines.where((F.col("g.wide") == 0) | (F.array_min("hits.diagonal") < F.array_max("hits.diagonal")))
    lines = lines.withColumn("n_matched", F.size(F.array_distinct("hits.at"))).withColumn("covered", F.size(_places(F.array_distinct("hits.at"), w)))
    n = F.greatest("n_matched", F.col("covered") - (w - 1))
    share = F.greatest(F.col("n_matched") / F.col("n_windows"), (F.col("covered") - (w - 1)) / (F.col("coverable") - (w - 1)))
    lines = lines.withColumn("coverage", share)
    lines = stored(lines.where((F.col("coverage") >= p["coverage"]) & (n >= F.least(F.lit(p["windows"]), F.col("n_windows")))), "lines")
    named = lines.withColumnRenamed("doc_id", "_id").join(few(items.select(F.col("item_id").alias("_item"), F.col("item_key").alias("_key"), "item_words"), 0.1), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_key") == F.col("_key")))
    ids = few(lines.select(F.col("doc_id").alias("_id")).distinct(), 3.0)
    again = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", template_words(F.col("_text")).alias("_words"))
    both = again.join(few(named, 0.1), F.col("doc_id").eqNullSafe(F.col("_id")))
    # at a break one word may be matched from both sides: each place, of the item and of the document, is used once
    spots = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda k: F.struct((x["at"] + k).alias("i"), (x["at"] + x["diagonal"] + k).alias("d"))))))
    first = let(spots, lambda s: F.filter(s, lambda x: ~F.exists(s, lambda y: (y["i"] == x["i"]) & (y["d"] < x["d"]))))
    first = let(first, lambda s: F.filter(s, lambda x: ~F.exists(s, lambda y: (y["d"] == x["d"]) & (y["i"] < x["i"]))))
    spots = F.when(F.col("g.wide") == 0, spots).otherwise(first)
    pairs = let(spots, lambda s: F.transform(s, lambda x: F.struct(F.get("item_words", x["i"]).alias("item"), F.get("_words", x["d"]).alias("doc"))))
    both = both.select("doc_id", "item_id", "item_key", "g.wide", F.array_min("hits.diagonal").alias("diagonal"), F.col("n_matched").cast("long").alias("n_matched"), F.col("n_windows").cast("long").alias("n_windows"), "coverage", F.array_min(F.transform("hits", lambda x: x["at"] + x["diagonal"])).alias("doc_start"), pairs.alias("_pairs"))
    # rows that share a doc_id may have other words there
    both = both.where(F.forall("_pairs", lambda z: F.coalesce(slot_of(z["item"]) == slot_of(z["doc"]), F.lit(False))))
    slots = F.array_distinct(F.filter("_pairs", lambda z: slot_of(z["item"]).isin("#", "@", "%")))
    once = lambda s, side: F.size(F.array_distinct(F.transform(s, lambda z: z[side])))
    both = both.withColumn("slots", slots).select(
        "*",
        F.size("slots").cast("long").alias("n_slots"),
        F.when(F.size("slots") > 0, (once(F.col("slots"), "item") + once(F.col("slots"), "doc")) / (2 * F.size("slots"))).otherwise(F.lit(1.0)).alias("consistency"),
        F.forall("slots", lambda z: z["item"] == z["doc"]).alias("exact"),
    )
    both = both.drop("_pairs", "slots")
    alone = items_alone(items, p)
    if not alone.isEmpty():
        both = both.unionByName(whole_items(texts, alone, p, few))
    best = F.max_by(F.struct("doc_start", "n_matched", "n_windows", "coverage", "n_slots", "consistency", "exact"), F.struct("n_matched", "consistency", -F.col("wide"), -F.col("diagonal"), "item_key")).alias("b")
    return both.where(F.col("consistency") >= p["consistency"]).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: dict | None = None, broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs``, all columns, without documents that contain an item.

    Rows are named by a hash of doc_id and text, so a row without doc_id has a verdict like any other, and so has each of
    several texts under one id. The names of what goes are broadcast up to ``broadcast_rows``: no text is shuffled.
    """
    name = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    found = stored(contaminated(docs.select(name.alias("doc_id"), "text"), benchmark, params).select(F.col("doc_id").alias("_found")).distinct(), "found")
    few = F.broadcast(found) if found.count() <= broadcast_rows else found
    return docs.withColumn("_name_of_row", name).join(few, F.col("_name_of_row") == F.col("_found"), "left_anti").drop("_name_of_row")


def op1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
