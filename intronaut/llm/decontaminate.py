"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Items become windows of ``window`` words. A document contains a window only if it
contains every word of it, so one necessary word per window, the rarest in the corpus,
is the whole prefix that must be joined. Documents keep the places of such words
alone; the join with the windows that the word stands for gives a start, which
must leave room for the window on both sides (positional and length bound), and
the words in between are then compared one by one.

The documents are read twice: once to count the words of the benchmark, which orders
them by rarity, and once to find the places of prefixes. The second pass numbers the
rows and writes one row for each text and one for each place, so all later steps go
by that number. Words meet by ``lower``, which folds more letters than A-Z; the words
around a place are folded exactly before they are compared.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intronaut.scratch import materialize

#: Between words of a text as it stands; in lower case, \x3A-\x60 are separators throughout.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Prefix words that are broadcast for one pass over the documents; more of them take more passes.
BLOCK_WORDS = 1_000_000
#: Largest vocabulary (in rows, of one word each) that is broadcast to count its words.
BROADCAST_WORDS = 1_000_000
NO_ITEMS = "cast(array() as array<string>)"


def parts_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as they stand in the text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def folded(words: Column) -> Column:
    """The words with A-Z in lower case and all other letters as they are."""
    return F.transform(words, lambda w: F.translate(w, ascii_uppercase, ascii_lowercase))


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(window, words, size): the distinct windows; (window, item): which items have them. A shorter item is one window."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), folded(parts_of(F.col("text").cast("string"))).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = materialize(words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("words")).distinct(), "item_windows")
    windows = materialize(cut.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("size")), "windows")
    return windows, cut.join(windows, "words").select("window", "item")


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, offset, window, words, size, before, after): the rarest word of each window in the corpus, by lower case, and its place in the window.

    ``before`` and ``after`` are the most words that any window of the key has before and after it.

    Windows with a word that no document has occur nowhere and are left out.
    """
    spread = windows.select("window", F.posexplode("words").alias("offset", "word")).withColumn("key", F.lower("word"))
    vocabulary = materialize(spread.select("key").distinct(), "vocabulary")
    small = vocabulary.count() <= BROADCAST_WORDS
    words = docs.select(F.explode(parts_of(F.col("text"))).alias("word")).select(F.lower("word").alias("key"))
    seen = materialize(words.join(F.broadcast(vocabulary) if small else vocabulary, "key").groupBy("key").agg(F.count("*").alias("n")), "word_counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("rarest")
    ranked = spread.join(seen, "key", "left").groupBy("window").agg(rarest).where("rarest.n > 0")
    met = ranked.select("window", "rarest.key", "rarest.offset").join(windows, "window")
    reach = met.groupBy("key").agg(F.max("offset").alias("before"), F.max(F.col("size") - F.col("offset") - 1).alias("after"))
    return materialize(met.join(reach, "key"), "prefixes")


def places(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (key ``""``) and one per place of a key, with as many words on either side as the key's windows reach.

    ``docs`` has row, doc_id and text, ``keys`` key, before and after. Returns row, doc_id, n_words, place, key, context and first, the
    place that the context begins with. The words of a text
    are led by an empty one, which is no word and so marks the row itself.
    """
    wanted = F.broadcast(keys.select("key", "before", "after").union(keys.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(0), F.lit(0))))
    words = docs.select("row", "doc_id", parts_of(F.col("text")).alias("w"))
    spread = words.select("row", "doc_id", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    place = F.col("at") - 1
    first = F.greatest(place - F.col("before"), F.lit(0))
    context = F.when(F.col("at") > 0, F.slice("w", first + 1, place - first + F.col("after") + 1))
    return spread.withColumn("key", F.lower("word")).join(wanted, "key").select("row", "doc_id", F.size("w").alias("n_words"), place.alias("place"), "key", context.alias("context"), first.alias("first"))


def contaminated_rows(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """As :func:`contaminated_words`, with the ``row`` of ``docs`` (row, doc_id, text) as a further column.

    ``row`` is a lasting key of any type; rows that share one have the same text.
    """
    windows, owners = item_windows(items, window)
    sought = prefixes(docs, windows)
    keys = materialize(sought.select("key", "before", "after").distinct(), "prefix_words")
    n_blocks = max(1, -(-keys.count() // BLOCK_WORDS))
    if n_blocks > 1:  # the passes must agree on the numbers of rows
        docs = materialize(docs.select("row", "doc_id", "text"), "numbered")
    own = lambda df, block: df.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block)
    found = materialize(reduce(DataFrame.union, (places(docs, own(keys, block)) for block in range(n_blocks))), "places")
    start = F.col("place") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    equal = folded(F.slice("context", start - F.col("first") + 1, F.col("size"))) == F.col("words")
    hit = found.where("place >= 0").join(sought.drop("before", "after"), "key").where(fits).where(equal)
    hits = materialize(hit.select("row", start.alias("low"), (start + F.col("size")).alias("high"), "window").distinct(), "hits")
    merged = F.aggregate(
        F.array_sort("ranges"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, r: F.struct(F.greatest(s["end"], r["high"]).alias("end"), (s["n"] + F.greatest(r["high"] - F.greatest(s["end"], r["low"]), F.lit(0))).alias("n")),
    )
    covered = hits.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("ranges"), F.sort_array(F.collect_set("window")).alias("windows"))
    covered = materialize(covered.select("row", merged["n"].cast("long").alias("n_hit"), "windows"), "covered")
    # the items of a set of windows are put together once, however many rows have that set
    sets = covered.select("windows").distinct().withColumn("window", F.explode("windows")).join(owners, "window").groupBy("windows").agg(F.sort_array(F.collect_set("item")).alias("items"))
    base = found.where("place < 0").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    base = base.distinct() if n_blocks > 1 else base
    n_hit, found_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.expr(NO_ITEMS))
    out = base.join(covered.join(sets, "windows").drop("windows"), "row", "left")
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(found_items).cast("long").alias("n_items"), found_items.alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Words of each document inside any occurrence of an item window, and the items found.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read.
    Returns one row per input row: doc_id, n_words, n_hit, n_items, items (array of item ids
    as strings, sorted), contaminated (n_hit > 0 and ``share`` * n_hit >= n_words). Null and
    empty texts have no words; items without id or words have no windows; repeated rows
    are judged each.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return contaminated_rows(rows, items, window, share).drop("row")
