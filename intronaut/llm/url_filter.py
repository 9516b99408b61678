"""URL filters as a temporal list join.

A block list is a log of dated entries: a pattern is added or removed on a date.
Per pattern the log becomes disjoint validity intervals. A capture has a few keys,
the suffixes of its host and the path prefixes below the host; it meets the
intervals of equal patterns, and the one that holds at its fetch time decides.
Hosts are the same in any case of letters, paths are not.

Long lists are joined by shuffle. Most keys of captures (all top-level domains, most
hosts) are no pattern at all, so keys go through a bitmap of the patterns' hashes before
the exchange: it has ``FILTER_BITS`` bits whatever the size of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.scratch import materialize

#: Largest number of intervals that is broadcast; longer lists are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bits of the bitmap that keys must pass before a shuffle.
FILTER_BITS = 1 << 24
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty where the URL has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def keys_of(url: Column) -> Column:
    """Host suffixes of whole labels and host/path prefixes of whole segments; empty labels (a last dot) don't count."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    host = F.array_join(labels, ".")
    segments = F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda x: x != "")
    empty = F.array().cast("array<string>")
    suffixes = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(empty)
    prefixes = F.when((F.size(segments) > 0) & (F.size(labels) > 0), F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(empty)
    return F.array_distinct(F.concat(suffixes, prefixes))


def folded(pattern: Column) -> Column:
    """The pattern with its host in lower case; the path keeps its letters."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, dated) -> (pattern, since, until): from an ``add`` to the pattern's next ``remove``.

    The host part of a pattern is lower-cased. Entries with nulls or another action are ignored. An ``add`` while the pattern is active changes nothing;
    of entries of one pattern and time a ``remove`` counts.
    """
    log = entries.where("pattern is not null and dated is not null and action in ('add', 'remove')").groupBy(folded(F.col("pattern")).alias("pattern"), "dated").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("dated")
    changes = log.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    runs = changes.withColumn("until", F.lead("dated").over(order))
    return runs.where("action = 'add'").select("pattern", F.col("dated").alias("since"), "until")


def _passing(keys: DataFrame, active: DataFrame) -> DataFrame:
    """``keys`` without most of those that are no pattern: a bitmap of hashes as a table of words of 64 bits, of fixed size."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = active.select(F.shiftright(bit("pattern"), 6).alias("word"), F.pmod(bit("pattern"), F.lit(64)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    asked = keys.join(F.broadcast(words), F.shiftright(bit("key"), 6) == F.col("word"))
    return asked.where(F.expr("bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(key), {FILTER_BITS}L), 64) as int))")) != 0).select(*keys.columns)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture against the entries active at its fetch time.

    ``captures`` has page_id, url and fetched_at, ``entries`` pattern, action and dated. Returns one row
    per capture: page_id, url, fetched_at, blocked, pattern (the longest active one, ties by
    code point) and since. A null or unreadable URL, or a null time, matches nothing. Repeated
    rows get the same answer each.
    """
    active = materialize(intervals(entries), "intervals")
    asked = captures.select(F.col("url").alias("asked_url"), F.col("fetched_at").alias("asked_at")).where("asked_url is not null and asked_at is not null").distinct()
    keys = asked.withColumn("key", F.explode(keys_of(F.col("asked_url"))))
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    else:
        keys = _passing(keys, active)
    met = keys.join(active, F.col("key") == F.col("pattern")).where("asked_at >= since and (until is null or asked_at < until)")
    best = met.groupBy("asked_url", "asked_at").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("best"))
    # written, so that Spark can split a URL with many captures; captures without a URL or time go round the join
    best = materialize(best, "blocked")
    rows, asks = captures.select("page_id", "url", "fetched_at"), F.col("url").isNotNull() & F.col("fetched_at").isNotNull()
    joined = rows.where(asks).join(best, (F.col("url") == F.col("asked_url")) & (F.col("fetched_at") == F.col("asked_at")), "left")
    joined = joined.unionByName(rows.where(~asks), allowMissingColumns=True)
    return joined.select("page_id", "url", "fetched_at", F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"))


def demonstration_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, for want of a real one: digits of a digest pick hosts and days of 2024."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.get(F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda x: x != ""), 0).alias("segment")).where("host <> ''").distinct()
    digit = lambda name, i, n: F.conv(F.substring(F.md5(F.col(name)), i, n), 16, 10).cast("int")
    day = lambda n: F.expr("date'2024-01-01'") + n
    whole = hosts.select(F.col("host").alias("pattern")).distinct()
    below = hosts.where("segment is not null").select(F.concat("host", F.lit("/"), "segment").alias("pattern"))
    both = whole.union(below).distinct().where(digit("pattern", 1, 1) < 4)
    start, life = digit("pattern", 2, 2), digit("pattern", 4, 2)
    adds = both.select("pattern", F.lit("add").alias("action"), day(start).alias("dated"))
    removes = both.where(digit("pattern", 6, 1) < 8).select("pattern", F.lit("remove").alias("action"), day(start + life + 1).alias("dated"))
    again = both.where(digit("pattern", 6, 1) < 4).select("pattern", F.lit("add").alias("action"), day(start + life + 31).alias("dated"))
    return adds.union(removes).union(again)
