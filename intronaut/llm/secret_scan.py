"""Secrets in texts: patterns, and windows of high entropy, in DataFrame functions only.

Patterns find base spans. Beyond them, candidates are runs of one character class
(hexadecimal, base64) that are as long as a window at least. A window slides over a
candidate: a fold adds the character that enters to the counts and takes the one that
leaves, and keeps the sum of c log2 c over the counts, from which the entropy follows.
The sum is kept in whole millionths of a bit, so it doesn't drift. Windows at or over the
class's threshold are merged to spans, unless an allow-list knows the candidate or what
stands before it. Candidates are cut into overlapping pieces, so a fold has a bounded length.

The places of matches come from the texts between them, whose lengths are summed over
rows of numbers after the texts have been left behind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.scratch import materialize


def either_case(word: str) -> str:
    """A pattern of the word in which each ASCII letter may be in upper or lower case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Pattern:
    """A kind of base span: matches of ``pattern`` whose group ``group`` has ``least`` characters at least."""

    kind: str
    pattern: str
    least: int
    group: int = 0


@dataclass(frozen=True)
class CharacterClass:
    """A kind of entropy span: windows of ``window`` characters of ``alphabet`` with ``bits`` per character at least."""

    kind: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{self.alphabet.replace('-', '')}{'-' if '-' in self.alphabet else ''}]{{{self.window},}}"

    @property
    def terms(self) -> list[int]:
        """c log2 c in millionths, for the counts 0 to ``window``."""
        return [round(1e6 * c * math.log2(c)) if c else 0 for c in range(self.window + 1)]

    @property
    def limit(self) -> int:
        """The largest sum of terms of a window with ``bits`` of entropy."""
        return math.floor(1e6 * self.window * (math.log2(self.window) - self.bits))


# The patterns of base spans, in the order of their kinds. A run that is taken as far as it goes and must
# have a length is asked for at that length, which gives the same spans; a short value of ``assign`` uses up its text.
PATTERNS = (
    Pattern("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Pattern("access", "AKIA[A-Z0-9]{14,}", 18),
    Pattern("hex", "[0-9a-f]{16,}", 16),
)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", 24, 3.0),
    CharacterClass("entropy_base64", f"{_LETTERS}{_LETTERS.upper()}0123456789+/", 24, 4.0),
)
#: Candidates, with up to ``BEFORE`` characters before them, that match one of these are no secrets.
ALLOW = (
    r"data:[A-Za-z0-9/+.;=-]*base64,[A-Za-z0-9+/]*$",
    r"[Ss][Hh][Aa](1|256|384|512)[-:=][A-Za-z0-9+/]*$",
    r"([Mm][Dd]5|[Cc]ommit|[Cc]hecksum|[Dd]igest|[Ee][Tt]ag)[\"']?[ :=]*[\"']?[A-Za-z0-9+/]*$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|PLACEHOLDER|[Dd]ummy|DUMMY|xxxx|XXXX",
    r"abcdefgh|ABCDEFGH|01234567|12345678",
)
BEFORE = 48
#: Windows of a candidate that one fold looks at.
PIECE = 512


def _candidates(kind: int) -> Column:
    """Structs (kind, at, gap, size, value, before) of the matches; the text after the last one makes a struct without value."""
    pairs = F.arrays_zip(F.col(f"found_{kind}").alias("found"), F.col(f"between_{kind}").alias("between"))
    one = lambda z, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("at"), F.length(z["between"]).alias("gap"), F.length(z["found"]).alias("size"), z["found"].alias("value"), F.right(z["between"], F.lit(BEFORE)).alias("before"))
    return F.coalesce(F.transform(pairs, one), F.expr("cast(array() as array<struct<kind:int,at:int,gap:int,size:int,value:string,before:string>>)"))


def entropy_windows(piece: Column, cls: CharacterClass) -> Column:
    """Merged ranges (low, high; from 0, high exclusive) of the windows of a text of one class that reach its entropy."""
    w, terms, none = cls.window, F.array(*map(F.lit, cls.terms)), F.lit(-1)
    place = lambda i: F.instr(F.lit(cls.alphabet), F.substring(piece, i, F.lit(1)))
    run = F.expr("cast(array() as array<struct<low:int,high:int>>)")
    start = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("low"), none.alias("high"), run.alias("done"),
    )

    def step(s: Column, i: Column) -> Column:
        enters, leaves = place(i), F.when(i > w, place(i - w)).otherwise(F.lit(0))
        more, less = F.get(s["counts"], enters - 1), F.coalesce(F.get(s["counts"], leaves - 1), F.lit(0))
        gained = F.get(terms, more + 1) - F.get(terms, more)
        lost = F.when(leaves > 0, F.get(terms, less) - F.get(terms, less - 1)).otherwise(F.lit(0))
        total = F.when(enters == leaves, s["sum"]).otherwise(s["sum"] + gained - lost)
        counts = F.transform(s["counts"], lambda c, k: c + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
        hot = (i >= w) & (total <= cls.limit)
        fresh = hot & ((s["low"] < 0) | (i - w > s["high"]))
        return F.struct(
            counts.alias("counts"), total.alias("sum"), F.when(fresh, i - w).otherwise(s["low"]).alias("low"), F.when(hot, i).otherwise(s["high"]).alias("high"),
            F.when(fresh & (s["low"] >= 0), F.array_append(s["done"], F.struct(s["low"].alias("low"), s["high"].alias("high")))).otherwise(s["done"]).alias("done"),
        )

    def close(s: Column) -> Column:
        return F.when(s["low"] >= 0, F.array_append(s["done"], F.struct(s["low"].alias("low"), s["high"].alias("high")))).otherwise(s["done"])

    return F.aggregate(F.sequence(F.lit(1), F.length(piece)), start, step, close)


def _entropy_spans(found: DataFrame, kind: int, cls: CharacterClass, allow: tuple[str, ...]) -> DataFrame:
    """(row, kind, start, end) of the merged windows of one class's candidates."""
    allowed = reduce(lambda a, p: a | F.regexp_like(F.concat("before", "value"), F.lit(p)), allow, F.lit(False))
    pieces = found.where(F.col("kind") == kind).where(~allowed).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("size") - cls.window, F.lit(PIECE))))
    cut = pieces.select("row", "start", (F.col("start") + F.col("off")).alias("base"), F.substring(F.col("value"), F.col("off") + 1, F.lit(PIECE + cls.window - 1)).alias("piece"))
    hot = cut.select("row", "start", "base", F.explode(entropy_windows(F.col("piece"), cls)).alias("r")).select("row", F.col("start").alias("candidate"), (F.col("base") + F.col("r.low")).alias("low"), (F.col("base") + F.col("r.high")).alias("high"))
    w = Window.partitionBy("row", "candidate").orderBy("low")
    new = (F.col("low") > F.coalesce(F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    islands = hot.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("row", "candidate", "island").agg(F.min("low").alias("start"), F.max("high").alias("end"))
    return islands.select("row", F.lit(kind).alias("kind"), "start", "end")


def scan_secrets(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Spans of secrets in each text, by pattern and by entropy.

    ``docs`` has doc_id and text; other columns are not read. Returns one row per input row: doc_id and spans, an
    array of (start, kind, end) sorted by start and kind, in code points from 0, ends exclusive; ``kind`` is the place of the kind among
    ``patterns`` and ``classes`` from 0. Base spans are whole matches, leftmost and without overlap within a kind; the allow-list
    touches entropy spans alone, which may overlap base spans. Null and empty texts have no spans, repeated rows get the same ones.
    """
    kinds = [*(p.pattern for p in patterns), *(c.pattern for c in classes)]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"found_{k}") for k, p in enumerate(kinds)))
    matched = found.select("row", "doc_id", *(c for k, p in enumerate(kinds) for c in (f"found_{k}", F.when(F.size(f"found_{k}") > 0, F.split("text", p, -1)).alias(f"between_{k}"))))
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit("").alias("value"), F.lit("").alias("before")))
    every = matched.select("row", "doc_id", F.explode(F.concat(itself, *map(_candidates, range(len(kinds))))).alias("m")).select("row", "doc_id", "m.*").where("value is not null")
    # one row per text and one per match; what follows has no texts any more
    written = materialize(every, "candidates")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    found = written.where("kind >= 0").withColumn("start", start.cast("long"))
    base = [found.where((F.col("kind") == k) & (F.length(F.regexp_extract("value", p.pattern, p.group)) >= p.least)).select("row", "kind", "start", (F.col("start") + F.col("size")).alias("end")) for k, p in enumerate(patterns)]
    added = [_entropy_spans(found, len(patterns) + k, c, allow) for k, c in enumerate(classes)]
    spans = reduce(DataFrame.unionByName, [*base, *added]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    nothing = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return written.where("kind < 0").select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
