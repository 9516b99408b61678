"""Hard negatives by distributed radix selection over integer scores.

Vectors become whole numbers and a score is an inner product, so scores can be selected
digit by digit. An anchor has windows of scores: one over all rows of its own label, to
find its positives, and then one per positive over the rows of other labels. In each
round tiles (a block of anchors and a block of rows) count the scores inside a window by
the window's current digit; counts are summed, and the digit that holds the last row
wanted becomes the window's new range. A tile sends only the digits down to the one
where it has as many rows as are wanted itself, since nothing below can be needed. Windows
whose cut is known leave the rounds. At last the rows above the cut are gathered, and of
those at it (ties) as many as are missing, by the smaller number.

Rows travel as blocks of numbers; tiles are dealt by slots of blocks, so neither a
label nor a vector that many rows share makes a task larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.functions.ordering import numbered
from intronaut.scratch import materialize

#: Numbers of a block of rows and of a block of anchors.
ROW_CELLS, ANCHOR_CELLS = 1 << 17, 1 << 15
#: Blocks of rows that an anchor block is sent to together, where there are more than tasks.
SLOT_BLOCKS = 64
#: Bits of a digit.
DIGIT = 10
#: Scores looked at in one step of a task.
STEP_CELLS = 1 << 20
BLOCK = "dim int, block long, n int, least long, most long, label binary, vec_id binary, row binary, data binary, wide boolean"
WINDOWS = "array<struct<at:int,part:int,lo:bigint,hi:bigint,top:bigint,want:bigint,ties:bigint>>"
COUNTS = "dim int, block long, at int, part int, lo long, hi long, top long, want long, shift long, digit long, n long"
PARTNERS = "dim int, block long, at int, part int, score long, vec_id long, row long"
WINDOW = ("dim", "block", "at", "part")


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one block as one row, arrays as binary, whole numbers of 32 bits where they fit."""
    table = table.sort_by("number")
    data = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = bool(len(data)) and int(max(data.max(), -(data.min() + 1))) >= 1 << 31
    label, vec_id, row = (table.column(c).to_numpy().astype(np.int64) for c in ("label", "vec_id", "row"))
    cells = [table.column("dim")[0].as_py(), table.column("block")[0].as_py(), len(table), int(label.min()), int(label.max()), label.tobytes(), vec_id.tobytes(), row.tobytes(), (data if wide else data.astype(np.int32)).tobytes(), wide]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.bool_()]
    return pa.table([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=["dim", "block", "n", "least", "most", "label", "vec_id", "row", "data", "wide"])


def _dealt(rows: DataFrame, cells: int) -> DataFrame:
    """Rows with their ``block`` and their place ``at`` in it: rows of one length in the order of labels, up to ``cells`` numbers a block."""
    size = F.greatest(F.floor(F.lit(cells) / F.greatest("dim", F.lit(1))), F.lit(1)).cast("long")
    blocks = numbered(rows, "number", "dim", "label", "vec_id", "row").withColumn("block", F.floor(F.col("number") / size).cast("long"))
    return blocks.withColumn("at", F.row_number().over(Window.partitionBy("dim", "block").orderBy("number")) - 1)


def _array(cell: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


@dataclass
class Tile:
    """Windows of a block of anchors, with the scores of its anchors (rows) and a block of rows (columns)."""

    at: np.ndarray
    part: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    top: np.ndarray
    want: np.ndarray
    ties: np.ndarray
    scores: np.ndarray
    partner: np.ndarray
    row: np.ndarray
    vec_id: np.ndarray

    def steps(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(windows, their scores, which rows may be partners), a bounded number of scores at once."""
        size = max(1, STEP_CELLS // max(1, len(self.row)))
        for first in range(0, len(self.at), size):
            s = slice(first, first + size)
            yield s, self.scores[self.at[s]], self.partner[self.at[s]]


def _tiles(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[int, int, Tile]]:
    """(dim, block of anchors, tile) of each pair of blocks; partners have the same label, the row itself left out, or another one."""
    for batch in batches:
        for cell in batch.to_struct_array():
            dim = cell["dim"].as_py()
            windows = [w.to_numpy(zero_copy_only=False) for w in cell["windows"].values.flatten()]
            a, b = (_array(cell[f"data{k}"], np.int64 if cell[f"wide{k}"].as_py() else np.int32).reshape(cell[f"n{k}"].as_py(), dim) for k in "ab")
            x, y = a.astype(float), b.astype(float)
            # sums below 2**53 are exact in doubles
            exact = not dim or np.abs(x).max() * np.abs(y).max() * dim < 2.0**53
            scores = (x @ y.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T
            row, equal = _array(cell["rowb"]), _array(cell["labela"])[:, None] == _array(cell["labelb"])[None, :]
            partner = equal & (_array(cell["rowa"])[:, None] != row[None, :]) if same else ~equal
            yield dim, cell["blocka"].as_py(), Tile(*windows, scores, partner, row, _array(cell["vec_idb"]))


def _shift(width: np.ndarray, digit: int) -> np.ndarray:
    """Bits below the first digit (of so many bits) of numbers up to ``width``."""
    bits, rest = np.zeros(len(width), np.int64), width.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        large = rest >> step > 0
        bits += step * large
        rest = np.where(large, rest >> step, rest)
    return np.maximum(bits + (rest > 0) - digit, 0)


def _batch(dim: int, block: int, columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, block, np.int64)), *map(pa.array, columns)]
    return pa.record_batch(arrays, [c.split()[0] for c in names.split(", ")])


def _histograms(same: bool, bits: int):
    """Scores of each window by digit from the top, down to the digit where this tile alone has all rows wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block, t in _tiles(batches, same):
            shift = _shift(t.hi - t.lo, bits)
            for s, scores, partner in t.steps():
                inside = partner & (scores >= t.lo[s, None]) & (scores <= t.hi[s, None])
                w, c = np.nonzero(inside)
                digit = (t.hi[s][w] - scores[w, c]) >> shift[s][w]
                counts = np.bincount((w << bits) + digit, minlength=len(scores) << bits).reshape(len(scores), 1 << bits)
                w, digit = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < t.want[s, None]))
                window = [x[s][w] for x in (t.at, t.part, t.lo, t.hi, t.top, t.want, shift)]
                yield _batch(dim, block, [*window, digit, counts[w, digit]], COUNTS)

    return count


def _partners(same: bool):
    """Rows above a window's cut, and this tile's first ones at it, as many as are missing (all where ``ties`` is negative)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block, t in _tiles(batches, same):
            order = np.lexsort((t.row, t.vec_id))
            for s, scores, partner in t.steps():
                scores, partner = scores[:, order], partner[:, order]
                even = partner & (scores == t.lo[s, None])
                first = even & ((t.ties[s, None] < 0) | (np.cumsum(even, axis=1) <= t.ties[s, None]))
                w, c = np.nonzero(partner & (scores > t.lo[s, None]) & (scores <= t.top[s, None]) | first)
                yield _batch(dim, block, [t.at[s][w], t.part[s][w], scores[w, c], t.vec_id[order[c]], t.row[order[c]]], PARTNERS)

    return take


class Grid:
    """Blocks of rows and of anchors (row, vec_id, label, dim, q), and the tiles that they make."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        pack = lambda df: df.groupBy("dim", "block").applyInArrow(_pack, BLOCK)
        self.rows = materialize(pack(_dealt(rows, ROW_CELLS)), "row_blocks")
        self.placed = materialize(_dealt(anchors, ANCHOR_CELLS), "anchors")
        self.anchors = materialize(pack(self.placed), "anchor_blocks")
        blocks, tasks = self.rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.slots = max(1, min(blocks, max(2 * tasks, -(-blocks // SLOT_BLOCKS))))

    def _tiles(self, state: DataFrame, same: bool) -> DataFrame:
        """Blocks of anchors that have windows beside the blocks of rows of their length (for the same label, those in its range of labels)."""
        windows = state.groupBy("dim", "block").agg(F.collect_list(F.struct("at", "part", "lo", "hi", "top", "want", "ties")).cast(WINDOWS).alias("windows"))
        side = lambda df, k: df.select("dim", *(F.col(c).alias(f"{c}{k}") for c in df.columns if c != "dim"))
        asked = side(self.anchors, "a").join(windows.withColumnRenamed("block", "blocka"), ["dim", "blocka"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(self.slots - 1))))
        held = side(self.rows, "b").withColumn("slot", F.pmod("blockb", F.lit(self.slots)).cast("int"))
        met = asked.join(held.hint("merge"), ["dim", "slot"])
        return met.where("leasta <= mostb and leastb <= mosta") if same else met

    def first(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The first ``k`` rows of each window, by falling score, then by vec_id: dim, block, at, part, score, vec_id, row, rank.

        ``windows`` has dim, block, at (an anchor's place), part, lo and hi (scores, both included).
        """
        active = windows.select(*WINDOW, "lo", "hi", F.col("hi").alias("top"), F.lit(k).cast("long").alias("want"), F.lit(-1).cast("long").alias("ties"))
        settled = None
        while settled is None or not active.isEmpty():
            found = self._tiles(active, same).mapInArrow(_histograms(same, DIGIT), COUNTS)
            keys = [*WINDOW, "lo", "hi", "top", "want", "shift"]
            upto = F.sum("n").over(Window.partitionBy(*WINDOW).orderBy("digit"))
            last = F.min(F.when(F.col("upto") >= F.col("want"), F.struct("digit", "n", "upto"))).alias("last")
            cut = found.groupBy(*keys, "digit").agg(F.sum("n").alias("n")).withColumn("upto", upto).groupBy(*keys).agg(last)
            unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift").cast("int"))
            hi = F.col("hi") - unit * F.col("last.digit")
            missing = F.col("want") - F.col("last.upto") + F.col("last.n")
            # fewer rows than wanted: all of the window; as many as wanted: all of the digit
            few, whole = F.col("last").isNull(), F.col("last.upto") == F.col("want")
            ranges = F.when(few, F.col("lo")).otherwise(F.greatest(F.col("lo"), hi - unit + 1)).alias("lo"), F.when(few, F.col("hi")).otherwise(hi).alias("hi")
            state = cut.select(*WINDOW, *ranges, "top", F.coalesce(missing, "want").alias("want"), F.when(few | whole, -1).otherwise(missing).cast("long").alias("ties"), (few | whole | (F.col("shift") == 0)).alias("done"))
            state = materialize(state, "windows")
            done, active = state.where("done").drop("done"), state.where("not done").drop("done")
            settled = done if settled is None else settled.union(done)
        rows = self._tiles(settled, same).mapInArrow(_partners(same), PARTNERS)
        rank = F.row_number().over(Window.partitionBy(*WINDOW).orderBy(F.desc("score"), "vec_id", "row"))
        return materialize(rows.withColumn("rank", rank).where(F.col("rank") <= k), "partners")


def _share(score: str, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a score of at least 0, rounded down or up, without a product that overflows."""
    return F.expr(f"{score} div 100 * {percent} + ({score} % 100 * {percent} + {99 if up else 0}) div 100")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Rows of other labels that score nearly as high with an anchor as one of its positives does.

    ``vectors`` has vec_id, embedding (array of numbers) and label; ``anchor`` tells anchors by these columns. A component x counts as floor(``scale`` * x),
    a score is the inner product with the anchor. An anchor's positives are its first ``positives`` other rows of its label, by falling score, then by vec_id.
    For each of them come the first ``negatives`` rows of other labels with ``low`` to ``high`` percent of its score. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Rows with a null vec_id, label or vector or any null or non-finite component take no part; vectors meet those of their
    length only (empty ones score 0 with each other). Rows that repeat a vec_id count as rows, also as partners of each other. A negative score of a positive leaves no negatives.
    Scores are exact while those of all pairs stay within 2**61.
    """
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    good = good.withColumn("q", F.transform("x", lambda v: F.floor(v * scale))).withColumn("square", F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = materialize(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("q").alias("dim"), "q", "square", "anchor"), "rows")
    grid = Grid(rows.drop("anchor", "square"), rows.where("anchor").drop("anchor"))
    longest = rows.agg(F.max("square")).first()[0] or 0.0
    bound = F.least(F.ceil(F.sqrt(F.col("square")) * (longest**0.5 * (1 + 1e-9))).cast("double") + 1, F.lit(2.0**61)).cast("long")
    first = grid.first(grid.placed.select(*WINDOW[:3], F.lit(0).alias("part"), (-bound).alias("lo"), bound.alias("hi")), positives, same=True)
    found = first.select(*WINDOW[:3], F.col("rank").alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    limits = first.where("score >= 0").select(*WINDOW[:3], F.col("rank").alias("part"), _share("score", low, True).alias("lo"), _share("score", high, False).alias("hi"))
    mined = grid.first(limits.where("lo <= hi"), negatives, same=False)
    mined = mined.select(*WINDOW, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    anchors = grid.placed.select(*WINDOW[:3], F.col("vec_id").alias("anchor_id"))
    return mined.join(found, [*WINDOW]).join(anchors, [*WINDOW[:3]]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
