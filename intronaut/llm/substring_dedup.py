"""Repeated passages by recompression.

1. Every window of ``window`` words elects the highest symbol of the recompression (runs, then pairs,
   :mod:`intronaut.llm.recompression`) that reaches no further than the window. Equal windows elect equal symbols at
   the same distance. Consecutive windows of one symbol are one row, with a digest of each window.
   Windows that repeat within a task's chunk of text are settled there, and one of them stands for all.
2. Census, a Spark round over the symbols alone: how often each one is elected. The few names that are elected more
   often than ``LEAST_HOT`` times (at most ``HOT_SYMBOLS`` names, whatever the size of the corpus) are hot.
3. Rows meet by symbol. A symbol seen once ends all its windows; of shared ones the windows are compared. Windows of a
   hot symbol meet one by one, by their own names, and a task sends each of those once.
4. Word ranges of repeated windows go back to their row, whose kept words are joined.

Rows are known by 128 bits of a hash of their content. Windows are the same if the names of their symbols (64 bits), their
distances to them and their digests (64 bits) are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intronaut.llm.recompression import elect
from intronaut.llm.words import CHUNK_BYTES, U, Words, mix, signed, split_words, windows
from intronaut.scratch import materialize

#: Elections that make a symbol hot, at least; and the largest number of hot symbols, which are sent to every task.
LEAST_HOT, HOT_SYMBOLS = 5_000, 1_000_000
#: Names of hot windows that a task remembers.
REMEMBERED = 1_000_000
ELECTED = "symbol long, row_a long, row_b long, start int, distance int, digests binary"
RANGES = "row_a long, row_b long, low int, high int"
_WIDTH = 8


def _stretches(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch in which the columns stay and the last one goes up by one."""
    *same, start = columns
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = start[1:] != start[:-1] + 1
    for x in same:
        new |= x[1:] != x[:-1]
    opens = np.flatnonzero(np.concatenate([[True], new]))
    return opens, np.append(opens[1:], len(start)) - 1


def _twins(digest: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of keys occur more than once, and which of these occurrences come first."""
    order = np.argsort(digest, kind="stable")
    alike = digest[order[1:]] == digest[order[:-1]]
    twin = alike.copy()
    for key in others:
        twin &= key[order[1:]] == key[order[:-1]]
    if (alike & ~twin).any():  # equal digests of different rows may stand between rows that are the same
        order = np.lexsort((*others, digest))
        twin = digest[order[1:]] == digest[order[:-1]]
        for key in others:
            twin &= key[order[1:]] == key[order[:-1]]
    again, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order[1:]] = twin
    again[order[:-1]] = twin
    again |= later
    return again, again & ~later


class Elections:
    """Windows of one chunk that have to meet others, and those that repeat inside the chunk."""

    def __init__(self, words: Words, window: int):
        row, start, place, symbol = elect(words, window)
        digest = windows(words.codes, window)[start] if len(start) else symbol
        again, first = _twins(digest, symbol)
        self.row, self.at, self.window = words.first + row, start - words.offsets[row] + words.base, window
        self.distance, self.symbol, self.digest = place - start, symbol, digest
        self.settled = again
        self.open = np.flatnonzero(~again | first)

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the chosen windows of each symbol's occurrence."""
        return _stretches(self.row[chosen], (self.at + self.distance)[chosen], self.symbol[chosen], self.at[chosen])


def _record(symbol: np.ndarray, keys: list[np.ndarray], start: np.ndarray, distance: np.ndarray, digests: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(signed(symbol)), *map(pa.array, keys), pa.array(start.astype(np.int32)), pa.array(distance.astype(np.int32)), digests]
    return pa.record_batch(columns, ["symbol", "row_a", "row_b", "start", "distance", "digests"])


def _binary(borders: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _known(row: np.ndarray, low: np.ndarray, high: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    """Ranges known to repeat: they have their end in place of digests and meet nothing on their way."""
    keys = [k[row] for k in keys]
    ends = _binary(np.arange(len(row) + 1) * 4, high.astype(np.int32))
    return _record(mix(keys[0].view(U) + low.astype(U)), keys, low, np.zeros(len(row)), ends)


class _Seen:
    """Hot windows that a task has sent on: name, digest, and row and start where it came first."""

    def __init__(self):
        self.names = np.zeros(0, U)
        self.rest = np.zeros((0, 4), np.int64)

    def add(self, names: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these distinct windows were sent before, and the rest of those' first occurrences."""
        known, at = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            known = (self.names[at] == names) & (self.rest[at, 0] == rest[:, 0])
        firsts = self.rest[at[known]]
        if len(self.names) + len(names) > REMEMBERED:  # forgotten ones are sent again, which only costs rows
            self.names, self.rest = self.names[:0], self.rest[:0]
        every, rests = np.concatenate([self.names, names[~known]]), np.concatenate([self.rest, rest[~known]])
        order = np.argsort(every, kind="stable")
        self.names, self.rest = every[order], rests[order]
        return known, firsts


def _elector(window: int, hot: np.ndarray, chunk: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("row_a", "row_b")]
            for words in split_words(batch.column("text"), chunk=chunk, overlap=window - 1):
                e = Elections(words, window)
                again = np.flatnonzero(e.settled)
                opens, closes = _stretches(e.row[again], e.at[again])
                yield _known(e.row[again[opens]], e.at[again[opens]], e.at[again[closes]] + window, keys)
                is_hot = np.isin(e.symbol[e.open], hot)
                mine = e.open[~is_hot]
                opens, closes = e.rows(mine)
                digests = _binary(np.append(opens, len(mine)) * _WIDTH, e.digest[mine])
                row, first = e.row[mine[opens]], mine[opens]
                yield _record(e.symbol[first], [k[row] for k in keys], e.at[first], e.distance[first], digests)
                yield from _send_hot(e, e.open[is_hot], keys, seen)

    return send


def _send_hot(e: Elections, mine: np.ndarray, keys: list[np.ndarray], seen: _Seen) -> Iterator[pa.RecordBatch]:
    """Windows of hot symbols, each under a name of its own; one that the task has sent before is known to repeat."""
    name = mix(mix(e.symbol[mine] + e.distance[mine].astype(U)) ^ e.digest[mine])
    row, at = e.row[mine], e.at[mine]
    known, firsts = seen.add(name, np.stack([signed(e.digest[mine]), keys[0][row], keys[1][row], at], 1))
    new = np.flatnonzero(~known)
    yield _record(name[new], [k[row[new]] for k in keys], at[new], np.zeros(len(new)), _binary(np.arange(len(new) + 1) * _WIDTH, e.digest[mine[new]]))
    yield _known(row[known], at[known], at[known] + e.window, keys)
    a, b, start = (np.ascontiguousarray(firsts[:, i]) for i in (1, 2, 3))
    yield _known(np.arange(len(a)), start, start + e.window, [a, b])


def _census(window: int, chunk: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split_words(batch.column("text"), chunk=chunk, overlap=window - 1):
                e = Elections(words, window)
                names, n = np.unique(e.symbol[e.open[e.rows(e.open)[0]]], return_counts=True)
                yield pa.record_batch([pa.array(signed(names)), pa.array(n.astype(np.int64))], ["symbol", "n"])

    return count


def hot_symbols(texts: DataFrame, window: int) -> np.ndarray:
    """The symbols elected most often: the driver gets at most ``HOT_SYMBOLS`` of them, and mostly none."""
    elected = texts.mapInArrow(_census(window, CHUNK_BYTES), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counted, least = materialize(elected.where(F.col("n") >= LEAST_HOT), "census"), LEAST_HOT
    while counted.where(F.col("n") >= least).count() > HOT_SYMBOLS:
        least *= 2
    return np.sort(counted.where(F.col("n") >= least).select("symbol").toArrow().column("symbol").to_numpy()).view(U)


def _repeated(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Covered ranges of rows sorted by symbol, all rows of a symbol together."""
    sizes = np.diff(np.frombuffer(batch.column("digests").buffers()[1], np.int32)[: len(batch) + 1]) if len(batch) else np.zeros(0, np.int64)
    ready, batch = (batch.take(pa.array(np.flatnonzero(x))) for x in (sizes == 4, sizes != 4))
    ends = np.frombuffer(ready.column("digests").buffers()[2], np.int32)[: len(ready)] if len(ready) else np.zeros(0, np.int32)
    symbol = batch.column("symbol").to_numpy()
    same = symbol[1:] == symbol[:-1]
    shared = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(batch) else np.zeros(0, np.int64)
    batch = batch.take(pa.array(shared))
    symbol = batch.column("symbol").to_numpy()
    borders = np.frombuffer(batch.column("digests").buffers()[1], np.int32)[: len(batch) + 1] // _WIDTH if len(batch) else np.zeros(1, np.int32)
    digest = np.frombuffer(batch.column("digests").buffers()[2], U)[: borders[-1]] if len(batch) else np.zeros(0, U)
    row = np.repeat(np.arange(len(batch)), np.diff(borders))
    step = np.arange(len(row)) - borders[row]
    start = batch.column("start").to_numpy()[row] + step
    distance = batch.column("distance").to_numpy()[row] - step
    again = _twins(digest, symbol[row], distance)[0]
    at, start = row[again], start[again]
    opens, closes = _stretches(at, start)
    of = pa.array(at[opens])
    low, high = (pa.array(x.astype(np.int32)) for x in (start[opens], start[closes] + window))
    columns = [*((batch.column(c).take(of), ready.column(c)) for c in ("row_a", "row_b")), (low, ready.column("start")), (high, pa.array(ends))]
    return pa.record_batch([pa.concat_arrays(x) for x in columns], ["row_a", "row_b", "low", "high"])


def _comparer(window: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            symbol = batch.column("symbol").to_numpy()
            cut = int(np.searchsorted(symbol, symbol[-1]))  # the last symbol may go on in the next batch
            if cut == 0:
                if held and held[-1].column("symbol")[-1].as_py() != symbol[0]:
                    yield _repeated(_joined(held), window)
                    held = []
                held.append(batch)
                continue
            yield _repeated(_joined([*held, batch.slice(0, cut)]), window)
            held = [batch.slice(cut)]
        if held:
            yield _repeated(_joined(held), window)

    return compare


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0].take(pa.array(np.arange(sum(map(len, parts)))))


def _kept(words: Words, keep: np.ndarray) -> np.ndarray:
    """The bytes of the kept words, each followed by a space."""
    starts, lengths = words.starts[keep], (words.ends - words.starts)[keep] + 1
    stops = np.cumsum(lengths)
    source = np.repeat(starts - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0)
    out = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
    out[stops - 1] = 0x20
    return out


def _covered(n: int, ranges: pa.Array, row: np.ndarray, offsets: np.ndarray, base: int) -> np.ndarray:
    """Words of a chunk inside the ranges (structs) of their rows."""
    low, high = (ranges.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] - base for c in ("low", "high"))
    edge = np.bincount(np.clip(low, 0, n), minlength=n + 1) - np.bincount(np.clip(high, 0, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _remover(chunk: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            total, removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
            texts: list[list[np.ndarray]] = [[] for _ in range(n)]
            spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
            lists = batch.column("ranges").fill_null([])
            counts, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            ends = np.cumsum(counts)
            for words in split_words(batch.column("row").field("text"), chunk=chunk):
                mine = slice(int(ends[words.first - 1]) if words.first else 0, int(ends[words.last - 1]))
                gone = _covered(len(words.codes), flat[mine], np.repeat(np.arange(words.last - words.first), counts[words.first : words.last]), words.offsets, words.base)
                kept = _kept(words, ~gone)
                sums = np.concatenate([[0], np.cumsum(gone)])
                bytes_ = np.concatenate([[0], np.cumsum((words.ends - words.starts + 1) * ~gone)])
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2) if gone.any() else np.zeros((0, 2), np.int64)
                for i in range(words.last - words.first):
                    a, b = int(words.offsets[i]), int(words.offsets[i + 1])
                    total[words.first + i] += b - a
                    removed[words.first + i] += sums[b] - sums[a]
                    texts[words.first + i].append(kept[bytes_[a] : bytes_[b]])
                owner = np.searchsorted(words.offsets, change[:, 0], "right") - 1
                for (a, b), i in zip(change.tolist(), owner.tolist(), strict=True):
                    _add_spans(spans, words, i, a, b)
            text = [b"".join(x.tobytes() for x in parts)[:-1].decode() for parts in texts]
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.record_batch([batch.column("row"), pa.array(total), pa.array(removed), pa.array(text, pa.string()), pa.array(spans, span)], ["row", "n_words", "n_removed", "kept_text", "removed_spans"])

    return remove


def _add_spans(spans: list[list[dict[str, int]]], words: Words, i: int, a: int, b: int) -> None:
    """The covered words ``a`` to ``b`` of the chunk, cut where rows meet and joined where pieces of a row do."""
    while a < b:
        stop, at = min(b, int(words.offsets[i + 1])), words.base - int(words.offsets[i])
        mine = spans[words.first + i]
        if a < stop:
            if mine and mine[-1]["high"] == a + at:
                mine[-1]["high"] = stop + at
            else:
                mine.append({"low": a + at, "high": stop + at})
        a, i = stop, i + 1


def remove_repeats_with(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows of ``docs`` (doc_id and text among their columns) as structs ``row``, with the results of :func:`remove_repeats`.

    Columns of ``docs`` may have any names, also those of results.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    text = F.col("text").cast("string")
    # a key per row content: rows that repeat an id with another text stay apart; equal rows share their ranges
    content = (F.col("doc_id").cast("long"), text)
    row = F.struct(*(text.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(F.xxhash64(*content).alias("row_a"), F.xxhash64(F.lit(1), *reversed(content)).alias("row_b"), row.alias("row"))
    texts = keyed.select("row_a", "row_b", F.col("row.text").alias("text"))
    elected = texts.mapInArrow(_elector(window, hot_symbols(texts.select("text"), window), CHUNK_BYTES), ELECTED)
    met = elected.repartition(F.col("symbol")).sortWithinPartitions("symbol")
    ranges = met.mapInArrow(_comparer(window), RANGES).groupBy("row_a", "row_b").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = materialize(ranges, "ranges")
    results = T.StructType.fromDDL("n_words long, n_removed long, kept_text string, removed_spans array<struct<low:int,high:int>>")
    schema = T.StructType([keyed.schema["row"], *results.fields])
    return keyed.join(ranges, ["row_a", "row_b"], "left").select("row", "ranges").mapInArrow(_remover(CHUNK_BYTES), schema)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that starts anywhere else as well.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; null has none. Windows are
    judged on the input, repeats inside one document count, and every occurrence goes.
    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and
    removed_spans (word ranges, end exclusive), one row per input row; repeated rows repeat
    each other. Other columns of ``docs`` are not read.
    """
    found = remove_repeats_with(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window)
    return found.select("row.doc_id", "n_words", "n_removed", "kept_text", "removed_spans")
