"""Substring dedup by recompression: words that a repeated window covers are removed.

Recompression renames a text in rounds: runs of one symbol, then pairs of a "left" and a "right" symbol (a bit of the name
and the round decides) become new symbols. Names are fingerprints of what they stand for, so every task gives the same
name to the same run or pair and no dictionary has to be shuffled. A symbol's dependence extent is what of the text its
forming depends on; a window that contains the extent has the symbol at the same place wherever the window occurs.

Every window picks the symbol of least fingerprint among those of the highest level whose extents it contains (a window
that contains none, or only short ones, stands for itself). Windows that are equal anywhere thus pick equal symbols, so:

1. One scan turns the picks into anchors: (fingerprint, first and last window that pick it, hash of all words from the
   first window's start to the last one's end). Anchors equal in all of that are reduced to the earliest one within an
   Arrow batch, the others are known as repeats, and a fingerprint that the batch has in several contexts is known as such.
   So a hot passage, and a hot phrase in ever other surroundings, cost a row or two a batch where they are looked at.
2. The anchors are grouped by fingerprint, which tells those that stand alone; the others are grouped by fingerprint and
   context. Equal ones repeat the earliest of them as a whole. Where anchors of one fingerprint differ, the earliest of each
   kind go on with their windows one by one.
3. These windows are grouped by two independent 64-bit hashes of their words; later ones repeat the earliest.

The covered spans of a document are then merged and cut out of its text. The exchange of the texts by id is used twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.llm.common import text_chunks, written
from specula.llm.tokens import U, Lane, fmix, splitmix, words

ROUNDS = 2
#: A symbol spans so many words at most, and its extent must hold so many to serve as an anchor.
LONGEST, LEAST = 12, 6

#: key deals the rows out: the name, or a value of its own for rows of which more needn't be known. many: the batch has other
#: contexts of the name. A row without place only tells that.
ANCHORS = "key long, name long, context long, doc_id long, first int, last int, repeat boolean, many boolean"


class _Level:
    """Symbols in text order: name, the words [start, end) and the dependence extent [low, high)."""

    def __init__(self, names, starts, ends, rows, firsts):
        self.names, self.starts, self.ends, self.rows = names, starts, ends, rows
        self.low, self.high, self.firsts = starts.copy(), ends.copy(), firsts

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Extents of the symbols before and after; at a text's edge one beyond it, as nothing outside is known there."""
        same = self.rows[1:] == self.rows[:-1]
        low, high = self.starts - 1, self.ends + 1
        low[1:] = np.where(same, self.low[:-1], low[1:])
        high[:-1] = np.where(same, self.high[1:], high[:-1])
        return low, high

    def _joined(self, head: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Merge each symbol that is no head into the one before it."""
        at = np.flatnonzero(head)
        ends = np.append(at[1:], len(head)) - 1
        self.names, self.starts, self.ends, self.rows = names[at], self.starts[at], self.ends[ends], self.rows[at]
        self.low, self.high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    def runs(self, salt: np.uint64) -> None:
        """Name maximal runs; whether a symbol is in one depends on both neighbours. Overlong runs stay as they are, but that
        they are overlong depends on all of them."""
        low, high = self._neighbours()
        low, high = np.minimum(low, self.low), np.maximum(high, self.high)
        head = np.ones(len(self.names), bool)
        head[1:] = (self.names[1:] != self.names[:-1]) | (self.rows[1:] != self.rows[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(head)))
        fits = self.ends[np.append(at[1:], len(head)) - 1] - self.starts[at] <= LONGEST
        over = np.repeat(~fits, size)
        if over.any():
            low = np.where(over, np.repeat(np.minimum.reduceat(low, at), size), low)
            high = np.where(over, np.repeat(np.maximum.reduceat(high, at), size), high)
        head |= over
        names = self.names.copy()
        long = at[fits & (size > 1)]
        names[long] = fmix(self.names[long] * U(3) + size[fits & (size > 1)].astype(np.uint64) + salt)
        self._joined(head, names, low, high)

    def pairs(self, salt: np.uint64) -> None:
        """Name adjacent (left, right) symbols. A pair depends on nothing outside, a symbol left alone on one neighbour."""
        right = (fmix(self.names + salt) & U(1)).astype(bool)
        head = np.ones(len(self.names), bool)
        fits = (self.rows[1:] == self.rows[:-1]) & (self.ends[1:] - self.starts[:-1] <= LONGEST)
        head[1:] = ~(fits & ~right[:-1] & right[1:])
        second = ~head
        first = np.zeros(len(head), bool)
        first[:-1] = second[1:]
        low, high = self._neighbours()
        alone = ~(first | second)
        low = np.where(alone & right, np.minimum(low, self.low), self.low)
        high = np.where(alone & ~right, np.maximum(high, self.high), self.high)
        names = self.names.copy()
        at = np.flatnonzero(first)
        names[at] = fmix(self.names[at] * U(5) + fmix(self.names[at + 1] + salt) + salt)
        self._joined(head, names, low, high)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least value in each [lo, hi), -1 if empty; from minima over spans of powers of two."""
    out = np.full(len(lo), -1, np.int64)
    size = hi - lo
    best, width = np.arange(len(values)), 1
    while True:
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(now):
            a, b = best[lo[now]], best[hi[now] - width]
            out[now] = np.where(values[b] < values[a], b, a)
        if 2 * width > len(values) or not (size >= 2 * width).any():
            return out
        a, b = best[:-width], best[width:]
        best, width = np.where(values[b] < values[a], b, a), 2 * width


class Recompressor:
    """Anchors of a chunk of texts; places are word numbers in the chunk."""

    def __init__(self, window: int):
        self.window = window
        self.one, self.two = Lane(81, fold=False), Lane(91, fold=False)
        self.salts = splitmix(95, 2 * ROUNDS)

    def windows(self, firsts: np.ndarray) -> np.ndarray:
        """Every window's first word."""
        n = int(firsts[-1])
        rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        return np.flatnonzero(np.arange(n) + self.window <= firsts[1:][rows]) if n else np.zeros(0, np.int64)

    def hashes(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of both lanes, for hashes of word ranges, and the words' names."""
        names = self.one.words(data, starts, ends)
        return names, self.one.running(names), self.two.running(self.two.words(data, starts, ends))

    def anchors(self, data, starts, ends, firsts):
        """(name, context, first window, last window), windows by their first word."""
        at = self.windows(firsts)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at, at
        names, sum_one, sum_two = self.hashes(data, starts, ends)
        n = len(names)
        level = _Level(names, np.arange(n), np.arange(1, n + 1), np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)), firsts)
        for k in range(ROUNDS):
            level.runs(self.salts[2 * k])
            level.pairs(self.salts[2 * k + 1])
        kept = np.flatnonzero((level.high - level.low >= LEAST) & (level.high - level.low <= self.window))
        low, high = level.low[kept], level.high[kept]
        lo = np.searchsorted(low, at, "left")
        hi = np.maximum(np.searchsorted(high, at + self.window, "right"), lo)
        low, high = np.clip(low, 0, n), np.clip(high, 0, n)
        strong = fmix(level.names[kept] + self.one.ranges(sum_one, low, high))
        pick = _least(strong, lo, hi)
        itself = pick < 0
        mark = np.where(itself, -1 - at, pick)
        head = np.ones(len(at), bool)
        head[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(head)
        first, last = at[head], at[np.append(head[1:], len(at)) - 1]
        pick = pick[head]
        name = np.where(pick >= 0, strong[pick] if len(strong) else U(0), self.one.ranges(sum_one, first, first + self.window) ^ U(1))
        # The place of the symbol in the context belongs to it: equal contexts must also have it at the same place.
        inside = np.where(pick >= 0, (level.starts[kept][pick] if len(kept) else 0) - first, 0).astype(np.uint64)
        context = fmix(self.two.ranges(sum_two, first, last + self.window) + inside * U(0x9E3779B97F4A7C15))
        return name, context, first, last


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches):
        of = Recompressor(window)
        for batch in batches:
            parts = []
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for begin, end, data, offsets in text_chunks(batch, "text"):
                starts, ends, firsts = words(data, offsets)
                name, context, first, last = of.anchors(data, starts, ends, firsts)
                row = np.searchsorted(firsts, first, "right") - 1
                parts.append((name.view(np.int64), context.view(np.int64), ids[begin + row], (first - firsts[row]).astype(np.int32), (last - firsts[row]).astype(np.int32)))
            if not parts:
                continue
            name, context, doc, first, last = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((first, doc, context, name))
            name, context, doc, first, last = (x[order] for x in (name, context, doc, first, last))
            same = np.zeros(len(name), bool)
            same[1:] = (name[1:] == name[:-1]) & (context[1:] == context[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
            # Rows that repeat an id are as early as each other.
            repeat = (doc != doc[head]) | (first != first[head])
            # Names with several contexts in the batch: their rows know that already and are dealt out one by one, and one
            # row a name tells the others. So a name, too, costs a row a batch where it is looked at.
            own = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            kinds = np.add.reduceat((~same).astype(np.int64), own) if len(own) else own
            many = np.repeat(kinds > 1, np.diff(np.append(own, len(name))))
            alone = fmix(name.view(np.uint64) + fmix(doc.astype(np.uint64)) + first.astype(np.uint64)).view(np.int64)
            key = np.where(repeat | many, alone, name)
            for k in range(0, len(name), 50_000):
                cut = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (key, name, context, doc, first, last, repeat, many)], names)
            told = name[own[kinds > 1]]
            if len(told):
                none = pa.nulls(len(told), pa.int32())
                no = pa.array(np.zeros(len(told), bool))
                yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(told), pa.array(np.zeros(len(told), np.int64)), pa.nulls(len(told), pa.int64()), none, none, no, no], names)

    return docs.mapInArrow(run, ANCHORS)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(one, two, doc_id, first): the windows of texts' (doc_id, text, spans) that spans (first, last) name."""

    def run(batches):
        of = Recompressor(window)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            for begin, end, data, offsets in text_chunks(batch, "text"):
                starts, ends, firsts = words(data, offsets)
                _, sum_one, sum_two = of.hashes(data, starts, ends)
                part = spans.slice(begin, end - begin)
                flat, row = part.flatten(), np.repeat(np.arange(end - begin), np.diff(part.offsets.to_numpy()))
                first, last = flat.field("first").to_numpy().astype(np.int64), flat.field("last").to_numpy().astype(np.int64)
                size = last - first + 1
                at = np.repeat(first + firsts[row], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(row, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of.one.ranges(sum_one, at, at + window).view(np.int64)),
                        pa.array(of.two.ranges(sum_two, at, at + window).view(np.int64)),
                        pa.array(ids[begin + row]),
                        pa.array((at - firsts[row]).astype(np.int32)),
                    ],
                    ["one", "two", "doc_id", "first"],
                )

    return texts.mapInArrow(run, "one long, two long, doc_id long, first int")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts' (doc_id, text, spans) without the words of windows that spans name."""

    def run(batches):
        for batch in batches:
            spans = batch.column("spans")
            for begin, end, *_ in text_chunks(batch, "text"):
                counts, removed, kept = [], [], []
                texts = batch.column("text").slice(begin, end - begin).to_pylist()
                for text, own in zip(texts, spans.slice(begin, end - begin).to_pylist()):
                    held = (text or "").encode().split()
                    gone = 0
                    counts.append(len(held))
                    if own:
                        cover = np.zeros(len(held) + 1, np.int64)
                        for s in own:
                            cover[s["first"]] += 1
                            cover[min(s["last"] + window, len(held))] -= 1
                        stays = np.cumsum(cover[:-1]) == 0
                        held = [w for w, keep in zip(held, stays.tolist()) if keep]
                        gone = len(stays) - len(held)
                    removed.append(gone)
                    kept.append(b" ".join(held).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "text"],
                )

    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def _by_doc(spans: DataFrame) -> DataFrame:
    """The spans of a document, as many as it has windows at most."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): every document with the words gone that a repeated window covers.

    A word is a run of anything but ASCII white space, a window ``window`` consecutive words of one document. A window is a
    repeat if the same words start earlier: in a document of smaller id, or before it in the same one. What stays is joined
    by one space. Null and empty texts have no words; texts shorter than a window stay whole. Ids should be unique: rows
    that repeat an id are as early as each other and share what is cut. Null ids count as the smallest. An empty table
    gives an empty result; other columns are not read.
    """
    lowest = -(1 << 63)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    group = Window.partitionBy("key")
    place = F.rank().over(Window.partitionBy("name", "context", "repeat").orderBy("doc_id", "first"))
    # First which names are shared at all, and whether in different contexts; a name has at most two rows of a batch there.
    shared = (
        _anchors(docs, window)
        .withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("differ", F.col("many") | (F.min("context").over(group) != F.max("context").over(group)) | (F.count("doc_id").over(group) < F.col("n")))
        .filter("doc_id IS NOT NULL AND (repeat OR many OR n > 1)")
        .select("name", "context", "doc_id", "first", "last", "repeat", "differ")
    )
    # Then which of equal contexts is the earliest; what a batch knew as repeats is dealt out by itself.
    deal = F.when(F.col("repeat"), F.xxhash64("doc_id", "first")).otherwise(F.col("context"))
    known = (
        shared.withColumn("context", deal)
        .withColumn("place", place)
        .select("doc_id", "first", "last", F.expr("repeat or place > 1").alias("again"), F.expr("not repeat and place = 1 and differ").alias("open"))
    )
    known = written(known, "anchors")
    opened = _by_doc(known.filter("open"))
    rows = _windows(docs.join(opened, "doc_id"), window)
    rows = written(rows, "windows")
    earliest = rows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "first")).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = rows.join(earliest, ["one", "two"]).filter("doc_id <> e.doc_id or first <> e.first").select("doc_id", "first", F.col("first").alias("last"))
    spans = _by_doc(known.filter("again").select("doc_id", "first", "last").unionByName(later))
    out = _cut(docs.join(spans, "doc_id", "left"), window)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(lowest)))


def op8_substring_dedup(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM w, unnest(range(1, len(w) - 18)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM r, unnest(range(0, 20)) AS t(j)),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string([x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(coalesce(gone, []), x[2])], ' ')) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""
