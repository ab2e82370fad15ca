"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets.

The Jaccard similarity of a short item and a long document says nothing, so items are partitioned by the size of their
shingle set and every partition is searched in pieces of documents of a matching size. A partition of items with more than
u/2 and at most u shingles looks at every 3 consecutive half-blocks of u/2 shingles; some such piece holds all of an
item that stands in one place. Item and piece then have a similarity of at least LEAST_SIMILARITY where the item's
containment is at the threshold, and with HASHES minima of one table each they meet but for a chance of MISS. Minima of
half-blocks are taken once for the smallest size and combined for the larger ones. Items of at most SMALLEST/2 shingles are
a partition that is looked up by all its shingles. Every (document, item) that meets is
verified on the whole sets of both.

Items are searched in blocks of bounded size, one after the other: what a block's items have of minima and shingles is
broadcast, the documents are scanned once a block, and nothing of them is shuffled.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm.common import text_chunks, written
from specula.llm.near_dup import shingles
from specula.llm.tokens import U, Lane, splitmix, words

#: For containment c = 0.8 of n = u/2 shingles in a piece of 1.5 u: c n / (1.5 u + n - c n).
LEAST_SIMILARITY, MISS = 0.8 * 0.5 / (1.5 + 0.1), 1e-5
HASHES = math.ceil(math.log(MISS) / math.log(1 - LEAST_SIMILARITY))
SMALLEST = 16
#: Shingles in a block of items, at 8 bytes; only an item larger than that makes a block larger.
BLOCK_SHINGLES = 1_000_000


class Index:
    """Minima of a block's items by partition and hash, and their sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        small = np.array([i for i, s in enumerate(sets) if len(s) <= SMALLEST // 2], np.int64)
        self.bits = max(16, int(16 * len(sets)).bit_length()) if len(sets) < 1 << 20 else 24
        # Of a handful of shingles the minima are the set itself.
        self.tiny = self._table(np.concatenate([sets[i] for i in small]), np.repeat(small, [len(sets[i]) for i in small])) if len(small) else None
        self.salts, self.odds = splitmix(171, HASHES), splitmix(172, HASHES) | U(1)
        sizes = np.array([1 << (len(s) - 1).bit_length() if len(s) > SMALLEST // 2 else 0 for s in sets], np.int64)
        self.parts: dict[int, list[tuple]] = {}
        for u in sorted(set(sizes.tolist()) - {0}):
            members = np.flatnonzero(sizes == u)
            lows = [np.array([((sets[i] ^ self.salts[k]) * self.odds[k]).min() for i in members], np.uint64) for k in range(HASHES)]
            self.parts[u] = [self._table(low, members) for low in lows]

    def _table(self, values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted values, whose they are, and a table of their low bits that tells most others apart at once."""
        order = np.argsort(values, kind="stable")
        table = np.zeros(1 << self.bits, bool)
        table[(values & U((1 << self.bits) - 1)).astype(np.int64)] = True
        return values[order], owners[order], table

    def _hits(self, part, values: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        held, owners, table = part
        hit = np.flatnonzero(table[(values & U((1 << self.bits) - 1)).astype(np.int64)])
        a, b = np.searchsorted(held, values[hit], "left"), np.searchsorted(held, values[hit], "right")
        return {(int(row[h]), int(i)) for h, x, y in zip(hit[b > a], a[b > a], b[b > a]) for i in owners[x:y]}

    def search(self, values: np.ndarray, firsts: np.ndarray):
        """(row, item) that meet. values: the shingles of texts in order, firsts: number of each text's first."""
        n = len(values)
        if not n:
            return set()
        counts = np.diff(firsts)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(n) - firsts[:-1][row]
        found = self._hits(self.tiny, values, row) if self.tiny else set()
        if not self.parts:
            return found
        base = SMALLEST // 2
        at = np.flatnonzero(place % base == 0)
        low = np.stack([np.minimum.reduceat((values ^ self.salts[k]) * self.odds[k], at) for k in range(HASHES)])
        row, place = row[at], place[at] // base
        size = base
        while True:
            if (part := self.parts.get(2 * size)) is not None:
                m = len(row)
                for k in range(HASHES):
                    piece = low[k].copy()
                    for step in (1, 2):
                        same = row[step:] == row[: m - step] if m > step else np.zeros(0, bool)
                        piece[: max(m - step, 0)] = np.where(same, np.minimum(piece[: max(m - step, 0)], low[k][step:]), piece[: max(m - step, 0)])
                    found |= self._hits(part[k], piece, row)
            if not any(u > 2 * size for u in self.parts):
                return found
            at = np.flatnonzero(place % 2 == 0)
            low, row, place, size = np.minimum.reduceat(low, at, axis=1), row[at], place[at] // 2, 2 * size


def find_contained(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the items of whose distinct shingles a document has ``percent`` or more.

    Shingles are ``width`` words after lower-casing A-Z; a text of fewer words has its whole sequence as the only one, so
    such an item is found where it is the whole document. Null and empty items are never found, null and empty documents
    hold none. Repeated items or documents give repeated rows. Rows with a null id keep it. Empty tables give an empty
    result; other columns are not read. Documents are read whole; the search needs the larger part of an item within about
    its own length, while verification counts its shingles anywhere in the document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def pairs(batch, found):
        ids = batch.column("id").to_pylist()
        hits = [(ids[r], *more) for r, *more in found]
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*hits)], ["doc_id", "item_id", "n_item", "n_shared"])

    out = docs.sparkSession.createDataFrame([], FOUND)
    for held, _ in _blocks(items, width, item_id, item_text):
        # Found pairs are few; written, they let go of the block before the next one comes.
        out = out.unionByName(written(rows.mapInArrow(_searcher(held, width, percent, "text", pairs), FOUND), "found"))
        held.unpersist()
    return out


FOUND = "doc_id long, item_id long, n_item long, n_shared long"


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; the search is that of ``find_contained``.

    Rows are dropped where they are read, so no text is shuffled; each block of items is one pass over what is left, which
    is written where another block follows, so that one block at a time is held.
    """

    def rest(batch, found):
        keep = np.ones(batch.num_rows, bool)
        keep[[r for r, *_ in found]] = False
        yield batch.filter(pa.array(keep))

    names = [f"c{k}" for k in range(len(docs.columns))]
    rows, at = docs.toDF(*names), names[docs.columns.index(text_col)]
    for held, more in _blocks(items, width, item_id, item_text):
        rows = rows.mapInArrow(_searcher(held, width, percent, at, rest), rows.schema)
        if more:
            rows = written(rows, "clean")
            held.unpersist()
    return rows.toDF(*docs.columns)


def _blocks(items: DataFrame, width: int, item_id: str, item_text: str):
    """(broadcast, whether more follow) of about BLOCK_SHINGLES shingles each, which together hold every item that has any."""
    named = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    sets = shingles(named, width).filter(F.size("shingles") > 0)
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_SHINGLES)
    for k in range(blocks):
        block = sets.filter(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == k).toArrow()
        arrays = [np.asarray(x.values, np.int64).view(np.uint64) for x in block.column("shingles")]
        yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block.column("id").to_pylist(), arrays)), k + 1 < blocks


_built: dict[str, Index] = {}


def _searcher(held, width: int, percent: int, column: str, emit):
    """A function over Arrow batches: ``emit`` makes batches of one and its [(row, item id, n_item, n_shared)]."""

    def run(batches):
        key, *block = held.value
        if key not in _built:
            _built.clear()
            _built[key] = Index(*block)
        index, lane = _built[key], Lane(61, fold=True)
        for batch in batches:
            found = []
            for begin, end, data, offsets in text_chunks(batch, column):
                starts, ends, firsts = words(data, offsets)
                hashes = lane.words(data, starts, ends)
                counts = np.diff(firsts)
                row = np.repeat(np.arange(len(counts)), counts)
                at = np.flatnonzero(np.arange(len(hashes)) + width <= firsts[1:][row]) if len(hashes) else np.zeros(0, np.int64)
                short = np.flatnonzero((counts > 0) & (counts < width))
                first, last = np.concatenate([at, firsts[short]]), np.concatenate([at + width, firsts[short + 1]])
                order = np.argsort(first, kind="stable")
                values = lane.ranges(lane.running(hashes), first[order], last[order])
                bounds = np.searchsorted(first[order], firsts)
                for r, i in index.search(values, bounds):
                    item = index.sets[i]
                    shared = int(np.isin(item, values[bounds[r] : bounds[r + 1]]).sum())
                    if 100 * shared >= percent * len(item):
                        found.append((begin + r, index.ids[i], len(item), shared))
            yield from emit(batch, found)

    return run


def op5_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_contained(docs, items)


OP5_SQL = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT DISTINCT k, id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n FROM s WHERE k = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM s d JOIN s b ON d.s = b.s AND d.k = 'd' AND b.k = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
