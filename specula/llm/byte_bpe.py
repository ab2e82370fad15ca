"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Every text is split by the tokenizer's pattern; the distinct pieces of a chunk that the worker hasn't met are put into
matrices of about equal length, one row a piece. Each round finds the leftmost minimum-rank pair of every row, merges it
and closes the gap (one cell leaves every row, so a boolean mask and a reshape do it); rows without a pair left drop out.
Ranks of pairs come from an open-addressing hash table that is probed for a whole matrix at once.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from specula.llm.common import text_chunks

#: Widths of the matrices in bytes. A longer piece is a matrix of its own, see ``_wide``.
WIDTHS = (2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256)
ROWS = 8192
NONE = np.int32(2**31 - 1)
#: Pieces that a worker remembers; beyond it starts anew, so its memory is bounded whatever the corpus holds.
CACHED = 200_000
MAX_VOCABULARY_BYTES = 64 << 20


class PairTable:
    """rank of the token that a pair of tokens forms, or NONE; linear probing in a table at most a quarter full."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(8, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slots], self.ranks[slots] = keys[todo[put]], ranks[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], at[left]
            at = np.where(self.keys[at] == -1, at, (at + 1) & self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Either side below 0 (padding) gives NONE."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (held != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out


class ByteBpe:
    """Ranks of a byte-level BPE vocabulary and the encoder over them."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), made.append(rank)
        self.pairs = PairTable((np.array(left, np.int64) << 32) | np.array(right, np.int64), np.array(made, np.int32))
        self._forget()

    def _forget(self):
        self.seen: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        row = np.arange(n)
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE, np.int32)
            ended = best == NONE
            for r, k in zip(row[ended], np.flatnonzero(ended)):
                out[r] = ids[k][: sizes[r]]
            if ended.any():
                go = ~ended
                row, ids, ranks, at, best = row[go], ids[go], ranks[go], at[go], best[go]
                if not len(row):
                    break
            k, w = np.arange(len(row)), ids.shape[1]
            sizes[row] -= 1
            ids[k, at] = best
            keep = np.ones((len(row), w), bool)
            keep[k, at + 1] = False
            ids = ids[keep].reshape(len(row), w - 1)
            keep = np.ones((len(row), w - 1), bool)
            keep[k, at] = False
            ranks = ranks[keep].reshape(len(row), w - 2)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.pairs.find(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < w - 2)
            ranks[has, at[has]] = self.pairs.find(ids[has, at[has]], ids[has, at[has] + 1])
        return out

    def _wide(self, piece: bytes) -> np.ndarray:
        """Token ids of a long piece: a matrix of one row, in which a round merges all pairs of the row's least rank.

        From the left, without overlaps: what rounds of one merge each do one after the other, unless a merge makes a pair of a
        still lower rank; then only the leftmost is merged. A round costs the row's length, and there are about as many rounds
        as ranks, not bytes.
        """
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of touching pairs every second one
            # The pair that a merge makes with the token behind it, before that is merged itself.
            inner = at[at < len(ids) - 2]
            passed = self.pairs.find(np.full(len(inner), best, np.int32), ids[inner + 2])
            merged = self._merge(ids, ranks, at, best)
            if len(passed) and passed.min() < best or len(merged[1]) and merged[1].min() < best:
                merged = self._merge(ids, ranks, at[:1], best)
            ids, ranks = merged
        return ids

    def _merge(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, token) -> tuple[np.ndarray, np.ndarray]:
        """The row after the pairs at these places became the token, and the ranks of its pairs."""
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids.copy()
        ids[at] = token
        ids, ranks = ids[keep], ranks[keep[1:]]
        now = at - np.arange(len(at))
        left = now[now > 0]
        ranks[left - 1] = self.pairs.find(ids[left - 1], ids[left])
        right = now[now < len(ids) - 1]
        ranks[right] = self.pairs.find(ids[right], ids[right + 1])
        return ids, ranks

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces and remember them."""
        raw = [p.encode() for p in pieces]
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            if (whole := self.ranks.get(b)) is not None:
                out[k] = np.array([whole], np.int32)
            elif len(b) > WIDTHS[-1]:
                out[k] = self._wide(b)
            else:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(b)), []).append(k)
        for width, members in buckets.items():
            for i in range(0, len(members), ROWS):
                part = members[i : i + ROWS]
                for k, ids in zip(part, self._matrix([raw[k] for k in part], width)):
                    out[k] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *out])
        base = len(self.seen)
        self.seen.update((p, base + k) for k, p in enumerate(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets: text k has ids[offsets[k]:offsets[k + 1]])."""
        if len(self.seen) > CACHED:
            self._forget()
        split = [self.pattern.findall(t) for t in texts]
        pieces = [p for s in split for p in s]
        if new := list(dict.fromkeys(p for p in pieces if p not in self.seen)):
            self._learn(new)
        which = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(total)]
        counts = np.cumsum([0, *map(len, split)])
        return ids, np.concatenate([[0], ends])[counts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_loaded: dict[str, ByteBpe] = {}


def encoder(vocabulary: bytes, pattern: str) -> ByteBpe:
    """One encoder a worker process for each vocabulary and pattern."""
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(vocabulary, pattern)
    return _loaded[key]


def load_vocabulary(path: str) -> bytes:
    """The rank file, read by the driver; it is broadcast, so its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return data


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row, without special tokens; the columns ``carry`` come along.

    Null and empty texts have no ids and decode to nothing. Rows are independent: repeated rows give repeated results, an
    empty table an empty result, other columns are not read. Texts of any length are encoded whole.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches):
        bpe = encoder(vocabulary.value, pattern)
        for batch in batches:
            for first, end, *_ in text_chunks(batch, 0):
                texts = [t or "" for t in batch.column(0).slice(first, end - first).to_pylist()]
                ids, offsets = bpe.encode(texts)
                listed = ids.tolist()
                back = [bpe.decode(listed[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(first, end - first) for k in places),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(back, pa.binary()),
                    ],
                    [*names, "ids", "decoded"],
                )

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    names = rows.columns[1:]
    places = range(1, len(rows.columns))
    schema = StructType([*rows.schema.fields[1:], StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})


def op3_byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
