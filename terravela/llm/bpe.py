"""Byte-level BPE encoding and decoding with numpy: length-bucketed padded matrices of distinct pieces.

Every row of a matrix is a piece of text that the pattern split off. In each round every row merges its
leftmost pair of minimum rank, found in a hash table of pairs; finished rows are compacted away. A very long piece
is a matrix of its own, folded to rows of one width, of which a round touches only those beside its merge.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.llm import textbytes as tb

_NONE = np.int64(1) << 40
#: Cells of a matrix, the bytes from which a piece makes a matrix of its own, and that matrix's width.
MATRIX_CELLS, LONG, FOLD = 1 << 19, 2048, 1024
#: Distinct pieces that a worker remembers; a larger memory is emptied, which changes no result.
REMEMBERED = 100_000


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of their merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find_one(self, left: int, right: int) -> int:
        """As find, for a single pair of ids."""
        key = (left << 32) | right
        slot = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - self.bits)
        while (seen := int(self.keys[slot])) != -1:
            if seen == key:
                return int(self.values[slot])
            slot = (slot + 1) & (len(self.keys) - 1)
        return int(_NONE)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _NONE where there is no such pair; negative ids are padding."""
        keys = np.where((left >= 0) & (right >= 0), (left << 32) | right, -2)
        slot, out = self._slot(keys), np.full(len(keys), _NONE, np.int64)
        at = np.flatnonzero(keys >= 0)
        while len(at):
            seen = self.keys[slot[at]]
            hit = seen == keys[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (seen != -1)]
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
        return out


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = read_ranks(rank_file)
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        merges = np.fromiter(chain.from_iterable(self._merges()), np.int64).reshape(-1, 3)
        self.table = PairTable((merges[:, 0] << 32) | merges[:, 1], merges[:, 2].copy())

    def _merges(self) -> Iterator[tuple[int, int, int]]:
        """(left, right, rank) for each way to make a token of two others."""
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    yield left, right, rank

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.split(t) for t in texts]
        wanted = set().union(*pieces)
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known = {}
        new = [p for p in wanted if p not in self.known]
        self.known.update(zip(new, self.merge([p.encode() for p in new])))
        return [list(chain.from_iterable(map(self.known.__getitem__, p))) for p in pieces]

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) >= LONG:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(len(piece).bit_length() * 2 + (len(piece) >> max(0, len(piece).bit_length() - 2) & 1), []).append(i)
        for rows in buckets.values():
            width = max(len(pieces[i]) for i in rows)
            most = max(1, MATRIX_CELLS // width)
            for a in range(0, len(rows), most):
                self._merge_matrix([pieces[i] for i in rows[a : a + most]], width, rows[a : a + most], out)
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int, rows: list[int], out: list) -> None:
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full_like(ids, _NONE)
        ranks[:, :-1] = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        names, columns = np.array(rows), np.arange(width + 1)
        while len(names):
            at = ranks.argmin(1)
            every = np.arange(len(names))
            best = ranks[every, at]
            over = best == _NONE
            if over.any():
                for name, row, n in zip(names[over].tolist(), ids[over].tolist(), (ids[over] >= 0).sum(1).tolist()):
                    out[name] = tuple(row[:n])
                ids, ranks, names, at, best = ids[~over], ranks[~over], names[~over], at[~over], best[~over]
                if not len(names):
                    return
                every = np.arange(len(names))
            source = np.minimum(columns + (columns > at[:, None]), width)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, _NONE
            ids[every, at] = best
            ranks[every, at] = self.table.find(best, ids[every, np.minimum(at + 1, width)])
            later = np.flatnonzero(at > 0)
            ranks[later, at[later] - 1] = self.table.find(ids[later, at[later] - 1], best[later])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """One piece folded to a matrix; merged ids keep their cells, and each row knows its minimum."""
        codes = self.byte[np.frombuffer(piece, np.uint8)]
        n = len(codes)
        ranks = np.full((-(-n // FOLD), FOLD), _NONE, np.int64)
        flat = ranks.reshape(-1)
        flat[: n - 1] = self.table.find(codes[:-1], codes[1:])
        low = ranks.min(1)
        ids, after, before = codes.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := int(low[row := int(low.argmin())])) != _NONE:
            i = row * FOLD + int(ranks[row].argmin())
            gone = after[i]
            ids[i], ids[gone], after[i] = best, -1, after[gone]
            flat[gone], flat[i], left, right = _NONE, _NONE, before[i], after[i]
            if right < n:
                before[right] = i
                flat[i] = self.table.find_one(best, ids[right])
            if left >= 0:
                flat[left] = self.table.find_one(ids[left], best)
            for k in {row, gone // FOLD, max(left, 0) // FOLD}:
                low[k] = ranks[k].min()
        return tuple(x for x in ids if x >= 0)


class Decoder:
    def __init__(self, rank_file: bytes):
        by_id = {rank: token for token, rank in read_ranks(rank_file).items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' ids one after another, and the rows' offsets in them."""
        length = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        shift = np.repeat(self.begin[ids] - ends[:-1], length)
        return self.bytes[shift + np.arange(ends[-1])], ends[offsets]


#: By maker: the value and what was made of it.
_held: dict = {}


def _once(shared, make):
    """What make builds of a broadcast's value, built once in a process; another value takes its place."""
    value = shared.value
    if make not in _held or _held[make][0] != value:
        _held[make] = value, make(value)
    return _held[make][1]


def _new_encoder(value: tuple[bytes, str]) -> Encoder:
    return Encoder(*value)


def _new_decoder(value: tuple[bytes, str]) -> Decoder:
    return Decoder(value[0])


def _share(df: DataFrame, path: str, pattern: str):
    """The rank file (under 1 MB) for all executors; it is read on the driver only."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def _encoded(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids one after another, and the rows' offsets in them."""
    ids = encoder.encode([t or "" for t in texts.to_pylist()])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])), offsets


def _listed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _decoded(decoder: Decoder, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data, at = decoder.decode(ids.astype(np.int64), offsets)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tb.short_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each match of pattern encoded separately; no special tokens.

    A null or empty text has no ids. Ids of rows may have any type, be null or repeat; other columns are ignored.
    """
    shared = _share(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(shared, _new_encoder)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _listed(*_encoded(encoder, part.column(1)))], ["doc_id", "ids"])
        encoder.known.clear()

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {tb.type_of(docs, id_col)}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded binary); a null list decodes to no bytes, an unknown id fails."""
    shared = _share(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(shared, _new_decoder)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                ids = part.column(1)
                offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(ids).fill_null(0), np.int64))])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _decoded(decoder, ids.flatten().to_numpy(zero_copy_only=False), offsets)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {tb.type_of(encoded, 'doc_id')}, ids array<int>, decoded binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode of bpe_encode in one pass of one worker: (doc_id, ids, decoded)."""
    shared = _share(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _once(shared, _new_encoder), _once(shared, _new_decoder)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                ids, offsets = _encoded(encoder, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), _listed(ids, offsets), _decoded(decoder, ids, offsets)], ["doc_id", "ids", "decoded"])
        encoder.known.clear()

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {tb.type_of(docs, id_col)}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
