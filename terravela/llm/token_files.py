"""Token ids as Parquet files: list columns encoded by dictionary, counts and places by delta, row groups and page indexes of a stated size.

A file holds part (its place among the files), doc_id, start (ids of this file before the document), n_tokens and ids.
Documents stand in ascending order of their ids, so that row groups and pages have narrow ranges of doc_id: readers of
some documents fetch their pages only, and readers of counts and places never touch the ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravela.llm import textbytes as tb
from terravela.plans.lineage import broadcast_below, fresh_dir

#: Words whose ids a worker remembers; beyond that it forgets those that the texts at hand don't hold.
REMEMBERED = 500_000
#: Files whose places may be broadcast, a few MB.
BROADCAST_FILES = 250_000
SLICE_BYTES = 4 << 20
#: Words or texts that the library is given at once; what it returns for each is far larger than its ids.
ENCODED = 5_000

# Bytes by what stands beside a cut: spaces go, and a cut lies between a letter or digit and a mark. Apostrophes begin contractions, so that no cut touches them.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _MARK
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = _LETTER
_KIND[[ord(c) for c in " \t\n\v\f\r"]] = _SPACE
_KIND[ord("'")] = _OTHER


def _plain_words(config: dict) -> bool:
    """Whether a tokenizer drops spaces and never joins a letter or digit and a mark, so that words may be encoded one by one."""
    normal = (config.get("normalizer") or {}).get("normalizers", [])
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " " and len(steps) == 2 and steps[0].get("pattern") == {"Regex": split} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and not config.get("post_processor")


class WordEncoder:
    """A tokenizer of the tokenizers library that meets each distinct word once.

    Texts are cut at spaces and between ASCII letters or digits and ASCII marks, where no token of a word-wise tokenizer can
    cross; a text that holds a special token's own words, or any text under another kind of tokenizer, is encoded whole.
    """

    def __init__(self, config: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        held = json.loads(config)
        self.tokenizer, self.by_word = Tokenizer.from_str(config), _plain_words(held)
        self.special = [t["content"].lower().encode() for t in held.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.length, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def _keep(self, words: list[bytes], entries: np.ndarray) -> None:
        """Forget all words but these."""
        n = self.length[entries]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.pool = self.pool[np.repeat(self.begin[entries] - ends[:-1], n) + np.arange(ends[-1])]
        self.begin, self.length, self.used = ends[:-1], n, int(ends[-1])
        self.known = dict(zip(words, range(len(words))))

    def _learn(self, new: list[bytes]) -> None:
        ids = self._whole([w.decode() for w in new])
        first, n = len(self.known), np.fromiter(map(len, ids), np.int64, len(ids))
        grown = lambda a, size: a if len(a) >= size else np.concatenate([a, np.zeros(max(size - len(a), len(a)), a.dtype)])
        self.begin, self.length = grown(self.begin, first + len(n)), grown(self.length, first + len(n))
        self.pool = grown(self.pool, self.used + int(n.sum()))
        self.length[first : first + len(n)] = n
        self.begin[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.pool[self.used : self.used + int(n.sum())] = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        self.used += int(n.sum())
        self.known.update(zip(new, range(first, first + len(new))))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), ENCODED) for e in self.tokenizer.encode_batch_fast(texts[i : i + ENCODED], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another (null: empty), and the n + 1 offsets of the texts in them."""
        data, offsets = tb.utf8(texts)
        lowered = tb.lower_ascii(data)
        raw = lowered.tobytes()
        if self.by_word and not any(s in raw for s in self.special):
            return self._by_word(lowered, offsets)
        parts = []
        for k, text in enumerate(texts):
            a, b = int(offsets[k]), int(offsets[k + 1])
            if self.by_word and not any(s in raw[a:b] for s in self.special):
                parts.append(self._by_word(lowered[a:b], np.array([0, b - a]))[0])
            else:
                parts.append(np.array(self._whole([text.as_py() or ""])[0], np.int32))
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _by_word(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[data]
        # The Latin-1 letters, two bytes from C3 80 to C3 BF but for the signs 97 and B7, end and begin words like ASCII ones.
        pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[pair], kind[pair + 1] = _LETTER, _LETTER
        inside = kind != _SPACE
        cut = np.ones(len(data) + 1, bool)
        before, after = kind[:-1], kind[1:]
        cut[1:-1] = (before == _SPACE) | (before == _LETTER) & (after == _MARK) | (before == _MARK) & (after == _LETTER)
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1] & inside)
        place = np.zeros(len(data) + 1, np.int32)
        np.cumsum(inside, out=place[1:])
        edges = np.append(place[start], place[-1])
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
        values = words.dictionary.to_pylist()
        found = list(map(self.known.get, values))
        if None in found:
            missing = [w for w, k in zip(values, found) if k is None]
            if len(self.known) + len(missing) > REMEMBERED:
                self._keep([w for w, k in zip(values, found) if k is not None], np.array([k for k in found if k is not None], np.int64))
            self._learn(missing)
            found = list(map(self.known.get, values))
        entry = np.array(found, np.int64)[words.indices.to_numpy(zero_copy_only=False)] if found else np.zeros(0, np.int64)
        n = self.length[entry]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.begin[entry] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(start, offsets)]


_encoders: dict[str, WordEncoder] = {}


def _encoder(config: str) -> WordEncoder:
    """The encoder of a file, built once in a process; another file takes its place."""
    if config not in _encoders:
        _encoders.clear()
        _encoders[config] = WordEncoder(config)
    return _encoders[config]


def _closed(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with end_id after them."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text without special tokens, add end_id, and write files below path, in ascending order of ids.

    tokenizer names a file of the tokenizers library, read on the driver. A null or empty text has the end id alone. Null ids
    come first; rows of one id follow by a hash of their text, and equal rows are interchangeable, so that a hot id
    is split over files. Ids of rows may have any type that can be ordered; other columns are ignored. An empty table writes
    files without rows. ids are dictionary-encoded; part, start, n_tokens (and doc_id, if it is a number) by delta.
    Files are Spark's own, written with its commit protocol.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The last key splits equal rows; it moves none past another text.
    keyed = placed.select("*", F.xxhash64("text").alias("place"), F.monotonically_increasing_id().alias("salt"))
    ordered = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "place", "salt").sortWithinPartitions(F.asc_nulls_first("doc_id"), "place", "salt").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, so_far = _encoder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in tb.slices(batch, "text", SLICE_BYTES):
                ids, offsets = _closed(*encoder.encode(piece.column(1)), end_id)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), piece.column(0), pa.array(offsets[:-1] + so_far), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )
                so_far += int(offsets[-1])

    rows = ordered.mapInArrow(run, f"part int, doc_id {tb.type_of(placed, 'doc_id')}, start long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true"}
    rows.write.options(**options).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, first_id, last_id, n_docs, base, n_tokens) of each file with rows; base counts the ids of all files before it. Reads no ids."""
    files = spark.read.parquet(path).groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.select("part", "first_id", "last_id", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_tokens")


def _based(rows: DataFrame, path: str) -> DataFrame:
    """rows of the files with start counted from the first file's beginning."""
    base = broadcast_below(token_index(rows.sparkSession, path).select("part", "base"), BROADCAST_FILES)
    return rows.join(base, "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files' documents; start counts the ids of all documents before. where, on doc_id, prunes row groups and pages."""
    rows = spark.read.parquet(path)
    return _based(rows if where is None else rows.where(where), path)


def read_places(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens), as read_tokens without fetching ids."""
    return read_tokens(spark, path, where).drop("ids")


def token_window(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, ids): the ids from place first up to, not including, last of all documents one after another.

    The index names the files and the places in them; only pages whose documents meet the window are read.
    """
    index = token_index(spark, path).where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first))
    parts = [(r["part"], r["base"], r["n_tokens"]) for r in index.agg(F.min("part").alias("a"), F.max("part").alias("b")).join(index, (F.col("part") == F.col("a")) | (F.col("part") == F.col("b"))).select("part", "base", "n_tokens").collect()]  # two files at most
    rows = spark.read.parquet(path)
    if not parts or first >= last:
        return _based(rows.where("false"), path).select("doc_id", "start", "ids")
    (low, base, _), (high, end_base, _) = min(parts), max(parts)
    inside = F.col("part").between(low, high) & ((F.col("part") > low) | (F.col("start") + F.col("n_tokens") > first - base)) & ((F.col("part") < high) | (F.col("start") < last - end_base))
    found = _based(rows.where(inside), path)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    kept = F.least(F.col("n_tokens"), F.lit(last) - F.col("start")) - skip
    return found.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), kept.cast("int")).alias("ids"))


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files: the unsigned CRC-32 of a document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            n = np.asarray(pc.list_value_length(lists), np.int64)
            ends = (4 * np.cumsum(n)).tolist()
            crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip([0, *ends], ends)), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc)], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("part", "doc_id", "start", "ids")
    return _based(rows.mapInArrow(run, f"part int, doc_id {tb.type_of(rows, 'doc_id')}, start long, n_tokens long, ids_crc32 long"), path)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """token_checksums of files that write_token_files has written in the shared folder."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    return token_checksums(spark, path)
