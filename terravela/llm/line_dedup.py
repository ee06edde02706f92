"""Line dedup: a segment-partition edit join of the distinct lines, and the classes of lines it makes.

For a threshold of t edits a line is split into t + 1 segments, of which any line within t edits holds one
unchanged. Every line is indexed by its segments under (length, segment number, text), and probes the index with
the substrings of a line of its length or up to t longer that an alignment can put there. Pairs that meet are
compared by a bit-parallel edit distance over a band of 2t + 1 diagonals, for all pairs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.llm import textbytes as tb
from terravela.plans.graph import connected_components
from terravela.plans.lineage import broadcast_below, cut

#: Keys of lines that may be broadcast, about 16 MB; beyond that the join shuffles.
BROADCAST_ROWS = 500_000
#: Groups of a seed beyond this size are compared by equal parts of their signatures instead of all against all.
DENSE = 2048
#: Cells of the matrices in which a batch of pairs is compared.
BLOCK_CELLS = 1 << 19
_U = np.uint64


def line_key(line: str) -> int:
    """The 64-bit key of a line, equal to Spark's xxhash64 of it."""
    return _signed(xxhash.xxh64_intdigest(line.encode(), seed=42))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def placements(length: np.ndarray, edits: int, min_chars: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, int]]:
    """For lines of these lengths, which substrings to put out: (lines, indexed length, segment, start, size, role).

    A line of n characters has edits + 1 segments whose sizes differ by one at most, longer ones last. It is indexed
    (role 2) by its own, and probes (role 1; 3 for both) for lines of n - edits to n characters. A segment with i
    segments to its left and edits - i to its right needs looking for only where at most that many edits fall on
    each side; otherwise another segment finds the pair.
    """
    for gap in range(edits + 1):
        shorter = length - gap
        base, longer = np.divmod(shorter, edits + 1)
        for i in range(edits + 1):
            size = base + (i >= edits + 1 - longer)
            at = i * base + np.maximum(0, i - (edits + 1 - longer))
            for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1):
                start = at + shift
                fit = np.flatnonzero((start >= 0) & (start + size <= length) & (shorter >= max(min_chars, edits + 1)))
                yield fit, shorter[fit], i, start[fit], size[fit], 3 if not gap and not shift else 1


def _seeds(edits: int, min_chars: int):
    """Rows (seed, key, signature, role): role 1 probes, 2 is indexed, 3 both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text"):
                lines = [x for x in {line for text in part.column(1).to_pylist() if text for line in text.split("\n")} if len(x) >= min_chars and x.strip(" ")]
                if not lines:
                    continue
                key = np.array([line_key(x) for x in lines], np.int64)
                codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
                length = np.array([len(x) for x in lines])
                begin = np.cumsum(length) - length
                # A parity bit for each class of characters: an edit flips two bits at most.
                bit = _U(1) << ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(_U)
                signature = np.bitwise_xor.reduceat(bit, begin).view(np.int64)
                spans = tb.SpanHash(codes)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for rows, shorter, i, start, size, role in placements(length, edits, min_chars):
                    first = begin[rows] + start
                    seed = tb.mix(spans.of(first, first + size) ^ tb.mix((shorter * 64 + i).astype(_U)))
                    out[0].append(seed.view(np.int64))
                    out[1].append(key[rows])
                    out[2].append(signature[rows])
                    out[3].append(np.full(len(rows), role, np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["seed", "key", "signature", "role"])

    return run


def _close(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(_U)) <= 2 * edits


def _meet(key: np.ndarray, signature: np.ndarray, role: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a seed's lines, one indexed and one probing, whose signatures allow `edits` edits."""
    probe, index = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if len(probe) * len(index) <= DENSE * DENSE:
        groups = [(probe, index)] if len(probe) and len(index) else []
    else:  # one of 2 * edits + 1 parts of the signatures is equal
        groups, parts = [], 2 * edits + 1
        for p in range(parts):
            low, high = 64 * p // parts, 64 * (p + 1) // parts
            value = (signature.view(_U) >> _U(low)) & ((_U(1) << _U(high - low)) - _U(1))
            shared = np.intersect1d(value[probe], value[index])
            by_probe, by_index = probe[np.argsort(value[probe], kind="stable")], index[np.argsort(value[index], kind="stable")]
            for v in shared:
                groups.append(tuple(x[np.searchsorted(value[x], v) : np.searchsorted(value[x], v, side="right")] for x in (by_probe, by_index)))
    for left, right in groups:
        for i in range(0, len(left), max(1, (1 << 20) // len(right))):
            rows = left[i : i + max(1, (1 << 20) // len(right))]
            x, y = np.nonzero(_close(signature[rows][:, None], signature[right][None, :], edits) & (key[rows][:, None] != key[right][None, :]))
            if len(x):
                yield key[rows[x]], key[right[y]]


def _pairs(edits: int):
    """Over seeds sorted by seed: the distinct pairs (a < b) that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            last = np.searchsorted(columns[0], columns[0][-1])
            yield from settle([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield from settle(held)

    def settle(columns):
        seed, key, signature, role = columns
        if not len(seed):
            return
        at = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        end = np.append(at[1:], len(seed))
        big = end - at > 1
        lefts, rights = [], []
        two = big & (end - at == 2)
        i = at[two]
        good = (key[i] != key[i + 1]) & _close(signature[i], signature[i + 1], edits) & (((role[i] & 1) & (role[i + 1] >> 1)) | ((role[i + 1] & 1) & (role[i] >> 1))).astype(bool)
        lefts.append(key[i[good]])
        rights.append(key[i[good] + 1])
        for a, b in zip(at[big & ~two].tolist(), end[big & ~two].tolist()):
            own, first = np.unique(np.stack([key[a:b], role[a:b]]), axis=1, return_index=True)
            if (own[0] == own[0][0]).all():
                continue
            for x, y in _meet(own[0], signature[a:b][first], own[1].astype(np.int8), edits):
                lefts.append(x)
                rights.append(y)
        x, y = np.concatenate(lefts), np.concatenate(rights)
        if len(x):
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def _trimmed(x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of two lines without the beginning and then the end that they share; the distance stays."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n -= head
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def banded_distance(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Edit distances of the pairs, exact up to `edits` and greater beyond, a column of all pairs at a time.

    Bit k of a pair's vectors stands for the row that lies k - edits below the diagonal; a step to the next
    column moves the band down a row. The distance is carried along the band's lowest diagonal.
    """
    codes = [_trimmed(x, y) for x, y in zip(left, right)]
    la, lb = np.array([len(x) for x, _ in codes], np.int64), np.array([len(y) for _, y in codes], np.int64)
    out = np.full(len(left), edits + 1)
    width = 2 * edits + 1
    mask = _U((1 << width) - 1)
    todo = np.flatnonzero(abs(la - lb) <= edits)
    todo = todo[np.argsort(lb[todo], kind="stable")]
    while len(todo):
        # The longest pairs first, as many as fill a block of cells together.
        columns = int(lb[todo[-1]])
        some = todo[-max(1, BLOCK_CELLS // (columns + 3 * edits + 2)) :]
        todo = todo[: len(todo) - len(some)]
        a = np.full((len(some), columns + 3 * edits + 2), -1, np.int64)
        b = np.full((len(some), columns), -2, np.int64)
        for i, k in enumerate(some.tolist()):
            a[i, edits : edits + la[k]], b[i, : lb[k]] = codes[k]
        vp = np.full(len(some), _U(((1 << width) - 1) ^ ((1 << edits) - 1)))
        vn = np.zeros(len(some), _U)
        low = np.full(len(some), edits)
        weight = _U(1) << np.arange(width, dtype=_U)
        for j in range(columns):
            live = j < lb[some]
            equal = ((a[:, j : j + width] == b[:, j : j + 1]) * weight).sum(1, dtype=_U)
            d0 = ((((equal & vp) + vp) ^ vp) | equal | vn) & mask
            hp = (vn | ~(d0 | vp)) & mask
            hn = d0 & vp
            down = d0 >> _U(1)
            low = np.where(live, low + 1 - (d0 >> _U(width - 1)).astype(np.int64), low)
            vp = np.where(live, (hn | ~(down | hp)) & mask, vp)
            vn = np.where(live, down & hp, vn)
        for k in range(width - 1):
            above = k >= la[some] - lb[some] + edits
            low = low - np.where(above, ((vp >> _U(k)) & _U(1)).astype(np.int64) - ((vn >> _U(k)) & _U(1)).astype(np.int64), 0)
        out[some] = np.minimum(low, edits + 1)
    return out


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(banded_distance(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits) <= edits)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def near_lines(docs: DataFrame, edits: int = 2, min_chars: int | None = None) -> DataFrame:
    """docs(text) -> (a, b): keys of different lines of min_chars (edits + 1 by default) or more within `edits` edits of one another."""
    min_chars = max(min_chars or 0, edits + 1)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = docs.select(F.lit(0).alias("_"), "text").mapInArrow(_seeds(edits, min_chars), "seed long, key long, signature long, role byte")
    pairs = seeds.repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(_pairs(edits), "a long, b long").distinct()
    pairs = cut(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= min_chars).withColumn("key", F.xxhash64("line"))
    lines = cut(lines.join(broadcast_below(keys, BROADCAST_ROWS), "key", "left_semi").groupBy("key").agg(F.first("line").alias("line")))
    a, b = lines.select(F.col("key").alias("a"), F.col("line").alias("line_a")), lines.select(F.col("key").alias("b"), F.col("line").alias("line_b"))
    return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "line_a", "line_b").mapInArrow(_verified(edits), "a long, b long"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int | None = None) -> DataFrame:
    """(doc_id, line_no, n_chars, class_doc_id, class_line_no, n_links, kept): one row for each line that isn't blank.

    Lines end at \\n and count from 0. A class holds equal lines and, transitively, lines of min_chars or more
    within `edits` edits; shorter lines only have equal ones. min_chars is edits + 1 by default and at least, as a
    line needs a character for each segment. Its first line, by (doc_id, line_no) with a null id
    first, is kept and named in all its rows. n_links counts the different texts within `edits` edits of the
    line. Null and empty texts have no rows; rows of docs with equal ids have their lines ranked together.
    Two lines that share a 64-bit key would count as equal. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    links = near_lines(docs, edits, min_chars)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(F.trim("line")) > 0)
    lines = lines.select("doc_id", "line_no", F.length("line").alias("n_chars"), F.xxhash64("line").alias("key"))
    roots = connected_components(links)
    counts = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    firsts = lines.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    known = firsts.join(roots.withColumnRenamed("node", "key"), "key", "left").where("n > 1 OR root IS NOT NULL").select("key", "first", F.coalesce("root", "key").alias("root"))
    leads = known.groupBy("root").agg(F.min("first").alias("lead"))
    named = known.select("key", "root").join(leads, "root").join(counts, "key", "left").select("key", "lead", "n_links")
    joined = lines.join(named, "key", "left")
    own = F.struct("doc_id", "line_no")
    lead = F.coalesce("lead", own)
    return joined.select("doc_id", "line_no", "n_chars", lead["doc_id"].alias("class_doc_id"), lead["line_no"].alias("class_line_no"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.col("doc_id").eqNullSafe(lead["doc_id"]) & (F.col("line_no") == lead["line_no"])).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each text reduced to its blank lines and the lines that line_classes keeps; fails if ids are null or repeat."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if bad := ids.where("id IS NULL OR n > 1").limit(1).collect():
        raise ValueError(f"the id {bad[0]['id']} is null or not unique")
    gone = line_classes(docs, id_col, text_col, **options).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    gone = cut(gone)
    joined = docs.join(gone, docs[id_col] == gone["doc_id"], "left")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda line, i: ~F.array_contains(gone["_gone"], i)), "\n")
    text = F.when(gone["_gone"].isNull(), docs[text_col]).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
