"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, bounded by sizes.

The product's entry for two documents is the number of n-grams they share. Entries that a size-derived
bound excludes are never accumulated, in four steps that all keep every link:

1. Documents with equal n-gram sets are one row of the incidence, held as a 64-bit key of the set.
2. In hash order, the first n - t + m n-grams of two linked documents share m or more of them (t: the least
   overlap that a link needs). One pass over those columns, combined per slice of rows before it is
   shuffled, keeps the rows with enough shared columns. Most rows end here.
3. For the rows kept, columns are ordered by frequency. Only entries that share one of the first n - t + 1
   columns of both rows can reach the bound, t now the overlap that the two sizes need and columns of one row
   left out. Of each such column and size class, first the entries with its most central row are accumulated;
   that joins a large group of near copies with about as many entries as it has rows.
   Columns that hold more than their share of the entries are dealt over several tasks.
4. Then all entries between rows that step 3 left in different components are accumulated.

Overlaps are counted exactly, over whole n-gram sets. Hashes have 64 bits: among n distinct n-grams of two
documents an overlap is wrong with a chance of about n**2 / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravela.llm import textbytes as tb
from terravela.plans.graph import connected_components
from terravela.plans.lineage import broadcast_below, cut

#: Rows of (doc_id) that may be broadcast, about 16 MB; beyond that the join shuffles.
BROADCAST_ROWS = 250_000


def _need(n, percent: int):
    """The least overlap that any link of a set of n n-grams has."""
    return (percent * n + 99) // 100


def _margin(n):
    return n // 10 + 1


def _incidence(batch: pa.RecordBatch, k: int):
    """Of a slice: rows and hashes of its incidence, each row's set size and its set's key."""
    data, offsets = tb.utf8(batch.column(1))
    low = tb.lower_ascii(data)
    start, end, row = tb.words(low, offsets)
    r, h = tb.shingles(tb.word_hashes(low, start, end), row, batch.num_rows, k)
    n = np.bincount(r, minlength=batch.num_rows)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(h))])
    begin = np.concatenate([[0], np.cumsum(n)])
    key = tb.mix((sums[begin[1:]] - sums[begin[:-1]]) + n.astype(np.uint64)).view(np.int64)
    key[key == 0] = 1
    return r, h, n, key, begin


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text"):
                _, _, n, key, _ = _incidence(part, k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, mask=n == 0)], ["doc_id", "n", "node"])

    return run


def _prefix_postings(k: int, percent: int):
    """(hash, node): one row for a column and a slice, node 0 where the slice has several nodes there;
    and (node, n, shared), the columns already seen to be shared within the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text"):
                r, h, n, key, begin = _incidence(part, k)
                _, first = np.unique(key, return_index=True)
                own = np.zeros(len(n), bool)
                own[first] = True
                own &= n > 0
                prefix = n - _need(n, percent) + _margin(n)
                take = (np.arange(len(r)) - begin[r] < prefix[r]) & own[r]
                r, h = r[take], h[take]
                order = np.argsort(h, kind="stable")
                r, h = r[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                at = np.flatnonzero(new)
                several = np.diff(np.append(at, len(h))) > 1
                local = np.bincount(r[np.repeat(several, np.diff(np.append(at, len(h))))], minlength=len(n))[own]
                node = np.where(several, 0, key[r[at]])
                m = int(own.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h[at].view(np.int64), key[own]])), pa.array(np.concatenate([node, key[own]])), pa.array(np.concatenate([np.zeros(len(at), np.int64), n[own]])), pa.array(np.concatenate([np.zeros(len(at), np.int64), local]))],
                    ["hash", "node", "n", "shared"],
                )

    return run


def _shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over postings sorted by hash: for each node, how many of its columns have another node."""

    def out(node, n, shared):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(shared)], ["node", "n", "shared"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def settle(h, node):
        if not len(h):
            return None
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(at, len(h)))
        low, high = np.minimum.reduceat(node, at), np.maximum.reduceat(node, at)
        several = np.logical_or.reduceat(node == 0, at) | (low != high)
        hit = node[np.repeat(several, length) & (node != 0)]
        nodes, counts = np.unique(hit, return_counts=True)
        return out(nodes, np.zeros(len(nodes), np.int64), counts.astype(np.int64)) if len(nodes) else None

    for batch in batches:
        h, node, n, shared = (c.to_numpy() for c in batch.columns)
        own = n > 0
        if own.any():
            yield out(node[own], n[own], shared[own])
        h, node = np.concatenate([held[0], h[~own]]), np.concatenate([held[1], node[~own]])
        if len(h):
            last = np.searchsorted(h, h[-1])
            if (done := settle(h[:last], node[:last])) is not None:
                yield done
            held = h[last:], node[last:]
    if (done := settle(*held)) is not None:
        yield done


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text"):
                _, h, n, key, begin = _incidence(part, k)
                raw = [h[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["node", "n", "grams"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The incidence of the rows kept, an entry a row; grams are sorted as unsigned numbers."""
    for batch in batches:
        node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        h = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(node, n)), pa.array(np.repeat(n, n))], ["hash", "node", "n"])


def _salts(counted: DataFrame, total: int) -> DataFrame:
    """(hash, salts): into how many parts to deal the columns that hold over a quarter of a fair task's entries.

    counted(hash, held) has a column's entries of total. There are fewer such columns than four times the shuffle
    partitions, whatever the input, so that the result may be broadcast.
    """
    parts = 4 * int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counted.where(F.col("held") * parts > total).select("hash", F.ceil(F.col("held") * parts / F.lit(max(total, 1))).cast("int").alias("salts"))
    return F.broadcast(cut(hot))


def _dealt(entries: DataFrame, salts: DataFrame) -> DataFrame:
    """entries(hash, node, ...) with a salt: the part of its column that an entry is in."""
    return entries.join(salts, "hash", "left").withColumn("salt", F.pmod(F.hash("node"), F.coalesce("salts", F.lit(1)))).drop("salts")


def _to_all(rows: DataFrame, salts: DataFrame) -> DataFrame:
    """rows(hash, ...) once for each part of their column."""
    return rows.join(salts, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def _overlaps(percent: int, block: int = 1 << 20):
    """Accumulate the product's entries for blocks of row pairs, and keep the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            ga, gb = batch.column(4), batch.column(5)
            cut_at = np.flatnonzero(np.diff((np.cumsum(na + nb) - 1) // block)) + 1
            for i, j in zip([0, *cut_at.tolist()], [*cut_at.tolist(), len(a)]):
                left = np.frombuffer(b"".join(ga.slice(i, j - i).to_pylist()), np.uint64)
                right = np.frombuffer(b"".join(gb.slice(i, j - i).to_pylist()), np.uint64)
                pair = np.concatenate([np.repeat(np.arange(j - i), na[i:j]), np.repeat(np.arange(j - i), nb[i:j])])
                gram = np.concatenate([left, right])
                order = np.lexsort((gram, pair))
                pair, gram = pair[order], gram[order]
                both = (pair[1:] == pair[:-1]) & (gram[1:] == gram[:-1])
                overlap = np.bincount(pair[1:][both], minlength=j - i)
                keep = 100 * overlap >= percent * (na[i:j] + nb[i:j] - overlap)
                yield pa.RecordBatch.from_arrays([pa.array(a[i:j][keep]), pa.array(b[i:j][keep])], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Documents linked by a word n-gram Jaccard similarity of `percent` or more, as components.

    Returns (doc_id, n_shingles, component_id, linked), one row for each input row. Text is lower-cased in A-Z;
    words are runs of characters other than ASCII white space; fewer than `words` words make one n-gram.
    A null, empty or blank text has no n-grams and no links. component_id is the smallest non-null id
    reachable, null only where no document of the component has an id. Ids may have any orderable type; repeated ones are separate
    documents that happen to share an id. Other columns of docs are ignored, whatever their names.
    """
    docs = tb.short_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signatures = cut(docs.mapInArrow(_signatures(words), f"doc_id {tb.type_of(docs, 'doc_id')}, n long, node long"))

    postings = docs.mapInArrow(_prefix_postings(words, percent), "hash long, node long, n long, shared long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = postings.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(_shared_columns, "node long, n long, shared long")
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    kept = shared.groupBy("node").agg(F.max("n").alias("n"), F.sum("shared").alias("shared")).where(F.col("shared") >= F.floor(need / 10) + 1)
    first = signatures.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    kept = cut(kept.select("node").join(first, "node"))

    picked = docs.join(broadcast_below(kept.select(F.col("first_id").alias("doc_id")).distinct(), BROADCAST_ROWS), "doc_id", "left_semi")
    nameless = docs.where("doc_id IS NULL")
    sets = picked.unionByName(nameless).mapInArrow(_sets(words), "node long, n long, grams binary")
    sets = cut(sets.join(kept.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    entries = sets.mapInArrow(_entries, "hash long, node long, n long")
    frequent = cut(entries.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    salts = _salts(frequent.withColumnRenamed("df", "held"), frequent.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    by_node = Window.partitionBy("node")
    ranked = _dealt(entries, salts).join(_to_all(frequent, salts), ["hash", "salt"]).withColumns({"rank": F.row_number().over(by_node.orderBy("df", "hash")), "m": F.count(F.lit(1)).over(by_node), "centre": F.sum(F.log2("df")).over(by_node) / F.col("n")})
    prefix = cut(ranked.where(F.col("rank") <= F.col("m") - need + 1).select("hash", "node", "n", "m", "rank", "centre"))
    salts = _salts(prefix.groupBy("hash").agg(F.count(F.lit(1)).alias("held")), prefix.count())
    prefix = _dealt(prefix, salts)

    # The first common column of a linked pair is among the first m - overlap + 1 shared columns of either.
    overlap = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent) - 1e-9)
    fits = (F.col("rank_a") + overlap <= F.col("ma") + 1) & (F.col("rank_b") + overlap <= F.col("mb") + 1) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("hash", *[c for c in ("salt", "size", "root") if c in df.columns], F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"), F.col("rank").alias(f"rank_{x}")).withColumnsRenamed({"root": f"r{x}"})

    def linked(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
        b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_overlaps(percent), "a long, b long"))

    sized = prefix.withColumn("size", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int"))
    head = sized.groupBy("hash", "size").agg(F.max(F.struct("centre", "node", "n", "m", "rank")).alias("h")).select("hash", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "h.*")
    star = side(sized, "b").join(side(_to_all(head, salts), "a"), ["hash", "salt", "size"]).where((F.col("a") != F.col("b")) & fits)
    near = linked(star.select("a", "b", "na", "nb").distinct())
    roots = connected_components(near)

    placed = cut(prefix.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    top = placed.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("held")).groupBy("hash").agg(F.max(F.struct("held", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    top = _to_all(top.select("hash", F.col("top.root").alias("top")), salts)
    outside = placed.join(top, ["hash", "salt"]).where("root <> top").drop("salt")
    rest = side(_to_all(outside, salts), "a").join(side(placed, "b"), ["hash", "salt"]).where((F.col("ra") != F.col("rb")) & fits)
    bridges = linked(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct())
    if bridges.limit(1).count():
        roots = connected_components(near.unionByName(bridges))

    groups = first.join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    lowest = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = groups.select("node", "root").join(lowest, "root").select("node", "component_id")
    return signatures.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("component_id").isNotNull()).alias("linked")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, that with the smallest id; all columns stay. Rows without an id stay."""
    gone = jaccard_components(docs, id_col, text_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = broadcast_below(cut(gone), BROADCAST_ROWS)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
