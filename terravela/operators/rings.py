"""Outlines of labelled blocks: edges are chained within blocks, and only the chains that cross a block's border are followed as rows.

A ring runs along cell edges with its label on the left and turns left where two rings of a label touch. It is named by its
smallest edge, (row * (width + 1) + col) * 4 + side of the edge's first corner, and begins there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.functions.geometry import signed_area
from terravela.operators.blocks import _STRIPS, BLOCK, _grouped, _padded, _strips, array
from terravela.operators.grid import GridMeta
from terravela.plans.lineage import stored

#: Sides of a cell as (way along the edge, first corner from the cell's upper left one): north westwards, south eastwards, west southwards, east northwards.
SIDES = (((0, -1), (0, 1)), ((0, 1), (1, 0)), ((1, 0), (0, 0)), ((-1, 0), (1, 1)))
_SIDE_OF = {way: k for k, (way, _) in enumerate(SIDES)}


def _left(way: tuple[int, int]) -> tuple[int, int]:
    return -way[1], way[0]


def _edges(labels: np.ndarray, corner: tuple[int, int], width: int) -> dict[str, np.ndarray]:
    """The edges of a block's own cells: id, label, the place of the next edge in the block's frame of cells, its id, and whether the outline turns where the edge begins."""
    size = labels.shape[0] - 2
    own = labels[1:-1, 1:-1]
    at = lambda dr, dc: labels[1 + dr : 1 + dr + size, 1 + dc : 1 + dc + size] if -1 <= dr <= 1 and -1 <= dc <= 1 else None
    parts = []
    for side, (way, first) in enumerate(SIDES):
        left = _left(way)
        right = (-left[0], -left[1])
        there = (own >= 0) & (at(*right) != own)
        r, c = np.nonzero(there)
        same = lambda dr, dc: (at(dr, dc) == own)[r, c]
        ahead, beyond = same(*way), same(way[0] + right[0], way[1] + right[1])
        behind, across = same(-way[0], -way[1]), same(right[0] - way[0], right[1] - way[1])
        # Around the own cell if the cell ahead is another's, else straight on along that one, else round the one beyond.
        turn = (-right[0], -right[1]), way, right
        pick = np.where(~ahead, 0, np.where(~beyond, 1, 2))
        move = np.array([(0, 0), way, (way[0] + right[0], way[1] + right[1])])[pick]
        side2 = np.array([_SIDE_OF[t] for t in turn])[pick]
        r2, c2 = r + move[:, 0], c + move[:, 1]
        begin = np.array([f for _, f in SIDES])[side2]
        name = lambda rr, cc, ss, ff: ((rr + corner[0] + ff[..., 0]).astype(np.int64) * (width + 1) + cc + corner[1] + ff[..., 1]) * 4 + ss
        parts.append({
            "id": name(r, c, side, np.array(first)), "label": own[r, c], "place": (r * size + c) * 4 + side, "next": name(r2, c2, side2, begin),
            "next_place": np.where((r2 >= 0) & (r2 < size) & (c2 >= 0) & (c2 < size), (r2 * size + c2) * 4 + side2, -1), "corner": ~(behind & ~across), "r": r + corner[0] + first[0], "c": c + corner[1] + first[1],
        })
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _chains(br: int, bc: int, labels: np.ndarray, size: int, width: int) -> list[dict]:
    """The chains of a block's edges: closed ones have no next edge, others run from an edge that is entered to the one that leaves."""
    e = _edges(labels, (br * size, bc * size), width)
    n = len(e["id"])
    if not n:
        return []
    index = np.full(size * size * 4, -1)
    index[e["place"]] = np.arange(n)
    onward = np.where(e["next_place"] >= 0, index[e["next_place"]], -1)
    entered = np.ones(n, bool)
    entered[onward[onward >= 0]] = False
    follow, seen, found = onward.tolist(), bytearray(n), []
    for start in np.flatnonzero(entered).tolist() + np.arange(n).tolist():
        if seen[start]:
            continue
        chain, k = [], start
        while k >= 0 and not seen[k]:
            seen[k] = 1
            chain.append(k)
            k = follow[k]
        chain = np.array(chain)
        low = int(e["id"][chain].argmin())
        if k >= 0:  # closed: begin at the smallest edge
            chain, low = np.roll(chain, -low), 0
        turns = np.flatnonzero(e["corner"][chain])
        found.append({"label": int(e["label"][chain[0]]), "first": int(e["id"][chain[0]]), "next": int(e["next"][chain[-1]]) if k < 0 else None, "low": int(e["id"][chain[low]]), "to_low": low, "n": len(chain), "at": turns.tolist(), "r": e["r"][chain[turns]].tolist(), "c": e["c"][chain[turns]].tolist()})
    return found


def outline_blocks(blocks: DataFrame, meta: GridMeta, size: int = BLOCK) -> DataFrame:
    """blocks(br, bc, label) -> (label, ring, signed_area, n_corners, points): the rings around the cells of each label (-1: none).

    Rings within a block are closed there. Of the others each round doubles the chains over which a chain knows the
    smallest edge ahead and how far it is; only a ring's own corners are gathered.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for br, bc, data in pdf[["br", "bc", "label"]].itertuples(index=False):
                grid = array(data, "label", size).astype(np.float64)
                grid[grid < 0] = np.nan
                found += [(br, bc, -1, grid.tobytes()), *_strips(br, bc, grid[None])]
            yield pd.DataFrame(found, columns=["br", "bc", "side", "data"])

    def chain(br: int, bc: int, own: bytes, sides: dict) -> list[dict]:
        padded = _padded(np.frombuffer(own, "<f8").reshape(1, size, size), sides)[0]
        return _chains(br, bc, np.where(np.isnan(padded), -1, padded).astype(np.int64), size, meta.width)

    shape = "label long, first long, next long, low long, to_low long, n long, at array<long>, r array<long>, c array<long>"
    chains = stored(_grouped(blocks.select("br", "bc", "label").mapInPandas(spread, _STRIPS), chain, shape))
    open_ = chains.where("next IS NOT NULL")
    ahead = chains.where("next IS NULL").withColumnRenamed("low", "ring")
    if open_.limit(1).count():
        state = stored(open_.select("first", F.col("next").alias("ptr"), "low", "to_low", F.col("n").alias("span")))
        while True:
            there = state.select(F.col("first").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"), F.col("to_low").alias("to_low2"), F.col("span").alias("span2"))
            lower = F.col("low2") < F.col("low")
            state = stored(state.join(there, "ptr").select("first", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), F.when(lower, F.col("to_low2") + F.col("span")).otherwise(F.col("to_low")).alias("to_low"), (F.col("span") + F.col("span2")).alias("span"), lower.alias("moved")))
            if not state.where("moved").limit(1).count():
                break
            state = state.drop("moved")
        named = state.select("first", F.col("low").alias("ring"), F.col("to_low").alias("d"))
        ahead = ahead.unionByName(open_.join(named, "first").select("label", "first", "next", F.col("ring"), F.col("d").alias("to_low"), "n", "at", "r", "c"))
    # Corners after the smallest edge in its own chain come first, then those by how far it is ahead of them.
    corner = F.explode(F.arrays_zip("at", "r", "c")).alias("p")
    left = F.col("to_low") - F.col("p.at")
    corners = ahead.select("label", "ring", "to_low", corner).groupBy("label", "ring").agg(F.array_sort(F.collect_list(F.struct((left > 0).alias("later"), (-left).alias("place"), F.col("p.r").alias("r0"), F.col("p.c").alias("c0")))).alias("p"))
    points = F.transform("p", lambda p: F.struct(meta.x(p["c0"], 0).alias("x"), meta.y(p["r0"], 0).alias("y")))
    return corners.withColumn("points", points).select("label", "ring", signed_area(F.col("points")).alias("signed_area"), F.size("points").alias("n_corners"), "points")
