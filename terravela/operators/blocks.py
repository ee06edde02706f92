"""Block rasters: a row for each square of cells, its layers as arrays, so that stencils, filling and flow run as array code.

A block (br, bc) holds cells br * size to (br + 1) * size - 1 by bc * size to (bc + 1) * size - 1 in row-major order, NaN for nodata.
Only the cells along a block's border move between blocks, as strips or as rows: what is global (levels over the borders,
flow and labels across them) is solved on these, and each block is then worked through again by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.operators.focal import DIRECTIONS
from terravela.operators.grid import GridMeta
from terravela.plans.graph import connected_components, jump_to_roots
from terravela.plans.lineage import broadcast_below, stored

BLOCK = 512
#: Blocks whose places may be broadcast, a few MB.
BROADCAST_BLOCKS = 250_000
TYPES = {"z": "<f8", "filled": "<f8", "flat": "<f8", "slope": "<f8", "dir": "|i1", "acc": "<i8", "root": "<i8", "label": "<i8"}
_SPARK = {"f": "double", "i": "long"}


def array(data: bytes, layer: str, size: int) -> np.ndarray:
    return np.frombuffer(data, TYPES[layer]).reshape(size, size)


def _packed(layer: str, values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, TYPES[layer]).tobytes()


def to_blocks(cells: DataFrame, size: int = BLOCK, layer: str = "z", value: str = "v") -> DataFrame:
    """(br, bc, layer) of cells(row, col, value); a group is one block's cells. Cells without a value make no block by themselves."""
    empty = -1 if TYPES[layer] == "<i8" else np.nan

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        row, col = (table.column(n).to_numpy() for n in ("row", "col"))
        grid = np.full((size, size), empty, TYPES[layer])
        grid[row - key[0].as_py() * size, col - key[1].as_py() * size] = table.column("v").to_numpy()
        return pa.table({"br": pa.array([key[0].as_py()], pa.int32()), "bc": pa.array([key[1].as_py()], pa.int32()), layer: pa.array([grid.tobytes()], pa.binary())})

    held = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast(_SPARK[TYPES[layer][1]]).alias("v"))
    part = lambda c: F.floor(F.col(c) / size).cast("int")
    return held.groupBy(part("row").alias("br"), part("col").alias("bc")).applyInArrow(pack, f"br int, bc int, {layer} binary")


def from_blocks(blocks: DataFrame, layers: dict[str, str], size: int = BLOCK, present: str = "z", least: tuple[str, float] | None = None) -> DataFrame:
    """(row, col, name of each of layers) of the cells where layer present has data, and, with least, a layer has that value or more. NaN becomes null."""
    read = list(dict.fromkeys([present, *layers.values(), *([least[0]] if least else [])]))
    kinds = {name: _SPARK[TYPES[layer][1]] for name, layer in layers.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = {n: array(batch.column(n)[k].as_py(), n, size) for n in read}
                there = ~np.isnan(at[present]) if TYPES[present][1] == "f" else at[present] >= 0
                if least:
                    there = there & (at[least[0]] >= least[1])
                r, c = np.nonzero(there)
                out = [pa.array((r + batch.column("br")[k].as_py() * size).astype(np.int32)), pa.array((c + batch.column("bc")[k].as_py() * size).astype(np.int32))]
                for layer in layers.values():
                    values = at[layer][r, c]
                    out.append(pa.array(values.astype(np.int64)) if TYPES[layer][1] == "i" else pa.array(values, mask=np.isnan(values)))
                yield pa.RecordBatch.from_arrays(out, ["row", "col", *layers])

    return blocks.select("br", "bc", *read).mapInArrow(run, "row int, col int, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))


def _strip(grid: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """Of layers x size x size the cells that the block in that direction meets."""
    pick = lambda d: slice(None) if d == 0 else slice(-1, None) if d > 0 else slice(0, 1)
    return grid[:, pick(dr), pick(dc)]


def _strips(br: int, bc: int, grid: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(br, bc, side, data) for the blocks around, side being the direction from here; strips of nodata are left out."""
    found = [(br + dr, bc + dc, k, _strip(grid, dr, dc)) for k, (_, dr, dc) in enumerate(DIRECTIONS)]
    return [(r, c, k, s.astype("<f8").tobytes()) for r, c, k, s in found if not np.isnan(s).all()]


def _padded(own: np.ndarray, sides: dict[int, bytes]) -> np.ndarray:
    """layers x (size + 2) x (size + 2): a block with the strips around it, NaN where there is none."""
    layers, size, _ = own.shape
    out = np.full((layers, size + 2, size + 2), np.nan)
    out[:, 1:-1, 1:-1] = own
    place = lambda d: slice(1, -1) if d == 0 else 0 if d > 0 else size + 1
    for k, data in sides.items():
        _, dr, dc = DIRECTIONS[k]
        out[:, place(dr), place(dc)] = np.frombuffer(data, "<f8").reshape(layers, *([size] if 0 in (dr, dc) else []))
    return out


def _shift(padded: np.ndarray, dr: int, dc: int) -> np.ndarray:
    n = padded.shape[-1]
    return padded[..., 1 + dr : n - 1 + dr, 1 + dc : n - 1 + dc]


def flood(z: np.ndarray, around: np.ndarray, epsilon: float) -> np.ndarray:
    """The lowest levels of a block's cells, given those around it (padded; NaN nodata, inf unknown).

    A cell's level is the larger of its height and the lowest level beside it plus epsilon; water leaves beside nodata. Cells are
    reached in the order of their levels, each once.
    """
    size = z.shape[0]
    width = size + 2
    ring = around.copy()
    ring[1:-1, 1:-1] = z
    open_ = np.zeros((width, width), bool)
    open_[1:-1, 1:-1] = ~np.isnan(z)
    beside = np.zeros((size, size), bool)
    for _, dr, dc in DIRECTIONS:
        beside |= np.isnan(_shift(ring, dr, dc))
    level = np.full((width, width), np.inf)
    leaves = np.zeros((width, width), bool)
    leaves[1:-1, 1:-1] = beside & open_[1:-1, 1:-1]
    level[leaves] = ring[leaves]
    edge = np.isfinite(around)
    edge[1:-1, 1:-1] = False
    level[edge] = around[edge]
    start = np.flatnonzero(leaves | edge)
    heights, levels = ring.ravel().tolist(), level.ravel().tolist()
    todo = bytearray((open_ & ~leaves).ravel().tobytes()) + bytes(width + 2)  # steps from the ring may end past either end, where nothing is open
    steps = [dr * width + dc for _, dr, dc in DIRECTIONS]
    heap = list(zip([levels[i] for i in start.tolist()], start.tolist()))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        now, i = pop(heap)
        now += epsilon
        for step in steps:
            j = i + step
            if todo[j]:
                todo[j] = 0
                here = heights[j]
                here = here if here > now else now
                levels[j] = here
                push(heap, (here, j))
    out = np.array(levels).reshape(width, width)[1:-1, 1:-1].copy()
    out[np.isnan(z)] = np.nan
    return out


def _grouped(rows: DataFrame, run, shape: str) -> DataFrame:
    """Apply run(br, bc, own bytes, side -> bytes) to the rows (br, bc, side, data) of each block, side -1 being the block itself."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        side, data = table.column("side").to_pylist(), table.column("data").to_pylist()
        at = dict(zip(side, data))
        own = at.pop(-1, None)
        found = run(key[0].as_py(), key[1].as_py(), own, at) if own is not None else []
        return pa.Table.from_pylist(found, schema=types)

    types = _arrow(shape)
    return rows.groupBy("br", "bc").applyInArrow(one, shape)


def _arrow(shape: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ", 1) for f in shape.split(", ")]
    return pa.schema([(n, kinds[k] if k in kinds else pa.list_(kinds[k[6:-1]])) for n, k in fields])


def _whole(blocks: DataFrame, layer: str = "z") -> DataFrame:
    return blocks.select("br", "bc", F.lit(-1).alias("side"), F.col(layer).alias("data"))


_STRIPS = "br int, bc int, side int, data binary"


def _first_strips(blocks: DataFrame, size: int, layers: int) -> DataFrame:
    """Unknown levels (inf) around each block where the blocks beside have data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for br, bc, z in pdf[["br", "bc", "z"]].itertuples(index=False):
                found += _strips(br, bc, np.repeat(np.where(np.isnan(array(z, "z", size)), np.nan, np.inf)[None], layers, 0))
            yield pd.DataFrame(found, columns=["br", "bc", "side", "data"])

    return blocks.select("br", "bc", "z").mapInPandas(run, _STRIPS)


def border_levels(blocks: DataFrame, epsilons: tuple[float, ...], size: int = BLOCK) -> DataFrame | None:
    """(br, bc, side, data): the final levels, for each epsilon, along the blocks around each block; None for a single block.

    Blocks are solved for the levels around them, again while those fall. Heights are written once; a round reads and shuffles
    those of the blocks whose surroundings changed, and writes strips only, a few hundredths of a raster.
    """
    if blocks.limit(2).count() < 2:
        return None

    def solve(br: int, bc: int, own: bytes, sides: dict) -> list[dict]:
        z = array(own, "z", size)
        around = _padded(np.full((len(epsilons), size, size), np.nan), sides)
        levels = np.stack([flood(z, around[k], e) for k, e in enumerate(epsilons)])
        return [{"br": r, "bc": c, "side": k, "data": d} for r, c, k, d in _strips(br, bc, levels)]

    keys = blocks.select("br", "bc")
    strips = stored(_first_strips(blocks, size, len(epsilons)).join(broadcast_below(keys, BROADCAST_BLOCKS), ["br", "bc"], "left_semi"))
    step = F.create_map(*[F.lit(x) for k, (_, dr, dc) in enumerate(DIRECTIONS) for x in (k, F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c")))])[F.col("side")]
    source = {"sr": F.col("br") - step["r"], "sc": F.col("bc") - step["c"]}
    todo = None
    while True:
        solved = blocks if todo is None else blocks.join(todo, ["br", "bc"], "left_semi")
        given = strips if todo is None else strips.join(todo, ["br", "bc"], "left_semi")
        new = stored(_grouped(_whole(solved).unionByName(given), solve, _STRIPS))
        now = strips.alias("s").join(new.withColumnRenamed("data", "now"), ["br", "bc", "side"], "left").select("br", "bc", "side", F.coalesce("now", "data").alias("data"), (F.col("now") != F.col("data")).alias("fell"))
        now = stored(now)
        strips = now.drop("fell")
        todo = broadcast_below(stored(now.where("fell").select("br", "bc").distinct()), BROADCAST_BLOCKS)
        if not todo.limit(1).count():
            return strips


def fill_blocks(blocks: DataFrame, epsilons: tuple[float, ...], size: int = BLOCK) -> DataFrame:
    """blocks(br, bc, z) with the levels of one epsilon as filled, and of a second as flat."""
    names = ("filled", "flat")[: len(epsilons)]

    def solve(br: int, bc: int, own: bytes, sides: dict) -> list[dict]:
        z = array(own, "z", size)
        around = _padded(np.full((len(epsilons), size, size), np.nan), sides)
        return [{"br": br, "bc": bc, "z": own} | {n: _packed(n, flood(z, around[k], e)) for k, (n, e) in enumerate(zip(names, epsilons))}]

    strips = border_levels(blocks, epsilons, size)
    rows = _whole(blocks) if strips is None else _whole(blocks).unionByName(strips)
    return _grouped(rows, solve, "br int, bc int, z binary, " + ", ".join(f"{n} binary" for n in names))


def directions(padded: np.ndarray, cell_size: float) -> np.ndarray:
    """The direction of the steepest drop per distance, the first of equals, -1 where nothing is lower."""
    here = padded[1:-1, 1:-1]
    drops = np.stack([(here - _shift(padded, dr, dc)) / (cell_size * (2**0.5 if dr and dc else 1.0)) for _, dr, dc in DIRECTIONS])
    drops[np.isnan(drops)] = -np.inf
    best = drops.argmax(0)
    return np.where(drops.max(0) > 0, best, -1).astype(np.int8)


def slopes(padded: np.ndarray, cell_size: float, top: bool, left: bool, bottom: int | None, right: int | None) -> np.ndarray:
    """Horn's slope in degrees. Beyond the grid's first or last row (bottom: its place in the block) and column the edge repeats; nodata counts as the centre."""
    p = padded.copy()
    for yes, to, from_ in ((top, 0, 1), (bottom is not None, (bottom or 0) + 2, (bottom or 0) + 1)):
        if yes:
            p[to] = p[from_]
    for yes, to, from_ in ((left, 0, 1), (right is not None, (right or 0) + 2, (right or 0) + 1)):
        if yes:
            p[:, to] = p[:, from_]
    here = p[1:-1, 1:-1]
    n = {}
    for name, dr, dc in DIRECTIONS:
        there = _shift(p, dr, dc)
        n[name] = np.where(np.isnan(there), here, there)
    east = (n["ne"] + 2 * n["e"] + n["se"] - n["nw"] - 2 * n["w"] - n["sw"]) / (8 * cell_size)
    south = (n["sw"] + 2 * n["s"] + n["se"] - n["nw"] - 2 * n["n"] - n["ne"]) / (8 * cell_size)
    return np.degrees(np.arctan(np.hypot(east, south)))


def _downstream(direction: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell the flat place of the cell below (itself at an end), where it leaves the block, and the row and column (from the block's corner) that it leaves to."""
    size = direction.shape[0]
    r, c = np.indices((size, size))
    dr, dc = (np.array([0] + [d[k] for d in DIRECTIONS])[direction.astype(np.int64) + 1] for k in (1, 2))
    r2, c2 = r + dr, c + dc
    out = there & ((r2 < 0) | (r2 >= size) | (c2 < 0) | (c2 >= size))
    to = np.where(out | ~there, r * size + c, r2.clip(0, size - 1) * size + c2.clip(0, size - 1)).ravel()
    return to, out.ravel(), r2.ravel(), c2.ravel()


def _ends(to: np.ndarray) -> np.ndarray:
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _accumulated(to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What flows through each cell, its own weight included, for a forest of cells (to: the cell below, itself at an end)."""
    n = len(to)
    here = np.arange(n)
    total, up = weight.astype(np.float64), np.where(to == here, -1, to)
    while True:
        moving = np.flatnonzero(up >= 0)
        if not len(moving):
            return np.rint(total).astype(np.int64)
        above = up[moving]
        total = total + np.bincount(above, weights=total[moving], minlength=n)
        up[moving] = up[above]


def drain_blocks(blocks: DataFrame, meta: GridMeta, epsilon: float = 1e-5, size: int = BLOCK) -> DataFrame:
    """blocks(br, bc, z) -> (br, bc, z, filled, flat, dir, slope, acc, root), the layers of a drained terrain.

    Levels with a rise of epsilon a step and without, D8 directions and slope of the former, the cells that drain through each cell, and
    the cell (row * width + col) at which its water ends. Flow is summed within blocks, then along the cells by which it enters blocks,
    by doubling, and blocks that it enters are worked through once more.
    """
    epsilons = (epsilon, 0.0)

    def solve(br: int, bc: int, own: bytes, sides: dict) -> list[dict]:
        z = array(own, "z", size)
        there = ~np.isnan(z)
        around = _padded(np.full((2, size, size), np.nan), sides)
        filled, flat = (flood(z, around[k], e) for k, e in enumerate(epsilons))
        padded = around[0].copy()
        padded[1:-1, 1:-1] = filled
        direction = directions(padded, meta.cell_size)
        last = lambda extent, b: extent - 1 - b * size if 0 <= extent - 1 - b * size < size else None
        slope = slopes(padded, meta.cell_size, br == 0, bc == 0, last(meta.height, br), last(meta.width, bc))
        layers = {"filled": filled, "flat": flat, "slope": slope}
        return [{"br": br, "bc": bc, "z": own} | {n: _packed(n, v) for n, v in layers.items()} | _flow(br, bc, there, direction, meta, size)]

    strips = border_levels(blocks, epsilons, size)
    rows = _whole(blocks) if strips is None else _whole(blocks).unionByName(strips)
    solved = stored(_grouped(rows, solve, f"br int, bc int, z binary, filled binary, flat binary, slope binary, {_FLOW}"))
    return _entered(solved, meta, size)


def catchment_blocks(blocks: DataFrame, meta: GridMeta, outlet: int, size: int = BLOCK) -> DataFrame:
    """drained blocks(br, bc, z, dir) -> (br, bc, label): outlet's id in the cells that drain to that cell, itself included, -1 elsewhere."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, col = divmod(outlet, meta.width)
        for batch in batches:
            for k in range(batch.num_rows):
                br, bc, z = (batch.column(n)[k].as_py() for n in ("br", "bc", "z"))
                direction = array(batch.column("dir")[k].as_py(), "dir", size).copy()
                if row // size == br and col // size == bc:
                    direction[row % size, col % size] = -1
                yield pa.RecordBatch.from_pylist([{"br": br, "bc": bc, "z": z} | _flow(br, bc, ~np.isnan(array(z, "z", size)), direction, meta, size)], schema=types)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                root = array(batch.column("root")[k].as_py(), "root", size)
                yield pa.RecordBatch.from_arrays([batch.column("br").slice(k, 1), batch.column("bc").slice(k, 1), pa.array([_packed("label", np.where(root == outlet, outlet, -1))], pa.binary())], ["br", "bc", "label"])

    shape = f"br int, bc int, z binary, {_FLOW}"
    types = _arrow(shape)
    solved = stored(blocks.select("br", "bc", "z", "dir").mapInArrow(ended, shape))
    return _entered(solved, meta, size).select("br", "bc", "root").mapInArrow(labelled, "br int, bc int, label binary")


_FLOW = "dir binary, acc binary, root binary, rim array<long>, rim_to array<long>, rim_root array<long>, exit_to array<long>, exit_n array<long>"


def _flow(br: int, bc: int, there: np.ndarray, direction: np.ndarray, meta: GridMeta, size: int) -> dict:
    """A block's flow by itself: sums and ends of its cells, where its rim's water leaves it (-1: nowhere) or ends, and what it gives to the cells around."""
    to, out, r2, c2 = _downstream(direction, there)
    acc, end = _accumulated(to, there.ravel()), _ends(to)
    ids = ((np.arange(size)[:, None] + br * size) * meta.width + np.arange(size) + bc * size).ravel()
    beyond = (r2 + br * size) * meta.width + c2 + bc * size
    exits = np.flatnonzero(out)
    rim = np.zeros((size, size), bool)
    rim[[0, -1]], rim[:, [0, -1]] = True, True
    rim = np.flatnonzero(rim.ravel() & there.ravel())
    return {
        "dir": _packed("dir", direction), "acc": _packed("acc", np.where(there.ravel(), acc, 0)), "root": _packed("root", np.where(there.ravel(), ids[end], -1)),
        "rim": ids[rim].tolist(), "rim_to": np.where(out[end[rim]], beyond[end[rim]], -1).tolist(), "rim_root": ids[end[rim]].tolist(), "exit_to": beyond[exits].tolist(), "exit_n": acc[exits].tolist(),
    }


def _entered(solved: DataFrame, meta: GridMeta, size: int) -> DataFrame:
    """Blocks with the flow that enters them added to acc, and with the ends of flow that leaves them in root."""
    names = [n for n in solved.columns if n not in ("rim", "rim_to", "rim_root", "exit_to", "exit_n")]
    if not solved.where("size(exit_to) > 0").limit(1).count():
        return solved.select(*names)
    into = solved.select(F.explode(F.arrays_zip("exit_to", "exit_n")).alias("e")).groupBy(F.col("e.exit_to").alias("node")).agg(F.sum("e.exit_n").alias("n"))
    rim = solved.select(F.explode(F.arrays_zip("rim", "rim_to", "rim_root")).alias("e")).select(F.col("e.rim").alias("node"), F.when(F.col("e.rim_to") >= 0, F.col("e.rim_to")).alias("next"), F.col("e.rim_root").alias("end"))
    entries = stored(rim.join(into, "node", "left").select("node", "next", "end", F.coalesce("n", F.lit(0)).alias("n")))
    sums = _sums_along(entries.select("node", F.col("next").alias("up"), "n"))
    # The end of the flow from any cell of a rim: that of the last rim on its way.
    last = jump_to_roots(entries.select("node", F.coalesce("next", "node").alias("root")))
    ends = last.join(entries.select(F.col("node").alias("root"), "end"), "root").select("node", "end")
    place = {"br": F.floor(F.floor(F.col("node") / meta.width) / size).cast("int"), "bc": F.floor((F.col("node") % meta.width) / size).cast("int")}
    given = sums.where("n > 0").withColumns(place).groupBy("br", "bc").agg(F.collect_list(F.struct("node", "n")).alias("entered"))  # of a block's rim
    through = solved.select(F.explode("exit_to").alias("node")).distinct().join(ends, "node").select("node", "end")
    beyond = solved.select("br", "bc", F.explode("exit_to").alias("node")).distinct().join(through, "node").groupBy("br", "bc").agg(F.collect_list(F.struct("node", "end")).alias("left"))
    joined = solved.select(*names).join(given, ["br", "bc"], "left").join(beyond, ["br", "bc"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                there = ~np.isnan(array(row["z"], "z", size))
                to, out, r2, c2 = _downstream(array(row["dir"], "dir", size), there)
                corner = row["br"] * size, row["bc"] * size
                weight = there.ravel().astype(np.int64)
                for e in row["entered"] or []:
                    r, c = divmod(e["node"], meta.width)
                    weight[(r - corner[0]) * size + c - corner[1]] += e["n"]
                acc, end = _accumulated(to, weight), _ends(to)
                root = array(row["root"], "root", size).ravel().copy()
                if row["left"]:
                    beyond = (r2 + corner[0]) * meta.width + c2 + corner[1]
                    known = sorted((e["node"], e["end"]) for e in row["left"])
                    nodes, ends_of = np.array([x[0] for x in known]), np.array([x[1] for x in known])
                    leaves = out[end]
                    root[leaves] = ends_of[np.searchsorted(nodes, beyond[end[leaves]])]
                yield pa.RecordBatch.from_arrays([pa.array([row[n] if n not in ("acc", "root") else _packed(n, {"acc": np.where(there.ravel(), acc, 0), "root": root}[n])], batch.schema.field(n).type) for n in names], names)

    return stored(joined.mapInArrow(run, "br int, bc int, " + ", ".join(f"{n} binary" for n in names[2:])))


def _sums_along(forest: DataFrame) -> DataFrame:
    """forest(node, up, n) -> (node, n): what enters at each node by itself and from all above; rounds grow with the logarithm of the longest way."""
    state = stored(forest)
    while state.where("up IS NOT NULL").limit(1).count():
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("more"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        state = stored(state.join(given, "node", "left").join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return state.select("node", "n")


def label(mask: np.ndarray, eight: bool) -> np.ndarray:
    """The flat place of the first cell of each cell's connected part, -1 outside the mask."""
    size = mask.shape[0]
    own = np.where(mask, np.arange(size * size).reshape(size, size), size * size)
    label_of = np.append(own.ravel(), size * size)
    steps = [(dr, dc) for _, dr, dc in DIRECTIONS if eight or 0 in (dr, dc)]
    while True:
        padded = np.full((size + 2, size + 2), size * size)
        padded[1:-1, 1:-1] = label_of[:-1].reshape(size, size)
        low = np.minimum.reduce([_shift(padded, dr, dc) for dr, dc in steps] + [padded[1:-1, 1:-1]])
        low = np.where(mask, low, size * size).ravel()
        # What a cell has heard goes to its label as well, which hooks whole parts at once.
        new = label_of.copy()
        np.minimum.at(new, label_of[:-1][mask.ravel()], low[mask.ravel()])
        new[:-1] = np.where(mask.ravel(), np.minimum(new[:-1], low), size * size)
        new = _ends(new)
        if (new == label_of).all():
            return np.where(mask, new[:-1].reshape(size, size), -1)
        label_of = new


def component_blocks(blocks: DataFrame, meta: GridMeta, eight: bool = True, size: int = BLOCK, layer: str = "z") -> DataFrame:
    """(br, bc, label): of each block's cells with data in layer the smallest cell id of their connected part, -1 elsewhere.

    Parts are labelled within blocks; only pairs of labels that meet at a border are solved as a graph.
    """

    def ids(br: int, bc: int, local: np.ndarray) -> np.ndarray:
        r, c = np.divmod(local, size)
        return np.where(local >= 0, (r + br * size) * meta.width + c + bc * size, -1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                br, bc = batch.column("br")[k].as_py(), batch.column("bc")[k].as_py()
                found = ids(br, bc, label(~np.isnan(array(batch.column(layer)[k].as_py(), layer, size)), eight))
                yield pa.RecordBatch.from_arrays([pa.array([br], pa.int32()), pa.array([bc], pa.int32()), pa.array([_packed("label", found)], pa.binary())], ["br", "bc", "label"])

    labelled = stored(blocks.select("br", "bc", layer).mapInArrow(first, "br int, bc int, label binary"))
    if labelled.limit(2).count() < 2:
        return labelled

    def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for br, bc, data in pdf.itertuples(index=False):
                grid = array(data, "label", size).astype(np.float64)
                grid[grid < 0] = np.nan
                found += _strips(br, bc, grid[None])
                found += [(br, bc, -1, grid.tobytes())]
            yield pd.DataFrame(found, columns=["br", "bc", "side", "data"])

    def meet(br: int, bc: int, own: bytes, sides: dict) -> list[dict]:
        padded = _padded(np.frombuffer(own, "<f8").reshape(1, size, size), sides)[0]
        ring = np.zeros((size + 2, size + 2), bool)
        ring[[0, -1]], ring[:, [0, -1]] = True, True
        pairs = []
        for _, dr, dc in DIRECTIONS:
            if eight or 0 in (dr, dc):
                mine, there, outside = padded[1:-1, 1:-1], _shift(padded, dr, dc), _shift(ring, dr, dc)
                both = outside & ~np.isnan(mine) & ~np.isnan(there)
                pairs.append(np.stack([mine[both], there[both]], 1))
        return [{"a": int(a), "b": int(b)} for a, b in np.unique(np.concatenate(pairs), axis=0)]

    edges = stored(_grouped(labelled.mapInPandas(strips, _STRIPS), meet, "a long, b long"))
    roots = connected_components(edges)
    inside = labelled.mapInPandas(lambda batches: (pd.concat([pd.DataFrame({"br": br, "bc": bc, "node": np.unique(np.frombuffer(data, "<i8"))}) for br, bc, data in pdf.itertuples(index=False)]) for pdf in batches if len(pdf)), "br int, bc int, node long")
    moved = inside.join(roots.where("node <> root"), "node").groupBy("br", "bc").agg(F.collect_list(F.struct("node", "root")).alias("moved"))  # labels of one block

    def relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grid = array(batch.column("label")[k].as_py(), "label", size).copy()
                if pairs := batch.column("moved")[k].as_py():
                    known = sorted((p["node"], p["root"]) for p in pairs)
                    nodes, to = np.array([p[0] for p in known]), np.array([p[1] for p in known])
                    at = np.searchsorted(nodes, grid).clip(0, len(nodes) - 1)
                    grid = np.where(nodes[at] == grid, to[at], grid)
                yield pa.RecordBatch.from_arrays([batch.column("br").slice(k, 1), batch.column("bc").slice(k, 1), pa.array([grid.tobytes()], pa.binary())], ["br", "bc", "label"])

    return labelled.join(moved, ["br", "bc"], "left").mapInArrow(relabel, "br int, bc int, label binary")
