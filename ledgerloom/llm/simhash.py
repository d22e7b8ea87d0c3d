"""SimHash near-duplicates by tiled exact comparison.

Fingerprints lie in cells by their population counts: two of them within radius r have counts that differ by r at most,
so only pairs of cells that near are compared and all others are skipped. Cells of more than TILE fingerprints are
split into tiles. Each pair of tiles is compared with numpy exclusive-or and bit counts in Arrow functions: the tile
that is at home is held, the fingerprints that visit it stream past in chunks. A tile with many visitors is held by
several tasks, each with a slice of them. Of the pairs found, a spanning forest is emitted, so a dense group of n
fingerprints gives no n * n links. Only distinct fingerprints are compared; copies share one.

`links` and `near_duplicates` count LANES lanes of a 64-bit fingerprint each on its own, which skips more pairs at a
small radius. `compare_cells` takes fingerprints of several words and any cells; `nearcopies` uses it at a wide radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, cut, rereadable, small_batches, with_row_id, without_rows
from ledgerloom.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
LANES, TILE = 4, 4096
#: A task compares a tile with about so many tiles of visitors.
SLICE_TILES = 16
#: Cells of a matrix of comparisons, which fit a core's cache, and pairs found that are held before a forest is taken.
_CELLS, _PAIRS = 262_144, 1_000_000


def grams(text: str | None, shingle: int) -> np.ndarray:
    """Unsigned hashes of a text's shingles, in order; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    own = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return np.fromiter((h(g, SEED) for g in own), "<u8", len(own))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes; of no hashes: 0."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if set in over half the shingles' hashes; no words: 0."""
    return majority(grams(text, shingle))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (_rid, doc_id, fp) for each row of df; fp is the fingerprint as a signed bigint. A null text has no words."""
    small_batches(df.sparkSession)
    rows = with_row_id(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("_rid", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["_rid", "doc_id", "fp"])

    return rows.mapInArrow(run, f"_rid bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Places of pairs (a, b) of nodes below n that span the same components as all of them, n - 1 at most; of several, the first."""
    label, taken, at = np.arange(n), [], np.arange(len(a))
    while len(at):
        x, y = label[a[at]], label[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        _, first = np.unique(x, return_index=True)
        up = np.arange(n)
        for k in first:
            p, q = int(x[k]), int(y[k])
            while up[p] != p:
                p = int(up[p])
            while up[q] != q:
                q = int(up[q])
            if p != q:
                up[max(p, q)] = min(p, q)
                taken.append(int(at[k]))
        while (nxt := up[up]).tolist() != up.tolist():
            up = nxt
        label = up[label]
    return taken


class _Tile:
    """Fingerprints at home, one row of words each, that visitors are compared with."""

    def __init__(self, home: np.ndarray, radius: int, first: int) -> None:
        self.home, self.radius, self.first = home, radius, first
        self.word = np.ascontiguousarray(home[:, 0])

    def pairs(self, visit: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in home, places in visit, distances) of the pairs within radius; within: visit is home, and each pair counts once."""
        step = max(1, _CELLS // max(1, len(self.home)))
        for k in range(0, len(visit), step):
            d = np.bitwise_count(visit[k : k + step, :1] ^ self.word[None, :])
            v, h = np.nonzero(d <= self.first)
            if within and len(v):
                below = v + k < h
                v, h = v[below], h[below]
            if not len(v):
                continue
            d = d[v, h].astype(np.int16)
            for w in range(1, visit.shape[1]):
                d += np.bitwise_count(visit[v + k, w] ^ self.home[h, w])
            near = d <= self.radius
            if near.any():
                yield h[near], v[near] + k, d[near]


class _Shared:
    """Sets of hashes at home, by hash, so that a set is held against all of them at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        by = np.argsort(flat, kind="stable")
        self.hashes, first = np.unique(flat[by], return_index=True)
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[by]
        self.first = np.append(first, len(flat))

    def common(self, own: np.ndarray) -> np.ndarray:
        """Number of hashes that own shares with each set."""
        at = np.minimum(np.searchsorted(self.hashes, own), max(0, len(self.hashes) - 1))
        at = at[self.hashes[at] == own] if len(self.hashes) else at[:0]
        start, n = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else at
        return np.bincount(self.owners[places], minlength=len(self.sizes))


def _compare(radius: int, first: int, words: int, least: tuple[int, int] | None):
    """Streams rows (tile, slice, role, words..., node[, label, set]), sorted by the first three, and yields links (a, b) of nodes.

    The links are a forest that prefers near pairs; with labels and sets, of the pairs whose labels differ and whose sets
    share least[0] / least[1] of their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, home_sets = None, [], []
        tile: _Tile | None = None
        shared: _Shared | None = None
        own = np.zeros((0, 2), np.int64)  # node and label of those at home

        def similar(h: np.ndarray, v: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
            nonlocal shared
            shared = shared or _Shared(home_sets)
            out = np.zeros(len(h), bool)
            by = np.argsort(v, kind="stable")
            edge = np.flatnonzero(np.diff(v[by], prepend=-1, append=-1))
            for s, e in itertools.pairwise(edge.tolist()):
                one, homes = sets[v[by[s]]], h[by[s:e]]
                common, both = shared.common(one)[homes], len(one) + shared.sizes[homes]
                out[by[s:e]] = common * (least[0] + least[1]) >= both * least[0]
            return out

        def links(visit: np.ndarray, names: np.ndarray, sets: list[np.ndarray], within: bool) -> Iterator[pa.RecordBatch]:
            held, size, count = [], 0, len(tile.home) + (0 if within else len(visit))

            def taken() -> tuple[np.ndarray, ...]:
                h, v, d = (np.concatenate(x) for x in zip(*held, strict=True))
                near = np.argsort(d, kind="stable")
                h, v, d = h[near], v[near], d[near]
                keep = _forest(v, h + (0 if within else len(visit)), count)
                return h[keep], v[keep], d[keep]

            for h, v, d in tile.pairs(visit, within):
                if least is not None:
                    other = own[h, 1] != names[v, 1]
                    h, v, d = h[other], v[other], d[other]
                    alike = similar(h, v, sets) if len(h) else other[:0]
                    h, v, d = h[alike], v[alike], d[alike]
                held.append((h, v, d))
                size += len(h)
                if size >= _PAIRS + count:
                    held = [taken()]
                    size = len(held[0][0])
            if size:
                h, v, _ = taken()
                yield pa.RecordBatch.from_arrays([pa.array(own[h, 0]), pa.array(names[v, 0])], names=["a", "b"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal tile, own
            rows = np.concatenate(home) if home else np.zeros((0, words + 2), np.int64)
            own = rows[:, words:]
            tile = _Tile(np.ascontiguousarray(rows[:, :words]).view(np.uint64), radius, first)
            if key is not None and key[1] == 0 and len(rows) > 1:
                yield from links(tile.home, own, home_sets, True)

        for batch in batches:
            at, part, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            numbers = batch.num_columns - (least is not None)
            rest = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3, numbers)], 1)
            sets = batch.column(numbers).to_numpy(zero_copy_only=False) if least is not None else None
            if rest.shape[1] < words + 2:  # without a name of its own a fingerprint is named by its one word; without labels none counts
                rest = np.hstack([rest, rest[:, :1] if rest.shape[1] == words else rest[:, :0], rest[:, :1]])
            edge = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in itertools.pairwise([0, *edge.tolist(), len(at)]):
                if s == e:
                    continue
                if (now := (int(at[s]), int(part[s]))) != key:
                    if tile is None:
                        yield from settle()
                    key, home, home_sets, tile, shared = now, [], [], None, None
                own_sets = [] if sets is None else list(sets[s:e])
                if role[s] == 0:
                    home.append(rest[s:e])
                    home_sets += own_sets
                    continue
                if tile is None:
                    yield from settle()
                yield from links(np.ascontiguousarray(rest[s:e, :words]).view(np.uint64), rest[s:e, words:], own_sets, False)
        if tile is None:
            yield from settle()

    return run


def compare_cells(cells: DataFrame, words: list[str], radius: int, first: int | None = None, node: str | None = None, sets: tuple[str, str] | None = None, least: tuple[int, int] | None = None, tile: int = TILE, bound: int | None = None) -> DataFrame:
    """Links (a, b) of the rows of cells(cell, targets, words..., node, ...) within radius bits, all words together, and `first` in the first.

    A row is compared with those of its own cell and of the cells in targets (of two cells, one names the other); null
    targets count as none. node (bigint) names a row, else its one word does. The links join the same components as all
    such pairs. sets names two columns, of labels (bigint) and of sorted sets of hashes (array<bigint>): pairs with
    equal labels don't count, nor do those whose sets' Jaccard similarity is below least[0] / least[1]; tiles then have so
    many hashes as a tile of sets of 512. There are at most `bound` cells.
    """
    cols = [*words, *([node] if node else []), *(sets or ())]
    size = F.sum(F.size(sets[1]) / 512.0) if sets else F.count(F.lit(1))
    name = node or words[0]
    per = cut(cells.groupBy("cell").agg(size.alias("m"), F.first("targets").alias("targets")))
    load = per.select("cell", "m").unionByName(per.select(F.explode("targets").alias("cell"), "m").where("cell is not null")).groupBy("cell").agg(F.sum("m").alias("load"))
    counts = per.join(load, "cell").select("cell", F.ceil(F.col("m") / tile).cast("int").alias("n"), F.ceil(F.col("load") / (tile * SLICE_TILES)).cast("int").alias("slices"))
    several = not counts.where("n > 1").isEmpty()
    counts = F.broadcast(counts) if bound is not None and bound <= BROADCAST_ROWS else counts
    sub, part = (F.pmod(F.xxhash64(F.col(name), F.lit(k)), n).cast("int") for k, n in enumerate((F.col("n"), F.col("slices"))))
    all_tiles = lambda start: F.explode(F.sequence(start, F.col("n") - 1)).alias("sub")
    visits = cells.select(*cols, F.explode("targets").alias("cell")).where("cell is not null").join(counts, "cell")
    visits = visits.select("cell", all_tiles(F.lit(0)), part.alias("slice"), F.lit(1).alias("role"), *cols)
    at_home = cells.select("cell", *cols).join(counts, "cell").withColumn("sub", sub)
    home = at_home.select("cell", "sub", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), *cols)
    rows = home.unionByName(visits)
    if several:  # pairs of tiles of one cell
        own = at_home.where("sub + 1 < n").withColumn("_from", F.col("sub") + 1).drop("sub")
        rows = rows.unionByName(own.select("cell", all_tiles(F.col("_from")), part.alias("slice"), F.lit(1).alias("role"), *cols))
    rows = rows.select((F.col("cell") * 2**20 + F.col("sub")).alias("tile"), "slice", "role", *cols)
    dealt = rows.repartition("tile", "slice").sortWithinPartitions("tile", "slice", "role")
    return dealt.mapInArrow(_compare(radius, radius if first is None else first, len(words), least), "a bigint, b bigint")


def links(distinct: DataFrame, radius: int = RADIUS, lanes: int = LANES, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the same components as all pairs of distinct(fp) within radius bits."""
    width, base = 64 // lanes, 64 // lanes + 1
    mask = (1 << width) - 1 if width < 64 else -1
    pops = [F.bit_count(F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND(F.lit(mask).cast("long"))).cast("long") for i in range(lanes)]
    cells = distinct.select("fp", *[p.alias(f"p{i}") for i, p in enumerate(pops)])
    number: Column = sum((F.col(f"p{i}") * base**i for i in range(1, lanes)), F.col("p0"))
    shifts = [d for d in itertools.product(range(-radius, radius + 1), repeat=lanes) if 0 < sum(map(abs, d)) <= radius and d > (0,) * lanes]
    fits = lambda d: [F.col(f"p{i}") + x for i, x in enumerate(d)]
    target = F.array(*[F.when(sum(((p >= 0) & (p <= width)).cast("int") for p in fits(d)) == lanes, sum(p * base**i for i, p in enumerate(fits(d)))) for d in shifts])
    # At most base ** lanes cells: 83,521 for four lanes, whose counts are broadcast; the 43 million of eight lanes' are not.
    return compare_cells(cells.select("fp", number.alias("cell"), target.cast("array<bigint>").alias("targets")), ["fp"], radius, tile=tile, bound=base**lanes)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of df: _rid, doc_id, fp, component_id, keep_rid.

    component_id is the smallest doc_id that links reach, keep_rid the row that has it (of several, the first read).
    Texts without words have fingerprint 0, linked like any other. Null doc_ids give way to others: a component of
    nothing else has a null id. An empty table gives no rows.
    """
    rows = cut(fingerprints(df, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rid"))
    distinct = cut(rows.groupBy("fp").agg(first.alias("first")))
    member = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    roots = distinct.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    named = roots.select("fp", "root").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least._rid").alias("keep_rid"))
    return rows.join(named, "fp").select("_rid", "doc_id", "fp", "component_id", "keep_rid")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """df with one row of each component: the one with the smallest doc_id. Its columns stay as they are."""
    df = rereadable(df)
    dropped = cut(near_duplicates(df, doc_id, text, radius).where("_rid <> keep_rid").select("_rid"))
    return without_rows(df, dropped)
