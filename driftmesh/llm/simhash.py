"""SimHash near-duplicates by exact comparison in tiles.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Distinct fingerprints are dealt into
cells, cells into tiles of bounded size, and pairs of tiles that may hold a link are compared exactly with exclusive-or
and bit counts in numpy. A pair of tiles returns a spanning forest of its links, never the links themselves, so a large
group of near copies yields a row per member and pair of tiles; components are then found by rounds of star steps.

Two uses. `simhash_components` links 64-bit fingerprints within a few bits: cells are the bit counts of halves (quarters
on large tables), and as two fingerprints within the radius cannot differ by more in their counts, only such tiles meet;
within a pair, groups by the counts of quarters are skipped by the same rule. `similar_components` links documents whose
sets of shingles have a Jaccard similarity of at least `similarity`: a fingerprint of 128 bits, over distinct shingles,
is compared within a radius that covers that similarity; sets so alike have sizes within the similarity of each other, so
cells are classes of size, and only neighbouring classes meet (bit counts prune nothing at such a radius). A link is a
pair within the radius whose whole sets have the similarity. Of each forest, which prefers the least distances, every
edge is verified on the whole sets; where one fails, a link beside it may join what the forest does not, so in the
components that refuted edges split, all pairs within the radius whose ends are still apart are verified as well, in
tiles that hold the sets and return only the edges that join: no link is lost, and no pair becomes a row.

Null and empty texts, and texts of white space, have fingerprint zero, linked like any other. Rows that repeat an id are
returned each; a null id is never a component's id while another is in it. Other columns, whatever their names, are not
looked at, and stay in drop_near_copies() and drop_similar(). An empty table gives no rows. Texts are read whole, a very
long one in bounded pieces. Work grows with the square of the distinct fingerprints that share a neighbourhood of cells,
in bounded pieces spread over all tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import SALTS, connected_components, discard, fresh, giving_back, look_up, materialize, slices, small_side

#: The hash of a shingle is XXH64 with this seed.
SEED = 42
TILE_ROWS = 8_192
#: Comparisons that a kernel holds at a time, and the links after which it reduces them to a forest.
BLOCK, HELD_LINKS = 1 << 20, 1 << 21
#: Distinct fingerprints from which cells are counts of quarters instead of halves.
MANY_PRINTS = 3_000_000
#: Shingles hashed at a time.
HASHED = 65_536
#: Bits in which the 128-bit fingerprints of sets of similarity 0.8 may differ; the mean is 19.4, the deviation 4.1.
WIDE_RADIUS = 28
#: Shingles of the sets that a tile holds, about.
TILE_SHINGLES = 1 << 19
#: Edges of a node from which its set of shingles is sent in SALTS copies.
HUB_EDGES = 256


def shingle_digests(text: str, shingle: int, digest) -> Iterator[bytes]:
    """Joined digests of the shingles, some at a time."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for at in range(0, len(starts), HASHED):
        yield b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + HASHED].tolist(), ends[at : at + HASHED].tolist())])


def fingerprint(text: str, shingle: int) -> int:
    import xxhash

    ones, n = np.zeros(64, np.int64), 0
    for raw in shingle_digests(text, shingle, xxhash.xxh64_digest):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print), the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return _texts(docs, id_col, text_col).mapInArrow(giving_back(run), "doc_id long, print long")


def _settle(labels: np.ndarray) -> np.ndarray:
    while True:
        deeper = labels[labels]
        if np.array_equal(deeper, labels):
            return labels
        labels = deeper


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each u and v; a label is the least index of its component."""
    while len(u):
        a, b = labels[u], labels[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        labels = _settle(labels)
    return labels


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).astype(np.int16)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all of a (and b) linked within the radius, between a and b, or within a where b is None."""
    every = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    other = a if b is None else b
    labels = np.arange(len(every))

    def groups(values):
        counts = _quarters(values)
        keys, inverse = np.unique(counts, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        return keys, np.split(order, np.cumsum(np.bincount(inverse.ravel()))[:-1])

    keys_a, places_a = groups(a)
    keys_b, places_b = (keys_a, places_a) if b is None else groups(b)
    for g, (key, mine) in enumerate(zip(keys_a, places_a)):
        near = np.flatnonzero(np.abs(keys_b - key).sum(axis=1) <= radius)
        if b is None:
            near = near[near >= g]
        if not len(near):
            continue
        theirs = np.concatenate([places_b[i] for i in near])
        right = other[theirs]
        step = max(1, BLOCK // len(theirs))
        for at in range(0, len(mine), step):
            left = mine[at : at + step]
            i, j = np.nonzero(np.bitwise_count(a[left][:, None] ^ right) <= radius)
            labels = _merge(labels, left[i], theirs[j] + shift)
    moved = np.flatnonzero(labels != np.arange(len(every)))
    return every[moved], every[labels[moved]]


def links(prints: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS, parts: int = 2) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of distinct prints within the radius. parts: the pieces of a
    print whose bit counts make its cell, 2 or 4."""
    width = 64 // parts
    names = [f"c{k}" for k in range(parts)]
    counts = [F.bit_count(F.shiftrightunsigned("print", k * width).bitwiseAND(F.lit((1 << width) - 1))).alias(c) for k, c in enumerate(names)]
    counted = prints.select("print", *counts).distinct()
    cells = counted.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"))  # 33 x 33 at most, or 17 to the fourth
    dealt = counted.join(F.broadcast(cells), names).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    tiles = materialize(dealt.groupBy(*names, "part").agg(F.collect_list("print").alias("prints"), F.first("parts").alias("parts")), "tiles")
    sizes = tiles.select(*names, "part", "parts")
    # the cells within the radius of each, the lesser first, and every part of the one with every part of the other
    steps = [m for m in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, m)) <= radius and m >= (0,) * parts]
    moves = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(m, names)]) for m in steps]))
    left = sizes.withColumn("move", moves).select(*[F.col(c).alias("a" + c) for c in names], F.col("part").alias("ap"), *[(F.col(c) + F.col("move." + c)).alias(c) for c in names])
    pairs = left.join(F.broadcast(cells), names).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("long") - 1)))
    same_cell = F.lit(True)
    for c in names:
        same_cell = same_cell & (F.col("a" + c) == F.col(c))
    pairs = pairs.filter(~same_cell | (F.col("ap") <= F.col("part"))).withColumn("same", same_cell & (F.col("ap") == F.col("part"))).withColumn("part", F.col("part").cast("int")).drop("parts")
    with_a = pairs.join(tiles.select(*[F.col(c).alias("a" + c) for c in names], F.col("part").alias("ap"), F.col("prints").alias("a")), ["a" + c for c in names] + ["ap"])
    with_b = with_a.join(tiles.select(*names, "part", F.col("prints").alias("b")), [*names, "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.ascontiguousarray(batch.column(c)[k].values.to_numpy()).view(np.uint64) for c in (1, 2))
                u, v = tile_forest(a, None if batch.column(0)[k].as_py() else b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return with_b.select("same", "a", "b").mapInArrow(giving_back(run), "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, print, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    parts = 2 if distinct.count() < MANY_PRINTS else 4
    roots = materialize(connected_components(links(distinct.select("print"), radius, tile_rows, parts)).withColumnRenamed("node", "print"), "roots")
    # only prints that have a link or several rows need a name; all other rows are their own component
    rooted = roots.join(distinct, "print").unionByName(distinct.filter("n > 1").join(roots, "print", "left_anti").withColumn("root", F.col("print")).select("print", "root", "least", "n"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(look_up(rooted, least, "root").select("print", "component_id"), "named")
    for done in (distinct, roots, rooted, least):
        discard(done)
    met = look_up(rows, named.withColumn("met", F.lit(True)), "print", "left", named.count())
    return met.select("doc_id", "print", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is their component's, all columns kept; rows without an id stay if their component has
    none."""
    found = materialize(simhash_components(docs, shingle, radius, id_col, text_col, **options), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # an id may have several texts: it goes if none of them stays
    gone = found.groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).filter("not stays")
    return _without(docs, gone.select("doc_id"), id_col)


def _without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows of these ids (doc_id)."""
    name = fresh("gone", docs)
    gone = materialize(ids.select(F.col("doc_id").alias(name)), "gone")
    return docs.join(small_side(gone), F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")


# sets of shingles alike


def shingle_rows(text: str, shingle: int) -> np.ndarray:
    """Digests of the distinct shingles, rows of 16 bytes, in the order of their first eight, which tell them apart."""
    import xxhash

    raw = np.frombuffer(b"".join(shingle_digests(text, shingle, xxhash.xxh128_digest)), np.uint8).reshape(-1, 16)
    return raw[np.unique(np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel(), return_index=True)[1]]


def wide_print(rows: np.ndarray) -> tuple[int, int]:
    """The 128-bit fingerprint of distinct shingles, as two signed longs."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(rows), HASHED):
        ones += np.unpackbits(rows[at : at + HASHED], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(rows)).tobytes()
    return int.from_bytes(bits[:8], "big", signed=True), int.from_bytes(bits[8:], "big", signed=True)


def sketches(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p0, p1, size, whole): the fingerprint over distinct shingles, their number, and a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            found = [shingle_rows(t, shingle) for t in batch.column(1).to_pylist()]
            prints = np.array([wide_print(f) for f in found], np.int64)
            whole = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([len(f) for f in found], pa.int32()), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p0", "p1", "size", "whole"])

    return _texts(docs, id_col, text_col).mapInArrow(giving_back(run), "doc_id long, p0 long, p1 long, size int, whole long")


def spanning_forest(u: np.ndarray, v: np.ndarray, distance: np.ndarray, nodes: int) -> np.ndarray:
    """Places of edges that make a spanning forest of least distances: Kruskal's rule, level by level, and within a level
    every component joins a lesser one by one edge at a time."""
    labels, chosen = np.arange(nodes), []
    for level in np.unique(distance):
        at = np.flatnonzero(distance == level)
        while len(at):
            a, b = labels[u[at]], labels[v[at]]
            differ = a != b
            at, a, b = at[differ], a[differ], b[differ]
            if not len(at):
                break
            low = np.minimum(a, b)
            high, first = np.unique(np.maximum(a, b), return_index=True)
            chosen.append(at[first])
            labels[high] = low[first]
            labels = _settle(labels)
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _by_size(tile: tuple) -> list[np.ndarray]:
    order = np.argsort(tile[3], kind="stable")
    return [np.ascontiguousarray(c[order]) for c in tile]


def _within(a: list[np.ndarray], b: list[np.ndarray] | None, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, distances) of all links between a and b, or within a where b is None, some at a time.
    Both are (ids, p0, p1, sizes, ...) by size. Links: within the radius, and sizes within the similarity of each other."""
    _, p0, p1, sizes, *_ = a
    _, q0, q1, other_sizes, *_ = a if b is None else b
    step = max(1, BLOCK // max(1, len(q0)))
    for at in range(0, len(p0), step):
        stop = min(at + step, len(p0))
        lo = max(at + 1 if b is None else 0, int(np.searchsorted(other_sizes, similarity * sizes[at], "left")))
        hi = int(np.searchsorted(other_sizes, sizes[stop - 1] / similarity + 1e-9, "right"))
        if lo >= hi:
            continue
        apart = np.bitwise_count(p0[at:stop, None] ^ q0[lo:hi])
        apart += np.bitwise_count(p1[at:stop, None] ^ q1[lo:hi])
        i, j = np.nonzero(apart <= radius)
        d = apart[i, j].astype(np.int64)
        i, j = i + at, j + lo
        x, y = sizes[i], other_sizes[j]
        real = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
        if b is None:
            real &= i < j
        yield i[real], j[real], d[real]


def similar_forest(a: tuple, b: tuple | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of ids) of a spanning forest of least distances over the links between a and b, or within a where b is
    None. Each is (ids, p0, p1, sizes)."""
    a, b = _by_size(a), None if b is None else _by_size(b)
    shift = 0 if b is None else len(a[0])
    every = a[0] if b is None else np.concatenate([a[0], b[0]])
    held, count = [np.zeros((3, 0), np.int64)], 0

    def reduced():
        u, v, d = np.concatenate(held, axis=1)
        keep = spanning_forest(u, v, d, len(every))
        return [np.stack([u[keep], v[keep], d[keep]])]

    for i, j, d in _within(a, b, radius, similarity):
        held.append(np.stack([i, j + shift, d]))
        count += len(i)
        if count > HELD_LINKS:
            held = reduced()
            count = held[0].shape[1]
    u, v, _ = reduced()[0]
    return every[u], every[v]


def joining_links(a: tuple, b: tuple | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of ids) that join, beside the roots, all between a and b, or within a, whose fingerprints are within the
    radius and whose whole sets have the similarity: fewer than there are roots. Each is (ids, p0, p1, sizes, roots, sets).

    A pair whose ends are joined already is passed over; every other one is verified here, so none of them is a row.
    """
    sides = [(*side[:4], side[4], np.arange(len(side[0]))) for side in ([a] if b is None else [a, b])]
    sides = [_by_size(side) for side in sides]
    every, sizes, roots = (np.concatenate([side[k] for side in sides]) for k in (0, 3, 4))
    shift = 0 if b is None else len(a[0])
    sets = [whole[5][i] for whole, side in zip([a] if b is None else [a, b], sides) for i in side[5]]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    stops = np.cumsum([len(x) for x in sets])
    starts = stops - [len(x) for x in sets]
    labels, met = np.unique(roots, return_inverse=True)[1].ravel(), np.zeros(len(codes), bool)
    out_u, out_v = [], []
    for i, j, _ in _within(sides[0], None if b is None else sides[1], radius, similarity):
        j = j + shift
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]
        for u, theirs in zip(np.unique(i), np.split(j, np.flatnonzero(np.diff(i)) + 1)):
            theirs = theirs[labels[theirs] != labels[u]]
            if not len(theirs):
                continue
            met[codes[starts[u] : stops[u]]] = True
            ends = np.cumsum(stops[theirs] - starts[theirs])
            firsts = ends - (stops[theirs] - starts[theirs])
            sums = np.concatenate([[0], np.cumsum(met[codes[np.repeat(starts[theirs] - firsts, stops[theirs] - starts[theirs]) + np.arange(ends[-1])]])])
            met[codes[starts[u] : stops[u]]] = False
            common = sums[ends] - sums[firsts]
            good = theirs[common >= similarity * (sizes[u] + sizes[theirs] - common) - 1e-9]
            joined, first = np.unique(labels[good], return_index=True)
            if len(joined):
                out_u.append(np.full(len(joined), every[u]))
                out_v.append(every[good[first]])
                labels[np.isin(labels, joined)] = labels[u]
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *out_u]), np.concatenate([nothing, *out_v])


def similar_candidates(prints: DataFrame, similarity: float, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): forests of links between distinct (id, p0, p1, size), pair of tiles by pair of tiles."""
    classed = prints.withColumn("cell", F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9)).otherwise(-1).cast("int"))
    cells = classed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"))  # a cell per class of size
    dealt = classed.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("id", "p0", "p1", "size")))
    tiles = materialize(dealt.groupBy("cell", "part").agg(rows.alias("rows"), F.first("parts").alias("parts")), "tiles")
    left = tiles.select(F.col("cell").alias("ac"), F.col("part").alias("ap"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = left.join(F.broadcast(cells), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    pairs = pairs.filter((F.col("ac") != F.col("cell")) | (F.col("ap") <= F.col("part"))).withColumn("same", (F.col("ac") == F.col("cell")) & (F.col("ap") == F.col("part"))).drop("parts")
    with_a = pairs.join(tiles.select(F.col("cell").alias("ac"), F.col("part").alias("ap"), F.col("rows").alias("a")), ["ac", "ap"])
    with_b = with_a.join(tiles.select("cell", "part", F.col("rows").alias("b")), ["cell", "part"])

    def tile(cell) -> tuple:
        flat = cell.values.flatten()
        p = [np.ascontiguousarray(c.to_numpy()) for c in flat]
        return p[0], p[1].view(np.uint64), p[2].view(np.uint64), p[3].astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = tile(batch.column(1)[k]), None if batch.column(0)[k].as_py() else tile(batch.column(2)[k])
                u, v = similar_forest(*sides, radius, similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return with_b.select("same", "a", "b").mapInArrow(giving_back(run), "u long, v long")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v) whose sets, from (doc_id, shingles), have a Jaccard similarity of at least `similarity`.

    The set of a node with many edges is sent in copies, and its edges are dealt over them.
    """
    ends = edges.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    hubs = materialize(ends.filter(F.col("n") > HUB_EDGES).select("doc_id", F.lit(SALTS).alias("copies")), "hubs")
    most = hubs.count()
    marked = edges
    for end in ("u", "v"):
        marked = look_up(marked, hubs.select(F.col("doc_id").alias(end), F.col("copies").alias("copies_" + end)), end, "left", most)
    dealt = marked.select("u", "v", *[F.when(F.col("copies_" + e).isNotNull(), F.pmod(F.xxhash64("u", "v"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt_" + e) for e in ("u", "v")])
    copied = look_up(sets, hubs, "doc_id", "left", most).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    with_u = dealt.join(copied.select(F.col("doc_id").alias("u"), F.col("salt").alias("salt_u"), F.col("shingles").alias("a")), ["u", "salt_u"])
    both = with_u.join(copied.select(F.col("doc_id").alias("v"), F.col("salt").alias("salt_v"), F.col("shingles").alias("b")), ["v", "salt_v"])
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common >= F.lit(similarity) * (F.size("a") + F.size("b") - common) - 1e-9).select("u", "v")


def missing_links(sets: DataFrame, nodes: DataFrame, similarity: float, radius: int, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(u, v): verified links that join what nodes (doc_id, comp, root) of the same comp but different roots leave apart.

    sets: (doc_id, p0, p1, shingles). A comp is one tile, or is dealt into tiles of bounded size that meet in pairs; a pair
    of tiles gives fewer edges than it has roots, however many pairs it verifies.
    """
    held = materialize(look_up(sets, nodes, "doc_id"), "held")
    cells = materialize(held.groupBy("comp").agg(F.ceil(F.sum(F.size("shingles") + F.lit(1)) / tile_shingles).cast("int").alias("parts")), "cells")
    dealt = look_up(held, cells, "comp").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    tiles = materialize(dealt.groupBy("comp", "part").agg(F.collect_list(F.struct("doc_id", "p0", "p1", "root", "shingles")).alias("rows"), F.first("parts").alias("parts")), "tiles")
    pairs = tiles.select("comp", F.col("part").alias("ap"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("part"))
    with_a = pairs.join(tiles.select("comp", F.col("part").alias("ap"), F.col("rows").alias("a")), ["comp", "ap"])
    other = tiles.select("comp", "part", F.col("rows").alias("b"))
    with_b = with_a.filter("ap = part").select("a", F.expr("array()").cast(other.schema["b"].dataType).alias("b"))
    with_b = with_b.unionByName(with_a.filter("ap < part").join(other, ["comp", "part"]).select("a", "b"))

    def tile(cell) -> tuple | None:
        if not len(cell.values):
            return None
        ids, p0, p1, roots, sets = cell.values.flatten()
        p0, p1 = (np.ascontiguousarray(c.to_numpy()).view(np.uint64) for c in (p0, p1))
        sets = [x.values.to_numpy() for x in sets]
        return ids.to_numpy(), p0, p1, np.array([len(x) for x in sets], np.float64), roots.to_numpy(), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                u, v = joining_links(tile(batch.column(0)[k]), tile(batch.column(1)[k]), radius, similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    found = materialize(with_b.mapInArrow(giving_back(run), "u long, v long"), "more")
    for done in (held, cells, tiles):
        discard(done)
    return found


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(node, root) of the documents that have a link: root is the least id of the component, itself among the nodes.

    Ids are nodes: rows without an id have no links, and rows that repeat one are linked if any of them is.
    """
    rows = materialize(sketches(docs.filter(F.col(id_col).isNotNull()), shingle, id_col, text_col), "sketches")
    # equal sets stand for each other
    keyed = rows.select("doc_id", F.struct("p0", "p1", "size", "whole").alias("key"))
    distinct = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    equal = look_up(keyed, materialize(distinct.filter("n > 1").select("key", "id"), "equal"), "key").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    prints = distinct.select("id", "key.p0", "key.p1", "key.size")

    found = similar_candidates(prints, similarity, radius, tile_rows)
    candidates = materialize(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct(), "candidates")
    name = fresh("met", docs)
    ends = materialize(candidates.select(F.explode(F.array("u", "v")).alias(name)).distinct(), "ends")
    asked = docs.join(small_side(ends), F.col(id_col).cast("long") == F.col(name), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [shingle_rows(t, shingle) for t in batch.column(1).to_pylist()]
            prints = np.array([wide_print(f) for f in found], np.int64)
            sets = pa.array([np.ascontiguousarray(f[:, :8]).view(np.int64).ravel() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1]), sets], names=["doc_id", "p0", "p1", "shingles"])

    sets = materialize(_texts(asked, id_col, text_col).mapInArrow(giving_back(run), "doc_id long, p0 long, p1 long, shingles array<long>"), "sets")
    good = materialize(verified(candidates, sets.select("doc_id", "shingles"), similarity).distinct(), "good")
    links = good
    if good.count() < candidates.count():
        # every link that is still missing lies in a component of the forests that refuted edges have split
        nodes = materialize(connected_components(candidates).withColumnRenamed("root", "comp"), "nodes")
        roots = materialize(connected_components(good), "roots")
        nodes = materialize(look_up(nodes, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
        split = materialize(nodes.groupBy("comp").agg((F.min("root") != F.max("root")).alias("split")).filter("split").select("comp"), "split")
        links = good.unionByName(missing_links(sets, look_up(nodes, split, "comp").withColumnRenamed("node", "doc_id"), similarity, radius, tile_shingles))
    links = materialize(links.unionByName(equal), "links")
    for done in (distinct, candidates, ends, sets):
        discard(done)
    return connected_components(links)


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that are not the least id of their component of similar documents, all columns kept; rows
    without an id stay."""
    found = materialize(similar_components(docs, shingle, similarity, id_col=id_col, text_col=text_col, **options), "components")
    return _without(docs, found.filter("node != root").select(F.col("node").alias("doc_id")), id_col)
