"""Points and faces as tables: merging, incidence, lattices, ranks and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.functions.geometry import polygon_props


def point_merge(points: DataFrame, tol: float = 1e-12) -> DataFrame:
    """(pt_id, rep_id): each point's representative, the least id within tol of it.

    Equal points fold first, so a place that many points share costs one row in the join; the rest meet through cells of
    tol's size and their 27 neighbours, never in a product.
    """
    distinct = points.groupBy("x", "y", "z").agg(F.min("pt_id").alias("rep_id"))
    size = max(tol, 1e-300)

    def place(x: Column) -> Column:  # of the cell, as a double: a long would end at 1.8e7 for the smallest cells
        q = x / F.lit(2 * size)
        return q - F.pmod(q, F.lit(1.0)) + F.lit(0.0)

    cell = [place(F.col(c)).alias(f"c{c}") for c in "xyz"]
    # a point is asked for in the cells that its ball touches: at most two a side
    sides = [F.array_distinct(F.array(place(F.col(c) - size), place(F.col(c) + size))) for c in "xyz"]
    homes = distinct.select("x", "y", "z", "rep_id", *cell)
    asks = distinct.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), *[s.alias(f"s{c}") for s, c in zip(sides, "xyz")])
    for c in "xyz":
        asks = asks.withColumn(f"c{c}", F.explode(f"s{c}")).drop(f"s{c}")
    d2 = sum((F.col(c) - F.col(f"a{c}")) * (F.col(c) - F.col(f"a{c}")) for c in "xyz")
    near = asks.join(homes, ["cx", "cy", "cz"]).filter(d2 <= tol * tol).groupBy("ax", "ay", "az").agg(F.min("rep_id").alias("rep_id"))
    return points.join(near, (points["x"] == near["ax"]) & (points["y"] == near["ay"]) & (points["z"] == near["az"])).select(points["pt_id"], "rep_id")


def first_occurrence(points: DataFrame) -> DataFrame:
    """(x, y, z, pt_id): the first point at each place."""
    return points.groupBy("x", "y", "z").agg(F.min("pt_id").alias("pt_id"))


def range_buckets(df: DataFrame, keys: list[str], buckets: int, seed: int = 11) -> Column:
    """A column that deals rows into ranges of the keys' order, by borders from a sample of some 40 rows a bucket."""
    n = df.count()
    if buckets < 2 or n < 2 * buckets:
        return F.lit(0)
    rows = df.select(*keys).sample(fraction=min(1.0, 40 * buckets / n), seed=seed).orderBy(*keys).collect()
    borders = [rows[i * len(rows) // buckets] for i in range(1, buckets)] if len(rows) >= buckets else []
    if not borders:
        return F.lit(0)
    kind = "struct<" + ",".join(f"`{k}`:{df.schema[k].dataType.simpleString()}" for k in keys) + ">"
    list_of = F.array(*[F.struct(*[F.lit(v) for v in b]) for b in borders]).cast(f"array<{kind}>")
    here = F.struct(*keys)
    return F.size(F.filter(list_of, lambda b: b <= here))


def running(df: DataFrame, keys: list[str], value: Column, name: str, buckets: int | None = None, exclusive: bool = False) -> DataFrame:
    """df with the running sum of value in the keys' order: sums within ranges, then offsets of whole ranges, so no task
    sees more than a range. The keys must order rows totally."""
    k = buckets if buckets is not None else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("__value", value).withColumn("__bucket", range_buckets(df, keys, k))
    sums = marked.groupBy("__bucket").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__sum")).drop("__sum")
    inner = F.sum("__value").over(Window.partitionBy("__bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.col("__inner") + F.col("__before")
    out = marked.withColumn("__inner", inner).join(F.broadcast(before), "__bucket")  # one row a bucket
    return out.withColumn(name, total - F.col("__value") if exclusive else total).drop("__value", "__bucket", "__inner", "__before")


def previous(df: DataFrame, keys: list[str], value: str, name: str, buckets: int | None = None) -> DataFrame:
    """df with the value of the row before in the keys' order, null at the first: within ranges by a window, at the start of
    a range from the last row of the nearest range before it that has any."""
    k = buckets if buckets is not None else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("__bucket", range_buckets(df, keys, k))
    order = Window.partitionBy("__bucket").orderBy(*keys)
    ends = marked.groupBy("__bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*keys)).alias("last"))
    carried = ends.select("__bucket", F.lag("last").over(Window.orderBy("__bucket")).alias("__last"))  # one row a bucket that has rows
    seen = marked.withColumn("__before", F.lag(F.struct(F.col(value).alias("v"))).over(order)).join(F.broadcast(carried), "__bucket")
    return seen.withColumn(name, F.coalesce("__before", "__last")["v"]).drop("__bucket", "__before", "__last")


def radius_rank(points: DataFrame) -> DataFrame:
    """(pt_id, radius, rank): dense places from 0 in the order of the distance to the origin, then id."""
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return running(points.select("pt_id", radius.alias("radius")), ["radius", "pt_id"], F.lit(1).cast("long"), "__rank").select("pt_id", "radius", (F.col("__rank") - 1).alias("rank"))


def radius_merge(points: DataFrame, tol: float = 1e-12) -> DataFrame:
    """(pt_id, rep_id): the least id strictly within tol, found among points of about equal distance to the origin.

    Points in the order of that distance part into runs where it jumps by tol or more; points within tol of each other
    share a run. Equal points fold first; within a run the rest meet through cells as in point_merge.
    """
    distinct = points.groupBy("x", "y", "z").agg(F.min("pt_id").alias("pt_id"))
    ranked = radius_rank(distinct).join(distinct, "pt_id")
    jumps = previous(ranked, ["radius", "pt_id"], "radius", "before")
    begins = F.coalesce((F.col("radius") - F.col("before") >= tol), F.lit(True)).cast("long")
    runs = running(jumps, ["radius", "pt_id"], begins, "run").select("pt_id", "run", "x", "y", "z")
    cells = [F.floor(F.col(c) / F.lit(tol)).alias(f"c{c}") for c in "xyz"]
    asks = runs.select(F.col("pt_id").alias("a_id"), "run", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    for c in "xyz":
        asks = asks.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"a{c}") / F.lit(tol)) - 1, F.floor(F.col(f"a{c}") / F.lit(tol)) + 1)))
    d2 = sum((F.col(c) - F.col(f"a{c}")) * (F.col(c) - F.col(f"a{c}")) for c in "xyz")
    near = asks.join(runs.select("pt_id", "run", "x", "y", "z", *cells), ["run", "cx", "cy", "cz"]).filter(d2 < tol * tol).groupBy("a_id").agg(F.min("pt_id").alias("rep_id"))
    folded = distinct.select("x", "y", "z", F.col("pt_id").alias("a_id")).join(near, "a_id").drop("a_id")
    return points.join(folded, ["x", "y", "z"]).select("pt_id", "rep_id")


def mean_split(points: DataFrame, axis: str) -> DataFrame:
    """(pt_id, is_left): whether the coordinate is at most the mean of all."""
    mean = points.agg(F.avg(axis)).first()[0]
    return points.select("pt_id", (F.col(axis) <= F.lit(mean)).alias("is_left"))


def median_split(points: DataFrame, axis: str) -> DataFrame:
    """(pt_id, is_left): whether a point is among the first half (the greater one) in the order of the coordinate, then id."""
    ranked = running(points.select("pt_id", axis), [axis, "pt_id"], F.lit(1).cast("long"), "__rank")
    half = (points.count() + 1) // 2
    return ranked.select("pt_id", (F.col("__rank") <= half).alias("is_left"))


def lexsort_rank(points: DataFrame) -> DataFrame:
    """(pt_id, u_id): dense places from 0 in the order of z, then y, then x, then id."""
    return running(points, ["z", "y", "x", "pt_id"], F.lit(1).cast("long"), "__rank").select("pt_id", (F.col("__rank") - 1).alias("u_id"))


def incidence(faces: DataFrame) -> DataFrame:
    """(face_id, pos, node, k): one row per corner."""
    return faces.select("face_id", F.size("nodes").alias("k"), F.posexplode("nodes").alias("pos", "node"))


def max_faces_per_node(faces: DataFrame) -> DataFrame:
    return incidence(faces).groupBy("node").count().agg(F.max("count").alias("max_faces"))


def csr_pointers(faces: DataFrame) -> DataFrame:
    """(face_id, begin, stop): where each face's corners lie in the list of all."""
    sized = faces.select("face_id", F.size("nodes").cast("long").alias("k"))
    return running(sized, ["face_id"], F.col("k"), "stop").select("face_id", (F.col("stop") - F.col("k")).alias("begin"), "stop")


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """counts with `offset`: the exclusive running sum of n."""
    return running(counts, [key], F.col(n).cast("long"), "offset", exclusive=True)


def lattice_quads(points: DataFrame, high: bool = False) -> DataFrame:
    """(face_id, nodes) of a lattice (pt_id, i, j): the quad from each point to its next ones, reversed on high faces.

    The joins are by merge: their sides are the lattice, whose size in memory its files do not tell."""
    p = points.select("pt_id", "i", "j")
    step = lambda di, dj, name: p.select(F.col("pt_id").alias(name), (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")).hint("merge")
    quads = p.join(step(1, 0, "n2"), ["i", "j"]).join(step(1, 1, "n3"), ["i", "j"]).join(step(0, 1, "n4"), ["i", "j"])
    names = ["pt_id", "n4", "n3", "n2"] if high else ["pt_id", "n2", "n3", "n4"]
    return quads.select(F.col("pt_id").alias("face_id"), F.array(*names).alias("nodes"))


def face_props(faces: DataFrame, points: DataFrame) -> DataFrame:
    """(face_id, k, area, nx, ny, nz): corners meet their coordinates in a join and their face in one group."""
    corners = incidence(faces).join(points.select(F.col("pt_id").alias("node"), "x", "y", "z"), "node")
    grouped = corners.groupBy("face_id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("corners"))
    return grouped.select("face_id", "k", polygon_props(F.col("corners")).alias("p")).select("face_id", "k", "p.area", "p.nx", "p.ny", "p.nz")


def node_normals(faces: DataFrame, props: DataFrame) -> DataFrame:
    """(node, a, nx, ny, nz): area shares, and normals weighted by them, not of unit length."""
    shares = incidence(faces).join(props.drop("k"), "face_id").withColumn("da", F.col("area") / F.col("k"))
    return shares.groupBy("node").agg(F.sum("da").alias("a"), *[(F.sum(F.col("da") * F.col(c)) / F.sum("da")).alias(c) for c in ("nx", "ny", "nz")])


def corner_flags(faces: DataFrame, props: DataFrame, normals: DataFrame, angle: float = 30.0) -> DataFrame:
    """(node, is_corner): a face at the node turns away from its normal by more than the angle."""
    import math

    faced = incidence(faces).join(props.select("face_id", "nx", "ny", "nz"), "face_id")
    n = normals.select("node", F.col("nx").alias("mx"), F.col("ny").alias("my"), F.col("nz").alias("mz"))
    dot = F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz")
    return faced.join(n, "node").groupBy("node").agg(F.bool_or(F.abs(dot) < math.cos(math.radians(angle))).alias("is_corner"))


def extent(points: DataFrame) -> DataFrame:
    """(ldef0): the largest distance of a point from the mean of all."""
    mean = points.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]).first()
    if mean[0] is None:
        return points.agg(F.lit(0.0).alias("ldef0"))
    return points.agg(F.max(F.sqrt(sum((F.col(c) - mean[i]) * (F.col(c) - mean[i]) for i, c in enumerate("xyz")))).alias("ldef0"))


def merge_grids(parts: list[DataFrame]) -> DataFrame:
    """Nodes of several parts (node_id, x0, y0, z0) one after the other; equal nodes of two parts stay apart."""
    out, at = None, 0
    for i, part in enumerate(parts):
        moved = part.select((F.col("node_id") + at).alias("node_id"), F.lit(i).alias("part"), "x0", "y0", "z0")
        last = part.agg(F.max("node_id")).first()[0]
        at += 0 if last is None else last + 1
        out = moved if out is None else out.unionByName(moved)
    return out
