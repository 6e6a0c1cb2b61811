"""ASCII polyMesh folders: points, faces, boundary, owner and neighbour, one folder a part.

Files are read whole, one row each; parts are spread over tasks and every list is exploded in place. Binary files raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.operators.common import small_side

PART = r"processor(\d+)"


def _files(spark: SparkSession, case: str, name: str) -> DataFrame:
    """(part, body): the text between a file's header and its end; part 0 for a case that is not cut up."""
    glob = f"{case}/processor*/constant/polyMesh/{name}"
    try:
        raw = spark.read.text(glob, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raw = spark.read.text(f"{case}/constant/polyMesh/{name}", wholetext=True)
    raw = raw.withColumn("file", F.input_file_name())
    ascii_only = F.when(F.col("value").rlike(r"format\s+binary"), F.raise_error(F.concat(F.lit("binary file "), F.col("file"))).cast("string")).otherwise(F.col("value"))
    part = F.coalesce(F.try_to_number(F.regexp_extract("file", PART, 1), F.lit("999999")).cast("int"), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(ascii_only, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    return raw.select(part.alias("part"), F.regexp_replace(bare, r"(?s)FoamFile\s*\{.*?\}", "").alias("body"))


def _list(body: Column) -> Column:
    """What stands between the outermost parentheses."""
    return F.regexp_extract(body, r"(?s)^\s*\d+\s*\((.*)\)\s*$", 1)


def read_points(spark: SparkSession, case: str, name: str = "points") -> DataFrame:
    """(part, node, x, y, z) in file order."""
    vectors = F.regexp_extract_all(_list(F.col("body")), F.lit(r"\(\s*([^()]+?)\s*\)"), F.lit(1))
    rows = _files(spark, case, name).select("part", F.posexplode(vectors).alias("node", "v")).withColumn("c", F.split("v", r"\s+"))
    return rows.select("part", F.col("node").cast("long").alias("node"), *[F.get("c", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def read_faces(spark: SparkSession, case: str) -> DataFrame:
    """(part, face, nodes) in file order; the number before a face must be that of its nodes."""
    faces = F.regexp_extract_all(_list(F.col("body")), F.lit(r"(\d+\s*\([^()]*\))"), F.lit(1))
    rows = _files(spark, case, "faces").select("part", F.posexplode(faces).alias("face", "v"))
    nodes = F.transform(F.split(F.trim(F.regexp_extract("v", r"\(([^()]*)\)", 1)), r"\s+"), lambda n: n.cast("long"))
    sized = rows.select("part", F.col("face").cast("long").alias("face"), nodes.alias("nodes"), F.regexp_extract("v", r"^(\d+)", 1).cast("int").alias("k"))
    return sized.select("part", "face", F.when(F.size("nodes") == F.col("k"), F.col("nodes")).otherwise(F.raise_error(F.lit("a face has other nodes than its number says")).cast("array<long>")).alias("nodes"))


def read_boundary(spark: SparkSession, case: str) -> DataFrame:
    """(part, name, bc_type, n_faces, start_face)."""
    entries = F.regexp_extract_all(_list(F.col("body")), F.lit(r"([^\s{}();]+\s*\{[^{}]*\})"), F.lit(1))
    rows = _files(spark, case, "boundary").select("part", F.explode(entries).alias("e"))
    number = lambda key: F.regexp_extract("e", rf"\b{key}\s+(\d+)\s*;", 1).cast("long")
    return rows.select("part", F.regexp_extract("e", r"^([^\s{]+)", 1).alias("name"), F.regexp_extract("e", r"\btype\s+(\w+)\s*;", 1).alias("bc_type"), number("nFaces").alias("n_faces"), number("startFace").alias("start_face"))


def read_cells(spark: SparkSession, case: str) -> DataFrame:
    """(part, face, owner, neighbour); neighbour is null on the boundary."""
    def labels(name: str, column: str) -> DataFrame:
        values = F.regexp_extract_all(_list(F.col("body")), F.lit(r"(\d+)"), F.lit(1))
        return _files(spark, case, name).select("part", F.posexplode(values).alias("face", "v")).select("part", F.col("face").cast("long").alias("face"), F.col("v").cast("long").alias(column))

    return labels("owner", "owner").join(labels("neighbour", "neighbour"), ["part", "face"], "left")


def surface_faces(faces: DataFrame, boundary: DataFrame) -> DataFrame:
    """(part, face, name, bc_type, nodes) of the faces whose patch is of a surface type; types count, names do not."""
    from driftmesh.operators.patches import surface_face_filter

    # a part's patches are a short list: broadcast, so that faces stay where they are
    cut = surface_face_filter(boundary).groupBy("part").agg(F.collect_list(F.struct("start_face", "n_faces", "name", "bc_type")).alias("cuts"))
    held = F.filter("cuts", lambda c: (F.col("face") >= c["start_face"]) & (F.col("face") < c["start_face"] + c["n_faces"]))
    return faces.join(small_side(cut), "part").select("part", "face", "nodes", F.explode(held).alias("c")).select("part", "face", "c.name", "c.bc_type", "nodes")


HEADER = """FoamFile
{{
    version     2.0;
    format      ascii;
    class       vectorField;
    location    "constant/polyMesh";
    object      points;
}}

{n}
("""


def _ordered_lines(df: DataFrame, path: str, keys: list[str], single: bool = False) -> None:
    """Lines in the keys' order as text files that, read by name, follow one another; or as a single file."""
    dealt = df.coalesce(1) if single else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("value").write.text(path)


def write_points(nodes: DataFrame, path: str, single: bool = False) -> None:
    """A points file (node_id, x, y, z) as text parts in order, for one part of a case; numbers are written as short as they read back the same."""
    n = nodes.count()
    number = lambda c: F.col(c).cast("string")
    body = nodes.select(F.lit(1).alias("k"), "node_id", F.concat(F.lit("("), number("x"), F.lit(" "), number("y"), F.lit(" "), number("z"), F.lit(")")).alias("value"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, 0, HEADER.format(n=n)), (2, 0, ")")], "k int, node_id long, value string")
    _ordered_lines(ends.unionByName(body), path, ["k", "node_id"], single)


def short(column: Column) -> Column:
    """A number in six digits at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%g", column), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def write_tecplot(nodes: DataFrame, faces: DataFrame, cells: DataFrame, path: str) -> None:
    """A Tecplot polyhedron grid as text parts in order: nodes (node, x, y, z), faces (face, nodes), cells (face, owner,
    neighbour). Numbers count from 1; a boundary face has right element 0."""
    spark = nodes.sparkSession
    size = faces.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("corners")).first()
    n_cells = (cells.agg(F.max("owner")).first()[0] or 0) + 1
    head = ['TITLE = "driftmesh grid"', "FILETYPE = GRID", 'VARIABLES = "X" "Y" "Z"', "Zone", "ZoneType=FEPOLYHEDRON", f"NODES={nodes.count()}", f"FACES={size['n']}", f"ELEMENTS={n_cells}", f"TotalNumFaceNodes={size['corners']}", "NumConnectedBoundaryFaces=0", "TotalNumBoundaryConnections=0"]
    parts = [spark.createDataFrame([(0, i, h) for i, h in enumerate(head)], "k int, id long, value string")]
    for k, c in enumerate("xyz", 1):
        parts.append(nodes.select(F.lit(k).alias("k"), F.col("node").alias("id"), short(F.col(c)).alias("value")))
    parts.append(faces.select(F.lit(4).alias("k"), F.col("face").alias("id"), F.size("nodes").cast("string").alias("value")))
    parts.append(faces.select(F.lit(5).alias("k"), F.col("face").alias("id"), F.array_join(F.transform("nodes", lambda n: (n + 1).cast("string")), " ").alias("value")))
    parts.append(cells.select(F.lit(6).alias("k"), F.col("face").alias("id"), (F.col("owner") + 1).cast("string").alias("value")))
    parts.append(cells.select(F.lit(7).alias("k"), F.col("face").alias("id"), F.coalesce(F.col("neighbour") + 1, F.lit(0)).cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    _ordered_lines(out, path, ["k", "id"])


def write_tree_centres(tree: DataFrame, path: str) -> None:
    """Centres of a tree's inner nodes (driftmesh.schema.TREE) as Tecplot text, a zone for each level but the deepest."""
    deepest = tree.agg(F.max("level")).first()[0] or 0
    inner = tree.filter((F.col("level") < deepest) & (F.col("left_id") >= 0))
    heads = inner.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", F.lit(-1).alias("node_id"), F.format_string('Zone T="level%d" I=%d', "level", "n").alias("value"))
    rows = inner.select("level", "node_id", F.concat_ws(" ", *[short(F.col(c)) for c in ("cx", "cy", "cz")]).alias("value"))
    first = tree.sparkSession.createDataFrame([(-1, -1, 'VARIABLES = "X" "Y" "Z"')], "level int, node_id int, value string")
    _ordered_lines(first.unionByName(heads).unionByName(rows), path, ["level", "node_id"])
