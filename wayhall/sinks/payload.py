"""Response payloads of built graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.functions.geometry import half_even, point
from wayhall.schema import PLAIN

#: Walls of a piece of a floor plan, at most, as a power of two.
PIECE_BITS = 8


def shown_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as consumers read them: defaults for what is missing, coordinates to 4 digits, width to 3 or null if unknown."""
    text = (F.coalesce(c, F.lit("")).alias(c) for c in ("name", "type", "level"))
    spot = (half_even(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in "xyz")
    width = F.when(F.coalesce("width", F.lit(0.0)) != 0, half_even(F.col("width"), 3)).alias("width")
    return nodes.select("model_id", "seq", "id", *text, *spot, F.coalesce("accessible", F.lit(True)).alias("accessible"), width)


def shown_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as consumers read them; without coordinates a straight line between the nodes."""
    ends = lambda n: nodes.select("model_id", F.col("id").alias(n), point(F.col("x"), F.col("y"), F.col("z")).alias(f"p{n}"))
    # Only these need their nodes; the others aren't moved.
    bare = edges.where("coords IS NULL").drop("coords").join(ends("u"), ["model_id", "u"]).join(ends("v"), ["model_id", "v"]).withColumn("coords", F.array("pu", "pv"))
    return edges.where("coords IS NOT NULL").unionByName(bare.select(*edges.columns)).select(
        "model_id", "seq", "u", "v", F.coalesce("edge_type", F.lit(PLAIN)).alias("type"), F.coalesce("accessible", F.lit(True)).alias("accessible"),
        F.coalesce("levels", F.lit("")).alias("levels"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.transform("coords", lambda p: F.array(p["x"], p["y"], p["z"])).alias("coords"),
    )


def floor_plans(outlines: DataFrame) -> DataFrame:
    """model_id, level, piece, lines: each level's outline in order, as nested coordinates, in pieces that are to be read in their order.

    A piece has the lines of walls whose numbers are within 1 << PIECE_BITS of each other, so no row grows with its level.
    """
    line = F.transform("coords", lambda p: F.array(p["x"], p["y"]))
    # The last 12 bits of seq tell lines of a wall.
    piece = F.shiftright("seq", PIECE_BITS + 12).alias("piece")
    listed = outlines.groupBy("model_id", "level", piece).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    return listed.select("model_id", "level", "piece", F.col("l.line").alias("lines"))


def upload_responses(graph, files: DataFrame) -> DataFrame:  # noqa: ANN001
    """model_id and the JSON response to each upload (files: model_id, file)."""
    gather = lambda df, name, cols: df.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("seq", *cols))).alias("__l")).select("model_id", F.transform("__l", lambda s: F.struct(*(s[c].alias(c) for c in cols))).alias(name))
    storeys = graph.storeys.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("elevation", "seq", "name"))).alias("s")).select("model_id", F.col("s.name").alias("storeys"))
    whole = F.flatten(F.array_sort(F.collect_list(F.struct("piece", "lines")))["lines"])
    plans = floor_plans(graph.outlines).groupBy("model_id", "level").agg(whole.alias("lines")).groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "lines"))).alias("floorplans"))
    nodes = gather(shown_nodes(graph.nodes), "nodes", ["id", "name", "type", "level", "x", "y", "z", "accessible", "width"])
    edges = gather(shown_edges(graph.edges, graph.nodes), "edges", ["u", "v", "type", "accessible", "levels", "weight", "coords"])
    all_ = files.select("model_id", F.col("file").alias("filename"))
    for part in (storeys, nodes, edges, plans):
        all_ = all_.join(part, "model_id", "left")
    body = F.struct(F.col("model_id").alias("session_id"), "filename", *(F.col(c) for c in ("storeys", "nodes", "edges", "floorplans")))
    return all_.select("model_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def response_lines(graph, files: DataFrame) -> DataFrame:  # noqa: ANN001
    """model_id, part, level, seq, line: the bodies of upload_responses(), to be read in the order of these columns.

    A line is a node, an edge or a line of a floor plan, so no row grows with its model; only the storeys stand in one.
    """
    start = lambda df, *by: df.groupBy("model_id", *by).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    whole = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    own = files.select("model_id", F.col("file").alias("filename"))
    names = graph.storeys.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("elevation", "seq", "name"))).alias("s"))
    head = own.join(names, "model_id", "left").withColumn("storeys", F.coalesce(F.col("s.name"), F.array().cast("array<string>")))
    open_ = F.concat(F.regexp_replace(whole(F.col("model_id").alias("session_id"), "filename", "storeys"), r"\}$", ""), F.lit(', "nodes": ['))
    empty, zero = F.lit("").alias("level"), F.lit(0).cast("long").alias("seq")
    fixed = lambda n, text: own.select("model_id", F.lit(n).alias("part"), empty, zero, F.lit(text).alias("line"))

    def listed(df: DataFrame, n: int, cols: list[str]) -> DataFrame:
        told = df.join(own.select("model_id"), "model_id", "left_semi").join(start(df), "model_id")
        return told.select("model_id", F.lit(n).alias("part"), empty, "seq", F.concat(F.when(F.col("seq") == F.col("low"), "").otherwise(","), whole(*cols)).alias("line"))

    lines = graph.outlines.join(own.select("model_id"), "model_id", "left_semi").join(start(graph.outlines, "level"), ["model_id", "level"])
    first = graph.outlines.groupBy("model_id").agg(F.min("level").alias("first"))
    name = F.regexp_replace(F.regexp_replace(whole(F.col("level").alias("k")), r'^\{"k":', ""), r"\}$", "")
    begin = F.when(F.col("seq") == F.col("low"), F.concat(F.when(F.col("level") == F.col("first"), "").otherwise(","), name, F.lit(":["))).otherwise(",")
    end = F.when(F.col("seq") == F.col("high"), "]").otherwise("")
    line = F.to_json(F.transform("coords", lambda p: F.array(p["x"], p["y"])))
    lines = lines.join(first, "model_id").select("model_id", F.lit(5).alias("part"), "level", "seq", F.concat(begin, line, end).alias("line"))
    rows = head.select("model_id", F.lit(0).alias("part"), empty, zero, open_.alias("line"))
    for part in (
        listed(shown_nodes(graph.nodes), 1, ["id", "name", "type", "level", "x", "y", "z", "accessible", "width"]), fixed(2, '], "edges": ['),
        listed(shown_edges(graph.edges, graph.nodes), 3, ["u", "v", "type", "accessible", "levels", "weight", "coords"]), fixed(4, '], "floorplans": {'), lines, fixed(6, "}}"),
    ):
        rows = rows.unionByName(part)
    return rows


def write_responses(graph, files: DataFrame, path: str, partitions: int | None = None) -> None:  # noqa: ANN001
    """The bodies of upload_responses() as text below path/model_id=..: the files of a model, in the order of their names, are its body.

    Lines are sorted in ranges, so a large model is written by many tasks and none holds more than its range.
    """
    rows = response_lines(graph, files)
    order = ["model_id", "part", "level", "seq"]
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    dealt.select("model_id", F.col("line").alias("value")).write.partitionBy("model_id").text(path)
