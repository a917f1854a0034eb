"""Opening building models: IFC files (STEP) as building tables, all files of a folder at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayhall import schema
from wayhall.plans.chains import steps_back
from wayhall.plans.checkpoint import cut, written
from wayhall.sources.shapes import TYPES as SHAPE_TYPES
from wayhall.sources.shapes import arg, of, world_vertices
from wayhall.sources.step import HEADER, instances, ref, refs, statements
from wayhall.sources.tables import Building

#: Classes that become elements. A class derived from one that is scanned is in schema.SUBTYPES too.
CLASSES = [
    "IfcBuildingStorey", "IfcSpace", "IfcSlab", "IfcSlabStandardCase", "IfcSlabElementedCase", "IfcDoor", "IfcDoorStandardCase", "IfcStair", "IfcStairFlight", "IfcRamp", "IfcRampFlight",
    "IfcTransportElement", "IfcWall", "IfcWallStandardCase", "IfcWallElementedCase", "IfcCurtainWall",
]
#: Other classes that relations name, of which the identity and the name matter.
NAMED = ["IfcProject", "IfcSite", "IfcBuilding", "IfcOpeningElement", "IfcOpeningStandardCase", "IfcElementAssembly", "IfcRoof"]
#: Relations, and the instances that properties come from.
RELATIONS = [
    "IfcRelFillsElement", "IfcRelVoidsElement", "IfcRelSpaceBoundary", "IfcRelSpaceBoundary1stLevel", "IfcRelSpaceBoundary2ndLevel", "IfcRelAggregates", "IfcRelContainedInSpatialStructure",
    "IfcRelDefinesByProperties", "IfcRelDefinesByType", "IfcPropertySet", "IfcPropertySingleValue", "IfcWallType", "IfcCurtainWallType",
]
WALL_SET, EXTERNAL = "Pset_WallCommon", "IsExternal"
KEY = ["model_id", "element_id"]


def _upper(names: list[str]) -> list[str]:
    return [n.upper() for n in names]


def _rooted(inst: DataFrame) -> DataFrame:
    """model_id, id, ifc_class, guid, name of all instances that have an identity and that relations may name."""
    names = F.create_map(*(F.lit(x) for n in CLASSES + NAMED for x in (n.upper(), n)))
    return of(inst, *_upper(CLASSES + NAMED)).select("model_id", "id", F.element_at(names, F.col("type")).alias("ifc_class"), arg(0).alias("guid"), arg(2).alias("name")).where("guid IS NOT NULL")


def _truth(value: Column) -> Column:
    """Whether a property's value counts as true: not .F., not a zero, not an empty text."""
    inner = F.regexp_extract(value, r"(?s)^[A-Za-z0-9_]+\((.*)\)$", 1)
    return F.when(value.isNotNull(), ~inner.isin(".F.", "''", "") & ~inner.rlike(r"^[-+]?0+\.?0*([Ee][-+]?[0-9]+)?$"))


def external_walls(inst: DataFrame) -> DataFrame:
    """model_id, id, is_external of elements that the wall property set says it of, by themselves or else by their type."""
    sets = of(inst, "IFCPROPERTYSET").where(arg(2) == WALL_SET).select("model_id", F.col("id").alias("pset"), F.explode(refs(arg(4))).alias("property"))
    value = of(inst, "IFCPROPERTYSINGLEVALUE").where(arg(0) == EXTERNAL).select("model_id", F.col("id").alias("property"), _truth(arg(2)).alias("is_external"))
    told = cut(sets.join(value, ["model_id", "property"]).where("is_external IS NOT NULL").groupBy("model_id", "pset").agg(F.min_by("is_external", "property").alias("is_external")))
    own = of(inst, "IFCRELDEFINESBYPROPERTIES").select("model_id", F.col("id").alias("rel"), ref(arg(5)).alias("pset"), F.explode(refs(arg(4))).alias("id")).join(told, ["model_id", "pset"])
    kinds = of(inst, "IFCWALLTYPE", "IFCCURTAINWALLTYPE").select("model_id", F.col("id").alias("kind"), F.explode(refs(arg(5))).alias("pset")).join(told, ["model_id", "pset"])
    typed = of(inst, "IFCRELDEFINESBYTYPE").select("model_id", F.col("id").alias("rel"), ref(arg(5)).alias("kind"), F.explode(refs(arg(4))).alias("id")).join(kinds, ["model_id", "kind"])
    both = own.select("model_id", "id", "is_external", F.struct(F.lit(0).alias("k"), "rel").alias("o")).unionByName(typed.select("model_id", "id", "is_external", F.struct(F.lit(1).alias("k"), "rel").alias("o")))
    return both.groupBy("model_id", "id").agg(F.min_by("is_external", "o").alias("is_external"))


def containers(inst: DataFrame, rooted: DataFrame) -> DataFrame:
    """model_id, id, container_class, container_name: where an instance, or the whole that it is a part of, is contained."""
    held = of(inst, "IFCRELCONTAINEDINSPATIALSTRUCTURE").select("model_id", F.col("id").alias("rel"), ref(arg(5)).alias("holder"), F.explode(refs(arg(4))).alias("top"))
    held = held.groupBy("model_id", "top").agg(F.min_by("holder", "rel").alias("holder"))
    parts = of(inst, "IFCRELAGGREGATES").select("model_id", F.col("id").alias("rel"), ref(arg(4)).alias("before"), F.explode(refs(arg(5))).alias("node"))
    parts = parts.groupBy("model_id", "node").agg(F.min_by("before", "rel").cast("string").alias("before")).withColumn("node", F.col("node").cast("string"))
    whole = steps_back(parts, ["model_id"]).groupBy("model_id", "node").agg(F.max_by("step", "back").cast("long").alias("whole")).select("model_id", F.col("node").cast("long").alias("id"), "whole")
    tops = rooted.select("model_id", "id").join(whole, ["model_id", "id"], "left").withColumn("top", F.coalesce("whole", "id"))
    holder = rooted.select("model_id", F.col("id").alias("holder"), F.col("ifc_class").alias("container_class"), F.col("name").alias("container_name"))
    return tops.join(held, ["model_id", "top"]).join(holder, ["model_id", "holder"]).select("model_id", "id", "container_class", "container_name")


def element_table(inst: DataFrame, rooted: DataFrame) -> DataFrame:
    """The elements, in the order of their instance numbers. inst has path and the schemas of files too.

    Transport elements have no predefined type before the fourth version of the schema. Heights of storeys and widths of
    doors are in the file's unit, as they stand there.
    """
    kind = F.col("type")
    listed = rooted.where(F.col("ifc_class").isin(*CLASSES)).select("model_id", "id", "ifc_class")
    new = ~F.coalesce(F.col("step_schema"), F.lit("")).startswith("IFC2X")
    predefined = F.when(kind.startswith("IFCSLAB") | ((kind == "IFCTRANSPORTELEMENT") & new), F.trim(arg(8), F.lit(".")))
    headers = of(inst, HEADER).groupBy("path").agg(F.min(arg(0)).alias("step_schema"))
    rows = of(inst, *_upper(CLASSES)).join(listed, ["model_id", "id"]).join(headers, "path", "left").select(
        "model_id", arg(0).alias("element_id"), "ifc_class", F.col("id").alias("seq"), arg(2).alias("name"), F.when(kind != "IFCBUILDINGSTOREY", arg(4)).alias("object_type"), arg(3).alias("description"),
        predefined.alias("predefined_type"), F.when(kind.startswith("IFCDOOR"), F.expr("try_cast(get(args, 9) AS double)")).alias("overall_width"),
        F.when(kind == "IFCBUILDINGSTOREY", arg(9)).alias("elevation"), "id",
    )
    rows = rows.join(external_walls(inst), ["model_id", "id"], "left").join(containers(inst, rooted), ["model_id", "id"], "left")
    kinds = dict(c.split() for c in schema.ELEMENTS.split(", "))
    return rows.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def relation_tables(inst: DataFrame, rooted: DataFrame) -> dict[str, DataFrame]:
    """The four tables of relations, by identity; seq is the relation's instance number."""
    guid = lambda name: rooted.select("model_id", F.col("id").alias(f"__{name}"), F.col("guid").alias(name))

    def table(types: list[str], one: dict[str, int], many: dict[str, int] | None = None) -> DataFrame:
        rows = of(inst, *_upper(types)).select("model_id", F.col("id").alias("seq"), "args")
        rows = rows.select("model_id", "seq", "args", *(ref(arg(i)).alias(f"__{n}") for n, i in one.items()))
        for n, i in (many or {}).items():
            rows = rows.select("*", F.posexplode(refs(arg(i))).alias("child_pos", f"__{n}"))
        for n in [*one, *(many or {})]:
            rows = rows.join(guid(n), ["model_id", f"__{n}"])
        return rows.select("model_id", "seq", *one, *(many or {}), *(["child_pos"] if many else []))

    made = {
        "rel_fills": table(["IfcRelFillsElement"], {"element_id": 5, "opening_id": 4}),
        "rel_voids": table(["IfcRelVoidsElement"], {"opening_id": 5, "wall_id": 4}),
        "rel_boundary": table([r for r in RELATIONS if r.startswith("IfcRelSpaceBoundary")], {"element_id": 5}),
        "rel_aggregates": table(["IfcRelAggregates"], {"parent_id": 4}, {"child_id": 5}),
    }
    for k, df in made.items():
        made[k] = df.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.TABLES[k].split(", "))))
    return made


def model_names(path: Column) -> Column:
    """A file's name without its folder and suffix."""
    return F.regexp_replace(F.url_decode(F.replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")


def _opened(spark: SparkSession, path: str, name: Callable[[Column], Column], types: list[str]) -> DataFrame:
    """model_id, path, id, type, args: the instances of the types and the schemas of files, written once."""
    found = instances(statements(spark, path), types, header=True)
    inst = written(found.withColumn("model_id", name(F.col("path"))), "type")
    twice = inst.groupBy("model_id").agg(F.count_distinct("path").alias("n")).where("n > 1").select("model_id").limit(1).collect()
    if twice:
        raise ValueError(f"several files are called {twice[0][0]}")
    return inst


def _vertices(inst: DataFrame) -> DataFrame:
    once = Window.partitionBy("model_id", "element_id").orderBy("id")
    shaped = of(inst, *_upper(CLASSES)).select("model_id", "id", arg(0).alias("element_id"), ref(arg(5)).alias("placement"), ref(arg(6)).alias("shape")).where("shape IS NOT NULL")
    shaped = shaped.withColumn("nth", F.row_number().over(once)).where("nth = 1").select(*KEY, "placement", "shape")
    points = world_vertices(inst, shaped)
    return points.select(*(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in schema.VERTICES.split(", "))))


def read_elements(spark: SparkSession, path: str, name: Callable[[Column], Column] = model_names) -> DataFrame:
    """The elements of read_ifc() alone; no shape is looked at."""
    inst = _opened(spark, path, name, _upper(CLASSES + NAMED + RELATIONS))
    return element_table(inst, cut(_rooted(inst)))


def read_relations(spark: SparkSession, path: str, name: Callable[[Column], Column] = model_names) -> dict[str, DataFrame]:
    """The four relations of read_ifc() alone, by the names that they have in a Building."""
    inst = _opened(spark, path, name, _upper(CLASSES + NAMED + RELATIONS))
    return relation_tables(inst, cut(_rooted(inst)))


def read_vertices(spark: SparkSession, path: str, name: Callable[[Column], Column] = model_names) -> DataFrame:
    """The vertices of read_ifc() alone."""
    return _vertices(_opened(spark, path, name, [*_upper(CLASSES), *SHAPE_TYPES]))


def read_ifc(spark: SparkSession, path: str, name: Callable[[Column], Column] = model_names) -> Building:
    """The building tables of the IFC files below path; model_id is what name makes of a file's path, by default its name.

    Each file is read in byte ranges and no file goes through one task; its instances are written once, by type, in the
    folder of spark.checkpoint.dir. Vertices are in the world and in metres: extruded solids of rectangles, circles (as
    32 corners), polylines and indexed curves; faceted solids and surfaces, triangulated and polygonal face sets, mapped
    items. Solids that are cut are taken before the cut. Elements without such a shape have no vertices. Two files of one
    model_id raise ValueError; no file at all gives empty tables.
    """
    inst = _opened(spark, path, name, [*_upper(CLASSES + NAMED + RELATIONS), *SHAPE_TYPES])
    rooted = cut(_rooted(inst))
    return Building(cut(element_table(inst, rooted)), cut(_vertices(inst)), **relation_tables(inst, rooted))
