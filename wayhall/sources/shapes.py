"""Vertices of elements in the world, from the placements and solids of a table of STEP instances.

All elements at once: chains of placements are composed by doubling, mapped items and operands of cut solids are followed in
rounds, points come from joins. inst has model_id, id, type, args.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.functions.matrix import CELLS, framed, identity, moved, parts, product
from wayhall.plans.chains import composed
from wayhall.plans.checkpoint import cut
from wayhall.sources.step import numbers, ref, refs

#: Prefixes of SI units.
PREFIXES = {"EXA": 1e18, "PETA": 1e15, "TERA": 1e12, "GIGA": 1e9, "MEGA": 1e6, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1, "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6, "NANO": 1e-9, "PICO": 1e-12, "FEMTO": 1e-15, "ATTO": 1e-18}
#: Corners of a circle, and how deep mapped items and operands may be nested.
CORNERS, DEEPEST = 32, 32

#: The types of instances that a shape may be made of.
PROFILES = ["IFCRECTANGLEPROFILEDEF", "IFCCIRCLEPROFILEDEF", "IFCARBITRARYCLOSEDPROFILEDEF", "IFCARBITRARYPROFILEDEFWITHVOIDS"]
SHELLS = ["IFCFACETEDBREP", "IFCFACETEDBREPWITHVOIDS", "IFCSHELLBASEDSURFACEMODEL", "IFCFACEBASEDSURFACEMODEL"]
FACE_SETS = ["IFCTRIANGULATEDFACESET", "IFCPOLYGONALFACESET"]
CUT = ["IFCBOOLEANRESULT", "IFCBOOLEANCLIPPINGRESULT"]
TYPES = [
    "IFCLOCALPLACEMENT", "IFCAXIS2PLACEMENT2D", "IFCAXIS2PLACEMENT3D", "IFCCARTESIANPOINT", "IFCDIRECTION", "IFCPRODUCTDEFINITIONSHAPE", "IFCSHAPEREPRESENTATION",
    "IFCMAPPEDITEM", "IFCREPRESENTATIONMAP", "IFCCARTESIANTRANSFORMATIONOPERATOR3D", "IFCEXTRUDEDAREASOLID", *PROFILES, "IFCPOLYLINE", "IFCINDEXEDPOLYCURVE",
    "IFCCARTESIANPOINTLIST2D", "IFCCARTESIANPOINTLIST3D", *SHELLS, "IFCCLOSEDSHELL", "IFCOPENSHELL", "IFCCONNECTEDFACESET", "IFCFACE", "IFCFACEOUTERBOUND", "IFCFACEBOUND", "IFCPOLYLOOP",
    *FACE_SETS, *CUT, "IFCUNITASSIGNMENT", "IFCSIUNIT", "IFCCONVERSIONBASEDUNIT", "IFCMEASUREWITHUNIT",
]


def arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def of(inst: DataFrame, *types: str) -> DataFrame:
    return inst.where(F.col("type").isin(*types))


def _lookup(inst: DataFrame, name: str, value: Column, *types: str) -> DataFrame:
    """model_id, name (the id), v_name (the value) of the types' instances, to join by a reference called name."""
    return of(inst, *types).select("model_id", F.col("id").alias(name), value.alias(f"v_{name}"))


def _cells() -> dict[str, Column]:
    return {c: F.col(c) for c in CELLS}


def unit_scales(inst: DataFrame) -> DataFrame:
    """model_id, scale: metres in a unit of length; models that name none have no row."""
    prefix = F.create_map(*(F.lit(x) for k, v in PREFIXES.items() for x in (k, v)))
    metric = of(inst, "IFCSIUNIT").where(arg(1) == ".LENGTHUNIT.").select("model_id", F.col("id").alias("unit"), F.coalesce(F.element_at(prefix, F.trim(arg(2), F.lit("."))), F.lit(1.0)).alias("scale"))
    other = of(inst, "IFCCONVERSIONBASEDUNIT").where(arg(1) == ".LENGTHUNIT.").select("model_id", F.col("id").alias("unit"), ref(arg(3)).alias("measure"))
    measure = of(inst, "IFCMEASUREWITHUNIT").select("model_id", F.col("id").alias("measure"), F.get(numbers(arg(0)), F.lit(0)).alias("n"), ref(arg(1)).alias("base"))
    other = other.join(measure, ["model_id", "measure"]).join(metric.select("model_id", F.col("unit").alias("base"), F.col("scale").alias("s")), ["model_id", "base"])
    units = metric.unionByName(other.select("model_id", "unit", (F.col("n") * F.col("s")).alias("scale")))
    used = of(inst, "IFCUNITASSIGNMENT").select("model_id", F.explode(refs(arg(0))).alias("unit"))
    return units.join(used, ["model_id", "unit"]).groupBy("model_id").agg(F.min_by("scale", "unit").alias("scale"))


def axes(inst: DataFrame) -> DataFrame:
    """model_id, axis (the id) and CELLS of all axis placements, in the plane or in space."""
    point = _lookup(inst, "place", numbers(arg(0)), "IFCCARTESIANPOINT")
    way = lambda name: _lookup(inst, name, numbers(arg(0)), "IFCDIRECTION")
    flat = F.col("type") == "IFCAXIS2PLACEMENT2D"
    rows = of(inst, "IFCAXIS2PLACEMENT3D", "IFCAXIS2PLACEMENT2D").select(
        "model_id", F.col("id").alias("axis"), ref(arg(0)).alias("place"), F.when(~flat, ref(arg(1))).alias("up"), F.when(flat, ref(arg(1))).otherwise(ref(arg(2))).alias("near")
    )
    rows = rows.join(point, ["model_id", "place"], "left").join(way("up"), ["model_id", "up"], "left").join(way("near"), ["model_id", "near"], "left")
    return framed(rows, "v_place", "v_up", "v_near").select("model_id", "axis", *CELLS)


def world_placements(inst: DataFrame, axis: DataFrame) -> DataFrame:
    """model_id, placement (the id) and CELLS of all local placements in the world."""
    rows = of(inst, "IFCLOCALPLACEMENT").select("model_id", F.col("id").alias("placement"), ref(arg(0)).alias("up"), ref(arg(1)).alias("axis"))
    rows = _or_identity(rows.join(axis, ["model_id", "axis"], "left"))
    return composed(rows, ["model_id"], CELLS, product, "placement")


def _or_identity(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in identity().items()})


def _within(df: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """df, its CELLS followed by those of inner (model_id, key, CELLS) where there are any."""
    told = df.join(inner.select("model_id", key, *(F.col(c).alias(f"in_{c}") for c in CELLS)), ["model_id", key], "left")
    own = {c: F.coalesce(F.col(f"in_{c}"), v) for c, v in identity().items()}
    both = product(_cells(), own)
    kept = [c for c in df.columns if c not in CELLS]
    return told.select(*kept, *(both[c].alias(c) for c in CELLS))


def _operators(inst: DataFrame) -> DataFrame:
    """model_id, target (the id) and CELLS of transformations: axes, scale and place."""
    point, way = _lookup(inst, "place", numbers(arg(0)), "IFCCARTESIANPOINT"), lambda n: _lookup(inst, n, numbers(arg(0)), "IFCDIRECTION")
    rows = of(inst, "IFCCARTESIANTRANSFORMATIONOPERATOR3D").select("model_id", F.col("id").alias("target"), ref(arg(0)).alias("near"), ref(arg(2)).alias("place"), F.coalesce(arg(3).cast("double"), F.lit(1.0)).alias("scale"), ref(arg(4)).alias("up"))
    rows = rows.join(point, ["model_id", "place"], "left").join(way("up"), ["model_id", "up"], "left").join(way("near"), ["model_id", "near"], "left")
    rows = framed(rows, "v_place", "v_up", "v_near")
    return rows.select("model_id", "target", *((F.col(c) * F.col("scale") if c[2] != "3" else F.col(c)).alias(c) for c in CELLS))


def solid_items(inst: DataFrame, elements: DataFrame, axis: DataFrame) -> DataFrame:
    """model_id, element_id, item (the id), type, path (where it stands in the element) and CELLS of the solids of elements.

    elements has model_id, element_id, placement, shape. Bodies only: representations called Body, Facetation or nothing.
    A mapped item stands for the items of its map; a cut solid for what it is cut from. Deeper than DEEPEST is an error.
    """
    placed = elements.join(world_placements(inst, axis), ["model_id", "placement"], "left")
    reps = of(inst, "IFCSHAPEREPRESENTATION").where(F.coalesce(arg(1), F.lit("Body")).isin("Body", "Facetation")).select("model_id", F.col("id").alias("rep"), refs(arg(3)).alias("items"))
    listed = of(inst, "IFCPRODUCTDEFINITIONSHAPE").select("model_id", F.col("id").alias("shape"), F.posexplode(refs(arg(2))).alias("nth", "rep")).join(reps, ["model_id", "rep"])
    rows = _or_identity(placed).join(listed, ["model_id", "shape"]).select("model_id", "element_id", *CELLS, "nth", F.posexplode("items").alias("pos", "item"))
    rows = rows.select("model_id", "element_id", "item", F.array("nth", "pos").alias("path"), *CELLS)
    kinds = inst.select("model_id", F.col("id").alias("item"), "type")
    maps = of(inst, "IFCREPRESENTATIONMAP").select("model_id", F.col("id").alias("source"), ref(arg(0)).alias("axis"), ref(arg(1)).alias("rep")).join(reps, ["model_id", "rep"])
    uses = of(inst, "IFCMAPPEDITEM").select("model_id", F.col("id").alias("item"), ref(arg(0)).alias("source"), ref(arg(1)).alias("target"))
    first = of(inst, *CUT).select("model_id", F.col("id").alias("item"), ref(arg(1)).alias("operand"))
    target, done = _operators(inst), None
    now = cut(rows.join(kinds, ["model_id", "item"]))
    for _ in range(DEEPEST):
        leaves = now.where(~F.col("type").isin("IFCMAPPEDITEM", *CUT))
        done = leaves if done is None else done.unionByName(leaves)
        more = now.where(F.col("type").isin("IFCMAPPEDITEM", *CUT)).drop("type")
        if more.isEmpty():
            return done
        mapped = _within(more.join(uses, ["model_id", "item"]), target, "target").join(maps, ["model_id", "source"])
        mapped = _within(mapped, axis, "axis").select("model_id", "element_id", "path", *CELLS, F.posexplode("items").alias("pos", "item"))
        mapped = mapped.withColumn("path", F.concat("path", F.array("pos"))).drop("pos")
        operand = more.join(first, ["model_id", "item"]).drop("item").withColumnRenamed("operand", "item")
        now = cut(mapped.unionByName(operand.select(mapped.columns)).join(kinds, ["model_id", "item"]))
    raise ValueError(f"mapped items or cut solids nested deeper than {DEEPEST}")


def _listed_points(lists: DataFrame, key: list[str], inst: DataFrame) -> DataFrame:
    """key, nth, p of rows key, points (references)."""
    rows = lists.select(*key, F.posexplode("points").alias("nth", "point"))
    return rows.join(_lookup(inst, "point", numbers(arg(0)), "IFCCARTESIANPOINT"), ["model_id", "point"]).select(*key, "nth", F.col("v_point").alias("p"))


def _coordinates(lists: DataFrame, key: list[str], width: int) -> DataFrame:
    """key, nth, p of rows key, flat (all numbers one after another)."""
    spots = F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / width).cast("int") - 1), lambda i: F.slice("flat", i * width + 1, F.lit(width)))
    return lists.where(F.size("flat") >= width).select(*key, F.posexplode(spots).alias("nth", "p"))


def profile_points(inst: DataFrame) -> DataFrame:
    """model_id, profile (the id), nth, p: corners of profiles, a closing one that repeats the first left out."""
    half = lambda i: arg(i).cast("double") / 2
    corner = lambda sx, sy: F.array(half(3) * sx, half(4) * sy)
    box = of(inst, "IFCRECTANGLEPROFILEDEF").select("model_id", F.col("id").alias("profile"), ref(arg(2)).alias("axis"), F.array(*(corner(*s) for s in ((-1, -1), (1, -1), (1, 1), (-1, 1)))).alias("all"))
    turn = [(math.cos(2 * math.pi * k / CORNERS), math.sin(2 * math.pi * k / CORNERS)) for k in range(CORNERS)]
    disc = of(inst, "IFCCIRCLEPROFILEDEF").select("model_id", F.col("id").alias("profile"), ref(arg(2)).alias("axis"), F.array(*(F.array(arg(3).cast("double") * a, arg(3).cast("double") * b) for a, b in turn)).alias("all"))
    made = _or_identity(box.unionByName(disc).join(axes(inst), ["model_id", "axis"], "left")).select("model_id", "profile", F.posexplode("all").alias("nth", "q"), *CELLS)
    made = made.select("model_id", "profile", "nth", F.array(*moved(_cells(), tuple(parts(F.col("q"))))[:2]).alias("p"))
    curves = of(inst, "IFCARBITRARYCLOSEDPROFILEDEF", "IFCARBITRARYPROFILEDEFWITHVOIDS").select("model_id", F.col("id").alias("profile"), ref(arg(2)).alias("curve"))
    line = curves.join(of(inst, "IFCPOLYLINE").select("model_id", F.col("id").alias("curve"), refs(arg(0)).alias("points")), ["model_id", "curve"]).drop("curve")
    index = curves.join(of(inst, "IFCINDEXEDPOLYCURVE").select("model_id", F.col("id").alias("curve"), ref(arg(0)).alias("list")), ["model_id", "curve"])
    index = index.join(of(inst, "IFCCARTESIANPOINTLIST2D").select("model_id", F.col("id").alias("list"), numbers(arg(0)).alias("flat")), ["model_id", "list"])
    key = ["model_id", "profile"]
    drawn = _listed_points(line, key, inst).unionByName(_coordinates(index.select(*key, "flat"), key, 2))
    xy = lambda c: F.struct(*(F.get(c, F.lit(i)) for i in (0, 1)))
    drawn = drawn.join(drawn.groupBy(*key).agg(F.min_by("p", "nth").alias("p0"), F.max("nth").alias("last")), key)
    return made.unionByName(drawn.where((F.col("nth") == 0) | (F.col("nth") < F.col("last")) | (xy("p") != xy("p0"))).select(*key, "nth", "p"))


def item_points(inst: DataFrame, axis: DataFrame) -> DataFrame:
    """model_id, item (the id), nth, p: vertices of solids and surfaces, in the item's own system."""
    key = ["model_id", "item"]
    swept = of(inst, "IFCEXTRUDEDAREASOLID").select("model_id", F.col("id").alias("item"), ref(arg(0)).alias("profile"), ref(arg(1)).alias("axis"), ref(arg(2)).alias("way"), arg(3).cast("double").alias("depth"))
    swept = swept.join(_lookup(inst, "way", numbers(arg(0)), "IFCDIRECTION"), ["model_id", "way"], "left")
    way = parts(F.coalesce("v_way", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    size = F.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])
    swept = _or_identity(swept.join(axis, ["model_id", "axis"], "left")).withColumn("rise", F.array(*(F.col("depth") * w / F.when(size > 0, size).otherwise(1.0) for w in way)))
    both = swept.join(profile_points(inst), ["model_id", "profile"]).select(*key, *CELLS, "nth", "p", "rise", F.explode(F.array(F.lit(0), F.lit(1))).alias("top"))
    spot = tuple(a + F.col("top") * F.get("rise", F.lit(i)) for i, a in enumerate([*parts(F.col("p"))[:2], F.lit(0.0)]))
    solid = both.select(*key, (F.col("nth") + F.col("top") * (1 << 24)).alias("nth"), F.array(*moved(_cells(), spot)).alias("p"))
    sets = of(inst, *FACE_SETS).select("model_id", F.col("id").alias("item"), ref(arg(0)).alias("list"))
    sets = sets.join(of(inst, "IFCCARTESIANPOINTLIST3D").select("model_id", F.col("id").alias("list"), numbers(arg(0)).alias("flat")), ["model_id", "list"])
    shells = of(inst, *SHELLS).select("model_id", F.col("id").alias("item"), F.posexplode(refs(arg(0))).alias("a", "shell"))
    step = lambda df, name, into, at, *types: df.join(of(inst, *types).select("model_id", F.col("id").alias(name), F.posexplode(refs(arg(0))).alias(at, into)), ["model_id", name]).drop(name)
    loops = step(step(shells, "shell", "face", "b", "IFCCLOSEDSHELL", "IFCOPENSHELL", "IFCCONNECTEDFACESET"), "face", "bound", "c", "IFCFACE")
    loops = step(step(loops, "bound", "loop", "d", "IFCFACEOUTERBOUND", "IFCFACEBOUND"), "loop", "point", "e", "IFCPOLYLOOP")
    # A point that several faces share is one vertex, where it comes first.
    order = F.min(F.struct("a", "b", "c", "d", "e")).alias("o")
    shared = loops.groupBy(*key, "point").agg(order).join(_lookup(inst, "point", numbers(arg(0)), "IFCCARTESIANPOINT"), ["model_id", "point"])
    shared = shared.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("o")) - 1).alias("nth"), F.col("v_point").alias("p"))
    return solid.unionByName(_coordinates(sets.select(*key, "flat"), key, 3)).unionByName(shared)


def world_vertices(inst: DataFrame, elements: DataFrame) -> DataFrame:
    """model_id, element_id, vseq, x, y, z in metres, of elements (model_id, element_id, placement, shape)."""
    axis = cut(axes(inst))
    found = solid_items(inst, elements, axis).join(item_points(inst, axis), ["model_id", "item"]).join(unit_scales(inst), "model_id", "left")
    spot = moved(_cells(), tuple(parts(F.col("p"))))
    scale = F.coalesce("scale", F.lit(1.0))
    rows = found.select("model_id", "element_id", "path", "item", "nth", *((c * scale).alias(n) for c, n in zip(spot, "xyz", strict=True)))
    order = Window.partitionBy("model_id", "element_id").orderBy("path", "item", "nth")
    return rows.select("model_id", "element_id", (F.row_number().over(order) - 1).alias("vseq"), "x", "y", "z")
