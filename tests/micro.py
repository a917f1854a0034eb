"""A hand-written building: every stage, every edge type, and the border cases of their rules."""

from wayhall import schema
from wayhall.sources.tables import Building

M = "m1"


def box(x0, y0, z0, x1, y1, z1):
    return [(x0, y0, z0), (x1, y0, z0), (x1, y1, z0), (x0, y1, z0), (x0, y0, z1), (x1, y0, z1), (x1, y1, z1), (x0, y1, z1)]


#: id, class, attributes, mesh
ELEMENTS = [
    ("st0", "IfcBuildingStorey", {"name": "\tP0\n", "elevation": "0"}, []),
    ("st1", "IfcBuildingStorey", {"name": "P1", "elevation": "99"}, []),
    ("st2", "IfcBuildingStorey", {"name": "P2", "elevation": "6.0"}, []),
    ("st1b", "IfcBuildingStorey", {"name": "P1", "elevation": "3"}, []),
    ("A", "IfcSpace", {"name": "Sala"}, box(0, 0, 0, 4, 4, 2.5)),
    ("B", "IfcSpace", {"name": ""}, box(4, 0, 0, 8, 4, 2.5)),
    ("C", "IfcSpace", {"name": "Arriba"}, box(0, 0, 3, 8, 4, 5.5)),
    ("T", "IfcSpace", {"name": "Medio"}, box(20, 20, 1.5, 22, 22, 2.5)),  # base midway between storeys: the lower one
    ("N", "IfcSpace", {"name": "Sin malla"}, []),
    ("S1", "IfcSlab", {"predefined_type": "FLOOR"}, box(10, 0, 0, 19, 50, 0.2)),
    ("S2", "IfcSlab", {}, box(100, 0, 0, 111, 11, 0.2)),  # too large both ways
    ("S3", "IfcSlab", {"predefined_type": "roof"}, box(120, 0, 0, 122, 2, 0.2)),
    ("S4", "IfcSlab", {}, box(1, 1, 0, 3, 3, 0.2)),  # inside room A
    ("S5", "IfcSlab", {}, box(12, 24, 0, 16, 26, 0.2)),  # inside S1
    ("S6", "IfcSlab", {}, box(30, 0, 0, 34, 4, 0.2)),
    ("S7", "IfcSlab", {}, box(32, 0, 0, 36, 4, 0.2)),  # its centroid lies on S6's border
    ("S8", "IfcSlab", {}, box(34.05, 0, 0, 38.05, 4, 0.2)),  # in S7 only, which is refused
    ("D1", "IfcDoor", {"name": "Entre", "overall_width": 0.9}, box(3.9, 1.9, 0, 4.1, 2.1, 2)),
    ("D2", "IfcDoor", {"overall_width": 0.84}, box(7.95, 1.95, 0, 8.05, 2.05, 2)),
    ("D3", "IfcDoor", {}, box(60, 60, 0, 61, 60.2, 2)),  # no area near; unknown width
    ("D4", "IfcDoor", {"overall_width": 0.85}, box(6.9, 3.9, 3, 7.1, 4.1, 5)),
    ("W1", "IfcWall", {"is_external": True, "container_class": "IfcBuildingStorey", "container_name": "Otro"}, [(4, 0, 0), (4, 4, 0), (4, 4, 3), (4, 0, 3)]),
    ("W2", "IfcWallStandardCase", {"is_external": False}, [(0, 0, 0), (3, 3, 0), (3.0001, 3.0001, 0.1), (0, 0.1, 0), (0, 0, 3)]),
    ("W3", "IfcWallStandardCase", {"is_external": True}, [(50, 0, 3), (55, 0, 3)]),
    ("F1", "IfcStairFlight", {}, [(1, 1, 0), (2, 1, 0), (1, 3, 1.5), (2, 3, 1.5)]),
    ("F2", "IfcStairFlight", {}, [(1, 3.2, 1.5), (2, 3.2, 1.5), (1, 1, 3), (2, 1, 3)]),
    ("F3", "IfcStairFlight", {}, [(1.5, 1.5, 3.2), (1.5, 3, 6)]),
    ("ST", "IfcStair", {}, []),
    ("R1", "IfcRamp", {}, [(5, 1, 0), (5, 3, 0.16)]),
    ("R1", "IfcRampFlight", {}, []),
    ("R2", "IfcRampFlight", {}, [(5, 1, 0), (5, 3, 0.14)]),
    ("L1", "IfcTransportElement", {"name": "forklift"}, box(7, 1, 0, 8.5, 2.5, 6)),
    ("L2", "IfcTransportElement", {"predefined_type": " escalator "}, box(0, 0, 0, 2, 2, 6)),
    ("L3", "IfcTransportElement", {"predefined_type": "ELEVATOR"}, box(40, 0, 0, 41.5, 1.5, 2)),
    ("L4", "IfcTransportElement", {"predefined_type": "ELEVATOR"}, box(41.5, 0, 3, 43, 1.5, 5)),
    ("L5", "IfcTransportElement", {"predefined_type": "ELEVATOR"}, box(43, 0, 6, 44.5, 1.5, 8)),  # near L4, not near L3
    ("L6", "IfcTransportElement", {}, box(60, 61, 0, 61.5, 62.5, 5.8)),  # no word, but a door near
    ("L7", "IfcTransportElement", {}, box(90, 90, 0, 91.5, 91.5, 5.8)),  # neither
]


def rows(model_id=M):
    elements, vertices = [], []
    names = [c.split()[0] for c in schema.ELEMENTS.split(", ")]
    seen = set()
    for seq, (ident, kind, attributes, mesh) in enumerate(ELEMENTS):
        own = {"model_id": model_id, "element_id": ident, "ifc_class": kind, "seq": seq} | attributes
        elements.append(tuple(own.get(n) for n in names))
        if ident not in seen:
            vertices += [(model_id, ident, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(mesh)]
        seen.add(ident)
    return elements, vertices


def building(spark, model_id=M):
    elements, vertices = rows(model_id)
    make = lambda data, kind: spark.createDataFrame(data, kind)
    return Building(
        make(elements, schema.ELEMENTS),
        make(vertices, schema.VERTICES),
        make([(model_id, 1, "D1", "o0"), (model_id, 2, "D1", "o1"), (model_id, 3, "D4", "o4")], schema.REL_FILLS),
        make([(model_id, 1, "o0", "S1"), (model_id, 2, "o1", "W1"), (model_id, 3, "o1", "W2")], schema.REL_VOIDS),
        make([(model_id, 1, "W2"), (model_id, 2, "S1"), (model_id, 3, "W2")], schema.REL_BOUNDARY),
        make([(model_id, 1, "ST", "F2", 0), (model_id, 1, "ST", "F1", 1), (model_id, 1, "A", "F3", 2)], schema.REL_AGGREGATES),
    )
