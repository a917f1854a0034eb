"""Writing the micro building as a STEP file, with nested placements, for tests of the reader."""

from tests.micro import ELEMENTS

#: Where the site's system stands: its x is the world's y, its y the world's -x.
SITE = (100.0, 20.0, 0.0)
HEAD = "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('a;b','',(''),(''),'','','');\nFILE_SCHEMA(('{schema}'));\nENDSEC;\nDATA;\n"


class File:
    def __init__(self, schema="IFC4", scale=1.0):
        self.lines, self.n, self.schema, self.scale = [], 0, schema, scale

    def add(self, kind, *args):
        self.n += 1
        self.lines.append(f"#{self.n}={kind}({','.join(map(self.said, args))});")
        return Ref(self.n)

    def said(self, a):
        if a is None:
            return "$"
        if isinstance(a, Ref):
            return f"#{a.n}"
        if isinstance(a, Raw):
            return a.text
        if isinstance(a, (list, tuple)):
            return "(" + ",".join(map(self.said, a)) + ")"
        if isinstance(a, float):
            text = f"{a * self.scale!r}".replace("e", "E")
            return text if "E" in text else text.rstrip("0")
        return "'" + "".join(f"\\X\\{ord(c):02X}" if c < " " else f"\\X2\\{ord(c):04X}\\X0\\" if c > "~" else "''" if c == "'" else c for c in a) + "'"

    def text(self, end=";\n"):
        body = "\n".join(self.lines)
        return HEAD.format(schema=self.schema) + body + "\nENDSEC;\nEND-ISO-10303-21;\n"


class Ref:
    def __init__(self, n):
        self.n = n


class Raw:
    def __init__(self, text):
        self.text = text


def to_site(x, y, z):
    return y - SITE[1], SITE[0] - x, z - SITE[2]


def placement(f, up, at, **directions):
    point = f.add("IFCCARTESIANPOINT", list(at))
    ways = [f.add("IFCDIRECTION", [Raw(f"{c:.1f}") for c in d]) if d else None for d in (directions.get("axis"), directions.get("ref"))]
    return f.add("IFCLOCALPLACEMENT", up, f.add("IFCAXIS2PLACEMENT3D", point, *ways))


def shape(f, items, kind="Body"):
    return f.add("IFCPRODUCTDEFINITIONSHAPE", None, None, [f.add("IFCSHAPEREPRESENTATION", None, "Axis", "Curve2D", []), f.add("IFCSHAPEREPRESENTATION", None, kind, "Solid", items)])


def solid(f, mesh, at):
    """A box as an extruded polygon or rectangle, other meshes as a list of points; at is where the element stands."""
    own = [tuple(a - b for a, b in zip(to_site(*p), at, strict=True)) for p in mesh]
    up = f.add("IFCDIRECTION", [Raw("0."), Raw("0."), Raw("1.")])
    if len(mesh) == 8 and len({p[2] for p in mesh}) == 2:
        low = f.add("IFCAXIS2PLACEMENT3D", f.add("IFCCARTESIANPOINT", [0.0, 0.0, own[0][2]]), None, None)
        corners = [f.add("IFCCARTESIANPOINT", list(p[:2])) for p in own[:4]]
        profile = f.add("IFCARBITRARYCLOSEDPROFILEDEF", Raw(".AREA."), None, f.add("IFCPOLYLINE", [*corners, corners[0]]))
        return f.add("IFCEXTRUDEDAREASOLID", profile, low, up, own[4][2] - own[0][2])
    return f.add("IFCTRIANGULATEDFACESET", f.add("IFCCARTESIANPOINTLIST3D", [list(map(float, p)) for p in own]), None, None, Raw("((1,2,3))"), None)


def micro_file(schema="IFC4", scale=1.0, container="st2"):
    """Text of a file whose tables are those of micro.py, its elements in the same order."""
    f = File(schema, scale)
    f.add("IFCUNITASSIGNMENT", [f.add("IFCSIUNIT", Raw("*"), Raw(".LENGTHUNIT."), Raw(".MILLI." if scale == 1000 else "$"), Raw(".METRE."))])
    site = placement(f, None, SITE, axis=(0, 0, 1), ref=(0, 1, 0))
    floor = placement(f, site, (1.0, 2.0, 0.5))
    ids = {}
    for ident, kind, own, mesh in ELEMENTS:
        place = body = None
        if mesh:
            low = to_site(*mesh[0])
            place = placement(f, floor, [a - b for a, b in zip(low, (1.0, 2.0, 0.5), strict=True)])
            body = shape(f, [solid(f, mesh, low)])
        head = [ident, None, own.get("name"), own.get("description"), own.get("object_type"), place, body]
        predefined = Raw(f".{own['predefined_type']}.") if own.get("predefined_type") else None
        if kind == "IfcBuildingStorey":
            args = [*head, None, Raw(".ELEMENT."), Raw(own["elevation"] if "." in own["elevation"] else own["elevation"] + ".")]
        elif kind == "IfcDoor":
            args = [*head, None, Raw("2.1"), Raw(str(own["overall_width"])) if "overall_width" in own else None, Raw(".DOOR."), None, None]
        else:
            args = [*head, None, predefined]
        ref = f.add(kind.upper(), *args)
        ids.setdefault(ident, ref)
        if "is_external" in own:
            prop = f.add("IFCPROPERTYSINGLEVALUE", "IsExternal", None, Raw(f"IFCBOOLEAN({'.T.' if own['is_external'] else '.F.'})"), None)
            f.add("IFCRELDEFINESBYPROPERTIES", f"p{f.n}", None, None, None, [ref], f.add("IFCPROPERTYSET", f"s{f.n}", None, "Pset_WallCommon", None, [prop]))
        if "container_class" in own:
            f.add("IFCRELCONTAINEDINSPATIALSTRUCTURE", f"c{f.n}", None, None, None, [ref], ids[container])
    openings = {o: f.add("IFCOPENINGELEMENT", o, None, None, None, None, None, None, None) for o in ("o0", "o1", "o4")}
    for opening, element in (("o0", "D1"), ("o1", "D1"), ("o4", "D4")):
        f.add("IFCRELFILLSELEMENT", f"f{f.n}", None, None, None, openings[opening], ids[element])
    for opening, wall in (("o0", "S1"), ("o1", "W1"), ("o1", "W2")):
        f.add("IFCRELVOIDSELEMENT", f"v{f.n}", None, None, None, ids[wall], openings[opening])
    for element in ("W2", "S1", "W2"):
        f.add("IFCRELSPACEBOUNDARY", f"b{f.n}", None, None, None, ids["A"], ids[element], None, Raw(".PHYSICAL."), Raw(".INTERNAL."))
    for parent, children in (("ST", ["F2", "F1"]), ("A", ["F3"])):
        f.add("IFCRELAGGREGATES", f"a{f.n}", None, None, None, ids[parent], [ids[c] for c in children])
    return f.text()
