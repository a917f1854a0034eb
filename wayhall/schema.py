"""Schemas of the building tables and of the graph relations. All tables are keyed by model_id."""

from __future__ import annotations

ELEMENTS = (
    "model_id string, element_id string, ifc_class string, seq long, name string, object_type string, description string, "
    "predefined_type string, overall_width double, elevation string, is_external boolean, container_class string, container_name string"
)
VERTICES = "model_id string, element_id string, vseq int, x double, y double, z double"
REL_FILLS = "model_id string, seq long, element_id string, opening_id string"
REL_VOIDS = "model_id string, seq long, opening_id string, wall_id string"
REL_BOUNDARY = "model_id string, seq long, element_id string"
REL_AGGREGATES = "model_id string, seq long, parent_id string, child_id string, child_pos int"
TABLES = {
    "elements": ELEMENTS,
    "vertices": VERTICES,
    "rel_fills": REL_FILLS,
    "rel_voids": REL_VOIDS,
    "rel_boundary": REL_BOUNDARY,
    "rel_aggregates": REL_AGGREGATES,
}

#: Node types, default names and edge types are part of the data that consumers read.
ROOM, SLAB, DOOR, STAIR, RAMP, LIFT = "Habitacion", "Suelo", "Puerta", "Escalera", "Rampa", "Ascensor"
ROOM_NAME, SLAB_NAME, DOOR_NAME = "Estancia", "Suelo/Pasillo", "Puerta"
STAIR_NAMES, RAMP_NAMES, LIFT_NAME = ("Escalera Inicio", "Escalera Fin"), ("Rampa Inicio", "Rampa Fin"), "Ascensor"
UNKNOWN_STOREY, ONLY_STOREY, UNKNOWN_LEVEL = "Nivel Desconocido", "Nivel 0", "Desconocido"
DOOR_AREA, VERTICAL_AREA, VERTICAL_DOOR = "puerta_espacio", "vertical_espacio", "vertical_puerta"
FLIGHT, LANDING, RAMP_EDGE, LIFT_EDGE, PLAIN = "escalera", "escalera_rellano", "rampa", "ascensor", "camino"
BARRIER = 999999.0

WALLS = ("IfcWall", "IfcWallStandardCase", "IfcCurtainWall")
SCANNED_WALLS = ("IfcWall", "IfcWallStandardCase")

#: Classes that a scan for a class also returns.
SUBTYPES = {
    "IfcSlab": ("IfcSlab", "IfcSlabStandardCase", "IfcSlabElementedCase"),
    "IfcDoor": ("IfcDoor", "IfcDoorStandardCase"),
    "IfcWall": ("IfcWall", "IfcWallStandardCase", "IfcWallElementedCase"),
    "IfcWallStandardCase": ("IfcWallStandardCase",),
}

#: Positions of stages in the order in which nodes and edges come to be; see ordinal().
STAGES = {ROOM: 1, SLAB: 2, DOOR: 3, STAIR: 4, "landing": 5, "landing_near": 6, RAMP: 7, LIFT: 8, "cabins": 9}
