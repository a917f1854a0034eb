"""Merkle manifest of a dataset by an associative monoid of sparse forests (operator 11).

Rows are leaves. Each group (source) has a tree over its leaves in the order of their ids; the groups' roots, in order, are
the leaves of a top tree. Any runs of siblings up to the arity have one parent, so the shape follows from the counts.

A Forest holds nodes whose sibling run isn't complete, keyed by tree, level and index. As the arity of every run is known,
adding a node resolves it, and its parents, the moment the last sibling arrives, whatever the order: merging forests is
associative and commutative.

1. Leaves are hashed in the JVM, sorted into ranges and written. Counts by range and group give each leaf its index.
2. Each range becomes a Forest; only what it can't resolve leaves it, a few nodes for each level.
3. Tree reduction: FAN neighbouring forests are merged at a time, in rounds, each written, until the root is all there is.
4. Back down, each round tells its nodes their way to the root; at last each range tells its leaves. A way is the place
   and the siblings at every level; folding a leaf along it gives the root again, or another digest if the leaf isn't
   the one that was there.

No task holds more than a range of leaves, or FAN forests of a range's open nodes; the driver gets the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.llm.scratch import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, FAN, PER_RANGE = 3, 64, 100_000
#: The top tree's number; groups have theirs from 0.
TOP = -1
PLACE_BITS = 33  # of monotonically_increasing_id(): the row in its partition


def hashed(texts: str) -> str:
    return hashlib.sha256(texts.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields one after another: each - if null, else its UTF-8 length, a colon and itself."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*said), 256)


@lru_cache(4096)
def widths(n: int, arity: int) -> tuple[int, ...]:
    """Nodes at each level of a tree of n leaves, down to 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return tuple(out)


class Forest:
    """Nodes that wait for siblings, and the runs that were resolved here. sizes: leaves of each tree that may come up."""

    def __init__(self, sizes: dict[int, int], arity: int = ARITY):
        self.sizes, self.arity = sizes, arity
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}
        self.runs: dict[tuple[int, int, int], list[str]] = {}
        self.root: str | None = None

    def add(self, tree: int, level: int, index: int, digest: str) -> None:
        while True:
            width = widths(self.sizes[tree], self.arity)[level]
            if width == 1:
                if tree == TOP:
                    self.root = digest
                    return
                tree, level, index = TOP, 0, tree
                continue
            run, place = divmod(index, self.arity)
            key = (tree, level, run)
            here = self.open.setdefault(key, {})
            here[place] = digest
            if len(here) < min(self.arity, width - run * self.arity):
                return
            del self.open[key]
            self.runs[key] = members = [here[i] for i in range(len(here))]
            level, index, digest = level + 1, run, hashed("".join(members))

    def nodes(self) -> list[tuple[int, int, int, str]]:
        return [(tree, level, run * self.arity + place, d) for (tree, level, run), here in self.open.items() for place, d in here.items()]

    def merge(self, other: Forest) -> Forest:
        self.sizes = self.sizes | other.sizes
        for node in other.nodes():
            self.add(*node)
        self.root = self.root or other.root
        return self

    def way(self, tree: int, level: int, index: int, above: dict[tuple[int, int, int], list[str]], known: dict) -> list[str]:
        """Steps from a node to the root, each 'place:siblings'. above: of nodes that are open here; known: of parents met last."""
        if widths(self.sizes[tree], self.arity)[level] == 1:
            return [] if tree == TOP else self.way(TOP, 0, tree, above, known)
        run, place = divmod(index, self.arity)
        members = self.runs.get((tree, level, run))
        if members is None:
            return above[tree, level, index]
        if known.get((tree, level), (None, None))[0] != run:
            known[tree, level] = run, self.way(tree, level + 1, run, above, known)
        return [f"{place}:{''.join(members[:place] + members[place + 1 :])}", *known[tree, level][1]]


def fold(digest: str, steps: list[str]) -> str:
    for step in steps:
        place, siblings = step.split(":")
        at = 64 * int(place)
        digest = hashed(siblings[:at] + digest + siblings[at:])
    return digest


NODE = "part long, tree long, level int, index long, n long, digest string"
WAY = "part long, tree long, level int, index long, n long, steps string"


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [c.split() for c in kinds.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], arrow[kind]) for i, (name, kind) in enumerate(names)})


def _opened(forest: Forest, part: int) -> pa.Table:
    """The forest's open nodes, or the root at level -1."""
    found = [(part, *node[:3], forest.sizes[node[0]], node[3]) for node in forest.nodes()]
    return _table(found + ([(part, TOP, -1, 0, 0, forest.root)] if forest.root else []), NODE)


def _of_leaves(rows: pa.Table, segments: list[dict], groups: int, arity: int) -> tuple[Forest, list[tuple[int, int]]]:
    """A range's forest, and tree and index of each of its rows, in order."""
    forest, at = Forest({s["tree"]: s["n"] for s in segments} | {TOP: groups}, arity), []
    for s in sorted(segments, key=lambda s: s["tree"]):
        at += [(s["tree"], s["start"] + i) for i in range(s["m"])]
    for (tree, index), leaf in zip(at, rows.column("leaf").to_pylist(), strict=True):
        forest.add(tree, 0, index, leaf.hex())
    return forest, at


def _merged(nodes: pa.Table, groups: int, arity: int) -> Forest:
    rows = nodes.to_pylist()
    forest = Forest({r["tree"]: r["n"] for r in rows} | {TOP: groups}, arity)
    for r in rows:
        forest.add(r["tree"], r["level"], r["index"], r["digest"])
    return forest


@dataclass
class Manifest:
    """root; the sorted leaves; the groups' pieces by range; and the open nodes of each round."""

    root: str
    groups: int
    arity: int
    fan: int
    leaves: DataFrame
    segments: DataFrame
    rounds: list[DataFrame]

    def _ways(self) -> DataFrame:
        """The way to the root of each node that is open in a range."""
        groups, arity, fan = self.groups, self.arity, self.fan
        found = self.leaves.sparkSession.createDataFrame([], WAY)
        for nodes in reversed(self.rounds):

            def run(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
                forest = _merged(own, groups, arity)
                above = {(r["tree"], r["level"], r["index"]): r["steps"].split(",") for r in told.to_pylist()}
                known: dict = {}
                rows = sorted(own.to_pylist(), key=lambda r: (r["tree"], r["level"], r["index"]))
                return _table([(r["part"], r["tree"], r["level"], r["index"], r["n"], ",".join(forest.way(r["tree"], r["level"], r["index"], above, known))) for r in rows], WAY)

            up = nodes.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up")
            found = materialise(up.cogroup(found.withColumnRenamed("part", "up").groupBy("up")).applyInArrow(run, WAY), "ways")
        return found

    def proofs(self, siblings: bool = False) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each leaf.

        proof_sha256 is of the siblings on the leaf's way to the root, level by level, left to right; with siblings, proof
        is the list of the steps, each its place among the siblings, a colon, and these. folded_root comes from the claimed
        leaf where there is one, else from the leaf.
        """
        groups, arity, root = self.groups, self.arity, self.root

        def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
            rows, told = rows.sort_by("place"), told.to_pylist()
            segments = [r for r in told if r["steps"] is None]
            forest, at = _of_leaves(rows, segments, groups, arity)
            above = {(r["tree"], r["level"], r["index"]): r["steps"].split(",") for r in told if r["steps"] is not None}
            known: dict = {}
            subroots: dict[int, str] = {}
            out, lists = [], []
            for (tree, index), leaf, claimed in zip(at, rows.column("leaf").to_pylist(), rows.column("claimed").to_pylist(), strict=True):
                leaf, steps = leaf.hex(), forest.way(tree, 0, index, above, known)
                if tree not in subroots:
                    subroots[tree] = fold(leaf, steps[: len(widths(forest.sizes[tree], arity)) - 1])
                folded = fold(claimed.hex() if claimed else leaf, steps)
                out.append((leaf, subroots[tree], root, hashed("".join(s.split(":")[1] for s in steps)), folded, folded == root))
                lists.append(steps)
            made = _table(out, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
            made = made.add_column(0, "id", rows.column("id"))
            return made.append_column("proof", pa.array(lists, pa.list_(pa.string()))) if siblings else made

        own = self.segments.select("part", "tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("index"), "n", "start", "m", F.lit(None).cast("string").alias("steps"))
        told = own.unionByName(self._ways(), allowMissingColumns=True)
        kind = self.leaves.schema["id"].dataType.simpleString()
        schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if siblings else "")
        return self.leaves.select("part", "place", "id", "leaf", "claimed").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, schema)


def _segments(leaves: DataFrame) -> DataFrame:
    """part, tree, start, m, n: how many leaves of each group lie in each range, from which index on, and the group's number and size."""
    counted = materialise(leaves.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("m")), "counted")
    own = Window.partitionBy("grp")
    before = F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = counted.withColumns({"start": F.coalesce(before, F.lit(0)), "n": F.sum("m").over(own), "first": F.min("part").over(own)})
    heads = pieces.where("part = first").select("grp", "first", F.row_number().over(Window.partitionBy("first").orderBy("grp")).alias("k"))
    # One row for each range in which a group begins: as many as there are ranges at most.
    ahead = heads.groupBy("first").agg(F.count(F.lit(1)).alias("c")).withColumn("ahead", F.sum("c").over(Window.orderBy("first")) - F.col("c")).drop("c")
    numbered = heads.join(ahead, "first").select(F.col("grp").alias("g"), (F.col("ahead") + F.col("k") - 1).alias("tree"))
    return materialise(pieces.join(numbered, F.col("grp").eqNullSafe(F.col("g"))).select("part", "grp", "tree", "start", "m", "n"), "segments")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", claimed: Column | None = None, arity: int = ARITY, fan: int = FAN, per_range: int = PER_RANGE) -> Manifest | None:
    """The manifest of docs, None if it has no rows. claimed: hex digests, or nulls, that rows claim to be their leaf.

    A null group comes first and is a group of its own; groups are in order of their UTF-8 bytes. Leaves of a group are
    in order of their ids, null ids first; rows repeated with one id are leaves of their own, in order of their digests.
    """
    spark = docs.sparkSession
    # Claims of rows that are alike but for them stay where they are: the row breaks the last ties.
    rows = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").alias("id"), F.unhex(leaf_hash([F.col(f"`{c}`") for c in fields])).alias("leaf"),
        (F.unhex(claimed) if claimed is not None else F.lit(None).cast("binary")).alias("claimed"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "leaves")
    n = rows.count()
    if not n:
        return None
    order = ["grp", "id", "leaf", "row"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_range))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    leaves = materialise(sorted_.select("grp", "id", "leaf", "claimed", "place", F.shiftright("place", PLACE_BITS).alias("part")), "sorted", release=True)
    segments = _segments(leaves)
    groups = segments.agg(F.max("tree")).first()[0] + 1

    def of_range(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        return _opened(_of_leaves(own.sort_by("place"), told.to_pylist(), groups, arity)[0], key[0].as_py())

    def of_forests(key: tuple, nodes: pa.Table) -> pa.Table:
        return _opened(_merged(nodes, groups, arity), key[0].as_py())

    pieces = segments.select("part", "tree", "start", "m", "n")
    nodes = materialise(leaves.select("part", "place", "leaf").groupBy("part").cogroup(pieces.groupBy("part")).applyInArrow(of_range, NODE), "nodes")
    rounds, left = [], parts
    while True:
        done = nodes.where("level = -1").select("digest").first()
        if done:
            return Manifest(done[0], groups, arity, fan, leaves, segments, rounds)
        rounds.append(nodes)
        if left == 1:
            raise RuntimeError("nodes without siblings are left")
        left = -(-left // fan)
        up = nodes.select(F.floor(F.col("part") / fan).alias("part"), "tree", "level", "index", "n", "digest")
        nodes = materialise(up.groupBy("part").applyInArrow(of_forests, NODE), "nodes")


def subroots(made: Manifest) -> DataFrame:
    """grp, n, subroot of each group."""
    first = made.segments.where("start = 0").select("part", "grp", "n")
    place = made.leaves.groupBy("part", F.col("grp").alias("g")).agg(F.min_by("id", "place").alias("id"), F.min_by("leaf", "place").alias("leaf"))
    at = first.join(place.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g"))).select("grp", "n", F.lower(F.hex("leaf")).alias("leaf"))
    found = made.proofs().select(F.col("leaf").alias("own"), "subroot").distinct()
    return at.join(found, F.col("leaf") == F.col("own")).select("grp", "n", "subroot")


def merkle_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", claimed: Column | None = None, arity: int = ARITY, fan: int = FAN, per_range: int = PER_RANGE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs.

    See manifest() for nulls, ties and repeated rows, and Manifest.proofs() for the columns. An empty table gives an empty
    result. Columns that aren't among fields, group_col and id_col are not read, whatever their names. arity, at most ten
    million, changes the digests; fan and per_range the cost only.
    """
    made = manifest(docs, fields, group_col, id_col, claimed, arity, fan, per_range)
    if made is None:
        return docs.limit(0).select(F.col(f"`{id_col}`").alias("doc_id"), *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(False).alias("verified"))
    return made.proofs().withColumnRenamed("id", "doc_id")


def tampered_leaf(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What rows whose id's CRC-32 is even claim: the leaf of the text without line feeds. Null ids claim nothing."""
    other = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in fields]
    return F.when(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(2)) == 0, leaf_hash(other))


#: The same in DuckDB: all levels by recursion, then each leaf's way up.
ORACLE = """
WITH RECURSIVE said AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS t,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) END AS u,
    concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head FROM documents),
bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
odd AS (SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) % 2 = 0 AS odd FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), bits),
leaves AS (SELECT s.doc_id, dense_rank() OVER (ORDER BY s.source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY s.source ORDER BY s.doc_id) - 1 AS i, count(*) OVER (PARTITION BY s.source) AS n,
    sha256(concat(head, t)) AS leaf, CASE WHEN odd.odd THEN sha256(concat(head, t)) ELSE sha256(concat(head, u)) END AS claimed FROM said s JOIN odd USING (doc_id)),
inner_ AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, min(level) + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM inner_ WHERE n > 1 GROUP BY tree, i // 3),
top AS (SELECT 0 AS level, tree AS i, (SELECT max(tree) + 1 FROM leaves) AS n, h FROM inner_ WHERE n = 1
  UNION ALL SELECT min(level) + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 3),
runs AS (SELECT tree, level, i // 3 AS r, min(n) AS n, list(h ORDER BY i) AS m FROM inner_ GROUP BY tree, level, i // 3
  UNION ALL SELECT -1, level, i // 3, min(n), list(h ORDER BY i) FROM top GROUP BY level, i // 3),
way AS (SELECT doc_id, tree, tree AS own, 0 AS level, i, '' AS proof, claimed AS f FROM leaves
  UNION ALL SELECT doc_id, CASE WHEN r.n = 1 THEN -1 ELSE w.tree END, own, CASE WHEN r.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN r.n = 1 THEN own ELSE w.i // 3 END,
    CASE WHEN r.n = 1 THEN proof ELSE concat(proof, array_to_string(list_concat(m[1:i % 3], m[i % 3 + 2:]), '')) END,
    CASE WHEN r.n = 1 THEN f ELSE sha256(concat(array_to_string(m[1:i % 3], ''), f, array_to_string(m[i % 3 + 2:], ''))) END
  FROM way w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.r = w.i // 3 WHERE NOT (w.tree = -1 AND r.n = 1)),
ends AS (SELECT way.* FROM way JOIN runs r ON way.tree = -1 AND r.tree = -1 AND r.level = way.level AND r.n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = t.h AS verified
FROM leaves l JOIN ends e USING (doc_id) JOIN (SELECT tree, h FROM inner_ WHERE n = 1) s ON s.tree = l.tree CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""
