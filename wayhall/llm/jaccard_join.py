"""N-gram Jaccard self-join by vertical partitioning (operator 5).

A document is its set of distinct k-word shingles, as 64-bit hashes. Shingles have one global order: by hash, with those
estimated to be frequent after all others. The order is cut into fragments; the overlap of two sets is the sum of their
overlaps in each fragment, which are counted separately.

1. Equal sets are one node.
2. Two sets that link share a shingle among the first |x| - ceil(t|x|) + 1 of each, in the global order. Those prefixes
   are dealt by shingle: rare ones (light) by a shuffle, frequent ones (heavy, a bounded list) by partial aggregation, so
   a hot shingle is never gathered in one task. At the first shingle that two linked sets share, what is left of either
   set from there on is at least as large as the overlap they need (_may_link). Parity bitmaps give one more bound. All
   bounds are exact, none loses a link.
3. Every set is paired with one leader of each of its shingles: the set in which the shingle stands first, which among
   near copies is the one of the fewest edits. So the first pairs are no more than the postings, whatever a group's size.
   Links make components. Then, under shingles whose sets still lie in different components than their leader, those are
   paired with the others that lie in another one. So jaccard_components() may leave links inside a component uncounted,
   but misses no component; jaccard_links() looks at all pairs and gives every link.
4. Candidate pairs are verified by vertical partitioning: partial overlaps by fragment, summed by pair.

The shingle order depends on a broadcast list of at most HEAVY shingles; which ones are in it changes the speed, never
the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.llm.components import components
from wayhall.llm.scratch import discard, materialise, modest_batches
from wayhall.llm.textkit import U, Hasher, chunks, grams, mix, not_white, signed

WORDS, SIMILARITY = 5, 80
HEAVY, HEAVY_FROM = 1 << 18, 16
FRAGMENTS = 4
LEAST_BITS = 512
#: Rows up to which a table of keys is broadcast, once it is counted; larger ones are shuffled.
BROADCAST_ROWS = 1 << 20
SEED = 41
#: Shingles that are counted at once in heavy_shingles().
COUNTED = 1 << 21


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than k words the whole sequence is one shingle."""
    hasher, table = Hasher(True, SEED), not_white()
    for c in chunks(column, table):
        words = hasher.spans(c.data, c.starts, c.ends)
        runs, at = grams(words, k, SEED), c.offsets
        for i in range(c.docs):
            a, n = at[i], c.counts[i]
            if n >= k:
                yield np.unique(runs[a : a + n - k + 1])
            elif n:
                yield grams(words[a : a + n], int(n), SEED + int(n))
            else:
                yield np.zeros(0, U)


def heavy_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that stand out in some batch of documents, the rarest first; at most HEAVY of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, seen = [], 0, set()
            for s in (*shingles(batch.column(0), k), None):
                if s is not None and (d := digest(s)) not in seen:  # equal sets are one node
                    seen.add(d)
                    held.append(s)
                    size += len(s)
                if held and (s is None or size > COUNTED):
                    h, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[n >= 4])), pa.array(n[n >= 4])], ["h", "n"])
                    held, size = [], 0

    counted = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_FROM)
    rows = counted.orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    return rows.column(0).to_numpy()[::-1].view(U)


class Order:
    """Sets in the global order."""

    def __init__(self, heavy: np.ndarray):
        self.by_hash, self.rank = np.sort(heavy), np.argsort(heavy)

    def arranged(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The sorted set in the global order, and how many of it are light."""
        if not len(self.by_hash) or not len(s):
            return s, len(s)
        at = np.minimum(np.searchsorted(self.by_hash, s), len(self.by_hash) - 1)
        is_heavy = self.by_hash[at] == s
        late = np.flatnonzero(is_heavy)
        late = late[np.argsort(self.rank[at[late]])]
        return np.concatenate([s[~is_heavy], s[late]]), len(s) - len(late)


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each slot that an odd number of shingles fall into; the number of slots is the power of two not below the set's size.

    Folding the halves of a bitmap gives the one of half as many slots.
    """
    bits = max(LEAST_BITS, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((mix(s + U(3)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rows(docs: DataFrame, heavy: Broadcast, k: int, percent: int) -> DataFrame:
    """row_id, doc_id, n, digest; on the first row of a set in each task (lead) also prefix, how many of it are light, and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(heavy.value), set()
        for batch in batches:
            n, key, lead, prefix, light, bitmap = [], [], [], [], [], []
            for s in shingles(batch.column(2), k):
                d = digest(s) if len(s) else None
                first = d is not None and d not in seen
                n.append(len(s))
                key.append(d)
                lead.append(first)
                if first:
                    seen.add(d)
                    ordered, many = order.arranged(s)
                    prefix.append(signed(ordered[: prefix_length(len(s), percent)]))
                    light.append(many)
                    bitmap.append(parity_bitmap(s))
                else:
                    prefix.append(None)
                    light.append(None)
                    bitmap.append(None)
            if len(seen) > 200_000:
                seen.clear()
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(lead, pa.bool_()), pa.array(prefix, pa.list_(pa.int64())), pa.array(light, pa.int64()), pa.array(bitmap, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "doc_id", "n", "digest", "lead", "prefix", "light", "bitmap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = F.col("row_id") if "row_id" in docs.columns else F.monotonically_increasing_id().alias("row_id")
    rows = docs.select(numbers, "doc_id", "text")
    return rows.mapInArrow(run, f"row_id long, doc_id {kind}, n long, digest binary, lead boolean, prefix array<long>, light long, bitmap array<long>")


def _sets(docs: DataFrame, heavy: Broadcast, k: int) -> DataFrame:
    """digest, fragment, part: the sets of docs, cut by the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(heavy.value)
        for batch in batches:
            key, fragment, part = [], [], []
            for s in shingles(batch.column(0), k):
                if not len(s):
                    continue
                d, (ordered, light) = digest(s), order.arranged(s)
                own = ((ordered[:light] >> U(40)) * U(FRAGMENTS - 1) >> U(24)).astype(np.int64)
                cuts = np.searchsorted(own, np.arange(FRAGMENTS))
                for f in range(FRAGMENTS):
                    x = ordered[cuts[f] : cuts[f + 1]] if f < FRAGMENTS - 1 else ordered[light:]
                    if len(x):
                        key.append(d)
                        fragment.append(f)
                        part.append(signed(x))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(fragment, pa.int32()), pa.array(part, pa.list_(pa.int64()))], ["digest", "fragment", "part"])

    return docs.select("text").mapInArrow(run, "digest binary, fragment int, part array<long>")


def _may_link(percent: int, a: tuple[str, str] = ("a.n", "a.pos"), b: tuple[str, str] = ("b.n", "b.pos")) -> Column:
    """Whether two sets, given their sizes and where the first shingle they share stands, can have the overlap they need.

    Linked sets pass it at their first common shingle; at later ones they needn't.
    """
    need = F.lit(percent) * (F.col(a[0]) + F.col(b[0]))
    left = lambda x: F.lit(100 + percent) * (F.col(x[0]) - F.col(x[1]))
    return (left(a) >= need) & (left(b) >= need)


def _pairs(u: str, v: str, found: DataFrame) -> DataFrame:
    return found.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two parity bitmaps differ; a longer one is folded. 0 if one is over twice as long as the other."""
    short, long_ = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    n = F.size(short)
    fold = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(long_, i).bitwiseXOR(F.get(long_, i + n)))
    same = F.when(F.size(long_) == n, long_).when(F.size(long_) == 2 * n, fold).otherwise(short)
    return F.aggregate(F.zip_with(short, same, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that their parity bitmaps don't rule out, with sizes and digests.

    Bitmaps of two sets differ in at most as many bits as the sets differ in shingles.
    """
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}"), F.col("digest").alias(f"d{c}"), F.col("rep_doc").alias(f"doc_{c}")) for c in "uv")
    both = F.col("nu") + F.col("nv")
    found = pairs.join(x, "u").join(y, "v").where((100 + percent) * (both - _apart(F.col("mu"), F.col("mv"))) >= 2 * percent * both)
    return materialise(found.drop("mu", "mv"), "near")


def _verified(near: DataFrame, docs: DataFrame, heavy: Broadcast, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of _near() whose sets link: partial overlaps by fragment, summed."""
    wanted = materialise(near.select(F.explode(F.array("doc_u", "doc_v")).alias("wanted")).distinct(), "wanted")
    texts = docs.join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    # Rows repeated with one id give one set more than once.
    sets = materialise(_sets(texts, heavy, k).repartition("digest").dropDuplicates(["digest", "fragment"]), "fragments", release=True)
    left = near.select("u", "v", "nu", "nv", "du", "dv").join(sets.select(F.col("digest").alias("du"), "fragment", F.col("part").alias("pu")), "du").drop("du")
    both = left.join(sets.select(F.col("digest").alias("dv"), "fragment", F.col("part").alias("pv")), ["dv", "fragment"])
    partial = both.select("u", "v", "nu", "nv", F.array_size(F.array_intersect("pu", "pv")).alias("overlap"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("overlap").alias("overlap"))
    links = total.where(100 * F.col("overlap") >= percent * (F.col("nu") + F.col("nv") - F.col("overlap")))
    links = materialise(links.select("u", "v", "overlap"), "links", release=True)
    discard(wanted)
    discard(sets)
    return links


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows; otherwise Spark joins by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _across(shared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components under a shingle whose leader is in another one than at least one of them."""
    small = _small(roots)
    root = lambda node, name: small.select(F.col("node").alias(node), F.col("root").alias(name))
    told = shared.join(root("node", "found"), "node", "left").join(root("leader", "first"), "leader", "left")
    told = told.withColumns({"root": F.coalesce("found", "node"), "top": F.coalesce("first", "leader")}).drop("found", "first")
    told = materialise(told.where("c > 2 AND node <> leader").select("h", "node", "n", "pos", "root", (F.col("root") != F.col("top")).alias("other")), "told", release=True)
    match = (F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root")) & (~F.col("b.other") | (F.col("a.node") < F.col("b.node")))
    found = told.where("other").alias("a").join(told.alias("b"), match & _may_link(percent))
    return _pairs("a.node", "b.node", found)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of ``words`` words
    (A-Z lowered; words are runs without [\\x20\\x09-\\x0D]). component_id is the smallest id reachable by links, the
    document's own included. Texts with fewer words are one shingle; null, empty and blank texts have no shingles and
    link with nothing. Rows repeated with one id link by their sets like any others. A null id takes no part in the
    smallest; its component_id is null if nothing else is reachable. An empty table gives an empty result. Other
    columns are not read.
    """
    rows, roots, nodes = _linked(docs, id_col, text_col, words, percent)
    named = rows.join(nodes.select("digest", "node"), "digest", "left").join(roots, "node", "left")
    named = materialise(named.select("doc_id", "n", F.coalesce("root", "node").alias("root")), "named")
    label = materialise(named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "labels")
    return named.join(label, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, for each component: of the smallest id, null after all others.

    Of rows with that id in the component one stays. Rows without shingles stay. Rows are told apart by numbers, so a
    repeated or null id costs no row of another component.
    """
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", release=True)
    rows, roots, nodes = _linked(numbered, id_col, text_col, words, percent, "__row")
    named = rows.join(nodes.select("digest", "node"), "digest").join(roots, "node", "left")
    named = materialise(named.select("row_id", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))["row_id"].alias("first"))
    drop = materialise(named.join(first, "root").where("row_id <> first").select(F.col("row_id").alias("__row")), "drop")
    return numbered.join(_small(drop), "__row", "left_anti").drop("__row")


def _prepared(docs: DataFrame, heavy: Broadcast, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows; named, the number (node) of each set by digest; nodes, one row for each; and shared, the postings of the prefixes' shingles that several nodes have."""
    whole = materialise(_rows(docs, heavy, words, percent), "sets", release=True)
    leads = whole.where("lead")
    named = leads.groupBy("digest").agg(F.min("row_id").alias("node"), F.min_by("doc_id", "row_id").alias("rep_doc"))
    named = materialise(named, "named")
    # A set that several tasks met has a lead in each; one of them stays.
    spare = leads.select("row_id", "digest").join(named, "digest").where("row_id <> node").select("row_id")
    nodes = leads.join(_small(materialise(spare, "spare")), "row_id", "left_anti")
    postings = nodes.select(F.col("row_id").alias("node"), "n", "light", F.posexplode("prefix").alias("pos", "h"))
    head = F.struct("pos", "node", "n")
    by_size, alike = Window.partitionBy("h").orderBy("n"), Window.partitionBy("h")
    beside = (F.lead("n").over(by_size) * percent <= 100 * F.col("n")) | (F.lag("n").over(by_size) * 100 >= percent * F.col("n"))
    light = postings.where("pos < light").drop("light").withColumn("beside", beside).where("beside").drop("beside")
    light = light.withColumns({"c": F.count(F.lit(1)).over(alike), "l": F.min(head).over(alike)})
    late = postings.where("pos >= light").drop("light")
    tops = late.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(head).alias("l")).where("c > 1")
    frequent = late.join(_small(materialise(tops, "tops")), "h").select("node", "n", "pos", "h", "c", "l")
    shared = light.unionByName(frequent).select("h", "node", "n", "pos", "c", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"), F.col("l.pos").alias("leader_pos"))
    shared = materialise(shared, "shared", release=True)
    kept = nodes.select(F.col("row_id").alias("node"), "n", "bitmap", "digest", F.col("doc_id").alias("rep_doc"))
    return whole.select("row_id", "doc_id", "n", "digest"), named, kept, shared


def _all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    both = (F.col("a.h") == F.col("b.h")) & (F.col("a.node") < F.col("b.node"))
    return _pairs("a.node", "b.node", postings.alias("a").join(postings.alias("b"), both & _may_link(percent)))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """set_a, set_b, doc_a, doc_b, n_a, n_b, rows_a, rows_b, overlap: every link between different sets, each once.

    Every candidate pair is verified, inside components too, so the result, and the work under a shingle that many sets
    share, grow with the square of a group of near copies. A set is named by a number (set_a < set_b) and by the id of
    one of its rows (doc_); n_ are its shingles and rows_ the rows of docs that have it, which link with each other as
    well. So rows_a * rows_b over all links, and rows * (rows - 1) / 2 over all sets, is the number of links of rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    modest_batches(docs.sparkSession)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, words))
    rows, _, nodes, shared = _prepared(docs, heavy, words, percent)
    pairs = materialise(_all_pairs(shared, percent), "pairs", release=True)
    links = _verified(_near(pairs, nodes, percent), docs, heavy, words, percent)
    sizes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    sets = materialise(nodes.select("node", "n", "digest", "rep_doc").join(sizes, "digest"), "named", release=True)
    side = lambda node, x: sets.select(F.col("node").alias(node), F.col("rep_doc").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("rows").alias(f"rows_{x}"))
    out = links.join(side("u", "a"), "u").join(side("v", "b"), "v")
    return out.select(F.col("u").alias("set_a"), F.col("v").alias("set_b"), "doc_a", "doc_b", "n_a", "n_b", "rows_a", "rows_b", "overlap")


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows; the root of each linked node; named: digest, node, rep_doc."""
    numbers = [F.col(row_col).alias("row_id")] if row_col else []
    docs = docs.select(*numbers, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    modest_batches(docs.sparkSession)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, words))
    rows, named, nodes, shared = _prepared(docs, heavy, words, percent)
    met = shared.where((F.col("node") != F.col("leader")) & _may_link(percent, ("n", "pos"), ("leader_n", "leader_pos")))
    pairs = materialise(_pairs("node", "leader", met), "pairs", release=True)
    near = _near(pairs, nodes, percent)
    links = _verified(near, docs, heavy, words, percent)
    roots = materialise(components(links), "roots")
    # Pairs with a leader have been tried.
    more = materialise(_across(shared, roots, percent), "across", release=True)
    discard(shared)
    near = _near(more.join(pairs, ["u", "v"], "left_anti"), nodes, percent)
    if not near.isEmpty():
        more = _verified(near, docs, heavy, words, percent)
        if not more.isEmpty():
            roots = materialise(components(links.unionByName(more)), "roots")
    return rows, roots, named


#: The same result in DuckDB, every pair that shares a shingle counted; its work grows with the square of a group.
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= {WORDS} THEN list_distinct(list_transform(range(1, len(words) - {WORDS} + 2), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS own FROM w
),
e AS (SELECT doc_id, len(own) AS n, unnest(own) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= {SIMILARITY} * (n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT t.b, r.root FROM r JOIN t ON r.doc_id = t.a)
SELECT s.doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
