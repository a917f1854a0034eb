"""SimHash near-duplicates by anchor points of a covering code (operator 12).

A document's fingerprint has 64 bits; documents link when theirs differ in few. Distinct fingerprints are compared:

1. A fingerprint is cut into parts. Two fingerprints within a distance of d have a part, of s, in which they are within
   d // s. That part is where anchors find them.
2. Anchors of a part are the words of a covering code: a Hamming code over its low bits, the other bits free, so that
   every word has one anchor, its home, within a covering radius of 1.
3. A fingerprint is replicated to every anchor within the covering radius plus the threshold, block by block: these are
   the homes of all words within the threshold of it. So of two fingerprints within the threshold in a part, one lies at
   the home of the other, and both meet there.
4. Those at home at an anchor are compared, on all bits, with all that came to it. Only links that join what isn't yet
   joined there are put out, so a group of near copies gives about as many links as members and anchors, not all pairs.

An anchor that many came to is dealt as a grid: slices of those at home meet slices of the others. Fewer parts give more,
smaller anchors and more replicas; their number follows the number of fingerprints and doesn't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.llm.components import components
from wayhall.llm.scratch import discard, materialise, modest_batches
from wayhall.llm.textkit import U, Chunk, chunks, not_white, signed

WORDS, BITS, DIFFER, SEED = 4, 64, 4, 42
#: Fingerprints from which two parts, of more and smaller anchors, are cheaper than three.
MANY = 1 << 28
#: Members of an anchor, at home and in all, that one task compares at most.
SLICE = 4096
#: Pairs compared at once, and members up to which an anchor's pairs are written out without joining them first.
AT_ONCE, FEW = 1 << 21, 12
#: Rows up to which a table of keys is broadcast, once it is counted; larger ones are shuffled.
BROADCAST_ROWS = 1 << 18
SHINGLES_AT_ONCE = 1 << 16
#: Bits of each byte value.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _spaced(c: Chunk, inside: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The chunk's text with A-Z lowered and one space after each word, and the bounds of its words there."""
    keep = inside.copy()
    after = c.ends[c.ends < len(keep)]
    keep[after] = True
    data = np.where(inside, c.data, np.uint8(0x20))
    upper = (data >= 0x41) & (data <= 0x5A)
    data = np.where(upper, data + np.uint8(0x20), data)
    at = np.concatenate(([0], np.cumsum(keep)))
    return data[keep].tobytes(), at[c.starts], at[c.ends]


def _chunk_prints(c: Chunk, inside: np.ndarray, words: int) -> Iterator[int]:
    text, starts, ends = _spaced(c, inside)
    digest, first = xxhash.xxh64_intdigest, 0
    for n in c.counts.tolist():
        total, ones = max(n - words + 1, 1 if n else 0), np.zeros(BITS, np.int64)
        left, right = starts[first : first + total], ends[first + min(words, n) - 1 : first + n] if n else ends[:0]
        for a in range(0, total, SHINGLES_AT_ONCE):
            spans = zip(left[a : a + SHINGLES_AT_ONCE].tolist(), right[a : a + SHINGLES_AT_ONCE].tolist(), strict=True)
            h = np.fromiter((digest(text[x:y], SEED) for x, y in spans), U, min(SHINGLES_AT_ONCE, total - a))
            slots = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
            ones += (np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS).ravel()
        yield sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()) if n else 0
        first += n


def prints(column: pa.Array, words: int = WORDS) -> Iterator[int]:
    """The unsigned fingerprint of each text: bit i is set if over half of the shingles' hashes have it; 0 without words."""
    table = not_white()
    for c in chunks(column, table):
        yield from _chunk_prints(c, table[c.data], words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (long, the fingerprint's bits): one row for each row of docs."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(prints(batch.column(1), words), U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(found))], ["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class Anchors:
    """Anchors of the fingerprints' parts, for a distance of at most differ."""

    def __init__(self, parts: int, differ: int = DIFFER):
        self.parts, self.reach = parts, differ // parts
        edges = [BITS * i // parts for i in range(parts + 1)]
        self.at, self.width = edges[:-1], [b - a for a, b in zip(edges, edges[1:], strict=False)]
        self.checks = [w.bit_length() if w + 1 == 1 << w.bit_length() else w.bit_length() - 1 for w in self.width]

    def part(self, fp: np.ndarray, p: int) -> np.ndarray:
        return (fp >> U(self.at[p])) & U((1 << self.width[p]) - 1)

    def home(self, word: np.ndarray, p: int) -> np.ndarray:
        """The nearest anchor: a Hamming code's word in the low 2**m - 1 bits, the rest as it is."""
        m, syndrome = self.checks[p], np.zeros(len(word), U)
        for j in range(m):
            mask = sum(1 << (i - 1) for i in range(1, 1 << m) if i >> j & 1)
            syndrome |= (np.bitwise_count(word & U(mask)).astype(U) & U(1)) << U(j)
        flip = np.where(syndrome > 0, U(1) << (np.maximum(syndrome, U(1)) - U(1)), U(0))
        return word ^ flip

    def near(self, word: np.ndarray, p: int) -> np.ndarray:
        """Rows of anchors that may be home to a word within reach of each word; the first is its own. Some repeat."""
        errors = [0] + [sum(1 << i for i in c) for k in range(1, self.reach + 1) for c in combinations(range(self.width[p]), k)]
        return np.stack([self.home(word ^ U(e), p) for e in errors], 1)

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor, row of fp, at home: each anchor of each fingerprint once."""
        anchor, row, home = [], [], []
        for p in range(self.parts):
            found = self.near(self.part(fp, p), p)
            own = found[:, :1]
            found = np.sort(found, 1)
            once = np.ones(found.shape, bool)
            once[:, 1:] = found[:, 1:] != found[:, :-1]
            at, column = np.nonzero(once)
            key = found[at, column]
            anchor.append(key | U(p) << U(40))
            row.append(at)
            home.append(key == own[at, 0])
        return tuple(np.concatenate(x) for x in (anchor, row, home))


def replicas(distinct: DataFrame, anchors: Anchors) -> DataFrame:
    """anchor, fp, home: distinct (fp) at every anchor that it may meet a linked one at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column(0).to_numpy().view(U)
            for a in range(0, len(all_), 2000):
                fp = all_[a : a + 2000]
                key, row, home = anchors.keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(fp[row])), pa.array(home)], ["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def dealt(placed: DataFrame, most: int = SLICE) -> DataFrame:
    """placed with a cell: at anchors with over most members slices at home meet slices of all, each pair of slices in a cell of its own.

    A slice is chosen by the fingerprint's hash, so each that is at home meets each that came in one cell of its anchor.
    """
    full = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("h")).where((F.col("n") > most) & (F.col("h") > 0))
    full = materialise(full.select("anchor", F.ceil(F.col("h") / most).alias("down"), F.ceil(F.col("n") / most).alias("over")), "full")
    if full.count() <= BROADCAST_ROWS:
        full = F.broadcast(full)
    slot = lambda n: F.pmod(F.xxhash64("fp", F.lit(7)), n)
    line = F.transform(F.sequence(F.lit(0).cast("long"), F.col("over") - 1), lambda i: F.struct((slot(F.col("down")) * F.col("over") + i).alias("cell"), F.lit(True).alias("home")))
    column = F.transform(F.sequence(F.lit(0).cast("long"), F.col("down") - 1), lambda i: F.struct((i * F.col("over") + slot(F.col("over"))).alias("cell"), F.lit(False).alias("home")))
    cells = F.when(F.col("over").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.col("home").alias("home")))).when(F.col("home"), F.concat(line, column)).otherwise(column)
    return placed.join(full, "anchor", "left").select("anchor", "fp", F.explode(cells).alias("c")).select("anchor", "c.cell", "fp", "c.home")


def near_pairs(home: np.ndarray, all_: np.ndarray, differ: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join each at home, and what of all it is near to, as far as nothing else here joins them.

    A search from one at home takes all that is near out of the rest, and goes on from what it has found; what isn't at
    home only looks for those that are. What is found needn't be looked at again, so dense groups cost little.
    """
    alike = lambda x, y: np.bitwise_count(x ^ y) <= differ
    guest = all_[~np.isin(all_, home)]
    while len(home):
        queue, home = [(home[0], True)], home[1:]
        while queue and (len(home) or len(guest)):
            x, searches_all = queue.pop()
            near = alike(home, x)
            found = home[near]
            if len(found):
                yield np.full(len(found), x), found
                queue += [(f, True) for f in found]
                home = home[~near]
            if searches_all and len(guest):
                near = alike(guest, x)
                found = guest[near]
                if len(found):
                    yield np.full(len(found), x), found
                    queue += [(f, False) for f in found]
                    guest = guest[~near]


def _meet(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, differ: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole cells; anchor numbers the cells, in order."""
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, len(anchor)))
    hosts = np.add.reduceat(home.astype(np.int64), first)
    small = (size <= FEW) & (hosts > 0) & (size > 1)
    rows = np.flatnonzero(home & np.repeat(small, size))
    group = np.repeat(np.arange(len(first)), size)[rows]
    for a in range(0, len(rows), AT_ONCE // FEW):
        own, of = rows[a : a + AT_ONCE // FEW], group[a : a + AT_ONCE // FEW]
        left = np.repeat(own, size[of])
        right = np.repeat(first[of] - np.cumsum(size[of]) + size[of], size[of]) + np.arange(len(left))
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= differ) & (fp[left] != fp[right])
        yield fp[left[near]], fp[right[near]]
    for g in np.flatnonzero((size > FEW) & (hosts > 0)):
        own = slice(first[g], first[g] + size[g])
        yield from near_pairs(np.unique(fp[own][home[own]]), np.unique(fp[own]), differ)


def links(distinct: DataFrame, anchors: Anchors, differ: int = DIFFER, most: int = SLICE) -> DataFrame:
    """u, v: fingerprints of distinct (fp) within differ bits, enough of them to join all that are joined by such steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
            number = np.cumsum(np.concatenate(([0], (cells[1:, :2] != cells[:-1, :2]).any(1))))
            found = list(_meet(number, cells[:, 2].view(U), cells[:, 3] > 0, differ))
            u, v = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, U) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.minimum(signed(u), signed(v)))), pa.array(signed(np.maximum(signed(u), signed(v))))], ["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            if not len(rows):
                continue
            # The last cell of a batch may go on in the next.
            open_ = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(1))[0])
            if open_ or (held and (held[-1][-1, :2] != rows[0, :2]).any()):
                whole = np.concatenate([*held, rows[:open_]])
                if len(whole):
                    yield from out(whole)
                held = [rows[open_:]]
            else:
                held.append(rows)
        if held:
            yield from out(np.concatenate(held))

    placed = dealt(replicas(distinct, anchors), most)
    met = placed.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return met.select("anchor", "cell", "fp", "home").mapInArrow(run, "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, differ: int = DIFFER, parts: int | None = None, most: int = SLICE) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    Words are runs without [\\x20\\x09-\\x0D], A-Z lowered; a shingle is so many words joined by a space, repeats included,
    or the whole sequence if it is shorter. A bit of the fingerprint, 16 hex digits, is set if over half of the shingles'
    hashes (XXH64, seed 42) have it; texts without words, null texts included, have fingerprint 0. Rows link if their
    fingerprints differ in at most differ bits. component_id is the smallest id reachable by links, the row's own included;
    null ids take no part in it, and it is null where there is no other. Rows repeated with one id are rows of their own.
    An empty table gives an empty result. Other columns are not read. parts (None: by the number of distinct fingerprints)
    and most (members of an anchor that are compared at once) change the cost only.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = parts or (3 if distinct.count() < MANY else 2)
    found = materialise(links(distinct, Anchors(parts, differ), differ, most), "links", release=True)
    roots = materialise(components(found), "roots", release=True)
    # Written first, as label below: a join of two plain tables is one that Spark can split where many rows have one key.
    named = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    labels = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "by_root")
    label = materialise(named.join(labels, "root").select(F.col("fp").alias("own"), "component_id"), "labels")
    discard(distinct)
    discard(found)
    out = rows.join(label, F.col("fp") == F.col("own"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
