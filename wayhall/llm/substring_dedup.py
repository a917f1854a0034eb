"""Substring dedup with a count-min prefilter (operator 6).

A window is 13 consecutive words. Documents are dealt into blocks of neighbouring ids, of about BLOCK_BYTES of text each,
and three passes go over them:

1. Each block sends a count-min sketch of its windows: for each of DEPTH hash rows the cells that it hits, once or more
   often. A sketch is sparse and cut into stripes; stripes of all blocks are merged, and each block learns which of its
   cells were hit at least twice. The sketch is as wide as the corpus needs, cut so that a stripe has about STRIPE windows,
   and no task holds more than a stripe.
2. A window all of whose cells were hit twice is estimated as repeated. None that is repeated is missed, as merged counts
   never fall short. Only these windows' exact 128-bit keys are sent, each once for a block, and grouped. As blocks are
   ranges of ids, a block only needs to know whether a lower block has the key; inside a block the smallest id is known.
3. Words covered by windows that start in a document with a smaller id are removed.

A window that a third of all documents share is one key for each block. Texts are shuffled by block in each pass, and
nothing else that moves is as large as they are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.llm.blocks import block_of, id_cuts
from wayhall.llm.scratch import discard, materialise, modest_batches
from wayhall.llm.textkit import U, Hasher, chunks, gram_mask, grams, mix, not_white

WINDOW = 13
DEPTH = 2
ROOM = 8
SEEDS = (51, 52)
BLOCK_BYTES, STRIPE = 5 << 19, 1 << 21
MASKS = "block int, row int, stripe int, mask binary"


def _ordered(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ranks of the documents' ids (equal ids share one, null is last) and their texts, in the order of id and text."""
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column(0).combine_chunks()
    filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
    none = ids.is_null().to_numpy(zero_copy_only=False)
    rank = np.cumsum(np.concatenate([[0], (filled[1:] != filled[:-1]) | (none[1:] != none[:-1])])) if len(filled) else np.zeros(0, np.int64)
    return rank, table.column(1)


def _windows(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window in order, and the document it starts in."""
    hasher, table = Hasher(False, SEEDS[0]), not_white()
    first, second, owners = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for c in chunks(texts, table):
        ok = gram_mask(c.counts, window)
        words = hasher.spans(c.data, c.starts, c.ends)
        first.append(grams(words, window, SEEDS[0])[ok])
        second.append(grams(words, window, SEEDS[1])[ok])
        owners.append(c.owner[: len(ok)][ok] + c.first)
    return np.concatenate(first), np.concatenate(second), np.concatenate(owners)


def _cells(hashes: np.ndarray, row: int, stripes: int, bits: int) -> np.ndarray:
    """Stripe in the upper 32 bits, cell in the lower."""
    x = mix(hashes + U(row + 1))
    return ((x >> U(32)) * U(stripes) >> U(32) << U(32)) | (x & U((1 << bits) - 1))


def _packed(cells: np.ndarray) -> bytes:
    """Rising 32-bit cells as 16-bit steps; 65535 means as much and go on."""
    step = np.diff(cells.astype(np.int64), prepend=0)
    more = step // 65535
    out = np.full(int(more.sum()) + len(step), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = step - more * 65535
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != 65535].astype(np.uint32)


def _stripe_bounds(cells: np.ndarray, stripes: int) -> np.ndarray:
    return np.searchsorted(cells, np.arange(stripes + 1, dtype=U) << U(32))


def _merge(rows: pa.Table, parts: list[np.ndarray], weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each part, which of its values weigh 2 or more in all parts together."""
    values, weight = np.concatenate(parts), np.concatenate(weights)
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.diff(values[order], prepend=values[order][:1] + 1 if len(values) else []))
    sums = np.add.reduceat(weight[order], first) if len(first) else weight
    often = np.empty(len(values), bool)
    often[order] = np.repeat(sums >= 2, np.diff(np.append(first, len(values))))
    return np.split(often, np.cumsum([len(p) for p in parts])[:-1])


def _sketch(placed: DataFrame, window: int, stripes: int, bits: int) -> DataFrame:
    """First pass: MASKS rows, a bit for each cell of a block's sketch."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        hashes = _windows(_ordered(table)[1], window)[0]
        out = []
        for row in range(DEPTH):
            cells, counts = np.unique(_cells(hashes, row, stripes, bits), return_counts=True)
            at = _stripe_bounds(cells, stripes)
            for s in np.flatnonzero(np.diff(at)):
                own = slice(at[s], at[s + 1])
                out.append((key[0].as_py(), row, int(s), _packed(cells[own] & U(0xFFFFFFFF)), np.packbits(counts[own] > 1).tobytes()))
        kinds = [("block", pa.int32()), ("row", pa.int32()), ("stripe", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary())]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("cells").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)] + 1 for x, p in zip(table.column("twice").to_pylist(), parts, strict=True)]
        masks = [np.packbits(m).tobytes() for m in _merge(table, parts, twice)]
        return table.select(["block", "row", "stripe"]).append_column("mask", pa.array(masks, pa.binary()))

    sent = placed.groupBy("block").applyInArrow(send, "block int, row int, stripe int, cells binary, twice binary")
    return sent.groupBy("row", "stripe").applyInArrow(merge, MASKS)


def _masks(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r["row"], r["stripe"]): r["mask"] for r in table.select(["row", "stripe", "mask"]).to_pylist()}


def _estimated(hashes: np.ndarray, masks: dict[tuple[int, int], bytes], stripes: int, bits: int) -> np.ndarray:
    """Which windows are estimated to be repeated."""
    found = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        cells = _cells(hashes, row, stripes, bits)
        own = np.unique(cells)
        at = _stripe_bounds(own, stripes)
        often = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(masks[row, int(s)], np.uint8))[: at[s + 1] - at[s]].astype(bool) for s in np.flatnonzero(np.diff(at)))])
        own = own[often]
        place = np.minimum(np.searchsorted(own, cells), max(0, len(own) - 1))
        found &= own[place] == cells if len(own) else False
    return found


def _exact(placed: DataFrame, masks: DataFrame, window: int, stripes: int, bits: int) -> DataFrame:
    """Second pass: keys by block and shard (shard >= 0), and for each block a row of shard -1 with what the third needs.

    That row holds the runs of windows estimated as repeated, the index of each one's key in the block's sorted keys and
    whether it also starts in a smaller id of the block.
    """

    def send(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        rank, texts = _ordered(table)
        hashes, second, owner = _windows(texts, window)
        at = np.flatnonzero(_estimated(hashes, _masks(replies), stripes, bits))
        keys = np.stack([hashes[at], second[at]], 1)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.ones(len(at), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
        index = np.empty(len(at), np.uint32)
        index[order] = np.cumsum(new) - 1
        unique, ranks = keys[order][new], rank[owner[at]]
        low = np.minimum.reduceat(ranks[order], np.flatnonzero(new)) if len(at) else ranks
        local = ranks > low[index] if len(at) else np.zeros(0, bool)
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        runs = np.stack([at[starts], np.diff(np.append(starts, len(at)))], 1).astype(np.int64)
        shard = ((unique[:, 0] >> U(32)) * U(stripes) >> U(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(stripes + 1))
        out = [(int(s), unique[cuts[s] : cuts[s + 1]].tobytes(), None, None) for s in np.flatnonzero(np.diff(cuts))]
        out.append((-1, runs.tobytes(), index.tobytes(), np.packbits(local).tobytes()))
        columns = {"block": pa.array([key[0].as_py()] * len(out), pa.int32()), "shard": pa.array([o[0] for o in out], pa.int32())}
        return pa.table(columns | {n: pa.array([o[i] for o in out], pa.binary()) for i, n in enumerate(("data", "key_index", "local"), 1)})

    return placed.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(send, "block int, shard int, data binary, key_index binary, local binary")


def _grouped(keys: DataFrame) -> DataFrame:
    """For each block and shard a bit for each key: whether a lower block has it."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [np.frombuffer(x, U).reshape(-1, 2) for x in table.column("data").to_pylist()]
        values = np.concatenate(parts)
        order = np.lexsort((values[:, 1], values[:, 0]))  # stable: lower blocks first
        again = np.zeros(len(values), bool)
        again[order[1:]] = (values[order][1:] == values[order][:-1]).all(1)
        bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(p) for p in parts])[:-1])]
        sizes = pa.array([len(p) for p in parts], pa.int64())
        return table.select(["block", "shard"]).append_column("size", sizes).append_column("lower", pa.array(bits, pa.binary()))

    return keys.groupBy("shard").applyInArrow(merge, "block int, shard int, size long, lower binary")


def _cut(placed: DataFrame, told: DataFrame, window: int, id_type: str) -> DataFrame:
    """Third pass: the result."""

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        removed = np.zeros(0, bool)
        state = [r for r in replies.to_pylist() if r["shard"] < 0]
        if state:
            lower = [np.unpackbits(np.frombuffer(r["lower"], np.uint8))[: r["size"]] for r in sorted(replies.to_pylist(), key=lambda r: r["shard"]) if r["shard"] >= 0]
            lower = np.concatenate(lower).astype(bool) if lower else np.zeros(0, bool)
            runs, index = np.frombuffer(state[0]["data"], np.int64).reshape(-1, 2), np.frombuffer(state[0]["key_index"], np.uint32)
            gone = lower[index] | np.unpackbits(np.frombuffer(state[0]["local"], np.uint8))[: len(index)].astype(bool) if len(index) else np.zeros(0, bool)
            at = np.repeat(runs[:, 0] - np.concatenate([[0], np.cumsum(runs[:-1, 1])]), runs[:, 1]) + np.arange(len(index)) if len(index) else np.zeros(0, np.int64)
            removed = at[gone]
        n_words, n_removed, sha, first = [], [], [], 0
        for value in table.column("text"):
            words = (value.as_py() or "").encode().split()
            mine = max(0, len(words) - window + 1)
            a, z = np.searchsorted(removed, (first, first + mine))
            if a < z:
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, removed[a:z] - first, 1)
                np.add.at(edge, removed[a:z] - first + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            else:
                kept = words
            first += mine
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs.

    Words are runs without [\\x20\\x09-\\x0D]. Each word covered by a window whose word sequence also starts in a document
    with a smaller id is removed; windows are judged on the input. kept_sha256 is of the kept words joined by one space.
    Null and empty texts have no words. Rows repeated with one id never remove words of each other; null ids count as
    the largest. An empty table gives an empty result. Other columns are not read. Ids are numbers.
    """
    modest_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = id_cuts(own, "doc_id", max(1, size // BLOCK_BYTES), F.ceil((F.octet_length("text") + 1) / 4096).cast("int"))
    placed = own.withColumn("block", block_of(F.col("doc_id"), cuts))
    windows = max(1, size / 6)
    parts = math.ceil(windows / STRIPE)
    bits = min(32, max(8, math.ceil(math.log2(ROOM * windows / parts))))
    masks = materialise(_sketch(placed, window, parts, bits), "masks", release=True)
    exact = materialise(_exact(placed, masks, window, parts, bits), "windows", release=True)
    discard(masks)
    lower = _grouped(exact.where("shard >= 0").select("block", "shard", "data"))
    none = F.lit(None).cast("binary")
    told = exact.where("shard < 0").withColumns({"size": F.lit(0).cast("long"), "lower": none}).unionByName(lower.withColumns({"data": none, "key_index": none, "local": none}))
    told = materialise(told, "told", release=True)
    discard(exact)
    return _cut(placed, told, window, own.schema["doc_id"].dataType.simpleString())


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT g.doc_id, g.i FROM g JOIN m ON g.k = m.k WHERE m.low < g.doc_id), (SELECT unnest(range(0, 13)) AS o)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (
  SELECT p.doc_id, count(*) AS n_words, count(r.p) AS n_removed, string_agg(CASE WHEN r.p IS NULL THEN p.word END, ' ' ORDER BY p.p) AS kept
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p GROUP BY p.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
