"""Document fingerprints by a homomorphic multiset hash (operator 10).

A document is the multiset of its paragraphs (lines). A paragraph is hashed to a wide vector; a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo a power of two. The sum doesn't depend on the order of the
paragraphs, and paragraphs can be added or taken away without the rest of the text (``combine``).

A vector has two sections. STRONG lanes modulo 2**64 come from a cryptographic hash of the paragraph and serve equality.
SOFT lanes modulo 2**32 are sums of +1 and -1 hashed from the paragraph's word pairs (the word, where there is one
alone), each with its occurrence number in the paragraph, so that a pair that stands there k times weighs k: the squared distance of two fingerprints there estimates how many word pairs their texts don't share, which gives
``likeness``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayhall.llm.blocks import block_of, id_cuts
from wayhall.llm.textkit import U, Hasher, chunks, grams, mix, not_white

STRONG, SOFT = 16, 128
SEED = 31
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


class Fingerprinter:
    def __init__(self) -> None:
        self.hasher, self.table = Hasher(False, SEED), not_white()

    def soft(self, texts: pa.Array) -> np.ndarray:
        """SOFT lanes (int64) of each text."""
        out = []
        for c in chunks(texts, self.table):
            words = self.hasher.spans(c.data, c.starts, c.ends)
            lines = np.searchsorted(np.flatnonzero(c.data == 10), c.starts)
            own = c.owner
            follows = np.zeros(len(words) + 1, bool)  # follows[i]: word i stands after word i - 1 in the same paragraph
            follows[1:-1] = (own[1:] == own[:-1]) & (lines[1:] == lines[:-1])
            pair = grams(words, 2, SEED)
            value = np.where(follows[1:], np.append(pair, U(0))[: len(words)], mix(words + U(5)))
            use = follows[1:] | ~follows[:-1]
            # Both rise along the chunk, so their sum tells paragraphs apart.
            value, counts = numbered(value[use], (own + lines)[use]), np.bincount(own[use], minlength=c.docs)
            lanes = np.zeros((c.docs, SOFT), np.int64)
            at = np.concatenate(([0], np.cumsum(counts)))
            for i in range(c.docs):
                for a in range(at[i], at[i + 1], 1 << 15):
                    v = value[a : min(a + (1 << 15), at[i + 1])]
                    bits = np.unpackbits(np.stack([v, mix(v + U(9))], 1).view(np.uint8), axis=1)
                    lanes[i] += 2 * bits.sum(0, dtype=np.int32).astype(np.int64) - len(v)
            out.append(lanes)
        return np.concatenate(out) if out else np.zeros((0, SOFT), np.int64)

    @staticmethod
    def strong(text: str) -> np.ndarray:
        total = np.zeros(STRONG, U)
        for p in text.encode().split(b"\n"):
            if p:
                total += np.frombuffer(hashlib.shake_128(p).digest(8 * STRONG), "<u8")
        return total

    def fingerprints(self, texts: list[str]) -> list[str]:
        soft = (self.soft(pa.array(texts, pa.large_string())) & 0xFFFFFFFF).astype(">u4")
        return [self.strong(t).astype(">u8").tobytes().hex() + s.tobytes().hex() for t, s in zip(texts, soft, strict=True)]


def _lanes(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * STRONG], ">u8").astype(U), np.frombuffer(raw[8 * STRONG :], ">u4").astype(np.uint32)


def numbered(value: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """Values hashed again with how many equal ones stand before them in their paragraph; first ones stay as they are."""
    order = np.lexsort((value, paragraph))
    v, p, each = value[order], paragraph[order], np.arange(len(value))
    new = np.ones(len(value), bool)
    new[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1])
    times = np.empty(len(value), np.int64)
    times[order] = each - np.maximum.accumulate(np.where(new, each, 0))
    return np.where(times > 0, mix(value + times.astype(U) * U(0x9E3779B97F4A7C15)), value)


def combine(fingerprint: str, other: str, sign: int = 1) -> str:
    """The fingerprint with the other's paragraphs put in (sign 1) or taken out (sign -1)."""
    (a, b), (c, d) = _lanes(fingerprint), _lanes(other)
    if sign < 0:
        c, d = U(0) - c, np.uint32(0) - d
    return (a + c).astype(">u8").tobytes().hex() + (b + d).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of SOFT lanes: 1 less the estimated share of word pairs that two texts don't have in common."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    square = lambda x: (x.view(np.int32).astype(float) ** 2).sum(-1)
    both, apart = square(a) + square(b), square(a - b)
    return np.where(apart == 0, 1.0, np.clip(1 - apart / np.maximum(both, 1), 0, 1))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, extra, doc_id, text: partitions hold whole blocks of neighbouring ids in order, each followed by the next block's first rows (extra)."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = id_cuts(own, "doc_id", 4 * parts)
    placed = own.withColumn("block", block_of(F.col("doc_id"), cuts))
    heads = dict(placed.groupBy("block").agg(F.min("doc_id")).collect())  # one row for each block
    first = min((h for h in heads.values() if h is not None), default=None)
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    kind = docs.schema[id_col].dataType
    at = lambda values, t: F.get(F.array(*(F.lit(v).cast(t) for v in values)), F.col("block"))
    blocks = range(len(cuts) + 1)
    head = F.col("doc_id").eqNullSafe(at([heads.get(b) for b in blocks], kind)) & (F.col("doc_id").isNotNull() | F.lit(first is None))
    target = lambda block, extra: F.struct(block.cast("int").alias("block"), F.lit(extra).alias("extra"))
    here = target(F.col("block"), False)
    placed = placed.withColumn("to", F.explode(F.when(head, F.array(here, target(at([before.get(b) for b in blocks], "int"), True))).otherwise(F.array(here))))
    dealt = placed.select("to.block", "to.extra", "doc_id", "text").repartition(parts, "block")
    return dealt.sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 200) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending id order; after the last comes the first. Null text counts as empty. Rows of one id follow each
    other in the order of their texts; null ids come last. One document alone is its own next. An empty table gives an
    empty result. Other columns are not read. Ids are numbers.

    Documents are dealt by ranges of ids whose bounds are approximate quantiles (four to a shuffle partition). The rows of
    the first id of each range are also sent to the range before, so the next document is always at hand and the texts
    move once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter()

        def made(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
            edited = []
            for t, x in zip(texts, [*texts[1:], after], strict=True):
                cut = len(t) // 4
                edited.append(t[: len(t) - cut] + x[:cut])
            soft, other = maker.soft(pa.array([*texts, after], pa.large_string())), maker.soft(pa.array(edited, pa.large_string()))
            wide = lambda ts, lanes: [maker.strong(t).astype(">u8").tobytes().hex() + r.tobytes().hex() for t, r in zip(ts, (lanes & 0xFFFFFFFF).astype(">u4"), strict=False)]
            columns = [pa.array(ids, kind_pa), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(wide(texts, soft)), pa.array(wide(edited, other))]
            columns += [pa.array(likeness(soft[:-1], other)), pa.array(likeness(soft[:-1], soft[1:]))]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        ids, texts, block = [], [], None
        for batch in batches:
            for b, extra, ident, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if extra:
                    if texts and b == block:
                        yield made(ids, texts, text)
                        ids, texts = [], []
                    continue
                block = b
                if len(texts) > rows_at_once or sum(map(len, texts[-8:])) > 1 << 22:
                    yield made(ids, texts, text)
                    ids, texts = [], []
                ids.append(ident)
                texts.append(text)

    ident = docs.schema[id_col].dataType
    kind_pa = to_arrow_type(ident)
    rows = in_order(docs.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {ident.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
