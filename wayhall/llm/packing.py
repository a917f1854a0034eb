"""Packing documents into sequences by shortest-pack-first over the length histogram (operator 8).

1. Each document is tokenised once, on the executors, and cut into pieces of at most ``max_len`` ids: full pieces and one
   remainder. Only (doc_id, start, length, crc, tokens) rows go on.
2. The histogram of lengths has at most ``max_len`` rows, however large the input. On it, lengths are placed longest
   first, each into the pack with the most room left, which updates counts of packing patterns.
3. Patterns become slots (length, rank range, first sequence, offset). Their number depends on ``max_len`` only, so they
   may be sent to all executors. Each piece finds its slot by its rank among the pieces of its length.

Ranks are counted in salted buckets with prefix sums, so a length that a third of all pieces have isn't ranked in one task.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayhall.llm.scratch import materialise

#: The word pattern of the vocabulary's own pre-tokenizer, and the strings that it treats specially.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"
#: White space for Python's split(), ordinary characters for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters whose lower case depends on context in Python.
CONTEXTUAL = "Σ"


class CachedTokenizer:
    """The ids of a lower-casing, white-space-dropping word BPE, with words looked up before they are encoded.

    Such a tokenizer treats each run of non-space characters alone, and each match of WORDS in it alone, so ids of runs
    seen before can be reused. Texts for which that isn't certain are encoded whole. The cache is emptied when it has
    ``limit`` entries, which bounds memory.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.limit = Tokenizer.from_file(path), regex.compile(WORDS), limit
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, runs: set[str]) -> None:
        """Put runs into the cache."""
        known = self.known
        split = {r: self.words.findall(r) for r in runs if not r.isalpha()}
        new = [r for r in runs if r.isalpha()]
        new += {p for ps in split.values() for p in ps if p not in known and p not in runs or len(ps) == 1}
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            ends = (4 * np.append(np.flatnonzero(np.diff(np.array(got.word_ids))) + 1, len(got))).tolist()
            start = 0
            for p, end in zip(some, ends, strict=True):
                known[p] = ids[start:end]
                start = end
        for r, ps in split.items():
            known[r] = b"".join([known[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned little-endian 32-bit integers."""
        plain = [not (SPECIAL in t or any(c in t for c in SEPARATORS) or CONTEXTUAL in t) and unicodedata.is_normalized("NFC", t) for t in texts]
        runs = [t.lower().split() if ok else None for t, ok in zip(texts, plain, strict=True)]
        if len(self.known) > self.limit:
            self.known.clear()
        missing: set[str] = set()
        for rs in runs:
            missing.update(r for r in set(rs or ()) if r not in self.known)
        if missing:
            self._learn(missing)
        find = self.known.__getitem__
        return [self._whole(t) if rs is None else b"".join(map(find, rs)) for t, rs in zip(texts, runs, strict=True)]


@lru_cache(maxsize=1)
def tokenizer_of_worker(path: str) -> CachedTokenizer:
    """One for each Python worker, so that the tasks it runs share the cache."""
    return CachedTokenizer(path)


def tokens(tok: CachedTokenizer, column: pa.Array, chars: int = 1 << 21) -> Iterator[bytes]:
    """Ids of each text of a column, some texts at a time; null counts as empty."""
    held: list[str] = []
    size = 0
    for value in column:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size > chars:
            yield from tok.encode(held)
            held, size = [], 0
    yield from tok.encode(held)


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer_of_worker(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, own in enumerate(tokens(tok, batch.column(1))):
                ids = own + end
                n = len(ids) // 4
                for start in range(0, n, max_len):
                    own = ids[4 * start : 4 * (start + max_len)]
                    at.append(i)
                    rows.append((start, len(own) // 4, zlib.crc32(own), n))
            table = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(table[:, k]) for k in range(4))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, count): lengths go longest first into the pack with the most room, new packs open if none fits."""
    heap: list[tuple[int, int]] = []
    open_: dict[int, tuple[tuple[int, ...], int]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    made = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, key = heapq.heappop(heap)
                pattern, count = open_.pop(key)
                room, used = -room, min(left, count)
                if count > used:
                    made += 1
                    open_[made] = (pattern, count - used)
                    heapq.heappush(heap, (-room, made))
            else:
                room, pattern, used = max_len, (), left
            pattern, room, left = (*pattern, length), room - length, left - used
            if room:
                made += 1
                open_[made] = (pattern, used)
                heapq.heappush(heap, (-room, made))
            else:
                done.append((pattern, used))
    return done + [open_[k] for _, k in sorted(heap)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Each id of a document, its end id included, lies in exactly one piece; the pieces of a sequence lie without gaps from
    0. A null or empty text is the end id alone. Rows repeated with one id are packed each on its own. An empty table
    gives an empty result. Other columns are not read.
    """
    found = materialise(pieces(docs, tokenizer_path, max_len, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most max_len rows
    table = slots(shortest_pack_first(histogram, max_len))
    spark = docs.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(sums, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    sent, names = spark.sparkContext.broadcast(table), found.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = rows[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            more = [pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")
