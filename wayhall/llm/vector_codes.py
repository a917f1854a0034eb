"""Vector code compression by product codes, nearest entries found by partial-distance search (operator 13).

Vectors become integers and are cut into equal parts; each part has a codebook that starts as that part of the first
vectors and is moved to the means of what it is nearest to, for a fixed number of rounds, all in integers. So results
don't depend on how rows are dealt.

``nearest`` looks at the dimensions of a part in the order of the codebook's variance, the largest first, entry by entry,
over a whole batch. A vector stops looking at an entry once its distance so far strictly exceeds the best complete
distance that it has; what is left to look at shrinks, the result is that of a full search, ties included.

A round sends one row for each part, entry and task to the shuffle, and a codebook, of a fixed size, to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.llm.scratch import discard, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers beyond it could overflow sums of squares.
LARGEST = 1 << 26
#: Rows up to which a table of labels is broadcast, once it is counted; a larger one is shuffled.
BROADCAST_ROWS = 1 << 16


def floored(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and the integers of those; ValueError for unequal lengths or components that are too large."""
    rows = [None if v is None or any(x is None for x in v) else v for v in vectors.to_pylist()] if vectors.null_count or vectors.flatten().null_count else None
    if rows is not None:
        whole = np.array([r is not None for r in rows], bool)
        data, sizes = np.array([x for r in rows if r is not None for x in r], float), np.array([len(r) for r in rows if r is not None], int)
    else:
        whole = np.ones(len(vectors), bool)
        data, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), vectors.value_lengths().to_numpy(zero_copy_only=False)
    if not len(sizes):
        return whole, np.zeros((0, 0), np.int64)
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal lengths")
    data = data.reshape(len(sizes), sizes[0])
    finite = np.isfinite(data).all(1)
    whole[np.flatnonzero(whole)[~finite]] = False
    data = np.floor(scale * data[finite])
    if len(data) and np.abs(data).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g}")
    return whole, data.astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: kept rows as integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, data = floored(batch.column(2), scale)
            keep = pa.array(whole)
            at = np.arange(len(data) + 1) * (data.shape[1] if len(data) else 0)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(data.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), lists], ["vec_id", "label", "v"])

    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), F.col(f"`{vector_col}`").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>")


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions of a part's codebook (entries x dimensions), the largest variance first; ties keep their order."""
    n = len(book)
    return np.argsort(-(n * (book * book).sum(0) - book.sum(0) ** 2), kind="stable")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry, ties to the lower one, and the squared distance."""
    order = search_order(book)
    lead = order[0]
    at = np.abs(x[:, lead, None] - book[None, :, lead]).argmin(1)
    best = ((x - book[at]) ** 2).sum(1)
    columns = [np.ascontiguousarray(x[:, d]) for d in order]
    for e, entry in enumerate(book):
        rows = np.flatnonzero(at != e)
        far = np.zeros(len(rows), np.int64)
        for column, d in zip(columns, order, strict=True):
            far += (column[rows] - entry[d]) ** 2
            stays = far <= best[rows]
            if not stays.all():
                rows, far = rows[stays], far[stays]
            if not len(rows):
                break
        wins = (far < best[rows]) | (e < at[rows])  # those left are no further than the best
        at[rows[wins]], best[rows[wins]] = e, far[wins]
    return at, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if (column.value_lengths().to_numpy(zero_copy_only=False) != dims).any():
        raise ValueError("vectors of unequal lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _moved(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x dimensions) after one round; entries that nothing is nearest to stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            for p in range(parts if len(x) else 0):
                own = x[:, p * width : (p + 1) * width]
                at, _ = nearest(own, books[p])
                np.add.at(total[p], at, own)
                n[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(n)
        sums = total[p, e]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), lists], ["part", "entry", "n", "s"])

    found = ints.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(width))).alias("s"))
    out = books.copy()
    for r in found.collect():  # parts x entries rows
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["s"]]
    return out


def first_books(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks of the first vectors by id (null ids last, then by their integers); None without vectors."""
    rows = ints.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).select("v").collect()
    if not rows:
        return None
    if len({len(r[0]) for r in rows}) > 1:
        raise ValueError("vectors of unequal lengths")
    x = np.array([r[0] for r in rows], np.int64)
    if not x.shape[1] or x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} equal parts")
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def train(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x dimensions) after so many rounds over all vectors."""
    books = first_books(ints, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = _moved(ints, books)
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (bytes, an index for each part), error."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), parts * width)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts if len(x) else 0):
                at, far = nearest(x[:, p * width : (p + 1) * width], books[p])
                code[:, p], error = at, error + far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in ints.schema}
    return ints.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with approx, the vector that each code stands for."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book)) for book in books))
    code = F.col("code")
    index = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("approx", F.concat(*(F.get(F.get(flat, F.lit(p)), index(p)) for p in range(len(books)))))


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' decimal components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each kept row of vectors.

    Rows whose vector is null or holds null or non-finite components are dropped. Components become floor(scale * x).
    code has two hex digits for each part; error is the squared distance to what the code stands for, label_error its sum
    over the rows of one label, null labels together. Rows repeated with one id are rows of their own; among the first
    vectors, equal ids are in order of their components and null ids come last. With fewer kept rows than entries, there
    are as many entries as rows. No kept row gives an empty result. Vectors of unequal lengths, of a length that can't be
    cut into equal parts, or with components beyond LARGEST / scale raise an error. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    ints = materialise(integers(vectors, id_col, vector_col, label_col, scale), "integers")
    books = train(ints, parts, entries, rounds)
    if books is None:
        return ints.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    codes = materialise(encode(ints, books), "codes")
    discard(ints)
    by_label = materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"), "labels")
    if by_label.count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB: every distance in full, rounds written out one after another."""
    gap = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    found = lambda i: f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min((d, entry)) AS m FROM (SELECT p.vec_id, p.label, p.part, p.x, c.entry, {gap} AS d FROM p JOIN c{i} c USING (part)) GROUP BY vec_id, label, part)"
    moved = lambda i: f"""u{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM (
    SELECT part, m[2] AS entry, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS pos) GROUP BY ALL) GROUP BY part, entry),
  c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.x, c.x) AS x FROM c{i} c LEFT JOIN u{i} u USING (part, entry))"""  # noqa: E731
    steps = [s for i in range(rounds) for s in (found(i), moved(i))]
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
  c0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p) WHERE entry < {entries}),
  {', '.join([*steps, found(rounds)])},
  f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM f"""
