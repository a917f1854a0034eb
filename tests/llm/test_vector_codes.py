"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from wayhall.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x[d] for x in o) // len(o) for d in range(width)] if o else e for o, e in zip(own, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    return [(i, c, e, by_label[label], sha) for i, c, e, label in out]


def vectors(n, seed=2, dims=16):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.choice((rnd.gauss(0, 0.1), rnd.randrange(-3, 3) / 4)))) for _ in range(dims)], rnd.choice((None, 1, 2, 2))) for i in range(n)]
    if n > 30:
        rows[3] = (3, None, 1)
        rows[5] = (5, [None, *rows[5][1][1:]], 1)
        rows[7] = (7, [math.nan, *rows[7][1][1:]], 2)
        rows[8] = (8, [-math.inf, *rows[8][1][1:]], 2)
        rows[20:28] = [(20 + i, rows[19][1], 2) for i in range(8)]  # copies
        rows += [rows[1], (2, rows[9][1], None), (None, rows[10][1], 1), (None, None, None)]
    return rows


@pytest.mark.parametrize("n", [1, 9, 16, 120])
def test_against_plain_python(spark, n):
    rows = vectors(n)
    got = vector_codes.compress(spark.createDataFrame(rows, KIND).repartition(3), rounds=3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, rounds=3)))


def test_partial_distance_search_is_exact():
    rng = np.random.default_rng(1)
    for low, high, n in ((-3, 3, 16), (-2000, 2000, 16), (0, 2, 5), (0, 1, 16)):
        x, book = rng.integers(low, high, (3000, 8)), rng.integers(low, high, (n, 8))
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        at, far = vector_codes.nearest(x, book)
        assert (at == full.argmin(1)).all() and (far == full.min(1)).all()
    book = np.array([[0, 5, 0], [9, 5, 1], [-9, 5, 2]])
    assert vector_codes.search_order(book).tolist() == [0, 2, 1]


def test_decode(spark):
    rows = vectors(60)
    ints = vector_codes.integers(spark.createDataFrame(rows, KIND), "vec_id", "embedding", "label")
    books = vector_codes.train(ints, rounds=2)
    back = vector_codes.decode(vector_codes.encode(ints, books), books).join(ints.select("vec_id", "v").dropDuplicates(["vec_id"]), "vec_id").where("vec_id > 10").collect()
    assert len(back) > 40
    for r in back:
        assert sum((round(4096 * a) - b) ** 2 for a, b in zip(r["approx"], r["v"], strict=True)) == r["error"]


def test_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], KIND)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2), (2, [None] * 8, 2)], KIND)).collect() == []
    clash = spark.createDataFrame([(1, [0.5] * 8, 1, "x", 2, "y")], KIND + ", code string, error long, own string")
    assert [tuple(r)[:4] for r in vector_codes.compress(clash).collect()] == [(1, "00" * 8, 0, 0)]
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="length|equal parts|beyond"):
            vector_codes.compress(spark.createDataFrame(bad, KIND)).collect()
