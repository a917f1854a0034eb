"""SimHash near-duplicates against plain Python, and their anchors."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, corpus, frame, white_words
from wayhall.llm import simhash
from wayhall.llm.textkit import U


def plain_print(text):
    w = white_words(text)
    own = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, differ=4):
    """Numbers of the smallest fingerprint reachable, by comparing all."""
    known = sorted(set(prints))
    root = {x: x for x in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(known):
        for y in known[:i]:
            if (x ^ y).bit_count() <= differ:
                a, b = sorted((top(x), top(y)))
                root[b] = a
    return [top(x) for x in prints]


def near_corpus():
    rnd, rows = random.Random(3), corpus()
    words = [f"word{i}" for i in range(400)]
    for i in range(40):
        own = list(words)
        for _ in range(rnd.randrange(1, 6)):
            own[rnd.randrange(400)] = f"other{rnd.randrange(1000)}"
        rows.append((200 + i, " \t".join(own) if i % 2 else " ".join(own).upper(), None, None, None))
    return rows


@pytest.mark.parametrize(("parts", "most"), [(None, simhash.SLICE), (2, 5)])
def test_against_plain_python(spark, parts, most):
    rows = near_corpus()
    own = [plain_print(r[1]) for r in rows]
    roots = plain_components(own)
    least = {}
    for r, top in zip(rows, roots, strict=True):
        least[top] = min((x for x in (least.get(top), r[0]) if x is not None), default=None)
    want = sorted(((r[0], f"{p:016x}", least[top]) for r, p, top in zip(rows, own, roots, strict=True)), key=repr)
    got = simhash.simhash_components(frame(spark, rows).repartition(3), parts=parts, most=most).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
    assert any(i != top for i, top in ((r["doc_id"], r["component_id"]) for r in got))


def test_random_fingerprints(spark):
    # Chains and balls of few bits around some centres, and others by chance.
    rnd = random.Random(8)
    own = {rnd.getrandbits(64) for _ in range(300)}
    for centre in list(own)[:20]:
        at = centre
        for _ in range(15):
            at ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice((1, 3, 4, 5))))
            own.add(at)
    own |= {0, (1 << 64) - 1, 15, 31 << 59}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(x),) for x in own], "fp long").repartition(3)
    for parts, most in ((3, simhash.SLICE), (3, 4), (2, 50)):
        found = simhash.links(distinct, simhash.Anchors(parts), most=most).collect()
        pairs = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in found]
        assert all(0 < (u ^ v).bit_count() <= 4 for u, v in pairs)
        root = {x: x for x in own}
        for _ in range(len(own)):
            before = dict(root)
            for u, v in pairs:
                root[u] = root[v] = min(root[u], root[v])
            if before == root:
                break
        assert [root[x] for x in sorted(own)] == plain_components(sorted(own))


def test_anchors_cover():
    rng = np.random.default_rng(4)
    for parts in (2, 3, 4):
        anchors = simhash.Anchors(parts)
        for p in range(parts):
            word = rng.integers(0, 1 << anchors.width[p], 500, dtype=U)
            home = anchors.home(word, p)
            assert (np.bitwise_count(word ^ home) <= 1).all() and (anchors.home(home, p) == home).all()
            moved = word.copy()
            for _ in range(anchors.reach):
                moved ^= U(1) << rng.integers(0, anchors.width[p], 500, dtype=U)
            assert (anchors.near(moved, p) == home[:, None]).any(1).all()


def test_dense_group_gives_few_links():
    # 2000 fingerprints within two bits of one: a search puts out one link for each, not each pair.
    bits = [(a, b) for a in range(64) for b in range(a)][:2000]
    all_ = np.array([1 << a | 1 << b for a, b in bits], U)
    found = list(simhash.near_pairs(all_, all_, 4))
    assert sum(len(u) for u, _ in found) == 1999


def test_empty_and_clashing(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "some words of a text", 1, 2, "a"), (2, None, None, None, None), (None, "\n", 3, 4, "b")]
    clash = spark.createDataFrame(rows, "doc_id long, text string, fp long, anchor long, component_id string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(clash).collect()), key=repr)
    assert got == sorted([(1, f"{plain_print('some words of a text'):016x}", 1), (2, "0" * 16, 2), (None, "0" * 16, 2)], key=repr)


def test_spark_hashes_alike(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64)
    assert got == xxhash.xxh64_intdigest(b"a b c d", 42)
