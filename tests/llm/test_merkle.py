"""Merkle manifests against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import SCHEMA, corpus, frame
from wayhall.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(said(doc_id), said(source), said(lang), said(n_chars), said(text))


def plain_tree(leaves, arity):
    """Root, and for each leaf the steps (place, siblings) to it."""
    steps, at, now = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(now) > 1:
        runs = [now[i : i + arity] for i in range(0, len(now), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            steps[k].append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        at, now = [i // arity for i in at], [h(*r) for r in runs]
    return now[0], steps


def plain(rows, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0], plain_leaf(r, r[1]), plain_leaf(r, r[1].replace("\n", "")) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else None))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([x[1] for x in groups[s]], arity)
    root, upper = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, above in zip(names, upper, strict=True):
        for (doc_id, leaf, other), own in zip(groups[s], trees[s][1], strict=True):
            steps, folded = own + above, other or leaf
            for place, siblings in steps:
                folded = h(*siblings[:place], folded, *siblings[place:])
            out.append((doc_id, leaf, trees[s][0], root, h(*(x for _, sib in steps for x in sib)), folded, folded == root))
    return out


def many(n=300, sources=40):
    rnd = random.Random(n)
    return [(i, "\n".join(f"line {rnd.randrange(99)}" for _ in range(rnd.randrange(3))), "en", "hot" if i % 3 == 0 else f"é{rnd.randrange(sources)}", i) for i in range(n)]


@pytest.mark.parametrize(("rows", "arity", "fan", "per_range"), [(corpus(), 3, 64, 100_000), (many(200, 500), 5, 2, 20), (many(1), 3, 64, 9), (many(28, 1), 3, 2, 1)])
def test_against_plain_python(spark, rows, arity, fan, per_range):
    got = merkle.merkle_proofs(frame(spark, rows).repartition(3), claimed=merkle.tampered_leaf(), arity=arity, fan=fan, per_range=per_range).collect()
    want = plain(rows, arity)
    strip = lambda rows: Counter(tuple(r)[:4] for r in rows)
    assert strip(got) == strip(want)
    once = {r[0] for r in want if r[0] is not None and sum(x[0] == r[0] for x in want) == 1}
    only = lambda rows: sorted(tuple(r) for r in rows if r[0] in once)
    assert only(got) == only(want)
    assert Counter(r["proof_sha256"] for r in got) == Counter(r[4] for r in want)


def test_forests_merge_in_any_order():
    rnd = random.Random(4)
    leaves = [h(str(i)) for i in range(50)]
    want, _ = plain_tree([plain_tree(leaves[:33], 3)[0], plain_tree(leaves[33:], 3)[0]], 3)
    nodes = [(0, 0, i, d) for i, d in enumerate(leaves[:33])] + [(1, 0, i, d) for i, d in enumerate(leaves[33:])]
    sizes = {0: 33, 1: 17, merkle.TOP: 2}
    for _ in range(20):
        rnd.shuffle(nodes)
        forests = []
        for a in range(0, 50, 7):
            forests.append(merkle.Forest(sizes))
            for node in nodes[a : a + 7]:
                forests[-1].add(*node)
        while len(forests) > 1:
            a, b = forests.pop(rnd.randrange(len(forests))), forests.pop(rnd.randrange(len(forests)))
            forests.append(a.merge(b))
        assert forests[0].root == want and not forests[0].open


def test_few_nodes_leave_a_range():
    forest = merkle.Forest({0: 10_000, merkle.TOP: 1})
    for i in range(3_217, 6_801):
        forest.add(0, 0, i, h(str(i)))
    assert len(forest.nodes()) <= 2 * 2 * 9


def test_siblings_and_subroots(spark):
    rows = many(120, 4)
    made = merkle.manifest(frame(spark, rows), per_range=30)
    for r in made.proofs(siblings=True).collect():
        assert merkle.fold(r["leaf"], r["proof"]) == made.root == r["folded_root"] and r["verified"]
    want = {r[2] for r in plain(rows)}
    found = merkle.subroots(made).collect()
    assert {r["subroot"] for r in found} == want and sum(r["n"] for r in found) == 120 and len(found) == len(want)


def test_a_change_anywhere_changes_the_root(spark):
    rows = many(30, 3)
    root = lambda rows: merkle.manifest(frame(spark, rows)).root
    first = root(rows)
    assert root(rows[::-1]) == first
    for k, v in ((1, "x"), (1, None), (2, None), (3, None), (4, None)):
        other = list(rows[7])
        other[k] = v
        assert root([*rows[:7], tuple(other), *rows[8:]]) != first


def test_empty_and_clashing(spark):
    assert merkle.merkle_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)) is None
    rows = [(1, "a", "en", "s", 1), (None, None, None, None, None), (2, "", "", "", 0)]
    extra = spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4) for r in rows], SCHEMA + ", part long, place long, leaf string, grp string, row long, id long")
    got = merkle.merkle_proofs(extra, claimed=merkle.tampered_leaf()).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))
