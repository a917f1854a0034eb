"""Operators against plain-Python versions, over rows with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, corpus, frame, white_words
from wayhall.llm import exact_dedup, fingerprint, jaccard_join, license_scan, lm_scoring, mixing, packing, substring_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def spread(spark, rows=None):
    return frame(spark, rows).repartition(3)


def test_exact_dedup(spark):
    rows = corpus()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r)
    want = Counter()
    for t, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            want[(r[0], best[0], len(g), hashlib.sha256(t.encode()).hexdigest())] += 1
    for size in (4096, 7):
        got = exact_dedup.exact_dedup(spread(spark), block_chars=size).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_starts_again_on_a_clash(spark):
    from pyspark.sql import functions as F

    tried = []

    def keys(block, seed):
        tried.append(seed)
        return F.struct((F.length(block).cast("long") if seed == 0 else F.xxhash64(block)).alias("h1"), F.lit(0).cast("long").alias("h2"))

    rows = [(1, "aa", None, None, None), (2, "bb", None, None, None), (3, "a a", None, None, None)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(frame(spark, rows), keys_of=keys).collect()}
    assert got == {1: 3, 2: 2, 3: 3} and max(tried) == 1


def test_jaccard(spark):
    rows = corpus()
    sets = []
    for r in rows:
        w = white_words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    got = jaccard_join.jaccard_components(spread(spark)).collect()
    assert Counter(map(tuple, got)) == want


def test_substrings(spark):
    rows = corpus()
    first = {}
    key = lambda d: (d is None, d or 0)
    for r in rows:
        w = white_words(r[1], lower=False)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, (True, 1e9)), key(r[0]))
    want = Counter()
    for r in rows:
        w = white_words(r[1], lower=False)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(r[0]) for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(map(tuple, substring_dedup.substring_dedup(spread(spark)).collect())) == want


def test_lm_base_and_gain(spark):
    rows = corpus()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [[*white_words(r[1]), None] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens, strict=True) if not held(r[0]) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True))
    got = lm_scoring.lm_scores(spread(spark)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_lm_is_a_distribution(spark):
    texts = [(i, "the cat sat on the mat the cat ran" if i % 2 else "le chat est sur le lit le chat", None, None, None) for i in range(40)]
    docs = frame(spark, texts)
    counts = lm_scoring.count_tokens(docs)
    tree = lm_scoring.fit_tree(docs, counts)
    assert all(len(level["context"]) for level in tree.levels)
    rng, n = np.random.default_rng(1), counts.count() + 1  # the unknown and all tokens
    assert n < lm_scoring.SYMBOLS
    for _ in range(20):
        before = rng.integers(0, n, 3)
        p = sum(10 ** tree.log10(np.array([*before, s]), np.arange(4))[3] for s in range(n))
        assert abs(p - 1) < 1e-9
    got = lm_scoring.lm_scores(docs).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_packing_round_trip(spark):
    rows = corpus()
    got = packing.pack_documents(spread(spark), TOKENIZER, max_len=64).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want, total = Counter(), 0
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        for a in range(0, len(ids), 64):
            own = ids[a : a + 64]
            want[(r[0], a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= math.ceil(total / 64 * 1.1) + 1


def test_tokenizer_cache():
    odd = ["", "it's 'the café ''s ½ Ⅷ ²x", "a\x1cb c", "Σας ΟΔΟΣ", "é x", "<|endoftext|> hi", "İstanbul ǅ ﬁ", "x y z", "日本語 テスト 123", "a​b !!'s don't'll", "１２"]
    cached = packing.CachedTokenizer(TOKENIZER, limit=5)
    for texts in (odd, odd[::-1]):
        want = [x.ids for x in cached.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode(texts)] == want


def test_licenses(spark):
    texts = [
        "All Rights\tReserved. CC-BY cc by", "the GNU General Public License, version 3; general public license", "Released under the MIT License.", "reserved rights all", None, "",
        "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files", "éall rights reserved", "x " * 3000 + "all rights reserved",
        "released under q under the q the mit q mit license q", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i]["n_base"] for i in range(9)] == [3, 2, 0, 0, 0, 0, 0, 0, 1]
    assert (got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (0, 5, "cc-by,reserved")
    assert (got[1]["first_word"], got[1]["last_word"]) == (2, 7) and got[8]["first_word"] == 3000
    assert got[2]["labels"] == "mit" and got[6]["labels"] == "mit" and got[2]["base_labels"] == ""
    assert got[4]["n_words"] == 0 and got[4]["first_word"] is None and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[9]["labels"] == "" and got[9]["score"] < 0.8  # the words are there, but not side by side
    assert got[10]["labels"] == "cc-by-sa"  # not cc-by with a word put in


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_chain(runs):
    """Longest chain of runs (low, high, diagonal), trying all; matched words, then the shortest span, then the first."""
    best = (0, 0, 0)

    def extend(matched, first, last, following):
        nonlocal best
        low, high, diagonal = last
        best = max(best, (matched, -(high + diagonal - first), -first))
        for i, (a, b, d) in enumerate(following):
            gain = b - max(a, high, high + diagonal - d)
            if gain > 0:
                extend(matched + gain, first, (a, b, d), following[i + 1 :])

    for i, (a, b, d) in enumerate(runs):
        extend(b - a, a + d, (a, b, d), runs[i + 1 :])
    return best[0], -best[2], -best[2] - best[1]


def plain_spans(words, coverage=0.8, drift=0.125):
    """start, stop, label, likeness of the templates in the words, comparing words."""
    found = set()
    for t, (label, text) in enumerate(license_scan.TEMPLATES):
        template = text.split()
        n, k = len(template), license_scan.K
        votes = defaultdict(set)
        for q in range(n - k + 1):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == template[q : q + k]:
                    votes[p - q].add(q)
        for anchor in votes:
            runs = []
            for d in range(anchor, anchor + max(1, int(n * drift)) + 1):
                for q in sorted(votes.get(d, ())):
                    if runs and runs[-1][2] == d and q <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], q + k, d)
                    else:
                        runs.append((q, q + k, d))
            matched, start, stop = plain_chain(sorted(runs))
            like = matched / max(n, stop - start)
            if like >= coverage:
                found.add((like, matched, -start, -t, stop, label))
    stands = [x for x in found if not any(y[:4] > x[:4] and -y[2] < x[4] and -x[2] < y[4] for y in found)]
    return sorted((-s, stop, label, like) for like, _, s, _, stop, label in stands)


def test_licenses_by_brute_force(spark):
    import random

    rnd = random.Random(11)
    texts = [r[1] if r[0] != 54 else None for r in corpus()]
    for _ in range(60):
        words = []
        for _ in range(rnd.randrange(1, 4)):
            words += [rnd.choice(["x", "the", "software", "cc", "by", "éa"]) for _ in range(rnd.randrange(12))]
            part = rnd.choice([*license_scan.TEMPLATES, *((b, a) for a, b in license_scan.PHRASES.items())])[1].split()
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(part))
                part[at : at + rnd.randrange(2)] = rnd.choice([[], ["new"], ["one", "more"], part[at : at + 4]])
                part = part or ["gone"]
            words += part
        texts.append(rnd.choice([" ", ", ", "\n"]).join(words))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).repartition(3)).collect()}
    assert len(got) == len(texts)
    several = 0
    for i, t in enumerate(texts):
        words = alnum_words(t)
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        spans = plain_spans(words)
        several += len(spans)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert [tuple(s) for s in r["spans"]] == spans, t
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert r["labels"] == ",".join(sorted({label for _, label in places} | {s[2] for s in spans}))
        assert r["score"] == 1 if places else r["score"] >= max((s[3] for s in spans), default=0)
    assert several > 30


def test_fingerprints(spark):
    rows = corpus()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = Counter()
    for r, x in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = r[1] or "", x[1] or ""
        cut = len(t) // 4
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())] += 1
    got = fingerprint.fingerprint_documents(spread(spark)).collect()
    assert Counter(tuple(r)[:3] for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        by_text[r["fingerprint"]].add(r["n_chars"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(by_text) == len({"\n".join(sorted(p for p in (r[1] or "").split("\n") if p)) for r in rows})


def test_fingerprint_algebra():
    maker = fingerprint.Fingerprinter()
    a, b, ab, ba = maker.fingerprints(["one two three\nfour five", "six seven eight", "one two three\nfour five\nsix seven eight", "six seven eight\nfour five\none two three"])
    assert ab == ba == fingerprint.combine(a, b) and fingerprint.combine(ab, b, -1) == a and a != b


def test_likeness_is_the_overlap_of_word_pairs():
    rnd = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rnd.choice(vocabulary, k))
    pairs = lambda t: sum((Counter(zip(p.split(), p.split()[1:])) for p in t.split("\n")), Counter())
    maker, off = fingerprint.Fingerprinter(), []
    for k in range(60):
        a = text(300)
        b = " ".join(a.split()[: 300 - 4 * k]) + " " + ("same " * (5 * k) if k % 2 else text(4 * k))
        x, y = maker.soft(pa.array([a, b], pa.large_string()))
        n, m = pairs(a), pairs(b)
        off.append(abs(float(fingerprint.likeness(x[None], y[None])[0]) - 2 * sum((n & m).values()) / (sum(n.values()) + sum(m.values()))))
    assert np.mean(np.array(off) < 0.15) > 0.9 and max(off) < 0.3


def test_mixing(spark):
    rows = corpus()
    got = mixing.mix_sources(frame(spark), total=600).collect()
    n = Counter(r[3] or "~" for r in rows)
    found = Counter(r["source"] or "~" for r in got)
    for s in n:
        assert abs(found[s] - 600 / len(n)) < 6 * math.sqrt(600 / len(n) * 2)
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    again = mixing.mix_sources(spread(spark), total=600).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    only = mixing.mix_sources(frame(spark), weights={"hot": 1.0}, total=50)
    assert {r["source"] for r in only.collect()} == {"hot"}


def test_poisson_inverse(spark):
    from pyspark.sql import functions as F

    u = spark.range(1, 2000).select((F.col("id") / 2000).alias("u"))
    for rate in (0.1, 1.0, 9.0):
        ks = [r[0] for r in u.select(mixing.poisson_inverse(F.lit(rate), F.col("u"), 120)).collect()]
        assert abs(sum(ks) / len(ks) - rate) < 0.05 * (1 + rate)


@pytest.mark.parametrize("make", [
    exact_dedup.exact_dedup, exact_dedup.keep_one, jaccard_join.jaccard_components, jaccard_join.keep_one_of_each, substring_dedup.substring_dedup, lm_scoring.lm_scores,
    mixing.mix_sources, mixing.mixed_rows, license_scan.scan_licenses, fingerprint.fingerprint_documents, lambda d: packing.pack_documents(d, TOKENIZER),
])
def test_empty_and_clashing(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "some words of a text", "x", "y", 1, 2, 3, 4, "5", 6, 7, 8), (2, None, None, None, None, None, None, None, None, None, None, None)]
    extra = spark.createDataFrame(rows, SCHEMA + ", row_id long, n long, h long, name string, copy long, rate long, block long")
    assert make(extra).count() >= 1


@pytest.mark.parametrize("depth", [2, 3])
def test_lm_tree_keeps_what_a_large_corpus_holds_rarely(spark, depth):
    # Rare next to the size of the corpus and outside any fixed alphabet: 6,000 words, a pair seen 8 times.
    rows = [(i, " ".join(f"w{(i * 31 + j * 17) % 6000}" for j in range(300)), None, None, None) for i in range(400)]
    rows += [(1000 + i, "zyx wvu", None, None, None) for i in range(8)]
    tokens = [[*white_words(r[1]), None] for r in rows]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for r, t in zip(rows, tokens, strict=True) if not held(r[0])]
    counts = [Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, depth + 2)]
    n, v = sum(counts[0].values()), len(counts[0])
    after = [defaultdict(Counter) for _ in range(depth)]
    for d in range(1, depth + 1):
        for run, c in counts[d].items():
            after[d - 1][run[:-1]][run[-1]] += c
    kept = [set() for _ in range(depth)]

    def p(run, d):
        """Of the last token of run after at most d others."""
        if d == 0:
            return (counts[0][run[-1:]] + 1) / (n + v + 1)
        q, context = p(run, d - 1), run[-1 - d : -1]
        if len(context) < d or context not in kept[d - 1]:
            return q
        follow = after[d - 1][context]
        often = {w: c for w, c in follow.items() if c >= 4}
        return (often.get(run[-1], 0) + (lm_scoring.PRIOR + sum(follow.values()) - sum(often.values())) * q) / (sum(follow.values()) + lm_scoring.PRIOR)

    for d in range(1, depth + 1):
        for context, follow in after[d - 1].items():
            total, often = sum(follow.values()), {w: c for w, c in follow.items() if c >= 4}
            gain = sum(c * math.log(c / total / p((*context, w), d - 1)) for w, c in often.items())
            rare, mass = total - sum(often.values()), 1 - sum(p((*context, w), d - 1) for w in often)
            gain += rare * math.log(rare / total / max(mass, 1e-12)) if rare else 0
            if often and gain >= lm_scoring.DIVERGENCE:
                kept[d - 1].add(context)
    assert ("zyx",) in kept[0] and len(kept[0]) > 4096
    want = sorted((r[0], round(sum(math.log10(p(tuple(t[max(0, i - depth) : i + 1]), depth)) for i in range(len(t))), 6)) for r, t in zip(rows, tokens, strict=True))
    got = lm_scoring.lm_scores(spread(spark, rows), depth=depth).collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == want


def test_mixing_of_a_rare_source(spark):
    from pyspark.sql import functions as F

    u = spark.range(1, 200).select((F.col("id") / 200).alias("u"))
    for rate in (690.0, 710.0, 20_000.0):
        most = int(rate + 12 * math.sqrt(rate) + 40)
        cdf = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(most)])
        got = [r[0] for r in u.select(mixing.poisson_inverse(F.lit(rate), F.col("u"), most)).collect()]
        assert got == [int(np.searchsorted(cdf, i / 200)) for i in range(1, 200)]
    rows = [(i, "text", "en", "large", None) for i in range(100)] + [(1000, "rare", "en", None, None)]
    got = mixing.mix_sources(frame(spark, rows), total=20_000).collect()
    rare = [r["copy"] for r in got if r["source"] is None]
    assert sorted(rare) == list(range(len(rare))) and abs(len(rare) - 10_000) < 600 and abs(len(got) - 20_000) < 1000


def test_jaccard_links(spark):
    # 40 near copies of one text: every pair of them links, which no leader or component may hide.
    words = [f"w{i}" for i in range(200)]
    rows = corpus() + [(100 + i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :]), None, None, None) for i in range(40)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (white_words(r[1]) for r in rows)]
    have = Counter(x for x in sets if x)
    distinct = list(have)
    want = Counter()
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                want[(*sorted([(len(x), have[x]), (len(y), have[y])]), len(x & y))] += 1
    got = jaccard_join.jaccard_links(spread(spark, rows)).collect()
    assert Counter((*sorted([(r["n_a"], r["rows_a"]), (r["n_b"], r["rows_b"])]), r["overlap"]) for r in got) == want
    assert sum(r["doc_a"] is not None and r["doc_b"] is not None and min(r["doc_a"], r["doc_b"]) >= 100 for r in got) == 40 * 39 // 2
    assert len({(r["set_a"], r["set_b"]) for r in got}) == len(got)


def test_keep_one_of_each_by_row(spark):
    text = lambda k: " ".join(f"{k}{j}" for j in range(60))
    near = lambda k: text(k) + " more"
    texts = [(1, text("a")), (None, near("a")), (None, text("b")), (None, text("c")), (None, near("c")), (7, text("d")), (7, near("a")), (8, text("e")), (8, near("e")), (None, None), (9, ""), (9, "")]
    got = jaccard_join.keep_one_of_each(spread(spark, [(i, t, None, None, None) for i, t in texts])).collect()
    kept = Counter((r["doc_id"], (r["text"] or "").split(" ")[0]) for r in got)
    assert kept == Counter([(1, "a0"), (None, "b0"), (None, "c0"), (7, "d0"), (8, "e0"), (None, ""), (9, ""), (9, "")])
