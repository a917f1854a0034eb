"""Each stage of the pipeline against a plain-Python version, on what the stage before it kept."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import SCHEMA, corpus, frame, labels, white_words
from wayhall.llm import quality
from wayhall.llm.queries import KEEP_AT, KEEP_FROM, grade

#: Names that operators use inside.
CLASHING = ", row_id long, copy long, rate double, shuffle_key string, selected boolean, n long, node long, keep_id long"


def test_stages_by_brute_force(spark, tmp_path):
    copied = corpus()[16][1].split()  # near copies: one word in some hundred differs
    copies = [(200 + i % 9, " ".join(copied[:i] + [f"x{i}"] + copied[i + 1 :]), "en", "hot", None) for i in range(12)]
    rows = [(*r, i, 1, 0.5, "k", False, 2, 3, 4) for i, r in enumerate(corpus() + copies)]
    spark.createDataFrame(rows, SCHEMA + CLASHING).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, names, frames = [list(map(tuple, docs.collect()))], docs.columns, [docs]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert at == 4 or out.columns == names
        out.write.parquet(str(tmp_path / f"out{at}"))
        docs = spark.read.parquet(str(tmp_path / f"out{at}"))
        kept.append(list(map(tuple, docs.collect())))
        frames.append(docs)

    # Quality: every word's features looked up alone.
    model, f = quality.fit_quality(frames[0], labels(spark), grade()), quality.Featuriser()
    above = model.grades.index(KEEP_FROM) - 1
    want = Counter()
    for r in kept[0]:
        words = [np.frombuffer(w.encode(), np.uint8) for w in white_words(r[1], lower=False)]
        total = 0.0
        for w in words:
            one, n = np.array([0]), np.array([len(w)])
            spans = [f.lower.spans(w, one, n), quality.mix(f.exact.spans(w, one, np.minimum(n, 2)) + quality.U(1)), quality.mix(f.exact.spans(w, np.maximum(n - 2, 0), n) + quality.U(2))]
            total += sum(float(model.weights[int(s[0]) >> (64 - quality.BITS)]) for s in spans)
        margin = total / max(1, len(words)) + float(model.weights[f.length_feature(np.array([len(words)]))[0]])
        p = 1 / (1 + math.exp(model.thresholds[above] - margin))
        assert abs(p - KEEP_AT) > 1e-6
        if p >= KEEP_AT:
            want[r] += 1
    assert Counter(kept[1]) == want and 0 < len(kept[1]) < len(kept[0])

    # Exact dedup: the longest of equal texts, then the smallest id.
    equal = defaultdict(list)
    for r in kept[1]:
        equal[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    assert len(kept[2]) == len(equal) and not Counter(kept[2]) - Counter(kept[1])
    for r in kept[2]:
        assert rank(r) == min(map(rank, equal.pop(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""))))

    # Near copies: one row of each component, of the smallest id; rows without words stay.
    words = [white_words(r[1]) for r in kept[2]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for i, r in enumerate(kept[2]):
        groups[root[i]].append(r)
    place = lambda r: (r[0] is None, r[0] or 0)
    assert len(kept[3]) == len(groups) < len(kept[2]) and not Counter(kept[3]) - Counter(kept[2])
    for g in groups.values():
        assert [place(r) for r in kept[3] if r in g] == [min(map(place, g))]

    # Mixing: the inverse of each source's Poisson distribution at each id's hash.
    sources = Counter(r[3] or "~" for r in kept[3])
    want = Counter()
    for r in kept[3]:
        rate = len(kept[3]) / len(sources) / sources[r[3] or "~"]
        u = (int(hashlib.md5(f"{corpus_pipeline.MIX_SEED}:{'~' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total < u:
            k += 1
            p *= rate / k
            total += p
        want[r] += k
    assert Counter(kept[4]) == +want

    # Packing: an exact round trip of ids, and sequences without gaps.
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    size, end = corpus_pipeline.MAX_LEN, corpus_pipeline.END_ID
    for r in kept[4]:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, end]
        for a in range(0, len(ids), size):
            want[(r[0], a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes()), len(ids))] += 1
    assert Counter(r[:5] for r in kept[5]) == want
    at = defaultdict(list)
    for r in frames[5].collect():
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= size


def test_pipeline_of_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
