"""Small corpora and plain-Python versions of word rules."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def white_words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def corpus(n=60, seed=5):
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, repeated ids and a hot source."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéñ字") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = text(40)
    texts = [text(rnd.randrange(1, 120)) for _ in range(n)]
    for i in range(10, 16):
        texts[i] = texts[9].replace(" ", "  ", i)
    for i in range(20, 28):
        words = texts[19].split() or ["x"]
        words[i % len(words)] = "Changed"
        texts[i] = " ".join(words * (1 if len(words) > 60 else 3))
    for i in range(30, 50):
        texts[i] = text(5) + " " + passage + "\n" + text(30)
    texts[50], texts[51], texts[52], texts[53] = None, "", " \t\n", "Solo"
    texts[54] = text(20_000)
    texts[55] = "\x0b".join([passage] * 3)
    rows = [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 4}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return [*rows, rows[5], (5, "another text of one id", "en", "s1", 3), (None, passage, None, None, None), (None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def labels(spark, rows=None):
    ids = sorted({r[0] for r in (corpus() if rows is None else rows) if r[0] is not None})
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in ids], "doc_id long, quality int, toxic int")
