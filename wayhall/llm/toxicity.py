"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 3).

Texts are folded first: lower case, homoglyphs to Latin letters, accents off, digits and signs that stand for letters to
those letters. Lexicon entries are words and word beginnings of labelled training texts, weighted by the log odds of a
toxic against another document. An entry counts where it starts a word; of entries that start at one place the longest
counts; a hit inside an exception phrase doesn't. Weights are summed and normalised by the text's length, and a logistic
fitted on the same training rows turns that into a score between 0 and 1.

Training uses at most ``max_rows`` labelled rows, equal texts once. The lexicon is bounded by ``max_entries``. Scoring is one pass over
each text and moves nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayhall.llm.samples import fold, labelled_sample
from wayhall.llm.scratch import materialise

#: Look-alike letters, and digits or signs written for letters.
LOOKALIKES = dict(zip("абвгезийкмнопрстуухіјѕԁαβεικνορτυχ", "a6brezuukmhonpctyyxijsdabeikvoptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}

MAX_ROWS = 20_000
MAX_ENTRIES = 4_000
PREFIXES = range(4, 9)
#: An entry's log likelihood ratio must exceed this: about what the best of a million chance words reaches.
SURPRISE = 15.0
WORD = re.compile(r"[^\W_]+")


def _folding() -> dict[int, str]:
    table = {ord(k): v for k, v in (LOOKALIKES | SUBSTITUTES).items()}
    for c in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(c))[0]
        if plain.isascii() and plain.isalpha():
            table[c] = plain.lower()
    for c in range(0xFF01, 0xFF5F):
        table[c] = unicodedata.normalize("NFKC", chr(c)).lower()
    return table | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)} | {c: None for c in range(0x300, 0x370)}


FOLDING = _folding()


def folded(text: str) -> str:
    return text.lower().translate(FOLDING)


def candidates(text: str) -> set[str]:
    """Words and word beginnings of a folded text. Beginnings are marked with a star."""
    out = set()
    for w in set(WORD.findall(text)):
        if len(w) >= 3:
            out.add(w)
        out.update(w[:n] + "*" for n in PREFIXES if n < len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    logistic: tuple[float, ...] = (-6.0, 2.0, 0.5, 0.0)

    def machine(self):  # noqa: ANN201
        """Automaton over the entries; None for an empty lexicon, which Aho-Corasick can't hold."""
        import ahocorasick

        auto, kinds = ahocorasick.Automaton(), {}
        for entry, w in self.weights.items():
            kinds.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), w))
        for key, both in kinds.items():
            auto.add_word(key, (len(key), sorted(both)))  # the whole word before the beginning
        if not self.weights:
            return None
        auto.make_automaton()
        return auto


def word_before(text: str, at: int) -> str:
    """The last word that ends before at, whole; empty without one."""
    stop = at
    while stop and not WORD.match(text, stop - 1):
        stop -= 1
    begin = stop
    while begin and WORD.match(text, begin - 1):
        begin -= 1
    return text[begin:stop]


def hits(text: str, auto, exceptions: set[str], phrases: Counter | None = None) -> tuple[float, int]:  # noqa: ANN001
    """Weight and number of hits in a folded text; phrases gets the two-word phrases around hits."""
    best: dict[int, tuple[int, float]] = {}
    for end, (size, both) in auto.iter(text) if auto else ():
        start = end - size + 1
        if start and text[start - 1].isalnum():
            continue
        inside = end + 1 < len(text) and text[end + 1].isalnum()
        w = next((w for open_, w in both if open_ or not inside), None)
        if w is None:
            continue
        if start not in best or best[start][0] < size:
            best[start] = (size, w)
    total, n = 0.0, 0
    for start, (_, w) in best.items():
        if exceptions or phrases is not None:
            at = WORD.match(text, start)
            word, stop = at[0], at.end()
            before, after = word_before(text, start), WORD.search(text, stop)
            around = ([f"{before} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else [])
            if phrases is not None:
                phrases.update(set(around))
            if any(p in exceptions for p in around):
                continue
        total, n = total + w, n + 1
    return total, n


def features(text: str, auto, exceptions: set[str]) -> tuple[float, float, float]:  # noqa: ANN001
    total, n = hits(text, auto, exceptions)
    length = 1 + len(text) / 6
    return math.log1p(total), math.log1p(100 * total / length), math.log1p(n)


def _map(df: DataFrame, row, schema: str, lexicon=None) -> DataFrame:  # noqa: ANN001
    """Rows made by row(text, label, auto, exceptions) from text and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, exceptions = (lexicon.value.machine(), lexicon.value.exceptions) if lexicon else (None, set())
        for batch in batches:
            out = row(((folded(t.as_py() or ""), y.as_py()) for t, y in zip(batch.column(0), batch.column(1), strict=True)), auto, exceptions)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    kinds = [(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")]
    return df.mapInArrow(run, schema)


def fit_lexicon(docs: DataFrame, labels: DataFrame, label: Column, where: Column | None = None, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit on at most max_rows labelled rows. With no toxic or no other rows the lexicon is empty and every score is the base rate."""
    sample = materialise(labelled_sample(docs, labels, label, max_rows, where).dropDuplicates(["text", "label"]), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not bad or not good:
        base = (bad + 0.1) / (bad + good + 1)
        return Lexicon({}, set(exceptions), (math.log(base / (1 - base)), 0.0, 0.0, 0.0))

    def count(rows, auto, exceptions):  # noqa: ANN001, ANN202
        t, o = Counter(), Counter()
        for text, y in rows:
            (t if y else o).update(candidates(text))
        return [{"entry": k, "bad": t[k], "good": o[k]} for k in t.keys() | o.keys()]

    counted = _map(sample, count, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    rate, n = bad / (bad + good), F.col("bad") + F.col("good")
    other = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / (1 - rate))).otherwise(0.0)
    surprise = F.col("bad") * F.log(F.col("bad") / n / rate) + other
    rows = counted.where("bad >= 3").withColumn("w", odds).where((F.col("w") >= 2) & (surprise >= SURPRISE)).orderBy(F.desc(F.col("w") * F.col("bad")), "entry").limit(max_entries).collect()
    sc = docs.sparkSession.sparkContext
    lexicon = Lexicon({r["entry"]: float(r["w"]) for r in rows}, set(exceptions))
    sent = sc.broadcast(lexicon)

    def around(rows, auto, exceptions):  # noqa: ANN001, ANN202
        t, o = Counter(), Counter()
        for text, y in rows:
            hits(text, auto, set(), t if y else o)
        return [{"entry": k, "bad": t[k], "good": o[k]} for k in t.keys() | o.keys()]

    phrases = _map(sample, around, "entry string, bad long, good long", sent).groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    benign = phrases.where(F.col("good") > 3 + 20 * F.col("bad")).orderBy(F.desc("good"), "entry").limit(max_entries).collect()
    lexicon.exceptions |= {r["entry"] for r in benign}
    sent = sc.broadcast(lexicon)

    def measure(rows, auto, exceptions):  # noqa: ANN001, ANN202
        return [dict(zip(("y", "a", "b", "c"), (y, *features(text, auto, exceptions)), strict=True)) for text, y in rows]

    table = _map(sample, measure, "y double, a double, b double, c double", sent).toPandas().to_numpy()
    lexicon.logistic = tuple(_logistic(table[:, 1:], table[:, 0]))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs.

    Null counts as empty; empty texts get the score of a text without hits. Repeated rows get equal scores. An empty table
    gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        auto, w = lex.machine(), np.array(lex.logistic)
        for batch in batches:
            x = np.array([features(folded(t.as_py() or ""), auto, lex.exceptions) for t in batch.column(1)]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; the lexicon is learnt from rows outside the held-out fold."""
    lexicon = fit_lexicon(docs, labels, F.col("toxic"), fold("doc_id", folds) != held_out)
    scored = score_toxicity(docs, lexicon, threshold)
    return scored.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
