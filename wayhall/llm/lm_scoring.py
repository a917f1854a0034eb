"""LM scoring with a probabilistic suffix tree (operator 2).

Tokens are words, lower-cased, and one end for each text. All training tokens are counted, and give the base
distribution (c + 1) / (N + V + 1), in which every unknown word gets 1 / (N + V + 1). The suffix tree predicts over the
same alphabet: all tokens of the training rows, and the unknown ones.

A context is the last 1 to ``depth`` tokens of a text. Contexts and their continuations are runs of tokens that were seen
MIN_COUNT times; rarer continuations share what is left to the context's longest proper suffix. A context is retained if
its next-token distribution diverges from that of the suffix: its count times the Kullback-Leibler divergence, rarer
continuations taken together, must reach DIVERGENCE. Neither threshold depends on the corpus's size. The suffix's
distribution gets the rarer continuations' weight and PRIOR pseudo-counts. A token is scored from the longest retained
context that the text before it ends with.

The factor that a context adds to the probability of its suffix is the context's own for all tokens, times one that
belongs to the run of tokens that context and token make. So the tree is a table of runs with a logarithm each, a text's
score is the sum over its runs, and runs are joined to the table by Spark. Two things of bounded size are sent to the
executors to move less: the most frequent runs (one for each of HOT slots), which are looked up on the spot, and bitmaps of
hashes that rule out most runs that aren't in the tree. They change what moves, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.llm.samples import fold
from wayhall.llm.scratch import discard, materialise, modest_batches
from wayhall.llm.textkit import U, Chunk, Hasher, chunks, mix, not_white, signed

#: How many tokens Tree.log10() numbers.
SYMBOLS = 4096
#: How many tokens contexts have at most, in a corpus of any size.
DEPTH = 2
MIN_COUNT = 4
PRIOR = 20.0
DIVERGENCE = 12.0
SEED = 61
BLOCK, PIECE = 1 << 21, 1 << 18
#: Slots of frequent runs for each length, bits of a bitmap for each hash, and the most bits it has.
HOT, BITS_EACH, MOST_BITS = 1 << 18, 16, 1 << 27
#: The hash of the end token; words' hashes may only meet it by chance, like each other.
END = mix(np.array([SEED], U))[0]
FACTOR = U(int(mix(np.array([SEED + 1], U))[0]) | 1)


def token_hashes(chunk: Chunk, hasher: Hasher) -> np.ndarray:
    """Hashes of all tokens of a chunk, an end after each document's words."""
    at = np.cumsum(chunk.counts)
    return np.insert(hasher.spans(chunk.data, chunk.starts, chunk.ends), at, END)


def _stream(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Chunk, np.ndarray]]:
    hasher, table = Hasher(True, SEED), not_white()
    for batch in batches:
        for c in chunks(batch.column(column), table):
            yield batch, c, token_hashes(c, hasher)


def count_tokens(texts: DataFrame) -> DataFrame:
    """h, c: each token of texts and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["h", "c"])

        for _, _, h in _stream(batches, 0):
            held.append(h)
            size += len(h)
            if size > 1 << 22:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def longer(runs: np.ndarray) -> np.ndarray:
    """Hashes of the runs that end at each token and are one token longer than those given; the first has none."""
    out = np.zeros(len(runs), U)
    out[1:] = joined(runs[:-1], runs[1:])
    return out


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a run from those of all but its last token and all but its first."""
    return mix(context * FACTOR + suffix)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """32-bit words of a bitmap that has the lowest bits of each h set; its size is bounded by MOST_BITS."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * hashes.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(slot, 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1, cast(h & 31 AS int))")).alias("b")).toArrow()
    out = np.zeros(bits // 32, np.int32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint32)


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & U(len(words) * 32 - 1)
    return (words[slot >> U(5)] >> (slot & U(31)).astype(np.uint32)) & np.uint32(1) == 1


def count_runs(texts: DataFrame, size: int, seen: Broadcast) -> DataFrame:
    """h, context, suffix, c: the runs of size tokens seen MIN_COUNT times, and the hashes of what is before the last and after the first.

    seen: a bitmap of the runs one token shorter that were.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, words = [], 0, seen.value

        def out() -> pa.RecordBatch:
            context, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, n = np.unique(joined(context, suffix), return_index=True, return_counts=True)
            at, n = (x[np.argsort(context[at])] for x in (at, n))
            return pa.RecordBatch.from_arrays([pa.array(signed(context[at])), pa.array(signed(suffix[at])), pa.array(n)], ["context", "suffix", "c"])

        for _, c, last in _stream(batches, 0):
            for _ in range(size - 2):
                last = longer(last)
            known = in_bitmap(words, last)
            known[1:] &= known[:-1]
            at = np.flatnonzero(known & (places(c) >= size - 1))
            held.append((last[at - 1], last[at]))
            many += len(at)
            if many > BLOCK:
                yield out()
                held, many = [], 0
        if many:
            yield out()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, suffix = (batch.column(i).to_numpy().view(U) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(signed(joined(context, suffix))), *batch.columns], ["h", "context", "suffix", "c"])

    found = texts.select("text").mapInArrow(run, "context long, suffix long, c long")
    found = found.groupBy("context", "suffix").agg(F.sum("c").alias("c")).where(F.col("c") >= MIN_COUNT)
    return found.mapInArrow(name, "h long, context long, suffix long, c long")


@dataclass
class Tree:
    """The tokens (h, c), and for each length of contexts the retained ones (context, unseen) and the runs (h, c, p, own) one longer.

    p is a run's last token's probability after the others. own is null on runs whose context isn't retained.
    """

    n: int
    v: int
    counts: DataFrame
    contexts: list[DataFrame] = field(default_factory=list)
    runs: list[DataFrame] = field(default_factory=list)

    def values(self) -> list[DataFrame]:
        """For each length of runs h, c, base, more: what a run adds to the log10 of the base score (less log10(n + v + 1)), and beyond that to the tree's."""
        out = []
        for size in range(len(self.runs) + 1):
            own = self.counts.select("h", "c", F.log10(F.col("c") + 1.0).alias("base"), F.lit(0.0).alias("own")) if size == 0 else self.runs[size - 1].select("h", "c", F.lit(None).cast("double").alias("base"), "own")
            if size < len(self.contexts):
                own = own.join(self.contexts[size].withColumnRenamed("context", "h"), "h", "left")
            else:
                own = own.withColumn("unseen", F.lit(None).cast("double"))
            out.append(own.where("base IS NOT NULL OR own IS NOT NULL OR unseen IS NOT NULL").select("h", "c", "base", (F.coalesce("own", F.lit(0.0)) + F.coalesce("unseen", F.lit(0.0))).alias("more")))
        return out

    @cached_property
    def levels(self) -> list[dict[str, np.ndarray]]:
        """A small tree in the driver: hashes of contexts and of runs with what they add."""
        out = []
        for contexts, runs in zip(self.contexts, self.runs, strict=True):
            c = contexts.orderBy("context").select("context", "unseen").toArrow()
            r = runs.where("own IS NOT NULL").select("h", "own").orderBy("h").toArrow()
            out.append({"context": c.column(0).to_numpy(), "unseen": c.column(1).to_numpy(), "run": r.column(0).to_numpy(), "own": r.column(1).to_numpy()})
        return out

    @cached_property
    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and base probability of each symbol: 0 the unknown, then the most frequent tokens."""
        top = self.counts.orderBy(F.desc("c"), "h").limit(SYMBOLS - 1).toArrow()
        own, p = np.arange(SYMBOLS).astype(U), np.zeros(SYMBOLS)
        own[1 : len(top) + 1] = top.column("h").to_numpy().view(U)
        p[: len(top) + 1] = np.concatenate([[1], top.column("c").to_numpy() + 1]) / (self.n + self.v + 1)
        return own, p

    def log10(self, symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """log10 P(symbol | longest retained context) in a small tree; inside: how many tokens of its text stand before each."""
        names, base = self.symbols
        h = names[symbols]
        out, run = np.log10(base[symbols]), h
        for d, level in enumerate(self.levels, 1):
            before, run = np.roll(run, 1), longer(run)
            for keys, adds, x in ((level["context"], level["unseen"], before), (level["run"], level["own"], run)):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, signed(x)), len(keys) - 1)
                    out += np.where((keys[at] == signed(x)) & (inside >= d), adds[at], 0)
        return out


def places(chunk: Chunk) -> np.ndarray:
    """How many tokens of its own text stand before each token."""
    sizes = chunk.counts + 1
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def fit_tree(texts: DataFrame, counts: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of training texts, whose token counts (h, c) are given."""
    sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tree = Tree(int(sums[0] or 0), int(sums[1]), counts)
    shorter = counts.select("h", "c", ((F.col("c") + 1) / F.lit(float(tree.n + tree.v + 1))).alias("q"))
    sc = texts.sparkSession.sparkContext
    for d in range(1, depth + 1):
        words = sc.broadcast(bitmap(shorter.where(F.col("c") >= MIN_COUNT)))
        seen = materialise(count_runs(texts, d + 1, words).join(shorter.select(F.col("h").alias("suffix"), "q"), "suffix").drop("suffix"), "runs", release=True)
        sums = seen.groupBy("context").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.log(F.col("c") / F.col("q"))).alias("s"), F.sum("q").alias("mass"))
        sums = sums.join(shorter.select(F.col("h").alias("context"), F.col("c").alias("all")), "context").withColumn("rare", F.col("all") - F.col("total"))
        rest = F.when(F.col("rare") > 0, F.col("rare") * F.log(F.col("rare") / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
        kept = sums.where(F.col("s") + rest - F.col("all") * F.log("all") >= DIVERGENCE)
        kept = materialise(kept.select("context", "all", (F.col("rare") + F.lit(PRIOR)).alias("left")), "contexts")
        size = F.col("all") + F.lit(PRIOR)
        p = (F.col("c") + F.col("left") * F.col("q")) / size
        told = seen.join(kept, "context", "left").select("h", "c", F.coalesce(p, "q").alias("p"), (F.log10(p / F.col("q")) - F.log10(F.col("left") / size)).alias("own"))
        told = materialise(told, "told", release=True)
        discard(seen)
        tree.contexts.append(kept.select("context", F.log10(F.col("left") / size).alias("unseen")))
        tree.runs.append(told)
        shorter = told.select("h", "c", F.col("p").alias("q"))
    return tree


def hot_runs(values: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, base, more, and whether there is one, of the most frequent run in each of HOT slots."""
    slot = F.col("h").bitwiseAND(F.lit(HOT - 1)).cast("int")
    top = values.groupBy(slot.alias("slot")).agg(F.max(F.struct("c", "h", "base", "more")).alias("top")).select("slot", "top.h", "top.base", "top.more").toArrow()
    keys, base, more, used = np.zeros(HOT, U), np.zeros(HOT), np.zeros(HOT), np.zeros(HOT, bool)
    at = top.column(0).to_numpy()
    keys[at], base[at], more[at], used[at] = top.column(1).to_numpy().view(U), top.column(2).fill_null(0).to_numpy(), top.column(3).to_numpy(), True
    return keys, base, more, used


def text_runs(docs: DataFrame, hot: Broadcast, seen: Broadcast) -> DataFrame:
    """block, h, at, doc_id, n_tokens, known, base, more.

    One row (n_tokens isn't null) for each text, with the sums over its hot runs; and the other runs that bitmaps don't rule
    out, each once in a block of texts, with the texts (at) they are in.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "h", "at", "doc_id", "n_tokens", "known", "base", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, block, part = [], 0, 0, TaskContext.get().partitionId()
        tables, bitmaps = hot.value, seen.value

        def rows(h: np.ndarray, cuts: np.ndarray, at: np.ndarray, ids: pa.Array, sums: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(h), PIECE):
                b = min(len(h), a + PIECE)
                lists = pa.ListArray.from_arrays(pa.array(cuts[a : b + 1] - cuts[a], pa.int32()), pa.array(at[cuts[a] : cuts[b]], pa.int32()))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                more = [pa.nulls(b - a, t) if sums is None else pa.array(x[a:b], t) for x, t in zip(sums or kinds, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part << 32 | block)), pa.array(signed(h[a:b])), lists, ids.slice(a, b - a), *more], names)

        def out() -> Iterator[pa.RecordBatch]:
            h, inside = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            ids = pa.concat_arrays([x[0] for x in held])
            n = np.concatenate([x[3] for x in held])
            owner, each = np.repeat(np.arange(len(n)), n), np.arange(len(n) + 1)
            total, last = [np.zeros(len(n)) for _ in range(3)], h
            for size, (keys, base, more, used) in enumerate(tables, 1):
                last = h if size == 1 else longer(last)
                at = np.flatnonzero(inside >= size - 1)
                own = last[at]
                slot = own & U(HOT - 1)
                found = used[slot] & (keys[slot] == own)
                who, slot = owner[at[found]], slot[found]
                if size == 1:
                    total[0] += np.bincount(who, minlength=len(n))
                    total[1] += np.bincount(who, base[slot], len(n))
                total[2] += np.bincount(who, more[slot], len(n))
                at, own = at[~found], own[~found]
                near = in_bitmap(bitmaps[size - 1], own)
                at, own = at[near], own[near]
                order = np.argsort(own)
                at, own = at[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                yield from rows(own[first], np.append(first, len(own)), owner[at], pa.nulls(len(first), ids.type), None)
            # The texts' own rows meet nothing; their hashes only deal them out.
            yield from rows(mix(each[:-1].astype(U) + U(part << 32 | block)), each, each[:-1], ids, [n, total[0].astype(np.int64), total[1], total[2]])

        for batch, c, h in _stream(batches, 1):
            held.append((batch.column(0).slice(c.first, c.docs), h, places(c), c.counts + 1))
            tokens += len(h)
            if tokens > BLOCK:
                yield from out()
                held, tokens, block = [], 0, block + 1
        if held:
            yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, h long, at array<int>, doc_id {kind}, n_tokens long, known long, base double, more double")


def score_texts(docs: DataFrame, tree: Tree, folds: int, held_out: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    levels = [materialise(x, "values") for x in tree.values()]
    hot, seen = sc.broadcast([hot_runs(x) for x in levels]), sc.broadcast([bitmap(x) for x in levels])
    table = levels[0].select("h", "base", "more")
    for x in levels[1:]:
        table = table.unionByName(x.select("h", "base", "more"))
    table = table.select("h", F.col("base").alias("own_base"), F.col("more").alias("own_more"))
    head, met = F.col("n_tokens").isNotNull(), F.col("own_more").isNotNull()
    both = text_runs(docs, hot, seen).join(table, "h", "left").where(head | met)
    each = both.select(
        "block", F.explode("at").alias("at"), "doc_id", "n_tokens",
        F.when(head, F.col("known")).otherwise(F.col("own_base").isNotNull().cast("long")).alias("known"),
        F.when(head, F.col("base")).otherwise(F.coalesce("own_base", F.lit(0.0))).alias("base"),
        F.when(head, F.col("more")).otherwise(F.col("own_more")).alias("more"),
    )
    sums = each.groupBy("block", "at").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_tokens")), *(F.sum(c).alias(c) for c in ("known", "base", "more")))
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tree.n + tree.v + 1)))
    return materialise(sums.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("more")).alias("score"),
    ), "scored", release=True)


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Scores are log10 probabilities. Training uses the rows whose crc32 of the id as text, modulo folds, isn't held_out;
    null ids are trained on. Null and empty texts are the end token alone. Repeated rows count as often as they are there
    and get equal scores. With nothing to train on every token is unknown. An empty table gives an empty result. Other
    columns are not read. depth: how many tokens contexts have at most.
    """
    modest_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    train = own.where(F.coalesce(fold("doc_id", folds) != held_out, F.lit(True)))
    counts = materialise(count_tokens(train), "counts", release=True)
    return score_texts(own, fit_tree(train, counts, depth), folds, held_out)
