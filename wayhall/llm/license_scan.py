"""License scans by diagonal voting (operator 9).

The rolling word hashes of all texts, of PHRASE_K and of K words, are joined by Spark to the positions of the same hashes
in phrases and license templates. A hit at word p of a text and word q of a template votes for the diagonal p - q, which
is where the template would start. Votes are summed by diagonal. A phrase must be there whole on one diagonal. For
templates each diagonal is merged with those just above it (words put in or left out shift them), by at most ``drift`` of
the template's words in all, and the merged votes are verified: runs of words that are the same in text and template are
chained, both sides rising and no word used twice; the chain's words must be at least ``coverage`` both of the template
and of the span they lie in. Of verified spans that overlap, only the best keeps its label, so that a wording that holds
another with one word more isn't taken for both.

The templates are constants of this module, so the joined side has a fixed size and is broadcast. What moves afterwards
is only hits. Hits are equal by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayhall.llm.textkit import Hasher, alnum, chunks, gram_mask, grams, signed

#: Phrases that are counted wherever their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of public licenses and notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions "
        "and limitations under the license",
    ),
    ("gpl", "this work is licensed under the gnu general public license version"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
PHRASE_K, K = 2, 3
SEED = 21
SPAN = "row_id long, doc_id {kind}, t int, label string, n_words long, place long, share double, start long, stop long, matched int, likeness double"


def _hasher() -> Hasher:
    return Hasher(True, SEED)


def template_rows(entries: list[tuple[str, str]], k: int, first: int) -> list[tuple[int, int, int, int, str]]:
    """h, t, tpos, words, label of each k-word hash of each entry (label, text); entries are numbered from ``first``."""
    rows = []
    for t, (label, text) in enumerate(entries, first):
        for c in chunks(pa.array([text]), alnum()):
            n = int(c.counts[0])
            if n < k:
                raise ValueError(f"a template needs {k} words: {text!r}")
            h = signed(grams(_hasher().spans(c.data, c.starts, c.ends), k, SEED))
            rows += [(int(x), t, i, n, label) for i, x in enumerate(h)]
    return rows


def _places(spark: SparkSession, rows: list[tuple], h: str, name: str) -> DataFrame:
    """One row for each hash, with all places it has: t, tpos, words, label."""
    held = defaultdict(list)
    for key, *place in rows:
        held[key].append(tuple(place))
    return spark.createDataFrame(list(held.items()), f"{h} long, {name} array<struct<t: int, tpos: int, words: int, label: string>>")


def rolling_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, doc_id, pos, short, long: the hashes of PHRASE_K and K words from each word on, null past the end.

    Each document also has a row of pos -1, whose hashes are null and whose n_words is its number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = _hasher(), alnum()
        for batch in batches:
            for c in chunks(batch.column(2), table):
                words = hasher.spans(c.data, c.starts, c.ends)
                at = np.flatnonzero(gram_mask(c.counts, PHRASE_K))
                own = c.owner[at]
                owner = np.concatenate([own, np.arange(c.docs)])
                pos = np.concatenate([at - c.offsets[own], np.full(c.docs, -1)])
                none = np.zeros(c.docs, np.int64)
                longer = np.zeros(len(at), np.int64)
                whole = np.flatnonzero(gram_mask(c.counts, K))
                has = np.isin(at, whole, assume_unique=True)
                longer[has] = signed(grams(words, K, SEED)[whole])
                short = pa.array(np.concatenate([signed(grams(words, PHRASE_K, SEED)[at]), none]), mask=pos < 0)
                long_ = pa.array(np.concatenate([longer, none]), mask=np.concatenate([~has, none == 0]))
                count = pa.array(np.concatenate([np.zeros(len(at), np.int64), c.counts]), mask=pos >= 0)
                take = pa.array(owner + c.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), short, long_, count], ["row_id", "doc_id", "pos", "short", "long", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"row_id long, doc_id {kind}, pos int, short long, long long, n_words long")


def chain(votes: list[tuple[int, list[int]]], k: int) -> tuple[int, int, int]:
    """matched words, first and past-the-last word of the text, of the longest chain under votes (diagonal, template positions).

    Votes side by side on a diagonal are a run of equal words. A chain takes runs with both sides rising; what a run shares
    with the one before, on either side, is cut off. Of equal chains the one of the shortest span stays, then the first.
    """
    runs = []
    for diagonal, found in votes:
        for q in sorted(found):
            if runs and runs[-1][2] == diagonal and q <= runs[-1][1]:
                runs[-1][1] = q + k
            else:
                runs.append([q, q + k, diagonal])
    runs.sort()
    best: list[tuple[int, int]] = []  # matched words, minus the chain's first word in the text
    for j, (low, high, diagonal) in enumerate(runs):
        top = (high - low, low + diagonal)
        for i in range(j):
            _, end, other = runs[i]
            gain = high - max(low, end, end + other - diagonal)
            if gain > 0:
                top = max(top, (best[i][0] + gain, best[i][1]))
        best.append(top)
    matched, length, start = max((m, first - (high + diagonal), -first) for (m, first), (_, high, diagonal) in zip(best, runs, strict=True))
    return matched, -start, -start - length


def _verified(votes: DataFrame, kind: str, coverage: float) -> DataFrame:
    """votes with start, stop, matched and likeness where their cluster holds a verified span, null elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, stop, matched, likeness = ([None] * batch.num_rows for _ in range(4))
            clusters, sizes = batch.column("cluster"), batch.column("words")
            for i in np.flatnonzero(clusters.is_valid().to_numpy(zero_copy_only=False)).tolist():
                m, a, b = chain([(v["diagonal"], v["found"]) for v in clusters[i].as_py()], K)
                like = m / max(sizes[i].as_py(), b - a)
                if like >= coverage:
                    start[i], stop[i], matched[i], likeness[i] = a, b, m, like
            kept = [batch.column(c) for c in ("row_id", "doc_id", "t", "label", "n_words", "place", "share")]
            more = [pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(matched, pa.int32()), pa.array(likeness, pa.float64())]
            yield pa.RecordBatch.from_arrays(kept + more, [c.split()[0] for c in SPAN.split(", ")])

    return votes.mapInArrow(run, SPAN.format(kind=kind))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, coverage: float = 0.8, drift: float = 0.125) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row for each row of docs.

    n_base counts all places of phrases; first_word and last_word are their smallest and largest start, null without any.
    spans are those of templates that hold: start, stop (past the last word), label, likeness (matched words by the
    larger of template and span). Ties between overlapping spans go to more matched words, then the earlier start, then
    the template listed first. labels are those of phrases and spans. score is 1 with a phrase, else the best likeness, or
    the largest share of a template's hashes on one diagonal. Null and empty texts have no words and score 0. Repeated
    rows, and rows with null ids, get results of their own. An empty table gives an empty result. Other columns aren't read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    short = template_rows([(label, text) for text, label in phrases.items()], PHRASE_K, 0)
    long_ = template_rows(templates, K, len(phrases))
    most = max((r[3] for r in long_), default=0)
    hashes = rolling_hashes(docs, id_col, text_col)
    found = hashes.join(F.broadcast(_places(spark, short, "short", "a")), "short", "left").join(F.broadcast(_places(spark, long_, "long", "b")), "long", "left")
    places = F.concat(*(F.coalesce(F.col(x), F.array().cast("array<struct<t: int, tpos: int, words: int, label: string>>")) for x in "ab"))
    hits = found.where("pos = -1 OR a IS NOT NULL OR b IS NOT NULL").select("row_id", "doc_id", "pos", "n_words", F.explode_outer(places).alias("at"))
    hits = hits.select("row_id", "doc_id", "n_words", "at.*", (F.col("pos") - F.col("at.tpos")).alias("diagonal")).repartition("row_id")
    votes = hits.groupBy("row_id", "doc_id", "t", "label", "words", "diagonal").agg(F.collect_set("tpos").alias("found"), F.max("n_words").alias("n_words"))

    phrase = F.col("t") < len(phrases)
    share = F.size("found") / (F.col("words") - F.when(phrase, PHRASE_K).otherwise(K) + 1)
    votes = votes.withColumn("share", F.when(F.col("t").isNotNull(), share))
    reach = F.greatest(F.lit(1), F.floor(F.col("words") * drift)).cast("int")
    above = Window.partitionBy("row_id", "t").orderBy("diagonal").rangeBetween(0, max(1, int(most * drift)))
    near = F.filter(F.collect_list(F.struct("diagonal", "found")).over(above), lambda v: v["diagonal"] <= F.col("diagonal") + reach)
    votes = votes.withColumn("near", F.when(~phrase, near))
    # A vote stands for at most K words, so what is left out here can't reach the coverage.
    enough = F.aggregate("near", F.lit(0), lambda n, v: n + F.size(v["found"])) * K >= coverage * F.col("words")
    votes = votes.withColumns({"cluster": F.when(enough, F.col("near")), "place": F.when(phrase & (F.col("share") == 1), F.col("diagonal").cast("long"))})
    spans = _verified(votes.select("row_id", "doc_id", "t", "label", "n_words", "place", "share", "words", "cluster"), kind, coverage)

    # A span is at most most / coverage words long, so all that overlap one lie within that many words of its start.
    length = int(most / coverage) + 1
    rank = F.struct("likeness", "matched", (-F.col("start")).alias("early"), (-F.col("t")).alias("listed"))
    beside = F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop", rank.alias("rank")))).over(Window.partitionBy("row_id").orderBy("start").rangeBetween(-length, length))
    beaten = F.exists(beside, lambda o: (o["start"] < F.col("stop")) & (F.col("start") < o["stop"]) & (o["rank"] > rank))
    spans = spans.withColumn("stands", F.col("start").isNotNull() & ~beaten)
    join = lambda *which: F.array_join(F.array_sort(F.collect_set(F.when(*which))), ",")
    return spans.groupBy("row_id", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count("place").alias("n_base"),
        F.min("place").alias("first_word"),
        F.max("place").alias("last_word"),
        join(F.col("place").isNotNull(), F.col("label")).alias("base_labels"),
        join(F.col("place").isNotNull() | F.col("stands"), F.col("label")).alias("labels"),
        F.coalesce(F.max(F.greatest("share", "likeness")), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("stands"), F.struct("start", "stop", "label", "likeness")))).alias("spans"),
    ).drop("row_id")
