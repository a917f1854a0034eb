"""Mixing sources to target weights by Poisson replication (operator 7).

A source with target weight w and n of all N documents is repeated w * total / n times on average. A document's count is
the inverse of the Poisson distribution with that mean at a uniform number hashed from the seed and the document's id, so
it depends on nothing else: not on the partitioning, the order or the other documents of the source. Where exp(-rate)
would vanish the inversion starts below the mean, at a probability from logarithms, so rates have no limit. Documents are
exploded by their counts and shuffled globally by a hashed key. As the key is uniform, equal ranges of it are partitions of
about equal numbers of rows; nothing is sampled to find their bounds, so documents are read and hashed once.

Everything is DataFrame operations. Sources are counted with map-side combining. The table of sources joins by an
equality that Spark broadcasts only if it measures it as small, and otherwise splits where a source is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayhall.llm.scratch import materialise

BITS = 52
#: Rates up to this one are inverted from 0; exp(-rate) is still an ordinary double.
FROM_ZERO = 700
#: How many standard deviations from the mean a Poisson distribution ends in double precision.
SIGMAS = 12
#: The longest list that is exploded at once.
PIECE = 4096


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return (F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))


def poisson_inverse(rate: Column, u: Column, most: int | Column) -> Column:
    """The smallest k with P(X <= k) >= u for X of mean rate; most is where the distribution ends in double precision."""
    low = F.floor(rate - SIGMAS * F.sqrt(rate)).cast("double")
    # Stirling's series for log(low!), which is past 380! here.
    factorial = low * F.log(low) - low + F.log(2 * F.lit(math.pi) * low) / 2 + 1 / (12 * low) - 1 / (360 * low * low * low)
    least = F.when(rate <= FROM_ZERO, F.lit(0)).otherwise(low.cast("int"))
    p = F.when(rate <= FROM_ZERO, F.exp(-rate)).otherwise(F.exp(low * F.log(rate) - rate - factorial))
    first = F.struct(p.alias("p"), p.alias("sum"), least.alias("k"))
    step = lambda s, i: F.when(s["sum"] >= u, s).otherwise(F.struct((s["p"] * rate / i).alias("p"), (s["sum"] + s["p"] * rate / i).alias("sum"), i.cast("int").alias("k")))
    return F.aggregate(F.sequence(least + 1, F.lit(most) if isinstance(most, int) else most), first, step, lambda s: s["k"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source_col: str = "source", default_weight: float = 0.0) -> DataFrame:
    """src, n, rate: each source's documents and mean target repetition rate.

    weights None: all sources the same. A null source is a source of its own, named '~'. Sources without a weight get
    default_weight. Weights are normalised over the sources that have documents. total None: as many documents as come in.
    """
    counts = docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("~")).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "sources")
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "src string, w double")
        weighed = counts.join(table, "src", "left").withColumn("w", F.coalesce("w", F.lit(float(default_weight))))
    sums = weighed.agg(F.sum("w"), F.sum("n")).first()
    all_w, size = sums[0] or 1.0, float(sums[1] or 0) if total is None else float(total)
    return weighed.select("src", "n", (F.col("w") / F.lit(all_w) * F.lit(size) / F.col("n")).alias("rate"))


def _globally(copies: DataFrame) -> DataFrame:
    """copies in the order of shuffle_key, an md5: partitions are equal ranges of its first 32 bits."""
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    return copies.repartitionById(n, F.shiftright(share * F.lit(n), 32).cast("int")).sortWithinPartitions("shuffle_key")


def _mixed(docs: DataFrame, weights: dict[str, float] | None, total: int | None, seed: int, id_col: str, source_col: str, default_weight: float) -> DataFrame:
    """row (all columns of docs), copy, rate, shuffle_key, in the order of shuffle_key."""
    rates = materialise(source_rates(docs, weights, total, source_col, default_weight), "rates")
    most = F.floor(F.col("rate") + SIGMAS * F.sqrt("rate") + 40).cast("int")
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("~"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), source.alias("src"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")).alias("id"))
    counted = rows.join(rates.select("src", "rate"), "src").withColumn("k", poisson_inverse(F.col("rate"), uniform(seed, F.col("id")), most)).where("k > 0")
    pieces = counted.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("k") - 1, F.lit(PIECE))))
    copies = pieces.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + PIECE, "k") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}k"), "id", F.col("copy").cast("string")))
    return _globally(copies.select("row", "copy", "rate", key.alias("shuffle_key")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", default_weight: float = 0.0) -> DataFrame:
    """docs with each row repeated by its count, plus copy (0, 1, ...), rate and shuffle_key; ordered by shuffle_key.

    Rows repeated in the input with one id get one count each, the same for all. A null id is hashed as '~'. Texts aren't
    read. Rates of 0 drop the source; an empty table gives an empty result. Columns named like the added ones are
    replaced.
    """
    mixed = _mixed(docs, weights, total, seed, id_col, source_col, default_weight)
    added = ("copy", "rate", "shuffle_key")
    return mixed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added), *added)


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", default_weight: float = 0.0) -> DataFrame:
    """As mix_sources(), with the columns of docs alone."""
    return _mixed(docs, weights, total, seed, id_col, source_col, default_weight).select("row.*")


def oracle(seed: int = 7) -> str:
    """The same counts in DuckDB for equal weights and rates up to FROM_ZERO."""
    return f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '~') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, CAST(1 AS DOUBLE) / CAST((SELECT count(*) FROM c) AS DOUBLE) * CAST((SELECT sum(n) FROM c) AS DOUBLE) / CAST(n AS DOUBLE) AS rate FROM c),
cdf AS (
  SELECT src, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS s FROM r
  UNION ALL SELECT src, rate, k + 1, p * rate / (k + 1), s + p * rate / (k + 1) FROM cdf WHERE k < floor(rate + {SIGMAS} * sqrt(rate) + 40)
),
d AS (
  SELECT *, coalesce(source, '~') AS src,
    (CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents
),
n AS (SELECT d.doc_id, d.source, d.text, r.rate, (SELECT count(*) FROM cdf WHERE cdf.src = d.src AND cdf.s < d.u) AS k FROM d JOIN r ON d.src = r.src)
SELECT doc_id, source, copy, round(rate, 6) AS rate, md5('{seed}k:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key,
  length(text) AS n_code_points
FROM (SELECT *, unnest(range(0, k)) AS copy FROM n WHERE k > 0)
"""
