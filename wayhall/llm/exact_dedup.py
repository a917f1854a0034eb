"""Exact dedup by deterministic block naming (operator 1).

A normalised text is cut into blocks of ``block_chars`` code points. The distinct blocks are sorted into integer names;
adjacent names are paired, the distinct pairs are sorted into names again, and so on until one name is left for each
text. Two texts get the same (rounds, name) exactly when they are equal: a name stands for one block or one pair, never
for two.

The texts are shuffled once, to find the distinct blocks; from there on only ids, integers and 128-bit keys move. Whether
two distinct blocks share a key is checked over all blocks; if it ever happens, naming starts again with other keys, so
the names are free of collisions, not just likely to be.

Everything is DataFrame operations. Aggregations combine before their shuffle and the joins put one row per name on one
side, so a group that holds a third of all rows is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayhall.llm.scratch import materialise

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c))
    return out


def _blocks(norm: Column, size: int) -> Column:
    found = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(found)


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys sorted across partitions, each with an integer name that rises in that order."""
    return materialise(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _keys(block: Column, seed: int) -> Column:
    """A 128-bit key of a block."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2"))


def _all_keys(blocks: Column, keys_of, seed: int) -> Column:  # noqa: ANN001
    return F.transform(blocks, lambda block: keys_of(block, seed))


def block_identities(docs: DataFrame, carry: list[Column], text_col: str = "text", block_chars: int = BLOCK_CHARS, keys_of=_keys) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (row_id, n_chars, text_sha256 and the carried columns c0, c1, ...), and row_id, rounds, name.

    Equal texts share both rounds and name, and no others do.
    """
    docs = docs.select(F.col(f"`{text_col}`").alias("__text"), *(c.alias(f"c{i}") for i, c in enumerate(carry)))
    norm = normalised(F.col("__text"))
    clash, seed = True, -1
    while clash:
        seed += 1
        rows = materialise(
            docs.select(
                F.monotonically_increasing_id().alias("row_id"),
                *(F.col(f"c{i}") for i in range(len(carry))),
                F.char_length(F.coalesce("__text", F.lit(""))).cast("long").alias("n_chars"),
                F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
                _all_keys(_blocks(norm, block_chars), keys_of, seed).alias("keys"),
            ),
            "rows",
        )
        blocks = docs.select(F.explode(_blocks(norm, block_chars)).alias("block"))
        distinct = blocks.groupBy(keys_of(F.col("block"), seed).alias("k"), "block").agg(F.count(F.lit(1)).alias("n"))
        keys = materialise(distinct.select("k.h1", "k.h2"), "keys")
        clash = not keys.groupBy("h1", "h2").count().where("count > 1").isEmpty()
    names = _named(keys, ["h1", "h2"])
    at = rows.select("row_id", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k")).select("row_id", "n", "pos", "k.*")
    left = materialise(at.join(names, ["h1", "h2"]).select("row_id", "n", "pos", "name"), "level")
    done = left.where("n = 1").select("row_id", F.lit(0).alias("rounds"), "name")
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    rounds = 0
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        pick = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(-1))
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = left.where("n > 1").groupBy("row_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), half.alias("pos")).agg(pick(0).alias("a"), pick(1).alias("b"))
        pairs = materialise(pairs, "pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        left = materialise(pairs.join(names, ["a", "b"]).select("row_id", "n", "pos", "name"), "level")
        done = done.unionByName(left.where("n = 1").select("row_id", F.lit(rounds).alias("rounds"), "name"))
    return rows.drop("keys"), done


def _winners(rows: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their identity, and for each identity its size and the row that stays."""
    ids = materialise(rows.join(done, "row_id"), "identities")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("c0").isNull().alias("none"), "c0", "row_id")
    # Written first: a join of two plain tables is one that Spark can split where a group is large.
    return ids, materialise(ids.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")), "best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, keys_of=_keys) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]. The row with the most code points stays, then the
    one with the smallest id (null ids last). Null text counts as empty, so null, empty and blank texts are one group.
    Rows repeated with one id are rows of their own: one of them stays. An empty table gives an empty result. Other
    columns are not read, whatever their names.
    """
    rows, done = block_identities(docs, [F.col(f"`{id_col}`")], text_col, block_chars, keys_of)
    ids, best = _winners(rows, done)
    return ids.join(best, ["rounds", "name"]).select(
        F.col("c0").alias("doc_id"), F.col("best.c0").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, by the rule of exact_dedup()."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows, done = block_identities(docs, [F.col(f"`{id_col}`"), whole], text_col)
    _, best = _winners(rows.drop("c1"), done)
    return rows.join(best.select("best.row_id"), "row_id", "left_semi").select("c1.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), s AS (
  SELECT doc_id, sha256(t) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM s
"""
