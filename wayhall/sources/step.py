"""Reading STEP physical files (ISO 10303-21) as a table of instances, files of any size in pieces.

Spark's text source cuts a file at every semicolon, each byte range by itself. A semicolon ends a statement only outside
strings and comments. So each piece is a function of the state it starts in (plain, in a string, in a comment); almost all
leave the state as it is. The functions of a range's other pieces compose to one, those of a file's ranges to the state that
each range starts in. Ranges that start plain and hold no such piece are statements as they are; the rest goes through
windows over single ranges. No step gathers a file in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayhall.plans.checkpoint import cut

#: States: plain, in a string, in a comment. A function is the three states it leads to.
SAME = "012"
#: Strings and comments, to be matched from the left, and the same with the string as a group.
WHOLE, WHOLE_STRING = r"(?s)'[^']*'|/\*.*?\*/", r"(?s)('[^']*')|/\*.*?\*/"
#: Rows up to which a table of ranges is broadcast, once it is counted.
BROADCAST_ROWS = 1 << 16

INSTANCE = "path string, id long, type string, args array<string>"


def _leads_to(value: Column) -> Column:
    """The state after a piece that starts plain: what opens first of what isn't closed."""
    rest = F.regexp_replace(value, WHOLE, "")
    string, comment = F.instr(rest, "'"), F.instr(rest, "/*")
    return F.when((string > 0) & ((comment == 0) | (string < comment)), "1").when(comment > 0, "2").otherwise("0")


def _after(first: Column, then: Column) -> Column:
    """The function of two pieces one after another."""
    return F.call_function("translate", first, F.lit(SAME), then)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, value, f: what stands between semicolons; at is the order in a byte range (block)."""
    rows = spark.read.option("lineSep", ";").option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    calm = ~F.col("value").contains("'") & ~F.col("value").contains("/*") & ~F.col("value").contains("*/")
    odd = F.concat(_leads_to(F.col("value")), _leads_to(F.concat(F.lit("'"), "value")), _leads_to(F.concat(F.lit("/*"), "value")))
    return rows.withColumn("f", F.when(calm, SAME).otherwise(odd))


def _starts(pieces: DataFrame) -> DataFrame:
    """path, block, start, quiet: the state that each byte range starts in, and whether no piece of it changes a state."""
    marks = F.array_sort(F.collect_list(F.when(F.col("f") != SAME, F.struct("at", "f"))))
    blocks = pieces.groupBy("path", "block").agg(marks.alias("marks"))
    blocks = blocks.select("path", "block", (F.size("marks") == 0).alias("quiet"), F.aggregate("marks", F.lit(SAME), lambda a, m: _after(a, m["f"])).alias("f"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.when(F.col("f") != SAME, F.col("f"))).over(before)
    start = F.substring(F.aggregate(before, F.lit(SAME), lambda a, f: _after(a, f)), 1, 1)
    return cut(blocks.select("path", "block", start.alias("start"), "quiet"))


def _composed(marks: DataFrame) -> DataFrame:
    """path, block, at, upto: for each piece that isn't SAME the function from its range's start to its end."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows, upto, now = rows.sort_by("at"), [], SAME
        for f in rows.column("f").to_pylist():
            now = "".join(f[int(s)] for s in now)
            upto.append(now)
        return rows.select(["path", "block", "at"]).append_column("upto", pa.array(upto, pa.string()))

    return marks.select("path", "block", "at", "f").groupBy("path", "block").applyInArrow(run, "path string, block long, at long, upto string")


def _joined(pieces: DataFrame) -> DataFrame:
    """path, value: the statements of byte ranges that hold strings or comments across semicolons."""
    pieces = cut(pieces)
    own = Window.partitionBy("path", "block").orderBy("at")
    until = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.join(_composed(pieces.where(F.col("f") != SAME)), ["path", "block", "at"], "left")
    end = F.substring(F.coalesce(F.last("upto", ignorenulls=True).over(until), F.lit(SAME)), F.col("start").cast("int") + 1, F.lit(1))
    rows = rows.withColumn("end", end).withColumn("begin", F.coalesce(F.lag("end").over(own), "start"))
    whole = rows.where("begin = '0' AND end = '0'").select("path", "value")
    key = F.struct("block", "at")
    parts = rows.where("begin <> '0' OR end <> '0'")
    parts = cut(parts.withColumn("key", F.last(F.when(F.col("begin") == "0", key), ignorenulls=True).over(until)).select("path", "block", "at", "value", "key"))
    # A statement that goes on from an earlier range has the last key of the ranges before.
    last = parts.groupBy("path", "block").agg(F.max("key").alias("key"))
    carried = F.last("key", ignorenulls=True).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.join(last.select("path", "block", carried.alias("carried")), ["path", "block"]).withColumn("key", F.coalesce("key", "carried"))
    glued = parts.groupBy("path", "key").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    return whole.unionByName(glued.select("path", F.array_join("p.value", ";").alias("value")))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """path, value: the statements of the files below path, without comments and semicolons, in no order."""
    pieces = _pieces(spark, path)
    starts = _starts(pieces)
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    told = pieces.join(starts, ["path", "block"])
    plain = told.where("quiet AND start = '0'").select("path", "value")
    found = plain.unionByName(_joined(told.where("NOT (quiet AND start = '0')")))
    return found.withColumn("value", F.when(F.col("value").contains("/*"), F.regexp_replace("value", WHOLE_STRING, "$1")).otherwise(F.col("value")))


_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),]|[^'(),]+")
_CODED = re.compile(r"\\X2\\((?:[0-9A-F]{4})*)\\X0\\|\\X4\\((?:[0-9A-F]{8})*)\\X0\\|\\X\\([0-9A-F]{2})|\\S\\(.)|\\P[A-I]\\|\\\\", re.S)


def text_of(token: str) -> str:
    """The text of a string token: quotes and control directives resolved."""

    def resolve(m: re.Match) -> str:
        if m[1] is not None:
            return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
        if m[2] is not None:
            return bytes.fromhex(m[2]).decode("utf-32-be", "replace")
        if m[3] is not None:
            return chr(int(m[3], 16))
        return chr(ord(m[4]) + 128) if m[4] is not None else "\\" if m[0] == "\\\\" else ""

    text = token[1:-1].replace("''", "'").replace("\r", "").replace("\n", "")
    return _CODED.sub(resolve, text) if "\\" in text else text


def arguments(inner: str) -> list[str | None]:
    """Top-level arguments between a statement's brackets: $ and * are None, strings are resolved, the rest is as written."""
    out, depth, now = [], 0, []
    for token in _TOKEN.findall(inner):
        if token == "," and not depth:
            out.append(now)
            now = []
            continue
        depth += (token == "(") - (token == ")")
        now.append(token if token[0] == "'" else "".join(token.split()))
    tokens = [[t for t in a if t] for a in [*out, now]]
    return [None if a in ([], ["$"], ["*"]) else text_of(a[0]) if len(a) == 1 and a[0][0] == "'" else "".join(a) for a in tokens]


#: The type of the row that instances() gives for a file's schema, which no instance can have.
HEADER = "(FILE_SCHEMA)"
_SCHEMA = re.compile(r"\s*FILE_SCHEMA\s*\([^']*'([A-Za-z0-9_]+)", re.S)
_STATEMENT = re.compile(r"\s*#\s*(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\s*", re.S)


def instances(stated: DataFrame, types: list[str] | None = None, header: bool = False) -> DataFrame:
    """path, id, type (upper case), args: the instances of statements(), of the types only where they are given.

    Arguments that are left out ($ or *) are null, strings are as text; references, lists, numbers and enumerations are as
    written, without blanks. Instances of several types at once are left out, as are headers; with header, a file's schema
    is a row of type HEADER, so that the statements are made only once.
    """
    wanted = F.col("value").rlike(r"^\s*#\s*\d+\s*=\s*[A-Za-z]")
    kind = F.upper(F.regexp_extract("value", r"=\s*([A-Za-z0-9_]+)", 1))
    if types is not None:
        wanted &= kind.isin(*sorted(t.upper() for t in types))
    found = stated.where(wanted | F.col("value").rlike(r"^\s*FILE_SCHEMA\s*\(") if header else wanted)

    def told(value: str) -> tuple[int, str, list[str | None]] | None:
        m = _STATEMENT.fullmatch(value)
        if m:
            return int(m[1]), m[2].upper(), arguments(m[3])
        m = _SCHEMA.match(value) if header else None
        return m and (0, HEADER, [m[1].upper()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [(p, told(v)) for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            parsed = [(p, *m) for p, m in parsed if m]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in parsed], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())))],
                ["path", "id", "type", "args"],
            )

    return found.select("path", "value").mapInArrow(run, INSTANCE)


def schemas(stated: DataFrame) -> DataFrame:
    """path, step_schema: the first name in the FILE_SCHEMA of each file of statements(), upper case."""
    found = stated.where(F.col("value").rlike(r"^\s*FILE_SCHEMA\s*\("))
    return found.groupBy("path").agg(F.min(F.upper(F.regexp_extract("value", r"'([A-Za-z0-9_]+)", 1))).alias("step_schema"))


def ref(arg: Column) -> Column:
    """The instance number that an argument refers to; null for anything else."""
    return F.when(arg.rlike(r"^#\d+$"), F.substring(arg, 2, 20).cast("long"))


def refs(arg: Column) -> Column:
    """The instance numbers in a list."""
    return F.transform(F.regexp_extract_all(arg, F.lit(r"#(\d+)"), 1), lambda r: r.cast("long"))


def numbers(arg: Column) -> Column:
    """The numbers in a list, nested ones one after another."""
    return F.transform(F.regexp_extract_all(arg, F.lit(r"([-+]?[0-9][0-9.]*(?:[Ee][-+]?[0-9]+)?)"), 1), lambda r: r.cast("double"))
