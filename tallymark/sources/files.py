"""Reading files: numbered lines, raw cell grids, JSON, clean CSV, parquet; one bad file never stops a batch."""

from __future__ import annotations

import functools
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import values as V

_LINE_CHUNK = 10_000
# --- fixed values -----------------------------------------------------------
# Byte-order marks, as the hexadecimal text of a file's first bytes.
MARKS = (("UTF-16LE", "FFFE"), ("UTF-16BE", "FEFF"), ("UTF-8", "EFBBBF"))
# ----------------------------------------------------------------------------


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def detect_encoding(spark: SparkSession, paths, lenient: bool = False) -> DataFrame:
    """``file_id, encoding`` by byte-order mark, else UTF-8."""
    text = spark.read.option("ignoreCorruptFiles", lenient).text(_as_list(paths), lineSep="\n")
    first = text.select(F.hex(F.col("value").cast("binary")).alias("bytes"), F.col("_metadata.file_path").alias("file_id"),
                        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    heads = first.filter("start = 0").groupBy("file_id").agg(F.min_by(F.substring("bytes", 1, 6), "id").alias("head"))
    encoding = F
    for name, mark in MARKS:
        encoding = encoding.when(F.col("head").startswith(mark), F.lit(name))
    return heads.select("file_id", encoding.otherwise("UTF-8").alias("encoding"))


def numbered_lines(spark: SparkSession, paths, encoding: str | None = None, lenient: bool = False) -> DataFrame:
    """``file_id, line_no, line``: every line in file order, from 1, marks and carriage returns removed.

    Files are read in blocks by many tasks. Lines are numbered inside each block, and the
    line totals of the earlier blocks of the same file (one row per block) are added.
    ``lenient`` leaves out what cannot be read of a corrupt file instead of failing.
    """
    if encoding is None:
        found = {r.file_id: r.encoding for r in detect_encoding(spark, paths, lenient).filter("encoding LIKE 'UTF-16%'").collect()}
        wide: dict[str, list[str]] = {}
        for path, name in found.items():
            wide.setdefault(name, []).append(path)
        out = numbered_lines(spark, paths, "UTF-8", lenient)
        if found:
            out = out.filter(~F.col("file_id").isin(list(found)))
        for name, group in wide.items():
            out = out.unionByName(numbered_lines(spark, group, name, lenient))
        return out
    # The reader only uses the encoding to find line ends; the bytes of a line are decoded here.
    raw = F.col("value")
    decoded = raw if encoding == "UTF-8" else F.decode(raw.cast("binary"), encoding)
    lines = spark.read.option("encoding", encoding).option("ignoreCorruptFiles", lenient).text(_as_list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace(decoded, "\r$", "").alias("line"))
    inner = W.partitionBy("file_id", "block").orderBy("id")
    across = W.partitionBy("file_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = lines.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "file_id", "block", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    numbered = lines.withColumn("at", F.row_number().over(inner)).join(totals, ["file_id", "block"])
    line_no = F.col("before") + F.col("at")
    clean = F.when(line_no == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return numbered.select("file_id", line_no.alias("line_no"), clean.alias("line"))


def scan_lines(spark: SparkSession, paths) -> DataFrame:
    """``file_id, line, content``: trimmed non-blank lines, numbered after blanks are dropped."""
    lines = numbered_lines(spark, paths)
    kept = lines.select(
        "file_id", "line_no", F.floor((F.col("line_no") - 1) / _LINE_CHUNK).alias("chunk"),
        V.trimmed(F.col("line")).alias("content")).filter("content <> ''")
    return _numbered_in_chunks(kept, "line").select("file_id", F.col("line").cast("int").alias("line"), "content")


def _numbered_in_chunks(rows: DataFrame, name: str) -> DataFrame:
    """Numbers rows of a file from 1 in ``line_no`` order, a stretch of lines per task."""
    inner = W.partitionBy("file_id", "chunk").orderBy("line_no")
    across = W.partitionBy("file_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("file_id", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "file_id", "chunk", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    return rows.withColumn("at", F.row_number().over(inner)).join(totals, ["file_id", "chunk"]).withColumn(
        name, F.col("before") + F.col("at"))


def split_lines(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``file_id, line, content`` from text already in a column, one document per row."""
    lines = F.filter(F.transform(F.split(text, "\n"), V.trimmed), lambda x: x != "")
    return df.select(key.alias("file_id"), F.posexplode(lines).alias("at", "content")).select(
        "file_id", (F.col("at") + 1).alias("line"), "content")


def _cell_patterns(sep: str) -> tuple[str, str]:
    """A cell that begins with a quote, up to where it ends outside quotes, and any other cell.

    Quotes count only in a cell whose first character is one. Quantifiers are possessive: matching never goes back, so it
    is linear and needs no stack.
    """
    out = f"[^\"{re.escape(sep)}]"
    plain = f"[^{re.escape(sep)}]"
    return f"\"[^\"]*+\"(?:{out}*+\"[^\"]*+\")*+{out}*+", f"(?:{out}{plain}*+)?+"


def _line_machine(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends outside quotes when it begins a record, and when it begins inside quotes.

    Together they are the line's transition function over the two states a line can begin in.
    """
    quoted, plain = _cell_patterns(sep)
    cell, more = f"(?:{quoted}|{plain})", f"(?:{re.escape(sep)}(?:{quoted}|{plain}))*+\\z"
    closing = quoted[1:]  # a quoted cell whose opening quote lies on an earlier line
    has_quote = F.contains(line, F.lit('"'))
    return ~has_quote | line.rlike(f"\\A{cell}{more}"), has_quote & line.rlike(f"\\A{closing}{more}")


def records(lines: DataFrame, sep: str = ",") -> DataFrame:
    """``file_id, row_no, record``: lines joined where a quoted cell runs over a line end.

    Reading cells is a finite-state machine. A line can begin in two states only, outside and inside quotes, so what it
    does to them is one of four functions: keep (0), swap (1), lead outside (2) or lead inside (3). Functions are
    composed in order: within a stretch of lines by a window, and over the stretches of a file by a window over one row
    a stretch; a stretch counts its record starts for both states it may begin in. Lines that are a record by themselves
    then stay where they are, the others meet by record. A quote that is never closed holds the rest of its file.
    """
    outside, inside = _line_machine(F.col("line"), sep)
    kind = F.when(outside, F.when(inside, 2).otherwise(0)).otherwise(F.when(inside, 1).otherwise(3))
    chunked = lines.select("file_id", "line_no", "line", F.floor((F.col("line_no") - 1) / _LINE_CHUNK).alias("chunk"), kind.alias("kind"))
    inner = W.partitionBy("file_id", "chunk").orderBy("line_no")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    read = chunked.withColumn("swaps", F.sum((F.col("kind") == 1).cast("long")).over(upto))
    # The last function that leads to one state whatever came before, and the swaps up to it.
    fixed = F.last(F.when(F.col("kind") >= 2, F.struct((F.col("kind") == 3).alias("inside"), F.col("swaps").alias("at"))), ignorenulls=True)
    read = read.withColumn("fixed", fixed.over(upto))

    def after(entry: Column, swaps: Column, fixed: Column) -> Column:
        """Whether quotes are open after rows with these swaps and last constant, begun with ``entry``."""
        odd = lambda n: n % 2 == 1
        return F.when(fixed.isNull(), entry != odd(swaps)).otherwise(fixed.inside != odd(swaps - fixed.at))

    for name, entry in (("out", F.lit(False)), ("in", F.lit(True))):
        read = read.withColumn(f"after_{name}", after(entry, F.col("swaps"), F.col("fixed")))
        read = read.withColumn(f"before_{name}", F.coalesce(F.lag(f"after_{name}").over(inner), entry))
        read = read.withColumn(f"rows_{name}", F.sum((~F.col(f"before_{name}")).cast("long")).over(upto))
    last = F.max_by(F.struct("after_out", "after_in", "rows_out", "rows_in"), "line_no")
    stretches = read.groupBy("file_id", "chunk").agg(last.alias("s")).select(
        "file_id", "chunk", "s.*", F.when(~F.col("s.after_out"), F.when(F.col("s.after_in"), 0).otherwise(2)).otherwise(
            F.when(F.col("s.after_in"), 3).otherwise(1)).alias("kind"))
    by_file = W.partitionBy("file_id").orderBy("chunk")
    earlier = by_file.rowsBetween(W.unboundedPreceding, -1)
    stretches = stretches.withColumn("swaps", F.sum((F.col("kind") == 1).cast("long")).over(by_file.rowsBetween(W.unboundedPreceding, 0)))
    stretches = stretches.withColumn("fixed", fixed.over(earlier)).withColumn(
        "entry", after(F.lit(False), F.coalesce(F.lag("swaps").over(by_file), F.lit(0)), F.col("fixed")))
    begun = F.when(F.col("entry"), F.col("rows_in")).otherwise(F.col("rows_out"))
    entries = stretches.withColumn("begun", begun).select(
        "file_id", "chunk", "entry", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("records_before"))
    choose = lambda name: F.when(F.col("entry"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    placed = read.join(entries, ["file_id", "chunk"]).select(
        "file_id", "line_no", "line", (F.col("records_before") + choose("rows")).alias("row_no"),
        (choose("before") | choose("after")).alias("part"))
    alone = placed.filter(~F.col("part")).select("file_id", "row_no", F.col("line").alias("record"))
    joined = placed.filter("part").groupBy("file_id", "row_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return alone.unionByName(joined.select(
        "file_id", "row_no", F.array_join(F.transform("parts", lambda p: p.line), "\n").alias("record")))


def cells_of(rows: DataFrame, sep: str = ",") -> DataFrame:
    """Splits ``record`` into ``cells``, each row by itself and as wide as it is; blank records become empty rows.

    A cell that both begins and ends with a quote loses them, and its doubled quotes are single; an empty cell is null.
    """
    quoted, plain = _cell_patterns(sep)
    cell = f"{re.escape(sep)}({quoted}(?={re.escape(sep)}|\\z)|\"(?s:.*+)|{plain})"
    found = F.regexp_extract_all(F.concat(F.lit(sep), F.col("record")), F.lit(cell), 1)

    def bare(c: Column) -> Column:
        wrapped = c.startswith('"') & c.endswith('"')
        inner = F.replace(F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(wrapped, inner).otherwise(c), F.lit(""))

    blank = F.trim("record") == ""
    return rows.select(*[c for c in rows.columns if c != "record"], F.when(
        blank, F.array().cast("array<string>")).otherwise(F.transform(found, bare)).alias("cells"))


def scan_grid(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """``file_id, row_no, cells``: delimited files as raw grids, blank rows kept, rows from 1."""
    return cells_of(records(numbered_lines(spark, paths), sep), sep)


def scan_csv(spark: SparkSession, paths) -> DataFrame:
    """A delimited file with a clean first-row header, every cell as text."""
    return spark.read.csv(_as_list(paths), header=True, multiLine=True, inferSchema=False, escape='"')


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns, arrays and maps as JSON text."""
    def leaves(prefix: list[str], schema: T.StructType):
        for field in schema.fields:
            path = [*prefix, field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(path, field.dataType)
            else:
                c = F.col(".".join(V.quoted(p) for p in path))
                if isinstance(field.dataType, (T.ArrayType, T.MapType)):
                    c = F.to_json(c)
                yield c.alias(".".join(path))

    return df.select(*leaves([], df.schema))


def _opens_with(spark: SparkSession, paths) -> set[str]:
    """The kinds of outermost JSON token met in the files: ``{``, ``[`` or, for a lone scalar, an empty text."""
    lines = spark.read.text(_as_list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"), F.monotonically_increasing_id().alias("id"),
        F.substring(F.regexp_extract("value", r"^[\s\x{FEFF}]*(\S)", 1), 1, 1).alias("token")).filter("token <> ''")
    first = lines.groupBy("file_id").agg(F.min_by("token", "id").alias("token"))
    kinds = F.when(F.col("token").isin("{", "["), F.col("token")).otherwise("")
    return {r.token for r in first.select(kinds.alias("token")).distinct().collect()}


def scan_json(spark: SparkSession, paths, *, multi_line: bool = True, flatten: bool | None = None) -> DataFrame:
    """An array of objects as rows over the union of their keys; one object as one flattened row.

    The outermost token of the text decides, never the number of rows: an array that holds one object is not flattened.
    An array without objects and a lone scalar are one row with their JSON text as ``value``. JSON lines
    (``multi_line=False``) are split over tasks; they are rows like those of an array.
    """
    df = spark.read.option("multiLine", multi_line).json(_as_list(paths))
    opening = _opens_with(spark, paths) if multi_line else {"["}
    if df.columns in ([], ["_corrupt_record"]):
        if not multi_line or opening == {"{"} or not opening:
            return spark.createDataFrame([], "value string")
        texts = spark.read.text(_as_list(paths), wholetext=True)
        return texts.select(F.to_json(F.parse_json(F.regexp_replace("value", r"^\x{FEFF}", ""))).alias("value"))
    if flatten is None:
        flatten = opening == {"{"}
    if flatten:
        return flatten_struct(df)
    # Objects inside an array of rows stay one cell, as JSON text.
    return df.select(*[
        F.to_json(V.quoted(f.name)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType))
        else F.col(V.quoted(f.name)) for f in df.schema.fields])


def is_tabular(df: DataFrame) -> bool:
    return len(df.columns) > 1 and df.limit(2).count() > 1


def _located(spark: SparkSession, path: str) -> str | None:
    """The path as the readers' file metadata spells it, or null where nothing is there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return _spelled(system.makeQualified(jpath).toUri().toString()) if system.exists(jpath) else None


def _spelled(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def _faults(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first fault of each file that cannot be read to its end. All are read at once; a group with a fault is halved."""
    if not paths:
        return {}
    try:
        spark.read.option("ignoreCorruptFiles", False).text(paths, lineSep="\n").agg(F.sum(F.length("value"))).collect()
    except (PySparkException, Py4JJavaError) as fault:
        if len(paths) == 1:
            return {paths[0]: str(fault).strip().split("\n")[0][:500]}
        middle = len(paths) // 2
        return _faults(spark, paths[:middle]) | _faults(spark, paths[middle:])
    return {}


def scan_many(spark: SparkSession, paths) -> tuple[DataFrame | None, DataFrame]:
    """All readable files as one grid, and one status row per file; a bad file is a row, not a failure.

    Every file is first read to its end. One with a fault is ``partial`` if rows before the fault could be read, which
    stay, and else ``error``; its row says what the fault was. Sound files are read strictly.
    """
    found = {p: _located(spark, p) for p in _as_list(paths)}
    schema = "path string, status string, error string, rows long"
    errors = spark.createDataFrame([(p, "error", "file not found", 0) for p, uri in found.items() if uri is None], schema)
    there = [(p, uri) for p, uri in found.items() if uri is not None]
    if not there:
        return None, errors
    faults = _faults(spark, [p for p, _ in there])
    sound = [p for p, _ in there if p not in faults]
    parts = [numbered_lines(spark, group, lenient=lenient) for group, lenient in ((sound, False), (list(faults), True)) if group]
    grid = cells_of(records(functools.reduce(DataFrame.unionByName, parts)))
    names = spark.createDataFrame([(p, uri, faults.get(p)) for p, uri in there], "path string, uri string, fault string")
    filled = grid.groupBy(F.regexp_replace("file_id", "^file:/+", "file:/").alias("uri")).agg(
        F.count_if(F.exists("cells", lambda c: ~V.is_missing(c, T.StringType()))).alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    status = names.join(filled, "uri", "left").select(
        "path", F.when(rows == 0, "error").when(F.col("fault").isNotNull(), "partial").otherwise("ok").alias("status"),
        F.coalesce("fault", F.when(rows == 0, "no readable rows")).alias("error"), rows.alias("rows"))
    return grid, status.unionByName(errors)
