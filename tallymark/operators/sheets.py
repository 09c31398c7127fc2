"""How raw sheets should be read: header, title rows, totals, second tables, transposition.

Many sheets go through at once, and one sheet may hold most rows, so the unit of
work is a stretch of rows (``file_id, chunk``), never a whole sheet. What a stretch
needs to know about the rest arrives as one summary row per stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import values as V
from ..session import durable

# --- fixed values -----------------------------------------------------------
HEADER_REACH = 0.8
HEADER_SCAN = 25
CONTRAST_ROWS = 10
MIN_CONTRIBUTORS = 2
SUM_TOLERANCE = 1e-9
PREVIEW_CHARS = 60
AGGREGATE_LABEL = r"(?i)^\s*(grand\s+)?(totals?|sub-?totals?|sums?|overall)\b"
TRANSPOSE_ROWS, TRANSPOSE_COLUMNS = 3, 3
TRANSPOSE_LABELS, TRANSPOSE_NUMBERS = 0.8, 0.7
TRANSPOSE_RATIO, TRANSPOSE_SPREAD = 2, 0.6
TRANSPOSE_DETAIL = (
    "field names may run down the first column and records across the columns — each row's values agree in "
    "magnitude while each column's span orders of magnitude, so a column mean would average unrelated measures. "
    "The columns were computed as-is; transpose the sheet if this reading is wrong."
)
SECOND_HEADER_DETAIL = (
    "another table appears to start here; the rows under it are still counted with the first table's")
# ----------------------------------------------------------------------------
CHUNK_ROWS = 10_000
TEXT = T.StringType()
FILE = ["file_id"]
STRETCH = ["file_id", "chunk"]


# -- row predicates ---------------------------------------------------------------

def is_blank_row(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: ~V.is_missing(c, TEXT))


def row_span(cells: Column) -> Column:
    """1-based place of the right-most present cell, 0 for a blank row."""
    reach = F.transform(cells, lambda c, i: F.when(V.is_missing(c, TEXT), 0).otherwise(i + 1))
    return F.coalesce(F.array_max(reach), F.lit(0))


def preview(cells: Column) -> Column:
    shown = F.filter(cells, lambda c: ~V.is_missing(c, TEXT))
    return F.transform(shown, lambda c: F.substring(V.trimmed(c), 1, PREVIEW_CHARS))


def aggregate_label(trimmed: Column, numbers: Column) -> Column:
    """The first trimmed cell that is neither missing nor a number, if it names a total."""
    words = F.filter(F.zip_with(trimmed, numbers, lambda t, n: F.when(n.isNull() & (t != ""), t)), lambda t: t.isNotNull())
    first = F.try_element_at(words, F.lit(1))
    return F.when(first.rlike(AGGREGATE_LABEL), first)


def read_rows(grid: DataFrame) -> DataFrame:
    """Each row with its numbers, span and the counts the later steps compare."""
    # One select per step: cells are trimmed once, and the later steps name what the earlier ones found.
    rows = grid.select(
        "file_id", "row_no", F.floor((F.col("row_no") - 1) / CHUNK_ROWS).alias("chunk"), "cells",
        F.transform("cells", V.trimmed).alias("t"))
    reach = F.transform("t", lambda t, i: F.when(t != "", i + 1).otherwise(0))
    rows = rows.select(
        "file_id", "row_no", "chunk", "cells", "t",
        F.transform("t", lambda t: F.when(t.rlike(V.NUMBER_START), V.number_from(t))).alias("numbers"),
        F.coalesce(F.array_max(reach), F.lit(0)).alias("span"),
        F.transform(F.filter("t", lambda t: t != ""), F.lower).alias("words"))
    filled = F.size("words")
    return rows.select(
        "file_id", "row_no", "chunk", "cells", "numbers", "span", filled.alias("present"),
        (filled - F.size(F.array_compact("numbers"))).alias("textual"),
        F.size(F.array_distinct("words")).alias("distinct"), (filled == 0).alias("blank"),
        aggregate_label(F.col("t"), F.col("numbers")).alias("label"))


def _same_start(a: Column, b: Column) -> Column:
    """Whether two summaries of one column lead to the same decisions: the sums agree, and so does having enough values."""
    scale = F.greatest(F.lit(1.0), F.abs(a.s), F.abs(b.s))
    same = (a.col == b.col) & (F.abs(a.s - b.s) <= 1e-13 * scale) & (
        (a.n >= MIN_CONTRIBUTORS) == (b.n >= MIN_CONTRIBUTORS)) & ((a.n == b.n) | (a.n >= MIN_CONTRIBUTORS))
    return F.coalesce(same, F.lit(False))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, stretch by stretch: a row is compared with the sums of the rows kept so far, and kept if it is none."""
    kinds = pa.schema([
        ("file_id", pa.string()), ("chunk", pa.int64()),
        ("found", pa.list_(pa.struct([("row_no", pa.int64()), ("comparable", pa.int64()), ("matched", pa.int64()),
                                      ("matched_columns", pa.list_(pa.int32()))]))),
        ("kept", pa.list_(pa.struct([("col", pa.int32()), ("s", pa.float64()), ("n", pa.int64())])))])
    key, start, own, found, out = None, {}, {}, [], []  # own: sums and counts of the rows kept in the stretch itself

    def closed():
        return {"file_id": key[0], "chunk": key[1], "found": found, "kept": [{"col": c, "s": s, "n": n} for c, (s, n) in own.items()]}

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file_id", "chunk", "row_no", "numbers", "second_header", "labelled", "entry")]
        for file_id, chunk, row_no, numbers, second_header, labelled, entry in zip(*columns, strict=True):
            if (file_id, chunk) != key:
                if key is not None:
                    out.append(closed())
                start = {e["col"]: (e["s"], e["n"]) for e in entry or ()}
                key, own, found = (file_id, chunk), {}, []
            if second_header:
                continue
            comparable, equal = 0, []
            values = [(c, v) for c, v in enumerate(numbers) if v is not None]
            for c, v in values:
                (before, m), (above, n) = start.get(c, (0.0, 0)), own.get(c, (0.0, 0))
                above += before
                if m + n >= MIN_CONTRIBUTORS:
                    comparable += 1
                    if abs(v - above) <= SUM_TOLERANCE * max(1.0, abs(v), abs(above)):
                        equal.append(c)
            hit = bool(equal) and 2 * len(equal) >= comparable
            if hit:
                found.append({"row_no": row_no, "comparable": comparable, "matched": len(equal), "matched_columns": equal})
            elif not labelled:
                for c, v in values:
                    above, n = own.get(c, (0.0, 0))
                    own[c] = (above + v, n + 1)
        yield pa.RecordBatch.from_pylist(out, schema=kinds)
        out = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema=kinds)


def modal_width(rows: DataFrame) -> DataFrame:
    """The most common non-blank span per sheet, ties to the wider."""
    counts = rows.filter("span > 0").groupBy("file_id", "span").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("file_id").agg(F.max_by("span", F.struct("n", "span")).alias("width"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def header_candidates(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """Scored header candidates per sheet: reach, distinct cells, contrast with and agreement of the rows below.

    Only the first rows of a sheet matter: 25 candidates and ten rows under the last.
    """
    order = W.partitionBy("file_id").orderBy("row_no")
    below = order.rowsBetween(1, CONTRAST_ROWS)
    top = rows.filter("NOT blank").select(
        "file_id", "row_no", "span", "present", "textual", "distinct", F.row_number().over(order).alias("nth"))
    listed = top.filter(F.col("nth") <= HEADER_SCAN + CONTRAST_ROWS).join(widths, "file_id").select(
        "*", F.sum("textual").over(below).alias("textual_below"), F.sum("present").over(below).alias("present_below"),
        F.count_if(F.col("span") == F.col("width")).over(below).alias("agreeing"), F.count("span").over(below).alias("rows_below"))
    scored = listed.filter(F.col("row_no") <= HEADER_SCAN).select(
        "file_id", "width", "row_no", (F.col("present") < F.col("width")).alias("sparse"),
        F.least(F.lit(1.0), F.col("span") / F.col("width")).alias("reach"),
        _share(F.col("distinct"), F.col("present")).alias("distinct"),
        F.greatest(F.lit(0.0), _share(F.col("textual"), F.col("present"))
                   - _share(F.col("textual_below"), F.col("present_below"))).alias("contrast"),
        _share(F.col("agreeing"), F.col("rows_below")).alias("agreement"))
    parts = ["reach", "distinct", "contrast", "agreement"]
    score = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    return scored.groupBy("file_id", "width").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "sparse", *parts, score.alias("score")))).alias("candidates"))


def choose_header(candidates: DataFrame) -> DataFrame:
    """The header row of each sheet, whether it is certain, and the other plausible rows."""
    viable, one = F.col("reach") >= HEADER_REACH, F.struct("row_no", "score", "sparse", "contrast")
    rows = candidates.select("file_id", "width", F.inline("candidates")).withColumn("viable", viable)
    rows = rows.withColumn("first", F.min(F.when(F.col("viable"), one)).over(W.partitionBy("file_id")))
    later = F.col("viable") & (F.col("row_no") > F.col("first.row_no")) & (F.col("score") > F.col("first.score"))
    staged = rows.groupBy("file_id", "width").agg(
        F.min("first").alias("first"), F.min(F.when(later, one)).alias("later"),
        F.min(F.struct((-F.col("score")).alias("s"), "row_no", "contrast")).alias("best"), F.min("row_no").alias("start"),
        F.sort_array(F.collect_list(F.when(F.col("viable"), F.col("row_no")))).alias("viable_rows"),
        F.sort_array(F.collect_list("row_no")).alias("all_rows"))
    none = F.col("first").isNull()
    staged = staged.withColumn("better", F.when(F.col("first.sparse"), F.col("later")))
    picked = {c: F.when(none, F.col(f"best.{c}")).otherwise(F.coalesce(F.col(f"better.{c}"), F.col(f"first.{c}")))
              for c in ("row_no", "contrast")}
    staged = staged.select("*", *[v.alias(c) for c, v in picked.items()])
    stepped = F.col("row_no") > F.col("start")
    certain = ~none & (~stepped | (F.col("contrast") > 0)) & F.col("better").isNull()
    others = F.array_remove(F.when(none, F.col("all_rows")).otherwise(F.col("viable_rows")), F.col("row_no"))
    return staged.select(
        "file_id", "width", F.col("row_no").alias("header_row"), certain.alias("certain"),
        F.when(~certain, others).otherwise(F.array().cast("array<long>")).alias("others"))


class Sheets:
    """The structural read of ``grid(file_id, row_no, cells)``.

    ``overrides(file_id, header_row, include_rows)`` holds corrections: where a header
    really is, and which aggregate rows to put back.
    """

    def __init__(self, grid: DataFrame, overrides: DataFrame | None = None):
        self.spark = grid.sparkSession
        self.grid = grid
        self.overrides = overrides

    @cached_property
    def rows(self) -> DataFrame:
        """Every row read once and written down, as all later steps start from it."""
        return durable(read_rows(self.grid))

    @cached_property
    def headers(self) -> DataFrame:
        """One row per sheet: size, width, header, certainty, and the corrections asked for. Written once."""
        sizes = self.rows.groupBy("file_id").agg(F.max("row_no").alias("rows_total"), F.max("span").alias("reach"))
        found = choose_header(header_candidates(self.rows, modal_width(self.rows)))
        out = sizes.join(found, "file_id", "left")
        if self.overrides is None:
            asked = [F.lit(None).cast("long").alias("asked_header"), F.array().cast("array<long>").alias("include_rows")]
            out = out.select("*", *asked)
        else:
            out = out.join(self.overrides.select(
                "file_id", F.when(F.col("header_row") >= 1, F.col("header_row")).cast("long").alias("asked_header"),
                F.coalesce(F.col("include_rows").cast("array<long>"), F.array().cast("array<long>")).alias("include_rows"),
            ), "file_id", "left").withColumn(
                "include_rows", F.coalesce("include_rows", F.array().cast("array<long>")))
        named = F.coalesce(F.col("asked_header") <= F.col("rows_total"), F.lit(False)) & F.col("width").isNotNull()
        return durable(out.select(
            "file_id", "rows_total", "reach", "width", "asked_header", "include_rows", named.alias("specified"),
            F.when(named, F.col("asked_header")).otherwise(F.col("header_row")).alias("header_row"),
            (named | F.col("certain")).alias("certain"),
            F.when(named, F.array().cast("array<long>")).otherwise(F.col("others")).alias("others")))

    def _by_stretch(self, *columns: str) -> DataFrame:
        """Sheet facts repeated per stretch, so a huge sheet's rows never meet them in one task."""
        stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows_total") - 1) / CHUNK_ROWS))
        return self.headers.filter("header_row IS NOT NULL").select(
            "file_id", F.explode(stretches).alias("chunk"), *columns)

    @cached_property
    def _stretches(self) -> DataFrame:
        """All stretches of the sheets that have more than one."""
        return self._by_stretch("rows_total").filter(F.col("rows_total") > CHUNK_ROWS).select(*STRETCH)

    @cached_property
    def _deepest(self) -> int:
        """The lowest header of all sheets: rows under it need not be looked at for headers and what stands above them."""
        return self.headers.agg(F.max("header_row")).first()[0] or 0

    @cached_property
    def data(self) -> DataFrame:
        """Non-blank rows under the header, flagged: label, second header.

        Rows meet the sheet's facts once; all windows follow that layout. What a stretch needs of the one before or after
        it comes from the stretches of sheets that have several.
        """
        inner = W.partitionBy(*STRETCH).orderBy("row_no")
        earlier = W.partitionBy("file_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        later = W.partitionBy("file_id").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
        ends = self.rows.select(*STRETCH, "row_no", "blank").join(self._stretches, STRETCH).groupBy(*STRETCH).agg(
            F.max_by("blank", "row_no").alias("ends_blank"))
        before = self._stretches.join(ends, STRETCH, "left").select(
            *STRETCH, F.last("ends_blank", True).over(earlier).alias("_blank_before"))
        heads = self._by_stretch("header_row", "width")
        starts = self.rows.filter("chunk > 0 AND NOT blank").join(heads, STRETCH).filter("row_no > header_row").groupBy(*STRETCH).agg(
            F.min_by("numbers", "row_no").alias("starts"))
        following = self._stretches.join(starts, STRETCH, "left").select(
            *STRETCH, F.last("starts", True).over(later).alias("_next_stretch"))
        rows = self.rows.join(heads, STRETCH)
        rows = rows.withColumn("_lag", F.lag("blank").over(inner)).join(before, STRETCH, "left").withColumn(
            "after_blank", F.coalesce("_lag", "_blank_before", F.lit(False)))
        data = rows.filter("NOT blank AND row_no > header_row")
        data = data.withColumn("_lead", F.lead("numbers").over(inner)).join(following, STRETCH, "left")
        below = F.coalesce("_lead", "_next_stretch")
        words_over_numbers = F.exists(
            F.arrays_zip(F.col("cells").alias("c"), F.col("numbers").alias("n"), below.alias("b")),
            lambda z: ~V.is_missing(z.c, TEXT) & z.n.isNull() & z.b.isNotNull())
        second = (
            F.col("after_blank") & below.isNotNull() & (F.col("present") >= 2)
            & (F.col("textual") == F.col("present")) & words_over_numbers)
        return durable(data.select(
            *STRETCH, "row_no", "cells", "numbers", F.coalesce(second, F.lit(False)).alias("second_header"), "label", "width"))

    def second_headers(self) -> DataFrame:
        return self.data.filter("second_header").select("file_id", "row_no", preview(F.col("cells")).alias("cells"))

    def aggregate_labels(self) -> DataFrame:
        return self.data.filter("label IS NOT NULL AND NOT second_header").select("file_id", "row_no", "label")

    # -- rows that restate the rows above them ------------------------------

    def _carried(self, kept: DataFrame, sheets: DataFrame) -> DataFrame:
        """``file_id, chunk, entry``: what the rows kept in earlier stretches add up to, for stretches after the first."""
        across = W.partitionBy("file_id", "col").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        by_column = kept.select(*STRETCH, F.inline("kept")).groupBy(*STRETCH, "col").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        # Every later stretch of a sheet, also one where the column has no number itself.
        later = sheets.join(by_column.select("file_id", "col").distinct(), "file_id")
        begun = later.join(by_column, ["file_id", "chunk", "col"], "left").select(
            *STRETCH, "col", F.coalesce(F.sum("s").over(across), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n"))
        return begun.filter("n > 0").groupBy(*STRETCH).agg(
            F.array_sort(F.collect_list(F.struct("col", "s", "n"))).alias("entry"))

    def _folded(self, rows: DataFrame, entries: DataFrame) -> DataFrame:
        """One row a stretch: the rows in it that restate the rows above, and what its kept rows add up to."""
        ordered = rows.join(entries, STRETCH, "left").select(
            *STRETCH, "row_no", "numbers", "second_header", F.col("label").isNotNull().alias("labelled"), "entry")
        ordered = ordered.repartition(*STRETCH).sortWithinPartitions(*STRETCH, "row_no")
        out = ("file_id string, chunk long, found array<struct<row_no:long,comparable:long,matched:long,matched_columns:array<int>>>, "
               "kept array<struct<col:int,s:double,n:long>>")
        return ordered.mapInArrow(_fold, out)

    def _running(self) -> DataFrame:
        """``file_id, chunk, row_no, comparable, matched_columns, hit, labelled``: each row with a number against the sums of
        all unlabelled rows above it in its stretch, which are the kept ones up to the first unlabelled hit."""
        cells = self.data.filter("NOT second_header").select(
            *STRETCH, "row_no", F.col("label").isNotNull().alias("labelled"), F.posexplode("numbers").alias("col", "v")).filter("v IS NOT NULL")
        w = W.partitionBy(*STRETCH, "col").orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
        counted = F.when(~F.col("labelled"), F.col("v"))
        cells = cells.repartition(*STRETCH).select("*", F.coalesce(F.sum(counted).over(w), F.lit(0.0)).alias("above"), F.count(counted).over(w).alias("n"))
        enough = F.col("n") >= MIN_CONTRIBUTORS
        equal = enough & (F.abs(F.col("v") - F.col("above")) <= SUM_TOLERANCE * F.greatest(F.lit(1.0), F.abs("v"), F.abs("above")))
        rows = cells.groupBy(*STRETCH, "row_no", "labelled").agg(
            F.count_if(enough).alias("comparable"), F.sort_array(F.collect_list(F.when(equal, F.col("col")))).alias("matched_columns"))
        hit = (F.size("matched_columns") > 0) & (2 * F.size("matched_columns") >= F.col("comparable"))
        return rows.withColumn("hit", hit)

    @cached_property
    def arithmetic(self) -> DataFrame:
        """Rows that restate the rows above.

        In a sheet of one stretch all is said by running sums, unless numbers stand below an unlabelled total: it was
        summed up too. Those sheets, and sheets of several stretches, are folded.
        """
        run = self._running()
        last = W.partitionBy(*STRETCH)
        early = F.bool_or(F.col("hit") & ~F.col("labelled") & (F.col("row_no") < F.col("last"))).over(last)
        run = run.withColumn("last", F.max("row_no").over(last)).withColumn("early", early)
        found = durable(run.filter("hit OR early").select(
            *STRETCH, "row_no", "comparable", F.size("matched_columns").cast("long").alias("matched"), "matched_columns", "early"))
        sheets = durable(found.filter("early").select("file_id").unionByName(self._stretches.select("file_id")).distinct())
        if sheets.isEmpty():
            return found.drop("early")
        return durable(found.drop("early").join(sheets, "file_id", "left_anti").unionByName(self._fold_sheets(sheets).select(*found.drop("early").columns)))

    def _fold_sheets(self, sheets: DataFrame) -> DataFrame:
        """The rows of ``sheets`` that restate the rows above them: a fold over a sheet's rows, in stretches side by side.

        What a stretch does depends on the rows before it only through a summary: for each column the sum of the kept
        values and whether there are enough of them. Each stretch is first folded as if all unlabelled rows before it
        were kept, and its own kept rows are summed up; the summaries added in order tell each stretch what really came
        before it. Stretches whose summary differs from what was assumed, as an unlabelled total stood before them, are
        folded again. A sheet of one stretch takes one pass; a later pass settles at least the first stretch that was
        wrong, so there are never more passes than stretches, and for rows that add up to nothing one is enough.
        """
        rows = durable(self.data.join(sheets, "file_id", "left_semi").select(*STRETCH, "row_no", "numbers", "second_header", "label"))
        own = rows.select(*STRETCH).distinct()
        several = durable(own.groupBy("file_id").agg(F.count(F.lit(1)).alias("stretches")).filter("stretches > 1"))
        later = durable(own.join(several.select("file_id"), "file_id", "left_semi"))
        plain = rows.filter("label IS NULL AND NOT second_header").join(several.select("file_id"), "file_id", "left_semi")
        assumed = plain.select(*STRETCH, F.posexplode("numbers").alias("col", "v")).filter("v IS NOT NULL").groupBy(*STRETCH, "col").agg(
            F.sum("v").alias("s"), F.count("v").alias("n"))
        entries = durable(self._carried(assumed.groupBy(*STRETCH).agg(F.collect_list(F.struct("col", "s", "n")).alias("kept")), later))
        done = durable(self._folded(rows, entries))
        most = several.agg(F.max("stretches")).first()[0] or 0
        for _ in range(most):
            now = durable(self._carried(done.join(later, STRETCH, "left_semi"), later))
            old = entries.withColumnRenamed("entry", "before")
            same = F.coalesce(F.forall(F.zip_with("entry", "before", _same_start), lambda x: x), F.lit(False))
            changed = durable(now.join(old, STRETCH, "full").filter(~same).select(*STRETCH))
            if not changed.count():
                break
            again = self._folded(rows.join(changed, STRETCH, "left_semi"), now)
            entries, done = now, durable(done.join(changed, STRETCH, "left_anti").unionByName(again))
        return done.select(*STRETCH, F.inline("found"))

    def arithmetic_match(self) -> DataFrame:
        return self.arithmetic.select("file_id", "row_no", "comparable", "matched", "matched_columns")

    # -- classification -----------------------------------------------------

    @cached_property
    def classified(self) -> DataFrame:
        """The data rows that are not observations, with reason and confidence."""
        nothing = F.lit(None)
        rows = self.data.select(*STRETCH, "row_no", F.lit(False).alias("match"), "cells", "label", "second_header",
                                nothing.cast("array<int>").alias("matched_columns"))
        matches = self.arithmetic.select(
            *STRETCH, "row_no", F.lit(True).alias("match"), nothing.cast("array<string>").alias("cells"),
            nothing.cast("string").alias("label"), F.lit(False).alias("second_header"), "matched_columns")
        # A row's match is laid right after it, so that all steps share one layout by stretch.
        after = W.partitionBy(*STRETCH).orderBy("row_no", "match")
        flagged = rows.unionByName(matches).repartition(*STRETCH).withColumn("matched_columns", F.lead("matched_columns").over(after)).filter("NOT match")
        # The last data row of a sheet of several stretches, told to each of them.
        last = self.data.select("file_id", "chunk", "row_no").filter("chunk > 0").groupBy("file_id").agg(F.max("row_no").alias("last_row"))
        last = self._stretches.join(last, "file_id")
        arithmetic, label = F.col("matched_columns").isNotNull(), F.col("label").isNotNull()
        flagged = flagged.join(last, STRETCH, "left")
        trailing = F.col("row_no") == F.coalesce("last_row", F.max("row_no").over(W.partitionBy(*STRETCH)))
        confidence = (
            F.when(F.col("second_header"), "uncertain").when(label & arithmetic, "certain")
            .when(arithmetic & F.col("trailing"), "confident").when(arithmetic | label, "uncertain"))
        flagged = flagged.withColumn("trailing", trailing).withColumn("confidence", confidence)
        kept = F.when(F.col("confidence").isNull(), F.col("row_no"))
        inner = W.partitionBy(*STRETCH).orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
        reason = F.when(F.col("second_header"), "second header").when(F.col("confidence").isNotNull(), "aggregate")
        whole = W.partitionBy(*STRETCH)
        found = durable(flagged.select(
            *STRETCH, "row_no", "cells", "label", "matched_columns", "trailing", "confidence", reason.alias("reason"),
            F.min(kept).over(inner).alias("lo1"), F.max(kept).over(inner).alias("hi1"), F.min(kept).over(whole).alias("lo"),
            F.max(kept).over(whole).alias("hi"), (F.row_number().over(W.partitionBy(*STRETCH).orderBy("row_no")) == 1).alias("starts"),
            (F.col("last_row").isNotNull()).alias("several")).filter("reason IS NOT NULL OR (starts AND several)"))
        earlier = W.partitionBy("file_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        carried = found.filter("starts AND several").select(
            *STRETCH, F.min("lo").over(earlier).alias("lo0"), F.max("hi").over(earlier).alias("hi0"))
        return durable(found.filter("reason IS NOT NULL").join(carried, STRETCH, "left").select(
            *STRETCH, "row_no", "cells", "label", "matched_columns", "trailing", "confidence", "reason",
            F.least("lo0", "lo1").alias("first_above"), F.greatest("hi0", "hi1").alias("last_above")))

    def classify_rows(self) -> DataFrame:
        return self.classified.select("file_id", "row_no", "reason", "confidence", "label")

    @cached_property
    def header_names(self) -> DataFrame:
        """Trimmed header cells per sheet, blanks as empty text."""
        heads = self.rows.filter(F.col("row_no") <= self._deepest).join(self._by_stretch("header_row"), STRETCH).filter("row_no = header_row")
        return heads.select("file_id", F.transform(
            "cells", lambda c: F.when(V.is_missing(c, TEXT), "").otherwise(V.trimmed(c))).alias("names"))

    def preamble_rows(self) -> DataFrame:
        rows = self.rows.filter(~F.col("blank") & (F.col("row_no") < self._deepest)).join(self._by_stretch("header_row", "certain"), STRETCH)
        return rows.filter("row_no < header_row").select(
            "file_id", "row_no", F.lit("preamble").alias("reason"),
            F.when(F.col("certain"), "confident").otherwise("uncertain").alias("confidence"),
            F.lit("above the header row").alias("detail"), F.lit(None).cast("string").alias("label"),
            preview(F.col("cells")).alias("cells"))

    @cached_property
    def set_aside(self) -> DataFrame:
        """Every row that is not an observation, with why, how sure, and whether it was put back."""
        found = self.classified
        heads = self._by_stretch("include_rows").join(self.header_names, "file_id")
        found = found.join(heads, STRETCH)
        names = F.transform("matched_columns", lambda c: F.coalesce(
            F.try_element_at("names", c + 1), F.concat(F.lit("column "), c + 1)))
        n = F.size("matched_columns")
        joined = F.when(n == 1, F.element_at(names, 1)).otherwise(F.concat(
            F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "),
            F.try_element_at(names, F.lit(-1))))
        sums = F.concat(
            joined, F.when(n > 1, " equal").otherwise(" equals"), F.lit(" the sum of rows "),
            F.col("first_above"), F.lit("–"), F.col("last_above"))
        labelled = F.concat(F.lit('labelled "'), F.col("label"), F.lit('"'),
                            F.when(F.col("trailing"), " in the final row").otherwise(""))
        detail = (F.when(F.col("reason") == "second header", SECOND_HEADER_DETAIL)
                  .when(F.col("matched_columns").isNotNull(), sums).otherwise(labelled))
        back = (F.col("reason") == "aggregate") & F.array_contains("include_rows", F.col("row_no"))
        aggregates = found.select(
            "file_id", "row_no", "reason", "confidence", detail.alias("detail"), "label",
            preview(F.col("cells")).alias("cells"), back.alias("restored"))
        return self.preamble_rows().withColumn("restored", F.lit(False)).unionByName(aggregates)

    def unapplied(self) -> DataFrame:
        """Corrections that did not take, and why."""
        asked = self.headers.filter("header_row IS NOT NULL")
        headers = asked.filter("asked_header IS NOT NULL AND NOT specified").select(
            "file_id", F.col("asked_header").alias("row_no"), F.lit("header row is outside the file").alias("reason"),
            F.lit("headerRow").alias("correction"))
        rows = asked.select("file_id", "rows_total", "header_row", F.explode(F.array_distinct("include_rows")).alias("row_no"))
        restored = self.set_aside.filter("restored").select("file_id", "row_no")
        why = (F.when(F.col("row_no") > F.col("rows_total"), "outside the file")
               .when(F.col("row_no") <= F.col("header_row"), "at or above the header row")
               .otherwise("not an excluded row"))
        left = rows.join(restored, ["file_id", "row_no"], "left_anti").select(
            "file_id", "row_no", why.alias("reason"), F.lit(None).cast("string").alias("correction"))
        return headers.unionByName(left)

    # -- transposition ------------------------------------------------------

    def detect_transpose(self) -> DataFrame:
        """Sheets whose columns mix magnitudes while their rows agree; medians are compared by counting."""
        data = self.data.filter(F.col("width") >= TRANSPOSE_COLUMNS + 1)
        head = F.try_element_at("cells", F.lit(1))
        text = ~V.is_missing(head, TEXT) & V.to_number(head, TEXT).isNull()
        block = F.slice("numbers", F.lit(2), F.col("width") - 1)
        numeric = F.size(F.filter(block, lambda n: n.isNotNull()))
        filled = F.size(F.filter(F.slice("cells", F.lit(2), F.col("width") - 1), lambda c: ~V.is_missing(c, TEXT)))
        shape = data.groupBy("file_id").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~V.is_missing(head, TEXT)).alias("labels"),
            F.count_if(text).alias("textual"), F.sum(numeric).alias("numeric_cells"), F.sum(filled).alias("present_cells"))
        distinct = data.filter(text).groupBy("file_id", F.lower(V.trimmed(head)).alias("w")).agg(F.count(F.lit(1))).groupBy(
            "file_id").agg(F.count(F.lit(1)).alias("distinct"))
        cells = data.select("file_id", "chunk", "row_no", F.posexplode(block).alias("col", "value")).filter(
            "value IS NOT NULL")
        size = F.when(F.col("value") != 0, F.log10(F.abs("value")))
        spread = F.when(F.count(size) >= 2, F.stddev_pop(size)).alias("spread")
        columns = cells.groupBy("file_id", "col").agg(spread).groupBy("file_id").agg(
            F.count(F.lit(1)).alias("numeric_columns"), F.percentile("spread", 0.5).alias("column_spread"))
        sheet = shape.join(distinct, "file_id").join(columns, "file_id").filter(
            (F.col("rows") >= TRANSPOSE_ROWS) & (F.col("labels") >= F.col("rows") * TRANSPOSE_LABELS)
            & (F.col("textual") >= F.col("labels") * TRANSPOSE_LABELS)
            & (F.col("distinct") >= F.col("textual") * TRANSPOSE_LABELS)
            & (F.col("numeric_columns") >= TRANSPOSE_COLUMNS) & (F.col("present_cells") > 0)
            & (F.col("numeric_cells") >= F.col("present_cells") * TRANSPOSE_NUMBERS)
            & (F.col("column_spread") >= TRANSPOSE_SPREAD))
        limit = self._by_stretch().join(
            sheet.select("file_id", (F.col("column_spread") / TRANSPOSE_RATIO).alias("most")), "file_id")
        rows = cells.groupBy("file_id", "chunk", "row_no").agg(spread).filter("spread IS NOT NULL").join(limit, STRETCH)
        under = F.col("spread") <= F.col("most")
        counted = rows.groupBy("file_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(under).alias("k"), F.max(F.when(under, F.col("spread"))).alias("lo"),
            F.min(F.when(~under, F.col("spread"))).alias("hi"), F.max("most").alias("most"))
        half = F.floor(F.col("n") / 2)
        odd = F.col("n") % 2 == 1
        at_most = (
            F.when(odd | (F.col("k") != half), F.col("k") >= half + 1)
            .otherwise((F.col("lo") + F.col("hi")) / 2 <= F.col("most")))
        return counted.filter(at_most).select(
            "file_id", F.lit("possible-transpose").alias("kind"), F.lit(TRANSPOSE_DETAIL).alias("detail"))

    # -- the report and the table -------------------------------------------

    def structure_report(self) -> DataFrame:
        """One row per sheet: header, confidence, observations, and how much was set aside or left open.

        The rows themselves stay in ``set_aside`` and ``unapplied``, one row each, as a sheet may have any number.
        """
        aside = self.set_aside.groupBy("file_id").agg(
            F.count_if(~F.col("restored")).alias("excluded"), F.count_if("restored").alias("restored"),
            F.count_if(~F.col("restored") & (F.col("reason") != "preamble")).alias("dropped"),
            F.bool_or(~F.col("restored") & (F.col("confidence") == "uncertain")).alias("doubtful"))
        observed = self.data.groupBy("file_id").agg(F.count(F.lit(1)).alias("data_rows"))
        unapplied = self.unapplied().groupBy("file_id").agg(F.count(F.lit(1)).alias("unapplied"))
        warnings = self.detect_transpose().groupBy("file_id").agg(
            F.collect_list(F.struct("kind", "detail")).alias("warnings"))
        out = self.headers
        for part in (aside, observed, unapplied, warnings):
            out = out.join(part, "file_id", "left")
        def size(c):
            return F.coalesce(c, F.lit(0))

        uncertain = (
            ~F.col("certain") | F.col("unapplied").isNotNull() | F.col("warnings").isNotNull()
            | F.coalesce("doubtful", F.lit(False)))
        untouched = (F.col("header_row") == 1) & (size("excluded") == 0) & (size("restored") == 0) & ~F.col("specified")
        return out.select(
            "file_id", "header_row", F.when(F.col("specified"), "specified").otherwise("detected").alias("header_source"),
            F.when(F.col("header_row").isNull(), "none").when(uncertain, "uncertain").when(untouched, "none")
            .otherwise("confident").alias("confidence"),
            (size("data_rows") - size("dropped")).alias("observations"),
            *[size(c).alias(c) for c in ("excluded", "restored", "unapplied")],
            F.coalesce("others", F.array()).alias("alternatives"), F.coalesce("warnings", F.array()).alias("warnings"))

    def name_columns(self) -> DataFrame:
        """One unique name per column: repeats get ``_1``, ``_2``; blanks take their column letter."""
        reach = self.headers.select("file_id", "reach")
        heads = self.header_names.join(reach, "file_id").select(
            "file_id", F.concat("names", F.array_repeat(F.lit(""), F.greatest(F.col("reach") - F.size("names"), F.lit(0)))).alias("names"))

        def first_free(options: Column, taken: Column) -> Column:
            return F.element_at(F.filter(options, lambda o: ~F.array_contains(taken, o)), 1)

        def repeat(done: Column, name: Column) -> Column:
            tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.concat(name, F.lit("_"), k))
            return F.concat(done, F.array(F.when(
                (name != "") & F.array_contains(done, name), first_free(tries, done)).otherwise(name)))

        def letters(i: Column) -> Column:
            def one(k):
                return F.char((k % 26 + 65).cast("long"))
            second, third = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
            return (F.when(i < 26, one(i)).when(i < 702, F.concat(one(second), one(i)))
                    .otherwise(F.concat(one(third), one(second), one(i))))

        def fill(done: Column, name: Column, i: Column) -> Column:
            base = F.concat(F.lit("Column "), letters(i))
            tries = F.concat(F.array(base), F.transform(
                F.sequence(F.lit(2), F.size("named") + 2), lambda k: F.concat(base, F.lit(" ("), k, F.lit(")"))))
            return F.when(name == "", first_free(tries, F.col("named"))).otherwise(name)

        named = heads.select("file_id", F.aggregate(
            "names", F.array().cast("array<string>"), repeat).alias("named"))
        return named.select("file_id", F.transform("named", lambda name, i: fill(None, name, i)).alias("columns"))

    def data_rows(self) -> DataFrame:
        """The observations: ``file_id, row_no, values`` with each cell under its column's name."""
        gone = self.set_aside.filter("NOT restored").select("file_id", "row_no")
        names = self._by_stretch().join(self.name_columns(), "file_id")
        rows = self.data.join(gone, ["file_id", "row_no"], "left_anti").join(names, STRETCH)
        width = F.size("columns")
        padded = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width)
        return rows.select("file_id", "row_no", F.map_from_arrays("columns", padded).alias("values"))
