"""A DataFrame read as a table of cells, plus the facts that shape later plans.

``Table`` never holds rows. The only thing it brings to the driver is one record
per column (counts, types, fences), so its footprint follows the column count.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T

from ..functions import dates as D, values as V
from ..session import durable

# --- fixed values -----------------------------------------------------------
NUMERIC_SHARE = 0.5
DATE_SHARE = 0.8
# ----------------------------------------------------------------------------
COLUMNS_PER_SCAN = 60
SMALL_COLUMN = 200_000
# Text columns with at most so many distinct cells (by estimate) are read once a text instead of once a row.
FEW_TEXTS = 10_000
MOMENTS = ("min", "max", "mean", "std_pop", "var_samp")


class UnknownColumn(ValueError):
    pass


def chunks(items, size):
    items = list(items)
    return [items[i:i + size] for i in range(0, len(items), size)]


def settle(facts: DataFrame) -> DataFrame:
    """Fact rows computed now and kept as they are; only for frames of a few rows per column or table.

    Later frames then start from the finished numbers instead of repeating the plan behind them.
    """
    return facts.sparkSession.createDataFrame(facts.collect(), facts.schema)


def facts_by_column(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One global aggregate per column struct, turned from one wide row into one row per column."""
    parts = [
        df.agg(F.array(*part).alias("facts")).select(F.inline("facts"))
        for part in chunks(structs, COLUMNS_PER_SCAN)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_text(cells: DataFrame, *keys: str) -> DataFrame:
    """``text`` cells with the number, kind, moment and notations read from them.

    One select per step: a later step then names an earlier result instead of holding
    a copy of its expression, which keeps the generated code small.
    """
    kept = [c for c in cells.columns if c != "text"]
    t = F.col("t")
    steps = cells.select(*kept, V.trimmed(F.col("text")).alias("t"))
    steps = steps.select(*kept, "t", F.coalesce(t == "", F.lit(True)).alias("blank"),
                         t.rlike(V.NUMBER_START).alias("digits"), t.rlike(V.DATE_START).alias("dated"))
    steps = steps.select(
        *kept, "t", "blank", "dated", F.when(F.col("digits"), V.number_from(t)).alias("number"))
    steps = steps.select(
        *kept, "t", "blank", "dated", "number", F.col("number").isNotNull().alias("read"),
        F.when(F.col("dated"), D.date_from(t)).alias("moment"))
    by_shape = t.rlike(V.KIND_DATE_SHAPES[0]) | t.rlike(V.KIND_DATE_SHAPES[1]) | t.rlike(V.KIND_DATE_SHAPES[2])
    kind = (F.when(F.col("blank"), "missing").when(F.col("read"), "numeric")
            .when(F.col("dated") & by_shape, "date").otherwise("text"))
    steps = steps.select(*kept, "t", "number", "moment", kind.alias("kind"),
                         (F.col("read") & ~t.rlike(V.PLAIN_NUMBER)).alias("marked"))
    return steps.select(*kept, "number", "moment", "kind", *[
        F.coalesce(F.col("marked") & mark, F.lit(False)).alias(f"f{i}") for i, mark in enumerate(V.format_marks(t))])


class Table:
    """``row_id`` names a unique, ordered long column; operators that speak of row
    order refuse to run without one."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, row_id: str | None = None):
        self.row_id = row_id
        hidden = {row_id} if row_id and columns is None else set()
        self.df = df
        self.columns = [c for c in (columns or df.columns) if c not in hidden]
        self.types = {f.name: f.dataType for f in df.schema.fields}

    @property
    def spark(self):
        return self.df.sparkSession

    def raw(self, column: str) -> Column:
        return F.col(V.quoted(column))

    def missing(self, column: str) -> Column:
        return V.is_missing(self.raw(column), self.types[column])

    def number(self, column: str) -> Column:
        return V.to_number(self.raw(column), self.types[column])

    def moment(self, column: str) -> Column:
        return D.to_date(self.raw(column), self.types[column])

    def level(self, column: str) -> Column:
        return V.level_of(self.raw(column), self.types[column])

    def kind(self, column: str) -> Column:
        return V.classify_value(self.raw(column), self.types[column])

    def order_column(self) -> Column:
        if self.row_id is None:
            raise ValueError("this operator speaks of row order: name a unique, ordered row_id")
        return F.col(V.quoted(self.row_id))

    def require(self, columns) -> list[str]:
        unknown = [c for c in columns if c not in self.columns]
        if unknown:
            raise UnknownColumn(f"Unknown column{'s' if len(unknown) > 1 else ''}: {', '.join(unknown[:5])}.")
        return list(columns)

    def where(self, condition: Column) -> "Table":
        return Table(self.df.filter(condition), self.columns, self.row_id)

    def numbers(self, columns: list[str], *extra: Column) -> DataFrame:
        """The number read from each cell, under the column's own name, parsed once."""
        text = [c for c in columns if isinstance(self.types[c], T.StringType)]
        # Text is trimmed in a step of its own, as the reading names it many times.
        cells = self.df.select(*[x.alias(f"_extra{i}") for i, x in enumerate(extra)], *[
            (V.trimmed(self.raw(c)) if c in text else self.number(c)).alias(c) for c in columns]) if text else None
        if cells is None:
            return self.df.select(*extra, *[self.number(c).alias(c) for c in columns])
        named = self.df.limit(0).select(*extra).columns
        return cells.select(*[F.col(f"_extra{i}").alias(n) for i, n in enumerate(named)], *[
            (V.number_trimmed(F.col(V.quoted(c))) if c in text else F.col(V.quoted(c))).alias(c) for c in columns])

    # -- pass 1: one record per column ---------------------------------------

    def _typed_struct(self, position: int, column: str) -> Column:
        """Facts of a column whose Spark type already says what its cells are."""
        dtype, raw = self.types[column], self.raw(column)
        num = F.col(V.quoted(column)) if V.is_numeric_type(dtype) else F.lit(None).cast("double")
        present = F.count(F.col(V.quoted(column)))
        zero = F.lit(0).cast("long")
        kind = ("numeric" if V.is_numeric_type(dtype) else "date" if V.is_time_type(dtype)
                else "boolean" if isinstance(dtype, T.BooleanType) else "text")
        at = raw if V.is_time_type(dtype) else F.lit(None).cast("timestamp_ntz")
        moments = [F.min(num), F.max(num), F.avg(num), F.stddev_pop(num), F.var_samp(num)]
        if kind != "numeric":
            moments = [F.lit(None).cast("double")] * 5
        ends = [F.min(at), F.max(at)] if kind == "date" else [F.lit(None).cast("timestamp_ntz")] * 2
        return F.struct(
            F.lit(position).alias("position"), F.lit(column).alias("column"),
            F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - present).alias("missing"),
            (present if kind == "numeric" else zero).alias("numbers"),
            (present if kind == "date" else zero).alias("dates"),
            *[(present if kind == k else zero).alias(f"{k}_cells") for k in V.KINDS],
            *[m.alias(n) for m, n in zip(moments, MOMENTS)],
            ends[0].alias("earliest"), ends[1].alias("latest"),
            F.array().cast("array<string>").alias("formats"))

    def _typed_facts(self, columns: list[str]) -> DataFrame:
        cells = []
        for c in columns:
            dtype = self.types[c]
            if V.is_numeric_type(dtype):
                cells.append(self.number(c).alias(c))
            elif V.is_time_type(dtype):
                cells.append(self.moment(c).alias(c))
            else:
                cells.append(self.raw(c))
        structs = [self._typed_struct(self.columns.index(c), c) for c in columns]
        return facts_by_column(self.df.select(*cells), structs)

    def _few_texts(self, columns: list[str]) -> list[str]:
        found = {}
        for part in chunks(columns, COLUMNS_PER_SCAN):
            found |= dict(zip(part, self.df.agg(*[F.approx_count_distinct(self.raw(c)) for c in part]).first()))
        return [c for c in columns if found[c] <= FEW_TEXTS]

    def _text_facts(self, columns: list[str], few: bool) -> DataFrame:
        """Facts of text columns: cells are read in long form, so each is parsed once by one short plan.

        Columns of ``few`` texts are counted first, and each text is parsed once.
        """
        cells = self.df.select(F.posexplode(F.array(*[self.raw(c) for c in columns])).alias("at", "text"))
        if few:
            read = read_text(cells.groupBy("at", "text").agg(F.count(F.lit(1)).alias("times")))
        else:
            read = read_text(cells)
        n, k, d = F.col("number"), F.col("kind"), F.col("moment")
        rows, count, moments = F.count(F.lit(1)), F.count_if, (F.avg(n), F.stddev_pop(n), F.var_samp(n))
        if few:
            # Moments about the mean, found from the least number, so that equal numbers have no spread.
            times, of = F.col("times"), W.partitionBy("at")
            size = F.sum(F.when(n.isNotNull(), times))
            read = read.withColumn("least", F.min("number").over(of))
            read = read.withColumn("mean", F.col("least") + F.sum(times * (n - F.col("least"))).over(of) / size.over(of))
            squares = F.sum(times * F.pow(n - F.col("mean"), 2))
            rows, count = F.sum(times), lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0).cast("long"))
            moments = (F.max("mean"), F.sqrt(squares / size), F.when(size > 1, squares / (size - 1)))
        flags = [F.bool_or(F.col(f"f{i}")) for i in range(len(V.NUMBER_FORMATS))]
        named = F.filter(
            F.array(*[F.when(flag, F.lit(name)) for flag, name in zip(flags, V.NUMBER_FORMATS)]),
            lambda name: name.isNotNull())
        names = F.array(*[F.lit(c) for c in columns])
        places = F.array(*[F.lit(self.columns.index(c)) for c in columns])
        grouped = read.groupBy("at").agg(
            rows.alias("row_count"), count(k == "missing").alias("missing"),
            count(n.isNotNull()).alias("numbers"), count(d.isNotNull()).alias("dates"),
            *[count(k == kind).alias(f"{kind}_cells") for kind in V.KINDS],
            *[m.alias(name) for m, name in zip((F.min(n), F.max(n), *moments), MOMENTS)],
            F.min(d).alias("earliest"), F.max(d).alias("latest"), named.alias("formats"))
        return grouped.select(
            F.element_at(places, F.col("at") + 1).alias("position"), F.element_at(names, F.col("at") + 1).alias("column"),
            *[c for c in grouped.columns if c != "at"])

    def column_facts(self) -> DataFrame:
        """Counts, kinds, moments and both type rules, one row per column; each column is read once."""
        text = [c for c in self.columns if isinstance(self.types[c], T.StringType)]
        typed = [c for c in self.columns if c not in text]
        parts = [self._typed_facts(part) for part in chunks(typed, COLUMNS_PER_SCAN)]
        few = self._few_texts(text) if text else []
        parts += [self._text_facts(part, True) for part in chunks(few, COLUMNS_PER_SCAN)]
        parts += [self._text_facts(part, False) for part in chunks([c for c in text if c not in few], COLUMNS_PER_SCAN)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return with_types(out)

    @cached_property
    def facts(self) -> dict[str, Row]:
        rows = {row["column"]: row for row in self.column_facts().collect()}
        if len(rows) < len(self.columns):
            # Grouping an empty table gives no record for its text columns.
            empty = Table(self.df.limit(0).select(*[F.lit(None).cast("double").alias(c) for c in self.columns]))
            rows = {**{r["column"]: r for r in empty.column_facts().collect()}, **rows}
        return {c: rows[c] for c in self.columns}

    @cached_property
    def readings(self) -> DataFrame:
        """The numbers of every numeric column. Where some come from text, they are parsed once and written."""
        numeric = self.of_type("numeric")
        rows = self.numbers(numeric)
        return durable(rows) if any(isinstance(self.types[c], T.StringType) for c in numeric) else rows

    @cached_property
    def _estimates(self) -> dict[str, int]:
        numeric = self.of_type("numeric")
        row = self.readings.agg(*[
            F.approx_count_distinct(F.col(V.quoted(c))).alias(f"d{i}") for i, c in enumerate(numeric)]).first()
        return {c: row[f"d{i}"] for i, c in enumerate(numeric)}

    def distinct_bound(self, column: str) -> int:
        """A safe upper bound on a numeric column's distinct values; small columns need no scan."""
        n = self.facts[column].numbers
        return n if n <= SMALL_COLUMN else min(n, 2 * self._estimates[column])

    @property
    def row_count(self) -> int:
        return next(iter(self.facts.values())).row_count if self.columns else 0

    def of_type(self, stat_type: str) -> list[str]:
        return [c for c in self.columns if self.facts[c].stat_type == stat_type]


def with_types(facts: DataFrame) -> DataFrame:
    """Adds the two type rules, which differ on purpose and are reported side by side.

    ``stat_type``: numeric from half of the present cells, else date from 80 %, else
    categorical. ``quality_type``: the leading kind if it holds 80 %, else mixed.
    """
    present = F.col("row_count") - F.col("missing")
    lead = F.greatest(*[F.col(f"{k}_cells") for k in V.KINDS])
    leading = F
    for kind in V.KINDS:
        leading = leading.when(F.col(f"{kind}_cells") == lead, F.lit(kind))
    consistency = F.coalesce(F.try_divide(lead, present), F.lit(1.0))
    return facts.select(
        "*",
        present.alias("present"),
        F.when(present == 0, "empty")
        .when((F.col("numbers") > 0) & (F.col("numbers") >= present * NUMERIC_SHARE), "numeric")
        .when(F.col("dates") >= present * DATE_SHARE, "date")
        .otherwise("categorical").alias("stat_type"),
        F.when(present == 0, "empty").when(consistency >= 0.8, leading).otherwise("mixed").alias("quality_type"),
        F.round(consistency, 3).alias("type_consistency"),
    )


def select_columns(df: DataFrame, requested: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The requested columns in table order, and the names left out."""
    wanted = {name.strip() for name in requested or [] if name.strip()}
    if requested is not None and not wanted:
        raise ValueError("Select at least one column to analyze.")
    if not wanted:
        return df, []
    unknown = [name for name in dict.fromkeys(n.strip() for n in requested) if name and name not in df.columns]
    if unknown:
        raise UnknownColumn(f"Unknown column{'s' if len(unknown) > 1 else ''}: {', '.join(unknown[:5])}.")
    kept = [c for c in df.columns if c in wanted]
    return df.select(*[V.quoted(c) for c in kept]), [c for c in df.columns if c not in wanted]


def resolve_target(target: str | None, columns: list[str], *, strict: bool = True) -> str | None:
    """A named target must exist for a single table; in a batch it is used where present."""
    if target is None or target in columns:
        return target
    if strict:
        raise UnknownColumn(f'Target column "{target}" is not in this table.')
    return None


def drop_heavy_fields(result: DataFrame) -> DataFrame:
    """A result without its row-level payloads: each array of rows becomes its count."""
    out = []
    for field in result.schema.fields:
        c = F.col(V.quoted(field.name))
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            out.append(F.coalesce(F.size(c), F.lit(0)).alias(f"{field.name}_reported"))
        else:
            out.append(c)
    return result.select(*out)


# -- inclusion predicates: the reason a row is left out, null where it is kept ----

def numeric_reason(table: Table, column: str) -> Column:
    return (
        F.when(table.missing(column), f"missing {column}")
        .when(table.number(column).isNull(), f"non-numeric {column}")
    )


def date_reason(table: Table, column: str) -> Column:
    return (
        F.when(table.missing(column), f"missing {column}")
        .when(table.moment(column).isNull(), f"invalid date {column}")
    )


def present_reason(table: Table, column: str) -> Column:
    return F.when(table.missing(column), f"missing {column}")


def level_reason(table: Table, column: str, levels: list[str]) -> Column:
    return (
        F.when(table.missing(column), f"missing {column}")
        .when(~table.level(column).isin(levels), f"{column} outside retained groups")
    )


def period_reason(table: Table, column: str, periods: list[str], grain: str) -> Column:
    moment = table.moment(column)
    return (
        F.when(moment.isNull(), f"invalid date {column}")
        .when(~D.period_key(moment, grain).isin(periods), f"{column} outside compared periods")
    )
