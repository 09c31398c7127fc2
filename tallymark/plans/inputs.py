"""Tables as the checks read them: the given parquet tables, and messy forms Spark derives from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.profile import Profile
from ..operators.table import Table
from ..session import ensure_checkpoint_dir, prepare


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark, sf_dir, name, columns=None, row_id=None) -> Table:
    return Table(load(spark, sf_dir, name), columns, row_id)


def profile(spark, sf_dir, name, columns=None, row_id=None) -> Profile:
    return Profile(table(spark, sf_dir, name, columns, row_id))


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def money(column: str) -> str:
    return f"format_number({column}, 2)"


def messy_lineitem(spark, sf_dir) -> DataFrame:
    """lineitem with a price as people type it, a date in three spellings, and a column with gaps."""
    li = load(spark, sf_dir, "lineitem")
    price = F.expr(f"""
        CASE l_orderkey % 5
          WHEN 0 THEN concat('$', {money('l_extendedprice')})
          WHEN 1 THEN concat('(', {money('l_extendedprice')}, ')')
          WHEN 2 THEN concat(cast(cast(round(l_discount * 100) AS int) AS string), '%')
          WHEN 3 THEN 'n/a' ELSE '  ' END""")
    ship = F.expr("""
        CASE l_linenumber % 3 WHEN 0 THEN date_format(l_shipdate, 'yyyy-MM-dd')
          WHEN 1 THEN date_format(l_shipdate, 'M/d/yyyy') ELSE date_format(l_shipdate, 'MMM d, yyyy') END""")
    return li.select(
        "*", price.alias("price_text"), ship.alias("ship_text"),
        F.expr("CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END").alias("gappy_quantity"),
        F.expr("CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice + 9000 * l_quantity END").alias("gappy_price"),
        F.expr("CASE WHEN l_extendedprice < 60000 THEN l_tax END").alias("gappy_tax"))


def gappy_orders(spark, sf_dir) -> DataFrame:
    """orders with planted signals: a gap tied to price, and a price that depends on the status."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
        F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice + CASE o_orderstatus WHEN 'F' THEN 150000 "
               "WHEN 'P' THEN 60000 ELSE 0 END END").alias("price"),
        F.expr("CASE WHEN o_totalprice < 300000 THEN o_custkey % 10 END").alias("tier"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN substr(o_orderpriority, 1, 1) ELSE o_orderstatus END").alias("mix"))


def sides(spark, sf_dir) -> tuple[Profile, Profile]:
    """lineitem before and from 1998: a column dropped, a column added, a price raised, a flag renamed."""
    li = load(spark, sf_dir, "lineitem")
    old = li.filter("l_shipdate < '1998-01-01'").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
        F.col("l_tax").cast("string").alias("code"))
    new = li.filter("l_shipdate >= '1998-01-01'").select(
        "l_quantity", (F.col("l_extendedprice") * 1.25).alias("l_extendedprice"),
        F.expr("CASE WHEN l_linenumber < 3 THEN 'A' ELSE l_returnflag END").alias("l_returnflag"),
        "l_linestatus", "l_tax", F.concat(F.lit("T"), F.col("l_tax").cast("string")).alias("code"))
    return Profile(Table(old)), Profile(Table(new))


def _sheet_rows(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("file_id"), "o_custkey", F.row_number().over(w).cast("long").alias("rn"),
        F.concat(F.lit("O-"), "o_orderkey").alias("a"), F.col("o_orderstatus").alias("b"), "o_totalprice")


def _sheet(df: DataFrame, row_no, *cells) -> DataFrame:
    return df.select("file_id", F.lit(row_no).cast("long").alias("row_no") if isinstance(row_no, int)
                     else row_no.alias("row_no"),
                     F.array(*[(F.lit(c) if c is None or isinstance(c, str) else c).cast("string") for c in cells])
                     .alias("cells"))


def order_sheets(spark, sf_dir) -> DataFrame:
    """One raw sheet per customer: title, blank, header, its orders, and a last row with the total.

    By customer the last row is a right ``TOTAL``, a right sum without the word, or a wrong ``TOTAL``.
    """
    of = W.partitionBy("o_custkey")
    rows = _sheet_rows(spark, sf_dir).select("*", F.count(F.lit(1)).over(of).alias("n"), F.sum("o_totalprice").over(of).alias("s"))
    wrong = F.when(F.col("o_custkey") % 3 == 2, 12345.5).otherwise(0.0)
    total = F.format_string("%.2f", F.col("s") + wrong)
    word = F.when(F.col("o_custkey") % 3 == 1, "all orders").otherwise("TOTAL")

    def line(row_no, *cells):
        return F.struct((F.lit(row_no) if isinstance(row_no, int) else row_no).cast("long").alias("row_no"), F.array(*[
            (F.lit(c) if c is None or isinstance(c, str) else c).cast("string") for c in cells]).alias("cells"))

    # The first order of a customer brings the lines that a sheet has once.
    own = line(F.col("rn") + 3, F.col("a"), F.col("b"), F.col("o_totalprice"))
    once = F.array(line(1, F.concat(F.lit("Orders of customer "), "o_custkey")), line(2, None, None, None),
                   line(3, "order", "status", "price"), own, line(F.col("n") + 4, word, None, total))
    return rows.select("file_id", F.inline(F.when(F.col("rn") == 1, once).otherwise(F.array(own))))


def double_sheets(spark, sf_dir) -> DataFrame:
    """One sheet per customer: its orders, a gap, and a second small table."""
    rows = _sheet_rows(spark, sf_dir)
    sizes = rows.groupBy("file_id").agg(F.max("rn").alias("n"))
    return (
        _sheet(sizes, 1, "order", "status", "price")
        .unionByName(_sheet(rows, F.col("rn") + 1, F.col("a"), F.col("b"), F.col("o_totalprice")))
        .unionByName(_sheet(sizes, F.col("n") + 2, None, None, None))
        .unionByName(_sheet(sizes, F.col("n") + 3, "item", "state", "amount"))
        .unionByName(_sheet(sizes, F.col("n") + 4, "box", "new", "7.25")))


def turned_sheets(spark, sf_dir) -> DataFrame:
    """One sheet per nation with the measures down the side and the market segments across."""
    by = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("c_acctbal")).alias("s"), F.avg(F.abs("c_acctbal")).alias("m"))
    cells = by.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n", "s", "m"))).alias("k"))
    cells = cells.withColumn("file_id", F.concat(F.lit("n"), "c_nationkey"))

    def measure(row_no, name, value):
        return cells.select("file_id", F.lit(row_no).cast("long").alias("row_no"), F.concat(
            F.array(F.lit(name)), F.transform("k", lambda x: value(x).cast("string"))).alias("cells"))

    head = measure(1, "measure", lambda x: x.c_mktsegment)
    return (head.unionByName(measure(2, "customers", lambda x: x.n))
            .unionByName(measure(3, "balance", lambda x: F.round(x.s * 100, 2)))
            .unionByName(measure(4, "mean share", lambda x: F.round(x.m / 10000, 6))))


def saved_analyses(spark, sf_dir) -> DataFrame:
    """orders in the shape of saved analyses."""
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("a"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("s"), F.col("o_custkey") % 50).alias("session_id"), F.col("o_orderstatus").alias("kind"),
        *[F.lit(None).cast("string").alias(c) for c in ("filename", "file_type", "model", "question")],
        F.col("o_totalprice").cast("string").alias("payload"))
