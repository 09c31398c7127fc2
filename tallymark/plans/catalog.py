"""Every operator as a named query over the given tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import dates as D, distributions as S, values as V
from ..operators import compare as M, correlate as C, infer as I, profile as P, quality as Q, rollups as U
from ..operators import sample as R, sheets as G, shifts as H, timeline as L
from ..operators.evidence import Evidence, rank_evidence
from ..operators.provenance import Provenance
from ..operators.ranks import grouped_quantiles, rank_average, with_position
from ..operators.table import (
    Table, UnknownColumn, date_reason, drop_heavy_fields, level_reason, numeric_reason, period_reason, present_reason,
    resolve_target as find_target, select_columns,
)
from ..session import durable
from ..sources import files as X, store as B
from . import inputs as N
from .analyze import profile_many

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TEXT = T.StringType()
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None, name: str | None = None):
    def register(make):
        key = name or make.__name__
        QUERIES[key] = make
        if sql is not None:
            ORACLE[key] = sql
        return make
    return register


# The SQL side builds the same messy table from the numbers it was made of.
MESSY = """m AS (SELECT *,
  CASE l_orderkey % 5 WHEN 0 THEN l_extendedprice WHEN 1 THEN -l_extendedprice
    WHEN 2 THEN round(l_discount * 100) END AS price_num, l_orderkey % 5 = 4 AS price_blank,
  CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS gappy_quantity,
  CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice + 9000 * l_quantity END AS gappy_price,
  CASE WHEN l_extendedprice < 60000 THEN l_tax END AS gappy_tax FROM lineitem)"""
GAPPY = """g AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice + CASE o_orderstatus WHEN 'F' THEN 150000 WHEN 'P' THEN 60000
    ELSE 0 END END AS price,
  CASE WHEN o_totalprice < 300000 THEN o_custkey % 10 END AS tier,
  CASE WHEN o_orderkey % 4 = 0 THEN substr(o_orderpriority, 1, 1) ELSE o_orderstatus END AS mix FROM orders)"""
LONG = """u AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)"""
EVENT_LONG = """u AS (SELECT 'user_id' AS "column", event_id, CAST(user_id AS DOUBLE) AS v FROM events
  UNION ALL SELECT 'value', event_id, value FROM events)"""
EVENT_FENCES = f"""{EVENT_LONG}, q AS (SELECT "column", count(v) AS n, min(v) AS lo, max(v) AS hi,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY 1),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"""
SHEET = """s AS (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1)"""


# -- scans ------------------------------------------------------------------------

@query("SELECT * FROM nation")
def scan_table(spark, sf):
    return X.scan_table(N.prepare(spark), f"{sf}/nation.parquet")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  o_orderpriority FROM orders""")
def scan_csv(spark, sf):
    path = N.scratch(spark)
    N.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").write.csv(path, header=True)
    return X.scan_csv(spark, path)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ', "' || c_mktsegment || '"' AS quoted,
  CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def scan_grid(spark, sf):
    path = N.scratch(spark)
    N.load(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("q"), "c_nationkey"
    ).write.csv(path, header=True, escape='"')
    grid = X.scan_grid(spark, path).filter("row_no > 1")
    return grid.select(*[F.try_element_at("cells", F.lit(i)).alias(c) for i, c in ((1, "key"), (2, "quoted"), (3, "nation"))])


@query("""SELECT p_partkey AS "key", p_size || '" pipe' AS bare, p_type || ' "x" ' || p_brand AS inner_quotes,
  p_brand || ', "new"' AS quoted, 4 + p_partkey % 3 AS width FROM part""")
def scan_grid_bare_quotes(spark, sf):
    """Quotes inside plain cells are text, those around a cell are not, and every row is as wide as it is."""
    path = N.scratch(spark)
    N.load(spark, sf, "part").select(F.concat(
        F.concat_ws(",", "p_partkey", F.concat("p_size", F.lit('" pipe')), F.concat("p_type", F.lit(' "x" '), "p_brand"),
                    F.concat(F.lit('"'), "p_brand", F.lit(', ""new"""'))),
        F.expr("repeat(',', int(p_partkey % 3))"))).write.text(path)
    grid = X.scan_grid(spark, path)
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return grid.select(cell(1).cast("long").alias("key"), cell(2).alias("bare"), cell(3).alias("inner_quotes"),
                       cell(4).alias("quoted"), F.size("cells").cast("long").alias("width"))


@query("""SELECT doc_id, nullif(text, '') AS text, source FROM documents""")
def scan_grid_long_text(spark, sf):
    """Whole documents as quoted cells: line ends, separators and quotes inside them stay text."""
    path = N.scratch(spark)
    N.load(spark, sf, "documents").select("doc_id", "text", "source").write.csv(
        path, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return X.scan_grid(spark, path).select(cell(1).cast("long").alias("doc_id"), cell(2).alias("text"), cell(3).alias("source"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_json(spark, sf):
    path = N.scratch(spark)
    N.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    return X.scan_json(spark, path, multi_line=False)


@query("""SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS "props.k", event_type AS "props.of.type"
  FROM events""")
def flatten_struct(spark, sf):
    of = F.struct(F.col("event_type").alias("type"))
    parsed = F.from_json("props", "k long")
    return X.flatten_struct(N.load(spark, sf, "events").select(
        "event_id", F.struct(parsed.k.alias("k"), of.alias("of")).alias("props")))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM conversations)
  SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM t""")
def split_lines(spark, sf):
    df = N.load(spark, sf, "conversations")
    out = X.split_lines(df, F.col("conv_id") * 1000 + F.col("turn"), F.col("text"))
    return out.select(F.col("file_id").alias("id"), F.col("line").cast("long").alias("line"), "content")


@query("""SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, c_name AS content
  FROM customer""")
def scan_lines(spark, sf):
    """One file a nation, its lines padded and every third followed by a blank one."""
    path = N.scratch(spark)
    rows = N.load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.concat(
        F.lit("  "), "c_name", F.lit("\t "), F.when(F.col("c_custkey") % 3 == 0, F.lit("\r\n \t")).otherwise(F.lit("\r"))).alias("value"))
    rows.repartition(5, "nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy(
        "nation").text(path)
    found = X.scan_lines(spark, path)
    nation = F.regexp_extract("file_id", "nation=([0-9]+)", 1).cast("int")
    return found.select(nation.alias("nation"), F.col("line").cast("long").alias("line"), "content")


@query("""SELECT turn, line, content FROM (SELECT 1 AS turn, 1 AS line, '' AS content) WHERE false UNION ALL
  SELECT 0, CAST(count(*) AS INTEGER), 'records' FROM customer UNION ALL SELECT 1, 2 * CAST(count(*) AS INTEGER), 'lines' FROM customer""")
def quoted_line_ends(spark, sf):
    """Cells holding a line end stay one record: records and lines of one written file set."""
    path = N.scratch(spark)
    N.load(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("two_lines")).write.csv(path, escape='"')
    lines = X.numbered_lines(spark, path)
    records = X.records(lines).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("records")).withColumn("t", F.lit(0))
    lines = lines.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("lines")).withColumn("t", F.lit(1))
    return records.unionByName(lines).select(
        F.col("t").alias("turn"), F.col("n").cast("int").alias("line"), F.col("what").alias("content"))


@query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey % 3 AS kind FROM customer)
  SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY c_custkey) AS line_no, c_name || ' é漢' AS line FROM c""")
def decode(spark, sf):
    """One file in each encoding, told by its mark: UTF-8, UTF-16 little and big end first."""
    path = N.scratch(spark)
    c = N.load(spark, sf, "customer").withColumn("kind", F.col("c_nationkey") % 3)
    place = F.row_number().over(W.partitionBy("kind").orderBy("c_custkey"))
    text = F.concat(F.when(place == 1, F.lit("﻿")).otherwise(""), "c_name", F.lit(" é漢"))
    rows = c.select("kind", "c_custkey", text.alias("value"))
    for kind, encoding in enumerate(("UTF-8", "UTF-16LE", "UTF-16BE")):
        rows.filter(F.col("kind") == kind).coalesce(1).sortWithinPartitions("c_custkey").select("value").write.csv(
            f"{path}/kind={kind}", encoding=encoding, quote="\x01", ignoreLeadingWhiteSpace=False)
    found = X.numbered_lines(spark, path)
    return found.select(F.regexp_extract("file_id", "kind=([0-9])", 1).cast("int").alias("kind"), "line_no", "line")


@query("""SELECT o_orderstatus AS dataset, 'ok' AS status, count(*) AS "rows" FROM orders GROUP BY 1
  UNION ALL SELECT 'missing', 'error', 0""")
def scan_many(spark, sf):
    path = N.scratch(spark)
    N.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus").repartition(3, "o_orderstatus").write.partitionBy(
        "o_orderstatus").csv(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(
        path).select("path")
    # One path per written file.
    _, status = X.scan_many(spark, [r.path.split("file:")[-1] for r in found.collect()] + [f"{path}/missing"])
    dataset = F.coalesce(F.nullif(F.regexp_extract("path", "o_orderstatus=([A-Z])", 1), F.lit("")), F.lit("missing"))
    return status.groupBy(dataset.alias("dataset"), "status").agg(F.sum("rows").alias("rows"))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_rows(spark, sf):
    return R.preview_rows(N.table(spark, sf, "orders", row_id="o_orderkey"))


CUTOFF = dt.datetime(1998, 6, 1)


SAVED = """saved AS (SELECT 'a' || o_orderkey AS id, o_orderdate AS created_at, 's' || (o_custkey % 50) AS session_id,
  o_orderstatus AS kind, o_orderkey AS k FROM orders)"""


def _store(spark, sf) -> B.AnalysisStore:
    """orders as saved analyses in a store of their own, partitioned by month."""
    keeper = B.AnalysisStore(spark, N.scratch(spark), "month")
    keeper.append(N.saved_analyses(spark, sf))
    return keeper


@query(f"""WITH {SAVED} SELECT id, created_at, kind FROM saved WHERE session_id = 's7' AND created_at >= TIMESTAMP '1998-06-01'
  ORDER BY created_at DESC, id LIMIT 20""")
def list_analyses(spark, sf):
    cutoff = B.retention_cutoff("30", CUTOFF + dt.timedelta(days=30))
    return _store(spark, sf).list("s7", cutoff).select("id", "created_at", "kind")


@query(f"""WITH {SAVED} SELECT id, created_at, kind FROM saved WHERE session_id = 's7'""")
def list_all_analyses(spark, sf):
    """Without retention and without the limit of the list."""
    return _store(spark, sf).list("s7", None, None).select("id", "created_at", "kind")


@query(f"""WITH {SAVED} SELECT id, kind, session_id, created_at FROM saved WHERE k % 10 = 3 AND created_at >= TIMESTAMP '1998-06-01'""")
def get_analysis(spark, sf):
    """Many ids asked for at once: inside and outside retention, and one that never was."""
    asked = N.load(spark, sf, "orders").filter("o_orderkey % 10 = 3").select(F.concat(F.lit("a"), "o_orderkey").alias("id"))
    asked = asked.unionByName(spark.createDataFrame([("never",)], "id string"))
    return _store(spark, sf).get(asked, CUTOFF).select("id", "kind", "session_id", "created_at")


@query(f"""WITH {SAVED}, left_over AS (SELECT * FROM saved WHERE NOT (session_id = 's7' AND created_at < TIMESTAMP '1998-06-01'))
  SELECT session_id, count(*) AS "rows", min(created_at) AS oldest, (SELECT count(*) FROM saved) - (SELECT count(*) FROM left_over)
  AS swept FROM left_over GROUP BY 1""")
def sweep_expired(spark, sf):
    """What each session still has on disk after one session's expired rows were swept."""
    keeper = _store(spark, sf)
    swept = keeper.sweep_expired("s7", CUTOFF)
    return keeper.saved().groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.min("created_at").alias("oldest")).withColumn(
        "swept", F.lit(swept).cast("long"))


@query(f"""WITH {SAVED} SELECT CAST(date_trunc('month', created_at) AS DATE) AS created_date, count(*) AS "rows" FROM saved
  WHERE created_at >= TIMESTAMP '1998-06-15' GROUP BY 1""")
def sweep_partitions(spark, sf):
    """After a sweep of all sessions whole partitions are gone, and the one the cutoff falls in is rewritten."""
    keeper = _store(spark, sf)
    keeper.sweep_expired(None, dt.datetime(1998, 6, 15))
    folder = F.regexp_extract("path", "created_date=([0-9-]+)", 1).cast("date")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(keeper.rows)
    on_disk = files.select(folder.alias("created_date")).distinct()
    return on_disk.join(keeper.saved().groupBy("created_date").agg(F.count(F.lit(1)).alias("rows")), "created_date", "left")


@query(f"""WITH {SAVED} SELECT id, kind FROM saved WHERE NOT (session_id = 's7' AND kind = 'F')""")
def delete_analysis(spark, sf):
    """What is left after a session's deletions, which only ever reach its own rows."""
    keeper = _store(spark, sf)
    asked = keeper.saved().filter("kind = 'F' AND session_id IN ('s7', 's8')").select("id")
    keeper.delete(asked, "s7")
    return keeper.saved().select("id", "kind")


@query("SELECT count(*) AS saved, 1 AS mine, 0 AS after_delete FROM orders")
def save_analysis(spark, sf):
    """A result saved, listed and deleted again, beside a bulk of earlier ones."""
    keeper = _store(spark, sf)
    before = keeper.saved().count()
    facts = P.compute_stats(N.profile(spark, sf, "orders")).agg(F.count(F.lit(1)).alias("columns"))
    mine = keeper.save(facts, session_id="me", kind="analysis", filename="orders", file_type="table", now=CUTOFF)
    listed = keeper.list("me", None).count()
    keeper.delete(mine, "me")
    return spark.createDataFrame(
        [(before, listed, keeper.list("me", None).count())], "saved long, mine int, after_delete int")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def export_result(spark, sf):
    path = N.scratch(spark)
    table = N.table(spark, sf, "lineitem", ["l_returnflag"])
    B.export_result(P.level_counts(table, ["l_returnflag"]), path, CUTOFF)
    return spark.read.schema("level string, n long, exported_at string").json(path).select(F.col("level").alias("flag"), "n")


# -- scalar functions -------------------------------------------------------------

@query(f"""WITH {MESSY} SELECT price_blank AS price_missing, gappy_quantity IS NULL AS quantity_missing, count(*) AS n
  FROM m GROUP BY 1, 2""")
def is_missing(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    return m.df.groupBy(m.missing("price_text").alias("price_missing"), m.missing("gappy_quantity").alias("quantity_missing")
                        ).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MESSY} SELECT l_orderkey, l_linenumber, price_num AS number FROM m")
def to_number(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    return m.df.select("l_orderkey", "l_linenumber", m.number("price_text").alias("number"))


@query(f"""WITH {MESSY} SELECT l_orderkey % 5 AS shape, count(price_num) AS read, round(sum(price_num), 2) AS total
  FROM m GROUP BY 1""")
def parse_formatted(spark, sf):
    m = N.messy_lineitem(spark, sf).withColumn("x", V.parse_formatted(V.trimmed(F.col("price_text"))))
    return m.groupBy((F.col("l_orderkey") % 5).alias("shape")).agg(
        F.count("x").alias("read"), F.round(F.sum("x"), 2).alias("total"))


@query(f"""WITH {MESSY}, f AS (SELECT l_orderkey % 5 AS shape, max(abs(price_num)) >= 1000 AS thousands FROM m GROUP BY 1)
  SELECT shape, CASE shape WHEN 0 THEN 'currency' || CASE WHEN thousands THEN '|thousands' ELSE '' END
    WHEN 1 THEN 'negated parentheses' || CASE WHEN thousands THEN '|thousands' ELSE '' END WHEN 2 THEN 'percent' ELSE '' END AS formats
  FROM f UNION ALL SELECT 9, 'negated parentheses|currency|percent' || CASE WHEN bool_or(thousands) THEN '|thousands' ELSE '' END FROM f""")
def number_formats(spark, sf):
    """The notations of each way a price is written, and of all together (9)."""
    m, out = durable(N.messy_lineitem(spark, sf).select("l_orderkey", "price_text")), None
    for shape in (0, 1, 2, 3, 4, 9):
        rows = m.filter(F.lit(shape == 9) | (F.col("l_orderkey") % 5 == shape)).select("price_text")
        one = Table(rows).column_facts().select(F.lit(shape).cast("long").alias("shape"), F.array_join("formats", "|").alias("formats"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {MESSY} SELECT l_returnflag AS flag, count(price_num) AS n, round(min(price_num), 4) AS low,
  round(max(price_num), 4) AS high FROM m WHERE price_num IS NOT NULL GROUP BY 1""")
def numeric_values(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    rows = m.df.select("l_returnflag", m.number("price_text").alias("x")).filter("x IS NOT NULL")
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("x").alias("n"), F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"))


@query(f"""WITH {MESSY} SELECT l_orderkey, gappy_quantity AS x, round(gappy_price, 4) AS y FROM m
  WHERE gappy_quantity IS NOT NULL AND gappy_price IS NOT NULL""")
def paired_values(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    return C.paired_values(m, "gappy_quantity", "gappy_price", F.col("l_orderkey")).withColumn("y", F.round("y", 4))


@query(f"""WITH {MESSY} SELECT l_linenumber AS line, count(gappy_quantity) AS covered, count(*) AS total,
  round(100.0 * count(gappy_quantity) / count(*), 1) AS coverage FROM m GROUP BY 1""")
def coverage_pct(spark, sf):
    m = N.messy_lineitem(spark, sf).groupBy(F.col("l_linenumber").alias("line")).agg(
        F.count("gappy_quantity").alias("covered"), F.count(F.lit(1)).alias("total"))
    return m.withColumn("coverage", V.coverage_pct(F.col("covered"), F.col("total")))


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
  FROM lineitem GROUP BY 1""")
def quantile(spark, sf):
    li = N.load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    out = grouped_quantiles(li, ["flag"], "v", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return out.select("flag", "n", *[F.round(c, 4).alias(c) for c in ("p05", "median", "p95")])


@query("""SELECT DISTINCT x, CASE WHEN round(x, 4) = 0 AND x <> 0 THEN CAST(format('{:.3e}', x) AS DOUBLE) ELSE round(x, 4)
  END AS rounded FROM (SELECT l_discount * l_tax / 1000 AS x FROM lineitem UNION ALL
  SELECT l_discount * 7 + l_tax FROM lineitem)""")
def round_sig(spark, sf):
    li = N.load(spark, sf, "lineitem")
    x = li.selectExpr("l_discount * l_tax / 1000 AS x").unionByName(li.selectExpr("l_discount * 7 + l_tax AS x")).distinct()
    return x.withColumn("rounded", V.round_sig(F.col("x")))


@query(f"""WITH {MESSY} SELECT CASE WHEN price_blank THEN 'missing' WHEN price_num IS NOT NULL THEN 'numeric' ELSE 'text' END
  AS price, 'date' AS ship, 'text' AS flag, CASE WHEN gappy_quantity IS NULL THEN 'missing' ELSE 'numeric' END AS quantity,
  count(*) AS n FROM m GROUP BY ALL""")
def classify_value(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    kinds = {"price": "price_text", "ship": "ship_text", "flag": "l_returnflag", "quantity": "gappy_quantity"}
    return m.df.groupBy(*[m.kind(c).alias(k) for k, c in kinds.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")
def to_date(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    return m.df.select("l_orderkey", "l_linenumber", D.day_text(m.moment("ship_text")).alias("day"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') AS year
  FROM events""")
def period_key(spark, sf):
    e = Table(N.load(spark, sf, "events"))
    return e.df.select("event_id", *[D.period_key(e.moment("ts"), g).alias(g) for g in ("day", "month", "year")])


@query("""SELECT k, days, CASE WHEN days <= 92 THEN 'day' WHEN days <= 1100 THEN 'month' ELSE 'year' END AS grain FROM
  (SELECT o_custkey AS k, CAST(datediff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS days FROM orders GROUP BY 1)""")
def choose_granularity(spark, sf):
    o = N.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("days"))
    return o.withColumn("grain", D.choose_granularity(F.col("days")))


_R = "(o_totalprice / 250000 - 1)"


@query(f"""WITH x AS (SELECT abs{_R} AS r FROM orders), w AS (SELECT
    CASE WHEN r >= 0.9 THEN 'very strong' WHEN r >= 0.7 THEN 'strong' WHEN r >= 0.5 THEN 'moderate' WHEN r >= 0.3 THEN 'weak' ELSE 'negligible' END AS r,
    CASE WHEN 1.5 * r >= 1.2 THEN 'very strong' WHEN 1.5 * r >= 0.8 THEN 'strong' WHEN 1.5 * r >= 0.5 THEN 'moderate' WHEN 1.5 * r >= 0.2
      THEN 'weak' ELSE 'negligible' END AS d,
    CASE WHEN r >= 0.5 THEN 'strong' WHEN r >= 0.3 THEN 'moderate' WHEN r >= 0.1 THEN 'weak' ELSE 'negligible' END AS v FROM x),
  l AS (SELECT ['very strong', 'strong', 'moderate', 'weak', 'negligible'] AS names)
  SELECT r, d, v, names[least(list_position(names, r) + 1, 5)] AS weaker1, names[least(list_position(names, r) + 2, 5)] AS weaker2,
    names[least(list_position(names, r) + 3, 5)] AS weaker3, count(*) AS n FROM w, l GROUP BY ALL""")
def strength_ladders(spark, sf):
    x = F.expr(_R)
    o = N.load(spark, sf, "orders").select(
        V.correlation_strength(x).alias("r"), V.effect_strength(x * 1.5).alias("d"), V.association_strength(F.abs(x)).alias("v"))
    weaker = {f"weaker{k}": V.weaken(F.col("r"), F.lit(k)) for k in (1, 2, 3)}
    return o.withColumns(weaker).groupBy("r", "d", "v", *weaker).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, round(p_retailprice - p_size, 4) AS delta,
  round((p_retailprice - (2 * p_size + 1)) / abs(2 * p_size + 1) * 100, 1) AS pct FROM part""")
def delta(spark, sf):
    odd = F.col("p_size") * 2 + 1
    return N.load(spark, sf, "part").select(
        "p_partkey", V.delta(F.col("p_retailprice"), F.col("p_size")).alias("delta"),
        V.delta_pct(F.col("p_retailprice"), odd.cast("double")).alias("pct"))


@query("""SELECT p_partkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D'
  ELSE 'F' END AS grade FROM (SELECT p_partkey, p_size * 2 AS s FROM part)""")
def health_grade(spark, sf):
    return N.load(spark, sf, "part").select("p_partkey", V.health_grade(F.col("p_size") * 2).alias("grade"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN left(text, 159) || '…' ELSE text END AS cell FROM documents")
def safe_cell(spark, sf):
    return N.load(spark, sf, "documents").select("doc_id", V.safe_cell(F.col("text")).alias("cell"))


@query("""SELECT p_partkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS txt
  FROM (SELECT p_partkey, round(p_retailprice, 1) AS x FROM part)""")
def text_of(spark, sf):
    p = N.load(spark, sf, "part").select("p_partkey", F.round("p_retailprice", 1).alias("x"))
    return p.select("p_partkey", V.text_of(F.col("x"), T.DoubleType()).alias("txt"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS cell FROM events UNION ALL
  SELECT -1 - o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders""")
def normalize_date_cells(spark, sf):
    e = N.load(spark, sf, "events").select("event_id", D.normalize_date_cell(F.col("ts")).alias("cell"))
    return e.unionByName(N.load(spark, sf, "orders").select(
        (-1 - F.col("o_orderkey")).alias("event_id"), D.normalize_date_cell(F.col("o_orderdate")).alias("cell")))


# -- projections and predicates ---------------------------------------------------

@query("""WITH asked AS (SELECT unnest(['l_tax', 'o_totalprice', 'L_TAX', '']) AS target), c AS (SELECT column_name AS c FROM
  information_schema.columns WHERE table_name = 'lineitem')
  SELECT target, CASE WHEN c IS NOT NULL THEN target ELSE 'refused' END AS single, c AS batch FROM asked LEFT JOIN c ON c = target""")
def resolve_target(spark, sf):
    """A target that is not there is refused for one table and left out in a batch."""
    columns, rows = N.load(spark, sf, "lineitem").columns, []
    for target in ("l_tax", "o_totalprice", "L_TAX", ""):
        try:
            single = find_target(target, columns)
        except UnknownColumn:
            single = "refused"
        rows.append((target, single, find_target(target, columns, strict=False)))
    return spark.createDataFrame(rows, "target string, single string, batch string")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", name="select_columns")
def selected_columns(spark, sf):
    return select_columns(N.load(spark, sf, "orders"), ["o_totalprice", " o_orderkey", "o_orderstatus"])[0]


@query(f"""WITH {MESSY} SELECT CASE WHEN price_blank THEN 'missing price_text' WHEN price_num IS NULL THEN 'non-numeric price_text'
  END AS price, CASE WHEN gappy_tax IS NULL THEN 'missing gappy_tax' END AS tax,
  CASE WHEN l_returnflag = 'R' THEN 'l_returnflag outside retained groups' END AS flag, NULL AS ship,
  CASE WHEN year(l_shipdate) NOT IN (1997, 1998) THEN 'l_shipdate outside compared periods' END AS period, count(*) AS n
  FROM m GROUP BY ALL""")
def inclusion_reasons(spark, sf):
    m = Table(N.messy_lineitem(spark, sf))
    return m.df.groupBy(
        numeric_reason(m, "price_text").alias("price"), present_reason(m, "gappy_tax").alias("tax"),
        level_reason(m, "l_returnflag", ["A", "N"]).alias("flag"), date_reason(m, "ship_text").alias("ship"),
        period_reason(m, "l_shipdate", ["1997", "1998"], "year").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'o_orderstatus' AS "column", count(*) AS valid, count(DISTINCT o_orderstatus) AS "unique", 'category' AS role,
  least(8, count(DISTINCT o_orderstatus)) AS top_reported FROM orders UNION ALL
  SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority), 'category', least(8, count(DISTINCT o_orderpriority))
  FROM orders""")
def drop_heavy(spark, sf):
    out = drop_heavy_fields(P.categorical_summary(N.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))
    return out.withColumn("top_reported", F.col("top_reported").cast("long"))


# -- column profile ---------------------------------------------------------------

@query(f"""WITH {MESSY} SELECT 'price_text' AS "column", 'numeric' AS stat_type, 'mixed' AS quality_type,
  count(*) FILTER (price_blank) AS missing, count(price_num) AS numbers, 0 AS dates FROM m
  UNION ALL SELECT 'ship_text', 'date', 'date', 0, 0, count(*) FROM m
  UNION ALL SELECT 'l_returnflag', 'categorical', 'text', 0, 0, 0
  UNION ALL SELECT 'gappy_quantity', 'numeric', 'numeric', count(*) - count(gappy_quantity), count(gappy_quantity), 0 FROM m
  UNION ALL SELECT 'l_shipdate', 'date', 'date', 0, 0, count(*) FROM m""")
def profile_field(spark, sf):
    columns = ["price_text", "ship_text", "l_returnflag", "gappy_quantity", "l_shipdate"]
    facts = Table(N.messy_lineitem(spark, sf), columns).column_facts()
    return facts.select("column", "stat_type", "quality_type", "missing", "numbers", "dates")


_SUMMARY = f"""WITH {LONG}, q AS (SELECT "column", count(v) AS valid, min(v) AS lo, max(v) AS hi, avg(v) AS a, stddev_pop(v) AS s,
  quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS p FROM u GROUP BY 1),
  f AS (SELECT *, p[2] - 1.5 * (p[4] - p[2]) AS low, p[4] + 1.5 * (p[4] - p[2]) AS high FROM q)"""


@query(f"""{_SUMMARY} SELECT "column", valid, 0 AS missing, 0 AS invalid, 100.0 AS coverage, round(lo, 4) AS min, round(hi, 4) AS max,
  round(a, 4) AS mean, round(s, 4) AS std, round(p[1], 4) AS p05, round(p[2], 4) AS q1, round(p[3], 4) AS median,
  round(p[4], 4) AS q3, round(p[5], 4) AS p95, round(low, 4) AS lower_fence, round(high, 4) AS upper_fence,
  (SELECT count(*) FROM u WHERE u."column" = f."column" AND (v < low OR v > high)) AS outliers FROM f""")
def numeric_summary(spark, sf):
    return N.profile(spark, sf, "lineitem", MEASURES).numeric_summary().select(
        "column", "valid", "missing", "invalid", "coverage", "min", "max", "mean", "std", *P.QUANTILES, "lower_fence",
        "upper_fence", "outliers")


@query(f"""WITH {MESSY}, q AS (SELECT count(price_num) AS valid, count(*) FILTER (price_blank) AS missing, count(*) AS n,
  avg(price_num) AS a, quantile_cont(price_num, 0.5) AS med FROM m)
  SELECT 'price_text' AS "column", valid, missing, n - missing - valid AS invalid, round(100.0 * valid / n, 1) AS coverage,
  round(a, 4) AS mean, round(med, 4) AS median FROM q""")
def numeric_summary_messy(spark, sf):
    p = P.Profile(Table(N.messy_lineitem(spark, sf), ["price_text"]))
    return p.numeric_summary().select("column", "valid", "missing", "invalid", "coverage", "mean", "median")


@query(f"""WITH {LONG}, q AS (SELECT "column", count(v) AS n, avg(v) AS a, stddev_samp(v) / sqrt(count(v)) AS e, count(v) - 1.0 AS k FROM u
  GROUP BY 1), z AS (SELECT 1.959963984540054 AS z), t AS (SELECT "column", n, a, e, z + (z ** 3 + z) / (4 * k)
    + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * k ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * k ** 3) AS t FROM q, z)
  SELECT "column", round(e, 4) AS standard_error, n - 1 AS degrees_freedom, round(a - t * e, 3) AS lower, round(a + t * e, 3) AS upper FROM t""")
def mean_ci(spark, sf):
    """The interval against the expansion of the t quantile in powers of one over the degrees of freedom."""
    out = N.profile(spark, sf, "lineitem", MEASURES).numeric_summary()
    return out.select("column", "mean_ci.standard_error", "mean_ci.degrees_freedom",
                      F.round("mean_ci.lower", 3).alias("lower"), F.round("mean_ci.upper", 3).alias("upper"))


@query(f"""WITH {LONG} SELECT "column", round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.25), 4) AS q1,
  round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, round(quantile_cont(v, 0.95), 4) AS p95
  FROM u GROUP BY 1""")
def quantiles(spark, sf):
    p = N.profile(spark, sf, "lineitem", MEASURES)
    rows = [(c, *[q[k] for k in P.QUANTILES]) for c, q in p.quantiles.items()]
    frame = spark.createDataFrame(rows, "column string, " + ", ".join(f"{k} double" for k in P.QUANTILES))
    return frame.select("column", *[V.round_sig(F.col(k)).alias(k) for k in P.QUANTILES])


@query(f"""WITH {EVENT_FENCES} SELECT "column", round(low, 4) AS lower_fence, round(high, 4) AS upper_fence, true AS applied,
  (SELECT count(*) FROM u WHERE u."column" = f."column" AND (v < low OR v > high)) AS outliers FROM f""")
def iqr_outliers(spark, sf):
    p = N.profile(spark, sf, "events", row_id="event_id")
    return p.numeric_summary().select("column", "lower_fence", "upper_fence", F.col("outliers_applied").alias("applied"), "outliers")


@query(f"""WITH {EVENT_FENCES}, o AS (SELECT "column", event_id AS "row", v AS value, CASE WHEN v < low THEN 'below' ELSE 'above' END AS side,
  round(CASE WHEN v < low THEN low - v ELSE v - high END, 3) AS beyond FROM u JOIN f USING ("column") WHERE v < low OR v > high),
  r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY beyond DESC, "row") AS place FROM o)
  SELECT * FROM r WHERE place <= 200""")
def outlier_rows(spark, sf):
    out = N.profile(spark, sf, "events", row_id="event_id").outlier_rows()
    return out.withColumn("beyond", F.round("beyond", 3))


def _bins_sql(source: str, low: str, high: str, bins: int = 10) -> str:
    return (f"SELECT \"column\", CAST(least(floor((v - {low}) / (({high} - {low}) / {bins})), {bins - 1}) AS INTEGER) AS bin, "
            f"count(*) AS \"count\" FROM {source} GROUP BY 1, 2")


@query(f"""WITH {LONG}, e AS (SELECT "column", min(v) AS lo,
  max(v) AS hi FROM u GROUP BY 1), j AS (SELECT * FROM u JOIN e USING ("column")), c AS ({_bins_sql('j', 'lo', 'hi')}),
  k AS (SELECT "column", CAST(unnest(range(10)) AS INTEGER) AS bin FROM e)
  SELECT k."column", k.bin, coalesce(c."count", 0) AS "count" FROM k LEFT JOIN c ON c."column" = k."column" AND c.bin = k.bin""")
def histogram(spark, sf):
    return N.profile(spark, sf, "lineitem", MEASURES).histogram(tail_aware=False).select("column", "bin", "count")


@query(f"""WITH {EVENT_FENCES}, j AS (SELECT u."column", v, low, high FROM u JOIN f USING ("column") WHERE "column" = 'value'),
  c AS (SELECT * FROM j WHERE v BETWEEN low AND high), e AS (SELECT min(v) AS lo, max(v) AS hi FROM c),
  b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM c, e GROUP BY 1),
  t AS (SELECT -1 AS bin, count(*) AS n FROM j WHERE v < low UNION ALL SELECT 10, count(*) FROM j WHERE v > high)
  SELECT bin, 'iqr-tail-aware' AS method, CASE WHEN bin < 0 THEN 'low-tail' WHEN bin = 10 THEN 'high-tail' ELSE 'center' END AS kind,
  n AS "count" FROM (SELECT * FROM b UNION ALL SELECT * FROM t WHERE n > 0)""")
def tail_aware_histogram(spark, sf):
    p = N.profile(spark, sf, "events", ["value"])
    return p.histogram().select("bin", "method", "kind", "count")


def _levels_sql(columns: list[str], source: str, head: str = "") -> str:
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level FROM {source}" for c in columns)
    return (f"WITH {head}u AS ({union}), c AS (SELECT \"column\", level, count(*) AS n FROM u WHERE level IS NOT NULL GROUP BY 1, 2), "
            "t AS (SELECT \"column\", count(*) AS uniq, CAST(sum(n) AS BIGINT) AS valid FROM c GROUP BY 1)")


@query(_levels_sql(["o_orderstatus", "o_orderpriority"], "orders") + """
  SELECT "column", place, level AS value, n AS "count", round(100.0 * n / valid, 1) AS percentage, uniq AS "unique", valid
  FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS place FROM c) JOIN t USING ("column")
  WHERE place <= 8""")
def frequency_table(spark, sf):
    return P.frequency_table(N.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


_ROLE = """CASE WHEN valid = 0 THEN 'empty' WHEN uniq = valid AND valid > 1 THEN 'identifier'
  WHEN uniq / valid >= 0.9 AND valid >= 10 THEN 'identifier' WHEN uniq <= 25 AND uniq / valid <= 0.5 THEN 'category'
  ELSE 'high-cardinality text' END"""


@query(_levels_sql(["p_brand", "p_type", "p_name"], "part") + f"""
  SELECT "column", valid, uniq AS "unique", {_ROLE} AS role, lead_level, lead_n FROM t JOIN (SELECT "column", level AS lead_level,
  n AS lead_n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS p FROM c) WHERE p = 1) USING ("column")""")
def categorical_summary(spark, sf):
    out = P.categorical_summary(N.table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])
    first = F.element_at("top", 1)
    return out.select("column", "valid", "unique", "role", first.value.alias("lead_level"), first["count"].alias("lead_n"))


@query(_levels_sql(["c_name", "c_mktsegment"], "customer") + f"""
  SELECT "column", {_ROLE} AS role FROM t UNION ALL SELECT 'url', CASE WHEN count(DISTINCT url) = count(url) THEN 'identifier'
  WHEN count(DISTINCT url) / count(url) >= 0.9 THEN 'identifier' ELSE 'high-cardinality text' END FROM pages""")
def categorical_role(spark, sf):
    a = P.categorical_summary(N.table(spark, sf, "customer"), ["c_name", "c_mktsegment"])
    return a.unionByName(P.categorical_summary(N.table(spark, sf, "pages"), ["url"])).select("column", "role")


@query("""SELECT 'o_orderkey' AS "column", 'numeric' AS type, count(*) AS valid, round(avg(o_orderkey), 4) AS mean,
  NULL AS role, NULL AS earliest FROM orders UNION ALL
  SELECT 'o_custkey', 'numeric', count(*), round(avg(o_custkey), 4), NULL, NULL FROM orders UNION ALL
  SELECT 'o_totalprice', 'numeric', count(*), round(avg(o_totalprice), 4), NULL, NULL FROM orders UNION ALL
  SELECT 'o_orderstatus', 'categorical', count(*), NULL, 'category', NULL FROM orders UNION ALL
  SELECT 'o_orderpriority', 'categorical', count(*), NULL, 'category', NULL FROM orders UNION ALL
  SELECT 'o_orderdate', 'date', count(*), NULL, NULL, strftime(min(o_orderdate), '%Y-%m-%d') FROM orders""")
def compute_stats(spark, sf):
    out = P.compute_stats(N.profile(spark, sf, "orders"))
    return out.select("column", "type", "valid", "mean", "role", D.day_text(F.col("earliest")).alias("earliest"))


@query("""SELECT 'supplier' AS dataset, 's_acctbal' AS "column", count(*) AS numbers, round(avg(s_acctbal), 4) AS mean,
  round(quantile_cont(s_acctbal, 0.25), 4) AS q1, round(quantile_cont(s_acctbal, 0.5), 4) AS median FROM supplier UNION ALL
  SELECT 'customer', 'c_acctbal', count(*), round(avg(c_acctbal), 4), round(quantile_cont(c_acctbal, 0.25), 4),
  round(quantile_cont(c_acctbal, 0.5), 4) FROM customer UNION ALL
  SELECT 'customer', 'c_name', 0, NULL, NULL, NULL""")
def profile_many_tables(spark, sf):
    """Columns of several tables profiled in one job from long cells."""
    def cells(name, column):
        return N.load(spark, sf, name).select(
            F.lit(name).alias("dataset"), F.lit(column).alias("column"), F.col(column).cast("string").alias("text"))

    long = cells("supplier", "s_acctbal").unionByName(cells("customer", "c_acctbal")).unionByName(cells("customer", "c_name"))
    return profile_many(long).select(
        "dataset", "column", "numbers", *[F.round(c, 4).alias(c) for c in ("mean", "q1", "median")])


# -- quality ----------------------------------------------------------------------

@query(f"""WITH {MESSY} SELECT 'price_text' AS "column", count(price_num) AS numeric_cells, 0 AS date_cells, 0 AS boolean_cells,
  count(*) FILTER (NOT price_blank AND price_num IS NULL) AS text_cells, count(*) FILTER (price_blank) AS missing FROM m UNION ALL
  SELECT 'ship_text', 0, count(*), 0, 0, 0 FROM m UNION ALL
  SELECT 'gappy_tax', count(gappy_tax), 0, 0, 0, count(*) - count(gappy_tax) FROM m""")
def value_type_counts(spark, sf):
    t = Table(N.messy_lineitem(spark, sf), ["price_text", "ship_text", "gappy_tax"])
    return t.column_facts().select("column", *[f"{k}_cells" for k in V.KINDS], "missing")


@query(f"""WITH {MESSY}, c AS (SELECT count(price_num) AS k, count(*) FILTER (NOT price_blank) AS n FROM m)
  SELECT 'price_text' AS "column", CASE WHEN k / n >= 0.8 THEN 'numeric' ELSE 'mixed' END AS quality_type,
  round(k / n, 3) AS type_consistency FROM c UNION ALL SELECT 'ship_text', 'date', 1.0
  UNION ALL SELECT 'gappy_tax', 'numeric', 1.0""")
def quality_type(spark, sf):
    t = Table(N.messy_lineitem(spark, sf), ["price_text", "ship_text", "gappy_tax"])
    return t.column_facts().select("column", "quality_type", "type_consistency")


@query(f"""WITH {GAPPY} SELECT 'price' AS "column", count(*) - count(price) AS missing, count(DISTINCT price) AS "unique",
  round(100.0 * (count(*) - count(price)) / count(*), 1) AS missing_pct,
  round(100.0 * count(DISTINCT price) / count(price), 1) AS unique_pct FROM g UNION ALL
  SELECT 'tier', count(*) - count(tier), count(DISTINCT tier), round(100.0 * (count(*) - count(tier)) / count(*), 1),
  round(100.0 * count(DISTINCT tier) / count(tier), 1) FROM g UNION ALL
  SELECT 'mix', 0, count(DISTINCT mix), 0.0, round(100.0 * count(DISTINCT mix) / count(mix), 1) FROM g""")
def missing_and_unique(spark, sf):
    q = Q.Quality(P.Profile(Table(N.gappy_orders(spark, sf), ["price", "tier", "mix"])))
    return q.columns().select("column", "missing", "unique", "missing_pct", "unique_pct")


@query(f"""WITH {EVENT_FENCES} SELECT "column", 'numeric' AS type,
  (SELECT count(*) FROM u WHERE u."column" = f."column" AND (v < low OR v > high)) AS outliers FROM f
  UNION ALL SELECT 'event_type', 'text', 0""")
def outlier_count(spark, sf):
    q = Q.Quality(N.profile(spark, sf, "events", ["user_id", "event_type", "value"]))
    return q.columns().select("column", "type", "outliers")


@query("""SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem
  GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_shipdate)""")
def duplicate_rows(spark, sf):
    t = N.table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    return Q.duplicate_rows(t)


_SCORE = f"""WITH {GAPPY}, c AS (SELECT count(*) AS n, round(100.0 * (count(*) - count(price)) / count(*), 1) AS mp,
  round(100.0 * (count(*) - count(tier)) / count(*), 1) AS mt, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
  quantile_cont(tier, 0.25) AS t1, quantile_cont(tier, 0.75) AS t3 FROM g),
  o AS (SELECT count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) +
    count(*) FILTER (tier < t1 - 1.5 * (t3 - t1) OR tier > t3 + 1.5 * (t3 - t1)) AS out FROM g, c),
  d AS (SELECT CAST(sum(k - 1) AS BIGINT) AS dup FROM (SELECT count(*) AS k FROM g GROUP BY price, tier, mix)),
  s AS (SELECT n, mp, mt, out, dup, 100 - (mp + mt) / 3 * 0.8 - 100.0 / 3 * 0.25 - 100.0 * dup / n * 0.4
    - 100.0 * out / (n * 3) * 0.5 AS score, (SELECT round(100.0 * count(*) FILTER (o_orderkey % 4 <> 0) / count(*)) FROM g) AS same
    FROM c, o, d)"""


@query(f"""{_SCORE} SELECT n AS row_count, dup AS duplicate_rows, round(100 - (mp + mt) / 3, 1) AS completeness,
  CAST(greatest(0, round(score)) AS INTEGER) AS health_score, CASE WHEN score >= 89.5 THEN 'A' WHEN score >= 79.5 THEN 'B'
  WHEN score >= 69.5 THEN 'C' WHEN score >= 59.5 THEN 'D' ELSE 'F' END AS health_grade FROM s""")
def health_score(spark, sf):
    q = Q.Quality(P.Profile(Table(N.gappy_orders(spark, sf), ["price", "tier", "mix"])))
    return q.summary().select("row_count", "duplicate_rows", "completeness", "health_score", "health_grade")


@query(f"""{_SCORE} SELECT CASE WHEN mp >= 40 THEN 'high' ELSE 'medium' END AS severity,
  '"price" is missing ' || mp || '% of its values' AS message FROM s WHERE mp >= 10 UNION ALL
  SELECT CASE WHEN mt >= 40 THEN 'high' ELSE 'medium' END, '"tier" is missing ' || mt || '% of its values' FROM s WHERE mt >= 10
  UNION ALL SELECT 'high', '"mix" mixes value types (only ' || CAST(same AS INTEGER) || '% consistent)' FROM s
  UNION ALL SELECT CASE WHEN 100.0 * dup / n >= 5 THEN 'high' ELSE 'medium' END, dup || ' duplicate row' ||
  CASE WHEN dup = 1 THEN '' ELSE 's' END || ' (' || CASE WHEN round(100.0 * dup / n, 1) = floor(round(100.0 * dup / n, 1))
  THEN CAST(CAST(round(100.0 * dup / n, 1) AS INTEGER) AS VARCHAR) ELSE CAST(round(100.0 * dup / n, 1) AS VARCHAR) END || '%)' FROM s WHERE dup > 0""")
def issues(spark, sf):
    return Q.Quality(P.Profile(Table(N.gappy_orders(spark, sf), ["price", "tier", "mix"]))).issues()


def _one_decimal(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS INTEGER) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


@query(f"""{_SCORE}, x AS (SELECT *, (SELECT count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) FROM g, c) AS op,
    (SELECT count(*) FILTER (tier < t1 - 1.5 * (t3 - t1) OR tier > t3 + 1.5 * (t3 - t1)) FROM g, c) AS ot, round(100.0 * dup / n, 1) AS dp FROM s),
  i AS (SELECT CASE WHEN mp >= 40 THEN 0 ELSE 1 END AS sev, 0 AS pos, 0 AS step, '"price" is missing ' || {_one_decimal("mp")} || '% of its values' AS msg
      FROM x WHERE mp >= 10 UNION ALL
    SELECT CASE WHEN mt >= 40 THEN 0 ELSE 1 END, 1, 0, '"tier" is missing ' || {_one_decimal("mt")} || '% of its values' FROM x WHERE mt >= 10 UNION ALL
    SELECT 0, 2, 1, '"mix" mixes value types (only ' || CAST(same AS INTEGER) || '% consistent)' FROM x UNION ALL
    SELECT 2, 0, 3, '"price" has ' || op || ' statistical outlier' || CASE WHEN op = 1 THEN '' ELSE 's' END FROM x WHERE op > 0 UNION ALL
    SELECT 2, 1, 3, '"tier" has ' || ot || ' statistical outlier' || CASE WHEN ot = 1 THEN '' ELSE 's' END FROM x WHERE ot > 0 UNION ALL
    SELECT CASE WHEN 100.0 * dup / n >= 5 THEN 0 ELSE 1 END, 9, 0, dup || ' duplicate row' || CASE WHEN dup = 1 THEN '' ELSE 's' END || ' (' ||
      {_one_decimal("dp")} || '%)' FROM x WHERE dup > 0)
  SELECT 'Health ' || CASE WHEN score >= 89.5 THEN 'A' WHEN score >= 79.5 THEN 'B' WHEN score >= 69.5 THEN 'C' WHEN score >= 59.5 THEN 'D' ELSE 'F' END
    || ' (' || CAST(greatest(0, round(score)) AS INTEGER) || '/100), ' || n || ' rows, ' || dup || ' duplicate rows. Columns — price: numeric'
    || CASE WHEN mp > 0 THEN ', ' || {_one_decimal("mp")} || '% missing' ELSE '' END || CASE WHEN op > 0 THEN ', ' || op || ' outliers' ELSE '' END
    || ' | tier: numeric' || CASE WHEN mt > 0 THEN ', ' || {_one_decimal("mt")} || '% missing' ELSE '' END
    || CASE WHEN ot > 0 THEN ', ' || ot || ' outliers' ELSE '' END || ' | mix: mixed. Issues — '
    || (SELECT string_agg(msg, '; ' ORDER BY sev, pos, step) FROM i) || '.' AS summary FROM x""")
def profile_summary_line(spark, sf):
    return Q.Quality(P.Profile(Table(N.gappy_orders(spark, sf), ["price", "tier", "mix"]))).summary_line()


# -- dates ------------------------------------------------------------------------

def _line(spark, sf, name, column, columns=None) -> L.Timeline:
    return L.Timeline(N.table(spark, sf, name, columns or [column]), column)


@query(f"""WITH {MESSY} SELECT 'ship_text' AS "column", count(*) AS present, count(*) AS dates, true AS is_date FROM m UNION ALL
  SELECT 'price_text', count(*) FILTER (NOT price_blank), 0, false FROM m""")
def is_date_column(spark, sf):
    return L.date_columns(Table(N.messy_lineitem(spark, sf), ["ship_text", "price_text"]))


@query("""SELECT 'ts' AS "column", count(*) AS valid, 0 AS missing, 0 AS invalid, 100.0 AS coverage,
  strftime(min(ts), '%Y-%m-%d') AS earliest, strftime(max(ts), '%Y-%m-%d') AS latest,
  CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS range_days, 'day' AS granularity FROM events
  UNION ALL SELECT 'o_orderdate', count(*), 0, 0, 100.0, strftime(min(o_orderdate), '%Y-%m-%d'),
  strftime(max(o_orderdate), '%Y-%m-%d'), CAST(datediff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT), 'year' FROM orders""")
def date_summary(spark, sf):
    return _line(spark, sf, "events", "ts").summary().unionByName(_line(spark, sf, "orders", "o_orderdate").summary())


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS \"count\" FROM events GROUP BY 1 ORDER BY 1 LIMIT 60")
def period_counts(spark, sf):
    return _line(spark, sf, "events", "ts").period_counts(limit=60)


_YEARS = "p AS (SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 1)"


@query(f"""WITH {_YEARS}, r AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS k FROM p),
  a AS (SELECT max(k) AS periods, avg(n) FILTER (i <= k // 3) AS f, avg(n) FILTER (i > k - k // 3) AS l FROM r)
  SELECT periods, round(f, 6) AS first_mean, round(l, 6) AS last_mean, CASE WHEN (l - f) / f >= 0.15 THEN 'increasing'
  WHEN (l - f) / f <= -0.15 THEN 'decreasing' ELSE 'flat' END AS trend FROM a""")
def trend(spark, sf):
    out = _line(spark, sf, "orders", "o_orderdate").trend()
    return out.select("periods", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"), "trend")


@query(f"""WITH {_YEARS}, r AS (SELECT period, n, lag(period) OVER (ORDER BY period) AS pp, lag(n) OVER (ORDER BY period) AS pn FROM p)
  SELECT 'year' AS granularity, period AS current, n AS current_count, pp AS previous, pn AS previous_count, n - pn AS delta,
  round(100.0 * (n - pn) / pn, 1) AS change_pct FROM r ORDER BY period DESC LIMIT 1""")
def period_over_period(spark, sf):
    return _line(spark, sf, "orders", "o_orderdate").period_over_period()


def _gappy_days(spark, sf) -> Table:
    return Table(N.load(spark, sf, "events").filter("day(ts) % 5 <> 3 OR day(ts) = 1"), ["ts"])


_DAYS = """p AS (SELECT DISTINCT CAST(ts AS DATE) AS d, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events
  WHERE day(ts) % 5 <> 3 OR day(ts) = 1),
  a AS (SELECT unnest(generate_series((SELECT min(d) FROM p), (SELECT max(d) FROM p), INTERVAL 1 DAY)) AS d)"""


@query(f"""WITH {_DAYS} SELECT strftime(d, '%Y-%m-%d') AS period FROM a WHERE CAST(d AS DATE) NOT IN (SELECT d FROM p)
  ORDER BY 1 LIMIT 20""")
def gaps(spark, sf):
    return L.Timeline(_gappy_days(spark, sf), "ts").gaps()


@query(f"""WITH {_DAYS} SELECT strftime(a.d, '%Y-%m-%d') AS period, coalesce(p.n, 0) AS "count" FROM a
  LEFT JOIN p ON p.d = CAST(a.d AS DATE)""")
def gap_filled_timeline(spark, sf):
    return L.Timeline(_gappy_days(spark, sf), "ts").gap_filled()


@query("""WITH s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS step FROM events),
  o AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS i, count(*) OVER () AS k FROM s WHERE step IS NOT NULL)
  SELECT 'ts' AS "column", max(k) + 1 AS moments, max(step) AS widest_step, max(step) FILTER (i = k // 2) AS median_step,
  max(step) > 5 * max(step) FILTER (i = k // 2) AS irregular FROM o""")
def irregular_intervals(spark, sf):
    return _line(spark, sf, "events", "ts").irregular_intervals()


# -- correlation ------------------------------------------------------------------

def _pairs_sql(columns: list[str], body, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {body(a, b)} FROM {source}" for a, b in C.column_pairs(columns))


@query("""WITH c AS (SELECT column_name AS c, ordinal_position AS p FROM information_schema.columns
  WHERE table_name = 'lineitem' AND data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT'))
  SELECT x.c AS a, y.c AS b FROM c x JOIN c y ON x.p < y.p""")
def column_pairs(spark, sf):
    return spark.createDataFrame(C.column_pairs(N.profile(spark, sf, "lineitem").numeric), "a string, b string")


GAPS = ["gappy_quantity", "gappy_price", "gappy_tax"]


@query(f"WITH {MESSY} " + _pairs_sql(
    GAPS, lambda a, b: f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS pearson", "m"))
def pearson(spark, sf):
    t = Table(N.messy_lineitem(spark, sf), GAPS)
    out = C.pair_moments(t.numbers(GAPS), C.column_pairs(GAPS), "pearson")
    return out.select("a", "b", "n", F.round("pearson", 6).alias("pearson"))


@query("""WITH c AS (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT value, n, sum(n) OVER (ORDER BY value) - n + (n + 1) / 2 AS rank FROM c""")
def rank_averages(spark, sf):
    return rank_average(N.load(spark, sf, "lineitem"), F.col("l_extendedprice"))


def _spearman_sql(a: str, b: str, source: str) -> str:
    ranked = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{i}" for i, c in enumerate((a, b)))
    return (f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(r0, r1), 6) AS spearman FROM "
            f"(SELECT {ranked} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query(f"WITH {MESSY} " + " UNION ALL ".join(_spearman_sql(a, b, "m") for a, b in C.column_pairs(GAPS)))
def spearman(spark, sf):
    t = Table(N.messy_lineitem(spark, sf), GAPS)
    out = C.spearman(t, C.column_pairs(GAPS))
    return out.select("a", "b", "n", F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {MESSY}, p AS (""" + _pairs_sql(GAPS, lambda a, b: f"corr({a}, {b}) AS p", "m") + "), s AS (" + " UNION ALL ".join(
    _spearman_sql(a, b, "m") for a, b in C.column_pairs(GAPS)) + """), j AS (SELECT a, b, n, p, spearman AS s,
  (SELECT count(*) FROM m) AS total, abs(spearman) - abs(p) >= 0.2 AS by_rank FROM p JOIN s USING (a, b))
  SELECT a, b, CASE WHEN by_rank THEN 'spearman' ELSE 'pearson' END AS method,
  round(CASE WHEN by_rank THEN s ELSE p END, 4) AS coefficient, n, round(100.0 * n / total, 1) AS coverage
  FROM j WHERE abs(CASE WHEN by_rank THEN s ELSE p END) >= 0.3""")
def correlate(spark, sf):
    out = C.correlate(Table(N.messy_lineitem(spark, sf), GAPS), GAPS)
    return out.select("a", "b", "method", "coefficient", "n", "coverage")


def _positions(spark, sf) -> Table:
    """Every position of the vectors as a column; the last eight have gaps of their own."""
    vectors = N.load(spark, sf, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    x = [F.get("embedding", F.lit(k)).cast("double") for k in range(width)]
    return Table(vectors.select(*[
        F.when(F.col("vec_id") % (k - width + 12) != 0, c).alias(f"e{k}") if k >= width - 8 else c.alias(f"e{k}") for k, c in enumerate(x)]))


@query("""WITH w AS (SELECT max(len(embedding)) AS w FROM embeddings),
  l AS (SELECT vec_id, p - 1 AS p, CAST(embedding[p] AS DOUBLE) AS x FROM embeddings, w, unnest(range(1, w + 1)) t(p)
    WHERE p - 1 < w - 8 OR vec_id % (p - 1 - w + 12) <> 0),
  j AS (SELECT a.p AS p, b.p AS q, a.x AS x, b.x AS y FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.p < b.p),
  r AS (SELECT *, rank() OVER (PARTITION BY p, q ORDER BY x) + (count(*) OVER (PARTITION BY p, q, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY p, q ORDER BY y) + (count(*) OVER (PARTITION BY p, q, y) - 1) / 2 AS ry FROM j)
  SELECT 'e' || p AS a, 'e' || q AS b, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
  FROM r GROUP BY p, q""")
def correlate_positions(spark, sf):
    """All pairs of the positions of the vectors at once, with gaps: one scan for Pearson, one pass for ranks."""
    t = _positions(spark, sf)
    return C.coefficients(t, C.column_pairs(t.columns)).select(
        "a", "b", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""SELECT c_custkey AS "row", round(c_nationkey, 4) AS x, round(c_acctbal, 4) AS y FROM customer""")
def scatter_points(spark, sf):
    return C.scatter_points(N.table(spark, sf, "customer", row_id="c_custkey"), "c_nationkey", "c_acctbal")


@query("""WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
  SELECT CAST(least(19, floor((l_quantity - a) / (b - a) * 20)) AS INTEGER) AS x_cell,
  CAST(least(19, floor((l_extendedprice - c) / (d - c) * 20)) AS INTEGER) AS y_cell, count(*) AS "count" FROM lineitem, e GROUP BY 1, 2""")
def density_grid(spark, sf):
    return C.density_grid(N.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(f"""WITH {MESSY}, r AS (SELECT round(corr(gappy_quantity, gappy_price), 4) AS c FROM m)
  SELECT 'gappy_quantity' AS "column", NULL::DOUBLE AS gappy_quantity, c AS gappy_price, NULL::DOUBLE AS gappy_tax FROM r UNION ALL
  SELECT 'gappy_price', c, NULL, NULL FROM r UNION ALL SELECT 'gappy_tax', NULL, NULL, NULL""")
def correlation_matrix(spark, sf):
    return C.correlation_matrix(P.Profile(Table(N.messy_lineitem(spark, sf), GAPS)))


# -- inference --------------------------------------------------------------------

@query("""SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 4) AS variance,
  round(stddev_samp(l_quantity), 4) AS std FROM lineitem GROUP BY 1""")
def sample_summary(spark, sf):
    li = N.load(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag"))
    out = I.sample_summary(li, F.col("l_quantity"), "flag")
    return out.select("flag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "variance", "std")])


@query("""WITH t AS (SELECT DISTINCT p_size, p_size / 10.0 AS t FROM part)
  SELECT p_size, round(1 - 2 * atan(t) / pi(), 9) AS tail1, round(1 - t / sqrt(2 + t * t), 9) AS tail2,
    round(1 - 0.75 * t / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4))), 9) AS tail4,
    round(tan(pi() * (p_size / 102.0)), 6) AS critical1,
    round(p_size / 51.0 * sqrt(2 / (1 - (p_size / 51.0) ** 2)), 6) AS critical2,
    round(2 * sqrt(cos(acos(sqrt(1 - (p_size / 51.0) ** 2)) / 3) / sqrt(1 - (p_size / 51.0) ** 2) - 1), 6) AS critical4 FROM t""")
def student_t(spark, sf):
    """Tails and critical values at 1, 2 and 4 degrees of freedom, where they have closed forms."""
    sizes = durable(N.load(spark, sf, "part").select("p_size").distinct())
    t, df = F.col("p_size") / 10, {k: F.lit(float(k)) for k in (1, 2, 4)}
    tails = sizes.select("p_size", *[F.round(S.student_tail(t, d), 9).alias(f"tail{k}") for k, d in df.items()])
    return tails.withColumns({f"critical{k}": F.round(S.student_critical(d, F.col("p_size") / 51), 6) for k, d in df.items()})


_WELCH = """w AS (SELECT l_returnflag AS flag, count(*) FILTER (NOT c) AS n1, avg(l_extendedprice) FILTER (NOT c) AS m1,
  var_samp(l_extendedprice) FILTER (NOT c) AS v1, count(*) FILTER (c) AS n2, avg(l_extendedprice) FILTER (c) AS m2,
  var_samp(l_extendedprice) FILTER (c) AS v2 FROM (SELECT *, l_shipdate >= TIMESTAMP '1998-01-01' AS c FROM lineitem) GROUP BY 1)"""


@query(f"""WITH {_WELCH} SELECT flag, n1 AS baseline_n, n2 AS current_n, round(m2 - m1, 4) AS difference,
  round(sqrt(v1 / n1 + v2 / n2), 4) AS standard_error, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 4) AS t,
  round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 2) AS degrees_freedom FROM w""")
def welch_test(spark, sf):
    li = N.load(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag"))
    out = I.welch_test(li, F.col("l_extendedprice"), F.col("l_shipdate") >= "1998-01-01", "flag")
    return out.select("flag", *[f"welch.{c}" for c in (
        "baseline_n", "current_n", "difference", "standard_error", "t", "degrees_freedom")])


def _chi_sql(a: str, b: str, source: str) -> str:
    return f"""(WITH j AS (SELECT {a} AS l, {b} AS r, count(*) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT l, sum(o) AS ro FROM j GROUP BY 1), y AS (SELECT r, sum(o) AS co FROM j GROUP BY 1), t AS (SELECT sum(o) AS n FROM j),
  e AS (SELECT coalesce(o, 0) AS o, CAST(ro AS DOUBLE) * co / n AS e, n FROM x CROSS JOIN y CROSS JOIN t LEFT JOIN j USING (l, r)),
  c AS (SELECT max(n) AS n, sum((o - e) ** 2 / e) AS chi, min(e) AS least FROM e),
  d AS (SELECT (SELECT count(*) FROM x) AS rl, (SELECT count(*) FROM y) AS cl)
  SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, rl AS row_levels, cl AS column_levels, round(chi, 4) AS chi_square,
  (rl - 1) * (cl - 1) AS degrees_freedom, round(sqrt(chi / (n * least(rl - 1, cl - 1))), 4) AS cramers_v,
  round(c.least, 4) AS expected_min, c.least < 5 AS sparse FROM c, d)"""


@query(_chi_sql("p_brand", "p_type", "part"))
def chi_square(spark, sf):
    return I.categorical_association(N.table(spark, sf, "part"), [("p_brand", "p_type")]).drop("p_value")


@query("""WITH v AS (SELECT l_extendedprice AS x, l_shipdate >= TIMESTAMP '1998-01-01' AS c FROM lineitem),
  g AS (SELECT x, count(*) FILTER (NOT c) AS a, count(*) FILTER (c) AS b FROM v GROUP BY 1),
  r AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM g)
  SELECT (SELECT count(*) FROM v WHERE NOT c) AS baseline_n, (SELECT count(*) FROM v WHERE c) AS current_n,
  round(max(abs(fa - fb)), 4) AS statistic FROM r""")
def ks_two_sample(spark, sf):
    v = N.load(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("value"), (F.col("l_shipdate") >= "1998-01-01").alias("current"))
    return I.ks_two_sample(v, []).select("baseline_n", "current_n", "statistic")


@query("""WITH m AS (SELECT median(value) AS c FROM events) SELECT count(*) AS n, round(max(c), 4) AS median,
  round(median(abs(value - c)), 4) AS mad FROM events, m""")
def mad(spark, sf):
    found = H.mad(N.load(spark, sf, "events"))
    return spark.createDataFrame([(found["n"], round(found["median"], 4), round(found["mad"], 4))],
                                 "n long, median double, mad double")


_SHIFT = """s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, ts, v FROM e),
  k AS (SELECT count(*) AS n, median(v) AS c FROM s), z AS (SELECT max(n) AS n, median(abs(v - c)) * 1.4826 AS scale FROM s, k),
  b AS (SELECT i + 1 AS split, median(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mb,
    median(v) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ma FROM s),
  t AS (SELECT split, mb, ma, (ma - mb) / scale AS effect, abs((ma - mb) / scale) * sqrt(least(split, n - split) / n) AS score, n
    FROM b, z WHERE split BETWEEN 5 AND n - 5),
  w AS (SELECT * FROM t ORDER BY score DESC, split LIMIT 1)"""


@query(f"""WITH e AS (SELECT event_id, ts, value + CASE WHEN event_id % 10 < 7 AND ts >= TIMESTAMP '2024-01-19' THEN 40 ELSE 0 END AS v
  FROM events), {_SHIFT} SELECT split AS split_index, n, strftime(ts, '%Y-%m-%d') AS boundary, round(mb, 4) AS baseline_median,
  round(ma, 4) AS current_median, round(effect, 4) AS robust_effect, round(score, 4) AS score
  FROM w JOIN s ON s.i = w.split WHERE abs(effect) >= 0.5""")
def level_shift(spark, sf):
    lifted = F.expr("value + CASE WHEN event_id % 10 < 7 AND ts >= '2024-01-19' THEN 40 ELSE 0 END")
    t = Table(N.load(spark, sf, "events").withColumn("lifted", lifted), ["ts", "lifted"], "event_id")
    return H.level_shift(H.ordered_series(t, "ts", "lifted")).select(
        "split_index", "n", "boundary", "baseline_median", "current_median", "robust_effect", "score")


# -- evidence ---------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderdate", "o_orderstatus", "o_orderpriority", "price", "tier", "mix"]


def _orders_evidence(spark, sf, target="price") -> Evidence:
    return Evidence(P.Profile(Table(N.gappy_orders(spark, sf), ORDER_COLUMNS, "o_orderkey")), target)


def _messy_evidence(spark, sf, target=None) -> Evidence:
    return Evidence(P.Profile(Table(N.messy_lineitem(spark, sf), GAPS)), target)


@query(f"""WITH {MESSY} SELECT 'gappy_quantity and gappy_price rise together (pearson +' || round(corr(gappy_quantity, gappy_price), 4) || ')'
  AS claim, 'pearson_r' AS metric, round(corr(gappy_quantity, gappy_price), 4) AS value,
  count(*) FILTER (gappy_quantity IS NOT NULL AND gappy_price IS NOT NULL) AS sample_size, 'very strong' AS strength FROM m""")
def correlation_evidence(spark, sf):
    return _messy_evidence(spark, sf, "gappy_price").correlations().select("claim", "metric", "value", "sample_size", "strength")


_GROUPS = f"""WITH {GAPPY}, l AS (SELECT o_orderstatus AS level, count(price) AS n, avg(price) AS m, var_pop(price) AS v, var_samp(price) AS s
  FROM g GROUP BY 1 HAVING count(price) >= 3), t AS (SELECT * FROM l ORDER BY m DESC, level LIMIT 1),
  b AS (SELECT * FROM l ORDER BY m, level DESC LIMIT 1),
  d AS (SELECT t.level AS tl, b.level AS bl, t.m AS tm, b.m AS bm, (t.m - b.m) / sqrt((t.n * t.v + b.n * b.v) / (t.n + b.n)) AS d,
    (t.m - b.m) / sqrt(t.s / t.n + b.s / b.n) AS tt FROM t, b)"""


def _ntext(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


@query(f"""{_GROUPS} SELECT 'price averages ' || {_ntext('round(tm, 2)')} || ' for o_orderstatus=' || tl || ' vs ' || {_ntext('round(bm, 2)')}
  || ' for o_orderstatus=' || bl AS claim, round(d, 3) AS value, (SELECT CAST(sum(n) AS BIGINT) FROM l) AS sample_size,
  round(d, 4) AS effect_size, round(tt, 4) AS t FROM d""")
def group_mean_difference(spark, sf):
    out = _orders_evidence(spark, sf).group_differences().filter(F.element_at("columns", 2) == "o_orderstatus")
    return out.select("claim", "value", "sample_size", F.col("statistics")["effect_size"].alias("effect_size"),
                      F.col("statistics")["t"].alias("t"))


@query(f"""WITH {GAPPY}, p AS (SELECT count(price) FILTER (tier IS NULL) AS n1, avg(price) FILTER (tier IS NULL) AS m1,
  var_pop(price) FILTER (tier IS NULL) AS v1, count(price) FILTER (tier IS NOT NULL) AS n2,
  avg(price) FILTER (tier IS NOT NULL) AS m2, var_pop(price) FILTER (tier IS NOT NULL) AS v2 FROM g)
  SELECT 'rows missing tier average ' || {_ntext('round(m1, 2)')} || ' price, vs ' || {_ntext('round(m2, 2)')} || ' when tier is present' AS claim,
  round((m1 - m2) / sqrt((n1 * v1 + n2 * v2) / (n1 + n2)), 3) AS value, n1 + n2 AS sample_size, 'very strong' AS strength FROM p""")
def missingness_impact(spark, sf):
    return _orders_evidence(spark, sf).missingness_impact().select("claim", "value", "sample_size", "strength")


@query(f"WITH {GAPPY} SELECT a, b, n, chi_square, cramers_v FROM (" + " UNION ALL ".join(
    f"SELECT * FROM {_chi_sql(a, b, 'g')}" for a, b in C.column_pairs(["o_orderstatus", "o_orderpriority", "mix"])
) + ") WHERE cramers_v >= 0.1")
def categorical_association(spark, sf):
    out = _orders_evidence(spark, sf, None).associations()
    return out.select(F.element_at("columns", 1).alias("a"), F.element_at("columns", 2).alias("b"),
                      F.col("sample_size").alias("n"), F.col("statistics")["chi_square"].alias("chi_square"),
                      F.col("value").alias("cramers_v"))


@query(f"""WITH {GAPPY}, {_levels_sql(["o_orderstatus", "o_orderpriority", "mix"], "g")[5:]},
  r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS p FROM c)
  SELECT "column", level, round(100.0 * n / valid, 1) AS value, valid AS sample_size, CASE WHEN round(100.0 * n / valid, 1) >= 60
  THEN 'strong' WHEN round(100.0 * n / valid, 1) >= 35 THEN 'moderate' ELSE 'weak' END AS strength
  FROM r JOIN t USING ("column") WHERE p = 1 AND round(100.0 * n / valid, 1) >= 20""")
def category_share(spark, sf):
    out = _orders_evidence(spark, sf, None).category_shares()
    return out.select(F.element_at("columns", 1).alias("column"), F.regexp_extract("claim", '"(.*)"', 1).alias("level"), "value",
                      "sample_size", "strength")


@query(f"""WITH {_YEARS}, r AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS k FROM p),
  a AS (SELECT max(k) AS k, avg(n) FILTER (i <= k // 3) AS f, avg(n) FILTER (i > k - k // 3) AS l, CAST(sum(n) AS BIGINT) AS n FROM r)
  SELECT 'activity by o_orderdate is ' || CASE WHEN l > f THEN 'increasing' ELSE 'decreasing' END || ' across ' || k ||
  ' year periods (' || (SELECT strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') FROM orders)
  || ')' AS claim, n AS sample_size FROM a WHERE abs((l - f) / f) >= 0.15""")
def period_volume_trend(spark, sf):
    return _orders_evidence(spark, sf).volume_trend().select("claim", "sample_size")


@query(f"""WITH {_YEARS}, r AS (SELECT period, n, lag(period) OVER (ORDER BY period) AS pp, lag(n) OVER (ORDER BY period) AS pn FROM p),
  z AS (SELECT *, round(100.0 * (n - pn) / pn, 1) AS x FROM r ORDER BY period DESC LIMIT 1)
  SELECT period || ' has ' || n || ' rows vs ' || pn || ' in ' || pp || ' (' || CASE WHEN x >= 0 THEN '+' ELSE '' END || {_ntext('x')} || '%)'
  AS claim, x AS value, n + pn AS sample_size, CASE WHEN abs(x) >= 50 THEN 'strong' WHEN abs(x) >= 20 THEN 'moderate' ELSE 'weak' END
  AS strength FROM z""")
def period_change(spark, sf):
    return _orders_evidence(spark, sf).period_change().select("claim", "value", "sample_size", "strength")


def _rising_events(spark, sf, columns=("ts", "rising")) -> Evidence:
    rising = F.expr("value + 8 * day(ts)")
    t = Table(N.load(spark, sf, "events").withColumn("rising", rising), list(columns), "event_id")
    return Evidence(P.Profile(t), "rising")


_RISING = "e AS (SELECT event_id, ts, value + 8 * day(ts) AS v FROM events)"


@query(f"""WITH {_RISING}, o AS (SELECT v, row_number() OVER (ORDER BY ts, event_id) AS t FROM e),
  k AS (SELECT v, t, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM o),
  c AS (SELECT count(*) AS n, corr(t, v) AS p, corr(t, r) AS s FROM k)
  SELECT CASE WHEN abs(s) - abs(p) >= 0.2 THEN round(s, 4) ELSE round(p, 4) END AS value, n AS sample_size FROM c""")
def target_time_trend(spark, sf):
    return _rising_events(spark, sf).time_trend().select("value", "sample_size")


@query(f"""WITH {_RISING}, {_SHIFT} SELECT 'rising has a candidate level shift near ' || strftime(ts, '%Y-%m-%d') || ' (median ' ||
  {_ntext('round(mb, 4)')} || ' to ' || {_ntext('round(ma, 4)')} || ')' AS claim, round(effect, 4) AS value, n AS sample_size
  FROM w JOIN s ON s.i = w.split""")
def candidate_level_shift(spark, sf):
    return _rising_events(spark, sf).candidate_shift().select("claim", "value", "sample_size")


@query(f"""WITH {EVENT_FENCES}, o AS (SELECT "column", n, low, high, (SELECT count(*) FROM u WHERE u."column" = f."column" AND
  (v < low OR v > high)) AS k FROM f) SELECT "column" || ' has ' || k || ' value(s) outside the IQR fences (' ||
  {_ntext('round(round(low, 4), 2)')} || ' to ' || {_ntext('round(round(high, 4), 2)')} || ')' AS claim, CAST(k AS DOUBLE) AS value,
  n AS sample_size, CASE WHEN k / n >= 0.05 THEN 'moderate' ELSE 'weak' END AS strength FROM o WHERE k > 0""")
def outlier_evidence(spark, sf):
    out = Evidence(N.profile(spark, sf, "events", row_id="event_id"), "value").outliers()
    return out.select("claim", "value", "sample_size", "strength")


@query("""WITH e AS (SELECT 'order ' || o_orderkey AS claim, CASE o_orderpriority WHEN '1-URGENT' THEN 'very strong'
  WHEN '2-HIGH' THEN 'strong' WHEN '3-MEDIUM' THEN 'moderate' WHEN '5-LOW' THEN 'weak' ELSE 'negligible' END AS strength,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS size FROM orders)
  SELECT claim, strength, size, row_number() OVER (ORDER BY list_position(['very strong', 'strong', 'moderate', 'weak', 'negligible'], strength),
    size DESC NULLS LAST, claim) - 1 AS place FROM e""")
def ranked_evidence(spark, sf):
    """All orders ranked as records, those without a number last within their strength."""
    words = F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'very strong' WHEN '2-HIGH' THEN 'strong'
      WHEN '3-MEDIUM' THEN 'moderate' WHEN '5-LOW' THEN 'weak' ELSE 'negligible' END""")
    o = N.load(spark, sf, "orders").select(
        F.concat(F.lit("order "), "o_orderkey").alias("claim"), words.alias("strength"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("value"))
    ranked = durable(rank_evidence(o, limit=None).select("claim", "strength", F.col("value").alias("size")))
    # The rows lie in order of rank; partitions keep it.
    return ranked.withColumn("at", F.monotonically_increasing_id()).transform(lambda r: with_position(r, ["at"], name="place")).drop("at")


_UNDATED = ["o_orderstatus", "o_orderpriority", "price", "tier", "mix"]
_KINDS = ["o_orderstatus", "o_orderpriority", "mix"]


def _fence_sql(c: str) -> str:
    return f"""SELECT '{c} has ' || n || ' value(s) outside the IQR fences (' || {_ntext('round(round(lo, 4), 2)')} || ' to ' || {_ntext('round(round(hi, 4), 2)')}
    || ')' AS claim, 'iqr_outliers' AS metric, CAST(n AS DOUBLE) AS value, CASE WHEN 1.0 * n / valid >= 0.05 THEN 'moderate' ELSE 'weak' END AS strength,
    valid AS sample_size FROM (SELECT count({c}) FILTER ({c} < lo OR {c} > hi) AS n, count({c}) AS valid, any_value(lo) AS lo, any_value(hi) AS hi
    FROM g, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
      quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM g)) WHERE n > 0"""


# The evidence of a table without dates and target: correlations, associations, leading levels and outliers.
_EVIDENCE = f"""{_levels_sql(_KINDS, "g", GAPPY + ", ")},
  rp AS ({_pairs_sql(["price", "tier"], lambda a, b: f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS p", "g")}),
  rs AS ({_spearman_sql("price", "tier", "g")}),
  rc AS (SELECT a, b, rp.n, abs(spearman) - abs(p) >= 0.2 AS ranked, round(CASE WHEN abs(spearman) - abs(p) >= 0.2 THEN spearman ELSE p END, 4) AS r
    FROM rp JOIN rs USING (a, b)),
  av AS (SELECT a, b, n, cramers_v AS v, CASE WHEN cramers_v >= 0.5 THEN 'strong' WHEN cramers_v >= 0.3 THEN 'moderate' ELSE 'weak' END AS st
    FROM ({" UNION ALL ".join(f"SELECT * FROM {_chi_sql(a, b, 'g')}" for a, b in C.column_pairs(_KINDS))}) WHERE cramers_v >= 0.1),
  top AS (SELECT "column", level, valid, uniq, round(100.0 * n / valid, 1) AS share FROM c JOIN t USING ("column")
    QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) = 1),
  e AS (SELECT a || ' and ' || b || CASE WHEN r > 0 THEN ' rise together (' ELSE ' move in opposite directions (' END || CASE WHEN ranked THEN 'spearman '
      ELSE 'pearson ' END || CASE WHEN r >= 0 THEN '+' ELSE '' END || {_ntext('r')} || ')' AS claim, CASE WHEN ranked THEN 'spearman_rho' ELSE 'pearson_r' END AS metric,
      r AS value, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength,
      n AS sample_size FROM rc WHERE abs(r) >= 0.3 AND n >= 3 UNION ALL
    SELECT a || ' and ' || b || ' have ' || st || ' categorical association (Cramér''s V ' || {_ntext('v')} || ')', 'cramers_v', v, st, n FROM av UNION ALL
    SELECT "column" || ' is dominated by "' || level || '" (' || {_ntext('share')} || '% of ' || valid || ' values across ' || uniq || ' levels)', 'category_share',
      share, CASE WHEN share >= 60 THEN 'strong' WHEN share >= 35 THEN 'moderate' ELSE 'weak' END, valid FROM top WHERE share >= 20 AND valid >= 8 UNION ALL
    {_fence_sql('price')} UNION ALL {_fence_sql('tier')})"""


def _undated(spark, sf) -> Evidence:
    return Evidence(P.Profile(Table(N.gappy_orders(spark, sf), _UNDATED)))


@query(f"{_EVIDENCE} SELECT * FROM e")
def build_evidence(spark, sf):
    """All that a table without dates and target shows; the families of dates and targets have rows of their own."""
    return _undated(spark, sf).build().select("claim", "metric", "value", "strength", "sample_size")


@query()
def build_target_evidence(spark, sf):
    return _orders_evidence(spark, sf).build().drop("statistics", "context")


@query(f"""WITH {GAPPY}, r AS (SELECT count(*) AS n, count(price) AS p, count(tier) AS t, count(*) FILTER (price IS NOT NULL AND
  year(o_orderdate) >= (SELECT max(year(o_orderdate)) - 1 FROM orders)) AS y, count(*) FILTER (year(o_orderdate) >=
  (SELECT max(year(o_orderdate)) - 1 FROM orders)) AS z FROM g)
  SELECT 'group_mean_difference' AS metric, n AS input_rows, p AS included_rows, n - p AS excluded_rows, 'missing price: ' || (n - p) AS reasons FROM r
  UNION ALL SELECT 'missingness_mean_difference', n, p, n - p, 'missing price: ' || (n - p) FROM r
  UNION ALL SELECT 'period_volume_trend', n, n, 0, '' FROM r
  UNION ALL SELECT 'period_over_period_change', n, z, n - z, 'o_orderdate outside compared periods: ' || (n - z) FROM r""")
def provenance(spark, sf):
    e = _orders_evidence(spark, sf)
    found = durable(rank_evidence(
        e.group_differences().filter(F.element_at("columns", 2) == "o_orderstatus").unionByName(e.missingness_impact())
        .unionByName(e.volume_trend()).unionByName(e.period_change())))
    out = Provenance(e.profile, found).summary()
    reasons = F.array_join(F.transform("exclusion_reasons", lambda r: F.concat(r.reason, F.lit(": "), r["count"])), "; ")
    return out.select("metric", "input_rows", "included_rows", "excluded_rows", reasons.alias("reasons"))


@query(f"""WITH {GAPPY}, i AS (SELECT o_orderkey, price, tier, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM g
  WHERE price IS NOT NULL), x AS (SELECT DISTINCT CAST(floor(j * (n - 1) / 9.0 + 0.5) AS BIGINT) AS k
  FROM (SELECT unnest(range(10)) AS j), (SELECT max(n) AS n FROM i))
  SELECT o_orderkey AS "row", 'price' AS "column", {_ntext('price')} AS value FROM i JOIN x USING (k) UNION ALL
  SELECT o_orderkey, 'tier', CAST(tier AS VARCHAR) FROM i JOIN x USING (k)""")
def source_rows(spark, sf):
    e = _orders_evidence(spark, sf)
    return Provenance(e.profile, durable(e.missingness_impact())).source_rows().select("row", "column", "value")


@query(f"""WITH {GAPPY}, o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place_in, count(*) OVER () AS n FROM g),
  q AS (SELECT min(price) AS lo, max(price) AS hi, round(quantile_cont(price, 0.5), 4) AS md, quantile_cont(price, 0.25) AS q1,
    quantile_cont(price, 0.75) AS q3, quantile_cont(tier, 0.25) AS t1, quantile_cont(tier, 0.75) AS t3 FROM g),
  levels AS (SELECT o_orderstatus AS l, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS k FROM g GROUP BY 1),
  c AS (
    SELECT min(o_orderkey) AS "row", 'first row' AS reason, 0 AS kind, 0 AS place FROM g UNION ALL
    SELECT max(o_orderkey), 'last row', 0, 1 FROM g UNION ALL
    SELECT arg_min(o_orderkey, (abs(price - md), o_orderkey)), 'median price', 1, 2 FROM g, q WHERE price IS NOT NULL UNION ALL
    SELECT arg_min(o_orderkey, (abs(price - round(q1, 4)), o_orderkey)), 'lower quartile price', 1, 3 FROM g, q WHERE price IS NOT NULL UNION ALL
    SELECT arg_min(o_orderkey, (abs(price - round(q3, 4)), o_orderkey)), 'upper quartile price', 1, 4 FROM g, q WHERE price IS NOT NULL UNION ALL
    SELECT arg_min(o_orderkey, (abs(price - lo), o_orderkey)), 'minimum price', 1, 5 FROM g, q WHERE price IS NOT NULL UNION ALL
    SELECT arg_min(o_orderkey, (abs(price - hi), o_orderkey)), 'maximum price', 1, 6 FROM g, q WHERE price IS NOT NULL UNION ALL
    SELECT * FROM (SELECT o_orderkey, 'missing ' || concat_ws(', ', CASE WHEN price IS NULL THEN 'price' END,
      CASE WHEN tier IS NULL THEN 'tier' END), 2, 0 FROM g WHERE price IS NULL OR tier IS NULL ORDER BY o_orderkey LIMIT 2) UNION ALL
    SELECT min(o_orderkey), 'outlier in price', 3, 7 FROM g, q WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) UNION ALL
    SELECT min(o_orderkey), 'outlier in tier', 3, 8 FROM g, q WHERE tier < t1 - 1.5 * (t3 - t1) OR tier > t3 + 1.5 * (t3 - t1) UNION ALL
    SELECT min(o_orderkey), 'o_orderstatus = ' || l, 4, 8 + k FROM g JOIN levels ON l = o_orderstatus WHERE k <= 3 GROUP BY l, k UNION ALL
    SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)), 'earliest o_orderdate', 5, 20 FROM g UNION ALL
    SELECT arg_min(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)), 'latest o_orderdate', 5, 21 FROM g),
  base AS (SELECT * FROM c WHERE "row" IS NOT NULL), had AS (SELECT DISTINCT "row" FROM base), b AS (SELECT count(*) AS taken FROM had),
  spread AS (SELECT o_orderkey AS "row", 'spread sample' AS reason, 6 AS kind, place_in AS place,
    coalesce(sum(CASE WHEN h."row" IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY place_in ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new
    FROM o LEFT JOIN had h ON h."row" = o_orderkey WHERE place_in > 0 AND place_in % greatest(1, n // 15) = 0),
  picked AS (SELECT * FROM base UNION ALL SELECT "row", reason, kind, place FROM spread, b WHERE taken < 14 AND taken + new < 14)
  SELECT "row", string_agg(reason, ' | ' ORDER BY kind, place, reason) AS reasons FROM picked GROUP BY 1 ORDER BY 1 LIMIT 14""")
def representative_sample(spark, sf):
    """All reasons of the sample as it is shown."""
    p = P.Profile(Table(N.gappy_orders(spark, sf), ORDER_COLUMNS, "o_orderkey"))
    return R.representative_sample(p).select("row", F.array_join("reasons", " | ").alias("reasons"))


@query("""WITH f AS (SELECT min(event_id) AS a, max(event_id) AS z FROM events),
  r AS (SELECT a AS "row", 'first row' AS reason FROM f UNION ALL SELECT z, 'last row' FROM f UNION ALL
  SELECT (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1), 'earliest ts' UNION ALL
  SELECT (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 1), 'latest ts' UNION ALL
  SELECT (SELECT event_id FROM events ORDER BY abs(value - (SELECT round(median(value), 4) FROM events)), event_id LIMIT 1), 'median value' UNION ALL
  SELECT (SELECT event_id FROM events ORDER BY value, event_id LIMIT 1), 'minimum value' UNION ALL
  SELECT (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 1), 'maximum value')
  SELECT * FROM r""")
def sample_reasons(spark, sf):
    """The single-row reasons of the sample, before it is cut to its length."""
    p = N.profile(spark, sf, "events", ["ts", "value"], "event_id")
    picked = R.representative_sample(p, limit=64).select("row", F.explode("reasons").alias("reason"))
    return picked.filter(F.col("reason").rlike("row$|ts$|median value|minimum value|maximum value"))


# -- comparison -------------------------------------------------------------------

def _compare(spark, sf) -> M.Comparison:
    return M.Comparison(*N.sides(spark, sf))


OLD = "a AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')"
NEW = """b AS (SELECT l_quantity, l_extendedprice * 1.25 AS l_extendedprice, CASE WHEN l_linenumber < 3 THEN 'A' ELSE l_returnflag END
  AS l_returnflag, l_linestatus, l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


def _types_sql(source: str) -> str:
    """The type of each column by its texts, half of which must read as numbers."""
    return f"""(SELECT "column", CASE WHEN avg(CAST(try_cast(v AS DOUBLE) IS NOT NULL AS INTEGER)) >= 0.5 THEN 'numeric' ELSE 'categorical' END AS t
    FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM ({source})) ON COLUMNS(*) INTO NAME "column" VALUE v) GROUP BY 1)"""


@query(f"""WITH a AS {_types_sql("SELECT l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_tax::VARCHAR AS code FROM lineitem "
                                 "WHERE l_shipdate < TIMESTAMP '1998-01-01'")},
  b AS {_types_sql("SELECT l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_tax, 'T' || l_tax AS code FROM lineitem "
                   "WHERE l_shipdate >= TIMESTAMP '1998-01-01'")}
  SELECT coalesce(a."column", b."column") AS "column", a.t AS baseline_type, b.t AS current_type,
    CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'shared' END AS status, coalesce(a.t <> b.t, false) AS type_changed
  FROM a FULL JOIN b ON a."column" = b."column" """)
def schema_diff(spark, sf):
    return _compare(spark, sf).schema_diff().drop("baseline_position", "current_position")


@query(f"""WITH {OLD}, {NEW}, n AS (
  SELECT 'l_quantity' AS "column", (SELECT round(avg(l_quantity), 4) FROM a) AS x, (SELECT round(avg(l_quantity), 4) FROM b) AS y,
    (SELECT round(median(l_quantity), 4) FROM a) AS p, (SELECT round(median(l_quantity), 4) FROM b) AS q UNION ALL
  SELECT 'l_extendedprice', (SELECT round(avg(l_extendedprice), 4) FROM a), (SELECT round(avg(l_extendedprice), 4) FROM b),
    (SELECT round(median(l_extendedprice), 4) FROM a), (SELECT round(median(l_extendedprice), 4) FROM b))
  SELECT "column", round(y - x, 4) AS mean_delta, round((y - x) / abs(x) * 100, 1) AS mean_pct, round(q - p, 4) AS median_delta,
  NULL AS unique_delta, NULL AS dominant_changed FROM n UNION ALL
  SELECT 'l_returnflag', NULL, NULL, NULL, (SELECT count(DISTINCT l_returnflag) FROM b) - (SELECT count(DISTINCT l_returnflag) FROM a),
  (SELECT l_returnflag FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) <> (SELECT l_returnflag FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  UNION ALL SELECT 'l_linestatus', NULL, NULL, NULL, (SELECT count(DISTINCT l_linestatus) FROM b) - (SELECT count(DISTINCT l_linestatus) FROM a),
  (SELECT l_linestatus FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) <> (SELECT l_linestatus FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def column_delta(spark, sf):
    return _compare(spark, sf).column_delta().select(
        "column", "mean_delta", "mean_pct", "median_delta", "unique_delta", "dominant_changed")


def _side_welch(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM a) AS n1, (SELECT avg({c}) FROM a) AS m1, (SELECT var_samp({c}) FROM a) AS v1, "
            f"(SELECT count({c}) FROM b) AS n2, (SELECT avg({c}) FROM b) AS m2, (SELECT var_samp({c}) FROM b) AS v2")


@query(f"""WITH {OLD}, {NEW}, w AS ({_side_welch('l_quantity')} UNION ALL {_side_welch('l_extendedprice')})
  SELECT "column", n1 AS baseline_n, n2 AS current_n, round(m2 - m1, 4) AS difference, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 4) AS t,
  round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 2) AS degrees_freedom FROM w""")
def mean_shift(spark, sf):
    return _compare(spark, sf).mean_shift().select(
        "column", *[f"welch.{c}" for c in ("baseline_n", "current_n", "difference", "t", "degrees_freedom")])


def _side_ks(c: str) -> str:
    return f"""(WITH v AS (SELECT {c} AS x, false AS c FROM a UNION ALL SELECT {c}, true FROM b),
  g AS (SELECT x, count(*) FILTER (NOT c) AS a, count(*) FILTER (c) AS b FROM v GROUP BY 1),
  r AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM g)
  SELECT '{c}' AS "column", round(max(abs(fa - fb)), 4) AS statistic FROM r)"""


@query(f"WITH {OLD}, {NEW} SELECT * FROM {_side_ks('l_quantity')} UNION ALL SELECT * FROM {_side_ks('l_extendedprice')}")
def distribution_shift(spark, sf):
    return _compare(spark, sf).distribution_shift().select("column", "statistic")


@query(f"""WITH {OLD}, {NEW} SELECT (SELECT count(*) FROM a) AS baseline_rows, (SELECT count(*) FROM b) AS current_rows,
  (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS row_delta, 6 AS baseline_columns, 6 AS current_columns, 5 AS shared_columns,
  0.0 AS completeness_delta""")
def comparison_summary(spark, sf):
    return _compare(spark, sf).summary().select(
        "baseline_rows", "current_rows", "row_delta", F.col("baseline_columns").cast("int").alias("baseline_columns"),
        F.col("current_columns").cast("int").alias("current_columns"), "shared_columns", "completeness_delta")


def _leader_sql(c: str) -> str:
    def side(t):
        return (f"(SELECT {c} AS l, round(100.0 * count(*) / (SELECT count({c}) FROM {t}), 1) AS share FROM {t} WHERE {c} IS NOT NULL "
                f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
    return (f"SELECT 'low' AS severity, '{c} has a new leading category' AS title, x.l || ' (' || {_ntext('x.share')} || '%) to ' || y.l || ' (' || "
            f"{_ntext('y.share')} || '%).' AS detail, 'categorical.dominant' AS metric, '{c}' AS columns FROM {side('a')} x, {side('b')} y WHERE x.l <> y.l")


@query(f"""WITH {OLD}, {NEW}, w AS ({_side_welch('l_quantity')} UNION ALL {_side_welch('l_extendedprice')}),
  d AS (SELECT "column" AS c, n1, n2, round(m1, 4) AS m1, round(m2, 4) AS m2, m2 - m1 AS diff, sqrt(v1 / n1 + v2 / n2) AS se, 1.959963984540054 AS z,
    (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS k FROM w),
  q AS (SELECT *, z + (z ** 3 + z) / (4 * k) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * k ** 2) AS tc, round((m2 - m1) / abs(m1) * 100, 1) AS pct FROM d),
  ks AS (SELECT * FROM {_side_ks('l_quantity')} UNION ALL SELECT * FROM {_side_ks('l_extendedprice')}),
  n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b), r AS (SELECT *, round(100.0 * (b - a) / a, 1) AS pct FROM n),
  both_text AS (SELECT *, {_ntext('m1')} || ' to ' || {_ntext('m2')} AS means FROM q)
  SELECT 'high' AS severity, '1 shared column changed type' AS title, 'code: numeric to categorical' AS detail, 'schema.type' AS metric, 'code' AS columns
  UNION ALL SELECT 'medium', '1 column added', 'l_tax', 'schema.added', 'l_tax' UNION ALL SELECT 'medium', '1 column removed', 'l_discount', 'schema.removed', 'l_discount'
  UNION ALL SELECT 'medium', 'Row count ' || CASE WHEN pct > 0 THEN 'increased ' ELSE 'decreased ' END || {_ntext('abs(pct)')} || '%', a || ' to ' || b || ' rows.', 'rows', ''
    FROM r WHERE abs(pct) >= 10
  UNION ALL SELECT 'medium', c || ' mean difference excludes zero at 95% confidence', means || '; difference ' || {_ntext('round(diff, 4)')} || ', 95% CI '
    || {_ntext('round(diff - tc * se, 4)')} || ' to ' || {_ntext('round(diff + tc * se, 4)')} || '. Exploratory and unadjusted across columns.', 'numeric.mean_shift', c
    FROM both_text WHERE abs(diff) > tc * se
  UNION ALL SELECT 'low', c || ' mean ' || CASE WHEN pct > 0 THEN 'increased ' ELSE 'decreased ' END || {_ntext('abs(pct)')} || '%',
    means || '; descriptive change, before significance testing.', 'numeric.mean', c FROM both_text WHERE abs(diff) <= tc * se AND abs(pct) >= 10
  UNION ALL SELECT 'medium', "column" || ' distribution shifted', 'Two-sample KS D=' || {_ntext('statistic')}
    || '. This tests the full distribution and is exploratory and unadjusted across columns.', 'numeric.distribution_shift', "column" FROM ks WHERE statistic >= 0.2
  UNION ALL {_leader_sql('l_returnflag')} UNION ALL {_leader_sql('l_linestatus')}""")
def findings(spark, sf):
    """All findings of the two sides; p-values are left out of their texts, the interval's ends are compared."""
    bare = F.regexp_replace("detail", r", p=[0-9.e-]+\. ", ". ")
    return _compare(spark, sf).findings().withColumn("detail", bare).withColumn("columns", F.array_join("columns", ","))


@query(f"""WITH {OLD}, {NEW}, k AS (SELECT * FROM {_side_ks('l_quantity')} UNION ALL SELECT * FROM {_side_ks('l_extendedprice')}),
  r AS (SELECT 'l_quantity' AS "column", (SELECT least(min(a.l_quantity), (SELECT min(l_quantity) FROM b)) FROM a) AS low,
  (SELECT greatest(max(a.l_quantity), (SELECT max(l_quantity) FROM b)) FROM a) AS high, (SELECT median(l_quantity) FROM a) AS x,
  (SELECT median(l_quantity) FROM b) AS y UNION ALL SELECT 'l_extendedprice',
  (SELECT least(min(a.l_extendedprice), (SELECT min(l_extendedprice) FROM b)) FROM a),
  (SELECT greatest(max(a.l_extendedprice), (SELECT max(l_extendedprice) FROM b)) FROM a), (SELECT median(l_extendedprice) FROM a),
  (SELECT median(l_extendedprice) FROM b))
  SELECT "column", round(low, 4) AS low, round(high, 4) AS high, statistic, round((x - low) / (high - low) * 100, 3) AS baseline_median,
  round((y - low) / (high - low) * 100, 3) AS current_median FROM r JOIN k USING ("column")""")
def shift_strips(spark, sf):
    return _compare(spark, sf).shift_strips().select(
        "column", "low", "high", "statistic", F.round("baseline_median", 3).alias("baseline_median"),
        F.round("current_median", 3).alias("current_median"))


# -- rollups ----------------------------------------------------------------------

_READ = [*GAPS, "price_num"]


@query(f"""WITH {MESSY}, p AS (""" + _pairs_sql(_READ, lambda a, b: f"corr({a}, {b}) AS p, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n", "m")
       + "), s AS (" + " UNION ALL ".join(_spearman_sql(a, b, "m") for a, b in C.column_pairs(_READ)) + """),
  j AS (SELECT CASE WHEN abs(spearman) - abs(p) >= 0.2 THEN spearman ELSE p END AS c FROM p JOIN s USING (a, b) WHERE p.n >= 3),
  l AS (SELECT "column", count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM (
    UNPIVOT (SELECT gappy_quantity, gappy_price, gappy_tax, price_num FROM m) ON COLUMNS(*) INTO NAME "column" VALUE v) GROUP BY 1),
  k AS (SELECT count(price_num) AS num, count(*) FILTER (NOT price_blank AND price_num IS NULL) AS txt FROM m)
  SELECT 'Column types' AS label, 4 - CAST(mixed AS INTEGER) AS settled, CAST(mixed AS INTEGER) AS open
    FROM (SELECT greatest(num, txt) < 0.8 * (num + txt) AS mixed FROM k) UNION ALL
  SELECT 'Outlier checks', count(*) FILTER (n >= 8 AND q3 > q1), count(*) FILTER (NOT (n >= 8 AND q3 > q1)) FROM l UNION ALL
  SELECT 'Numeric pairs', least(10, count(*) FILTER (abs(c) >= 0.3)), 6 - least(10, count(*) FILTER (abs(c) >= 0.3)) FROM j""")
def read_ledger(spark, sf):
    p = P.Profile(Table(N.messy_lineitem(spark, sf), [*GAPS, "price_text"]))
    return U.read_ledger(p)


@query(f"""WITH {MESSY}, c AS (SELECT count(*) FILTER (NOT price_blank AND price_num IS NULL) AS n FROM m)
  SELECT '1 column could not be typed' AS text, 1 AS n UNION ALL SELECT n || ' cells could not be read as numbers', n FROM c UNION ALL
  SELECT '1 of 6 numeric pairs cleared the reporting bar', 5""")
def unsettled_reads(spark, sf):
    return U.unsettled_reads(P.Profile(Table(N.messy_lineitem(spark, sf), [*GAPS, "price_text"]))).select("text", "n")


@query(f"""{_EVIDENCE}, f AS (SELECT * FROM (VALUES (0, 'Correlations', true, 'two numeric columns', ['pearson_r', 'spearman_rho']),
    (1, 'Group differences', false, 'a numeric target column', ['group_mean_difference', 'missingness_mean_difference']),
    (2, 'Associations', true, 'two category columns', ['cramers_v']), (3, 'Dominant levels', true, 'a category column', ['category_share']),
    (4, 'Time patterns', false, 'a date column with six dated rows', ['period_volume_trend']),
    (5, 'Level shifts', false, 'a date column and a numeric target', ['candidate_level_shift']),
    (6, 'Outliers', true, 'a numeric column', ['iqr_outliers'])) v(place, family, applicable, needs, metrics))
  SELECT place, family, applicable, needs, (SELECT count(*) FROM e WHERE list_contains(metrics, metric)) AS found FROM f""")
def family_coverage(spark, sf):
    """A table without dates and target: those families do not apply."""
    e = _undated(spark, sf)
    return U.family_coverage(e, durable(e.build()))


@query(f"""WITH e AS (SELECT event_id, value AS v FROM events),
  q AS (SELECT count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM e),
  o AS (SELECT max(n) AS n, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS k FROM e, q)
  SELECT 'iqr_outliers' AS metric, n, k || ' outside fences' AS effect FROM o""")
def finding_vitals(spark, sf):
    e = Evidence(N.profile(spark, sf, "events", ["ts", "value"], "event_id"), "value")
    return U.finding_vitals(e.outliers()).select("metric", "n", "effect")


@query(f"""{_SUMMARY} SELECT "column", round((p[1] - lo) / (hi - lo) * 100, 4) AS p05_at, round((p[3] - lo) / (hi - lo) * 100, 4) AS median_at,
  round((p[5] - lo) / (hi - lo) * 100, 4) AS p95_at FROM f""")
def spread_strip(spark, sf):
    out = U.spread_strip(N.profile(spark, sf, "lineitem", MEASURES))
    return out.select("column", *[F.round(c, 4).alias(c) for c in ("p05_at", "median_at", "p95_at")])


@query(f"""WITH {MESSY} SELECT 'price_text' AS "column", round(100.0 * count(price_num) / count(*), 2) AS valid_pct,
  round(100.0 * count(*) FILTER (price_blank) / count(*), 2) AS missing_pct,
  round(100.0 * count(*) FILTER (NOT price_blank AND price_num IS NULL) / count(*), 2) AS invalid_pct FROM m UNION ALL
  SELECT 'gappy_tax', round(100.0 * count(gappy_tax) / count(*), 2), round(100.0 * (count(*) - count(gappy_tax)) / count(*), 2), 0.0 FROM m""")
def completeness_track(spark, sf):
    return U.completeness_track(P.Profile(Table(N.messy_lineitem(spark, sf), ["price_text", "gappy_tax"])))


@query("""SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text'
  ELSE 'date' END AS type, count(*) AS columns FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def kind_counts(spark, sf):
    return U.kind_counts(N.profile(spark, sf, "lineitem"))


@query("""WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem)
  SELECT CAST(least(floor((l_quantity - lo) / w), 9) AS INTEGER) AS bin, count(*) AS "count", round(avg(l_extendedprice), 2) AS mean
  FROM lineitem, e GROUP BY 1""")
def chart_bin_mean(spark, sf):
    return U.chart_bin_mean(N.profile(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice").drop("start")


@query("""SELECT o_orderpriority AS level, round(sum(CASE WHEN o_totalprice = 0 THEN 1 ELSE o_totalprice END), 2) AS total
  FROM orders GROUP BY 1 ORDER BY total DESC, level LIMIT 12""")
def chart_category_sum(spark, sf):
    out = U.chart_category_sum(N.profile(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("level", F.round("total", 2).alias("total"))


@query("""SELECT o_orderkey AS "row", strftime(o_orderdate, '%Y-%m-%d') AS label, o_totalprice AS y FROM orders
  ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def chart_line(spark, sf):
    p = N.profile(spark, sf, "orders", ["o_orderdate", "o_totalprice"], "o_orderkey")
    return U.chart_line(p, "o_orderdate", "o_totalprice").withColumn("label", F.substring("label", 1, 10))


@query("""SELECT event_type AS level, count(*) AS "count", min(event_id) AS first_row FROM events GROUP BY 1 ORDER BY 3 LIMIT 8""")
def chart_pie(spark, sf):
    return U.chart_pie(N.profile(spark, sf, "events", row_id="event_id"), "event_type")


@query("""SELECT c_custkey AS "row", CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer ORDER BY c_custkey LIMIT 200""")
def chart_scatter(spark, sf):
    return U.chart_scatter(N.profile(spark, sf, "customer", row_id="c_custkey"), "c_nationkey", "c_acctbal")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders)
  SELECT 'o_totalprice' AS "column", 'histogram' AS kind, CAST(least(floor((o_totalprice - lo) / w), 9) AS INTEGER) AS at, count(*) AS value
  FROM orders, e GROUP BY 3 UNION ALL
  SELECT 'o_orderdate', 'trend', CAST(row_number() OVER (ORDER BY y) - 1 AS INTEGER), n FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)
  UNION ALL SELECT 'o_orderstatus', 'category', CAST(row_number() OVER (ORDER BY n DESC, s) - 1 AS INTEGER), n
  FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)""")
def chart_catalogue(spark, sf):
    out = U.chart_catalogue(N.profile(spark, sf, "orders", ["o_totalprice", "o_orderdate", "o_orderstatus"]), "o_totalprice")
    return out.select("column", "kind", F.posexplode("points").alias("at", "point")).select(
        "column", "kind", "at", F.col("point.value").alias("value"))


# -- raw sheets -------------------------------------------------------------------

@query(f"""WITH {SHEET} SELECT blank, CAST(sum(n) AS BIGINT) AS n FROM (SELECT false AS blank, n + 3 AS n FROM s UNION ALL SELECT true, 1 FROM s)
  GROUP BY 1""")
def is_blank_row(spark, sf):
    grid = N.order_sheets(spark, sf)
    return grid.groupBy(G.is_blank_row(F.col("cells")).alias("blank")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SHEET} SELECT span, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 0 AS span, 1 AS n FROM s UNION ALL SELECT 1, 1 FROM s
  UNION ALL SELECT 3, n + 2 FROM s) GROUP BY 1""")
def row_span(spark, sf):
    grid = N.order_sheets(spark, sf)
    return grid.groupBy(G.row_span(F.col("cells")).alias("span")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_custkey AS k, 1 + CAST(floor(o_totalprice) AS BIGINT) % 4 AS span, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT 'c' || k AS file_id, span AS width FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, span DESC) AS p FROM r)
  WHERE p = 1""")
def modal_width(spark, sf):
    """Ragged sheets: a row is as wide as its order's price says, and blank rows lie between."""
    o = N.load(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    span = (F.floor("o_totalprice") % 4 + 1).cast("int")
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("file_id"), (2 * F.row_number().over(w)).cast("long").alias("row_no"),
                    F.concat(F.array_repeat(F.lit("x"), span), F.array(F.lit(" "), F.lit(None).cast("string"))).alias("cells"))
    blank = rows.withColumn("row_no", F.col("row_no") + 1).withColumn("cells", F.array(F.lit(""), F.lit(None).cast("string")))
    return G.modal_width(G.read_rows(rows.unionByName(blank))).select("file_id", F.col("width").cast("long").alias("width"))


@query(f"""WITH {SHEET} SELECT 'c' || k AS file_id, 3 AS row_no, 1.0 AS reach, 1.0 AS distinct_share,
  round(1 - (2.0 * least(n, 10) + CASE WHEN n < 10 THEN 1 ELSE 0 END) / (3 * least(n, 10) + CASE WHEN n < 10 THEN 2 ELSE 0 END), 6) AS contrast,
  1.0 AS agreement FROM s""")
def header_candidates(spark, sf):
    """The header row's own scores; contrast follows from the ten rows under it."""
    rows = G.read_rows(N.order_sheets(spark, sf))
    out = G.header_candidates(rows, G.modal_width(rows)).select("file_id", F.explode("candidates").alias("c"))
    return out.filter("c.row_no = 3").select(
        "file_id", F.col("c.row_no").cast("int").alias("row_no"), "c.reach", F.col("c.distinct").alias("distinct_share"),
        F.round("c.contrast", 6).alias("contrast"), "c.agreement")


@query("SELECT DISTINCT 'c' || o_custkey AS file_id, 3 AS header_row, true AS certain FROM orders")
def choose_header(spark, sf):
    rows = G.read_rows(N.order_sheets(spark, sf))
    out = G.choose_header(G.header_candidates(rows, G.modal_width(rows)))
    return out.select("file_id", F.col("header_row").cast("int").alias("header_row"), "certain")


@query("""SELECT DISTINCT 'c' || o_custkey AS file_id, 1 AS row_no, 'preamble' AS reason, 'confident' AS confidence,
  'Orders of customer ' || o_custkey AS first_cell FROM orders""")
def preamble_rows(spark, sf):
    out = G.Sheets(N.order_sheets(spark, sf)).preamble_rows()
    return out.select("file_id", F.col("row_no").cast("int").alias("row_no"), "reason", "confidence",
                      F.element_at("cells", 1).alias("first_cell"))


@query(f"WITH {SHEET} SELECT 'c' || k AS file_id, n + 3 AS row_no, 'item|state|amount' AS cells FROM s")
def second_header(spark, sf):
    out = G.Sheets(N.double_sheets(spark, sf)).second_headers()
    return out.select("file_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query(f"WITH {SHEET} SELECT 'c' || k AS file_id, n + 4 AS row_no, 'TOTAL' AS label FROM s WHERE k % 3 <> 1")
def aggregate_label(spark, sf):
    return G.Sheets(N.order_sheets(spark, sf)).aggregate_labels()


@query(f"""WITH {SHEET} SELECT 'c' || k AS file_id, n + 4 AS row_no, 1 AS comparable, 1 AS matched FROM s WHERE k % 3 <> 2 AND n >= 2""")
def arithmetic_match(spark, sf):
    return G.Sheets(N.order_sheets(spark, sf)).arithmetic_match().drop("matched_columns")


_CONFIDENCE = """CASE WHEN k % 3 = 2 THEN 'uncertain' WHEN n < 2 THEN CASE WHEN k % 3 = 0 THEN 'uncertain' END
  WHEN k % 3 = 0 THEN 'certain' ELSE 'confident' END"""


@query(f"""WITH {SHEET} SELECT 'c' || k AS file_id, n + 4 AS row_no, 'aggregate' AS reason, {_CONFIDENCE} AS confidence,
  CASE WHEN k % 3 <> 1 THEN 'TOTAL' END AS label FROM s WHERE {_CONFIDENCE} IS NOT NULL""")
def classify_rows(spark, sf):
    return G.Sheets(N.order_sheets(spark, sf)).classify_rows()


def _corrected(spark, sf) -> G.Sheets:
    asked = N.load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("o_custkey % 5 = 0").select(
        F.concat(F.lit("c"), "o_custkey").alias("file_id"),
        F.when(F.col("o_custkey") % 2 == 0, 9_999_999).cast("long").alias("header_row"),
        F.array(F.col("n") + 4, F.lit(2).cast("long"), F.col("n") + 50).alias("include_rows"))
    return G.Sheets(N.order_sheets(spark, sf), asked)


@query(f"""WITH {SHEET}, a AS (SELECT * FROM s WHERE k % 5 = 0)
  SELECT 'c' || k AS file_id, n + 4 AS row_no, 'restored' AS outcome FROM a WHERE {_CONFIDENCE} IS NOT NULL
  UNION ALL SELECT 'c' || k, n + 4, 'not an excluded row' FROM a WHERE {_CONFIDENCE} IS NULL
  UNION ALL SELECT 'c' || k, 2, 'at or above the header row' FROM a UNION ALL SELECT 'c' || k, n + 50, 'outside the file' FROM a
  UNION ALL SELECT 'c' || k, 9999999, 'header row is outside the file' FROM a WHERE k % 2 = 0""")
def overrides(spark, sf):
    sheets = _corrected(spark, sf)
    back = sheets.set_aside.filter("restored").select("file_id", "row_no", F.lit("restored").alias("outcome"))
    return back.unionByName(sheets.unapplied().select("file_id", "row_no", F.col("reason").alias("outcome")))


@query("SELECT DISTINCT 'n' || c_nationkey AS file_id, 'possible-transpose' AS kind FROM customer")
def detect_transpose(spark, sf):
    return G.Sheets(N.turned_sheets(spark, sf)).detect_transpose().select("file_id", "kind")


@query(f"""WITH {SHEET} SELECT 'c' || k AS file_id, 3 AS header_row, 'detected' AS header_source,
  CASE WHEN {_CONFIDENCE} = 'uncertain' THEN 'uncertain' ELSE 'confident' END AS confidence,
  CASE WHEN {_CONFIDENCE} IS NULL THEN n + 1 ELSE n END AS observations, CASE WHEN {_CONFIDENCE} IS NULL THEN 1 ELSE 2 END AS excluded,
  0 AS warnings FROM s""")
def structure_report(spark, sf):
    out = G.Sheets(N.order_sheets(spark, sf)).structure_report()
    return out.select("file_id", F.col("header_row").cast("int").alias("header_row"), "header_source", "confidence", "observations",
                      "excluded", F.size("warnings").alias("warnings"))


@query("""SELECT 'n' || n_nationkey AS file_id, n_name || '|' || n_name || '_1|Column C|' || r_name || '|last' AS columns
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def name_columns(spark, sf):
    n = N.load(spark, sf, "nation").join(F.broadcast(N.load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumn("file_id", F.concat(F.lit("n"), "n_nationkey"))
    grid = N._sheet(n, 1, F.col("n_name"), F.concat(F.lit(" "), "n_name"), None, F.col("r_name"), "last").unionByName(
        N._sheet(n, 2, F.col("n_nationkey"), "x", "y", "z", "4")).unionByName(
        N._sheet(n, 3, F.col("n_nationkey"), "x", "y", "z", "7"))
    return G.Sheets(grid).name_columns().select("file_id", F.array_join("columns", "|").alias("columns"))


@query(f"""WITH {SHEET}, o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 3 AS row_no,
  'O-' || o_orderkey AS ord, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders)
  SELECT 'c' || k AS file_id, row_no, ord, status, price FROM o UNION ALL
  SELECT 'c' || k, n + 4, 'all orders', NULL, round(t, 2) FROM s WHERE k % 3 = 1 AND n < 2""")
def data_rows(spark, sf):
    out = G.Sheets(N.order_sheets(spark, sf)).data_rows()
    v = F.col("values")
    return out.select("file_id", "row_no", v["order"].alias("ord"), v["status"].alias("status"),
                      F.round(v["price"].try_cast("double"), 2).alias("price"))
