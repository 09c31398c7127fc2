import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import correlate as C, infer as I, quality as Q, ranks as R, shifts as H, timeline as L
from tallymark.operators.evidence import Evidence
from tallymark.operators.profile import Profile, level_counts
from tallymark.operators.provenance import Provenance
from tallymark.operators.quality import Quality
from tallymark.operators.sample import representative_sample
from tallymark.operators.table import Table, UnknownColumn, resolve_target, select_columns
from tallymark.operators.compare import Comparison
from tallymark.plans.catalog import QUERIES
from tallymark.session import durable
from tallymark.sources import store as B


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for i in range(41):
        revenue = 100.0 + 10 * i + (5000 if i == 40 else 0)
        rows.append((i, ["North", "South", "East"][i % 3], None if i % 10 == 9 else f"${revenue:,.2f}",
                     2.0 * i + 5, f"2024-{1 + i // 20:02d}-{1 + i % 20:02d}", "" if i % 4 else "note"))
    return spark.createDataFrame(rows, "id long, region string, revenue string, spend double, `when` string, note string")


def brute_split(v, m=5):
    n, c = len(v), np.median(v)
    mad = np.median(np.abs(v - c))
    scale = mad * 1.4826 if mad > 0 else v.std(ddof=1)
    best = None
    for i in range(m, n - m + 1):
        score = abs((np.median(v[i:]) - np.median(v[:i])) / scale) * np.sqrt(min(i, n - i) / n)
        if best is None or score > best[1]:
            best = (i, score)
    return best[0], scale


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_split_search_equals_a_scan_of_every_split(spark, seed):
    rng = np.random.default_rng(seed)
    n = [24, 700, 1500, 2500][seed]
    v = [np.r_[np.full(12, 10.0), np.full(12, 30.0)], rng.normal(size=n), rng.integers(0, 4, n).astype(float),
         rng.normal(size=n) + (np.arange(n) > n // 3)][seed]
    df = durable(spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(v)], "position long, at long, value double"))
    expected, scale = brute_split(v)
    assert H.find_split(df, n, scale, (v.min(), v.max())) == expected


def test_level_series(spark):
    df = spark.createDataFrame([(i, i, 10.0 if i < 12 else 30.0) for i in range(24)], "position long, at long, value double")
    row = H.level_shift(df).first()
    assert (row.split_index, row.median_difference) == (12, 20.0)
    assert row.inference.testable is False


def test_narrowing_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(R, "GATHERED_VALUES", 50)
    rng = np.random.default_rng(7)
    v = np.where(rng.random(4000) < 0.4, 3.0, rng.exponential(size=4000))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    places = [0, 1, 999, 1800, 2500, 3998, 3999]
    found = R.order_statistics(df, {"v": (4000, places)})["v"]
    assert [found[p] for p in places] == [np.sort(v)[p] for p in places]


@pytest.mark.parametrize("parts", [1, 7])
def test_sliced_ranks_do_not_depend_on_partitioning(spark, parts):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 500, 3000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(parts)
    got = {r.value: r["rank"] for r in R.rank_average(df, F.col("v")).collect()}
    for x in (v.min(), v.max(), v[17]):
        assert got[x] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_coefficients_of_many_gappy_columns(spark):
    """Against plain ones, pair by pair: gaps, ties, a hot value, a constant column, one with two values, one nearly empty."""
    rng = np.random.default_rng(5)
    n, width = 700, 9
    x = rng.normal(size=(n, width)) * 10.0 ** np.arange(width) + 1e6
    x[:, 1] = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 90, n))
    x[:, 2] += x[:, 0]
    x[:, 3] = 4.25
    x[rng.random((n, width)) < np.array([0, 0, 0, 0, 0.1, 0.5, 0.1, 0.9, 0.2])] = np.nan
    x[5:, 8] = np.where(np.isnan(x[5:, 7]), x[5:, 8], 3.0)  # constant where column 7 is there
    x[:5, 8] = np.nan
    names = [f"c{k}" for k in range(width)]
    frame = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names))
    found = {(r.a, r.b): r for r in C.coefficients(Table(frame.repartition(4)), C.column_pairs(names)).collect()}
    assert len(found) == 36

    def ranks(v):
        return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])

    def corr(a, b):
        return None if len(a) == 0 or np.ptp(a) == 0 or np.ptp(b) == 0 else float(np.corrcoef(a, b)[0, 1])

    for (a, b), r in found.items():
        p, q = x[:, int(a[1])], x[:, int(b[1])]
        both = ~np.isnan(p) & ~np.isnan(q)
        assert r.n == both.sum()
        assert r.pearson == (None if corr(p[both], q[both]) is None else pytest.approx(corr(p[both], q[both]), abs=1e-9))
        assert r.spearman == (None if r.pearson is None else pytest.approx(corr(ranks(p[both]), ranks(q[both])), abs=1e-12))
    assert found["c7", "c8"].pearson is None and found["c0", "c3"].pearson is None


def test_large_magnitudes_correlate_exactly(spark):
    df = spark.createDataFrame([(1e9 + i, 1e9 + 2 * i, 4.0) for i in range(40)], "a double, b double, c double")
    out = {(r.a, r.b): r for r in C.correlate(Table(df), ["a", "b", "c"], min_reported=0.0).collect()}
    assert out[("a", "b")].pearson == 1.0 and len(out) == 1  # a constant column has no coefficient


def test_disagreeing_pair_leads_with_ranks(spark):
    rows = [(float(i), float(i)) for i in range(1, 15)] + [(15.0, -600.0)]
    row = C.correlate(Table(spark.createDataFrame(rows, "a double, b double")), ["a", "b"], min_reported=0.0).first()
    assert row.method == "spearman" and "disagree" in row.caveat


def test_association_of_a_perfect_split(spark):
    rows = [("pro", "yes")] * 20 + [("free", "no")] * 20
    row = I.categorical_association(Table(spark.createDataFrame(rows, "plan string, kept string")), [("plan", "kept")]).first()
    assert row.cramers_v == 1.0 and row.p_value < 0.001


def test_numeric_summary_reads_formats_and_counts(spark, sales):
    p = Profile(Table(sales, row_id="id"))
    row = p.numeric_summary().filter("column = 'revenue'").first()
    assert (row.valid, row.missing, row.invalid, row.formats, row.max) == (37, 4, 0, ["currency", "thousands"], 5500.0)
    assert p.outlier_rows(["revenue"]).first()["row"] == 40


def test_histogram_holds_every_value_once(spark, sales):
    p = Profile(Table(sales, row_id="id"))
    counts = {r.column: r.n for r in p.histogram().groupBy("column").agg(F.sum("count").alias("n")).collect()}
    assert counts == {"revenue": 37, "spend": 41}


def test_empty_and_null_tables(spark):
    empty = Profile(Table(spark.createDataFrame([], "a string, b double")))
    assert {c: f.stat_type for c, f in empty.table.facts.items()} == {"a": "empty", "b": "empty"}
    assert Quality(empty).summary().first().health_grade in "ABCDF"
    blank = Table(spark.createDataFrame([("", None), (" ", None)], "a string, b double"))
    assert [f.missing for f in blank.facts.values()] == [2, 2]


def test_columns_and_targets(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b, c` int, d int")
    kept, out = select_columns(df, ["d", "b, c"])
    assert kept.columns == ["b, c", "d"] and out == ["a"]
    with pytest.raises(UnknownColumn):
        select_columns(df, ["x"])
    with pytest.raises(UnknownColumn):
        resolve_target("x", df.columns)
    assert resolve_target("x", df.columns, strict=False) is None
    with pytest.raises(ValueError):
        Table(df).order_column()


def test_evidence_and_provenance_account_for_every_row(spark, sales):
    p = Profile(Table(sales, row_id="id"))
    found = durable(Evidence(p, "revenue").build())
    rows = found.collect()
    assert rows and all(r.sample_size <= 41 and 0 <= r.coverage <= 100 for r in rows)
    prov = Provenance(p, found)
    for r in prov.summary().collect():
        assert r.included_rows + r.excluded_rows == r.input_rows == 41
    per_record = {r.place: r.n for r in prov.source_rows().groupBy("place").agg(F.countDistinct("row").alias("n")).collect()}
    assert all(n <= 10 for n in per_record.values())
    again = Evidence(Profile(Table(sales.repartition(5), row_id="id")), "revenue").build().collect()
    assert [r.claim for r in again] == [r.claim for r in rows]


def test_sample_is_ascending_and_explained(spark, sales):
    rows = representative_sample(Profile(Table(sales, row_id="id"))).collect()
    assert [r["row"] for r in rows] == sorted(r["row"] for r in rows) and len(rows) <= 14
    assert all(r.reasons for r in rows) and "first row" in rows[0].reasons


def test_month_gap_is_found(spark):
    days = ["2024-01-31", "2024-02-10", "2024-04-02", "2024-05-30", "2024-06-01"]
    line = L.Timeline(Table(spark.createDataFrame([(d,) for d in days], "d string")), "d")
    assert line.grain == "month" and [r.period for r in line.gaps().collect()] == ["2024-03"]
    assert line.gap_filled().count() == 6


def test_comparison(spark):
    old = spark.createDataFrame([("N", 100.0 + i, "x") for i in range(4)], "region string, revenue double, legacy string")
    new = spark.createDataFrame([("S", 205.0 + i, "y") for i in range(4)], "region string, revenue double, channel string")
    c = Comparison(Profile(Table(old)), Profile(Table(new)))
    deltas = {r.column: r for r in c.column_delta().collect()}
    assert deltas["revenue"].mean_delta == 105.0 and deltas["region"].dominant_changed
    assert c.distribution_shift().first().statistic == 1.0
    metrics = [r.metric for r in c.findings().collect()]
    assert "schema.added" in metrics and "schema.removed" in metrics and "numeric.mean_shift" in metrics
    same = Comparison(Profile(Table(old)), Profile(Table(old))).findings().collect()
    assert [r.metric for r in same] == ["stable"]


def test_joint_counts_coded_and_listed_are_equal(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < 0.1 else f"v{rng.integers(0, k)}" for k in (2, 5, 40)) + (None,) for _ in range(900)]
    t = Table(spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(3))
    pairs = C.column_pairs(["a", "b", "c", "d"])
    found = []
    for most in (1000, 10, 0):
        monkeypatch.setattr(I, "CODED_LEVELS", most)
        found.append(sorted(tuple(r) for r in I.contingency(t, pairs).collect()))
    assert found[0] == found[1] == found[2] and len({r[:2] for r in found[0]}) == 3


def test_duplicates_are_counted_whatever_the_filter_lets_through(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 400)), None if rng.random() < 0.3 else float(rng.integers(0, 3)), "t") for _ in range(3000)]
    t = Table(spark.createDataFrame([*rows, *[(-1, 0.5, "hot")] * 2000], "a int, b double, c string").repartition(5))
    expected = 5000 - len({*rows, (-1, 0.5, "hot")})
    assert Q.duplicate_rows(t).first().duplicate_rows == expected
    monkeypatch.setattr(Q, "BLOOM_BITS", 64)
    monkeypatch.setattr(Q, "BLOOM_PIECE", 64)
    assert Q.duplicate_rows(t).first().duplicate_rows == expected
    assert Q.duplicate_rows(Table(spark.range(50).toDF("a"))).first().duplicate_rows == 0


def test_saved_results_are_got_by_a_table_of_ids(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    saved = [(f"a{k}", start + dt.timedelta(days=k), "s", "k", None, None, None, None, "{}") for k in range(60)]
    keeper = B.AnalysisStore(spark, str(tmp_path), "month")
    keeper.append(spark.createDataFrame(saved, B.FIELDS))
    asked = [f"a{k}" for k in range(0, 60, 2)] + ["a4", "a40", "never", None]
    cutoff, table = start + dt.timedelta(days=30), spark.createDataFrame([(k,) for k in asked], "id string")
    expected = [f"a{k}" for k in range(30, 60, 2)]
    assert sorted(r.id for r in keeper.get(table, cutoff).collect()) == expected
    assert sorted(r.id for r in keeper.get(asked[:-1], cutoff).collect()) == expected
    assert [r.id for r in keeper.get("a44", cutoff).collect()] == ["a44"] and keeper.get("a4", cutoff).count() == 0


def test_the_query_of_saved_results_asks_for_every_tenth(spark, tmp_path):
    orders = [(k, k % 7, "O", dt.datetime(1998, 7, 1), 1.0) for k in range(200)]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_totalprice double"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["get_analysis"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in found) == sorted(f"a{k}" for k in range(200) if k % 10 == 3)


def test_saved_results_are_deleted_by_a_table_of_ids(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    saved = [(f"a{k}", start + dt.timedelta(days=k), f"s{k % 2}", "F" if k % 3 else "O", None, None, None, None, "{}") for k in range(90)]
    saved += [("a4", start, "s0", "F", None, None, None, None, "again"), ("a4", start, "s1", "F", None, None, None, None, "other"),
              ("a4", start, None, "F", None, None, None, None, "nobody"), (None, start, "s0", "F", None, None, None, None, "no id")]
    saved += [(f"m{k}", dt.datetime(2024, 6, 1), "s0", "F", None, None, None, None, "{}") for k in range(5)]  # a month of its own
    keeper = B.AnalysisStore(spark, str(tmp_path), "month")
    keeper.append(spark.createDataFrame(saved, B.FIELDS))
    left = [r for r in saved if not (r[0] and r[2] == "s0" and r[3] == "F")]
    key = lambda r: tuple(str(x) for x in r[:9])

    def stored():
        return sorted(key(r) for r in keeper.saved().select(*[c.split()[0] for c in B.FIELDS.split(", ")]).collect())

    asked = keeper.saved().filter("kind = 'F'").select("kind", "id")  # read from the rows that go, with ids of other sessions
    asked = asked.unionByName(spark.createDataFrame([("F", "never"), ("F", "a4"), ("F", None)], "kind string, id string"))
    assert keeper.delete(asked.filter("false"), "s0") == 0 and keeper.delete(asked, "never") == 0
    assert stored() == sorted(map(key, saved))
    assert keeper.delete(asked, "s0") == len(saved) - len(left)
    assert stored() == sorted(map(key, left)) and not [p for p in tmp_path.rglob("*") if p.name == "created_date=2024-06-01"]


def test_the_query_of_deletions_brings_no_ids_to_the_driver(spark, tmp_path, monkeypatch):
    orders = [(k, k % 100, "FOP"[k % 3], dt.datetime(1998, 7 + k % 2, 1), 1.0) for k in range(6000)]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_totalprice double"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    kind, sizes = type(spark.range(1)), []
    collect = kind.collect

    def counted(df):
        rows = collect(df)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    left = QUERIES["delete_analysis"](spark, str(tmp_path))
    assert sizes and max(sizes) <= 2  # one row a month at most
    found = collect(left)
    assert sorted(r.id for r in found) == sorted(f"a{k}" for k, c, s, *_ in orders if c % 50 != 7 or s != "F")


def test_few_columns_meet_their_ranks_in_place(spark, monkeypatch):
    """No cell is dealt out by itself, and the coefficients are those of the cells; gaps, ties, hot values, text."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else float(rng.integers(0, 4)), None if i % 5 == 0 else float(rng.normal()),
             None if i % 3 == 0 else (0.0 if i % 2 else float(i)), f" ${i * i % 101:,}.5 ") for i in range(600)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d string")
    columns = ["a", "b", "c", "d"]

    def found():
        return {(r.a, r.b): (r.n, r.pearson, r.spearman) for r in C.coefficients(Table(frame), C.column_pairs(columns)).collect()}

    monkeypatch.setattr(C, "FEW_COLUMNS", 0)
    cells = found()
    monkeypatch.setattr(C, "FEW_COLUMNS", 6)
    monkeypatch.setattr(C, "attach_ranks", lambda *a: pytest.fail("cells are dealt out"))
    for few in (10_000, 1):
        monkeypatch.setattr(C, "FEW_VALUES", few)
        for pair, (n, p, s) in found().items():
            assert (n, pytest.approx(p, abs=1e-12), pytest.approx(s, abs=1e-12)) == cells[pair]


def test_products_take_a_batch_in_pieces(spark):
    """Memory follows the piece, not the batch: 6,000 rows of 300 keys."""
    from tallymark.operators import comoments as M
    rows = spark.range(6000, numPartitions=1).selectExpr("transform(sequence(0, 299), k -> struct(int(k) as key, double((id + k) % 7) as z)) as cells")
    x = np.array([[(i + k) % 7 for k in range(300)] for i in range(6000)], float)
    batch = rows.limit(1200).toArrow().combine_chunks().to_batches()[0]
    assert np.array_equal(M.dense_of(batch.slice(700, 500), 300), x[700:1200])
    t = M.product_sums(rows, [0, 1], [5, 299], 300)
    assert np.allclose(t["ab"], [(x[:, 0] * x[:, 5]).sum(), (x[:, 1] * x[:, 299]).sum()])
    assert M.PIECE_ROWS <= 500


def test_numbers_are_counted_before_they_become_text(spark):
    """The levels are those of the texts, and no text is made of a row's number before its value is counted."""
    nan, inf = float("nan"), float("inf")
    rows = [(0.0, "a"), (-0.0, "a"), (1.5, ""), (1.5, None), (nan, "b"), (inf, "b"), (2.0e-17, "1.5"), (2.0, "a"), (None, "a")]
    table = Table(spark.createDataFrame(rows, "x double, t string"))
    counts = level_counts(table, ["x", "t"])
    direct = {}
    for c in ("x", "t"):
        for r in table.df.select(table.level(c).alias("v")).collect():
            if r.v is not None:
                direct[c, r.v] = direct.get((c, r.v), 0) + 1
    assert {(r.column, r.level): r.n for r in counts.collect()} == direct
    plan = counts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    texts = [k for k, line in enumerate(plan) if "decimal(38,16)" in line]
    assert texts and max(texts) < min(k for k, line in enumerate(plan) if "Generate inline" in line)


@pytest.mark.parametrize("seed", [0, 1, 2, 3, 4, 5])
def test_split_search_ends_once_no_split_can_be_reported(spark, monkeypatch, seed):
    """None only where the best split's effect is too small; grids are added up the same in many parts."""
    rng = np.random.default_rng(seed)
    n = 6000 if seed < 3 else 40
    v = rng.normal(size=n) + (np.arange(n) > n // 2) * [0.0, 0.2, 1.0][seed % 3]
    df = durable(spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(v)], "position long, at long, value double"))
    expected, scale = brute_split(v)
    monkeypatch.setattr(H, "TALLIED_ROWS", 100)
    rounds, count = [], H._count_grid
    monkeypatch.setattr(H, "_count_grid", lambda *a: rounds.append(1) or count(*a))
    effect = abs(np.median(v[expected:]) - np.median(v[:expected])) / scale
    whole = H.find_split(df, n, scale, (v.min(), v.max()))
    full, rounds[:] = len(rounds), []
    cut = H.find_split(df, n, scale, (v.min(), v.max()), least_effect=H.MIN_EFFECT)
    assert whole == expected and cut == (expected if effect >= H.MIN_EFFECT else None)
    assert len(rounds) < full if n == 6000 and cut is None else len(rounds) == full or cut is None
    assert H.level_shift(df).count() == (effect >= H.MIN_EFFECT)


def test_texts_are_read_once_with_the_same_facts(spark, monkeypatch):
    """Counted texts and single cells give the same facts, and a constant has no spread."""
    from tallymark.operators import table as T
    rows = [(["1,200", " 7.5", "$3", "", None, "n/a", "(12)"][i % 7], "0.1", ["2024-01-02", "x", None][i % 3]) for i in range(300)]
    frame = spark.createDataFrame([*rows, (None, "0.1", "1")], "a string, b string, c string").repartition(3)
    read, parse = [], T.read_text
    monkeypatch.setattr(T, "read_text", lambda cells: read.append(cells) or parse(cells))
    few = Table(frame).facts
    assert read[0].count() == 7 + 1 + 4
    monkeypatch.setattr(T, "FEW_TEXTS", 0)
    each = Table(frame).facts
    for c in "abc":
        for x, y in zip(few[c], each[c]):
            assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y), c
    assert few["b"].std_pop == 0 and few["b"].mean == 0.1


def test_few_columns_are_correlated_without_python_workers(spark, monkeypatch):
    monkeypatch.setattr(C, "pearson_matrix", lambda *a: pytest.fail("matrices"))
    monkeypatch.setattr(C, "product_sums", lambda *a: pytest.fail("matrices"))
    x = np.random.default_rng(1).normal(size=(200, 3)).round(1)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    for r in C.coefficients(Table(frame), C.column_pairs(["a", "b", "c"])).collect():
        a, b = x[:, "abc".index(r.a)], x[:, "abc".index(r.b)]
        ra, rb = (np.array([(v < u).sum() + (v == u).sum() / 2 for u in v]) for v in (a, b))
        assert (r.n, r.pearson, r.spearman) == (200, pytest.approx(np.corrcoef(a, b)[0, 1]), pytest.approx(np.corrcoef(ra, rb)[0, 1]))


def test_cells_make_rows_across_batches(spark, monkeypatch):
    """Rows of single cells are whole wherever a batch ends, and the ranks of many columns are sent as single cells."""
    import pyarrow as pa
    from tallymark.operators import comoments as M
    rng = np.random.default_rng(3)
    x = rng.normal(size=(57, 30)) * (rng.random((57, 30)) < 0.6)
    x[:, 4] = 1.0
    at, key = np.nonzero(x)
    cells = pa.record_batch([pa.array(at * 11), pa.array(key.astype(np.int32)), pa.array(x[at, key])], names=["id", "key", "z"])
    monkeypatch.setattr(M, "PIECE_ROWS", 5)
    for held in (1, 40, 10_000):
        monkeypatch.setattr(M, "HELD_CELLS", held)
        got = list(M.dense_rows((cells.slice(k, 7) for k in range(0, len(cells), 7)), 30))
        assert np.array_equal(np.concatenate(got), x) and max(map(len, got)) <= 5
    seen, sums = [], C.product_sums
    monkeypatch.setattr(C, "product_sums", lambda rows, *a: seen.append(rows.columns) or sums(rows, *a))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{k} double" for k in range(30))).repartition(3)
    found = {(r.a, r.b): r.spearman for r in C.coefficients(Table(frame), C.column_pairs(["c0", "c1", "c2", "c3", "c5", "c6", "c7"])).collect()}
    rank = [[(v < u).sum() + (v == u).sum() / 2 for u in v] for v in x.T]
    assert seen == [["id", "key", "z"]] and found["c0", "c7"] == pytest.approx(np.corrcoef(rank[0], rank[7])[0, 1])
