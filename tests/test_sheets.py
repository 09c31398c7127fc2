import gzip
import random

import pytest

from tallymark.operators import sheets as G
from tallymark.plans import inputs as N
from tallymark.sources import files as X
from tallymark.sources.store import AnalysisStore, retention_cutoff

import datetime as dt

SHEETS = {
    "total": [["Region", "Units", "Revenue"], ["N", "100", "40000"], ["S", "120", "50000"], ["E", "90", "45000"],
              ["W", "133", "48750"], ["TOTAL", "443", "183750"]],
    "titled": [["Quarterly"], [], ["region", "units"], ["N", "10"], ["S", "20"], [], ["TOTAL", "30"]],
    "unlabelled": [["x", "y"], ["1", "2"], ["3", "4"], ["4", "6"]],
    "wrong": [["k", "v"], ["a", "3"], ["b", "4"], ["Total", "99"]],
    "zeros": [["k", "v"], ["a", "0"], ["b", "0"], ["c", "0"], ["d", "0"]],
    "second": [["r", "u"], ["a", "1"], ["b", "2"], [], ["c", "d"], ["x", "5"], ["y", "6"]],
    "turned": [["metric", "Jan", "Feb", "Mar"], ["revenue", "100000", "120000", "110000"],
               ["rating", "4.1", "4.2", "4.3"], ["units", "900", "950", "920"]],
    "clean": [["a", "b"], ["x", "1"], ["y", "2"]],
}


def grid_of(spark, sheets):
    rows = [(name, i + 1, row) for name, grid in sheets.items() for i, row in enumerate(grid)]
    return spark.createDataFrame(rows, "file_id string, row_no long, cells array<string>")


@pytest.fixture(scope="module", params=[10_000, 2])
def report(request, spark):
    """Once with whole sheets per stretch, once with two rows per stretch."""
    before, G.CHUNK_ROWS = G.CHUNK_ROWS, request.param
    sheets = G.Sheets(grid_of(spark, SHEETS))
    out = {r.file_id: r for r in sheets.structure_report().collect()}
    aside = sheets.set_aside.orderBy("row_no").collect()
    G.CHUNK_ROWS = before
    return out, {k: [r for r in aside if r.file_id == k] for k in out}


def test_readings(report):
    report, aside = report
    got = {k: (r.header_row, r.confidence, r.observations, [(e.row_no, e.reason, e.confidence) for e in aside[k]])
           for k, r in report.items()}
    assert all(r.excluded == len(aside[k]) for k, r in report.items())
    assert got["total"] == (1, "confident", 4, [(6, "aggregate", "certain")])
    assert got["titled"] == (3, "confident", 2, [(1, "preamble", "confident"), (7, "aggregate", "certain")])
    assert got["unlabelled"] == (1, "confident", 2, [(4, "aggregate", "confident")])
    assert got["wrong"] == (1, "uncertain", 2, [(4, "aggregate", "uncertain")])
    assert got["zeros"][2:] == (2, [(4, "aggregate", "uncertain"), (5, "aggregate", "confident")])
    assert got["second"] == (1, "uncertain", 4, [(5, "second header", "uncertain")])
    assert got["clean"] == (1, "none", 2, [])
    assert got["turned"][1] == "uncertain" and report["turned"].warnings[0].kind == "possible-transpose"
    assert aside["total"][0].detail == "Units and Revenue equal the sum of rows 2–5"


def fold(rows):
    """Sequential reading of one single-column sheet of numbers, as the rule is stated."""
    kept, out = [], []
    for i, v in enumerate(rows):
        s = sum(kept)
        if len(kept) >= 2 and abs(v - s) <= 1e-9 * max(1, abs(v), abs(s)):
            out.append(i + 2)
        else:
            kept.append(v)
    return out


def test_rounds_reach_the_sequential_answer(spark):
    rng = random.Random(4)
    values = {f"s{k}": [rng.choice([0, 1, 1, 2, 3]) for _ in range(12)] for k in range(40)}
    sheets = {k: [["n", "v"]] + [["a", str(x)] for x in v] for k, v in values.items()}
    found = G.Sheets(grid_of(spark, sheets)).classify_rows().collect()
    got = {k: sorted(r.row_no for r in found if r.file_id == k) for k in sheets}
    assert got == {k: fold(v) for k, v in values.items()}


def test_corrections(spark):
    asked = spark.createDataFrame([("total", None, [6, 2, 99]), ("clean", 50, [])],
                                  "file_id string, header_row long, include_rows array<long>")
    sheets = G.Sheets(grid_of(spark, SHEETS), asked)
    out = {r.file_id: r for r in sheets.structure_report().collect()}
    back = sheets.set_aside.filter("restored").collect()
    assert [(r.file_id, r.row_no) for r in back] == [("total", 6)] and out["total"].observations == 5
    assert sorted((u.file_id, u.row_no, u.reason) for u in sheets.unapplied().collect()) == [
        ("clean", 50, "header row is outside the file"), ("total", 2, "not an excluded row"), ("total", 99, "outside the file")]
    assert out["clean"].confidence == "uncertain" and out["total"].unapplied == 2


def test_files(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    quoted = put("q.csv", '﻿name,note,,name\r\n"A ""x""","multi\nline",1,2\r\nB,,3,4\r\n')
    wide = put("w.csv", b"\xff\xfe" + "x,y\n1,é\n".encode("utf-16-le"))
    grid, status = X.scan_many(spark, [quoted, wide, str(tmp_path / "lost.csv")])
    rows = {(r.file_id.rsplit("/", 1)[1], r.row_no): r.cells for r in grid.collect()}
    assert rows[("q.csv", 1)] == ["name", "note", None, "name"] and rows[("q.csv", 2)] == ['A "x"', "multi\nline", "1", "2"]
    assert rows[("w.csv", 1)] == ["x", "y"] and rows[("w.csv", 2)] == ["1", "é"]
    assert sorted(r.status for r in status.collect()) == ["error", "ok", "ok"]
    names = {r.file_id.rsplit("/", 1)[1]: r.columns for r in G.Sheets(grid).name_columns().collect()}
    assert names["q.csv"] == ["name", "note", "Column C", "name_1"]


def test_json(spark, tmp_path):
    one, many = tmp_path / "one.json", tmp_path / "many.json"
    one.write_text('{"a": {"b": 1, "c": [1, 2]}, "d": "x"}')
    many.write_text('[{"a": 1}, {"b": {"c": 2}}, {"a": 3}]')
    assert X.scan_json(spark, str(one)).first().asDict() == {"a.b": 1, "a.c": "[1,2]", "d": "x"}
    df = X.scan_json(spark, str(many))
    assert df.columns == ["a", "b"] and df.count() == 3 and X.is_tabular(df)


def test_store(spark, tmp_path):
    now = dt.datetime(2024, 6, 1)
    assert retention_cutoff(-1, now) is None and retention_cutoff("x", now) is None
    assert retention_cutoff(30, now) == dt.datetime(2024, 5, 2)
    store = AnalysisStore(spark, str(tmp_path / "store"))
    result = spark.range(1).selectExpr("id AS n")
    old = store.save(result, session_id="me", kind="k", filename="f", file_type="t", now=dt.datetime(2024, 1, 1))
    new = store.save(result, session_id="me", kind="k", filename="f", file_type="t", now=now)
    cutoff = retention_cutoff(30, now)
    assert [r.id for r in store.list("me", cutoff).collect()] == [new] and store.get(old, cutoff).count() == 0
    assert store.get(new, cutoff).first().payload == '{"n":0}'
    assert store.delete(new, "someone else") == 0 and store.delete(new, "me") == 1 and store.delete(new, "me") == 0
    assert store.sweep_expired("me", cutoff) == 1 and store.saved().count() == 0


def test_json_shapes(spark, tmp_path):
    def read(name, text):
        path = tmp_path / name
        path.write_text(text)
        return X.scan_json(spark, str(path))

    one = read("one.json", '\n [{"a": {"b": 1, "c": [2]}}]')
    assert one.columns == ["a"] and one.first().a == '{"b":1,"c":[2]}'
    assert read("object.json", ' {"a": {"b": 1, "c": [2]}}').first().asDict() == {"a.b": 1, "a.c": "[2]"}
    for name, text, value in [("list", "[1, 2, 3]", "[1,2,3]"), ("lone", "42", "42"), ("none", "[]", "[]"), ("word", '"x"', '"x"')]:
        assert [tuple(r) for r in read(f"{name}.json", text).collect()] == [(value,)]


def test_bad_files_are_rows(spark, tmp_path):
    for folder in ("a b", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x y.csv").write_text("h,i\n1,2\n" * (1 if folder == "b" else 2))
    (tmp_path / "bad.csv.gz").write_bytes(b"not compressed at all")
    paths = [str(tmp_path / p) for p in ("a b/x y.csv", "b/x y.csv", "bad.csv.gz", "lost.csv")]
    _, status = X.scan_many(spark, paths)
    assert sorted((r.path, r.status, r.rows) for r in status.collect()) == sorted(
        zip(paths, ["ok", "ok", "error", "error"], [4, 2, 0, 0]))


def test_a_file_damaged_in_the_middle_is_named(spark, tmp_path):
    whole, damaged = tmp_path / "whole.csv.gz", tmp_path / "damaged.csv.gz"
    rnd = random.Random(2)
    content = "".join(f"{k},{rnd.random()}\n" for k in range(60000)).encode()
    whole.write_bytes(gzip.compress(content))
    damaged.write_bytes(gzip.compress(content)[:-len(gzip.compress(content)) // 3])
    grid, status = X.scan_many(spark, [str(whole), str(damaged)])
    by = {r.path: r for r in status.collect()}
    assert (by[str(whole)].status, by[str(whole)].rows, by[str(whole)].error) == ("ok", 60000, None)
    lost = by[str(damaged)]
    assert lost.status == "partial" and 0 < lost.rows < 60000 and lost.error
    assert grid.count() == 60000 + lost.rows


def machine(text, sep=","):
    """The rows of a text, character by character: quotes count in cells that begin with one."""
    text = text.removesuffix("\n")
    rows, row, start, inside = [], [], 0, False
    for i, c in enumerate([*text, None]):
        if c is None or not inside and c in (sep, "\n"):
            cell = text[start:i]
            row.append((cell[1:-1].replace('""', '"') if cell[:1] == cell[-1:] == '"' else cell) or None)
            start = i + 1
            if c != sep:
                rows.append(row)
                row = []
        elif c == '"' and text[start] == '"':
            inside = not inside
    return [[] if len(r) == 1 and not (r[0] or "").strip(" ") else r for r in rows]


def test_the_composed_machine_reads_like_a_plain_one(spark, tmp_path, monkeypatch):
    """Stretches of three lines, so that quotes open and close across many of them."""
    monkeypatch.setattr(X, "_LINE_CHUNK", 3)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(['"', '"', ",", "\n", "a", "b", " ", '5"', ',"', '",', '""', '"\n'])
                     for _ in range(rnd.randint(1, 60))) for _ in range(250)]
    texts += ['a,b\n1,5" pipe\n2,x\n3,y\n4,z\n', 'n,"' + "," * 6000 + '"\n1,2\n', '"' + '""' * 50_000 + '",1',
              ",".join(["x"] * 20_000) + "\n" + ",".join(['"q""q"'] * 20_000)]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.csv").write_text(text)
    found = {}
    for r in X.scan_grid(spark, str(tmp_path)).collect():
        found.setdefault(int(r.file_id.split("/f")[-1][:-4]), {})[r.row_no] = r.cells
    for k, text in enumerate(texts):
        rows = found.get(k, {})
        blank = [[] if len(r) == 1 and not (r[0] or "").strip(" ") else r for r in (rows[n + 1] for n in range(len(rows)))]
        assert blank == machine(text), text[:200]
    assert found[250] == {1: ["a", "b"], 2: ["1", '5" pipe'], 3: ["2", "x"], 4: ["3", "y"], 5: ["4", "z"]}
    assert [len(found[251][n]) for n in (1, 2)] == [2, 2]


def rows_scanned(df):
    """Rows that the file scan handed on when ``df`` was collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_store_partitions(spark, tmp_path):
    store = AnalysisStore(spark, str(tmp_path / "store"), "month")
    rows = spark.range(6000).selectExpr(
        "concat('a', xxhash64(id)) AS id", "timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(id % 120) AS created_at",
        "concat('s', id % 4) AS session_id", "'k' AS kind", "'f' AS filename", "'t' AS file_type", "string(null) AS model",
        "string(null) AS question", "repeat('x', 50) AS payload")
    store.append(rows)

    def files():
        return {p.relative_to(store.rows): p.stat().st_mtime_ns for p in sorted((tmp_path / "store").rglob("*.parquet"))}

    before = files()
    months = {p.parts[0] for p in before}
    assert months == {f"created_date=2024-0{m}-01" for m in range(1, 6)}
    cutoff = dt.datetime(2024, 3, 15)
    gone = rows.filter("created_at < '2024-03-15'").count()
    assert store.sweep_expired(None, cutoff) == gone and store.sweep_expired(None, cutoff) == 0
    after = files()
    assert {p.parts[0] for p in after} == {f"created_date=2024-0{m}-01" for m in range(3, 6)}
    later = {p: t for p, t in before.items() if p.parts[0] > "created_date=2024-03-01"}
    assert later == {p: t for p, t in after.items() if p.parts[0] > "created_date=2024-03-01"}
    assert store.saved().count() == 6000 - gone and store.saved().filter("created_at < '2024-03-15'").count() == 0
    plan = store.list("s1", dt.datetime(2024, 4, 20))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan and "2024-04-01" in plan
    assert store.delete("never", "s1") == 0 and store.sweep_expired("s1", None) == 0
    store.compact()
    assert store.saved().count() == 6000 - gone
    assert AnalysisStore(spark, str(tmp_path / "none")).saved().count() == 0
    with pytest.raises(ValueError):
        AnalysisStore(spark, "x", "week")


def test_a_point_read_opens_one_row_group(spark, tmp_path):
    spark.conf.set("parquet.block.size", 64 * 1024)
    try:
        store = AnalysisStore(spark, str(tmp_path / "store"), "year")
        store.append(spark.range(40_000).selectExpr(
            "concat('a', xxhash64(id)) AS id", "timestamp_ntz'2024-01-10 00:00:00' AS created_at", "'s' AS session_id", "'k' AS kind",
            "'f' AS filename", "'t' AS file_type", "string(null) AS model", "string(null) AS question", "string(hash(id)) AS payload"))
        wanted = store.saved().filter("payload = string(hash(17L))").first().id
        spark.conf.set("spark.sql.parquet.filterPushdown", "true")
        read = store.get(wanted, None)
        assert read.count() == 1 and rows_scanned(read) < 40_000 / 4
    finally:
        spark.conf.unset("parquet.block.size")


def seeded_sheets(n):
    """Sheets with unlabelled and labelled totals, running totals, zeros, gaps and second headers."""
    rnd, out = random.Random(11), {}
    for k in range(n):
        width = rnd.randint(1, 4)
        rows, sums = [["name", *[f"m{c}" for c in range(width)]]], [[] for _ in range(width)]
        for i in range(rnd.randint(3, 22)):
            kind = rnd.random()
            if kind < 0.12 and i > 1:
                cells = [str(sum(s)) if rnd.random() < 0.8 else str(rnd.randint(0, 9)) for s in sums]
                rows.append([rnd.choice(["", "Total", "all", None]), *cells])
            elif kind < 0.17:
                rows += [[], ["part", *["units"] * width]]
            elif kind < 0.22:
                rows.append([])
            else:
                values = [rnd.choice([0, 0, 1, 2, 5, 10]) if rnd.random() < 0.85 else None for _ in range(width)]
                rows.append([f"r{i}", *[None if v is None else str(v) for v in values]])
                for s, v in zip(sums, values):
                    s += [] if v is None else [v]
        out[f"s{k:03d}"] = rows
    out["zeros"] = [["k", "v"]] + [["a", "0"]] * 40
    out["running"] = [["k", "v"]] + [["a", str(v)] for v in (1, 1, 2, 2, 4, 6, 6, 12, 3, 15, 15, 30, 30)]
    return out


def plain_fold(rows):
    kept, found = [], []
    for r in rows:
        if r.second_header:
            continue
        comparable, equal = 0, []
        for c, v in enumerate(r.numbers):
            above = [k[c] for k in kept if c < len(k) and k[c] is not None]
            if v is not None and len(above) >= 2:
                comparable += 1
                if abs(v - sum(above)) <= 1e-9 * max(1, abs(v), abs(sum(above))):
                    equal.append(c)
        if equal and 2 * len(equal) >= comparable:
            found.append((r.row_no, comparable, len(equal), equal))
        elif r.label is None:
            kept.append(r.numbers)
    return found


@pytest.mark.parametrize("stretch", [3, 10_000])
def test_stretches_fold_like_a_plain_fold(spark, monkeypatch, stretch):
    monkeypatch.setattr(G, "CHUNK_ROWS", stretch)
    sheets = G.Sheets(grid_of(spark, seeded_sheets(250)))
    data, found = {}, {}
    for r in sheets.data.orderBy("row_no").collect():
        data.setdefault(r.file_id, []).append(r)
    for r in sheets.arithmetic_match().orderBy("row_no").collect():
        found.setdefault(r.file_id, []).append((r.row_no, r.comparable, r.matched, list(r.matched_columns)))
    expected = {k: plain_fold(rows) for k, rows in data.items()}
    assert found == {k: f for k, f in expected.items() if f} and len(found) > 100


def test_sheets_of_one_stretch_are_not_folded(spark, monkeypatch):
    """Running sums settle them; only a sheet with numbers below an unlabelled total is folded."""
    folded = []
    monkeypatch.setattr(G.Sheets, "_fold_sheets", lambda self, sheets: folded.append(sorted(r.file_id for r in sheets.collect())) or
                        self.data.limit(0).selectExpr(*["file_id", "chunk", "row_no", "0L comparable", "0L matched", "array(0) matched_columns"]))
    plain = {"last": [["x", "y"], ["1", "2"], ["3", "4"], ["4", "6"]], "named": [["x", "y"], ["1", "2"], ["3", "4"], ["Total", "6"], ["5", "1"]]}
    found = G.Sheets(grid_of(spark, plain)).classify_rows().collect()
    assert {(r.file_id, r.row_no) for r in found} == {("last", 4), ("named", 4)} and not folded
    early = {"early": [["x", "y"], ["1", "2"], ["3", "4"], ["4", "6"], ["5", "1"]]}
    G.Sheets(grid_of(spark, plain | early)).classify_rows().collect()
    assert folded == [["early"]]


def test_order_sheets_read_orders_once(spark):
    plan = N.order_sheets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
