"""Sheets and tables from files of mixed encodings and shapes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidepanel.sources import files as fl, ingest as s


def _folder(tmp_path, files):
    for name, data in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path)


def test_encodings_ragged_headers_and_skipped_rows(spark, tmp_path):
    plain = "title\n编号,名称,值\n1,钢铁,2.5\n2,\"煤, 炭\nb\",N/A\n\n3,x,7,extra\n4,y\n"
    turned = "title\n名称,编号\n铜,5,9\n铝,6,8\n"
    files = {"b/utf8.csv": plain, "b/bom.csv": b"\xef\xbb\xbf" + plain.encode(), "b/gb.csv": turned.encode("gb18030"), "b/wide.csv": plain.encode("utf-16"),
             "b/bad.csv": "title\n编号,名称\n9,".encode("gb18030") + b"\xff\xff\n", "b/empty.csv": b"", "b/blank.csv": b"\n\n", "b/other.txt": "1,2"}
    d = fl.read_files(spark, _folder(tmp_path, files) + "/b", ["编号", "名称", "值", "3"], skip_rows=[0])
    got = {}
    for r in d.collect():
        got.setdefault(r.sheet, []).append(tuple(r)[2:])
    assert set(got) == {"utf8", "bom", "gb", "wide", "bad"} and {r.file for r in d.select("file").collect()} == {"b"}
    rows = [(2, "1", "钢铁", "2.5", None, None), (3, "2", "煤, 炭\nb", None, None, None), (4, "3", "x", "7", "extra", "long"), (5, "4", "y", None, None, "short")]
    for sheet, encoding in (("utf8", "utf-8"), ("bom", "utf-8-sig"), ("wide", "utf-16")):
        assert sorted((r[0], *r[3:], r[2]) for r in got[sheet]) == rows and {r[1] for r in got[sheet]} == {encoding}
    assert sorted(got["gb"]) == [(2, "gb18030", None, "5", "铜", None, None), (3, "gb18030", None, "6", "铝", None, None)]
    assert got["bad"][0][3] == "9" and fl.file_chunks(spark, str(tmp_path) + "/b", skip_rows=[0]).filter("n_bad > 0").count() == 1
    names = {r.sheet: r.names for r in fl.file_chunks(spark, str(tmp_path) + "/b", skip_rows=[0]).collect()}
    assert names["utf8"] == ["编号", "名称", "值", "3"] and names["gb"] == ["名称", "编号", "2"] and names["blank"] == [] and "empty" not in names


def test_names_and_header_rows(spark, tmp_path):
    assert fl.column_names(["a", "", "a", "a.1", None], 6) == ["a", "1", "a.1", "a.1.1", "4", "5"] and fl.column_names(["a", "b"], 1) == ["a"]
    assert fl.header_at([["report"], ["day", "x", "y"], ["2024-01-01", "1", "2"]]) == 1
    assert fl.header_at([["1", "2"], ["3", "4"]]) is None and fl.header_at([]) is None and fl.header_at([[None, None], ["a", None], ["1", "2"]]) == 1
    path = _folder(tmp_path, {"k/a.csv": "1,2\n3,4\n", "k/b.csv": "y,x,x\n1,2,3\n"})
    every = fl.read_files(spark, path + "/k")
    assert every.columns[5:] == ["0", "y", "1", "x", "x.1"]
    assert sorted((r["0"], r["1"], r.y, r.x, r["x.1"]) for r in every.collect() if r.sheet == "a") == [("1", "2", None, None, None), ("3", "4", None, None, None)]
    assert [(r.y, r.x, r["x.1"]) for r in every.collect() if r.sheet == "b"] == [("1", "2", "3")]


def test_many_chunks_keep_every_row(spark, tmp_path):
    n = 40_000
    path = _folder(tmp_path, {"k/a.csv": "id;v\n" + "".join(f"{i};{i % 7}\n" for i in range(n))})
    chunks = fl.file_chunks(spark, path + "/k", delimiter=";")
    assert chunks.count() == 2
    got = fl.read_files(spark, path + "/k", ["id"], delimiter=";").agg(F.count("id"), F.sum(F.col("id").cast("long")), F.min("row_no"), F.max("row_no")).first()
    assert tuple(got) == (n, n * (n - 1) // 2, 1, n)


def test_a_file_beyond_the_bound_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "MAX_BYTES", 10)
    with pytest.raises(PySparkException, match="too large"):
        fl.read_files(spark, _folder(tmp_path, {"k/a.csv": "a,b\n1,2\n3,4\n5,6\n"}) + "/k", ["a"]).collect()


WIND = "0,,\n指标名称,甲,乙\n13/04/2024,1,2\n03/04/2024,,5\n合计,9,9\n"
STEEL = "钢联数据,,\n指标名称,甲,丙\n频度,周,周\n描述,x,y\n2024-04-05,3,4\n2024-04-12,0,6\n"
PLAIN = "指标名称,丁\n04/13/2024,8\n04/03/2024,7\n"
SHEETS = {"b1/钢铁_日度_Wind.csv": WIND.encode("gb18030"), "b1/钢铁_周度_Mysteel.csv": STEEL, "b2/化工_日度_THS.csv": PLAIN, "b2/说明.csv": "a,b\n1,2\n"}


def test_sheet_rows_equal_the_rows_of_the_grid(spark, tmp_path):
    chunks = fl.file_chunks(spark, _folder(tmp_path, SHEETS) + "/*", None)
    grid = chunks.select("file", "sheet", F.explode("rows").alias("r")).select("file", "sheet", "r.row_no", "r.cells")
    mine, theirs = fl.sheet_rows(chunks), s.vendor_grid_ingest(grid)
    assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, theirs.select(mine.columns).collect()), key=str) and mine.count() == 10
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_files_to_panel(spark, tmp_path):
    path = _folder(tmp_path, SHEETS) + "/*"
    panel, source = fl.files_to_panel(spark, path)
    got = {(r.freq, r.series, str(r.ts)): r.value for r in panel.collect()}
    assert got[("daily", "甲", "2024-04-13")] == 1.0 and got[("daily", "乙", "2024-04-03")] == 5.0 and got[("daily", "丁", "2024-04-03")] == 7.0
    assert got[("weekly", "丙", "2024-04-05")] == 4.0 and got[("weekly", "丙", "2024-04-12")] == 6.0 and got[("weekly", "乙", "2024-04-05")] == 5.0
    # 甲 is weekly in two sheets of b1: the first by name (周度) gives it, its zero is missing
    assert got[("weekly", "甲", "2024-04-05")] == 3.0 and got[("weekly", "甲", "2024-04-12")] is None and ("weekly", "甲", "2024-04-19") not in got
    assert {r.series: r.source for r in source.collect()}["丁"] == "b2|化工_日度_THS"
    first = fl.files_to_panel(spark, path, order=["b2", "b1"])[1]
    assert first.count() == 4
