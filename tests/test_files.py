"""Import of vendor files, tables, targets and result files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from candlemill.params import ScreenParams
from candlemill.plans.load import load_bars, load_statements
from candlemill.schemas import BAR_HEADERS, BAR_SCHEMA
from candlemill.sources.csv_files import PATH, REASON, _number, accepted, read_bar_files, read_finance_files, rejected
from candlemill.sources.shared import keep, scratch, shared_folder
from candlemill.sources.sinks import write_dips, write_report, write_signals
from candlemill.sources.tables import fit_bars, read_table
from candlemill.sources.targets import read_targets

VALUES = {"股票代码": "sh600001", "股票名称": "浦发", "交易日期": "2024-01-02", "开盘价": "10.5", "沪深300成分股": "True",
          "上证50成分股": "false", "新版申万一级行业名称": ""}


def bar_file(folder, name, rows=(VALUES,), encoding="utf-8", headers=tuple(BAR_HEADERS), extra=""):
    lines = ["vendor banner", ",".join(headers) + extra]
    lines += [",".join(r.get(h, "") for h in headers) for r in rows]
    (folder / name).write_bytes("\r\n".join(lines).encode(encoding))


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "bars"
    path.mkdir()
    return path


def reasons(parsed):
    return {r[PATH].rsplit("/", 1)[1]: r[REASON] for r in rejected(parsed).collect()}


def test_bar_files(spark, folder):
    bar_file(folder, "a.csv")
    bar_file(folder, "b.csv", [{**VALUES, "股票代码": "sz000001"}] * 3, "gb2312", tuple(reversed(BAR_HEADERS)), ",more")
    bar_file(folder, "missing.csv", headers=tuple(BAR_HEADERS)[:-1])
    bar_file(folder, "number.csv", [VALUES, {**VALUES, "收盘价": "ten"}])
    bar_file(folder, "day.csv", [{**VALUES, "交易日期": ""}])
    bar_file(folder, "none.csv", [])
    (folder / "bytes.csv").write_bytes(b"banner\n\xff\xff\xff\n")
    (folder / "banner.csv").write_bytes(b"banner")
    (folder / "empty.csv").write_bytes(b"")  # Spark passes over files without content.
    bar_file(folder, "other.txt")
    parsed = read_bar_files(spark, str(folder))
    rows = accepted(parsed).orderBy("stock_code").collect()
    assert accepted(parsed).schema == BAR_SCHEMA
    assert [r.stock_code for r in rows] == ["sh600001"] + ["sz000001"] * 3
    for row in rows:
        assert (row.stock_name, row.trade_date, row.open_price, row.close_price) == ("浦发", date(2024, 1, 2), 10.5, None)
        assert (row.hs300_component, row.sse50_component, row.gem_component) == (1, 0, 0)
        assert row.industry_level1 == ""
    found = reasons(parsed)
    assert found.keys() == {"missing.csv", "number.csv", "day.csv", "none.csv", "bytes.csv", "banner.csv"}
    assert "09:55收盘价" in found["missing.csv"] and "ten" in found["number.csv"]


QUOTES = [
    {**VALUES, "股票名称": '"a, ""b"""', "开盘价": "1"}, {**VALUES, "股票名称": 'x 5" y', "开盘价": "2"},
    {**VALUES, "股票名称": '"line one\r\nline, two\r\n\r\n"', "开盘价": "3"}, {**VALUES, "股票名称": '"z"z', "开盘价": "4"},
    {**VALUES, "股票名称": '"q"" \r\n"""', "新版申万一级行业名称": '"end"', "开盘价": "5"}, {**VALUES, "股票名称": '""', "开盘价": "6"},
]


def test_blocks_change_nothing(spark, folder):
    """Files cut into small blocks give the rows and reasons of whole ones, records over several lines included."""
    rows = [{**VALUES, "开盘价": str(i)} for i in range(300)]
    bar_file(folder, "utf.csv", rows)
    bar_file(folder, "gb.csv", rows[:90], "gb2312", tuple(reversed(BAR_HEADERS)), ",more")
    bar_file(folder, "number.csv", [*rows, {**VALUES, "收盘价": "ten"}, *rows])
    bar_file(folder, "missing.csv", rows, headers=tuple(BAR_HEADERS)[:-1])
    (folder / "bytes.csv").write_bytes((folder / "utf.csv").read_bytes() + b"\xff\xff\xff\r\n")
    bar_file(folder, "quote.csv", [*QUOTES, *rows[:40], *QUOTES])
    bar_file(folder, "quote-gb.csv", [*rows[:7], *QUOTES], "gb2312")
    bar_file(folder, "open.csv", [{**VALUES, "股票名称": '"a'}])
    bar_file(folder, "long.csv", [{**VALUES, "股票名称": '"a'}, *rows * 15])
    bar_file(folder, "blank.csv", rows[:2], extra="\r\n\r\n")
    bar_file(folder, "header.csv", [])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    for limit in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            parsed = read_bar_files(spark, str(folder))
            results.append((sorted(map(str, accepted(parsed).collect())), reasons(parsed)))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert results[0] == results[1]
    found, why = results[0]
    assert len(found) == 300 + 90 + 40 + 7 + 3 * len(QUOTES) + 2
    assert why.keys() == {"number.csv", "missing.csv", "bytes.csv", "open.csv", "long.csv", "header.csv"}
    assert "ten" in why["number.csv"] and "09:55收盘价" in why["missing.csv"] and why["header.csv"] == "no rows"
    names = {(r.stock_name, r.open_price) for r in accepted(parsed).where("stock_name <> '浦发'").collect()}
    assert names >= {('a, "b"', 1.0), ('x 5" y', 2.0), ("line one\nline, two\n\n", 3.0), ('"z"z', 4.0), ("", 6.0)}


def test_every_gb2312_character(spark, folder):
    """The JVM decodes what the codec of the same name does."""
    signs = [bytes([a, b]).decode("gb2312", "ignore") for a in range(0xA1, 0xF8) for b in range(0xA1, 0xFF)]
    names = ["".join(signs[i : i + 90]) for i in range(0, len(signs), 90)]
    names = [n for n in names if n.strip() == n and n]
    bar_file(folder, "all.csv", [{**VALUES, "股票名称": n} for n in names], "gb2312")
    found = accepted(read_bar_files(spark, str(folder))).select("stock_name").collect()
    assert sorted(r[0] for r in found) == sorted(names) and len(names) > 80


def test_no_python_reads_files(spark, folder):
    bar_file(folder, "a.csv")
    bar_file(folder, "b.csv", encoding="gb2312")
    text = accepted(read_bar_files(spark, str(folder)))._jdf.queryExecution().toString()
    assert "Python" not in text and "MapInArrow" not in text


def test_names_with_glob_characters(spark, folder):
    bar_file(folder, "a[1]{x}.csv", encoding="gb2312")
    bar_file(folder, "b?.csv")
    parsed = read_bar_files(spark, str(folder))
    assert accepted(parsed).count() == 2 and rejected(parsed).count() == 0


def test_repeated_header_and_empty_banner(spark, folder):
    header = ",".join(BAR_HEADERS)
    row = ",".join(VALUES.get(h, "") for h in BAR_HEADERS)
    (folder / "again.csv").write_bytes("\n".join(["banner", header, row, header, row]).encode())
    (folder / "empty-banner.csv").write_bytes("\n".join(["", header, row]).encode())
    (folder / "empty-header.csv").write_bytes("\n".join(["banner", "", header, row]).encode())
    parsed = read_bar_files(spark, str(folder))
    assert accepted(parsed).count() == 1
    assert reasons(parsed).keys() == {"again.csv", "empty-header.csv"}


def test_folder_without_files(spark, folder):
    bar_file(folder, "bad.csv", headers=("x",))
    parsed = read_bar_files(spark, str(folder))
    assert accepted(parsed).collect() == [] and accepted(parsed).schema == BAR_SCHEMA and rejected(parsed).count() == 1


def test_load_bars_replaces(spark, folder, tmp_path):
    table = str(tmp_path / "table")
    bar_file(folder, "a.csv")
    bar_file(folder, "bad.csv", headers=("x",))
    for _ in range(2):
        assert load_bars(spark, str(folder), table).count() == 1
        assert read_table(spark, table).count() == 1


def finance_file(folder, code, header, *rows, encoding="gb2312", name=None):
    path = folder / code
    path.mkdir(exist_ok=True)
    text = "\n".join(["banner", header, *rows, ""])
    (path / (name or f"{code}_一般企业.csv")).write_bytes(text.encode(encoding))


def test_finance_files(spark, tmp_path):
    header = "stock_code@xbx,report_date@xbx,抓取时间,R_np@xbx,B_total_assets@xbx"
    finance_file(tmp_path, "sh600000", header)
    finance_file(tmp_path, "sh600001", header, "sh600001,20240331,,1.5,bad", "sh600001,,x,,2")
    finance_file(tmp_path, "sh600002", "R_np@xbx,stock_code@xbx,new@xbx", "7,sh600002,1", encoding="utf-8")
    finance_file(tmp_path, "sh600003", header, "sh600003,20240331,,1,1", name="sh600003_银行.csv")
    finance_file(tmp_path, "sh600004", header, "sh600004,20240331,,1,1", name="sh600009_一般企业.csv")
    parsed = read_finance_files(spark, str(tmp_path))
    rows = [tuple(r) for r in accepted(parsed).orderBy("stock_code", "report_date").collect()]
    assert accepted(parsed).columns == ["stock_code", "report_date", "抓取时间", "R_np", "B_total_assets"]
    assert rows == [("sh600001", None, "x", None, 2.0), ("sh600001", "20240331", None, 1.5, None),
                    ("sh600002", None, None, 7.0, None)]
    assert reasons(parsed).keys() == {"sh600000_一般企业.csv"}
    fitted = accepted(read_finance_files(spark, str(tmp_path), ["stock_code", "new"]))
    assert {tuple(r) for r in fitted.collect()} == {("sh600001", None), ("sh600002", 1.0)}


def test_load_statements_appends(spark, tmp_path):
    finance_file(tmp_path, "sh600001", "stock_code,report_date,R_np", "sh600001,20240331,1")
    table = str(tmp_path / "table")
    for n in (1, 2):
        assert load_statements(spark, str(tmp_path), table).count() == 0
        assert read_table(spark, table).count() == n


def test_statements_keep_every_column(spark, tmp_path):
    one, two, table = tmp_path / "one", tmp_path / "two", str(tmp_path / "table")
    for folder, header, row in ((one, "stock_code,report_date,R_np,R_x", "sh600001,20240331,1,2,99"), (two, "R_new,stock_code,R_x", "7,sh600002,3,99")):
        folder.mkdir()
        finance_file(folder, row.split(",")[0 if folder == one else 1], header, row)
        assert load_statements(spark, str(folder), table).count() == 0
    back = read_table(spark, table).orderBy("stock_code")
    assert back.columns == ["stock_code", "report_date", "R_np", "R_x"]
    assert [tuple(r) for r in back.collect()] == [("sh600001", "20240331", 1.0, 2.0), ("sh600002", None, None, 3.0)]


def test_scratch_is_emptied(spark, folder, tmp_path):
    import os

    bar_file(folder, "a.csv")
    where = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(where))
    with scratch(spark):
        load_bars(spark, str(folder), str(tmp_path / "table"))
        assert set(os.listdir(where)) > before
        with scratch(spark):
            inner = keep(spark.range(3), "inner")
            assert inner.count() == 3
        assert not [n for n in os.listdir(where) if n.startswith("inner")]
    assert set(os.listdir(where)) == before and read_table(spark, str(tmp_path / "table")).count() == 1


def test_no_readable_statement_file(spark, tmp_path):
    finance_file(tmp_path, "sh600001", "stock_code")
    with pytest.raises(ValueError):
        read_finance_files(spark, str(tmp_path))


def test_fit_bars(spark):
    fitted = fit_bars(spark.createDataFrame([("a", 1, 2)], "stock_code string, volume int, other int"))
    assert fitted.schema.names == BAR_SCHEMA.names and fitted.first().volume == 1.0 and fitted.first().turnover is None


def test_targets(spark, tmp_path):
    path = tmp_path / "targets.csv"
    path.write_text("备注,代码,    名称,现价\n20240102,SZ000001,平安,10.5\n20240103,sh600000,浦发,8\n", encoding="utf-8")
    listed = spark.read.option("header", True).csv(str(path))
    rows = read_targets(listed).orderBy("list_pos").collect()
    assert [tuple(r)[:4] for r in rows] == [
        (date(2024, 1, 2), "sz000001", "平安", 10.5), (date(2024, 1, 3), "sh600000", "浦发", 8.0)]


def test_result_files(spark, market, tmp_path):
    from __spark_entry__ import queries

    folder = market.folder
    signals = queries()["signals"](spark, folder)
    write_signals(signals, ScreenParams(history_bars=40), str(tmp_path / "signals"))
    back = spark.read.option("header", True).csv(str(tmp_path / "signals"))
    assert back.columns[:5] == ["股票代码", "股票名称", "交易日期", "前复权_收盘价", "前复权_前40天最高收盘价"]
    assert back.count() == signals.count()
    write_dips(queries()["find_dips"](spark, folder), str(tmp_path / "dips"))
    back = spark.read.option("header", True).csv(str(tmp_path / "dips"))
    assert back.columns == ["stock_code", "stock_name", "breakthrough_date", "dip_date", "support_date", "support_price"]
    assert back.count() == queries()["find_dips"](spark, folder).count()
    write_report(queries()["pnl_report"](spark, folder), str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert len(back[0]) == 13 and [r["编号"] for r in back] == [str(i) for i in range(1, len(back))] + [None]


def test_tasks_write_vendor_files(spark, monkeypatch):
    """The driver renames nothing where tasks can write; the files are those of Spark's writer, byte for byte."""
    from pathlib import Path

    from fixtures import files

    rows = [(f"sh{i % 7}" if i % 7 else None, 2, f"{i:04}", f"浦,{i}" if i % 3 else None) for i in range(500)] + [("sz1", 2, "1", '"two\nlines"')]
    lines = spark.createDataFrame(rows, "stock_code string, line int, at string, text string").repartition(5)
    written = []
    for tasks in (True, False):
        with monkeypatch.context() as patch:
            if tasks:
                patch.setattr(files, "_rename", lambda *_: pytest.fail("the driver renames files"))
            else:
                patch.setattr(files, "_address", lambda *_: None)
            root = Path(files._write(lines, F.col("stock_code") == "sh3", "trial", "{code}/{code}.csv").removeprefix("file://"))
        written.append({str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")})
    assert written[0] == written[1] and len(written[0]) == 8 and "浦,3".encode() not in written[0]["sh3/sh3.csv"]


@pytest.mark.parametrize("name", ["bar_csv_ingest", "bar_csv_rejects"])
def test_vendor_files_of_a_part_at_a_time(spark, market, monkeypatch, name):
    """The files of a part of the stocks lie on disk at a time, without shuffle files of theirs; all parts give what one gives."""
    import os
    from importlib import import_module
    from pathlib import Path

    from fixtures import registry

    stocks = {r[0] for r in market.bars.select("stock_code").distinct().collect()}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    read, found = registry.read_bar_files, []
    for rows in (10**9, -(-market.bars.count() // 3)):
        folders, files, before = [], [], set(disk.getAllFiles().mkString("\n").split("\n"))

        def look(spark, folder, folders=folders, files=files, before=before):
            assert not [f for f in folders if os.path.exists(f)]
            folders.append(folder.removeprefix("file://"))
            files.append({p.stem for p in Path(folders[-1]).glob("*.csv")})
            shuffled = sum(os.path.getsize(f) for f in set(disk.getAllFiles().mkString("\n").split("\n")) - before)
            assert shuffled < 0.02 * sum(p.stat().st_size for p in Path(folders[-1]).glob("*.csv"))
            return read(spark, folder)

        monkeypatch.setattr(import_module("fixtures.market"), "FILE_ROWS", rows, raising=False)
        monkeypatch.setattr(registry, "read_bar_files", look)
        result = registry.QUERIES[name](spark, market.folder)
        assert not [f for f in folders if os.path.exists(f)]
        found.append((files, sorted(map(str, result.collect()))))
    (whole, one), (parts, joined) = found
    assert whole == [stocks] and len(parts) == 3 and set().union(*parts) == stocks and sum(map(len, parts)) == len(stocks)
    assert one == joined and len(one) > 1


def test_statement_folders_are_no_pattern(spark, tmp_path, monkeypatch):
    """Folders are listed by tasks, not as a pattern by the driver; only files one folder down are statements."""
    for folder in (tmp_path, tmp_path / "deep"):
        folder.mkdir(exist_ok=True)
        finance_file(folder, "sh600001", "stock_code,R_np", "sh600001,1")
    (tmp_path / f"{tmp_path.name}_一般企业.csv").write_bytes(b"banner\nstock_code,R_np\nsh9,2\n")
    asked, text = [], type(spark.read).text
    with monkeypatch.context() as patch:
        patch.setattr(type(spark.read), "text", lambda self, path, *a, **k: asked.append(path) or text(self, path, *a, **k))
        found = accepted(read_finance_files(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in found] == [("sh600001", 1.0)] and not any("*" in path for path in asked)
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_finance_files(spark, str(tmp_path / "none"), ["stock_code"])


def test_numbers(spark):
    """Letters that make a double of what is none, and words and signs that are one."""
    cells = ["1.5", " 2 ", "1e3", "1d", "1.D ", "7F", "0x1p3", "0X1p3", "-3", "+4.", "Infinity", "NaN", "inf", "f", "1,5", "", None]
    found = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").selectExpr("i", f"cast({_number('c')} as string) v").orderBy("i").collect()
    assert [r.v for r in found] == ["1.5", "2.0", "1000.0", None, None, None, None, None, "-3.0", "4.0", "Infinity", "NaN", "Infinity", None, None, None, None]
