import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelake.plans import engine, report
from tracelake.sources import ingest
from tracelake.streaming import behaviour
from tests.test_logs import LOG


def workbook(rows):
    strings = [c for r in rows for c in r]
    shared = "<sst>" + "".join(f"<si><t>{c.replace('&', '&amp;')}</t></si>" for c in strings) + "</sst>"
    n, body = 0, ""
    for k, r in enumerate(rows):
        body += f'<row r="{k + 1}">'
        for j, _ in enumerate(r):
            body += f'<c r="{chr(65 + j)}{k + 1}" t="s"><v>{n}</v></c>'
            n += 1
        body += "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_line_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_text("﻿one\r\n\nthree\n", encoding="utf-8")
    rows = ingest.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_number").collect()
    assert [(r["line_number"], r["line"]) for r in rows] == [(1, "one"), (2, ""), (3, "three")]


def test_many_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "b.log").write_text("".join(f"line {k}\n" for k in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = ingest.read_lines(spark, str(tmp_path / "b.log"))
        assert df.where(F.col("line") != F.concat(F.lit("line "), (F.col("line_number") - 1).cast("string"))).count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("raw", "want"), [("로그".encode("cp949"), "로그"), (b"\xff\xfea\x00", "a"), (b"\xfe\xff\x00a", "a"), ("é".encode(), "é"), (b"\xef\xbb\xbfx", "x"), (b"", "")])
def test_encodings(raw, want):
    assert ingest.decode_bytes(raw) == want


def test_read_any(spark, tmp_path):
    (tmp_path / "k.txt").write_bytes("로그\r\n둘".encode("cp949"))
    assert [r["line"] for r in ingest.read_any(spark, str(tmp_path / "k.txt")).orderBy("line_number").collect()] == ["로그", "둘"]


def test_workbook_of_records(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(workbook([["Record Number", "Record type", "Filename #1"], ["7", "File", "\\Users\\a & b\\Downloads\\x.exe"]]))
    a = engine.analyze(spark, str(tmp_path / "m.xlsx"))
    assert a.kind == "mft" and a["findings"].first()["category"] == "suspicious-place:downloads"
    assert "suspicious-place" in report.render(a, "m.xlsx")


def test_workbook_of_anything_else_is_a_log(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(workbook([["time", "text"], ["2026-01-01 00:00:00", 'nmap, "x"']]))
    kind, rows, _ = ingest.ingest(spark, str(tmp_path / "s.xlsx"))
    assert kind == "log" and [r["line"] for r in rows.orderBy("line_number").collect()][1] == '2026-01-01 00:00:00,"nmap, ""x"""'


def test_log_file_end_to_end(spark, tmp_path):
    (tmp_path / "web.log").write_text("\n".join(LOG))
    a = engine.analyze(spark, str(tmp_path / "web.log"))
    assert a.kind == "log" and a["entries"].first()["format"] == "weblog"
    assert a["counters"].first()["abnormal_sources"] == 1
    page = report.render(a, "web.log", lambda numbers: f"{numbers['entries']} lines <seen>")
    assert "10 lines &lt;seen&gt;" in page and "45.155.205.99" in page
    report.save(a, "web.log", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() >= 1


def test_csv_log_and_table(spark, tmp_path):
    (tmp_path / "audit.csv").write_text("time,src,event\n2026-01-01 00:00:00,1.2.3.4,mimikatz run\n")
    a = engine.analyze(spark, str(tmp_path / "audit.csv"))
    assert a["anomalies"].first()["category"] == "cred-dump"
    (tmp_path / "mft.tsv").write_text("Inode\tParent Path\tFileName\n5\t\\Temp\tnc.exe\n")
    assert engine.analyze(spark, str(tmp_path / "mft.tsv"))["findings"].first()["category"] == "tool-netcat"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2026-01-01 00:0{k % 9}:00", "1.2.3.4", 401, 10) for k in range(30)] + [("2026-01-01 00:01:00", "5.6.7.8", 404, None)] * 20
    df = spark.createDataFrame(rows, "t string, source_ip string, status_code int, bytes long").select(F.col("t").cast("timestamp").alias("ts"), "source_ip", "status_code", "bytes")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = behaviour.alerts(behaviour.windowed_counts(stream)).writeStream.outputMode("update").format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("alerts").collect())) == sorted(map(tuple, behaviour.alerts(behaviour.windowed_counts(df)).collect()))
    assert {r["category"] for r in spark.table("alerts").collect()} == {"behavior-auth", "behavior-enum"}


@pytest.mark.parametrize(("encoding", "mark"), [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")])
def test_wide_files_are_cut_into_blocks(spark, tmp_path, encoding, mark):
    """Lines keep their numbers over blocks, also where bytes of two characters look like a line end."""
    like_an_end = "\u0a05\u4e00" if encoding == "utf-16-le" else "\u4e00\u0a05"  # 05 0A 00 4E, and 4E 00 0A 05
    lines = [f"line {k} é 로그" + (like_an_end * (k % 3)) * (k % 50 == 7) + ("\r" if k % 4 == 0 else "") for k in range(9000)] + ["", "end " + like_an_end]
    (tmp_path / "w.log").write_bytes(mark + "\n".join(lines).encode(encoding))
    (tmp_path / "u.log").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20001")  # blocks start between the bytes of a character as well
    try:
        df = ingest.read_wide(spark, str(tmp_path / "w.log"), encoding)
        assert spark.read.option("encoding", "UTF-16LE").option("lineSep", "\n").text(str(tmp_path / "w.log")).rdd.getNumPartitions() > 5
        got = [(r["line_number"], r["line"]) for r in df.orderBy("line_number").collect()]
        all_ = ingest.read_text(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k + 1, line.removesuffix("\r")) for k, line in enumerate(lines)] and all_ == len(lines) + 2


def test_workbooks_are_read_as_a_stream():
    """Memory doesn't grow with the rows of a sheet."""
    import tracemalloc

    def peak(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for k in range(n):
                f.write(f'<row r="{k + 1}"><c r="A{k + 1}"><v>{k}</v></c><c r="C{k + 1}" t="inlineStr"><is><r><t>a &amp; </t></r><r><t>b</t></r></is></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
        content = out.getvalue()
        tracemalloc.start()
        rows = 0
        for rows, cells in enumerate(ingest.sheet_rows(content), 1):
            assert cells == [str(rows - 1), "", "a & b"]
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return used - len(content)

    assert peak(40_000) < peak(2_000) + (1 << 20)


def test_first_sheet_by_number_and_odd_cells():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet10.xml", "<worksheet><sheetData><row><c><v>ten</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><sheetData><row><c r="B1" t="s"><v>1</v></c><c t="s"><v>9</v></c><c/></row><row/></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>")
    assert list(ingest.sheet_rows(out.getvalue())) == [["", "one", "", ""], []]
    with pytest.raises(ValueError):
        list(ingest.sheet_rows(b"\xd0\xcf old"))
