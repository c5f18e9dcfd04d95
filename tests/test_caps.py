"""Nothing is left out before a report's own limit."""

from pyspark.sql import functions as F

from tests.test_files import workbook
from tests.test_logs import LOG
from tracelake.operators import mft
from tracelake.plans import engine
from tracelake.queries import mft as queries
from tracelake.sources import ingest


def test_late_critical_findings_are_shown(spark, monkeypatch):
    found = spark.range(mft.SCAN_CAP + 1).select(F.col("id").alias("record_number"), F.lit(1).alias("rule_no"), F.lit("c").alias("category"), F.when(F.col("id") == mft.SCAN_CAP, "critical").otherwise("low").alias("severity"), F.lit("p").alias("path"))
    monkeypatch.setattr(queries, "found", lambda spark, sf: found)
    rows = queries.mft_shown(spark, "").collect()
    assert len(rows) == mft.SHOWN
    assert (rows[0]["record_number"], rows[0]["severity"]) == (mft.SCAN_CAP, "critical")


def test_sheets_are_read_to_the_end(spark, tmp_path, monkeypatch):
    (tmp_path / "m.xlsx").write_bytes(workbook([["a"]] * 7))
    book = (tmp_path / "m.xlsx").read_bytes()
    assert ingest.sheet_rows.__defaults__ == (None,) and len(list(ingest.sheet_rows(book))) == 7
    assert ingest.read_sheets(spark, str(tmp_path / "m.xlsx")).count() == 7
    assert ingest.read_sheets(spark, str(tmp_path / "m.xlsx"), 3).count() == 3


def test_format_is_told_from_the_first_characters(spark, tmp_path):
    (tmp_path / "web.txt").write_text("\n".join(["# preamble"] * 90 + list(LOG)))
    assert engine.analyze(spark, str(tmp_path / "web.txt"))["entries"].first()["format"] == "weblog"
