"""Formats, seeded numbers, literal guards, encodings in whole analyses, and what reports say."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_files import workbook
from tests.test_logs import LOG
from tracelake import rx, store
from tracelake.functions import format as formats
from tracelake.functions import random as seeded
from tracelake.operators import clusters, mft
from tracelake.plans import engine, report
from tracelake.rules import corpus
from tracelake.rules.cves import CVES
from tracelake.rules.iocs import PATTERNS
from tracelake.rules.signatures import SIGNATURES


def test_formats(spark):
    df = spark.createDataFrame([(n,) for n in (None, -1, 0, 1023, 1024, 1280, 10239, 10240, 1 << 20, 5 << 40)], "n long")
    assert [r["x"] for r in df.select(formats.bytes_said(F.col("n")).alias("x")).collect()] == ["0 B", "0 B", "0 B", "1023 B", "1.0 KB", "1.3 KB", "10.0 KB", "10 KB", "1.0 MB", "5120 GB"]
    one = spark.createDataFrame([(1234567, 0.125, dt.datetime(2026, 1, 2, 3, 4, 5), "C:\\a/b.c")], "n long, s double, t timestamp, v string")
    row = one.select(formats.number_said(F.col("n")), formats.percent_said(F.col("s")), formats.percent_said(F.col("s"), 1), formats.time_said(F.col("t")), formats.time_said(F.lit(None).cast("timestamp")), formats.breakable(F.col("v"))).first()
    assert list(row) == ["1,234,567", "13%", "12.5%", "03:04:05", "—", "C:\u200b\\\u200ba/\u200bb.\u200bc"]


def test_seeded_numbers_are_the_published_ones():
    assert seeded.seed_from("a") == 0xE40C292C and seeded.seed_from("a", 1) == seeded.seed_from("a|1")
    assert list(seeded.uniform(1, [0, 1])) == [pytest.approx(0.6270739405881613), pytest.approx(0.002735721180215478)]
    assert list(seeded.uniform(1, [1])) == list(seeded.uniform(1, [0, 1]))[1:]
    many = seeded.uniform(7, range(10_000))
    assert 0 <= many.min() and many.max() < 1 and abs(many.mean() - 0.5) < 0.02


def test_seeded_numbers_of_sql():
    db = duckdb.connect()
    assert [r[0] for r in db.execute(f"SELECT {seeded.uniform_sql('4000000000', 'i')} FROM range(100) AS t(i) ORDER BY i").fetchall()] == list(seeded.uniform(4_000_000_000, range(100)))
    assert db.execute(f"SELECT {seeded.seed_from_sql('s')}::BIGINT FROM (SELECT '12|é x' AS s)").fetchone()[0] == seeded.seed_from(12, "é x")


#: For each pattern a text that it matches, built from what it needs, would pass its guard; these are written by hand.
HITS = (
    ("recon-scanner", "a SQLMap b"), ("recon-scanner", "zgrab x"), ("recon-enum", "GET /.env HTTP"), ("sqli", "1 UNION\tSELECT 2"), ("sqli", "x' or '1'='1"), ("sqli", "a;-- b"), ("xss", "ONERROR=x"), ("path-traversal", "..\\..\\x"),
    ("log4shell", "${JNDI:ldap://x}"), ("cmd-injection", "; wget x"), ("cmd-injection", "`id`"), ("brute-force", "event id: 4625"), ("cred-dump", "SEKURLSA"), ("powershell-enc", "powershell -nop -w hidden"), ("webshell", "/c99.php?cmd=1"),
    ("persistence-reg", "schtasks  /create"), ("privesc", "SeDebugPrivilege"), ("log-clear", "del x.evtx"), ("lateral", "\\\\h\\C$"), ("c2-beacon", "/submit.php"), ("exfil", "scp x u@h"), ("ransomware", "vssadmin delete shadows"),
)
MISSES = ("GET /index.html 200", "nikt o", "unions elected", "/administration", "so lo", "event 46250", "lsass", "path..to", "curling", "a b c", "")


def test_guards_hold_wherever_patterns_do(spark):
    texts = [t for _, t in HITS] + list(MISSES) + [f"x {t.upper()} y" for _, t in HITS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    groups = [s.patterns for s in SIGNATURES] + [c.patterns for c in CVES if c.patterns] + [(p,) for _, p in PATTERNS]
    for patterns in groups:
        both = df.select(rx.any_of(F.col("t"), patterns).alias("a"), rx.any_of(F.col("t"), patterns, F.col("low")).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both)


def test_each_rule_hits_and_misses(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(HITS)] + [(100 + k, t) for k, t in enumerate(MISSES)], "k int, t string").withColumn("low", F.lower("t"))
    for s in SIGNATURES:
        found = {r["k"] for r in df.where(rx.any_of(F.col("t"), s.patterns, F.col("low"))).collect()}
        assert {k for k, (code, _) in enumerate(HITS) if code == s.code} <= found and not {k for k in found if k >= 100}, s.code


@pytest.mark.parametrize("encoding", ["cp949", "utf-16"])
def test_logs_in_other_encodings(spark, tmp_path, encoding):
    (tmp_path / "old.log").write_bytes("\n".join(["2026-01-01 00:00:00 로그인 실패 10.0.0.1", "2026-01-01 00:00:01 nmap 한글"]).encode(encoding))
    a = engine.analyze(spark, str(tmp_path / "old.log"))
    assert [r["raw"][20:23] for r in a["entries"].orderBy("line_number").collect()] == ["로그인", "nma"]
    assert {r["category"] for r in a["anomalies"].collect()} == {"brute-force", "recon-scanner"}


def test_whole_log_analysis(spark, tmp_path):
    (tmp_path / "web.log").write_text("\n".join(LOG))
    a = engine.analyze(spark, str(tmp_path / "web.log"))
    for name in engine.LOG_FRAMES:
        a[name].count()
    lines = a["ioc_lines"].where("type = 'ip'").collect()
    assert {(r["key"], r["line_number"]) for r in lines} >= {("45.155.205.99", k) for k in range(3, 9)}
    assert a["cve_evidence"].first()["cve"] == "CVE-2021-44228" and a["intrusion"].first()["top_source"] == "45.155.205.99"
    m = a["ml_metrics"].first()
    assert m["rows"] == 10 and 0.8 < m["accuracy"] <= 1 and -1 <= m["silhouette"] <= 1
    page = report.render(a, "web.log")
    assert all(x in page for x in ("Facts", "Assessments", "Techniques", "Vulnerabilities", "[ML]", "assessment", "Times can be forged"))


def test_whole_record_analysis(spark, tmp_path):
    rows = [["Record Number", "Record type", "Filename #1", "Std Info Creation date"]] + [[str(k), "File", p, "2024-01-05 10:00:00"] for k, p in enumerate(["\\Users\\a\\Downloads\\x.exe", "\\Temp\\mimikatz.exe", *(f"\\docs\\f{j}.txt" for j in range(8))])]
    (tmp_path / "m.xlsx").write_bytes(workbook(rows))
    a = engine.analyze(spark, str(tmp_path / "m.xlsx"))
    assert a["flow_edges"].count() >= 1 and a["intrusion"].first()["top_source"] is None and a["ml_clusters"].count() >= 1
    assert "file records analysed" in report.render(a, "m.xlsx")
    assert mft.search(a["findings"], "MIMI").count() == 1 and mft.search(a["findings"], "mimi", "low").count() == 0


def test_silhouette_by_hand(spark):
    points, centres = [((0.0, 0.0), 0), ((1.0, 0.0), 0), ((5.0, 5.0), 1)], np.array([[0.5, 0.0], [5.0, 5.0]])
    df = spark.createDataFrame([(clusters.apart(np.array([p]), centres)[0].tolist(),) for p, _ in points], "apart array<double>")
    want = []
    for p, c in points:
        own, other = math.dist(p, centres[c]), math.dist(p, centres[1 - c])
        want.append((other - own) / max(own, other))
    assert clusters.silhouette(clusters.Clusters(df, centres, []), spark).first()["silhouette"] == pytest.approx(sum(want) / 3)
    assert clusters.silhouette(None, spark).first()["silhouette"] == 0


def test_corpus_lines_differ_and_forms_stay_in_a_fold():
    lines = corpus.documents()
    assert len(lines) == len({t for _, t, _ in lines}) >= 560
    forms = len(next(iter(corpus.FORMS.values())))
    assert forms % 5 == 0 and {len(f) for f in corpus.FORMS.values()} == {forms}


def test_scratch_removes_what_was_written(spark):
    with store.scratch(spark):
        df, path = store.cut_at(spark.range(5), "trial")
        assert df.count() == 5
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
