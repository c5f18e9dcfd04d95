"""What keeps large tables within their time: tasks of bounded size, guards that say enough, characters counted in batches."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake import rx
from tracelake.functions import text, time
from tracelake.operators import detect, iocs, observe, parse
from tracelake.rules.iocs import PATTERNS
from tracelake.rules.signatures import SIGNATURES
from tracelake.plans.case import LogCase
from tracelake.sources import testbed

LINES = ["", "plain words", "see https://a.example.org/x?y=1 or http://b.example.com", "' or '1'='1", "nmap; id `x` $(y)", "größer 가나다 \U0001f600 12", "10.0.0.1 - - [01/Feb/2024:10:11:12 +0100] \"GET /.env HTTP/1.1\" 404 -", "2024-02-01 10:11:12 [99/Xyz/2024:10:11:12", "Feb  3 04:05:06 host", "t=1700000000123", "mail a@b.example.com C:\\x\\y.exe " + "a" * 64]


def test_larger_tables_have_more_tasks(spark, tmp_path):
    n = 6 * testbed.ROWS + 1
    spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    dealt = testbed.spread(spark, str(tmp_path), "t")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == 7 and max(sizes) <= testbed.ROWS + 1


def test_a_part_that_may_be_missing_stays_in_the_literal():
    assert rx.needed(r"\bhttps?://[^\s]+") == {"http://", "https://"}
    assert "or" not in rx.needed(r"'\s*or\s*'?1")


def test_gates_change_no_result(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "t string").withColumn("l", F.lower("t"))
    plain = F.array_compact(F.array(*[F.when(rx.any_of(F.col("t"), s.patterns), F.lit(k)) for k, s in enumerate(SIGNATURES)]))
    values = F.transform(iocs.found(F.col("t"), F.col("l")), lambda x: F.concat_ws(":", x["type"], x["value"]))
    said = lambda kind: lambda v: F.concat(F.lit(f"{kind}:"), v)
    every = [F.transform(F.regexp_extract_all("t", F.lit(p.java), F.lit(0)), said(kind)) for kind, p in PATTERNS]
    rows = df.select(detect.rule_numbers(F.col("t"), F.col("l")).alias("a"), plain.alias("b"), values.alias("c"), F.flatten(F.array(*every)).alias("d")).collect()
    assert [(r["a"], r["c"]) for r in rows] == [(r["b"], r["d"]) for r in rows]
    assert any(r["a"] for r in rows) and any("url:" in x for r in rows for x in r["c"])


def test_times_are_the_same_form_by_form(spark):
    df = spark.createDataFrame([(t,) for t in [*LINES, None]], "t string")
    got = [tuple(r) for r in time.with_timestamp(df, "t").select("ts", time.parse_timestamp(F.col("t")).alias("own")).collect()]
    assert all(a == b for a, b in got) and sum(a is not None for a, _ in got) == 4


def test_characters_in_batches(spark, monkeypatch):
    texts = [*LINES, None, "x" * 300, "\t\n 1aZ_"]
    stats = text.char_stats(F.col("t"))
    want = spark.createDataFrame([(t,) for t in texts], "t string").select(text.shannon_entropy(F.col("t")), stats["len"], stats["digit_ratio"], stats["special_ratio"], F.coalesce(F.length(F.regexp_replace("t", r"[\x00-\x7f]", "")), F.lit(0))).collect()
    for counted, together in ((1 << 20, 2048), (40, 3)):
        monkeypatch.setattr(text, "COUNTED", counted)
        monkeypatch.setattr(text, "TOGETHER", together)
        m = text.measured(pa.array([None, *texts], pa.string()).slice(1))
        n = np.maximum(1, m["length"])
        got = np.stack([m["entropy"], m["length"], m["digits"] / n, m["special"] / n, m["beyond"]], axis=1)
        assert got.tolist() == [pytest.approx(list(r)) for r in want]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_rows_hold_is_worked_out_after_they_are_dealt(spark, tmp_path):
    spark.range(9).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plan = _plan(detect.behaviour(parse.weblog(testbed.access_lines(spark, str(tmp_path)))))
    behind = plan[plan.index("Repartition") :]
    assert "Filter" not in behind and "HTTP" not in behind and "HTTP" in plan


def test_lines_are_not_sorted_to_be_counted(spark):
    entries = parse.weblog(spark.createDataFrame([(1, LINES[6]), (2, LINES[6])], "line_number long, line string"))
    for df in (detect.behaviour(entries), observe.sources(entries)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
        row = df.first()
        assert row["missing"] == 2 and row["first_missing_line"] == 1 and row["first_missing_ts"] is not None and row["first_denied_line"] is None


def test_batches_are_matched_as_by_duckdb(spark):
    texts = [*LINES, None, "union\x0bselect", "union\tselect", "powershell a\rb -enc x", "curl a\nb post", "CVE-2021-44228 log4j", "C:\\a\\b.exe", "x@y.org", "사용자 로그인 실패"]
    groups = observe.GROUPS
    con = duckdb.connect()
    want = [sum(1 << k for k, g in enumerate(groups) if t is not None and con.execute(f"SELECT {rx.any_sql('?', g)}", [t]).fetchone()[0]) for t in texts]
    assert rx.matched(pa.array([None, *texts], pa.string()).slice(1), ["|".join(p.re2 for p in g) for g in groups]).to_pylist() == want
    assert rx.matched(pa.array([], pa.string()), ["a"]).to_pylist() == []
    entries = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line_number long, raw string").withColumn("message", F.lit(""))
    hits = {(r["line_number"], r["rule_no"]) for r in detect.rule_hits(entries).collect()}
    assert hits == {(k, no) for k, bits in enumerate(want) for no in range(len(SIGNATURES)) if bits >> no & 1}


def test_marks_are_those_found_without_bits(spark):
    df = spark.createDataFrame([(t,) for t in [*LINES, "CVE-2021-44228 203.0.113.9 x@y.org b.com http://c.net/d.png http://e.io/f"]], "t string").withColumn("l", F.lower("t")).withColumn("b", rx.occurring(F.col("t"), observe.GROUPS))
    first = len(observe.GROUPS) - len(iocs.SELDOM)
    rows = df.select(iocs.found(F.col("t"), F.col("l")).alias("a"), iocs.marked(F.col("t"), F.col("b"), first).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and len(rows[-1]["a"]) == 8


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(k, f'10.0.0.{k % 2} - - [01/Feb/2024:10:11:12 +0000] "GET /.env{k} HTTP/1.1" 404 -') for k in range(40)], "line_number long, line string")
    case = LogCase(parse.weblog(lines))
    assert case.observed.count() == 40
    case.entries = None  # nothing goes back to the lines
    assert case.report_lines.count() > 3 and case.anomalies.where("rule_no = 19").count() == 2
    assert "HTTP" not in _plan(detect.anomalies(parse.weblog(lines)))
