"""Lines to log entries.

Entry columns: line_number, ts, source_ip, user, method, url, status_code, bytes, user_agent,
message, raw, format. Empty values are null. Each line is matched by one regular expression once,
which rewrites it to its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.time import parse_timestamp_sql, with_timestamp
from tracelake.rules.iocs import IPV4
from tracelake.rx import Rx, quoted

# The forms of access log lines and of requests in other lines.
CLF = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+([^"]*?)\s+(HTTP/[\d.]+)?"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
IP = Rx(IPV4, False)
REQUEST = Rx(r"\b(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+(/\S*)")
STATUS = Rx(r'HTTP/\d\.\d"?\s+(\d{3})\b')
WEB = Rx(r'"\s*(GET|POST|PUT|DELETE|HEAD)\s+\S+\s+HTTP/\d')
DASH = Rx(r"\d+\.\d+\.\d+\.\d+\s+-\s+", False)
MESSAGE = 500
COLUMNS = ("line_number", "ts", "source_ip", "user", "method", "url", "status_code", "bytes", "user_agent", "message", "raw", "format")
_MARK = "\x01"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def detect_format(name: Column, sample: Column) -> Column:
    """csv, evtx, weblog or txt, by file name and the start of its text."""
    ext = F.element_at(F.split(F.lower(name), r"\."), -1)
    web = sample.rlike(WEB.java) | ((ext == "log") & sample.rlike(DASH.java))
    return F.when(ext == "csv", "csv").when(ext == "evtx", "evtx").when(web, "weblog").otherwise("txt")


def detect_format_sql(name: str, sample: str) -> str:
    ext = f"list_last(string_split(lower({name}), '.'))"
    return f"CASE WHEN {ext} = 'csv' THEN 'csv' WHEN {ext} = 'evtx' THEN 'evtx' WHEN regexp_matches({sample}, {quoted(WEB.re2)}) OR ({ext} = 'log' AND regexp_matches({sample}, {quoted(DASH.re2)})) THEN 'weblog' ELSE 'txt' END"


def generic_fields(raw: Column, format_: Column | str = "txt") -> dict[str, Column]:
    """Fields of a line of any form: the first address, a request, and a status behind HTTP/x.y only."""
    return {
        "source_ip": _or_null(F.regexp_extract(raw, IP.java, 0)),
        "user": F.lit(None).cast("string"),
        "method": _or_null(F.upper(F.regexp_extract(raw, REQUEST.java, 1))),
        "url": _or_null(F.regexp_extract(raw, REQUEST.java, 2)),
        "status_code": F.regexp_extract(raw, STATUS.java, 1).try_cast("int"),
        "bytes": F.lit(None).cast("long"),
        "user_agent": F.lit(None).cast("string"),
        "message": F.substring(F.trim(raw), 1, MESSAGE),
        "format": F.lit(format_) if isinstance(format_, str) else format_,
    }


def _finished(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return with_timestamp(df.select("line_number", *[fields[c].alias(c) for c in COLUMNS[2:] if c != "raw"], "raw"), "raw").select(*COLUMNS)


def _lines(lines: DataFrame, line: str) -> DataFrame:
    return lines.select("line_number", F.col(line).alias("raw")).where(F.trim("raw") != "")


def generic(lines: DataFrame, line: str = "line", format_: str = "txt") -> DataFrame:
    """Entries of lines (line_number, line) of any form."""
    df = _lines(lines, line)
    return _finished(df, generic_fields(F.col("raw"), format_))


def weblog(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of access-log lines; a line of another form gets what `generic` finds in it."""
    df = _lines(lines, line)
    groups = _MARK.join(f"${k}" for k in range(1, 11))
    df = df.withColumn("part", F.split(F.regexp_replace("raw", f"(?s){CLF}.*", groups), _MARK))
    part = lambda k: F.get("part", F.lit(k - 1))
    other = generic_fields(F.col("raw"), "weblog")
    fields = {
        "source_ip": part(1),
        "user": F.when(part(2) != "-", part(2)),
        "method": part(4),
        "url": _or_null(part(5)),
        "status_code": part(7).try_cast("int"),
        "bytes": F.when(part(8) == "-", F.lit(0).cast("long")).otherwise(part(8).try_cast("long")),
        "user_agent": _or_null(part(10)),
        "message": F.concat(part(4), F.lit(" "), part(5), F.lit(" → "), part(7)),
        "format": F.lit("weblog"),
    }
    web = F.size("part") == 10
    return _finished(df, {k: F.when(web, v).otherwise(other[k]) for k, v in fields.items()})


def generic_sql(lines: str, format_: str = "txt") -> str:
    """Entries of the lines of a subquery, for DuckDB."""
    return f"""SELECT line_number, {parse_timestamp_sql('line')} AS ts, nullif(regexp_extract(line, {quoted(IP.re2)}), '') AS source_ip, NULL::VARCHAR AS "user",
      nullif(upper(regexp_extract(line, {quoted(REQUEST.re2)}, 1)), '') AS method, nullif(regexp_extract(line, {quoted(REQUEST.re2)}, 2), '') AS url,
      try_cast(regexp_extract(line, {quoted(STATUS.re2)}, 1) AS INT) AS status_code, NULL::BIGINT AS bytes, NULL::VARCHAR AS user_agent,
      trim(line)[1:{MESSAGE}] AS message, line AS raw, '{format_}' AS format FROM ({lines}) WHERE trim(line) <> ''"""


def weblog_sql(lines: str) -> str:
    """Entries of the access-log lines of a subquery, for DuckDB; all of them have to match."""
    names = "['source_ip', 'user', 'time', 'method', 'url', 'protocol', 'status', 'bytes', 'referer', 'agent']"
    return f"""SELECT line_number, {parse_timestamp_sql('line')} AS ts, m.source_ip, CASE WHEN m."user" <> '-' THEN m."user" END AS "user", m.method, nullif(m.url, '') AS url,
      try_cast(m.status AS INT) AS status_code, CASE WHEN m.bytes = '-' THEN 0 ELSE try_cast(m.bytes AS BIGINT) END AS bytes, nullif(m.agent, '') AS user_agent,
      m.method || ' ' || m.url || ' → ' || m.status AS message, line AS raw, 'weblog' AS format
      FROM (SELECT *, regexp_extract(line, {quoted(CLF)}, {names}) AS m FROM ({lines}) WHERE trim(line) <> '')"""


# What a header has to contain to be a field of a CSV log, tried column by column.
CSV_KEYS = {"time": ("time", "date", "시간", "일시"), "ip": ("ip", "src", "source", "client", "출발지"), "message": ("message", "msg", "event", "description", "detail", "내용", "메시지"), "user": ("user", "account", "사용자", "계정"), "status": ("status", "code", "result", "결과")}


def csv_columns(header: list[str]) -> dict[str, int | None]:
    """Which column of a CSV log holds which field: the first whose header contains a key."""
    low = [h.strip().lower() for h in header]
    return {f: next((k for k, h in enumerate(low) if any(key in h for key in keys)), None) for f, keys in CSV_KEYS.items()}


def split_csv(line: Column, delimiter: str = ",") -> Column:
    """Cells of a line, trimmed: quotes toggle anywhere, two inside quotes are one.

    Outside quotes the delimiters become marks: a line is cut at its quotes, and every other piece
    is outside; an empty piece between two inside ones stands for a doubled quote.
    """
    pieces = F.split(line, '"')

    def joined(p: Column, k: Column) -> Column:
        outside = F.replace(p, F.lit(delimiter), F.lit(_MARK))
        doubled = (p == "") & (k > 0) & (k < F.size(pieces) - 1)
        return F.when(k % 2 == 1, p).when(doubled, F.lit('"')).otherwise(outside)

    return F.transform(F.split(F.array_join(F.transform(pieces, joined), ""), _MARK), lambda c: F.trim(c))


def csv_entries(lines: DataFrame, header: list[str], line: str = "line") -> DataFrame:
    """Entries of the lines of a CSV log, given its header; cells that a row lacks are null."""
    at = csv_columns(header)
    df = _lines(lines, line).withColumn("cells", split_csv(F.col("raw"))).withColumn("joined__", F.array_join("cells", " "))
    cell = lambda f: F.lit(None).cast("string") if at[f] is None else _or_null(F.get("cells", F.lit(at[f])))
    joined = F.col("joined__")
    ip = cell("ip")
    fields = {
        "source_ip": F.when(ip.rlike(IP.java), ip).otherwise(_or_null(F.regexp_extract(joined, IP.java, 0))),
        "user": cell("user"),
        "method": F.lit(None).cast("string"),
        "url": F.lit(None).cast("string"),
        "status_code": F.when(cell("status").rlike(r"^\d{3}\z"), cell("status").try_cast("int")),
        "bytes": F.lit(None).cast("long"),
        "user_agent": F.lit(None).cast("string"),
        "message": F.get("cells", F.lit(at["message"])) if at["message"] is not None else F.substring(joined, 1, MESSAGE),
        "format": F.lit("csv"),
    }
    out = df.select("line_number", F.coalesce(cell("time"), joined).alias("time__"), *[fields[c].alias(c) for c in COLUMNS[2:] if c != "raw"], "raw")
    return with_timestamp(out, "time__").select(*COLUMNS)


def csv_sql(lines: str, header: list[str]) -> str:
    """Entries of the lines of a CSV log, for DuckDB; the header has to name time, address, user, message and status."""
    at = csv_columns(header)
    cell = lambda f: f"nullif(cells[{at[f] + 1}], '')"
    pieces = "string_split(line, '\"')"
    joined = f"array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i % 2 = 0 THEN p WHEN p = '' AND i > 1 AND i < len({pieces}) THEN '\"' ELSE replace(p, ',', chr(1)) END), '')"
    text = "array_to_string(cells, ' ')"
    return f"""SELECT line_number, {parse_timestamp_sql(f"coalesce({cell('time')}, {text})")} AS ts, CASE WHEN regexp_matches({cell('ip')}, {quoted(IP.re2)}) THEN {cell('ip')} ELSE nullif(regexp_extract({text}, {quoted(IP.re2)}), '') END AS source_ip,
      {cell('user')} AS "user", NULL::VARCHAR AS method, NULL::VARCHAR AS url, CASE WHEN regexp_matches({cell('status')}, '^\\d{{3}}$') THEN try_cast({cell('status')} AS INT) END AS status_code,
      NULL::BIGINT AS bytes, NULL::VARCHAR AS user_agent, cells[{at['message'] + 1}] AS message, line AS raw, 'csv' AS format
      FROM (SELECT *, list_transform(string_split({joined}, chr(1)), lambda c: trim(c)) AS cells FROM ({lines}) WHERE trim(line) <> '')"""
