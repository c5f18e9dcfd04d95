"""File-system (NTFS MFT) records: from table cells to records, and findings on them.

A record is checked by one projection: the findings it gives make an array in rule order, which is
exploded. Nothing is shuffled before findings are aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.time import parse_timestamp, parse_timestamp_sql
from tracelake.operators.detect import truncate, truncate_sql
from tracelake.operators.iocs import encoded, encoded_sql
from tracelake.rules import mft as rules
from tracelake.rules import severity
from tracelake.rules.iocs import REFERENCE_OTHER
from tracelake.rx import any_of, any_sql, first_of, quoted

TIMES = ("si_created", "si_modified", "si_accessed", "si_entry", "fn_created", "fn_modified", "fn_accessed", "fn_entry")
# What a header has to contain to be a column, tried column by column.
HEADERS = {
    "record_number": ("record number", "entry number", "entrynumber", "inode", "recordnumber"),
    "active": ("active",),
    "in_use": ("in use", "inuse"),
    "record_type": ("record type", "recordtype"),
    "is_dir": ("isdirectory", "is directory"),
    "path": ("filename #1", "full path", "fullpath", "filepath", "full name"),
    "parent_path": ("parent path", "parentpath"),
    "file_name": ("filename", "file name", "name"),
    "si_created": ("std info creation", "created0x10", "si created", "standardinfo creation"),
    "si_modified": ("std info modification", "lastmodified0x10", "si modified"),
    "si_accessed": ("std info access", "lastaccess0x10", "si access"),
    "si_entry": ("std info entry", "lastrecordchange0x10", "si entry"),
    "fn_created": ("fn info creation", "created0x30", "fn created", "filename creation"),
    "fn_modified": ("fn info modification", "lastmodified0x30", "fn modified"),
    "fn_accessed": ("fn info access", "lastaccess0x30", "fn access"),
    "fn_entry": ("fn info entry", "lastrecordchange0x30", "fn entry"),
}
NO_DATE = r"(?i)^(no(si|fn)record|zero|n/?a|-|0)\z"
NO_PATH = r"(?i)^(no(si|fn)record|zero)\z"
SERIAL_DAY, SERIAL_END = 25569, 2958466
SCAN_CAP, SHOWN, DATED, EVIDENCES = 6000, 3000, 80, 12


def column_map(header: list[str]) -> dict[str, int | None]:
    """Which cell holds which column: the first header that contains a key."""
    low = [h.strip().lower() for h in header]
    return {name: next((k for k, h in enumerate(low) if any(key in h for key in keys)), None) for name, keys in HEADERS.items()}


def is_mft_table(header: list[str]) -> bool:
    """Whether a header is that of a table of file records."""
    low = [h.strip().lower() for h in header]
    has = lambda *keys: any(key in h for key in keys for h in low)
    numbered = has("record number", "entry number", "entrynumber", "inode") and has("record type", "parent")
    return has("filename", "file name") and (has("std info creation", "created0x10", "fn info creation", "created0x30") or numbered)


def parse_date(cell: Column) -> Column:
    """A date cell: a placeholder is null, a number is a serial day of a spreadsheet, other text a timestamp."""
    v = F.trim(cell)
    serial = v.try_cast("double")
    number = v.rlike(r"^\d+(\.\d+)?\z")
    stamp = F.timestamp_millis(F.round((serial - SERIAL_DAY) * 86400000).cast("bigint"))
    return F.when(v.isNull() | (v == "") | v.rlike(NO_DATE), None).when(number, F.when((serial > 1) & (serial < SERIAL_END), stamp)).otherwise(parse_timestamp(v))


def parse_date_sql(cell: str) -> str:
    v = f"trim({cell})"
    stamp = f"make_timestamp(cast(round((try_cast({v} AS DOUBLE) - {SERIAL_DAY}) * 86400000) AS BIGINT) * 1000)"
    placeholder = NO_DATE.replace(r"\z", "$")
    return f"CASE WHEN {v} IS NULL OR {v} = '' OR regexp_matches({v}, {quoted(placeholder)}) THEN NULL WHEN regexp_matches({v}, '^\\d+(\\.\\d+)?$') THEN (CASE WHEN try_cast({v} AS DOUBLE) > 1 AND try_cast({v} AS DOUBLE) < {SERIAL_END} THEN {stamp} END) ELSE {parse_timestamp_sql(v)} END"


def records(rows: DataFrame, header: list[str], cells: str = "cells", number: str = "row_number") -> DataFrame:
    """Records of rows (number, cells array<string>) under a header."""
    at = column_map(header)

    def cell(name: str) -> Column:
        return F.lit("") if at[name] is None else F.trim(F.coalesce(F.get(cells, F.lit(at[name])), F.lit("")))

    parent, own = F.regexp_replace(cell("parent_path"), r"[\\/]+\z", ""), cell("file_name")
    joined = F.when(cell("parent_path") != "", F.concat(parent, F.lit("\\"), own)).otherwise(own)
    path = F.when(cell("path") != "", cell("path")).otherwise(joined)
    path = F.when((path == "") | path.rlike(NO_PATH), "").otherwise(F.translate(path, "\\", "/"))
    active, used = F.lower(cell("active")), F.lower(cell("in_use"))
    is_active = F.when(active != "", ~active.rlike("inactive|deleted|false|no|0") & active.rlike("active|true|yes|1")).when(used != "", used.rlike("true|yes|1")).otherwise(True)
    kind = F.when(cell("record_type") != "", cell("record_type")).when(F.lower(cell("is_dir")).rlike("true|yes|1"), "Folder").otherwise("File")
    n = cell("record_number").try_cast("bigint")
    out = rows.select(F.when(n.isNull() | (n == 0), F.col(number)).otherwise(n).alias("record_number"), is_active.alias("active"), kind.alias("record_type"), path.alias("path"), *[parse_date(cell(t)).alias(t) for t in TIMES])
    name = F.element_at(F.split(F.regexp_replace("path", r"/+\z", ""), "/"), -1)
    out = out.withColumn("file_name", name)
    base = F.substring_index("file_name", ":", 1)
    ext = F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)\z", 1))
    return out.withColumn("ext", ext).select("record_number", "active", "record_type", "path", "file_name", "ext", *TIMES)


def records_sql(rows: str, header: tuple[str, ...]) -> str:
    """Records of a DuckDB subquery of (row_number, c0, c1, ...); the header has to name a path and a type."""
    at = column_map(list(header))
    cell = lambda name: "''" if at[name] is None else f"trim(coalesce(c{at[name]}, ''))"
    times = ", ".join(f"{parse_date_sql(cell(t))} AS {t}" for t in TIMES)
    active = f"lower({cell('active')})"
    placeholder = NO_PATH.replace(r"\z", "$")
    return f"""SELECT *, lower(regexp_extract(string_split(file_name, ':')[1], '(?s)^.+\\.([^.]*)$', 1)) AS ext FROM (
      SELECT *, list_last(string_split(regexp_replace(path, '/+$', ''), '/')) AS file_name FROM (
        SELECT coalesce(nullif(try_cast({cell('record_number')} AS BIGINT), 0), row_number) AS record_number,
          CASE WHEN {active} <> '' THEN NOT regexp_matches({active}, 'inactive|deleted|false|no|0') AND regexp_matches({active}, 'active|true|yes|1') ELSE true END AS active,
          {cell('record_type')} AS record_type, CASE WHEN {cell('path')} = '' OR regexp_matches({cell('path')}, {quoted(placeholder)}) THEN '' ELSE replace({cell('path')}, '\\', '/') END AS path, {times} FROM ({rows})))"""


def _flags() -> dict[str, Column]:
    """What the rules ask of a record."""
    low = F.lower("path")
    place = first_of([(any_of(low, (rx,)), F.lit(label)) for label, rx, _ in rules.SUSPICIOUS], F.lit(None).cast("string"))
    hours = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(3600e6)
    return {
        "low": low,
        "is_exe": F.col("ext").isin(*rules.EXECUTABLE) & ~any_of(F.col("file_name"), rules.BENIGN),
        "in_system": any_of(low, rules.SYSTEM),
        "artifact": any_of(F.col("path"), rules.ARTIFACT),
        "orphan": any_of(F.col("path"), rules.ORPHAN) | ~F.col("path").startswith("/"),
        "place": place,
        "root": any_of(F.col("path"), rules.DRIVE_ROOT) & ~any_of(F.col("file_name"), rules.BENIGN),
        "expected": any_of(low, rules.EXPECTED),
        "legitimate": any_of(low, rules.LEGITIMATE),
        "si_before_fn": F.coalesce(hours(F.col("fn_created"), F.col("si_created")) > 24, F.lit(False)),
        "si_after_change": F.coalesce(hours(F.col("si_created"), F.col("si_modified")) > 1, F.lit(False)),
    }


def _severity_of(place: Column, deleted: Column) -> Column:
    base = F.lit("high")
    for label, _, s in rules.SUSPICIOUS:
        base = F.when(place == label, s).otherwise(base)
    return F.when(deleted & (base == "medium"), "high").when(deleted & (base == "low"), "medium").otherwise(base)


def flagged(records_: DataFrame) -> DataFrame:
    """Records with the flags the rules use, each worked out once."""
    return records_.withColumns(_flags())


def findings(records_: DataFrame) -> DataFrame:
    """All findings, uncapped: (record_number, rule_no, category, severity, confidence, technique_id, path, file_name, active, si_created, fn_created)."""
    df = flagged(records_.where("path <> ''"))
    name = F.col("file_name")

    def one(when: Column, no: int, category: Column | str, sev: Column | str, confidence: str, technique: Column | str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(F.lit(no).alias("rule_no"), lit(category).alias("category"), lit(sev).alias("severity"), F.lit(confidence).alias("confidence"), lit(technique).alias("technique_id")))

    df = df.withColumn("tools", F.array(*[any_of(name, rx) for _, rx, _, _ in rules.TOOLS]))
    tool = [one(F.get("tools", F.lit(k)), k, label, sev, "fact", tech) for k, (label, _, tech, sev) in enumerate(rules.TOOLS)]
    tool_hit = F.array_contains("tools", True)
    n = len(rules.TOOLS)
    plain = ~F.col("in_system") & ~F.col("artifact")
    stream = F.when(F.instr(name, ":") > 1, F.regexp_extract(name, r"(?s)^[^:]*:(.*)\z", 1)).otherwise("")
    meta = F.col("low").startswith("/$") | name.startswith("$") | stream.startswith("$")
    ads = (F.instr(name, ":") > 1) & ~meta & ~any_of(name, rules.KNOWN_STREAM)
    loose = F.col("is_exe") & ~F.col("artifact") & ~F.col("orphan") & ~tool_hit
    placed = F.col("place").isNotNull() | F.col("root")
    others = [
        one(plain & any_of(name, rules.DOUBLE), n, "double-extension", "high", "fact", "T1036.007"),
        one(plain & ads, n + 1, "data-stream", "medium", "fact", "T1564.004"),
        one(~F.col("artifact") & F.lower(name).isin(*rules.PROTECTED) & ~F.col("legitimate"), n + 2, "process-name", "high", "assessment", "T1036.005"),
        one(loose & placed, n + 3, F.concat(F.lit("suspicious-place:"), F.coalesce("place", F.lit("drive-root"))), _severity_of(F.col("place"), ~F.col("active")), "assessment", F.when(F.col("ext").startswith("ps"), "T1059.001").otherwise("T1105")),
        one(~F.col("active") & loose & ~F.col("in_system") & ~placed & ~F.col("expected"), n + 4, "deleted-executable", "medium", "fact", "T1070.004"),
    ]
    found = F.filter(F.array(*tool, *others), lambda x: x.isNotNull())
    out = df.withColumn("f__", F.explode(found))
    return out.select("record_number", "f__.*", "path", "file_name", "active", "si_created", "fn_created", (F.col("si_before_fn") & ~F.col("in_system") | F.col("si_after_change")).alias("odd_times"))


def findings_sql(records_: str) -> str:
    low, name = "lower(path)", "file_name"
    case = lambda get: "CASE " + " ".join(f"WHEN {any_sql(low, (rx,))} THEN '{get(label, s)}'" for label, rx, s in rules.SUSPICIOUS) + " END"
    flags = f"""list_contains({list(rules.EXECUTABLE)}, ext) AND NOT {any_sql(name, rules.BENIGN)} AS is_exe, {any_sql(low, rules.SYSTEM)} AS in_system, {any_sql('path', rules.ARTIFACT)} AS artifact,
      {any_sql('path', rules.ORPHAN)} OR NOT starts_with(path, '/') AS orphan, {case(lambda label, s: label)} AS place, {case(lambda label, s: s)} AS place_severity,
      {any_sql('path', rules.DRIVE_ROOT)} AND NOT {any_sql(name, rules.BENIGN)} AS root, {any_sql(low, rules.EXPECTED)} AS expected, {any_sql(low, rules.LEGITIMATE)} AS legitimate,
      instr({name}, ':') > 1 AS has_stream, CASE WHEN instr({name}, ':') > 1 THEN {name}[instr({name}, ':') + 1:] ELSE '' END AS stream, [{', '.join(any_sql(name, rx) for _, rx, _, _ in rules.TOOLS)}] AS tools,
      coalesce(epoch_us(fn_created) - epoch_us(si_created) > 86400000000, false) AS si_before_fn, coalesce(epoch_us(si_created) - epoch_us(si_modified) > 3600000000, false) AS si_after_change"""
    n = len(rules.TOOLS)
    tool = [f"SELECT *, {k} AS rule_no, '{label}' AS category, '{sev}' AS severity, 'fact' AS confidence, '{tech}' AS technique_id FROM flagged WHERE tools[{k + 1}]" for k, (label, _, tech, sev) in enumerate(rules.TOOLS)]
    plain, loose, placed = "NOT in_system AND NOT artifact", "is_exe AND NOT artifact AND NOT orphan AND NOT list_contains(tools, true)", "(place IS NOT NULL OR root)"
    meta = f"(starts_with({low}, '/$') OR starts_with({name}, '$') OR starts_with(stream, '$'))"
    base = "coalesce(place_severity, 'high')"
    bumped = f"CASE WHEN NOT active AND {base} = 'medium' THEN 'high' WHEN NOT active AND {base} = 'low' THEN 'medium' ELSE {base} END"
    others = [
        f"SELECT *, {n}, 'double-extension', 'high', 'fact', 'T1036.007' FROM flagged WHERE {plain} AND {any_sql(name, rules.DOUBLE)}",
        f"SELECT *, {n + 1}, 'data-stream', 'medium', 'fact', 'T1564.004' FROM flagged WHERE {plain} AND has_stream AND NOT {meta} AND NOT {any_sql(name, rules.KNOWN_STREAM)}",
        f"SELECT *, {n + 2}, 'process-name', 'high', 'assessment', 'T1036.005' FROM flagged WHERE NOT artifact AND list_contains({list(rules.PROTECTED)}, lower({name})) AND NOT legitimate",
        f"SELECT *, {n + 3}, 'suspicious-place:' || coalesce(place, 'drive-root'), {bumped}, 'assessment', CASE WHEN starts_with(ext, 'ps') THEN 'T1059.001' ELSE 'T1105' END FROM flagged WHERE {loose} AND {placed}",
        f"SELECT *, {n + 4}, 'deleted-executable', 'medium', 'fact', 'T1070.004' FROM flagged WHERE NOT active AND {loose} AND NOT in_system AND NOT {placed} AND NOT expected",
    ]
    return f"""WITH flagged AS (SELECT *, {flags} FROM ({records_}) WHERE path <> '')
      SELECT record_number, rule_no, category, severity, confidence, technique_id, path, file_name, active, si_created, fn_created, (si_before_fn AND NOT in_system) OR si_after_change AS odd_times FROM ({' UNION ALL '.join(tool + others)})"""


def totals(records_: DataFrame) -> DataFrame:
    """One row of counts over all records."""
    df = flagged(records_)
    folder = F.lower("record_type").rlike("folder|directory")
    named = F.col("path") != ""
    return df.agg(
        F.count("*").alias("records"),
        F.count_if(~folder).alias("files"),
        F.count_if(folder).alias("folders"),
        F.count_if("active").alias("active"),
        F.count_if(~F.col("active")).alias("inactive"),
        F.count_if(F.col("si_created").isNotNull() | F.col("fn_created").isNotNull()).alias("dated"),
        F.count_if(named & ~F.col("in_system") & F.col("si_before_fn")).alias("si_before_fn"),
        F.count_if(named & ~F.col("in_system") & F.col("si_after_change")).alias("si_after_change"),
    )


def totals_sql(records_: str) -> str:
    folder, named = "regexp_matches(lower(record_type), 'folder|directory')", f"path <> '' AND NOT {any_sql('lower(path)', rules.SYSTEM)}"
    return f"""SELECT count(*)::BIGINT AS records, count(*) FILTER (NOT {folder})::BIGINT AS files, count(*) FILTER ({folder})::BIGINT AS folders, count(*) FILTER (active)::BIGINT AS active, count(*) FILTER (NOT active)::BIGINT AS inactive,
      count(*) FILTER (si_created IS NOT NULL OR fn_created IS NOT NULL)::BIGINT AS dated, count(*) FILTER ({named} AND epoch_us(fn_created) - epoch_us(si_created) > 86400000000)::BIGINT AS si_before_fn,
      count(*) FILTER ({named} AND epoch_us(si_created) - epoch_us(si_modified) > 3600000000)::BIGINT AS si_after_change FROM ({records_})"""


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("count"), severity.worst(F.col("severity")).alias("severity"))


ORDER = ("record_number", "rule_no", "path")


def shown(found: DataFrame, scan_cap: int | None = None, limit: int = SHOWN) -> DataFrame:
    """The worst findings first, by record; optionally only of the first `scan_cap` ones."""
    if scan_cap is not None:
        found = found.orderBy(*ORDER).limit(scan_cap)
    return found.orderBy(severity.rank(F.col("severity")).desc(), *ORDER).limit(limit)


def techniques(found: DataFrame) -> DataFrame:
    """One row a technique: worst severity, and the first evidences, worst first."""
    rank = severity.rank(F.col("severity"))
    w = Window.partitionBy("technique_id").orderBy(rank.desc(), *ORDER)
    line = F.concat(F.lit("#"), F.col("record_number").cast("string"), F.lit(": "), truncate(F.col("path"), 150))
    first = found.select("technique_id", F.row_number().over(w).alias("nth"), line.alias("e")).where(F.col("nth") <= EVIDENCES)
    evidence = first.groupBy("technique_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "e"))), lambda x: x["e"]), " | ").alias("evidence"))
    per = found.groupBy("technique_id").agg(F.count("*").alias("findings"), severity.worst(F.col("severity")).alias("severity"))
    name = lambda k: reduce(lambda acc, x: F.when(F.col("technique_id") == x[0], x[1][k]).otherwise(acc), rules.TECHNIQUES.items(), F.lit(None).cast("string"))
    return per.join(evidence, "technique_id").select("technique_id", name(0).alias("technique"), name(1).alias("tactic_id"), "severity", "findings", "evidence")


def techniques_sql(found: str) -> str:
    order = f"{severity.rank_sql('severity')} DESC, record_number, rule_no, path"
    case = lambda k: "CASE technique_id " + " ".join(f"WHEN '{t}' THEN {quoted(v[k])}" for t, v in rules.TECHNIQUES.items()) + " END"
    return f"""SELECT technique_id, {case(0)} AS technique, {case(1)} AS tactic_id, {severity.worst_sql('severity')} AS severity, count(*)::BIGINT AS findings,
      string_agg(CASE WHEN nth <= {EVIDENCES} THEN '#' || record_number || ': ' || {truncate_sql('path', 150)} END, ' | ' ORDER BY nth) AS evidence
      FROM (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY {order}) AS nth FROM ({found})) GROUP BY technique_id"""


def iocs(found: DataFrame) -> DataFrame:
    """Paths of severe findings as indicators: the worst finding gives the spelling and severity."""
    bad = found.where(severity.rank(F.col("severity")) >= severity.RANK["high"])
    order = F.struct(-severity.rank(F.col("severity")), "record_number", "rule_no", "path")
    out = bad.groupBy(F.lower("path").alias("key")).agg(F.count("*").alias("count"), F.min_by("path", order).alias("value"), F.min_by("severity", order).alias("severity"), F.min_by("si_created", order).alias("first_seen"), F.min_by("file_name", order).alias("file_name"))
    return out.select("value", "count", "severity", "first_seen", F.concat(F.lit(REFERENCE_OTHER), encoded(F.col("file_name"))).alias("reference"))


def iocs_sql(found: str) -> str:
    rank = severity.rank_sql("severity")
    order = f"(-({rank}), record_number, rule_no, path)"
    return f"""SELECT value, count, severity, first_seen, '{REFERENCE_OTHER}' || {encoded_sql('file_name')} AS reference FROM (
      SELECT count(*)::BIGINT AS count, arg_min(path, {order}) AS value, arg_min(severity, {order}) AS severity, arg_min_null(si_created, {order}) AS first_seen, arg_min(file_name, {order}) AS file_name FROM ({found}) WHERE {rank} >= {severity.RANK['high']} GROUP BY lower(path))"""


def timeline(found: DataFrame, limit: int = DATED) -> DataFrame:
    """The earliest dated findings."""
    first = found.where("si_created is not null").orderBy("si_created", *ORDER).limit(limit)
    place = F.row_number().over(Window.orderBy("si_created", *ORDER))  # `limit` rows
    return first.select(place.alias("place"), "si_created", "file_name", "category", "severity", "confidence", truncate(F.col("path"), 160).alias("path"))


def search(found: DataFrame, words: str, severity_: str | None = None) -> DataFrame:
    """Findings whose path, category or name holds words, case ignored; optionally of one severity; the worst first."""
    text = F.lower(F.concat_ws(" ", "path", "category", "file_name"))
    rows = found.where(F.contains(text, F.lower(F.lit(words))))
    rows = rows if severity_ is None else rows.where(F.col("severity") == severity_)
    return rows.orderBy(severity.rank(F.col("severity")).desc(), *ORDER)


def search_sql(found: str, words: str) -> str:
    return f"SELECT * FROM ({found}) WHERE contains(lower(concat_ws(' ', path, category, file_name)), lower({quoted(words)}))"
