"""Files to lines or rows of cells.

Text is read by Spark's text source and numbered within each file without gathering it. Lines of files
that are no UTF-8 are decoded in tasks, by the encoding that fits their file best. Files in UTF-16 are cut
into blocks as others are, at line ends of two bytes. A spreadsheet is a task's work; its rows are handed
on as they are parsed.
"""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.mft import is_mft_table
from tracelake.operators.parse import split_csv
from tracelake.session import ship

SHEETS, TABLES = ("xlsx", "xlsm", "xls"), ("csv", "tsv")
#: Encodings tried if a text is no UTF-8.
FALLBACKS = ("euc-kr", "cp949")


def extension(name: Column) -> Column:
    """What follows the last dot of a name, in lower case."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def kind(path: str) -> str:
    """sheet, table or text, by file name."""
    ext = path.lower().rpartition(".")[2]
    return "sheet" if ext in SHEETS else "table" if ext in TABLES else "text"


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_number, value) of text files, the value's bytes as they are.

    A line's number is its place in its block of the file plus the lines of the blocks before:
    one count a block, no sort of lines.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_number"), "value")


def _bare(value: Column) -> Column:
    """A line without the sign that ends it and the mark that a file's first one may start with."""
    line = F.regexp_replace(value, r"\r\z", "")
    return F.when(F.col("line_number") == 1, F.regexp_replace(line, "^﻿", "")).otherwise(line)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_number, line) of text files in UTF-8; every physical line counts, blank ones too."""
    return _numbered(spark, path).select("file", "line_number", _bare(F.col("value")).alias("line"))


def _tried(value: Column) -> Column:
    """array<struct(bad int, line string)>: a line's bytes read as UTF-8 and as each fallback, and how many characters are lost."""
    ship()

    @F.arrow_udf("array<struct<bad:int,line:string>>")
    def tried(rows: pa.Array) -> pa.Array:
        out = []
        for x in rows:
            texts = [(x.as_py() or b"").decode(name, "replace") for name in ("utf-8", *FALLBACKS)]
            out.append([{"bad": t.count("\ufffd"), "line": t} for t in texts])
        return pa.array(out, pa.list_(pa.struct([("bad", pa.int32()), ("line", pa.string())])))

    return tried(value.cast("binary"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of text files in UTF-8, UTF-16 with a mark, or a fallback encoding.

    A file that holds invalid UTF-8 is read by the fallback that loses least, all its lines alike; no
    other file is decoded in Python.
    """
    rows = _numbered(spark, path)
    start = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    wide = F.max(F.when((F.col("line_number") == 1) & start.isin(*WIDE), start))
    odd = rows.groupBy("file").agg((~F.bool_and(F.is_valid_utf8("value"))).alias("bad"), wide.alias("wide")).where("bad or wide is not null").collect()  # a row for each such file
    plain = rows.join(F.broadcast(spark.createDataFrame([(r["file"],) for r in odd], "file string")), "file", "left_anti") if odd else rows
    parts = [plain.select("file", "line_number", _bare(F.col("value")).alias("line"))]
    for mark, encoding in WIDE.items():
        if names := [r["file"] for r in odd if r["wide"] == mark]:
            parts.append(read_wide(spark, names, encoding))
    if names := [r["file"] for r in odd if not r["wide"]]:
        tried = _numbered(spark, names).select("file", "line_number", _tried(F.col("value")).alias("tried"))
        bad = [F.sum(F.col("tried")[k]["bad"]) for k in range(1 + len(FALLBACKS))]
        best = F.lit(0)
        for k in range(1, len(bad)):  # the first fallback that loses fewer characters than UTF-8
            best = F.when((best == 0) & (bad[k] < bad[0]), k).otherwise(best)
        chosen = tried.groupBy("file").agg(best.alias("k"))
        parts.append(tried.join(chosen, "file").select("file", "line_number", _bare(F.get("tried", F.col("k"))["line"]).alias("line")))
    return reduce(DataFrame.unionByName, parts)


#: The encodings of two bytes, by the mark at a file's start.
WIDE = {"FFFE": "utf-16-le", "FEFF": "utf-16-be"}


def read_wide(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(file, line_number, line) of text files in an encoding of two bytes.

    Blocks are cut where the two bytes of a line end stand, wherever that is: bytes of two neighbouring
    characters may look the same, and then a piece of an odd number of bytes comes out. A piece goes on from
    the one before it if the pieces of odd length before it, in its block and in those before, are odd in number.
    """
    ship(spark)
    end = "\n".encode(encoding)
    raw = spark.read.option("encoding", encoding.upper().replace("-LE", "LE").replace("-BE", "BE")).option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("at"))
    within = Window.partitionBy("file", "block").orderBy("at")
    odd = F.length("value") % 2
    rows = raw.withColumn("flips", F.sum(odd).over(within) - odd)
    blocks = rows.groupBy("file", "block").agg(F.sum(odd).alias("odd"), *[F.count_if(F.col("flips") % 2 == k).alias(f"n{k}") for k in (0, 1)])
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.withColumn("turned", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2)
    blocks = blocks.withColumn("starts", F.when(F.col("turned") == 0, F.col("n0")).otherwise(F.col("n1")))
    blocks = blocks.select("file", "block", "turned", F.coalesce(F.sum("starts").over(w), F.lit(0)).alias("before"))
    placed = rows.join(blocks, ["file", "block"]).withColumn("goes_on", (F.col("flips") + F.col("turned")) % 2)
    placed = placed.withColumn("line_number", F.col("before") + F.sum(1 - F.col("goes_on")).over(within))
    broken = placed.where("goes_on = 1").select("file", "line_number").distinct()
    whole = placed.join(broken, ["file", "line_number"], "left_anti").select("file", "line_number", "value")
    pieces = placed.join(broken, ["file", "line_number"]).groupBy("file", "line_number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("pieces"))  # those of one line
    mended = F.aggregate(F.slice("pieces", 2, 1 << 30), F.get("pieces", F.lit(0))["value"], lambda acc, x: F.concat(acc, F.lit(end), x["value"]))

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([x.as_py().decode(encoding, "replace") for x in values], pa.string())

    both = whole.unionByName(pieces.select("file", "line_number", mended.alias("value")))
    return both.select("file", "line_number", _bare(decode("value")).alias("line"))


def decode_bytes(raw: bytes) -> str:
    """Text of bytes: by their mark, else UTF-8, else the fallback with fewer replacement characters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    text = raw.decode("utf-8", "replace")
    bad = text.count("�")
    if bad:
        for name in FALLBACKS:
            other = raw.decode(name, "replace")
            if other.count("�") < bad:
                return other
    return text


def decoded(content: Column) -> Column:
    """Text of a binary column."""
    ship()

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else decode_bytes(x.as_py()) for x in rows], pa.string())

    return decode(content)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of text files in any of the encodings, each read whole."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))
    return files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_number"), "line")


def delimiter(header: str) -> str:
    """A tab if a header has more of them than commas."""
    return "\t" if header.count("\t") > header.count(",") else ","


def table_rows(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(row_number, cells) of the non-empty lines of a table; the header is row 0 if it is line 1."""
    return lines.where(F.col("line") != "").select((F.col("line_number") - 1).alias("row_number"), split_csv(F.col("line"), separator).alias("cells"))


def to_csv(cells: Column) -> Column:
    """A row of cells as a CSV line; cells with a comma, a quote or a line feed are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, quoted), ",")


def _column(ref: str) -> int:
    n = 0
    for c in ref.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they are read; each is let go before the next one comes, and so is all beside them."""
    open_: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            open_.append(element)
            continue
        open_.pop()
        if _local(element.tag) == name:
            yield element
        if not any(_local(x.tag) == name for x in open_):
            element.clear()
            if open_:
                open_[-1].remove(element)


def _said(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t")


class Strings:
    """The shared strings of a workbook, one after another in one buffer, found by their offsets."""

    def __init__(self, stream=None):
        self.held, self.ends = bytearray(), array("q", [0])
        for element in _elements(stream, "si") if stream else ():
            self.held += _said(element).encode("utf-8", "surrogatepass")
            self.ends.append(len(self.held))

    def __getitem__(self, k: int) -> str:
        return self.held[self.ends[k] : self.ends[k + 1]].decode("utf-8", "surrogatepass") if 0 <= k < len(self.ends) - 1 else ""


def sheet_rows(content: bytes, most: int | None = None) -> Iterator[list[str]]:
    """Rows of the first sheet of a workbook, one at a time; optionally only the first `most`.

    The sheet is unpacked and parsed as its rows are asked for, so a task holds the packed file, the
    shared strings and one row. A file that is no zipped workbook (a binary one of old, say) has none
    that can be read, and says so.
    """
    if not zipfile.is_zipfile(io.BytesIO(content)):
        raise ValueError("not an XML workbook: save it as .xlsx")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = Strings(z.open("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else Strings()
        # By number, so that sheet2 comes before sheet10.
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for k, row in enumerate(_elements(z.open(sheets[0]), "row") if sheets else ()):
            if most is not None and k >= most:
                return
            cells: list[str] = []
            for cell in row:
                if _local(cell.tag) != "c":
                    continue
                at = re.match("[A-Za-z]+", cell.get("r", ""))
                value = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
                if cell.get("t") == "s":
                    value = shared[int(value)] if value.strip().isdigit() else ""
                elif cell.get("t") == "inlineStr":
                    value = _said(cell)
                place = _column(at[0]) if at else len(cells)
                cells += [""] * (place + 1 - len(cells))
                cells[place] = value
            yield cells


def _sheets(most: int | None):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                n, held = 0, []
                for cells in sheet_rows(content.as_py(), most):
                    held.append(cells)
                    if len(held) == 1000:
                        yield _batch(path.as_py(), n, held)
                        n, held = n + len(held), []
                if held:
                    yield _batch(path.as_py(), n, held)

    return run


def _batch(path: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["file", "row_number", "cells"])


def read_sheets(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, row_number, cells) of workbooks, all rows or the first `most` of each; the header is row 0."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_sheets(most), "file string, row_number long, cells array<string>")


def ingest(spark: SparkSession, path: str, most: int | None = None) -> tuple[str, DataFrame, list[str]]:
    """What a file is: ("mft" or "table", rows without header, header), or ("log", lines, []).

    Rows of a table whose header is not that of file records are a log again; a workbook's are
    turned into CSV lines and then read as any other text. `most` limits a workbook's rows.
    """
    how = kind(path)
    if how == "text":
        return "log", read_text(spark, path), []
    if how == "sheet":
        rows = read_sheets(spark, path, most)
    else:
        lines = read_text(spark, path)
        head = lines.where("line_number = 1").select("line").first()
        rows = table_rows(lines, delimiter(head[0] if head else ""))
    top = rows.where("row_number = 0").select("cells").first()
    header = top[0] if top else []
    if is_mft_table(header):
        return "mft", rows.where("row_number > 0"), header
    if how == "sheet":
        return "log", rows.select("file", (F.col("row_number") + 1).alias("line_number"), to_csv(F.col("cells")).alias("line")), []
    if path.lower().endswith(".csv"):
        return "table", lines.where("line_number > 1"), header
    return "log", lines, []
