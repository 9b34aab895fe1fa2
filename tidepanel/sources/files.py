"""Delimited sheets of unknown encoding and shape, read file by file.

One task reads one file at a time (bytes come from Spark's ``binaryFile`` reader, so any
file system works) and emits chunks of rows. A chunk carries what later steps need to know
about its whole file: the first rows, the names, the order of day and month. So a grid is
never joined with its own head, and nothing after the scan shuffles.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.plans.session import cut_lineage
from tidepanel.sources.ingest import NA_TOKENS, TWO_WAYS, cell_date, layout_of, load_panel

HEAD_ROWS = 20        # rows looked at for the header
CHUNK_CELLS = 50_000  # cells of a chunk
MAX_BYTES = 512 << 20  # a larger file is an error, not a partial result

CHUNKS = """file string, sheet string, encoding string, n_bad long, header_row int, day_first boolean, width int,
  head array<array<string>>, names array<string>, rows array<struct<row_no: bigint, cells: array<string>, repaired: string>>"""
_ROW = pa.struct([("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("repaired", pa.string())])
_CHUNK = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("encoding", pa.string()), ("n_bad", pa.int64()), ("header_row", pa.int32()),
                    ("day_first", pa.bool_()), ("width", pa.int32()), ("head", pa.list_(pa.list_(pa.string()))), ("names", pa.list_(pa.string())),
                    ("rows", pa.list_(_ROW))])


def decoded(content: bytes) -> tuple[str, str, int]:
    """(text, encoding, undecodable characters): a byte order mark decides, else the whole file
    is UTF-8 or GB18030 (which holds cp936), else GB18030 with marks for what cannot be read."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            text = content.decode(name, "replace")
            return text, name, text.count("�")
    for name in ("utf-8", "gb18030"):
        try:
            return content.decode(name), name, 0
        except UnicodeDecodeError:
            pass
    text = content.decode("gb18030", "replace")
    return text, "gb18030", text.count("�")


def header_at(head: Sequence[Sequence[str | None]]) -> int | None:
    """The first row of names: as many cells as most rows of the head, give or take a few
    (at least half), none of them a number or a date. None if there is no such row."""
    filled = [[c for c in row if c is not None] for row in head]
    widths = Counter(len(f) for f in filled if f)
    if not widths:
        return None
    usual = max(widths, key=lambda w: (widths[w], w))
    for i, cells in enumerate(filled):
        if cells and 2 * len(cells) >= usual and not any(re.match(r"\s*[-+]?[\d.]+\s*(%|$|[-/年.]\d)", c) for c in cells):
            return i
    return None


def column_names(header: Sequence[str | None], width: int) -> list[str]:
    """``width`` names: blank or missing ones are their position, repeated ones get ``.1``, ``.2``;
    a longer header is trimmed."""
    out, seen = [], Counter()
    for i in range(width):
        name = (header[i] or "").strip() if i < len(header) else ""
        name = name or str(i)
        while seen[name]:
            seen[name] += 1
            name = f"{name}.{seen[name] - 1}"
        seen[name] += 1
        out.append(name)
    return out


def _cells(text: str, delimiter: str) -> Iterator[list[str | None]]:
    """Rows that are no blank lines; an empty cell is NULL."""
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if row:
            yield [c if c != "" else None for c in row]


def file_chunks(spark: SparkSession, path: str | Sequence[str], header: int | str | None = "infer", skip_rows: Sequence[int] = (),
                delimiter: str = ",", pattern: str = "*.csv") -> DataFrame:
    """Chunks of rows (``CHUNKS``) of all files under ``path``.

    Columns ``file`` and ``sheet`` are the partition folders of that name, else the folder and
    the name of a file. Rows are numbered from 0 without blank lines. ``header`` is a row number,
    None, or "infer" (:func:`header_at` over rows not skipped). ``rows`` holds the data rows and every row of a
    head without skipped ones and the header; ``repaired`` tells rows ``short`` or ``long`` of the file's usual width:
    short ones are filled with NULL to ``width`` (the widest row), no cell is dropped. A file without
    rows gives one chunk without rows, one of no bytes gives none. A file above ``MAX_BYTES`` is an error: read it with ``read_table``, which splits files.
    """
    folders = [path] if isinstance(path, str) else list(path)
    d = None
    for folder in folders:  # each with its own partition folders
        one = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        d = one if d is None else d.unionByName(one, allowMissingColumns=True)
    parts = F.split(F.col("path"), "/")
    own = {c: (F.coalesce(F.col(c).cast("string"), other) if c in d.columns else other).alias(c) for c, other in (
        ("file", F.element_at(parts, -2)), ("sheet", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")))}
    large = F.raise_error(F.concat(F.lit("too large for one task, use read_table: "), F.col("path")))
    content = F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(large.cast("binary"))
    skip = frozenset(skip_rows)

    def read(batches):
        day, chunk_cells, schema = re.compile(TWO_WAYS), CHUNK_CELLS, _CHUNK
        for batch in batches:
            for file, sheet, raw in zip(*(batch.column(i) for i in range(3))):
                text, encoding, n_bad = decoded(raw.as_py() or b"")
                head, widths, first_day, first_month = [], Counter(), 0, 0
                for i, row in enumerate(_cells(text, delimiter)):  # first pass: what the file is like
                    if i < HEAD_ROWS:
                        head.append(row)
                    if i not in skip:
                        widths[len(row)] += 1
                    m = day.match((row[0] or "").strip())
                    if m:
                        first_day += int(m[1]) > 12
                        first_month += int(m[2]) > 12
                if header == "infer":
                    at = header_at([[] if i in skip else row for i, row in enumerate(head)])
                else:
                    at = header
                names_row = next((row for i, row in enumerate(_cells(text, delimiter)) if i == at), []) if at is not None else []
                if names_row:
                    widths[len(names_row)] -= 1
                widths = +widths
                usual = max(widths, key=lambda w: (widths[w], w)) if widths else len(names_row)
                width = max(widths) if widths else len(names_row)
                same = {"file": file.as_py(), "sheet": sheet.as_py(), "encoding": encoding, "n_bad": n_bad, "header_row": at, "width": width,
                        "day_first": first_day > first_month, "head": head[:5], "names": column_names(names_row, width)}
                rows, sent = [], False
                for i, row in enumerate(_cells(text, delimiter)):  # second pass: the rows
                    if i == at or i in skip:
                        continue
                    n = len(row)
                    rows.append({"row_no": i, "cells": row + [None] * (width - n), "repaired": "short" if n < usual else "long" if n > usual else None})
                    if len(rows) * max(width, 1) >= chunk_cells:
                        yield pa.RecordBatch.from_pylist([{**same, "rows": rows}], schema)
                        rows, sent = [], True
                if rows or not sent:
                    yield pa.RecordBatch.from_pylist([{**same, "rows": rows}], schema)

    return d.select(own["file"], own["sheet"], content.alias("content")).mapInArrow(read, CHUNKS)


def read_files(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, header: int | str | None = "infer",
               skip_rows: Sequence[int] = (), na_tokens: Sequence[str] = NA_TOKENS, **options) -> DataFrame:
    """A table from files whose encoding, header row and column order may differ: text columns
    by name, with ``file``, ``sheet``, ``row_no``, ``encoding`` and ``repaired`` in front.

    Without ``columns`` the names of all files are collected first (a schema, one more scan).
    A file that lacks a column gives NULL; texts that mean a missing value are NULL.
    """
    chunks = file_chunks(spark, path, header, skip_rows, **options)
    if columns is None:
        found = chunks.select("file", "sheet", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
        columns = [r.name for r in found.orderBy("at", "name").collect()]
    flat = chunks.select("file", "sheet", "encoding", "names", F.explode("rows").alias("r"))
    place = {c: F.array_position("names", F.lit(c)) for c in columns}
    cell = {c: F.when(place[c] > 0, F.get("r.cells", (place[c] - 1).cast("int"))) for c in columns}
    known = lambda c: F.when(~F.trim(c).isin(list(na_tokens)), c)
    return flat.select("file", "sheet", F.col("r.row_no").alias("row_no"), "encoding", F.col("r.repaired").alias("repaired"),
                       *[known(cell[c]).alias(c) for c in columns])


def sheet_rows(chunks: DataFrame) -> DataFrame:
    """Long rows (file, sheet, layout, series, ts, raw, seq) of vendor sheets read by
    :func:`file_chunks` with ``header=None``: the same rows as ``vendor_grid_ingest`` gives,
    but layout, names and day order come with each chunk."""
    p = layout_of(lambda r, c=0: F.get(F.get("head", F.lit(r)), F.lit(c)))
    d = chunks.select("file", "sheet", "head", "day_first", p.alias("p"), F.explode("rows").alias("r"))
    d = d.filter(F.col("r.row_no") >= F.col("p.data_row"))
    pairs = F.arrays_zip(F.get("head", F.col("p.header_row")).alias("name"), F.col("r.cells").alias("cell"))
    d = d.select("file", "sheet", F.col("p.layout").alias("layout"), cell_date(F.get("r.cells", F.lit(0)), F.col("day_first")).alias("ts"),
                 F.col("r.row_no").alias("seq"), pairs.alias("pairs")).filter(F.col("ts").isNotNull())
    d = d.select("file", "sheet", "layout", "ts", "seq", F.explode(F.slice("pairs", F.lit(2), F.greatest(F.size("pairs") - 1, F.lit(0)))).alias("c"))
    return d.select("file", "sheet", "layout", F.col("c.name").alias("series"), "ts", F.col("c.cell").alias("raw"), "seq").filter(F.col("series").isNotNull())


def files_to_panel(spark: SparkSession, path: str | Sequence[str], order: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(panel, source map) from a folder of workbooks with one delimited file per sheet.

    The files are read once, into a table of long rows. A name belongs to the first source that has it: files in
    ``order`` first, then by file and sheet name.
    """
    rows = sheet_rows(file_chunks(spark, path, None, **options))
    place: Column = F.array_position(F.lit(list(order)), F.col("file")) if order else F.lit(0)
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1).cast("int").alias("place"), "file", "sheet")
    raw = cut_lineage(rows.withColumn("source_ord", rank))
    return load_panel(raw)
