"""Comma- and tab-separated files, read in splits: one large file is many tasks.

Spark's text source cuts files at line feeds, wherever they are stored. What a line means depends on whether a quote is open where it begins, and so on all
lines before it. That is settled in two passes:

1.  Each split is walked from both states, quote closed and quote open. It maps a state at its begin to one at its end, and to a number of records that begin in it: a row.
2.  Within a file these rows are chained, in order: each split gets its state and its first record's number. (A file has a row for each of its splits, some
    128 MB of text.)
3.  Splits are read again and parsed from their states by the ``csv`` module, line by line. A record that crosses a border
    is passed on in parts, and put together by its number.

The rows are those of ``csv.reader`` over the whole file: quotes count at a field's begin alone, two quotes in a quoted field are one, text after a closing
quote belongs to the field, a carriage return ends a line, and a quote that is never closed takes the rest of the file. A task holds a batch of lines and one record. A file
with bytes that aren't UTF-8 gives no rows and a message.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.store import stored

_SPLIT = "path string, begin bigint, lines bigint, bytes bigint, size bigint, bad boolean, open_after_closed boolean, open_after_open boolean, records_closed bigint, records_open bigint"
_STARTS = "path string, begin bigint, open boolean, first bigint, unended boolean, message string"
_ROW = "path string, row_i bigint, cells array<string>, part bigint, text string"
LONGEST_FIELD = (1 << 31) - 1


def delimiter_of(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def pieces(line: str) -> list[str]:
    """A line without its line feed, cut after carriage returns inside it."""
    return re.findall("[^\r]*\r|[^\r]+", line) if "\r" in line[:-1] else [line]


def open_at_end(line: str, quoted: bool, delimiter: str) -> bool:
    """Whether a quote is open where a line ends, if one is (or none is) where it begins."""
    if '"' not in line:
        return quoted
    at = 0
    while True:
        if not quoted:
            if line[at : at + 1] != '"':
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        end = line.find('"', at)
        while end >= 0 and line[end + 1 : end + 2] == '"':
            end = line.find('"', end + 2)
        if end < 0:
            return True
        quoted = False
        at = line.find(delimiter, end + 1) + 1
        if not at:
            return False


def _walk(line: str, quoted: bool, delimiter: str) -> tuple[bool, int]:
    """(state after a line, records that begin in it)."""
    begun = 0
    for piece in pieces(line):
        begun += not quoted
        quoted = open_at_end(piece, quoted, delimiter)
    return quoted, begun


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each split of the batches, which come in the order of the files."""
    columns = [f.split()[0] for f in _SPLIT.split(", ")]
    now, row, lines = None, [], 0
    for batch in batches:
        for path, begin, size, raw in zip(batch["path"], batch["begin"], batch["size"], batch["value"], strict=True):
            if (path, begin) != now:
                if now:
                    yield pd.DataFrame([row], columns=columns)
                now, row = (path, begin), [path, begin, 0, 0, size, False, False, True, 0, 0]
                delimiter = delimiter_of(path)
            row[2] += 1
            row[3] += len(raw) + 1
            try:
                line = bytes(raw).decode()
            except UnicodeDecodeError:
                row[5] = True
                continue
            if '"' not in line and "\r" not in line[:-1]:
                row[8] += not row[6]
                row[9] += not row[7]
                continue
            for state, count in ((6, 8), (7, 9)):
                row[state], begun = _walk(line, row[state], delimiter)
                row[count] += begun
    if now:
        yield pd.DataFrame([row], columns=columns)


def _chained(splits: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file in order: the state and the number of the first record of each."""
    splits = splits.sort_values("begin")
    first, quoted, out = 0, False, []
    message = "UnicodeDecodeError: bytes that aren't UTF-8" if splits["bad"].any() else None
    # The source drops a byte order mark (3 bytes), and a line feed after the last line or not.
    unended = int(splits["bytes"].sum() - splits["size"].iloc[0]) in (1, -2)
    for r in splits.itertuples():
        out.append((r.path, r.begin, quoted, first, unended, message))
        first += r.records_open if quoted else r.records_closed
        quoted = r.open_after_open if quoted else r.open_after_closed
    return pd.DataFrame(out, columns=[f.split()[0] for f in _STARTS.split(", ")])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records, and parts of those that cross a border of the split."""
    csv.field_size_limit(LONGEST_FIELD)
    columns = [f.split()[0] for f in _ROW.split(", ")]
    now, quoted, number, held, crossing, delimiter = None, False, 0, [], False, ","
    out: list[tuple] = []

    def ended(whole: bool) -> None:
        text = "".join(held)
        held.clear()
        if crossing or not whole:
            out.append((now[0], number, None, now[1], text))
        else:
            out.append((now[0], number, next(csv.reader([text] if "\r" not in text and text.count("\n") == 1 else io.StringIO(text, newline=""), delimiter=delimiter), []), None, None))

    for batch in batches:
        for path, begin, start, first, raw in zip(batch["path"], batch["begin"], batch["open"], batch["first"], batch["value"], strict=True):
            if (path, begin) != now:
                if held:
                    ended(False)
                now, quoted, delimiter = (path, begin), bool(start), delimiter_of(path)
                crossing, number = quoted, first - 1
            parts = pieces(bytes(raw).decode())
            parts[-1] += "\n"
            for piece in parts:
                if not quoted:
                    number += 1
                    crossing = False
                held.append(piece)
                quoted = open_at_end(piece[:-1], quoted, delimiter)
                if not quoted:
                    ended(True)
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if held:
        ended(False)
    if out:
        yield pd.DataFrame(out, columns=columns)


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records from their parts. The last line feed isn't the file's own where its last line has no end."""
    csv.field_size_limit(LONGEST_FIELD)
    for batch in batches:
        rows = []
        for path, number, parts, unended in zip(batch["path"], batch["row_i"], batch["parts"], batch["unended"], strict=True):
            text = "".join(parts)
            if unended and text.endswith("\n"):
                text = text[:-1]
            rows.append((path, number, next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(path)), [])))
        yield pd.DataFrame(rows, columns=["path", "row_i", "cells"])


def read_splits(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (path, row_i, cells), files that can't be read (path, message)).

    lines: (path, begin, size, value binary), as the text source gives them: ``begin`` tells a file's splits apart and orders them.
    """
    starts = stored(lines.mapInPandas(_walked, _SPLIT).groupBy("path").applyInPandas(_chained, _STARTS), "splits")
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    placed = numbered.join(starts.where("message is null"), ["path", "begin"]).sortWithinPartitions("path", "begin", "at")
    parsed = stored(placed.select("path", "begin", "open", "first", "value").mapInPandas(_parsed, _ROW), "records")
    parts = parsed.where("cells is null").groupBy("path", "row_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]).alias("parts"))
    ends = starts.groupBy("path").agg(F.max("unended").alias("unended"))
    crossing = parts.join(ends, "path").mapInPandas(_together, "path string, row_i bigint, cells array<string>")
    return parsed.where("cells is not null").select("path", "row_i", "cells").unionByName(crossing), starts.where("message is not null").select("path", "message").distinct()


def read_delimited(spark: SparkSession, root: str, pattern: str = "*.{csv,tsv,CSV,TSV}", only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of all such files below a folder; only: (path) of those that are asked for."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    # The metadata's paths are encoded as in an address; those of other sources aren't.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = lines.select(path.alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    return read_splits(lines if only is None else lines.join(only.select("path"), "path", "left_semi"))
