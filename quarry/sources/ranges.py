"""Text files as byte ranges (S6): one file of any size is read by many tasks.

A file is dealt out as ``(path, offset, length)`` ranges.  A range owns the characters whose first byte lies in it, so
the texts of a file's ranges are the file's text, whatever the ranges are.  Every row also has the
characters before and after its text, for matches over a seam and the letters' neighbours.

``text_ranges(listing)`` is the form of the folder jobs: ranges come from an explode over the listing, so their number is no
matter of the driver.  ``TextRanges`` is the same as a data source: ``spark.read.format("text_ranges")``.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources.files import children, file_system, qualified

RANGE_BYTES = 128 << 20   # of a file for one task
PIECE_BYTES = 8 << 20     # of a range that are held at once
CONTEXT = 64              # characters before and after a text, unless the caller asks for more

SCHEMA = "path string, offset long, length long, pre string, text string, post string, error string"


def _char_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character can begin: past the rest of one that began before.

    After three continuation bytes any further one belongs to no character and is dropped on either side.
    """
    end = min(at + 3, len(data))
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def read_piece(stream, size: int, offset: int, length: int, context: int) -> tuple[str, str, str]:
    """``(before, text, after)`` of the bytes ``offset`` to ``offset + length`` of a seekable stream of ``size`` bytes.

    UTF-8 with bad bytes dropped, as if the whole file were decoded.  At least ``context`` characters are given
    before and after where the file has them.
    """
    reach = 4 * (context + 1)
    while True:
        first, last = max(0, offset - reach), min(size, offset + length + reach)
        stream.seek(first)
        data = stream.read(last - first)
        a, b = _char_start(data, offset - first), _char_start(data, min(offset + length, size) - first)
        before = data[_char_start(data, 0) if first else 0:a].decode("utf-8", errors="ignore")
        after = data[b:].decode("utf-8", errors="ignore")
        enough = (len(before) >= context or not first) and (len(after) >= context or last == size)
        if enough or reach > 1 << 24:
            return before[-context:] if context else "", data[a:b].decode("utf-8", errors="ignore"), after[:context]
        reach *= 8                                         # bad bytes were dropped: look further


def pieces(path: str, size: int, offset: int, length: int, context: int) -> Iterator[tuple]:
    """The rows of a range, ``PIECE_BYTES`` at a time; a file that can't be read is one row with its error."""
    try:
        system, where = file_system(path)
        with system.open_input_file(where) as stream:
            end = min(offset + length, size)
            for at in range(offset, max(end, offset + 1), PIECE_BYTES):
                n = min(PIECE_BYTES, end - at)
                pre, text, post = read_piece(stream, size, at, n, context)
                yield path, at, n, pre, text, post, ""
    except Exception as e:
        yield path, offset, length, "", None, "", f"{type(e).__name__}: {e}"


def file_head(path: str, n: int = 4096) -> bytes:
    system, where = file_system(path)
    with system.open_input_stream(where) as stream:
        return stream.read(n)


def text_ranges(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A listing's rows (``path``, ``size``) once for every range: ``offset`` and ``length`` added; an empty file has one range."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    return (listing.select("*", F.explode(starts).alias("offset"))
            .withColumn("length", F.least(F.lit(range_bytes).cast("long"), F.col("size") - F.col("offset"))))


def read_ranges(ranges: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Reads ``text_ranges``: one row for each piece of up to ``PIECE_BYTES``; every other column is kept.

    Ranges are spread by (path, offset), so the ranges of one file go to many tasks.
    """
    keep = [c for c in ranges.columns if c not in ("offset", "length", "pre", "text", "post", "error")]
    fields = ", ".join(f"`{c}` {ranges.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                for _, at, n, pre, text, post, error in pieces(row["path"], int(row["size"]), int(row["offset"]), int(row["length"]), context):
                    yield pd.DataFrame([[*(row[c] for c in keep), at, n, pre, text, post, error]],
                                       columns=[*keep, "offset", "length", "pre", "text", "post", "error"])

    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ranges.select(*keep, "offset", "length").repartition(n, "path", "offset")
            .mapInPandas(run, f"{fields}, offset long, length long, pre string, text string, post string, error string"))


# ---------------------------------------------------------------- the same as a data source
class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.context = int(options.get("context", CONTEXT))
        if self.range_bytes < 1 or self.context < 0:
            raise ValueError("rangeBytes must be 1 at least, context 0 at least")

    def partitions(self):
        """Ranges dealt out so that a task has about ``rangeBytes``; small files share a task."""
        out, held, room = [], [], 0
        for path, size in sorted(self._files()):
            for at in range(0, max(size, 1), self.range_bytes):
                n = min(self.range_bytes, size - at)
                if held and room + n > self.range_bytes:
                    out.append(_Ranges(held))
                    held, room = [], 0
                held.append((path, size, at, n))
                room += n
        return [*out, _Ranges(held)] if held else out or [_Ranges([])]

    def _files(self):
        system, base = file_system(self.root)
        prefix = self.root[:len(self.root) - len(base)] if self.root.endswith(base) else ""
        info = system.get_file_info(base)
        if info.is_file:
            yield self.root, info.size
            return
        todo = [base.rstrip("/")]
        while todo:
            at = todo.pop()
            for name, folder, size, _, error in children(system, at):
                if folder:
                    todo.append(f"{at}/{name}")
                else:
                    yield f"{prefix}{at}/{name}", 0 if error else size

    def read(self, partition):
        for path, size, at, n in partition.ranges:
            yield from pieces(path, size, at, n, self.context)


class TextRanges(DataSource):
    """``spark.read.format("text_ranges").option("path", folder or file)``; options ``rangeBytes`` and ``context`` (characters).

    The ranges are planned in the driver (a hundred bytes each); for very many files use ``text_ranges`` over a listing.
    """

    @classmethod
    def name(cls):
        return "text_ranges"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def text_range_source(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, context: int = CONTEXT) -> DataFrame:
    """The rows of every file below ``root`` through the data source, which is registered first."""
    spark.dataSource.register(TextRanges)
    return (spark.read.format("text_ranges").option("path", qualified(spark, root))
            .option("rangeBytes", str(range_bytes)).option("context", str(context)).load())
