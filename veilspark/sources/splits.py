"""Large files read by many tasks: JSON Lines and text by their lines, CSV by a speculative scan that settles which quotes are open where a range begins.

Ranges are those of Spark's own text source, so any store that Spark reads will do. A line of a CSV file may stand inside a quoted cell that opened in another range. So each range is scanned
once for both cases: what state it ends in if it begins outside quotes, and if it begins inside. A scan over these small maps, one for each range, gives the state in which each range really
begins; then every range is parsed on its own, and the few records that cross a border are put together from their pieces. No file has to fit in one task, nor does a record's place in its
range matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import csvsource, leaves
from .scratch import Scratch

_PLACE = ("path", "block")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value) of the lines of files: ``block`` is where the line's range begins in its file, ``at`` ascends within a range. Only a line feed ends a line."""
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))


def json_lines(spark: SparkSession, path: str, nested: bool = True) -> DataFrame:
    """Leaves of JSON Lines, each line a document of its own: doc_id is the path, the range and the line's number in it. A line that cannot be read is a problem of its own."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*$"))
    first = F.shiftright("at", 33)  # the task; its lines are told by the rest
    named = rows.select(F.concat_ws("#", "path", "block", F.concat_ws("-", first, F.col("at") - F.shiftleft(first, 33))).alias("doc_id"), "value", F.lit("json").alias("kind"))
    return leaves.leaves(named, text="value", kind="kind", nested=nested)


def ends_inside(line: str, inside: bool, delimiter: str, quote: str) -> bool:
    """Whether a quoted cell is open after ``line``, which begins inside one or at the beginning of a cell."""
    i, stop = 0, re.compile(f"[{re.escape(delimiter)}\r]")
    while True:
        if inside:
            j = line.find(quote, i)
            if j < 0:
                return True
            if line.startswith(quote, j + 1):
                i = j + 2
                continue
            inside, i = False, j + 1
        elif line.startswith(quote, i):
            inside, i = True, i + 1
            continue
        found = stop.search(line, i)
        if found is None:
            return False
        i = found.end()


def _by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], bool]]:
    """(place, some of its lines, whether these are the last) of each range of a partition, in order."""
    place, held = None, []
    for batch in batches:
        for p, b, value in zip(*(batch.column(c).to_pylist() for c in (*_PLACE, "value"))):
            if (p, b) != place or len(held) >= 10_000:
                if held:
                    yield place, held, (p, b) != place
                place, held = (p, b), []
            held.append(value)
    if held:
        yield place, held, True


def csv_states(rows: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """(path, block, inside) of the ranges of ``rows`` (as ``lines`` gives them): whether a quoted cell is open where a range begins."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [False, True]
        for place, some, last in _by_range(batches):
            for line in some:
                if quote in line:
                    ends = [ends_inside(line, state, delimiter, quote) for state in ends]
            if last:
                yield pa.RecordBatch.from_pylist([dict(zip(_PLACE, place)) | {"if_out": ends[0], "if_in": ends[1]}], pa.schema([("path", pa.string()), ("block", pa.int64()), ("if_out", pa.bool_()), ("if_in", pa.bool_())]))
                ends = [False, True]

    maps = rows.select(*_PLACE, "value").mapInArrow(scan, "path string, block long, if_out boolean, if_in boolean")
    # a map is constant, keeps the state or turns it over: the state is that after the last constant one, turned over as often as maps since then do so
    before = Window.partitionBy("path").orderBy("block")
    fixed = F.when(F.col("if_out") == F.col("if_in"), F.col("if_out"))
    turns = F.sum(F.when(F.col("if_out") & ~F.col("if_in"), 1).otherwise(0)).over(before)
    told = maps.withColumn("turns", turns).withColumn("fixed", F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("turns").alias("turns"))))
    last = F.last("fixed", ignorenulls=True).over(before)
    after = F.coalesce(last["state"], F.lit(False)) != (F.pmod(F.col("turns") - F.coalesce(last["turns"], F.lit(0)), F.lit(2)) == 1)
    return told.withColumn("after", after).select(*_PLACE, F.coalesce(F.lag("after").over(before), F.lit(False)).alias("inside"))


def csv_rows(spark: SparkSession, path: str, delimiter: str | None = None, quote: str | None = None) -> DataFrame:
    """(path, row, cells) of CSV files: rows are numbered in their file from 0, the header among them. The dialect of each file is the given one, or sniffed from the beginning of the first.

    Cells, doubled quotes, lines in quotes and ragged rows are as ``csvsource.parse`` has them. A file whose last quote is never closed has that record as a row of null ``cells``.
    """
    scratch = Scratch(spark)
    if delimiter is None or quote is None:
        head = "\n".join(r.value for r in lines(spark, path).where("block = 0").select("value").limit(200).collect())
        delimiter, quote = csvsource.sniff(head)
    rows = lines(spark, path)
    states = scratch.save(csv_states(rows, delimiter, quote), "states")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records as cells; the pieces at a range's ends as text: 1 goes on from the range before, 2 goes on in the next, 3 does both."""
        schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string()))])
        n, held, crossing, inside = 0, [], None, None
        for place, some, last in _by_state(batches):
            out = []
            if inside is None:
                inside = crossing = place[2]
            for line in some:
                held.append(line)
                inside = ends_inside(line, inside, delimiter, quote) if quote in line else inside
                if not inside:
                    text, held = "\n".join(held), []
                    if crossing:
                        out.append((*place[:2], -1, 1, text, None))
                        crossing = False
                    else:
                        for cells in csvsource.parse(text + "\n", delimiter, quote):
                            out.append((*place[:2], n, 0, None, cells))
                            n += 1
            if last:
                if held:
                    out.append((*place[:2], -1 if crossing else n, 3 if crossing else 2, "\n".join(held), None))
                n, held, crossing, inside = 0, [], None, None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    def _by_state(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], bool]]:
        place, held = None, []
        for batch in batches:
            for p, b, state, value in zip(*(batch.column(c).to_pylist() for c in (*_PLACE, "inside", "value"))):
                if (p, b, state) != place or len(held) >= 10_000:
                    if held:
                        yield place, held, (p, b, state) != place
                    place, held = (p, b, state), []
                held.append(value)
        if held:
            yield place, held, True

    # a row for each range of 4 MB and more: this keeps the order of lines, which a shuffle would not
    known = rows.join(F.broadcast(states), [*_PLACE])
    parsed = scratch.save(known.select(*_PLACE, "inside", "value").mapInArrow(parse, "path string, block long, n long, piece int, text string, cells array<string>"), "parsed")
    whole = parsed.where("piece = 0").select(*_PLACE, "n", "cells")

    pieces = parsed.where("piece > 0")
    opened = F.sum(F.when(F.col("piece") == 2, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("block", "n"))
    told = pieces.select(*_PLACE, "n", "piece").withColumn("record", opened)  # no texts in the window
    joined = pieces.join(told.drop("piece"), [*_PLACE, "n"]).groupBy("path", "record")
    joined = joined.agg(F.array_sort(F.collect_list(F.struct("block", "n", "piece", "text"))).alias("x"))

    @F.arrow_udf("array<array<string>>")
    def cells(column: pa.Array) -> pa.Array:
        return pa.array([csvsource.parse(t + "\n", delimiter, quote) for t in column.to_pylist()], pa.list_(pa.list_(pa.string())))

    text = F.array_join(F.transform("x", lambda p: p["text"]), "\n")
    closed = F.element_at("x", -1)["piece"] == 1
    made = joined.select("path", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["n"].alias("n"), closed.alias("closed"), text.alias("text"))
    good = made.where("closed").select(*_PLACE, "n", F.posexplode(cells("text")).alias("more", "cells")).select(*_PLACE, (F.col("n") + F.col("more")).alias("n"), "cells")
    bad = made.where("not closed").select(*_PLACE, "n", F.lit(None).cast("array<string>").alias("cells"))
    every = whole.unionByName(good).unionByName(bad)
    sizes = every.groupBy(*_PLACE).agg((F.max("n") + 1).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.join(sizes.select(*_PLACE, before.alias("before")), [*_PLACE]).select("path", (F.col("before") + F.col("n")).alias("row"), "cells")


def csv_leaves(spark: SparkSession, path: str, delimiter: str | None = None, quote: str | None = None, named: bool = True) -> DataFrame:
    """Leaves of CSV files, as ``leaves.leaves`` has them; with ``named`` the first row of each file names its columns."""
    rows = csv_rows(spark, path, delimiter, quote)
    heads = rows.where("row = 0").select("path", F.col("cells").alias("heads"))
    body = rows.where("row > 0") if named else rows
    body = body.join(heads, "path", "left") if named else body.withColumn("heads", F.lit(None).cast("array<string>"))
    cell = body.select("path", (F.col("row") - int(named)).alias("row"), "heads", F.posexplode_outer("cells").alias("i", "text"))
    lost = F.col("i").isNull()
    return cell.select(
        F.col("path").alias("doc_id"),
        (F.shiftleft("row", 20) + F.coalesce("i", F.lit(0))).alias("leaf_id"),
        F.when(lost, "problem").otherwise("value").alias("kind"),
        F.concat(F.lit("["), F.col("row"), F.lit("]["), F.coalesce("i", F.lit(0)), F.lit("]")).alias("path"),
        F.coalesce(F.get("heads", F.col("i")), F.lit("")).alias("key"),
        F.lit(0).alias("start"),
        F.coalesce(F.length("text"), F.lit(0)).alias("end"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array("row").alias("record_ids"),
        F.when(lost, "unterminated quote").alias("problem"),
    )
