"""CSV files with line breaks inside quotes, read by many tasks.

Spark splits a file at line ends, and a line tells alone neither whether it starts a record nor how many
quotes stand before it in the file. A first pass counts the quotes of every split; their running parity
per file tells in which state each split begins. With it a second pass finds the record starts of its
split, and the few records that cross a split are put together from their parts. Spark's own CSV parser
reads the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: As written by common programs: a quote inside quotes is doubled.
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
PARTS = "file string, start long, begins boolean, ends boolean, first boolean, record string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines of the files with the split that each begins in."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "\n").text(path).select(*split, "value")


def split_states(text: DataFrame) -> dict[tuple[str, int], bool]:
    """For each split of the files whether it begins inside quotes; one entry for each planned split.

    An odd number of quotes in a file is an error.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = text.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    here = Window.partitionBy("file")
    before = here.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    unclosed = F.raise_error(F.concat(F.lit("quotes that are not closed in "), F.col("file"))).cast("boolean")
    states = found.select(
        "file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("odd").over(here) % 2 == 1).alias("open"),
    ).where(F.when(F.col("open"), unclosed).otherwise(F.lit(True)))
    return {(r["file"], r["start"]): r["inside"] for r in states.collect()}


class _Cutter:
    """Records of one split after the other, from lines in order."""

    def __init__(self, states: dict[tuple[str, int], bool]):
        self.states = states
        self.key: tuple[str, int] | None = None
        self.waiting: list[str] = []  # lines whose record may go on
        self.inside = self.begins = self.first = False

    def open_split(self, key: tuple[str, int]) -> None:
        if key not in self.states:
            raise ValueError(f"{key[0]} was split in another way by the first pass; read it again")
        self.key, self.inside, self.waiting = key, self.states[key], []
        self.begins, self.first = not self.inside, key[1] == 0

    def close_split(self) -> pa.RecordBatch | None:
        if self.key is None or not self.waiting:
            return None
        return self.batch(pa.array([]), ["\n".join(self.waiting)], ends=not self.inside)

    def batch(self, records: pa.Array, front: list[str], ends: bool = True) -> pa.RecordBatch:
        """Rows of the part in ``front`` (none or one) and of the whole records behind it."""
        n = len(front) + len(records)
        begins, first = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
        closed = np.ones(n, dtype=bool)
        if front:
            begins[0], closed[0] = self.begins, ends
            self.begins = True
        if n and self.first and begins[0]:
            first[0], self.first = True, False
        return pa.RecordBatch.from_arrays(
            [pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()), pa.array(begins),
             pa.array(closed), pa.array(first), pa.concat_arrays([pa.array(front, pa.string()), records.cast(pa.string())])],
            names=["file", "start", "begins", "ends", "first", "record"],
        )

    def cut(self, text: pa.Array) -> pa.RecordBatch | None:
        """Records that are known to be whole once these lines of the split are read."""
        odd = pc.count_substring(text, '"').to_numpy(zero_copy_only=False) % 2
        state = (int(self.inside) + np.cumsum(odd)) % 2
        starts = np.flatnonzero((state - odd) % 2 == 0)
        self.inside = bool(state[-1])
        if not len(starts):
            self.waiting += text.to_pylist()
            return None
        self.waiting += text.slice(0, starts[0]).to_pylist()
        offsets = pa.array(starts, pa.int32())
        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, text), "\n") if len(starts) > 1 else pa.array([])
        out = self.batch(whole, ["\n".join(self.waiting)] if self.waiting else [])
        self.begins, self.waiting = True, text.slice(starts[-1]).to_pylist()
        return out


def _cut_lines(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(sent.value)
        for batch in batches:
            file, start = (batch.column(c).dictionary_encode() for c in ("file", "start"))
            number = file.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(start.dictionary) + 1)
            number += start.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:]):
                key = (batch.column("file")[a].as_py(), batch.column("start")[a].as_py())
                if key != cutter.key:
                    yield from filter(None, [cutter.close_split()])
                    cutter.open_split(key)
                yield from filter(None, [cutter.cut(batch.column("value").slice(a, b - a))])
        yield from filter(None, [cutter.close_split()])

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): the records of the files as text; ``first`` marks the first one of a file.

    The states of the splits go to the tasks: one entry for each split that the driver plans itself.
    Only parts of records that cross a split are shuffled. Line breaks inside quotes stay as they are.
    """
    text = lines(spark, path)
    sent = spark.sparkContext.broadcast(split_states(text))
    parts = text.mapInArrow(_cut_lines(sent), PARTS)
    in_file = Window.partitionBy("file").orderBy("start", "begins")
    crossing = parts.where("not (begins and ends)").withColumn("nth", F.sum(F.col("begins").cast("int")).over(in_file))
    pieces = F.sort_array(F.collect_list(F.struct("start", "begins", "record")))
    joined = crossing.groupBy("file", "nth").agg(
        F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"), F.max("first").alias("first")
    )
    found = parts.where("begins and ends").select("record", "first").unionByName(joined.select("record", "first"))
    return found.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text; every file starts with the header.

    Equal to Spark's ``multiLine`` reader up to the order of rows, for lines that end in LF or CRLF and
    quotes as described in the module; files of any size are read by as many tasks as they have splits.
    """
    head = spark.read.options(header=True, inferSchema=False, **OPTIONS).csv(path)
    rows = records(spark, path).where(~F.col("first") & (F.col("record") != ""))
    columns = ", ".join(f"`{c.replace('`', '``')}` string" for c in head.columns)
    return rows.select(F.from_csv("record", columns, OPTIONS).alias("row")).select("row.*")
