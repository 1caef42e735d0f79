"""Records of large CSV files whose quoted cells may hold line breaks, read by many tasks.

Files are read as lines, block by block. Whether a line begins inside a quoted cell depends on all
lines before it; but a line, and so a block, only maps the two possible states before it (outside,
inside) to the states after it. The maps of the blocks, with the records that begin in each under
either state, are one row per block: their prefix gives the state and the record number at which
every block begins. A second pass over the same lines joins continued lines. Only records cut by
the border of a block are shuffled.

Lines end with \\n or \\r\\n. A quote opens a cell only where the cell begins. Empty lines outside
cells are no records. A quote that is never closed runs to the end of its file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wattlink.session import durable, ship

BOM = "﻿"
_INSIDE = re.compile(r'(?:[^"]+|"")*+')
_OPENING = {True: re.compile(r'[ \t]*"'), False: re.compile('"')}


def inside_after(line: str, inside: bool, trimmed: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or not, ends inside one."""
    at = 0
    while True:
        if not inside:
            opening = _OPENING[trimmed].match(line, at)
            inside, at = bool(opening), opening.end() if opening else at
        if inside:
            at = _INSIDE.match(line, at).end()
            if at == len(line):
                return True
            inside, at = False, at + 1
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


class _Block:
    """Lines of one block, batch by batch, for one state at its beginning."""

    def __init__(self, inside: bool, trimmed: bool):
        self.inside, self.trimmed = inside, trimmed

    def states(self, lines: list, quoted: np.ndarray) -> np.ndarray:
        """Whether each line begins inside a cell."""
        out = np.empty(len(lines), bool)
        last = 0
        for k in quoted:
            out[last:k + 1] = self.inside
            self.inside, last = inside_after(lines[k], self.inside, self.trimmed), k + 1
        out[last:] = self.inside
        return out


def _runs(batches: Iterator[pa.RecordBatch]):
    """(new block?, file, block, lines, places of lines with a quote, line not blank?) of every run of lines of one block."""
    current = None
    for b in batches:
        files, blocks = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        keys = list(zip(files, blocks.tolist()))
        begin = 0
        while begin < len(keys):
            end = begin + 1
            while end < len(keys) and keys[end] == keys[begin]:
                end += 1
            text = b.column(2).slice(begin, end - begin)
            quoted = np.flatnonzero(pc.match_substring(text, '"').to_numpy(zero_copy_only=False))
            lines = text.to_pylist()
            if keys[begin][1] == 0 and keys[begin] != current:
                lines[0] = lines[0].lstrip(BOM)
            filled = np.fromiter((line not in ("", "\r") for line in lines), bool, len(lines))
            yield keys[begin] != current, *keys[begin], lines, quoted, filled
            current = keys[begin]
            begin = end


def _summary(trimmed: bool):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("after_outside", pa.bool_()), ("after_inside", pa.bool_()),
                        ("from_outside", pa.int64()), ("from_inside", pa.int64()), ("first", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pair, counts, first, ended = None, None, None, [], False

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (
                *key, pair[0].inside, pair[1].inside, *counts, "\n".join(first) if key[1] == 0 else None)))], schema)

        for new, file, block, lines, quoted, filled in _runs(batches):
            if new:
                if key:
                    yield row()
                key, pair, counts, first, ended = (file, block), (_Block(False, trimmed), _Block(True, trimmed)), [0, 0], [], False
            for k in (0, 1):
                begins = ~pair[k].states(lines, quoted) & filled
                counts[k] += int(begins.sum())
                if k == 0 and block == 0 and not ended:  # the first record of the file, which is its header
                    at = np.flatnonzero(begins)
                    start = 0 if first else (at[0] if len(at) else len(lines))
                    stop = at[at > start] if not first else at
                    first += lines[start:stop[0] if len(stop) else len(lines)]
                    ended = len(stop) > 0
        if key:
            yield row()

    return run, "file string, block long, after_outside boolean, after_inside boolean, from_outside long, from_inside long, first string"


def _assembled(carried, trimmed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, key, state, cut = [], 0, None, None, False

        def out(numbers, texts, cuts):
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(numbers, pa.int64()),
                 pa.array(texts, pa.string()), pa.array(cuts, pa.bool_())], ["file", "block", "record", "text", "cut"])

        for new, file, block, lines, quoted, filled in _runs(batches):
            if new:
                if held:
                    yield out([number], ["\n".join(held)], [cut or state.inside])
                key, held = (file, block), []
                inside, before = carried.value[key]
                # a record that began in an earlier block is the one before the next to begin
                state, number, cut = _Block(inside, trimmed), before - 1, inside
            within = state.states(lines, quoted)
            begins = np.flatnonzero(~within & filled).tolist()
            numbers, texts, cuts = [], [], []
            last = 0
            for at in [*begins, len(lines)]:
                held += [lines[k] for k in range(last, at) if filled[k] or within[k]]
                if at == len(lines):
                    break
                if held:
                    numbers.append(number)
                    texts.append("\n".join(held))
                    cuts.append(cut)
                held, last, cut, number = [lines[at]], at + 1, False, number + 1
            if numbers:
                yield out(numbers, texts, cuts)
        if held:
            yield out([number], ["\n".join(held)], [cut or state.inside])

    return run, "file string, block long, record long, text string, cut boolean"


def _names(header: str) -> list[str]:
    cells = next(csv.reader([header.rstrip("\r")]), [])
    cells = [c if c else f"_c{k}" for k, c in enumerate(cells)]
    return [f"{c}{k}" if cells.count(c) > 1 else c for k, c in enumerate(cells)]


def read_records(spark: SparkSession, path: str, strict: bool = False, trimmed: bool = False, number: str | None = None) -> DataFrame:
    """All rows of header CSV files as text columns named by the header of the first file by path.

    `strict`: a row with too few or too many cells, or a quote that is never closed, fails the read;
    otherwise cells are filled with null or dropped. `trimmed`: blanks around cells are dropped.
    `number`: a column that numbers the rows from 1, files in order of their paths. The lines are
    checkpointed once, so that both passes see the same blocks; one row per block goes through the driver.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = durable(lines)
    carried, names, inside, before, at, file = {}, None, False, 0, 0, None
    # one row per block
    for row in lines.mapInArrow(*_summary(trimmed)).orderBy("file", "block").collect():
        if row["file"] != file:
            if inside and strict:
                raise ValueError(f"a quote is never closed in {file}")
            file, inside, before = row["file"], False, before + at - (1 if at else 0)
            at = 0
            if names is None and row["first"]:
                names = _names(row["first"])
        # records of a file are numbered from 0, its header; `before` rows stand in earlier files
        carried[row["file"], row["block"]] = (inside, before + at)
        at += row["from_inside" if inside else "from_outside"]
        inside = row["after_inside" if inside else "after_outside"]
    if inside and strict:
        raise ValueError(f"a quote is never closed in {file}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names or []])
    if not names:
        return spark.createDataFrame([], schema.add(number, T.LongType()) if number else schema)
    first = {}
    for (name, block), (_, start) in carried.items():
        first[name] = min(first.get(name, start), start)
    shared = spark.sparkContext.broadcast(carried)
    records = lines.mapInArrow(*_assembled(shared, trimmed))
    # a record cut by block borders: few rows, at most two a block
    joined = records.where("cut").groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    records = records.where("NOT cut").select("file", "record", "text").unionByName(joined)
    heads = spark.createDataFrame(list(first.items()), "file string, head long")  # one row per file
    records = records.join(F.broadcast(heads), "file").where("record > head")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "mode": "FAILFAST" if strict else "PERMISSIVE",
               "ignoreLeadingWhiteSpace": str(trimmed).lower(), "ignoreTrailingWhiteSpace": str(trimmed).lower()}
    cells = F.from_csv(F.regexp_replace("text", "\r$", ""), _ddl(names), options)
    kept = records.select("record", F.inline(F.array(cells)))
    # _r: its own name, since the header may hold any
    return kept.toDF("_r", *names).select(*[F.col(f"`{n}`") for n in names], *([F.col("_r").alias(number)] if number else []))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
