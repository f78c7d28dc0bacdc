"""TextGrid files (long and short form) as interval rows: a Python data source, and parsing of whole-file text columns."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from speechloom.functions import text as T

COLUMNS = "tier_idx int, tier string, idx int, xmin double, xmax double, label string"
_VALUE = re.compile(r'"((?:[^"]|"")*)"|(?<![\w"])(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w"])')


def is_long_form(head: str) -> bool:
    return "item [" in head or "name = " in head


def parse_textgrid(text: str) -> Iterator[tuple[int, str, int, float, float, str]]:
    """(tier_idx, tier, idx, xmin, xmax, label) of interval tiers; labels keep their text with doubled quotes undone.

    Both forms hold the same values in the same order once names, signs and indices are gone, so one reading of the
    values serves both. Point tiers are passed over but count as tiers."""
    text = text.lstrip("﻿")
    if is_long_form(text[:2000]):
        text = re.sub(r"^\s*(?:item|intervals|points)\s*\[\d*\]:?\s*$|\b(?:intervals|points): size", " ", text, flags=re.M)
    values: list[str | float] = [m.group(1).replace('""', '"') if m.group(1) is not None else float(m.group(2)) for m in _VALUE.finditer(text)]
    # Header: two strings, start, end, then the number of tiers.
    at = next((i for i, v in enumerate(values) if isinstance(v, float)), len(values)) + 2
    if at >= len(values):
        return
    tiers, at = int(values[at]), at + 1
    for t in range(tiers):
        kind, name, n = str(values[at]), str(values[at + 1]), int(values[at + 4])
        at += 5
        width = 2 if kind == "TextTier" else 3
        for k in range(n):
            if width == 3:
                s, e, label = values[at : at + 3]
                yield t, name, k, float(s), float(e), str(label)
            at += width


def intervals_of_text(files: DataFrame, file_id: str = "file_id", text: str = "value") -> DataFrame:
    """Interval rows of a table of whole files, with an error column: unreadable files give one row with the error and
    nulls, others go on. Files without interval tiers give no row."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            rows = []
            for f, t in zip(df[file_id], df[text]):
                try:
                    rows += [(f, *r, None) for r in parse_textgrid(t or "")]
                except (IndexError, ValueError, TypeError) as e:
                    rows.append((f, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_id", "tier_idx", "tier", "idx", "xmin", "xmax", "label", "error"]).astype({"tier_idx": "Int32", "idx": "Int32"})

    return files.select(file_id, text).mapInPandas(run, f"file_id string, {COLUMNS}, error string")


def _text_of(raw: bytes) -> str:
    return raw.decode("utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("utf-8-sig", "replace")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """Interval rows (with an error column, see intervals_of_text) of the text files under a path of any store that Spark
    reads; UTF-8 and UTF-16. file_id is that of a folder 'file_id=...', else the file's stem."""
    folder = F.regexp_extract("path", r"/file_id=([^/]+)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    @F.pandas_udf("string")
    def decoded(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda b: _text_of(bytes(b)))

    return intervals_of_text(files.select(F.when(folder != "", F.url_decode(folder)).otherwise(T.file_stem(F.col("path"))).alias("file_id"), decoded("content").alias("value")))


def _tier_words(block: Column, pattern: str) -> Column:
    part = lambda g: F.regexp_extract_all(block, F.lit(pattern), F.lit(g))
    rows = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(x["a"].cast("double").alias("xmin"), x["b"].cast("double").alias("xmax"), F.lower(F.trim(x["c"])).alias("label")))
    return F.filter(rows, lambda x: ~x["label"].isin("", "sp", "sil"))


def short_words(text: Column, tier: str) -> Column:
    """ARRAY<STRUCT<xmin, xmax, label>> of a tier of a short-form text by built-in functions alone: blank and silence
    labels left out, labels in lower case. Quotes in labels stay doubled."""
    block = F.regexp_extract(text, rf'(?s)"IntervalTier"\r?\n"{re.escape(tier)}"\r?\n[^\n]*\n[^\n]*\n[^\n]*\n(.*?)(?:"(?:Interval|Text)Tier"\r?\n"|\z)', 1)
    return _tier_words(block, r'([\d.eE+-]+)\s+([\d.eE+-]+)\s+"((?:[^"]|"")*)"')


def long_words(text: Column, tier: str) -> Column:
    """short_words for long-form text."""
    block = F.regexp_extract(text, rf'(?s)name = "{re.escape(tier)}"(.*?)(?:\n\s*item \[|\z)', 1)
    return _tier_words(block, r'xmin = ([\d.eE+-]+)\s+xmax = ([\d.eE+-]+)\s+text = "((?:[^"]|"")*)"')


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store a path or URI lies in (local, HDFS, S3, ...) and the path in it; drivers and executors open it alike."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


class _File(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per = options["path"], int(options.get("filespertask", "64"))
        self.ids: set[str] | None = None
        self.tiers: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on file_id (files aren't opened) and tier."""
        for f in filters:
            value = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if value is not None and f.attribute == ("file_id",):
                self.ids = value if self.ids is None else self.ids & value
            elif value is not None and f.attribute == ("tier",):
                self.tiers = value if self.tiers is None else self.tiers & value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _store(self.path)
        stem = lambda p: os.path.splitext(os.path.basename(p))[0]
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            paths = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".TextGrid")]
        else:
            parent = os.path.dirname(root)
            paths = [f.path for f in fs.get_file_info(pafs.FileSelector(parent, allow_not_found=True)) if fnmatch.fnmatch(f.path, root)]
        paths = sorted(p for p in paths if self.ids is None or stem(p) in self.ids)
        return [_File(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [_File([])]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        for path in partition.paths:
            name = os.path.splitext(os.path.basename(path))[0]
            with fs.open_input_stream(path) as f:
                raw = f.read()
            for row in parse_textgrid(_text_of(raw)):
                if self.tiers is None or row[1] in self.tiers:
                    yield (name, *row)


class _Message(WriterCommitMessage):
    def __init__(self, files: int) -> None:
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, rows: Iterator) -> _Message:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        n = 0
        for r in rows:
            end = f"{root}/{r['file_id']}.TextGrid"
            part = f"{end}.part{os.getpid()}"
            with fs.open_output_stream(part) as f:
                f.write(r["value"].encode("utf-8"))
            fs.move(part, end)  # a task tried again replaces its file whole
            n += 1
        return _Message(n)


class TextGridSource(DataSource):
    """spark.read.format('textgrid').load(directory or glob); option filesPerTask. Written rows are file_id, value
    (sinks.textgrid.textgrid_text), one file each."""

    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return f"file_id string, {COLUMNS}"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextGridSource)
