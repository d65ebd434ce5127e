"""Label text: center labels in, fixed-size boxes out.

Labels are a folder and a file an image. On a mounted folder Hadoop without its native library starts `chmod` for each file, which
takes longer than all the rest; so there a Python data source writes the files, as for cubes. Another one reads them: Spark's text
source spends a task on each folder it lists and some ms on each file it opens, more than on the lines of an image.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from fringeframe.sources.envi import _filesystem

# What Spark writes as %XX in a folder's name, and its name for null or empty values.
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# What Hadoop writes as %XX in the text of a path.
_QUOTED = re.compile("[^A-Za-z0-9_.~!'()*,;:$&+=/@\u00a1-\U0010ffff-]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Reading: text of a task, what opening a file counts as, text held at a time.
TASK_BYTES, OPEN_BYTES, BLOCK_BYTES = 16 << 20, 16 << 10, 1 << 20


def fixed8(c: Column) -> Column:
    """Eight decimals, half to even."""
    return F.format_string("%.8f", F.bround(c, 8))


def parse_center_lines(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Add x, y in pixels to label `line`s; blank lines are dropped, short lines fail the job.

    Eight or more columns with visibility above zero use columns 5 and 6, else five or more use columns
    1 and 2. Values with both magnitudes at most 1.5 are normalised and get scaled.
    """
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.get(F.col("_p"), F.lit(i)).cast("double")
    point = (F.size("_p") >= 8) & (number(7) > 0)
    short = F.raise_error(F.concat(F.lit("invalid label line: "), F.col("line")))
    pick = lambda a, b: F.when(point, number(a)).when(F.size("_p") >= 5, number(b)).otherwise(short)
    rows = lines.filter(F.trim("line") != "").withColumn("_p", parts).withColumns({"_x": pick(5, 1), "_y": pick(6, 2)})
    normalised = (F.abs("_x") <= 1.5) & (F.abs("_y") <= 1.5)
    return rows.withColumns(
        {
            "x": F.when(normalised, F.col("_x") * width).otherwise(F.col("_x")),
            "y": F.when(normalised, F.col("_y") * height).otherwise(F.col("_y")),
        }
    ).drop("_p", "_x", "_y")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path as a file: URI if it is on a mounted folder, which pyarrow reads as well."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return uri if uri.startswith("file:") else None


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over, folders as well as files."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


class FileGroup(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(0)
        self.files = files


class LabelReader(DataSourceReader):
    """Rows of (path, lines): a row a file, or a row a block of a long file. A file is listed with its size once and read by one task."""

    def __init__(self, options):
        self.root = options["path"]
        self.tasks = int(options.get("tasks", 1))

    def partitions(self):
        store, root = _filesystem(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        shown = lambda path: not any(map(_hidden, path[len(root) :].strip("/").split("/")))
        files = [(f.path, f.size + OPEN_BYTES) for f in found if f.type == fs.FileType.File and shown(f.path)]
        share = min(TASK_BYTES, sum(size for _path, size in files) // self.tasks)
        groups, held = [[]], 0
        for path, size in files:
            if groups[-1] and held + size > share:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [FileGroup(group) for group in groups]

    def read(self, partition):
        store, _root = _filesystem(self.root)
        paths, texts, held = [], [], 0

        def batch():
            # A view, as Spark does not check the encoding of a line either.
            lines = pc.split_pattern(pa.array(texts, pa.binary()).view(pa.string()), "\n")
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), lines], ["path", "lines"])

        for path in partition.files:
            name = "file:" + _QUOTED.sub(lambda c: "".join(f"%{b:02X}" for b in c.group().encode()), path)
            for text in self._blocks(store, path):
                paths.append(name)
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield batch()
                    paths, texts, held = [], [], 0
        if paths:
            yield batch()

    @staticmethod
    def _blocks(store, path):
        """Whole lines of a file, ended by \\n; \\r ends a line too, so \\r\\n leaves a blank one. Streams of gz, bz2 and zst are unpacked."""
        rest, first = b"", True
        with store.open_input_stream(path) as handle:
            while block := handle.read(BLOCK_BYTES):
                head, end, tail = block.replace(b"\r", b"\n").rpartition(b"\n")
                if first:
                    head, tail = (head.removeprefix(b"\xef\xbb\xbf"), tail) if end else (head, tail.removeprefix(b"\xef\xbb\xbf"))
                    first = False
                if end:
                    yield rest + head
                    rest = tail
                else:
                    rest += tail
        if rest:
            yield rest


class LabelSource(DataSource):
    @classmethod
    def name(cls):
        return "label_lines"

    def schema(self):
        return "path string, lines array<string>"

    def reader(self, schema: StructType):
        return LabelReader(self.options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, path) of every label file below `path`; blank lines may be lost or added.

    Mounted folders are read by a task for some 16 MB of files; other stores, single files and patterns by Spark's text source.
    """
    uri = _mounted(spark, path)
    if uri is not None:
        store, root = _filesystem(uri)
        if store.get_file_info(root).type == fs.FileType.Directory:
            spark.dataSource.register(LabelSource)
            files = spark.read.format("label_lines").option("tasks", spark.sparkContext.defaultParallelism).load(uri)
            return files.select(F.explode("lines").alias("line"), "path")
    text = spark.read.option("recursiveFileLookup", True).text(path)
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def read_centers(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Centers of every label file below `path`, with the file's path."""
    lines = read_lines(spark, path).withColumn("line", F.regexp_replace("line", "^﻿", ""))
    return parse_center_lines(lines, width, height)


def box_lines(df: DataFrame, width: int, height: int, box: int, class_id: Column | None = None, inset: bool = False) -> DataFrame:
    """Add `line`: class, center clipped to 0..1, box size, eight decimals.

    Class 0 in particle mode (no class_id). `inset` clips the center to half a box from the edge instead.
    """
    half = box / 2.0

    def center(c: str, size: int) -> Column:
        if inset:
            return F.greatest(F.lit(half), F.least(F.col(c), F.lit(size - half))) / float(size)
        return F.greatest(F.lit(0.0), F.least(F.col(c) / float(size), F.lit(1.0)))

    label = F.lit(0) if class_id is None else class_id
    return df.withColumn(
        "line",
        F.concat_ws(
            " ", label.cast("string"), fixed8(center("x", width)), fixed8(center("y", height)),
            fixed8(F.lit(box / width)), fixed8(F.lit(box / height)),
        ),
    )


def _folder(column: str, value: str | None) -> str:
    """A folder's name as Spark's partitioned sinks give it."""
    escape = lambda text: _ESCAPED.sub(lambda c: f"%{ord(c.group()):02X}", text)
    return f"{escape(column)}={escape(value) if value else _NO_VALUE}"


class LabelWriter(DataSourceArrowWriter):
    """Streams sorted (folder columns, line) rows of a task into one file a folder; holds one batch at a time.

    A file has its name only when it is whole, and always the same name, so a task run again replaces its files.
    """

    def __init__(self, options):
        self.root = options["path"]

    def write(self, iterator):
        store, root = _filesystem(self.root)
        key, handle, temporary, final = None, None, None, None
        for batch in iterator:
            if not len(batch):
                continue
            by, lines = batch.schema.names[:-1], batch.column(batch.num_columns - 1).fill_null("")
            ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(c)).run_ends.to_numpy() for c in by]))
            starts = np.concatenate([[0], ends[:-1]])
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), lines), "\n")
            keys = zip(*(batch.column(c).take(pa.array(starts)).to_pylist() for c in by))
            for new, text in zip(keys, texts.to_pylist()):
                if new != key:
                    if handle is not None:
                        handle.close()
                        store.move(temporary, final)
                    key = new
                    folder = "/".join([root, *map(_folder, by, key)])
                    store.create_dir(folder, recursive=True)
                    temporary, final = f"{folder}/_{uuid.uuid4().hex}.part", f"{folder}/labels.txt"
                    handle = store.open_output_stream(temporary)
                handle.write(f"{text}\n".encode())
        if handle is not None:
            handle.close()
            store.move(temporary, final)
        return WriterCommitMessage()

    def commit(self, messages):
        store, root = _filesystem(self.root)
        store.create_dir(root, recursive=True)
        store.open_output_stream(f"{root}/_SUCCESS").close()


class LabelSink(DataSource):
    @classmethod
    def name(cls):
        return "box_labels"

    def writer(self, schema: StructType, overwrite: bool):
        return LabelWriter(self.options)


def write_box_labels(lines: DataFrame, path: str, by: list[str]) -> None:
    """Label lines as text, one folder per value of `by` (split, image), in place of what `path` held.

    Stores other than mounted folders get Spark's own text sink, with the same folders.
    """
    spark = lines.sparkSession
    uri = _mounted(spark, path)
    if uri is None:
        lines.select(*by, "line").repartition(*by).write.partitionBy(*by).mode("overwrite").text(path)
        return
    store, root = _filesystem(uri)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)
    spark.dataSource.register(LabelSink)
    # Null and empty values share a folder, so they must share a task.
    named = lines.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in by], "line")
    named.repartition(*by).sortWithinPartitions(*by).write.format("box_labels").mode("append").save(uri)
