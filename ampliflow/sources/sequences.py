"""FASTQ and FASTA as Spark data sources: ``register(spark)``, then ``spark.read.format("fastq").load(path)``.

One partition per file (gzip cannot be split); rows come in Arrow batches with
their ordinal in the file. Writing makes one file per task, or per sample with
the option ``bySample`` (``samples``: names that get a file even without rows);
FASTA records without a header are numbered ``task.record``. Paths may be
folders, globs or comma-separated lists, gzip by suffix.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BATCH = 8192
SUFFIXES = ("", ".gz", ".gzip")


def _open(path: str, mode: str):
    return gzip.open(path, mode + "t", compresslevel=6) if path.endswith((".gz", ".gzip")) else open(path, mode)


def _files(path: str, kinds: tuple[str, ...]) -> list[str]:
    out = []
    for part in path.removeprefix("file:").split(","):
        if os.path.isdir(part):
            out += [os.path.join(part, f) for f in os.listdir(part) if f.removesuffix(".gz").removesuffix(".gzip").endswith(kinds)]
        else:
            out += glob.glob(part) or [part]
    return sorted(out)


def _sample(path: str) -> str:
    name = os.path.basename(path)
    for end in (".gz", ".gzip", ".fastq", ".fq", ".fasta", ".fa", ".fna"):
        name = name.removesuffix(end)
    return name


def file_samples(path: str, kinds: tuple[str, ...] = (".fastq", ".fq")) -> list[str]:
    """The samples of the files of a path, in the order of their names; files without reads count."""
    return [_sample(f) for f in _files(path, kinds)]


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str]]:
    """Records of four lines, up to an empty header."""
    lines = (x.rstrip("\r\n") for x in lines)
    while len(four := tuple(islice(lines, 4))) == 4 and four[0]:
        yield four


def fasta_records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Header without ``>`` and upper-cased sequence, whose lines are joined."""
    head, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(parts).upper()
            head, parts = line[1:], []
        elif head is not None:
            parts.append(line)
    if head is not None:
        yield head, "".join(parts).upper()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], fastq: bool, most: int | None):
        self.files, self.fastq, self.most = files, fastq, most

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = ["header", "seq", "sep", "qual"] if self.fastq else ["header", "seq"]
        with _open(partition.path, "r") as f:
            records = islice((fastq_records if self.fastq else fasta_records)(f), self.most)
            first = 0
            while some := list(islice(records, BATCH)):
                columns = [pa.array(c, pa.string()) for c in zip(*some, strict=True)]
                ids = pa.array(range(first, first + len(some)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([_sample(partition.path)] * len(some)), ids, *columns], names=["sample_id", "read_id" if self.fastq else "ref_id", *names])
                first += len(some)


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """A file for each task, or with ``by_sample`` for each sample (rows must come sorted by sample, one task a sample)."""

    def __init__(self, path: str, fastq: bool, compress: bool, overwrite: bool, by_sample: bool = False, samples: str = ""):
        self.path, self.fastq, self.by_sample = path.removeprefix("file:"), fastq, by_sample
        self.end = (".fastq" if fastq else ".fasta") + (".gz" if compress else "")
        self.samples = [x for x in samples.split(",") if x]
        os.makedirs(self.path, exist_ok=True)
        if overwrite:
            for f in _files(self.path, (".fastq", ".fasta")):
                os.remove(f)

    def write(self, rows: Iterator) -> _Done:
        from pyspark import TaskContext

        c = TaskContext.get()
        own = f"part-{c.partitionId():05d}"
        for name, some in groupby(rows, lambda r: r["sample_id"] if self.by_sample else own):
            path = os.path.join(self.path, f"{name}{self.end}")
            draft = f"{path}.{c.taskAttemptId()}.draft" + (".gz" if self.end.endswith(".gz") else "")
            with _open(draft, "w") as f:
                for k, r in enumerate(some):
                    d = r.asDict()
                    f.write(f"{d['header']}\n{d['seq']}\n{d.get('sep') or '+'}\n{d['qual']}\n" if self.fastq else f">{d.get('header') or f'{c.partitionId()}.{k + 1}'}\n{d['seq']}\n")
            os.replace(draft, path)
        return _Done(self.path)

    def commit(self, messages: list) -> None:
        """Declared samples without a row get an empty file."""
        for name in self.samples:
            path = os.path.join(self.path, f"{name}{self.end}")
            if not os.path.exists(path):
                with _open(path, "w"):
                    pass


class FastqSource(DataSource):
    fastq = True

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "sample_id string, read_id long, header string, seq string, sep string, qual string"

    def _most(self) -> int | None:
        most = self.options.get("maxRecords")
        return int(most) if most else None

    def reader(self, schema) -> DataSourceReader:
        kinds = (".fastq", ".fq") if self.fastq else (".fasta", ".fa", ".fna")
        return _Reader(_files(self.options["path"], kinds), self.fastq, self._most())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.fastq, self.options.get("compression", "gzip") == "gzip", overwrite, self.options.get("bySample") == "true", self.options.get("samples", ""))


class FastaSource(FastqSource):
    fastq = False

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "sample_id string, ref_id long, header string, seq string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], False, self.options.get("compression") == "gzip", overwrite)


def sequences_of(spark, found, collapse: bool = False):
    """(seq) in upper case, of a FASTA or FASTQ path, one sequence, a list, the keys of a dict, a pandas Series, or a frame of Spark or pandas.

    A frame gives its column ``sequence`` or ``seq``, or else (a wide table) the names of its columns. ``collapse``: each once.
    """
    if isinstance(found, DataFrame):
        column = next((c for c in ("sequence", "seq") if c in found.columns), None)
        out = found.select(F.upper(column).alias("seq")) if column else None
        found = None if column else found.columns
    elif isinstance(found, str) and (files := [f for f in _files(found, (".fastq", ".fq", ".fasta", ".fa", ".fna")) if os.path.exists(f)]):
        register(spark)
        kind = "fastq" if files[0].removesuffix(".gz").removesuffix(".gzip").endswith((".fastq", ".fq")) else "fasta"
        out, found = spark.read.format(kind).load(found).select(F.upper("seq").alias("seq")), None
    elif isinstance(found, str):
        found = [found]
    elif isinstance(found, pd.DataFrame):
        column = next((c for c in ("sequence", "seq") if c in found.columns), None)
        found = found[column] if column else found.columns
    elif not hasattr(found, "__iter__"):
        raise TypeError(f"no sequences in a {type(found).__name__}")
    if found is not None:
        out = spark.createDataFrame([(str(s).upper(),) for s in found], "seq string")
    return out.distinct() if collapse else out


def register(spark) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastaSource)
