"""FASTA and GenBank files as DataFrames; one parser for all paths."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = "assembly_idx int, record_no int, record_id string, seq string"
_SPACE = re.compile(r"\s+")


def parse_fasta(text: str, where: str = "text") -> Iterator[tuple[int, str, str]]:
    """(number, id, sequence) of each record, letters as they are.

    A record begins at a line that starts with ``>``; its id is what follows up to the first white space. Blank lines,
    carriage returns and white space inside sequences are ignored. No lines give no records, a header alone an empty
    sequence; sequence before any header is an error.
    """
    parts = re.split(r"(?:\A|(?<=[\r\n]))>", text)
    if parts[0].strip():
        raise ValueError(f"{where}: sequence before the first header")
    for n, part in enumerate(parts[1:]):
        header, _, body = part.replace("\r\n", "\n").partition("\n")
        name = header.split(None, 1)[0] if header and not header[0].isspace() else ""
        yield n, name.rstrip("\r"), _SPACE.sub("", body)


def _content(name: str, data: bytes) -> str:
    return (gzip.decompress(data) if name.lower().endswith(".gz") else data).decode()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for idx, path, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            rows = list(parse_fasta(_content(path, data), path))
            if rows:
                n, ids, seqs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([idx] * len(n), pa.int32()), pa.array(n, pa.int32()), pa.array(ids), pa.array(seqs)], ["assembly_idx", "record_no", "record_id", "seq"]
                )


def read_fasta(spark: SparkSession, assemblies: DataFrame, upper: bool = False) -> DataFrame:
    """Records of the files named in ``assemblies`` (assembly_idx, path); plain or gzip by the suffix.

    A path is a URI of any file system of the session, or a path of its default one; letters that patterns use are taken
    as they are. Files are read and parsed by the executors, a file a row; the driver only lists their names. A file that
    is not there is an error, as is one that the scan gives under no name of the list.
    """
    listed = assemblies.select("assembly_idx", "path").distinct().collect()  # names of the run's input files
    if not listed:
        return spark.createDataFrame([], RECORDS)
    full = {r[1]: _qualified(spark, r[1]) for r in listed}
    where = spark.createDataFrame([(r[0], full[r[1]]) for r in listed], "assembly_idx int, file string")
    files = spark.read.format("binaryFile").load([_PATTERN.sub(r"\\\g<0>", f) for f in sorted(set(full.values()))])
    read = {re.sub("^file:/+", "file:/", unquote(f)) for f in files.inputFiles()}  # these come with letters escaped
    lost = sorted(set(full.values()) - read)
    if lost:
        raise FileNotFoundError(f"files that were not read: {lost[:5]}")
    named = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"), "content")
    out = named.join(F.broadcast(where), "file").select("assembly_idx", "file", "content").mapInArrow(_parse, RECORDS)
    return out.withColumn("seq", F.upper("seq")) if upper else out


_PATTERN = re.compile(r"[\[\]{}*?\\]")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the file system writes it, with its scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def repeated_names(records: DataFrame) -> DataFrame:
    """``assembly_idx, record_id, n`` of ids that several records of one assembly have."""
    return records.where("record_id IS NOT NULL").groupBy("assembly_idx", "record_id").agg(F.count("*").alias("n")).where("n > 1")


def fasta_text(records: DataFrame, width: int = 60) -> DataFrame:
    """``assembly_idx, text``: each assembly's records as FASTA. An assembly is one file, so one row."""
    lines = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    rec = F.concat(F.lit(">"), F.coalesce("record_id", F.lit("")), F.lit("\n"), lines, F.lit("\n"))
    rows = records.select("assembly_idx", F.struct("record_no", rec.alias("t")).alias("r"))
    return rows.groupBy("assembly_idx").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"])).alias("text"))


def parse_texts(texts: DataFrame) -> DataFrame:
    """Records of ``assembly_idx, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, name, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, name, s in parse_fasta(t or "")]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["assembly_idx", "record_no", "record_id", "seq"])

    return texts.select("assembly_idx", "text").mapInArrow(run, RECORDS)


def parse_genbank(text: str) -> Iterator[tuple[int, str, str]]:
    """(number, id, upper-case sequence) of each entry: the VERSION (else LOCUS) name and the letters of ORIGIN."""
    n = 0
    for entry in re.split(r"^//\s*$", text, flags=re.M):
        locus = re.search(r"^LOCUS\s+(\S+)", entry, re.M)
        if not locus:
            continue
        version = re.search(r"^VERSION\s+(\S+)", entry, re.M)
        origin = re.search(r"^ORIGIN.*?\n(.*)", entry, re.M | re.S)
        yield n, (version or locus)[1], re.sub(r"[^A-Za-z]", "", origin[1]).upper() if origin else ""
        n += 1


def read_genbank(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, record_no, record_id, seq`` of GenBank flat files, plain or gzip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse_genbank(_content(p, d))]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "record_no", "record_id", "seq"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, record_no int, record_id string, seq string")


class FastaDataSource(DataSource):
    """``spark.read.format('fasta').load(path)``: one partition a file of a comma-separated list of local paths."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "path string, record_no int, record_id string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options["path"].split(","))


class _FastaReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            for n, name, seq in parse_fasta(_content(partition.value, f.read()), partition.value):
                yield partition.value, n, name, seq
