"""Lists of input files: path lists, directories, downloaded packages, and the assembly table made of them."""

from __future__ import annotations

import json
import logging
import os
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
# Endings of sequence files, in any case, plain or with .gz after them.
ENDINGS = (".fasta", ".fa", ".fna", ".fas")
ASSEMBLIES = "assembly_idx int, path string, is_target boolean"


def list_dir(path: str | Path, mode: str = "a") -> list[Path]:
    """Entries sorted by name: all, directories or files (``a``, ``d``, ``f``)."""
    if mode not in ("a", "d", "f"):
        raise ValueError(f"mode is a, d or f, not {mode!r}")
    found = sorted(Path(path).iterdir(), key=lambda p: p.name)
    return [p for p in found if mode == "a" or (p.is_dir() if mode == "d" else p.is_file())]


def paths_in_list(file: str | Path) -> list[Path]:
    """The files named in a text file, one a line, relative to it; blank lines are skipped, what is no file is logged and skipped."""
    file, found = Path(file), []
    for line in file.read_text().splitlines():
        if not line.strip():
            continue
        p = (file.parent / line.strip()).resolve()
        if p.is_file():
            found.append(p)
        else:
            log.warning("not a file: %s", p)
    return found


def paths_in_dir(path: str | Path) -> list[Path]:
    """Sequence files directly in a directory, by name."""
    return [p for p in list_dir(path, "f") if p.name.lower().removesuffix(".gz").endswith(ENDINGS)]


def paths_in_package(path: str | Path) -> list[Path]:
    """The first file of each assembly directory of a download; none is an error, several are logged."""
    found = []
    for d in list_dir(path, "d"):
        files = paths_in_dir(d)
        if not files:
            raise FileNotFoundError(f"no sequence file in {d}")
        if len(files) > 1:
            log.warning("several sequence files in %s", d)
        found.append(files[0])
    return found


def search_taxon(taxon: str, api_key: str | None = None) -> list[dict]:
    """Assembly reports of a taxon, by the public ``datasets`` command where it is installed."""
    tool = shutil.which("datasets")
    if tool is None:
        raise FileNotFoundError("the datasets command is not installed")
    cmd = [tool, "summary", "genome", "taxon", taxon, *(["--api-key", api_key] if api_key else [])]
    return json.loads(subprocess.run(cmd, capture_output=True, check=True, text=True).stdout).get("reports", [])


def download_taxon(
    taxon: str, to: str | Path, *, level: str = "contig", source: str = "genbank", annotated: bool = False, exclude_mag: bool = False, gzip: bool = True,
    api_key: str | None = None, workers: int = 1,
) -> list[Path]:
    """Files of a taxon's genomes, by the ``datasets`` command; a download that is already there is used again.

    A list of the genomes comes first and then their sequences, packed with ``gzip``. A download that breaks off leaves
    nothing behind.
    """
    to = Path(to)
    data = to / "ncbi_dataset" / "data"
    if data.is_dir():
        return paths_in_package(data)
    tool = shutil.which("datasets")
    if tool is None:
        raise FileNotFoundError("the datasets command is not installed")
    key = ["--api-key", api_key] if api_key else []
    levels = ["contig", "scaffold", "chromosome", "complete"]
    asked = [] if level == levels[0] else ["--assembly-level", ",".join(levels[levels.index(level) :])]
    to.mkdir(parents=True, exist_ok=True)
    package = to / "package.zip"
    listed = ["--filename", str(package), "--dehydrated", "--include", "genome", "--exclude-atypical", "--exclude-multi-isolate", "--assembly-source", source]
    listed += [*asked, *(["--annotated"] if annotated else []), "--mag", "exclude" if exclude_mag else "all", *key]
    try:
        subprocess.run([tool, "download", "genome", "taxon", taxon, *listed], check=True)
        shutil.unpack_archive(package, to)
        subprocess.run([tool, "rehydrate", "--directory", str(to), "--max-workers", str(workers), *(["--gzip"] if gzip else []), *key], check=True)
    except Exception:
        shutil.rmtree(to, ignore_errors=True)
        raise
    return paths_in_package(data)


def assembly_table(spark: SparkSession, targets: list[Path], others: list[Path]) -> DataFrame:
    """Numbered assemblies, targets first; at least one of each class, no path twice."""
    if not targets or not others:
        raise ValueError("at least one target and one non-target assembly are needed")
    every = [str(p) for p in [*targets, *others]]
    twice = sorted({p for p in every if every.count(p) > 1}) if len(set(every)) < len(every) else []
    if twice:
        raise ValueError(f"assemblies named twice: {twice[:5]}")
    rows = [(i, p, i < len(targets)) for i, p in enumerate(every)]
    return spark.createDataFrame(rows, ASSEMBLIES)


def checked_output(path: str | Path, overwrite: bool, directory: bool = False) -> Path:
    """A place to write to: an error if it is taken, unless ``overwrite``, or if it is of the other kind."""
    p = Path(path)
    if p.exists():
        if p.is_dir() != directory:
            raise FileExistsError(f"{p} is {'a directory' if p.is_dir() else 'a file'}")
        if not overwrite:
            raise FileExistsError(f"{p} exists")
    elif directory:
        os.makedirs(p)
    return p
