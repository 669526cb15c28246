"""Delimited lines that may not parse (problem 5): good rows typed, bad rows with the reason.

Lines are checked column by column, a block at a time and each check once. A block in which all pass goes through Arrow's
CSV reader as a whole; one in which some fail is bisected on the outcome of the check until the failing lines stand alone,
and what is left of it is parsed at once. Only lines that fail are read again, letter by letter, to name the reason.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import spread

FIELDS = ["assembly_idx", "record_no", "record_id", "note", "length", "seq"]
SCHEMA = (
    "line_no bigint, ok boolean, reason string, assembly_idx bigint, record_no bigint, record_id string, note string,"
    " length bigint, seq string"
)
# Fixed values of the format: the letters of a sequence, and the shape of a line of six fields.
LETTERS = "ACGTURYKMSWBDHVNacgturykmswbdhvn"
_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
_SHAPE = rf"\A{_FIELD}(?:,{_FIELD}){{5}}\z"
_DIGITS, _ID, _SEQ = r"\A[0-9]{1,18}\z", r"\A[^\s]+\z", rf"\A[{LETTERS}]+\z"
_BLOCK = 4096


def parse_lines(df: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Rows of :data:`SCHEMA`, one per line that is not skipped; ``reason`` is NULL where ``ok``.

    Skipped: NULL lines, lines of blanks only, lines that start with ``#``. One final carriage return is not part of a
    line. Reasons, the first that holds: ``quoting``, ``columns``, ``values``. A number of more than 18 digits is valid
    and comes out as NULL. Repeated rows come out as often as they went in. An empty frame gives no rows; other columns
    of ``df`` are ignored. Runs unchanged on a stream.
    """
    rows = df.select(F.col(line_no).cast("bigint").alias("line_no"), F.col(line).cast("string").alias("line"))
    return (rows if df.isStreaming else spread(rows)).mapInArrow(_parse, SCHEMA)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        line = batch.column(1)
        line = pc.replace_substring_regex(line, r"\r\z", "")
        skip = pc.or_(pc.equal(pc.utf8_trim_whitespace(line), ""), pc.starts_with(line, "#"))
        keep = pc.fill_null(pc.invert(skip), False)
        no, line = pc.filter(batch.column(0), keep), pc.filter(line, keep)
        for at in range(0, len(line), _BLOCK):
            good: list[pa.RecordBatch] = []
            failed: list[tuple[pa.Array, pa.Array]] = []
            _block(no.slice(at, _BLOCK), line.slice(at, _BLOCK), good, failed)
            yield from good
            if failed:
                rows = [diagnose(i, t) for x, y in failed for i, t in zip(x.to_pylist(), y.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [("line_no", pa.int64()), ("ok", pa.bool_()), ("reason", pa.string()), ("assembly_idx", pa.int64()), ("record_no", pa.int64())]
    + [("record_id", pa.string()), ("note", pa.string()), ("length", pa.int64()), ("seq", pa.string())]
)


def _block(no: pa.Array, line: pa.Array, good: list, failed: list) -> None:
    """Typed rows of the lines that are certainly valid; the others are left to a strict reading."""
    fits = _mask(pc.match_substring_regex(line, _SHAPE))
    (no, line), out = _parted(fits, no, line)
    failed.append(out)
    columns = _columns(line)
    if columns is None:  # the reader takes no line or another number of lines: bisect the block itself
        if len(line) == 1:
            failed.append((no, line))
        elif len(line):
            half = len(line) // 2
            _block(no.slice(0, half), line.slice(0, half), good, failed)
            _block(no.slice(half), line.slice(half), good, failed)
        return
    checks = [(f, _DIGITS) for f in ("assembly_idx", "record_no", "length")] + [("record_id", _ID), ("seq", _SEQ)]
    right = [pc.match_substring_regex(columns[f], p) for f, p in checks]
    # RE2's \s is ASCII only: ids with any other letter outside ASCII are read strictly
    right.append(pc.string_is_ascii(columns["record_id"]))
    valid = np.logical_and.reduce([_mask(x) for x in right])
    length = pc.cast(pc.if_else(pa.array(valid), columns["length"], "0"), pa.int64())
    valid &= length.to_numpy() == pc.utf8_length(columns["seq"]).to_numpy()
    (no, *cells), out = _parted(valid, no, *columns.values(), line)
    failed.append((out[0], out[-1]))
    if len(no):
        cell = dict(zip(FIELDS, cells[:-1], strict=True)) | {"line_no": no, "ok": pa.array([True] * len(no)), "reason": pa.nulls(len(no), pa.string())}
        good.append(pa.RecordBatch.from_arrays([pc.cast(cell[f.name], f.type) for f in _ARROW], schema=_ARROW))


def _mask(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _parted(ok: np.ndarray, *columns: pa.Array) -> tuple[list[pa.Array], list[pa.Array]]:
    """The columns where ``ok`` holds, and where it does not: runs between failing rows, found by bisection."""
    fails = np.concatenate([[0], np.cumsum(~ok)])
    if not fails[-1]:
        return list(columns), [c.slice(0, 0) for c in columns]
    runs: list[tuple[int, int]] = []
    alone: list[int] = []
    todo = [(0, len(ok))]
    while todo:
        lo, hi = todo.pop()
        if lo == hi:
            continue
        if fails[lo] == fails[hi]:
            runs.append((lo, hi))
        elif hi - lo == 1:
            alone.append(lo)
        else:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]  # the left half is taken first, so rows stay in order
    at = pa.array(alone, pa.int64())
    kept = [pa.concat_arrays([c.slice(lo, hi - lo) for lo, hi in runs]) if runs else c.slice(0, 0) for c in columns]
    return kept, [c.take(at) for c in columns]


def _columns(line: pa.Array) -> dict[str, pa.Array] | None:
    """The fields of the lines, or None where the reader does not take them one by one."""
    if not len(line):
        return dict.fromkeys(FIELDS, pa.array([], pa.string()))
    text = "\n".join(line.to_pylist()).encode("utf-8", "surrogatepass")
    try:
        t = pcsv.read_csv(
            io.BytesIO(text),
            read_options=pcsv.ReadOptions(column_names=FIELDS, use_threads=False, block_size=len(text) + 1024),
            parse_options=pcsv.ParseOptions(ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types=dict.fromkeys(FIELDS, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if t.num_rows != len(line):  # a line break inside a line
        return None
    return {f: t.column(f).chunk(0) if t.column(f).num_chunks == 1 else t.column(f).combine_chunks() for f in FIELDS}


def diagnose(no: int, line: str) -> dict:
    """One line read strictly."""
    row = dict.fromkeys(_ARROW.names) | {"line_no": no, "ok": False}
    fields = split_strict(line)
    if fields is None:
        return row | {"reason": "quoting"}
    if len(fields) != len(FIELDS):
        return row | {"reason": "columns"}
    f = dict(zip(FIELDS, fields, strict=True))
    digits = all(f[k] and f[k].isascii() and f[k].isdigit() for k in ("assembly_idx", "record_no", "length"))
    named = f["record_id"] and not any(ch.isspace() for ch in f["record_id"])
    if not (digits and named and f["seq"] and not f["seq"].strip(LETTERS) and set(f["seq"]) <= set(LETTERS)):
        return row | {"reason": "values"}
    if (f["length"].lstrip("0") or "0") != str(len(f["seq"])):
        return row | {"reason": "values"}
    number = {k: int(f[k]) if len(f[k].lstrip("0")) <= 18 else None for k in ("assembly_idx", "record_no", "length")}
    return row | f | number | {"ok": True}


def split_strict(line: str) -> list[str] | None:
    """The fields of a line, or None where its quoting is broken."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if line.startswith('""', end):
                    end += 2
                    continue
                break
            if end + 1 < n and line[end + 1] != ",":
                return None
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return None
            fields.append(line[at:end])
            at = end
        if at >= n:
            return fields
        at += 1
