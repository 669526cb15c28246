"""Documents into containers of fixed token capacity (problem 7): best fit over a histogram of lengths.

The plan is made from how many items have each length, never from the items: its size follows the number of different
lengths, which is at most the capacity, and for capacities larger than that the longest text.
It is a list of slot runs: items of one length with ranks in a range go into consecutive containers, so many to each.
Documents then take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ranking import row_numbers
from strandline.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BROADCAST_ROWS = 200_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens`` of the whole text; a NULL text has 0 tokens. One row per distinct (key, length)."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = spread(rows).mapInArrow(partial(_lengths, path=vocabulary), "id bigint, n_tokens bigint").distinct()
    return out.withColumnRenamed("id", key)


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = tokenizer(path)
    for b in batches:
        n = []
        for at in range(0, b.num_rows, 256):  # few texts are Python strings at a time
            n += [len(enc.encode_ordinary(t)) for t in b.column(1).slice(at, 256).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: (length, rank from, rank to, first bin, items a bin, offset in the bin).

    Ranks count from 0 and end before ``rank to``; item r of a run is in bin ``first + (r - from) // items a bin``.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in free:
                insort(sizes, room)
                free[room] = []
            free[room].append((first, n))

    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (capacity // length))
                put(capacity, bins, n)
                bins += n
                continue
            room = sizes[at]
            first, n = free[room].pop()
            if not free[room]:
                del free[room], sizes[at]
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left:  # fewer than fill one bin
                out.append((length, rank, rank + left, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            put(room, first + full, rest)
    return out


def pack(lengths: DataFrame, key: str, n_tokens: str, containers: DataFrame) -> DataFrame:
    """``container, key, piece, token_start, n_tokens, bin, bin_offset``: where each document goes, for each container kind.

    ``containers`` has ``container`` and ``capacity`` (a short list; kinds without a capacity of at least 1 are left out).
    A document above the capacity is split into full pieces and a rest; no other is split. Containers are numbered from 0
    within their kind. A document without tokens takes no space: ``bin`` is NULL. Every document has a row in every kind;
    repeated rows count once. No documents or no containers give no rows.
    """
    spark = lengths.sparkSession
    kinds = sorted({(r[0], r[1]) for r in containers.select("container", F.col("capacity").cast("bigint")).where("capacity > 0").collect()}, key=str)
    docs = lengths.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("bigint").alias("n")).distinct()
    each = [F.struct(F.lit(str(a)).alias("container"), F.lit(b).cast("bigint").alias("capacity")) for a, b in kinds]
    kind = F.explode(F.array(*each).cast("array<struct<container:string,capacity:bigint>>")).alias("c")
    items = docs.select("id", "n", kind).select("c.container", "id", "n", "c.capacity").select(
        "container", "id", "n", "capacity",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.expr("(n + capacity - 1) DIV capacity - 1")))).alias("piece"),
    )
    items = items.select(
        "container", "id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"),
        F.least(F.col("capacity"), F.col("n") - F.col("piece") * F.col("capacity")).alias("length"),
    )
    ranked = row_numbers(items, ["container", "length"], [F.col("id"), F.col("piece")], "rank")
    counts: dict[str, dict[int, int]] = {str(a): {} for a, _ in kinds}
    for r in ranked.where("length > 0").groupBy("container", "length").count().toLocalIterator():
        counts[r[0]][r[1]] = r[2]
    slots = [(str(name), *s) for name, c in kinds for s in plan(counts[str(name)], c)]
    schema = "container string, length bigint, r0 bigint, r1 bigint, bin0 bigint, each bigint, bin_offset0 bigint"
    slot = spark.createDataFrame(slots, schema)
    slot = F.broadcast(slot) if len(slots) <= _BROADCAST_ROWS else slot
    r = F.col("rank") - 1
    i = ranked.alias("i")
    on = (F.col("i.container") == F.col("s.container")) & (F.col("i.length") == F.col("s.length")) & (r >= F.col("r0")) & (r < F.col("r1"))
    return i.join(slot.alias("s"), on, "left").select(
        F.col("i.container").alias("container"), F.col("id").alias(key), "piece", "token_start", F.col("i.length").alias("n_tokens"),
        F.expr("bin0 + (rank - 1 - r0) DIV each").alias("bin"),
        F.expr("bin_offset0 + (rank - 1 - r0) % each * i.length").alias("bin_offset"),
    )


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, capacity, n_bins, n_tokens, filled``: the share of all planned space that is used."""
    used = packed.groupBy("container").agg((F.max("bin") + 1).alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    cap = containers.select(F.col("container").cast("string").alias("container"), F.col("capacity").cast("bigint").alias("capacity")).distinct()
    return used.join(cap, "container").select("container", "capacity", "n_bins", "n_tokens", (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("filled"))
