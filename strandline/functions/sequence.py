"""Scalar sequence functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; A C G T in both cases, other letters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def hash60(text: Column) -> Column:
    """The first 60 bits of MD5 as a BIGINT; any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def slice_seq(seq: Column, start: Column, stop: Column) -> Column:
    """Letters start to stop, counted from 0, half-open."""
    return F.substring(seq, start + 1, stop - start)


def first_token(header: Column) -> Column:
    """A record's id: its header up to the first white space."""
    return F.regexp_extract(header, r"^(\S*)", 1)


def is_yes(flag: Column) -> Column:
    return flag == "y"


def yes_no(flag: Column) -> Column:
    return F.when(flag, "y").when(~flag, "n")


def edge_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The ends of an undirected edge in order."""
    return F.least(a, b), F.greatest(a, b)


def canonical_order(a: Column) -> Column:
    """The smaller of an array and its reverse."""
    return F.when(a <= F.reverse(a), a).otherwise(F.reverse(a))


def has_repeats(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def location_header(assembly: Column, record_id: Column, start: Column, stop: Column) -> Column:
    return F.format_string("%d-%s-%d:%d", assembly, record_id, start, stop)


def shared_fraction(cell: Column) -> Column:
    """``shared/total`` as a double."""
    p = F.split(cell, "/")
    return p[0].cast("double") / p[1].cast("double")
