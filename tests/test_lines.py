import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators.lines import SCHEMA, diagnose, parse_lines, split_strict
from tests.conftest import rows

GOOD = "1,2,id,note,4,ACGT"
CASES = {
    GOOD: None,
    '1,2,id,"a, ""b""",4,acgN': None,
    "1,2,id,note,04,ACGT": None,
    '"1",2,"id",,"4","ACGT"': None,
    '1,2,id,"open,4,ACGT': "quoting",
    '1,2,id,"a"b,4,ACGT': "quoting",
    '1,2,id,a"b,4,ACGT': "quoting",
    '1,2,id,a"b,4': "quoting",
    "1,2,id,note,4": "columns",
    "1,2,id,note,4,ACGT,": "columns",
    "1": "columns",
    "x,2,id,note,4,ACGT": "values",
    "1,,id,note,4,ACGT": "values",
    "1,٢,id,note,4,ACGT": "values",
    "1,2,,note,4,ACGT": "values",
    "1,2,i d,note,4,ACGT": "values",
    "1,2,i d,note,4,ACGT": "values",
    "1,2,id,note,4,": "values",
    "1,2,id,note,4,ACXT": "values",
    "1,2,id,note,5,ACGT": "values",
    "1,2,id,note,99999999999999999999999,ACGT": "values",
    "1,2,id,two\nlines,4,ACGT": None,
    "99999999999999999999999,2,id,note,4,ACGT": None,
}


def test_every_case_alone_and_in_a_block(spark):
    skipped = [None, "", "  \t ", "\r", "# a comment", "#"]
    lines = [*CASES, *skipped, GOOD + "\r", *[GOOD] * 600]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame([(i, x, "x") for i, x in enumerate(lines)], "line_no bigint, line string, reason string").coalesce(1)
    got = {r["line_no"]: r for r in parse_lines(df).collect()}
    for i, line in enumerate(lines):
        if line in skipped:
            assert i not in got
        else:
            want = CASES[line.removesuffix("\r")]
            assert (got[i]["reason"], got[i]["ok"]) == (want, want is None), line
    i = lines.index('1,2,id,"a, ""b""",4,acgN')
    assert tuple(got[i])[3:] == (1, 2, "id", 'a, "b"', 4, "acgN")
    i = lines.index("99999999999999999999999,2,id,note,4,ACGT")
    assert got[i]["assembly_idx"] is None and got[i]["ok"]


def test_empty_table_and_long_line(spark):
    df = spark.createDataFrame([], "line_no bigint, line string")
    assert rows(parse_lines(df)) == []
    seq = "A" * 300_000
    df = spark.createDataFrame([(1, f"1,2,id,,{len(seq)},{seq}"), (1, f"1,2,id,,{len(seq)},{seq}")], "line_no bigint, line string")
    assert [len(r["seq"]) for r in parse_lines(df).collect()] == [300_000] * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('ab",\r #', max_size=6), min_size=1, max_size=7))
def test_strict_split_reads_back_what_was_quoted(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert split_strict(line) == fields
    row = diagnose(1, line)
    assert set(row) == {c.split()[0] for c in SCHEMA.split(", ")}


def test_works_on_a_stream(spark, tmp_path):
    from strandline.streaming.ingest import load_lines

    spark.createDataFrame([(1, GOOD), (2, "bad")], "line_no bigint, line string").coalesce(1).write.parquet(f"{tmp_path}/in")
    load_lines(spark, f"{tmp_path}/in", f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state")
    assert rows(spark.read.parquet(f"{tmp_path}/good").select("line_no", "seq")) == [(1, "ACGT")]
    assert rows(spark.read.parquet(f"{tmp_path}/bad").select("line_no", "reason")) == [(2, "columns")]
