import gzip
import json
import os
import random
from pathlib import Path

import pytest

from strandline import api
from strandline.cli import config_of
from strandline.config import Config
from strandline.sources import fasta, paths, tables
from tests.conftest import rows


def test_fasta_cases():
    parse = lambda t: [(i, s) for _, i, s in fasta.parse_fasta(t)]
    assert parse("") == [] and parse("\n\n") == []
    assert parse(">a desc\r\nAC gt\r\n\r\nNN\n>b\n>c\tx\nA>C\n") == [("a", "ACgtNN"), ("b", ""), ("c", "A>C")]
    assert parse("> a\nAC") == [("", "AC")]
    with pytest.raises(ValueError):
        parse("ACGT\n>a\n")


def test_genbank():
    t = "LOCUS       X1  10 bp\nVERSION     X1.2\nORIGIN\n        1 acgta cg\n       61 tt\n//\nLOCUS  Y\nORIGIN\n//\n"
    assert list(fasta.parse_genbank(t)) == [(0, "X1.2", "ACGTACGTT"), (1, "Y", "")]


def test_read_files(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">r1\nacgt\n>r2\nGG\n")
    (tmp_path / "a.FNA.gz").write_bytes(gzip.compress(b">z\nTT\n"))
    (tmp_path / "empty.fasta").write_text("")
    (tmp_path / "notes.txt").write_text("b.fa\n\nmissing.fa\na.FNA.gz\n")
    files = paths.paths_in_dir(tmp_path)
    assert [p.name for p in files] == ["a.FNA.gz", "b.fa", "empty.fasta"]
    assert [p.name for p in paths.paths_in_list(tmp_path / "notes.txt")] == ["b.fa", "a.FNA.gz"]
    table = paths.assembly_table(spark, files[:1], files[1:])
    want = [(0, 0, "z", "TT"), (1, 0, "r1", "ACGT"), (1, 1, "r2", "GG")]
    assert rows(fasta.read_fasta(spark, table, upper=True)) == want
    spark.dataSource.register(fasta.FastaDataSource)
    assert spark.read.format("fasta").load(str(tmp_path / "b.fa")).count() == 2
    assert rows(fasta.parse_texts(fasta.fasta_text(fasta.read_fasta(spark, table, upper=True)))) == want
    with pytest.raises(ValueError):
        paths.assembly_table(spark, files[:1], files[:1])
    with pytest.raises(ValueError):
        paths.assembly_table(spark, [], files)


def test_config_rules(tmp_path):
    ok = {"tar_dir": tmp_path, "neg_dir": tmp_path}
    c = Config(**ok, api_key="secret")
    assert "secret" not in json.dumps(c.to_dict()) and "secret" not in repr(c)
    with pytest.raises(Exception):
        c.seed = 1
    for bad in ({"stringency": 11}, {"penalty_th": 1.5}, {"max_len": 100}, {"tar_dir": tmp_path / "no"}, {"tar_dir": None}, {"level": "x"}):
        with pytest.raises(ValueError):
            Config(**{**ok, **bad})
    assert Config(download_only=True).download_only
    c = config_of(["--tar-dir", str(tmp_path), "--neg-dir", str(tmp_path), "--kmerlen", "15", "--no-blast", "--overwrite", "--penalty-th", "0.3"])
    assert (c.kmerlen, c.run_blast, c.overwrite, c.penalty_th, c.run_mash) == (15, False, True, 0.3, True)


def _genomes(where):
    r = random.Random(7)
    core = "".join(r.choice("ACGT") for _ in range(400))
    for side, n in (("tar", 4), ("neg", 3)):
        (where / side).mkdir()
        for i in range(n):
            own = ["".join(r.choice("ACGT") for _ in range(600)) for _ in range(2)]
            seq = own[0] + (core if side == "tar" else "") + own[1]
            (where / side / f"{i}.fa").write_text(f">rec{i} x\n{seq}\n>short\nACGT\n")
    return core


def test_a_run_finds_what_targets_share(spark, tmp_path):
    core = _genomes(tmp_path)
    c = dict(tar_dir=tmp_path / "tar", neg_dir=tmp_path / "neg", prefix=tmp_path, title="out", kmerlen=15, windowsize=10, min_len=100, penalty_th=0.1, max_nodes_cap=None)
    got = api.run(spark, Config(**c))
    lines = (tmp_path / "out" / "signatures.fasta").read_text().splitlines()
    assert len(lines) == 2 and "-rec" in lines[0] and lines[1][20:-20] in core and len(lines[1]) > 350
    row = (tmp_path / "out" / "signatures.csv").read_text().splitlines()[1].split(",")
    assert float(row[2]) > 0.95 and float(row[3]) == 1.0 and float(row[5]) == 0.0
    assert {"assemblies.csv", "config.json"} <= {p.name for p in (tmp_path / "out").iterdir()}
    with pytest.raises(FileExistsError):
        api.run(spark, Config(**c))
    assert api.load(spark, tmp_path / "out")["signatures"].count() == 1
    # the same whatever the partitions, and with recomputed sketches
    records = fasta.read_fasta(spark, got.assemblies)
    base = None
    for n, low in ((1, False), (9, True)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = api.find_signatures(records.repartition(n), got.assemblies, 15, 10, min_len=50, stringency=5, low_memory=low, run_mash=low, sketchsize=2000, cap=0.1)[0]
        now = rows(found.select("assembly_idx", "start", "stop", "seq"))
        base = base or now
        assert now == base and now
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_tables_of_other_tools(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a\tb\t0.1\t0\t250/1000\n")
    assert tables.read_distances(spark, str(tmp_path / "d.tsv")).first()["jaccard"] == 0.25
    (tmp_path / "h.tsv").write_text("0\t3@y@r\t90\t5\t1\t1\t100\t1\t100\t1e-9\t99.5\tACGT\n")
    h = tables.read_hits(spark, str(tmp_path / "h.tsv"))
    from strandline.operators.metrics import parse_subjects

    assert parse_subjects(h).select("assembly_idx", "is_target", "record_id", "nident").first() == (3, True, "r", 90)


def test_signature_files_leave_unknown_scores_empty(spark, tmp_path):
    nan = float("nan")
    data = [(0, 3, "r", 5, 9, "ACGT", 0.5, nan, None, 2), (1, 3, None, 0, 2, "AC", nan, 0.25, 1.0, 1)]
    df = spark.createDataFrame(data, "ord int, assembly_idx int, record_id string, start int, stop int, seq string, conservation double, divergence double, rep_ratio double, n_nodes int")
    assert tables.write_signatures(df, tmp_path / "s.fasta", tmp_path / "s.csv") == 2
    head, first, second = (tmp_path / "s.csv").read_text().splitlines()
    row = dict(zip(head.split(","), first.split(","), strict=True))
    assert row["fasta_header"] == "3-r-5:9" and row["conservation"] == "0.5" and row["divergence"] == row["rep_ratio"] == row["f_tar_hits"] == ""
    assert dict(zip(head.split(","), second.split(","), strict=True)) | {"fasta_header": "3--0:2", "conservation": "", "divergence": "0.25"} == dict(zip(head.split(","), second.split(","), strict=True))
    assert (tmp_path / "s.fasta").read_text() == ">3-r-5:9\nACGT\n>3--0:2\nAC\n"


def test_odd_file_names_and_lost_files(spark, tmp_path):
    names = ["a b.fa", "c[1].fa", "d{x,y}.fa", "é%20.fa", "plus+#.fa"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text(f">r{i}\nACGT\n>r{i}\nAA\n")
    table = spark.createDataFrame([(i, str(tmp_path / n) if i % 2 else f"file://{tmp_path}/{n}") for i, n in enumerate(names)], "assembly_idx int, path string")
    got = fasta.read_fasta(spark, table)
    assert rows(got.select("assembly_idx", "record_id").distinct()) == [(i, f"r{i}") for i in range(5)]
    assert rows(fasta.repeated_names(got)) == [(i, f"r{i}", 2) for i in range(5)]
    with pytest.raises(Exception, match="nowhere"):
        fasta.read_fasta(spark, spark.createDataFrame([(0, str(tmp_path / "nowhere.fa"))], "assembly_idx int, path string")).collect()


def test_a_run_without_subgraph_is_an_error(spark, tmp_path):
    for side in ("tar", "neg"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "0.fa").write_text(">r\n" + "ACGTTGCATG" * 20 + "\n")
    c = dict(tar_dir=tmp_path / "tar", neg_dir=tmp_path / "neg", prefix=tmp_path, title="out", kmerlen=15, windowsize=10, penalty_th=0.0, run_mash=False, run_blast=False, order="hash")
    with pytest.raises(RuntimeError, match="subgraph"):
        api.run(spark, Config(**c, save_graph=True, tables=f"file://{tmp_path}/elsewhere"))
    assert (tmp_path / "elsewhere" / "graph" / "nodes").is_dir()
    with pytest.raises(ValueError):
        Config(**{**c, "order": "other"})


def test_sketches_and_search_database_are_written(spark, tmp_path):
    sk = spark.createDataFrame([(0, 5, 1), (0, 9, 2)], "assembly_idx int, hash bigint, rn int")
    tables.save_sketches(sk, str(tmp_path / "sk"), 21, 2)
    assert rows(tables.load_sketches(spark, str(tmp_path / "sk"), 21, 2)) == rows(sk)
    with pytest.raises(ValueError):
        tables.load_sketches(spark, str(tmp_path / "sk"), 17, 2)
    rec = spark.createDataFrame([(0, "a", "ACGT"), (1, None, None)], "assembly_idx int, record_id string, seq string")
    a = spark.createDataFrame([(0, True), (1, False)], "assembly_idx int, is_target boolean")
    for only, want in ((False, [">0@y@a", "ACGT", ">1@n@"]), (True, [">1@n@"])):
        tables.write_search_database(rec, a, str(tmp_path / f"db{only}"), only)
        lines = [x for p in sorted((tmp_path / f"db{only}").glob("part-*")) for x in p.read_text().splitlines() if x]
        assert sorted(lines) == sorted(want)


@pytest.mark.skipif("STRANDLINE_GOLDEN" not in os.environ, reason="no folder of known results is named")
@pytest.mark.parametrize("listed", [False, True])
def test_known_signatures_letter_for_letter(spark, tmp_path, listed):
    """$STRANDLINE_GOLDEN has targets/, non-targets/, their path lists *.txt and expected/signatures.fasta of k = 17, w = 10."""
    at = Path(os.environ["STRANDLINE_GOLDEN"])
    given = dict(tar_paths=at / "targets.txt", neg_paths=at / "non-targets.txt") if listed else dict(tar_dir=at / "targets", neg_dir=at / "non-targets")
    c = Config(**given, prefix=tmp_path, title="out", kmerlen=17, windowsize=10, min_len=17, max_len=200, run_mash=False, run_blast=False)
    api.run(spark, c)
    assert (tmp_path / "out" / "signatures.fasta").read_text() == (at / "expected" / "signatures.fasta").read_text()
