"""Readers, sketch sets on disk, reports and the stream."""

import bz2
import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchlake.operators import readwise as R
from sketchlake.operators import sketch as K
from sketchlake.plans import reports
from sketchlake.sources import fastx, sequences
from sketchlake.functions import reads_qc
from sketchlake.sources.store import Layout, SketchSet, open_index, read_taxmap, replay_reads, write_index, write_read_cache
from sketchlake.streaming import profile as stream

FASTA = ">a first\nACGT\nAC\n\n>b\nGG\n"
FASTQ = "@r1 x\nACGT\n+\nII@I\n@r2\nGG\n+r2\n>I\n"


def test_records_of_all_formats(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    (tmp_path / "z.fasta.bz2").write_bytes(bz2.compress(FASTA.encode()))
    (tmp_path / "note.txt").write_text("no")
    spark.dataSource.register(fastx.FastxSource)
    rows = spark.read.format("fastx").load(str(tmp_path)).collect()
    got = sorted((r["path"].rpartition("/")[2], r["record_ord"], r["name"], r["comment"], r["seq"], r["qual"]) for r in rows)
    fa = [(0, "a", "first", "ACGTAC", None), (1, "b", "", "GG", None)]
    assert got == sorted([("x.fa", *r) for r in fa] + [("z.fasta.bz2", *r) for r in fa] + [("y.fq.gz", 0, "r1", "x", "ACGT", "II@I"), ("y.fq.gz", 1, "r2", "", "GG", ">I")])
    assert fastx.records_of(spark, str(tmp_path / "*.gz")).count() == 2


def test_windows_split_records_and_density(spark):
    records = spark.createDataFrame([("p", 0, "ACGTTGCA" * 10), ("p", 1, "TTTTACGA" * 9), ("q", 0, None)], "path string, record_ord long, seq string")
    each = sequences.split_records(records)
    assert sorted(r["gid"] for r in each.collect()) == [0, 1, 2]
    found = sequences.windows(each)
    assert {r["gid"]: r["n"] for r in found.groupBy("gid").agg(F.count("*").alias("n")).collect()} == {0: 80 - 31, 1: 72 - 31}
    cut = 1 << 43
    assert sequences.windows(each, threshold=cut).count() == found.where(F.col("hctx") <= cut).count()
    assert sequences.entries(sequences.windows(sequences.as_one(records))).select("gid").distinct().count() == 1


def test_sketch_set_round_trip_and_layout_check(spark, tmp_path):
    entries = spark.createDataFrame([(0, 5, 1, 1), (1, 6, 2, 1)], "gid long, hctx long, obj int, cnt long")
    kept = SketchSet(entries, entries.select("gid").distinct(), Layout(100))
    kept.save(str(tmp_path / "s"))
    back = SketchSet.load(spark, str(tmp_path / "s"))
    assert back.layout == kept.layout and sorted(map(tuple, back.entries.collect())) == sorted(map(tuple, entries.collect()))
    back.require(kept)


def test_taxmap_skips_header_and_comments(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#c\nref_key\tTAXID\tRANK\tTAXPATH\tTAXPATHSN\na\t1\tspecies\t2|1\tB|A\nb\t3\tgenus\t3\tC\tg\to\n")
    rows = read_taxmap(spark, str(tmp_path / "t.tsv")).orderBy("ref_key").collect()
    assert [(r["ref_key"], r["taxid"], r["otu"]) for r in rows] == [("a", "1", None), ("b", "3", "o")]


def test_phylip_lines(spark):
    matrix = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.0)], "row long, col long, distance double")
    lines = [r["line"] for r in reports.phylip_lines(matrix, spark.createDataFrame([(0,), (1,)], "gid long")).orderBy("ord").collect()]
    assert lines == ["2", "S000000001 0.000000 0.500000", "S000000002 0.500000 0.000000"]


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    ref = spark.createDataFrame([(g, h, (g * h) % 16) for g in range(3) for h in range(20) if (g + h) % 3], "gid long, hctx long, obj int")
    reads = spark.createDataFrame([(u, (u * 7 + k) % 20, (u + k) % 16) for u in range(60) for k in range(3)], "unit long, hctx long, obj int")
    for part in range(3):
        reads.where(F.col("unit") % 3 == part).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{part}"))
    source = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.profile_stream(source, ref, "best-diff-split", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(map(tuple, stream.current_coverage(spark, str(tmp_path / "out")).select("gid", "hctx", "cov", "diff", "weight").collect()))
    assert got == sorted(map(tuple, R.coverage(R.assign(R.candidates(reads, ref), "best-diff-split")).collect()))


def test_percentile_cutoff_by_hand(spark):
    rows = spark.createDataFrame([(0, i, 0, c) for i, c in enumerate([1, 1, 2, 3, 10])] + [(1, 0, 0, 1)], "gid long, hctx long, obj int, cnt long")
    assert {r["gid"]: r["cutoff"] for r in K.percentile_cutoffs(rows, 0.4).collect()} == {0: 3, 1: 1}
    assert {r["gid"]: r["cutoff"] for r in K.percentile_cutoffs(rows, 0.9, base=2, cap=4).collect()} == {0: 4, 1: 2}


def fastq(seed, n, wrap=None, end="\n"):
    """Records whose qualities often begin with @, + or >."""
    dice = random.Random(seed)
    out = []
    for i in range(n):
        k = dice.choice([0, 1, 5, 37, 90])
        seq, qual = "".join(dice.choice("ACGTN") for _ in range(k)), "".join(dice.choice("@+>IJ") for _ in range(k))
        cut = lambda s: end.join(s[j : j + wrap] for j in range(0, len(s), wrap)) if wrap and s else s
        out.append(f"@r{i} note {i}{end}{cut(seq)}{end}+{dice.choice(['', f'r{i}'])}{end}{cut(qual)}{end}")
    return "".join(out)


@pytest.mark.parametrize("split", [7, 40, 333, 1 << 20])
def test_ranges_of_plain_files_give_the_records_of_one_reader(spark, tmp_path, split):
    (tmp_path / "a.fq").write_bytes(fastq(1, 60).encode())
    (tmp_path / "b.fastq").write_bytes(fastq(2, 40, end="\r\n").encode())
    (tmp_path / "c.fa").write_text("".join(f">s{i} x\n" + "\n".join("ACGT" * (i % 5 + 1) for _ in range(i % 4)) + "\n" for i in range(30)))
    (tmp_path / "d.fa").write_text("")
    (tmp_path / "e.fa").write_text(">one\n" + "ACGTACGT\n" * 200)
    whole = []
    for name in ("a.fq", "b.fastq", "c.fa", "d.fa", "e.fa"):
        with open(tmp_path / name, newline="\n") as lines:
            whole += [(name, i, *r) for i, r in enumerate(fastx.parse(lines))]
    got = fastx.split_records(spark, str(tmp_path), split)
    assert sorted((r.path.rpartition("/")[2], r.record_ord, r.name, r.comment, r.seq, r.qual or (None if r.qual is None else "")) for r in got.collect()) == sorted(whole)


def test_a_large_plain_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "big.fq").write_bytes(fastq(3, 3000).encode())
    rows = fastx.split_records(spark, str(tmp_path / "big.fq"), 20_000)
    assert rows.count() == 3000 and rows.select("record_ord").distinct().count() == 3000
    ranges = [len(list(fastx.range_records(str(tmp_path / "big.fq"), at, at + 20_000))) for at in range(0, (tmp_path / "big.fq").stat().st_size, 20_000)]
    assert len(ranges) > 10 and min(ranges) > 20 and sum(ranges) == 3000
    with pytest.raises(ValueError, match="compressed"):
        fastx.split_records(spark, str(tmp_path / "x.fq.gz"))


def test_read_cache_replays_and_checks_its_stamp(spark, tmp_path):
    reads = spark.createDataFrame([(u, h, u % 3) for u in range(50) for h in range(u % 7)], "unit long, hctx long, obj int").repartition(3)
    path = str(tmp_path / "cache")
    stamp = write_read_cache(reads.union(reads), 50, 4, path)
    rows, held = replay_reads(spark, path, 4)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, reads.where("hctx <= 4").collect()))
    assert held == stamp and (stamp.total_reads, stamp.density_reads) == (50, reads.where("hctx <= 4").select("unit").distinct().count())
    with pytest.raises(ValueError, match="threshold"):
        replay_reads(spark, path, 5)
    with pytest.raises(ValueError, match="obj_bits"):
        replay_reads(spark, path, 4, obj_bits=26)


def test_joins_with_an_index_do_not_shuffle_it(spark, tmp_path, capsys):
    ref = spark.createDataFrame([(g, h, g) for g in range(5) for h in range(40) if (g + h) % 3], "gid long, hctx long, obj int")
    write_index(ref, "index_of_test", 8, str(tmp_path / "index"))
    index = open_index(spark, "index_of_test")
    reads = spark.createDataFrame([(u, u % 40, 1) for u in range(300)], "unit long, hctx long, obj int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.candidates(reads, index)
        found.explain()
        plan = capsys.readouterr().out
        own = plan[plan.index("FileScan") - 900 : plan.index("FileScan")]
        assert "Bucketed: true" in plan and "Exchange" not in own.split("SortMergeJoin")[-1].split(":- ")[-1].split("+- Sort [hctx")[-1]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.candidates(reads, ref).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table index_of_test")
    with pytest.raises(ValueError, match="index"):
        reads.write.saveAsTable("no_index_of_test", path=str(tmp_path / "other"))
        open_index(spark, "no_index_of_test")


def test_range_of_counts_comes_from_the_wide_sample(spark):
    dice = random.Random(6)
    rows = [(g, h, 0, max(1, round(dice.gauss(20, 4))) if dice.random() < 0.8 else dice.choice([1, 1, 2, 90])) for g in range(2) for h in range(600)]
    entries = spark.createDataFrame(rows, "gid long, hctx long, obj int, cnt long")
    sketch, ranges = reads_qc.qc_sketch(entries, 40, 10)
    held = {r.gid: (r.lower, r.upper) for r in ranges.collect()}
    for g in range(2):
        wide = sorted((h, c) for i, h, _, c in rows if i == g)[:400]
        counts, n = np.unique([c for _, c in wide], return_counts=True)
        want = reads_qc.infer_range(counts, n)
        assert held[g] == (want.lower, want.upper)
        assert sorted(r.hctx for r in sketch.where(f"gid = {g}").collect()) == [h for h, c in wide if want.lower <= c <= want.upper][:40]
