"""Formats, catalog and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from rangeloom.plans.catalog import Database
from rangeloom.sources import formats as fm
from rangeloom.sources import motifs
from rangeloom.streaming.ingest import stream_bins, write_track


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_interval_formats(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "track name=x\n#c\nchr1\t1\t5\tn\t3.5\t-\nchr2\t7\t9\n")
    assert [tuple(r) for r in fm.read_bed(spark, bed).orderBy("chrom").collect()] == [("chr1", 1, 5, "n", 3.5, -1), ("chr2", 7, 9, None, None, 0)]
    gff = put(tmp_path, "a.gff", "c\ts\tgene\t10\t20\t.\t+\t.\tid=1\nc\ts\texon\t11\t12\t.\t-\t.\tid=2\n")
    assert [(r.start, r.end, r.strand) for r in fm.read_gff(spark, gff, "gene").collect()] == [(9, 20, 1)]
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\nc\t5\trs\tACG\tA\t9\tPASS\tX=1\n")
    assert [(r.start, r.end, r.ref) for r in fm.read_vcf(spark, vcf).collect()] == [(4, 7, "ACG")]
    wig = put(tmp_path, "a.wig", "track type=wiggle_0\nfixedStep chrom=c start=11 step=5 span=2\n1\n2.5\nvariableStep chrom=d\n7 3\n9 4\n")
    assert sorted(tuple(r) for r in fm.read_wig(spark, wig).collect()) == [("c", 10, 12, 1.0), ("c", 15, 17, 2.5), ("d", 6, 7, 3.0), ("d", 8, 9, 4.0)]
    sam = put(tmp_path, "a.sam", "@HD\nr\t16\tc\t10\t9\t4M\t*\t0\t0\tACGT\tIIII\nr\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    assert [tuple(r) for r in fm.read_sam(spark, sam).collect()] == [("c", 9, -1, 4)]


def test_bedgraph_and_fasta(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 6, 1.5), ("a", 1, 2, None), ("a", 2, 4, float("nan"))], "chrom string, start long, end long, value double")
    fm.write_bedgraph(rows, str(tmp_path / "bg"))
    assert [tuple(r) for r in fm.read_bedgraph(spark, str(tmp_path / "bg")).collect()] == [("a", 5, 6, 1.5)]
    fasta = put(tmp_path, "a.fa", ">one desc\nACGTA\nCG\n>two\nTTTT\n")
    chunks = fm.read_fasta(spark, fasta, 4)
    assert sorted(tuple(r) for r in chunks.collect()) == [("one", 0, "ACGT"), ("one", 4, "ACG"), ("two", 0, "TTTT")]
    asked = spark.createDataFrame([("one", 2, 6, 1), ("one", 2, 6, -1), ("two", 0, 1, 1)], "chrom string, start long, end long, strand int")
    assert sorted(r.seq for r in fm.extract_sequence(chunks, asked, 4).collect()) == ["GTAC", "GTAC", "T"]
    fm.write_fasta(fm.read_fasta(spark, fasta, 1 << 20), str(tmp_path / "out"), 4)
    assert sorted(tuple(r) for r in fm.read_fasta(spark, str(tmp_path / "out")).collect()) == [("one", 0, "ACGTACG"), ("two", 0, "TTTT")]


def test_chain_and_motifs(spark, tmp_path):
    chain = put(tmp_path, "a.chain", "chain 100 o 1000 + 0 30 n 500 - 10 45 7\n10 5 10\n15\n\nchain 50 o 1000 + 100 110 n 500 + 0 10 8\n10\n\n")
    got = sorted((r.chain_id, r.startsrc, r.endsrc, r.start, r.end, r.strand) for r in fm.read_chain(spark, chain).collect())
    assert got == [(7, 0, 10, 480, 490, -1), (7, 15, 30, 455, 470, -1), (8, 100, 110, 0, 10, 1)]
    meme = put(tmp_path, "a.meme", "MEME version 4\n\nMOTIF m1 alt\nletter-probability matrix: alength= 4 w= 2\n 0.5 0.5 0 0\n 0 0 1 0\n\nMOTIF m2\nletter-probability matrix:\n 0.25 0.25 0.25 0.25\n")
    assert [(m.name, len(m.matrix)) for m in motifs.read_meme(spark, meme)] == [("m1", 2), ("m2", 1)]
    jaspar = put(tmp_path, "a.jaspar", ">MA1 X\nA [ 1 0 ]\nC [ 0 4 ]\nG [ 3 0 ]\nT [ 0 0 ]\n")
    assert motifs.read_jaspar(spark, jaspar)[0].matrix == ((0.25, 0.0, 0.75, 0.0), (0.0, 1.0, 0.0, 0.0))
    homer = put(tmp_path, "a.homer", ">ACG\tname\t6\n0.1\t0.2\t0.3\t0.4\n")
    assert motifs.read_homer(spark, homer)[0].name == "name"


def test_catalog(spark, tmp_path):
    chroms = spark.createDataFrame([(0, "a", 100)], "chrom_id int, chrom string, size long")
    db = Database.create(spark, str(tmp_path / "db"), chroms)
    db.save_dense("x.d", spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], "chrom string, bin long, value double"), 50)
    db.save("intervals", "i", spark.createDataFrame([("a", 1, 5)], "chrom string, start long, end long"))
    db.set_attribute("track", "x.d", "note", "hello")
    db.set_variable("x.d", "k", [1, 2])
    again = Database(spark, str(tmp_path / "db"))
    assert again.ls() == ["x.d"] and again.ls(note="^hel") == ["x.d"] and again.ls(note="no") == [] and again.variable("x.d", "k") == [1, 2]
    assert again.workspace().tracks["x.d"].bin_size == 50 and again.table("intervals", "i").count() == 1 and again.info()["size"] == 100
    with pytest.raises(ValueError):
        again.set_attribute("track", "x.d", "created.by", "me")
    again.mv("track", "x.d", "y")
    assert again.ls() == ["y"] and again.attribute("track", "y", "note") == "hello"
    other = Database.create_linked(spark, str(tmp_path / "other"), again)
    other.attach(again)
    assert other.where("track", "y") == [again.path] and other.track("y").data.count() == 2
    assert again.attributes().first()["note"] == "hello"


def test_stream(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:{m:02d}:10Z", "k": "a", "v": float(m)} for m in range(20)] + [{"ts": "2024-01-01T02:00:00Z", "k": "b", "v": 1.0}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "ts timestamp, k string, v double"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    write_track(stream_bins(stream, "k", "ts", "v", 300, origin="2024-01-01"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.chrom, r.bin): (r.value, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a", 0] == (2.0, 5) and got["a", 3] == (17.0, 5)
    batch = stream_bins(spark.read.schema(schema).json(str(tmp_path / "in")), "k", "ts", "v", 300, origin="2024-01-01")
    assert batch.count() == 5 and batch.where(F.col("chrom") == "b").first().n == 1
