import json

from pyspark.sql import functions as F

from strandlake import sql
from strandlake.sources import readers, writers
from strandlake.streaming import windowed_counts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first one\nACGT\nrynn\n>chr2:5-9\r\nAC\r\nGT\r\n>empty\n")
    got = {r.name: (r.description, r.seq) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"chr1": ("first one", "ACGTNNNN"), "chr2:5-9": ("", "ACGT"), "empty": ("", "")}
    assert [r.name for r in readers.fasta(spark, str(tmp_path / "a.fa"), F.col("name") == "chr1").collect()] == ["chr1"]
    row = spark.sql("SELECT '>chr7:100-200 x' h").select(readers.locus(F.col("h")).alias("l")).first().l
    assert (row.chrom, row.start, row.end) == ("chr7", 100, 200)


def test_panel_and_tables(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("Name\tForward_Primer\tREVERSE\tleft_start\nx\tacgt\tTTTT\t5\n")
    row = readers.panel(spark, str(tmp_path / "p.tsv")).first()
    assert (row.pair_id, row.primer1, row.primer2, row.left_start) == ("x", "ACGT", "TTTT", 5)
    (tmp_path / "g.gtf").write_text('#c\nchr1\ts\tgene\t11\t20\t.\t+\t.\tgene_type "unprocessed_pseudogene"; gene_name "A";\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_type "protein_coding"; gene_name "B";\nchr1\ts\texon\t3\t5\t.\t+\t.\tgene_name "B"; transcript_id "T";\n')
    assert [tuple(r) for r in readers.pseudogenes(spark, str(tmp_path / "g.gtf")).collect()] == [("chr1", 10, 20, "A")]
    assert [tuple(r) for r in readers.exons(spark, str(tmp_path / "g.gtf")).collect()] == [("chr1", 2, 5, "B", "T")]
    (tmp_path / "s.tsv").write_text("bin\tchrom\tchromStart\tchromEnd\tname\n1\tchr1\t5\t9\tn\n")
    assert [tuple(r) for r in readers.segmental_duplications(spark, str(tmp_path / "s.tsv")).collect()] == [("chr1", 5, 9, "n")]
    assert readers.intervals(spark, None).count() == 0


def test_sam_and_blast(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\nq1\t16\tchr1\t11\t0\t4M\t*\t0\t0\tACGT\t*\tNM:i:1\tXA:Z:chr2,+21,4M,2;chr3,-5,4M,0;\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = sorted((r.query, r.chrom, r.start, r.strand, r.mismatches) for r in readers.sam(spark, str(tmp_path / "x.sam")).collect())
    assert got == [("q1", "chr1", 10, "-", 1), ("q1", "chr2", 20, "+", 2), ("q1", "chr3", 4, "-", 0)]
    (tmp_path / "x.b").write_text("q\tchr1\t100\t4\t1\t0\t1\t4\t14\t11\t1\t2\n")
    r = readers.blast(spark, str(tmp_path / "x.b")).first()
    assert (r.chrom, r.start, r.end, r.strand) == ("chr1", 10, 14, "-")


def test_caches_and_manifests(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"_region": "chr1:5-9"}\n{"chrom": "chr1", "pos": 6, "ref": "A", "alt": "C", "af": 0.1}\n')
    v, regions = readers.variant_cache(spark, str(tmp_path / "v.jsonl"))
    assert v.count() == 1 and tuple(regions.first()) == ("chr1", 5, 9)
    m = spark.createDataFrame([("1", 5, "a" * 64, "BUILT"), ("2", 0, "a" * 64, "BUILT"), ("3", 5, "x", "BUILT"), ("4", 5, "a" * 64, "NO"), ("5", 5, "a" * 64, "BUILT"), ("5", 5, "a" * 64, "BUILT")], "chromosome string, file_bytes long, sha256 string, status string")
    assert sorted((r.chromosome, r.fault) for r in readers.manifest_faults(m).collect()) == [("2", "empty"), ("3", "digest"), ("4", "status"), ("5", "repeated"), ("5", "repeated")]


def test_gnomad(spark):
    from strandlake.plans.variants import parsed_gnomad

    one = {"data": {"region": {"variants": [{"chrom": "1", "pos": 5, "ref": "A", "alt": "C", "genome": {"af": 0.1, "ac": 1, "an": 10, "populations": [{"id": "x", "ac": 1, "an": 4}, {"id": "y", "ac": 0, "an": 0}]}}, {"chrom": "1", "pos": 6, "ref": "A", "alt": "C", "exome": {"ac": 1, "an": 10}}]}}}
    got = spark.createDataFrame([(json.dumps(one),)], "j string").select(F.inline(parsed_gnomad(F.col("j")))).collect()
    assert [(r.pos, r.af, r.pop_af) for r in got] == [(5, 0.1, {"x": 0.25})]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", [1, 2])], "b int, a string, c array<int>")
    writers.json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"a<b","b":1,"c":[1,2]}'
    writers.tsv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().c == "[1,2]"
    assert "a&lt;b" in writers.html_report(df, "T") and writers.contract(df.drop("c")).count() == 2


def test_sql_and_windows(spark):
    assert "dna_dimer" in sql.register(spark)
    row = spark.sql("SELECT dna_reverse_complement('AACG') r, dna_gc_fraction('AACG') g, dna_hamming('AC', 'AG') h, dna_dimer('GGGG', 'CCCC').found f").first()
    assert tuple(row) == ("CGTT", 0.5, 1, True)
    assert len(spark.sql("SELECT dna_melt_curve('ACGTACGT') c").first().c) == 193
    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a'")
    assert windowed_counts(e, "ts", "k").first().n == 2


def test_windows_on_a_stream(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a'")
    e.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").first().n == 2
