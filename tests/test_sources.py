import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from orrery.sources import counts, metadata
from orrery.streaming.patients import arm_counts, from_parquet


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_series_matrix(spark, tmp_path):
    path = put(tmp_path, "s.txt", '!Sample_geo_accession\t"GSM1"\t"GSM2"\n!Sample_characteristics_ch1\t"tissue: lung"\t"tissue: node"\n!Sample_characteristics_ch1\t"age: 7"\t"bare"\nx\t1\t2\n')
    got = {tuple(r) for r in metadata.read_series_matrix(spark, path).collect()}
    assert got == {("GSM1", "tissue", "lung"), ("GSM2", "tissue", "node"), ("GSM1", "age", "7")}


def test_descriptions_carry_their_sample_forward(spark, tmp_path):
    path = put(tmp_path, "soft.txt", "^SERIES = X\n^SAMPLE = GSM1\n!Sample_title = one\n!Sample_characteristics_ch1 = donor: 007\n^SAMPLE = GSM2\n!Sample_title = two\n!Sample_supplementary_file = f.gz\n")
    got = {tuple(r) for r in metadata.read_soft(spark, path).collect()}
    assert got == {("GSM1", "one", "007", None), ("GSM2", "two", None, "f.gz")}


def test_blocks_and_cell_lines(spark, tmp_path):
    blocks = put(tmp_path, "b.txt", "Sample: s1\n1, 2\n2\nsample = s2\n10\n")
    assert {tuple(r) for r in metadata.read_blocks(spark, blocks).collect()} == {("s1", 1), ("s1", 2), ("s2", 10)}
    lines = put(tmp_path, "c.txt", "head\nSample 1\ta\tb\tc\tPre_P1_2\tx\ty\nSample 2\tshort\n")
    assert [(r.patient, r.state) for r in metadata.read_cell_lines(spark, lines).collect()] == [("P1_2", "Pre")]


def test_ids_keep_their_zeros_and_widths_are_checked(spark, tmp_path):
    assert metadata.read_delimited(spark, put(tmp_path, "t.tsv", "patient\tlabel\n007\tx\n")).first().patient == "007"
    assert metadata.read_spaced(spark, put(tmp_path, "w.txt", "  a   b \n"), ["x", "y"]).first().y == "b"
    with pytest.raises(Exception, match="width"):
        metadata.read_spaced(spark, put(tmp_path, "v.txt", "a b c\n"), ["x", "y"]).collect()


def test_header_block_and_labels(spark, tmp_path):
    cells, values = counts.read_header_block(spark, put(tmp_path, "h.txt", "cell\tc1__T__red\tc2\ntumour\t1\t0\ng1\t0.5\t2\n"), 2)
    assert {(r.cell, r.tumour) for r in cells.collect()} == {("c1__T__red", "1"), ("c2", "0")}
    assert {tuple(r) for r in values.collect()} == {("g1", "c1__T__red", 0.5), ("g1", "c2", 2.0)}
    assert {r[0] for r in cells.select(metadata.header_label(F.col("cell"))).collect()} == {"T", "NA"}


def test_triple_and_unions(spark, tmp_path):
    put(tmp_path, "m.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 5\n2 2 7\n")
    put(tmp_path, "b.tsv", "AA\nCC\n")
    put(tmp_path, "f.tsv", "id1\tg1\nid2\tg2\n")
    got = counts.read_triple(spark, *(str(tmp_path / n) for n in ("m.mtx", "b.tsv", "f.tsv")), "s")
    assert {tuple(r) for r in got.collect()} == {("g1", "s_AA", 5.0), ("g2", "s_CC", 7.0)}
    other = spark.createDataFrame([("g1", "t_AA", 1.0)], "gene string, cell string, value double")
    assert counts.outer_union([got, other]).count() == 3
    assert {r.gene for r in counts.inner_union([got, other]).collect()} == {"g1"}


def test_truncated_gzip_fails(spark, tmp_path):
    whole = gzip.compress(("gene\tc1\n" + "".join(f"g{i}\t{i}\n" for i in range(50_000))).encode())
    (tmp_path / "t.tsv.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        counts.read_umi_tsv(spark, str(tmp_path / "t.tsv.gz"), ["c1"]).count()


def test_workbook(tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"><v>007</v></c></row></sheetData></worksheet>')
    assert metadata.workbook_rows(str(tmp_path / "w.xlsx")) == [["name", "", "ab"], ["", "007"]]


def test_counts_over_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 5 as patient", "timestamp_seconds(1600000000 + id * 3600) as ts", "if(id % 3 = 0, 'a', 'b') as arm")
    for i in range(3):
        rows.where(f"patient % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    is_a, is_b = F.col("arm") == "a", F.col("arm") == "b"
    stream = arm_counts(from_parquet(spark, str(tmp_path / "in"), "patient long, ts timestamp, arm string"), "patient", "ts", is_a, is_b, late="30 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("arms").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("arms").collect()} == {tuple(r) for r in arm_counts(rows, "patient", "ts", is_a, is_b).collect()}


def test_umi_table_by_position(spark, tmp_path):
    """A gene whose line repeats the header is a faulty line, not a second header; many small parts of a file keep their order."""
    rng = random.Random(1)
    cells = [f"c{i}" for i in range(40)]
    values = {f"g{g}": [rng.choice([0, 0, 1, 7]) for _ in cells] for g in range(3000)}
    text = "\t".join(["gene", *cells]) + "\n" + "".join("\t".join([g, *map(str, v)]) + "\n" for g, v in values.items())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = counts.read_umi_tsv(spark, put(tmp_path, "u.tsv", text), ["c5", "c1"], 3000, ["c5", "c1", "c9"]).collect()
        mtx = "%%MatrixMarket matrix coordinate integer general\n" + "% note\n" * 300 + "3000 40 2999\n" + "".join(f"{i} {1 + i % 40} {i}\n" for i in range(1, 3000))
        whole, sizes = counts.read_mtx(spark, put(tmp_path, "u.mtx", mtx))
        assert {tuple(r) for r in whole.collect()} == {(i, 1 + i % 40, float(i)) for i in range(1, 3000)} and sizes["entries"] == 2999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.gene, r.ord, r.cell): (r.value, r.n_detected) for r in got} == {(g, i, c): (float(v[cells.index(c)]), sum(v[k] > 0 for k in (5, 1, 9))) for g, v in values.items() for i, c in enumerate(["c5", "c1"])}
    with pytest.raises(counts.SourceError, match="no counts"):
        counts.read_umi_tsv(spark, put(tmp_path, "v.tsv", "gene\ta\ng1\t1\ngene\ta\n"), ["a"])


@pytest.mark.parametrize("text", ["", "%%MatrixMarket matrix array integer general\n1 1 1\n1 1 1\n", "%%MatrixMarket matrix coordinate integer general\n", "%%MatrixMarket matrix coordinate integer general\n0 1 0\n", "%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 5\n", "%%MatrixMarket matrix coordinate integer general\n2 2 1\n3 1 5\n", "%%MatrixMarket matrix coordinate integer general\n2 2 1\n1 1 -5\n"])
def test_faulty_matrices_are_refused(spark, tmp_path, text):
    with pytest.raises(counts.SourceError):
        counts.read_mtx(spark, put(tmp_path, "x.mtx", text))
