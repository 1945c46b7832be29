"""Readers of annotation texts: delimited tables, series matrices, sample descriptions, header labels, inferred-copy-number blocks, workbook cells."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table by an explicit schema; without one every column is a string, so that ids keep their zeros."""
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "FAILFAST").option("enforceSchema", not header)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_spaced(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table parted by runs of white space, all strings; a line of another width is an error."""
    f = F.split(F.trim("value"), r"\s+")
    line = F.when(F.size(f) == len(columns), f).otherwise(F.raise_error(F.lit("a line of another width")).cast("array<string>"))
    return spark.read.text(path).select(line.alias("f")).select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def header_label(column: Column, part: int = 1, missing: str = "NA") -> Column:
    """A part of `barcode__type__colour`; missing where there is none."""
    return F.coalesce(F.get(F.split(column, "__"), F.lit(part)), F.lit(missing))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).coalesce(1).withColumn("at", F.monotonically_increasing_id())


def read_series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample, characteristic, value: `!Sample_characteristics_ch1` lines against the samples' titles or accessions."""
    lines = _lines(spark, path)
    def cells(prefix):
        return lines.where(F.col("value").startswith(prefix)).select("at", F.posexplode(F.transform(F.expr("slice(split(value, '\\t'), 2, size(split(value, '\\t')))"), lambda x: F.trim(F.translate(x, '"', "")))).alias("i", "x"))
    names = cells("!Sample_geo_accession").select("i", F.col("x").alias("sample"))
    found = cells("!Sample_characteristics_ch1").select("i", F.trim(F.regexp_extract("x", r"^([^:]*):", 1)).alias("characteristic"), F.trim(F.regexp_replace("x", r"^[^:]*:", "")).alias("value"))
    return found.where("characteristic <> ''").join(names, "i").select("sample", "characteristic", "value")


def read_soft(spark: SparkSession, path: str, donor: str = r"[Dd]onor[: ]+(\S+)") -> DataFrame:
    """sample, title, donor, file of each `^SAMPLE` of a description file; each line belongs to the sample last named."""
    by = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(spark, path).withColumn("sample", F.last(F.when(F.col("value").startswith("^SAMPLE"), F.trim(F.regexp_extract("value", r"=\s*(.*)$", 1))), ignorenulls=True).over(by))
    def field(name):
        return F.max(F.when(F.col("value").startswith(name), F.trim(F.regexp_extract("value", r"=\s*(.*)$", 1))))
    return lines.where("sample is not null").groupBy("sample").agg(field("!Sample_title").alias("title"), F.max(F.when(F.regexp_extract("value", donor, 1) != "", F.regexp_extract("value", donor, 1))).alias("donor"), field("!Sample_supplementary_file").alias("file"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """sample, cluster of the tumour blocks of a listing: a line `sample: name`, then lines of cluster numbers parted by commas."""
    by = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = F.trim(F.regexp_extract("value", r"^\s*[Ss]ample\s*[:=]\s*(\S+)", 1))
    lines = _lines(spark, path).withColumn("sample", F.last(F.when(named != "", named), ignorenulls=True).over(by)).where(named == "")
    return lines.where("sample is not null and value rlike '[0-9]'").select("sample", F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1)).alias("cluster")).withColumn("cluster", F.col("cluster").cast("int")).distinct()


def read_cell_lines(spark: SparkSession, path: str, prefix: str = "Sample ", least: int = 7, tag: int = 4) -> DataFrame:
    """fields, patient, state of the lines with the prefix and at least so many fields; the tag field reads `state_patient`."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").startswith(prefix) & (F.size(f) >= least)).select(f.alias("fields"))
    parts = F.split(F.get("fields", F.lit(tag)), "_", 2)
    return rows.select("fields", F.get(parts, F.lit(1)).alias("patient"), F.get(parts, F.lit(0)).alias("state"))


def read_pairs(spark: SparkSession, pattern: str, suffix: str) -> DataFrame:
    """value, sample: lines of every file that a glob finds, with the sample that its name begins with."""
    return spark.read.text(pattern).select("value", F.regexp_extract(F.input_file_name(), rf"([^/]+?)_[^/_]*\.{suffix}(?:\.txt)?(?:\.gz)?$", 1).alias("sample"))


def spatial_pair(expression: DataFrame, places: DataFrame, key: str, blank: str = "blank") -> DataFrame:
    """Cells that both tables have, without the probes that are blanks."""
    kept = [c for c in expression.columns if not c.lower().startswith(blank)]
    return expression.select(*kept).join(places, key)


def workbook_rows(path: str, sheet: int = 1) -> list[list[str]]:
    """Cells of a sheet of an OOXML workbook, as strings; driver side."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        out = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{space}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{space}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                value = c.find(f"{space}v")
                inline = "".join(t.text or "" for t in c.iter(f"{space}t"))
                cells[at - 1] = inline if value is None else strings[int(value.text)] if c.get("t") == "s" else value.text or ""
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out
