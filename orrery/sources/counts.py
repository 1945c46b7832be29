"""Strict readers of count files. They give long counts (gene, cell, value); whatever a file gets wrong is an error, never a dropped row.

Files may be gzipped; a truncated one fails in Spark's own reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Counts below this are exact in doubles; names of an axis that are broadcast at most.
LIMIT, BROADCAST_NAMES = 1 << 53, 500_000


class SourceError(ValueError):
    """A file that does not keep to its format."""


def _refuse(problems: dict[str, int | None], path: str) -> None:
    found = {k: v for k, v in problems.items() if v}
    if found:
        raise SourceError(f"{path}: {found}")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, at: the lines of one file; at grows from line to line, as Spark deals the parts of a file in their order."""
    return spark.read.text(path).withColumn("at", F.monotonically_increasing_id())


def _whole(token: Column) -> Column:
    """A token's value if it is a non-negative whole number below LIMIT, else null."""
    value = F.when(token.rlike(r"^\+?[0-9]{1,19}$"), token.try_cast("decimal(20,0)"))
    return F.when(value < F.lit(LIMIT), value.cast("double"))


def read_umi_tsv(spark: SparkSession, path: str, cells: list[str], expect_genes: int | None = None, detection: list[str] | None = None, header_offset: int = 1) -> DataFrame:
    """gene, ord, cell, value for the cells asked for, ord being their place in the request; with detection also n_detected,
    the number of those cells in which the gene occurs.

    The first line names the cells after header_offset other fields; each further line is a gene and its counts. Every
    token is checked, also those of cells that are not asked for.
    """
    lines = _lines(spark, path)
    first = lines.first()
    if first is None:
        raise SourceError(f"{path}: empty file")
    names = first.value.split("\t")[header_offset:]
    place = {c: i for i, c in enumerate(names)}
    if not names or "" in place or len(place) != len(names):
        raise SourceError(f"{path}: the header has no cells, an empty or a repeated one")
    if not cells or len(set(cells)) != len(cells) or set(cells) - set(place) or set(detection or ()) - set(place):
        raise SourceError(f"{path}: cells asked for are missing, repeated or none")
    rows = lines.where(F.col("at") > first["at"]).select(F.split("value", "\t").alias("f"))
    rows = rows.select(F.get("f", F.lit(0)).alias("gene"), F.slice("f", 2, len(names) + 2).alias("tokens"))
    values = rows.withColumn("v", F.transform("tokens", _whole))
    report = values.agg(
        F.count("*").alias("genes"), F.count_if((F.col("gene") == "") | (F.size("tokens") == 0)).alias("empty lines or genes"),
        F.count_if(F.size("tokens") != len(names)).alias("lines of another width"),
        F.count_if(F.exists("v", lambda x: x.isNull())).alias("lines with tokens that are no counts"),
        (F.count("*") - F.count_distinct("gene")).alias("repeated genes"),
    ).first().asDict()
    genes = report.pop("genes")
    _refuse({**report, "genes other than expected": expect_genes is not None and genes != expect_genes}, path)
    found = F.array(*(F.lit(place[c]) for c in detection)) if detection else None
    asked = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("cell"), F.lit(place[c]).alias("at")) for i, c in enumerate(cells)))
    extra = [F.size(F.filter(found, lambda i: F.get("v", i) > 0)).alias("n_detected")] if detection else []
    long = values.select("gene", "v", *extra, F.explode(asked).alias("c"))
    return long.select("gene", "c.ord", "c.cell", F.expr("v[c.at]").alias("value"), *([] if not detection else ["n_detected"]))


def read_mtx(spark: SparkSession, path: str, columns: list[int] | None = None, expect_columns: int | None = None, detection: list[int] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(row, col, value) for the 1-based columns asked for (all by default), entries of one place summed; and the dimensions.

    With detection, n_detected gives for each row the number of those columns with a positive entry. Banner, dimensions,
    bounds, number of entries and counts are checked.
    """
    lines = _lines(spark, path)
    banner = lines.first()
    if banner is None or banner.value.split()[:5] != ["%%MatrixMarket", "matrix", "coordinate", "integer", "general"]:
        raise SourceError(f"{path}: not an integer, general, coordinate Matrix Market file")
    sizes = lines.where(~F.ltrim("value").startswith("%")).first()
    if sizes is None or len(sizes.value.split()) != 3 or not all(x.isdigit() for x in sizes.value.split()):
        raise SourceError(f"{path}: the dimensions are not three whole numbers")
    n_rows, n_cols, nnz = map(int, sizes.value.split())
    if not n_rows or not n_cols:
        raise SourceError(f"{path}: a dimension is zero")
    asked = set(columns or ()) | set(detection or ())
    if (expect_columns is not None and n_cols != expect_columns) or any(not 1 <= c <= n_cols for c in asked) or (columns is not None and (not columns or len(set(columns)) != len(columns))):
        raise SourceError(f"{path}: columns asked for do not fit the {n_cols} there are")
    body = lines.where((F.col("at") > sizes["at"]) & ~F.ltrim("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("f"), F.col("value"))
    body = body.select("f", *(_whole(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(("row", "col", "count"))))
    fine = (F.size("f") == 3) & F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("count").isNotNull()
    report = body.agg(F.count("*").alias("n"), F.count_if(~fine).alias("lines that are no entries"), F.count_if(fine & ~(F.col("row").between(1, n_rows) & F.col("col").between(1, n_cols))).alias("entries out of bounds")).first().asDict()
    _refuse({"entries other than declared": report.pop("n") != nnz, **report}, path)
    entries = body.select(F.col("row").cast("long"), F.col("col").cast("long"), "count")
    summed = entries.groupBy("row", "col").agg(F.sum(F.col("count").cast("decimal(38,0)")).alias("value"))
    safe = F.when(F.col("value") < LIMIT, F.col("value").cast("double")).otherwise(F.raise_error(F.lit("entries of one place sum beyond exact counts")).cast("double"))
    out = summed.where(F.col("col").isin(*columns)) if columns else summed
    out = out.select("row", "col", safe.alias("value"))
    if detection:
        found = summed.where(F.col("col").isin(*detection) & (F.col("value") > 0)).groupBy("row").agg(F.count("*").alias("n_detected"))
        out = out.join(found, "row", "left").withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
    return out, {"rows": n_rows, "columns": n_cols, "entries": nnz}


def read_names(spark: SparkSession, path: str, field: int = 0) -> DataFrame:
    """at (from 1), name: a field of each line of a tab-separated file, which must be one file."""
    lines = spark.read.text(path).coalesce(1).withColumn("at", F.monotonically_increasing_id() + 1)
    return lines.select("at", F.get(F.split("value", "\t"), F.lit(field)).alias("name"))


def read_triple(spark: SparkSession, matrix: str, barcodes: str, features: str, sample: str, feature_field: int = 1) -> DataFrame:
    """gene, cell, value of a sample's matrix with its barcodes and features; cells are sample_barcode."""
    counts, sizes = read_mtx(spark, matrix)
    cells, genes = read_names(spark, barcodes), read_names(spark, features, feature_field)
    _refuse({"barcodes other than columns": cells.count() != sizes["columns"], "features other than rows": genes.count() != sizes["rows"], "repeated barcodes": cells.count() - cells.select("name").distinct().count()}, matrix)
    cells, genes = cells.select(F.col("at").alias("col"), F.col("name").alias("barcode")), genes.select(F.col("at").alias("row"), F.col("name").alias("gene"))
    few = lambda names, n: F.broadcast(names) if n <= BROADCAST_NAMES else names
    named = counts.join(few(cells, sizes["columns"]), "col").join(few(genes, sizes["rows"]), "row")
    return named.select("gene", F.concat_ws("_", F.lit(sample), "barcode").alias("cell"), "value")


def outer_union(files: list[DataFrame]) -> DataFrame:
    """Counts of several files; a gene that one lacks is zero there, which long counts leave out."""
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def inner_union(files: list[DataFrame]) -> DataFrame:
    """Counts of the genes that all files have."""
    named = [f.withColumn("__file", F.lit(i)) for i, f in enumerate(files)]
    whole = outer_union(named)
    genes = whole.groupBy("gene").agg(F.count_distinct("__file").alias("n")).where(F.col("n") == len(files))
    return whole.join(genes.select("gene"), "gene", "left_semi").drop("__file")


def read_header_block(spark: SparkSession, path: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(cell, one column per header row) and (gene, cell, value) of a matrix under a block of header rows, the first naming the cells."""
    lines = _lines(spark, path)
    head = lines.limit(rows).collect()
    if len(head) < rows:
        raise SourceError(f"{path}: fewer lines than its header has")
    names, *columns = zip(*(r.value.split("\t") for r in head), strict=True)
    cells = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], ["i", "cell", *names[1:]])
    body = lines.where(F.col("at") > head[-1]["at"]).select(F.split("value", "\t").alias("f")).select(F.get("f", F.lit(0)).alias("gene"), F.posexplode(F.expr("slice(f, 2, size(f))")).alias("i", "x"))
    at = cells.select("i", "cell")
    named = body.join(F.broadcast(at) if len(columns) <= BROADCAST_NAMES else at, "i")
    return cells.drop("i"), named.select("gene", "cell", F.col("x").try_cast("double").alias("value"))


def two_pass_top_genes(values: DataFrame, n: int, markers: list[str] = ()) -> DataFrame:
    """values of the n genes of the largest variance and of the markers."""
    from ..operators.normalize import variable_genes

    keep = variable_genes(values, n).select("gene")
    if markers:
        keep = keep.unionByName(values.sparkSession.createDataFrame([(m,) for m in markers], "gene string")).distinct()
    return values.join(keep, "gene", "left_semi")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """chrom, i, j, count with i <= j from long contact records (Parquet)."""
    c = spark.read.parquet(path)
    return c.select("chrom", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("count").cast("double").alias("count")).groupBy("chrom", "i", "j").agg(F.sum("count").alias("count"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with at, from 0, in order. Meant for axes, not for cells by gene."""
    return df.withColumn("at", F.row_number().over(Window.orderBy(order)) - 1)


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """A 10x HDF5 file cannot be read: Spark has no such source, and its library is not here."""
    raise SourceError(f"{path}: HDF5 is not read; write it as Matrix Market files (read_triple) or long Parquet first")


def read_rds(spark: SparkSession, path: str) -> DataFrame:
    """An R data file cannot be read without R."""
    raise SourceError(f"{path}: R data are not read; write them as tab-separated text (read_umi_tsv) from R first")
