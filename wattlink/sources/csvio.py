"""CSV in and out: UTF-8 with byte order mark, header row, all columns text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wattlink import constants as K
from wattlink.functions.text import JS_SPACE, strip, text
from wattlink.sources.csvlines import BOM, read_records

_DIALECT = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_text_csv(spark: SparkSession, path: str, line_breaks: bool = True, **options) -> DataFrame:
    """Header CSV with every column as text. Quoted line breaks stay inside their cell.

    Large files are split either way; `line_breaks=False` saves the pass that finds which line breaks
    stand in cells, and takes further reader options.
    """
    if line_breaks and not options:
        return read_records(spark, path)
    return spark.read.options(**_DIALECT | {"multiLine": line_breaks}, inferSchema=False, **options).csv(path)


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows; a missing file gives none, missing columns are null, and so are cells that
    hold a missing-value word."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in K.REGISTRY_COLUMNS]))
    df = read_text_csv(spark, path)

    def column(name):
        if name not in df.columns:
            return F.lit(None).cast("string").alias(name)
        return F.when(~F.col(name).isin(K.PANDAS_NA_WORDS), F.col(name)).alias(name)

    return df.select(*[column(c) for c in K.REGISTRY_COLUMNS])


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strict import file: cells trimmed, empty lines skipped, a ragged row fails the whole file.
    Rows are numbered from 1 in file order as `row_no`; several files follow each other by path."""
    df = read_records(spark, path, strict=True, trimmed=True, number="_no")
    return df.select(*[strip(F.col(f"`{c}`"), JS_SPACE).alias(strip_name(c)) for c in df.columns if c != "_no"],
                     F.col("_no").alias("row_no"))


def strip_name(name: str) -> str:
    return name.strip().lstrip(BOM)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write a folder of CSV parts, each with a header that starts with a byte order mark."""
    columns = columns or df.columns
    out = df.select(*[text(F.col(f"`{c}`")).alias(c) for c in columns])
    marked = out.withColumnRenamed(columns[0], BOM + columns[0])
    marked.write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def append_csv(spark: SparkSession, path: str, rows: DataFrame, columns: list[str]) -> None:
    """Add rows to a CSV folder as further parts."""
    out = rows.select(*[text(F.col(f"`{c}`")).alias(c) for c in columns]).withColumnRenamed(columns[0], BOM + columns[0])
    out.write.mode("append").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def recognition_export(view: DataFrame) -> DataFrame:
    """Recognition view as the columns of the export file."""
    names = ["original_image", "province_name", "city", "longitude", "latitude", "poi"]
    return view.select(*[text(n).alias(c) for n, c in zip(names, K.POI_OUTPUT_COLUMNS)])


def csv_lines(df: DataFrame) -> DataFrame:
    """One column `line`: cells quoted only where they hold a quote, a comma or a line break."""
    def cell(c):
        t = text(F.col(f"`{c}`"))
        quoted = F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(t.rlike('[",\n]'), quoted).otherwise(t)

    cells = reduce(lambda a, b: a + [F.lit(","), b], [cell(c) for c in df.columns[1:]], [cell(df.columns[0])])
    return df.select(F.concat(*cells).alias("line"))


def write_export(df: DataFrame, path: str) -> None:
    """The export file as parts that follow each other by name: a byte order mark and the header line,
    then the rows, quoted only where needed."""
    header = df.sparkSession.createDataFrame([(BOM + ",".join(_cell(c) for c in df.columns),)], "line string").coalesce(1)
    header.unionByName(csv_lines(df)).write.mode("overwrite").option("lineSep", "\n").text(path)


def _cell(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n') else value


def import_template(spark: SparkSession, kind: str) -> DataFrame:
    """Header and sample row of an import template."""
    if kind not in K.IMPORT_TEMPLATES:
        raise ValueError("不支持的模板类型")
    header, sample = K.IMPORT_TEMPLATES[kind]
    return spark.createDataFrame([tuple(sample)], T.StructType([T.StructField(c, T.StringType()) for c in header]))


def write_template(spark: SparkSession, kind: str, path: str) -> None:
    """Write a template file, every cell quoted."""
    template = import_template(spark, kind)
    lines = [BOM + _quoted(template.columns), _quoted(template.first())]
    spark.createDataFrame([(line,) for line in lines], "line string").coalesce(1).write.mode("overwrite").text(path)


def _quoted(cells) -> str:
    return ",".join('"' + cell.replace('"', '""') + '"' for cell in cells)
