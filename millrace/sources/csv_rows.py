"""CSV source (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from .csv_split import split_rows
from .json_split import large_files
from .jsonl import SPLIT_OVER

# Cell texts that mean "missing".
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv_rows(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    one_line_rows: bool = False, split_over: int = SPLIT_OVER, range_bytes: int | None = None, **options,
) -> DataFrame:
    """CSV rows with header, keeping the cells in one struct column ``row``.

    Types are inferred unless a schema is given; inference is one more pass over the input, so
    large inputs should bring their schema. Quoted cells may hold line breaks, so a file is read by one
    task, unless it is larger than ``split_over`` bytes: then its rows are cut by many tasks first (see ``csv_split``), when this is called.
    ``one_line_rows`` promises that no cell holds one, and spares that. Extra options go
    to Spark's CSV reader.
    """
    if not one_line_rows:
        wanted = [path] if isinstance(path, str) else list(path)
        lengths = large_files(spark, wanted, split_over)
        if lengths:
            return _with_large(spark, wanted, lengths, schema, split_over, range_bytes, options)
    settings = {"header": True, "escape": '"', "multiLine": not one_line_rows, **options}
    if schema is None:
        inferred = spark.read.options(**settings).option("inferSchema", True).csv(path).schema
        # dates stay text: a prompt shows the cell as it was written
        schema = T.StructType(
            [
                T.StructField(f.name, T.StringType())
                if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                else f
                for f in inferred
            ]
        )
    rows = spark.read.options(**settings).schema(schema).csv(path)
    place = (P.plain_path(F.col("_metadata.file_path")), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return _shaped(rows, rows.schema, *place)


def _shaped(rows: DataFrame, schema: T.StructType, file: Column, block: Column, number: Column) -> DataFrame:
    def cell(field):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            col = F.when(~col.isin(MISSING_MARKERS), col)
        return col.alias(field.name)

    return rows.select(
        F.struct(file.alias("file"), block.alias("block"), number.alias("row")).alias("seq"),
        file.alias("source_file"),
        F.struct(*[cell(f) for f in schema]).alias("row"),
    )


def _with_large(spark, paths, lengths, schema, split_over, range_bytes, options) -> DataFrame:
    """Rows of files some of which are cut; the types of cut files need a schema or the small ones."""
    if schema is None:
        raise ValueError("files above split_over need a schema: inferring types is another pass over them by one task each")
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    texts = split_rows(spark, list(lengths), options.get("sep", ","), range_bytes).where("number > 0")
    settings = {"escape": '"', **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}}
    parsed = texts.select("file", "number", F.from_csv("value", schema.simpleString(), settings).alias("cells"))
    fields = [F.col(f"cells.`{f.name}`").alias(f.name) for f in schema]
    rows = parsed.select(F.col("file").alias("_file"), F.col("number").alias("_number"), *fields)
    large = _shaped(rows, schema, P.plain_path(F.col("_file")), F.lit(0).cast("long"), F.col("_number"))
    reader = spark.read.options(header=True, escape='"', multiLine=True, **options).schema(schema)
    small = reader.csv(paths).where(F.col("_metadata.file_size") <= split_over)
    place = (P.plain_path(F.col("_metadata.file_path")), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return _shaped(small, schema, *place).union(large)
