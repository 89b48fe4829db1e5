"""Reading the four logs from delimited text (or parquet) with one missing-value marker."""

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import normalize_missing
from ..operators.scale import col
from . import schemas

# Cell texts that delimited readers of the pandas kind treat as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class LogConfig:
    """Where the logs are, how they are delimited, and whether stored features are reused."""

    deposits: str
    events: str
    positions: str
    attribution: str
    delimiter: str = "\t"
    multiline: bool = False
    on_bad_cell: str = "fail"
    file_format: str = "csv"
    store: str = "data/features"
    reuse_prepared: bool = True


def read_delimited(spark, path, schema, delimiter="\t", multiline=False, on_bad_cell="fail"):
    """Read a delimited file with a header; declared columns are typed, others stay text.

    Cells holding a missing token become null before the cast. A cell that does not fit its
    type stops the read, or becomes null with ``on_bad_cell="null"`` (see ``bad_cells``); so
    does a row with more cells than the header, whose extra cells go then (see ``long_rows``). A short
    row ends in nulls. A file whose header differs from the first one's stops the read.
    """
    raw = _raw(spark, path, delimiter, multiline)
    if on_bad_cell == "fail":
        stop = F.raise_error(F.concat(F.lit("more cells than columns: "), F.col(LINE))).cast("boolean")
        raw = raw.filter(F.when(F.col(EXTRA), stop).otherwise(True))
    return _typed_columns(raw.drop(LINE, EXTRA), path, schema, on_bad_cell)


def _typed_columns(raw, path, schema, on_bad_cell):
    """Declared columns in their types; absent ones stop the read."""
    absent = [f.name for f in schema.fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"{path} lacks columns {absent}")
    kinds = dict(raw.dtypes)
    declared = {f.name: f.dataType for f in schema.fields}

    def typed(name):
        target = declared.get(name, T.StringType())
        if kinds[name] == target.simpleString() or name not in declared:
            return col(name)
        if isinstance(target, T.StringType) or kinds[name] != "string":
            return (col(name).cast(target) if on_bad_cell == "fail" else col(name).try_cast(target)).alias(name)
        lenient = _lenient_cast(col(name), target)
        # Where the lenient reading finds nothing, a plain cast raises on a present cell.
        value = F.coalesce(lenient, col(name).cast(target)) if on_bad_cell == "fail" else lenient
        return value.alias(name)

    return normalize_missing(raw.select(*[typed(c) for c in raw.columns]))


def _lenient_cast(column, target):
    """The cell as its type, or null. A whole number may be written as 3.0, as happens to whole
    columns with gaps; ids keep all their digits."""
    direct = column.try_cast(target)
    if not isinstance(target, T.IntegralType):
        return direct
    exact = column.try_cast("decimal(38,6)")
    return F.coalesce(direct, F.when(exact == F.floor(exact), exact.try_cast(target)))


LINE, EXTRA = "__line", "__extra"


def _raw(spark, path, delimiter, multiline):
    """All cells as text, the line of a row with another number of cells, and whether it has more."""
    options = {"sep": delimiter, "escape": '"', "multiLine": str(multiline).lower()}
    names = spark.read.options(header="true", **options).csv(path).columns
    texts = [T.StructField(n, T.StringType()) for n in names]
    # Each file's header is checked against these names.
    raw = spark.read.options(
        header="true", enforceSchema="false", mode="PERMISSIVE", columnNameOfCorruptRecord=LINE,
        columnPruning="false", **options  # a pruned read does not count cells
    ).schema(T.StructType([*texts, T.StructField(LINE, T.StringType())])).csv(path)
    wider = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    more = F.from_csv(F.col(LINE), wider.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    # An extra cell is there also when it is empty.
    ends = F.col(LINE).isNotNull() & (F.get(F.split(F.col(LINE), F.lit("\\Q" + delimiter + "\\E")), F.lit(len(names))).isNotNull())
    extra = F.coalesce(more[f"c{len(names)}"].isNotNull() | (ends & ~F.contains(F.col(LINE), F.lit('"'))), F.lit(False))
    marked = raw.withColumn(EXTRA, extra)
    return normalize_missing(marked.select(*[col(n) for n in names], LINE, EXTRA), MISSING_TOKENS)


def bad_cells(spark, path, schema, delimiter="\t", multiline=False):
    """Per declared column: cells that are present but do not fit the type."""
    raw = _raw(spark, path, delimiter, multiline)
    counts = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count_if(col(f.name).isNotNull() & _lenient_cast(col(f.name), f.dataType).isNull()).alias("bad"),
        )
        for f in schema.fields
    ]
    return raw.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def long_rows(spark, path, delimiter="\t", multiline=False):
    """How many rows have more cells than columns, and how many have a first cell."""
    raw = _raw(spark, path, delimiter, multiline)
    return raw.agg(F.count_if(F.col(EXTRA)).alias("long"), F.count(col(raw.columns[0])).alias("present"))


def read_log(spark, path, schema, config):
    if config.file_format == "csv":
        return read_delimited(spark, path, schema, config.delimiter, config.multiline, config.on_bad_cell)
    stored = spark.read.format(config.file_format).load(path)
    return normalize_missing(_typed_columns(stored, path, schema, config.on_bad_cell))


def read_logs(spark, config):
    """(deposits, positions, attribution, events), all lazy."""
    return (
        read_log(spark, config.deposits, schemas.DEPOSITS, config),
        read_log(spark, config.positions, schemas.POSITIONS, config),
        read_log(spark, config.attribution, schemas.ATTRIBUTION, config),
        read_log(spark, config.events, schemas.EVENTS, config),
    )
