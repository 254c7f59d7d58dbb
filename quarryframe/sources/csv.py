"""CSV: every cell is read as text, then one pass over all rows finds the types.

A column whose non-empty cells are all integers is i64, else if all are numbers f64, else string.  Empty
cells are null in numeric columns and empty strings in string columns.  Nothing is trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.errors import EmptyInput, InconsistentRowWidth
from quarryframe.operators.cast import plain_decimal
from quarryframe.operators.rows import checked, quoted
from quarryframe.sources.files import save_bytes, with_file_position

_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|(?i)^[+-]?(nan|inf|infinity)$"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, skip_rows: int = 0, multi_line: bool = False, position: str | None = None) -> DataFrame:
    """skip_rows: data rows, after the header, that are left out (their width still counts).

    multi_line: quoted cells may hold line ends; such files aren't split.  position: a column for the row
    number.  Rows of another width than the first, and blank lines, raise InconsistentRowWidth.
    """
    lines = spark.read.text(path)
    first = _first_row(spark, path, delimiter, multi_line)
    if first is None:
        raise EmptyInput(path)
    names = first if header else [f"column_{i}" for i in range(len(first))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("__bad", T.StringType())])
    reader = spark.read.schema(schema).options(sep=delimiter, quote='"', escape='"', header=header, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = reader.csv(path)
    if not multi_line and lines.where("value = ''").limit(1).count():
        raise InconsistentRowWidth("blank line")
    numbered = with_file_position(cells, "__pos") if skip_rows or position else cells
    every = [f"c{i}" for i in range(len(names))]
    full = lambda c, rule: F.bool_and(F.when(c != "", rule))
    found = cells.agg(
        F.bool_or(F.col("__bad").isNotNull()).alias("bad"),
        F.count(F.lit(1)).alias("n"),
        *(full(F.col(c), F.col(c).rlike(_INTEGER) & F.col(c).try_cast("bigint").isNotNull()).alias(f"i_{c}") for c in every),
        *(full(F.col(c), F.col(c).rlike(_NUMBER)).alias(f"n_{c}") for c in every),
    ).first()
    if found["bad"]:
        raise InconsistentRowWidth(path)
    if skip_rows:
        numbered = numbered.where(F.col("__pos") >= skip_rows)

    def typed(c: str) -> Column:
        cell = F.when(F.col(c) != "", F.col(c))
        if found[f"i_{c}"]:
            return cell.cast("bigint")
        if found[f"n_{c}"]:
            return cell.cast("double")
        return F.coalesce(F.col(c), F.lit(""))

    extra = [(F.col("__pos") - skip_rows).alias(position)] if position else []
    return checked(numbered.select(*(typed(c).alias(n) for c, n in zip(every, names, strict=True)), *extra))


def _first_row(spark: SparkSession, path: str, delimiter: str, multi_line: bool) -> list[str] | None:
    """The cells of the first row, by Spark's own parser."""
    row = spark.read.options(sep=delimiter, quote='"', escape='"', header=False, multiLine=multi_line, inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path).limit(1).collect()
    return ["" if c is None else c for c in row[0]] if row else None


def _cell(df: DataFrame, field: T.StructField, delimiter: str) -> Column:
    c = quoted(field.name)
    text = plain_decimal(c, field) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else F.lower(F.hex(c)) if isinstance(field.dataType, T.BinaryType) else F.to_json(c) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    special = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.coalesce(F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """(value): a line a row; cells are quoted only where they must be, nulls are empty."""
    return df.select(F.concat_ws(delimiter, *(_cell(df, f, delimiter) for f in df.schema.fields)).alias("value"))


def _header(df: DataFrame, delimiter: str) -> str:
    need = lambda n: any(x in n for x in (delimiter, '"', "\n", "\r"))
    return delimiter.join('"' + n.replace('"', '""') + '"' if need(n) else n for n in df.columns)


def to_csv_string(df: DataFrame, delimiter: str = ",", header: bool = True) -> str:
    """The whole frame as one string, on the driver: for frames known to be small."""
    lines = [_header(df, delimiter)] if header else []
    return "".join(line + "\n" for line in [*lines, *(r["value"] for r in csv_lines(df, delimiter).collect())])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, one_file: bool = False) -> None:
    """A folder of files, each with the header; one_file: a single file through the driver, for small frames."""
    if one_file:
        save_bytes(df.sparkSession, path, to_csv_string(df, delimiter, header).encode())
        return
    text = df.select(*((plain_decimal(quoted(f.name), f) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name)).alias(f.name) for f in df.schema.fields))
    text.write.mode("overwrite").options(header=header, sep=delimiter, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
