"""Reading tables from files and writing results."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..errors import InputError
from ..functions import values
from ..operators.findings import finding_json
from ..operators.shaping import tidy

# Accepted encodings (as Spark names them) in order, and delimiters.
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
DELIMITERS = ",;\t|"
NOT_IN_CP1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json",
           ".orc": "orc"}
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
# Words that stand for a missing value.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = "^ *[+-]?[0-9]+ *$"
NUMBER = "^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$|^ *[+-]?(inf|Infinity) *$"
ISO_DATE = "^ *[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """Text lines, whose bytes Spark keeps as they are, read in another encoding."""
    return lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("value"))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First accepted encoding that fits every line of the files.

    The checks run distributed over the whole input, so a stray byte far into the data is
    seen too.
    """
    lines = spark.read.text(path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return ENCODINGS[0]
    pattern = "[" + "".join(chr(b) for b in NOT_IN_CP1252) + "]"
    raw = _decoded(lines, ENCODINGS[2])
    return ENCODINGS[1] if raw.where(F.col("value").rlike(pattern)).isEmpty() else ENCODINGS[2]


def _from_cp1252(df: DataFrame) -> DataFrame:
    """Spark reads no windows-1252: text read as ISO-8859-1 differs in 0x80-0x9F only."""
    codes = [b for b in range(0x80, 0xA0) if b not in NOT_IN_CP1252]
    read = "".join(map(chr, codes))
    meant = bytes(codes).decode("cp1252")
    table = str.maketrans(read, meant)
    renamed = df.toDF(*[c.translate(table) for c in df.columns])
    texts = [f.name for f in renamed.schema.fields if f.dataType.simpleString() == "string"]
    return renamed.withColumns({c: F.translate(values.col(c), read, meant) for c in texts})


def delimiter_fit(lines: DataFrame, column: str = "value") -> DataFrame:
    """(candidate, per_line, n, lines): how many lines have the most usual count of each
    delimiter outside quotes, of the lines that have it at all, and of all lines."""
    bare = F.regexp_replace(F.col(column), '"[^"]*"', "")
    found = lines.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("candidate"),
                        (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("k"),
                    )
                    for d in DELIMITERS
                ]
            )
        )
    )
    counts = found.groupBy("candidate", "k").agg(F.count(F.lit(1)).alias("c"))
    usual = F.when(F.col("k") > 0, F.struct("c", "k"))
    return counts.groupBy("candidate").agg(
        F.max(usual)["k"].alias("per_line"),
        F.coalesce(F.max(usual)["c"], F.lit(0)).alias("n"),
        F.sum("c").alias("lines"),
    )


def _look(lines: DataFrame) -> tuple[str, bool]:
    """Delimiter of the lines (comma if none stands out) and whether quotes span lines."""
    head = lines.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.col("value").contains("\x00")), F.lit(False)).alias("binary"),
        F.coalesce(F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1), F.lit(False)).alias(
            "open_quotes"
        ),
    ).first()
    if not head["n"]:
        raise InputError("EMPTY_DATASET", "The file is empty.")
    if head["binary"]:
        raise InputError("INVALID_FILE", "The file looks binary, not a CSV.")
    fits = [r for r in delimiter_fit(lines).collect() if r["n"]]
    best = max(
        fits,
        key=lambda r: (r["n"], r["per_line"], -DELIMITERS.index(r["candidate"])),
        default=None,
    )
    return (best["candidate"] if best else ","), head["open_quotes"]


def header_delimiter(lines: DataFrame, column: str = "value") -> DataFrame:
    """(candidate, n): occurrences of each delimiter in text lines, most frequent first."""
    found = lines.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("candidate"),
                        (F.length(column) - F.length(F.replace(column, F.lit(d), F.lit("")))).alias(
                            "n"
                        ),
                    )
                    for d in DELIMITERS
                ]
            )
        )
    )
    return found.groupBy("candidate").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "candidate")


def _format_of(spark: SparkSession, path: str) -> str | None:
    """Format by the suffix of the path, or of a file in the folder; compression is passed over."""

    def by_name(name: str) -> str | None:
        name = PurePosixPath(name)
        if name.suffix.lower() in COMPRESSED:
            name = name.with_suffix("")
        return FORMATS.get(name.suffix.lower())

    found = by_name(path)
    if found or PurePosixPath(path).suffix:
        return found
    try:
        files = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    except AnalysisException:
        return None
    return by_name(files[0]["path"]) if files else None


def with_types(texts: DataFrame) -> DataFrame:
    """Text columns with missing-value words as nulls and the narrowest type all values fit.

    Types are found in one aggregate: int, bigint, double, boolean, timestamp, else string.
    """
    words = ", ".join(f"'{w}'" for w in MISSING_WORDS)
    names = texts.columns
    known = texts.select(
        *[
            F.expr(f"if(trim({values.quoted(c)}) IN ({words}), NULL, {values.quoted(c)})").alias(c)
            for c in names
        ]
    )
    tests = {
        "int": "try_cast({c} AS INT) IS NOT NULL AND {c} RLIKE '" + INTEGER + "'",
        "bigint": "try_cast({c} AS BIGINT) IS NOT NULL AND {c} RLIKE '" + INTEGER + "'",
        "double": "{c} RLIKE '" + NUMBER + "'",
        "boolean": "lower(trim({c})) IN ('true', 'false')",
        "timestamp": "{c} RLIKE '" + ISO_DATE + "' AND try_cast({c} AS TIMESTAMP) IS NOT NULL",
    }
    asked = []
    for i, c in enumerate(names):
        q = values.quoted(c)
        asked.append(f"count({q}) AS n{i}")
        asked += [f"count_if({t.replace('{c}', q)}) AS {k}{i}" for k, t in tests.items()]
    row = known.selectExpr(*asked).first()
    kinds = [
        next((k for k in tests if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string")
        for i in range(len(names))
    ]
    return known.select(
        *[
            F.col(values.quoted(c)).cast(k).alias(c) if k != "string" else values.col(c)
            for c, k in zip(names, kinds, strict=True)
        ]
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    format: str | None = None,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read CSV, Parquet, JSON or ORC files or folders, or a table of the catalogue.

    CSV encoding, delimiter and quotes that span lines are detected; what is given is not
    looked for. Give a schema for large CSV inputs: finding types costs a pass over the data.
    Files with quotes that span lines are read whole, one task each.
    """
    kind = format or _format_of(spark, path)
    if kind is None:
        if "/" not in path and spark.catalog.tableExists(path):
            return tidy(spark.table(path))
        accepted = ", ".join(FORMATS)
        suffix = PurePosixPath(path).suffix.lower()
        raise InputError(
            "INVALID_FILE", f"Unsupported file type '{suffix or path}'. Use one of {accepted}."
        )
    if kind != "csv":
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.format(kind).load(path)
    else:
        encoding = encoding or detect_encoding(spark, path)
        if sep is None or multi_line is None:
            lines = spark.read.text(path)
            found = _look(lines if encoding == ENCODINGS[0] else _decoded(lines, ENCODINGS[2]))
            sep = found[0] if sep is None else sep
            multi_line = found[1] if multi_line is None else multi_line
        charset = encoding if encoding == ENCODINGS[0] else ENCODINGS[2]
        reader = spark.read.options(
            header=True, sep=sep, encoding=charset, quote='"', escape='"', multiLine=multi_line
        )
        df = (reader.schema(schema) if schema else reader).csv(path)
        df = _from_cp1252(df) if encoding == ENCODINGS[1] else df
        df = df if schema else with_types(df)
    if df.isEmpty():
        raise InputError("EMPTY_DATASET", "The dataset has no rows or no columns.")
    return tidy(df)


def strict(value: Column, dtype: T.DataType) -> Column:
    """The value with NaN and infinities missing, at any depth."""
    if isinstance(dtype, values.FLOAT_TYPES):
        return F.when(F.abs(value) < float("inf"), value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: strict(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, v: strict(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [strict(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Write a result table as Parquet or strict JSON lines (no NaN or infinities)."""
    if kind == "json":
        df = df.select(
            *[strict(values.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
        )
    df.write.mode(mode).format(kind).save(path)


def write_findings_json(findings: DataFrame, path: str, mode: str = "error") -> None:
    """One compact JSON object per finding."""
    finding_json(findings).select("json").write.mode(mode).text(path)
