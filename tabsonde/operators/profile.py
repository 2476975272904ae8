"""Profile of a table: types, gaps, distributions, frequent values, duplicates, correlations.

Works in a handful of wide aggregations over disjoint column chunks, so every column is read
once per pass and only one row per column reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions import dates, values
from ..functions.values import col
from ..staging import together
from .hypotheses import _chunks, melt
from .moments import correlations, numbered, pair_moments
from .ranks import (
    SKETCH_GROUPS,
    bucket_count,
    bucket_name,
    cut_points,
    cuts_from,
    exact_quantiles,
    with_buckets,
)

# Limits of the profile.
MAX_TOP_CORRELATIONS = 20
TOP_CORRELATION = 0.5
MIN_CORRELATION_ROWS = 3
TOP_VALUES = 10
HIGH_MISSING_PCT = 50.0
HIGH_CARDINALITY = 50
TEXT_LENGTH = 50
ID_MIN_ROWS = 20
DATE_RATIO = 0.9
OUTLIER_REACH = 1.5
QUARTILES = (0.25, 0.5, 0.75)
ID_NAME = re.compile(r"(^|[_\s-])id$|^id[_\s-]|_key$", re.IGNORECASE)

COLUMNS_PER_SCAN = 40
#: Distinct values by sketch: registers as a power of two, the standard error of the estimate,
#: and how near to the number of rows an estimate is counted exactly.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
NEAR_UNIQUE = 0.05

COLUMN_SCHEMA = (
    "position int, name string, inferred_type string, dtype string, missing_count bigint, "
    "missing_pct double, unique_count bigint, mean double, std double, min double, p25 double, "
    "median double, p75 double, max double, skew double, outlier_count bigint, "
    "infinite_count bigint, top_values array<struct<value:string,count:bigint>>, "
    "min_date string, max_date string, zero_one boolean"
)
DATASET_SCHEMA = (
    "n_rows bigint, n_cols int, duplicate_rows bigint, missing_cells_total bigint, "
    "missing_pct_total double, sampled boolean, sample_rows bigint, total_columns int"
)
PAIR_SCHEMA = "a string, b string, r double, n bigint"


@dataclass(frozen=True)
class Profile:
    """Control-sized description of a table (one row per column), also as DataFrames."""

    columns: DataFrame
    dataset: DataFrame
    correlations: DataFrame
    rows: tuple[Row, ...]
    n_rows: int


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, values.TIME_TYPES):
        return "datetime"
    if isinstance(dtype, values.NUMERIC_TYPES):
        return "numeric"
    return "complex" if isinstance(dtype, values.COMPLEX_TYPES) else "string"


def _masked(name: str, dtype: T.DataType) -> str:
    return values.finite(values.number(values.quoted(name), dtype))


def _iso(when: str) -> str:
    shown = f"date_format({when}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    return f"regexp_replace({shown}, '[.]000000$', '')"


# Statistics of one long column per kind. Long form keeps the generated aggregation code small
# enough to be compiled to machine code, however many columns the table has.
_N = "count(v)"
NUMERIC_LOOK = {
    "present": "count(raw)",
    "mean": "avg(v)",
    "std": "stddev_samp(v)",
    "min": "min(v)",
    "max": "max(v)",
    "skew": f"CASE WHEN {_N} < 3 THEN NULL WHEN min(v) < max(v) THEN "
    f"skewness(v) * sqrt({_N} * ({_N} - 1D)) / nullif({_N} - 2, 0) ELSE 0D END",
    "infinite": "count_if(abs(raw) = CAST('Infinity' AS DOUBLE))",
    "zero_one": "min(raw IN (0D, 1D))",
}
TEXT_LOOK = {
    "present": "count(raw)",
    "length": "avg(length(raw))",
    "digits": "avg(CAST(raw RLIKE '[0-9]' AS DOUBLE))",
    # Long texts are no words, so they are not put into lower case.
    "yes_no": f"min(length(trim(raw)) <= {max(map(len, values.YES_NO_WORDS))} AND "
    f"lower(trim(raw)) IN ({values.literals(values.YES_NO_WORDS)}))",
    "dates": "count(t) / nullif(count(raw), 0)",
    "min_date": _iso("min(t)"),
    "max_date": _iso("max(t)"),
}
TIME_LOOK = {
    "present": "count(raw)", "min_date": _iso("min(raw)"), "max_date": _iso("max(raw)"),
}
OTHER_LOOK = {"present": "count(raw)"}


def _look_input(field: T.StructField, slot: str) -> str:
    name, kind = values.quoted(field.name), _kind(field.dataType)
    if kind == "numeric":
        return f"{values.number(name, field.dataType)} AS {slot}"
    if kind == "string":
        return f"CAST({name} AS STRING) AS {slot}"
    if kind == "datetime":
        return f"CAST({name} AS TIMESTAMP_NTZ) AS {slot}"
    return f"nullif({name} IS NOT NULL, false) AS {slot}"


def first_looks(df: DataFrame) -> dict[str, Row]:
    """Everything one scan can tell about each column, quartiles aside."""
    by_kind: dict[str, list[tuple[str, T.StructField]]] = {}
    for i, f in enumerate(df.schema.fields):
        kind = _kind(f.dataType)
        group = kind if kind in ("numeric", "string", "datetime") else "other"
        by_kind.setdefault(group, []).append((f"s{i}", f))
    out: dict[str, Row] = {}
    for kind, fields in by_kind.items():
        wide = df.selectExpr(*[_look_input(f, s) for s, f in fields])
        long = wide.unpivot([], wide.columns, "slot", "raw")
        look = OTHER_LOOK
        if kind == "numeric":
            look, long = NUMERIC_LOOK, long.selectExpr("slot", "raw", f"{values.finite('raw')} AS v")
        elif kind == "string":
            look = TEXT_LOOK
            long = long.withColumn("t", dates.as_time(F.col("raw"), T.StringType()))
        elif kind == "datetime":
            look = TIME_LOOK
        table = long.groupBy("slot").agg(*[F.expr(f"{sql} AS {k}") for k, sql in look.items()])
        named = dict(fields)
        out.update({named[r["slot"]].name: r for r in table.collect()})
        empty = Row(**(dict.fromkeys(look) | {"present": 0}))
        out.update({f.name: empty for _, f in fields if f.name not in out})
    return out


def quartiles_of(df: DataFrame, names: Sequence[str], rows: int) -> dict[str, list[float]]:
    """Exact quartiles of numeric columns, kept apart from the other statistics because the
    sketch-like aggregates would take those out of generated code."""
    fields = [df.schema[n] for n in names]
    slots = {f"v{i}": f for i, f in enumerate(fields)}
    if not slots:
        return {}
    wide = df.selectExpr(*[f"{_masked(f.name, f.dataType)} AS {s}" for s, f in slots.items()])
    cuts = {}
    for chunk in _chunks(list(slots), COLUMNS_PER_SCAN):
        points = cut_points(wide, {s: F.col(s) for s in chunk}, bucket_count(rows))
        cuts.update({s: cuts_from(points[s]) for s in chunk})
    melted = melt(
        with_buckets(wide, cuts),
        [{"slot": f"'{s}'", "bucket": bucket_name(s), "v": s} for s in slots],
    )
    bound = sum(c.buckets for c in cuts.values())
    table = exact_quantiles(melted, ["slot"], "v", "bucket", QUARTILES, bound)
    return {slots[r["slot"]].name: [r["q0"], r["q1"], r["q2"]] for r in table.collect()}


def _value_rows(
    df: DataFrame, texts: Sequence[str], only: Sequence[str] | None = None
) -> list[DataFrame]:
    """Melted (slot, value) per physical kind, so that values keep their identity.

    Long texts only need a distinct count, so their digests are counted. ``only`` names the
    columns that are looked at, all if it is None.
    """
    groups: dict[str, list[str]] = {"bigint": [], "double": [], "string": [], "digest": []}
    for i, f in enumerate(df.schema.fields):
        if only is not None and f.name not in only:
            continue
        name, kind = values.quoted(f.name), _kind(f.dataType)
        if isinstance(f.dataType, values.INTEGER_TYPES):
            groups["bigint"].append(f"CAST({name} AS BIGINT) AS s{i}")
        elif isinstance(f.dataType, values.FLOAT_TYPES):
            groups["double"].append(f"{values.number(name, f.dataType)} AS s{i}")
        elif kind == "complex" or f.name in texts:
            digest = f"md5({values.text(name, f.dataType)})"
            groups["digest"].append(f"if({name} IS NOT NULL, {digest}, NULL) AS s{i}")
        else:
            groups["string"].append(f"{values.text(name, f.dataType)} AS s{i}")
    out = []
    for name in ("string", "bigint", "double", "digest"):
        if groups[name]:
            wide = df.selectExpr(*groups[name])
            melted = wide.unpivot([], wide.columns, "slot", "value").where("value IS NOT NULL")
            out.append(melted.groupBy("slot", "value").agg(F.count("*").alias("n")))
    return out


def _sketched(field: T.StructField) -> str:
    """A 64-bit hash of the value, for the sketch; values that are equal hash alike."""
    name = values.quoted(field.name)
    value = values.text(name, field.dataType)
    if isinstance(field.dataType, values.FLOAT_TYPES):
        value = f"({values.number(name, field.dataType)} + 0D)"
    elif isinstance(field.dataType, values.INTEGER_TYPES):
        value = f"CAST({name} AS BIGINT)"
    return f"CASE WHEN {value} IS NOT NULL AND {name} IS NOT NULL THEN xxhash64({value}) END"


def distinct_estimates(df: DataFrame) -> dict[str, int]:
    """About how many distinct values each column has, by sketches that are merged in two levels.

    One scan, and a sketch of 2 ** SKETCH_BITS registers per column and task: no value is
    shuffled. The standard error is SKETCH_ERROR.
    """
    out: dict[str, int] = {}
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part")
    for chunk in _chunks(df.schema.fields, COLUMNS_PER_SCAN):
        slots = [f"s{i}" for i in range(len(chunk))]
        hashed = [f"{_sketched(f)} AS {s}" for f, s in zip(chunk, slots, strict=True)]
        sketches = df.selectExpr(*hashed).groupBy(group).agg(
            *[F.hll_sketch_agg(s, SKETCH_BITS).alias(s) for s in slots]
        )
        row = sketches.agg(
            *[F.hll_sketch_estimate(F.hll_union_agg(s)).alias(s) for s in slots]
        ).first()
        out.update({f.name: row[s] or 0 for f, s in zip(chunk, slots, strict=True)})
    return out


def near_unique(present: int, estimate: int) -> bool:
    """Whether every value may be different: then only counting tells."""
    return estimate >= (1 - NEAR_UNIQUE) * present


def value_summaries(
    df: DataFrame, texts: Sequence[str] = (), only: Sequence[str] | None = None
) -> tuple[dict[str, int], dict[str, list[tuple[str, int]]]]:
    """Exact distinct count per column and the most frequent values of text-like columns."""
    tables = _value_rows(df, texts, only)
    empty = F.lit(None).cast("string").alias("value")
    distinct = None
    for t in tables:
        part = t.groupBy("slot").agg(F.count("*").alias("n")).select("slot", empty, "n")
        distinct = part if distinct is None else distinct.unionByName(part)
    result = distinct
    if tables and dict(tables[0].dtypes)["value"] == "string":
        order = Window.partitionBy("slot").orderBy(F.desc("n"), "value")
        ranked = tables[0].withColumn("rank", F.row_number().over(order))
        result = result.unionByName(ranked.where(F.col("rank") <= TOP_VALUES).drop("rank"))
    counts: dict[str, int] = {}
    tops: dict[str, list[tuple[str, int]]] = {}
    for r in result.collect() if result is not None else ():
        name = df.columns[int(r["slot"][1:])]
        if r["value"] is None:
            counts[name] = r["n"]
        else:
            tops.setdefault(name, []).append((r["value"], r["n"]))
    for name in tops:
        tops[name].sort(key=lambda v: (-v[1], v[0]))
    return counts, tops


def looks_and_counts(
    df: DataFrame, approximate: bool = False
) -> tuple[dict[str, Row], dict[str, int], dict[str, list[tuple[str, int]]]]:
    """First looks, distinct counts and frequent values of all columns."""
    looks = first_looks(df)
    texts = [
        f.name
        for f in df.schema.fields
        if _kind(f.dataType) == "string" and (looks[f.name]["length"] or 0) > TEXT_LENGTH
    ]
    if not approximate:
        return looks, *value_summaries(df, texts)
    guess = distinct_estimates(df)
    listed = {f.name for f in df.schema.fields if _kind(f.dataType) in ("string", "boolean")}
    unique = {c for c in guess if near_unique(looks[c]["present"], guess[c])}
    counts, most = value_summaries(df, texts, sorted((unique | listed) - set(texts)))
    return looks, guess | counts, most


def distinct_values(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(name, unique_count) of all columns, as in a profile but without the rest of it."""
    df = df.select(*[col(c) for c in df.columns])
    _, found, _ = looks_and_counts(df, approximate)
    rows = [(c, found.get(c, 0)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "name string, unique_count bigint")


def infer_type(field: T.StructField, look: Row, distinct: int) -> str:
    """Semantic type: boolean, datetime, id, numeric, categorical, text (or complex)."""
    kind, present = _kind(field.dataType), look["present"]
    unique = present >= ID_MIN_ROWS and distinct == present
    if kind == "numeric":
        integer = isinstance(field.dataType, values.INTEGER_TYPES)
        return "id" if unique and integer and ID_NAME.search(field.name) else "numeric"
    if kind != "string":
        return kind
    if present == 0:
        return "categorical"
    if look["yes_no"]:
        return "boolean"
    if look["digits"] >= DATE_RATIO and look["dates"] >= DATE_RATIO:
        return "datetime"
    if unique and look["length"] <= TEXT_LENGTH:
        return "id"
    return "text" if look["length"] > TEXT_LENGTH else "categorical"


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row (rows, distinct_rows, duplicate_rows); missing equals missing.

    Rows are grouped on a 128-bit fingerprint (two 64-bit hashes over values and null flags),
    so the shuffle carries 16 bytes per row instead of the whole table.
    """
    parts = []
    for f in df.schema.fields:
        c = col(f.name)
        nested = isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
        # Hashes pass over nulls and borders inside a value; its text shows them.
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        parts += [c.isNull(), text if nested else c]
    prints = df.select(
        F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2")
    )
    groups = prints.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    rows, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return groups.agg(
        rows.alias("rows"), distinct.alias("distinct_rows"), (rows - distinct).alias("duplicate_rows")
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r, n): Pearson correlation of every pair over its complete rows."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    slots = [f"v{i}" for i in range(len(columns))]
    # Plain casts: moments leave out NaN and infinities, and forms that name a column twice would
    # work out twice what stands behind it.
    read = [
        f"CAST({values.quoted(c)} AS DOUBLE) AS {s}"
        if isinstance(types[c], (T.BooleanType, *values.NUMERIC_TYPES))
        else f"{values.number(values.quoted(c), types[c])} AS {s}"
        for c, s in zip(columns, slots, strict=True)
    ]
    found = correlations(pair_moments(df.selectExpr(*read), slots))
    names = numbered(columns)
    r = F.when(F.col("n") >= MIN_CORRELATION_ROWS, F.round("r", 4))
    return found.select(
        names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"), "n"
    )


def top_correlations(pairs: DataFrame) -> DataFrame:
    strong = pairs.where(F.abs("r") >= TOP_CORRELATION)
    return strong.orderBy(F.desc(F.abs("r")), "a", "b").limit(MAX_TOP_CORRELATIONS)


def correlation_columns(rows: Sequence[Row], limit: int | None = None) -> list[str]:
    """Varying numeric columns, those with the fewest gaps first; ``limit`` of them if given."""
    usable = [r for r in rows if r["inferred_type"] == "numeric" and r["unique_count"] > 1]
    return [r["name"] for r in sorted(usable, key=lambda r: r["missing_count"])][:limit]


def _outliers(df: DataFrame, quartiles: dict[str, list[float]]) -> dict[str, int]:
    types = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, int] = {}
    for chunk in _chunks(list(quartiles.items()), COLUMNS_PER_SCAN):
        aggs = []
        for i, (name, (q1, _, q3)) in enumerate(chunk):
            v, reach = _masked(name, types[name]), OUTLIER_REACH * (q3 - q1)
            low, high = q1 - reach, q3 + reach
            aggs.append(f"count_if(({v}) NOT BETWEEN {low!r}D AND {high!r}D) AS o{i}")
        row = df.selectExpr(*aggs).first()
        out.update({name: row[i] for i, (name, _) in enumerate(chunk)})
    return out


def _rounded(x: float | None, digits: int = 6) -> float | None:
    return None if x is None or x != x or abs(x) == float("inf") else round(x, digits)


def _percent(part: int, whole: int) -> float:
    return round(100.0 * part / whole, 2) if whole else 0.0


def profile(
    df: DataFrame,
    n_rows: int | None = None,
    total_rows: int | None = None,
    correlate: bool = True,
    duplicates: bool = True,
    max_columns: int | None = None,
    max_correlated: int | None = None,
    approximate: bool = False,
    spreads: bool = True,
) -> Profile:
    """Profile a table. ``total_rows`` is the size of the full table when ``df`` is a sample.

    All columns are profiled, and all numeric ones correlated, unless limits are given.
    ``approximate`` estimates distinct values by sketches; columns that may be unique, and texts
    whose frequent values are listed, are still counted. Without ``spreads`` quartiles and outliers
    are left out.
    """
    if not df.columns:
        raise InputError("EMPTY_DATASET", "The dataset has no rows or no columns.")
    spark, total_columns = df.sparkSession, len(df.columns)
    df = df.select(*[col(c) for c in df.columns[:max_columns]])
    n = df.count() if n_rows is None else n_rows
    numbers = [f.name for f in df.schema.fields if _kind(f.dataType) == "numeric"]

    def spread():
        if not spreads:
            return {}, {}
        found = quartiles_of(df, numbers, n)
        usable = {c: q for c, q in found.items() if q and q[0] is not None}
        return usable, _outliers(df, usable) if usable else {}

    def repeats_of():
        return duplicate_count(df).first()["duplicate_rows"] if duplicates else None

    # Independent passes are submitted together, so that one fills the cores another leaves.
    (looks, distinct, tops), (quartiles, outliers), repeats = together(
        lambda: looks_and_counts(df, approximate), spread, repeats_of
    )
    kinds = {
        f.name: infer_type(f, looks[f.name], distinct.get(f.name, 0)) for f in df.schema.fields
    }

    rows = []
    for i, f in enumerate(df.schema.fields):
        look, kind = looks[f.name], kinds[f.name]
        missing = n - look["present"]
        row = dict.fromkeys(c.split()[0] for c in COLUMN_SCHEMA.split(", "))
        row.update(
            position=i,
            name=f.name,
            inferred_type=kind,
            dtype=f.dataType.simpleString(),
            missing_count=missing,
            missing_pct=_percent(missing, n),
            unique_count=distinct.get(f.name, 0),
        )
        if kind == "numeric":
            q = quartiles.get(f.name, (None, None, None))
            row.update(
                zip(("p25", "median", "p75"), (_rounded(v) for v in q), strict=True),
                mean=_rounded(look["mean"]),
                std=_rounded(look["std"]),
                min=_rounded(look["min"]),
                max=_rounded(look["max"]),
                skew=_rounded(look["skew"]),
                outlier_count=outliers.get(f.name),
                infinite_count=look["infinite"] or None,
                zero_one=look["zero_one"],
            )
        elif kind in ("categorical", "boolean"):
            row["top_values"] = tops.get(f.name)
        elif kind == "datetime":
            row.update(min_date=look["min_date"], max_date=look["max_date"])
        rows.append(Row(**row))
    columns = spark.createDataFrame(rows, COLUMN_SCHEMA)
    missing_total = sum(r["missing_count"] for r in rows)
    sampled = total_rows is not None and total_rows > n
    dataset = spark.createDataFrame(
        [
            (
                total_rows if sampled else n, len(rows), repeats, missing_total,
                _percent(missing_total, n * len(rows)), sampled, n if sampled else None,
                total_columns,
            )
        ],
        DATASET_SCHEMA,
    )
    candidates = correlation_columns(rows, max_correlated) if correlate else []
    return Profile(columns, dataset, correlation_pairs(df, candidates), tuple(rows), n)


def profile_warnings(columns: DataFrame, dataset: DataFrame) -> DataFrame:
    """(scope, message): data-quality notes about columns and the whole table."""
    name, n = F.col("name"), F.col("unique_count")
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    rows = dataset.select(
        F.coalesce("sample_rows", "n_rows").alias("scanned_rows"),
        "n_rows", "n_cols", "duplicate_rows", "sampled", "total_columns",
    )
    scanned = rows.select("scanned_rows").first()["scanned_rows"]
    # The wording of the notes.
    notes = F.array(
        F.when(
            F.col("infinite_count") > 0,
            F.concat(quoted, F.format_string(
                " has %,d infinite values (excluded from stats).", F.col("infinite_count"))),
        ),
        F.when(
            F.col("missing_pct") > HIGH_MISSING_PCT,
            F.concat(quoted, F.format_string(" is %.1f%% missing.", F.col("missing_pct"))),
        ),
        F.when(
            (n <= 1) & F.lit(scanned > 1),
            F.concat(quoted, F.lit(" is constant and carries no information.")),
        ),
        F.when(
            (F.col("inferred_type") == "categorical") & (n > HIGH_CARDINALITY),
            F.concat(quoted, F.format_string(" is high-cardinality (%,d distinct values).", n)),
        ),
    )
    per_column = columns.select(
        name.alias("scope"), F.explode(F.array_compact(notes)).alias("message")
    )
    whole = F.array(
        F.when(
            F.col("sampled"),
            F.format_string("Statistics were computed on a random sample of %,d of %,d rows.",
                            F.col("scanned_rows"), F.col("n_rows")),
        ),
        F.when(
            F.col("total_columns") > F.col("n_cols"),
            F.format_string("Only the first %d of %d columns were profiled.",
                            F.col("n_cols"), F.col("total_columns")),
        ),
        F.when(
            F.col("duplicate_rows") > 0,
            F.format_string("%,d fully duplicated rows.", F.col("duplicate_rows")),
        ),
    )
    table = rows.select(
        F.lit(None).cast("string").alias("scope"),
        F.explode(F.array_compact(whole)).alias("message"),
    )
    return per_column.unionByName(table)


def type_tally(columns: DataFrame) -> DataFrame:
    return columns.groupBy("inferred_type").agg(F.count("*").alias("n_columns"))
