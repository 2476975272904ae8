"""Checking that numbers quoted in texts are backed by computed results.

``claims(doc_id, location, text)`` are matched against ``evidence(doc_id, pool, value)``.
Pools keep kinds apart: a figure printed as a percentage is only matched against percents, a
multiple against ratios, anything else against numbers and percents. A figure is backed if the
nearest evidence below or above it is within the tolerance, so it meets no other evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import literal
from ..staging import stage
from .nearest import nearest_known
from .skew import salted_join

# What counts as a number, and what is left out of the check. The hyphen, plus
# and minus signs may precede a number; a number glued to a word or a decimal is not one.
NUMBER = (
    r"(?=[-+−\d])(?<![\w.])([-+−]?\d{1,3}(?:,\d{3})+|[-+−]?\d+(?:\.\d+)?)"
    r"\s*(%|×|x\b|[KMB]\b|pp\b|points?\b)?(?!\w)"
)
SCIENTIFIC = r"\d+(?:\.\d+)?\s*(?:[eE]|×\s*10\^?)[-+−]?\d+"
P_THRESHOLD = r"p(?<=\bp)\s*(?:<|≤|<=)\s*$"
PERCENT_NAME = r"(?i)(?:^|_)(?:pct|percent|percentage|rate)(?:_|$)"
SMALL_INTEGER = 12
FIRST_YEAR, LAST_YEAR = 1900, 2100
PERCENT_UNITS = ("%", "pp", "point", "points")
RATIO_UNITS = ("×", "x")
SCALES = {"K": 1e3, "M": 1e6, "B": 1e9}
SCALED_TOLERANCE = 0.05
CONTEXT = 40
NUMBERS, PERCENTS, RATIOS = "numbers", "percents", "ratios"
# Java reads \w as ASCII only; the flag makes words and digits Unicode-aware.
_UNICODE = "(?U)"
# Matches are found one after the other, so their positions follow from the text between them.
_MARK = "\u0001"
# Between a match and its groups; no number holds it.
_PART = "\u0002"


# Characters of scientific notation and their stand-ins from the private use area.
_EXPONENT_CHARS = "0123456789.eE+-−^×"
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_EXPONENT_CHARS)))
# A number and the text next to it alternate, so this many pieces hold 40 characters; mostly a
# few do.
_NEAR = CONTEXT + 1
_FEW = 3


def _pattern(pattern: str) -> str:
    return _UNICODE + pattern


def _pieces(text: Column, pattern: str, groups: int = 0) -> Column:
    """Text cut at the matches of a pattern: text and matches alternate, matches at odd places.

    Groups of the pattern follow their match, so that none is searched again.
    """
    shown = _PART.join(f"${g + 1}" for g in range(groups + 1))
    marked = F.regexp_replace(text, _pattern(f"({pattern})"), f"{_MARK}{shown}{_MARK}")
    return F.split(marked, _MARK, -1)


def hide_scientific(text: Column) -> Column:
    """Put stand-ins for scientific notation, so no exponent is read as a number of its own."""
    hidden = F.array_join(
        F.transform(
            _pieces(text, SCIENTIFIC),
            lambda part, i: F.when(
                i % 2 == 1, F.translate(part, _EXPONENT_CHARS, _HIDDEN)
            ).otherwise(part),
        ),
        "",
    )
    return F.when(text.rlike(_pattern(SCIENTIFIC)), hidden).otherwise(text)


def _restored(text: Column) -> Column:
    return F.translate(text, _HIDDEN, _EXPONENT_CHARS)


def extract_numbers(
    claims: DataFrame, text: str = "text", scientific: bool = True, context: bool = True
) -> DataFrame:
    """One row per number of a text: the other input columns plus seq (order in the text),
    token, raw, unit, value, decimals, threshold (it follows "p <") and, if asked, context.

    Everything a number needs from its text is taken while the text is still one row, so the
    text itself is neither repeated per number nor shuffled.
    """
    clean = F.replace(F.col(text), F.lit(_MARK), F.lit(" "))
    source = hide_scientific(clean) if scientific else clean
    kept = [F.col(c) for c in claims.columns if c != text]

    def near(i: Column) -> Column:
        """The text next to piece ``i``, of the ends of pieces: a few if they hold enough."""

        def before(pieces: int) -> Column:
            start = F.greatest(i + 1 - pieces, F.lit(1))
            return F.array_join(F.slice("tails", start, i + 1 - start), "")

        def after(pieces: int) -> Column:
            return F.array_join(F.slice("heads", i + 2, F.lit(pieces)), "")

        def enough(text: Callable[[int], Column]) -> Column:
            few = text(_FEW)
            return F.when(F.length(few) >= CONTEXT, few).otherwise(text(_NEAR))

        around = (
            F.right(enough(before), F.lit(CONTEXT)).alias("before"),
            F.left(enough(after), F.lit(CONTEXT)).alias("after"),
        )
        piece = F.element_at("pieces", i + 1)
        return F.struct(
            ((i - 1) / 2).cast("int").alias("seq"),
            F.substring_index(piece, _PART, 1).alias("token"),
            F.substring_index(F.substring_index(piece, _PART, 2), _PART, -1).alias("raw"),
            F.nullif(F.substring_index(piece, _PART, -1), F.lit("")).alias("unit"),
            F.element_at("pieces", i).rlike(_pattern(P_THRESHOLD)).alias("threshold"),
            *(around if context else ()),
        )

    def ends(cut: Callable[[Column, Column], Column]) -> Column:
        """One end of every piece; of matches without their groups."""
        return F.transform(
            "pieces",
            lambda p, i: cut(
                F.when(i % 2 == 1, F.substring_index(p, _PART, 1)).otherwise(p), F.lit(CONTEXT)
            ),
        )

    found = F.array_compact(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, near(i))))
    sides = (ends(F.right).alias("tails"), ends(F.left).alias("heads"))
    rows = (
        claims.select(*kept, _pieces(source, NUMBER, groups=2).alias("pieces"))
        .select(*kept, "pieces", *(sides if context else ()))
        .select(*kept, found.alias("found"))
        # The outer form: the plain one would be filtered first, which reads every text twice.
        .select(*kept, F.inline_outer("found"))
        .where("token IS NOT NULL")
    )
    near_text = _restored(F.concat("before", "token", "after"))
    parsed = rows.select(
        *kept,
        "seq",
        F.trim(F.regexp_replace("token", r"\s+", " ")).alias("token"),
        "raw",
        "unit",
        "threshold",
        *([F.btrim(near_text, F.lit(" \n\r\t")).alias("context")] if context else ()),
    )
    cleaned = F.replace(F.replace("raw", F.lit(",")), F.lit("−"), F.lit("-"))
    scale = F.when(F.col("unit") == "K", SCALES["K"]).when(F.col("unit") == "M", SCALES["M"])
    scale = scale.when(F.col("unit") == "B", SCALES["B"]).otherwise(1.0)
    decimals = F.when(cleaned.contains("."), F.length(F.substring_index(cleaned, ".", -1)))
    return parsed.withColumns(
        {"value": cleaned.try_cast("double") * scale, "decimals": F.coalesce(decimals, F.lit(0))}
    )


def pool_of(unit: Column) -> Column:
    return (
        F.when(unit.isin(*PERCENT_UNITS), PERCENTS)
        .when(unit.isin(*RATIO_UNITS), RATIOS)
        .otherwise(NUMBERS)
    )


def checkable(numbers: DataFrame) -> DataFrame:
    """Drop small bare integers, years and significance thresholds."""
    bare = F.col("unit").isNull() & (F.col("decimals") == 0)
    small = F.abs("value") <= SMALL_INTEGER
    year = F.col("value").between(FIRST_YEAR, LAST_YEAR)
    return numbers.where(
        F.col("value").isNotNull() & ~(bare & (small | year)) & ~F.col("threshold")
    )


def _tolerance() -> Column:
    printed = F.pow(F.lit(10.0), -F.col("decimals")) / 2 + 1e-9
    scaled = F.coalesce(F.col("unit").isin(*SCALES), F.lit(False))
    return F.when(scaled, F.abs("value") * SCALED_TOLERANCE).otherwise(printed)


def ground_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every checkable number of the claims with ``supported``.

    Distinct (document, value, precision, pool) are matched once, with the nearest evidence of
    their document in every pool.
    """
    keyed = checkable(extract_numbers(claims)).withColumns(
        {"target": F.abs("value"), "tolerance": _tolerance(), "pool": pool_of(F.col("unit"))}
    )
    keyed = stage(keyed)
    match = ["doc_id", "pool", "target", "tolerance"]
    facts = evidence.select("doc_id", F.col("pool").alias("kind"), F.col("value").alias("known"))
    pools = (NUMBERS, PERCENTS, RATIOS)
    near = nearest_known(
        keyed.select(*match).distinct(), facts, ["doc_id"], "target", "known", "kind", pools
    )

    def within(pool: str) -> Column:
        gap = F.least(
            F.col("target") - F.col(f"{pool}_below"), F.col(f"{pool}_above") - F.col("target")
        )
        return F.coalesce(gap <= F.col("tolerance"), F.lit(False))

    backed = F.when(F.col("pool") == NUMBERS, within(NUMBERS) | within(PERCENTS))
    backed = backed.when(F.col("pool") == PERCENTS, within(PERCENTS)).otherwise(within(RATIOS))
    hits = near.where(backed).select(*match, F.lit(True).alias("hit"))
    out = salted_join(keyed, hits, match, ["location", "seq"], "left")
    kept = [c for c in claims.columns if c != "text"]
    return out.select(
        *kept,
        "seq",
        "token",
        "unit",
        "value",
        "decimals",
        F.coalesce("hit", F.lit(False)).alias("supported"),
        "context",
    )


def grounding_report(grounded: DataFrame) -> DataFrame:
    """(doc_id, checked, unverified_count): numbers checked and left unmatched per document."""
    return grounded.groupBy("doc_id").agg(
        F.count("*").alias("checked"), F.count_if(~F.col("supported")).alias("unverified_count")
    )


def unverified_numbers(grounded: DataFrame) -> DataFrame:
    """(doc_id, location, value, context) of every unmatched number."""
    return grounded.where(~F.col("supported")).select(
        "doc_id", "location", F.col("token").alias("value"), "context"
    )


# Report fields that hold references, not prose.
SKIPPED_FIELDS = (
    "finding_ids", "finding_id", "layout", "metric", "chart", "column", "confidence",
)


def report_texts(documents: DataFrame, json: str = "report") -> DataFrame:
    """Flatten nested JSON reports to (doc_id, location, text), skipping reference fields.

    Each round opens one nesting level of all documents at once, however deep they go.
    """
    skipped = ", ".join(literal(s) for s in SKIPPED_FIELDS)
    level = documents.selectExpr("doc_id", "'' AS path", f"parse_json({json}) AS node")
    out = None
    while True:
        kinds = level.withColumn("kind", F.expr("schema_of_variant(node)"))
        kinds = stage(kinds)
        texts = kinds.where("kind = 'STRING'").selectExpr(
            "doc_id", "path AS location", "CAST(node AS STRING) AS text"
        )
        out = texts if out is None else out.unionByName(texts)
        nested = kinds.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'")
        if nested.isEmpty():
            return out
        opened = nested.lateralJoin(
            documents.sparkSession.tvf.variant_explode(F.col("node").outer())
        )
        level = opened.where(f"key IS NULL OR key NOT IN ({skipped})").selectExpr(
            "doc_id",
            "CASE WHEN key IS NULL THEN concat(path, '[', pos, ']') "
            "WHEN path = '' THEN key ELSE concat(path, '.', key) END AS path",
            "value AS node",
        )


# ---------------------------------------------------------------- evidence pools


def is_percent_name(name: Column) -> Column:
    return name.rlike(PERCENT_NAME)


def _long(df: DataFrame, doc_id: Column, pool: str, value: Column) -> DataFrame:
    return df.select(
        doc_id.alias("doc_id"), F.lit(pool).alias("pool"), F.abs(value.cast("double")).alias("value")
    ).where("value IS NOT NULL AND value < double('Infinity')")


STATISTICS = (
    "mean", "std", "min", "p25", "median", "p75", "max", "skew",
    "outlier_count", "infinite_count",
)
COUNTS = ("missing_count", "unique_count")


def evidence_from_profile(
    columns: DataFrame, dataset: DataFrame, correlations: DataFrame, doc_id: Column
) -> DataFrame:
    """Numbers a profile backs: statistics, gaps and their complements, top-value counts."""
    every = (*COUNTS, *STATISTICS)
    stats = columns.select(
        "name",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v"))
                    for s in every
                ]
            )
        ),
    )
    percent = is_percent_name(F.col("name")) & ~F.col("stat").isin(*COUNTS)
    gaps = columns.select(
        F.explode(F.array(F.col("missing_pct"), 100 - F.col("missing_pct"))).alias("v")
    )
    tops = columns.select(F.explode("top_values").alias("t")).select(F.col("t.count").alias("v"))
    parts = [
        _long(stats, doc_id, NUMBERS, F.col("v")),
        _long(stats.where(percent), doc_id, PERCENTS, F.col("v")),
        _long(gaps, doc_id, PERCENTS, F.col("v")),
        _long(dataset, doc_id, PERCENTS, F.col("missing_pct_total")),
        _long(tops, doc_id, NUMBERS, F.col("v")),
        _long(correlations, doc_id, NUMBERS, F.col("r")),
    ]
    return _union(parts).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evidence_from_findings(findings: DataFrame, doc_id: Column) -> DataFrame:
    """Numbers findings back: texts, labels, effects, p, q, chart values and comparisons."""
    percent = F.col("chart.value_format") == "percent"
    chart_pool = F.when(percent, PERCENTS).otherwise(NUMBERS)
    labels = F.transform("chart.points", lambda p: p["category"])
    texts = findings.select(
        "dimension",
        F.explode(F.concat(F.array("summary", "headline", "title"), "caveats", labels)).alias(
            "text"
        ),
    ).where("text IS NOT NULL")
    quoted = extract_numbers(texts, scientific=False)
    in_text = quoted.select(
        doc_id.alias("doc_id"), pool_of(F.col("unit")).alias("pool"), F.abs("value").alias("value")
    ).where("value IS NOT NULL")
    banded = findings.where(is_percent_name(F.coalesce("dimension", F.lit("")))).select(
        F.explode(labels).alias("text")
    )
    band_numbers = extract_numbers(banded, scientific=False)
    unscaled = F.regexp_replace(F.regexp_replace("raw", ",", ""), "−", "-").try_cast("double")
    points = findings.select(
        chart_pool.alias("pool"), F.explode("chart.points").alias("p")
    ).select("pool", F.col("p.value").alias("v"))
    references = findings.select(chart_pool.alias("pool"), F.col("chart.reference").alias("v"))
    facts = findings.select(
        chart_pool.alias("pool"), F.explode(F.map_values("facts")).alias("fact")
    ).select("pool", F.col("fact").try_cast("double").alias("v"))
    ratio_effects = findings.where("effect.name = 'rate ratio'")

    def pooled(df: DataFrame, v: Column) -> DataFrame:
        return df.select(
            doc_id.alias("doc_id"), "pool", F.abs(v.cast("double")).alias("value")
        ).where("value IS NOT NULL AND value < double('Infinity')")

    parts = [
        in_text,
        _long(band_numbers, doc_id, PERCENTS, unscaled),
        _long(findings, doc_id, NUMBERS, F.col("effect.value")),
        _long(findings, doc_id, NUMBERS, F.col("p_value")),
        _long(findings, doc_id, NUMBERS, F.col("q_value")),
        _long(ratio_effects, doc_id, RATIOS, F.col("effect.value")),
        pooled(points, F.col("v")),
        _long(
            points.where((F.col("pool") == PERCENTS) & F.col("v").between(0, 100)),
            doc_id, PERCENTS, 100 - F.col("v"),
        ),
        pooled(references, F.col("v")),
        pooled(facts, F.col("v")),
        _long(facts.where(F.abs("v") <= 1), doc_id, PERCENTS, F.col("v") * 100),
        comparisons(findings, doc_id),
    ]
    return _union(parts).distinct()


def comparisons(findings: DataFrame, doc_id: Column) -> DataFrame:
    """Gaps, ratios and changes a writer draws from one chart: each point against the
    reference, the largest against the smallest, the first against the last."""
    pool = F.when(F.col("chart.value_format") == "percent", PERCENTS).otherwise(NUMBERS)
    shown = F.transform("chart.points", lambda p: p["value"])
    reference = F.col("chart.reference")
    against = F.when(
        reference.isNotNull(),
        F.transform("vs", lambda v: F.struct(v.alias("a"), reference.alias("b"))),
    ).otherwise(F.array().cast("array<struct<a:double,b:double>>"))
    ends = F.when(
        F.size("vs") > 0,
        F.array(
            F.struct(F.array_max("vs").alias("a"), F.array_min("vs").alias("b")),
            F.struct(F.element_at("vs", 1).alias("a"), F.element_at("vs", -1).alias("b")),
        ),
    ).otherwise(F.array().cast("array<struct<a:double,b:double>>"))
    pairs = (
        findings.select("chart", pool.alias("pool"), shown.alias("vs"))
        .select("pool", F.inline(F.concat(against, ends)))
        .where("a IS NOT NULL AND b IS NOT NULL")
    )
    a, b = F.col("a"), F.col("b")
    rows = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("pool").alias("pool"), F.abs(a - b).alias("value")),
                *[
                    F.struct(F.lit(RATIOS).alias("pool"), F.abs(F.try_divide(x, y)).alias("value"))
                    for x, y in ((a, b), (b, a))
                ],
                *[
                    F.struct(
                        F.lit(PERCENTS).alias("pool"),
                        (F.abs(F.try_divide(x, y) - 1) * 100).alias("value"),
                    )
                    for x, y in ((a, b), (b, a))
                ],
            )
        )
    )
    return rows.where("value IS NOT NULL").select(doc_id.alias("doc_id"), "pool", "value").distinct()
