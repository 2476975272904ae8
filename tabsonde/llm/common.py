"""What the operators share: the shared folder, staged tables, readings of text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import remove_at_exit

#: The white space that separates words and that exact copies may differ in.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Only where that is unset (one machine, as in tests) a folder of the session's own is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tabsonde-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are larger.

    Texts are long: a batch of ten thousand can take more memory than the work on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, a lost executor costs no earlier work, and a table that several jobs
    read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def keep_rows(docs: DataFrame, decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``docs`` that ``decided`` names, nulls in the keys equal to nulls.

    ``decided`` has the columns ``keys`` alone. Spark broadcasts it if it is small and joins by
    a shuffle otherwise.
    """
    named = decided.select([F.col(k).alias(f"__{k}") for k in keys])
    matches = [docs[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return docs.join(named, condition, "left_semi")


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the least hash of ``key``; the same on every run.

    About twice as many are compared in the end, however many there are.
    """
    total = df.count()
    share = min(1.0, 2.0 * rows / max(total, 1))
    steps = 1 << 20
    near = F.pmod(F.xxhash64(key, F.lit("near")), F.lit(steps)) < int(share * steps) + 1
    return df.where(near).orderBy(F.xxhash64(key), key).limit(rows)


#: A key with more than this share of all rows is joined by broadcast: there are at most as many
#: such keys as its reciprocal.
HOT_SHARE = 0.001


def join_spread(rows: DataFrame, groups: DataFrame, on: list[str], size: str = "size") -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and counts its rows.

    Rows of the most frequent keys stay where they lie, all others are shuffled; so no task gets
    a key with more than HOT_SHARE of the rows. ``groups`` keeps its count out of the result.
    """
    groups = stage(groups, "joined-groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > HOT_SHARE * total
    frequent = F.broadcast(groups.where(hot).drop(size))
    rare = groups.where(~hot).drop(size)
    lying = rows.join(frequent, on)
    moved = rows.join(frequent.select(*on), on, "left_anti").join(rare, on)
    return lying.unionByName(moved)
