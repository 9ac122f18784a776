"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.config import ensure_checkpoint_dir

HELD_OUT_MOD = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all documents that no model may learn from.

    A null id counts as the empty string, so the flag is never null.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == 0


def persisted(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder, read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(df: DataFrame) -> None:
    """Removes a table of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sample_by_hash(docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """``columns`` of the ``n`` rows of ``docs`` with the least hashed ids, in that order.

    The ids are chosen first; only the chosen rows' texts leave their tasks.  Rows with
    the same id follow each other by the hash of their text; never more than ``n`` rows
    are returned, whatever an id holds.
    """
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(n).withColumnRenamed("doc_id", "chosen_id")
    chosen = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi")  # n ids at most
    return chosen.orderBy(order, "doc_id", F.xxhash64("text")).limit(n).select(*columns)


def hashed_place(span: int, *salt: Column) -> Column:
    """A place in ``text`` (from 1) by hash from which ``span`` characters can be read:
    fits that take a bounded part of a sampled text take it anywhere in the whole text."""
    room = F.greatest(F.length("text") - span + 1, F.lit(1))
    return (1 + F.pmod(F.xxhash64("doc_id", "text", *salt), room)).cast("int")


def with_free_names(docs: DataFrame, reserved: tuple[str, ...], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply(docs)`` where columns of ``docs`` named as one that ``apply`` adds on its way
    get other names meanwhile, and their own ones back in the result."""
    taken = {c.lower() for c in docs.columns} | {r.lower() for r in reserved}
    away = {}
    for c in docs.columns:
        if c.lower() in {r.lower() for r in reserved}:
            name = f"{c}_of_input"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            away[c] = name
    out = apply(docs.withColumnsRenamed(away) if away else docs)
    return out.withColumnsRenamed({v: k for k, v in away.items()}) if away else out


# Rows of a narrow table (an id and a flag) that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if a count shows at most ``max_rows`` rows; else it is
    shuffled.  For narrow tables that meet wide rows, which then stay where they are."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
