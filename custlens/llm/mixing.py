"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words (runs of characters other than the space and the control characters
9-13).  The sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share
``budget_share`` (150 %) of all words; a source's target stops at ``max_epochs`` (2)
times its own words and what it cannot take is shared again by weight.  A source takes
its whole text as often as its target holds it (complete epochs); the rest of the target
is a sample without replacement: documents are ordered by the exponential key
``-ln(u) / quality`` and taken up to the word budget by a prefix sum.  ``u`` is hashed
from the document, so reruns agree.  The document on the budget line gives only the
words up to it, so a source's words meet its target to the word.

Quality is the share of letters among the text's characters, from 0.05 for none to 1.05.

The prefix sum does not sort a source: keys fall into buckets by their order, words are
summed per (source, bucket), and only the bucket with the budget line is sorted.  With n
rows there are about sqrt(n) buckets, so both steps stay small beside the source.

Special rows: a null or empty text has size 0 and takes 0; a null source is a source;
repeated rows count each and are told apart by a hash order, then by chance of equal
keys not at all: equal rows are interchangeable; a null doc_id is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.llm.common import persisted, with_free_names

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2.0
# Key buckets per unit of ln(key): the root of the number of rows, within these bounds.
BUCKETS_PER_UNIT = (16, 20_000)

_SPACE = "[\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), "^" + _SPACE + "|" + _SPACE + "$", "")
    return F.when(cut == "", F.lit(0)).otherwise(F.size(F.split(cut, _SPACE))).cast("long")


def quality(text: Column) -> Column:
    """0.05 plus the share of letters among the text's characters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    return F.coalesce(F.lit(0.05) + F.try_divide(letters, F.length(text)), F.lit(0.05))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) hashed from the document."""
    seed = F.md5(F.concat_ws(":", F.lit("mix"), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(seed, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text digest, size, and the exponential key of each row."""
    return docs.select(
        "doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), n_words(F.col("text")).alias("size"),
        (-F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.col("text"))).alias("key"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE,
            max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Sources are capped in the order of ``cap / weight``: going through them in that
    order, a source is capped while its cap lies below its share by weight of what the
    sources before it have left.  This is the fixed point of resharing the excess.
    One row per source in a window: a dimension, not data.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    fits = F.col("cap") <= F.col("level") * F.col("weight")
    return (
        sizes.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(budget_share))
        .withColumns({"level": level, "turn": F.row_number().over(order)})
        # The first source that is not capped sets the level of all from there on.
        .withColumn("first_open", F.min(F.when(~fits, F.struct("turn", "level"))).over(whole))
        .select("source", "source_size", F.round(
            F.when(F.col("turn") >= F.col("first_open.turn"), F.col("first_open.level") * F.col("weight"))
            .otherwise(F.col("cap")), 6).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE,
        max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, digest (of the text), size, source_size, target and taken for every
    row of ``docs``."""
    # Numbered once, so that equal rows stay apart in every later step.
    rows = persisted(sized(docs).withColumn("row", F.monotonically_increasing_id()))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per_source = persisted(per_source)
    aims = targets(per_source.select("source", "source_size"), weights, budget_share, max_epochs)
    n_rows = int(per_source.agg(F.sum("n")).first()[0] or 0)
    per_unit = min(max(math.isqrt(n_rows), BUCKETS_PER_UNIT[0]), BUCKETS_PER_UNIT[1])
    # Whatever the scale of an exponential variable, no unit of its logarithm holds more
    # than 1/e of it: buckets stay small for any qualities.
    rows = rows.withColumn("bucket", F.floor(F.log("key") * per_unit))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    named = F.col("source").eqNullSafe(F.col("source_name"))
    plan = persisted(
        aims.withColumnRenamed("source", "source_name").withColumn("epochs", epochs)
        .withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lines = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .join(plan, named)
        # The first bucket that does not fit whole; none if the rest is 0.
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("line"))
    )
    plan = persisted(
        plan.join(lines, named, "left")
        .select("source_name", "source_size", "target", "epochs", "rest",
                F.col("line.bucket").alias("line_bucket"), F.col("line.before").alias("line_before")))
    joined = rows.join(plan, named).drop("source_name")
    base = F.col("epochs") * F.col("size")
    out = ["doc_id", "source", "digest", "size", "source_size", "target", "taken"]
    on_line = F.col("bucket").eqNullSafe(F.col("line_bucket"))
    sure = joined.where(~on_line).withColumn(
        "taken", base + F.when(F.col("bucket") < F.col("line_bucket"), F.col("size")).otherwise(0)).select(*out)
    before = Window.partitionBy("source").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("line_before") - F.coalesce(F.sum("size").over(before), F.lit(0))
    line = joined.where(on_line).withColumn("part", F.least(F.col("size"), F.greatest(left, F.lit(0)))).withColumn(
        "taken", base + F.col("part")).select(*out)
    return sure.unionByName(line)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, with their columns and ``taken`` words.

    Rows equal in doc_id, source and text share the words taken from them evenly
    (rounded down, so their source may miss its target by less than a word a row).  A
    column ``taken`` of the input is replaced, all others are kept, whatever their names.
    """
    reserved = ("mix_doc_id", "mix_source", "mix_digest", "mix_taken")
    return with_free_names(docs, reserved, lambda rows: _mixed(rows, **options))


def _mixed(docs: DataFrame, **options) -> DataFrame:
    key = ["doc_id", "source", "digest"]
    taken = mix(docs, **options).groupBy(*key).agg((F.sum("taken") / F.count(F.lit(1))).cast("long").alias("mix_taken"))
    taken = taken.where("mix_taken > 0").select(*[F.col(c).alias(f"mix_{c}") for c in key], "mix_taken")
    same = (
        F.col("doc_id").eqNullSafe(F.col("mix_doc_id")) & F.col("source").eqNullSafe(F.col("mix_source"))
        & F.md5(F.col("text").cast("binary")).eqNullSafe(F.col("mix_digest"))
    )
    names = [F.col(f"`{c}`") for c in docs.columns if c != "taken"]
    return docs.join(taken, same).select(*names, F.col("mix_taken").alias("taken"))
