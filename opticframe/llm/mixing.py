"""Mixing sources to target weights by Poisson replication.

A source of n rows whose share of the mixture is to be w gets the repetition rate w * total / n.  Each
document's copy count is the inverse of the Poisson distribution with that mean at a uniform number
hashed from the seed and the document, so a run that is repeated, or a task that is, makes the same
copies.  Documents are exploded by their count and dealt out by a hash of (seed, document, copy), which
also orders each part: a global shuffle.  Sources are a table, of which the driver gets only totals; but for
their distribution functions, a few numbers a source, all is DataFrame functions.

Defined results: rows with a null source are one source of their own; rows without doc_id, and those of a doc_id
that has several texts, are told apart by the text's hash, so that only equal rows get equal counts; a source without a weight gets the rate 0
where weights are given; a weight for a source without rows goes to the others in proportion; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import HEAVY, Scratch, attach

#: A source's distribution function is tabled over so many standard deviations around its mean: beyond, a double's uniform number does not reach.
DEVIATIONS = 9
#: Sources, and numbers in their tables, up to which the tables are broadcast.
BROADCAST_SOURCES, BROADCAST_NUMBERS = 5000, 2_000_000


def uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """(least count, distribution function from there on) of a Poisson distribution: the count at u is least + how many of them are <= u."""
    if rate <= 0:
        return 0, [1.0]
    least = max(0, math.floor(rate - DEVIATIONS * math.sqrt(rate)))
    last = math.ceil(rate + DEVIATIONS * math.sqrt(rate) + 40)
    out, total = [], 0.0
    for k in range(least, last + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if total >= 1 - 2**-53:
            break
    out[-1] = 1.0
    return least, out


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """(_source, _n, _rate) of each source: rows and repetition rate, from a count that is summed before it is shuffled.

    Without weights a source's target share is in proportion to its rows to the power `temperature`;
    total: rows of the mixture (by default as many as there are).
    """
    sized = docs.groupBy(F.col("source").cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        wanted = sized.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_given string, _w double")
        wanted = sized.join(F.broadcast(given), F.col("_source").eqNullSafe(F.col("_given")), "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))  # as many rows as the caller named
    wanted = Scratch(docs.sparkSession, "sources").save(wanted.select("_source", "_n", "_w"))
    most, rows = wanted.agg(F.max("_w"), F.sum("_n")).first()
    if not most:
        return wanted.select("_source", "_n", F.lit(0.0).alias("_rate"))
    # of decimals, so that the sum is the same in whatever order the sources come
    whole = float(wanted.agg(F.sum((F.col("_w") / F.lit(most)).cast("decimal(38,18)"))).first()[0]) * most
    return wanted.select("_source", "_n", (F.col("_w") / F.lit(whole) * F.lit(float(total if total is not None else rows)) / F.col("_n")).alias("_rate"))


def tables(known: DataFrame) -> DataFrame:
    """Sources (_source, _n, _rate) with _least and _table: their distribution functions."""
    ship(known.sparkSession)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, table = zip(*map(poisson_table, batch.column(2).to_pylist())) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int32()), pa.array(table, pa.list_(pa.float64()))], names=["_source", "_n", "_rate", "_least", "_table"])

    return Scratch(known.sparkSession, "poisson").save(known.mapInArrow(tabled, "_source string, _n long, _rate double, _least int, _table array<double>"))


def told_apart(drawn: DataFrame) -> DataFrame:
    """Rows (_id, _h: the text's hash) with _t, that hash where _id is null or has rows of other texts, else null, and
    _salt, the row's number where _id is null or is that of very many rows, else null."""
    key = F.when(F.col("_id").isNull(), F.xxhash64("_h", F.lit(3))).otherwise(F.xxhash64("_id"))
    drawn = drawn.withColumn("_doc_key", key).withColumn("_row", F.monotonically_increasing_id())
    ids = drawn.where(F.col("_id").isNotNull()).groupBy("_doc_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    repeated = Scratch(drawn.sparkSession, "mixing").save(ids.where("_n > 1").select("_doc_key", "_n", (F.col("_lo") != F.col("_hi")).alias("_several")))
    if repeated.isEmpty():
        drawn = drawn.withColumn("_several", F.lit(False)).withColumn("_many", F.lit(False))
    else:
        total = drawn.count()
        many = repeated.where(F.col("_n") * F.lit(HEAVY) > F.lit(total)).select("_doc_key", F.lit(True).alias("_many"))
        drawn = drawn.join(F.broadcast(many), "_doc_key", "left")  # fewer than HEAVY ids
        if repeated.where("_several").isEmpty():
            drawn = drawn.withColumn("_several", F.lit(False))
        else:  # those of one text are there for attach to know what is heavy
            drawn = attach(drawn, repeated, "_doc_key", "_n", total)
    alone = F.col("_id").isNull()
    drawn = drawn.withColumn("_t", F.when(alone | F.coalesce("_several", F.lit(False)), F.col("_h")))
    return drawn.withColumn("_salt", F.when(alone | F.coalesce("_many", F.lit(False)), F.col("_row"))).drop("_h", "_doc_key", "_several", "_many", "_row")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 0, temperature: float = 0.5, total: float | None = None, details: bool = False) -> DataFrame:
    """The mixture: the documents' rows as often as drawn, in global random order; with details also _copy, _copies, _rate and _shuffle_key."""
    known = tables(rates(docs, weights, temperature, total))
    sources, numbers, rows = known.agg(F.count(F.lit(1)), F.sum(F.size("_table")), F.sum("_n")).first()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    drawn = docs.select(F.struct(*cols).alias("_doc"), F.col("source").cast("string").alias("_s"), F.col("doc_id").cast("string").alias("_id"), F.xxhash64("text").alias("_h"))
    drawn = told_apart(drawn)
    if sources <= BROADCAST_SOURCES and (numbers or 0) <= BROADCAST_NUMBERS:
        drawn = drawn.join(F.broadcast(known), F.col("_s").eqNullSafe(F.col("_source")))
    else:  # large sources are met by a broadcast, the others by a shuffle
        name = lambda c: F.unhex(F.md5(F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(c), F.lit("")))))
        drawn = attach(drawn.withColumn("_key_of", name("_s")), known.withColumn("_key_of", name("_source")).drop("_source"), "_key_of", "_n", rows)
    drawn = drawn.withColumn("_u", uniform(seed, "_id", "_t"))
    drawn = drawn.withColumn("_copies", F.col("_least") + F.size(F.filter("_table", lambda x: x <= F.col("_u"))))
    copies = drawn.where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    copies = copies.withColumn("_shuffle_key", F.xxhash64(F.lit(seed), "_id", "_t", "_copy"))
    extra = ["_copy", "_copies", "_rate", "_shuffle_key"] if details else []
    # the salt deals out rows that are told apart by nothing else, or share one doc_id
    return copies.repartition("_shuffle_key", "_salt").sortWithinPartitions("_shuffle_key", "_id").select("_doc.*", *extra)
