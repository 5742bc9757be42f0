"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mixture. Its mean repetition rate is the
wanted number of bytes over the bytes it has. A document's number of copies is
the value of a Poisson distribution with that mean at a number in [0, 1) taken
from a digest of seed, id and text, so a rerun, a retried task or another
cluster gives the same copies. The mean of the counts is the rate: fractional
rates need no separate sampling step. Copies are dealt over the whole output in
digest order, through a range exchange, so no source stays together.

Rates above ``STEP`` are sums of independent draws with smaller means, which is
again Poisson and keeps the table of the distribution short.

Only functions of the JVM are used. Sources are summed with partial sums and
joined back: broadcast up to a checked number of sources, else sorted, and
adaptive execution splits a hot source.

Null source: a source of its own. Null text: no bytes. A document counts one
byte more than its text, so no source has size zero. Weights that are null or
not above zero, and sources that the weights do not name, get rate 0 when a
weight table is given. Rows that share an id, or have none, are drawn and
placed each on its own, by their texts; rows with equal id and text have equal
counts. A text is whole in its row, however long. An
empty table gives an empty mixture. Columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import text_of, without

STEP = 8
#: Entries of the distribution per draw: the tail beyond it is far below the step of the draws, 2 ** -52.
ENTRIES = 64
#: Up to this many sources, 12 MB of distributions, every executor gets them and no text moves before the shuffle.
BROADCAST_SOURCES = 20_000
RESULT = ["rate", "copy_no", "mix_key"]


def unit(seed: int, key: Column, draw: Column) -> Column:
    """A number in [0, 1) with 52 random bits."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("out"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES)),
        start,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            (s["sum"] + s["p"] * mean / k).alias("sum"),
            F.concat(s["out"], F.array(s["sum"] + s["p"] * mean / k)).alias("out"),
        ),
        lambda s: s["out"],
    )


def source_rates(docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.5, epochs: float = 1.0, text_col: str = "text") -> DataFrame:
    """Per source: ``rate``, the number of draws and the distribution of one draw.

    ``weights`` has ``source, weight``; without it a source weighs its size to
    the power ``exponent``. ``epochs`` scales the mixture against the corpus.
    """
    sizes = docs.groupBy("source").agg(F.sum((F.octet_length(text_of(text_col)) + 1).cast("double")).alias("bytes"))
    if weights is None:
        known = sizes.withColumn("weight", F.pow("bytes", F.lit(float(exponent))))
    else:
        given = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
        usable = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0))
        known = sizes.join(given.withColumnRenamed("source", "__v_s"), F.col("source").eqNullSafe(F.col("__v_s")), "left").select(
            "source", "bytes", usable.alias("weight")
        )
    # One row: the totals over the sources, and their number.
    whole = known.agg(F.coalesce(F.sum("bytes"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    scale = whole[0] * epochs / whole[1] if whole[1] else 0.0
    rate = F.lit(scale) * F.col("weight") / F.col("bytes")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(float(STEP))).cast("int"))
    rates = (
        known.select("source", rate.alias("rate"))
        .withColumn("__v_draws", draws)
        .withColumn("__v_table", poisson_table(F.col("rate") / F.col("__v_draws")))
    )
    return F.broadcast(rates) if whole[2] <= BROADCAST_SOURCES else rates


def copies(rates: DataFrame, docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__v_key``, the rate of its source and the number of copies."""
    key = F.col("__v_key")
    count = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.col("__v_draws")),
            lambda j: F.aggregate(
                F.array(unit(seed, key, j)),
                F.lit(0),
                lambda n, u: n + F.size(F.filter(F.col("__v_table"), lambda p: p <= u)),
            ),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    renamed = rates.withColumnRenamed("source", "__v_source")
    # Id and text together: rows that share an id, or have none, are drawn and placed each on its own.
    own = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col)))
    named = docs.withColumn("__v_key", own)
    return named.join(renamed, F.col("source").eqNullSafe(F.col("__v_source")), "inner").withColumn("__v_copies", count)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 7,
    id_col: str = "doc_id",
    shuffle: bool = True,
) -> DataFrame:
    """The mixture: ``docs`` with ``rate, copy_no, mix_key``, one row per copy, in the order of ``mix_key``."""
    base = without(docs, RESULT)
    counted = copies(source_rates(base, weights, exponent, epochs), base, seed, id_col)
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("copy_no").cast("string"), F.col("__v_key")))
    out = (
        counted.where("__v_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__v_copies"))))
        .select(*[F.col(f"`{c}`") for c in base.columns], "rate", "copy_no", F.substring(key, 1, 16).alias("mix_key"))
    )
    return out.repartitionByRange("mix_key").sortWithinPartitions("mix_key") if shuffle else out


def op1_mixing(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mix(docs).withColumn("rate", F.round("rate", 9))


OP1_SQL = f"""
WITH sizes AS (
  SELECT source, SUM(CAST(COALESCE(strlen(text), 0) + 1 AS DOUBLE)) AS bytes FROM documents GROUP BY source
), weighed AS (
  SELECT source, bytes, pow(bytes, 0.5) AS weight FROM sizes
), rated AS (
  SELECT source, ((SELECT SUM(bytes) / SUM(weight) FROM weighed) * weight / bytes) AS rate FROM weighed
), drawn AS (
  SELECT *, GREATEST(1, CAST(CEIL(rate / {STEP}.0) AS INTEGER)) AS draws FROM rated
), entry AS (
  SELECT source, k, exp(-rate / draws) * pow(rate / draws, k) / gamma(CAST(k + 1 AS DOUBLE)) AS p
  FROM drawn, range(0, {ENTRIES + 1}) t(k)
), entries AS (
  SELECT source, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS below FROM entry
), tables AS (
  SELECT source, list(below ORDER BY k) AS cdf FROM entries GROUP BY source
), units AS (
  SELECT d.doc_id, r.source, j,
         CAST(('0x' || substr(md5('7|' || j || '|' || COALESCE(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(COALESCE(d.text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN drawn r ON d.source IS NOT DISTINCT FROM r.source, range(1, 1001) t(j) WHERE j <= r.draws
), counted AS (
  SELECT u.doc_id, SUM(len(list_filter(t.cdf, lambda p: p <= u.u))) AS n
  FROM units u JOIN tables t ON u.source IS NOT DISTINCT FROM t.source GROUP BY u.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, ROUND(r.rate, 9) AS rate, CAST(c.k AS INTEGER) AS copy_no,
       substr(md5('order7|' || c.k || '|' || COALESCE(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(COALESCE(d.text, ''))), 1, 16) AS mix_key
FROM documents d JOIN drawn r ON d.source IS NOT DISTINCT FROM r.source JOIN counted n ON n.doc_id = d.doc_id,
     range(1, 1001) c(k) WHERE c.k <= n.n
"""
