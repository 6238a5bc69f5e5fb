"""Importance resampling towards a target's distribution, over hashed features.

A document's features become one array of buckets by higher-order functions; its weight is the mean of the buckets' gains,
added up over that array from a literal array of one gain for each bucket. No row for a feature is made for scoring, and of
the corpus only the totals of the buckets are shuffled. Documents are drawn without replacement by adding Gumbel noise, which
follows from the document's id, and taking the highest sums.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.scan import levels, offsets

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Runs of letters and digits of ASCII and of anything beyond it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def bucket_array(text: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to `longest` consecutive words, joined by a blank; repeated runs count each."""
    bucket = lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")
    if longest == 1:
        return F.transform(words(text), bucket)

    def runs(w: Column) -> Column:
        of = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda at: bucket(F.array_join(F.slice(w, at, F.lit(k)), " "))))
        return F.flatten(F.array_compact(F.array(*[of(k) for k in range(1, longest + 1)])))

    return F.get(F.transform(F.array(words(text)), runs), F.lit(0))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """For each bucket floor(1000 ln) of its smoothed share in the target against that in docs. `buckets` totals come to the driver."""
    count = lambda df, name: df.select(F.explode(bucket_array(F.col("text"), longest, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))
    both = count(docs, "s").join(count(target, "t"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = cut(every.join(both, "bucket", "left").fillna(0.0, ["s", "t"]))
    s, t = both.agg(F.sum("s"), F.sum("t")).first()
    gain = F.floor(1000 * F.log((F.col("t") + 1) * F.lit(s + buckets) / ((F.col("s") + 1) * F.lit(t + buckets))))
    return [r["g"] for r in both.select("bucket", gain.alias("g")).orderBy("bucket").collect()]


def weight(features: Column, of: list[int]) -> Column:
    """The floored mean of the gains over an array of buckets; 0 if it is empty."""
    table = F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")  # folded to one literal when the plan is made
    total = F.aggregate(features, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    n = F.size(features).cast("long")
    whole = lambda total: F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.get(F.transform(F.array(total), whole), F.lit(0))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel) of an id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of docs (doc_id, text), weighed by how their words fit the texts of target.

    Of the N documents of at least `least` words, the floor(percent N / 100) of highest score are drawn and have a rank; ties go to
    the smaller doc_id, a null one last. Null and empty texts have no features, weight 0 and are not drawn; repeated rows
    are documents each; empty tables give no rows, or gains against nothing. Other columns play no part.
    """
    of = gains(docs, target, longest, buckets)
    n_words = F.size("features") if longest == 1 else F.size(words(F.col("text")))
    own = docs.select("doc_id", "text", bucket_array(F.col("text"), longest, buckets).alias("features"))
    own = own.select("doc_id", F.size("features").cast("long").alias("n_features"), weight(F.col("features"), of).alias("weight"), (n_words >= least).alias("long"))
    own = cut(own.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))  # a range partition reads its rows twice
    # Ranks: rows are dealt by score, numbered within their part, and parts by a scan over their sizes.
    order = [F.desc("long"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(own.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    sizes = cut(placed.groupBy(F.col("part").alias("node")).agg(F.count("*").alias("s"), F.count(F.when(F.col("long"), 1)).alias("long")))
    eligible, most = sizes.agg(F.sum("long"), F.max("node")).first()
    before = offsets(sizes.select("node", "s"), levels(most or 0)).select(F.col("node").alias("part"), "state")
    rank = F.col("state") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.when(F.col("long") & (rank <= (eligible or 0) * percent // 100), rank)
    return placed.join(before, "part").select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
