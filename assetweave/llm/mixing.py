"""Mixing sources to target weights by Poisson replication.

Each source has a target weight; its documents are to be repeated weight * total / size times on average. A
document's count is the inverse of the Poisson distribution with that mean at a number from 0 to 1 hashed from the
seed and its id, so that it is the same on every run and in every order. Each document is exploded by its count,
and all copies are shuffled: a hash of seed, id and copy deals them to partitions and orders them within.

Defined cases: null sources are one source; a null doc_id is hashed as the text 'null'; rows that repeat a doc_id
get the same count each; sources of weight 0 go; a count of a rate over MOST_RATE is the sum of such draws of equal
lesser rates, each at a hash of its own; weights or a total that are given and lead to such rates are refused; an
empty table gives no rows; the columns of docs pass through whatever their names, of which copy and shuffle_key are overwritten.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import partitions, unused, written

SEED = "mix-1"
#: The default weight of a source is its size to this power.
TEMPERATURE = 0.5
MOST_RATE = 500.0
#: Sources up to this number are broadcast with their distributions, about 1 kB each.
BROADCAST_SOURCES = 20_000


def hashed(*parts: Column | str) -> Column:
    """52 bits of the parts' MD5 as an integer."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def distribution(rate: Column) -> Column:
    """Array: chance of at most k, for k from 0 until chances no longer count."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(first.alias("p"), F.array(first).alias("c")), step, lambda acc: acc["c"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, rate): weights default to size ** TEMPERATURE, total to the number of documents."""
    sizes = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        given = F.broadcast(given) if len(weights) <= BROADCAST_SOURCES else given
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("name")
    all_weight, all_n = sizes.agg(F.sum("weight"), F.sum("n")).first()
    scale = float(total if total is not None else all_n or 0)
    share = F.col("weight") / F.lit(all_weight) if all_weight else F.lit(0.0)
    return sizes.select("source", (share * F.lit(scale) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None) -> DataFrame:
    """The copies of docs in their shuffled order, with copy (from 1) and shuffle_key."""
    by_source = rates(docs, weights, total)
    n, top = by_source.agg(F.count(F.lit(1)), F.max("rate")).first()
    given = weights is not None or total is not None
    if given and top is not None and not (math.isfinite(top) and top <= MOST_RATE):
        raise ValueError(f"a source would have to be repeated {top} times; the most is {MOST_RATE}")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE).cast("int"))
    kept = docs.drop("copy", "shuffle_key")
    name, times, chances, repeats = unused(kept, "name", "draws", "chances", "count")
    by_source = by_source.select(F.col("source").alias(name), draws.alias(times), distribution(F.col("rate") / draws).alias(chances))
    if n <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    counted = kept.join(by_source, F.col("source").eqNullSafe(F.col(name)))
    draw = lambda *more: F.size(F.filter(chances, lambda c: c <= hashed("doc_id", *more) / F.lit(float(2**52))))
    others = F.aggregate(F.sequence(F.lit(2), F.col(times)), F.lit(0), lambda acc, k: acc + draw(k))
    count = draw() + F.when(F.col(times) > 1, others).otherwise(0)
    copies = counted.withColumn(repeats, count).where(F.col(repeats) > 0).select(*kept.columns, F.explode(F.sequence(F.lit(1), F.col(repeats))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", hashed(F.lit("order"), "doc_id", "copy"))
    return keyed.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM s),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS chance FROM (SELECT source, rate, unnest(range(ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k FROM r)),
u AS (SELECT *, ('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT / 4503599627370496.0 AS at FROM documents),
m AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(c.k) AS times
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.chance <= u.at GROUP BY ALL),
x AS (SELECT * EXCLUDE times, unnest(range(1, times + 1))::INT AS copy FROM m)
SELECT *, ('0x' || md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy)[1:13])::BIGINT AS shuffle_key FROM x
"""
