"""Alignment of assets by the likeness of their names.

The likeness is 1 - d / (length of the longer name) for d edits, so the longer name's length bounds d. Assets of one name and the same
sources are a class; names are compared once, and links are between classes, so copies of a name cost no pairs.

Candidates are found without loss, in one of three ways, by the shorter name of a pair. For a short name that begins like many
others, as names do that differ in their numbers: all names of its leaf with all of others (leaves). For other short ones: the
partition of the shorter name into segments, of which some are left unchanged; the longer name has them, two at once where edits
are few, shifted as far as the edits allow; cuts are where each segment tells about as much. For a long one: grams of GRAM characters, each edit of
which spoils GRAM at the most; of two names alike, the rarest grams of the one, as many as edits can spoil and one more, have
one in common with those of the other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.operators.leaves import allowed, dense_pairs, in_leaves
from assetweave.operators.ordered import joined_by_size, stored

#: Segments of a name beyond those that its edits can touch and one more.
SPARE = 2
#: Up to so many edits, two segments are looked for at once.
PAIRED = 4
#: The longer names of two segments that more than FREQUENT shorter ones have are dealt to so many tasks.
SHARES, FREQUENT = 8, 1000
#: Shorter names of this length or more are compared by grams.
LONG, GRAM = 32, 3


def _floor(x: str) -> str:
    return f"CAST(floor({x} + 1e-9) AS INT)"


def name_classes(assets: DataFrame) -> DataFrame:
    """(name, sources, class_key, n): assets (asset_key, source, name) of one name and the same sources; class_key is the least
    of their n keys. Names are compared without case and outer blanks; of an asset's names the least counts; assets without a name are left out."""
    return _classes(_named(assets))


def _classes(named: DataFrame) -> DataFrame:
    return named.groupBy("name", "sources").agg(F.min("asset_key").alias("class_key"), F.count(F.lit(1)).alias("n"))


def _named(assets: DataFrame) -> DataFrame:
    name = F.lower(F.trim("name"))
    return assets.groupBy("asset_key").agg(F.min(name).alias("name"), F.array_sort(F.collect_set("source")).alias("sources")).where("name <> ''")


def _cuts(weights: list[float], parts: int) -> list[int]:
    """Where parts segments begin, and the end, so that they weigh about the same and have a character at least."""
    upto = [0.0]
    for w in weights:
        upto.append(upto[-1] + w)
    cuts = [0]
    for k in range(1, parts):
        low, high = cuts[-1] + 1, len(weights) - (parts - k)
        cuts.append(min(range(low, high + 1), key=lambda at: abs(upto[at] - upto[-1] * k / parts)))
    return [*cuts, len(weights)]


def _told(names: DataFrame) -> dict[int, list[float]]:
    """By length, the bits that the character at each place tells, on the mean, to one who knows the two before it; what follows two characters is counted over all lengths and places."""
    at = names.select("size", "name", F.explode(F.sequence(F.lit(1), "size")).alias("at"))
    before = F.expr("substring(name, greatest(at - 2, 1), least(at - 1, 2))")
    counts = stored(at.groupBy("size", "at", before.alias("before"), F.substring("name", F.col("at"), F.lit(1)).alias("char")).agg(F.count(F.lit(1)).alias("n")), "characters")
    these, all_of = counts.groupBy("before", "char").agg(F.sum("n").alias("these")), counts.groupBy("before").agg(F.sum("n").alias("all"))
    bits = F.sum(F.col("n") * F.log2(F.col("all") / F.col("these"))) / F.sum("n")
    rows = counts.join(these, ["before", "char"]).join(all_of, "before").groupBy("size", "at").agg(bits.alias("bits")).orderBy("size", "at").collect()
    return {s: [r.bits for r in rows if r["size"] == s] for s in {r["size"] for r in rows}}


def _couples(cuts: dict[tuple[int, int], list[int]], sizes: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Where the first two segments that edits leave alone are in a shorter name and can be in a longer one.

    cuts: by size and edits; sizes: size, edits, whole. Of the edits, one at least is in each segment before the first of the
    two, and in each between them; and they make up the shifts of the first, of the second against it, and of the end.
    """
    own, there = [], []
    for (size, edits), cut in cuts.items():
        own += [(size, edits, i, j, cut[i], cut[i + 1] - cut[i], cut[j], cut[j + 1] - cut[j]) for j in range(len(cut) - 1) for i in range(j)]
    for size, edits, whole in sizes:
        more = whole - size
        for _, _, i, j, at, length, at2, length2 in [c for c in own if c[:2] == (size, edits)]:
            for x in range(-edits, edits + 1):
                for y in range(-edits, edits + 1):
                    if max(i, abs(x)) + max(j - i - 1, abs(y - x)) + abs(more - y) <= edits and at + x >= 0 and at2 + y >= at + x + length and at2 + y + length2 <= whole:
                        there.append((whole, size, edits, i, j, at + x, length, at2 + y, length2))
    return own, there


def _short_pairs(texts: DataFrame, shorter: DataFrame, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """(a, b, edits): candidates of which the shorter one is one of shorter, and the edits allowed; a pair may come more than once.

    With few edits d, a name is cut into d + 2 segments, two of which the longer name has too, each shifted: the shifts
    of the one, of the other against it and of the end are edits. Names that have only common words alike don't meet so.
    With more edits it is cut into SPARE segments more than the d + 1 of which one must be left unchanged, so it has
    SPARE + 1 that the longer name has too, and its SPARE most frequent ones needn't be looked for. Segments and the longer
    names' pieces meet in an equi-join on lengths, edits, numbers and texts. sizes: size, edits, and whole of longer names.
    """
    spark, once = texts.sparkSession, "size < whole AND name <> other OR name < other"
    longer = texts.select(F.col("name").alias("other"), F.col("size").alias("whole"))
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    few = [s for s in sizes if s[1] <= PAIRED and s[0] >= s[1] + 2]
    found = []
    if few:
        told = _told(shorter.join(small(sorted({(s,) for s, _, _ in few}), "size int"), "size"))
        own, there = _couples({(s, d): _cuts([b + 0.1 for b in told[s]], d + 2) for s, d, _ in few}, few)
        place = "i int, j int, at int, length int, at2 int, length2 int"
        # hashes only make further candidates
        hashed = lambda text: F.expr(f"xxhash64(size, edits, i, j, substring({text}, at + 1, length), substring({text}, at2 + 1, length2))").alias("key")
        left = shorter.join(small(own, f"size int, edits int, {place}"), "size").select("name", "size", hashed("name"))
        right = longer.join(small(there, f"whole int, size int, edits int, {place}"), "whole").select("other", "whole", "edits", hashed("other"))
        # there are at most as many as a FREQUENT-th of the rows
        frequent = F.broadcast(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT).select("key", F.lit(SHARES).alias("shares")))
        shares = F.coalesce("shares", F.lit(1))
        left = left.join(frequent, "key", "left").select("name", "size", "key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
        right = right.join(frequent, "key", "left").select("other", "whole", "edits", "key", F.pmod(F.xxhash64("other"), shares).cast("int").alias("share"))
        # the rows are few against the pairs that they make, so their partitions mustn't be put together by size
        left, right = (df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "share") for df in (left, right))
        found.append(left.join(right, ["key", "share"]).where(once).select("name", "other", "edits"))

    rest = [s for s in sizes if s not in set(few)]
    if rest:
        parts = f"least(size, edits + {1 + SPARE})"
        start = lambda i: f"CAST(floor(({i}) * size / {parts}) AS INT)"
        each = lambda df, column, low, high: df.withColumn("_low", F.expr(low)).withColumn("_high", F.expr(high)).where("_low <= _high").withColumn(column, F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
        split = lambda df: each(df, "i", "0", f"{parts} - 1").withColumn("at", F.expr(start("i"))).withColumn("length", F.expr(f"{start('i + 1')} - at"))
        # a shift against the start and what it leaves of the difference in length are edits
        low, high = "- CAST(floor((edits - whole + size) / 2) AS INT)", "CAST(floor((edits + whole - size) / 2) AS INT)"
        key = ["size", "edits", "i", "segment"]
        segments = split(shorter.join(small(sorted({s[:2] for s in rest}), "size int, edits int"), "size")).select("name", "size", "edits", "i", F.expr("substring(name, at + 1, length)").alias("segment"))
        counted = segments.join(segments.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
        order = F.row_number().over(Window.partitionBy("name", "edits").orderBy(F.col("n").desc(), "i"))
        rare = counted.withColumn("place", order).where(F.expr(f"place > {parts} - 1 - edits")).select("name", *key)
        pieces = each(split(longer.join(small(rest, "size int, edits int, whole int"), "whole")), "place", f"greatest(0, at {low})", f"least(whole - length, at + {high})")
        pieces = pieces.select("other", "whole", "size", "edits", "i", F.expr("substring(other, place + 1, length)").alias("segment")).distinct()
        found.append(rare.join(pieces, key).where(once).select("name", "other", "edits"))
    met = reduce(DataFrame.union, found)
    return met.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"), "edits")


def _long_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): candidates of which the shorter has LONG characters or more."""
    # the k-th of a name's equal grams is told apart from the others, so that those in common can be counted
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - GRAM + 1), lambda i: F.substring("name", i, F.lit(GRAM)))).alias("at", "gram")
    grams = texts.where(F.col("size") >= LONG).select("name", "size", at)
    grams = stored(grams.withColumn("k", F.row_number().over(Window.partitionBy("name", "gram").orderBy("at"))), "grams")
    counts = stored(grams.groupBy("gram", "k").agg(F.count(F.lit(1)).alias("n")), "gram_counts")
    place = F.row_number().over(Window.partitionBy("name").orderBy("n", "gram", "k"))
    placed = stored(joined_by_size(grams, counts, ["gram", "k"], "n").withColumn("place", place), "placed_grams")
    # edits, if the name is the longer one, and if it is the shorter one of the longest that is like it
    as_longer, as_shorter = _floor(f"{1 - threshold!r} * size"), _floor(f"{1 - threshold!r} * floor(size / {threshold!r} + 1e-9)")
    longer = placed.where(F.expr(f"place <= {GRAM} * {as_longer} + 1")).select(F.col("name").alias("a"), F.col("size").alias("a_size"), F.expr(as_longer).alias("edits"), "gram", "k")
    shorter = placed.where(F.expr(f"place <= {GRAM} * {as_shorter} + 1")).select(F.col("name").alias("b"), F.col("size").alias("b_size"), "gram", "k")
    # not by places: the k-th of one name's grams may be another of the other's
    met = longer.join(shorter, ["gram", "k"]).where("(b_size < a_size OR b_size = a_size AND a < b) AND a_size - b_size <= edits")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_texts(texts: DataFrame, threshold: float = 0.8, info: tuple[str, ...] = ("name",)) -> DataFrame:
    """(likeness, and info of a and of b): pairs of different names alike, each once. texts: name, size and info; each name once. They are read several times."""
    spark, size, info = texts.sparkSession, F.greatest(F.length("a"), F.length("b")), list(info)
    # exploded, so that filters don't work out the edits again
    near = lambda pairs, d: pairs.withColumn("d", F.explode(F.array(d))).where("d >= 0").select("a", "b", (1 - F.col("d") / size).alias("likeness")).where(F.col("likeness") >= threshold)
    # most candidates of short names aren't alike, so that they are compared, as far as their edits go, before copies of a pair are put together
    bounded: Column = F.coalesce(*[F.when(F.col("edits") == d, F.levenshtein("a", "b", d)) for d in range(1, math.floor((1 - threshold) * LONG / threshold + 1e-9) + 1)])
    short = texts.where(F.col("size") <= LONG / threshold)
    leaves = in_leaves(short, info, LONG)
    heads = sorted(leaves.select("leaf", "size", "prefix", "dense").collect(), key=lambda h: h.leaf)
    wholes, scattered = {h.size for h in heads}, {h.size for h in heads if not h.dense and h.size < LONG}
    sizes = sorted((s, allowed(w, threshold), w) for s in scattered for w in wholes if s <= w <= s + allowed(w, threshold) and allowed(w, threshold))
    found = near(_long_pairs(texts, threshold).distinct(), F.levenshtein("a", "b"))
    if sizes:
        shorter = leaves.where(f"NOT dense AND size < {LONG}").select("size", F.explode("name").alias("name"))
        found = near(_short_pairs(short.select("name", "size"), shorter, sizes), bounded).distinct().union(found)
    if info == ["name"]:
        found = found.select("likeness", F.col("a").alias("a_name"), F.col("b").alias("b_name"))
    else:
        one, two = (texts.select(F.col("name").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in info]) for k in "ab")
        found = found.join(one, "a").join(two, "b").select("likeness", *one.columns[1:], *two.columns[1:])
    return found.unionByName(dense_pairs(leaves, heads, threshold, info)) if any(h.dense for h in heads) else found


def similar_names(assets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(left_key, right_key, likeness, n_left, n_right): pairs of classes (name_classes) that have no source in common and
    names alike; each asset of the one is linked with each of the other. assets: asset_key, source, name."""
    return _similar_classes(stored(name_classes(assets), "name_classes"), threshold)


def _similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    texts = classes.select("name").distinct().withColumn("size", F.length("name"))
    pairs = similar_texts(texts, threshold).withColumnsRenamed({"a_name": "a", "b_name": "b"})
    left, right = (classes.select(F.col("class_key").alias(f"{k}_key"), F.col("name").alias(k), F.col("sources").alias(f"{k}_sources"), F.col("n").alias(f"{k}_n")) for k in "ab")
    found = pairs.join(left, "a").join(right, "b")
    same = left.join(right, F.col("a") == F.col("b")).where("a_key < b_key").withColumn("likeness", F.lit(1.0))
    both = found.unionByName(same).where(~F.arrays_overlap("a_sources", "b_sources"))
    first = F.col("a_key") < F.col("b_key")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(pick("a_key", "b_key").alias("left_key"), pick("b_key", "a_key").alias("right_key"), "likeness", pick("a_n", "b_n").alias("n_left"), pick("b_n", "a_n").alias("n_right"))


def class_members(assets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(asset_key, class_key, n_links): the class of each asset that has a name, and how many assets it is linked with."""
    named = stored(_named(assets), "named")
    classes = stored(_classes(named), "name_classes")
    pairs = _similar_classes(classes, threshold)
    ends = pairs.select(F.col("left_key").alias("class_key"), F.col("n_right").alias("n")).unionByName(pairs.select(F.col("right_key").alias("class_key"), F.col("n_left").alias("n")))
    links = ends.groupBy("class_key").agg(F.sum("n").alias("n_links"))
    classes = stored(classes.join(links, "class_key", "left"), "linked_classes")
    rows = joined_by_size(named, classes, ["name", "sources"], "n")
    return rows.select("asset_key", "class_key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Ways in which names have parts (aligned_entries) up to which pairs of these are worked out beforehand.
KINDS = 300


def aligned_entries(entries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Links between names and the members of each name: (kind, left_key, right_key, likeness, n_left, n_right, n_links).

    entries: asset_key, source, name. All entries of one name are a class, whatever their sources; its key is the least of theirs.
    kind "link": two classes with names alike and the number of pairs of their entries that have no source in common, one at
    least. kind "member": an entry, its class and the number of entries of the class that it has no source in common with.
    """
    named = stored(_named(entries), "named")
    parts = _classes(named)
    whole = parts.groupBy("name").agg(F.min("class_key").alias("key"), F.sum("n").alias("n"), F.collect_list(F.struct("sources", "n")).alias("parts"))
    whole = stored(whole, "names")  # of a name there are as many parts as there are sets of sources
    apart = "aggregate({}, 0L, (s, y) -> s + IF(arrays_overlap({}, y.sources), 0L, y.n))"
    n_links = f"aggregate(a_parts, 0L, (t, x) -> t + x.n * {apart.format('b_parts', 'x.sources')})"
    texts, kinds = whole.withColumn("size", F.length("name")), whole.select(F.array_sort("parts").alias("parts")).distinct().limit(KINDS + 1).collect()
    few = len(kinds) <= KINDS
    if few:
        # names have their parts in a few ways only, so that the links between two of those are counted once
        numbers = entries.sparkSession.createDataFrame([(k, r.parts) for k, r in enumerate(kinds)], f"kind int, parts {dict(whole.dtypes)['parts']}")
        texts = texts.withColumn("parts", F.array_sort("parts")).join(F.broadcast(numbers), "parts").select("name", "size", "key", "n", "kind")
        texts = stored(texts, "texts")
    pairs = similar_texts(texts, threshold, ("key", "n", "kind" if few else "parts"))
    if few:
        one, two = (numbers.select(F.col("kind").alias(f"{k}_kind"), F.col("parts").alias(f"{k}_parts")) for k in "ab")
        pairs = pairs.join(F.broadcast(one.crossJoin(two).select("a_kind", "b_kind", F.expr(n_links).alias("n_links")).where("n_links > 0")), ["a_kind", "b_kind"])
    else:
        pairs = pairs.withColumn("n_links", F.expr(n_links)).where("n_links > 0")
    first = F.col("a_key") < F.col("b_key")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    links = pairs.select(
        F.lit("link").alias("kind"), pick("a_key", "b_key").alias("left_key"), pick("b_key", "a_key").alias("right_key"), "likeness", pick("a_n", "b_n").alias("n_left"), pick("b_n", "a_n").alias("n_right"), "n_links"
    )
    members = joined_by_size(named, whole, ["name"], "n").select(
        F.lit("member").alias("kind"), F.col("asset_key").alias("left_key"), F.col("key").alias("right_key"), F.lit(1.0).alias("likeness"), F.lit(1).cast("long").alias("n_left"), F.col("n").alias("n_right"), F.expr(apart.format("parts", "sources")).alias("n_links")
    )
    return links.unionByName(members)
