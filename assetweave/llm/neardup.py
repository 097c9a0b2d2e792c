"""Near-duplicate documents by a MinHash LSH forest.

Documents with equal shingle sets form a class, of which one goes on. A class has TREES keys of DEPTH minima of a
one-permutation MinHash each. A tree is the order of all classes by one key: classes next to each other have the longest
common prefixes. Classes with the same first minima, as many as floor_depth says, are a block of the tree; a pair at the
threshold is in one block of some tree but for a chance of MISSED.

Candidates are neighbours in these orders. First a sweep goes through some sorted trees and takes the nearest classes
of the longest common prefixes, whatever the region's depth; their links join most of a group of copies. A region that
is one component after that is done, however dense; the others are searched at the least depth, as whole blocks, whose
classes of different components are compared one and all. So each region is searched as deep as its density allows, and no
candidate is left out for its block's size. A block of many classes is dealt in chunks; its largest component is not
compared with itself.

Candidates are compared by their sizes and odd sketches, from which the size of the sets' difference follows with an
error of a few shingles, where they meet, and never become rows unless they pass. Of what passes in one place only a
spanning forest over the components, the best estimates first, is confirmed on the full sets; components are then worked
out by star contractions. Blocks that had more candidates and are still of several components are compared again with
their full sets at hand, each pair in the first tree that it meets in, so that the components are those of all links.

Defined cases: texts without words have no shingles and link with nothing; a text with fewer words than the
shingle width has one shingle, all its words; rows that share a doc_id are one document, which is linked if any
of its texts is; a row without doc_id links with nothing, has no component and is kept; extra columns pass
through; an empty table gives an empty result; thresholds under a half are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_limits, partitions, remove, written
from assetweave.llm.components import components
from assetweave.llm.shingles import distinct_sets, one_permutation, shingle_hashes

TREES = 20
#: Minima in a key, and bits kept of each.
DEPTH, MINIMUM_BITS = 5, 12
BINS = 1024
#: The most that the chance to meet in no block may be, for a pair at the threshold.
MISSED = 1e-6
#: Trees that are swept, and how many rows back a class looks in them.
SWEPT, BACK = 3, 2
#: Most classes of a block in one chunk, and most shingles where full sets are compared, on average.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Bits of an odd sketch, and the set size from which it is of a half, a quarter, ... of the hashes.
SKETCH, SKETCHED = 1024, 2048
#: Candidates are dropped when their sketches differ by so many standard deviations more than at the threshold.
ERRORS = 5.5
#: Pairs that one step compares.
PAIRS = 1 << 16
#: Up to this number of ids a list is broadcast, as 8 bytes each.
BROADCAST_IDS = 500_000


def floor_depth(least: int, most: int) -> int:
    """The most minima that a block may share for pairs of likeness least / most."""
    fit = [k for k in range(1, DEPTH + 1) if (1 - (least / most) ** k) ** TREES <= MISSED]
    if not fit:
        raise ValueError(f"the search is not built for a likeness of {least} / {most}")
    return fit[-1]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Rows x two odd sketches: bit i is whether an odd number of hashes fall on i, of those that the row's level takes,
    and of those that the next level takes."""
    size = np.array([len(s) for s in sets], np.int64)
    hashes, row, level = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), size), levels(size)
    place = ((hashes >> np.uint64(40)) % np.uint64(SKETCH)).astype(np.int64)
    out = np.empty((len(sets), 2, SKETCH // 8), np.uint8)
    for k in (0, 1):
        mask = (np.uint64(1) << (level[row] + k).astype(np.uint64)) - np.uint64(1)
        on = (hashes & mask) == 0
        count = np.bincount(row[on] * SKETCH + place[on], minlength=len(sets) * SKETCH)
        out[:, k] = np.packbits((count & 1).astype(np.uint8).reshape(len(sets), SKETCH), axis=1)
    return out


def levels(size: np.ndarray) -> np.ndarray:
    """How often the hashes are halved for a sketch of sets of these sizes."""
    return np.ceil(np.log2(np.maximum(size / SKETCHED, 1))).astype(np.int64)


def digests(docs: DataFrame, width: int, forest: bool) -> DataFrame:
    """doc_id, n_shingles and set_key of each row, and the trees' keys and the sketches, or the set's hashes."""
    extra = "keys array<long>, sketch binary" if forest else "shingles binary"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at = shingle_hashes(batch["text"], width)
            sets = list(distinct_sets(hashes, at))
            columns = {
                "doc_id": batch["doc_id"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
            }
            if forest:
                minima = (one_permutation(hashes, at, BINS, TREES * DEPTH) & np.uint32(2**MINIMUM_BITS - 1)).astype(np.int64).reshape(len(sets), TREES, DEPTH)
                keys = minima @ (1 << MINIMUM_BITS * np.arange(DEPTH - 1, -1, -1, dtype=np.int64))
                columns["keys"] = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * TREES, pa.int32()), pa.array(keys.ravel()))
                columns["sketch"] = pa.array([s.tobytes() for s in sketches(sets)], pa.binary())
            else:
                columns["shingles"] = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, f"doc_id long, n_shingles long, set_key binary, {extra}")


def close(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows (a, b) those near enough by their sizes n and sketches, with the estimated share of the difference.

    At the threshold the difference has d = (n_a + n_b) * (most - least) / (most + least) shingles, each of which
    turns a bit with the chance that the level takes it; the number of unlike bits and its variance follow.
    """
    fits = most * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])
    a, b = a[fits], b[fits]
    level = levels(n)
    at = np.maximum(level[a], level[b])
    unlike = np.bitwise_count(sketch[a, at - level[a]] ^ sketch[b, at - level[b]]).sum(axis=1, dtype=np.int64)
    both = (n[a] + n[b]).astype(float)
    most_apart, share = both * (most - least) / (most + least), 0.5**at
    one, two = (1 - 2 * share / SKETCH) ** most_apart, (1 - 4 * share / SKETCH) ** most_apart
    mean, variance = SKETCH / 2 * (1 - one), (SKETCH + SKETCH * (SKETCH - 1) * two - (SKETCH * one) ** 2) / 4
    near = unlike <= mean + ERRORS * np.sqrt(np.maximum(variance, 0)) + 1e-6
    apart = np.log(np.maximum(1 - 2 * unlike[near] / SKETCH, 1 / SKETCH)) / np.log(1 - 2 * share[near] / SKETCH)
    return a[near], b[near], apart / both[near]


def spanning(u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indices of a least spanning forest of the edges between the nodes u and v, by Boruvka's rounds."""
    if not len(u):
        return np.empty(0, np.int64)
    order = np.argsort(cost, kind="stable")
    nodes, at = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    u, v = at[: len(order)], at[len(order) :]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        live = live[label[u[live]] != label[v[live]]]
        if not len(live):
            break
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, label[u[live]], live)
        np.minimum.at(best, label[v[live]], live)
        new = np.unique(best[best < len(order)])
        chosen.append(new)
        # every tree of the chosen edges gets its least label
        up = np.arange(len(nodes))
        while True:
            x, y = up[label[u[new]]], up[label[v[new]]]
            low = np.minimum(x, y)
            np.minimum.at(up, x, low)
            np.minimum.at(up, y, low)
            up = up[up]
            if (up[label[u[new]]] == up[label[v[new]]]).all() and (up == up[up]).all():
                break
        label = up[label]
    return order[np.concatenate(chosen)]


def numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns as arrays; the sketches as rows x two x words."""
    out = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
    if "shingles" in batch.schema.names:
        out["shingles"] = np.array([np.frombuffer(x, np.uint64) for x in batch["shingles"].to_pylist()] + [None], object)[:-1]
        out["heads"] = batch["heads"].flatten().to_numpy().reshape(batch.num_rows, -1)
    return out | {"sketch": np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint64).reshape(batch.num_rows, 2, -1)}


def joined(x: dict[str, np.ndarray] | None, y: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return y if x is None else {c: np.concatenate([x[c], y[c]]) for c in y}


def found_rows(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Pairs of rows with their parts, followed by the (tree, head) of the rows more, whose blocks have more."""
    a, b = np.where(x["id"][a] < x["id"][b], a, b), np.where(x["id"][a] < x["id"][b], b, a)
    put = lambda pair, block: pa.concat_arrays([pa.array(pair) if pair is not None else pa.nulls(len(a), pa.int64()), pa.array(block) if block is not None else pa.nulls(len(more), pa.int64())])
    columns = {"a": (x["id"][a], None), "b": (x["id"][b], None), "part_a": (x["part"][a], None), "part_b": (x["part"][b], None), "tree": (None, x["tree"][more]), "head": (None, x["head"][more])}
    return pa.RecordBatch.from_pydict({c: put(*v) for c, v in columns.items()})


FOUND = "a long, b long, part_a long, part_b long, tree long, head long"


def sweep(back: int, least: int, most: int):
    """For rows (tree, head, id, part, n, sketch) in the trees' orders: candidates at most back rows apart, of one block
    and different parts, as a spanning forest of the parts of an Arrow batch."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = joined(held, numbers(batch, ("tree", "head", "id", "part", "n")))
            n, first = len(x["id"]), len(x["id"]) - batch.num_rows
            a, b = [], []
            for lag in range(1, back + 1):
                new = np.arange(max(first, lag), n)
                old = new - lag
                own = (x["tree"][new] == x["tree"][old]) & (x["head"][new] == x["head"][old]) & (x["part"][new] != x["part"][old])
                a.append(old[own])
                b.append(new[own])
            p, q, cost = close(np.concatenate(a), np.concatenate(b), x["n"], x["sketch"], least, most)
            kept = spanning(x["part"][p], x["part"][q], cost)
            yield found_rows(x, p[kept], q[kept], p[:0])
            held = {c: v[-back:] for c, v in x.items()}

    return pairs


def is_link(x: np.ndarray, y: np.ndarray, least: int, most: int) -> bool:
    """Whether most * |intersection| >= least * |union| of two ascending arrays."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return most * inter >= least * (len(both) - inter)


def linked(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, node: np.ndarray, least: int, most: int) -> np.ndarray:
    """Indices of pairs of rows that are links, as a spanning forest of the nodes; what it joins isn't looked at again."""
    up, kept = {}, []

    def root(k: int) -> int:
        while k in up:
            if up[k] in up:
                up[k] = up[up[k]]
            k = up[k]
        return k

    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        u, v = root(int(node[p])), root(int(node[q]))
        if u != v and is_link(x["shingles"][p], x["shingles"][q], least, most):
            up[u] = v
            kept.append(k)
    return np.array(kept, np.int64)


def compare(exact: bool, least: int, most: int):
    """For rows (tree, head, i, j, slot, id, part, n, sketch) ordered by these: candidates of different parts among the rows of
    one (tree, head, i, j), as a spanning forest of the parts, and the blocks that have more.

    exact: rows have their shingles and the heads of all trees, links are returned and all candidates looked at.
    """
    group_of, names = ("tree", "head", "i", "j"), ("tree", "head", "i", "j", "slot", "id", "part", "n")

    def whole(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        rows = len(x["id"])
        new = np.ones(rows, bool)
        new[1:] = np.any([x[c][1:] != x[c][:-1] for c in group_of], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, rows))
        group = np.repeat(np.arange(len(starts)), sizes)
        end, row = (starts + sizes)[group], np.arange(rows)
        # the rows of slot i stand before those of slot j
        before = np.bincount(group, x["slot"] == x["i"], minlength=len(starts)).astype(np.int64)
        partner = np.where(x["i"] == x["j"], row + 1, np.where(x["slot"] == x["i"], starts[group] + before[group], end))
        upto = np.cumsum(end - partner)
        found, low = [], 0
        while low < rows:
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
            count = (end - partner)[low:high]
            a = np.repeat(row[low:high], count)
            b = np.arange(len(a)) + np.repeat(partner[low:high] - np.cumsum(count) + count, count)
            own = x["part"][a] != x["part"][b]
            found.append(close(a[own], b[own], x["n"], x["sketch"], least, most))
            low = high
        a, b, cost = (np.concatenate([f[k] for f in found]) for k in range(3))
        _, part = np.unique(x["part"], return_inverse=True)
        node = group * (part.max(initial=0) + 1) + part
        if exact:
            order = np.argsort(cost, kind="stable")
            met = (x["heads"][a] == x["heads"][b]) & (np.arange(TREES) < x["tree"][a][:, None])
            order = order[~met.any(axis=1)[order]]
            kept = order[linked(x, a[order], b[order], node, least, most)]
            return found_rows(x, a[kept], b[kept], a[:0])
        kept = spanning(node[a], node[b], cost)
        more = np.ones(len(a), bool)
        more[kept] = False
        return found_rows(x, a[kept], b[kept], starts[np.unique(group[a[more]])])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = joined(held, numbers(batch, names))
            # the last group may go on in the next batch
            last = np.flatnonzero(np.any([x[c] != x[c][-1] for c in group_of], axis=0))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield whole({c: v[:cut] for c, v in x.items()})
            held = {c: v[cut:] for c, v in x.items()}
        if held is not None:
            yield whole(held)

    return pairs


class Forest:
    """The trees of some classes (id, number, n_shingles, keys, sketch), without those that are alone in all their blocks.

    id is the class's node; classes of one document may share it, and number tells them apart.
    """

    def __init__(self, classes: DataFrame, least: int, most: int):
        self.least, self.most = least, most
        shift = MINIMUM_BITS * (DEPTH - floor_depth(least, most))
        keyed = classes.select("id", "number", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("tree", "key")).withColumn("head", F.shiftright("key", shift))
        shared = keyed.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("tree", "head")
        self.rows = written(keyed.join(shared, ["tree", "head"]).select("id", "number", "n", "tree", "key", "head"), "trees")
        self.wide = written(classes.join(self.rows.select("id").distinct(), "id", "left_semi").select("id", "number", "sketch", F.transform("keys", lambda k: F.shiftright(k, shift)).alias("heads")), "sketches")

    def remove(self) -> None:
        for df in (self.rows, self.wide):
            remove(df.sparkSession, df)

    def open_rows(self, parts: DataFrame | None, trees: int, blocks: DataFrame | None = None) -> DataFrame:
        """The rows of blocks of several parts, with the block's sizes: all, of its largest part, and that part."""
        rows = self.rows.where(F.col("tree") < trees)
        rows = rows.withColumn("part", F.col("id")) if parts is None else rows.join(parts, "id", "left").withColumn("part", F.coalesce("component_id", "id")).drop("component_id")
        if blocks is not None:
            rows = rows.join(blocks, ["tree", "head"], "left_semi")
        sizes = rows.groupBy("tree", "head", "part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
        sizes = sizes.groupBy("tree", "head").agg(F.sum("size").alias("all"), F.sum("shingles").alias("all_shingles"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "part", "shingles")).alias("main")).where("parts > 1")
        return rows.join(sizes.select("tree", "head", "all", "all_shingles", "main"), ["tree", "head"])

    def swept(self, trees: int, back: int) -> DataFrame:
        """Candidates that are neighbours in the first trees, when each class is a part."""
        rows = self.open_rows(None, trees).select("id", "number", "n", "tree", "key", "head", "part").join(self.wide, ["id", "number"]).withColumn("salt", F.xxhash64("tree", "id"))
        rows = rows.repartitionByRange(partitions(rows.sparkSession), "tree", "key", "salt").sortWithinPartitions("tree", "key", "salt", "id")
        return rows.select("tree", "head", "id", "part", "n", "sketch").mapInArrow(sweep(back, self.least, self.most), FOUND)

    def compared(self, parts: DataFrame, blocks: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
        """Candidates of all trees' blocks; or with sets (id, number, shingles) the links of these blocks."""
        rows = self.open_rows(parts, TREES, blocks)
        chunks = lambda n, shingles: F.ceil(F.greatest(n / CHUNK, shingles / CHUNK_SHINGLES) if sets is not None else n / CHUNK).cast("long")
        small, main = chunks(F.col("all"), F.col("all_shingles")) <= 1, F.col("part") == F.col("main.part")
        other, own = chunks(F.col("all") - F.col("main.size"), F.col("all_shingles") - F.col("main.shingles")), chunks(F.col("main.size"), F.col("main.shingles"))
        deal, zero = F.xxhash64("id", "number"), F.lit(0).cast("long")
        rows = rows.withColumns({"slot": F.when(small, zero).when(main, other + F.pmod(deal, own)).otherwise(F.pmod(deal, other)), "last": F.when(small, zero).when(main, other - 1).otherwise(other + own - 1)})
        # a chunk of the largest part meets the other parts' chunks, those meet all
        dealt = rows.select("id", "number", "n", "tree", "head", "part", "slot", F.explode(F.sequence(zero, F.col("last"))).alias("with"))
        dealt = dealt.select("id", "number", "n", "tree", "head", "part", "slot", F.least("slot", "with").alias("i"), F.greatest("slot", "with").alias("j")).join(self.wide, ["id", "number"])
        dealt = dealt if sets is None else dealt.join(sets, ["id", "number"])
        dealt = dealt.repartition(partitions(dealt.sparkSession), "tree", "head", "i", "j").sortWithinPartitions("tree", "head", "i", "j", "slot", "id")
        return dealt.select("tree", "head", "i", "j", "slot", "id", "part", "n", "sketch", *([] if sets is None else ["heads", "shingles"])).mapInArrow(compare(sets is not None, self.least, self.most), FOUND)


def confirmed(least: int, most: int):
    """(part_a, part_b, a, b) of rows with set_a and set_b, those with most * |intersection| >= least * |union|."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [is_link(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least, most) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield batch.select(["a", "b", "part_a", "part_b"]).filter(mask)

    return links


def sets_of(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(doc_id, set_key, shingles) of the documents asked for (doc_id), each set of a document once."""
    some = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    sets = digests(docs.select("doc_id", "text").join(some, "doc_id", "left_semi"), width, False).where("n_shingles > 0")
    return sets.groupBy("doc_id", "set_key").agg(F.first("shingles").alias("shingles"))


def links_of(docs: DataFrame, pairs: DataFrame, width: int, least: int, most: int) -> DataFrame:
    """Those of the pairs (a, b, part_a, part_b) of doc_ids of docs of which some texts are links."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
    sets = sets_of(docs, asked, width).select("doc_id", "shingles")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "part_a", "part_b", "set_a", "set_b")
    found = written(both.mapInArrow(confirmed(least, most), "a long, b long, part_a long, part_b long"), "links")
    remove(docs.sparkSession, asked)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, set_key, component_id, kept (the component's least doc_id is the row's).

    width: words in a shingle; documents link where |intersection| / |union| >= least / most, a half at least.
    """
    spark = docs.sparkSession
    floor_depth(least, most)
    each = written(digests(docs, width, True), "digests")
    whole = each.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    of_key = whole.groupBy("set_key").agg(F.min("doc_id").alias("id"), *[F.max(c).alias(c) for c in ("n_shingles", "keys", "sketch")])
    classes = written(of_key.withColumn("number", F.xxhash64("set_key")), "classes")
    members = written(whole.select("set_key", "doc_id").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id").distinct(), "members")
    # a document of several texts is in several classes and so links them
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("doc_id", "a")
    links = members.join(several, "doc_id").where("a < id").select("a", F.col("id").alias("b"))
    forest = Forest(classes, least, most)

    def confirm(found: DataFrame) -> DataFrame:
        pairs = written(found.where("a IS NOT NULL").select("a", "b", "part_a", "part_b").distinct(), "pairs")
        links = links_of(docs, pairs, width, least, most)
        remove(spark, pairs)
        return links

    def contracted(new: DataFrame, parts: DataFrame) -> DataFrame:
        """The parts (id, component_id) after links of parts."""
        joined = components(new.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).toDF("part", "component_id")
        nodes = parts.toDF("id", "part").union(joined.select("part", "part")).distinct()
        return written(nodes.join(joined, "part", "left").select("id", F.coalesce("component_id", "part").alias("component_id")), "parts")

    swept = confirm(forest.swept(SWEPT, BACK))
    parts = written(components(swept.select("a", "b").union(links)).toDF("id", "component_id"), "parts")
    found = written(forest.compared(parts), "found")
    parts = contracted(confirm(found), parts)
    blocks = written(found.where("a IS NULL").select("tree", "head").distinct(), "blocks")
    if not blocks.isEmpty():
        asked = written(forest.open_rows(parts, TREES, blocks).select(F.col("id").alias("doc_id")).distinct(), "asked")
        sets = sets_of(docs, asked, width).select(F.col("doc_id").alias("id"), F.xxhash64("set_key").alias("number"), "shingles")
        parts = contracted(written(forest.compared(parts, blocks, sets), "links"), parts)
        remove(spark, asked)
    forest.remove()
    for df in (classes, swept, found, blocks):
        remove(spark, df)
    roots = members.join(parts, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "id")).alias("component_id"))
    out = each.select("doc_id", "n_shingles", "set_key").join(roots, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Shingles of two words, likeness 0.8."""
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without those that have a near duplicate with a lesser doc_id in their component."""
    out = near_duplicates(docs, width)
    gone = written(out.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, "doc_id", "left_anti").select(*docs.columns)
