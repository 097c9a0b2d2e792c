"""Names in sorted leaves, and the comparison of whole leaves with each other.

Names are sorted by length and text and cut into leaves of LEAF names at most. A leaf is dense if its names, DENSE at least, begin alike
for half their length or more; runs of such names are leaves of their own. A dense leaf is compared with each leaf that can hold names like its
own: not with those whose beginnings take more edits than the lengths allow. Two leaves are compared as
a whole, all names of the one with all of the other, a place of the edit table for all pairs at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from assetweave.operators.ordered import stored

#: Names of a leaf at most, and of a dense leaf at least.
LEAF, DENSE = 256, 4
#: Pairs that a task hands on together, at least, and tasks that compare leaves, by shuffle partition.
FOUND, TASKS = 50_000, 16


def allowed(size: int, threshold: float) -> int:
    """The edits between a name of so many characters and one that is no longer, at most."""
    return math.floor((1 - threshold) * size + 1e-9)


def in_leaves(texts: DataFrame, info: list[str], limit: int) -> DataFrame:
    """(leaf, size, leaf_n, prefix, dense, chars, and as arrays name and info): texts (name, size, info), each name once, in leaves.

    chars: code points of the names, in one byte or in four each. Leaves are numbered in the order. Those of names of limit characters
    or more aren't dense.
    """
    columns, most, least = list(dict.fromkeys(["name", *info])), LEAF, DENSE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from os.path import commonprefix

        number, held = TaskContext.get().partitionId() << 33, None

        def leaf(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            names, size = rows["name"].to_pylist(), rows["size"][0].as_py()
            prefix, text = commonprefix([names[0], names[-1]]), "".join(names)
            chars = text.encode("utf-32-le") if max(text) > "\xff" else text.encode("latin-1")
            dense = len(names) >= least and 2 * len(prefix) >= size and size < limit
            number += 1
            head = {"leaf": pa.array([number - 1], pa.int64()), "size": pa.array([size], pa.int32()), "leaf_n": pa.array([len(names)], pa.int32()), "prefix": pa.array([prefix]), "dense": pa.array([dense]), "chars": pa.array([chars], pa.binary())}
            arrays = {c: pa.array([rows[c].to_pylist()], pa.list_(rows.schema.field(c).type)) for c in columns}
            return pa.RecordBatch.from_pydict(head | arrays)

        def end(names: list[str], more: bool) -> int:
            """Names of the first leaf: a run that begins alike, cut where it has least in common if it is too long, or what comes before the first run that is long enough."""
            common = [len(commonprefix(names[k : k + 2])) for k in range(len(names) - 1)]
            cuts = [k + 1 for k, c in enumerate(common) if 2 * c < len(names[0])]
            if not cuts and more:
                return 1 + min(range(most), key=lambda k: (common[k], -k))
            starts, ends = [0, *cuts], [*cuts, len(names)]
            if ends[0] >= least:
                return ends[0]
            # a run that goes on may be long enough
            found = [s for s, e in zip(starts[1:], ends[1:]) if e - s >= least or more and e == len(names)]
            return found[0] if found else len(names)

        def leaves(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """The leaves of rows; but for the last time, the names that more may follow are held."""
            nonlocal held
            held = None
            while len(rows):
                sizes = rows["size"].to_numpy()
                same = int(np.searchsorted(sizes, sizes[0], "right"))
                if same == len(rows) and not last and same <= most:
                    held = rows
                    return
                yield leaf(rows.slice(0, at := end(rows["name"].slice(0, min(same, most + 1)).to_pylist(), same > most)))
                rows = rows.slice(at)

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                yield from leaves(pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows, False)
        if held is not None:
            yield from leaves(held, True)

    types = dict(texts.dtypes)
    schema = "leaf long, size int, leaf_n int, prefix string, dense boolean, chars binary, " + ", ".join(f"{c} array<{types[c]}>" for c in columns)
    dealt = texts.select("size", *columns).repartitionByRange(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "size", "name")
    return stored(dealt.sortWithinPartitions("size", "name").mapInArrow(cut, schema), "leaves")


def compared() -> Callable[..., np.ndarray]:
    """edits(a, b, k, wild): the edits between each of the names a, a row of code points each, and each of b, which are as long or longer.

    What is more than k may be any number over k. If wild, the code point 0 is like any other, so that beginnings give a lower bound.
    """

    def edits(a: np.ndarray, b: np.ndarray, k: int, wild: bool = False) -> np.ndarray:
        n, whole = a.shape[1], b.shape[1]
        more, far, shape = whole - n, k + 1, (len(a), len(b))
        # diagonals on which the difference in length can still be made up for
        band = [o for o in range(-k, k + 1) if abs(o) + abs(more - o) <= k]
        row = {o: np.full(shape, o if o >= 0 else far, np.uint8) for o in band}
        for i in range(1, n + 1):
            x, new, left = a[:, i - 1, None], {}, None
            for o in band:
                j = i + o
                if 0 < j <= whole:
                    y = b[None, :, j - 1]
                    other = (x != y) & (x != 0) & (y != 0) if wild else x != y
                    best = row[o] + other.view(np.uint8)
                    if o + 1 in row:
                        np.minimum(best, row[o + 1] + np.uint8(1), out=best)
                    if left is not None:
                        np.minimum(best, left + np.uint8(1), out=best)
                else:
                    best = np.full(shape, i if j == 0 else far, np.uint8)
                left = new[o] = best
            row = new
        return row[more]

    return edits


def _met(heads: list[Row], threshold: float, spark) -> DataFrame:
    """(one, two): dense leaves, and those that come no sooner in the order and may hold names like theirs."""
    edits, k_of = compared(), {s: allowed(s, threshold) for s in {h.size for h in heads}}
    sized = {s: [h for h in heads if h.size == s] for s in k_of}
    begins = {s: (np.array([h.leaf for h in hs]), np.array([[*map(ord, h.prefix)] + [0] * (s - len(h.prefix)) for h in hs], np.uint32)) for s, hs in sized.items()}
    begins = spark.sparkContext.broadcast(begins)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                leaves, texts = begins.value[size]
                at = int(np.searchsorted(leaves, leaf))
                for whole, k in k_of.items():
                    if k and size <= whole <= size + k:
                        others, beginnings = begins.value[whole]
                        first = at if whole == size else 0
                        near = others[first:][edits(texts[at : at + 1], beginnings[first:], k, True)[0] <= k]
                        yield pa.RecordBatch.from_pydict({"one": pa.array(np.full(len(near), leaf)), "two": pa.array(near)})

    dense = spark.createDataFrame([(h.leaf, h.size) for h in heads if h.dense], "leaf long, size int")
    return dense.repartition(TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf").mapInArrow(find, "one long, two long")


def dense_pairs(leaves: DataFrame, heads: list[Row], threshold: float, info: list[str]) -> DataFrame:
    """(likeness, and info of a and b): names alike of which the shorter one, or of two of one length the first, is in a dense leaf; each pair once.

    heads: leaf, size, prefix and dense of all leaves, in their order.
    """
    spark, edits, least = leaves.sparkSession, compared(), FOUND
    tasks = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = lambda key, k: leaves.select(F.col("leaf").alias(key), *[F.col(c).alias(f"{k}_{c}") for c in dict.fromkeys(["size", "leaf_n", "prefix", "chars", *info])])
    # few numbers make many comparisons, so their partitions mustn't be put together by size
    met = _met(heads, threshold, spark).repartition(tasks, "one").join(side("one", "a"), "one").repartition(tasks, "two").join(side("two", "b"), "two")
    out = [f"{k}_{c}" for k in "ab" for c in info]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from os.path import commonprefix

        def points(chars: bytes, n: int, size: int) -> np.ndarray:
            return np.frombuffer(chars, np.uint8 if len(chars) == n * size else np.uint32).reshape(n, size)

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("one", "two", *[f"{k}_{c}" for k in "ab" for c in ("size", "leaf_n", "prefix", "chars")])}
            starts = {c: batch.column(c).offsets.to_numpy() for c in out}
            values = {c: batch.column(c).values for c in out}
            held, rows = {c: [] for c in out} | {"likeness": []}, 0

            def made() -> pa.RecordBatch:
                arrays = {c: values[c].take(pa.array(np.concatenate(held[c]))) for c in out}
                return pa.RecordBatch.from_pydict({"likeness": pa.array(np.concatenate(held["likeness"]))} | arrays)

            for r in range(batch.num_rows):
                size, whole, common = cols["a_size"][r], cols["b_size"][r], len(commonprefix([cols["a_prefix"][r], cols["b_prefix"][r]]))
                a, b = (points(cols[f"{k}_chars"][r], cols[f"{k}_leaf_n"][r], s)[:, common:] for k, s in (("a", size), ("b", whole)))
                # as the likeness is worked out elsewhere, to the last bit
                k = max((d for d in range(whole) if 1 - d / whole >= threshold), default=0)
                found = edits(a, b, k)
                alike = found <= k
                if cols["one"][r] == cols["two"][r]:
                    alike = np.triu(alike, 1)
                x, y = np.nonzero(alike)
                if len(x):
                    held["likeness"].append(1 - found[x, y] / whole)
                    for c in out:
                        held[c].append((x if c[0] == "a" else y) + starts[c][r])
                    rows += len(x)
                    if rows >= least:
                        yield made()
                        held, rows = {c: [] for c in held}, 0
            if rows:
                yield made()

    types = dict(leaves.dtypes)
    schema = "likeness double, " + ", ".join(f"{c} {types[c[2:]].removeprefix('array<')[:-1]}" for c in out)
    columns = ["one", "two", *[f"{k}_{c}" for k in "ab" for c in dict.fromkeys(["size", "leaf_n", "prefix", "chars", *info])]]
    return met.select(*columns).mapInArrow(compare, schema)
