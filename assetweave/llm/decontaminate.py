"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are put into size classes by their five-word shingles; in a class the largest is at most GROWTH times
the smallest. A long document is seen, for each class, through overlapping windows of one and a half times the
class's largest size at steps of half of it, so that an item of the class lies whole in some window and makes up
a fair part of it; a containment threshold then turns into a Jaccard bound that MinHash can meet at any length of
document. The K minima of each window are looked up among the items' minima (one equal minimum makes a
candidate), and a candidate is verified by the exact share of the item's shingles that the whole document has.

At containment 0.8 a window's likeness to the item is at least 0.31, so K = 40 minima miss it with a chance of 4e-7;
at full containment of 0.41, 6e-10. Items go to the executors in blocks of bounded size, each for one pass over the
documents, whose hits are written before the next block is read; the documents stay where they are. Items with equal
shingle sets are one in the index.

Defined cases: null texts, empty texts and items without words match nothing; an item or a text of fewer than five
words is one shingle, all its words, so such an item is found only in a text of just those words; repeated items
and repeated documents each give their own rows, but equal (doc_id, item_id) pairs come out once, with the
largest share; a null id is an id like others; extra columns pass through or are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_batches, remove, unused, written
from assetweave.llm.shingles import mixed, shingle_hashes

WIDTH = 5
CONTAINMENT = 0.8
GROWTH = 1.6
MINIMA = 40
#: Characters of items in one block, and so the bound of what is broadcast.
BLOCK_CHARS = 16 << 20
MULTIPLIERS = mixed(np.arange(101, 101 + MINIMA, dtype=np.uint64)) | np.uint64(1)


class Items:
    """One block of items: the distinct shingle sets with the ids of each, and for each size class the sorted minima with
    their sets."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        hashes, at = shingle_hashes(pa.array(texts, pa.large_string()), WIDTH)
        of_set: dict[bytes, list[int | None]] = {}
        for item, a, b in zip(ids, at[:-1], at[1:], strict=True):
            if a < b:
                of_set.setdefault(np.unique(hashes[a:b]).tobytes(), []).append(item)
        self.ids, self.sets = list(of_set.values()), [np.frombuffer(s, np.uint64) for s in of_set]
        size = np.array([len(s) for s in self.sets])
        kind = np.floor(np.log(np.maximum(size, 1)) / np.log(GROWTH) + 1e-9).astype(int)
        self.classes = []
        for c in np.unique(kind):
            own = np.flatnonzero(kind == c)
            minima = np.stack([(self.sets[k][None, :] * MULTIPLIERS[:, None]).min(axis=1) for k in own])
            order = np.argsort(minima, axis=0, kind="stable")
            self.classes.append((int(size[own].max()), np.take_along_axis(minima, order, 0), own[order]))

    def found(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, set, shared shingles) of all sets contained enough in rows with these shingles."""
        candidates = []
        for largest, minima, owner in self.classes:
            half = max(1, (largest + 1) // 2)
            counts = np.diff(at)
            blocks = -(-counts // half)
            row = np.repeat(np.arange(len(counts)), blocks)
            if not len(row):
                continue
            number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = at[row] + number * half
            for j in range(MINIMA):
                least = np.minimum.reduceat(hashes * MULTIPLIERS[j], starts)
                window = least.copy()
                for ahead in (1, 2):
                    same = row[ahead:] == row[:-ahead]
                    window[:-ahead][same] = np.minimum(window[:-ahead][same], least[ahead:][same])
                low = np.searchsorted(minima[:, j], window, "left")
                high = np.searchsorted(minima[:, j], window, "right")
                hit = np.flatnonzero(high > low)
                if len(hit):
                    many = high[hit] - low[hit]
                    place = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    candidates.append(np.repeat(row[hit], many) * len(self.ids) + owner[place, j])
        if not candidates:
            return
        for code in np.unique(np.concatenate(candidates)):
            r, k = divmod(int(code), len(self.ids))
            shared = int(np.isin(self.sets[k], hashes[at[r] : at[r + 1]]).sum())
            if shared >= CONTAINMENT * len(self.sets[k]):
                yield r, k, shared


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The distinct items (item_id, text), in blocks of about BLOCK_CHARS characters; one block at a time is here."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = written(items, "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
    remove(benchmark.sparkSession, items)


HITS = "doc_id long, item_id long, n_shingles long, n_shared long"


def search(index: Items):
    """For rows (doc_id, text): the items of the index that they hold."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, item, len(index.sets[k]), shared) for r, k, shared in index.found(*shingle_hashes(batch["text"], WIDTH)) for item in index.ids[k]]
            row, *rest = (pa.array([f[c] for f in found], pa.int64()) for c in range(4))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(row), *rest], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items with CONTAINMENT of their shingles in a document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    with arrow_batches(spark):
        for block in blocks(benchmark):
            index = Items([r.item_id for r in block], [r.text for r in block])
            parts.append(written(texts.mapInArrow(search(index), HITS), "hits"))
    if not parts:
        return spark.createDataFrame([], HITS)
    best = F.max(F.struct("n_shared", "n_shingles")).alias("best")
    return reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs that hold no item: rows go by their own text, whatever other rows have the same doc_id."""
    hit, name = contaminated(docs, benchmark).select("doc_id").distinct(), unused(docs, "hit")[0]
    own = F.col("doc_id").cast("long")
    suspect = docs.where("text IS NOT NULL").join(hit.select(F.col("doc_id").alias(name)), own.eqNullSafe(F.col(name)), "left_semi").select(F.col("text").cast("string").alias("text")).distinct()
    # the texts of hit ids are searched again, each under a number of its own
    numbered = written(suspect.withColumn("doc_id", F.monotonically_increasing_id()), "suspect")
    found = contaminated(numbered, benchmark).select("doc_id").distinct()
    texts = numbered.join(found, "doc_id", "left_semi").select(digest("text").alias(name))
    return docs.join(texts, digest("text") == F.col(name), "left_anti").select(*docs.columns)


def digest(text: str) -> Column:
    return F.sha2(F.col(text).cast("string"), 256)


ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM bw),
size AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM ds JOIN bs USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
