"""Document fingerprints by one-permutation MinHash with low-order bits.

Every shingle of five words is hashed once; the hash's high bits choose one of BINS bins, which keeps its
least value. Empty bins are filled by optimal densification and the low eight bits of each bin are packed
into the fingerprint. Of two fingerprints the share of equal bins, less the share that eight bits make equal
by chance, estimates the Jaccard likeness of the two shingle sets.

Defined cases: a null or empty text, or one of white space, has the fingerprint of the empty set; two such
are alike (1.0), and such a one is unlike any other (0.0). A text of one to four words has one shingle, all
its words. Rows that repeat a doc_id follow each other in the order of their texts. A null doc_id stands
before all others. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_limits, cut_points, partitions
from assetweave.llm.shingles import one_permutation, shingle_hashes

WIDTH = 5
BINS = 512
BITS = 8
CHANCE = 2.0**-BITS


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows x BINS low bytes of the minima, and whether each row has shingles at all."""
    hashes, at = shingle_hashes(texts, WIDTH)
    return one_permutation(hashes, at, BINS).astype(np.uint8), np.diff(at) > 0


def encoded(code: np.ndarray, has: np.ndarray) -> list[str]:
    """Fingerprints as text; that of the empty set is empty."""
    return [base64.b64encode(c.tobytes()).decode() if h else "" for c, h in zip(code, has, strict=True)]


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness, row by row, corrected for equality by chance."""
    equal = (a == b).mean(axis=1)
    found = np.clip((equal - CHANCE) / (1 - CHANCE), 0.0, 1.0)
    return np.where(has_a & has_b, found, (has_a == has_b).astype(float))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint of the whole text."""
    arrow_limits(docs.sparkSession)

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(encoded(*packed(pa.Array.from_pandas(texts, type=pa.large_string()))), dtype=object)

    return docs.withColumn("fingerprint", made(F.col(text)))


def likeness_column(a: str, b: str):
    """Column: the likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        code = lambda s: np.stack([np.frombuffer(base64.b64decode(v), np.uint8) if v else np.zeros(BINS, np.uint8) for v in s])
        has = lambda s: np.array([bool(v) for v in s])
        return pd.Series(likeness(code(x), has(x), code(y), has(y)) if len(x) else [], dtype=float)

    return alike(F.col(a), F.col(b))


def in_order(docs: DataFrame, pieces: int) -> DataFrame:
    """docs dealt into ranges of doc_id, each in order, with the first row of the next range at its end.

    Adds piece (the range) and extra (True for that last row). The cuts are ids that occur, so the first row of
    a range is known without a look at the ranges; the first row of all also ends the last range.
    """
    rough = np.array(cut_points(docs, "doc_id", pieces), dtype=np.int64)

    @F.pandas_udf("int")
    def near(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(rough, ids.to_numpy(np.int64), "right"), dtype=np.int32)

    # the quantiles are floating-point numbers; the least id of each range is exact
    least = docs.where("doc_id IS NOT NULL").groupBy(near("doc_id")).agg(F.min("doc_id").alias("id")).collect()
    ids = sorted(r.id for r in least)
    cuts = np.array(ids[1:], dtype=np.int64)
    lowest = None if docs.where("doc_id IS NULL").limit(1).count() else ids[0] if ids else None

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        value = ids.fillna(0).to_numpy(np.int64)
        piece = np.where(null, 0, np.searchsorted(cuts, value, "right"))
        starts = ~null & np.isin(value, cuts)
        starts_all = null if lowest is None else ~null & (value == lowest)
        return pd.Series([[p, *([p - 1] if s and p else []), *([len(cuts)] if a else [])] for p, s, a in zip(piece, starts, starts_all, strict=True)], dtype=object)

    dealt = docs.select("doc_id", "text", F.posexplode(ranges("doc_id")).alias("copy", "piece"))
    dealt = dealt.select("doc_id", "text", "piece", (F.col("copy") > 0).alias("extra"))
    # the wrap-around row comes last in its range although its id is the lowest
    return dealt.repartition(partitions(docs.sparkSession), "piece").sortWithinPartitions("piece", "extra", F.col("doc_id").asc_nulls_first(), "text")


def edited_texts(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its last quarter of code points replaced by the first as many of the one that follows."""
    return [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they are."""
    arrow_limits(docs.sparkSession)
    pieces = 4 * partitions(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for its follower
        for batch in batches:
            ids, texts, piece, extra = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], batch["piece"].to_pylist(), batch["extra"].to_pylist()
            if held:
                ids, texts, piece, extra = [held[0], *ids], [held[1], *texts], [held[2], *piece], [held[3], *extra]
            if not ids:
                continue
            held = (ids[-1], texts[-1], piece[-1], extra[-1])
            # a document's follower is the next row of its range; of several extra rows only the first counts
            own = [i for i in range(len(ids) - 1) if not extra[i]]
            if not own:
                continue
            code, has = packed(pa.array(texts, pa.large_string()))
            new = edited_texts([texts[i] for i in own], [texts[i + 1] for i in own])
            code_new, has_new = packed(pa.array(new, pa.large_string()))
            i = np.array(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[k] for k in own], pa.int64()),
                    "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                    "fingerprint": pa.array(encoded(code[i], has[i]), pa.string()),
                    "edited_fingerprint": pa.array(encoded(code_new, has_new), pa.string()),
                    "near_edited": pa.array(likeness(code[i], has[i], code_new, has_new)),
                    "near_next": pa.array(likeness(code[i], has[i], code[i + 1], has[i + 1])),
                }
            )

    return in_order(docs, pieces).mapInArrow(report, SCHEMA)
