"""Document fingerprints: quartile bucket digests.

Byte triplets inside a sliding window are hashed into buckets and counted; each bucket is then written as two bits
that say in which quartile of the bucket counts it lies, beside a logarithmic length. Two digests are compared by
a bounded difference: the sum of the buckets' quartile steps (opposite quartiles count double) and of the length steps.

Nulls count as empty texts; an empty text has the digest of no counts. Equal texts have equal digests. Texts are
read whole, one at a time if they are very long. Rows with equal ids follow each other in the order of their texts' hashes; null ids come
after all others. Rows that repeat in id and text follow each other. A table of one row is followed by itself; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.common import parts_for, text_col, total_bytes

BUCKETS = 256
#: The triplets taken at each place, by distance from it.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: The mean step of two digests that have nothing in common: 0, 1, 2 and 6 with their chances. Larger differences count as this.
UNRELATED = 1.625
LENGTH_STEP = 12 / BUCKETS
_STEPS = np.array([0, 1, 2, 6])
_CHUNK = 4 << 20
PART_BYTES, MAX_PARTS = 16 << 20, 20_000


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """One row of bucket counts for each text."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        lens = np.array([len(t) for t in texts[at:end]], np.int64)
        raw = np.frombuffer(b"".join(texts[at:end]), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(end - at, dtype=np.int64), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(raw))  # bytes from here to the text's end
        for k, (i, j, m) in enumerate(TRIPLETS):
            n = len(raw) - m
            if n <= 0:
                continue
            x = (raw[i : i + n] << np.uint32(16)) | (raw[j : j + n] << np.uint32(8)) | raw[m : m + n]
            x = (x ^ np.uint32(k << 24)) * np.uint32(0x9E3779B1)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
            own = left[:n] > m
            slot = row[:n] * BUCKETS + (x >> np.uint32(24)).astype(np.int64) % BUCKETS
            out[at:end] += np.bincount(slot[own], minlength=(end - at) * BUCKETS).reshape(-1, BUCKETS)
        at = end
    return out


def length_code(n_bytes: int) -> int:
    return round(math.log(n_bytes + 1) / math.log(1.2))


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 for each bucket: how many of its row's three quartiles it exceeds."""
    ranked = np.sort(counts, axis=1)
    q = [ranked[:, BUCKETS * k // 4 - 1 : BUCKETS * k // 4] for k in (1, 2, 3)]
    return ((counts > q[0]).astype(np.uint8) + (counts > q[1]) + (counts > q[2])).astype(np.uint8)


def digests(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The digests as text, and their quartile codes and length codes."""
    codes = quartile_codes(bucket_counts(texts)) if texts else np.zeros((0, BUCKETS), np.uint8)
    lens = np.array([length_code(len(t)) for t in texts], np.int64)
    packed = (codes[:, 0::4] << 6) | (codes[:, 1::4] << 4) | (codes[:, 2::4] << 2) | codes[:, 3::4]
    return [f"q1{n:02x}{p.tobytes().hex()}" for n, p in zip(lens, packed, strict=True)], codes, lens


def parse(digest: str) -> tuple[np.ndarray, int]:
    packed = np.frombuffer(bytes.fromhex(digest[-BUCKETS // 2 :]), np.uint8)
    return np.stack([(packed >> 6) & 3, (packed >> 4) & 3, (packed >> 2) & 3, packed & 3], axis=1).ravel(), int(digest[2 : -BUCKETS // 2], 16)


def likeness(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from the difference of unrelated ones on."""
    steps = _STEPS[np.abs(a.astype(np.int16) - b.astype(np.int16))].mean(axis=1)
    lengths = np.maximum(np.abs(len_a - len_b) - 1, 0) * LENGTH_STEP
    return 1 - np.minimum((steps + lengths) / UNRELATED, 1)


def compare(left: str, right: str) -> float:
    (a, m), (b, n) = parse(left), parse(right)
    return float(likeness(a[None], b[None], np.array([m]), np.array([n]))[0])


def edited(text: str, following: str) -> str:
    """The last half of the text gives way to as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NONE = -(1 << 63)


def compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The result for texts and the texts that follow them."""
    after = [edited(t, x).encode() for t, x in zip(texts, following, strict=True)]
    marks, codes, lens = digests([t.encode() for t in texts])
    edited_marks, edited_codes, edited_lens = digests(after)
    # Mostly the next text's digest is that of the next row.
    _, last_codes, last_lens = digests([following[-1].encode()])
    next_codes, next_lens = np.concatenate([codes[1:], last_codes]), np.concatenate([lens[1:], last_lens])
    cols = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in after], pa.string()),
        pa.array(marks, pa.string()),
        pa.array(edited_marks, pa.string()),
        pa.array(likeness(codes, edited_codes, lens, edited_lens), pa.float64()),
        pa.array(likeness(codes, next_codes, lens, next_lens), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


def walk(batches: Iterator[pa.RecordBatch], chunk: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """The results of a part's rows, which come in order, the first row that is not its own behind them. A few megabytes of texts are held."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, own, t in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), batch.column("text"), strict=True):
            if texts and size >= chunk or not own:
                text = t.as_py()
                if texts:
                    yield compared(ids, texts, [*texts[1:], text])
                if not own:
                    return
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t.as_py())
            size += len(texts[-1])


class Ranges:
    """Parts of the descending order of (doc_id, hash of the text), from the ids that cut the table into equal shares. An id that
    fills several shares has as many parts, which its rows fall into by the hash."""

    def __init__(self, shares: list[int]):
        self.cuts, self.times = np.unique(np.array(shares, np.int64), return_counts=True)
        # Ids below a cut, and that id itself where it fills shares.
        self.first = np.cumsum(np.where(self.times > 1, self.times + 1, 1)) - np.where(self.times > 1, self.times + 1, 1)
        self.n = int(self.first[-1] + (self.times[-1] + 1 if self.times[-1] > 1 else 1))

    def part(self, key: np.ndarray, th: np.ndarray) -> np.ndarray:
        """Ascending with (key, th)."""
        at = np.searchsorted(self.cuts, key, side="left")
        share = ((th.astype(np.float64) + 2.0**63) / 2.0**64 * self.times[at]).astype(np.int64)
        return self.first[at] + np.where((self.times[at] > 1) & (self.cuts[at] == key), 1 + np.minimum(share, self.times[at] - 1), 0)


def fingerprint_documents(docs: DataFrame, part_bytes: int = PART_BYTES, max_parts: int = MAX_PARTS) -> DataFrame:
    """Digests of each text, of its edited text and their likeness, with the next document in descending (doc_id, hash of the text).

    Ids are cut into ranges of about `part_bytes` of text, or into `max_parts` ranges if those would be more. A range is read as a stream, so its size bounds no
    memory. The head of each range, which follows the last row of the range above, goes to both. Only the cuts and the heads' ids and hashes reach
    the driver, `max_parts` of either at most.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text_col().alias("text"), F.xxhash64(text_col()).alias("th"))
    parts = min(max_parts, parts_for(total_bytes(docs), part_bytes))
    cuts = df.agg(F.percentile_approx("key", [i / parts for i in range(1, parts + 1)], 20 * parts + 10_000).alias("c")).first()["c"]
    if not cuts:
        return df.sparkSession.createDataFrame([], SCHEMA)
    ranges = Ranges(cuts)

    @F.pandas_udf("int")
    def part(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.part(keys.to_numpy(), hashes.to_numpy()))

    heads = {r["part"]: (r["h"]["key"], r["h"]["th"]) for r in df.select("key", "th", part("key", "th").alias("part")).groupBy("part").agg(F.max(F.struct("key", "th")).alias("h")).collect()}
    filled = sorted(heads)
    above = dict(zip(filled, [*filled[1:], filled[0]], strict=True))  # the last row of all is followed by the first
    to = {heads[p]: q for p, q in above.items()}

    @F.pandas_udf("int")
    def receiver(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([to.get(k) for k in zip(keys.tolist(), hashes.tolist(), strict=True)], dtype="Int32")

    own = df.select("doc_id", "key", "text", "th", part("key", "th").alias("part"), F.lit(True).alias("own"))
    handed = df.select("key", "text", "th", receiver("key", "th").alias("part")).where("part is not null").groupBy("part").agg(F.first("text").alias("text"))
    rows = own.unionByName(handed.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), "text", F.lit(None).cast("long").alias("th"), "part", F.lit(False).alias("own")))
    return rows.repartitionById(ranges.n, F.col("part")).sortWithinPartitions(F.desc("own"), F.desc("key"), F.desc("th")).select("doc_id", "text", "own").mapInArrow(walk, SCHEMA)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
