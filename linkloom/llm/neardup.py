"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification.

Every text becomes its five-word shingles, weighted by 1 + ln of how often they occur (a text of fewer words is one
shingle), so that the weights stay close to the sets that are verified. Each shingle is a Poisson process whose rate is its weight and whose arrivals fall on registers at random; a register
keeps its earliest arrival, and a shingle stops once its next arrival comes after the latest of all registers. Two
texts agree in a register with the chance of their probability Jaccard. Bands of registers give buckets.

Links are verified by the exact Jaccard similarity of the shingle sets, 0.8 or more. Buckets are never expanded into
pairs. At first each member is compared with one leader, the member that shares most buckets over all. What then still lies
in one bucket and in two classes is compared in units of bounded size: by sizes and parities of the sets, which rule out no similar pair, and,
for the members that these leave in doubt, by the sets themselves. A unit sends on only links that join classes, fewer than it has
members. So every pair of bucket mates is in one class or was compared. Equal word sequences collapse to one node before all this.

A document's class is the least doc_id of its connected component, null if no row of it has an id. Nulls count as empty texts; texts
without words form one class. Rows with a null id take part like others. Rows that share an id but not the text are told apart by the
text. Ties don't matter: equal rows share a class. Words are runs other than ASCII white space, A-Z lower-cased. Texts are read whole,
however long; a worker holds a few of them at a time. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.llm.common import lower_ascii, mix64, utf8, word_hashes, word_spans
from linkloom.llm.licenses import pieces
from linkloom.llm.spark_util import components, cut

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits of a set's parities.
PARITY = 1024
#: Most members, and bytes of their sets, that one side of a unit holds on average.
UNIT_ROWS, UNIT_BYTES = 512, 8 << 20


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every k-word shingle, in order; a row with fewer words, but one at least, has one shingle."""
    starts, ends, rows = word_spans(raw, offsets)
    h = word_hashes(lower_ascii(raw), starts, ends)
    gold = np.uint64(0x9E3779B97F4A7C15)
    full = max(0, len(h) - k + 1)
    g = np.zeros(full, np.uint64)
    for i in range(k):
        g = mix64(g * gold + h[i : i + full])
    inside = rows[:full] == rows[k - 1 : k - 1 + full]
    out_rows, out = rows[:full][inside], g[inside]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first, extra = np.searchsorted(rows, short), np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = counts[short] > i
            extra[more] = mix64(extra[more] * gold + h[first[more] + i])
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, extra])
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out


def shingle_keys(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row and 32-bit hash of the distinct shingles of each row: the sets that are verified."""
    return np.unique((rows.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))


def weighted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row and their counts."""
    if not len(rows):
        return rows, hashes, np.zeros(0)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]))
    return r[first], h[first], 1 + np.log(np.diff(np.concatenate([first, [len(r)]])))


def prob_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """The element kept by each of m registers of each row (0 for a row without elements)."""
    earliest = np.full(n_rows * m, np.inf)
    kept = np.zeros(n_rows * m, np.uint64)
    latest = np.full(n_rows, np.inf)
    row, h, w, time, t = rows, hashes, weights, np.zeros(len(rows)), 0
    while len(row):
        t += 1
        r = mix64(h + np.uint64(t * 0xA24BAED4963EE407 % 2**64))
        time = time - np.log(((r >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / w
        alive = time < latest[row]
        row, h, w, time, r = row[alive], h[alive], w[alive], time[alive], r[alive]
        slot = row * m + (mix64(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        kept[slot[won]] = h[won]
        latest = earliest.reshape(n_rows, m).max(axis=1) if n_rows else latest
    return kept.reshape(n_rows, m)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = signature.shape
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], n, axis=0)
    for k in range(m // bands):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + signature.reshape(n, bands, -1)[:, :, k])
    return out


def parities(key: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row PARITY bits, sixty-four to a long: whether an odd number of its shingles falls on a bit; and how many
    shingles it has. key: row and 32-bit hash of each distinct shingle. Two sets differ in as many elements as bits at least."""
    row = (key >> np.uint64(32)).astype(np.int64)
    slot = (mix64(key & np.uint64(0xFFFFFFFF)) % np.uint64(PARITY)).astype(np.int64)
    out = np.zeros((n_rows, PARITY // 64), np.uint64)
    np.bitwise_xor.at(out, (row, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
    return out.view(np.int64), np.bincount(row, minlength=n_rows)


def fits(n: np.ndarray, m: np.ndarray, differ: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """False only where sets of n and m elements that differ in `differ` elements at least cannot be similar enough: the Jaccard
    similarity is (n + m - d) / (n + m + d) for sets that differ in d."""
    return np.maximum(differ, np.abs(n - m)) * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6


def agree(a: str, b: str, threshold: float = THRESHOLD) -> Column:
    """`fits` of two probes (the size, then the parity bits) as a column."""
    m, n = F.col(a)[0], F.col(b)[0]
    bits = F.lit(0)
    for i in range(1, PARITY // 64 + 1):
        bits = bits + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return F.greatest(bits, F.greatest(m, n) - F.least(m, n)) * F.lit(1 + threshold) <= (m + n) * F.lit(1 - threshold) + F.lit(1e-6)


def nodes_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each row's lower-cased words."""
    lowered = lower_ascii(raw).tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(b" ".join(lowered[a:b].split()), digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, which with the id names a row but for its exact repeats."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, th, node, the buckets (band hashes) and the probe of each row; rows without words have no buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                raw, offsets = utf8(batch.column("text"))
                n = batch.num_rows
                signature = prob_minhash(*weighted(*(found := shingles(raw, offsets))), n)
                bands = band_hashes(signature).view(np.int64)
                bits, sizes = parities(shingle_keys(*found), n)
                probe = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack([sizes, bits]).ravel()), PARITY // 64 + 1).cast(pa.list_(pa.int64()))
                some = np.bincount(found[0], minlength=n)[:n] > 0
                ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(nodes_of(raw, offsets)), lists, probe], ["doc_id", "th", "node", "buckets", "probe"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, node long, buckets array<long>, probe array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and its sorted set of 32-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                raw, offsets = utf8(batch.column("text"))
                rows, h = shingles(raw, offsets)
                key = shingle_keys(rows, h)
                ends = np.concatenate([[0], np.cumsum(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(raw, offsets)), lists], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The sizes alone rule many out before any sets meet."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(left, "a").join(right, "b").where((F.least(F.size("s"), F.size("t")) >= threshold * F.greatest(F.size("s"), F.size("t"))) & (both >= threshold * (F.size("s") + F.size("t") - both))).select("a", "b")


def in_units(member: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Deals the members of each bucket that holds several classes into units (bucket, x, y) of bounded rows and bytes. A unit
    compares some members outside the bucket's largest class (own) with some of all members (all), so that over the units of a
    bucket every pair of different classes is compared and the largest class never meets itself. member: bucket, node, label,
    and whatever a unit needs, of `weight` bytes."""
    counted = member.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    whole = counted.groupBy("bucket").agg(F.max(F.struct("n", "label", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w")).where(F.col("n") > F.col("m.n"))
    parts = lambda n, w: F.greatest(F.ceil(n / F.lit(unit_rows)), F.ceil(w / F.lit(unit_bytes)), F.lit(1)).cast("int")
    split = whole.select("bucket", F.col("m.label").alias("most"), parts(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("nx"), parts(F.col("n"), F.col("w")).alias("ny"))
    outside = F.col("label") != F.col("most")
    at = member.join(split, "bucket").withColumn("few", outside).withColumn("fx", F.pmod(F.xxhash64("node"), F.col("nx")).cast("int")).withColumn("fy", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ny")).cast("int"))
    column = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda x: F.struct(x.alias("x"), F.col("fy").alias("y")))
    row = F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda y: F.struct(F.col("fx").alias("x"), y.alias("y")))
    dealt = at.withColumn("u", F.explode(F.when(F.col("few"), F.array_union(row, column)).otherwise(column)))
    return dealt.select("bucket", F.col("u.x").alias("x"), F.col("u.y").alias("y"), "few", (F.col("few") & (F.col("u.x") == F.col("fx"))).alias("own"), (F.col("u.y") == F.col("fy")).alias("all"), *[c for c in member.columns if c not in ("bucket", "weight")])


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of a sorted partition, one by one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        whole = pa.concat_batches([*held, batch]) if held else batch
        k = [whole.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "x", "y")]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1).tolist() if whole.num_rows else []
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield whole.slice(a, b - a)
        held = [whole.slice(cuts[-1] if cuts else 0)]
    if held and held[0].num_rows:
        yield held[0]


def possible(node: np.ndarray, label: np.ndarray, few: np.ndarray, own: np.ndarray, every: np.ndarray, sizes: np.ndarray, bits: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) and the differing parity bits of a unit's pairs of different classes that may be similar enough."""
    left, right = np.flatnonzero(own), np.flatnonzero(every)
    step = max(1, (1 << 16) // max(1, len(right)))
    for lo in range(0, len(left), step):
        i = left[lo : lo + step]
        differ = np.bitwise_count(bits[i][:, None] ^ bits[right][None]).sum(axis=2, dtype=np.int64)
        new = (label[i][:, None] != label[right][None]) & (~few[right][None] | (node[i][:, None] < node[right][None]))
        p, q = np.nonzero(new & fits(sizes[i][:, None], sizes[right][None], differ, threshold))
        yield i[p], right[q], differ[p, q]


def _flags(unit: pa.RecordBatch) -> list[np.ndarray]:
    return [unit.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "few", "own", "all")]


def unsettled(member: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (bucket, node) that by their probes may be similar enough to a bucket mate of another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            node, label, few, own, every = _flags(unit)
            probe = unit.column("probe").flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            some = np.zeros(len(node), bool)
            for i, j, _ in possible(node, label, few, own, every, probe[:, 0], probe[:, 1:].view(np.uint64), threshold):
                some[i] = some[j] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([unit.column("bucket").filter(pa.array(some)), pa.array(node[some])], ["bucket", "node"])

    dealt = in_units(member.withColumn("weight", F.lit(8 * (PARITY // 64 + 1))))
    return dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "bucket long, node long").distinct()


def joined_classes(member: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between the classes of each bucket, verified by their sets: all that join two classes of a unit that earlier
    links of the unit leave apart, and no others, so that a unit gives fewer links than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            node, label, few, own, every = _flags(unit)
            sets = unit.column("shingles")
            flat, ends = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            bits, sizes = parities((np.repeat(np.arange(len(node), dtype=np.uint64), np.diff(ends)) << np.uint64(32)) | flat, len(node))
            above: dict[int, int] = {}

            def top(c: int, above: dict[int, int] = above) -> int:
                while (up := above.get(c, c)) != c:
                    above[c] = above.get(up, up)
                    c = up
                return c

            found = []
            for i, j, differ in possible(node, label, few, own, every, sizes, bits.view(np.uint64), threshold):
                for k in np.argsort(differ, kind="stable").tolist():
                    p, q = int(i[k]), int(j[k])
                    a, b = top(int(label[p])), top(int(label[q]))
                    if a != b:
                        both = len(np.intersect1d(flat[ends[p] : ends[p + 1]], flat[ends[q] : ends[q + 1]], assume_unique=True))
                        if both >= threshold * (sizes[p] + sizes[q] - both):
                            above[a] = b
                            found.append((int(node[p]), int(node[q])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    dealt = in_units(member.withColumn("weight", 4 * F.size("shingles")))
    return dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, node, class_node and class_id of each row. class_node is the least node of the class."""
    rows = cut(signed(docs))
    reps = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"), F.first("probe").alias("probe"))
    member = reps.select("node", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut(member.join(shared, "bucket").select("bucket", "node", "n"))
    info = cut(member.groupBy("node").agg(F.sum("n").alias("reach")).join(reps.select("node", "rep", "probe"), "node"))
    member = cut(member.join(info.select("node", "reach", "probe"), "node").select("bucket", "node", "reach", "probe"))
    first = member.groupBy("bucket").agg(F.max(F.struct("reach", "node", "probe")).alias("f")).select("bucket", F.col("f.node").alias("head"), F.col("f.probe").alias("led"))
    pairs = cut(member.join(first, "bucket").where((F.col("node") != F.col("head")) & agree("probe", "led", threshold)).select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct())
    # Texts of nodes that share a bucket: by the least id of a node; those without any id are looked at one and all.
    wanted = info.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    named = keyed(docs).where("doc_id is not null").join(wanted, "doc_id", "left_semi").select("text")
    unnamed = keyed(docs).where("doc_id is null").select("text")
    sets = cut(shingle_sets(named.union(unnamed)).join(info.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    links = cut(verified(pairs, sets, threshold))
    labels = components(links)
    labelled = cut(member.join(labels, "node", "left").select("bucket", "node", "probe", F.coalesce("label", "node").alias("label")))
    doubtful = cut(unsettled(labelled, threshold))
    fresh = cut(joined_classes(labelled.drop("probe").join(doubtful, ["bucket", "node"], "left_semi").join(sets, "node"), threshold))
    if not fresh.isEmpty():
        labels = components(links.union(fresh))
    least = labels.join(reps.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    linked = labels.join(least, "label").select("node", F.col("label").alias("class_node"), "class_id")
    # Written, so that the join below shuffles both sides anew and a text with very many copies can be split.
    own = cut(reps.select("node", "rep").join(linked, "node", "left").select("node", F.coalesce("class_node", "node").alias("class_node"), F.coalesce("class_id", "rep").alias("class_id")))
    return rows.select("doc_id", "th", "node").join(own, "node").select("doc_id", "th", "node", "class_node", "class_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of the least id, nulls last, and among its rows the one whose text has the least hash. Rows
    that repeat it wholly in id and text go too. The other columns are carried, whatever their names."""
    found = cut(classes(docs).groupBy("doc_id", "th", "class_node").agg(F.count(F.lit(1)).alias("n")))
    kept = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th", "n")).alias("k")).select(F.col("k.doc_id").alias("kd"), F.col("k.th").alias("kt"), F.col("k.n").alias("kn"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("rd"), F.xxhash64("text").alias("rt"))
    same = lambda: F.col("rd").eqNullSafe(F.col("kd")) & (F.col("rt") == F.col("kt"))
    once = rows.join(kept.where("kn = 1"), same(), "left_semi")
    if not (again := cut(kept.where("kn > 1"))).isEmpty():
        once = once.union(rows.join(again, same(), "left_semi").dropDuplicates(["rd", "rt"]))
    return once.select("row.*")
