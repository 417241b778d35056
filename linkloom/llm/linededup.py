"""Line deduplication by pairwise alignment.

Runs of lines that together have MIN_WORDS words or more (mostly a single line) and that several documents hold link each
later document to the first one that holds them, so a run in n
documents makes n - 1 links however frequent it is, and no pair within a group is made twice. Rare lines thus find the
overlaps, and frequent ones cost no more. Each linked pair is aligned with patience diff over its line hashes, then
what is left by the common runs of lines, wherever and however often they stand, and the aligned common blocks of MIN_WORDS words or more leave the later document. No link is lost
by taking first holders alone: every line with words of a block that a document has in common with any earlier one lies in a run that the first
holder of that run has too. (Blank lines at the ends of a block go only if the first holder has them.) A line of a first holder never leaves
it on account of a later one, so every text survives once.

Later means a greater (doc_id, hash of the text); null ids come last. Equal rows count as one document and are treated
alike; rows with one id and different texts are two documents. Lines end at `\\n`; blank and short lines go only inside a block of
MIN_WORDS words. Nulls and empty texts hold no such lines and stay as they are. Texts are read whole, however long: a task holds the line hashes
of the pairs of one Arrow batch. Ties don't occur, since the hash orders rows of one id. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.common import SPACE, mix64
from linkloom.llm.spark_util import cut

MIN_WORDS = 5
_LAST = (1 << 63) - 1


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, length) of the common lines that patience diff aligns, in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            matched.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            matched.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {b[j]: j for j in range(blo, bhi) if in_b[b[j]] == 1}
        once = [(i, place[a[i]]) for i in range(alo, ahi) if in_a[a[i]] == 1 and a[i] in place]
        if not once:
            continue
        tails, tops, back = [], [], [-1] * len(once)  # longest increasing run of places in b
        for k, (_, j) in enumerate(once):
            n = bisect_left(tails, j)
            back[k] = tops[n - 1] if n else -1
            tails[n : n + 1], tops[n : n + 1] = [j], [k]
        run, k = [], tops[-1]
        while k >= 0:
            run.append(once[k])
            k = back[k]
        i0, j0 = alo, blo
        for i, j in [*reversed(run), (ahi, bhi)]:
            if i < ahi:
                matched.append((i, j))
            if i > i0 and j > j0:
                todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def common_runs(later: list[int], earlier: list[int]) -> list[int]:
    """For each place of `later`, the length of the longest run of lines that ends there and stands anywhere in `earlier`.
    A suffix automaton of `earlier`: the work grows with the sum of the lengths, however often lines repeat."""
    known = set(later)
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for h in earlier:
        if h not in known:  # no run crosses it
            h = -1
        new, p = len(step), last
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        while p >= 0 and h not in step[p]:
            step[p][h] = new
            p = link[p]
        if p >= 0:
            q = step[p][h]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(h) == q:
                    step[p][h] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, state, n = [], 0, 0
    for h in later:
        while state > 0 and h not in step[state]:
            state = link[state]
            n = longest[state]
        if h in step[state]:
            state, n = step[state][h], n + 1
        else:
            state, n = 0, 0
        out.append(n)
    return out


def removed_lines(later: list[int], words: list[int], earlier: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Places of the later document's lines that lie in an aligned block with enough words. Patience diff comes first; what it
    leaves, lines that repeat or stand in another order, is aligned by the runs of lines that both documents hold."""
    gone = {i for s, _, n in patience_blocks(later, earlier) if sum(words[s : s + n]) >= min_words for i in range(s, s + n)}
    if len(gone) < len(later):
        before = [0, *accumulate(words)]
        done = len(later)  # lines from here on are settled by runs that end later
        for end, n in reversed(list(enumerate(common_runs(later, earlier), 1))):
            if before[end] - before[end - n] >= min_words:
                gone.update(range(end - n, min(end, done)))
                done = min(done, end - n)
    return sorted(gone)


def run_keys(h: np.ndarray, c: np.ndarray, words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and two hashes of each shortest run of lines with min_words words or more that starts, or that ends, with a line that has
    words. ends: the last line + 1 of each document. Every line with words of a common run that has enough words lies in such a
    run that is common too: the one that ends or the one that starts with it, or else the one that starts the common run."""
    total = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    line = np.flatnonzero(words > 0)
    stop = np.searchsorted(total, total[line] + min_words, "left")
    inside = stop <= ends[doc[line]]
    back = np.searchsorted(total, total[line + 1] - min_words, "right") - 1
    # Single lines were found forwards.
    other = (total[line + 1] >= min_words) & (words[line] < min_words)
    other &= back >= np.concatenate([[0], ends])[doc[line]]
    start, stop = np.concatenate([line[inside], back[other]]), np.concatenate([stop[inside], line[other] + 1])
    out = [doc[start]]
    for values, odd in ((h.view(np.uint64), 0x9E3779B97F4A7C15), (c.astype(np.uint64), 0xD6E8FEB86659FD93)):
        # A polynomial of the lines' hashes, by sums from the start; the run's place is divided out.
        up, down = (np.cumprod(np.full(len(h) + 1, x, np.uint64)) for x in (odd, pow(odd, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values) * up[: len(h)], dtype=np.uint64)])
        out.append(mix64((sums[stop] - sums[start]) * down[start]).view(np.int64))
    return out[0], out[1], out[2]


def held_runs(seqs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th and the two hashes of each run that links documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[k].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "c", "w")]
            doc, h, c = run_keys(*columns, np.cumsum(batch["h"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), min_words)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch["_id"].take(at), batch["_th"].take(at), pa.array(h), pa.array(c)], ["_id", "_th", "h", "c"])

    return seqs.select("_id", "_th", F.col("l.h").alias("h"), F.col("l.c").alias("c"), F.col("l.w").alias("w")).mapInArrow(run, "_id long, _th long, h long, c long").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows, each in a struct so that no name of theirs can clash, with what names a row but for its exact repeats."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").alias("t"))


def alignments(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th, the places of lines to remove and the earlier documents' ids, for documents that lose some."""
    word_count = lambda x: F.size(F.filter(F.split(x, SPACE, -1), lambda w: w != ""))
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.crc32(x.cast("binary")).alias("c"), word_count(x).alias("w")))
    seqs = cut(_keyed(docs.select("doc_id", "text").where("text is not null")).select("_id", "_th", lines.alias("l")))
    held = held_runs(seqs, min_words).select(F.struct("_id", "_th").alias("d"), "h", "c")
    # Written, so that the join below shuffles both sides anew and a run that very many documents hold can be split.
    first = cut(held.groupBy("h", "c").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("h", "c", "a"))
    pairs = held.join(first, ["h", "c"]).where("d > a").select("d", "a").distinct()
    flat = seqs.dropDuplicates(["_id", "_th"]).select("_id", "_th", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    own = flat.select(F.struct("_id", "_th").alias("d"), F.col("h").alias("dh"), F.col("w").alias("dw"))
    other = flat.select(F.struct("_id", "_th").alias("a"), F.col("h").alias("ah"))
    both = pairs.join(own, "d").join(other, "a").select(F.col("d._id").alias("_id"), F.col("d._th").alias("_th"), F.col("a._id").alias("earlier"), "dh", "dw", "ah")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [removed_lines(d.as_py(), w.as_py(), a.as_py(), min_words) for d, w, a in zip(batch["dh"], batch["dw"], batch["ah"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], batch["earlier"], pa.array(gone, pa.list_(pa.int32()))], ["_id", "_th", "earlier", "gone"])

    aligned = both.mapInArrow(run, "_id long, _th long, earlier long, gone array<int>").where(F.size("gone") > 0)
    return aligned.groupBy("_id", "_th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.sort_array(F.collect_set("earlier")).alias("earlier"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, the input's columns; t, the text; new, the text without its removed lines; gone and earlier (null: nothing removed)."""
    joined = _keyed(docs).join(alignments(docs, min_words), ["_id", "_th"], "left")
    kept = F.transform(F.filter(F.arrays_zip(F.split("t", "\n", -1).alias("l"), F.col("mark").alias("m")), lambda x: x["m"].isNull()), lambda x: x["l"])
    # Marks: an array as long as the last removed place, with something at each removed place; the zip pads it with nulls.
    marks = F.transform(F.arrays_zip(F.col("gone").alias("g"), F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1)).alias("p")), lambda x: F.concat(F.array_repeat(F.lit(None).cast("int"), x["g"] - x["p"] - 1), F.array(F.lit(1))))
    return joined.withColumn("mark", F.flatten(marks)).withColumn("new", F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))).drop("mark")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    empty = F.array().cast("array<int>")
    return dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n", -1))).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce("gone", empty).alias("removed_lines"), F.coalesce("earlier", F.array().cast("array<long>")).alias("earlier_ids"), F.crc32(F.col("new").cast("binary")).alias("kept_crc32"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their new texts; those of which nothing is left go. n_chars follows the text; all other columns are carried, whatever
    their names."""
    out = dedup_lines(docs).where(F.col("gone").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("new")} | ({"n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
