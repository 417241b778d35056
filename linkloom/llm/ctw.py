"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, the last by an end symbol. A symbol is eight binary
decisions; each of the 255 decision nodes has a context tree over the DEPTH bytes before the symbol. Every tree node
holds a Krichevsky-Trofimov estimate and the weight, after all training texts, of stopping there rather than looking one
byte further back. A prediction mixes the estimates of all depths by these weights; a context that was never seen
has the estimator's prior, one half. The result is a proper distribution over texts. bits_per_byte is the code length over the bytes of the
text as it is.

How it is spread: documents fall into blocks of bounded bytes. A block sends its distinct (context, symbol) pairs and
distinct words with their training counts, in sorted packed runs, to shards of the model. A pair's shard follows from
the last two context bytes, so a shard holds whole subtrees and weighs them alone; only the nodes of depth 0 and 1, at
most 65,280, meet in the driver. The blocks then ask their shards for what they need. Nothing that grows with the
corpus is broadcast or collected, no counts are cut off, and a shard's memory is that of its part of the model. Runs are added up in
groups of blocks first, and a part of the model answers groups of blocks, so no task's input follows the corpus.

Nulls count as empty texts, which are one end symbol. Rows with equal ids are scored one by one and are together in or
out of training; a null id counts as text 'null'. A text longer than a block is a block of its own size; rows alike in id and text fall into one
block, which is read as a stream. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.llm.common import lower_ascii, mix64, parts_for, text_col, total_bytes, utf8, word_spans
from linkloom.llm.spark_util import stage_folder

DEPTH = 5
END = 255  # no byte of UTF-8
BLOCK_BYTES = 24 << 20
#: Parts of the model at most (what they hold levels off as the text grows), and blocks that are added up together at least.
MAX_SHARDS, GROUP_BLOCKS = 1024, 16
FOLDS = 10
_SUB_BYTES = 4 << 20
_KEY = np.int64


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes of their steps: short for sorted runs and for small counts."""
    steps = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel())


def symbols(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all rows in one array, `depth` end symbols before each row; each row's first place and its end."""
    starts, ends, rows = word_spans(raw, offsets)
    n_rows = len(offsets) - 1
    lens = ends - starts
    words = np.bincount(rows, minlength=n_rows)
    chars = np.bincount(rows, lens, n_rows).astype(np.int64) if len(rows) else np.zeros(n_rows, np.int64)
    size = chars + np.maximum(words, 1)
    stop = np.cumsum(size + depth)
    first = stop - size
    out = np.full(int(stop[-1]) if n_rows else 0, 0x20, np.uint8)
    for k in range(depth):
        out[first - depth + k] = END
    if len(rows):
        done = np.cumsum(lens + 1) - (lens + 1)  # symbols of earlier words, over all rows
        row_done = np.cumsum(chars + words) - (chars + words)
        at = first[rows] + done - row_done[rows]
        src = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        out[np.repeat(at - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(len(src))] = lower_ascii(raw)[src]
    out[stop - 1] = END
    return out, first, stop


def pair_keys(sym: np.ndarray, first: np.ndarray, stop: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """(context, symbol) of every symbol in order: the nearest context byte is the highest, the symbol the lowest."""
    wide = sym.astype(_KEY)
    n = len(wide) - depth
    if n <= 0:
        return np.zeros(0, _KEY)
    key = wide[depth:].copy()
    for j in range(1, depth + 1):
        key |= wide[depth - j : depth - j + n] << _KEY(8 * (depth + 1 - j))
    own = np.ones(len(wide), bool)
    for k in range(depth):
        own[first - depth + k] = False
    return key[own[depth:]]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, or the sums of their weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.concatenate([first, [len(keys)]])) if weights is None else np.add.reduceat(weights, first)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0, by Stirling's series after a shift of 6."""
    shift = np.ones_like(x)
    for k in range(6):
        shift *= x + k
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - 1.1447298858494002  # log(pi)


def decisions(contexts: np.ndarray, syms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes (context, node) in order with how often each went to 0 and to 1."""
    keys, bits = [], []
    for j in range(8):
        keys.append((contexts << 8) | (1 << j) | (syms >> (8 - j)))
        bits.append((syms >> (7 - j)) & 1)
    key, bit = np.concatenate(keys), np.concatenate(bits)
    both, total = counted((key << 1) | bit, np.tile(counts, 8))
    node = np.unique(both >> 1)
    at = np.searchsorted(node, both >> 1)
    n = np.zeros((2, len(node)))
    n[both & 1, at] = total
    return node, n[0], n[1]


class Level:
    """The decision nodes of one depth: counts, the log of the weighted probability, the weight of stopping."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: tuple[np.ndarray, np.ndarray] | None):
        """children: the parent's node for each child, and the child's log weighted probability; None at full depth."""
        self.node, self.n0, self.n1 = node, n0, n1
        own = kt_log(n0, n1)
        if children is None:
            self.log_w, self.stop = own, np.ones(len(node))
        else:
            below = np.bincount(np.searchsorted(node, children[0]), children[1], len(node)) if len(node) else own
            self.log_w = np.logaddexp(own, below) - np.log(2.0)
            self.stop = np.exp(own - np.log(2.0) - self.log_w)

    def mix(self, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bit at each node; one half, the estimator's own prior, where the node was never seen. deeper: that of the next depth."""
        if not len(self.node):
            return np.full(len(node), 0.5)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        n0, n1 = self.n0[at], self.n1[at]
        p = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        if deeper is not None:
            p = self.stop[at] * p + (1 - self.stop[at]) * deeper
        return np.where(self.node[at] == node, p, 0.5)


def levels(keys: np.ndarray, counts: np.ndarray, least: int, depth: int = DEPTH) -> list[Level]:
    """Depths `least` to `depth`, from training pairs in order; the last of the list is the deepest."""
    out: list[Level] = []
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    for d in range(depth, least - 1, -1):
        context, sym = keys >> (8 * (depth + 1 - d)), keys & 255
        pair, total = counted((context << 8) | sym, counts)
        node, n0, n1 = decisions(pair >> 8, pair & 255, total)
        below = (((out[0].node >> 16) << 8) | (out[0].node & 255), out[0].log_w) if out else None
        out.insert(0, Level(node, n0, n1, below))
    return out


def bit_probabilities(keys: np.ndarray, tree: list[Level], least: int, depth: int = DEPTH, below: np.ndarray | None = None, upto: int | None = None) -> np.ndarray:
    """For each pair, the probability of each of its symbol's eight decisions as mixed at depth `least`."""
    sym = keys & 255
    out = np.empty((len(keys), 8))
    for j in range(8):
        node, bit = (1 << j) | (sym >> (8 - j)), (sym >> (7 - j)) & 1
        p = None if below is None else below[:, j]
        for d in range(upto if upto is not None else depth, least - 1, -1):
            p = tree[d - least].mix(((keys >> (8 * (depth + 1 - d))) << 8) | node, bit, p)
        out[:, j] = p
    return out


class Root:
    """Depths 0 and 1, from the sums over all shards."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        one = Level.__new__(Level)
        one.node, one.n0, one.n1 = node, n0, n1
        own = kt_log(n0, n1)
        one.log_w = np.logaddexp(own, below) - np.log(2.0)
        one.stop = np.exp(own - np.log(2.0) - one.log_w)
        top = np.unique(node & 255)
        at = np.searchsorted(top, node & 255)
        zero = Level(top, np.bincount(at, n0, len(top)), np.bincount(at, n1, len(top)), (node & 255, one.log_w))
        self.tree = [zero, one]

    def code_bits(self, keys: np.ndarray, subtree: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Bits that each pair's symbol costs in its context."""
        p = bit_probabilities(keys, self.tree, 0, depth, subtree, 1)
        return -np.log2(p).sum(axis=1)


A_SCHEMA = "kind string, shard int, block int, keys binary, counts binary"
M_SCHEMA = "kind string, shard int, keys binary, counts binary, bits binary, total long, entries long, node array<long>, n0 array<double>, n1 array<double>, below array<double>"
R_SCHEMA = "block int, kind string, keys binary, bits binary"
OUT_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long, bits_per_byte double"


def shard_table(n_shards: int) -> np.ndarray:
    """Shard of each pair of nearest context bytes."""
    return (mix64(np.arange(65536, dtype=np.uint64) + np.uint64(1)) % np.uint64(n_shards)).astype(np.int64)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SUB_BYTES, side="right")) - 1)
        yield at, end
        at = end


def gather_block(batches: Iterator[pa.RecordBatch], n_shards: int, depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """What a block sends: pairs and words with their training counts, those of held-out rows only with 0. Its rows are read as a stream; what
    is held are its distinct pairs and words."""
    pairs, counts, words, asked, ends, block, loose = [], [], Counter(), set(), 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block")[0].as_py()
        raw, offsets = utf8(batch.column("text"))
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in _slices(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sym, first, stop = symbols(part, at, depth)
            key = pair_keys(sym, first, stop, depth)
            training = np.repeat(~held[a:b], stop - first)
            for k, weight in ((key[training], 1), (key[~training], 0)):
                distinct, n = counted(k)
                pairs.append(distinct)
                counts.append(n * weight)
                loose += len(distinct)
            if loose > 8_000_000 + 2 * len(pairs[0]):
                pairs, counts = ([x] for x in counted(np.concatenate(pairs), np.concatenate(counts)))
                loose = 0
            lowered = lower_ascii(part).tobytes()
            ends += int((~held[a:b]).sum())
            for i in range(b - a):
                (asked.update if held[a + i] else words.update)(lowered[at[i] : at[i + 1]].split())
    if block is None:
        return
    key, n = counted(np.concatenate(pairs), np.concatenate(counts))
    rows: list[tuple] = []
    shard = shard_table(n_shards)[key >> (8 * (depth - 1))]
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(n_shards + 1))
    for s in range(n_shards):
        if at[s + 1] > at[s]:
            own = order[at[s] : at[s + 1]]
            rows.append(("pairs", s, block, pack(key[own]), pack(n[own])))
    words[b""] = ends
    dealt: list[list[bytes]] = [[] for _ in range(n_shards)]
    for w in words.keys() | asked:
        dealt[_word_shard(w, n_shards)].append(w)
    for s, own in enumerate(dealt):
        if own:
            own.sort()
            rows.append(("words", s, block, zstandard.compress(b" ".join(own), 1), pack(np.array([words[w] for w in own], np.int64))))
    types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "shard", "block", "keys", "counts"])


def _word_shard(word: bytes, n_shards: int) -> int:
    import zlib

    return zlib.crc32(word) % n_shards


def _words(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split(b" ")  # the end token is the empty word, so splitting is exact


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, object]]:
    """Rows come ordered by kind, shard and part. For each of these the sums of its runs, as they come: a Counter of words, or keys and counts."""
    now, state, loose = None, None, 0
    for batch in batches:
        for kind, shard, part, keys, counts in zip(*(batch.column(c) for c in ("kind", "shard", "part", "keys", "counts")), strict=True):
            here = kind.as_py(), shard.as_py(), part.as_py()
            if here != now:
                if now:
                    yield now[0], now[1], state if now[0] == "words" else counted(np.concatenate(state[0]), np.concatenate(state[1]))
                now, state, loose = here, Counter() if here[0] == "words" else [[], []], 0
            n = unpack(counts.as_py())
            if here[0] == "words":
                for w, c in zip(_words(keys.as_py()), n.tolist(), strict=True):
                    state[w] += c
            else:
                state[0].append(unpack(keys.as_py()))
                state[1].append(n)
                loose += len(n)
                if loose > 4_000_000 + 2 * len(state[0][0]):
                    state = [[x] for x in counted(np.concatenate(state[0]), np.concatenate(state[1]))]
                    loose = 0
    if now:
        yield now[0], now[1], state if now[0] == "words" else counted(np.concatenate(state[0]), np.concatenate(state[1]))


def add_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run for each part."""
    for kind, shard, state in merged(batches):
        if kind == "words":
            words = sorted(state)
            keys, counts = zstandard.compress(b" ".join(words), 1), pack(np.array([state[w] for w in words], np.int64))
        else:
            keys, counts = map(pack, state)
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([shard], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], ["kind", "shard", "keys", "counts"])


def build_shards(batches: Iterator[pa.RecordBatch], depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """Each shard's part of the model."""
    names = [c.split()[0] for c in M_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
    for kind, shard, state in merged(batches):
        if kind == "words":
            words = sorted(state)
            n = np.array([state[w] for w in words], np.int64)
            row = (kind, shard, zstandard.compress(b" ".join(words), 1), pack(n), None, int(n.sum()), int((n > 0).sum()), [], [], [], [])
        else:
            key, n = state
            tree = levels(key, n, 2, depth)
            bits = bit_probabilities(key, tree, 2, depth).astype("<f4")
            context, sym = key >> (8 * depth), key & 255
            pair, total = counted((context << 8) | sym, n)
            node, n0, n1 = decisions(pair >> 8, pair & 255, total)
            seen = n0 + n1 > 0
            node, n0, n1 = node[seen], n0[seen], n1[seen]
            below = np.bincount(np.searchsorted(node, ((tree[0].node >> 16) << 8) | (tree[0].node & 255)), tree[0].log_w, len(node)) if len(node) else np.zeros(0)
            row = (kind, shard, pack(key), None, zstandard.compress(np.ascontiguousarray(bits).tobytes(), 1), int(n.sum()), len(key), node.tolist(), n0.tolist(), n1.tolist(), below.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)


def answer(batches: Iterator[pa.RecordBatch], root: Root, depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by kind, shard and group of blocks, the model's part before the blocks' requests; each request is answered alone."""
    model, keys, values = None, None, None
    for batch in batches:
        for kind, shard, block, k, n, bits in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "block", "keys", "counts", "bits")), strict=True):
            if block is None:
                model = kind, shard
                if kind == "words":
                    values = dict(zip(_words(k), unpack(n).tolist(), strict=True))
                else:
                    keys = unpack(k)
                    values = root.code_bits(keys, np.frombuffer(zstandard.decompress(bits), "<f4").reshape(-1, 8).astype(float), depth)
                continue
            assert model == (kind, shard)
            said = pack(np.array([values[w] for w in _words(k)], np.int64)) if kind == "words" else values[np.searchsorted(keys, unpack(k))].astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.string()), pa.array([k], pa.binary()), pa.array([said], pa.binary())], ["block", "kind", "keys", "bits"])


class Answers:
    """What the model's parts said to a block: words' counts, and the bits of each pair."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.count: dict[bytes, int] = {}
        keys, cost = [np.zeros(0, _KEY)], [np.zeros(0, np.float32)]
        for batch in batches:
            for kind, k, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "bits")), strict=True):
                if kind == "words":
                    self.count.update(zip(_words(k), unpack(b).tolist(), strict=True))
                else:
                    keys.append(unpack(k))
                    cost.append(np.frombuffer(b, "<f4"))
        key, value = np.concatenate(keys), np.concatenate(cost)
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(float)

    def score(self, docs: pa.RecordBatch, total: int, distinct: int, depth: int = DEPTH) -> pa.RecordBatch:
        raw, offsets = utf8(docs.column("text"))
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        scale, count = np.log10(total + 0.1 * (distinct + 1)), self.count
        end = count.get(b"", 0)
        for a, b in _slices(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sym, first, stop = symbols(part, at, depth)
            code, found = pd.factorize(pair_keys(sym, first, stop, depth))
            each = self.value[np.searchsorted(self.key, found)][code]
            size = stop - first
            bits = np.add.reduceat(each, np.cumsum(size) - size)
            n_words = np.bincount(word_spans(part, at)[2], minlength=b - a)
            lowered = lower_ascii(part).tobytes()
            n = np.fromiter((count[w] for i in range(b - a) for w in lowered[at[i] : at[i + 1]].split()), np.int64, int(n_words.sum()))
            row = np.repeat(np.arange(b - a), n_words)
            cols[0].append(n_words + 1)
            cols[1].append(np.bincount(row[n > 0], minlength=b - a) + (end > 0))
            cols[2].append(np.bincount(row, np.log10(n + 0.1), b - a) + np.log10(end + 0.1) - (n_words + 1) * scale)
            cols[3].append(-bits * np.log10(2.0))
            cols[4].append(size)
            cols[5].append(np.maximum(np.diff(at), 1))
        n_tokens, n_known, base, score, size, n_bytes = (np.concatenate(c) if c else np.zeros(0) for c in cols)
        out = (
            docs.column("doc_id"), docs.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(size), total), pa.int64()),
            pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(size, pa.int64()), pa.array(-score / np.log10(2.0) / n_bytes, pa.float64()),
        )
        return pa.RecordBatch.from_arrays(list(out), [c.split()[0] for c in OUT_SCHEMA.split(", ")])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def score_documents(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    spark = docs.sparkSession
    blocks = parts_for(total_bytes(docs), block_bytes)
    shards = max(8, min(blocks, MAX_SHARDS))
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"), held_out().alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    folder = stage_folder(spark)

    rows.repartitionById(blocks, F.col("block")).mapInArrow(lambda b: gather_block(b, shards, depth), A_SCHEMA).write.parquet(f"{folder}/gathered")
    gathered = spark.read.parquet(f"{folder}/gathered")
    # Runs of some blocks are added up before a shard's sums meet in one task: their distinct keys grow far more slowly than the text.
    part = F.floor(F.col("block") / F.lit(group_blocks)).cast("int").alias("part")
    some = gathered.select("kind", "shard", part, "keys", "counts").repartition(parts, "kind", "shard", "part").sortWithinPartitions("kind", "shard", "part").mapInArrow(add_runs, "kind string, shard int, keys binary, counts binary")
    some.withColumn("part", F.lit(0)).repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(lambda b: build_shards(b, depth), M_SCHEMA).write.parquet(f"{folder}/model")
    model = spark.read.parquet(f"{folder}/model")
    sums = model.agg(F.sum(F.when(F.col("kind") == "words", F.col("total"))).alias("n"), F.sum(F.when(F.col("kind") == "words", F.col("entries"))).alias("v"), F.sum(F.octet_length("keys") + F.coalesce(F.octet_length("bits"), F.lit(0))).alias("b")).first()
    total, distinct, model_bytes = sums["n"] or 0, sums["v"] or 0, sums["b"] or 0
    asked_bytes = gathered.agg(F.sum(F.octet_length("keys")).alias("b")).first()["b"] or 0
    top = model.where("kind = 'pairs'").select(F.explode(F.arrays_zip("node", "n0", "n1", "below")).alias("x")).groupBy("x.node").agg(F.sum("x.n0").alias("n0"), F.sum("x.n1").alias("n1"), F.sum("x.below").alias("below")).orderBy("node").toPandas()  # 65,280 rows at most
    root = Root(top["node"].to_numpy(np.int64), *(top[c].to_numpy(float) for c in ("n0", "n1", "below")))
    # A task answers so many blocks that they ask for about as much as the model's part holds: neither outgrows the other.
    group = max(group_blocks, int(blocks * model_bytes / max(1, asked_bytes)))
    copies = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // group))).alias("g")
    asked = model.select("kind", "shard", copies, F.lit(None).cast("int").alias("block"), "keys", "counts", "bits").union(gathered.select("kind", "shard", F.floor(F.col("block") / F.lit(group)).cast("int"), "block", "keys", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    answers = asked.repartition(parts, "kind", "shard", "g").sortWithinPartitions("kind", "shard", "g", F.col("block").asc_nulls_first()).mapInArrow(lambda b: answer(b, root, depth), R_SCHEMA)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = rows.select("block", "doc_id", "text", "held_out", none("string", "kind"), none("binary", "keys"), none("binary", "bits")).union(answers.select("block", none("long", "doc_id"), none("string", "text"), none("boolean", "held_out"), "kind", "keys", "bits"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's answers come first, then its rows as a stream."""
        said, answers = [], None
        for batch in batches:
            first = batch.num_rows - batch.column("kind").null_count
            if first:
                said.append(batch.slice(0, first))
            if first < batch.num_rows:
                if answers is None:
                    answers, said = Answers(said), []
                yield answers.score(batch.slice(first), total, distinct, depth)

    return both.repartitionById(blocks, F.col("block")).sortWithinPartitions(F.col("kind").asc_nulls_last()).mapInArrow(score, OUT_SCHEMA)


def op1_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
