"""Packing by lexical retrieval.

Documents are encoded once, and the tokens' document frequencies are summed over all of them; that table is as long as the
vocabulary. The vocabulary has one random order, drawn with weights that favour its rarer tokens, and
a document goes to the shard of its first token in it, so that two texts meet with the chance of their weighted similarity, wherever they come from; whatever shares so much that it outgrows a shard is split
by the next token, then by hash. A shard has a BM25 inverted index over its documents, with frequencies and
mean length of the whole corpus. The document that opens a window is the seed: all its tokens are looked up, frequent ones too, and the unused documents that
score best fill the window in turn, ties by order in the shard. Bounds on all scores tell which documents are to be scored in full. What does not fit is cut and opens the next window. Only the last
window of a shard is not full. Shards and their order follow from the rows alone: a table is packed alike each time.

Nulls count as empty texts, which still have their end id. Every id lies in exactly one piece. Texts are taken whole: a long one fills
several windows. Equal rows are packed one by one. A null doc_id is kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.common import give_back, mix64, parts_for, text_col, total_bytes
from linkloom.llm.licenses import pieces
from linkloom.llm.spark_util import cut

WINDOW, END_ID = 2048, 1
#: Tokens of a shard, on average, and of a group of documents that must not be split.
SHARD_TOKENS, GROUP_TOKENS = 8 << 20, 2 << 20
#: Shards that a task packs, and bytes of text that a task encodes at least, so that files are not small.
SHARDS_A_TASK, TASK_BYTES = 3, 48 << 20
#: Tokens that more documents than these hold, and more than one in STOP_SHARE, are no telling ones. They count in the scores that fill windows.
STOP_SHARE, STOP_LEAST = 16, 8
K1, B = 1.2, 0.75
#: Lists are rows of numbers if they hold one document in DENSE_SHARE at least, the longest first, up to DENSE_BYTES.
DENSE_SHARE, DENSE_BYTES = 40, 32 << 20
#: Rows of so many documents are added one by one.
LONG_ROWS = 4096
#: Columns of an index are worked out so many numbers at a time: a worker has little memory beside its shard.
BLOCK, ROWS_A_COPY = 1 << 18, 512
#: Tokens with lower ids are too frequent to say where a document belongs.
KEY_FLOOR = 2000
#: A worker forgets its units when it has more of them, or more of their characters.
CACHE_UNITS, CACHE_CHARS = 500_000, 16 << 20
#: Rows of a table that is small enough to be sent to all executors.
SMALL_ROWS = 100_000
_DOUBLE = re.compile(r"\s\s")
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: For RE2: white space at an end or beside other white space, or an empty text.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_ODD = rf"\A{_SPACE}|{_SPACE}{_SPACE}|{_SPACE}\z|\A\z"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Units(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: object) -> int:
        n = self[key] = len(self)
        return n


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    return np.arange(lens.sum()) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of so many values each."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


def blocks(n: int) -> Iterator[slice]:
    return (slice(a, min(n, a + BLOCK)) for a in range(0, n, BLOCK))


def counts_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """How often each number below n occurs."""
    return sum((np.bincount(numbers[s], minlength=n) for s in blocks(len(numbers))), np.zeros(n, np.int64))


class UnitEncoder:
    """Ids of a byte-level vocabulary, a batch of texts at a time. A single space between two other characters always starts a new
    pre-token, so the units between such spaces are encoded apart, and equal ones once for each worker. The vocabulary
    is that of the given `tokenizers` file; its ranks run in tiktoken, which gives the same ids in a fraction of the time. Added
    tokens that stand in a text part it, and have their own ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        tokens = Tokenizer.from_file(path).get_added_tokens_decoder()
        if odd := [t.content for t in tokens.values() if t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"added tokens that take white space or whole words: {odd}")
        self.added = {t.content: i for i, t in tokens.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if tokens else lambda text: [text]
        shown = _byte_letters()
        ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if i not in tokens}
        self.size = 1 + max([*ranks.values(), *tokens, END_ID])
        encoding = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenize, self.tokenize_array = encoding.encode_ordinary, encoding.encode_to_numpy
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.units, self.chars = Units(), 0
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _keys(self, text: str, out: list[int]) -> None:
        """A word stands for itself after a space, (start,) for the start of a part, (None, token) for an added token."""
        units = self.units
        parts = self.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                out.append(units[None, part])
            elif part or len(parts) == 1:
                start, *words = part.split(" ") if _DOUBLE.search(part) is None else _BORDER.split(part)
                out.append(units[start,])
                out += map(units.__getitem__, words)

    def _learn(self, new: list) -> None:
        """Encodes new units: words without white space at their ends in one go, cut where their bytes end; others one by one."""
        self.chars += sum(len(k if type(k) is str else k[-1]) for k in new)
        plain = [type(k) is str and k != "" and not k[0].isspace() and not k[-1].isspace() for k in new]
        words = [k for k, p in zip(new, plain, strict=True) if p]
        joined = np.array(self.tokenize(" " + " ".join(words)), np.uint32) if words else np.zeros(0, np.uint32)
        stops = np.searchsorted(np.cumsum(self.n_bytes[joined]), np.cumsum([1 + len(w.encode()) for w in words]), "left") + 1 if words else np.zeros(0, np.int64)
        lens, out, at, n = [], [], 0, 0
        word = iter(stops.tolist())
        for k, p in zip(new, plain, strict=True):
            if p:
                stop = next(word)
                lens.append(stop - n)
                n = stop
            else:
                own = [self.added[k[1]]] if type(k) is tuple and k[0] is None else self.tokenize(k[0] if type(k) is tuple else " " + k)
                out += [joined[at:n], np.array(own, np.uint32)]
                at = n
                lens.append(len(own))
        self.ids = np.concatenate([self.ids, *out, joined[at:]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens, dtype=np.int64)])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(self.units) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.forget()
        known, keys, counts = len(self.units), [], []
        for text in texts:
            before = len(keys)
            self._keys(text, keys)
            counts.append(len(keys) - before)
        if len(self.units) > known:
            self._learn(list(islice(self.units, known, None)))
        at = np.array(keys, np.int64)
        lens = self.ends[at + 1] - self.ends[at]
        return self.ids[spread(self.ends[at], lens)], sums_of(lens, np.array(counts, np.int64))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode_batch(), for a column without nulls. Texts without white space at an end or beside other white space, which hold no added token, don't become objects
        of Python: their words are told apart and encoded once for each call."""
        odd = pa.compute.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        for content in self.added:
            odd = odd | pa.compute.match_substring(column, content).to_numpy(zero_copy_only=False)
        if odd.all():
            return self.encode_batch(column.to_pylist())
        if not odd.any():
            return self._encode_words(column)
        some, n_some = self._encode_words(column.filter(pa.array(~odd)))
        others, n_others = self.encode_batch(column.filter(pa.array(odd)).to_pylist())
        lens = np.zeros(len(odd), np.int64)
        lens[~odd], lens[odd] = n_some, n_others
        out, at, ends = np.empty(len(some) + len(others), np.uint32), [0, 0], np.cumsum(lens).tolist()
        for kind, n, end in zip(odd.tolist(), lens.tolist(), ends, strict=True):
            out[end - n : end] = (others if kind else some)[at[kind] : at[kind] + n]
            at[kind] += n
        return out, lens

    def _encode_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.compute.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()
        words, at, counts = coded.dictionary, coded.indices.to_numpy().copy(), pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        del lists, coded
        n_bytes = pa.compute.binary_length(words).to_numpy().astype(np.int64)
        joined = self.tokenize_array(" " + pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py())
        ends = np.searchsorted(np.cumsum(self.n_bytes[joined]), np.cumsum(1 + n_bytes), "left") + 1
        # The first word of a text has no space before it.
        first = np.cumsum(counts) - counts
        heads, which = np.unique(at[first], return_inverse=True)
        own = [self.tokenize(w) for w in words.take(pa.array(heads)).to_pylist()]
        at[first] = len(words) + which
        ids = np.concatenate([joined, *(np.array(x, np.uint32) for x in own)])
        ends = np.concatenate([[0], ends, len(joined) + np.cumsum([len(x) for x in own], dtype=np.int64)])
        lens = np.diff(ends).astype(np.int32)
        parts = [ids[spread(ends[at[s]], lens[at[s]])] for s in blocks(len(at))]
        return np.concatenate([ids[:0], *parts]), sums_of(lens[at], counts)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies show bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def held_tokens(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, document and count of each distinct pair, by token, then document."""
    # Both in one number, as plain sorts are far cheaper than sorts of places.
    bits, kind = (16, np.uint32) if ids.itemsize <= 2 and len(lens) <= 1 << 16 else (32, np.uint64)
    pairs, ends = ids.astype(kind), np.cumsum(lens)
    pairs <<= kind(bits)
    for s in blocks(len(pairs)):
        pairs[s] |= np.searchsorted(ends, np.arange(s.start, s.stop), "right").astype(kind)
    pairs.sort()
    new = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
    first = np.flatnonzero(new)
    count = np.empty(len(first), np.int32)
    np.subtract(first[1:], first[:-1], out=count[:-1], casting="unsafe")
    count[-1:] = len(pairs) - first[-1:]
    del first
    pairs = pairs[new]
    return (pairs >> kind(bits)).astype(ids.dtype), (pairs & kind((1 << bits) - 1)).astype(np.int32), count


def by_number(numbers: np.ndarray, n: int) -> np.ndarray:
    """Places in the order of numbers below n, equal ones as they come; few bits are sorted by counting."""
    return np.argsort(numbers.astype(np.uint16) if n <= 1 << 16 else numbers, kind="stable")


def with_ends(values: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    """The values with `end` behind those of each document."""
    out = np.full(len(values) + len(lens), end, values.dtype)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lens + 1) - 1] = False
    out[inner] = values
    return out


class Corpus:
    """What BM25 takes from the whole corpus: documents that hold each token, documents, and tokens in all."""

    def __init__(self, df: np.ndarray, n_docs: int, n_tokens: int):
        self.n_docs, self.mean = n_docs, max(1.0, n_tokens / max(1, n_docs))
        telling = (df > 1) & (df <= n_docs / STOP_SHARE + STOP_LEAST)
        self.whole = np.where(df > 1, np.log1p((n_docs - df + 0.5) / (df + 0.5)), 0.0)
        self.idf = np.where(telling, self.whole, 0.0)


@lru_cache(4)
def key_ranks(size: int) -> np.ndarray:
    """A fixed random order of the vocabulary, in which a token comes early with a weight that grows with its id: vocabularies list merges as they
    were learnt, the frequent ones first. The first KEY_FLOOR tokens are no keys; their rank is the vocabulary's size. Drawn as exponential times, so that two
    documents have the same first token with the chance of their similarity: the weights that they share over those of either."""
    weight = np.log(np.maximum(np.arange(size), 1) / KEY_FLOOR)
    draw = (mix64(np.arange(size, dtype=np.uint64) + np.uint64(0x51ED2701)) >> np.uint64(11)).astype(float) * 2.0**-53
    order = np.argsort(np.where(weight > 0, -np.log(draw + 2.0**-54) / np.maximum(weight, 1e-9), np.inf), kind="stable")
    order = order[weight[order] > 0]
    out = np.full(size, size, np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def first_keys(ids: np.ndarray, lens: np.ndarray, ranks: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """The n least ranks of each document's tokens; the vocabulary's size where there are fewer."""
    none = len(ranks)
    # With an end behind each document, which keeps documents without ids apart.
    rank = with_ends(ranks[ids], lens, none)
    starts = np.cumsum(lens + 1) - (lens + 1)
    out: list[np.ndarray] = []
    for _ in range(n):
        out.append(np.minimum.reduceat(rank, starts) if len(lens) else np.zeros(0, np.int32))
        rank[rank == np.repeat(out[-1], lens + 1)] = none
    return out


class Lists:
    """The documents that hold each token, with its weight in them, in arrays; rows come by token, then document."""

    def __init__(self, token: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int):
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]]))
        self.doc, self.weight, self.n = doc, weight, n
        self.starts = np.concatenate([starts, [len(token)]])
        # The lists that each document is in, as its query.
        lists = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(self.starts))
        order = by_number(doc, n)
        self.lists, self.query = lists[order], np.searchsorted(doc[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        return self.sums(self.lists[self.query[seed] : self.query[seed + 1]])

    def sums(self, lists: np.ndarray) -> np.ndarray:
        """The weights of these lists, added for each document."""
        spans = [slice(a, b) for a, b in zip(self.starts[lists].tolist(), self.starts[lists + 1].tolist(), strict=True)]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


class Bounds:
    """Scores of the unused documents, at most some slack too low. A long list is a row of 16-bit numbers, a place for each document, with weights rounded
    down to multiples of the document's unit, so that a seed's rows are added many documents at a time; no sum overflows, as all rows of a document have room in 16 bits.
    Short lists have their weights as they are. Columns of documents that were used go from time to time."""

    def __init__(self, lists: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int):
        count = counts_of(lists, int(lists.max(initial=-1)) + 1)
        long = np.argsort(-count, kind="stable")[: max(1, DENSE_BYTES // (2 * max(1, n)))]
        long = long[count[long] * DENSE_SHARE >= n]
        self.row, self.n, self.docs = np.full(len(count), -1, np.int32), n, np.arange(n)
        self.row[long] = np.arange(len(long))
        short, total = (self.row < 0)[lists], np.zeros(n)
        for s in blocks(len(doc)):
            total += np.bincount(doc[s], np.where(short[s], 0.0, weight[s]), n)
        self.unit = np.maximum(total, 1e-9) * ((1 + 1e-9) / 65535)
        self.dense = np.zeros((len(long), n), np.uint16)
        for s in blocks(len(doc)):
            some = ~short[s]
            at = doc[s][some]
            self.dense[self.row[lists[s][some]], at] = weight[s][some] / self.unit[at]
        self.starts = np.concatenate([[0], np.cumsum(np.where(self.row < 0, count, 0))])
        self.doc, self.weight = doc[short], weight[short]

    def drop(self, unused: np.ndarray) -> None:
        """Leaves out the documents that were used."""
        kept = unused[self.docs]
        self.dense, self.docs, self.unit = np.compress(kept, self.dense, 1), self.docs[kept], self.unit[kept]
        place, some = np.cumsum(kept, dtype=np.int32) - 1, kept[self.doc]
        self.starts = np.concatenate([[0], np.cumsum(some)])[self.starts]
        self.doc, self.weight, self.n = place[self.doc[some]], self.weight[some], len(self.docs)

    def scores(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of `docs` the weights of these lists, rounded down, and the slack."""
        rows = self.row[lists]
        long, short = rows[rows >= 0], lists[rows < 0]
        if self.n < LONG_ROWS:
            out = np.add.reduce(self.dense.take(long, 0), 0, np.uint16)
        else:  # a copy of the rows would not stay in the processor's cache
            out = np.zeros(self.n, np.uint16)
            for row in long.tolist():
                np.add(out, self.dense[row], out)
        out = out * self.unit
        if len(short):
            out += Lists.sums(self, short)
        return out, self.unit * len(long)


class Bm25Index:
    """Inverted index over the documents of a shard: the tokens that two of them hold at least. Windows are filled by all of these; the telling
    ones alone give a cheaper score."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, corpus: Corpus):
        token, doc, tf = held_tokens(ids, lens)
        here = np.where(corpus.whole > 0, counts_of(token, len(corpus.whole)), 0)
        shared = (here > 1)[token]
        # One after another, as old and new columns would stand beside each other.
        token = token[shared]
        doc = doc[shared]
        tf = tf[shared]
        weight = np.empty(len(token))
        for s in blocks(len(token)):
            weight[s] = corpus.whole[token[s]] * tf[s] * (K1 + 1) / (tf[s] + K1 * (1 - B + B * lens[doc[s]] / corpus.mean))
        number = np.cumsum(here > 1, dtype=np.int32) - 1  # of a token's list
        lists = number[token]
        del token, tf, shared
        self.n, self.corpus, self.tokens = len(lens), corpus, np.flatnonzero(here > 1)
        self.bounds = Bounds(lists, doc, weight, self.n)
        # The lists that each document is in, as its query, with its weights.
        self.query = np.concatenate([[0], np.cumsum(counts_of(doc, self.n))])
        self.lists, self.weight, following = np.empty_like(lists), np.empty_like(weight), self.query[:-1].copy()
        for s in blocks(len(doc)):
            order, count = by_number(doc[s], self.n), np.bincount(doc[s], minlength=self.n)
            at = np.arange(len(order)) + np.repeat(following - (np.cumsum(count) - count), count)
            self.lists[at], self.weight[at] = lists[s][order], weight[s][order]
            following += count
        self.asked = np.zeros(len(self.tokens), bool)

    @cached_property
    def telling(self) -> Lists:
        order = np.argsort(self.lists, kind="stable")
        token, doc = self.tokens[self.lists[order]], np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.query))[order]
        some = (self.corpus.idf > 0)[token]
        return Lists(token[some], doc[some], self.weight[order][some], self.n)

    def scores(self, seed: int) -> np.ndarray:
        return self.telling.scores(seed)

    def neighbours(self, seed: int, unused: np.ndarray, some: int = 64) -> Iterator[int]:
        """Unused documents that share a telling token with the seed, best first; ties by place."""
        score = np.where(unused, self.scores(seed), 0.0)
        found = np.flatnonzero(score)
        least = np.partition(score[found], -some)[-some] if len(found) > some else 0.0
        for part in (found[score[found] >= least], found[score[found] < least]):
            yield from part[np.lexsort((part, -score[part]))].tolist()

    def of(self, seed: int) -> np.ndarray:
        return self.lists[self.query[seed] : self.query[seed + 1]]

    def whole_scores(self, seed: int, docs: np.ndarray) -> np.ndarray:
        """The scores of some documents by all tokens, added in the order of the tokens."""
        lens = self.query[docs + 1] - self.query[docs]
        at = spread(self.query[docs], lens)
        self.asked[self.of(seed)] = True
        weight = self.weight[at] * self.asked[self.lists[at]]
        self.asked[self.of(seed)] = False
        return np.bincount(np.repeat(np.arange(len(docs)), lens), weight, len(docs))

    def nearest(self, seed: int, unused: np.ndarray, some: int = 8) -> Iterator[int]:
        """Documents that are unused now and share any token with the seed, best first; ties by place. Bounds tell which documents can be among the best
        `some`, then among eight times as many and so on to all of them; only these are scored in full."""
        if not len(lists := self.of(seed)):
            return iter(())
        if int(unused.sum()) < len(self.bounds.docs) * 0.8:
            self.bounds.drop(unused)
        low, slack = self.bounds.scores(lists)
        low[~unused[self.bounds.docs]] = -1
        return self._best_first(seed, self.bounds.docs, low, slack, some)

    def _best_first(self, seed: int, docs: np.ndarray, low: np.ndarray, slack: np.ndarray, some: int) -> Iterator[int]:
        above = np.inf
        while above > 0:
            # Whatever scores `least` or more is found, as it is no more than its slack above `low`; rounding of sums is far below 1e-6.
            least = max(0.0, np.partition(low, -some)[-some] - 1e-6) if some < len(docs) else 0.0
            found = docs[(low + slack >= least - 1e-6) & (low >= 0) if least else low >= 0]
            score = self.whole_scores(seed, found)
            new = (score >= least) & (score < above) & (score > 0)
            found, score = found[new], score[new]
            yield from found[np.lexsort((found, -score))].tolist()
            above, some = least, some * 8


class Packer:
    """Fills windows with pieces of documents, in the order it is given them."""

    def __init__(self, base: int, window: int = WINDOW):
        self.sequence, self.offset, self.window = base, 0, window

    def place(self, n: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document of n ids."""
        out, start = [], 0
        while start < n:
            take = min(n - start, self.window - self.offset)
            out.append((start, take, self.sequence, self.offset))
            start, self.offset = start + take, self.offset + take
            if self.offset == self.window:
                self.sequence, self.offset = self.sequence + 1, 0
        return out


def pack_shard(index: Bm25Index, sizes: list[int], packer: Packer) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(document, its pieces) for every document of a shard, in packing order."""
    unused = np.ones(len(sizes), bool)
    following, queue, sequence = 0, iter(()), None
    while True:
        doc = next((d for d in queue if unused[d]), None)
        if doc is None:
            while following < len(sizes) and not unused[following]:
                following += 1
            if following == len(sizes):
                return
            doc = following
        unused[doc] = False
        pieces = packer.place(sizes[doc])
        yield doc, pieces
        if packer.sequence != sequence:  # this document opened the window that is open now, or it is the first of the shard
            sequence, queue = packer.sequence, index.nearest(doc, unused)


_ENCODERS: dict[str, UnitEncoder] = {}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def encoder_of(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Frees the encoders of this process. A function that is sent to workers would bring a copy of the table with it if it named it itself, encoders of the driver included, and
    empty only that."""
    _ENCODERS.clear()
    give_back()


def encoded(docs: DataFrame, tokenizer_path: str, wide: bool) -> DataFrame:
    """doc_id, ids (without the end), their number n with it and the keys t and u of each document; and for each task one row of counts:
    documents by token, documents, tokens."""
    kind = np.dtype("<u4" if wide else "<u2")
    names = ["doc_id", "ids", "n", "t", "u", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        give_back()
        counts, ranks = np.zeros(encoder.size + 2, np.int64), key_ranks(encoder.size)
        for whole in batches:
            for batch in pieces(whole):
                ids, lens = encoder.encode_column(batch.column("text"))
                ids = ids.astype(kind)
                counts[: encoder.size] += np.bincount(held_tokens(ids, lens)[0], minlength=encoder.size)
                counts[encoder.size :] += batch.num_rows, len(ids)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]) * kind.itemsize, pa.int32())
                binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
                columns = [batch.column("doc_id"), binary, pa.array(lens + 1), *map(pa.array, first_keys(ids, lens, ranks)), pa.nulls(batch.num_rows, pa.binary())]
                del ids, offsets, binary
                yield pa.RecordBatch.from_arrays(columns, names)
                del columns
            whole = batch = None  # before the next comes
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(run, "doc_id long, ids binary, n long, t int, u int, counts binary")


def corpus_of(table: DataFrame, size: int) -> Corpus:
    """The sum of the rows of counts. Sixteen of them reach the driver, each as long as the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    rows = table.where(F.col("counts").isNotNull()).select("counts").mapInArrow(add, "counts binary").repartition(16).mapInArrow(add, "counts binary").collect()
    total = sum((np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64) for r in rows), np.zeros(size + 2, np.int64))
    return Corpus(total[:size], int(total[-2]), int(total[-1]))


def dealt(table: DataFrame, corpus: Corpus, group_tokens: int = GROUP_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int]:
    """The documents with their shard, below the number of shards. A group of documents with the same first key goes whole, one too large
    by the next key, and one that is still too large by hash."""
    rows = table.where(F.col("ids").isNotNull())
    heavy = lambda *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > group_tokens).select(*keys, F.ceil(F.col("n") / F.lit(group_tokens)).cast("long").alias(f"k{len(keys)}"))
    by_one, by_two = heavy("t"), heavy("t", "u")  # by_one has as many rows as tokens at most
    hint = F.broadcast if by_two.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else lambda df: df
    n_shards = parts_for(corpus.mean * corpus.n_docs + corpus.n_docs, shard_tokens)
    # Rows without an id may be wholly equal, so they are told apart by their place in the written table.
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    own = F.when(F.col("k2").isNotNull(), F.xxhash64("t", "u", F.pmod(F.xxhash64("doc_id", "h", "place"), F.col("k2")))).when(F.col("k1").isNotNull(), F.xxhash64("t", F.pmod(F.xxhash64("u"), F.col("k1")))).otherwise(F.xxhash64("t"))
    keyed = rows.select("doc_id", "ids", "t", "u", F.xxhash64("ids").alias("h"), place.alias("place"))
    return keyed.join(F.broadcast(by_one), "t", "left").join(hint(by_two), ["t", "u"], "left").select("doc_id", "ids", "t", "u", "h", F.pmod(own, F.lit(n_shards)).cast("int").alias("shard")), n_shards


def flat_ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and how many each row has."""
    lens = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    first, last = (np.frombuffer(column.buffers()[1], np.int32)[column.offset + k] for k in (0, len(column))) if len(column) else (0, 0)
    return (np.frombuffer(column.buffers()[2], np.uint8)[first:last].copy().view(kind) if last > first else np.zeros(0, kind)), lens


def ordered_ids(column: pa.Array, order: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column in that order of its rows, and how many each row has. Some rows at a time, as a whole column would be copied again."""
    lens = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)[order] // kind.itemsize
    ids, at = np.empty(lens.sum(), kind), 0
    for a in range(0, len(order), ROWS_A_COPY):
        part = flat_ids(column.take(pa.array(order[a : a + ROWS_A_COPY])), kind)[0]
        ids[at : at + len(part)] = part
        at += len(part)
    return ids, lens


def packer_of(corpus: Corpus, kind: np.dtype, window: int = WINDOW) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs a shard, which is all that comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()  # all texts are encoded by now
        if not (held := [b for b in batches if b.num_rows]):
            return
        whole = pa.Table.from_batches(held)
        held.clear()
        names, late = whole["doc_id"].fill_null(0).to_numpy(), whole["doc_id"].is_null().to_numpy()
        order = np.lexsort([whole["h"].to_numpy(), names, late, whole["u"].to_numpy(), whole["t"].to_numpy()])
        names, shard, column = whole["doc_id"].take(pa.array(order)).to_pylist(), whole["shard"][0].as_py(), whole["ids"]
        del whole
        column = column.combine_chunks()
        ids, lens = ordered_ids(column, order, kind)
        del column
        give_back()
        index, sizes, first = Bm25Index(ids, lens, corpus), (lens + 1).tolist(), np.cumsum([0, *lens]).tolist()
        give_back()
        cols: list[list] = [[] for _ in _NAMES]
        for d, places in pack_shard(index, sizes, Packer(shard << 40, window)):
            view = memoryview(np.append(ids[first[d] : first[d + 1]], kind.type(END_ID)).astype("<u4")).cast("B")
            for start, length, sequence, offset in places:
                for c, v in zip(cols, (names[d], start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), sizes[d], sequence, offset), strict=True):
                    c.append(v)
        del ids, index
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    size = encoder_of(tokenizer_path).size
    kind = np.dtype("<u4" if size > 1 << 16 else "<u2")
    table = cut(encoded(docs.coalesce(parts_for(total_bytes(docs), TASK_BYTES)), tokenizer_path, size > 1 << 16))
    corpus = corpus_of(table, size)
    rows, n_shards = dealt(table, corpus, group_tokens, shard_tokens)
    return rows.repartitionById(n_shards, F.col("shard")).mapInArrow(packer_of(corpus, kind, window), SCHEMA).coalesce(-(-n_shards // SHARDS_A_TASK))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer())
