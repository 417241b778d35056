"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

Instead of replaying merges, the encoder walks over the text with the longest vocabulary match at each place,
found by one Aho-Corasick pass of an automaton of all pieces. A token may follow another only if merging
the bytes of both from scratch would give just these two tokens; where no token may follow, the walk goes back one
token and tries its next longest prefix. A bitfield of the places from which no valid rest was found keeps the
walk linear. What comes out is the one sequence that the merges themselves would give.

Texts fall into units that start at a word mark, which no merge crosses, so equal units are encoded once for each
worker and kept in a table; between two texts it is emptied if its units, or their characters, are too many.

Nulls count as empty texts, which have no tokens. Texts are read whole, however long; rows with equal ids are encoded one by
one; a null doc_id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MARK = "▁"
#: Runs of marks that start a word, with the word; the model's pieces cross no other place between units.
_UNIT = re.compile(f"{MARK}*[^{MARK}]*")
CACHE_UNITS, CACHE_CHARS, CACHE_PAIRS = 500_000, 32 << 20, 500_000
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class MergeModel:
    """The pieces of a model, which pairs of them merge, and the walk."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.dummy_prefix = dummy_prefix
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.unknown = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        self.score = [s for _, s, _ in pieces]
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.rank = {p: (-self.score[i]) for p, i in self.id.items()}
        self.matches = ahocorasick.Automaton()
        for p in self.id:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.letters = {p for p in self.id if len(p) == 1}
        self.made: dict[str, bool] = {}
        self.units: dict[str, str] = {}
        self.chars = 0
        self.odd: dict[str, str] = {}

    @classmethod
    def load(cls, path: str) -> MergeModel:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a merge-type model that keeps characters and white space is needed")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], spec.add_dummy_prefix)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by replaying merges: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def can_follow(self, left: str, right: str) -> bool:
        """Whether re-merging the text of two adjacent tokens gives the same two tokens."""
        known = self.follows.get(left, {}).get(right)
        if known is None:
            if self.pairs >= CACHE_PAIRS:
                self.follows.clear()
                self.pairs = 0
            known = self.follows.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
            self.pairs += 1
        return known

    def makes(self, token: str) -> bool:
        """Whether a token's own text merges to that token; no other piece is ever a token."""
        known = self.made.get(token)
        if known is None:
            known = self.made[token] = self.merged(token) == [token]
        return known

    def next_shorter(self, piece: str) -> str | None:
        """The longest proper prefix that is a piece."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.id), None)
        return self.shorter[piece]

    def longest_at(self, text: str) -> list[int]:
        """Length of the longest piece that starts at each place (0: none), from one pass of the automaton."""
        longest = [0] * len(text)
        for end, n in self.matches.iter(text):  # ends rise, so the last match from a place is its longest
            longest[end - n + 1] = n
        return longest

    def walk(self, text: str) -> list[str]:
        """The tokens of a text all of whose characters are pieces."""
        end, failed = len(text), bytearray((len(text) >> 3) + 1)
        longest, made, follows = self.longest_at(text), self.made, self.follows
        tokens: list[str] = []
        at, last = 0, None
        token = text[: longest[0]] if end else None
        while token is not None:
            while True:
                after = at + len(token)
                fits = False
                if not failed[after >> 3] >> (after & 7) & 1:
                    fits = made.get(token)
                    if fits is None:
                        fits = self.makes(token)
                    if fits and last is not None:
                        row = follows.get(last)
                        fits = None if row is None else row.get(token)
                        if fits is None:
                            fits = self.can_follow(last, token)
                if fits:
                    tokens.append(token)
                    at, last = after, token
                    token = text[at : at + longest[at]] if at < end else None
                    break
                token = self.next_shorter(token)
                if token is None:
                    failed[at >> 3] |= 1 << (at & 7)
                    if not tokens:
                        raise ValueError("the vocabulary lacks single characters of its pieces")
                    token = tokens.pop()
                    at -= len(token)
                    last = tokens[-1] if tokens else None
        return tokens

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit. A character that is no piece stands alone as its bytes: no merge reaches over it."""
        if self.letters.issuperset(unit):
            return [self.id[t] for t in self.walk(unit)]
        out: list[int] = []
        known = ""
        for c in [*unit, ""]:
            if c in self.id and c:
                known += c
                continue
            out += [self.id[t] for t in self.walk(known)]
            known = ""
            if c:
                raw = c.encode()
                out += [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encoded(text)[0].split(",") if x]

    def learn(self, unit: str) -> str:
        """Encodes a unit that is not in the table. Units that decode to other text than their own are noted apart."""
        ids = self.encode_unit(unit)
        # Pieces alone spell the unit; bytes may read otherwise.
        if not self.letters.issuperset(unit) and (shown := self.surface(ids)) != unit.replace(MARK, " "):
            self.odd[unit] = shown
        joined = self.units[unit] = ",".join(map(str, ids))
        self.chars += len(unit) + len(joined)
        return joined

    def encoded(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, how many they are, and the text that they decode to."""
        if not text:
            return "", 0, ""
        if len(self.units) >= CACHE_UNITS or self.chars >= CACHE_CHARS:
            self.units.clear()
            self.odd.clear()
            self.chars = 0
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        plain = self.dummy_prefix and marked[-1] != MARK and MARK + MARK not in marked
        found = [MARK + w for w in marked[1:].split(MARK)] if plain else [u for u in _UNIT.findall(marked) if u]
        get = self.units.get
        got = [get(u) for u in found]
        if None in got:
            got = [get(u) or self.learn(u) for u in found]
        joined = ",".join(got)
        if self.odd and not self.odd.keys().isdisjoint(found):
            shown = "".join([self.surface([int(x) for x in g.split(",")]) for g in got])
        else:
            shown = marked.replace(MARK, " ")
        return joined, joined.count(",") + 1, shown[1:] if self.dummy_prefix and shown[:1] == " " else shown

    def surface(self, ids: list[int]) -> str:
        """Text of ids before the first mark is taken off; runs of byte pieces are read as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                raw.append(int(self.text[i][3:5], 16))
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[i] != CONTROL:
                out.append(self.text[i].replace(MARK, " "))
        return "".join(out) + (_utf8(raw) if raw else "")

    def decode(self, ids: list[int]) -> str:
        shown = self.surface(ids)
        return shown[1:] if self.dummy_prefix and shown[:1] == " " else shown


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that starts no valid character gives one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, MergeModel] = {}


def model_at(path: str) -> MergeModel:
    """The model of a worker, read once; its table of units lives as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = MergeModel.load(path)
    return _LOADED[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            counts, ids, shown = [], [], []
            for text in batch.column("text"):
                joined, n, decoded = model.encoded(text.as_py() or "")
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                shown.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
