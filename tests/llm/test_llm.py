"""The operators of linkloom.llm on small inputs, against brute force and for the odd cases."""

import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ctw, fingerprints, licenses, linededup, neardup, packing, quality, sentencepiece_bpe, sharding, spark_util, urls

WORDS = ["the", "of", "and", "Alpha", "beta", "gamma", "delta", "é", "señor", "zeta,", "eta.", "theta", "iota", "kappa", "to", "in"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows."""
    base = [(i, prose(i, 80) + "\n" + prose(100 + i, 30)) for i in range(30)]
    near = base[0][1].replace("Alpha", "Omega", 1)
    return [*base, (30, None), (31, ""), (32, " \n\t "), (33, prose(33, 6000)), (34, base[3][1]), (35, base[3][1]), (36, near), (37, "one two"), (None, "a text without id"), (5, base[5][1]), (38, "ｆｕｌｌ 中文 \U0001F600 " * 20), (39, "x" * 3000)]


SCHEMA = "doc_id long, text string, lang string, node long, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", 1, "x") for r in odd_rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    path = packing.tokenizer()
    import public_tokenizers

    assert ctw.score_documents(empty).count() == 0
    assert licenses.scan_documents(empty).count() == 0
    assert packing.pack_documents(empty, path).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert sharding.shard_documents(empty)[0].count() == 0
    assert sentencepiece_bpe.encode_documents(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert neardup.classes(empty).count() == 0
    assert quality.judge(empty, ["doc_id"]).count() == 0
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- 1 ---


def brute_ctw(train: list[bytes], test: list[bytes], depth: int) -> list[float]:
    """Context-tree weighting with dictionaries: the same model, one node at a time."""
    end = b"\xff"
    counts: list[Counter] = [Counter() for _ in range(depth + 1)]

    def stream(text):
        words = text.lower().split()
        return end * depth + b" ".join(words) + end

    for t in train:
        s = stream(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[d][(s[i - d : i], (1 << j) | (s[i] >> (8 - j))), s[i] >> (7 - j) & 1] += 1
    lg = math.lgamma
    nodes = [{k for k, _ in c} for c in counts]
    log_w, stop = [{} for _ in counts], [{} for _ in counts]
    for d in range(depth, -1, -1):
        below = Counter()
        if d < depth:
            for (ctx, n), v in log_w[d + 1].items():
                below[ctx[1:], n] += v
        for k in nodes[d]:
            a, b = counts[d][k, 0], counts[d][k, 1]
            own = lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
            log_w[d][k] = own if d == depth else np.logaddexp(own, below[k]) - math.log(2)
            stop[d][k] = 1.0 if d == depth else math.exp(own - math.log(2) - log_w[d][k])
    out = []
    for t in test:
        s, total = stream(t), 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                n, bit, p = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1, 0.5
                for d in range(depth, -1, -1):
                    k = (s[i - d : i], n)
                    a = (counts[d][k, bit] + 0.5) / (counts[d][k, 0] + counts[d][k, 1] + 1)
                    p = 0.5 if k not in nodes[d] else a if d == depth else stop[d][k] * a + (1 - stop[d][k]) * p
                total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("group_blocks", [1, 16])
def test_ctw_matches_brute_force(spark, group_blocks):
    rows = [(i, t) for i, t in odd_rows()[:12]] + [(30, None), (31, ""), (32, " \n")]
    got = {r.doc_id: r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2000, group_blocks=group_blocks).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = [(t or "").encode() for i, t in rows if not held(i)]
    want = brute_ctw(train, [(t or "").encode() for _, t in rows], ctw.DEPTH)
    c = Counter(w for t in train for w in [*t.lower().split(), b""])
    n, v = sum(c.values()), len(c)
    for (i, t), w in zip(rows, want, strict=True):
        words = [*(t or "").encode().lower().split(), b""]
        assert got[i].score == pytest.approx(w, rel=1e-4)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in words))
        assert got[i].bits_per_byte == pytest.approx(-got[i].score / math.log10(2) / max(1, len((t or "").encode())))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(words), sum(c[x] > 0 for x in words), n, held(i))


def test_ctw_is_a_distribution():
    """The probabilities of all next symbols in a context sum to 1."""
    text = prose(3, 200).encode()
    sym, first, stop = ctw.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    key, n = ctw.counted(ctw.pair_keys(sym, first, stop))
    tree = ctw.levels(key, n, 0)
    for context in [int(key[7]) & ~255, int(key[90]) & ~255, 0x010203040500]:
        p = ctw.bit_probabilities(np.array([context | s for s in range(256)]), tree, 0)
        assert p.prod(axis=1).sum() == pytest.approx(1)


def test_pack_round_trip():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000))
    assert (ctw.unpack(ctw.pack(a)) == a).all() and len(ctw.unpack(ctw.pack(a[:0]))) == 0


# --- 2 ---


def test_license_scan_finds_whole_and_edited_templates(spark):
    mit = licenses.TEMPLATES["mit"].split()
    edited = [w for k, w in enumerate(mit) if k % 17 != 5]
    rows = [(1, "intro words " + " ".join(edited) + " outro"), (2, prose(2, 200)), (3, "x\nReleased under the MIT License.\ny. Released under the MIT License."), (4, None), (5, ""), (6, "LICENSED under the apache license version 2 0")]
    got = [(r.doc_id, r.license) for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, "mit"), (3, "mit-notice"), (3, "mit-notice"), (6, "apache-2.0-notice")]
    span = licenses.scan_documents(spark.createDataFrame(rows[2:3], "doc_id long, text string")).orderBy("first_byte").collect()[0]
    assert rows[2][1].encode()[span.first_byte : span.end_byte] == b"Released under the MIT License" and span.coverage == 1


def brute_cover(template: list[str], words: list[str]) -> float:
    """Share of the template's words that the best local alignment with the whole text matches: no index, no band."""
    best, before = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            s, m = before[j]
            cell = max((s + 2, m + 1) if t == w else (s - 1, m), (before[j + 1][0] - 1, before[j + 1][1]), (row[j][0] - 1, row[j][1]), (0, 0), key=lambda c: c[0])
            row.append(cell)
            best = max(best, cell, key=lambda c: c[0])
        before = row
    return best[1] / len(template)


def test_licenses_found_are_those_of_a_full_alignment(spark):
    """Templates with words dropped, replaced and added, in prose: found are those that a full alignment covers."""
    r = random.Random(17)
    words = {k: re.findall("[a-z0-9]+", v.lower()) for k, v in licenses.TEMPLATES.items()}
    rows = []
    for i in range(120):
        name = r.choice([k for k in words if len(words[k]) < 130])
        rate, text = r.choice([0, 0, 0.05, 0.1, 0.15, 0.3]), []
        for w in words[name]:
            kind = r.random()
            text += [] if kind < rate / 2 else ["zzz"] if kind < rate else [w]
            if r.random() < rate / 6:
                text.append("yyy")
        rows.append((i, " ".join([*re.findall("[a-z]+", prose(i, 25).lower()), *text, *re.findall("[a-z]+", prose(500 + i, 25).lower())])))
    got = {(x.doc_id, x.license) for x in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, k) for i, t in rows for k, v in words.items() if brute_cover(v, t.split()) >= licenses.COVERAGE}
    assert len(want) > 80 and got <= want and len(want - got) <= 0.02 * len(want)
    short = [(1, "Released under MIT License"), (2, "All rights are reserved"), (3, "released under the terms of the MIT license"), (4, "rights"), (None, "all rights reserved " * 3)]
    found = Counter((x.doc_id, x.license) for x in licenses.scan_documents(spark.createDataFrame(short, "doc_id long, text string")).collect())
    assert found == {(1, "mit-notice"): 1, (2, "all-rights-reserved"): 1, (3, "mit-notice"): 1, (None, "all-rights-reserved"): 3}


def test_winnowing_meets_every_long_match():
    values = np.random.default_rng(2).integers(0, 1 << 60, 200).astype(np.uint64)
    kept = licenses.winnow(values, 3)
    assert all(any(i <= k < i + 3 for k in kept) for i in range(198))


# --- 3 ---


@pytest.mark.parametrize("shard_tokens", [2000, 1 << 20])
def test_packing_places_every_id_once(spark, docs, shard_tokens):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer())
    rows = packing.pack_documents(docs, packing.tokenizer(), shard_tokens=shard_tokens, group_tokens=shard_tokens // 3).collect()
    encoded = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in odd_rows()]
    # Pieces lie one behind another over the windows of a shard: put together, they are the documents' ids.
    found, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        shard = r.sequence_id >> 40
        pieces = open_.pop(shard, [])
        assert r.start == sum(p.length for p in pieces) and all(p.doc_id == r.doc_id for p in pieces)
        pieces.append(r)
        if r.start + r.length == r.doc_tokens:
            found.append((r.doc_id, tuple((p.start, p.length, p.ids_crc32) for p in pieces)))
        else:
            open_[shard] = pieces
    assert not open_
    left = Counter(found)
    for i, ids in encoded:
        same = [k for k in left if k[0] == i and sum(n for _, n, _ in k[1]) == len(ids) and all(c == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n, c in k[1])]
        assert same
        left[same[0]] -= 1
        left += Counter()
    assert not left
    sequences = [list(g) for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id)]
    for g in sequences:
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(sum(r.length for r in g) < 2048 for g in sequences) <= len({r.sequence_id >> 40 for r in rows})


def test_packing_is_repeatable(spark, docs):
    once, again = ([tuple(r) for r in packing.pack_documents(d, packing.tokenizer(), shard_tokens=3000, group_tokens=1000).collect()] for d in (docs, docs.repartition(7)))
    assert sorted(once, key=str) == sorted(again, key=str)


TEXTS = ["", " ", "a b", " lead", "trail ", "a  b", "a \n b", "don't stop", "x\t y\u00a0z", "\n\n", "a\u2028 b", "1 2,3", "日本 語", "<|endoftext|> a", "x <|endoftext|> a", "<|endoftext|>", "<|endoftext|><|endoftext|> b c", "a  <|endoftext|>\n d", "<|endoftext|", "b\n  c", "a ", "e \x1c f", " 's 't", "x" * 5000, "z" * 3000 + " q"]


def test_units_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer())
    e = packing.UnitEncoder(packing.tokenizer())
    r = random.Random(14)
    parts = ["a", "The", "ß", " ", " ", "  ", "\n", "\t", "'s", "1", "23", "<|endoftext|>", "é", "中", "\u00a0", "\u3000", "\x85", "\x1d", "...", "\U0001F600", "x'll"]
    texts = TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for size in (1, 7, 4000):
        for k in range(0, len(texts), size):
            ids, lens = e.encode_batch(texts[k : k + size])
            assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + size]]
        e.forget()


def test_columns_give_the_tokenizers_ids():
    """Texts with single spaces between their words are encoded without Python objects, the others as before; both keep their places."""
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(packing.tokenizer()), packing.UnitEncoder(packing.tokenizer()), random.Random(21)
    parts = ["a", "The", "ß", " ", " ", " ", "\n", "'s", "1", "23", "<|endoftext|>", "é", "\u00a0", "\u3000", "\x85", "\x1d", "\x0b", "\u200b", "...", "\U0001F600", "x'll"]
    easy = [" ".join(r.choice(["a", "ab\nc", "don't", "é", "\U0001F600x", "12", "a\u00a0b", "z" * 300]) for _ in range(r.randint(1, 9))) for _ in range(500)]
    mixed = easy + TEXTS + ["\na b", "a b\n", "a\x1cb c \x85", "a\u2003 b"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    r.shuffle(mixed)
    for texts in (easy, mixed, mixed[:1], TEXTS, ["", "\n"], ["a  b"]):
        ids, lens = e.encode_column(pa.array(["cut away", *texts]).slice(1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert texts is not easy or not e.units


def brute_bm25(docs: list[list[int]], corpus_docs: list[list[int]], seed: int) -> list[float]:
    """BM25 of each document for the seed's tokens, without those that tell nothing, with the corpus's frequencies and mean."""
    df, n = Counter(x for d in corpus_docs for x in set(d)), len(corpus_docs)
    mean = sum(map(len, corpus_docs)) / n
    out = []
    for d in docs:
        score, tf = 0.0, Counter(d)
        for x in set(docs[seed]):
            if tf[x] and 1 < df[x] <= n / packing.STOP_SHARE + packing.STOP_LEAST:
                score += math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(score)
    return out


def test_scores_are_those_of_bm25():
    r = random.Random(15)
    whole = [[min(int(r.paretovariate(0.4)), 299) for _ in range(r.randint(0, 60))] for _ in range(120)]
    flat, lens = np.array([x for d in whole for x in d], np.uint16), np.array([len(d) for d in whole])
    df = np.bincount(packing.held_tokens(flat, lens)[0], minlength=300)
    assert df.tolist() == [sum(x in d for d in whole) for x in range(300)]
    corpus = packing.Corpus(df, len(whole), int(lens.sum()))
    some = whole[:70]
    index = packing.Bm25Index(flat[: lens[:70].sum()], lens[:70], corpus)
    for seed in range(70):
        want = np.array(brute_bm25(some, whole, seed))
        got = index.scores(seed)
        others = np.arange(70) != seed
        assert np.allclose(got[others], want[others])
        unused = np.array([r.random() < 0.5 for _ in range(70)])
        ranked = sorted((i for i in range(70) if unused[i] and got[i] > 0), key=lambda i: (-got[i], i))
        assert list(index.neighbours(seed, unused, 5)) == ranked


def test_an_index_is_made_in_little_memory():
    """Not much more than twice what the index has in the end, however many numbers it is made of."""
    r = np.random.default_rng(23)
    lens = np.full(3000, 1000)
    flat = np.minimum(r.pareto(0.5, 3_000_000) * 40, 49_999).astype(np.uint16)
    corpus = packing.Corpus(np.bincount(packing.held_tokens(flat, lens)[0], minlength=50_000), 3000, len(flat))
    tracemalloc.start()
    index = packing.Bm25Index(flat, lens, corpus)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert index.n == 3000 and len(index.lists) > 1_000_000 and peak < 2.2 * now


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_an_index_is_the_same_in_blocks(monkeypatch, block):
    r = random.Random(24)
    whole = [[min(int(r.paretovariate(0.4)), 299) for _ in range(r.choice([0, 1, 40, 90]))] for _ in range(120)]
    flat, lens = np.array([x for d in whole for x in d], np.uint16), np.array([len(d) for d in whole])
    corpus = packing.Corpus(np.bincount(flat, minlength=300), 120, len(flat))
    one = packing.Bm25Index(flat, lens, corpus)
    monkeypatch.setattr(packing, "BLOCK", block)
    token, doc, count = packing.held_tokens(flat, lens)
    assert list(zip(token.tolist(), doc.tolist(), count.tolist(), strict=True)) == sorted((t, d, n) for d, x in enumerate(whole) for t, n in Counter(x).items())
    two = packing.Bm25Index(flat, lens, corpus)
    for a, b in ((one, two), (one.bounds, two.bounds)):
        same = {k: np.allclose(v, getattr(b, k), rtol=1e-12) if k == "unit" else (v == getattr(b, k)).all() for k, v in vars(a).items() if isinstance(v, np.ndarray)}
        assert len(same) > 4 and all(same.values()), same


def test_a_packing_worker_frees_its_encoder():
    from pyspark import cloudpickle

    packing.encoder_of(packing.tokenizer())
    pack = cloudpickle.loads(cloudpickle.dumps(packing.packer_of(packing.Corpus(np.array([0, 2, 1]), 2, 3), np.dtype("<u2"))))
    ids = pa.array([np.array(x, "<u2").tobytes() for x in ([1, 2], [1])], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([5, 4]), ids, *(pa.array([0, 0], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["doc_id", "ids", "t", "u", "h", "shard"])
    assert [list(r.values())[:3] + [r["offset"]] for r in pa.Table.from_batches(pack(iter([batch]))).to_pylist()] == [[4, 0, 2, 0], [5, 0, 3, 2]]
    assert not packing._ENCODERS


def test_keys_are_the_first_tokens_of_one_order():
    r = random.Random(20)
    whole = [[r.randint(0, 4999) for _ in range(r.choice([0, 1, 2, 30]))] for _ in range(200)]
    flat, lens = np.array([x for d in whole for x in d], np.uint16), np.array([len(d) for d in whole])
    ranks = packing.key_ranks(5000)
    assert sorted(ranks[ranks < 5000]) == list(range(5000 - packing.KEY_FLOOR - 1)) and (ranks[: packing.KEY_FLOOR + 1] == 5000).all()
    first, second = packing.first_keys(flat, lens, ranks)
    for d, a, b in zip(whole, first, second, strict=True):
        assert [a, b] == [*sorted({int(ranks[x]) for x in d} - {5000}), 5000, 5000][:2]


def test_windows_are_filled_with_neighbours():
    """Two themes in turn: the window that a document of one opens is filled with the other documents of that theme."""
    docs = [[10 + k % 2, 20 + k % 2, 100 + k] for k in range(40)]
    flat, lens = np.array([x for d in docs for x in d], np.uint16), np.full(40, 3)
    corpus = packing.Corpus(np.bincount(packing.held_tokens(flat, lens)[0], minlength=200) // 3, 40, 120)
    order = [d for d, _ in packing.pack_shard(packing.Bm25Index(flat, lens, corpus), [3] * 40, packing.Packer(0, 30))]
    assert sorted(order) == list(range(40)) and [d % 2 for d in order] == [0] * 20 + [1] * 20


def test_windows_count_frequent_tokens_too():
    """Whole scores hold tokens of any frequency, and stay those of BM25 as documents are used up; documents that share frequent tokens only are reached."""
    r = random.Random(16)
    whole = [[min(int(r.paretovariate(0.4)), 299) for _ in range(r.randint(0, 60))] for _ in range(400)]
    flat, lens = np.array([x for d in whole for x in d], np.uint16), np.array([len(d) for d in whole])
    df, mean = np.bincount(packing.held_tokens(flat, lens)[0], minlength=300), sum(map(len, whole)) / 400
    corpus = packing.Corpus(df, 400, int(lens.sum()))
    assert any(df > 400 / packing.STOP_SHARE + packing.STOP_LEAST)
    tfs, index, unused, more = [Counter(d) for d in whole], packing.Bm25Index(flat, lens, corpus), np.ones(400, bool), 0
    while (free := np.flatnonzero(unused).tolist()) and len(free) > 20:
        seed = r.choice(free)
        unused[seed] = False
        score = [sum(math.log(1 + (400 - df[x] + 0.5) / (df[x] + 0.5)) * tfs[d][x] * 2.2 / (tfs[d][x] + 1.2 * (0.25 + 0.75 * lens[d] / mean)) for x in tfs[seed] if df[x] > 1) for d in range(400)]
        ranked = list(packing.Bm25Index(flat, lens, corpus).neighbours(seed, unused))
        got = list(index.nearest(seed, unused, 5))
        assert sorted(got) == [d for d in free if d != seed and score[d] > 0] and all(score[a] >= score[b] - 1e-9 for a, b in itertools.pairwise(got))
        more += len(got) > len(ranked)
        unused[got[:30]] = False
    assert more


@pytest.mark.parametrize(("share", "room", "long_rows"), [(40, 1 << 20, 4096), (40, 1 << 20, 0), (4, 1 << 20, 4096), (40, 4000, 4096)])
def test_few_documents_are_scored_in_full(monkeypatch, share, room, long_rows):
    """Seed after seed, with copies among the documents: the best come as they do when all are scored, and few are; bounds hold for lists of either kind."""
    for name, value in (("DENSE_SHARE", share), ("DENSE_BYTES", room), ("LONG_ROWS", long_rows)):
        monkeypatch.setattr(packing, name, value)
    r = random.Random(22)
    whole = [[min(int(r.paretovariate(0.3)), 1999) for _ in range(r.choice([0, 3, 80, 150, 400]))] for _ in range(500)]
    whole += [whole[r.randrange(500)] for _ in range(100)]
    flat, lens = np.array([x for d in whole for x in d], np.uint16), np.array([len(d) for d in whole])
    token, doc, _ = packing.held_tokens(flat, lens)
    assert all((a == b).all() for a, b in zip(packing.held_tokens(flat.astype(np.uint32), lens), packing.held_tokens(flat, lens), strict=True))
    df = np.bincount(token, minlength=2000)
    corpus = packing.Corpus(df, 600, int(lens.sum()))
    index, unused, everyone, full, n = packing.Bm25Index(flat, lens, corpus), np.ones(600, bool), np.arange(600), 0, 0
    tfs = [Counter(d) for d in whole]
    mean, scored = sum(map(len, whole)) / 600, index.whole_scores
    while unused.sum() > 60:
        seed = r.choice(np.flatnonzero(unused).tolist())
        unused[seed] = False
        score = scored(seed, everyone)
        want = [sum(math.log(1 + (600 - df[x] + 0.5) / (df[x] + 0.5)) * tfs[d][x] * 2.2 / (tfs[d][x] + 1.2 * (0.25 + 0.75 * lens[d] / mean)) for x in tfs[seed] if df[x] > 1) for d in range(0, 600, 29)]
        assert np.allclose(score[::29], want)
        ranked = sorted((d for d in range(600) if unused[d] and score[d] > 0), key=lambda d: (-score[d], d))
        seen: list[int] = []
        monkeypatch.setattr(index, "whole_scores", lambda s, docs, seen=seen: (seen.append(len(docs)), scored(s, docs))[1])
        assert list(itertools.islice(index.nearest(seed, unused), 3)) == ranked[:3]
        if lens[seed] >= 80:
            full, n = full + sum(seen), n + int(unused.sum())
        assert list(index.nearest(seed, unused)) == ranked
        low, slack = index.bounds.scores(index.of(seed))
        there = score[index.bounds.docs]
        assert (low <= there + 1e-6).all() and (there <= low + slack + 1e-6).all()
        unused[ranked[:2]] = False
    assert len(index.bounds.docs) < 200 and full < n / 4


# --- 4 ---


def test_patience_aligns_common_blocks():
    assert linededup.patience_blocks([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1, 2), (4, 4, 1)]
    assert linededup.patience_blocks([], [1]) == [] and linededup.patience_blocks([1, 1, 2], [1, 2]) != []
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randint(0, 9) for _ in range(12)], [r.randint(0, 9) for _ in range(12)]
        blocks = linededup.patience_blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in itertools.pairwise(blocks))


def test_line_dedup_removes_from_the_later_document(spark, docs):
    line = "one two three four five six"
    rows = [(1, f"{line}\nown words of the first document"), (2, f"some other words come here now\n{line}\nOf."), (3, line), (4, None), (5, ""), (2, f"some other words come here now\n{line}\nOf."), (6, "Of.\nshort")]
    got = {r.row.doc_id: r.new for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "some other words come here now\nOf." and got[3] == "" and got[4] is None and got[5] == "" and got[6] == rows[6][1]
    kept = linededup.stage_line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"] and 3 not in {r.doc_id for r in kept.collect()}
    assert linededup.stage_line_dedup(spark, docs, "").columns == docs.columns


def test_line_dedup_finds_repeated_moved_and_short_lines(spark):
    x, y, z = "one two three four five six", "seven eight nine ten eleven", "some lines of the first one"
    rows = [(1, f"q\n{x}\n{y}\nr\n{x}\n{y}\n{z}\na b\n\nc d\ne f"), (2, f"s\n{x}\n{y}\nt"), (3, f"u\n{z}\nv\n{x}\nw\n{z}\nn"), (4, "k\na b\n\nc d\ne f\nm"), (5, "c d\ne f\na b")]
    got = {r.row.doc_id: r.new for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "s\nt", 3: "u\nv\nw\nn", 4: "k\nm", 5: rows[4][1]}


def test_removed_lines_are_those_of_all_common_runs():
    r = random.Random(5)
    for _ in range(400):
        a, b = [r.randint(0, 4) for _ in range(r.randint(0, 14))], [r.randint(0, 4) for _ in range(r.randint(0, 14))]
        w = [[0, 1, 2, 3, 6][x] for x in a]
        runs = {tuple(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        want = {k for i in range(len(a)) for j in range(i + 1, len(a) + 1) if tuple(a[i:j]) in runs and sum(w[i:j]) >= 5 for k in range(i, j)}
        assert linededup.removed_lines(a, w, b) == sorted(want)


def brute_lines(rows: list[tuple]) -> list[set[int]]:
    """The lines with words that each row loses if it is aligned with every earlier row that has a common run of lines, all runs tried."""
    runs, docs, out = {}, [], []
    for i, t in rows:
        lines = (t or "").split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        own = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(words[a : b + 1]) >= 5:
                    own.add(tuple(lines[a : b + 1]))
                    break
        gone = set()
        for m in {m for x in own for m in runs.get(x, ())}:
            gone |= {k for k in linededup.removed_lines([hash(x) for x in lines], words, [hash(x) for x in docs[m]]) if words[k]}
        for x in own:
            runs.setdefault(x, []).append(len(docs))
        docs.append(lines)
        out.append(gone)
    return out


def test_no_link_is_lost_by_first_holders(spark):
    """Texts of few short lines in all orders: what the first holders of runs give is what all earlier documents give."""
    r = random.Random(16)
    pool = ["a b", "c", "d e f", "", "g h i j k", "l m n o p q", " "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 7)))) for i in range(150)]
    got = {x.row.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), want in zip(rows, brute_lines(rows), strict=True):
        assert {k for k in got[i].gone or [] if t.split("\n")[k].strip()} == want


def test_lines_of_a_whole_table_match_brute_force(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no tables")
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()), key=lambda r: r[0])
    got = {x.doc_id: x for x in linededup.op4_line_dedup(spark, path).collect()}
    for (i, t), want in zip(rows, brute_lines(rows), strict=True):
        lines = (t or "").split("\n")
        assert {k for k in got[i].removed_lines if lines[k].strip()} == want
        assert got[i].n_removed == len(got[i].removed_lines) and got[i].kept_crc32 == zlib.crc32("\n".join(x for k, x in enumerate(lines) if k not in set(got[i].removed_lines)).encode())


# --- 5 ---


def test_every_row_has_a_slot_of_its_own(docs):
    rows = sharding.shard_documents(docs, 4, 64)[0].collect()
    assert len(rows) == len(odd_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t in odd_rows())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_are_near_equal_in_bytes(spark):
    """Also where a third of the rows are alike in id and text, or have no id."""
    rows = [(i, prose(i, 40 + i % 50)) for i in range(2000)] + [(None, "x " * 150)] * 700 + [(7, "y " * 100)] * 600
    placed, slot_map = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = placed.collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 24
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_a_stored_map_is_edited(spark, tmp_path):
    rows = [(i, prose(i, 40 + i % 50)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first, one = sharding.shard_documents(frame, 8, 512, f"{tmp_path}/maps")
    grown, two = sharding.shard_documents(frame, 9, 512, f"{tmp_path}/maps")
    assert (one.version, two.version) == (2, 3) and sharding.SlotMap.load(spark, f"{tmp_path}/maps", 1) == sharding.SlotMap.even(512, 8)
    before, after = ({r.doc_id: r.shard for r in x.collect()} for x in (first, grown))
    moved = [i for i in before if before[i] != after[i]]
    assert len(moved) < 2 * len(rows) / 9 and {r.virtual_slot for r in first.collect()} == {r.virtual_slot for r in grown.collect()}
    sizes = Counter()
    for i, t in rows:
        sizes[after[i]] += len(t.encode()) + 8
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 9


def test_slot_map_versions(spark, tmp_path):
    sizes = [random.Random(5).randint(1, 100) for _ in range(512)]
    first = sharding.SlotMap.balanced(sizes, 8)
    assert max(first.loads(sizes)) - min(first.loads(sizes)) <= 100
    grown = first.rebalanced(sizes, 9)
    moved = sum(a != b for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    assert grown.version == 2 and moved < 512 / 9 * 2 and max(grown.loads(sizes)) <= sum(sizes) / 9 * 1.05
    first.save(spark, f"{tmp_path}/m")
    grown.save(spark, f"{tmp_path}/m")
    assert sharding.SlotMap.load(spark, f"{tmp_path}/m") == grown and sharding.SlotMap.load(spark, f"{tmp_path}/m", 1) == first


# --- 6 ---


def test_encoding_equals_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    s, m = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.MergeModel.load(path)
    r = random.Random(6)
    texts = [t or "" for _, t in odd_rows()] + ["".join(r.choice("abthe   ▁\n\té中̀\U0001F600\x00'0$A") for _ in range(r.randint(0, 40))) for _ in range(500)]
    pieces = [p for p in m.id if len(p) > 1]
    texts += ["".join(r.choice(pieces).replace("▁", " ") for _ in range(6)) for _ in range(500)]
    for t in texts:
        ids = s.encode(t)
        assert m.encode(t) == ids and m.decode(ids) == s.decode(ids) == m.encoded(t)[2]
    got = Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in sentencepiece_bpe.encode_documents(docs, path).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter((i, len(ids), sha(",".join(map(str, ids))), sha(s.decode(ids))) for i, t in odd_rows() for ids in [s.encode(t or "")])


# --- 7 ---


def test_classes_match_brute_force(spark):
    r = random.Random(7)
    texts = []
    for g in range(12):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([3, 5, 60, 150]))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, texts[0].upper().replace(" ", "\n")), (903, "a a a a a a a a a"), (904, "a a a a a")]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else {()}
    label = {i: i for i in sets}
    for _ in range(20):
        for a, b in itertools.combinations(sets, 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_bucket_mates_behind_their_leaders_are_compared(spark, monkeypatch):
    """Links 0-1, 1-2 and 2-3; 0 and 3 lead their classes wherever 1 meets 2, and are too far from the other class."""
    r = random.Random(9)
    words = [f"w{r.randint(0, 10**9)}" for _ in range(127)]
    docs = spark.createDataFrame([(k, " ".join(words[9 * k : 9 * k + 100])) for k in range(4)], "doc_id long, text string")
    buckets = {0: [1, 2, 3], 1: [1, 2], 2: [1, 4], 3: [1, 3, 4]}
    given = spark.createDataFrame(list(buckets.items()), "doc_id long, buckets array<long>")
    signed = neardup.signed
    monkeypatch.setattr(neardup, "signed", lambda d: signed(d).drop("buckets").join(given, "doc_id").select("doc_id", "th", "node", "buckets", "probe"))
    assert {x.class_id for x in neardup.classes(docs).collect()} == {0}


def test_repeated_shingles_do_not_part_similar_sets(spark):
    """Set Jaccard 0.85, but one text repeats much of itself, so that few registers of the signatures agree."""
    docs = []
    for k in range(20):
        r = random.Random(k)
        base = [f"w{r.randint(0, 10**9)}" for _ in range(300)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:100] * 60, *base[100:250], *(f"e{r.randint(0, 10**9)}" for _ in range(5)), *base[250:]]))]
    # Every pair shares a bucket that the signatures alone would have to give: compared are the probes.
    rows = {x.doc_id: x.probe for x in neardup.signed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = spark.createDataFrame([(rows[2 * k], rows[2 * k + 1]) for k in range(20)], "a array<long>, b array<long>")
    assert pairs.where(neardup.agree("a", "b")).count() == 20


def test_probes_rule_out_no_similar_pair(spark):
    r = np.random.default_rng(11)
    rows = []
    for _ in range(400):
        n = int(r.integers(1, 400))
        both, own, other = (r.integers(0, 1 << 32, k, dtype=np.uint64) for k in (n, int(r.integers(0, n // 3 + 1)), int(r.integers(0, n // 3 + 1))))
        sets = [np.unique(np.concatenate([both, x])) for x in (own, other)]
        probe = [[len(x), *neardup.parities(x, 1)[0][0].tolist()] for x in sets]
        rows.append((*probe, len(np.intersect1d(*sets)) >= 0.8 * len(np.union1d(*sets))))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, similar boolean").withColumn("kept", neardup.agree("a", "b"))
    assert got.where("similar and not kept").count() == 0 < got.where("not kept").count()


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.default_rng(8)
    h = r.integers(1, 1 << 62, 300).astype(np.uint64)
    x, y = r.integers(1, 4, 300) * (r.random(300) < 0.8), r.integers(1, 4, 300) * (r.random(300) < 0.8)
    both = np.flatnonzero((x > 0) & (y > 0))
    true = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    rows = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    s = neardup.prob_minhash(rows, np.concatenate([h[x > 0], h[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]).astype(float), 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.03)


def brute_classes(rows: list[tuple]) -> list[int]:
    """A number for each row, equal where an inverted index of shingles finds a chain of similar sets."""
    sets, lists = [], {}
    for _, t, *_ in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else {()})
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in lists.get(x, ()))
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                above[max(top(i), top(j))] = min(top(i), top(j))
        for x in s:
            lists.setdefault(x, []).append(i)
    return [top(i) for i in range(len(rows))]


def test_classes_of_a_whole_table_match_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    top = brute_classes(rows)
    least = {}
    for (i, _), c in zip(rows, top, strict=True):
        least[c] = min(least.get(c, i), i)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {i: least[c] for (i, _), c in zip(rows, top, strict=True)}


@pytest.mark.parametrize("unit_rows", [3, 512])
def test_a_large_bucket_of_borderline_copies_is_dealt_into_units(spark, monkeypatch, unit_rows):
    """One bucket of 60 versions whose similarities lie around the threshold: leaders settle little."""
    monkeypatch.setattr(neardup.in_units, "__defaults__", (unit_rows, 8 << 20))
    r = random.Random(12)
    base = [f"w{r.randint(0, 10**9)}" for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in r.sample(range(120), 3 if i % 3 else 2):
            copy[k] = f"e{i}x{k}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    signed = neardup.signed
    monkeypatch.setattr(neardup, "signed", lambda d: signed(d).withColumn("buckets", F.array(F.lit(1).cast("long"))))
    got = {x.doc_id: x.class_id for x in neardup.classes(frame).collect()}
    assert got == dict(enumerate(brute_classes(rows))) and 1 < len(set(got.values())) < 60


def test_components_of_chains_and_stars(spark):
    r = random.Random(13)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(r.randint(300, 360), r.randint(300, 360)) for _ in range(40)] + [(i, i - 1) for i in range(600, 560, -1)]
    got = {x.node: x.label for x in spark_util.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_null_and_repeated_ids(spark):
    text = prose(70, 60)
    rows = [(1, text), (None, text + " more"), (None, None), (None, ""), (5, prose(71, 60)), (5, prose(72, 60)), (3, prose(72, 60) + " z"), (3, prose(72, 60) + " z"), (None, prose(73, 60)), (None, prose(73, 60) + " y")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = Counter((x.doc_id, x.class_id) for x in neardup.classes(frame).collect())
    assert got == Counter([(1, 1), (None, 1), (None, None), (None, None), (5, 5), (5, 3), (3, 3), (3, 3), (None, None), (None, None)])
    kept = [x.k for x in neardup.stage_near_duplicates(spark, frame, "").collect()]
    assert len(kept) == 5 and {0, 4} <= set(kept) and len({2, 3} & set(kept)) == len({6, 7} & set(kept)) == len({8, 9} & set(kept)) == 1


CLASHES = ["row", "rd", "rt", "th", "node", "class_id", "k", "_text", "_w", "n_words", "kept", "_gone", "_id", "_th", "_new", "_row", "_mark", "value", "a.b", "n"]


@pytest.mark.parametrize("stage", [quality.stage_quality, linededup.stage_line_dedup, neardup.stage_near_duplicates], ids=["quality", "lines", "near"])
def test_stages_carry_columns_of_any_name(spark, stage):
    line = "the first of all the lines to be found in this and in that"
    rows = [(i, f"{prose(200 + i, 80)}\n{line if i < 9 else ''}") for i in range(10)] + [(None, prose(210, 70)), (11, None), (12, ""), (13, prose(200, 80) + " the end")]
    frame = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows], ", ".join(["doc_id long, text string", *[f"`{c}` string" for c in CLASHES]]))
    got = stage(spark, frame, "")
    assert got.columns == frame.columns
    found = got.collect()
    assert found and all(tuple(x)[2:] == tuple(f"{c}{x.doc_id}" for c in CLASHES) for x in found)
    assert sorted(x.doc_id or -1 for x in found) == sorted(x.doc_id or -1 for x in stage(spark, frame.select("doc_id", "text"), "").collect())
    assert stage(spark, frame.limit(0), "").count() == 0


def test_operators_ignore_other_columns(spark):
    """Columns with the names that operators use inside change no result."""
    import public_tokenizers

    rows = [(i, prose(i, 60)) for i in range(20)] + [(None, prose(3, 60)), (21, None), (22, "All rights reserved.")]
    names = [*CLASHES, "block", "key", "part", "own", "ids", "counts", "t", "u", "h", "shard", "size", "text_crc32", "virtual_slot", "held_out", "kind", "keys", "bits", "rank", "place", "heavy", "name"]
    names = list(dict.fromkeys(names))
    wide = spark.createDataFrame([(*r, *[c for c in names]) for r in rows], ", ".join(["doc_id long, text string", *[f"`{c}` string" for c in names]]))
    plain = wide.select("doc_id", "text")
    for f in (ctw.score_documents, licenses.scan_documents, lambda d: packing.pack_documents(d, packing.tokenizer()), lambda d: sharding.shard_documents(d)[0].drop("rank"), neardup.classes, fingerprints.fingerprint_documents, lambda d: sentencepiece_bpe.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model"))):
        assert sorted(map(str, f(wide).collect())) == sorted(map(str, f(plain).collect()))


def test_stage_keeps_one_of_each_class(spark, docs):
    kept = neardup.stage_near_duplicates(spark, docs, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 34 not in ids and 35 not in ids and 36 not in ids and {0, 3, 5} <= set(ids) and ids.count(5) == 1


# --- 8 ---


def brute_measures(text: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    places = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_quality_measures(spark, docs):
    texts = odd_rows() + [(50, "a b c a b c a b c x"), (51, "$a *b <c>\nq\n\nq\n q"), (52, "z " * 60)]
    got = quality.judge(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_measures(t or "")) for i, t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.stage_quality(spark, docs, "").columns == docs.columns


# --- 9 ---


def test_url_rules_and_trees(spark):
    cases = [("http://A.Example.ORG/es/x?y=/en/", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://x.org/", "x.org", "/", "org/", "allow"), ("http://org", "org", "", None, None), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
             ("a://b.com/de/#c", "b.com", "/de/", "com/de/", "block"), ("x://y.com/fr/1?q#z", "y.com", "/fr/1", "com/fr/", "allow"), (None, "", "", None, None), ("no scheme", "", "", None, None), ("//h/p", "", "", None, None), ("s://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("s://h?x/y", "h", "", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    for r in urls.judge_urls(df).collect():
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_trees_judge_hidden_labels(spark, monkeypatch):
    """A quarter of the URLs that a rule decides hide their labels: the trees must find them, by several features."""
    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    fitted, fit = [], urls.fit_trees
    monkeypatch.setattr(urls, "fit_trees", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    pages = spark.read.parquet(path)
    hidden = F.pmod(F.crc32("url"), F.lit(4)) == 0
    truth = {r.page_id: r.ruled for r in urls.ruled(urls.located(pages)).where(hidden & F.col("ruled").isNotNull()).collect()}
    got = {r.page_id: r.p_block for r in urls.judge_urls(pages, label=F.when(~hidden, F.col("ruled"))).collect()}
    bad, good = (np.array([got[i] for i, v in truth.items() if v == kind]) for kind in ("block", "allow"))
    assert len(bad) > 30 and (bad[:, None] > good[None]).mean() > 0.95
    assert (bad > 0.5).mean() > 0.9 and (good <= 0.5).mean() > 0.95
    t = fitted[0]
    assert len(set(t.feature[np.isfinite(t.cut)].tolist())) >= 3


def test_rates_leave_out_the_rows_fold(spark):
    rows = [(i, f"http://h{i % 3}.s{i % 2}.com/{'de' if i % 4 else 'fr'}/{i}") for i in range(40)]
    known = urls.ruled(urls.located(spark.createDataFrame(rows, "page_id long, url string"))).withColumn("label", F.when(F.col("page_id") % 5 != 0, F.col("ruled")))
    got = urls.with_rates(urls.keys(known), urls.statistics(known), 0.25).collect()
    for key in urls.KEYS:
        for r in got:
            other = [x.label == "block" for x in got if x.label is not None and x[key] == r[key] and (r.label is None or x.fold != r.fold)]
            assert r[f"{key}_rate"] == pytest.approx((sum(other) + urls.SMOOTH * 0.25) / (len(other) + urls.SMOOTH))


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, "")], [(1, "http://a.com/de/"), (1, "http://a.com/de/"), (None, "x" * 100_000), (3, "http://b.net/" + "a/" * 50_000)]], ids=["empty", "null", "long"])
def test_odd_urls(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, fold string")
    got = urls.judge_urls(frame).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in rows) and all(r.verdict in ("allow", "block") for r in got)
    assert rows[:1] != [(1, None)] or {r.verdict for r in got} == {"allow"}


def test_trees_learn():
    r = np.random.default_rng(9)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = urls.fit_trees(x[:3000], y[:3000])
    assert ((t.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    assert len(urls.fit_trees(x, np.ones(4000)).feature) == 0 and urls.fit_trees(x[:0], y[:0]).log_odds(x[:2]).max() < 0


# --- 10 ---


def brute_digest(text: str) -> list[int]:
    """The length step, then the quartile of each bucket of a text."""
    raw, counts = text.encode(), [0] * 256
    for i in range(len(raw)):
        for k, (a, b, c) in enumerate(fingerprints.TRIPLETS):
            if i + c < len(raw):
                x = ((raw[i + a] << 16 | raw[i + b] << 8 | raw[i + c]) ^ k << 24) * 0x9E3779B1 % 2**32
                counts[(x ^ x >> 15) * 0x85EBCA77 % 2**32 >> 24] += 1
    q = [sorted(counts)[64 * k - 1] for k in (1, 2, 3)]
    return [round(math.log(len(raw) + 1) / math.log(1.2)), *[sum(c > x for x in q) for c in counts]]


def brute_likeness(a: list[int], b: list[int]) -> float:
    steps = sum([0, 1, 2, 6][abs(x - y)] for x, y in zip(a[1:], b[1:], strict=True)) / 256
    return 1 - min(1, (steps + max(0, abs(a[0] - b[0]) - 1) * 12 / 256) / 1.625)


@pytest.mark.parametrize("part_bytes", [300, 20_000, 1 << 20])
def test_fingerprints_follow_the_next_document(spark, part_bytes):
    rows = [*odd_rows(), *[(7, prose(300 + k, 20)) for k in range(25)], *[(None, prose(330 + k, 9)) for k in range(12)], (7, prose(301, 20)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint_documents(docs, part_bytes).collect()
    hashes = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashes, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = []
    for k, r in enumerate(order):
        t, x = r.text, order[(k + 1) % len(order)].text
        half = len(t) // 2
        new = t[: len(t) - half] + x[:half]
        marks = [brute_digest(y) for y in (t, new, x)]
        want.append((r.doc_id, len(t), hashlib.sha256(new.encode()).hexdigest(), marks[0], marks[1], brute_likeness(marks[0], marks[1]), brute_likeness(marks[0], marks[2])))

    def shown(digest: str) -> list[int]:
        codes, n = fingerprints.parse(digest)
        return [n, *codes.tolist()]

    found = [(r.doc_id, r.n_chars, r.edited_sha256, shown(r.fingerprint), shown(r.edited_fingerprint), r.near_edited, r.near_next) for r in got]
    for x, y in zip(sorted(found, key=str), sorted(want, key=str), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])
    mark = {r.doc_id: r.fingerprint for r in got}
    assert mark[3] == mark[34] == mark[35] and mark[30] == mark[31] and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare(mark[3], mark[34]) == 1.0 and fingerprints.compare(mark[0], mark[36]) > 0.8 > fingerprints.compare(mark[0], mark[38])


def test_fingerprints_of_small_tables(spark):
    for rows in ([(1, "alone")], [(None, None)], [(1, "a b c"), (2, None)], [(4, "same")] * 5):
        got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


# --- columns that SQL can express ---


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return path, con


def test_edited_texts_of_a_whole_table(spark, sql):
    path, con = sql
    want = con.sql("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x, length(t) AS n FROM t)
        SELECT doc_id, n, sha256(substr(t, 1, n - n // 2) || substr(x, 1, n // 2)) FROM n""").fetchall()
    got = fingerprints.op10_fingerprints(spark, path).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    mark = {r.doc_id: r.fingerprint for r in got}
    ids = sorted(mark)
    for r in got:
        following = mark[ids[ids.index(r.doc_id) - 1]]
        assert r.near_edited == pytest.approx(fingerprints.compare(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(fingerprints.compare(r.fingerprint, following))


def test_hosts_paths_and_rules_of_a_whole_table(spark, sql):
    path, con = sql
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])))
    want = con.sql(f"""WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages), s AS (SELECT page_id, CASE WHEN contains(u, '://') THEN substr(u, position('://' IN u) + 3) ELSE '' END AS r FROM u),
        h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
        SELECT page_id, host, path, CASE {rules} END FROM h""").fetchall()
    got = urls.op9_url_filters(spark, path).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(want, key=str)
    said = {h + p: v for v, h, p in urls.RULES}
    assert all(r.verdict == said[r.rule] for r in got if r.rule) and all(r.verdict in ("allow", "block") for r in got)


def test_sizes_and_places_of_a_whole_table(spark, sql):
    path, con = sql
    got = sharding.op5_sharding(spark, path).collect()
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    assert sorted((r.doc_id, r.size) for r in got) == sorted(con.sql("SELECT doc_id, strlen(coalesce(text, '')) + 8 FROM documents").fetchall())
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None and r.map_version == 2 for r in got if texts[r.doc_id] is not None)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert set(loads) == set(range(24)) and max(loads.values()) < 1.05 * min(loads.values())
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# --- the pipeline ---


def brute_pipeline(rows: list[tuple]) -> Counter:
    """(doc_id, ids of the text) of what the four stages leave, by brute force over (doc_id, text) rows with distinct ids."""
    from tokenizers import Tokenizer

    def good(t):
        n, chars, symbols, dup, repeated = brute_measures(t)
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        stops = sum(w.lower() in quality.STOP_WORDS for w in words)
        return not (n < 50 or 100 * repeated > 50 * n or chars < 2 * n or chars > 15 * n or 100 * symbols > 15 * n or 100 * stops < 6 * n or 100 * dup > 50 * len(lines))

    rows = sorted(((i, t) for i, t in rows if good(t or "")), key=lambda r: r[0])
    left = []
    for (i, t), gone in zip(rows, brute_lines(rows), strict=True):
        new = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if new.strip(" \t\n\v\f\r"):
            left.append((i, new))
    top = brute_classes(left)
    tokens = Tokenizer.from_file(packing.tokenizer())
    return Counter((i, tuple(tokens.encode(t, add_special_tokens=False).ids)) for k, (i, t) in enumerate(left) if top[k] == k)


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    r = random.Random(18)
    rows = []
    for i in range(70):
        lines = [" ".join([*r.sample(["the", "of", "and", "to", "in", "that"], 2), *(f"w{r.randint(0, 10**6)}" for _ in range(r.randint(4, 12)))]) for _ in range(r.randint(6, 14))]
        if i % 5 == 1:  # a shared passage
            lines[2:2] = ["the passage that stands in many of the texts", "and goes on to its second line here"]
        if i % 5 == 2:  # a near copy: no line in common, few words changed
            words = " ".join(lines).split()
            rows.append((1000 + i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))))
            words[len(words) // 2] = "other"
            lines = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
        rows.append((i, "\n".join(lines)))
        if i % 7 == 0:
            rows.append((500 + i, "\n".join(lines)))
    rows += [(2000, "$$$ *** " * 60), (2001, "too short"), (2002, None), (2003, "zzz " * 80), (2004, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(rows)
    assert 40 < len(want) < 80
    got: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault(p.doc_id, []).append(p)
    assert set(got) == {i for i, _ in want}
    for i, ids in want:
        full = [*ids, 1]
        assert sum(p.length for p in got[i]) == len(full) == got[i][0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.array(full[p.start : p.start + p.length], "<u4").tobytes()) for p in got[i])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_very_long_texts(spark):
    """A text of a megabyte, one without any space and one of one line repeated, beside short ones, through every operator."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(19)
    long = "\n".join(" ".join(["the", "of", *(f"w{r.randint(0, 10**7)}" for _ in range(10))]) for _ in range(11_000))
    texts = [long, long.replace("w1", "v1", 1), "x" * 300_000, "the line that is said again and again\n" * 9000, "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = Tokenizer.from_file(packing.tokenizer())
    packed = packing.pack_documents(docs, packing.tokenizer()).collect()
    for i, t in enumerate(texts):
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 1]
        own = sorted((p for p in packed if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in own] == list(itertools.accumulate([0, *(p.length for p in own[:-1])])) and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {x.doc_id: x for x in sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert {x.doc_id: x.class_id for x in neardup.classes(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    measured = {x.doc_id: x for x in quality.judge(docs, ["doc_id"]).collect()}
    assert all((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute_measures(texts[i]) for i, m in measured.items()) and measured[0].kept and not measured[3].kept
    lines = {x.row.doc_id: x for x in linededup.dedup_lines(docs).collect()}
    assert lines[1].new.count("\n") == 0 and "v1" in lines[1].new and lines[0].gone is None and lines[3].gone is None
    prints = {x.doc_id: x for x in fingerprints.fingerprint_documents(docs).collect()}
    assert prints[0].fingerprint != prints[2].fingerprint and all(prints[i].edited_sha256 == sha(fingerprints.edited(texts[i], texts[(i - 1) % 5])) for i in range(5))
    assert {x.doc_id: x.size for x in sharding.shard_documents(docs)[0].collect()} == {i: len(t) + 8 for i, t in enumerate(texts)}
    scored = {x.doc_id: x for x in ctw.score_documents(docs).collect()}
    assert all(scored[i].n_tokens == len(t.split()) + 1 and scored[i].score < 0 for i, t in enumerate(texts))
    notice = licenses.scan_documents(spark.createDataFrame([(0, long + "\nAll rights reserved.\n" + long)], "doc_id long, text string")).collect()
    assert [(n.license, n.first_byte) for n in notice] == [("all-rights-reserved", len(long) + 1)]


def test_pipeline_stages_chain(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    good = [(i, " ".join(f"{w} the{i}x{k}" for k, w in enumerate(["the", "of", "and", "to", "in"] * 15)), "en", "s", 1) for i in range(8)]
    rows = [*good, (8, good[0][1], "en", "s", 1), (9, "$$$ *** " * 60, "en", "s", 1), (10, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus.run(spark, str(tmp_path)).collect()}
    assert got == set(range(8)) and [n for n, _ in corpus.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "packing"]
