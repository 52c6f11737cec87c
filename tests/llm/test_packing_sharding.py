from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tidewatch.llm import packing, queries, sharding, words

CAPACITY = 4096


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def encoded(coder, texts):
    out = []
    for _, off, data in words.chunks(pa.array(texts, pa.string())):
        ids, cut = coder.encode(data, off)
        out += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


@pytest.mark.parametrize("limit", [200, 1_000_000])
def test_encoder_equals_the_tokenizer(limit):
    pick = random.Random(3)
    parts = ["a", "B", "é", "É", "ñ", "'", "'s", "'re", "’", "1", "23", "²", "½", "…", "—", " ", "\n", " ", " ", "́", "=", "̸", "!", "?!", "<|endoftext|>", "İ", "Σ", "ς", "ß", "中", "文", "한", "\x1c", "\x00", "\x85", "🙂", "ñ", "_", "-", ".", "​", "٣", "'ll", "don't"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(12))) for _ in range(8000)]
    assert encoded(packing.Encoder(queries.tokenizer_path(), limit), texts) == [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]


def check_packing(docs: dict, rows: list, coder) -> int:
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for name, text in docs.items():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        assert sorted(by[name]) == [(k, a, len(ids[a : a + CAPACITY]), zlib.crc32(np.array(ids[a : a + CAPACITY], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), CAPACITY))]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(places)


@pytest.mark.parametrize("block", [5000, 40])
def test_packing(spark, small, block):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs |= {10_000: None, 10_001: "", 10_002: "word " * 9000}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in docs.items()], "doc_id long, text string, piece int, row int")
    rows = packing.pack(packing.pieces(df, queries.tokenizer_path()), block=block).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(docs, rows, tokenizer()) <= -(-total // CAPACITY) * 1.05 + 3


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty, queries.tokenizer_path())).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(twice, queries.tokenizer_path())).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    full = spark.createDataFrame([(1, "word " * 4095)], "doc_id long, text string")
    assert [(r["length"], r["offset"]) for r in packing.pack(packing.pieces(full, queries.tokenizer_path())).collect()] == [(4096, 0)]


def test_encoder_parts_words_of_one_hash(monkeypatch):
    """Where runs share the first hash the second one tells them apart."""
    real = words.hashes
    monkeypatch.setattr(words, "hashes", lambda data, start, end, fold=words.SAME, seed=0: real(data, start, end, fold, 1) if seed else (end - start).astype(np.uint64))
    texts = ["one two six ten", "six one", "ten", "two-one", "sixty"]
    assert encoded(packing.Encoder(queries.tokenizer_path()), texts) == [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_crossover_beats_best_fit():
    """On pieces just above a third and a half of a sequence, crossover finds packings that best fit does not."""
    sizes = np.random.default_rng(1).integers(1100, 2200, 1200)
    alone = packing._fit(sizes, np.argsort(-sizes, kind="stable"), np.empty(len(sizes), np.int64), np.zeros(0, np.int64), CAPACITY)
    first = packing.evolve(sizes, [], 1, children=0)
    best = packing.evolve(sizes, [], 1)
    assert -(-sizes.sum() // CAPACITY) <= best.max() + 1 <= min(alone.max(), first.max()) - 1


def test_crossover_keeps_every_piece_once():
    pick = np.random.default_rng(1)
    sizes = pick.integers(1, 2000, 400)
    packed = [packing.evolve(sizes, [], seed) for seed in range(3)]
    best = packing.evolve(sizes, packed, 9)
    for bins in [*packed, best]:
        assert len(bins) == 400 and np.bincount(bins, sizes).max() <= CAPACITY and np.bincount(bins).min() > 0
    assert best.max() <= min(b.max() for b in packed)


def test_differencing_beats_greedy():
    pick = random.Random(2)
    weights = np.array([[pick.randrange(1, 10_000)] + [0] * 7 for _ in range(300)])
    total, turns = sharding.difference(weights)
    sums = np.zeros(8, np.int64)
    for w, t in zip(weights, turns, strict=True):
        assert sorted(t.tolist()) == list(range(8))
        sums[t[0]] += w[0]
    assert sorted(sums.tolist()) == sorted(total.tolist()) and sums.max() - sums.min() <= 20


@pytest.mark.parametrize("options", [{}, {"block": 20, "top": 3, "run": 5}])
def test_shards(spark, small, options):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [(9000, None), (9001, ""), (9002, docs[0][1]), (9002, docs[0][1]), (None, "é")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, key int, size int")
    rows = sharding.shard(df, 7, **options).collect()
    assert len(rows) == len(docs)
    texts, slots, home, sizes = dict(docs), defaultdict(list), {}, defaultdict(int)
    for r in rows:
        text = texts[r["id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        assert home.setdefault(text, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * max(sizes.values()) + (200 if options else 0)
    assert sharding.shard(df.where("false"), 7).count() == 0
