import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tesselar.llm import bitplane, common, packing, tokens

from .helpers import documents, nothing, rows, thue_morse


@pytest.fixture(scope="module")
def coded():
    t = Tokenizer.from_file(tokens.vocabulary())
    return [(r[0], np.array([*e.ids, 1], np.uint32).tobytes()) for r, e in zip(rows(), t.encode_batch([r[1] or "" for r in rows()], add_special_tokens=False), strict=True)]


def test_words_end_to_end_are_texts(coded):
    texts = [(r[1] or "").encode() for r in rows()]
    ends = np.cumsum([0, *map(len, texts)])
    coder = tokens.WordIds(tokens.vocabulary(), most=1000)
    for _ in range(3):
        assert coder.pack(np.frombuffer(b"".join(texts), np.uint8), ends) == [c for _, c in coded]


def test_words_of_equal_hash_keep_their_own_ids(monkeypatch):
    t = Tokenizer.from_file(tokens.vocabulary())
    texts = [thue_morse(), thue_morse("ba"), f"x {thue_morse()} y {thue_morse('ba')}", "same same word"]
    want = [np.array([*e.ids, 1], np.uint32).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    raw, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    assert tokens.WordIds(tokens.vocabulary()).pack(raw, ends) == want
    monkeypatch.setattr(common, "word_hashes", lambda raw, starts, stops: (stops - starts).astype(np.uint64))  # nearly all words collide
    assert tokens.WordIds(tokens.vocabulary()).pack(raw, ends) == want


def test_unicode_words():
    r = random.Random(5)
    pool = [chr(c) for a, b in ((32, 127), (0xA0, 0x250), (0x300, 0x340), (0x370, 0x400), (0x4E00, 0x4E20), (0x1F600, 0x1F620), (9, 14), (0x2000, 0x2010), (0x1C, 0x20)) for c in range(a, b)]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(400)]
    t = Tokenizer.from_file(tokens.vocabulary())
    want = [np.array([*e.ids, 1], np.uint32).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    data = [x.encode() for x in texts]
    assert tokens.WordIds(tokens.vocabulary()).pack(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])) == want


@pytest.mark.parametrize(("capacity", "rows_"), [(16, 200), (64, 8), (4096, 200000)])
def test_places(spark, coded, capacity, rows_):
    got = packing.pack_documents(documents(spark), tokens.vocabulary(), capacity, keep_ids=True, group_rows=rows_).collect()
    by_sequence, whole = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == r.piece * capacity
        assert r.length == capacity or r.piece == max(x.piece for x in got if x.doc_id == r.doc_id)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.piece, bytes(r.ids)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(Counter)
    for doc_id, data in coded:
        for p in range(0, len(data), 4 * capacity):
            want[doc_id][(p // (4 * capacity), data[p : p + 4 * capacity])] += 1
    assert {k: Counter(v) for k, v in whole.items()} == want
    total = sum(len(d) // 4 for _, d in coded)
    assert len(by_sequence) <= -(-total // capacity) * 1.2 + 1


def test_best_fit_is_close_to_the_bound():
    r = random.Random(1)
    counts = Counter(min(4095, max(1, int(r.lognormvariate(6.5, 1.1)))) for _ in range(20000))
    runs, n = packing.place(dict(counts))
    used = defaultdict(int)
    for length, _, count, first, offset in runs.tolist():
        for s in range(first, first + count):
            assert used[s] == offset
            used[s] += length
    assert max(used.values()) <= 4096 and sum(used.values()) == sum(k * v for k, v in counts.items())
    assert n <= -(-sum(used.values()) // 4096) * 1.01
    assert Counter({k: sum(c for length, _, c, _, _ in runs.tolist() if length == k) for k in counts}) == counts


def test_rounds_bring_groups_together(spark, monkeypatch):
    r = random.Random(3)
    lengths = [min(63, max(1, int(r.lognormvariate(2, 1)))) for _ in range(3000)]
    made = [(i, 0, 0, n, i, None) for i, n in enumerate(lengths)]
    monkeypatch.setattr(packing, "token_pieces", lambda docs, *a: docs)
    got = packing.pack_documents(spark.createDataFrame(made, packing.PIECES), "", 64, group_rows=100).collect()
    used = Counter()
    for row in got:
        used[row.sequence_id] += row.length
    assert Counter((row.doc_id, row.length) for row in got) == Counter(enumerate(lengths)) and max(used.values()) <= 64
    _, best = packing.place(dict(Counter(n for n in lengths if n < 64)), 64)
    assert len(used) <= (best + lengths.count(64)) * 1.01  # groups of 100 pieces against one of all; production groups are 2,000 times larger


def test_pieces_that_fill_no_sequence(spark, monkeypatch):
    """Groups leave all of these open: one sweep over all sizes settles them, however many there are."""
    lengths = [40] * 700 + [23] * 300 + [25] * 50
    made = [(i, 0, 0, n, i, None) for i, n in enumerate(lengths)]
    monkeypatch.setattr(packing, "token_pieces", lambda docs, *a: docs)
    got = packing.pack_documents(spark.createDataFrame(made, packing.PIECES).repartition(5), "", 64, group_rows=30).collect()
    used, at = defaultdict(int), defaultdict(list)
    for row in got:
        used[row.sequence_id] += row.length
        at[row.sequence_id].append((row.offset, row.length))
    assert len(got) == len(lengths) and len({r.doc_id for r in got}) == len(lengths) and max(used.values()) <= 64
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) for v in at.values())
    assert len(used) == packing.place(dict(Counter(lengths)), 64)[1]


def test_query_has_the_columns_asked_for(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op2_best_fit_packing(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    stored = bitplane.op5_token_bitplanes(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in stored.schema.fields][:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert got.agg({"length": "sum"}).first()[0] == stored.agg({"n_tokens": "sum"}).first()[0]


def test_empty_tables(spark, tmp_path):
    assert packing.pack_documents(nothing(spark), tokens.vocabulary()).collect() == []
    bitplane.write_ids(nothing(spark), str(tmp_path / "none"), tokens.vocabulary())
    assert bitplane.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_blocks_round_trip():
    for n in (0, 1, 3, 65536):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert np.array_equal(bitplane.decode_block(bitplane.encode_block(ids)), ids)
    with pytest.raises(ValueError, match="not a block"):
        bitplane.decode_block(b"x" * 40)


@pytest.mark.parametrize("block", [7, 65536])
def test_streams_round_trip(spark, coded, tmp_path, block):
    out = str(tmp_path / "ids")
    bitplane.write_ids(documents(spark), out, tokens.vocabulary(), block)
    got = sorted(bitplane.read_ids(spark, out, keep_ids=True).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _ in coded), key=lambda d: (d is not None, d or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(coded)
    plain = bitplane.read_ids(spark, out).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in plain) == Counter((d, zlib.crc32(x)) for d, x in coded)
    for doc_id in (34, 1000, 1, 5555):
        assert Counter(x.tobytes() for x in bitplane.read_document(spark, out, doc_id)) == Counter(x for d, x in coded if d == doc_id)
