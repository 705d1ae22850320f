"""Token files, packing and token counts against the tokenizer called plainly."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veriscore.llm.packing import best_fit_packing, combinations, pack_documents, salts_for, token_pieces
from veriscore.llm.registry import BYTE_BPE, op1_token_files, op2_best_fit_packing, op10_token_counts
from veriscore.llm.segments import SegmentEncoder, safe_segments
from veriscore.llm.token_counts import token_counts
from veriscore.llm.token_files import pack_ids, read_token_files, unpack_ids, write_token_files

ODD = ["a  b", "  x <|endoftext|> y", "\n \n q  z", "foo<|endoftext|>", "", " ", "a \n b\0c d", None, "é  x  z  q r ", "it's  a 'll x's", "你 好 👍🏽", "x " * 3000, "y" * 5000, "a\u0085b \u001c c"]
DOCS = [(i, t, "extra", "x") for i, t in enumerate(ODD)] + [(3, "tie", "e", "x"), (3, "tie", "e", "x"), (None, "no id", None, None)]
SCHEMA = "doc_id long, text string, shard string, length string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_segments_join_and_encode(plain):
    import pyarrow as pa

    assert all("".join(safe_segments(t)) == t for t in ODD if t)
    ids, offsets = SegmentEncoder(BYTE_BPE).encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [plain(t) for t in ODD]


def test_segments_beside_marks_and_forgotten_words(plain):
    import pyarrow as pa

    texts = ["\0", "a\0b c\0 d", "a\n", "b\n\n", " . .. \n", "\n\n a", "x\xa0y z", "it's 's 12ab3 $$a", "  a  ", "ends. \0", "don't  we'll\t x", "", None]
    small = SegmentEncoder(BYTE_BPE, limit=3)
    for batch in (texts, texts[::-1], ["new words in a third batch", *texts]):
        ids, offsets = small.encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [plain(t) for t in batch]


@pytest.mark.parametrize("ids", [[], [7], [0] * 9, list(range(70_000)), [5, 5, 300, 2, 5, 65_537, 1 << 18]])
def test_control_bytes_round_trip(ids):
    a = np.array(ids, np.int64)
    assert unpack_ids(*pack_ids(a), len(a)).tolist() == ids


def test_files_of_odd_rows(spark, tmp_path, plain):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    write_token_files(docs, f"{tmp_path}/f", BYTE_BPE, block_tokens=50)
    rows = sorted(read_token_files(spark, f"{tmp_path}/f").collect(), key=lambda r: r.start)
    want = sorted(((d, t or "") for d, t, _, _ in DOCS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    for r, (d, t) in zip(rows, want, strict=True):
        ids = [*plain(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (d, at, len(ids), crc(ids), ids)
        at += len(ids)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    write_token_files(docs, f"{tmp_path}/f", BYTE_BPE)
    assert read_token_files(spark, f"{tmp_path}/f").count() == 0
    assert pack_documents(docs, BYTE_BPE).count() == token_counts(docs, BYTE_BPE).count() == 0


def test_op1_whole_table(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in sorted(op1_token_files(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*plain(docs.pop(r.doc_id)), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not docs


def packed_well(rows, capacity, plain, docs):
    bins, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append(r)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // capacity) + 1
    for d, t in docs.items():
        ids, own = [*plain(t), 0], sorted(texts[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and (r.length == capacity or r.piece == 0)
        assert sum(r.length for r in own) == len(ids)


def test_op2_whole_table(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    packed_well(op2_best_fit_packing(spark, sf).collect(), 2048, plain, docs)


def test_packing_odd_rows_and_hot_length(spark, plain):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(100 + i, "same text") for i in range(500)], "doc_id long, text string")
    pieces = token_pieces(docs, BYTE_BPE, 64).cache()
    rows = best_fit_packing(pieces, 64).collect()
    packed_well(rows, 64, plain, {r.doc_id: r.text for r in docs.collect()})
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == pieces.count()


def test_combinations_use_every_piece_once():
    rng = np.random.default_rng(3)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 100, 40), rng.integers(1, 9, 40))}
    used = defaultdict(int)
    for times, bin_ in combinations(histogram, 100):
        assert sum(bin_) <= 100
        for n in bin_:
            used[n] += times
    assert used == histogram


def test_counts(spark, sf, plain):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    want = sorted((d is not None, d or 0, len((t or "").encode()), len(plain(t)), len(plain(t)) > 512) for d, t, _, _ in DOCS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, BYTE_BPE).collect()) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op10_token_counts(spark, sf).collect()} == {d: len(plain(t)) for d, t in texts.items()}


def test_parts_of_a_length_grow_with_it():
    assert salts_for({}) == salts_for({3: 1000}) == 256
    assert all(n / salts_for({2048: n, 7: n // 3}) <= 1 << 16 for n in (10**7, 10**9, 10**11))
