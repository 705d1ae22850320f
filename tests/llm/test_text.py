"""Toxicity, streaming BPE, quality rules, FLAC and the Jaccard join on odd rows and against plain versions."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veriscore.llm import flac
from veriscore.llm.bpe_stream import WordEncoder, decode, decode_documents, encode_decode_digest, encode_documents, sufficient_lookahead
from veriscore.llm.common import staged
from veriscore.llm.jaccard import connected_components, jaccard_components, one_of_each, shingles
from veriscore.llm.quality import SQL, keep_good, quality_features, quality_table
from veriscore.llm.registry import WORD_BPE, op4_toxicity, op5_bpe_stream, op7_quality_rules, op8_flac_column, op9_jaccard_join
from veriscore.llm.toxicity import Lexicon, drop_toxic, fold, learn_lexicon, toxicity_scores

ODD = [None, "", " ", "one", "a b", "a b c", "A B C D", "a b c d", "x " * 3000, "word\n\nword\nword \n word", "é ü 你好 <|endoftext|> I'LL", "\x1c \x85 \0", "näive ΑΣ", "tie tie", "tie tie"]
SCHEMA = "doc_id long, text string, source string, lang string, n_words string, host string"
ROWS = [(i, t, "src" if i % 2 else None, "en", "clash", None) for i, t in enumerate(ODD)] + [(3, "one", None, None, None, None), (None, "no id", None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Toxicity


def labelled(spark, n=600):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeionrst", k=6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w, bad = rng.choices(words, k=60), i % 4 == 0
        if bad:
            w[5], w[20] = rng.choice(["grobulous", "Gr0bulous", "zwickel" + rng.choice(words)]), "zwickelmann"
        elif i % 4 == 1:
            w[9:11] = ["zwickel", "cake"]
        docs.append((i, " ".join(w), "src", i))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, toxic long"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_folding():
    assert fold("1D10T, ІDIОT! 2024") == " idiot idiot 2024 "
    assert fold("") == "  " and fold("st00pid").strip() == "stoopid"


def test_lexicon_matches_and_spares():
    x = Lexicon({" clown ": 2.0, " zwick": 1.0}, (" clown fish ",), (-3.0, 4.0, 0.0, 0.0))
    assert x.hits(fold("a Clown, and zwickel")) == (3.0, 2, 4)
    assert x.hits(fold("clown fish and clowns"))[1] == 0
    assert x.score("clown") > 0.7 > x.score("clown fish") and 0 <= x.score(None) <= 1 and Lexicon({}).score("x") == 0.0


def test_learns_on_training_rows_only(spark):
    docs, labels = labelled(spark)
    model = learn_lexicon(docs, labels)
    rows = {r.doc_id: r for r in toxicity_scores(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(r.predicted == int(i % 4 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    poisoned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert learn_lexicon(docs, poisoned) == model
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 4 for r in kept.collect()} == {1, 2, 3}


def test_toxicity_odd_rows(spark, odd, sf):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (99, 1)], "doc_id long, toxic int")
    model = learn_lexicon(odd, labels)
    assert toxicity_scores(odd, model).count() == len(ROWS) and not model.weights
    assert learn_lexicon(odd.limit(0), labels.limit(0)).weights == {} and toxicity_scores(odd.limit(0), model).count() == 0
    docs, marks = labelled(spark, 300)
    model = learn_lexicon(docs, marks)
    for kind in ("long", "boolean", "double", "string"):
        assert learn_lexicon(docs, marks.selectExpr("doc_id", f"CAST(toxic AS {kind}) AS toxic") if kind != "string" else marks.selectExpr("doc_id", "CAST(toxic AS string) AS toxic")) == model


def plain_score(lexicon, text):
    """The score without an automaton: every entry is looked for at every place."""
    folded = fold(text or "")
    spared = {i for p in lexicon.exceptions for m in range(len(folded)) if folded.startswith(p, m) for i in range(m, m + len(p) - 1)}
    best = {}
    for start in (i for i, c in enumerate(folded) if c == " " and i not in spared):
        found = [w for p, w in lexicon.weights.items() if folded.startswith(p, start)]
        if found:
            best[start] = max(found)
    words = len(folded.split())
    x = (np.log1p(sum(best.values())), np.log1p(len(best)), np.log1p(1000 * len(best) / max(words, 20)))
    return 1 / (1 + np.exp(-np.clip(lexicon.beta[0] + np.dot(lexicon.beta[1:], x), -30, 30))) if lexicon.weights else 0.0


def test_toxicity_of_the_whole_table_like_a_plain_version(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has too few toxic rows for a lexicon
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model, texts = learn_lexicon(docs, labels), texts_of(spark, sf)
    rows = op4_toxicity(spark, sf).collect()
    assert len(rows) == len(texts) and model.weights
    for r in rows:
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.7)


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_lookahead_of_small_lists():
    assert sufficient_lookahead([], len) == 0
    assert sufficient_lookahead([("b", "c"), ("a", "b")], len) >= 1  # whether ab is made depends on the c after it
    with pytest.raises(ValueError):
        sufficient_lookahead([("a", "bc"), ("ab", "c")], len)


def test_bpe_like_library(spark, odd, library, sf):
    rng = random.Random(3)
    long = ["".join(rng.choices("aehinorst", k=3000)) for _ in range(3)] + ["ab" * 2000, "é" * 900]
    texts = ODD + long + list(texts_of(spark, sf).values())[:60]
    import pyarrow as pa

    ids, at = WordEncoder(WORD_BPE).encode(pa.array(texts))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want
        for step in (1, 7, 5000):
            assert "".join(decode(WORD_BPE, want, step=step)) == library.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r for r in encode_decode_digest(odd, WORD_BPE).collect()}
    want = library.encode(ODD[10], add_special_tokens=False).ids
    assert rows[10].n_tokens == len(want) and rows[10].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert rows[10].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert rows[0].n_tokens == 0 and rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(odd, WORD_BPE), WORD_BPE).collect()}
    assert back[6] == "a b c d "
    assert encode_decode_digest(odd.limit(0), WORD_BPE).count() == 0
    texts, rows = texts_of(spark, sf), {r.doc_id: r for r in op5_bpe_stream(spark, sf).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# Quality


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, sf):
    got = sorted((r.doc_id is not None, r.doc_id or 0, *r[1:6]) for r in quality_table(odd).collect())
    assert got == sorted((i is not None, i or 0, *plain_quality(t)) for i, t, *_ in ROWS)
    assert not any(r.kept for r in quality_table(odd).collect() if r.base_failed)
    assert quality_table(odd.limit(0)).count() == 0 and keep_good(odd).columns == odd.columns
    clash = odd.selectExpr("*", "1 AS _words", "2 AS _host", "3 AS _kept", "4 AS _row", "5 AS n", "6 AS `dotted.name`")
    assert sorted(map(repr, keep_good(clash).select(odd.columns).collect())) == sorted(map(repr, keep_good(odd).collect())) and keep_good(clash).columns == clash.columns
    assert "_base_failed" in quality_features(odd).columns
    rows = sorted(map(tuple, op7_quality_rules(spark, sf).collect()))
    assert rows == sorted(duckdb.sql(SQL.format(documents=f"'{sf}/documents.parquet'")).fetchall())


def test_hosts_decide(spark):
    text = " ".join(f"w{i}" for i in range(60))
    table = " ".join(f"w{i} |" for i in range(60))
    rows = [(i, table if i < 20 else text, "tables" if i < 20 else f"h{i % 5}") for i in range(200)] + [(900, table, "h1")]
    kept = {r.doc_id: r.kept for r in quality_table(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept[50] and not kept[900]


# FLAC


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    payloads = [flac.pad(b) for b in (b"", b"a", bytes(576), b"ab" * 5000, rng.integers(0, 256, 3000, np.uint8).tobytes(), bytes(range(256)) * 30, ("x é 你 " * 30_000).encode())]
    streams = flac.encode_payloads(payloads)
    assert flac.decode_streams(streams) == payloads
    assert [((flac.decode_any(s) + flac.CENTRE) % 256).astype(np.uint8).tobytes() for s in streams] == payloads
    for at in (len(streams[3]) // 3, len(streams[3]) // 2, len(streams[3]) - 1):
        broken = bytearray(streams[3])
        broken[at] ^= 0x10
        with pytest.raises((ValueError, IndexError)):
            flac.decode_streams([bytes(broken)])


def test_flac_linear_predictor():
    """A hand-made frame of quantised linear prediction with two Rice partitions, one escaped, read by the plain path."""
    x = [3, 5]
    residual = [1, -2, 0, 4, -1, 3, -3, 2, 1, 0, -1, 2, 2, -2, 1, 1, 0, 0, 3, -4] * 10
    residual = residual[:190]
    for r in residual:
        x.append(r + ((2 * x[-1] - x[-2]) >> 1))
    bits = "0" + "100001" + "0" + "".join(f"{v & 0xFFFF:016b}" for v in x[:2]) + "0011" + "00001" + f"{2 & 15:04b}{-1 & 15:04b}" + "00" + "0001"
    fold_ = lambda v: v << 1 if v >= 0 else (-v << 1) - 1
    bits += "0001" + "".join("0" * (fold_(v) >> 1) + "1" + str(fold_(v) & 1) for v in residual[:94]) + "1111" + "00100" + "".join(f"{v & 15:04b}" for v in [min(7, max(-8, v)) for v in residual[94:]])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x10, 0x08, 0])
    crc = lambda b, t, n: int(flac.crc_rows(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), t, n)[0])
    frame = head + bytes([crc(head, flac.CRC8, 8)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += crc(frame, flac.CRC16, 16).to_bytes(2, "big")
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 15 << 36 | 192).to_bytes(8, "big") + bytes(16)
    assert flac.decode_any(b"fLaC\x80\x00\x00\x22" + info + frame).tolist() == x


def test_streams_of_other_encoders_are_read_with_own_ones():
    raw = bytes(range(192))
    crc = lambda b, t, n: int(flac.crc_rows(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), t, n)[0])
    head = bytes([0xFF, 0xF8, 0x10, 0x02, 0])
    frame = head + bytes([crc(head, flac.CRC8, 8), 0x02]) + bytes((b - flac.CENTRE) & 255 for b in raw)
    frame += crc(frame, flac.CRC16, 16).to_bytes(2, "big")
    other = b"fLaC\x80\x00\x00\x22" + (192).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 192).to_bytes(8, "big") + bytes(16) + frame
    own = flac.pad(b"own text " * 200)
    assert flac.read_streams([*flac.encode_payloads([own]), other, *flac.encode_payloads([flac.pad(b"")])]) == [own, raw, flac.pad(b"")]
    assert flac.read_streams([]) == [] and [n for n, _ in flac.blocks_of(own)] == list(range(0, len(own), 576))
    with pytest.raises((ValueError, IndexError)):
        flac.read_streams([other[:-9] + b"x" + other[-8:]])


def test_quantised_predictors_are_written_and_read_at_once():
    """Slow waves are coded by quantised linear predictors; both readers agree, and a stream's bytes do not depend on its batch."""
    t = np.arange(576 * 40)
    rng = np.random.default_rng(4)
    waves = [((60 * np.sin(t / f) + 30 * np.sin(t / 3.1 + f) + rng.normal(0, 2, len(t))).astype(np.int64) + flac.CENTRE & 255).astype(np.uint8).tobytes() for f in (2.3, 7.7, 40.0)]
    payloads = [*waves, flac.pad(b"words and more words " * 300), bytes(576 * 3)]
    streams = flac.encode_payloads(payloads)
    low = [bytes(i // (7 + j) + flac.CENTRE & 255 for i in range(576)) for j in range(9)]  # a batch of low orders alone
    assert all(flac.decode_streams(flac.encode_payloads([p])) == [p] for p in [*payloads, *low])
    assert flac.decode_streams(streams) == payloads and streams == [flac.encode_payloads([p])[0] for p in payloads]
    kinds = set()
    for p, s in zip(payloads, streams):
        assert ((flac.decode_any(s) + flac.CENTRE) % 256).astype(np.uint8).tobytes() == p
        data, (_, at) = np.frombuffer(s, np.uint8), flac._layout(s)
        starts = flac.frame_starts(data, np.array([at]), np.array([len(s)]), np.array([len(p) // 576]))
        kinds |= {int(data[a + 5 + flac.LEADS[data[a + 4]]] >> 1) for a in starts}
    assert any(k >= 32 for k in kinds)


def test_flac_table_values(spark, sf):
    texts = texts_of(spark, sf)
    media = {r.doc_id: bytes(r.media) for r in flac.flac_column(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in op8_flac_column(spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        x = [b - 128 for b in payload]
        feature = f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};peak={max(map(abs, x))}"
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest(), feature)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want


def test_flac_rows(spark, odd, sf):
    media = flac.flac_column(odd)
    written = staged(flac.pcm_blocks(media, 2), "pcm")
    rows = {r.doc_id: r for r in flac.media_digest(written).collect()}
    payload = flac.pad(ODD[10].encode())
    assert rows[10].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[10].tail_crc32 == zlib.crc32(payload[-32:]) and rows[10].n_bytes == len(ODD[10].encode())
    assert rows[13][2:] == rows[14][2:] and rows[0].payload_bytes == 576
    blocks = sorted(flac.pcm_blocks(media.where("doc_id = 8")).collect(), key=lambda r: r.block)
    assert b"".join(r.pcm for r in blocks) == flac.pad(ODD[8].encode()) and [r.first_sample for r in blocks] == [576 * r.block for r in blocks]
    assert flac.media_digest(flac.pcm_blocks(flac.flac_column(odd.limit(0)))).count() == 0
    whole = flac.pad(ODD[8].encode())
    for first, length in ((0, 1), (570, 20), (1151, 700), (len(whole) - 5, 50), (0, len(whole))):
        found = flac.pcm_range(written.where("doc_id = 8"), F.lit(first), length).collect()
        assert [(r.first_sample, bytes(r.pcm)) for r in found] == [(first, whole[first : first + length])]
    assert flac.pcm_range(written.where("doc_id = 8"), F.lit(len(whole)), 9).count() == 0
    broken = written.withColumn("pcm", F.when(F.col("doc_id") == 8, F.concat(F.lit(b"?"), F.expr("substring(pcm, 2, n_samples - 1)"))).otherwise(F.col("pcm")))
    with pytest.raises(Exception, match="bad block"):
        flac.media_digest(broken).collect()
    with pytest.raises(Exception, match="blocks are missing"):
        flac.media_digest(written.where("doc_id != 8 or block = 0")).collect()
    texts = texts_of(spark, sf)
    assert all(r.payload_sha256 == hashlib.sha256(flac.pad(texts[r.doc_id].encode())).hexdigest() for r in op8_flac_column(spark, sf).collect())


def test_flac_blocks_of_one_part_lie_beside_the_streams(spark, sf, tmp_path):
    """PCM blocks of a part of the files take the place of those of the part before; every row is in one part."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(8).write.option("compression", "none").parquet(f"{tmp_path}/documents.parquet")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/*"))
    rows = op8_flac_column(spark, str(tmp_path)).collect()
    made = set(glob.glob(f"{shared}/*")) - before
    count = lambda kind, where: [spark.read.parquet(f).where(where).count() for f in made if os.path.basename(f).startswith(kind)]
    files = [len(glob.glob(f"{f}/part-*")) for f in made if os.path.basename(f).startswith("media-")]
    assert files[0] > 1 and count("media-", "true") == [docs.count()] and 0 < sum(count("pcm-", "block = 0")) <= docs.count() * 2 // 3
    media = flac.flac_column(docs)
    assert sorted(rows) == sorted(flac.media_digest(staged(flac.pcm_blocks(media, flac.SEEK), "whole")).collect())
    assert flac.digest_in_parts(staged(media.limit(0), "none")).count() == 0


# Jaccard


def plain_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        near = {j for g in s for j in inverted[g]}
        for g in s:
            inverted[g].append(i)
        for j in near:
            c = len(s & sets[j])
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_components(spark, rows, k, percent, **sizes):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, **sizes).collect()}
    assert got == plain_components(rows, k, percent)
    return got


def test_jaccard_near_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=120)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(160):  # near copies of one text, some of copies of it
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + i, " ".join(w)))
    passage = rng.choices(words, k=60)
    rows += [(400 + i, " ".join(rng.choices(words, k=40) + passage)) for i in range(120)] + [(600 + i, " ".join(base)) for i in range(40)]
    found = check_components(spark, rows, 4, 85)
    assert max(Counter(c for _, c in found.values()).values()) > 40
    check_components(spark, rows, 4, 85, group_tokens=500, group_sets=3)
    check_components(spark, rows[:60], 5, 80)


def test_jaccard_small_cases(spark, odd, sf):
    assert len(shingles("A  b\tc\x0bd e", 4)) == 2 and (shingles("A b c d", 4) == shingles("a b\nc d", 4)).all() and len(shingles("a b", 4)) == 1
    assert jaccard_components(odd.limit(0)).count() == 0 and jaccard_components(odd).count() == len(ROWS)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (60, 50)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(links).collect()} == {(i, 0) for i in range(41)} | {(50, 50), (51, 50), (60, 50)}
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[3] == 1 and kept.where("doc_id = 14").count() == 0
    rows = list(texts_of(spark, sf).items())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard_join(spark, sf).collect()} == plain_components(rows, 4, 85)


def test_an_id_with_two_texts_links_both(spark):
    rng = random.Random(5)
    a, b = ([f"{side}{rng.randrange(10**6)}" for _ in range(80)] for side in "ab")
    near = lambda w: " ".join([*w[:40], "changed", *w[41:]])
    rows = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "alone " * 9)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(rows).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert {(r.doc_id, r.text[:1]) for r in one_of_each(rows).collect()} == {(1, "a"), (1, "b"), (4, "a")}


def test_hot_tokens_are_dealt_out(spark, monkeypatch):
    from veriscore.llm import common, jaccard

    monkeypatch.setattr(jaccard, "SHARED", 2)
    monkeypatch.setattr(common, "HOT", 20)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30))])) for i in range(150)] + [(500 + i, " ".join(passage)) for i in range(50)]
    check_components(spark, rows, 4, 60, group_tokens=200, group_sets=4)


def test_pipeline_against_plain_version(spark, sf):
    import corpus_pipeline

    from veriscore.llm.registry import BYTE_BPE

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality_table(docs).where("kept").collect()}
    step = docs.where(docs.doc_id.isin(sorted(good)))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = {r.doc_id for r in toxicity_scores(step, learn_lexicon(step, labels)).where("predicted = 0").collect()}
    texts = texts_of(spark, sf)
    single = sorted(i for i, (_, c) in plain_components([(i, texts[i]) for i in sorted(good & clean)], 5, 80).items() if i == c)
    byte = Tokenizer.from_file(BYTE_BPE)
    want = {i: len(byte.encode(texts[i], add_special_tokens=False).ids) + 1 for i in single}
    rows = corpus_pipeline.run(spark, sf).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want and len(want) > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
