"""The toxicity learner recomputed in plain Python, and operators on clashing column names, equal ids and other integer types."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veriscore.llm import bpe_stream, flac, jaccard, packing, token_counts, token_files, toxicity
from veriscore.llm.registry import BYTE_BPE, WORD_BPE
from veriscore.llm.toxicity import Lexicon, entries, fold, learn_lexicon, training_rows


def plain_rows(docs, labels):
    """(text, toxic) of labelled rows outside the held-out third, one of each least three-word shingle and label."""
    toxic = {}
    for i, y in labels:
        toxic[i] = max(y, toxic.get(i, 0))
    best = {}
    for i, text in docs:
        if i in toxic and zlib.crc32(str(i).encode()) % 3 != 1:
            w = fold(text or "").split()
            sketch = min(zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2)))
            key = (sketch, toxic[i])
            if key not in best or i < best[key][0]:
                best[key] = (i, text)
    return [(text, y) for (_, y), (_, text) in best.items()]


def plain_learner(rows, size=4096):
    """Weights, learned exceptions and the logistic's coefficients by counting and by gradient descent's fixed point."""
    pos, neg = Counter(), Counter()
    n = [0, 0]
    for text, y in rows:
        n[y] += 1
        (pos if y else neg).update(entries(fold(text or "")))
    weights = {}
    for e in sorted(pos, key=lambda e: (len(e), e)):
        if pos[e] < 5 or pos[e] * 4 < neg[e]:
            continue
        w = math.log((pos[e] + 0.5) / (n[1] + 1)) - math.log((neg[e] + 0.5) / (n[0] + 1))
        shorter = max((weights.get(e[:k], 0.0) for k in range(5, len(e))), default=0.0)
        if w >= 1.5 and w / math.sqrt(1 / (pos[e] + 0.5) + 1 / (neg[e] + 0.5)) >= 4 and w > shorter + 0.5:
            weights[e] = w
    bare, seen, bad = Lexicon(weights), Counter(), set()
    for text, y in rows:
        w = fold(text or "").split()
        if bare.hits(fold(text or ""))[1]:
            for phrase in {f" {a} {b} " for a, b in zip(w, w[1:])}:
                if bare.hits(phrase)[1]:
                    seen[phrase] += 1
                    bad |= {phrase} if y else set()
    exceptions = {p for p, k in seen.items() if k >= 5 and p not in bad}
    return weights, exceptions


def gradient(beta, x, y, ridge=1e-2):
    x = np.hstack([np.ones((len(x), 1)), x])
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return x.T @ (y - p) - np.array([1e-6, *[ridge] * (x.shape[1] - 1)]) * beta


def test_learning_equals_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = learn_lexicon(docs, labels)
    rows = plain_rows([tuple(r) for r in docs.join(labels, "doc_id", "left_semi").collect()], [(r.doc_id, r.toxic) for r in labels.collect()])
    weights, exceptions = plain_learner(rows)
    assert weights and got.weights.keys() == weights.keys() and all(abs(got.weights[e] - w) < 1e-9 for e, w in weights.items())
    assert set(got.exceptions) == exceptions
    x = np.array([got.features(text) for text, _ in rows])
    y = np.array([float(label) for _, label in rows])
    assert np.abs(gradient(np.array(got.beta), x, y)).max() < 1e-5  # the penalised likelihood is at its top


def test_training_rows_of_equal_ids(spark):
    a, b = "some words of a first text here", "quite another text with other words"
    docs = spark.createDataFrame([(0, a), (0, b), (0, b), (7, a)], "doc_id int, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (7, 1)], "doc_id int, toxic int")
    assert not {i for i in (0, 7) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sorted(map(tuple, training_rows(docs, labels, 100).collect())) == sorted([(a, 1), (b, 1)])


@pytest.mark.parametrize("kind", ["int", "smallint"])
def test_ids_of_other_integer_types(spark, kind):
    docs = spark.createDataFrame([(1, "a text of words"), (2, None), (None, "x")], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "'x' as _id", "1 as sequence_id")
    lexicon = Lexicon({" words ": 1.0})
    made = [token_counts.token_counts(docs, BYTE_BPE), packing.pack_documents(docs, BYTE_BPE), bpe_stream.encode_decode_digest(docs, WORD_BPE), flac.flac_column(docs), toxicity.toxicity_scores(docs, lexicon), jaccard.jaccard_components(docs, 4, 85)]
    for df in made:
        assert {r.doc_id for r in df.collect()} == {1, 2, None}


def test_files_of_int_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b")] * 50, "doc_id int, text string")
    token_files.write_token_files(docs, f"{tmp_path}/f", BYTE_BPE, block_tokens=8)
    assert token_files.read_token_files(spark, f"{tmp_path}/f").count() == 100


def test_one_of_each_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "_v_e_r", "_id", "_version", "id", "version", "digest", "component", "ID2"]
    text = "one two three four five six seven"
    rows = [(i, text, 9, i, "v", 3, 4, 5, 6, 7) for i in (4, 2, 3)] + [(2, text, 9, 2, "v", 3, 4, 5, 6, 7), (None, "x", 1, 1, "v", 1, 1, 1, 1, 1), (8, None, 9, 9, "v", 3, 4, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _v_e_r long, _id long, _version string, id long, version long, digest long, component long, ID2 long")
    got = jaccard.one_of_each(docs)
    assert got.columns == names and got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
