"""Rendezvous shards, vector codes and resampling against plain Python on odd rows, and their queries' SQL on the small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from veriscore.llm import registry, resampling, sharding, vector_codes
from veriscore.llm.common import free_name
from veriscore.llm.resampling import bucket_counts, combined, draw, features, resample, word_crcs
from veriscore.llm.sharding import assign_shards, moved, shard_documents, write_shards
from veriscore.llm.vector_codes import Codebooks, bounded_scan, first_scan, groups_of, reconstruct, vector_codes as fit, with_label_error

ODD = ["", None, "one two three", "one two three", "Größe 你好 x1 X1", "a,b;c", " ", "word " * 60, "x" * 300 + " " + "é" * 90, "\x7fz\x80a", "tab\tline\nend", "a" * 48 + " " + "b" * 49]
DOCS = [(i, t, "s", 1, "r") for i, t in enumerate(ODD * 3)] + [(5, "same", "s", 1, "r")] * 40 + [(None, "no id", None, None, None), (None, None, None, None, None)]
SCHEMA = "doc_id int, text string, shard string, slot int, rank string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(5)


def plain_shard(key, weights):
    def score(i):
        digits = hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13]
        return weights[i] / -math.log((int(digits, 16) + 0.5) / 2**52)

    return max((i for i, w in enumerate(weights) if w > 0), key=lambda i: (score(i), -i))


def test_shards_of_odd_rows(docs):
    rows = shard_documents(docs, [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == len(DOCS) and sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in DOCS)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in DOCS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == plain_shard(r.doc_id, [1.0] * 4) and r.grown_shard in (r.shard, 4)
        slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32)))
    for group in slots.values():
        assert [s for s, _ in sorted(group)] == list(range(len(group)))
        assert [k for _, k in sorted(group)] == sorted(k for _, k in group)


def test_weights_share_and_moves(spark):
    keys = spark.range(20_000).selectExpr("id AS doc_id", "cast(null as string) AS text")
    old, new = [1.0, 2.0, 0.0, 3.0], [1.0, 2.0, 2.0, 3.0]
    n = {r.shard: r["count"] for r in assign_shards(keys, old).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and all(abs(n[i] / 20_000 - w / 6) < 0.02 for i, w in enumerate(old) if w)
    rows = moved(keys, old, new).collect()
    assert {r.to_shard for r in rows} == {2} and abs(sum(r.n_rows for r in rows) / 20_000 - 2 / 8) < 0.02
    with pytest.raises(ValueError):
        assign_shards(keys, [0.0])


def test_hot_id_is_split_over_tasks(spark):
    rows = spark.range(40_000).selectExpr("7 AS doc_id", "'t' AS text").repartition(8)
    from veriscore.llm.common import positions, staged

    placed = positions(staged(assign_shards(rows, [1.0]), "hot"), "shard", ["doc_id"], "slot")
    assert placed.agg({"slot": "max"}).first()[0] == 39_999 and placed.select("slot").distinct().count() == 40_000


def test_written_shards_keep_all_columns(spark, docs, tmp_path):
    into = write_shards(docs, f"{tmp_path}/s", [1.0] * 3)
    assert into == "_shard" == free_name("shard", docs.columns)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(DOCS)
    assert all(r[into] == plain_shard(r.doc_id, [1.0] * 3) for r in back.collect())


def plain_codes(vectors, parts, entries, rounds, scale):
    """Integer Lloyd over all distances in Python integers."""
    rows = [[math.floor(scale * v) for v in e] for _, _, e in vectors]
    w = len(rows[0]) // parts
    cut = [[tuple(r[p * w : p * w + w]) for r in rows] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(x, book):
        return min(range(len(book)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, book[j])), j))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in cut[p]:
                members[near(x, books[p])].append(x)
            books[p] = [tuple(sum(c) // len(members[j]) for c in zip(*members[j])) if j in members else b for j, b in enumerate(books[p])]
    codes = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(cut[p][i], books[p][c[p]])) for p in range(parts)) for i, c in enumerate(codes)]
    return codes, errors, books


@pytest.mark.parametrize("spread, entries, rounds", [(0.01, 30, 2), (1.0, 30, 4), (4000.0, 64, 2)])
def test_codes_equal_plain_lloyd(spark, spread, entries, rounds):
    """Narrow spreads make mostly ties, wide ones leave no room in floats."""
    rng = np.random.default_rng(3)
    vectors = [(i, i % 3 if i % 4 else None, [float(v) for v in rng.normal(0, spread, 8)]) for i in range(300)]
    vectors += [(300 + i, 1, vectors[i][2]) for i in range(40)]
    bad = [(-1, 1, None), (-2, 1, []), (-3, 1, [1.0] * 7 + [None]), (-4, 1, [float("nan")] * 8), (-5, 1, [float("inf")] + [0.0] * 7), (900, 1, [1.0] * 4), (901, 1, [1.0] * 7)]
    df = spark.createDataFrame([(*v, "x") for v in vectors + bad], "vec_id long, label int, embedding array<double>, code string").repartition(3)
    codes, books = fit(df, 4, entries, rounds, 256)
    got = {r.vec_id: (list(r.code), r.error, r.label_error) for r in with_label_error(codes).collect()}
    want_codes, want_errors, want_books = plain_codes(vectors, 4, entries, rounds, 256)
    by_label = Counter()
    for (_, label, _), e in zip(vectors, want_errors):
        by_label[label] += e
    assert got == {i: (c, e, by_label[label]) for (i, label, _), c, e in zip(vectors, want_codes, want_errors)}
    assert books.entries.tolist() == [[list(e) for e in b] for b in want_books]
    back = {r.vec_id: r.embedding for r in reconstruct(codes, books).collect()}
    worst = max(abs(a - b) for i, _, e in vectors for a, b in zip(e, back[i]))
    assert worst <= max(np.sqrt(want_errors)) / 256 + 1 / 256 + spread * 1e-6


def test_bounds_skip_most_distances_and_stay_exact():
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 100, (40, 4))[rng.integers(0, 40, 4000)] + rng.normal(0, 8, (4000, 4))).astype(np.int64)
    book = x[:64].copy()
    groups = groups_of(book)
    assert sorted(np.concatenate(groups).tolist()) == list(range(64))
    code, lower = first_scan(x, book, groups)
    taken = []
    for _ in range(5):
        new = np.array([x[code == j].sum(0) // max(1, (code == j).sum()) if (code == j).any() else book[j] for j in range(64)])
        code, lower, n = bounded_scan(x, new, groups, np.sqrt(((new - book) ** 2).sum(1)), code, lower)
        book = new
        taken.append(n)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
    assert taken[-1] < 0.5 * len(x) * 64


def test_codes_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(2, None, [0.5] * 4), (1, None, [0.25] * 4), (1, None, [0.25] * 4)], "vec_id long, label int, embedding array<float>")
    codes, books = fit(few, 2)
    assert books.entries.shape == (2, 3, 2) and sorted((r.vec_id, list(r.code), r.error) for r in codes.collect()) == [(1, [0, 0], 0), (1, [0, 0], 0), (2, [2, 2], 0)]
    none, no_books = fit(few.where("vec_id > 9"), 2)
    assert no_books is None and with_label_error(none).count() == 0
    with pytest.raises(Exception, match="or more"):
        fit(spark.createDataFrame([(1, 1, [1e30] * 4)], "vec_id long, label int, embedding array<double>"), 2)
    assert Codebooks(np.arange(8).reshape(2, 2, 2)).sha256() == hashlib.sha256(b"0,1,2,3,4,5,6,7").hexdigest()


def words(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_crcs_of_runs_equal_those_of_strings(n):
    for a, b in ((0, len(ODD)), (2, 7), (0, 0)):
        got = defaultdict(list)
        for row, crc in features(pa.array(ODD, pa.string()).slice(a, b - a), n):
            for r, c in zip(row.tolist(), crc.tolist()):
                got[r].append(c)
        assert {i: v for i, v in got.items()} == {i: want for i, t in enumerate(ODD[a:b]) if (want := [zlib.crc32(s.encode()) for s in runs(t, n)])}
    _, _, lengths = word_crcs(pa.array(["ab é"]))
    assert lengths.tolist() == [2, 2]


def test_combination_over_long_strings():
    a, b = b"start", b"q" * 1_000_003
    assert combined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)])).tolist() == [zlib.crc32(a + b)]


def plain_resample(docs, target, n, buckets, percent, least, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(zlib.crc32(f.encode()) % buckets for f in runs(text, n))
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in runs(text, n))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        f = runs(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(x.encode()) % buckets for x in f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text)) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    chosen = fit[: percent * len(fit) // 100]
    return sorted([(*r[:4], k) for k, r in enumerate(chosen, 1)] + [(*r[:4], None) for r in fit[len(chosen) :] + [r for r in out if not r[4]]], key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_plain_python(spark, docs, n):
    target = spark.createDataFrame([("one two x1",), (None,), ("Word",)], "text string")
    got = resample(docs, target, n=n, buckets=97, percent=40, least_words=2, seed=7)
    want = plain_resample([d[:2] for d in DOCS], ["one two x1", None, "Word"], n, 97, 40, 2, 7)
    assert sorted(map(tuple, got.collect()), key=str) == want
    none = target.where("false")
    assert sorted(map(tuple, resample(docs, none, n=n, buckets=97, percent=40, least_words=2, seed=7).collect()), key=str) == plain_resample([d[:2] for d in DOCS], [], n, 97, 40, 2, 7)
    assert resample(docs.where("false"), target).count() == 0
    assert bucket_counts(none, "text", n, 5).tolist() == [0] * 5
    ids = {r[0] for r in want if r[4] is not None}
    assert {r.doc_id for r in draw(docs, target, n=n, buckets=97, percent=40, least_words=2, seed=7).collect()} == ids


@pytest.mark.parametrize("name", ["op11_rendezvous_shards", "op12_vector_codes", "op13_target_resampling"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    answer = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(answer.fetchall(), key=str) == sorted(map(tuple, registry.queries()[name](spark, sf).select(columns).collect()), key=str)
    assert sharding and resampling and vector_codes
