"""N-gram Jaccard join over a token-group matrix.

Sets of word shingles are joined at a Jaccard threshold, exactly:

1. Equal sets are collapsed: one class, named by a 128-bit digest of its shingles, stands for all copies.
2. Two similar sets share one of their first few shingles in any fixed order (`needed` of them must be common). The order is
   by hash, with frequent shingles put last; frequency comes from counts over all documents in a fixed number of hash
   buckets, so its size does not grow with the corpus. Any such order is right; this one is fast.
3. Similar sets form groups: those with the same least shingle and about the same size, cut into parts of bounded size. The token-group matrix holds,
   for each group, the union of its members' first shingles, as rows (token, group).
4. The common tokens of two groups bound the overlap of any two of their sets; groups that can't qualify are not opened. Of
   opened groups the whole token unions bound each set's overlap once more, and only sets that pass are compared. An opening
   gives a spanning forest of its links.
5. Components come from label propagation with pointer jumping over the links.

Nothing is capped: groups are parts of bounded size, and all pairs of parts that share a token are opened. Tokens, classes and least
shingles that hold many rows are dealt out by salt or joined by broadcast. Empty sets link with nothing. Null text is empty, null
ids keep a row (their own component is null), repeated rows are copies, and an id with several texts takes part with each of them.
Shingles are compared by 64-bit hashes: a collision counts two different shingles as one, which can move the similarity of a pair at the
threshold; among 10^9 different shingles about one pair in 10^10 of them collides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, id_text, joined_split, staged

BUCKETS, CHUNK = 1 << 24, 1 << 18
_SHIFT = np.uint64(40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none an empty set.

    Bytes are lower-cased and split at white space in the ASCII sense: A-Z only, and \\x20, \\x09 to \\x0D only.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(max(1, len(h) - k + 1), min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return _distinct(out)


def needed(n: int | np.ndarray, percent: int):
    """Least overlap of a set of size n with any similar set."""
    return -(-n * percent // 100)


def _per_batch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for a in range(0, len(batch), 512):
            part = batch.slice(a, 512)
            yield part.column(0), [shingles(t, k) for t in part.column(1).to_pylist()]


def _versions(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray], pa.Array]]:
    for batch in batches:
        for a in range(0, len(batch), 512):
            part = batch.slice(a, 512)
            yield part.column(0), [shingles(t, k) for t in part.column(1).to_pylist()], part.column(2)


def frequent_buckets(docs: DataFrame, k: int) -> np.ndarray:
    """Hash buckets with far more shingles than usual in all documents, as a table of BUCKETS booleans.

    Every task counts its shingles per bucket (up to 255) and gives out what it met twice or more, which leaves out most chance meetings; these
    counts of all tasks are added up, chunk by chunk, and a bucket counts as frequent above three times the usual sum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(BUCKETS, np.uint8), [], 0

        def flush() -> None:
            found, n = np.unique(np.concatenate(held) >> _SHIFT, return_counts=True)
            found = found.astype(np.int64)
            counts[found] = np.minimum(counts[found] + n, 255)

        for _, sets in _per_batch(batches, k):
            held += sets
            size += sum(map(len, sets))
            if size > 1 << 20:
                flush()
                held.clear()
                size = 0
        if held:
            flush()
        for c in range(BUCKETS // CHUNK):
            own = counts[c * CHUNK : (c + 1) * CHUNK]
            at = np.flatnonzero(own > 1)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], names=["chunk", "buckets", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(*(x.to_pylist() for x in batch.columns)):
                own = sums.setdefault(c, np.zeros(CHUNK, np.int32))
                own[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.uint8)
        for c, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(own > 3 + 3 * own.mean()).tobytes()], pa.binary())], names=["chunk", "frequent"])

    counted = id_text(docs).mapInArrow(count, "chunk int, buckets binary, counts binary").repartition(BUCKETS // CHUNK, "chunk")
    table = np.zeros(BUCKETS, bool)
    for r in counted.mapInArrow(add, "chunk int, frequent binary").collect():  # BUCKETS bits in all
        table[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.unpackbits(np.frombuffer(r.frequent, np.uint8)).astype(bool)
    return table


def signatures(docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, version, n, digest, first, prefix, rare): hash of the text, set size, 128-bit set digest, least shingle, the first shingles in the common order, and how many of those are not frequent."""
    packed = np.packbits(hot).tobytes()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for ids, sets, versions in _versions(batches, k):
            digests, prefixes, rare = [], [], []
            for s in sets:
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                last = hot[(s >> _SHIFT).astype(np.int64)]
                first = np.concatenate([s[~last], s[last]]) if last.any() else s
                prefixes.append(first[: len(s) - needed(len(s), percent) + 1 if len(s) else 0].view(np.int64))
                rare.append(min(len(prefixes[-1]), len(s) - int(last.sum())))
            sizes = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, versions, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([int(x.view(np.int64)[0]) if len(x) else None for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(rare, pa.int32())], names=["doc_id", "version", "n", "digest", "first", "prefix", "rare"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(sign, "doc_id long, version long, n long, digest binary, first long, prefix array<long>, rare int")


def group_of(sets: DataFrame, tokens: int, members: int) -> DataFrame:
    """sets (digest, n, first) with `grp`: least shingle, size to 2 percent, part number; about `tokens` shingles and `members` sets at most.

    `sets` is read several times: pass a written table. Few least shingles need parts; those of many sets are joined by broadcast.
    """
    sets = sets.withColumn("band", F.floor(F.log("n") / math.log(1.02)))  # like sizes keep the bounds between groups sharp
    sets = sets.withColumn("first", F.xxhash64("first", "band"))
    sizes = staged(sets.groupBy("first").agg(F.count("*").alias("sets"), F.greatest(F.ceil(F.sum("n") / tokens), F.ceil(F.count("*") / members)).alias("parts")), "firsts")
    total = sizes.agg(F.sum("sets")).first()[0] or 0
    placed = joined_split(sets, sizes, ["first"], F.col("sets"), total)
    return placed.withColumn("grp", F.xxhash64("first", F.pmod(F.xxhash64("digest"), "parts"))).drop("sets", "parts")


#: A token shared by more groups than this is dealt out to several tasks.
SHARED = 512


def token_matrix(grouped: DataFrame) -> DataFrame:
    """(token, grp, band, groups) of tokens that several groups share. grouped: (grp, band, prefix, rare).

    A token outside the frequent buckets has few rows, so they are counted where they meet. Frequent ones are counted before the shuffle,
    and those with a large share of the rows get their count by broadcast.
    """
    tokens = grouped.select(F.posexplode("prefix").alias("at", "token"), "grp", "band", "rare")
    some = tokens.where("at < rare").select("token", "grp", "band").repartition("token").distinct()
    some = some.withColumn("groups", F.count("*").over(Window.partitionBy("token"))).where("groups > 1")
    many = staged(tokens.where("at >= rare").select("token", "grp", "band").distinct(), "frequent")
    counts = many.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    return some.unionByName(joined_split(many, counts, ["token"], F.col("groups"), many.count()).select(*some.columns))


def candidate_groups(grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a <= b, of groups that may hold similar sets; a = b for groups of two sets and more. grouped: (grp, n, band, prefix, rare).

    The matrix has the rows (token, group); tokens of one group only are dropped before it meets itself, and a token of many groups
    meets itself in several parts. For sets x of one and y of the other group, with c common tokens: the last prefix token of one,
    say x, is not after the other's, so x has at most c + n(x) - |prefix(x)| shingles in common with y, and percent / (100 + percent)
    of both sizes are needed. Groups for which this can't hold for any sizes they have, either way round, are no candidates.
    """
    ranges = grouped.groupBy("grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("sets"))
    matrix = staged(token_matrix(grouped), "matrix").withColumn("parts", F.ceil(F.col("groups") / SHARED).cast("int"))
    apart = math.ceil(math.log(100 / percent) / math.log(1.02)) + 1  # bands farther apart hold no similar sizes
    left = matrix.withColumn("part", F.pmod(F.xxhash64("grp"), "parts").cast("int")).alias("l")
    right = matrix.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("r")
    common = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.grp") < F.col("r.grp")) & (F.abs(F.col("l.band") - F.col("r.band")) <= apart)).groupBy(F.col("l.grp").alias("a"), F.col("r.grp").alias("b")).agg(F.count("*").alias("c"))
    sized = common.join(ranges.select(F.col("grp").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), "a").join(ranges.select(F.col("grp").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb")), "b")
    fits = (F.col("la") * percent <= F.col("hb") * 100) & (F.col("lb") * percent <= F.col("ha") * 100)

    def bound(x: str, y: str):  # 100 (100 + percent) (c + 1 + percent n(x) / 100) > 100 percent (n(x) + n(y)), largest x and smallest y
        return 100 * (100 + percent) * (F.col("c") + 1) + percent * (100 + percent) * F.col(x) >= 100 * percent * (F.col(x) + F.col(y))

    across = sized.where(fits & (bound("ha", "lb") | bound("hb", "la"))).select("a", "b")
    own = ranges.where(F.col("sets") > 1).select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    return across.unionByName(own)


class _Opened:
    """An opened group: its sets and its token union with the sets of each token."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        flat = flat[order]
        self.starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.union = flat[self.starts]
        self.counts = np.diff(self.starts, append=len(flat))

    def similar(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members similar to the query; members are looked at only if the union holds enough of its shingles."""
        at = np.searchsorted(self.union, query)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == query)]
        n = len(query)
        if len(at) < needed(n, percent):
            return at[:0]
        counts = self.counts[at]
        stops = np.cumsum(counts)
        rows = np.arange(stops[-1]) + np.repeat(self.starts[at] - stops + counts, counts)
        common = np.bincount(self.owner[rows], minlength=len(self.sizes))
        return np.flatnonzero(common * 100 >= percent * (n + self.sizes - common))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the components of the edges (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


#: Bits of the table of wanted documents per wanted set, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 26


def wanted_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(digest, shingles binary) of the classes whose representative's doc_id is in wanted (doc_id), and of some more.

    A table of bits, sized by the number of wanted documents up to 8 MB, tells most other documents apart in the scan, so that their texts are
    neither cut up nor shuffled. Where it lets others through, the join by digest drops them.
    """
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (BITS_EACH * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(bit.alias("bit")).selectExpr("CAST(bit div 64 AS INT) AS word", "shiftleft(1L, CAST(bit % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()  # at most MOST_BITS / 64 numbers
    packed = table.tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(packed, np.uint64)
        for batch in batches:
            place = batch.column(1).to_numpy().astype(np.int64)
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for a in range(0, len(batch), 512):
                sets = [s for t in batch.column(0).slice(a, 512).to_pylist() if len(s := shingles(t, k))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    return docs.where("doc_id is not null").select("text", bit.alias("bit")).mapInArrow(cut, "digest binary, shingles binary")


def open_groups(pairs: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int, tokens: int = 1 << 20, sets: int = 4096) -> DataFrame:
    """Links (a, b) between classes, a spanning forest per opening. members: (digest, doc_id, grp, n); pairs and members are written tables.

    Groups around the same smallest neighbour are opened together, so that families of copies are shipped once; such a bundle has at
    most `tokens` shingles and `sets` sets, else its groups stay alone. Pairs of groups in different bundles are opened pair by pair.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = staged(both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("rows")), "near")
    beside = joined_split(both, near, ["b"], F.col("rows"), near.agg(F.sum("rows")).first()[0] or 0)
    near = beside.groupBy(F.col("a").alias("grp")).agg(F.min("label").alias("label"))
    sizes = members.groupBy("grp").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).join(near, "grp")
    fitting = sizes.groupBy("label").agg(F.sum("tokens").alias("tokens"), F.sum("sets").alias("sets")).where((F.col("tokens") <= tokens) & (F.col("sets") <= sets)).select("label", F.lit(True).alias("fits"))
    homes = staged(sizes.join(fitting, "label", "left").select("grp", F.when(F.col("fits"), F.col("label")).otherwise(F.col("grp")).alias("home")), "homes")
    chosen = staged(members.join(homes, "grp").select("digest", "doc_id", "grp", "home"), "chosen")
    opened = staged(chosen.drop("doc_id").join(wanted_sets(docs, chosen.select("doc_id"), k).dropDuplicates(["digest"]), "digest"), "opened")

    def read(value: pa.Scalar) -> tuple[list[bytes], list[np.ndarray]]:
        rows = value.values
        return rows.field("digest").to_pylist(), [np.frombuffer(v, np.uint64) for v in rows.field("shingles").to_pylist()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for i in range(len(batch)):
                names, own = read(batch.column(1)[i])
                right, shift = own, 0
                if batch.num_columns == 3:
                    more, right = read(batch.column(2)[i])
                    names, shift = names + more, len(own)
                group = _Opened(right)
                found = [group.similar(q, percent) for q in own]
                links += [(names[x], names[y]) for x, y in _forest(np.repeat(np.arange(len(own)), [len(f) for f in found]), np.concatenate(found) + shift)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    entry = F.collect_list(F.struct("digest", "shingles"))
    within = opened.groupBy("home").agg(entry.alias("x")).where(F.size("x") > 1).mapInArrow(compare, "a binary, b binary")
    side = {c: homes.select(F.col("grp").alias(c), F.col("home").alias(f"h{c}")) for c in "ab"}
    apart = staged(pairs.join(side["a"], "a").join(side["b"], "b").where("ha <> hb").select("a", "b"), "apart")
    needed_groups = apart.select(F.explode(F.array("a", "b")).alias("grp")).distinct()
    groups = opened.join(needed_groups, "grp", "left_semi").groupBy("grp").agg(entry.alias("sets"))
    rows = apart.join(groups.select(F.col("grp").alias("a"), F.col("sets").alias("x")), "a").join(groups.select(F.col("grp").alias("b"), F.col("sets").alias("y")), "b")
    across = rows.select(F.lit(0).alias("_"), "x", "y").mapInArrow(compare, "a binary, b binary")
    return within.unionByName(across).where("a <> b")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. links (a, b) should be a written table.

    Every round each node takes the smallest label around it, then its label's label; labels are written each round, so a
    round costs two aggregations over the links and recovery never goes back further than one.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        # Root hooking: the old label itself learns the smallest label any of its nodes has seen.
        hooked = step.groupBy(F.col("label").alias("node")).agg(F.min("new").alias("root"))
        jump = step.join(hooked.withColumnRenamed("node", "label"), "label").select("node", "label", F.least("new", "root").alias("new"))
        nxt = jump.join(jump.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        nxt = staged(nxt, "labels")
        changed = nxt.where(F.col("new") < F.col("label")).limit(1).count()
        labels = nxt.select("node", F.col("new").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))


def classed(docs: DataFrame, k: int, percent: int, group_tokens: int, group_sets: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, version, n, digest) of every row, and (digest, copies, root, component) of every class: its component's least digest and smallest doc_id."""
    docs = id_text(docs)
    signed = staged(signatures(docs, k, percent, frequent_buckets(docs, k)), "signatures")
    filled = signed.where("n > 0 and doc_id is not null")
    one = F.min_by(F.struct("first", "prefix", "rare"), "doc_id").alias("_s")  # the same for all rows of a class
    classes = staged(filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n").alias("n"), one).select("digest", "doc_id", "copies", "n", "_s.*"), "classes")
    sets = staged(group_of(classes, group_tokens, group_sets), "sets")
    pairs = staged(candidate_groups(sets.select("grp", "n", "band", "prefix", "rare"), percent), "pairs")
    links = staged(open_groups(pairs, sets.select("digest", "doc_id", "grp", "n"), docs, k, percent), "edges")
    components = connected_components(links)
    named = sets.select("digest", "doc_id", "copies").join(components.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    named = staged(named, "named")
    least = staged(named.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")), "least")
    total = least.agg(F.sum("members")).first()[0] or 0
    final = joined_split(named, least, ["component"], F.col("members"), total).select("digest", "copies", F.col("component").alias("root"), F.col("least").alias("component"))
    return signed.select("doc_id", "version", "n", "digest"), staged(final, "final")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, group_tokens: int = 1 << 16, group_sets: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text), exactly."""
    rows, final = classed(docs, k, percent, group_tokens, group_sets)
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = joined_split(rows.where("n > 0 and doc_id is not null"), final, ["digest"], F.col("copies"), rows.count())
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(alone)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of its smallest doc_id, and all rows without words or without id; rows equal in id and text count
    once. All columns are kept as they are, whatever their names."""
    rows, final = classed(docs, k, percent, 1 << 16, 256)
    linked = joined_split(rows.where("n > 0 and doc_id is not null"), final, ["digest"], F.col("copies"), rows.count())
    chosen = linked.where("doc_id = component").groupBy("root").agg(F.min("doc_id").alias("id"), F.min("version").alias("version")).select("id", "version")
    chosen = staged(chosen.unionByName(rows.where("n = 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "version").distinct()), "chosen")
    own, version = free_name("id", docs.columns), free_name("version", docs.columns)
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(version, F.xxhash64(F.col("text").cast("string"))).withColumn(own, F.col("doc_id").cast("long"))
    kept = named.join(chosen.toDF(own, version), [own, version], "left_semi").dropDuplicates([own, version])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(F.col("doc_id").isNull()))


#: The components as SQL (all pairs that share a shingle; for small tables).
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - {k} + 1), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
