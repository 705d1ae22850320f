"""Bloom filter of a blocklist: sizing, build, probe, self-check, measured false positives, validation, base64 form.

The hash family is double FNV-1a over UTF-8 bytes with two seeds: position i of a name is (h1 + i * h2) mod 2^32 mod m, h2 odd; bits
are packed highest first. The filter of a feed is built by Spark's bitmap aggregate over its bit positions, so parts of feeds merge;
what a plan carries is one binary row of m / 8 bytes (about 1 MB for 578,000 planned names at 0.001), probed by byte offset. Its size
comes from the feed, at run time.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The hash family.
FAMILY, SEED_A, SEED_B, PRIME, MASK = "double-fnv1a-32", 0x811C9DC5, 0xCBF29CE4, 0x01000193, 0xFFFFFFFF
FPR, GROWTH = 0.001, 10


def sizing(planned: int, fpr: float = FPR) -> tuple[int, int]:
    """(bits, hashes) for `planned` names; bits are a multiple of 8."""
    if planned <= 0:
        return 256, 7
    bits = -(-math.ceil(-planned * math.log(fpr) / math.log(2) ** 2) // 8) * 8
    return bits, max(1, math.ceil(bits / planned * math.log(2)))


def planned_names(names: int, growth: int = GROWTH) -> int:
    return max(1, round(names * growth))


def fnv(data: bytes, seed: int) -> int:
    for b in data:
        seed = (seed ^ b) * PRIME & MASK
    return seed


def positions(name: str, bits: int, hashes: int) -> list[int]:
    h1, h2 = fnv(name.encode(), SEED_A), fnv(name.encode(), SEED_B) | 1
    return [((h1 + i * h2) & MASK) % bits for i in range(hashes)]


def words_of(names: Iterable[str]) -> list[int]:
    """32-bit words of the filter of a short list, for plan texts."""
    names = list(names)
    bits, hashes = sizing(planned_names(len(names)))
    words = [0] * -(-bits // 32)
    for name in names:
        for p in positions(name, bits, hashes):
            words[p // 32] |= 1 << (31 - p % 32)
    return words


@dataclass(frozen=True)
class BloomSpec:
    """A filter in its stored form."""

    m_bits: int
    k_hashes: int
    n_inserted: int
    planned_capacity: int
    bits_b64: str
    target_fpr: float = FPR
    empirical_fpr: float = 0.0
    version: int = 1
    hash_family: str = FAMILY
    fnv_offset_a: int = SEED_A
    fnv_offset_b: int = SEED_B
    fnv_prime: int = PRIME

    def checked(self) -> BloomSpec:
        """Itself, or an error where family, prime or length are not those that a probe relies on."""
        if self.hash_family != FAMILY:
            raise ValueError(f"unknown hash family {self.hash_family}")
        if self.fnv_prime != PRIME:
            raise ValueError(f"unknown FNV prime {self.fnv_prime}")
        if len(base64.b64decode(self.bits_b64)) != -(-self.m_bits // 8):
            raise ValueError("the bit array has another length than m_bits")
        return self

    def raw(self) -> bytes:
        return base64.b64decode(self.bits_b64)

    def words(self) -> list[int]:
        raw = self.raw()
        raw += bytes(-len(raw) % 4)
        return [int.from_bytes(raw[i : i + 4], "big") for i in range(0, len(raw), 4)]


def _hash(name: Column, seed: int) -> Column:
    """FNV-1a of the UTF-8 bytes of a column."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(name), F.lit(1))), lambda i: F.conv(F.hex(F.substring(F.encode(name, "UTF-8"), i, F.lit(1))), 16, 10).cast("bigint"))
    return F.when(F.octet_length(name) == 0, F.lit(seed).cast("bigint")).otherwise(F.aggregate(octets, F.lit(seed).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * PRIME).bitwiseAND(MASK)))


def with_positions(names: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """names with `positions`, the bit positions of a column."""
    name = F.lower(column)
    hashed = names.withColumn("_h", F.struct(_hash(name, SEED_A).alias("a"), _hash(name, SEED_B).bitwiseOR(F.lit(1).cast("bigint")).alias("b")))
    place = lambda i: (F.col("_h.a") + i * F.col("_h.b")).bitwiseAND(MASK) % bits
    return hashed.withColumn("positions", F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), place)).drop("_h")


#: Bits of one bitmap of Spark's bitmap aggregates.
BITMAP = 8 * 4096
#: Largest filter that is one row of a plan: 64 MB, 37 million planned names at 0.001.
MOST_BITS = 1 << 29


def bitmap_parts(names: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(bucket, bitmap): the filter in parts of 4,096 bytes, first bit highest. Parts of several lists of one size merge by `merged_parts`."""
    place = with_positions(names.select(F.lower(column).alias(column)), column, bits, hashes).select(F.explode("positions").alias("p"))
    highest_first = F.col("p").bitwiseAND(BITMAP - 8) + (7 - F.col("p") % 8)  # the aggregate counts from the lowest bit of a byte
    return place.groupBy((F.col("p") / BITMAP).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(highest_first.cast("long")).alias("bitmap"))


def merged_parts(*parts: DataFrame) -> DataFrame:
    """The parts of the union of the lists."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def joined_bits(parts: DataFrame, bits: int) -> DataFrame:
    """One row (bits), all parts in order, absent ones as zeros."""
    held = parts.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.hex("bitmap")))).alias("m"))  # bits / 8 bytes in all
    blank = F.lit("00" * (BITMAP // 8))
    digits = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit((bits - 1) // BITMAP).cast("long")), lambda b: F.coalesce(F.try_element_at("m", b), blank)), "")
    return held.select(F.substring(F.unhex(digits), 1, bits // 8).alias("bits"))


def spec_row(feed: DataFrame, column: str = "domain", fpr: float = FPR, growth: int = GROWTH) -> DataFrame:
    """The filter of a feed as a one-row table (version, hash_family, fnv_prime, m_bits, k_hashes, n_inserted, planned_capacity, target_fpr, bits).

    The driver reads the number of names only; bits are united in Spark, map side first.
    """
    names = feed.select(F.lower(column).alias(column)).where(F.col(column) != "").distinct()
    n = names.count()
    planned = planned_names(n, growth)
    bits, hashes = sizing(planned, fpr)
    if bits > MOST_BITS:
        raise ValueError(f"{bits} bits are more than a plan carries in one row ({MOST_BITS})")
    whole = joined_bits(bitmap_parts(names, column, bits, hashes), bits)
    return whole.select(F.lit(1).alias("version"), F.lit(FAMILY).alias("hash_family"), F.lit(PRIME).cast("long").alias("fnv_prime"), F.lit(bits).cast("long").alias("m_bits"), F.lit(hashes).alias("k_hashes"), F.lit(n).cast("long").alias("n_inserted"), F.lit(planned).cast("long").alias("planned_capacity"), F.lit(fpr).alias("target_fpr"), "bits")


def checked_rows(specs: DataFrame) -> DataFrame:
    """Those rows of a table of filters that a probe can rely on: family, prime and length are the expected ones, no field is null."""
    return specs.where((F.col("hash_family") == FAMILY) & (F.col("fnv_prime") == PRIME) & (F.col("m_bits") > 0) & (F.col("m_bits") % 8 == 0) & (F.col("k_hashes") > 0) & (F.octet_length("bits") * 8 == F.col("m_bits")))


#: The row of a filter that plans read.
SPEC = "spec struct<bits:binary,m:bigint,k:bigint>"


def plan_row(specs: DataFrame) -> DataFrame:
    """The one-row view (spec) that the gates of a plan read, from a stored filter."""
    return specs.select(F.struct("bits", F.col("m_bits").alias("m"), F.col("k_hashes").cast("long").alias("k")).alias("spec"))


def build(feed: DataFrame, column: str = "domain", fpr: float = FPR, growth: int = GROWTH) -> BloomSpec:
    """spec_row as an object for the stored JSON form, self-checked: no name of the feed is missed, false positives are measured."""
    names = feed.select(F.lower(column).alias(column)).where(F.col(column) != "").distinct()
    r = spec_row(feed, column, fpr, growth).first()
    spec = BloomSpec(r.m_bits, r.k_hashes, r.n_inserted, r.planned_capacity, base64.b64encode(bytes(r.bits)).decode(), fpr)
    missed = probed(names, spec, column).where("NOT hit").limit(1).count()
    if missed:
        raise RuntimeError("the filter misses a name of its own feed")
    return BloomSpec(**(spec.__dict__ | {"empirical_fpr": measured_fpr(feed.sparkSession, spec)}))


def probed(names: DataFrame, spec: BloomSpec, column: str = "domain") -> DataFrame:
    """names with `hit`: the name, or the name without www., is in the filter. An empty filter hits nothing."""
    spec.checked()
    if not spec.n_inserted or not spec.m_bits:
        return names.withColumn("hit", F.lit(False))
    spark = names.sparkSession
    held = F.broadcast(spark.createDataFrame([(bytearray(spec.raw()),)], "_bits binary"))  # one row of m / 8 bytes

    def hits(df: DataFrame, name: Column, out: str) -> DataFrame:
        probe = with_positions(df.withColumn("_name", name), "_name", spec.m_bits, spec.k_hashes).join(held)
        byte = lambda p: F.substring(F.col("_bits"), (p / 8).cast("int") + 1, F.lit(1))
        one = lambda p: F.conv(F.hex(byte(p)), 16, 10).cast("bigint").bitwiseAND(F.element_at(F.array(*(F.lit(1 << k).cast("bigint") for k in range(7, -1, -1))), (p % 8).cast("int") + 1)) != 0
        return probe.withColumn(out, F.coalesce(F.forall("positions", one), F.lit(False)) & (F.col("_name") != "")).drop("_bits", "positions", "_name")

    out = hits(hits(names, F.lower(column), "_own"), F.regexp_replace(F.lower(column), r"^www\.", ""), "_bare")
    return out.withColumn("hit", F.coalesce(F.col("_own") | F.col("_bare"), F.lit(False))).drop("_own", "_bare")


def measured_fpr(spark: SparkSession, spec: BloomSpec, probes: int = 1000) -> float:
    """Share of made-up names outside the feed that hit."""
    made = spark.range(probes).select(F.concat(F.lit("probe-"), F.sha2(F.col("id").cast("string"), 256).substr(1, 16), F.lit(".invalid")).alias("domain"))
    return probed(made, spec).agg(F.avg(F.col("hit").cast("int"))).first()[0]


def short_list_row(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """plan_row of the filter of a short list."""
    names = list(names)
    bits, hashes = sizing(planned_names(len(names)))
    raw = b"".join(w.to_bytes(4, "big") for w in words_of(names))[: bits // 8]
    return spark.createDataFrame([((bytearray(raw), bits, hashes),)], SPEC)


#: Bits a planned name, at FPR.
RATE = -math.log(FPR) / math.log(2) ** 2


def sized(d, feed: str) -> str:
    """feed(host), sz(n, m, k), placed(host, places): a feed's distinct names, the filter's size by their number, and their bit positions."""
    fnv = lambda seed: d.fold(d.codes("host"), f"CAST({seed} AS BIGINT)", "h", "b", f"({d.xor('h', 'b')} * {PRIME}) & {MASK}")
    m = f"CASE WHEN n = 0 THEN 256 ELSE {d.div(f'CAST(ceil(n * {GROWTH} * CAST({RATE!r} AS DOUBLE)) AS BIGINT) + 7', '8')} * 8 END"
    k = f"CASE WHEN n = 0 THEN 7 ELSE greatest(1, CAST(ceil(CAST(m AS DOUBLE) / (n * {GROWTH}) * CAST({math.log(2)!r} AS DOUBLE)) AS BIGINT)) END"
    return (
        f"feed AS (SELECT DISTINCT lower(host) AS host FROM ({feed}) feed0 WHERE host <> ''), sz AS (SELECT n, m, CAST({k} AS BIGINT) AS k FROM (SELECT n, CAST({m} AS BIGINT) AS m FROM (SELECT count(*) AS n FROM feed) sz0) sz1), "
        f"hashed AS (SELECT host, {fnv(SEED_A)} AS h1, {fnv(SEED_B)} | 1 AS h2, (SELECT m FROM sz) AS m, (SELECT k FROM sz) AS k FROM feed), placed AS (SELECT host, {d.map(d.seq('0', 'k - 1'), 'i', f'((h1 + i * h2) & {MASK}) % m')} AS places FROM hashed)"
    )


def filter_words(d, feed: str) -> str:
    """(words, m, k) of a feed's filter as one query of the oracle: 32-bit words, first bit highest."""
    own = f"SELECT DISTINCT pos FROM ({d.unnest('places', 'placed', 'host', 'pos')})"
    return f"WITH {sized(d, feed)}, set_bits AS (SELECT pos // 32 AS no, sum(1::BIGINT << (31 - pos % 32)) AS word FROM ({own}) GROUP BY no), nos AS (SELECT unnest(generate_series(0, (SELECT (m - 1) // 32 FROM sz))) AS no) SELECT list(CAST(coalesce(word, 0) AS BIGINT) ORDER BY nos.no) AS words, (SELECT m FROM sz) AS m, (SELECT k FROM sz) AS k FROM nos LEFT JOIN set_bits ON nos.no = set_bits.no"
