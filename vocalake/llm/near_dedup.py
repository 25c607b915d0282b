"""Near-duplicate components by banded MinHash, odd sketches and confirmation on full shingle sets."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected

SHINGLE = 5
ROWS = 4
MISS = 4e-7
SAMPLE = 1_024
SKETCH_BITS = 2_048
PERCENT = 85
CACHE = 200_000
SHINGLES_AT_ONCE = 50_000
FEW = 64
BLOCK = 2_048
AT_ONCE = 16

# An odd 64-bit multiplier to mix bits.
MIX = np.uint64(0x9E3779B97F4A7C15)


def band_count(percent: int) -> int:
    """The fewest bands of ROWS rows that a pair of exactly ``percent`` misses with a probability of MISS or less."""
    miss = 1 - (percent / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log(miss)) if miss > 0 else 1


def row_factors(bands: int) -> np.ndarray:
    """Odd 64-bit multipliers, one per MinHash row; more bands only add to them."""
    draws = np.random.default_rng(20_240_601).integers(1, 2 ** 63, bands * ROWS, np.uint64)
    return draws * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    values = (values ^ (values >> np.uint64(29))) * MIX
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of a text, A-Z lower-cased.

    Words end at space and the ASCII controls 9 to 13. Fewer words than five are one shingle; no words
    give the empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    last = len(codes) - width + 1
    value = np.full(last, width, np.uint64)
    for i in range(width):
        value = mixed(value) + codes[i:i + last]
    return np.unique(mixed(value))


def band_keys(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key per band of MinHash rows; equal rows give equal keys, and bands never share a key."""
    bands = len(factors) // ROWS
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), SHINGLES_AT_ONCE):
        least = np.minimum(least, (shingles[lo:lo + SHINGLES_AT_ONCE, None] * factors).min(0))
    rows = least.reshape(bands, ROWS)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key) + rows[:, i]
    return mixed(key).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash sample: the SAMPLE smallest mixed hashes each flip one bit.

    The bits in which two sketches differ are at most the elements in which the samples differ, and
    nearly as many where these are few against SKETCH_BITS.
    """
    order = mixed(shingles + MIX)
    if len(order) > SAMPLE:
        order = np.partition(order, SAMPLE - 1)[:SAMPLE]
    place = (order * MIX) >> np.uint64(64 - (SKETCH_BITS.bit_length() - 1))
    return np.packbits(np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signatures(docs: DataFrame, id_column: str, text_column: str, percent: int) -> DataFrame:
    """``id, n, digest, bands, sketch`` of each document; no bands and no sketch for empty sets."""
    factors = row_factors(band_count(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        none = np.empty(0, np.int64)
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), hashes)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(found, factors) if len(found) else none)
                sketches.append(odd_sketch(found) if len(found) else none)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                lists(bands, pa.int64()), lists(sketches, pa.int64()),
            ], ["id", "n", "digest", "bands", "sketch"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, id_column: str, text_column: str, wanted: DataFrame) -> DataFrame:
    """``id, shingles`` of the documents whose id is in ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(value.as_py(), hashes).view(np.int64) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(sets, pa.int64())], ["id", "shingles"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, shingles array<long>")


def may_link(n: Column, sketch: Column, other_n: Column, other_sketch: Column, percent: int = PERCENT) -> Column:
    """False only where two sets are surely below the similarity.

    Sets up to SAMPLE shingles are sampled whole, so more differing bits than differing shingles allowed
    rule a pair out for certain. For larger sets the bound leaves six standard deviations of the sample.
    """
    flipped = sum(
        (F.bit_count(sketch[i].bitwiseXOR(other_sketch[i])) for i in range(SKETCH_BITS // 64)), F.lit(0)
    )
    large, small = F.greatest(n, other_n), F.least(n, other_n)
    shared = (n + other_n) * (percent / (100 + percent))
    sampled = F.least(n, F.lit(SAMPLE)) + F.least(other_n, F.lit(SAMPLE))
    share = F.least(F.lit(1.0), shared / large)
    noise = 6 * F.sqrt(SAMPLE * share * (1 - share)) + 12
    allowed = F.when(large <= SAMPLE, sampled - 2 * shared).otherwise(sampled - 2 * (share * SAMPLE - noise))
    return (100 * small >= percent * large) & (flipped <= allowed + 1e-6)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the similarity."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("shingles").alias(f"{name}_set"))

    shared = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", shared).filter(
        100 * F.col("shared") >= percent * (F.size("a_set") + F.size("b_set") - F.col("shared"))
    ).select("a", "b")


def flips_allowed(n: np.ndarray, other_n: np.ndarray, percent: int) -> np.ndarray:
    """The differing bits up to which ``may_link`` keeps a pair, by the same formula."""
    large, shared = np.maximum(n, other_n), (n + other_n) * (percent / (100 + percent))
    sampled = np.minimum(n, SAMPLE) + np.minimum(other_n, SAMPLE)
    share = np.minimum(1.0, shared / large)
    noise = 6 * np.sqrt(SAMPLE * share * (1 - share)) + 12
    return np.where(large <= SAMPLE, sampled - 2 * shared, sampled - 2 * (share * SAMPLE - noise)) + 1e-6


def sketched_block(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (stray, member) of one block that may link: other component, size and sketch near enough.

    Both sides are ordered by size, so a slice of strays meets only the members of a size that can link.
    """
    n = block.column("n").to_numpy().astype(np.int64)
    stray = block.column("stray").to_numpy(zero_copy_only=False)
    order = np.argsort(n, kind="stable")
    strays, members = order[stray[order]], order[~stray[order]]
    ids, main = block.column("id").to_numpy(), block.column("main").to_numpy()
    component = block.column("component").to_numpy()
    lists_ = block.column("sketch").combine_chunks()
    sketch = lists_.flatten().to_numpy().reshape(-1, SKETCH_BITS // 64)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for lo in range(0, len(strays), AT_ONCE):
        left = strays[lo:lo + AT_ONCE]
        first = np.searchsorted(100 * n[members], percent * n[left[0]], "left")
        last = np.searchsorted(percent * n[members], 100 * n[left[-1]], "right")
        right = members[first:last]
        a, b = left[:, None], right[None, :]
        flipped = np.bitwise_count(sketch[a] ^ sketch[b]).sum(2, dtype=np.int64)
        near = (flipped <= flips_allowed(n[a], n[b], percent)) & (
            100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        near &= (component[a] != component[b]) & ((component[b] == main[b]) | (ids[b] < ids[a]))
        i, j = np.nonzero(near)
        found.append((left[i], right[j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def candidates(open_members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components under one key that size and sketch let through.

    ``open_members`` holds ``key, id, component, main, n, sketch``. Every member outside the largest
    component of a key meets all its members. Keys of up to FEW members are joined; larger ones are dealt
    in blocks of about BLOCK members by BLOCK strays, so the tasks of a hot key grow in number and not in
    size, and only the pairs let through leave a block.
    """
    is_stray = F.col("component") != F.col("main")
    fans = open_members.groupBy("key").agg(F.count("*").alias("members"), F.count_if(is_stray).alias("strays"))
    sized = open_members.join(fans, "key").withColumn("stray", is_stray)

    few = sized.filter(F.col("members") <= FEW)
    left = few.filter("stray").select("key", *[F.col(c).alias(f"stray_{c}") for c in ("id", "component", "n", "sketch")])
    joined = few.join(
        left,
        (few["key"] == left["key"]) & (F.col("component") != F.col("stray_component"))
        & ((F.col("component") == F.col("main")) | (F.col("id") < F.col("stray_id")))
        & may_link(F.col("n"), F.col("sketch"), F.col("stray_n"), F.col("stray_sketch"), percent),
    ).select(F.col("stray_id").alias("a"), F.col("id").alias("b"))

    def blocks(count: str) -> Column:
        return F.ceil(F.col(count) / BLOCK)

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("id", "key"), blocks(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks(count) - 1))

    many = sized.filter(F.col("members") > FEW)
    columns = ["key", "id", "component", "main", "n", "sketch"]
    dealt = many.select(
        *columns, F.lit(False).alias("stray"), own("members").alias("member_block"), every("strays").alias("stray_block")
    ).unionByName(many.filter("stray").select(
        *columns, F.lit(True).alias("stray"), every("members").alias("member_block"), own("strays").alias("stray_block")))
    kind = open_members.schema["id"].dataType.simpleString()

    def run(block: pa.Table) -> pa.Table:
        a, b = sketched_block(block, percent)
        ids = block.column("id")
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    spread = dealt.groupBy("key", "member_block", "stray_block").applyInArrow(run, f"a {kind}, b {kind}")
    return joined.unionByName(spread).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Documents link where their sets of five-word shingles have a Jaccard similarity of ``percent`` or
    more, and components are those of the link graph. Equal sets are one class, so copies cost one row
    each. Candidates are classes that share a key of a MinHash band. First each member of a band key is
    compared with one member of it, chosen by a hash that differs from key to key; then, under keys that
    still hold several components, every member outside the largest one is compared with all members of
    other components, in blocks of bounded size (``candidates``). That leaves no candidate between components unseen, while members of one component
    are not paired again. Odd sketches rule candidates out before full sets are fetched; each link is
    confirmed on full sets of 64-bit shingle hashes. The bands follow from ``percent`` (20 at 85, 28 at 80): a pair of exactly
    that similarity shares no band with a probability below 10^-6.

    The smallest id reachable names the component and is kept. Null and empty texts have no shingles, link
    with nothing and are their own component. Rows without an id get a null component and are kept; rows
    that repeat an id are one node and get the same component. Other columns are ignored; an empty table
    gives no rows.
    """
    signed = stored(signatures(docs, id_column, text_column, percent))
    solid = signed.filter("n > 0 AND id IS NOT NULL")
    classes = stored(solid.groupBy("digest", "n").agg(F.min("id").alias("class_id")))
    heads = stored(
        solid.join(classes.select("class_id"), F.col("id") == F.col("class_id"), "left_semi").dropDuplicates(["id"])
    )
    keyed = heads.select("id", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = stored(keyed.join(crowded, "key"))
    traits = stored(heads.select("id", "n", "sketch").join(members.select("id").distinct(), "id", "left_semi"))
    sets = stored(shingle_sets(docs, id_column, text_column, traits.select("id")).dropDuplicates(["id"]))

    def sketched(pairs: DataFrame) -> DataFrame:
        for name in ("a", "b"):
            pairs = pairs.join(traits.select(
                F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch")
            ), name)
        return pairs.filter(
            may_link(F.col("a_n"), F.col("a_sketch"), F.col("b_n"), F.col("b_sketch"), percent)
        ).select("a", "b")

    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("order"), "id")).alias("hub"))
    to_hub = members.join(hubs, "key").filter("id <> hub.id").select(
        F.col("hub.id").alias("a"), F.col("id").alias("b")
    ).distinct()
    links = confirmed(sketched(to_hub), sets, percent)
    found = stored(connected(links))

    placed = members.join(found, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("members"))
    mixed_keys = shares.groupBy("key").agg(
        F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("components")
    ).filter("components > 1").select("key", "main")
    open_members = stored(placed.join(mixed_keys, "key").join(traits, "id"))
    across = candidates(open_members, percent)
    late = confirmed(across, sets, percent)
    final = connected(late.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    return (
        signed.select("id", "n", "digest").join(classes, ["digest", "n"], "left")
        .join(final, F.col("class_id") == F.col("node"), "left")
        .select(
            "id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
