"""SimHash near-duplicate groups found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  Three differing bits leave at
least two of the segments with at most one differing bit each.  Every 23-bit word
lies within three bits of exactly one codeword of the perfect Golay code, so a
segment decodes to one of 4096 codeword indices, and a segment with all its one-bit
neighbours to a handful.  A fingerprint is filed under the index pair of each two
segments and looked up under the pairs of the neighbourhoods; that meets every
fingerprint within three bits.  Hits are verified on the whole fingerprint.

Fingerprints stand for all their copies, so copies never meet as pairs, and a bucket
gives a spanning forest of its links rather than the links.  Very full buckets are
cut into tiles that lie in different tasks.

``similarity`` adds links beyond three bits, for texts whose five-word shingles agree
to that share: then every fingerprint is filed under all pairs it looks up, which
meets most pairs of that similarity, and a 128-bit fingerprint of the distinct
five-word shingles, which travels with the first, estimates it.  With ``verified``
these meetings only say which fingerprints may belong together: inside such a family
the shingle sets themselves are compared, each with each, and only pairs whose sets
agree to the share, or whose fingerprints lie within three bits, are links.

Defined results: null and empty texts have fingerprint zero and link like others;
a text of fewer words than a shingle is one shingle; component ids ignore null doc
ids and are null where no id is reachable; repeated rows share their group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.contact import connected_components
from ..session import materialize
from .common import col, fresh

SHINGLE = 3
MAX_BITS = 3
# Segments of the fingerprint: first bit and width, at most 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
# Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
TILE_ROWS = 20_000  # filed fingerprints of one bucket that one task holds against lookups
# Shingles and 64-bit lanes of the fingerprint that verifies similarity.
SIMILAR_SHINGLE, LANES = 5, ("w0", "w1")
SIMILARITY = 0.8
FAMILY_ROWS = 1024  # half the fingerprints whose shingle sets one task holds at once
FILTER_BITS = 1 << 23  # of the filter that spares most texts outside families a shuffle
SMALL = 8  # rows of a bucket that are compared by shifting whole batches
CELLS = 1 << 22  # comparisons held in memory at once
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of an ASCII-lowered text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        joined, n = [b" ".join(words)], 1
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(size))))
        n = len(words) - size + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    if n < 512:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0)
    else:  # eight bits of every byte lane at a time, in runs that a lane can count
        padded = np.zeros(-(-n // 255) * 255, np.uint64)
        padded[:n] = hashes
        ones = np.empty(64, np.int64)
        for bit in range(8):
            lanes = ((padded >> np.uint64(bit)) & _LANES).reshape(-1, 255).sum(1, dtype=np.uint64)
            ones[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones.astype(np.int64) > n, bitorder="little").view(np.uint64)[0])


def _remix(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of hashes, another function for every lane."""
    h = hashes + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def similarity_lanes(text: str | None) -> list[int]:
    """Majority bits of the distinct five-word shingles, 64 a lane."""
    hashes = np.unique(shingle_hashes(text, SIMILAR_SHINGLE))
    return [majority(_remix(hashes, k)) for k in range(len(LANES))]


def similar_bits(similarity: float) -> int:
    """Lane bits in which two sets of that Jaccard similarity are expected to differ."""
    return round(64 * len(LANES) * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def with_fingerprints(
    docs: DataFrame, keep: list[str], size: int = SHINGLE, lanes: bool = False
) -> tuple[DataFrame, str]:
    """The kept columns and the fingerprint as a signed 64-bit number.

    With ``lanes`` it is a struct of the fingerprint and its lanes.
    """
    out = fresh(docs, "fingerprint")
    kept = F.struct(*[col(docs, c) for c in keep])
    frame = docs.select(kept.alias("row"), F.col("text").cast("string").alias("text"))

    names = ("fp", *LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.empty((b.num_rows, len(names) if lanes else 1), np.uint64)
            for row, t in zip(marks, b.column(1)):
                row[0] = majority(shingle_hashes(t.as_py(), size))
                if lanes:
                    row[1:] = similarity_lanes(t.as_py())
            cols = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in marks.T]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.StructArray.from_arrays(cols, names) if lanes else cols[0]], names=["row", out]
            )

    long = T.LongType()
    kind = T.StructType([T.StructField(n, long) for n in names]) if lanes else long
    schema = T.StructType([frame.schema["row"], T.StructField(out, kind)])
    return frame.mapInArrow(run, schema).select("row.*", out), out


def _golay() -> np.ndarray:
    """Error pattern of every syndrome: all patterns of up to three bits have their own."""
    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    single = [remainder(1 << k) for k in range(23)]
    errors = np.zeros(2048, np.uint32)
    for a in range(23):
        errors[single[a]] = 1 << a
        for b in range(a):
            errors[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return errors


class Golay:
    """Nearest codeword indices of 23-bit words, many at a time."""

    def __init__(self) -> None:
        self.errors = _golay()

    def index(self, words: np.ndarray) -> np.ndarray:
        """Index (the upper 12 bits) of the one codeword within three bits."""
        rest = words.astype(np.uint32)
        for k in range(22, 10, -1):
            rest = rest ^ ((rest >> np.uint32(k) & np.uint32(1)) * np.uint32(GENERATOR << (k - 11)))
        return (words.astype(np.uint32) ^ self.errors[rest]) >> np.uint32(11)

    def around(self, words: np.ndarray, width: int) -> np.ndarray:
        """Indices of each word and of its one-bit neighbours, one row per word."""
        flips = np.array([0, *(1 << k for k in range(width))], np.uint32)
        return self.index(words.astype(np.uint32)[:, None] ^ flips[None, :])


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]


def filed_keys(prints: np.ndarray, golay: Golay) -> np.ndarray:
    """The three bucket keys under which each fingerprint is filed."""
    own = [golay.index(s).astype(np.int64) for s in _segments(prints)]
    return np.stack([n << 24 | own[a] << 12 | own[b] for n, (a, b) in enumerate(PAIRS)], 1)


def lookup_keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct bucket keys where a fingerprint looks for others."""
    near = []
    for s, (_, width) in zip(_segments(prints), SEGMENTS):
        a = np.sort(golay.around(s, width).astype(np.int64), 1)
        first = np.ones(a.shape, bool)
        first[:, 1:] = a[:, 1:] != a[:, :-1]
        near.append([x[f] for x, f in zip(a, first)])
    rows, keys = [], []
    for n, (a, b) in enumerate(PAIRS):
        for row, (x, y) in enumerate(zip(near[a], near[b])):
            k = (n << 24 | x[:, None] << 12 | y[None, :]).ravel()
            keys.append(k)
            rows.append(np.full(len(k), row))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys)


def forest(filed: np.ndarray, looking: np.ndarray) -> list[tuple[int, int]]:
    """Links of at most MAX_BITS between two lists that connect what all links connect."""
    apart = looking[:, None] ^ filed[None, :]
    return spanning((np.bitwise_count(apart) <= MAX_BITS) & (apart != 0), filed, looking)


def spanning(near: np.ndarray, filed: np.ndarray, looking: np.ndarray) -> list[tuple[int, int]]:
    """Links out of ``near`` (lookup by filed; used up) that connect what all of it connects."""
    out: list[tuple[int, int]] = []
    open_filed = near.any(0)
    while open_filed.any():
        start = int(open_filed.argmax())
        open_filed[start] = False
        wave = np.array([start])
        while len(wave):  # from filed ones to lookups not yet seen, and back
            part = near[:, wave]
            rows = np.flatnonzero(part.any(1))
            out += zip(looking[rows].tolist(), filed[wave[part[rows].argmax(1)]].tolist())
            back = near[rows][:, open_filed] if len(rows) else np.zeros((0, 0), bool)
            cols = np.flatnonzero(open_filed)
            near[rows] = False
            hit = back.any(0) if len(rows) else np.zeros(len(cols), bool)
            wave = cols[hit]
            if len(wave):
                out += zip(looking[rows[back[:, hit].argmax(0)]].tolist(), filed[wave].tolist())
                open_filed[wave] = False
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in order, filed fingerprints before lookups; lookups stream past."""
    key, filed, waiting = None, [], []

    def drain() -> list[tuple[int, int]]:
        nonlocal waiting
        out: list[tuple[int, int]] = []
        if filed and waiting:
            base = np.concatenate(filed).view(np.uint64)
            ask = np.concatenate(waiting).view(np.uint64)
            step = max(1, CELLS // len(base))
            for k in range(0, len(ask), step):
                out += forest(base, ask[k : k + step])
        waiting = []
        return out

    def batch(links):
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["i", "j"]
        )

    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if not len(cols[0]):
            continue
        place = np.stack(cols[:2], 1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        links: list[tuple[int, int]] = []
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(place)]
        # Whole groups inside a batch without a filed row, or with a lone one and its
        # own lookup, hold no link.
        busy = (cols[2][starts] == 0) & (ends - starts > 2)
        busy[[0, -1]] = True
        for lo, hi in zip(starts[busy].tolist(), ends[busy].tolist()):
            here = tuple(place[lo])
            if here != key:
                links += drain()
                key, filed = here, []
            side, prints = cols[2][lo:hi], cols[3][lo:hi]
            split = int(np.searchsorted(side, 1))
            if split:
                filed.append(prints[:split])
            if split < hi - lo and filed:
                waiting.append(prints[split:])
                if sum(map(len, waiting)) * sum(map(len, filed)) > CELLS:
                    links += drain()
            if len(links) > 100_000:
                yield batch(links)
                links = []
        if links:
            yield batch(links)
    links = drain()
    if links:
        yield batch(links)


def links(prints: DataFrame) -> DataFrame:
    """(i, j) links that connect all distinct fingerprints within MAX_BITS of each other."""
    def filed(batches):
        golay = Golay()
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = filed_keys(p.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(p, 3))], names=["key", "fp"]
            )

    def looking(batches):
        golay = Golay()
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(p), 2048):
                part = p[lo : lo + 2048]
                rows, keys = lookup_keys(part.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    fp = prints.select("fp")
    base = fp.mapInArrow(filed, "key long, fp long")
    asks = fp.mapInArrow(looking, "key long, fp long")
    # A bucket of n filed fingerprints is cut into m = n / TILE_ROWS parts on both sides.
    full = base.groupBy("key").count().where(F.col("count") > TILE_ROWS).select(
        "key", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("m")
    )
    full = materialize(full, "full")
    one = F.lit(0).cast("long")
    if full.isEmpty():
        base, asks = base.withColumn("tile", one), asks.withColumn("tile", one)
    else:
        m = F.coalesce("m", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), m)
        spread = F.sequence(F.lit(0), m - 1)
        base = base.join(full, "key", "left").withColumn("own", own).withColumn(
            "part", F.explode(spread)
        ).select("key", "fp", (F.col("own") * m + F.col("part")).cast("long").alias("tile"))
        asks = asks.join(full, "key", "left").withColumn("own", own).withColumn(
            "part", F.explode(spread)
        ).select("key", "fp", (F.col("part") * m + F.col("own")).cast("long").alias("tile"))
    rows = base.select("key", "tile", F.lit(0).alias("side"), "fp").unionByName(
        asks.select("key", "tile", F.lit(1).alias("side"), "fp")
    )
    return (
        rows.repartition(F.col("key"), F.col("tile"))
        .sortWithinPartitions("key", "tile", "side")
        .mapInArrow(_link, "i long, j long")
        .distinct()
    )


def _similar(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether rows (fp, lanes) link, by the fingerprint or by the lanes."""
    bits = np.bitwise_count(a ^ b)
    return ((bits[..., 0] <= MAX_BITS) | (bits[..., 1:].sum(-1, dtype=np.int64) <= most)) & (a[..., 0] != b[..., 0])


def _link_similar(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Buckets in order: rows (key, tile, side, fp, lanes).

    A bucket of side 0 alone links within itself, a tile with rows of both sides
    between them.  A bucket may go on in further batches.
    """
    key, held, waiting = None, [], []

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both = np.stack([a, b], 1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], names=["i", "j"])

    def drain() -> pa.RecordBatch | None:
        out: list[tuple[int, int]] = []
        if held:
            base = np.concatenate(held)
            ask = np.concatenate(waiting) if waiting else base
            step = max(1, CELLS // (len(base) * base.shape[1]))
            for k in range(0, len(ask), step):
                some = ask[k : k + step]
                out += spanning(_similar(some[:, None], base[None], most), base[:, 0], some[:, 0])
        found = np.array(out, np.uint64).reshape(-1, 2)
        return pairs(found[:, 0], found[:, 1]) if len(found) else None

    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        if not len(cols[0]):
            continue
        keys, tiles, side = cols[:3]
        rows = np.stack(cols[3:], 1).view(np.uint64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        wide = ends - starts > SMALL
        wide[[0, -1]] = True
        # Narrow buckets inside the batch: all their rows against the next ones.
        group = np.repeat(np.arange(len(starts)), ends - starts)
        narrow = ~wide[group]
        for k in range(1, SMALL):
            at = np.flatnonzero(narrow[:-k] & (group[:-k] == group[k:]))
            at = at[_similar(rows[at], rows[at + k], most)]
            if len(at):
                yield pairs(rows[at, 0], rows[at + k, 0])
        for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist()):
            here = (keys[lo], tiles[lo])
            if here != key:
                if (found := drain()) is not None:
                    yield found
                key, held, waiting = here, [], []
            split = lo + int(np.searchsorted(side[lo:hi], 1))
            if split > lo:
                held.append(rows[lo:split])
            if hi > split:
                waiting.append(rows[split:hi])
    if (found := drain()) is not None:
        yield found


def similar_links(prints: DataFrame, similarity: float) -> DataFrame:
    """(i, j) links between distinct ``prints`` (fp, lanes), by fingerprint or similarity."""
    most, names = similar_bits(similarity), ["fp", *LANES]

    def keyed(batches):
        golay = Golay()
        for b in batches:
            values = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(b.num_columns)]
            for lo in range(0, len(values[0]), 2048):
                part = [v[lo : lo + 2048] for v in values]
                at, keys = lookup_keys(part[0].view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *[pa.array(p[at]) for p in part]], names=["key", *names]
                )

    def run(batches):
        return _link_similar(batches, most)

    longs = ", ".join(f"{n} long" for n in names)
    rows = prints.select(*names).mapInArrow(keyed, f"key long, {longs}")
    # A bucket of n rows is cut into m = n / TILE_ROWS parts, and each part meets each.
    full = materialize(
        rows.groupBy("key").count().where(F.col("count") > TILE_ROWS).select("key", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("m")),
        "full",
    )
    zero = F.lit(0)
    if full.isEmpty():
        dealt = rows.select("key", zero.cast("long").alias("tile"), zero.alias("side"), *names)
    else:
        m, own, part = F.coalesce("m", F.lit(1)), F.col("own"), F.col("part")
        dealt = (
            rows.join(full, "key", "left")
            .withColumn("own", F.pmod(F.xxhash64("fp"), m))
            .withColumn("part", F.explode(F.sequence(zero, m - 1)))
            .select(
                "key", (F.least(own, part) * m + F.greatest(own, part)).cast("long").alias("tile"),
                (own > part).cast("int").alias("side"), *names,
            )
        )
    return (
        dealt.repartition(F.col("key"), F.col("tile"))
        .sortWithinPartitions("key", "tile", "side")
        .mapInArrow(run, "i long, j long")
        .distinct()
    )


def set_links(prints: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions of links that connect what all true links connect.

    A true link joins sets that agree to ``similarity`` or prints within MAX_BITS.
    Sets hold distinct hashes.  Rows of the largest component are left out once all
    others have met everything: no link between two components can be missing then.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    ends = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(n), sizes)
    kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
    holders = owner[np.argsort(at, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(at, minlength=len(kinds)))]
    part, todo, out = np.arange(n), np.ones(n, bool), []
    while True:
        left = np.flatnonzero(todo & (part != np.bincount(part).argmax()))
        if not len(left):
            return out
        x = int(left[0])
        todo[x] = False
        mine = at[ends[x] : ends[x + 1]]
        runs = first[mine + 1] - first[mine]
        where = np.repeat(first[mine] - np.r_[0, np.cumsum(runs)[:-1]][: len(runs)], runs) + np.arange(runs.sum())
        both = np.bincount(holders[where], minlength=n)
        near = (both > 0) & (both >= similarity * (sizes[x] + sizes - both) - 1e-9)
        near |= np.bitwise_count(prints ^ prints[x]) <= MAX_BITS
        others, one = np.unique(part[near], return_index=True)
        out += [(x, int(y)) for p, y in zip(others, np.flatnonzero(near)[one]) if p != part[x]]
        part[np.isin(part, others)] = part[x]


def _link_sets(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, tile, fp, shingles) in order of their tiles, which may go on in further batches."""
    key, prints, sets = None, [], []

    def drain() -> pa.RecordBatch:
        fp = np.array(prints, np.int64)
        found = fp[np.array(set_links(fp.view(np.uint64), sets, similarity), np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], names=["i", "j"])

    for b in batches:
        values = b.column(3).values.to_numpy().view(np.uint64)
        ends = b.column(3).offsets.to_numpy()
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
        for k, (component, tile, fp) in enumerate(rows):
            if (component, tile) != key:
                if len(prints) > 1:
                    yield drain()
                key, prints, sets = (component, tile), [], []
            prints.append(fp)
            sets.append(values[ends[k] : ends[k + 1]].copy())
    if len(prints) > 1:
        yield drain()


def _components(found: DataFrame) -> DataFrame:
    """(fp, component) of every fingerprint with a link."""
    edges = materialize(found.select(F.lit(0).alias("name"), "i", "j"), "links")
    ends = edges.select("name", F.explode(F.array("i", "j")).alias("part_idx")).distinct()
    return connected_components(ends, edges).select(F.col("part_idx").alias("fp"), "component")


def verified_links(prints: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(i, j) links between ``prints`` (fp, lanes) that hold on shingle sets or within MAX_BITS.

    ``texts`` has (fp, text) of all rows.  A family is what ``similar_links`` connect;
    one of n fingerprints is cut into m = n / FAMILY_ROWS parts, and each two meet in
    a tile of their own.
    """
    spark = prints.sparkSession
    families = materialize(_components(similar_links(prints, similarity)), "families")
    slot = F.pmod(F.xxhash64("fp"), F.lit(FILTER_BITS))
    words = families.select(F.floor(slot / 8).alias("at"), (slot % 8).cast("int").alias("bit")).groupBy("at").agg(
        F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in words.toLocalIterator():  # no more than FILTER_BITS / 8 rows
        bits[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            seen, prints_, sets = set(), [], []
            for k in rows.tolist():
                one = (b.column(0)[k].as_py(), b.column(1)[k].as_py())
                if one not in seen:
                    seen.add(one)
                    prints_.append(one[0])
                    sets.append(np.unique(shingle_hashes(one[1], SIMILAR_SHINGLE)).view(np.int64))
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints_, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["fp", "shingles"],
            )

    size = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / FAMILY_ROWS).cast("int").alias("m"))
    many = families.join(size, "component")
    sets = texts.select("fp", "text", slot.alias("slot")).mapInArrow(shingles, "fp long, shingles array<bigint>")
    # Texts of one fingerprint are one class: the smallest set stands for it.
    sets = sets.join(many, "fp").groupBy("fp", "component", "m").agg(F.min("shingles").alias("shingles"))
    own, part, m = F.col("own"), F.col("part"), F.col("m")
    tiled = (
        sets.withColumn("own", F.pmod(F.xxhash64("fp"), m))
        .withColumn("part", F.explode(F.sequence(F.lit(0), m - 1)))
        .where((m == 1) | (own != part))
        .select("component", (F.least(own, part) * m + F.greatest(own, part)).cast("long").alias("tile"), "fp", "shingles")
    )

    def run(batches):
        return _link_sets(batches, similarity)

    return (
        tiled.repartition(F.col("component"), F.col("tile"))
        .sortWithinPartitions("component", "tile")
        .mapInArrow(run, "i long, j long")
        .distinct()
    )


def groups(prints: DataFrame, similarity: float | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``prints`` (fp, least: smallest doc id) with component_id, one row per fingerprint.

    With a ``similarity``, ``prints`` also carries the lanes; with ``texts`` (fp, text)
    its links are verified.
    """
    if similarity is None:
        found = links(prints)
    elif texts is None:
        found = similar_links(prints, similarity)
    else:
        found = verified_links(prints, texts, similarity)
    parts = _components(found)
    whole = materialize(
        prints.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "parts"
    )
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    return whole.join(least, "component").select("fp", "least", "component", "component_id")


def _grouped(
    docs: DataFrame, keep: list[str], size: int, similarity: float | None = None, verified: bool = False
) -> tuple[DataFrame, str, DataFrame]:
    """Kept columns with fingerprints, written once; and the group of every fingerprint.

    Texts of one fingerprint are one class; the smallest lanes among them stand for it.
    """
    marked, name = with_fingerprints(docs, keep, size, similarity is not None)
    marked = materialize(marked, "prints")
    fp, least = F.col(name), F.min(F.col("doc_id")).alias("least")
    if similarity is None:
        return marked, name, groups(materialize(marked.groupBy(fp.alias("fp")).agg(least), "distinct"))
    prints = marked.groupBy(fp["fp"].alias("fp")).agg(least, F.min(F.struct(*[fp[n] for n in LANES])).alias("lanes"))
    prints = materialize(prints.select("fp", "least", "lanes.*"), "distinct")
    marked = marked.withColumn(name, fp["fp"])
    texts = marked.select(F.col(name).alias("fp"), F.col("text").cast("string").alias("text")) if verified else None
    return marked, name, groups(prints, similarity, texts)


def near_duplicates(docs: DataFrame, keep: list[str], size: int = SHINGLE) -> tuple[DataFrame, str]:
    """Kept columns with a struct (fp, least, component, component_id) for every row."""
    marked, name, found = _grouped(docs, keep, size)
    found = found.select(F.struct("*").alias(fresh(marked, "group")))
    at = found.columns[0]
    return marked.join(found, F.col(name) == F.col(at)["fp"]).drop(name), at


def keep_one(docs: DataFrame, similarity: float | None = SIMILARITY, verified: bool = False) -> DataFrame:
    """One document of each group, all columns: the one with the smallest doc id.

    Groups hold what links within three bits or, unless ``similarity`` is null, by the
    similarity of five-word shingles: as the lanes estimate it, or with ``verified`` as
    the shingle sets have it.

    Among repeated rows of that id, and in groups without any id, the smallest row
    by all columns stays.  Texts are shuffled once: rows meet the chosen ids, and the
    choice among repeated rows keeps that partitioning.
    """
    marked, name, found = _grouped(docs, docs.columns, SHINGLE, similarity, verified)
    chosen = found.where(F.col("least").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min(F.struct("fp", "least")).alias("c")
    ).select(F.struct("c.*").alias(fresh(marked, "chosen")))
    at = chosen.columns[0]
    c, fp, doc = F.col(at), F.col(name), F.col("doc_id")
    least = F.min(F.struct(*[F.col("`" + x.replace("`", "``") + "`") for x in docs.columns])).alias("row")
    named = marked.where(doc.isNotNull()).join(chosen, (fp == c["fp"]) & (doc == c["least"]))
    nameless = marked.where(doc.isNull()).join(chosen.where(c["least"].isNull()), fp == c["fp"])
    return named.groupBy(fp, doc).agg(least).select("row.*").unionByName(
        nameless.groupBy(fp).agg(least).select("row.*")
    )
