"""Operators 3, 4, 6, 8 and 9 against plain Python on sf0.001 and on odd rows."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row, functions as F

from sherdloom.llm import decontam, mixing, quality, sharding, simhash
from sherdloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `we.ird` string, rid long, slot long, profile long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_docs(spark, texts):
    rows = [(k, t, "en", "s", 1, "w", 7, 8, 9) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "Ä É ä", "a b", "word " * 30_000, "x y z " * 40, "x y z " * 40, "1.2 # $\n# $\n# $"]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- quality -----------------------------------------------------------------------


def quality_base(text):
    text = text or ""
    words = SPACED.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        odd_docs(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", -F.col("doc_id") - 1)
    )
    judged, at = quality.judge(docs, ["doc_id", "text"])
    rows = judged.select("text", f"{at}.*").collect()
    assert len(rows) == 200 + len(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_base(r.text)
        assert not (r.base_failed and r.kept)


def js(p, q):
    p, q = (np.array(x, float) / max(sum(x), 1e-300) for x in (p, q))
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def test_quality_distances(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged, at = quality.judge(docs, ["text", "lang"])
    rows = judged.select("text", "lang", f"{at}.*").collect()

    def chars(t):
        some = [len(re.findall(r"[ \t-\r]", t))] + [len(re.findall(c.replace(r"\[\\\\", r"\[\\"), t)) for c in quality.CLASSES]
        return [*some, len(t) - sum(some)]

    def words(t, names):
        c = Counter(SPACED.findall(t))
        return [c[n] for n in names] + [sum(c.values()) - sum(c[n] for n in names)]

    ref = defaultdict(lambda: (0, 0))
    for r in rows:
        a, b = ref[r.lang]
        ref[r.lang] = a + np.array(chars(r.text)), b + np.array(words(r.text, quality.COMMON[r.lang]))
    for r in rows:
        assert r.char_distance == pytest.approx(js(chars(r.text), ref[r.lang][0]), abs=1e-6)
        assert r.word_distance == pytest.approx(js(words(r.text, quality.COMMON[r.lang]), ref[r.lang][1]), abs=1e-6)


def test_quality_keeps_columns_and_empty(spark):
    docs = odd_docs(spark, ODD)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.where("false")).count() == 0


# --- simhash -----------------------------------------------------------------------


def brute_print(text, size=3):
    words = (text or "").translate(LOWER)
    words = SPACED.findall(words)
    if not words:
        return 0
    grams = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_groups(prints):
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(distinct, np.uint64)
    for k, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= 3):
            parent[find(distinct[j])] = find(p)
    return {p: find(p) for p in distinct}


def test_simhash_query(spark):
    docs = documents(spark)
    prints = {d: brute_print(t) for d, t in docs}
    root = brute_groups(prints.values())
    least = {}
    for d, p in sorted(prints.items()):
        least.setdefault(root[p], d)
    got = QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, f"{p:016x}", least[root[p]]) for d, p in prints.items())


def planted_prints(n, seed, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = [int(b) for b in base]
    for b in base[: n // 2]:
        x = int(b)
        for bit in rng.choice(64, flips, replace=False):
            x ^= 1 << int(bit)
        out.append(x)
    return out


@pytest.mark.parametrize("flips", [1, 2, 3, 4])
def test_links_find_all_within_three_bits(spark, flips):
    prints = sorted(set(planted_prints(400, flips, flips)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(s, k) for k, s in enumerate(signed)], "fp long, least long")
    got = {r.fp: r.component_id for r in simhash.groups(frame).collect()}
    root = brute_groups(prints)
    least = {}
    for k, p in enumerate(prints):
        least.setdefault(root[p], k)
    assert got == {s: least[root[p]] for s, p in zip(signed, prints)}


def test_full_buckets_are_tiled(spark, monkeypatch):
    """Hundreds of fingerprints in one bucket, cut into tiles, give the same groups."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    monkeypatch.setattr(simhash, "CELLS", 64)
    rng = np.random.default_rng(5)
    prints = sorted({int(rng.integers(0, 1 << 14)) << 45 for _ in range(300)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(s, k) for k, s in enumerate(signed)], "fp long, least long")
    got = simhash.groups(frame).collect()
    root = brute_groups(prints)
    by = defaultdict(set)
    for r in got:
        by[r.component_id].add(np.array([r.fp], np.int64).view(np.uint64)[0].item())
    want = defaultdict(set)
    for p in prints:
        want[root[p]].add(p)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def brute_lanes(text):
    words = SPACED.findall((text or "").translate(LOWER))
    grams = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    out = []
    for lane in (1, 2):
        ones = Counter()
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42) + lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            h = (h ^ h >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
            h ^= h >> 31
            ones.update(b for b in range(64) if h >> b & 1)
        out.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)))
    return tuple(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_similar_groups(rows):
    """Smallest doc id of the group of each (doc_id, fingerprint, lanes)."""
    lanes = {}
    for _, p, w in rows:
        lanes[p] = min(lanes.get(p, w), w, key=lambda w: tuple(map(signed, w)))
    golay, prints = simhash.Golay(), sorted(lanes)
    at, keys = simhash.lookup_keys(np.array(prints, np.uint64), golay)
    met = defaultdict(set)
    for k, key in zip(at.tolist(), keys.tolist()):
        met[k].add(key)
    most = simhash.similar_bits(simhash.SIMILARITY)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, p in enumerate(prints):
        for b in range(a):
            q = prints[b]
            apart = sum((x ^ y).bit_count() for x, y in zip(lanes[p], lanes[q]))
            if (p ^ q).bit_count() <= 3 or (apart <= most and met[a] & met[b]):
                parent[find(a)] = find(b)
    place = {p: k for k, p in enumerate(prints)}
    least = {}
    for d, p, _ in sorted(rows):
        least.setdefault(find(place[p]), d)
    return {d: least[find(place[p])] for d, p, _ in rows}


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"edit{rng.integers(1 << 30)}"
    return out


def test_similar_copies_are_caught_and_others_kept(spark):
    """Of copies of similarity 0.93 nearly all go, of those of 0.87 most; texts below 0.5 stay."""
    rng = np.random.default_rng(3)
    texts, near, nearer = [], [], []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        texts.append((3 * k, " ".join(words)))
        # An edit breaks five of 296 shingles in either text.
        texts.append((3 * k + 1, " ".join(edited(rng, words, 2 if k % 2 else 4))))
        texts.append((3 * k + 2, " ".join(edited(rng, words, 40))))
        (nearer if k % 2 else near).append(3 * k + 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {d for d, _ in texts} - {*near, *nearer} <= kept
    assert len(set(near) - kept) >= 0.7 * len(near)
    assert len(set(nearer) - kept) >= 0.95 * len(nearer)
    strict = {r.doc_id for r in simhash.keep_one(docs, None).collect()}
    assert kept <= strict


@pytest.mark.parametrize("tile", [20_000, 16])
def test_similar_groups_against_brute_force(spark, monkeypatch, tile):
    """Also with a hot group of near copies, in whole buckets and in tiles."""
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    monkeypatch.setattr(simhash, "CELLS", 512)
    rng = np.random.default_rng(4)
    hot = [f"w{x}" for x in rng.integers(0, 3000, 120)]
    texts = [" ".join(edited(rng, hot, int(rng.integers(0, 9)))) for _ in range(120)]
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        texts += [" ".join(edited(rng, words, int(rng.integers(0, 9)))) for _ in range(2)]
    rows = [(k, brute_print(t), brute_lanes(t)) for k, t in enumerate([*texts, "", None, "one two"])]
    docs = spark.createDataFrame(list(enumerate([*texts, "", None, "one two"])), "doc_id long, text string")
    want = brute_similar_groups(rows)
    assert 2 < len(set(want.values())) < len(rows) - 60
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))


def test_golay_is_perfect():
    golay = simhash.Golay()
    assert len(set(golay.errors.tolist())) == 2048
    words = np.arange(1 << 12, dtype=np.uint32) << 11
    errors = golay.errors[:: 41]
    codes = words ^ 0
    # a codeword: the word whose own decoding has no error
    index = golay.index(codes)
    assert index.max() < 4096
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 1000, dtype=np.uint32)
    near = golay.around(x, 23)
    for bit in range(23):
        assert all(golay.index(x ^ np.uint32(1 << bit))[k] in near[k] for k in range(0, 1000, 97))
    assert len(errors) > 10


def test_majority_paths_agree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 511, 512, 2000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > n)


def test_keep_one(spark):
    docs = odd_docs(spark, ODD)
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {}
    for k, t in enumerate(ODD):
        want.setdefault(brute_print(t), k)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())
    assert simhash.keep_one(docs.where("false")).count() == 0
    alone = docs.where("doc_id is null")
    assert simhash.keep_one(alone).count() == len(want)


# --- decontamination ---------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_marks(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for d, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog again and again, they said."),
    (2, "Short item"), (3, None), (4, "..."), (None, "nameless ITEM of one two three four five six seven eight"),
    (5, "the quick brown fox jumps over the lazy dog again and again, they said."), (10, "É Ünï"),
]
LEAKS = [
    "say the QUICK brown fox, jumps over the lazy dog again; and so on", "a short item here", None, "",
    "nameless item of one two three four five six seven", "é ünï É ünï É ÜNï", "short item " * 500, "short", "Ω x",
]


@pytest.mark.parametrize("max_set", [decontam.MAX_SET, 0])
def test_decontamination_odd_rows(spark, max_set):
    docs = odd_docs(spark, LEAKS)
    docs = docs.unionByName(docs.where("doc_id < 2"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.report(docs, bench, max_set=max_set).collect()
    want = brute_marks([*enumerate(LEAKS), *list(enumerate(LEAKS))[:2]], ITEMS)
    assert sorted((tuple(r) for r in got), key=repr) == want
    left = decontam.drop_contaminated(docs, bench, max_set=max_set)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 7, 8]
    assert decontam.report(docs, bench.where("false"), max_set=max_set).where("contaminated").count() == 0
    assert decontam.report(docs.where("false"), bench, max_set=max_set).count() == 0


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op3_benchmark_decontamination"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_marks(documents(spark), items)
    assert any(r.contaminated for r in got)


def test_remove_spans(spark):
    docs = odd_docs(spark, ["...Keep, a short item! here", "clean text."])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert got == {0: "...Keep, a here", 1: "clean text."}


# --- mixing ------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = dict(zip(names, itertools.cycle((5, 2, 1))))
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        rate = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if rate * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else rate * weight[s] for s in names}
        capped |= over


def check_mix(rows, texts):
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for r, (source, text) in zip(rows, texts):
        n = len(SPACED.findall(text or ""))
        assert r.size == n and 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        sizes[source] += n
        taken[source] += r.taken
        biggest[source] = max(biggest[source], n)
    want = brute_targets(sizes)
    for r, (source, _) in zip(rows, texts):
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s], s


def test_mix_query(spark):
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    one = sorted(QUERIES["op9_mixing"](spark, SF).collect(), key=lambda r: r.doc_id)
    check_mix(one, [docs[r.doc_id] for r in one])
    again = sorted(QUERIES["op9_mixing"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert one == again


def test_mix_many_blocks_and_odd_sources(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(0, 40)), None, [None, "a", "b", "é", "A", "zero"][min(4, k % 7)], 1) for k in range(900)]
    rows += [(900, None, None, "zero", 0), (901, " ", None, "zero", 0), (None, "q r", None, "a", 1), (None, "q r", None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    *_, narrow = mixing.sized(docs, ["doc_id", "source"])
    mixed = mixing.mix(narrow, block=32).select("*", (F.col("copies") * F.col("size")).alias("taken"))
    out = mixed.join(narrow.select("rid", "source"), "rid").collect()
    assert len(out) == len(rows)
    check_mix(out, [(r.source, "w " * r.size) for r in out])
    assert mixing.report(docs.where("false")).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    """Thousands of equal rows, with or without an id, are no single group; partitions do not matter."""
    rows = [(None, "same words here", "hot")] * 3000 + [(7, "same words here", "hot")] * 3000
    rows += [(k, "w " * (k % 50), "hot") for k in range(100, 600)] + [(k, "w " * (k % 9), "cold") for k in range(600, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = spark.sparkContext.accumulator(0)
    settle = mixing._settle

    def watched(last):
        body = settle(last)

        def run(pdf):
            seen.add(1 if len(pdf) > 4 * 256 else 0)
            return body(pdf)

        return run

    monkeypatch.setattr(mixing, "_settle", watched)
    tell = lambda df: sorted((str(r.doc_id), r.size, r.taken) for r in mixing.report(df, block=256).collect())
    one = tell(docs.repartition(5))
    assert seen.value == 0 and len(one) == len(rows)
    assert tell(docs.repartition(3, "source")) == one


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(0, 900, 500).astype(float)
    q = mixing.flight(p, size, rng.random(500))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_flight_is_unbiased():
    size = np.array([3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 2.0, 9.0])
    p = np.array([0.5, 0.2, 0.7, 0.4, 0.6, 0.3, 0.9, 0.4])
    rng = np.random.default_rng(4)
    mean = np.mean([mixing.flight(p, size, rng.random(8)) for _ in range(4000)], 0)
    assert np.abs(mean - p).max() < 0.03


# --- sharding ----------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = sharding.shard_names(10)
    one = sharding.lookup_table(names, 1009)
    counts = np.bincount(one)
    assert counts.max() - counts.min() <= 1 and counts.sum() == 1009
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert ((one != fewer) & (one != 9)).mean() < 0.15
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement_odd_rows(spark):
    docs = odd_docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    placed = sharding.place(docs, docs.columns)
    assert placed.columns[: len(docs.columns)] == docs.columns and placed.columns[-1] == "shard"
    rows = placed.collect()
    assert len(rows) == len(ODD)
    held = sharding.lookup_table(sharding.shard_names())
    for r in rows:
        key = str(r.doc_id) if r.doc_id is not None else "text:" + hashlib.md5((r.text or "").encode()).hexdigest()
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r[placed.columns[-2]] == slot and r.shard == held[slot]
