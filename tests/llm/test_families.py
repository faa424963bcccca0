"""Near-dedup of the pipeline: families of merely similar texts stay, real near copies go."""

import numpy as np
import pytest
from test_dedup_chain import brute_print, edited

import corpus_pipeline
from sherdloom.llm import simhash


def shingles(text):
    return np.unique(simhash.shingle_hashes(text, simhash.SIMILAR_SHINGLE))


def brute_links(prints, sets):
    links = set()
    for x in range(len(sets)):
        for y in range(x):
            a, b = set(sets[x].tolist()), set(sets[y].tolist())
            same = len(a & b) >= 0.8 * len(a | b) if a | b else False
            if same or (int(prints[x]) ^ int(prints[y])).bit_count() <= 3:
                links.add((y, x))
    return links


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        parent[find(x)] = find(y)
    least = {}
    for k in range(n):
        least.setdefault(find(k), k)
    return [least[find(k)] for k in range(n)]


def test_set_links_against_all_pairs():
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in range(120)]
    texts = [" ".join(edited(rng, base, int(rng.integers(0, 6)))) for _ in range(60)] + ["", "one", "one two"]
    sets = [shingles(t) for t in texts]
    prints = np.array([brute_print(t) for t in texts], np.uint64)
    want = brute_links(prints, sets)
    got = simhash.set_links(prints, sets, 0.8)
    assert {(min(p), max(p)) for p in got} <= want
    assert roots(len(texts), got) == roots(len(texts), want)
    assert 1 < len(set(roots(len(texts), want))) < len(texts)


def family(similarity, n, start):
    """Texts of one core and own words, whose sets agree to ``similarity`` in each pair."""
    own = round(200 * (1 - similarity) / (2 * similarity))
    core = [f"core{similarity}x{k}" for k in range(204)]
    return [(start + k, " ".join(core + [f"own{start + k}y{j}" for j in range(own)])) for k in range(n)]


@pytest.mark.parametrize("rows", [1024, 60])
def test_families_below_the_limit_stay(spark, monkeypatch, rows):
    """Three families of 120 texts; only what op8's own three bits link may go."""
    monkeypatch.setattr(simhash, "FAMILY_ROWS", rows)
    texts = [t for k, s in enumerate((0.6, 0.68, 0.75)) for t in family(s, 120, 1000 * k)]
    # Texts within three bits of an earlier one are near copies by op8's definition.
    free, seen = [], []
    for d, t in texts:
        p = brute_print(t)
        if all((p ^ q).bit_count() > 3 for q in seen):
            free.append((d, t))
            seen.append(p)
    assert len(free) > 250
    copies = [(10_000 + d, t.replace("core0.6x100 ", "changed ")) for d, t in free[:40]]
    docs = spark.createDataFrame(free + copies, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, _ in free}
