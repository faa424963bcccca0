"""The pipeline against plain Python, stage by stage, and the registered oracles."""

import hashlib
from collections import Counter

from test_dedup_chain import LOWER, SF, SPACED, brute_marks, brute_print, brute_targets, quality_base

import corpus_pipeline
from sherdloom.llm import decontam, quality, sharding


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def smallest_of_groups(texts, similar):
    """The smallest id of every group that links close; also the linked pairs."""
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = [(a, b) for a in texts for b in texts if a < b and similar(a, b)]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {find(d) for d in texts}, pairs


def check_near_dedup(texts, kept):
    """No text goes without a true link, every pair within three bits is found, and most pairs at 0.8."""
    prints = {d: brute_print(t) for d, t in texts.items()}
    sets = {d: shingles(t) for d, t in texts.items()}

    def bits(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 3

    def alike(a, b):
        return bits(a, b) or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])

    by_bits, _ = smallest_of_groups(texts, bits)
    truth, pairs = smallest_of_groups(texts, alike)
    assert truth <= kept <= by_bits
    missed = [(a, b) for a, b in pairs if a in kept and b in kept]
    assert len(missed) <= 0.1 * len(pairs)


def test_pipeline_stage_by_stage(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in source.collect()}
    judged, at = quality.judge(source, ["doc_id"])
    kept = {r.doc_id for r in judged.select("doc_id", f"{at}.kept").collect() if r.kept}
    assert all(not quality_base(rows[d].text)[-1] for d in kept)

    stage = corpus_pipeline.near_dedup(spark, source.join(judged.where(f"{at}.kept").select("doc_id"), "doc_id", "left_semi"), SF)
    least = {r.doc_id for r in stage.select("doc_id").collect()}
    check_near_dedup({d: rows[d].text for d in kept}, least)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute_marks([(d, rows[d].text) for d in least], items) if not r[-1]}

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*source.columns, "slot", "shard"]
    out = got.collect()
    assert {r.doc_id for r in out} <= clean
    sizes, taken, most = Counter(), Counter(), Counter()
    for d in clean:
        n = len(SPACED.findall(rows[d].text))
        sizes[rows[d].source] += n
        most[rows[d].source] = max(most[rows[d].source], n)
    for r in out:
        assert r.text == rows[r.doc_id].text
        taken[r.source] += len(SPACED.findall(r.text))
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert max(Counter(r.doc_id for r in out).values()) <= 3
    held = sharding.lookup_table(sharding.shard_names())
    for r in out:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, held[slot])


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SF).columns == docs.columns, name
        assert stage(spark, nothing, SF).count() == 0, name


def test_stages_chain_without_writing(spark):
    """Every stage on the unwritten result of the one before, beside another run, gives what run() gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    beside = corpus_pipeline.quality_rules(spark, docs, SF)
    lazy = docs
    for _, stage in corpus_pipeline.STAGES:
        lazy = stage(spark, lazy, SF)
    whole = corpus_pipeline.run(spark, SF)
    other = corpus_pipeline.run(spark, SF)
    order = ["doc_id", "text"]
    assert sorted(map(tuple, lazy.select(order).collect())) == sorted(map(tuple, whole.select(order).collect()))
    assert other.count() == whole.count()
    assert beside.count() > 0


def test_stages_keep_clashing_columns(spark):
    """Extra columns, named like the helpers of the stages, come through all of them."""
    extra = ["kept", "fp", "found", "met_rid", "rid", "slot", "held_slot", "shard", "component", "least", "marks"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.selectExpr("*", *[f"doc_id AS {name}" for name in extra])
    out = wide
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.columns[: len(wide.columns)] == wide.columns
    rows = out.collect()
    assert rows and all(r[name] == r.doc_id for r in rows for name in extra)


def test_sharding_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert corpus_pipeline.sharding_documents(spark, docs, SF).count() == 0


def test_decontamination_by_join_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    wide = docs.selectExpr("*", "doc_id AS found", "doc_id AS met_rid", "doc_id AS rid")
    order = ["doc_id"]
    joined = decontam.drop_contaminated(wide, items, max_set=0).select(order).collect()
    assert sorted(joined) == sorted(decontam.drop_contaminated(docs, items).select(order).collect())
    assert decontam.drop_contaminated(wide, items.where("false")).count() == docs.count()
