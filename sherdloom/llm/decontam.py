"""Benchmark decontamination with a broadcast set of normalised n-grams.

Windows of benchmark items are hashed into a set; every window of a document is
looked up in it inside the row, hits are verified word by word, and the words they
cover are marked.  Only documents with hits give rows to the item lookup.

Defined results: a null text has no words and is never contaminated; an item
without words has no window; items that share a text or an id count by id once;
an item without an id marks words but is not listed; repeated document rows are
marked each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import UPPER, col, fresh, let, with_row_id

WINDOW = 10
# Fixed value: what separates words after ASCII lowering, as a Java character class.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
MAX_SET = 200_000  # windows that are broadcast; beyond it they are joined by shuffle


def normal_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, GAP + "+"), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(width, text, hash, items): distinct windows with the ids of their items."""
    def windows(w):
        n = F.least(F.size(w), F.lit(window))
        return F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.size(w) - n + 1),
                lambda i: F.struct(n.alias("width"), F.slice(w, i, n).alias("words")),
            ),
        )

    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item"),
        F.explode(let(normal_words(F.col("text")), windows)).alias("w"),
    )
    return (
        rows.select(
            "item", "w.width", F.array_join("w.words", " ").alias("text"),
            F.xxhash64(F.transform("w.words", lambda x: F.xxhash64(x))).alias("hash"),
        )
        .groupBy("width", "text", "hash")
        .agg(F.collect_set("item").alias("items"))
    )


def _literal(values) -> str:
    return ", ".join(values)


def _spans(found: list, words: str) -> Column:
    """Verified hits (at, width, text) of an array of words, in order of position."""
    parts = []
    for width in sorted({r["width"] for r in found}):
        own = [r for r in found if r["width"] == width]
        hashes = _literal(f"{r['hash']}L" for r in own)
        texts = _literal(f"'{r['text']}'" for r in own)  # words and single spaces only
        parts.append(
            f"filter(transform(filter(if(size(h) >= {width}, sequence(1, size(h) - {width - 1}), array()),"
            f" i -> xxhash64(slice(h, i, {width})) IN ({hashes})),"
            f" i -> named_struct('at', i, 'width', {width}, 'text', array_join(slice(w, i, {width}), ' '))),"
            f" x -> x.text IN ({texts}))"
        )
    if not parts:
        return F.expr("cast(array() AS array<struct<at:int,width:int,text:string>>)")
    return F.expr(
        f"element_at(transform(array({words}), w -> element_at(transform(array(transform(w, x -> xxhash64(x))),"
        f" h -> array_sort(concat({', '.join(parts)}))), 1)), 1)"
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which come in order of position."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["width"] - F.greatest(s["at"], a["end"])))
            .cast("long").alias("n"),
            F.greatest(a["end"], s["at"] + s["width"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def mark(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, max_set: int = MAX_SET
) -> tuple[DataFrame, str, DataFrame]:
    """(kept columns and a struct (n_words, n_hit, spans), its name, the windows)."""
    windows = item_windows(benchmark, window)
    out = fresh(docs, "marks")
    found = windows.select("width", "text", "hash").limit(max_set + 1).collect()
    if len(found) > max_set:
        return _mark_by_join(docs, windows, keep, out)
    words = fresh(docs, "normal_words")
    frame = docs.select(*[col(docs, c) for c in keep], normal_words(col(docs, "text")).alias(words))
    # The generator keeps the words a column: they are worked out once per row.
    frame = frame.withColumn(words, F.explode(F.array(words)))
    spans = _spans(found, f"`{words}`")
    whole = F.struct(
        F.size(words).cast("long").alias("n_words"),
        spans.alias("spans"),
    )
    marks = let(
        whole,
        lambda m: F.struct(
            m["n_words"].alias("n_words"), _covered(m["spans"]).alias("n_hit"), m["spans"].alias("spans")
        ),
    )
    return frame.withColumn(out, marks).drop(words), out, F.broadcast(windows)


def _mark_by_join(docs, windows, keep, out):
    """The same marks for a benchmark of any size: windows meet in a shuffled join."""
    rows, rid = with_row_id(docs, "decontam")
    words = fresh(rows, "normal_words")
    split = rows.select(F.col(rid).alias("rid"), normal_words(col(rows, "text")).alias(words))
    split = split.withColumn(words, F.explode(F.array(words)))
    widths = [r["width"] for r in windows.select("width").distinct().collect()]  # 1 to window
    parts = None
    for width in widths:
        part = split.where(F.size(words) >= width).select(
            "rid",
            F.explode(
                F.expr(
                    f"transform(sequence(1, size(`{words}`) - {width - 1}), i -> named_struct("
                    f"'at', i, 'width', {width}, 'text', array_join(slice(`{words}`, i, {width}), ' ')))"
                )
            ).alias("s"),
        )
        parts = part if parts is None else parts.unionByName(part)
    met = parts.join(
        windows.select(F.col("text").alias("t"), F.col("width").alias("wd")),
        (F.col("s.text") == F.col("t")) & (F.col("s.width") == F.col("wd")),
        "left_semi",
    )
    met_rid, found = fresh(rows, "met_rid"), fresh(rows, "found")
    spans = met.groupBy(F.col("rid").alias(met_rid)).agg(F.array_sort(F.collect_set("s")).alias(found))
    empty = F.expr("cast(array() AS array<struct<at:int,width:int,text:string>>)")
    got = rows.join(spans, F.col(rid) == F.col(met_rid), "left")
    whole = let(
        F.coalesce(found, empty),
        lambda s: F.struct(
            F.size(normal_words(F.col("text"))).cast("long").alias("n_words"),
            _covered(s).alias("n_hit"),
            s.alias("spans"),
        ),
    )
    return got.select(*[col(got, c) for c in keep], whole.alias(out)), out, windows


def report(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per document: counts and the ids of the items found in it."""
    marked, at, windows = mark(docs, benchmark, ["doc_id"], **parameters)
    # A number of its own for every row, written before the spans become rows.
    marked, rid = with_row_id(marked, "marks")
    rows = marked.select(
        "doc_id", F.col(rid).alias("rid"),
        F.col(at)["n_words"].alias("n_words"), F.col(at)["n_hit"].alias("n_hit"),
        F.explode_outer(
            F.array_distinct(
                F.transform(F.col(at)["spans"], lambda s: F.struct(s["width"].alias("width"), s["text"].alias("text")))
            )
        ).alias("s"),
    ).select("*", "s.width", "s.text")
    named = rows.join(windows.select("width", "text", "items"), ["width", "text"], "left")
    each = named.select("doc_id", "rid", "n_words", "n_hit", F.explode_outer("items").alias("item"))
    items = F.array_sort(F.collect_set("item"))
    return each.groupBy("rid", "doc_id", "n_words", "n_hit").agg(items.alias("items")).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents, all columns, without any benchmark window."""
    marked, at, _ = mark(docs, benchmark, docs.columns, **parameters)
    return marked.where(F.col(at)["n_hit"] == 0).drop(at)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """All documents, all columns, with the hit words and what follows each cut out."""
    marked, at, _ = mark(docs, benchmark, docs.columns, **parameters)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({word}{gap}*)"), 1)
    spans = F.col(at)["spans"]
    left = F.filter(
        pieces,
        lambda _, i: ~F.exists(spans, lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["width"])),
    )
    cut = F.concat(F.regexp_extract(F.col("text"), f"^{gap}*", 0), F.array_join(left, ""))
    return marked.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text"))).drop(at)
