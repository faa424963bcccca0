"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with the mean
histograms of its language by the Jensen-Shannon distance.  All of it is column
algebra: one pass over the texts, then a five-row reference.

Defined results: a null text counts as empty, an empty text has no words and fails
the base rule, a null or unlisted language is compared with all unlisted ones
together, repeated rows are judged each for itself, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import SPACE, col, fresh, let, split_words

# Frequent function words of each language, in natural order.
COMMON = {
    "de": "das dem den der des die ein eine für im ist mit nicht sich und von zu".split(),
    "en": "a and are as at be by for in is it of on that the this to was with".split(),
    "es": "con de del el en es la las los no para por que se su un una y".split(),
    "fr": "dans de des du en est et la le les par pas pour que qui un une".split(),
}
OTHER = "other"
# The words that documents of unlisted languages are compared by.
COMMON_OTHER = "a de den der el en et in la le the und".split()
# Character classes that are counted by pattern; space and the rest come on top.
CLASSES = ("[A-Z]", "[0-9]", "[#*$%&|<>]", "[!\"'()+,./:;=?@\\[\\\\\\]^_`{}~-]", "[^\\x00-\\x7F]", "[aeiou]")

MIN_WORDS = 50
# A distance is too large above limit + slack / sqrt(words): short texts scatter more.
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.25, 0.8
MAX_WORD_DISTANCE, WORD_SLACK = 0.20, 1.0
MIN_CHARS = 200  # shorter texts are not judged by their histograms


def _language(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON)), lang).otherwise(F.lit(OTHER))


def _common(language: Column) -> Column:
    lists = {**COMMON, OTHER: COMMON_OTHER}
    whens = F
    for name, words in lists.items():
        whens = whens.when(language == name, F.array(*map(F.lit, words)))
    return whens


def _repeats(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their three words.  Hashes are sorted
    with their positions; equal neighbours mark the repeated windows, and the gaps
    between marked positions give the words they cover.
    """
    def covered(hashes):
        pairs = F.array_sort(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def marks(s):
            return F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            )

        def width(p):
            gaps = F.transform(
                p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))
            )
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, marks), width)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashed,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
        ),
    )
    return let(
        windows,
        lambda t: F.when(
            F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")
        ).otherwise(covered(t)),
    )


def _lines_repeated(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def profile(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The kept columns and one struct with all counts of the whole text."""
    out = fresh(docs, "profile")
    text = F.coalesce(col(docs, "text"), F.lit(""))
    language = _language(col(docs, "lang"))
    gap = F.length(text) - F.length(F.regexp_replace(text, SPACE + "+", ""))
    counts = [F.regexp_count(text, F.lit(c)) for c in CLASSES]

    def of_words(w):
        def common(names):
            hits = F.filter(w, lambda x: F.array_contains(names, x))
            return let(
                hits,
                lambda h: F.concat(
                    F.transform(names, lambda n: F.size(h) - F.size(F.array_remove(h, n))),
                    F.array(F.size(w) - F.size(h)),
                ),
            )

        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeats(w).alias("n_repeat_words"),
            let(_common(language), common).alias("words"),
        )

    chars = let(
        F.struct(F.length(text).alias("all"), F.array(gap, *counts).alias("some")),
        lambda c: F.concat(
            c["some"],
            F.array(c["all"] - F.aggregate(c["some"], F.lit(0), lambda a, x: a + x)),
        ),
    )
    return docs.select(
        *[col(docs, c) for c in keep],
        F.struct(
            language.alias("language"),
            let(split_words(text), of_words).alias("w"),
            (F.length(text) - gap).cast("long").alias("word_chars"),
            counts[2].cast("long").alias("n_symbols"),
            _lines_repeated(text).alias("n_dup_lines"),
            chars.alias("chars"),
        ).alias(out),
    ), out


def _shares(counts: Column) -> Column:
    return let(
        F.struct(counts.alias("c"), F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).alias("n")),
        lambda s: F.transform(
            s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(F.lit(0.0))
        ),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two histograms of shares."""
    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: 0.5 * part(x, y) + 0.5 * part(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(profiles: DataFrame, at: str) -> DataFrame:
    """Summed histograms over all documents of each language: five rows at most."""
    n_chars = len(CLASSES) + 2
    n_words = max(map(len, COMMON.values())) + 1
    p = F.col(at)
    sums = [F.sum(F.get(p["chars"], F.lit(i)).cast("double")).alias(f"c{i}") for i in range(n_chars)]
    sums += [F.sum(F.get(p["w"]["words"], F.lit(i)).cast("double")).alias(f"w{i}") for i in range(n_words)]
    total = profiles.groupBy(p["language"].alias("ref_language")).agg(*sums)
    return total.select(
        "ref_language",
        _shares(F.array(*[f"c{i}" for i in range(n_chars)])).alias("ref_chars"),
        _shares(F.filter(F.array(*[f"w{i}" for i in range(n_words)]), lambda x: x.isNotNull())).alias("ref_words"),
    )


def judge(
    docs: DataFrame,
    keep: list[str],
    min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    char_slack: float = CHAR_SLACK,
    max_word_distance: float = MAX_WORD_DISTANCE,
    word_slack: float = WORD_SLACK,
) -> tuple[DataFrame, str]:
    """The kept columns and a struct with counts, both distances and the verdict."""
    found, at = profile(docs, keep)
    found = materialize(found, "quality")
    ref = references(found, at).select(F.struct("*").alias(fresh(found, "ref")))
    name = ref.columns[0]
    r = F.col(name)
    joined = found.join(F.broadcast(ref), F.col(at)["language"] == r["ref_language"])
    p, w = F.col(at), F.col(at)["w"]
    chars = js_distance(_shares(p["chars"]), r["ref_chars"])
    words = js_distance(_shares(w["words"]), r["ref_words"])
    n_chars = F.aggregate(p["chars"], F.lit(0), lambda a, x: a + x)
    failed = (w["n_words"] < min_words) | (100 * w["n_repeat_words"] > 50 * w["n_words"])
    scatter = 1 / F.sqrt(F.greatest(w["n_words"], F.lit(1)))
    off = (n_chars >= MIN_CHARS) & (
        (chars > max_char_distance + char_slack * scatter)
        | (words > max_word_distance + word_slack * scatter)
    )
    verdict = F.struct(
        w["n_words"].alias("n_words"), p["word_chars"].alias("word_chars"),
        p["n_symbols"].alias("n_symbols"), p["n_dup_lines"].alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & ~off).alias("kept"), chars.alias("char_distance"), words.alias("word_distance"),
    )
    return joined.withColumn(at, verdict).drop(name), at


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    judged, at = judge(docs, docs.columns)
    return judged.where(F.col(at)["kept"]).drop(at)
