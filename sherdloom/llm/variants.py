"""Spelling variants: frequent words, the words one edit away, and the form each goes back to.

Words are counted in each task and then by shuffle.  Two words are near if one inserted,
deleted or replaced code point makes one of the other.  The search is dynamic programming
over sorted lists: words that begin alike stand together, so a range of the list that
shares its first letters shares the rows of the edit matrix; each row is worked out once
per word and range, in a band of three cells, and a range is skipped as soon as its
shared letters are more than one edit away.  Tasks do this breadth first for all words
of a batch at once.

One list would be the whole vocabulary, so it is cut where no pair can be lost: of two
strings one edit apart, the shorter with t letters, either the first t // 2 letters agree
or the last t - t // 2.  Every word is filed under both halves, for its own length and
for the one below (as the longer of a pair).  Groups of more than ``GROUP`` words are
halved again by what is left of them, until at most two letters are left; the rounds grow
with the logarithm of the longest word.  No group is dropped or capped.

Defined results: null and empty texts have no words; a null doc id hashes as the empty
text; repeated rows count each for themselves; among near words of one count the
smallest in code-point order is taken; a word without near words has no form and is its
own root; an empty table, or one without a word of five occurrences, gives no rows; the
length of a text or of a run does not matter; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import col

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO = 199  # a run loses a letter where this divides its hash
SHORTEST = 6  # letters
LEAST = 5  # occurrences
RATIO = 5  # a form is this many times as frequent
GROUP = 4096  # words that one list may hold
BATCH = 16384  # filed words that a task searches at once
COUNTER_ROWS = 400_000  # distinct words that a task holds before it hands them on


def words_of(doc_id: object, text: str | None, typo: int = TYPO) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, for words of ``SHORTEST`` letters or more."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered = (text or "").encode().lower().decode()  # bytes lower A-Z alone
    for run, n in Counter(RUN.findall(lowered)).items():
        if len(run) >= SHORTEST:
            h = zlib.crc32(run.encode(), seed)
            if h % typo == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
                if len(run) < SHORTEST:
                    continue
            yield run, n


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of all words with ``least`` occurrences in all texts."""
    source = docs.select(col(docs, "doc_id").cast("string").alias("doc_id"), col(docs, "text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(c):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"]
            )

        c: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                for word, n in words_of(doc_id.as_py(), text.as_py()):
                    c[word] = c.get(word, 0) + n
                if len(c) > COUNTER_ROWS:
                    yield batch(c)
                    c = {}
        if c:
            yield batch(c)

    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def _halved(filed: DataFrame) -> DataFrame:
    """The filed rests (key, t, rest) once more, under their first and under their last half.

    ``t`` is the length of the shorter rest of a pair; the rest itself has t or t + 1 letters.
    """
    t, rest = F.col("t"), F.col("rest")
    first = F.floor(t / 2).cast("int")
    last = t - first
    size = F.length(rest)
    halves = F.array(
        F.struct(
            F.concat("key", F.lit("<"), F.substring(rest, F.lit(1), first)).alias("key"),
            last.alias("t"),
            F.substring(rest, first + 1, size).alias("rest"),
        ),
        F.struct(
            F.concat("key", F.lit(">"), F.substring(rest, size - last + 1, last)).alias("key"),
            first.alias("t"),
            F.substring(rest, F.lit(1), size - last).alias("rest"),
        ),
    )
    return filed.select("word", "n", F.explode(halves).alias("h")).select("word", "n", "h.*")


def filed_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n, key, rest): every two near words share a key, no key has more than ``most`` rests.

    Rests of two letters at most stay together: the alphabet bounds their number.
    """
    size = F.length("word")
    level = _halved(
        words.select("word", "n", F.explode(F.array(size, size - 1)).alias("t"), F.col("word").alias("rest"))
        .where("t > 0")
        .withColumn("key", F.col("t").cast("string"))
    )
    done = None
    while True:
        crowded = level.where("t > 1").groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most)
        crowded = materialize(crowded.select("key"), "crowded")
        if crowded.isEmpty():
            part = level
        else:
            part = level.join(crowded, "key", "left_anti")
            level = _halved(level.join(crowded, "key", "left_semi"))
        part = part.select("word", "n", "key", "rest")
        done = part if done is None else done.unionByName(part)
        if crowded.isEmpty():
            return done


def _adjacent_lcps(chars: np.ndarray, start: np.ndarray, size: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Letters each string shares with the one before it; -1 where a list opens."""
    lcp = np.zeros(len(start), np.int64)
    lcp[opens] = -1
    at = np.flatnonzero(lcp == 0)
    depth = 0
    while len(at):
        at = at[(size[at] > depth) & (size[at - 1] > depth)]
        at = at[chars[start[at] + depth] == chars[start[at - 1] + depth]]
        depth += 1
        lcp[at] = depth
    return lcp


def near_in_lists(rests: list[str], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x, y) of strings exactly one edit apart, both ways, within sorted lists.

    ``opens`` has the position at which each list begins; strings of a list are distinct.
    """
    n = len(rests)
    size = np.fromiter(map(len, rests), np.int64, n)
    start = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    # A letter behind the last string, so that a look past an end stays in the array.
    chars = np.frombuffer(("".join(rests) + "\0").encode("utf-32-le"), np.uint32)
    lcp = _adjacent_lcps(chars, start, size, opens)
    bound = np.r_[opens, n]
    held = np.diff(bound)

    # One row per word and range [lo, hi) of strings that share ``depth`` letters; a, b, c
    # are the cells of that depth against depth - 1, depth and depth + 1 letters of the word.
    word = np.arange(n)
    lo, hi = np.repeat(bound[:-1], held), np.repeat(bound[1:], held)
    a, b = np.full(n, 2, np.int8), np.zeros(n, np.int8)
    c = np.where(size > 0, 1, 2).astype(np.int8)
    found_x, found_y = [], []
    last = len(chars) - 1
    depth = 0
    while len(word):
        # The one string that ends at this depth leads its range.
        off = size[word] - depth
        cell = np.where(off == 0, b, np.where(off == 1, c, np.where(off == -1, a, 2)))
        hit = (size[lo] == depth) & (cell == 1)
        found_x.append(word[hit])
        found_y.append(lo[hit])
        # Ranges one letter deeper.
        heads = np.flatnonzero(lcp <= depth)
        tails = np.r_[heads[1:], n]
        long_enough = size[heads] > depth
        heads, tails = heads[long_enough], tails[long_enough]
        from_, to = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
        width = to - from_
        row = np.repeat(np.arange(len(word)), width)
        head = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + from_[row]
        letter = chars[start[heads[head]] + depth]
        word, off = word[row], off[row]
        base = start[word] + depth

        def cost(shift, word=word, off=off, base=base, letter=letter):
            """0 where the word's letter at depth + shift is the range's, 1 where not, 2 outside."""
            inside = (off > shift) & (base + shift >= start[word])
            same = chars[np.clip(base + shift, 0, last)] == letter
            return np.where(inside, np.where(same, 0, 1), 2).astype(np.int8)

        a0, b0, c0 = a[row], b[row], c[row]
        # Cells without a letter of the word lie outside the matrix.
        a = np.where((off >= 0) & (depth > 0), np.minimum(a0 + cost(-1), b0 + 1), np.where(depth == 0, b0 + 1, 2))
        b = np.where(off > 0, np.minimum(np.minimum(b0 + cost(0), c0 + 1), a + 1), 2)
        c = np.where(off > 1, np.minimum(c0 + cost(1), b + 1), 2)
        keep = np.minimum(np.minimum(a, b), c) <= 1
        word, lo, hi = word[keep], heads[head[keep]], tails[head[keep]]
        a, b, c = (np.minimum(x[keep], 2).astype(np.int8) for x in (a, b, c))
        depth += 1
    return np.concatenate(found_x), np.concatenate(found_y)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, key, rest) sorted by key and rest -> (word, near, near_n)."""
    def answers(held: pa.Table) -> pa.RecordBatch:
        keys = held.column("key").combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        x, y = near_in_lists(held.column("rest").to_pylist(), np.r_[0, np.flatnonzero(new) + 1])
        words = held.column("word").combine_chunks()
        counts = held.column("n").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [words.take(pa.array(x)), words.take(pa.array(y)), counts.take(pa.array(y))], names=["word", "near", "near_n"]
        )

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BATCH:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column("key").combine_chunks()
            # The last key may go on in the next batch.
            same = pc.equal(keys, keys[len(keys) - 1]).to_numpy(zero_copy_only=False)
            cut = len(keys) - int(same.sum())
            if cut:
                yield answers(whole.slice(0, cut))
            held, rows = whole.slice(cut).to_batches(), len(keys) - cut
    if rows:
        yield answers(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, near, near_n) for all words (word, n) one edit apart; a pair may come more than once."""
    filed = filed_words(words, most).repartition("key").sortWithinPartitions("key", "rest")
    return filed.select("word", "n", "key", "rest").mapInArrow(_search, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form; counts grow five times a step, so no chain is long."""
    at = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(
            at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n), each named once."""
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near"))).alias("best")
    # The near words of a word are bounded by its length and the alphabet.
    beside = near_words(words, most).groupBy("word").agg(F.size(F.collect_set("near")).cast("long").alias("n_near"), best)
    chosen = (-F.col("best.down")) >= ratio * F.col("n")
    forms = materialize(
        words.join(beside, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.down")).alias("form_n"),
        ),
        "forms",
    )
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def report(docs: DataFrame) -> DataFrame:
    return group_variants(vocabulary(docs))
