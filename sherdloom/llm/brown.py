"""Language-model scoring with Brown class-based bigrams.

Exchange puts words into classes: word by word, the class whose neighbours fit best.
Every word that training holds ``LEAST`` times or more is clustered, whatever the size
of the training table.  Those that make up ``CORE_SHARE`` of its tokens, the core, are
exchanged over counted pairs until a round hardly raises the likelihood; then each of
the others meets its neighbours' classes and moves to the class where it fits best.
Words rarer than that belong to classes by their form, and so do unknown ones.  A
text's probability is the product of class transitions and of word emissions inside
the class, both smoothed.

Counts cover all training documents.  Words are counted in each task and then by
shuffle.  Tasks and the driver hold class tables and a dictionary, of the core and of
words with a ``DICTIONARY``-th of its share: no more than ``DICTIONARY / CORE_SHARE``
words can have that, however long the table.  All other words keep their counts and classes in a table that meets the documents in a
shuffled join, one row per document and distinct word; a document is the sequence of
its words' classes from then on.

Defined results: a null text is empty and is one end token; a null doc id is hashed
as the empty text; without training documents every count is zero and scores are
uniform guesses; words of equal count are clustered together or not at all; a text is
read whole however long; repeated rows count and score each for themselves; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import col, with_row_id

CORE_SHARE = 2.0**-16  # from which it is exchanged over pair counts: at most 2^16 words
DICTIONARY = 4  # tasks look words up that have this fraction of the core's share; the others meet them in a join
LEAST = 3  # times a clustered word is seen at least; the others stand for unknown words
CLASSES = 32  # classes of clustered words
FORMS = 8  # classes of all other words, by form
SETTLED = 2e-3  # gain of a round, in nats a token, at which the exchange has settled
BLOCK_WORDS = 1024  # words whose exchanges one group evaluates, on average
PLACED_WORDS = 4096  # words, rare ones counted, among which one group places those outside the core, on average
TOGETHER = 256  # of them, in one array operation
HOLE = 255  # class of a word that is not of the core, until the table of such words is met
FOLDS = 10
ADD = 0.1
PIECE_BYTES = 1 << 23  # text that a task holds as words at once, unless one text is longer
PIECE_STEPS = 1 << 20  # words that a task holds as classes at once, unless one text has more

_DIGIT = re.compile(rb"[0-9]")


def form_class(word: bytes) -> int:
    """Class of a word that is not clustered: digits, non-ASCII, or length."""
    if _DIGIT.search(word):
        return 0
    n = len(word)
    if not word.isascii():
        return 1 if n < 9 else 2
    return 3 if n < 5 else 4 if n < 8 else 5 if n < 11 else 6 if n < 16 else 7


def _forms(words: pa.Array) -> np.ndarray:
    """``form_class`` of many words."""
    n = pc.binary_length(words).to_numpy(zero_copy_only=False)
    digit = pc.match_substring_regex(words, "[0-9]").to_numpy(zero_copy_only=False)
    wide = ~pc.string_is_ascii(words.cast(pa.string())).to_numpy(zero_copy_only=False)
    return np.select([digit, wide & (n < 9), wide, n < 5, n < 8, n < 11, n < 16], range(7), 7)


def _words(text: str | None) -> list[bytes]:
    """The words of one text; ``_tokens`` finds those of many."""
    return (text or "").encode().lower().split()


def _pieces(batches: Iterator[pa.RecordBatch], texts: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose ``texts`` have ``size`` bytes together, or a single row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(first, last - first)
            first = last


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, all their words as numbers of these, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an edge leaves an empty word
    parts = pc.list_value_length(split).to_numpy(zero_copy_only=False)  # one at least
    lengths = np.add.reduceat(full.to_numpy(zero_copy_only=False), np.cumsum(parts) - parts, dtype=np.int64)
    found = words.filter(full).dictionary_encode()
    return found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False), lengths


def _lined_up(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The texts' values one after another, with ``end`` before, between and after the texts."""
    out = np.full(len(values) + len(lengths) + 1, end, values.dtype)
    out[np.arange(1, len(values) + 1) + np.repeat(np.arange(len(lengths)), lengths)] = values
    return out


def _bytes(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each of ``lengths``, of so many of the values."""
    ends = np.r_[0, np.cumsum(lengths)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, form, n) of all words of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            words, ids, _ = _tokens(b.column("text"))
            n = np.bincount(ids, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    each = training.select("text").mapInArrow(run, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).select("word", _form_column(F.col("word")).alias("form"), "n")


def clustered_words(counts: DataFrame, least: float) -> list:
    """The words seen ``least`` times or more, the most frequent first."""
    return sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))


class Symbols:
    """Numbers of words: clustered ones first, then forms, then the end of a text."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.first_form = len(words)
        self.end = len(words) + FORMS
        self.size = self.end + 1


def _known(words: pa.Array, symbols: pa.Array) -> np.ndarray:
    """Numbers of the words among ``symbols``; -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=symbols), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _symbols(words: pa.Array, symbols: pa.Array) -> np.ndarray:
    """Numbers of the words among ``symbols``, and behind these of the others' forms."""
    found = _known(words, symbols)
    other = np.flatnonzero(found < 0)
    found[other] = len(symbols) + _forms(words.take(pa.array(other)))
    return found


def _shared(spark: SparkSession, words: list[bytes], *further):
    """To tasks: the words of symbols as one array, and what goes with them."""
    return spark.sparkContext.broadcast((pa.array(words, pa.binary()), *further))


def pair_counts(training: DataFrame, symbols: Symbols) -> DataFrame:
    """(u, v, n) of neighbouring symbols.  Texts begin after the end symbol and end with it."""
    size, end = symbols.size, symbols.end
    shared = _shared(training.sparkSession, symbols.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (core,) = shared.value
        for b in _pieces(batches):
            words, ids, lengths = _tokens(b.column("text"))
            s = _lined_up(_symbols(words, core)[ids], lengths, end)
            codes, n = pa.array(s[:-1] * size + s[1:]).value_counts().flatten()
            codes = codes.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(codes // size), pa.array(codes % size), n], names=["u", "v", "n"])

    each = training.select("text").mapInArrow(run, "u long, v long, n long")
    return each.groupBy("u", "v").agg(F.sum("n").alias("n"))


# Sides of a word: its right and left neighbour, and itself as its right neighbour.
RIGHT, LEFT, OWN = 0, 1, 2


def _xlogx(x: np.ndarray) -> np.ndarray:
    """Of counts: whole numbers."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(grid: np.ndarray) -> float:
    """Log-likelihood of class transitions up to what classes cannot change."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(0)).sum() - _xlogx(grid.sum(1)).sum())


def gains(a: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """What each class gains (columns) by each word (rows) that leaves its class ``a``.

    ``right`` and ``left`` count a word's neighbours by class, without itself; ``own``
    counts it beside itself.
    """
    k, b = np.arange(len(a)), np.arange(classes)
    out = np.repeat(grid[None], len(a), 0)
    out[k, a] -= right
    out[k, :, a] -= left
    out[k, a, a] -= own
    rows, cols = out.sum(2), out.sum(1)
    r, l = (right.sum(1) + own)[:, None], (left.sum(1) + own)[:, None]
    # Cells differ from the grid's in the word's own class, and change beside its neighbours' classes.
    cell = np.repeat(_xlogx(grid)[None], len(a), 0)
    cell[k, a] = _xlogx(out[k, a])
    cell[k, :, a] = _xlogx(out[k, :, a])
    w, c = np.nonzero(right)
    moved = cell[:, b]
    moved[w, :, c] = _xlogx(out[w, :classes, c] + right[w, c, None])
    gain = moved.sum(2) - cell[:, b].sum(2)
    w, c = np.nonzero(left)
    moved = cell[:, :, b]
    moved[w, c] = _xlogx(out[w, c, :classes] + left[w, c, None])
    gain += moved.sum(1) - cell[:, :, b].sum(1)
    # The diagonal cell changes once, by both sides.
    d, x, y = out[:, b, b], right[:, b], left[:, b]
    gain += _xlogx(d + x + y + own[:, None]) - _xlogx(d + x) - _xlogx(d + y) + _xlogx(d)
    rows, cols = (rows + left)[:, b], (cols + right)[:, b]  # these neighbours stay whatever class it is
    return gain - (_xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + l) - _xlogx(cols))


def best_class(a: int, right: np.ndarray, left: np.ndarray, own: float, grid: np.ndarray, classes: int) -> tuple[int, float]:
    """The class in which a word of class ``a`` fits best, and what the move gains."""
    gain = gains(np.array([a]), right[None], left[None], np.array([float(own)]), grid, classes)[0]
    to = int(gain.argmax())
    return to, float(gain[to] - gain[a])


def _best(dense: np.ndarray, of: np.ndarray, grid: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The best class of words of classes ``of``, and what they gain there.

    ``dense`` counts their neighbours by word, side and class.  A word that comes from a
    form class has no gain: it leaves that class anyway.
    """
    best, gained = [np.zeros(0, int)], [np.zeros(0)]
    for first in range(0, len(of), TOGETHER):
        a, part = of[first : first + TOGETHER], dense[first : first + TOGETHER]
        k, own = np.arange(len(a)), part[:, OWN].sum(1)
        part[k, RIGHT, a] -= own
        part[k, LEFT, a] -= own
        gain = gains(a, part[:, RIGHT], part[:, LEFT], own, grid, classes)
        to = gain.argmax(1)
        here = np.where(a < classes, gain[k, np.minimum(a, classes - 1)], np.nan)
        best.append(to)
        gained.append(gain[k, to] - here)
    return np.concatenate(best), np.concatenate(gained)


def best_classes(beside: DataFrame, of: np.ndarray, grid: np.ndarray, classes: int) -> DataFrame:
    """(w, to, gain): words of ``beside`` (w, side, c, n), their best class, all others at rest."""
    now, total = of.astype(np.int16), len(grid)  # go to every task

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        words, at = np.unique(pdf["w"].to_numpy(np.int64), return_inverse=True)
        dense = np.zeros((len(words), 3, total))
        dense[at, pdf["side"].to_numpy(int), pdf["c"].to_numpy(int)] = pdf["n"].to_numpy(float)
        to, gain = _best(dense, now[words].astype(int), grid, classes)
        return pd.DataFrame({"w": words, "to": to, "gain": gain})

    return beside.groupBy(F.floor(F.col("w") / BLOCK_WORDS)).applyInPandas(evaluate, "w long, to int, gain double")


def exchange(pairs: DataFrame, symbols: Symbols, classes: int, settled: float) -> tuple[np.ndarray, np.ndarray]:
    """Class of every symbol and the class-pair counts.

    A round counts each word's neighbours by class, lets every word look for its best
    class with all others at rest, and moves a share of those that gain.  A round that
    makes the corpus less likely is taken back and half as many words move.  The last
    round is the one that gains less than ``settled`` a token, or has nothing to move.
    """
    spark = pairs.sparkSession
    fixed = np.arange(FORMS + 1) + classes
    of = np.r_[np.arange(symbols.first_form) % classes, fixed].astype(np.int64)
    total = classes + FORMS + 1

    def count(of):
        held = spark.createDataFrame(pd.DataFrame({"s": np.arange(symbols.size), "c": of}), "s long, c long")
        held = F.broadcast(held)  # one row per word of the core
        right = pairs.join(held, F.col("v") == F.col("s")).groupBy(F.col("u").alias("w"), F.lit(RIGHT).alias("side"), "c")
        left = pairs.join(held, F.col("u") == F.col("s")).groupBy(F.col("v").alias("w"), F.lit(LEFT).alias("side"), "c")
        near = materialize(right.agg(F.sum("n").alias("n")).unionByName(left.agg(F.sum("n").alias("n"))), "near")
        grid = np.zeros((total, total))
        cells = near.where(F.col("side") == RIGHT).join(held, F.col("w") == F.col("s")).groupBy(held["c"].alias("a"), near["c"].alias("b"))
        for r in cells.agg(F.sum("n").alias("n")).collect():  # one row per pair of classes
            grid[r["a"], r["b"]] = r["n"]
        return near, grid

    near, grid = count(of)
    share = 0.25
    twins = materialize(
        pairs.where("u = v").select(F.col("u").alias("w"), F.lit(OWN).alias("side"), F.lit(0).cast("long").alias("c"), "n"), "twins"
    )
    while True:
        words = near.unionByName(twins).where(F.col("w") < symbols.first_form)
        moves = best_classes(words, of, grid, classes).where("gain > 0")  # a word's own class gains nothing
        moves = sorted(moves.collect(), key=lambda r: (-r["gain"], r["w"]))  # no more than the core
        moves = moves[: int(np.ceil(share * len(moves)))]
        if not moves:
            break
        tried = of.copy()
        for r in moves:
            tried[r["w"]] = r["to"]
        near_, grid_ = count(tried)
        gain = likelihood(grid_) - likelihood(grid)
        if gain > 0:
            of, near, grid = tried, near_, grid_
            if gain < settled * grid.sum():
                break
        elif len(moves) == 1:
            break
        else:
            share /= 2
    return of, grid


def contexts(training: DataFrame, core: Symbols, of: np.ndarray, total: int) -> DataFrame:
    """(word, beside): what stands beside the words outside the core.

    ``beside`` lists places: the class on the left, the class on the right and whether the
    word itself stands there, in one number of four bytes.
    """
    shared, end = _shared(training.sparkSession, core.words, of), core.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, of = shared.value
        for b in _pieces(batches):
            words, ids, lengths = _tokens(b.column("text"))
            s = _symbols(words, core)
            c = _lined_up(of[s][ids], lengths, of[end])
            w = _lined_up(ids, lengths, -1)
            at = np.flatnonzero(np.r_[s >= len(core), False][w])  # the end's -1 is none of them
            beside = (c[at - 1] * total + c[at + 1]) * 2 + (w[at] == w[at + 1])
            n = np.bincount(w[at], minlength=len(words))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(met)), _bytes(beside[np.argsort(w[at], kind="stable")].astype(np.int32), n[met])],
                names=["word", "beside"],
            )

    return training.select("text").mapInArrow(run, "word binary, beside binary")


def placed_words(beside: DataFrame, others: DataFrame, grid: np.ndarray, classes: int, blocks: int) -> DataFrame:
    """(word, n, class): the words ``others`` (word, form, n) in the class where they fit best.

    Words meet what stands beside them in ``blocks`` groups; those not of ``others`` are left out there.
    """
    total = len(grid)

    def evaluate(beside: pa.Table, others: pa.Table) -> pa.Table:
        others = others.combine_chunks()
        row = pc.index_in(beside["word"], value_set=others["word"].combine_chunks())
        beside, row = beside.filter(row.is_valid()), row.drop_null().to_numpy().astype(np.int64)
        x = np.frombuffer(b"".join(beside["beside"].to_pylist()), np.int32)
        at = 3 * np.repeat(row, pc.binary_length(beside["beside"]).to_numpy() // 4)
        places = [(at + RIGHT) * total + x // 2 % total, (at + LEFT) * total + x // 2 // total, ((at + OWN) * total)[x % 2 == 1]]
        dense = np.bincount(np.concatenate(places), minlength=others.num_rows * 3 * total)
        dense = dense.reshape(-1, 3, total).astype(float)
        to, _ = _best(dense, classes + others["form"].to_numpy().astype(int), grid, classes)
        return pa.table({"word": others["word"], "n": others["n"], "class": pa.array(to, pa.int32())})

    block = F.pmod(F.xxhash64("word"), F.lit(blocks))
    return beside.groupBy(block).cogroup(others.groupBy(block)).applyInArrow(evaluate, "word binary, n long, class int")


class Learned:
    """Classes and counts: of the core and the forms here, of all other words in the table ``placed``."""

    def __init__(self, core, of, counts, placed, total, tokens, vocabulary, ends, held) -> None:
        """``held``: how often a word comes at least that the dictionary ``symbols`` holds beside the core."""
        n = np.zeros(core.size)
        n[: len(counts)] = counts
        n[core.end] = ends
        self.core, self.of, self.n, self.placed, self.total = core, of, n, placed, total
        self.tokens, self.vocabulary, self.ends = tokens, vocabulary, ends
        mass, kinds = np.zeros(total), np.zeros(total)
        np.add.at(mass, of[: len(counts)], n[: len(counts)])
        np.add.at(kinds, of[: len(counts)], 1)
        sums = placed.groupBy("class").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("k"))
        for r in sums.collect():  # one row per class
            mass[r["class"]] += r["m"]
            kinds[r["class"]] += r["k"]
        self.room = np.log10(mass + ADD * (kinds + 1))
        self.floor = float(np.log10(tokens + ADD * (vocabulary + 1)))
        self.symbols, self.classes, self.counts = self.with_words(placed.where(F.col("n") >= held).collect())

    def with_words(self, others: list) -> tuple[Symbols, np.ndarray, np.ndarray]:
        """Symbols, classes and counts of the core and of further words (word, n, class)."""
        k = self.core.first_form
        symbols = Symbols([*self.core.words, *(bytes(r["word"]) for r in others)])
        of = np.r_[self.of[:k], [r["class"] for r in others], self.of[k:]].astype(np.int64)
        return symbols, of, np.r_[self.n[:k], [r["n"] for r in others], self.n[k:]]


def learn(
    training: DataFrame, core_share: float = CORE_SHARE, least: int = LEAST, classes: int = CLASSES, settled: float = SETTLED,
) -> Learned:
    """Classes of all words of the training texts."""
    counts = materialize(word_counts(training), "words")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    in_core = F.col("n") >= max(least, core_share * tokens)
    top = clustered_words(counts, max(least, core_share * tokens))
    ends, total = training.count(), classes + FORMS + 1
    core = Symbols([bytes(r["word"]) for r in top])
    of, grid = exchange(materialize(pair_counts(training, core), "pairs"), core, classes, settled)
    others = counts.where((F.col("n") >= least) & ~in_core)
    found = placed_words(contexts(training, core, of, total), others, grid, classes, max(1, kinds // PLACED_WORDS))
    rare = counts.where(F.col("n") < least).select("word", "n", (F.col("form") + classes).alias("class"))
    placed = materialize(found.unionByName(rare), "placed")
    held = core_share / DICTIONARY * tokens
    return Learned(core, of, [r["n"] for r in top], placed, total, tokens + ends, kinds + (ends > 0), ends, held)


def as_classes(docs: DataFrame, learned: Learned) -> DataFrame:
    """(doc_id, n_tokens, known, base, emitted, classes) of (doc_id, text) rows, written once.

    ``classes`` holds one byte a word; ``emitted`` sums what words cost inside their classes.
    The texts of a piece share one list of the words that tasks don't hold.  It is dealt over
    their rows, each word meets its count and class once for all of them, and the texts of
    the piece take these from there.
    """
    symbols, of, room, floor = learned.symbols, learned.classes, learned.room, learned.floor
    base = np.log10(learned.counts + ADD) - floor
    emit = np.log10(learned.counts + ADD) - room[of]
    emit[symbols.end] = 0.0  # the end is alone in its class
    shared, end = _shared(docs.sparkSession, symbols.words, of, learned.counts > 0, base, emit), symbols.end
    sums = ["known", "base", "emitted"]
    kept = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, known long, base double, emitted double, classes binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, known, base, emit = shared.value
        for b in _pieces(batches):
            words, ids, lengths = _tokens(b.column("text"))
            s, n = _known(words, held), len(lengths)
            own = s >= 0
            text = np.repeat(np.arange(n), lengths)

            def summed(values):
                return values[end] + np.bincount(text, np.where(own, values[s], 0)[ids], n)

            hole = ~own[ids]
            holes = (np.cumsum(~own) - 1)[ids[hole]].astype(np.int32)
            others = words.take(pa.array(np.flatnonzero(~own)))
            dealt = len(others) * np.arange(n + 1) // n
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lengths + 1), pa.array(summed(known).astype(np.int64)), pa.array(summed(base)),
                 pa.array(summed(emit)), _bytes(np.where(own, of[s], HOLE).astype(np.uint8)[ids], lengths),
                 _lists(pa.array(holes), np.r_[0, np.cumsum(np.bincount(text[hole], minlength=n))]),
                 pa.array(np.arange(n)), pa.array(dealt[:-1].astype(np.int32)), _lists(others, dealt)],
                names=["doc_id", "n_tokens", *sums, "classes", "holes", "place", "before", "words"],
            )

    scanned = docs.select("doc_id", "text").mapInArrow(scan, f"{kept}, holes array<int>, place long, before int, words array<binary>")
    rows, rid = with_row_id(scanned, "coded")
    rows = rows.withColumn("piece", F.col(rid) - F.col("place"))  # the rows of a piece are numbered one after another
    each = rows.select("piece", "before", F.posexplode("words").alias("at", "word"))
    # A word that training lacks has no row to take its class from.
    form = _form_column(F.col("word")) + (learned.total - FORMS - 1)
    met = each.join(learned.placed.hint("shuffle_hash"), "word", "left").select(
        F.col("piece").alias("met_piece"), (F.col("before") + F.col("at")).alias("at"), F.coalesce("class", form).alias("class"), F.coalesce("n", F.lit(0)).alias("n")
    )

    def fill(docs: pa.Table, met: pa.Table) -> pa.Table:
        docs, at = docs.combine_chunks(), met["at"].to_numpy()
        of, n = np.zeros(len(at), np.uint8), np.zeros(len(at))
        of[at], n[at] = met["class"].to_numpy(), met["n"].to_numpy()
        weight = np.log10(n + ADD)
        holes = docs["holes"].combine_chunks()
        text = np.repeat(np.arange(len(docs)), pc.list_value_length(holes).to_numpy())
        holes = holes.flatten().to_numpy()
        filled = {}
        for c, values in zip(sums, (n > 0, weight - floor, weight - room[of])):
            filled[c] = docs[c].to_numpy() + np.bincount(text, values[holes], len(docs)).astype(docs[c].to_numpy().dtype)
        classes = np.frombuffer(b"".join(docs["classes"].to_pylist()), np.uint8).copy()
        classes[classes == HOLE] = of[holes]
        filled["classes"] = _bytes(classes, pc.binary_length(docs["classes"]).to_numpy())
        return pa.table({"doc_id": docs["doc_id"], "n_tokens": docs["n_tokens"], **filled})

    texts = rows.select("piece", "doc_id", "n_tokens", *sums, "classes", "holes").groupBy("piece")
    return materialize(texts.cogroup(met.groupBy("met_piece")).applyInArrow(fill, kept), "classes")


def _steps(texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes that texts go from and to, step by step, and where each text's steps begin."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    c = _lined_up(np.frombuffer(b"".join(texts.to_pylist()), np.uint8).astype(np.int64), lengths, end)
    return c[:-1], c[1:], np.cumsum(lengths + 1) - lengths - 1


def class_pairs(texts: DataFrame, total: int) -> np.ndarray:
    """Counts of neighbouring classes in the texts of ``as_classes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(total * total, np.int64)
        for b in _pieces(batches, "classes", PIECE_STEPS):
            a, c, _ = _steps(b.column(0), total - 1)
            found += np.bincount(a * total + c, minlength=total * total)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at // total), pa.array(at % total), pa.array(found[at])], names=["a", "b", "n"])

    grid = np.zeros((total, total))
    found = texts.select("classes").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for r in found.collect():  # one row per pair of classes
        grid[r["a"], r["b"]] = r["n"]
    return grid


def transitions(grid: np.ndarray) -> np.ndarray:
    """Smoothed log10 probability of a class (column) after another one (row)."""
    return np.log10((grid + ADD) / (grid.sum(1, keepdims=True) + ADD * len(grid)))


class Model:
    """Class tables and all clustered words in one place, to look into a model whose dictionary fits there."""

    def __init__(self, learned: Learned, grid: np.ndarray, others: list) -> None:
        self.symbols, self.of, n = learned.with_words(others)
        self.step, self.room = transitions(grid), learned.room
        self.emit = np.log10(n + ADD) - self.room[self.of]
        self.emit[self.symbols.end] = 0.0


def fit(training: DataFrame, least: int = LEAST, classes: int = CLASSES, **parameters) -> tuple[Model, DataFrame]:
    """The class model of the training texts and the counts (word, form, n) of all other words.

    ``score`` does without: it leaves words outside the core in their table.
    """
    learned = learn(training, least=least, classes=classes, **parameters)
    texts = as_classes(training.select(F.lit(None).cast("long").alias("doc_id"), "text"), learned)
    others = learned.placed.where(F.col("n") >= least).collect()
    rare = learned.placed.where(F.col("n") < least).select("word", (F.col("class") - classes).alias("form"), "n")
    return Model(learned, class_pairs(texts, learned.total), others), rare


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def score(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document with base and class-model log10 probabilities."""
    source = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").cast("string").alias("text"))
    learned = learn(source.where(~is_held_out(F.col("doc_id"))).select("text"), **parameters)
    texts = as_classes(source, learned)
    total = learned.total
    step = transitions(class_pairs(texts.where(~is_held_out(F.col("doc_id"))), total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, "classes", PIECE_STEPS):
            a, c, first = _steps(b.column("classes"), total - 1)
            found = np.add.reduceat(step[a, c], first) + b.column("emitted").to_numpy()
            kept = ["doc_id", "n_tokens", "known", "base"]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(found, pa.float64())], names=[*kept, "total"])

    scored = texts.mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, known long, base double, total double"
    )
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(int(learned.tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("total").alias("score"),
        F.pow(F.lit(10.0), -F.col("total") / F.col("n_tokens")).alias("perplexity"),
    )


def _form_column(word: Column) -> Column:
    """``form_class`` as a column, for words without a training count."""
    text, n = word.cast("string"), F.octet_length(word)
    return (
        F.when(text.rlike("[0-9]"), 0)
        .when(F.length(text) < n, F.when(n < 9, 1).otherwise(2))
        .when(n < 5, 3).when(n < 8, 4).when(n < 11, 5).when(n < 16, 6).otherwise(7)
    )
