"""Two tokenizations of one text, aligned by galloping intersection of their end lists.

A text is encoded by two tokenizers; each gives a rising list of byte offsets at which its
tokens end.  The shorter list drives: from where the last search stopped, a step that
doubles brackets the next end in the longer list and a binary search settles it.  Ends in
both lists cut the tokens into groups, and the ranks found for two neighbouring ends of
the driver differ by the tokens of the other side that overlap the token between them.
Tasks search in many stripes of the lists side by side, each galloping from its own head.

Corpus-wide counts of linked id pairs need no row per document and pair.  Documents are
bundled, in reading order, up to some ``BUNDLE`` links; a bundle lists its distinct pairs once,
with the number of its documents that hold each, and documents keep positions in
that list.  Counts meet bundles in shuffled joins, then each bundle its documents.
What a task holds is one bundle, so the bound is ``BUNDLE`` links and one document.

Defined results: texts that are null or empty, or whose tokens do not give back a space and
the text, have no tokens and zeros; strings that look like special tokens are plain text; a null
doc id stays null; repeated rows are aligned and counted each for themselves; an empty table
gives no rows; texts of any length are encoded whole; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import col

FOLDER = "/opt/tokenizers"
# The entries of byte_bpe_50k.json as ranks; tests hold the two against each other.
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
# Fixed value: the published pattern that cuts a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUNDLE = 1 << 22  # links after which a bundle of documents is closed
BLOCK = 1 << 21  # bytes of texts that are aligned at once
STRIPES = 4096
ID_BITS = 32  # a pair is one whole number: A's id above B's


class Codec:
    """The two tokenizers, with the bytes of every token."""

    def __init__(self, folder: str) -> None:
        with open(os.path.join(folder, RANKS), "rb") as file:
            ranks = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        bytes_a = sorted(ranks, key=ranks.get)
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.size_a = np.array([len(x) for x in bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # Decimal ids with the mark that follows them.
        self.spelled = np.array(
            [f"{k}{mark}".encode() for ids, marks in ((bytes_a, ",|"), (self.bytes_b, ",;")) for mark in marks for k in range(len(ids))],
            object,
        )

    def _piece(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[3:5], 16)])
        return self.b.id_to_piece(k).replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both tokenizers; both empty where the tokens do not give back the text."""
        if not text:
            return [], []
        whole = " " + text
        raw = whole.encode()
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return [], []
        a = self.a.encode_ordinary(whole)
        return (a, b) if self.a.decode_bytes(a) == raw else ([], [])


@lru_cache(maxsize=1)
def codec(folder: str) -> Codec:
    """One per worker process."""
    return Codec(folder)


def gallop(short: np.ndarray, long: np.ndarray, stripes: int = STRIPES) -> np.ndarray:
    """Index in ``long`` of the first end not below each end of ``short``.

    Both rise strictly and end alike.  Every stripe of ``short`` goes on from the index it found last.
    """
    out = np.empty(len(short), np.int64)
    if not len(short):
        return out
    stride = -(-len(short) // stripes)
    heads = np.arange(0, len(short), stride)
    at = np.searchsorted(long, short[heads])
    last = len(long) - 1
    for k in range(stride):
        heads = heads[heads + k < len(short)]
        at = at[: len(heads)]
        want = short[heads + k]
        # Doubling steps: ``low`` is below the wanted end, ``high`` is not or is still moving.
        low, high, step = at - 1, at, 1
        behind = long[high] < want
        while behind.any():
            low = np.where(behind, high, low)
            high = np.where(behind, np.minimum(high + step, last), high)
            step *= 2
            behind = long[high] < want
        while (high - low > 1).any():
            middle = (low + high) // 2
            under = long[middle] < want
            open_ = high - low > 1
            low = np.where(open_ & under, middle, low)
            high = np.where(open_ & ~under, middle, high)
        out[heads + k] = at = high
    return out


class Aligned:
    """A block of texts, aligned: ids, groups and links of all its documents together."""

    def __init__(self, codec: Codec, texts: list[str | None]) -> None:
        both = [codec.encode(t) for t in texts]
        self.codec, self.docs = codec, len(texts)
        self.n_a = np.array([len(a) for a, _ in both], np.int64)
        self.n_b = np.array([len(b) for _, b in both], np.int64)
        self.a = np.fromiter(chain.from_iterable(a for a, _ in both), np.int64, self.n_a.sum())
        self.b = np.fromiter(chain.from_iterable(b for _, b in both), np.int64, self.n_b.sum())
        # Offsets run on through the block: all documents end in both lists.
        ends_a, ends_b = np.cumsum(codec.size_a[self.a]), np.cumsum(codec.size_b[self.b])
        turned = len(ends_a) > len(ends_b)
        short, long = (ends_b, ends_a) if turned else (ends_a, ends_b)
        rank = gallop(short, long)
        common = long[rank] == short
        cut_short, cut_long = np.flatnonzero(common), rank[common]
        self.cut_a, self.cut_b = (cut_long, cut_short) if turned else (cut_short, cut_long)  # last token of each group
        self.ends = ends_a[self.cut_a]  # byte offset at which each group ends
        # A token overlaps what lies between the rank of the end before it and its own.
        first = np.r_[0, rank[:-1] + common[:-1]] if len(rank) else rank
        width = rank - first + 1
        driver = np.repeat(np.arange(len(rank)), width)
        other = np.arange(len(driver)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
        self.link_a, self.link_b = (other, driver) if turned else (driver, other)
        self.doc_a = np.repeat(np.arange(self.docs), self.n_a)
        self.link_doc = self.doc_a[self.link_a]
        self.group_doc = self.doc_a[self.cut_a]
        self.n_groups = np.bincount(self.group_doc, minlength=self.docs)
        self.n_links = np.bincount(self.link_doc, minlength=self.docs)

    def digests(self) -> list[str]:
        """SHA-256 of the spelled-out groups of each document; empty without tokens."""
        n_a, n_b = len(self.codec.size_a), len(self.codec.size_b)
        closes_a, closes_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        closes_a[self.cut_a] = closes_b[self.cut_b] = True
        # In a group A's tokens come first: tokens of B before it, and of A up to its end.
        before_b = np.r_[0, self.cut_b[:-1] + 1] if len(self.cut_b) else self.cut_b
        group_a = np.cumsum(closes_a) - closes_a
        group_b = np.cumsum(closes_b) - closes_b
        spelled = np.empty(len(self.a) + len(self.b), np.int64)
        spelled[np.arange(len(self.a)) + before_b[group_a]] = self.a + np.where(closes_a, n_a, 0)
        spelled[np.arange(len(self.b)) + self.cut_a[group_b] + 1] = 2 * n_a + self.b + np.where(closes_b, n_b, 0)
        pieces = self.codec.spelled[spelled]
        ends = np.cumsum(self.n_a + self.n_b)
        return [
            hashlib.sha256(b"".join(pieces[end - size : end].tolist())[:-1]).hexdigest() if size else ""
            for size, end in zip((self.n_a + self.n_b).tolist(), ends.tolist())
        ]

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct linked pairs of each document and how often it has each."""
        keys = (self.a[self.link_a] << ID_BITS) | self.b[self.link_b]
        # Links may lie in the order of either side, but documents follow each other.
        ends = np.cumsum(self.n_links)
        return [
            np.unique(keys[end - size : end], return_counts=True)
            for size, end in zip(self.n_links.tolist(), ends.tolist())
        ]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, pa.DataType]]:
    """(ids, texts, type of the ids) of some ``BLOCK`` bytes each."""
    ids, texts, size, kind = [], [], 0, None
    for b in batches:
        kind = b.column(0).type
        for doc_id, text in zip(b.column(0), b.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= BLOCK:
                yield ids, texts, kind
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, kind


def _source(docs: DataFrame) -> tuple[DataFrame, str]:
    source = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").cast("string").alias("text"))
    return source, docs.schema["doc_id"].dataType.simpleString()


def align(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, groups, links) of every text.

    A group has the ids of both sides and its byte range in a space and the text; a link is a
    pair of token positions whose bytes overlap.
    """
    source, kind = _source(docs)
    ids_type, group, link = pa.list_(pa.int32()), pa.struct, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    groups_type = pa.list_(group([("a", ids_type), ("b", ids_type), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, arrow in _blocks(batches):
            x = Aligned(codec(folder), texts)
            groups: list[list] = [[] for _ in ids]
            a, b, begin = 0, 0, 0
            origin = np.r_[0, np.cumsum(x.n_a), 0]
            origin_b = np.r_[0, np.cumsum(x.n_b), 0]
            first = 0  # byte offset at which the document begins
            held = -1
            for doc, to_a, to_b, end in zip(x.group_doc.tolist(), x.cut_a.tolist(), x.cut_b.tolist(), x.ends.tolist()):
                if doc != held:
                    held, first = doc, begin
                groups[doc].append(
                    {"a": x.a[a : to_a + 1].tolist(), "b": x.b[b : to_b + 1].tolist(), "start": begin - first, "end": end - first}
                )
                a, b, begin = to_a + 1, to_b + 1, end
            links: list[list] = [[] for _ in ids]
            for doc, i, j in zip(x.link_doc.tolist(), x.link_a.tolist(), x.link_b.tolist()):
                links[doc].append({"a": i - int(origin[doc]), "b": j - int(origin_b[doc])})
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow), pa.array(groups, groups_type), pa.array(links, link)], names=["doc_id", "groups", "links"]
            )

    return source.mapInArrow(
        run,
        f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>,start:bigint,end:bigint>>, "
        "links array<struct<a:int,b:int>>",
    )


def _bundled(docs: DataFrame, folder: str) -> DataFrame:
    """One row per document: counts, digest, its bundle, and its pairs as rising positions.

    ``gaps`` are the differences of the positions, which pack well; a bundle's first row
    carries its list of pairs and the documents that hold each.
    """
    source, kind = _source(docs)
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    names = ["doc_id", "bundle", *numbers, "groups_sha256", "gaps", "times", "pairs", "holders"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        links = 0

        def close(arrow):
            nonlocal part
            pairs, at, holders = np.unique(
                np.concatenate([np.empty(0, np.int64), *[p for p, _ in held]]), return_inverse=True, return_counts=True
            )
            size = np.array([len(p) for p, _ in held])
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            gaps = np.diff(at, prepend=0)
            begins = ends[:-1][size > 0]
            gaps[begins] = at[begins]
            times = np.concatenate([np.empty(0, np.int64), *[t for _, t in held]])

            def lists(values):
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))

            rest = [None] * (len(rows) - 1)
            columns = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], arrow), pa.array([part] * len(rows), pa.int64()),
                    *[pa.array(c, pa.int64()) for c in columns[1:5]], pa.array(columns[5], pa.string()),
                    lists(gaps), lists(times),
                    pa.array([pairs, *rest], pa.list_(pa.int64())), pa.array([holders.astype(np.int32), *rest], pa.list_(pa.int32())),
                ],
                names=names,
            )
            part += 1
            return batch

        for ids, texts, arrow in _blocks(batches):
            x = Aligned(codec(folder), texts)
            for doc_id, *row, pair in zip(
                ids, x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), x.n_links.tolist(), x.digests(), x.pairs()
            ):
                rows.append((doc_id, *row))
                held.append(pair)
                links += row[3]
                if links >= BUNDLE:
                    yield close(arrow)
                    rows, held, links = [], [], 0
        if rows:
            yield close(arrow)

    return source.mapInArrow(
        run,
        f"doc_id {kind}, bundle long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "gaps array<int>, times array<int>, pairs array<bigint>, holders array<int>",
    )


def pair_counts(bundled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle, at, pair) of all bundles, and (pair, n, best): documents with each pair, and whether A's id has no commoner."""
    zipped = F.arrays_zip("pairs", "holders")
    each = bundled.where("pairs is not null").select("bundle", F.posexplode(zipped).alias("at", "p")).select(
        "bundle", "at", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders")
    )
    counts = each.groupBy("pair").agg(F.sum("holders").alias("n")).withColumn("a", F.shiftright("pair", ID_BITS))
    counts = materialize(counts, "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    best = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return each.select("bundle", "at", "pair"), best


def _settle(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bundle's documents with the counts of their pairs."""
    at = right.column("at").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at] = right.column("n").to_numpy()
    best[at] = right.column("best").to_numpy().astype(np.int64)
    gaps = left.column("gaps").combine_chunks()
    times = left.column("times").combine_chunks()
    ends = np.r_[0, np.cumsum(gaps.value_lengths().to_numpy())].astype(np.int64)
    moved = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
    # Positions start anew in every document.
    before = np.r_[0, moved][ends[:-1]]
    held = moved - np.repeat(before, np.diff(ends))
    often = times.flatten().to_numpy().astype(np.int64)

    def total(values):
        run = np.r_[0, np.cumsum(values)]
        return pa.array(run[ends[1:]] - run[ends[:-1]], pa.int64())

    kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", total(often * best[held])).append_column("count_sum", total(often * n[held]))
    return kept.append_column("groups_sha256", left.column("groups_sha256"))


def report(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Counts and digest of the alignment of every text, with corpus-wide counts of linked id pairs."""
    bundled = materialize(_bundled(docs, folder), "bundles")
    each, counts = pair_counts(bundled)
    met = each.join(counts, "pair").select(F.col("bundle").alias("met_bundle"), "at", "n", "best")
    texts = bundled.drop("pairs", "holders")
    schema = (
        f"doc_id {bundled.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
        "n_best long, count_sum long, groups_sha256 string"
    )
    return texts.groupBy("bundle").cogroup(met.groupBy("met_bundle")).applyInArrow(_settle, schema)
