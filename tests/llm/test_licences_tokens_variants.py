"""Operators 11, 12 and 13 against plain Python on sf0.001 and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sherdloom.llm import licences, tokalign, variants
from sherdloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FOLDER = "/opt/tokenizers"
ODD = [
    None, "", " ", "\n\n", "a", "Released under the MIT License.", "cc by cc by CC-BY cc by", "é ÀÉ ß ×÷", "\x00 nul \x1f",
    "▁ low line", "  two  blanks ", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト", "😀😀 á", "ﬁ ² ½ Ⅳ",
    "gnu general public license " * 400, "word " * 20000, "x" * 30000, "tab\tnew\r\nline",
    "The GNU General  Public-License; the apache\nlicense, version 2.0 (the License)",
]


def odd_rows(spark):
    rows = [(k, t, "x", 1, True) for k, t in enumerate(ODD)] + [(None, "cc by", "y", 2, None), (5, ODD[5], "z", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, word int, bundle boolean")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- licences ----------------------------------------------------------------------

def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [
        (at, label)
        for label, phrase in licences.PHRASES.items()
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    ]
    starts = [at for at, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})),
    )


def check_licences(rows, got):
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    want = {d: brute_base(t) for d, t in rows}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")}
        assert r.labels == ",".join(sorted(r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_licence_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_licences(rows, QUERIES["op11_licence_scan"](spark, SF).collect())


def test_licences_of_odd_rows(spark):
    rows = odd_rows(spark)
    check_licences([(r.doc_id, r.text) for r in rows.collect()], licences.report(rows).collect())
    assert licences.report(rows.where("false")).count() == 0


def test_automaton_knows_every_substring():
    rng = random.Random(5)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 5))]
        a = licences.Automaton(sequences)
        places = defaultdict(set)
        for k, s in enumerate(sequences):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    places[tuple(s[i:j])].add((k, j))
        for part, at in places.items():
            state = 0
            for w in part:
                state = a.next[state][w]
            assert set(a.places[state]) == at and len(a.places[state]) == len(at)
            assert a.size[a.link[state]] < len(part) <= a.size[state]


def test_matches_are_all_maximal_ones():
    rng = random.Random(6)
    for _ in range(300):
        alphabet = [f"w{k}" for k in range(3)]
        templates = {str(k): [" ".join(rng.choices(alphabet, k=rng.randrange(3, 12)))] for k in range(3)}
        s = licences.Scanner({"p": "w0 w1"}, templates, 3)
        text = rng.choices([*alphabet, "other"], k=30)
        _, found = s.matches(text)
        for k, sequence in enumerate(s.sequences):
            names = [w for i in sequence for w in s.ids if s.ids[w] == i]
            want = set()
            for i in range(len(text)):
                for j in range(len(names)):
                    if i and j and text[i - 1] == names[j - 1]:
                        continue
                    n = 0
                    while i + n < len(text) and j + n < len(names) and text[i + n] == names[j + n]:
                        n += 1
                    if n >= min(3, len(names)):
                        want.add((i, i + n, j, j + n))
            assert set(found.get(k, [])) == want


@pytest.mark.parametrize("text, labels", [
    ("Alpha beta. All Rights Reserved. Gamma", {"all-rights-reserved"}),
    (licences.TEMPLATES["lgpl"][0], {"lgpl"}),  # and not gpl, which shares most of its words
    (licences.TEMPLATES["gpl"][0].replace("redistribute", "spread"), {"gpl"}),  # one word changed
    ("x " * 50 + licences.TEMPLATES["mit"][0].replace(" free of charge,", " at no cost whatsoever,") + " y" * 50, {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
    ("permission to use rights to copy conditions of software", set()),
])
def test_chained_labels(text, labels):
    s = licences.Scanner(licences.PHRASES, licences.TEMPLATES, licences.LONG)
    words = licences.words(text)
    base, spans, _ = s.scan(words)
    assert {label for _, label, _ in base} | {label for label, *_ in spans} == labels
    for label, k, start, end, covered, share in spans:
        assert 0 <= start < end <= len(words) and covered <= end - start and share == covered / len(s.sequences[k])


def test_scan_gives_spans_of_own_templates(spark):
    docs = spark.createDataFrame([(1, "one two three four five six and seven eight nine ten eleven")], "doc_id int, text string")
    got = licences.scan(docs, {"own": ["one two three four five six seven eight nine ten eleven"]}, {"nine": "nine ten"}).first()
    assert [(p.label, p.start, p.end) for p in got.base] == [("nine", 9, 11)]
    assert [(s.label, s.start, s.end, s.covered, s.share) for s in got.spans] == [("own", 0, 12, 11, 1.0)]


# --- token alignment ---------------------------------------------------------------

A = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")


def byte_letters():
    """The bytes that the byte-level entries are spelled in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = byte_letters()


def brute_tokens(text):
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in A.id_to_token(k)) for k in a]
    bytes_b = []
    for k in b:
        p = B.id_to_piece(k)
        bytes_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    return a, b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()


def brute_groups(a, b, ends_a, ends_b):
    cuts, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for cut in cuts:
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def brute_links(ends_a, ends_b):
    out, j = [], 0
    for i, end in enumerate(ends_a):
        start = ends_a[i - 1] if i else 0
        while ends_b[j] <= start:
            j += 1
        k = j
        while k < len(ends_b) and (ends_b[k - 1] if k else 0) < end:
            out.append((i, k))
            k += 1
    return out


def check_alignment(rows, got):
    found = [(d, *brute_tokens(t)) for d, t in rows]
    links = [brute_links(x[3], x[4]) for x in found]
    counts = Counter(p for x, each in zip(found, links) for p in {(x[1][i], x[2][j]) for i, j in each})
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter()
    for (d, a, b, ea, eb), each in zip(found, links):
        groups = brute_groups(a, b, ea, eb)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [counts[a[i], b[j]] for i, j in each]
        best = sum(c == most[a[i]] for c, (i, _) in zip(n, each))
        want[d, len(a), len(b), len(groups), len(each), best, sum(n), hashlib.sha256(spelled.encode()).hexdigest() if a else ""] += 1
    assert Counter(
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got
    ) == want


@pytest.mark.parametrize("bundle", [None, 500])
def test_alignment_query(spark, monkeypatch, bundle):
    if bundle:  # many bundles of few documents, and blocks of one
        monkeypatch.setattr(tokalign, "BUNDLE", bundle)
        monkeypatch.setattr(tokalign, "BLOCK", 2000)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_alignment(rows, QUERIES["op12_token_alignment"](spark, SF).collect())


def test_alignment_of_odd_rows(spark):
    rows = odd_rows(spark)
    check_alignment([(r.doc_id, r.text) for r in rows.collect()], tokalign.report(rows).collect())
    assert tokalign.report(rows.where("false")).count() == 0


def test_both_vocabularies_of_a_agree():
    codec = tokalign.codec(FOLDER)
    assert [codec.a.decode_single_token_bytes(k) for k in range(50256)] == [
        bytes(LETTERS[c] for c in A.id_to_token(k)) for k in range(50256)
    ]
    rng = random.Random(7)
    signs = ["'s", "'LL", " ", "  ", "\t", "\r\n", "é", "́", "‍", " ", "\u0085", "　", "1", "²", "中", "😀", "_", "\x1c", "Ab"]
    for _ in range(500):
        text = "".join(rng.choices(signs, k=30))
        assert codec.a.encode_ordinary(text) == A.encode(text, add_special_tokens=False).ids


def test_gallop_finds_every_rank():
    rng = np.random.default_rng(8)
    for n in (1, 2, 10, 500):
        long = np.unique(rng.integers(1, 3 * n, n))
        for m in (1, 3, len(long)):
            short = np.unique(np.r_[rng.choice(np.arange(1, long[-1] + 1), min(m, long[-1])), long[-1]])
            for stripes in (1, 3, 4096):
                assert (tokalign.gallop(short, long, stripes) == np.searchsorted(long, short)).all()


def test_aligned_groups_and_links(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for r in tokalign.align(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        a, b, ea, eb = brute_tokens(r.text)
        assert [(g.a, g.b) for g in r.groups] == brute_groups(a, b, ea, eb)
        assert [g.end for g in r.groups] == sorted(set(ea) & set(eb))
        assert all(g.start == h.end for h, g in zip(r.groups, r.groups[1:]))
        assert sorted((x.a, x.b) for x in r.links) == brute_links(ea, eb)


# --- spelling variants -------------------------------------------------------------

def brute_vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute_variants(vocabulary):
    near = defaultdict(list)
    by_size = defaultdict(list)
    for w in vocabulary:
        by_size[len(w)].append(w)
    for w in vocabulary:
        near[w] = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_edit(w, x)]
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), form[w] and vocabulary[form[w]]) for w, n in vocabulary.items()}


def as_rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variant_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_vocabulary(rows))
    assert as_rows(QUERIES["op13_spelling_variants"](spark, SF)) == want
    assert any(form for _, form, *_ in want)


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_variants_in_crowded_groups(spark, most):
    """Words with long common beginnings, ends and middles; groups of any size are split until they fit."""
    rng = random.Random(9)
    words = {"abcdef", "abcdeg", "abcde", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÿ" * 40, "ÿ" * 41}
    for _ in range(300):
        head, tail = rng.choice(["", "a" * 9, "stem"]), rng.choice(["", "b" * 9, "ending"])
        words.add(head + "".join(rng.choices("abé", k=rng.randrange(5, 9))) + tail)
    vocabulary = {w: rng.choice([5, 6, 30, 200, 1000]) for w in words}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert as_rows(variants.group_variants(df, most=most)) == brute_variants(vocabulary)


def test_variants_follow_chains(spark):
    words = [("aaaaaab", 5), ("aaaaabb", 25), ("aaaabbb", 125), ("aaabbbb", 625), ("aabbbbb", 3125), ("zzzzzz", 7)]
    got = {w: (form, root) for w, form, root, *_ in as_rows(variants.group_variants(spark.createDataFrame(words, "word string, n long")))}
    assert got["aaaaaab"] == ("aaaaabb", "aabbbbb") and got["zzzzzz"] == (None, "zzzzzz")


def test_variants_of_odd_rows(spark):
    texts = [*ODD, "Colour COLOUR colour colour colour color's colours " * 3, "colouR×÷ " * 20, "q" * 20000]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] * 2 + [(None, "nameless " * 9, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    assert as_rows(variants.report(docs)) == brute_variants(brute_vocabulary([r[:2] for r in rows]))
    assert variants.report(docs.where("false")).count() == 0
