"""Operators 1, 2, 5, 7 and 10 against plain Python on sf0.001 and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sherdloom.llm import brown, fixity, pages, pii, urls
from sherdloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- urls --------------------------------------------------------------------------

ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/es/x", "http://www.example.org/en/1?x=/q", "a://b://c/d",
    "http://shop.com/fr/1", "http://shop.com/de/1", "http://notexample.org", "http://example.org", "http://myorg/",
    "http://example.org/en/2#/en/1", "http://É.com/De/", "http://com/de/", "x://example.org/en/12/3/4/5/6",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def brute_rule(host, path):
    fit = [
        (h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_url_rules_and_odd_urls(spark):
    rows = spark.createDataFrame([(k, u, None) for k, u in enumerate(ODD_URLS)] * 2, "page_id long, url string, bad int")
    got = urls.judge(rows).collect()
    assert len(got) == 2 * len(ODD_URLS)
    for r in got:
        host, path = brute_parts(ODD_URLS[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.judge(rows.where("false")).count() == 0


def test_url_query(spark):
    pages_ = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op1_url_templates"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages_)
    for r in got:
        host, path = brute_parts(pages_[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict)


def brute_templates(paths):
    """Template of every (host, path) of a list, level by level."""
    rows = [[h, [s for s in p.split("/") if s], ""] for h, p in paths]
    for level in range(urls.LEVELS):
        child = Counter((h, t, s[level]) for h, s, t in rows if len(s) > level)
        total = Counter((h, t) for h, s, t in rows if len(s) > level)
        for row in rows:
            h, s, t = row
            if len(s) > level:
                n = child[h, t, s[level]]
                own = n >= urls.SUPPORT and n * urls.BRANCHES >= total[h, t]
                row[2] = f"{t}/{s[level] if own else '*'}"
    return [t + "/**" * (len(s) > urls.LEVELS) for _, s, t in rows]


def test_url_templates_learn_bad_branches(spark):
    rng = random.Random(1)
    rows = []
    for k in range(2000):
        host = "hot.net" if k % 3 else f"h{k % 40}.net"
        section = rng.choice(["news", "spam", "junk", "blog"])
        url = f"http://{host}/{section}/{rng.randrange(10**6)}/a" + "/b/c" * (k % 2)
        bad = int(rng.random() < (0.95 if section in ("spam", "junk") else 0.05)) if k % 5 < 2 else None
        rows.append((k, url, bad))
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in urls.judge(frame, rules=()).collect()}
    want = brute_templates([brute_parts(u) for _, u, _ in rows])
    assert [got[k].template for k in range(2000)] == want
    hot = [r for r in got.values() if r.host == "hot.net"]
    assert all((r.verdict == "block") == (r.path.split("/")[1] in ("spam", "junk")) for r in hot)


def test_similar_branches_share_their_labels(spark):
    rows = [("m.net", "", t, int(k < bad)) for t, bad in (("/a", 9), ("/b", 8), ("/c", 0)) for k in range(10)]
    frame = spark.createDataFrame(rows, "host string, parent string, template string, bad int")
    got = {r.template: (r.labelled, r.purity) for r in urls.branch_purity(frame).collect()}
    assert got["/a"] == got["/b"] and got["/a"][0] == 20 and got["/c"][0] == 10
    assert got["/a"][1] == pytest.approx((17 + urls.PRIOR * 17 / 30) / (20 + urls.PRIOR))


# --- personal data -----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_base(text):
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, regex, lo, hi in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in regex.finditer(text):
            n = sum(c in "0123456789" for c in m[0])
            if lo <= n <= hi and (kind == "phone" or luhn(m[0])):
                out.append((kind, m))
    order = ["email", "ip", "card", "phone"]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda s: (s[1], order.index(s[0])))


def test_base_matches_patterns_on_random_text():
    rng = random.Random(7)
    finder = pii.Finder()
    for alphabet in ("0123456789.-+ @a", "01.@", "a@b.-+ ", "4111 -.+()@x\n", "٣1.2+éa@b"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
            base, spans = finder.find(text)
            assert base == brute_base(text), text
            assert set(base) <= set(spans)


def test_cues_add_validated_spans():
    finder = pii.Finder()
    found = lambda t: [(k, t[a:b]) for k, a, b in finder.find(t)[1]]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert found("see ftp://joe:secret@host.net/x") [0][0] == "account"
    assert ("address", "joe.d [at] mail [dot] example [dot] org") in found("write joe.d [at] mail [dot] example [dot] org now")
    assert ("account", "123-45-6789") in found("SSN: 123-45-6789.")
    assert found("assn 123-45-6789 and lessons at noon") == []
    assert ("phone", "030 1234567") in found("tel: 030 1234567")


def test_pii_query_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None), (-1, ""), (-2, "1" * 200_000 + "@"), (-3, "+1 (555) 123-4567 " * 3000), (-3, "é 1.2.3.4 a@b.c")],
        "doc_id long, text string",
    )
    both = docs.select("doc_id", "text").unionByName(odd).withColumns({"base": F.lit(1), "spans": F.lit(2)})
    texts = both.collect()
    got = pii.report(both).collect()
    want = []
    for r in texts:
        base = brute_base(r.text or "")
        n = Counter(k for k, _, _ in base)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((r.doc_id, n["email"], n["ip"], n["card"], n["phone"], sha))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert pii.report(both.where("false")).count() == 0
    assert QUERIES["op2_personal_data"](spark, SF).count() == docs.count()


def test_masked(spark):
    frame = spark.createDataFrame([(1, "mail a@b.cc or 10.0.0.1."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.masked(frame).collect()}
    assert got == {1: "mail <email> or <ip>.", 2: None}


# --- language model ----------------------------------------------------------------


def brute_lm(rows):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for d, t in rows:
        w = tokens(t)
        c = [counts[x] for x in w] + [ends]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        out.append((d, held(d), len(c), sum(x > 0 for x in c), n, base))
    return out


def same_scores(got, want):
    key = lambda r: (repr(r[0]), r[2], r[3], round(r[5], 4))
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def test_lm_query_beats_unigrams_on_held_out_text(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_brown_scoring"](spark, SF).collect()
    same_scores(got, brute_lm(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd_rows(spark):
    rows = [(None, None), (None, "a b"), (1, ""), (2, "Ä ä 12 word"), (2, "Ä ä 12 word"), (3, "x " * 5000), (4, "a b a b")]
    rows += [(k, f"the w{k} of w{k % 7}") for k in range(10, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "word": F.lit("w")})
    got = brown.score(frame, least=2, core_share=0.005, classes=3).collect()
    same_scores(got, brute_lm(rows))
    assert brown.score(frame.where("false")).count() == 0
    nothing = frame.where("doc_id = 3").withColumn("doc_id", F.lit(7).cast("long"))  # any fold
    assert brown.score(nothing).count() == 1


def test_lm_score_against_brute_force(spark):
    """Given the classes, counts, transitions and emissions follow from the texts alone."""
    rows = [(k, f"the w{k % 9} of w{k % 7} and r{k} Ä{k % 3} the the") for k in range(60)] + [(60, None), (61, "x " * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    training = [t for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    parameters = {"least": 3, "core_share": 0.04, "classes": 3}
    model, _ = brown.fit(spark.createDataFrame([(t,) for t in training], "text string"), **parameters)
    end, total = 3 + brown.FORMS, 4 + brown.FORMS
    n = Counter(w for t in training for w in brown._words(t))
    clustered = {w: int(model.of[k]) for k, w in enumerate(model.symbols.words)}
    assert set(clustered) == {w for w in n if n[w] >= 3} and max(clustered.values()) < 3
    assert sum(n[w] < 0.04 * sum(n.values()) for w in clustered) > 0  # some are outside the core

    def class_of(w):
        return clustered.get(w, 3 + brown.form_class(w))

    grid = Counter()
    for t in training:
        c = [end, *map(class_of, brown._words(t)), end]
        grid.update(zip(c, c[1:]))
    leaves = Counter()
    for (a, _), k in grid.items():
        leaves[a] += k
    mass, kinds = Counter(), Counter()
    for w, k in n.items():
        mass[class_of(w)] += k
        kinds[class_of(w)] += 1
    for r in brown.score(frame, **parameters).collect():
        words = brown._words(dict(rows)[r.doc_id])
        c = [end, *map(class_of, words), end]
        want = sum(math.log10((grid[p] + 0.1) / (leaves[p[0]] + 0.1 * total)) for p in zip(c, c[1:]))
        want += sum(math.log10((n[w] + 0.1) / (mass[class_of(w)] + 0.1 * (kinds[class_of(w)] + 1))) for w in words)
        assert r.score == pytest.approx(want)


def test_clustered_words_do_not_hang_on_the_size(spark, monkeypatch):
    """Three times are enough beside any number of other words, and only the core is a dictionary of the tasks."""
    long = " ".join(f"w{k % 50}" for k in range(150_000))
    rows = [("rare word here " * 3,), (long,)] + [(long,) for _ in range(3)]
    frame = spark.createDataFrame(rows, "text string")
    held = []
    real = brown.Symbols.__init__
    monkeypatch.setattr(brown.Symbols, "__init__", lambda self, words: held.append(len(words)) or real(self, words))
    parameters = {"least": 3, "core_share": 2.0**-10, "classes": 3, "settled": 1.0}
    learned = brown.learn(frame, **parameters)
    assert {bytes(r.word): r.n for r in learned.placed.where("class < 3").collect()} == {b"rare": 3, b"word": 3, b"here": 3}
    # 2**-22 of some 2**24 tokens was the least share of a clustered word
    many = brown.learn(frame.crossJoin(spark.range(30)).where("id = 0 or text like 'w%'").select("text"), **parameters)
    assert many.tokens > 2**24 and {bytes(r.word) for r in many.placed.where("class < 3").collect()} == {b"rare", b"word", b"here"}
    assert max(held) == 50


def test_words_of_a_piece_of_texts_are_listed_once(spark, monkeypatch):
    """Tasks hold and send on the words outside the dictionary once for many texts, not for each of them."""
    rows = [(k, "the " * 20 + " ".join(f"r{w}" for w in range(40))) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tables = {}
    real = brown.with_row_id
    monkeypatch.setattr(brown, "with_row_id", lambda df, tag: tables.setdefault(tag, real(df, tag)))
    learned = brown.learn(frame.select("text"), least=3, core_share=0.2, classes=3, settled=1.0)
    texts = brown.as_classes(frame, learned)
    assert tables["coded"][0].select(F.sum(F.size("words"))).first()[0] == 40
    assert {(r.n_tokens, r.known, len(r.classes)) for r in texts.collect()} == {(61, 61, 60)}


def test_pieces_hold_every_row_and_little_text():
    texts = ["a" * 10, None, "", "b" * 500, *["c" * 30] * 50]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    pieces = [p.column(0).to_pylist() for p in brown._pieces(iter([batch, batch.slice(0, 0)]), size=100)]
    assert sum(pieces, []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 100 for p in pieces)


def test_tokens_are_the_words_of_each_text(spark):
    texts = [" a\x0bB\x1cc\x0c d\r\n", None, "", "  ", "Ä ä\u00a0x A a", "a\x85b 12 longerthan16letters\u00e9"]
    words, ids, lengths = brown._tokens(pa.array(texts))
    found = iter([words[int(k)].as_py() for k in ids])
    assert [[next(found) for _ in range(n)] for n in lengths] == [brown._words(t) for t in texts]
    assert list(brown._forms(words)) == [brown.form_class(w) for w in words.to_pylist()]


def test_model_is_a_distribution(spark):
    """Over all words, an unknown one of each form and the end, probabilities sum to one."""
    rows = [(f"the w{k} of w{k % 7} Ä{k % 3} 5",) for k in range(40)]
    frame = spark.createDataFrame(rows, "text string")
    model, rare = brown.fit(frame, least=2, core_share=0.1, classes=3)
    s = model.symbols
    of = model.of
    emit = np.zeros(len(model.step))
    np.add.at(emit, of[: s.first_form], 10 ** model.emit[: s.first_form])
    for r in rare.collect():
        emit[of[s.first_form + r["form"]]] += 10 ** (math.log10(r["n"] + 0.1) - model.room[of[s.first_form + r["form"]]])
    unknown = 10 ** (math.log10(0.1) - model.room)
    emit[: of[s.end]] += unknown[: of[s.end]]
    emit[of[s.end]] = 1
    assert emit == pytest.approx(np.ones(len(emit)))
    assert (10**model.step).sum(1) == pytest.approx(np.ones(len(emit)))


def test_exchange_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(0)
    words, classes, total = 30, 4, 6
    pairs = rng.integers(0, 5, (words + 2, words + 2)).astype(float)
    of = np.r_[rng.integers(0, classes, words), [4, 5]]

    def grid(of):
        g = np.zeros((total, total))
        np.add.at(g, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), pairs)
        return g

    for w in range(words):
        a = of[w]
        right, left = np.zeros(total), np.zeros(total)
        np.add.at(right, of, pairs[w])
        np.add.at(left, of, pairs[:, w])
        right[a] -= pairs[w, w]
        left[a] -= pairs[w, w]
        to, gain = brown.best_class(a, right, left, pairs[w, w], grid(of), classes)
        tries = []
        for b in range(classes):
            moved = of.copy()
            moved[w] = b
            tries.append(brown.likelihood(grid(moved)) - brown.likelihood(grid(of)))
        assert gain == pytest.approx(max(tries), abs=1e-6) and tries[to] == pytest.approx(max(tries), abs=1e-6)


def test_forms_agree(spark):
    words = ["a", "abcd", "abcde", "abcdefgh", "abcdefghijk", "abcdefghijklmnop", "é", "ééééé", "a1", "é1", "longéwordlong"]
    frame = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    got = [r.f for r in frame.select(brown._form_column(F.col("word")).alias("f")).collect()]
    assert got == [brown.form_class(w.encode()) for w in words]


# --- fixity ------------------------------------------------------------------------


def test_audit_finds_planted_faults(spark):
    rng = random.Random(3)
    rows = [(k % 3, k * 7 - 300, f"payload {k}") for k in range(700)] + [(None, None, None), (None, None, ""), (1, None, "x"), (0, 5, "twin"), (0, 5, "twin")]
    mine = spark.createDataFrame(rows, "archive long, offset long, payload string")
    bad = {}
    other = []
    for r in rows[:-5]:
        u = rng.random()
        if u < 0.02:
            bad[r[:2]] = "missing"
        elif u < 0.04:
            bad[r[:2]] = "changed"
            other.append((r[0], r[1], r[2] + "?"))
        else:
            other.append(r)
    other += rows[-5:-1] + [(9, 1, "new")]  # one twin less, one record more
    bad |= {(0, 5): "changed", (9, 1): "added"}
    other = spark.createDataFrame(other, "archive long, offset long, payload string")
    got = {(r.archive, r.offset): r.status for r in fixity.audit(mine, other).collect()}
    assert got == bad
    assert fixity.audit(mine, mine).count() == 0
    assert fixity.audit(mine.where("false"), mine.where("false")).count() == 0
    nulls = mine.withColumn("payload", F.coalesce("payload", F.lit("")))
    assert [tuple(r) for r in fixity.audit(mine, nulls).collect()] == [(None, None, "changed")]


def test_changed_urls_are_found(spark):
    rows = spark.createDataFrame([(k, f"http://a.org/{k}", "same", k) for k in range(40)], "page_id long, url string, html string, hash int")
    moved = rows.withColumn("url", F.when(F.col("page_id") == 7, "http://b.org/7").when(F.col("page_id") != 9, F.col("url")))
    got = fixity.audit(fixity.page_records(rows), fixity.page_records(moved)).collect()
    assert sorted(map(tuple, got)) == [(0, 7, "changed"), (0, 9, "changed")]


# --- pages -------------------------------------------------------------------------


def text_of(html):
    return "\n\n".join(t for t, s in pages.lines(html) if s != pages.ASIDE_LINE)


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
        ("<article><p>a &amp; b&nbsp;c<br>d<p>e <b>f</article><p>no", "a & b c d\n\ne f"),
        ("<nav>menu</nav><div><p>x</p></div><footer>f</footer>", "x"),
        ('<div class="side-bar sidebar">s</div><div class="comments">c</div><p>t', "t"),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes', "yes"),
        ("<p>a<!-- <p>b</p> --> c</p><form>f</form><!-- open <p>d", "a c"),
        ("<main><header><h1>T</h1></header><aside>x</aside><ul><li>one<li>two</ul></main>", "T\n\none\n\ntwo"),
        ('<article class="post comments-open"><p>t</article>', "t"),
        ("<p>cut &am", "cut &am"), ("<p>cut <a hre", "cut"), ("<p title='a>b'>q</p>", "q"),
        ("<p>" * 5000 + "deep", "deep"), ("<p>&#65;&#x42;&lt;p&gt;</p>", "AB<p>"), ("<p hidden>a</p><p>b", "b"),
    ],
)
def test_blocks(html, want):
    assert text_of(html) == want


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(2000):
        a = [rng.randrange(6) for _ in range(rng.randrange(12))]
        b = [rng.randrange(6) for _ in range(rng.randrange(12))]
        got = pages.shared_lines(a, b)
        assert got == sorted(got) and len(set(got)) == len(got) == brute_lcs(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in got)


def site_page(k, body):
    return f"<div>Site name</div><div><a>Home</a></div><div class='x1'>{body}</div><div>Imprint {k % 1}</div>"


def test_differencing_deletes_what_a_site_repeats(spark):
    rows = [(k, f"http://a.net/p/{k:03d}", site_page(k, f"<p>Story {k} begins.</p><p>And {k} ends.</p>")) for k in range(60)]
    rows += [(100 + k, f"http://b.net/{k}", site_page(0, "<p>Same story.</p>")) for k in range(3)]  # copies only
    rows += [(200, None, None), (201, None, ""), (202, "x", "<p>alone"), (202, "x", "<p>alone")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"lines": F.lit(1), "key": F.lit("k"), "we.ird": F.lit("w")}
    )
    got, at = pages.extract(frame, frame.columns)
    assert got.columns == [*frame.columns, at]
    texts = {r.page_id: r[at] for r in got.collect()}
    assert all(texts[k] == f"Story {k} begins.\n\nAnd {k} ends." for k in range(60))
    assert all("Same story." in texts[100 + k] for k in range(3))
    assert (texts[200], texts[201], texts[202]) == ("", "", "alone")
    assert got.count() == len(rows)
    assert pages.extract(frame.where("false"), ["page_id"])[0].count() == 0


def test_page_query_gives_the_articles(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op10_page_text"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(source)
    import html as entities

    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id].html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        plain = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in blocks]
        assert r.text == "\n\n".join(b for b in plain if b)
        assert r.n_chars == len(r.text)
