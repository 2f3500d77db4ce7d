"""Line labelling, ranked search and the divergence audit on hard rows and against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlight.llm import divergence, lexical_search, line_crf

from .conftest import SCHEMA, hard_rows, prose, rows_of

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LINES = [
    "a b c a b c", "a a a a", "\n\nx y\n\nx y\r\nx y\n", "é𝄞 x", "\n", "w", "one\x0btwo\x0cthree # * $ é", "same line\nsame line\n same line",
    "tail\n", "\nhead", "a b\nc a b c", "   ", "é" * 3000 + " " + "b c d " * 900,
]


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def base_counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(again)


def test_line_counts_match_brute_force(spark, docs, monkeypatch):
    rows = [(n, t) for n, t in enumerate([*LINES, None, ""])] + [(1000 + n, r[1]) for n, r in enumerate(hard_rows())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_crf.label_documents(table, ([1.0] + [0.0] * (len(line_crf.MARKS) - 1), [0.0] * 4), True).collect()}
    for doc_id, text in rows:
        row, text = got[doc_id], text or ""
        assert tuple(row[1:6]) == base_counts(text), text[:50]
        full = [x for x in text.split("\n") if WORD.search(x)]
        assert (row["n_lines"], row["n_content_lines"], row["content"]) == (len(full), len(full), "\n".join(full))
        assert row["content_share"] == (1.0 if full else 0.0)
    # the size of a block changes nothing
    texts = [(r[1] or "").encode() for r in rows]
    whole = line_crf.measure(texts)[0]
    for n, text in enumerate(texts):
        assert all(whole[k][n] == v[0] for k, v in line_crf.measure([text])[0].items())


def test_chains_match_all_labellings():
    draw = np.random.default_rng(5)
    lengths = np.array([3, 1, 0, 5, 2, 4, 3])
    emission, moves = draw.normal(size=lengths.sum()), draw.normal(size=(2, 2))
    chains = line_crf.Chains(lengths)
    states = chains.viterbi(emission, moves)
    content, expected = chains.marginals(emission, moves)
    at, moved = 0, np.zeros((2, 2))
    for length in lengths:
        ways = list(itertools.product((0, 1), repeat=int(length)))
        scores = np.array([sum(e * s for e, s in zip(emission[at: at + length], w, strict=True))
                           + sum(moves[a, b] for a, b in itertools.pairwise(w)) for w in ways])
        share = np.exp(scores - scores.max())
        share /= share.sum()
        if length:
            assert ways[scores.argmax()] == tuple(states[at: at + length])
            assert np.allclose(share @ np.array(ways), content[at: at + length])
        for way, p in zip(ways, share, strict=True):
            for pair in itertools.pairwise(way):
                moved[pair] += p
        at += length
    assert np.allclose(moved, expected)


def junk(seed):
    draw = random.Random(seed)
    words = prose(seed, 90).split()
    return "\n".join(" ".join(w + draw.choice(["###", "***", "%%%"]) for w in words[k: k + 9]) for k in range(0, 90, 9))


def test_labelled_lines_decide_retention(spark):
    good = [prose(70_000 + n, 8) + ".\n" + prose(74_000 + n, 20) + ".\n" + prose(71_000 + n, 60) + "." for n in range(160)]
    bad = [(prose(72_000 + n, 8) + ".\n" if n % 2 else "") + junk(73_000 + n) for n in range(80)]
    rows = [(n, t) for n, t in enumerate(good)] + [(1000 + n, t) for n, t in enumerate(bad)]
    learned = [(n, 1) for n in range(120)] + [(1000 + n, 0) for n in range(60)] + [(5, 0), (None, 1), (7, None), (9, 4), (11, 1)]
    labels = spark.createDataFrame(learned, "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_crf.judge(docs, labels, with_text=True).collect()}
    assert sum(got[n]["kept"] for n in range(120, 160)) >= 38
    assert not any(got[1000 + n]["kept"] for n in range(60, 80))
    # a clean line over a page of junk is found although its document is labelled as a whole
    assert sum(got[1000 + n]["content"].startswith(prose(72_000 + n, 8)) for n in range(61, 80, 2)) >= 8
    assert sum(got[1000 + n]["n_content_lines"] for n in range(80)) < 0.1 * sum(got[1000 + n]["n_lines"] for n in range(80))


def test_quality_of_hard_rows(spark, docs, wide_docs, no_docs):
    labels = spark.createDataFrame([(100, 1), (101, 0)], "doc_id long, quality int")
    none = labels.where("false")
    plain = line_crf.judge(docs, none)
    assert plain.count() == docs.count() and rows_of(plain) == rows_of(line_crf.judge(wide_docs, none))
    assert all(r["kept"] == (not r["base_failed"]) for r in plain.collect())
    assert line_crf.judge(no_docs, labels).count() == 0
    rows = line_crf.judge(docs, labels).where("doc_id = 8").collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    repeated = spark.createDataFrame([(1, "w x y z " * 30, "en", "a", 0), (2, prose(3, 49), "en", "a", 0), (3, prose(3, 50), "en", "a", 0)], SCHEMA)
    assert [r["base_failed"] for r in line_crf.judge(repeated, none).orderBy("doc_id").collect()] == [True, True, False]


# ---------------------------------------------------------------- search


def plain_search(docs, items, top):
    tables = [(doc_id, Counter(TERM.findall(lowered(text)))) for doc_id, text in docs if text and TERM.search(text)]
    total, n = sum(c.total() for _, c in tables), len(tables)
    df = Counter(t for _, c in tables for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items}:
        terms, scores = Counter(TERM.findall(lowered(text or ""))), []
        for doc_id, counts in tables:
            m = 25 + (75 * counts.total() * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t, k in terms.items() if counts[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched():
    draw = random.Random(12)
    words = [f"w{n}" for n in range(300)]
    common = [0.5 / (n + 1) for n in range(300)]
    rows = [(n, " ".join(draw.choices(words, common, k=draw.choice([3, 20, 60, 400])))) for n in range(900)]
    rows += [(2000 + n, "w7 w9 w250") for n in range(300)] + [(r[0], r[1]) for r in hard_rows()]
    items = [(n, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for n in range(30)]
    items += [(100, None), (101, ""), (102, "--- ..."), (103, "nosuchterm W7"), (104, "W7 w7 W250 w9"), (105, "É é ß"), (105, "w1"), (None, "w3 w4"),
              (106, prose(1, 90)), (0, items[0][1])]
    return rows, items


@pytest.mark.parametrize("segment", [16, 8192])
def test_search_matches_scoring_everything(spark, searched, monkeypatch, segment):
    rows, items = searched
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical_search, "BLOCK", 4 if segment == 16 else 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(docs, asked)
    assert rows_of(got) == plain_search(rows, items, 10)


def test_search_in_passes_and_on_wide_or_empty_tables(spark, searched, docs, wide_docs, no_docs):
    rows, items = searched
    table = spark.createDataFrame(rows[::7], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_search.search(table, asked, top=3, pass_terms=90)) == plain_search(rows[::7], items, 3)
    wide = asked.selectExpr("*", "1 AS rank", "2 AS score", "3 AS terms", "4 AS item")
    assert rows_of(lexical_search.search(wide_docs, wide)) == rows_of(lexical_search.search(docs, asked))
    assert lexical_search.search(no_docs, asked).count() == 0
    assert lexical_search.search(docs, asked.where("false")).count() == 0


def test_blocks_are_given_up_unread():
    draw = random.Random(3)
    postings, lengths = [], []
    for n in range(4000):
        rare = n == 2500
        postings.append(np.array([[0, 1 + (n == 2500)]] + ([[1, 5]] if rare else []), dtype=np.int64))
        lengths.append(40 if rare else draw.randint(50, 400))
    row = lexical_search._segment(list(range(4000)), lengths, postings)
    segment = lexical_search.Segment(row, 4000, sum(lengths))
    heap = lexical_search.Heap(1)
    segment.search({0: 100, 1: 9000}, heap)
    first = len(segment.read)
    again = lexical_search.Segment(row, 4000, sum(lengths))
    again.search({0: 100, 1: 9000}, heap)  # the bar is known now: one block of each list is enough
    assert heap.rows[0][1] == 2500 and len(again.read) <= 2 <= first


# ---------------------------------------------------------------- audit


def plain_audit(rows, least, top):
    groups, counts, langs, having = set(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", LETTERS.findall(lowered(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        having[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in having[lang].items() if d >= least]
        v = len(kept)

        def share(count, k=kept, v=v):
            n = sum(count[t] for t in k)
            return {t: 1 + (10**9 * (count[t] + 2)) // (n + 2 * v) for t in k}

        p, q = share(counts[lang, source]), share(langs[lang])
        far = lambda a, b, t: (a[t] - b[t]) ** 2 // (a[t] + b[t])
        peers = [(s, share(counts[x, s])) for x, s in groups if x == lang and s != source]
        parts = {"pair": [(-sum(far(p, o, t) for t in kept), s.encode(), s) for s, o in peers],
                 "term": sorted((-far(p, q, t), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t])[:top]}
        for part, values in parts.items():
            out += [(lang, source, part, item, -value, n + 1) for n, (value, _, item) in enumerate(sorted(values))]
    return sorted(out, key=repr)


def audited():
    draw = random.Random(8)
    words = [f"t{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(120)] + ["É", "ß", "straße"]
    rows = [(" ".join(draw.choices(words, k=draw.randint(0, 60))), draw.choice(["en", "de"]), f"s{draw.choice([0] * 9 + list(range(9)))}")
            for _ in range(500)]
    return rows + [(None, None, None), ("", "xx", "s1"), ("lonely words", "xx", "s2"), ("A a Z_z9y", "en", None), (None, "en", "silent")]


@pytest.mark.parametrize("blocks", [(512, 2048, 1 << 20), (3, 4, 50)])
def test_audit_matches_every_term_of_every_pair(spark, monkeypatch, blocks):
    for name, size in zip(("ROW_BLOCK", "PEER_BLOCK", "SLICE_POSTINGS"), blocks, strict=True):
        monkeypatch.setattr(divergence, name, size)
    rows = audited()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert rows_of(divergence.audit(docs, least_docs=10, top_terms=10)) == plain_audit(rows, 10, 10)


def test_audit_of_hard_rows(spark, docs, wide_docs, no_docs):
    rows = [(r[1], r[2], r[3]) for r in hard_rows()]
    assert rows_of(divergence.audit(docs, 2, 4)) == plain_audit(rows, 2, 4) == rows_of(divergence.audit(wide_docs, 2, 4))
    assert divergence.audit(no_docs).count() == 0
    assert {r["value"] for r in divergence.audit(docs, 10_000).collect()} == {0}


def test_shares_do_not_overflow(spark):
    pairs = [(2, 4), (1, 3), (9_000_000_000_000, 9_000_000_000_001), (123_456_789_012_345, 999_999_999_999_999), (7, 7)]
    want = [1 + 10**9 * a // b for a, b in pairs]
    assert divergence.share(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist() == want
    table = spark.createDataFrame(pairs, "a long, b long")
    assert [r[0] for r in table.select(divergence.share_column(table["a"], table["b"])).collect()] == want
