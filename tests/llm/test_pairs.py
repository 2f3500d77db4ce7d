"""Near-duplicates, fingerprints, repeated passages and language-model scores against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash

from ledgerlight.llm import cells, cross_polytope, fingerprints, graph, phrases, pivot_simhash, ppm

from .conftest import BIG, SCHEMA, hard_rows, prose, rows_of


def split_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    links = [(n, n + 1) for n in range(60)] + [(500, n) for n in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    links += [(None, 3), (3, None)]
    got = dict(rows_of(graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b")))
    solid = [x for x in links if None not in x]
    expected = roots_of({n for x in solid for n in x}, solid)
    assert got == expected
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_forest_keeps_components():
    draw = np.random.default_rng(0)
    a, b = draw.integers(0, 400, 300), draw.integers(0, 400, 300)
    member, root = cells.forest(400, a, b)
    expected = roots_of(range(400), list(zip(a.tolist(), b.tolist())))
    got = roots_of(range(400), list(zip(member.tolist(), root.tolist())))
    assert got == expected


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = split_words(words)
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, docs, wide_docs, no_docs):
    base = prose(77, 400).split()
    rows = hard_rows()
    for n in range(60):  # near copies at growing distance
        words = list(base)
        for k in range(n // 6):
            words[(37 * k + n) % len(words)] = f"other{n}x{k}"
        rows.append((2000 + n, " ".join(words), "en", "a", 0))
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = [plain_simhash(r[1]) for r in rows]
    kinds = sorted(set(marks))
    links = [(a, b) for a in kinds for b in kinds if a < b and (a ^ b).bit_count() <= 2]
    assert links
    root = roots_of(kinds, links)
    least = {}
    for row, mark in zip(rows, marks):
        if row[0] is not None:
            least[root[mark]] = min(least.get(root[mark], row[0]), row[0])
    expected = sorted(((r[0], f"{m:016x}", least.get(root[m])) for r, m in zip(rows, marks)), key=repr)
    assert rows_of(pivot_simhash.near_duplicates(table)) == expected
    kept = rows_of(pivot_simhash.keep_one_per_group(table), "doc_id")
    assert kept == sorted([(n,) for n in set(least.values())] + [(None,)], key=repr)
    assert rows_of(pivot_simhash.near_duplicates(wide_docs)) == rows_of(pivot_simhash.near_duplicates(docs))
    assert pivot_simhash.near_duplicates(no_docs).count() == 0 and pivot_simhash.keep_one_per_group(no_docs).count() == 0


def test_crowded_bucket_is_split_and_stays_exact(spark):
    """Two equal segments for all: every fingerprint shares a bucket with every other one."""
    draw = np.random.default_rng(5)
    marks = np.unique(np.bitwise_or.reduce([np.int64(1) << draw.integers(0, 32, 3000) for _ in range(5)]))
    got = graph.components(pivot_simhash.near_links(spark.createDataFrame([(int(m),) for m in marks], "mark long")), "a", "b")
    bits = marks.astype(np.uint64)
    links = [(int(marks[i]), int(marks[j])) for i in range(len(bits))
             for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits) <= 2) if i < j]
    assert len(marks) > 4 * cells.CHUNK // 2
    root = roots_of(marks.tolist(), links)
    assert dict(rows_of(got)) == {n: root[n] for x in links for n in x}


def test_embeddings_match_brute_force(spark):
    draw = np.random.default_rng(2)
    rows, vec_id = [], 0
    for group in range(25):
        centre = draw.normal(size=20)
        for _ in range(12):
            rows.append((vec_id, (centre + draw.normal(size=20) * draw.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist(), group % 3))
            vec_id += 1
    rows += [(vec_id + n, rows[0][1], rows[0][2]) for n in range(4)] + [(3, rows[3][1], rows[3][2])]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 20, 1), (9003, [float("nan")] + [1.0] * 19, 1), (9004, [1.0, None] + [0.0] * 18, 1),
             (9005, [float("inf")] * 20, 1), (9006, rows[0][1], None), (9007, [1.0, 2.0], rows[0][2]), (None, rows[5][1], rows[5][2])]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    sound = [n for n, (_, e, lab) in enumerate(rows) if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [(a, b) for a in sound for b in sound if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1])
             and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(np.float64(rows[a][1])) / np.linalg.norm(np.float64(rows[b][1])) >= 0.93]
    root = roots_of(range(len(rows)), links)
    count = collections.Counter(n for x in links for n in x)
    least = {}
    for n, row in enumerate(rows):
        if row[0] is not None:
            least[root[n]] = min(least.get(root[n], row[0]), row[0])
    expected = sorted(((r[0], count[n], least.get(root[n]), r[0] is not None and r[0] == least[root[n]]) for n, r in enumerate(rows)), key=repr)
    assert len(links) > 300
    assert rows_of(got) == expected
    assert cross_polytope.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_crowded_embedding_bucket_counts_links_once(spark):
    draw = np.random.default_rng(8)
    centre = draw.normal(size=16)
    rows = [(n, (centre + draw.normal(size=16) * 0.01).tolist(), 0) for n in range(1500)]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in got} == {(1499, 0, True), (1499, 0, False)}


def shingles(text):
    words = split_words(text)
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints(spark, docs, wide_docs, no_docs):
    rows = {r[0]: r[1] or "" for r in hard_rows() if r[0] is not None}
    ids = sorted(rows, reverse=True)
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["near_next"] == 0.0
            continue
        text, after = rows[r["doc_id"]], rows[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(shingles(text), shingles(edited))) < 0.15
        assert abs(r["near_next"] - likeness(shingles(text), shingles(after))) < 0.15
        exact = len(shingles(text))
        assert abs(r["distinct_shingles"] - exact) <= (0 if exact < fingerprints.K else 0.35 * exact)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 8)}) == 1
    assert rows_of(fingerprints.edited_fingerprints(wide_docs)) == rows_of(fingerprints.edited_fingerprints(docs))
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


def test_edited_fingerprints_without_repeats(spark, docs):
    single = docs.dropDuplicates(["doc_id"]).where("doc_id IS NULL OR doc_id <> 12").repartition(4)
    rows = {r["doc_id"]: r["text"] or "" for r in single.collect() if r["doc_id"] is not None}
    ids = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(single).collect()}
    assert set(got) == {*ids, None} and got[None]["near_next"] == 0.0
    for at, doc_id in enumerate(ids):
        text, after = rows[doc_id], rows[ids[(at + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[doc_id]["near_next"] - likeness(shingles(text), shingles(after))) < 0.15
    alone = fingerprints.edited_fingerprints(single.where("doc_id = 5")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"one one").hexdigest()


def test_id_ranges_are_searched_in_two_steps(spark):
    from pyspark.sql import functions as F

    tops = list(range(10_000, 0, -10))
    table = spark.createDataFrame([(n,) for n in (10_000, 9_991, 9_990, 5_000, 7_433, 10, 1)], "n long")
    got = [r[0] for r in table.select(fingerprints.range_of(F.col("n"), tops)).collect()]
    assert got == [sum(t >= n for t in tops) - 1 for n in (10_000, 9_991, 9_990, 5_000, 7_433, 10, 1)]


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    left, right = prose(1, 900), prose(2, 700)
    table = spark.createDataFrame([(left, right, left + "\n" + right)], "a string, b string, both string")
    for name in ("a", "b", "both"):
        table = fingerprints.fingerprint(table.withColumn("text", F.col(name))).withColumnRenamed("sketch", f"s_{name}")
    row = table.select(
        fingerprints.resemblance(fingerprints.merge(F.col("s_a"), F.col("s_b")), F.col("s_both")).alias("same"),
        fingerprints.containment(F.col("s_a"), F.col("s_both")).alias("inside"),
        fingerprints.containment(F.col("s_both"), F.col("s_a")).alias("part")).first()
    assert row["same"] > 0.9 and row["inside"] > 0.8 and 0.4 < row["part"] < 0.75


def plain_removal(rows):
    first = {}
    split = [(d, split_words(t)) for d, t in rows]
    for d, words in split:
        if d is not None:
            for i in range(len(words) - 49):
                key = tuple(words[i: i + 50])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        if d is not None:
            for i in range(len(words) - 49):
                if first[tuple(words[i: i + 50])] < d:
                    gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(spark, docs, wide_docs, no_docs):
    rows = [r[:2] for r in hard_rows()]
    passage = prose(500, 130).split()
    for n in range(40):  # parts of a passage at both sides of the limit, in other company, and overlapping chains
        a = n * 2
        rows.append((3000 + n, f"{prose(600 + n, n)} {' '.join(passage[a: a + 45 + n % 12])} {prose(700 + n, 55 - n)}"))
    rows += [(4000 - n, " ".join(passage[n: n + 60])) for n in range(30)]
    rows += [(5000, " ".join(["same"] * 300)), (5001, " ".join(["same"] * 80)), (5002, "x " + " ".join(["same"] * 49))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_removal(rows)
    assert sum(r[2] > 0 for r in expected) > 40
    assert rows_of(phrases.remove_repeats(table)) == expected
    assert rows_of(phrases.remove_repeats(wide_docs)) == plain_removal([r[:2] for r in hard_rows()])
    assert phrases.remove_repeats(no_docs).count() == 0


def plain_ppm(counts, text):
    stream, total, top = b"\0" * ppm.ORDER + text.encode() + b"\0", 0.0, ppm.ORDER
    for at in range(top, len(stream)):
        out = set()
        for order in range(top, -2, -1):
            if order < 0:
                total -= math.log10(256 - len(out))
                break
            seen = counts[order].get(stream[at - order: at])
            if not seen:
                continue
            n, d = sum(c for s, c in seen.items() if s not in out), len(set(seen) - out)
            if stream[at] in seen:
                total += math.log10(seen[stream[at]] / (n + d))
                break
            total += math.log10(d / (n + d)) if d else 0.0
            out |= set(seen)
    return total


def test_scores_match_brute_force(spark, docs, wide_docs, no_docs):
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    tokens = collections.Counter()
    for d, text, *_ in hard_rows():
        if not held(d):
            tokens.update(words(text))
            stream = b"\0" * ppm.ORDER + (text or "").encode() + b"\0"
            for at in range(ppm.ORDER, len(stream)):
                for order in range(ppm.ORDER + 1):
                    counts[order][stream[at - order: at]][stream[at]] += 1
    n, v = sum(tokens.values()), len(tokens)
    got = {(r["doc_id"], r["n_tokens"]): r for r in ppm.score_documents(docs).collect()}
    for d, text, *_ in hard_rows():
        r = got[d, len(words(text))]
        assert r["held_out"] == held(d) and r["train_tokens"] == n
        assert r["n_known"] == sum(tokens[w] > 0 for w in words(text))
        assert math.isclose(r["base_score"], sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words(text)), rel_tol=1e-9)
        if text is None or len(text) < 20_000:
            assert math.isclose(r["score"], plain_ppm(counts, text or ""), rel_tol=1e-9)
    assert rows_of(ppm.score_documents(wide_docs), "doc_id", "n_known") == rows_of(ppm.score_documents(docs), "doc_id", "n_known")
    assert ppm.score_documents(no_docs).count() == 0
    only = spark.createDataFrame([(None, "nothing to learn from")], "doc_id long, text string")
    assert math.isclose(ppm.score_documents(only).first()["score"], -22 * math.log10(256))


def test_an_id_with_different_texts_keeps_those_that_lead(spark):
    a, b, c = prose(50_001, 80), prose(50_002, 80), prose(50_003, 80)
    rows = [(5, a), (5, b), (3, b), (5, c), (5, c), (7, a), (None, a), (3, b)]
    kept = pivot_simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept) == sorted([(5, a), (3, b), (5, c), (None, a)], key=repr)


def test_no_context_of_the_corpus_is_dropped(spark):
    draw = random.Random(11)
    made = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ -", k=40_000)) for _ in range(24)]
    rows = [(n, text) for n, text in enumerate(made)] + [(100 + n, made[n][500:540] + made[n + 1][900:930]) for n in range(9)]
    learned = [b"\0" * ppm.ORDER + t.encode() + b"\0" for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    assert len({s[at - 5: at + 1] for s in learned for at in range(5, len(s))}) > 1 << 19
    wanted = [b"\0" * ppm.ORDER + t.encode() + b"\0" for d, t in rows if d >= 100]
    contexts = {s[at - order: at] for s in wanted for at in range(ppm.ORDER, len(s)) for order in range(ppm.ORDER + 1)}
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    for s in learned:
        for at in range(ppm.ORDER, len(s)):
            for order in range(ppm.ORDER + 1):
                if s[at - order: at] in contexts:
                    counts[order][s[at - order: at]][s[at]] += 1
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows[24:]:
        assert math.isclose(got[d], plain_ppm(counts, text), rel_tol=1e-9)


def test_large_ids_survive(docs):
    for job in (pivot_simhash.near_duplicates, phrases.remove_repeats, ppm.score_documents, fingerprints.edited_fingerprints):
        assert job(docs).where(f"doc_id = {BIG}").count() == 1
