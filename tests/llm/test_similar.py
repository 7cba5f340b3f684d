"""Near and exact duplicates, substrings, passages, vectors, components, and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semspark.llm import chaining, nndescent, simhash, substrings, topk
from semspark.llm.common import components, least_labels
from tests.llm.helpers import DOC, ODD, documents, prose, written


def union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("finish", [0, 5, 10**6])
def test_components(spark, finish):
    r = random.Random(finish)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (500, 501), (500, 501)]
    got = {x.id: x.root for x in components(spark.createDataFrame(pairs, "a bigint, b bigint"), finish).collect()}
    assert got == {k: v for k, v in union([p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), finish).count() == 0


def test_golay():
    _, error, weight, over = simhash.golay()
    assert np.bincount(weight).tolist() == [1, 23, 253, 1771]
    x = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    for bit in (0, 7, 22):
        (ha, va, na), (hb, vb, nb) = simhash.decode(x), simhash.decode(x ^ (1 << bit))
        assert all(a in set(v[:n]) and b in set(w[:m]) for a, b, v, n, w, m in zip(ha, hb, vb, nb, va, na, strict=True))


def brute_simhash(rows):
    import xxhash

    fps = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode()
        w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", w) if x]
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = list(fps)
    parts = union([(a, b) for a in ids for b in ids if a <= b and (fps[a] ^ fps[b]).bit_count() <= 3])
    return {d: (f"{fps[d]:016x}", parts[d]) for d in ids}


def test_simhash(spark, tmp_path):
    texts, voc, r = prose(3, 120, (3, 200))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for n in range(40):  # copies with a word or two changed
        w = list(texts[n])
        w[r.randrange(len(w))] = r.choice(voc)
        rows.append((1000 - n, " ".join(w).upper()))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a\tB")]
    d = written(spark, tmp_path, [(i, t, None, None, None) for i, t in rows])
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.op9_simhash(spark, d).collect()}
    assert got == brute_simhash(rows)


def test_simhash_links_of_planted_fingerprints(spark, monkeypatch):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for f in fps for _ in range(2)]
    centre = r.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))) for _ in range(400)]  # a large bucket
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x.id: x.root for x in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))).collect()}
    want = union([(a, b) for a, x in zip(signed, fps, strict=True) for b, y in zip(signed, fps, strict=True) if a < b and (x ^ y).bit_count() <= 3])
    assert got == want


def test_similar_groups(spark):
    texts, voc, r = prose(5, 80, (150, 250))
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    for n in range(40):  # about 1 word in 100 changed: similarity over 0.85
        w = list(texts[n])
        for _ in range(2):
            w[r.randrange(len(w))] = r.choice(voc)
        rows.append((100 + n, " ".join(w), None, None, None))
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(documents(spark, rows)).collect()}
    assert all(got[i] == i for i in range(80)) and sum(got[100 + n] == n for n in range(40)) >= 38
    kept = simhash.deduplicated(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns and kept.count() <= 82


def altered(words, n, r):
    """words with n of them, at least 5 apart, replaced by new ones: 5 shingles each are lost."""
    out = list(words)
    for i in r.sample(range(1, len(words) // 6), n):
        out[6 * i] = f"new{r.getrandbits(40)}"
    return out


def jaccard(a, b):
    a, b = (set(zip(*(x[i:] for i in range(5)), strict=False)) for x in (a, b))
    return len(a & b) / len(a | b)


def grouped(spark, rows):
    return {x.doc_id: x.component_id for x in simhash.similar_groups(documents(spark, [(i, " ".join(t), None, None, None) for i, t in rows.items()])).collect()}


def test_links_of_large_buckets_are_verified():
    """Pairs that are near an unrelated row, and near each other, are linked whatever else a bucket holds."""
    r = random.Random(14)
    for others in (0, 5, 40):
        base = [r.getrandbits(63) for _ in range(100)]
        sets = [np.array(base[:60] + [r.getrandbits(63) for _ in range(40)], np.uint64) for _ in range(others + 1)]
        pair = base[:55] + [r.getrandbits(63) for _ in range(45)]
        sets += [np.array(pair, np.uint64), np.array(pair[:-4] + [r.getrandbits(63) for _ in range(4)], np.uint64)]
        a, b = simhash.linked(sets, 0.8)
        assert [{int(x), int(y)} for x, y in zip(a, b, strict=True)] == [{others + 1, others + 2}]


def test_similar_chains(spark):
    """A~B and B~C put A and C together, though they are below the bound, whatever the order of ids."""
    texts, _, r = prose(15, 30, (300, 300))
    rows = {}
    for n, a in enumerate(texts):
        b = altered(a, 5, r)
        c = altered(b, 5, r)
        rows |= dict(zip([(n, 100 + n, 200 + n), (100 + n, n, 200 + n), (200 + n, 100 + n, n)][n % 3], (a, b, c), strict=True))
    want = union([(i, j) for n in range(30) for i in (n, 100 + n, 200 + n) for j in (n, 100 + n, 200 + n) if i <= j and jaccard(rows[i], rows[j]) >= 0.8])
    assert all(want[200 + n] == n for n in range(30)) and grouped(spark, rows) == want


def test_similar_recall_at_the_bound(spark):
    """Pairs at a similarity just over 0.8 are found, those just under it are not."""
    texts, _, r = prose(16, 200, (320, 320))
    rows = dict(enumerate(texts)) | {1000 + n: altered(t, 6 + n % 3, r) for n, t in enumerate(texts)}
    over = [n for n in range(200) if jaccard(rows[n], rows[1000 + n]) >= 0.8]
    got = grouped(spark, rows)
    assert 100 <= len(over) < 200 and max(jaccard(rows[n], rows[1000 + n]) for n in over) < 0.84
    assert sum(got[1000 + n] == n for n in over) >= 0.99 * len(over)
    assert all(got[1000 + n] == 1000 + n for n in set(range(200)) - set(over))


def test_similar_groups_meet_by_golay_keys(spark):
    """Buckets of similar_groups come from SimHash fingerprints: at 3 differing bits in one table a Golay key is shared."""
    r = random.Random(18)
    h = np.unique(np.array([r.getrandbits(64) for _ in range(301)], np.uint64))
    plain = [simhash.majority(simhash.mix64(h ^ salt)) for salt in simhash.mix64(np.arange(1, 6, dtype=np.uint64))]
    assert simhash.simhashes(h, 5).tolist() == plain
    rows = {}
    for n in range(300):
        fps = [r.getrandbits(64) for _ in range(4)]
        near = [fps[0], fps[1], r.getrandbits(64), fps[3]]
        for bit in r.sample(range(64), 3):
            near[3] ^= 1 << bit
        for t in (0, 1):  # near enough for a comparison, mostly without a key
            for low, size in ((0, 21), (21, 21), (42, 22)):
                for bit in r.sample(range(low, low + size), 6):
                    near[t] ^= 1 << bit
        rows |= {n: fps, 1000 + n: near}
    cells = [(n, b"".join(x.to_bytes(8, "little") for x in fps)) for n, fps in rows.items()]
    got = simhash.sharing(spark.createDataFrame(cells, "id bigint, fps binary").repartition(7), 0.8).collect()
    found = {}
    for x in got:
        found.setdefault(x.bucket, set()).add((x.id, x.table))
    assert {n for b in found.values() for n in range(300) if {i for i, _ in b} == {n, 1000 + n}} == set(range(300))
    assert sum({t for _, t in b} == {3} for b in found.values()) > 100
    assert sum({i % 1000 for i, _ in b} != {min(i for i, _ in b) % 1000} for b in found.values()) <= 2


def test_a_set_is_in_one_bucket(spark):
    """Near copies that meet by many keys are one bucket, in which each is once."""
    texts, _, r = prose(19, 4, (300, 300))
    rows = {1000 * n + i: altered(t, 1 + i % 3, r) if i else t for n, t in enumerate(texts) for i in range(80 if n < 2 else 1)}
    sets = {i: np.unique(simhash.hashes(" ".join(t).encode().split(), 5)) for i, t in rows.items()}
    cells = [(i, simhash.simhashes(h, 13).tobytes()) for i, h in sets.items()]
    got = simhash.sharing(spark.createDataFrame(cells, "id bigint, fps binary").repartition(5), 0.8).collect()
    assert sorted((x.bucket, x.id) for x in got) == [(1000 * n, 1000 * n + i) for n in (0, 1) for i in range(80)]
    want = union([(i, j) for i in rows for j in rows if i <= j and jaccard(rows[i], rows[j]) >= 0.8])
    assert grouped(spark, rows) == want


def test_links_are_within_parts_of_a_bucket():
    r = random.Random(20)
    common = [r.getrandbits(63) for _ in range(60)]
    sets = []
    for _ in range(60):
        base = common + [r.getrandbits(63) for _ in range(r.randint(1, 60))]
        sets += [np.array(base, np.uint64)] + [np.unique(np.array(r.sample(base, max(1, int(len(base) * r.uniform(0.75, 1)))), np.uint64)) for _ in range(r.randint(0, 3))]
    sets += [np.array(x, np.uint64) for x in ([7], [7], [7, 8, 9, 10], [7, 8, 9, 10, 11], [7, 8, 9, 12])]
    pairs = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9]
    part = {i: n for n, at in enumerate(simhash.apart(sets, 0.8)) for i in at.tolist()}
    assert len(pairs) > 100 and all(part[i] == part[j] for i, j in pairs)
    alone = [np.array(common[:40] + [r.getrandbits(63) for _ in range(40)], np.uint64) for _ in range(50)]
    assert simhash.apart(alone, 0.8) == []


def test_simhash_odd(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    assert len(got) == len(ODD) and {x.component_id for x in got if x.fp == 0} == {1}
    kept = simhash.deduplicated(documents(spark)).collect()
    assert len({x.doc_id for x in kept}) == len(kept)
    assert {x.doc_id for x in kept if x.text and x.text.startswith("one two")} == {4}
    for f in (simhash.near_duplicates, simhash.similar_groups, simhash.deduplicated):
        assert f(documents(spark, [])).count() == 0


def brute_substrings(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.fixture(scope="module")
def repeating():
    r = random.Random(6)
    base = ["".join(r.choice("ab cdé\n") for _ in range(400)) for _ in range(6)]
    docs = {}
    for i in range(150):
        t = "".join(r.choice("ab cd") for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 3)):
            x, a = r.choice(base), r.randint(0, 300)
            t += x[a : a + r.randint(50, 300)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))
        docs[i * 3] = t + "ab" * r.randint(0, 200) * (r.random() < 0.1)
    docs |= {1: None, 4: "", 7: docs[0], 10: docs[0], 13: "z" * 5000, 16: "z" * 99, 19: "z" * 100}
    return docs


@pytest.mark.parametrize("hot", [(24, 256), (1, 2), (2, 1)])
def test_substrings(spark, tmp_path, monkeypatch, repeating, hot):
    plain = substrings.repeated
    monkeypatch.setattr(substrings, "repeated", lambda docs: plain(docs, hot_here=hot[0], hot=hot[1]))
    d = written(spark, tmp_path, [(i, t, None, None, None) for i, t in repeating.items()])
    got = {r.doc_id: tuple(r)[1:] for r in substrings.op4_substrings(spark, d).collect()}
    assert got == brute_substrings(repeating)


def test_long_documents_in_pieces():
    """A document longer than a block gives the same anchors as it does whole."""
    data = np.frombuffer("".join(random.Random(7).choice("abc ") for _ in range(40_000)).encode(), np.uint8)

    def anchors(size):
        old, substrings.BLOCK = substrings.BLOCK, size
        found = set()
        for pieces in substrings.cut_up(np.array([5]), data, np.array([0, len(data)]), 100):
            x = substrings.Block(pieces, 100)
            x.anchors()
            found |= set(zip(x.key.tolist(), x.context.tolist(), (x.at + x.base[x.own]).tolist(), (x.low + x.base[x.own]).tolist(), strict=True))
        substrings.BLOCK = old
        return found

    assert anchors(7_000) == anchors(1 << 21)


@pytest.mark.parametrize("length", [1, 7, 8, 9, 20])
def test_digit_passes_find_equal_strings(length):
    rng = np.random.default_rng(length)
    flat = rng.integers(0, 2, 600).astype(np.uint8)
    start, group = rng.integers(0, 600 - length, 400), np.sort(rng.integers(0, 3, 400))
    row, number = substrings.equal_strings(flat, start, group, length)
    by = {}
    for i in range(400):
        by.setdefault((int(group[i]), flat[start[i] : start[i] + length].tobytes()), []).append(i)
    want = sorted(v for v in by.values() if len(v) > 1)
    assert sorted(row[number == n].tolist() for n in np.unique(number)) == want
    assert substrings.equal_strings(flat, start[:0], group[:0], length)[0].tolist() == []


def test_equal_numbers_of_unequal_bytes_are_told_apart():
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    new = np.array([True, False, False, False])
    assert substrings.differing(data, np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3]), new).tolist() == [2]
    assert substrings.differing(data, np.array([0, 3, 6, 9]), np.array([3, 3, 2, 3]), new).tolist() == [2]


def test_substrings_odd(spark):
    got = substrings.repeated(documents(spark)).collect()
    # every row is a document of its own, those that share an id or have none too
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ODD)
    assert [(s.low, s.high) for r in got if r.doc_id == 6 for s in r.spans] != []
    assert substrings.repeated(documents(spark, [])).count() == 0


def fuzz(words, rate, voc, r):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(r.choice(voc) if x < rate * 2 / 3 else w)
        if x > 1 - rate / 3:
            out.append(r.choice(voc))
    return out


def test_chaining_finds_planted_passages(spark):
    texts, voc, r = prose(8, 200, (30, 200), 3000)
    docs = dict(enumerate(texts))
    p, q = ([r.choice(voc) for _ in range(n)] for n in (60, 120))
    for i in range(40, 200, 20):
        docs[i][10:10] = p
    for i in range(45, 200, 25):
        docs[i][5:5] = fuzz(q, 0.06, voc, r)
    docs[199], docs[198] = fuzz(docs[7] + docs[9], 0.05, voc, r), docs[8] + docs[11]
    docs[5] = docs[5] + docs[5][:25] + docs[5][-50:]
    rows = [(i, " ".join(t), None, None, None) for i, t in docs.items()]
    got = chaining.fuzzy_passages(documents(spark, rows)).collect()
    want = set(range(60, 200, 20)) | set(range(70, 200, 25)) | {198, 199, 5}
    assert {g.doc_id for g in got} >= want - {5} and {g.doc_id for g in got} <= want
    for g in got:
        a, b = docs[g.doc_id], docs[g.ref_doc_id]
        assert (g.ref_doc_id, g.ref_start) < (g.doc_id, g.start) and g.similarity >= 0.8 and g.n_words >= 40
        x, y = " ".join(a).encode()[g.start : g.stop].split(), " ".join(b).encode()[g.ref_start : g.ref_stop].split()
        assert abs(1 - edit(x, y) / max(len(x), len(y)) - g.similarity) < 1e-9
    exact = [g for g in got if g.doc_id in range(60, 200, 20) and g.similarity == 1 and g.n_words >= 60]
    assert len(exact) == len(range(60, 200, 20))


@pytest.mark.parametrize("between", [(80, 80), (120, 135), (20, 250)])
def test_passages_on_both_sides_of_other_text(spark, between):
    """Two exact passages with unrelated words between them are returned, each on its own."""
    texts, voc, r = prose(17, 40, (30, 60), 4000)
    docs, want = dict(enumerate(texts)), {}
    for n in range(0, 40, 2):
        p, q = ([r.choice(voc) for _ in range(60)] for _ in range(2))
        for d, gap in zip((n, n + 1), between, strict=True):
            docs[d] = p + [r.choice(voc) for _ in range(gap)] + q
            want[d] = 60 + gap
    got = chaining.fuzzy_passages(documents(spark, [(i, " ".join(t), None, None, None) for i, t in docs.items()])).collect()
    for d in range(1, 40, 2):
        text = " ".join(docs[d]).encode()
        at = [(len(text[: g.start].split()), g.n_words) for g in got if g.doc_id == d and g.ref_doc_id == d - 1]
        assert len(at) == 2 and min(at)[0] == 0 and abs(max(at)[0] - want[d]) <= 3 and all(60 <= n <= 66 for _, n in at)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_chains():
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        assert chaining.distance(a, b) == edit(a, b)
    for _ in range(60):  # the best chain's score, by trying all pairs
        n = r.randint(1, 12)
        x, y = np.array([r.randrange(30) for _ in range(n)]), np.array([r.randrange(30) for _ in range(n)])
        best = {}
        for i in sorted(range(n), key=lambda i: (x[i], y[i])):
            best[i] = 5 + max([0.0] + [best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) / 2 for j in best if x[j] < x[i] and y[j] < y[i]])
        c = chaining.chains(x, y, 5.0, 0.1)
        assert sorted(i for k in c for i in k) == list(range(n)) and all((np.diff(x[k]) > 0).all() and (np.diff(y[k]) > 0).all() for k in c)
        top = max(5 * len(k) - 0.1 * (x[k[-1]] - x[k[0]] + y[k[-1]] - y[k[0]]) / 2 for k in c)
        assert abs(top - max(best.values())) < 1e-9


def test_passages_put_together_from_earlier_ones(spark):
    """A 96-word passage of two documents is found though eight earlier ones hold overlapping 28-word parts of it."""
    texts, voc, r = prose(23, 40, (30, 60), 4000)
    docs = dict(enumerate(texts))
    p = [r.choice(voc) for _ in range(96)]
    for n, at in enumerate(range(0, 69, 9)):
        docs[n] = docs[n][:10] + p[at : at + 28] + docs[n][10:]
    docs[20], docs[30] = docs[20][:5] + p + docs[20][5:], docs[30][:15] + p + docs[30][15:]
    got = chaining.fuzzy_passages(documents(spark, [(i, " ".join(t), None, None, None) for i, t in docs.items()])).collect()
    assert [(g.doc_id, g.ref_doc_id) for g in got if g.n_words >= 96 and g.similarity == 1] == [(30, 20)]


def mosaics(seed, n):
    """Documents put together from parts of common pieces of 50 to 160 words and words of their own."""
    texts, voc, r = prose(seed, n, (5, 40), 3000)
    pieces = [[r.choice(voc) for _ in range(r.randint(50, 160))] for _ in range(8)]
    for t in texts:
        for _ in range(r.randint(0, 3)):
            q = r.choice(pieces)
            a = r.randrange(max(1, len(q) - 20))
            at = r.randrange(len(t))
            t[at:at] = q[a : a + r.randint(20, 90)]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_long_repetitions_are_covered(spark, seed):
    """Brute force: each run of LONG_RUN words that occurs earlier, in any document, lies in a passage, and passages hold."""
    docs = mosaics(seed, 60)
    got = chaining.fuzzy_passages(documents(spark, [(i, " ".join(t), None, None, None) for i, t in enumerate(docs)])).collect()
    n, seen, found = chaining.LONG_RUN, set(), 0
    for i, t in enumerate(docs):
        stops = np.cumsum([len(w) + 1 for w in t]) - 1
        for a in range(len(t) - n + 1):
            run = tuple(t[a : a + n])
            if run in seen:
                found += 1
                start, stop = int(stops[a]) - len(t[a]), int(stops[a + n - 1])
                inside = [(max(start, g.start), min(stop, g.stop)) for g in got if g.doc_id == i]
                assert sum(len(" ".join(t)[x:y].split()) for x, y in inside if x < y) >= n, (i, a)
            seen.add(run)
    assert found > 100
    for g in got:
        x, y = " ".join(docs[g.doc_id])[g.start : g.stop].split(), " ".join(docs[g.ref_doc_id])[g.ref_start : g.ref_stop].split()
        assert len(x) >= 40 and abs(1 - edit(x, y) / max(len(x), len(y)) - g.similarity) < 1e-9 and g.similarity >= 0.8


def test_passages_do_not_depend_on_partitions(spark):
    docs = mosaics(5, 300)
    df = documents(spark, [(i, " ".join(t), None, None, None) for i, t in enumerate(docs)])
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, size in ((1, 1 << 21), (4, 20_000), (64, 3_000)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(str, chaining.fuzzy_passages(df.repartition(parts), block_bytes=size).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen[0]) > 100 and seen[0] == seen[1] == seen[2]


def test_recall_of_changed_passages(spark):
    """Of passages of 60 words with so many of them changed at random places, how many are found (README)."""
    texts, voc, r = prose(31, 400, (20, 60), 5000)
    for share, least in ((0.05, 0.99), (0.10, 0.97), (0.15, 0.85)):
        docs = [list(t) for t in texts]
        for i in range(200):
            p = [r.choice(voc) for _ in range(60)]
            q = list(p)
            for k in r.sample(range(60), round(60 * share)):
                q[k] = r.choice(voc)
            docs[i][10:10], docs[200 + i][15:15] = p, q
        got = chaining.fuzzy_passages(documents(spark, [(i, " ".join(t), None, None, None) for i, t in enumerate(docs)])).collect()
        pairs = {(g.ref_doc_id, g.doc_id) for g in got}
        recall = sum((i, 200 + i) in pairs for i in range(200)) / 200
        print(share, recall, len(pairs))
        assert recall >= least and len(pairs) <= 205


@pytest.mark.parametrize(("others", "change"), [(30, "replaced"), (30, "left out"), (30, "added"), (120, "replaced")])
def test_changed_passages_whose_seeds_are_all_frequent(spark, others, change):
    """A passage of 60 words and the same with 5 words changed are a pair, however many documents hold its stretches."""
    texts, voc, r = prose(53, 5 * others + 100, (20, 50), 4000)
    docs, at = dict(enumerate(texts)), r.sample(range(len(texts)), len(texts))
    want = set()
    for n in range(4):
        p = [r.choice(voc) for _ in range(60)]
        for k in range(5):
            for i in at[k * others : (k + 1) * others]:
                docs[i] = docs[i] + p[12 * k : 12 * k + 12] + [r.choice(voc) for _ in range(30)]
        q = []
        for i, w in enumerate(p):
            new = i % 12 == 11
            q += [] if new and change == "left out" else [r.choice(voc)] if new and change == "replaced" else [w]
            q += [r.choice(voc)] if new and change == "added" else []
        one, two = len(texts) + 2 * n, len(texts) + 2 * n + 1
        docs[one], docs[two] = ([r.choice(voc) for _ in range(20)] + x + [r.choice(voc) for _ in range(20)] for x in (p, q))
        want.add((one, two))
    got = chaining.fuzzy_passages(documents(spark, [(i, " ".join(t), None, None, None) for i, t in docs.items()])).collect()
    assert {(g.ref_doc_id, g.doc_id) for g in got if g.n_words >= 55} == want


def test_stretches_of_a_block(spark):
    """Brute force: stretches between short seeds that others have, one of both frequent; the first of those that are alike."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") if i % 3 else "a" for _ in range(r.randint(1, 60))) for i in range(40)]
    x = chaining.Words(pa.table({"did": pa.array(range(40), pa.int64()), "text": pa.array(texts, pa.large_string())}))
    x.hashes()
    seeds = x.seeds(4, 8, 32, 16)
    shared = {k: r.random() < 0.5 for k in np.unique(seeds[0]).tolist() if r.random() < 0.7}  # whether it is rare
    pk = np.array(sorted(shared), np.uint64)
    none = np.zeros(len(pk), np.int64)
    pair, text, did, word, gap = chaining.stretches(x, seeds, [pk, none, none, np.array([shared[k] for k in pk.tolist()], np.uint8)], 4)
    got = {(d, w, w + g) for d, w, g in zip(did.tolist(), word.tolist(), gap.tolist(), strict=True)}
    places = sorted((o, w, k) for k, o, w, n in zip(*(v.tolist() for v in seeds), strict=True) if n == 4 and k in shared)
    least, allowed = {}, set()
    for d, w, k in places:
        for d2, w2, k2 in places:
            if d == d2 and 0 < w2 - w <= chaining.REACH and not (shared[k] and shared[k2]):
                least.setdefault((k, k2, tuple(texts[d].split()[w : w2 + 4])), (d, w, w2))
                allowed.add((d, w, w2))
    assert got <= allowed and len(got) > 100
    assert len(pair) == len(set(zip(pair.tolist(), text.tolist(), strict=True)))
    assert {v for v in least.values() if no_run(texts[v[0]].split(), v)} <= got


def no_run(t, v):
    """Whether no seed at the ends of a stretch repeats itself within its own words, so none is left out."""
    return all(t[w + s : w + s + 4] != t[w : w + 4] for w in v[1:] for s in (-4, -3, -2, -1, 1, 2, 3, 4) if w + s >= 0)


def test_near_copies_that_no_passage_covers_as_a_whole(spark, monkeypatch):
    """Near copies whose last words but one differ: two of them whose seeds all lie in a passage that the later one has already
    are not chained along stretches, so chains don't grow with the square of the copies; every copy has its passage."""
    r, n, made, real = random.Random(8), 300, [], chaining.aligned
    p = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(n):
        q = [f"x{i}a{k}" if r.random() < 0.02 and 10 < k < 140 else w for k, w in enumerate(p)]
        q[148] = f"x{i}"
        docs.append(" ".join(q))

    def aligned(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(chaining, "aligned", aligned)
    got = chaining.fuzzy_passages(documents(spark, [(i, t, None, None, None) for i, t in enumerate(docs)])).collect()
    assert made[0].filter(F.col("kind") == chaining.CHAIN).count() < 10 * n
    assert {g.doc_id for g in got if g.n_words >= 147} == set(range(1, n))


def test_what_lies_within_a_passage():
    """Brute force: words with MARGIN more at either side, in one passage; fewer than a seed's may be left at a document's ends."""
    r = random.Random(4)
    words = {d: r.choice((3, 60, 150, 400)) for d in range(0, 40, 2)}
    covered = []
    for d in r.sample(sorted(words), 15):
        for _ in range(r.randint(1, 4)):
            low = min(r.choice((0, 2, 3, 5, r.randrange(words[d]))), words[d] - 1)
            covered.append((d, low, r.choice((words[d], max(words[d] - 3, low + 1), r.randint(low, words[d]))), words[d]))
    covered = np.array(covered, np.int64)
    asked = []
    for _ in range(3000):
        d = r.randrange(41)
        n = words.get(d, 50)
        low = r.choice((0, min(4, n - 1), r.randrange(n)))
        asked.append((d, low, r.choice((n, max(low + 1, n - 4), r.randint(low + 1, n)))))
    m, s = chaining.MARGIN, 4
    want = [any(c == d and a <= max(low - m, min(low, s - 1)) and z >= min(high + m, max(high, n - s + 1)) for c, a, z, n in covered.tolist()) for d, low, high in asked]
    assert chaining.within(*np.array(asked, np.int64).T, covered, s).tolist() == want
    assert 50 < sum(want) < 2500


def test_nearest_is_the_edit_distance():
    r = random.Random(6)
    for _ in range(300):
        a = [r.randrange(r.choice((3, 40))) for _ in range(r.randint(1, 40))]
        b = [x if r.random() > 0.2 else r.randrange(40) for x in a if r.random() > 0.1] or [1]
        d = edit(a, b)
        assert chaining.nearest(np.array(a), np.array(b), d) == chaining.nearest(np.array(a), np.array(b), d + 2) == d


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    texts, voc, r = prose(41, 12, (50, 60), 4000)
    p = [r.choice(voc) for _ in range(60)]
    rows = [(None if i % 3 else i // 4, " ".join(t[:20] + p + t[20:]), None, None, None) for i, t in enumerate(texts)]
    got = chaining.fuzzy_passages(documents(spark, rows)).collect()
    assert len(got) == 11 and all(g.similarity == 1 for g in got) and sum(g.doc_id is None for g in got) == 8
    assert sorted(g.doc_id for g in got if g.doc_id is not None) == [0, 1, 2]


def test_chaining_odd(spark):
    assert {r.doc_id for r in chaining.fuzzy_passages(documents(spark)).collect()} <= {9}
    assert chaining.fuzzy_passages(documents(spark, [])).count() == 0


# ---- vectors

VECTORS = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [float("inf"), 0.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 4.0, 6.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (20, [-1.0, 0.5, 3.0]), (40, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (60, [])]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS n", "'x' AS q")


def write_vectors(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_topk(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = np.round(rng.standard_normal((700, 40)) * 0.2, 2).astype(np.float32)  # coarse, so that scores tie
    x[300:340] = x[0]
    d = write_vectors(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(x)])
    got = topk.op6_topk(spark, d).toPandas()
    q = np.floor(x.astype(np.float64) * 64)
    for i in range(0, 700, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:20]
        r = got[got.query_id == i].sort_values("rank")
        assert r.vec_id.tolist() == order and r.score.tolist() == s[order].astype(int).tolist() and r["rank"].tolist() == list(range(1, 21))


def test_topk_blocks_and_large_numbers():
    rng = np.random.default_rng(11)
    for kind in (50, 2**28):
        c = rng.integers(-kind, kind, (33, 900))
        ids = rng.permutation(900).astype(np.int64)
        got = topk.best(ids[:70], c[:, :70].T.copy(), ids, c, 5)
        s = c[:, :70].T.astype(object) @ c.astype(object) if kind > 50 else c[:, :70].T @ c
        for i in range(70):
            order = [j for j in sorted(range(900), key=lambda j: (-s[i, j], ids[j])) if ids[j] != ids[i]][:5]
            m = got[0] == ids[i]
            assert got[1][m].tolist() == ids[order].tolist() and got[2][m].tolist() == [s[i, j] for j in order]


def clustered(seed, clusters, size, dims):
    """Integer vectors around far-apart centres."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dims)) * 400
    return np.rint(np.repeat(centre, size, axis=0) + 12 * rng.standard_normal((clusters * size, dims))).astype(np.int64)


def test_topk_prunes_clustered_vectors(spark, caplog):
    """Most pairs of blocks never meet, most of the others' products are never worked out, and the result is whole."""
    x = clustered(15, 40, 60, 48)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, q array<bigint>").repartition(5)
    with caplog.at_level("INFO", logger="semspark.llm.topk"):
        got = topk.top_k(rows, topk.F.col("vec_id") % 20 == 0, 7, size=60).toPandas()
    met, of = (int(w) for w in caplog.messages[-1].split() if w.isdigit())
    assert of >= 35 and met < 0.25 * of * (of - 1)
    for i in range(0, len(x), 20):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:7]
        r = got[got.query_id == i].sort_values("rank")
        assert r.vec_id.tolist() == order and r.score.tolist() == s[order].tolist()
    ids, some = np.arange(len(x)), x[:16]
    floors = np.sort(some @ x.T, axis=1)[:, -8].astype(np.float64)
    found, share = topk.searched(ids[:16], some, ids, x.T.copy(), 7, floors)
    assert share < 0.5 and sorted(zip(*(c.tolist() for c in found), strict=True)) == sorted(zip(*(c.tolist() for c in topk.best(ids[:16], some, ids, x.T.copy(), 7)), strict=True))


def test_topk_keeps_all_vectors_of_an_id(spark):
    rows = spark.createDataFrame([(20, [1, 0]), (20, [0, 3]), (1, [5, 5]), (1, [5, 6]), (2, []), (40, []), (40, [])], "vec_id bigint, q array<bigint>")
    got = [r[:] for r in topk.top_k(rows, topk.F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 18), (20, 2, 1, 15), (20, 3, 1, 5), (40, 1, 2, 0)]


def test_topk_odd(spark, tmp_path):
    got = topk.op6_topk(spark, write_vectors(spark, tmp_path, VECTORS)).collect()
    assert {(r.query_id, r.vec_id) for r in got if r.query_id == 20} == {(20, i) for i in (2, 6, 7, 40)}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 40] == [7, 6, 20, 2]
    assert topk.op6_topk(spark, write_vectors(spark, tmp_path / "e", [])).count() == 0


def brute_links(x, threshold=0.9):
    n = x.astype(np.float64)
    n = n / np.linalg.norm(n, axis=1, keepdims=True)
    m = n @ n.T >= threshold
    np.fill_diagonal(m, False)
    ids, root = least_labels(*np.nonzero(m))
    comp = np.arange(len(x))
    comp[ids] = root
    return m.sum(axis=1), comp


def test_nndescent(spark, tmp_path):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 32))
    x[200:500] = x[0] + 0.12 * rng.standard_normal((300, 32))  # more than any list holds
    x[600:700] = x[500:600] + 0.2 * rng.standard_normal((100, 32))
    x = x.astype(np.float32)
    d = write_vectors(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(x)])
    got = nndescent.op8_nndescent(spark, d).toPandas().sort_values("vec_id")
    n, comp = brute_links(x)
    assert n.max() > 250 and (got.n_links.to_numpy() <= n).all() and got.n_links.sum() >= 0.98 * n.sum()
    assert (got.component_id.to_numpy() == comp).mean() > 0.99 and (got.kept == (got.vec_id == got.component_id)).all()


def test_links_between_saturated_groups(spark, monkeypatch):
    """Groups of more near copies than a list holds, linked with each other: no list has an entry of the other group."""
    rng = np.random.default_rng(18)
    x = rng.standard_normal((1200, 32))
    x[0] /= np.linalg.norm(x[0])
    for n in range(8):  # cosine 0.95 between the groups of a pair, about 0.999 within
        a = x[1000 + n] / np.linalg.norm(x[1000 + n])
        b = x[1100 + n] - (x[1100 + n] @ a) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b)
        for at, c in ((100 * n, a), (100 * n + 50, b)):
            x[at : at + 40] = c + 0.005 * rng.standard_normal((40, 32))
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))])
    n, comp = brute_links(x.astype(np.float32))
    assert n[0] == 80
    got = nndescent.near_duplicates(rows).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == n.tolist() and got.component_id.tolist() == comp.tolist()
    monkeypatch.setattr(nndescent, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="0.5000 of the links"):
        nndescent.near_duplicates(rows)


def test_copies_of_a_vector_are_one_class(spark):
    """A third of all rows are one vector, some others are near it, scaled copies of it are it."""
    rng = np.random.default_rng(29)
    x = rng.standard_normal((900, 16))
    x[100:400] = x[7]
    x[400:420] = x[7] + 0.05 * rng.standard_normal((20, 16))
    x[420:430] = 2 * x[7]
    n, comp = brute_links(x)
    got = nndescent.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).toPandas().sort_values("vec_id")
    assert n[7] >= 330 and got.n_links.tolist() == n.tolist() and got.component_id.tolist() == comp.tolist()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_hubs_are_split(spark):
    """A vector that all others have in their lists is several groups, each with all of its own neighbours."""
    rng = np.random.default_rng(30)
    x = rng.standard_normal((201, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, 8, v.astype(np.float32).tobytes()) for i, v in enumerate(x)], "id bigint, dims int, v32 binary")
    entry = lambda ids: (np.array(ids, np.int64).tobytes(), np.zeros(len(ids), np.float32).tobytes())
    lists = spark.createDataFrame([(i, *entry([0] if i else [1, 2])) for i in range(201)], nndescent.LISTS)
    found = nndescent.round_of(lists, rows, 300, 8, members=20).toPandas()
    met = {i: set() for i in range(201)}
    for r in found.itertuples():
        met[r.id] |= set(np.frombuffer(r.nbrs, np.int64).tolist())
    assert max(len(x) // 8 for x in found.nbrs) < 45
    assert all(met[i] - {i} >= {1, 2} - {i} for i in range(3, 201)) and len(met[1] - {1}) == 199


def test_blocks_of_large_components(spark, monkeypatch):
    """A component of several blocks is counted as it is in one."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal(16) + 0.25 * rng.standard_normal((300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, e array<double>")
    v = nndescent.normalised(rows)
    members = rows.selectExpr("id", "0L AS root")
    monkeypatch.setattr(nndescent, "BLOCK", 64)
    dense = nndescent.exact(members, v, 0.9).toPandas()
    n, comp = brute_links(x)
    assert dense.dropna(subset=["id"]).groupby("id").n.sum().reindex(range(300), fill_value=0).tolist() == n.tolist()
    e = dense.dropna(subset=["a"])
    ids, root = least_labels(e.a.to_numpy(np.int64), e.b.to_numpy(np.int64))
    got = np.arange(300)
    got[ids] = root
    assert (got == comp).all()


def test_nndescent_odd(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(vectors(spark, VECTORS)).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 60)}
    assert {k: got[k] for k in alone} == alone and got[None] == (0, None, True)
    assert got[6] == (2, 6, True) and got[7] == (2, 6, False) and got[40] == (2, 6, False) and got[9] == (1, 8, False) and len(got) == 13
    assert nndescent.near_duplicates(vectors(spark, [])).count() == 0


# ---- the pipeline


def test_pipeline_stages(spark, sf_dir):
    """Every stage on what the one before kept, each held against a plain version of what it decides."""
    from semspark.llm import mixing, packing
    from semspark.llm.common import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900001, "12345 !!!", "en", "src0", 9), (900002, None, None, None, None)], DOC)
    docs = docs.unionByName(extra.selectExpr(*(f"CAST({c} AS {t}) AS {c}" for c, t in docs.dtypes)))
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, sf_dir))
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    a, b = seen["language"]
    assert set(a.doc_id) - set(b.doc_id) == {900001, 900002}
    a, b = seen["near_dups"]
    assert b.doc_id.is_unique and set(b.text) <= set(a.text) and b.text.is_unique and set(a.groupby("text").doc_id.min()) >= set(b.doc_id)
    a, b = seen["pii"]
    assert len(a) == len(b) and not b.text.str.contains(r"@mail\d\.example", regex=True).any() and (b.n_chars == b.text.str.len()).all()
    a, b = seen["mixing"]
    taken = mixing.mix(spark.createDataFrame(a)).toPandas().groupby("doc_id").taken.sum()
    words = b.assign(n=b.text.str.split().str.len()).groupby("doc_id").n.sum()
    assert (taken[taken > 0] == words.reindex(taken[taken > 0].index)).all()
    a, b = seen["packing"]
    assert packing.pieces(spark.createDataFrame(a[["doc_id", "text"]])).count() == len(b)
    assert b.groupby("sequence_id").length.sum().max() <= 1024 and b.sequence_id.nunique() <= b.length.sum() / 1024 * 1.02 + 1


def test_run_is_its_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op4_substrings", "op6_topk", "op7_mixing", "op8_nndescent"])
def test_same_as_sql(spark, sf_dir, name):
    from semspark.llm import registry

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = registry.queries()[name](spark, sf_dir).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    order = sorted(theirs.columns)
    pd.testing.assert_frame_equal(ours[order].sort_values(order).reset_index(drop=True), theirs[order].sort_values(order).reset_index(drop=True), check_dtype=False)
