from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from flowlake.llm import decontaminate, simhash
from flowlake.llm.graph import connected_components

SF = "/root/testdata/sf0.001"


def _components(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    nodes = {n for e in real for n in e}
    assert got == _components(nodes, real)


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    k = 3
    shingles = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c", "a b c d", "A\tb\nc\x0bd\x0ce\rf  g", "É é x y z ß", "word " * 9000, "x y z w " * 3])
def test_fingerprint(text):
    assert simhash._fingerprint(text) % 2**64 == _plain_fingerprint(text)


def test_links_match_brute_force(spark):
    """Clusters around few centres: long lists, chains of links, and bit 63."""
    rng = random.Random(7)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            fp = centre
            for _ in range(rng.randint(0, 3)):
                fp ^= 1 << rng.randint(0, 63)
            fps.add(fp)
    fps = sorted(fps)
    ids = {fp: i for i, fp in enumerate(fps)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    dense = rng.getrandbits(64)
    fps = sorted({*fps, *(dense ^ x for x in range(400)), *(dense ^ (x << 57) for x in range(60))})  # lists of hundreds
    ids = {fp: i for i, fp in enumerate(fps)}
    classes = spark.createDataFrame([(signed(fp),) for fp in fps], "fp long")
    links = [(ids[r["u"] % 2**64], ids[r["v"] % 2**64]) for r in simhash.near_links(classes).collect()]
    brute = [(ids[a], ids[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert all((fps[u] ^ fps[v]).bit_count() <= 2 for u, v in links)
    assert _components(range(len(fps)), links) == _components(range(len(fps)), brute)


def test_simhash_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: _plain_fingerprint(t) for i, t in texts.items()}
    edges = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    parts = _components(fps, edges)
    assert got == {i: (fps[i], parts[i]) for i in fps}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert kept == {i for i, c in parts.items() if i == c}


def test_simhash_odd_rows(odd, none):
    got = simhash.simhash_components(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}  # null, empty and blank texts, ids 3, 4, 8 and null
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7, 9] and ids.count(None) == 1
    assert simhash.simhash_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "q r s t u")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == [1, 2]


def test_one_id_on_two_texts(spark):
    """Texts that clash in their id are two documents: an unrelated one is never lost to the other's near copy."""
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "q r s t u"), (3, "l m n o p"), (3, "v w x y z"), (3, "v w x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [(1, "a b c d"), (2, "q r s t u"), (3, "l m n o p"), (3, "v w x y z")]


# decontamination --------------------------------------------------------------------------------------------
def _words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["la", "le", "Éa", "x1", "b", "ou", "ss", "ß", "tt", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1 + 4, 6, 7, 9, 12, 13, 14, 20, 40, 60])]
    items += [(90, "Solo"), (91, "two words"), (92, None), (93, "  ... "), (None, say(15)), (94, "la " * 30), (94, say(13))]
    docs = []
    for i in range(120):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            w = item.split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [", ".join(w[a : a + rng.randint(5, 25)]).upper() if rng.random() < 0.3 else " ".join(w[a : a + 16]), say(rng.randint(0, 9))]
        docs.append((i, "\n".join(parts)))
    docs += [(500, None), (501, ""), (502, "la " * 200), (503, "solo"), (503, "solo"), (None, "x TWO, WORDS y")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(d, b).collect()), key=repr)
    assert got == _brute(docs, items)


def test_decontaminate_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "jumps over the lazy dog")], "item_id long, text string")
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns
    assert {r["doc_id"] for r in left.collect()} == {3, 4, None, 5, 6, 7, 8, 9}
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_threshold_is_a_twentieth(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha " + "x " * 19), (2, "alpha " + "x " * 20)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]


def test_winnowing_guarantee(spark):
    """Any two texts that share 13 words share a fingerprint."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        shared = [str(rng.randint(0, 3)) for _ in range(13)]
        pad = lambda: [str(rng.randint(0, 3)) for _ in range(rng.randint(0, 30))]
        rows.append((i, [*pad(), *shared, *pad()], [*pad(), *shared, *pad()]))
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    both = df.select(F.arrays_overlap(decontaminate.winnow(decontaminate.grams(F.col("a"))), decontaminate.winnow(decontaminate.grams(F.col("b")))).alias("x"))
    assert all(r["x"] for r in both.collect())
