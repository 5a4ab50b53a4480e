from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlake.llm import search
from flowlake.llm.common import materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Counter of (item id, rank, doc id, score)."""
    counts = [(i, len(words(t)), Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, n, _ in counts), sum(n for _, n, _ in counts)
    df = Counter(t for _, _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, n, c in counts:
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def found(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def corpus(seed, n=1500):
    """Texts of a skewed vocabulary on several subjects, with near copies and a large group of equal texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        subject = rng.randrange(12)
        if i > n * 2 // 3:
            text = "The same text, w3 w5 w30 W77 and w123 again"
        elif docs and rng.random() < 0.2:
            text = rng.choice(docs)[1] + " " + rng.choice(vocabulary)
        else:
            text = " ".join(vocabulary[min(399, int(rng.paretovariate(0.6)) + (30 * subject if rng.random() < 0.6 else 0))] for _ in range(rng.randrange(1, 60)))
        docs.append((i, text))
    items = [(j, " ".join(rng.sample(rng.choice(docs[:900])[1].split() * 3, 3)) + f" w{rng.randrange(400)} w{rng.randrange(400)}, w1") for j in range(40)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1, 4, 64])
def test_equals_brute_force(spark, block):
    docs, items = corpus(block)
    assert found(search.search(*frames(spark, docs, items), block=block)) == brute(docs, items)


def test_stored_index_of_all_terms_and_batches_of_items(spark, monkeypatch):
    docs, items = corpus(5, 600)
    d, q = frames(spark, docs, items)
    index = search.build_index(d)
    monkeypatch.setattr(search, "BATCH_TERMS", 60)
    monkeypatch.setattr(search, "OPEN_POSTINGS", 50)
    assert found(search.search(d, q, 5, index=index)) == brute(docs, items, 5)


def test_more_terms_than_may_be_broadcast(spark, monkeypatch):
    docs, items = corpus(6, 400)
    monkeypatch.setattr(search, "MAX_BROADCAST_ROWS", 10)
    assert found(search.search(*frames(spark, docs, items), 3)) == brute(docs, items, 3)


def test_blocks_hold_their_list_and_are_skipped_by_exact_bounds(spark):
    """Blocks partition each list that is needed, summaries are maxima over members, and what is skipped cannot be in the result."""
    docs, items = corpus(7)
    d, q = frames(spark, docs, items)
    index = search.build_index(d)
    named = materialize(search._counts(q, "item_id", "text", None).withColumn("item", F.col("id")), "t")
    (batch,) = search._batches(named, index.weights)
    want = brute(docs, items, 5)
    batch.threshold = {i: min(s for item, _, _, s in want if item == i) for i in {w[0] for w in want}}
    search._need(batch)
    shared = spark.sparkContext.broadcast(batch)
    blocks = search._blocks(index.rows, shared, 8).collect()
    rows = {r["row"]: dict(zip(r["terms"], r["parts"])) for r in index.rows.collect()}
    names = {i: t for t, i in batch.terms.items()}
    for term in batch.asked:
        mine = [x for b in blocks if b["term"] == term for x in b["rows"]]
        assert sorted(mine) == sorted(r for r, own in rows.items() if names[term] in own)
    for b in blocks:
        assert len(b["rows"]) <= 8
        for t, most in zip(b["at"], b["most"]):
            assert most == max(rows[r].get(names[t], 0) for r in b["rows"])
    kept = search._kept(spark.createDataFrame(blocks, "term int, rows array<long>, at array<int>, most array<long>"), shared).collect()
    looked_at = {(k["item"], r) for k in kept for r in k["rows"]}
    asked = {(i, r) for b in blocks for i in batch.lists[b["term"]] for r in b["rows"]}
    score = lambda i, own: search._score({batch.terms[t]: p for t, p in own.items() if t in batch.terms}, batch.items[i])
    needed = {(i, r) for i in batch.items for r, own in rows.items() if i in batch.threshold and score(i, own) >= batch.threshold[i]}
    assert needed <= looked_at < asked
    everything = sum(len(rows) for _ in batch.items)
    assert len(looked_at) < everything / 4


def test_odd_rows(spark, odd, none):
    items = [(1, "The quick BROWN fox"), (1, "The quick BROWN fox"), (None, "naïve 😀 Ünïcode"), (2, None), (3, " !? "), (4, "nowhere"), (5, "word word"), (6, "a text")]
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row long")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(search.search(odd, q)) == brute(docs, items)
    assert search.search(none, q).count() == 0 and search.search(odd, q.limit(0)).count() == 0
