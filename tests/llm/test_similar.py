from __future__ import annotations

import random

from flowlake.llm import pipeline, similar
from flowlake.llm.common import materialize


def _brute_kept(rows, similarity=0.8):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [rows[i] for i in range(len(rows)) if find(i) == i]


def _copies(seed=5):
    """Texts with edited copies on both sides of the threshold, one large group of copies, and an id on two texts."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randint(0, 3000)}"
    for group in range(40):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append(base)
        for _ in range(90 if group == 0 else 4):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 35))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return [*rows, (rows[-1][0], "another text under an id that is taken")]


def test_similar_matches_brute_force(spark):
    rows = _copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in similar.drop_similar(df).collect()) == sorted(_brute_kept(rows))


def test_recall_on_texts_near_the_threshold(spark):
    """What goes is right, and nearly all that should go does: the index may miss a pair near 0.8."""
    rows = _copies(6)
    got = {(r["doc_id"], r["text"]) for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(_brute_kept(rows))
    assert want <= got and len(set(rows) - got) >= 0.97 * len(set(rows) - want)


def test_near_dedup_stage_takes_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(300)]
    near, far = list(base), list(base)
    for i in (20, 90, 150, 220, 280):
        near[i] = "x"
    for i in range(5, 300, 20):
        far[i] = "y"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    stage = dict(pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == [1, 3]


def test_short_texts_make_no_pairs(spark):
    """Of texts of one to eight words only those of four shingles and more can be similar to others; all pairs of these lists are few."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(1 + i % 8))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    printed = df.select(similar._printer(5, 0.8)("text").alias("p")).select("p.*").filter("fp IS NOT NULL").distinct()
    assert printed.count() <= 2500
    printed = materialize(printed, "test")
    looked_at = []
    similar._components(printed, lambda pairs: looked_at.append(pairs.count()) or pairs.limit(0), similar.key_positions(), similar.FIRST_KEYS)
    assert sum(looked_at) < 10 * len(rows)
    assert similar.drop_similar(df).count() == len({t for _, t in rows})


def test_short_texts_that_are_equal_are_one(spark):
    rows = [(1, "a b c"), (2, "A  b c"), (3, "a b d"), (4, "a b c d e f g"), (5, "a b c d e f"), (6, None), (7, " "), (8, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.drop_similar(df).collect()) == [1, 3, 4, 5, 6, 8]


def _more_and_more_edited(copies, seed=11):
    """A text and copies of it with one to 20 words replaced: nearly all pairs are alike, but below the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 14, 20])):
            copy[rng.randrange(150)] = f"w{rng.randint(150, 8000)}"
        rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_pairs_of_a_group_grow_with_its_texts(spark, monkeypatch):
    looked_at, call = [], similar._Verifier.__call__
    monkeypatch.setattr(similar._Verifier, "__call__", lambda self, pairs: looked_at.append(pairs.count()) or call(self, pairs))
    sums = []
    for copies in (150, 600):
        rows = _more_and_more_edited(copies)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((r["doc_id"], r["text"]) for r in similar.drop_similar(df).collect()) == _brute_kept(rows)
        sums.append(sum(looked_at))
        looked_at.clear()
    assert sums[1] < 8 * sums[0] and sums[1] < 16 * 600


def test_pairs_by_sets_hold_all_similar_ones(spark):
    """Without components yet: of texts of several sizes around two frequent ones, some cut short, no similar pair is missing."""
    rng = random.Random(3)
    rows = [t.split() for _, t in _more_and_more_edited(120)] + [[f"v{i}" for i in range(60, 200)]] * 40
    rows += [[*r[: rng.randint(100, len(r))], *(["x"] * rng.randint(0, 2))] for r in rows]
    sets = {int(s.sum().view("int64")): s for s in (similar.shingle_set(" ".join(r)) for r in rows)}
    df = spark.createDataFrame([(k, [int(h) for h in s.view("int64")]) for k, s in sets.items()], "node long, s array<long>")
    placed = similar._placed(similar._parts(df), spark.createDataFrame([], "node long, component long"))
    got = {tuple(sorted(p)) for p in similar._rare_pairs(placed, 0.8).union(similar._frequent_pairs(placed, 0.8, False)).collect()}
    held = {k: set(s.tolist()) for k, s in sets.items()}
    want = {tuple(sorted((a, b))) for a in held for b in held if a != b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])}
    assert want and want <= got
