from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from flowlake.llm import exact_dedup, mixing, pipeline, registry, sharding

SF = "/root/testdata/sf0.001"


# exact dedup ------------------------------------------------------------------------------------------------
def test_exact_dedup_odd_rows(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == odd.count()
    fox = [r for r in got if r["text_sha256"] == hashlib.sha256(b"the quick brown fox jumps over the lazy dog and then it runs far away from here").hexdigest()]
    assert [r["group_size"] for r in fox] == [3] * 3 and all(r["keep_id"] == 2 for r in fox)
    assert sum(r["kept"] for r in fox) == 1 and [r["doc_id"] for r in fox if r["kept"]] == [2]
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted(str(r["doc_id"]) for r in empty) == ["3", "4", "None"] and {r["keep_id"] for r in empty} == {4}
    assert all(r["kept"] for r in got if r["group_size"] == 1)


def test_exact_dedup_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_same_prefix_and_length(spark):
    texts = ["p" * 64 + c for c in "abca"] + ["q" * 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(df).collect() if r["kept"]) == [1, 2, 3, 4]
    assert exact_dedup.surviving_keys(df).count() == 1  # the text of its own prefix is never hashed in full
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(df).collect()) == [1, 2, 3, 4]


def test_refinement_reads_less_at_each_step(spark):
    """A length of its own is not hashed at all; a shared length without a shared prefix is not read in full."""
    df = spark.createDataFrame([(1, "a" * 70), (2, "b" * 70), (3, "c" * 71), (4, "d" * 80), (5, "d" * 80)], "doc_id long, text string")
    assert sorted(r["n_bytes"] for r in exact_dedup.shared_lengths(df).collect()) == [70, 80]
    assert [r["n_bytes"] for r in exact_dedup.surviving_keys(df).collect()] == [80]
    assert [(r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(df).collect()] == [(5, 2)]


def test_drop_duplicates_odd_rows(odd, none):
    kept = exact_dedup.drop_duplicates(odd)
    want = Counter((r["doc_id"], r["text_sha256"]) for r in exact_dedup.exact_dedup(odd).collect() if r["kept"])
    got = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect())
    assert kept.columns == odd.columns and got == want and exact_dedup.drop_duplicates(none).count() == 0


# sharding ---------------------------------------------------------------------------------------------------
def _check(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n_shards
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_sharding_odd_rows(odd):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count()
    _check(rows, 3)
    null = next(r for r in rows if r["doc_id"] == 3)
    assert null["size"] == 16 and null["text_crc32"] == 0
    uni = next(r for r in rows if r["doc_id"] == 9)
    text = "naïve 😀 𝔘nicode Ünïcode ß".encode()
    assert uni["size"] == len(text) + 16 and uni["text_crc32"] == zlib.crc32(text)


def test_sharding_empty(none):
    assert sharding.shard_documents(none, 3).count() == 0


def test_shards_are_even(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 400)) for i in range(20_000)], "doc_id long, text string")
    rows = sharding.shard_documents(df, 40).collect()
    _check(rows, 40)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(size) == 40 and max(size.values()) <= 1.01 * min(size.values())


def _load(sizes, slot_map):
    shard, load = {r["virtual_slot"]: r["shard"] for r in slot_map.collect()}, Counter()
    for r in sizes.collect():
        load[shard[r["virtual_slot"]]] += r["bytes"]
    return load


def test_rebalance_moves_little(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(20_000)], "doc_id long, text string")
    sizes = sharding.slot_sizes(sharding.slot_rows(df)).cache()
    path = str(tmp_path)
    sharding.store_slot_map(sharding.build_slot_map(sizes, 10), path)
    sharding.store_slot_map(sharding.rebalance(sharding.read_slot_map(spark, path), sizes, 11), path)
    new = {r["virtual_slot"]: r["shard"] for r in sharding.read_slot_map(spark, path).collect()}
    old = {r["virtual_slot"]: r["shard"] for r in sharding.read_slot_map(spark, path, 1).collect()}
    assert sharding.read_slot_map(spark, path).first()["version"] == 2 and set(new) == set(old) == set(range(sharding.N_SLOTS))
    moved = [s for s in new if new[s] != old[s]]
    assert len(moved) / len(new) < 0.12 and sum(new[s] == 10 for s in moved) > 0.9 * len(moved)
    load = _load(sizes, sharding.read_slot_map(spark, path))
    assert len(load) == 11 and max(load.values()) < 1.03 * min(load.values())


def _placed(df):
    return sorted((r["doc_id"], r["shard"], r["slot"], r["virtual_slot"]) for r in df.collect())


def test_stored_map_holds(spark, tmp_path):
    """A second run uses the map of the first, a grown corpus loses nothing, and only a rebalance moves a slot."""
    path = str(tmp_path / "map")
    make = lambda n: spark.createDataFrame([(i, "x" * (i % 89)) for i in range(n)], "doc_id long, text string")
    first = _placed(sharding.shard_documents(make(300), 7, map_path=path))
    assert _placed(sharding.shard_documents(make(300), 7, map_path=path)) == first
    assert sharding.stored_versions(spark, path) == [1] and sharding.read_slot_map(spark, path).count() == sharding.N_SLOTS
    grown = sharding.shard_documents(make(9000), 7, map_path=path).collect()
    _check(grown, 7)
    where = {r["doc_id"]: r["shard"] for r in grown}
    assert len(where) == len(grown) == 9000 and all(where[d] == s for d, s, _, _ in first)
    moved = sharding.shard_documents(make(9000), 7, map_path=path, move=True).collect()
    _check(moved, 7)
    assert len(moved) == 9000 and sharding.stored_versions(spark, path) == [1, 2]
    size = Counter()
    for r in moved:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.02 * min(size.values())
    assert sum(r["shard"] != where[r["doc_id"]] for r in moved) < 2500
    more = sharding.shard_documents(make(9000), 8, map_path=path, move=True)
    assert more.count() == 9000 and {r["shard"] for r in more.collect()} == set(range(8)) and sharding.stored_versions(spark, path) == [1, 2, 3]
    with pytest.raises(ValueError):
        sharding.shard_documents(make(10), 7, map_path=path)
    with pytest.raises(ValueError):
        sharding.store_slot_map(sharding.read_slot_map(spark, path), path)


def test_map_of_an_empty_corpus(spark, none, odd, tmp_path):
    path = str(tmp_path / "map")
    assert sharding.shard_documents(none, 3, map_path=path).count() == 0
    held = Counter(r["shard"] for r in sharding.read_slot_map(spark, path).collect())
    assert sum(held.values()) == sharding.N_SLOTS and max(held.values()) - min(held.values()) <= 1
    rows = sharding.shard_documents(odd, 3, map_path=path).collect()
    assert len(rows) == odd.count()
    _check(rows, 3)
    sizes = sharding.slot_sizes(sharding.slot_rows(odd))
    missing = sharding.read_slot_map(spark, path).filter("virtual_slot >= 100")  # slots that a map does not list yet
    assert {r["virtual_slot"] for r in sharding.rebalance(missing, sizes, 3).collect()} == set(range(sharding.N_SLOTS))


def test_repeated_rows_are_spread(spark):
    df = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard_documents(df, 4).collect()
    _check(rows, 4)
    assert len(rows) == 6000 and max(Counter(r["virtual_slot"] for r in rows).values()) <= 4 * sharding.COPIES_TOGETHER


def brute_shards(docs, n_shards=40):
    """(doc_id, shard, slot, virtual slot) of (doc_id, text): slots, their largest-first packing and the positions in plain Python."""
    docs = [(doc, (text or "").encode()) for doc, text in docs]
    n_slots, slots = sharding.N_SLOTS, defaultdict(list)
    for doc, text in docs:
        h = 42
        for v in (doc, len(text) + 16, zlib.crc32(text)):
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        slots[(h - 2**64 if h >= 2**63 else h) % n_slots].append((doc, zlib.crc32(text), len(text) + 16))
    load, shard_of = [0] * n_shards, {}
    for size, slot in sorted(((sum(x[2] for x in slots[s]) + 1, s) for s in range(n_slots)), reverse=True):
        shard_of[slot] = at = load.index(min(load))
        load[at] += size
    out, filled = [], [0] * n_shards
    for slot in range(n_slots):
        for doc, _, _ in sorted(slots[slot]):
            out.append((doc, shard_of[slot], filled[shard_of[slot]], slot))
            filled[shard_of[slot]] += 1
    return sorted(out)


def test_sharding_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _placed(registry.QUERIES["op9_sharding"](spark, SF)) == brute_shards(docs)


# mixing -----------------------------------------------------------------------------------------------------
def _brute_share(budget, nodes):
    """nodes: name -> (cap, w): whole-token water-filling."""
    order = sorted(nodes, key=lambda n: (nodes[n][0] / nodes[n][1], n))
    out, left = {}, budget
    for i, n in enumerate(order):
        cap, w = nodes[n]
        rest = order[i:]
        if cap * sum(nodes[m][1] for m in rest) <= w * left:
            out[n], left = cap, left - cap
            continue
        total = sum(nodes[m][1] for m in rest)
        out |= {m: nodes[m][1] * left // total for m in rest}
        break
    return out


def _brute_mix(docs, weights, budget, epochs, seed=17):
    """docs: (doc_id, domain, lang, source, tokens). Draws (doc_id, epoch)."""
    leaf = defaultdict(list)
    for d in docs:
        leaf[d[1:4]].append(d)
    avail = {k: sum(d[4] for d in v) for k, v in leaf.items()}
    budget = sum(avail.values()) if budget is None else budget
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    live = {k: a for k, a in avail.items() if a > 0 and w("domain", k[0]) and w("lang", k[1]) and w("source", k[2])}

    def caps(prefix, depth):
        out = defaultdict(int)
        for k, a in live.items():
            if k[:depth] == prefix:
                out[k[depth]] += a * epochs
        return out

    draws = []
    level = ["domain", "lang", "source"]

    def go(prefix, b):
        depth = len(prefix)
        if depth == 3:
            full, rest = divmod(b, avail[prefix])
            keyed = sorted((hashlib.md5(f"{seed}|{full}|{d[0]}".encode()).hexdigest(), d[0], d) for d in leaf[prefix])
            upto = 0
            for _, _, d in keyed:
                upto += d[4]
                draws.extend((d[0], e) for e in range(full + (rest > 0 and upto <= rest)))
            return
        nodes = {n: (c, w(level[depth], n)) for n, c in caps(prefix, depth).items()}
        for n, share in _brute_share(b, nodes).items():
            if share > 0:
                go((*prefix, n), share)

    go((), budget)
    return sorted(draws)


@pytest.mark.parametrize(("budget", "epochs"), [(None, 4), (3000, 1), (10**7, 2), (1, 4)])
def test_mix_matches_brute_force(spark, budget, epochs):
    rng = random.Random(5)
    docs = []
    for i in range(400):
        source = "src0" if rng.random() < 0.4 else f"src{rng.randint(1, 6)}"
        docs.append((i, ["web", "forum"][int(source[3]) % 2], rng.choice(["en", "en", "de", "fr"]), source, rng.randint(0, 60)))
    df = spark.createDataFrame([(i, " ".join(["w"] * n), lang, s) for i, _, lang, s, n in docs], "doc_id long, text string, lang string, source string")
    weights = {"domain": {"web": 3}, "lang": {"en": 1, "de": 5, "fr": 0}, "source": {"src0": 2}}
    domain = F.when(F.substring("source", 4, 1).cast("int") % 2 == 0, "web").otherwise("forum")
    mixed = mixing.mix(df, domain, weights, budget, epochs)
    got = sorted((r["id"], r["epoch"]) for r in mixing.draws(mixed).collect())
    assert got == _brute_mix(docs, weights, budget, epochs)
    tokens = sum(r["tokens"] for r in mixing.draws(mixed).collect())
    assert tokens <= (budget if budget is not None else sum(d[4] for d in docs))


def test_mix_odd_rows(odd, none):
    domain = pipeline.domain_of(F.col("source"))
    out = mixing.mix_documents(odd, domain, pipeline.WEIGHTS)
    assert out.columns == odd.columns
    ids = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
    assert max(ids.values()) <= 4 and all(isinstance(k, tuple) for k in ids)
    assert ids[(2, odd.filter("doc_id = 2").first()["text"])] <= 4  # the repeated row is one document
    assert mixing.mix_documents(none, domain, pipeline.WEIGHTS).count() == 0
    assert mixing.draws(mixing.mix(none, domain, {})).count() == 0


def test_mix_documents_follows_mix(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    domain = pipeline.domain_of(F.col("source"))
    want = Counter(r["id"] for r in mixing.draws(mixing.mix(df, domain, pipeline.WEIGHTS)).collect())
    got = Counter(r["doc_id"] for r in mixing.mix_documents(df, domain, pipeline.WEIGHTS).select("doc_id").collect())
    assert got == want
