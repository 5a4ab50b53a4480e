from __future__ import annotations

import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowlake.llm import langid, pii, pipeline, registry
from tests.llm.test_dedup_shard_mix import _brute_mix as brute_mix
from tests.llm.test_dedup_shard_mix import brute_shards
from tests.llm.test_similar import _brute_kept as brute_similar
from tests.llm.test_simhash_decontaminate import _brute as brute_contamination
from tests.test_oracle import TABLES, same

SF = "/root/testdata/sf0.001"
FOUND = [
    ("Mail Jane.Doe+x@mail3.example.com.", "email", "Jane.Doe+x@mail3.example.com"),
    ("call +1 (017) 555-7713 now", "phone", "+1 (017) 555-7713"),
    ("call +49 30 901820 now", "phone", "+49 30 901820"),
    ("from 129.38.82.176, ok", "ip", "129.38.82.176"),
    ("pay 4952935900253052 soon", "card", "4952935900253052"),
    ("pay 4111-1111-1111-1111 soon", "card", "4111-1111-1111-1111"),
    ('token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" here', "secret", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"),
    ("is 123-45-6789 his", "ssn", "123-45-6789"),
    ("to DE89 3704 0044 0532 0130 00 please", "iban", "DE89 3704 0044 0532 0130 00"),
    ("and Mrs. Anna Schmidt said", "name", "Mrs. Anna Schmidt"),
    ("where John Smith lives at", "name", "John Smith"),
    ("or MR. JOHN SMITH again", "name", "MR. JOHN SMITH"),
    ("call 0171 555 7713 now", "phone", "0171 555 7713"),
    ("call (030) 901820 now", "phone", "(030) 901820"),
    ("from 2001:db8::1 it", "ip", "2001:db8::1"),
    ("to müller@bücher.de it", "email", "müller@bücher.de"),
    ("to иван@почта.рф it", "email", "иван@почта.рф"),
    ("pay 6212345678901232 soon", "card", "6212345678901232"),
    ("pay 3530111333300000 soon", "card", "3530111333300000"),
    ("pay 30569309025904 soon", "card", "30569309025904"),
    ("это госпожа Анна Петрова была", "name", "госпожа Анна Петрова"),
]
CLEAN = [
    "version 1.2.3.4.5 of 2001-11-04", "9807915762804490 has no check digit", "999.1.2.3", "a@b", "In 1999, 2,000,000 people", "Dr of the",
    "the token of my esteem", "at 12:30:45 of 00:11:22:33", "std::vector a::b", "The Smith Family", "007 008", "02/03/2004", "don't Miss it", "GB82 WEST 1234 5698 7654 33", "10 + 20 = 30", None, "",
]


def _rewritten(text, key="key"):
    return pii.Surrogates(key).rewrite(text, [p for *_, parts in pii.find(text) for p in parts])


@pytest.mark.parametrize(("text", "kind", "value"), FOUND)
def test_detect_and_replace(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in pii.detect(text)] == [(kind, value)]
    again = _rewritten(text)
    ((a, b, k),) = pii.detect(again)  # the stand-in is of the same type
    new = again[a:b]
    assert k == kind and again.replace(new, value) == text
    assert new != value and again == _rewritten(text) and again != _rewritten(text, "other")
    if kind != "name":
        shape = lambda x: re.sub(r"[a-zß-ÿа-я]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", x)))
        if kind not in ("ip", "secret"):
            assert shape(new) == shape(value)
        script = lambda x: [("Ѐ" <= c <= "ӿ", c.isascii()) for c in x if c.isalpha()]
        assert kind in ("ip", "secret") or script(new) == script(value)
    else:
        assert (new.split()[0] == value.split()[0]) == (value.split()[0] not in ("John",)) and len(new.split()) == len(value.split())
        assert ("Ѐ" <= new[-1] <= "ӿ") == ("Ѐ" <= value[-1] <= "ӿ")


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text(text):
    assert pii.detect(text) == []


def test_gender_of_names():
    assert _rewritten("Mr. Jo Smith").split()[1] in pii.GIVEN[("latin", "m")]
    assert _rewritten("Frau Jo Smith").split()[1] in pii.GIVEN[("latin", "f")]
    assert _rewritten("Later Maria Smith came").split()[1] in pii.GIVEN[("latin", "f")]
    assert _rewritten("Пётр Иванов тут").split()[0] in pii.GIVEN[("cyrillic", "m")]
    _, a, _, _, b, _, _, c = _rewritten("Mrs. Jo Smith left, Jo Smith and Jo").split()
    assert a == b == c and a in pii.GIVEN[("latin", "f")]


def test_one_person_under_several_names():
    text = "Mr. John Smith met Dr. JOHN SMITH. John Smith told Mr. Smith that Smith is John; the smith and johnson are not."
    got = _rewritten(text)
    given, surname = got.split()[1:3]
    assert got == text.replace("JOHN SMITH", f"{given} {surname}".upper()).replace("John", given).replace("Smith", surname)
    assert given != "John" and surname != "Smith"
    assert [k for *_, k in pii.detect(text)] == ["name"] * 6
    assert _rewritten("Mrs. Smith")[5:] == surname  # and in another document
    assert pii.detect("mr. john smith came")[0][2] == "name" and pii.detect("Mr. Ludwig van Beethoven sat")[0][:2] == (0, 24)


def _entities(names):
    return sorted({(kind, pii.canonical(kind, n[a:b])) for n in names for *_, parts in pii.find(n) for kind, a, b in parts})


def test_distinct_and_coreferent(spark):
    """Enough names to collide: stand-ins stay different, and one name has one stand-in."""
    names = [f"Mr. {a}{b} {c}{d}son" for a in "ABCDEFGHIJKLMNOPQRST" for b in ("ob", "im", "en") for c in "KLMNPRSTVWZ" for d in ("ar", "el", "ig", "on", "ut")]
    docs = [(i, f"Here {n} met {names[i - 1]}, and {n} left.") for i, n in enumerate(names)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = _entities(names)
    resolved = pii.resolve(spark.createDataFrame(seen, "type string, entity string"), "k").collect()
    assert len(resolved) == len(seen) == len({(r["type"], r["surrogate"]) for r in resolved})
    assert any(r["attempt"] > 1 for r in resolved) and not {(r["type"], r["surrogate"]) for r in resolved} & set(seen)
    stand_in = {(r["type"], r["entity"]): r["surrogate"].capitalize() for r in resolved}
    for r in pii.pseudonymize(df, "k").collect():
        want = []
        for n in (names[r["doc_id"]], names[r["doc_id"] - 1]):
            _, given, surname = n.split()
            want.append(f"Mr. {stand_in['given_m', given.lower()]} {stand_in['surname', surname.lower()]}")
        assert r["text"] == f"Here {want[0]} met {want[1]}, and {want[0]} left." and r["n_entities"] == 3


def test_one_stand_in_under_titles_of_two_genders(spark):
    """A given name has one stand-in in the corpus, whatever its documents make of it; of the list's gender, or of neither."""
    docs = [(1, "Here Dr. Alex Smith spoke."), (2, "Here Ms. Alex Smith spoke."), (3, "Here Mr. Alex Smith spoke."), (4, "Mr. Kim Wagner left."), (5, "Dr. Kim Wagner left."), (6, "Ms. Kim Smith left.")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    names = {i: re.search(r"(?:Dr|Ms|Mr)\. (\w+) (\w+)", t).groups() for i, t in got.items()}
    assert names[1] == names[2] == names[3] and names[4] == names[5] and names[6] == (names[4][0], names[1][1])
    assert len({*names[1], *names[4]} | {"Alex", "Kim", "Smith", "Wagner"}) == 8
    known = {(r["type"], r["entity"]): r["known"] for r in pii.known_types(spark.createDataFrame(
        [("given_m", "a"), ("given_x", "a"), ("given_f", "b"), ("given_m", "b"), ("given_x", "c"), ("surname", "a")], "type string, entity string")).collect()}
    assert known == {("given_m", "a"): "given_m", ("given_x", "a"): "given_m", ("given_f", "b"): "given_x", ("given_m", "b"): "given_x", ("given_x", "c"): "given_x", ("surname", "a"): "surname"}


@pytest.mark.parametrize("clean", ["In May 2020 it rained.", "It is in Baker Street now.", "See v1.2.3.4 of it."])
def test_clean_words_stay(clean):
    text = "Mr. May and Mrs. Baker left. "
    found = [text[a:b] for a, b, _ in pii.detect(text + clean) if a < len(text)]
    assert len(found) == 2 and len(pii.detect(text + clean)) == 2


def test_short_formats_do_not_run_out(spark):
    """Every address of the form a@b.io is taken: stand-ins grow until they are free."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i, f"to {a}@{b}.io") for i, (a, b) in enumerate((a, b) for a in letters for b in letters)]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()]
    assert len(set(got)) == 676 and not set(got) & {t for _, t in docs} and all(t.endswith(".io") and pii.detect(t)[0][2] == "email" for t in got)


def test_no_stand_in_is_an_entity(spark):
    first = pii.Surrogates("k").make("ip", "1.2.3.4")
    seen = spark.createDataFrame([("ip", "1.2.3.4"), ("ip", first)], "type string, entity string")
    got = {r["entity"]: r for r in pii.resolve(seen, "k").collect()}
    assert got["1.2.3.4"]["surrogate"] != first and got["1.2.3.4"]["attempt"] == 1


def test_pii_of_the_given_documents(spark):
    """The whole query worked out again in plain Python: rounds over all entities, then every text rewritten."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    s = pii.Surrogates("k")
    real = {(k, pii.canonical(k, t[a:b])) for _, t in docs for *_, parts in pii.find(t) for k, a, b in parts}
    settled, left = {}, {e: 0 for e in real}
    while left:
        tried = {e: s.make(*e, n) for e, n in left.items()}
        for e in sorted(tried):
            new = (e[0], tried[e])
            if new not in real and new not in {(k, m) for (k, _), (m, _) in settled.items()}:
                settled[e] = (tried[e], left[e])
        left = {e: n + 1 for e, n in left.items() if e not in settled}
    attempts = {e: n for e, (_, n) in settled.items()}
    want = {i: s.rewrite(t, [p for *_, parts in pii.find(t) for p in parts], attempts) for i, t in docs}
    spark.conf.set("spark.flowlake.pii.key", "k")
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_pii"](spark, SF).collect()}
    spark.conf.unset("spark.flowlake.pii.key")
    assert {i: r["text"] for i, r in got.items()} == want
    private = [r"[\w.+-]+@[\w.-]+\w", r"\+1 \(\d{3}\) 555-\d{4}", r"token = \"[0-9a-f]{40}\"", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"]
    for i, t in docs:
        spans = [m.group() for p in private for m in re.finditer(p, t)]
        assert all(x not in got[i]["text"] for x in spans)
        assert got[i]["n_entities"] or got[i]["text"] == t


def test_pii_odd_rows(odd, none):
    got = pii.pseudonymize(odd, "k")
    assert got.count() == odd.count() and got.filter("n_entities > 0").count() == 0
    clash = odd.withColumns({c: F.lit("old") for c in ("n_entities", "entity_types", "__k1", "__k2", "__later", "__found")})
    assert sorted(pii.pseudonymize(clash, "k").columns) == sorted([*odd.columns, "n_entities", "entity_types"])
    assert got.filter("doc_id = 3 AND text IS NULL").count() == 1 and pii.pseudonymize(none, "k").count() == 0


# registry and pipeline --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"pipeline"}))
def test_returns_every_row(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert registry.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def _xxh(*values):
    """Spark's hash of longs (8 bytes), ints (given as bytes) and strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v, h)
    return h - 2**64 if h >= 2**63 else h


def test_pipeline_matches_brute_force(spark):
    """Every stage worked out again in plain Python, on all that its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    assert len(docs) == table.count()

    # language: one text of each bucket of a language is learned from
    least = {}
    for r in docs.values():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            h = _xxh(r["text"].encode())
            at = (r["lang"], _xxh((1).to_bytes(4, "little"), h) % langid.MAX_TRAIN_ROWS)
            least[at] = min(least.get(at, (h, r["text"])), (h, r["text"]))
    model = langid.WordModel.fit([(text, lang) for (lang, _), (_, text) in least.items()])
    found = {i: model.label(r["text"]) for i, r in docs.items()}
    kept = [(i, docs[i]["text"]) for i, (lang, score, spans) in sorted(found.items()) if lang != "und" and (len(spans) <= 1 or score >= 0.5)]

    kept = brute_similar(kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in brute_contamination(kept, items) if hit and 20 * hit >= n}
    kept = [i for i, _ in kept if i not in bad]

    def domain(source):
        m = re.search("[0-9]+$", source or "")
        return {1: "reference", 2: "forum"}.get(int(m.group()) % 3 if m else 0, "web")

    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = [(i, domain(docs[i]["source"]), docs[i]["lang"] or "", docs[i]["source"] or "", tokens(docs[i]["text"])) for i in kept]
    mixed = [i for i, _ in brute_mix(leaves, pipeline.WEIGHTS, None, 4)]
    got = sorted((r["doc_id"], r["shard"], r["slot"], r["virtual_slot"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_shards([(i, docs[i]["text"]) for i in mixed])


def test_pipeline_odd_rows(spark, odd, none):
    for frame in (odd, none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "sharding":
                assert docs.columns == frame.columns
        assert docs.count() == 0 or frame is odd
