"""Benchmark decontamination by winnowing.

Both sides hash every ``GRAM`` = 6 consecutive words and keep the minimum hash of every ``SPAN`` = 8
consecutive grams. A span of 6 + 8 - 1 = 13 shared words has the same grams on both sides and
therefore the same minimum: every shared 13-word window shares a fingerprint. The fingerprints of
the benchmark are joined to those of the corpus; the texts that share one are read again, and each
hit gram is extended to the 13-word windows around it, which are compared word by word with the
benchmark's windows. Words inside a matching window are hit.

A benchmark item of fewer than 13 words is one window. Its whole text is its fingerprint (a gram as
long as the item, and a span of one gram), and such grams of the corpus are joined in the same way,
for the lengths that occur in the benchmark only.

Everything is built-in functions over arrays inside the scan; texts are not shuffled. What is
shuffled are keys, fingerprints that hit, and windows that hit.

Defined results for odd input
* A null or wordless text has no words and no hits; a null or wordless item has no windows.
* Equal texts have equal results, so results are keyed by two 64-bit hashes of the text and repeated
  rows or null ids need no special case.
* A null item id counts for hits, but not as an item. Rows with one item id are one item.
* An empty benchmark marks nothing; an empty corpus gives an empty result. Columns other than the
  named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import ascii_lower, broadcast_if_small, let, materialize, split_words

WINDOW = 13
GRAM = 6
SPAN = WINDOW - GRAM + 1
#: What separates words: ASCII but for digits and lower-case letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD)


def _pairwise(a: Column, b: Column, shift: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(a[i], b[i + shift]) for every i where both exist (as far as b reaches)."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), combine)


def grams(w: Column) -> Column:
    """Hashes of every GRAM = 6 consecutive words, in order."""
    one = F.transform(w, lambda x: F.xxhash64(x))
    pair = lambda x, y: F.xxhash64(x, y)
    return let(one, lambda g1: let(_pairwise(g1, g1, 1, pair), lambda g2: let(
        _pairwise(g2, g2, 2, pair), lambda g4: _pairwise(g4, g2, 4, pair))))


def winnow(g: Column) -> Column:
    """Distinct minimum hashes of all runs of SPAN = 8 grams."""
    low = lambda x, y: F.least(x, y)
    m8 = let(_pairwise(g, g, 1, low), lambda m2: let(
        _pairwise(m2, m2, 2, low), lambda m4: _pairwise(m4, m4, 4, low)))
    return F.array_distinct(m8)


def _window_at(w: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def _starts(w: Column, n: int) -> Column:
    """1, 2, ... as far as windows of n words reach."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _short(w: Column, n: int) -> Column:
    """Hashes of all runs of n words, for items of n words."""
    return F.transform(_starts(w, n), lambda i: F.xxhash64(F.lit(n), _window_at(w, i, n)))


def text_key(text: Column) -> tuple[Column, Column]:
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """n, window, set_id, items: every window of the benchmark once, with the sorted ids of the items that have it.

    ``set_id`` names the set of items: windows of one passage that many items share have one set.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    long = w.select("item", F.lit(WINDOW).alias("n"), F.explode(
        let(F.col("w"), lambda v: F.transform(_starts(v, WINDOW), lambda i: _window_at(v, i, WINDOW)))).alias("window"))
    short = w.filter((F.size("w") > 0) & (F.size("w") < WINDOW)).select(
        "item", F.size("w").alias("n"), F.array_join("w", " ").alias("window"))
    once = long.unionByName(short).groupBy("n", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return once.withColumn("set_id", F.md5(F.to_json("items").cast("binary")))


def benchmark_fingerprints(items: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct winnowed hashes of the items."""
    w = items.select(words(F.col(text_col)).alias("w"))
    long = w.select(F.explode(let(F.col("w"), lambda v: let(grams(v), winnow))).alias("h"))
    short = w.filter((F.size("w") > 0) & (F.size("w") < WINDOW)).select(
        F.xxhash64(F.size("w"), F.array_join("w", " ")).alias("h"))
    return long.unionByName(short).distinct()


def _hit_grams(texts: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """k1, k2, n, at: where (word from 1) a gram of a text, or a run of n words, has a known hash."""
    def placed(hashes: Column, n: int) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.lit(n).alias("n"), (i + 1).alias("at")))

    def short(n: int) -> Column:
        return let(F.col("w"), lambda w: placed(_short(w, n), n))

    found = [let(F.col("w"), lambda w: placed(grams(w), WINDOW)), *[short(n) for n in lengths]]
    return texts.select("k1", "k2", F.explode(F.concat(*found)).alias("x")).select("k1", "k2", "x.*").join(known, "h", "left_semi")


def _extended(texts: DataFrame) -> DataFrame:
    """k1, k2, start, n, window: the windows around each hit ``hits`` (n, at) of a text with words ``w``."""
    def windows(w: Column) -> Column:
        def around(x: Column) -> Column:
            first = F.when(x["n"] < WINDOW, x["at"]).otherwise(F.greatest(x["at"] - (SPAN - 1), F.lit(1)))
            return F.transform(F.sequence(first, x["at"]), lambda s: F.struct(s.alias("start"), x["n"].alias("n")))

        starts = F.array_distinct(F.flatten(F.transform("hits", around)))
        inside = F.filter(starts, lambda x: x["start"] + x["n"] - 1 <= F.size(w))
        return F.transform(inside, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.array_join(F.slice(w, x["start"], x["n"]), " ").alias("window")))

    return texts.select("k1", "k2", F.explode(let(F.col("w"), windows)).alias("x")).select("k1", "k2", "x.*")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """id_col, k1, k2, n_words, n_hit, n_items, items of every row of ``docs``.

    ``items`` holds the ids, as sorted strings, of the benchmark items with a window in the text.
    """
    windows = materialize(benchmark_windows(items, item_id_col, item_text_col), "bench-windows")
    prints = materialize(benchmark_fingerprints(items, item_text_col), "bench-prints")
    known = broadcast_if_small(prints)
    # at most WINDOW - 1 numbers
    lengths = sorted(r.n for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect())

    k1, k2 = text_key(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), k1, k2, words(F.col(text_col)).alias("w"))

    def scanned(w: Column) -> Column:
        hashes = F.concat(let(grams(w), winnow), *[F.array_distinct(_short(w, n)) for n in lengths])
        return F.struct(F.size(w).alias("n_words"), hashes.alias("hs"))

    # each text is cut and hashed once; rows and hashes then go their own ways
    scan = materialize(keyed.select("id", "k1", "k2", let(F.col("w"), scanned).alias("x")).select("id", "k1", "k2", "x.*"), "scan")
    hits = scan.select("k1", "k2", F.explode("hs").alias("h")).join(known, "h", "left_semi").select("k1", "k2").distinct()
    hits = broadcast_if_small(materialize(hits, "hit-texts"))

    again = docs.select(k1, k2, words(F.col(text_col)).alias("w")).join(hits, ["k1", "k2"], "left_semi")
    grams_hit = _hit_grams(again, known, lengths).select("k1", "k2", "n", "at").distinct()
    per_text = materialize(grams_hit.groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "at")).alias("hits")), "hit-grams")
    found = _extended(docs.select(k1, k2, words(F.col(text_col)).alias("w")).join(broadcast_if_small(per_text, 20_000), ["k1", "k2"])).distinct()
    names = broadcast_if_small(windows.select("n", "window", "set_id"), 200_000)
    matched = materialize(found.join(names, ["n", "window"]).select("k1", "k2", "start", "n", "set_id"), "hit-windows")

    by_start = Window.partitionBy("k1", "k2").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(by_start), F.lit(0))), F.lit(0))
    counted = matched.withColumn("fresh", fresh).groupBy("k1", "k2").agg(
        F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set("set_id")).alias("sets"))
    counted = materialize(counted.withColumn("combination", F.md5(F.array_join("sets", ",").cast("binary"))), "hit-texts-counted")
    # the items of a combination of windows are put together once, not for every text that has it
    distinct = counted.groupBy("combination").agg(F.first("sets").alias("sets")).select("combination", F.explode("sets").alias("set_id"))
    members = distinct.join(windows.select("set_id", "items").dropDuplicates(["set_id"]), "set_id").select("combination", F.explode("items").alias("item"))
    named = materialize(distinct.select("combination").distinct().join(
        members.groupBy("combination").agg(F.sort_array(F.collect_set("item")).alias("items")), "combination", "left"), "hit-items")
    # written first, so that the join below deals rows by plain exchanges: a hot text can be split
    result = counted.select("k1", "k2", "n_hit", "combination").join(broadcast_if_small(named, 20_000), "combination")
    result = broadcast_if_small(materialize(result.drop("combination"), "contaminated-texts"), 200_000)
    return scan.drop("hs").join(result, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col),
        "k1",
        "k2",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated texts."""
    found = contamination(docs, items, id_col, text_col)
    bad = materialize(
        found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(),
        "contaminated")
    k1, k2 = text_key(F.col(text_col))
    return docs.join(broadcast_if_small(bad), (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
