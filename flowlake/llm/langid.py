"""Language identification of mixed-language text.

Each word (a run of letters) is scored per language by the character n-grams it is made of. Unicode
script ranges narrow the candidates first: a language is a candidate for a word only if the script
makes up at least ``SCRIPT_SHARE`` of the words of that language's training texts. Viterbi with a
switching penalty then labels spans of words, and the language that labels most letters is the
document's.

The n-gram log-probabilities are learned from at most ``MAX_TRAIN_ROWS`` labelled texts of each
language: texts are dealt to as many buckets by a hash, and the text of the least hash in each is
taken. So a rare language has as many as it can, copies count once, and what is chosen does not
depend on order or on repeated ids. These texts are read whole; Spark counts their n-grams, and the
distinct ones with their counts are what the driver receives. None is left out.

Viterbi over a document whose best language is never beaten by more than the switching penalty over
any run of words can only stay in that language, so those documents need one vectorised look at
their scores; the others take the full recursion.

Defined results for odd input
* Text that is null or without letters gets ``und``, score 0 and no spans. Digits, fractions, roman
  numeral signs and the like are not letters.
* Words in a script no language was trained on have no candidates and weigh nothing; text of such
  words alone gets the most frequent language of the training rows with score 0. Where only one
  language was learned, text in its scripts gets it with score 1.
* Ties go to the language that sorts first. Null labels are not learned from. Without any labelled
  row every document is ``und``. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import give_back, materialize

#: Labelled texts of each language that are learned from, at most.
MAX_TRAIN_ROWS = 500
GRAM_SIZES = (1, 2, 3)
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.001
WORD_CACHE = 200_000

# First and last code point of the scripts told apart.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    # the pattern also takes fractions, superscripts, roman numeral signs and the like
    return "".join(c if c.isalpha() else " " for w in words for c in (*w, " ")).split()


def script_of(word: str) -> str:
    """Script of a word's first letter."""
    code = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= code <= hi), "other")


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in GRAM_SIZES for i in range(len(padded) - n + 1)]


def _counts(words: dict[str, int]) -> Counter:
    """("gram" or "script", which) -> how often, of words with their counts."""
    out: Counter = Counter()
    for word, n in words.items():
        out["script", script_of(word)] += n
        for g in _grams(word):
            out["gram", g] += n
    return out


class WordModel:
    """Log-probabilities of n-grams per language, relative to their mean over languages."""

    def __init__(self, langs: list[str], grams: dict[str, int], scores: np.ndarray, scripts: dict[str, np.ndarray], common: int):
        self.langs, self.grams, self.scripts, self.common = langs, grams, scripts, common
        self.scores = np.vstack([scores, np.zeros(len(langs))])  # the last row is of unknown n-grams
        self.narrow = {s for s, allowed in scripts.items() if not allowed.all()}
        self._words: dict[str, int] = {}
        self._table = np.zeros((1024, len(langs)), dtype=np.float32)
        self.key = hashlib.blake2b(repr((langs, sorted(grams), sorted(scripts))).encode() + scores.tobytes()).hexdigest()

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> "WordModel | None":
        """Learn from (text, lang) pairs."""
        words: dict[str, Counter] = {}
        for text, lang in texts:
            words.setdefault(lang, Counter()).update(words_of(text))
        counts = [(lang, kind, key, n) for lang, found in words.items() for (kind, key), n in _counts(found).items()]
        return cls.of_counts(counts, Counter(lang for _, lang in texts))

    @classmethod
    def of_counts(cls, counted: list[tuple[str, str, str, int]], rows: dict[str, int]) -> "WordModel | None":
        """Learn from (lang, "gram" or "script", which, count) and the number of rows of each language."""
        langs = sorted(rows)
        if not langs:
            return None
        at = {lang: k for k, lang in enumerate(langs)}
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for lang, kind, key, n in sorted(counted):
            (grams if kind == "gram" else scripts).setdefault(key, np.zeros(len(langs)))[at[lang]] += n
        names = list(grams)
        table = np.array([grams[g] for g in names]).reshape(len(names), len(langs)) + SMOOTHING
        logs = np.log(table / table.sum(axis=0))
        logs -= logs.mean(axis=1, keepdims=True)
        words = sum(scripts.values(), np.zeros(len(langs)))
        allowed = {s: (c > 0) & (c >= SCRIPT_SHARE * words) for s, c in scripts.items()}
        common = max(range(len(langs)), key=lambda k: (rows[langs[k]], -k))
        return cls(langs, {g: i for i, g in enumerate(names)}, logs, allowed, common)

    def _score_words(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, all their n-grams at once."""
        unknown, get = len(self.scores) - 1, self.grams.get
        ids, starts = [], []
        for w in words:
            starts.append(len(ids))
            ids += [get(g, unknown) for g in _grams(w)]
        rows = np.add.reduceat(self.scores[ids], starts) / len(GRAM_SIZES)
        for i, w in enumerate(words):
            script = "latin" if w[0] < "\u0250" else script_of(w)
            if script not in self.scripts:
                rows[i] = 0.0
            elif script in self.narrow:
                rows[i] = np.where(self.scripts[script], rows[i], rows[i].min() - 20.0)
        return rows

    def emissions(self, words: list[str]) -> np.ndarray:
        """Words x languages. Scores of words seen before are kept, up to WORD_CACHE words."""
        if len(self._words) > WORD_CACHE:
            self._words, self._table = {}, np.zeros((1024, len(self.langs)), dtype=np.float32)
        known = self._words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            at, end = len(known), len(known) + len(new)
            while end > len(self._table):
                self._table = np.vstack([self._table, np.zeros_like(self._table)])
            self._table[at:end] = self._score_words(new)
            known.update(zip(new, range(at, end)))
        return self._table[[known[w] for w in words]]

    def path(self, emitted: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
        """Language index of each word: the best labelling at ``penalty`` per switch."""
        n, k = emitted.shape
        best = int(emitted.sum(axis=0).argmax())
        if k == 1:
            return np.zeros(n, dtype=np.int64)
        gain = np.cumsum(emitted.max(axis=1) - emitted[:, best])
        gain = np.concatenate([[0.0], gain])
        if gain[-1] < penalty:
            return np.full(n, best)
        others = np.delete(emitted, best, axis=1) - emitted[:, [best]]
        run = np.concatenate([[0.0], np.cumsum(others.max(axis=1))])
        if (run - np.minimum.accumulate(run)).max() < penalty:
            return np.full(n, best)
        came, score = array("B" if k <= 2**8 else "H" if k <= 2**16 else "L"), emitted[0].tolist()
        for row in emitted[1:].tolist():
            switched = max(score)
            top = score.index(switched)
            switched -= penalty
            came.extend([j if s >= switched else top for j, s in enumerate(score)])
            score = [(s if s >= switched else switched) + e for s, e in zip(score, row)]
        out = np.empty(n, dtype=np.int64)
        out[-1] = at = score.index(max(score))
        for t in range(n - 2, -1, -1):
            out[t] = at = came[t * k + at]
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Language, score and (lang, start, end) word spans of a text."""
        words = words_of(text) if text else []
        if not words:
            return "und", 0.0, []
        if len(self.langs) == 1:
            known = any(script_of(w) in self.scripts for w in dict.fromkeys(words))
            return (self.langs[0], 1.0, [(self.langs[0], 0, len(words))]) if known else (self.langs[0], 0.0, [])
        emitted = self.emissions(words)
        if not emitted.any():
            return self.langs[self.common], 0.0, []
        path = self.path(emitted)
        cuts = np.flatnonzero(np.diff(path)) + 1
        bounds = [0, *cuts.tolist(), len(words)]
        spans = [(self.langs[path[a]], a, b) for a, b in zip(bounds, bounds[1:])]
        if len(spans) == 1:
            return spans[0][0], self._certainty(emitted, int(path[0])), spans
        letters = np.bincount(path, weights=[len(w) for w in words], minlength=len(self.langs))
        top = int(letters.argmax())
        return self.langs[top], float(letters[top] / letters.sum()), spans

    @staticmethod
    def _certainty(emitted: np.ndarray, best: int) -> float:
        total = emitted.sum(axis=0)
        return float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


_COUNTED = "lang string, kind string, key string, n long"


def _count_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams and scripts of (lang, text) rows, summed over each batch."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words: Counter = Counter()
            for text in texts:
                words.update(words_of(text))
            found = _counts(words)
            yield pd.DataFrame([(lang, kind, key, n) for (kind, key), n in found.items()], columns=["lang", "kind", "key", "n"], dtype="object").astype({"n": "int64"})


def fit(docs: DataFrame, trained_on: Column, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> WordModel | None:
    """Model from at most ``max_rows`` texts of each language, of the rows of ``docs`` that ``trained_on`` picks."""
    labelled = docs.filter(trained_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    bucket = F.pmod(F.xxhash64(F.lit(1), "hash"), F.lit(max_rows)).alias("bucket")
    chosen = materialize(labelled.groupBy("lang", bucket).agg(F.min("hash").alias("hash"), F.count("*").alias("n")), "langid-rows")
    # at most max_rows texts of a language, each once
    keys = F.broadcast(chosen.select("lang", "hash"))
    texts = labelled.join(keys, ["lang", "hash"]).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")
    counts = texts.mapInPandas(_count_texts, _COUNTED).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    rows = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return WordModel.of_counts([tuple(r) for r in counts.collect()], rows)


LABELS = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


#: The model a worker process holds, with the words it has scored: kept from task to task.
_held: dict[str, WordModel] = {}


def _hold(model: WordModel) -> WordModel:
    if model.key not in _held:
        _held.clear()
        _held[model.key] = model
    return _held[model.key]


def labeller(spark: SparkSession, model: WordModel | None):
    """Pandas UDF: text -> struct of lang_pred, score and word spans."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(LABELS)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = _hold(shared.value) if shared.value else None
        for texts in batches:
            found = [held.label(t) if held else ("und", 0.0, []) for t in texts]
            yield pd.DataFrame(
                {
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "spans": [[{"lang": x, "start": a, "end": b} for x, a, b in f[2]] for f in found],
                }
            )
            del texts, found
        give_back()

    return label


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32(id) mod 4 is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the struct ``language``: lang_pred, score, spans."""
    model = fit(docs, ~held_out(id_col), text_col, lang_col)
    return docs.withColumn("language", labeller(docs.sparkSession, model)(F.col(text_col)))


def keep_identified(docs: DataFrame, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without texts that have no letters and mixed texts no language of which labels ``min_share`` of the letters.

    A text of one language stays however short it is and however close another language comes.
    """
    model = fit(docs, ~held_out(id_col), text_col, lang_col)
    found = docs.withColumn("__language", labeller(docs.sparkSession, model)(F.col(text_col)))
    return found.filter(is_identified(F.col("__language"), min_share)).drop("__language")


def is_identified(language: Column, min_share: float = 0.5) -> Column:
    """Whether a struct of ``labeller`` names a language for its text."""
    one = F.size(language["spans"]) <= 1
    return (language["lang_pred"] != "und") & (one | (language["score"] >= min_share))
