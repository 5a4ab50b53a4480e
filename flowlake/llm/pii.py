"""PII surrogates: every detected entity is replaced by a keyed, type-consistent stand-in.

Entities: e-mail addresses, phone numbers, IP addresses, payment card numbers (valid check digit and
issuer), US social security numbers, IBANs, secrets (values of token / key / password settings and
well-known key prefixes) and personal names. A stand-in has the entity's type and format: letters
stay letters of the same script and case, digits stay digits, separators stay; card numbers and IBANs
get right check digits; names keep title, script, gender, case and number of words.

Names are found by a title, or by a known given name before a capitalised word. A name falls into
given names and a surname, and each part has a stand-in of its own. So "Mr. John Smith", "Dr. JOHN
SMITH", "John Smith" and "Mr. Smith" stay one person, in every document. Within a document a title,
wherever it stands, gives a given name its gender, and the surname or given name of a person who was
named is found alone too, but not before a number or a word like Street. Over the corpus a given name
has one gender: that of its titles and of the list, or neither where these differ.

One entity has one stand-in in the whole corpus (coreference), and two have different ones
(distinctness). A stand-in depends on the secret key, the entity and an attempt number only. All
first attempts are checked over the corpus: of entities that share a stand-in the least keeps it,
and no entity keeps a stand-in that is itself an entity of the corpus; the others get the next
attempt until nothing collides. From attempt ``WIDER`` on stand-ins grow longer, so that every type
has room however short the format and however many entities there are. Texts are read once; only
attempts other than the first (few) are sent back, keyed by the text they occur in.

Defined results for odd input
* Null text stays null with no entities; empty text stays empty.
* Overlapping finds: the type listed first in ``DETECTORS`` wins. Ties of a collision go to the
  entity that sorts first.
* Equal texts get equal results, so repeated rows and null ids need no special case.
* An empty table gives an empty result. Columns of ``docs`` are kept; ``text_col`` is replaced, and
  a column named like one of the added ones (also in mid-work: ``__k1``, ``__k2``, ``__found``) is
  replaced or dropped.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import broadcast_if_small, materialize, release, text_batches

#: Attempts of an entity's own length; later ones grow by a sign every other attempt.
WIDER = 6

# Titles by gender, common given names, and given names and syllables for stand-ins by script.
MALE_TITLES = ["Mr", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "M", "господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mlle", "госпожа"]
OTHER_TITLES = ["Dr", "Prof"]
KNOWN = {
    "m": "james john robert michael william david richard joseph thomas charles daniel matthew george edward brian kevin peter hans klaus jürgen wolfgang "
    "stefan andreas pierre jean philippe françois nicolas carlos josé juan luis miguel antonio иван пётр сергей алексей дмитрий андрей николай".split(),
    "f": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa emily margaret anna maria sabine monika ursula claudia "
    "marie sophie isabelle catherine nathalie carmen lucía josefa isabel анна мария елена ольга наталья татьяна ирина".split(),
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Leo Martin Noel Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("latin", "x"): "Alex Andrea Charlie Dana Eden Jamie Jordan Kim Lee Morgan Quinn Robin Sam Sasha Taylor Toni".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Григорий Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Софья Юлия".split(),
    ("cyrillic", "x"): "Саша Женя Валя Слава Шура Паша Сима Вася".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то".split(),
}
#: Last letters of made-up given names.
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "x"): "y", ("cyrillic", "m"): "н", ("cyrillic", "f"): "я", ("cyrillic", "x"): "й"}
PARTICLES = "von van de der den da di del la le du zu bin al".split()
#: Card prefixes of the issuers with the numbers' lengths; the stand-in keeps the prefix.
ISSUERS = re.compile(
    r"(?:(4)(?:\d{12}|\d{15}|\d{18})|(5[1-5])\d{14}|(222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|(3[47])\d{13}|(6011|65|64[4-9])\d{12,14}"
    r"|(30[0-5])\d{11,16}|(3[689])\d{12,17}|(352[89]|35[3-8]\d)\d{12,15}|(62)\d{14,17}|(5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15})\Z"
)

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_WORD = rf"[{_UPPER}][{_UPPER}{_LOWER}'’-]+"
_GAP = r"[ \u00a0]+"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}){_GAP}){{0,2}}"
_GENDERS = {t.casefold(): g for g, ts in (("m", MALE_TITLES), ("f", FEMALE_TITLES), ("x", OTHER_TITLES)) for t in ts}
_GIVEN_GENDER = {n: g for g, names in KNOWN.items() for n in names} | {n.casefold(): g for (_, g), names in GIVEN.items() if g != "x" for n in names}
#: A title of one letter is read as such in its own case only, others in any.
_TITLES = "|".join(sorted((re.escape(t) if len(t) == 1 else f"(?i:{re.escape(t)})" for t in [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]), key=len, reverse=True))
_TITLED = re.compile(rf"(?<!\w)((?:{_TITLES})\.?{_GAP})((?:{_WORD}{_GAP}){{0,2}}?{_PARTICLE}{_WORD}(?:{_GAP}{_PARTICLE}{_WORD}){{0,2}})(?!\w)")
_LOWER_GIVEN = "|".join(sorted(_GIVEN_GENDER, key=len, reverse=True))
_TITLED_LOWER = re.compile(rf"(?<!\w)((?:{_TITLES})\.?{_GAP})((?:{_LOWER_GIVEN}){_GAP}[{_LOWER}'’-]{{2,}})(?!\w)")
_CAPITALISED = rf"[{_UPPER}][{_LOWER}'’-]+"
_PAIR = re.compile(rf"(?<!\w)({_CAPITALISED}(?:{_GAP}{_CAPITALISED})?{_GAP}{_PARTICLE}{_CAPITALISED})(?!\w)")
_NAME_WORD = re.compile(rf"(?<!\w){_WORD}(?!\w)")
#: After a word that stands alone, what says that it is a month or a place and not a person.
_NO_PERSON = re.compile(r"[ \u00a0]+(?:\d|(?:Street|St|Road|Rd|Avenue|Ave|Lane|Square|Drive|Court|Place|Bridge|Park|Hill|Station|Airport|University)\b)")
#: Plain strings, one of which any text with a title, a setting or a key of the kind has: looked for first, as that is much faster.
_TITLE_SIGNS = [f"{t}{end}" for t in _GENDERS if len(t) > 1 for end in ". "]
_LETTER_SIGNS = [f"{t}{end}" for t in [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES] if len(t) == 1 for end in ". "]
_SETTING_SIGNS = ["token", "secret", "passw", "pwd", "key", "auth"]
_KEY_SIGNS = ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox"]

#: Types with their patterns; an earlier type wins where finds overlap, and names come last. The entity is group 1.
DETECTORS = [
    ("secret", re.compile(r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b\"?\s*[=:]\s*[\"']?)([A-Za-z0-9_+/=.\-]{8,})")),
    ("secret", re.compile(r"\b((?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}))\b")),
    ("email", re.compile(r"(?<![\w.+-])(\w[\w.+-]*@\w(?:[\w-]*\w)?(?:\.\w(?:[\w-]*\w)?)+)")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("card", re.compile(r"(\d(?<![\d.,]\d)[ -]?(?:\d[ -]?){11,17}\d)(?![\d])")),
    ("ip", re.compile(r"(\d(?<![\dvV.]\d)\d{0,2}(?:\.\d{1,3}){3})(?![\d]|\.\d)")),
    ("ip", re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:])")),
    ("ssn", re.compile(r"(\d(?<![\d-]\d)\d\d-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(
        r"(?<![\w.+(])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
        r"|\(0\d{1,4}\) ?\d{2,4}(?:[ -]?\d{2,4}){1,3}|0\d{2,4}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3})(?![\d])")),
]
_DIGIT = re.compile(r"[0-9]")
#: Separators that mentions of one number may differ in.
_FORMAT = " .()/-"


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10


def _is_card(digits: str) -> bool:
    return ISSUERS.match(digits) is not None and _luhn(digits) == 0


def _is_iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _is_ipv6(value: str) -> bool:
    """An address of three groups or one long group at least: ``a::b`` is more often something else."""
    groups = [g for g in value.split(":") if g]
    try:
        return ipaddress.IPv6Address(value) is not None and (len(groups) > 2 or max(map(len, groups), default=0) > 2)
    except ValueError:
        return False


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        return _is_card(re.sub(r"\D", "", value))
    if kind == "iban":
        return _is_iban(value)
    if kind == "ip":
        return _is_ipv6(value) if ":" in value else all(int(x) < 256 and (len(x) < 2 or x[0] != "0") for x in value.split("."))
    if kind == "phone":
        return (7 if value[0] in "+(" else 9) <= sum(c.isdigit() for c in value) <= 15
    return True


def _name_words(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the words of a name are, but for particles."""
    return [(start + m.start(), start + m.end()) for m in re.finditer(r"[^ \u00a0]+", text[start:end]) if m.group() not in PARTICLES]


def _names(text: str, lowered: str, free) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """(start, end, parts) of the names of a text; parts are ("given" or "surname", start, end), with the gender in the type."""
    found: list[tuple[int, int, list[tuple[int, int]], bool]] = []
    gender: dict[str, str] = {}
    taken: list[tuple[int, int]] = []
    open_ = lambda a, b: free(a, b) and all(b <= x or a >= y for x, y in taken)
    spaced, lowered = text.replace("\u00a0", " "), lowered.replace("\u00a0", " ")
    if any(sign in lowered for sign in _TITLE_SIGNS) or any(sign in spaced for sign in _LETTER_SIGNS):
        for pattern in (_TITLED, _TITLED_LOWER):
            for m in pattern.finditer(text):
                if not open_(*m.span()):
                    continue
                words = _name_words(text, *m.span(2))
                words = words[: next((i for i, (a, b) in enumerate(words) if text[a:b].rstrip(".").casefold() in _GENDERS), len(words))]
                if not words:
                    continue
                g = _GENDERS[m.group(1).strip(" \u00a0").rstrip(".").casefold()]
                alone_given = len(words) == 1 and text[slice(*words[0])].casefold() in _GIVEN_GENDER
                for a, b in words if alone_given else words[:-1]:
                    if g != "x":
                        gender.setdefault(text[a:b].casefold(), g)
                found.append((m.start(), words[-1][1], words, alone_given))
                taken.append((m.start(), words[-1][1]))
    for m in _PAIR.finditer(text):
        words = _name_words(text, *m.span(1))
        known = [i for i, (a, b) in enumerate(words[:-1]) if text[a:b].casefold() in _GIVEN_GENDER]
        if known and open_(words[known[0]][0], m.end()):
            words = words[known[0] :]
            found.append((words[0][0], m.end(), words, False))
            taken.append((words[0][0], m.end()))
    if not found:
        return []
    kinds: dict[str, str] = {}  # words of the persons of the document
    for _, _, words, alone_given in found:
        for i, (a, b) in enumerate(words):
            given = alone_given or i < len(words) - 1
            kinds[text[a:b].casefold()] = "given" if given and kinds.get(text[a:b].casefold()) != "surname" else "surname"
    for m in _NAME_WORD.finditer(text):
        if m.group().casefold() in kinds and open_(*m.span()) and not _NO_PERSON.match(text, m.end()):
            found.append((*m.span(), [m.span()], kinds[m.group().casefold()] == "given"))

    def part(a: int, b: int, given: bool) -> tuple[str, int, int]:
        word = text[a:b].casefold()
        return (f"given_{gender.get(word) or _GIVEN_GENDER.get(word, 'x')}" if given else "surname", a, b)

    return [(s, e, [part(a, b, alone or i < len(words) - 1) for i, (a, b) in enumerate(words)]) for s, e, words, alone in found]


def find(text: str | None) -> list[tuple[int, int, str, list[tuple[str, int, int]]]]:
    """(start, end, type, parts) of the entities of a text, in order, without overlaps. A part is (type, start, end); other than names are one part."""
    if not text:
        return []
    digit, found = _DIGIT.search(text) is not None, []
    lowered = text.lower()
    ruled_out = [
        not any(sign in lowered for sign in _SETTING_SIGNS), not any(sign in text for sign in _KEY_SIGNS), "@" not in text,
        not digit, not digit, not digit, text.count(":") < 2, not digit, not digit,
    ]
    free = lambda a, b: all(b <= x or a >= y for x, y, _, _ in found)
    for (kind, pattern), out in zip(DETECTORS, ruled_out, strict=True):
        if out:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if kind == "email" and m.group(1)[-1] == ".":
                b -= 1
            if free(a, b) and _valid(kind, text[a:b]):
                found.append((a, b, kind, [(kind, a, b)]))
    names = _names(text, lowered, free)
    return sorted(found + [(a, b, "name", parts) for a, b, parts in names])


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, without overlaps."""
    return [(a, b, kind) for a, b, kind, _ in find(text)]


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email" or kind == "surname" or kind.startswith("given"):
        return value.casefold()
    if kind in ("card", "iban", "phone"):
        return value.translate({ord(c): None for c in _FORMAT})
    if kind == "ip" and ":" in value:
        return str(ipaddress.ip_address(value))
    return value


@lru_cache(maxsize=4096)
def _alike(c: str) -> str:
    """Letters of the same script and case: those of its 32 code points."""
    base = ord(c) - ord(c) % 32
    near = map(chr, range(base, base + 32))
    return "".join(x for x in near if x.isalpha() and x.islower() == c.islower() and x.isupper() == c.isupper() and len(x.casefold()) == 1)


class Surrogates:
    """Stand-ins under a secret key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _stream(self, kind: str, canon: str, attempt: int):
        """Endless keyed numbers."""
        block = 0
        while True:
            data = f"{kind}\0{canon}\0{attempt}\0{block}".encode("utf-8", "surrogatepass")
            yield from hashlib.blake2b(data, key=self.key, digest_size=64).digest()
            block += 1

    def make(self, kind: str, canon: str, attempt: int = 0) -> str:
        """Stand-in of a canonical entity, in canonical form."""
        numbers = self._stream(kind, canon, attempt)
        longer = max(0, attempt - WIDER) // 2 + (attempt >= WIDER)
        if kind == "surname" or kind.startswith("given"):
            return self._name(kind, canon, attempt, numbers)
        if kind == "ip":
            if ":" not in canon and not longer:
                return ".".join(str(1 + next(numbers) % 254) for _ in range(4))
            # what IPv4 has no room for gets an IPv6 address of the range for private networks
            return str(ipaddress.IPv6Address(bytes([0xFD, *(next(numbers) for _ in range(15))])))
        head = 0
        if kind == "phone":
            head = 2 if canon[0] == "+" else int(canon[0] == "0")  # the country code's first digit stays, and a leading zero
        elif kind == "iban":
            head = 4
        elif kind == "card":
            head = len(next(filter(None, ISSUERS.match(canon).groups())))
        elif kind == "secret":
            m = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-", canon)
            head = m.end() if m else 0
        dot = canon.rfind(".") if kind == "email" else len(canon)  # the top-level domain stays
        is_hex = kind == "secret" and re.fullmatch(r"[0-9a-f]+", canon) is not None
        out = []
        for i, c in enumerate(canon):
            if i < head or i >= dot:
                out.append(c)
            elif is_hex:
                out.append("0123456789abcdef"[next(numbers) % 16])
            elif c.isascii() and c.isdigit():
                out.append(chr(48 + next(numbers) % 10))
            elif c.isalpha():
                # two numbers, as there may be more letters alike than would divide 256 evenly
                letters = _alike(c) or c
                out.append(letters[(next(numbers) * 256 + next(numbers)) % len(letters)])
            else:
                out.append(c)
        if longer and kind == "email":
            at = out.index("@")
            out[at:at] = [chr(97 + next(numbers) % 26) for _ in range(longer)]
        elif longer:
            out += [chr(48 + next(numbers) % 10) for _ in range(longer)]
        made = "".join(out)
        if kind == "card":
            check = (10 - _luhn(made[:-1] + "0")) % 10
            made = made[:-1] + str(check)
        elif kind == "iban":
            rest = int("".join(str(int(c, 36)) for c in made[4:] + made[:2] + "00")) % 97
            made = f"{made[:2]}{98 - rest:02d}{made[4:]}"
        return made

    @staticmethod
    def _name(kind: str, canon: str, attempt: int, numbers) -> str:
        """First attempts at given names are real ones; all others are syllables, more with every other attempt."""
        script = "cyrillic" if "\u0400" <= canon[0] <= "\u04ff" else "latin"
        gender = kind.removeprefix("given_")
        if gender != kind and attempt < 2:
            pool = GIVEN[(script, gender)]
            return pool[next(numbers) % len(pool)].casefold()
        syllables = SYLLABLES[script]
        size = (3 if gender == kind else 2) + attempt // 2
        made = "".join(syllables[next(numbers) % len(syllables)] for _ in range(size))
        return made if gender == kind else made + ENDINGS[(script, gender)]

    def render(self, kind: str, value: str, attempt: int = 0) -> str:
        """Stand-in of a mention, in the mention's own format."""
        made = self.make(kind, canonical(kind, value), attempt)
        if kind == "email":
            shown = [m.upper() if v.isupper() and len(m.upper()) == 1 else m for m, v in zip(made, value)]
            return "".join(shown) if len(made) == len(value) else made
        if kind in ("card", "iban", "phone"):
            signs = iter(made)
            return "".join(c if c in _FORMAT else next(signs) for c in value) + "".join(signs)
        if kind == "surname" or kind.startswith("given"):
            return made.upper() if value.isupper() else made if value.islower() else made.capitalize()
        return made

    def rewrite(self, text: str, parts: list[tuple[str, int, int]], attempts: dict | None = None, known: dict | None = None) -> str:
        """``text`` with the stand-ins of ``parts`` (type, start, end, in order). ``attempts``: (type, entity) -> attempt other than the first; ``known``: its type in the corpus, where that is another."""
        at, out = 0, []
        for kind, a, b in parts:
            value = text[a:b]
            entity = (kind, canonical(kind, value)) if attempts or known else None
            attempt = attempts.get(entity, 0) if attempts else 0
            out += [text[at:a], self.render(known.get(entity, kind) if known else kind, value, attempt)]
            at = b
        return "".join([*out, text[at:]])


_PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType())]))
_FOUND = T.StructType([T.StructField("types", T.ArrayType(T.StringType())), T.StructField("parts", _PARTS)])


@F.pandas_udf(_FOUND)
def _entities(texts: pd.Series) -> pd.DataFrame:
    kinds, parts = [], []
    for text in texts:
        found = find(text)
        kinds.append([kind for _, _, kind, _ in found])
        parts.append([{"type": k, "start": a, "end": b, "entity": canonical(k, text[a:b])} for *_, ps in found for k, a, b in ps])
    return pd.DataFrame({"types": kinds, "parts": parts})


def _maker(key: str):
    @F.pandas_udf(T.StringType())
    def make(types: pd.Series, entities: pd.Series, attempts: pd.Series) -> pd.Series:
        s = Surrogates(key)
        return pd.Series([s.make(k, e, int(a)) for k, e, a in zip(types, entities, attempts)], dtype="object")

    return make


def _rewriter(key: str):
    @F.pandas_udf(T.StringType())
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        s = Surrogates(key)
        for texts, found, later in batches:
            out = []
            for text, parts, again in zip(texts, found, later):
                again = [] if again is None else again
                attempts, known = ({(x["type"], x["entity"]): x[what] for x in again} for what in ("attempt", "known"))
                out.append(s.rewrite(text, [(p["type"], p["start"], p["end"]) for p in parts], attempts, known) if parts is not None and len(parts) else text)
            yield pd.Series(out, dtype="object")

    return rewrite


def _text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")


def family(kind: Column) -> Column:
    """What stand-ins have to differ within: types, but all given names are one family."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def known_types(entities: DataFrame) -> DataFrame:
    """Distinct (type, entity) -> type, entity, known: the type that the entity has in the whole corpus.

    A given name has the gender that titles and lists give it; where documents differ, that of neither.
    """
    given = F.col("type").startswith("given")
    genders = entities.filter(given & (F.col("type") != "given_x")).groupBy("entity").agg(
        F.min("type").alias("one"), F.max("type").alias("other"))
    genders = genders.select("entity", F.when(F.col("one") == F.col("other"), F.col("one")).otherwise("given_x").alias("gender"))
    named = entities.filter(given).join(genders, "entity", "left").select("type", "entity", F.coalesce("gender", "type").alias("known"))
    return entities.filter(~given).select("type", "entity", F.col("type").alias("known")).unionByName(named)


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (type, entity) -> type, entity, attempt, surrogate, all surrogates of a family different and none an entity.

    Each round settles what collides with nothing; the rest goes on with the next attempt. Rounds
    end, as stand-ins grow with the attempt and so outnumber whatever there is.
    """
    make = _maker(key)
    real = entities.select(family(F.col("type")).alias("family"), F.col("entity").alias("surrogate"))
    settled, open_ = None, entities.withColumn("attempt", F.lit(0))
    while True:
        tried = materialize(open_.withColumn("surrogate", make("type", "entity", "attempt")).withColumn("family", family(F.col("type"))), "pii-tried")
        release(open_)
        free = tried.join(real, ["family", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        won = free.groupBy("family", "surrogate").agg(F.min("entity").alias("entity"), F.min_by(F.struct("type", "attempt"), "entity").alias("x"))
        won = won.select("family", "x.type", "entity", "x.attempt", "surrogate")
        before, settled = settled, materialize(won if settled is None else settled.unionByName(won), "pii-settled")
        if before is not None:
            release(before)
        open_ = tried.join(settled.select("type", "entity"), ["type", "entity"], "left_anti")
        open_ = materialize(open_.select("type", "entity", (F.col("attempt") + 1).alias("attempt")), "pii-open")
        release(tried)
        if open_.isEmpty():
            return settled


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and the columns ``n_entities`` and ``entity_types``."""
    docs = docs.drop("__k1", "__k2", "__later", "__found", "n_entities", "entity_types")
    k1, k2 = _text_key(F.col(text_col))
    with text_batches(docs.sparkSession):
        read = materialize(docs.withColumns({"__k1": k1, "__k2": k2, "__found": _entities(F.col(text_col))}), "pii-read")
    seen = read.select("__k1", "__k2", F.explode("__found.parts").alias("x")).select("__k1", "__k2", "x.type", "x.entity").distinct()
    seen = materialize(seen, "pii-seen")
    known = materialize(known_types(seen.select("type", "entity").distinct()), "pii-known")
    resolved = resolve(materialize(known.select(F.col("known").alias("type"), "entity").distinct(), "pii-entities"), key)
    others = known.join(resolved.select(F.col("type").alias("known"), "entity", "attempt"), ["known", "entity"]).filter("attempt > 0 OR known != type")
    later = seen.join(others, ["type", "entity"]).groupBy("__k1", "__k2").agg(
        F.collect_set(F.struct("type", "entity", "known", "attempt")).alias("__later"))
    later = materialize(later, "pii-later")
    release(seen, known, resolved)
    out = read.join(broadcast_if_small(later, 100_000), ["__k1", "__k2"], "left")
    new = _rewriter(key)(F.col(text_col), F.col("__found.parts"), F.col("__later"))
    out = out.withColumns({text_col: new, "n_entities": F.size("__found.types").cast("long"), "entity_types": F.col("__found.types")})
    return out.drop("__k1", "__k2", "__later", "__found")
