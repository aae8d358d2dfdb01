"""Personal information inside free text: found, typed, and replaced by placeholders.

Regular expressions propose spans of every kind with a first score; checks confirm them (number
plan and area rules, Luhn for card numbers, mod 97 for bank accounts, the domain's form for
addresses), and a span that a check refutes is dropped; words near a span raise or lower its
score (``CONTEXT``), and it is kept at a score of ``THRESHOLD`` or more. Names are proposed
around tokens with the form of a family name, learned with the given names from a staff list,
and confirmed by a given name or initial beside them. Where spans overlap, the one of higher
score stays: digits confirmed as a card or account number are no telephone number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrock.session import persisted

THRESHOLD = 0.5
#: Partners that the stem and the ending of a given name must each have to be taken with any other.
PARTNERS = 5
#: Characters before a span that count as near it.
NEAR = 28

#: A blank, or a line end with the quote marks of the next line.
GAP = r"(?:[ \t]{1,3}|[ \t]*\r?\n[>|: \t]*)"
_SEP = rf"(?:[-./]|{GAP})"


class Found(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


#: Words before a span that raise, and that lower, the score of its kind.
CONTEXT: dict[str, tuple[str, str]] = {
    "email": (r"(?i)\b(?:e-?mail|mail|write|contact|reach|at|address)\b", r"(?i)\b(?:message-id|content-id)\b"),
    "phone": (r"(?i)\b(?:tel|phone|call|cell|fax|mobile|home|reach|contact|number|at|dial|handy|office)\b", r"(?i)(?:\b(?:ticket|item|deal|order|invoice|account|case|ref|report|query|test|no)\b\.?\s*#?\s*\Z)"),
    "id_number": (r"(?i)(?:\bssn\b|social\s+security|\bsoc\.?\s*sec|\btax\s?id\b|\bss\s?(?:no|number|#)|\bnino?\b)", r"(?i)(?:\b(?:ticket|item|deal|order|invoice|account|case|ref|report|query|test|no)\b\.?\s*#?\s*\Z)"),
    "street_address": (r"(?i)\b(?:at|address|office|live|lives|visit|located|delivered?|send)\b", r"(?i)\b(?:version|chapter|section|page)\s*\Z"),
    "person": (r"(?i)\b(?:mr|mrs|ms|dr|herr|frau|by|from|with|ask|tell|dear|hi)\b\.?", r"(?i)\b(?:street|avenue|project)\s*\Z"),
    "card_number": (r"(?i)\b(?:card|visa|amex|credit|payment)\b", r"(?i)\b(?:ticket|tracking|serial)\b"),
    "bank_account": (r"(?i)\b(?:iban|account|konto|bank)\b", r"(?i)\b(?:ticket|tracking|serial)\b"),
}
RAISED, LOWERED = 0.1, 0.3


@lru_cache(maxsize=16)
def _context(kind: str) -> tuple[re.Pattern, re.Pattern]:
    return tuple(re.compile(p) for p in CONTEXT[kind])


def in_context(text: str, f: Found) -> Found:
    """The span with the score that the words before it give."""
    raise_, lower = _context(f.kind)
    before = text[max(0, f.start - NEAR) : f.start]
    score = f.score - LOWERED if lower.search(before) else f.score + RAISED if raise_.search(before) else f.score
    return f._replace(score=score)


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


# --- electronic mail

_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9_%+'.-]*[A-Za-z0-9_%+-]\Z")
_SPELLED = re.compile(
    rf"(?<![\w.+-])([A-Za-z0-9_+-]+(?:(?:\.|{GAP}(?:dot|\(dot\)|\[dot\]){GAP})[A-Za-z0-9_+-]+)*){GAP}?(?:\bat\b|\(at\)|\[at\]|<at>|@){GAP}?"
    rf"([A-Za-z0-9-]+(?:(?:{GAP}?(?:\bdot\b|\(dot\)|\[dot\]|<dot>){GAP}?|\.)[A-Za-z0-9-]+)+)",
    re.I,
)
_SPELLED_SIGNS = ("dot", "DOT", "Dot", "(at)", "[at]", "(AT)", "[AT]", "<at>")
_SPELLED_SIGN = re.compile(r"(?i)\bdot\b|[(\[<]at[)\]>]")


def emails(text: str) -> Iterator[Found]:
    at = text.find("@")
    while at >= 0:
        window = text[max(0, at - 72) : at]
        m = _LOCAL_END.search(window)
        d = _DOMAIN.match(text, at + 1)
        if m is None and d is None or (m and not d) or (d and not m):
            # blanks around the sign
            left = re.search(rf"([A-Za-z0-9_%+'.-]*[A-Za-z0-9_%+-]){GAP}?\Z", window)
            right = re.compile(rf"{GAP}?").match(text, at + 1)
            d = _DOMAIN.match(text, right.end())
            m = left if d and left and re.search("[a-z]", d[0], re.I) and re.search(r"[A-Za-z]{2,}\Z", d[0]) else None
        if m and d:
            start = max(0, at - 72) + m.start()
            start += len(m[0]) - len(m[0].lstrip("'.-"))
            yield Found(start, d.end(), "email", 0.95)
        at = text.find("@", at + 1)
    if not any(x in text for x in _SPELLED_SIGNS):
        return
    for w in _SPELLED_SIGN.finditer(text):
        lo = max(0, w.start() - 96)
        for m in _SPELLED.finditer(text, lo, min(len(text), w.end() + 64)):
            if m.end(1) <= w.start() < m.end(2):
                yield Found(m.start(1), m.end(2), "email", 0.9)
                break


# --- telephone and identity numbers

_PHONE = re.compile(
    rf"(?<![\w+#$€£/.,-])(?<!\d )(?:"
    rf"(?P<nanp>(?:(?:\+1|001|1){_SEP}?)?(?:\(\d{{3}}\){GAP}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}})"
    rf"|(?P<nanp1>(?:\+|00)1{_SEP}\(?\d{{3}}\)?{_SEP}\d{{3}}{_SEP}\d{{4}})"
    rf"|(?P<intl>(?:\+|00)[2-9]\d{{0,2}}{_SEP}?(?:\(0\){GAP}?)?\d{{1,5}}(?:{_SEP}\d{{2,8}}){{1,4}})"
    rf"|(?P<trunk>\(?0\d{{1,4}}\)?{_SEP}\d{{3,8}}(?:{_SEP}\d{{2,5}}){{0,2}})"
    rf"|(?P<bare>[2-9]\d{{2}}[2-9]\d{{6}})"
    rf")(?![\w]|[-./,]\d)"
)
_ID_WORDS = re.compile(r"(?i)(?:\bssn\b|social\s+security|\bsoc\.?\s*sec|\btax\s?id\b|\bss\s?(?:no|number|#))")
_SSN = re.compile(rf"(?<![\w#$€£.,/+-])(\d{{3}})(-|{GAP})(\d{{2}})(-|{GAP})(\d{{4}})(?![\w]|[-./,]\d)")
_NINE = re.compile(r"(?<![\w#$€£.,/+-])\d{9}(?![\w]|[-./,]\d)")
_NINO = re.compile(rf"\d\d{GAP}?\d\d{GAP}?\d\d{GAP}?[A-Da-d](?![\w])")
_NINO_PREFIX = re.compile(rf"(?<![\w-])[A-Za-z]{{2}}{GAP}?\Z")
_DIGIT = re.compile(r"\d")


def phones(text: str) -> Iterator[Found]:
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if not 9 <= len(digits) <= 15:
            continue
        score = 0.6
        if m["nanp"] or m["nanp1"]:
            national = digits[-10:]
            if len(digits) not in (10, 11, 13) or national[0] in "01" or national[3] in "01":
                continue
        elif m["trunk"] and len(digits) < 10:
            score = 0.45
        elif m["bare"]:
            score = 0.5
        yield Found(m.start(), m.end(), "phone", score)


def identity_numbers(text: str) -> Iterator[Found]:
    for m in _SSN.finditer(text):
        area, group, serial = m[1], m[3], m[5]
        if (m[2] == "-") != (m[4] == "-") or area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            continue
        yield Found(m.start(), m.end(), "id_number", 0.75)
    for m in _NINE.finditer(text):
        before = text[max(0, m.start() - NEAR) : m.start()]
        if _ID_WORDS.search(before):
            yield Found(m.start(), m.end(), "id_number", 0.85)
    for m in _NINO.finditer(text):
        p = _NINO_PREFIX.search(text, max(0, m.start() - 12), m.start())
        if p:
            yield Found(p.start(), m.end(), "id_number", 0.85)


# --- street addresses

_TYPES = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Place|Pl|Terrace|Square|Sq|Crescent|Close|Parkway|Pkwy|Highway|Hwy|Circle|Cir"
_STREET = re.compile(
    rf"(?<![\w$€£#.,/-])\d{{1,5}}[A-Za-z]?{GAP}(?:(?:[NSEW]|[NS][EW]|North|South|East|West)\.?{GAP})?(?:[A-ZÀ-Þ][\w'’]+{GAP}){{1,3}}(?:{_TYPES})\b"
)
_BOX = re.compile(rf"(?<![\w])P\.?{GAP}?O\.?{GAP}?Box{GAP}\d+")
#: Streets whose type comes first or is part of the name, and what a text must hold to have one.
_OTHER_STREETS = [
    (("str.", "straße", "strasse", "weg", "platz", "allee", "gasse", "ufer", "damm"),
     re.compile(rf"(?<![\w-])[A-ZÄÖÜ][\wäöüß]*(?:str(?:\.|aße|asse)|weg|platz|allee|gasse|ufer|damm){GAP}\d{{1,4}}[a-z]?\b")),
    (("er Str", "er Weg", "er Platz", "er Allee", "er Gasse", "er Ring"),
     re.compile(rf"(?<![\w-])[A-ZÄÖÜ][\wäöüß]+er{GAP}(?:Str(?:\.|aße|asse)|Weg|Platz|Allee|Gasse|Ring){GAP}\d{{1,4}}[a-z]?\b")),
    (("rue ", "avenue ", "boulevard ", "place ", "impasse ", "chemin "),
     re.compile(rf"(?<![\w])\d{{1,4}}(?:{GAP}(?:bis|ter))?,?{GAP}(?:rue|avenue|boulevard|place|impasse|chemin){GAP}(?:(?:de|du|des|la|le|l['’]){GAP}?)*[A-ZÀ-Þ][\w'’-]+")),
    (("alle ", "venida ", "laza ", "aseo "),
     re.compile(rf"(?<![\w])(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo){GAP}(?:(?:de|del|la|los|las){GAP})*[A-ZÀ-Þ][\w'’-]+,?{GAP}\d{{1,4}}\b")),
]


def street_addresses(text: str) -> Iterator[Found]:
    for m in _STREET.finditer(text):
        yield Found(m.start(), m.end(), "street_address", 0.9)
    if "Box" in text:
        for m in _BOX.finditer(text):
            yield Found(m.start(), m.end(), "street_address", 0.9)
    for needed, pattern in _OTHER_STREETS:
        if any(x in text for x in needed):
            for m in pattern.finditer(text):
                yield Found(m.start(), m.end(), "street_address", 0.9)


# --- names


_LETTERS = r"[^\W\d_]+"
_NAME_WORD = re.compile(rf"{_LETTERS}(?:-{_LETTERS})*")
_TOKEN = re.compile(rf"(?<![^\W_])({_LETTERS})(?:-{_LETTERS})?(?![^\W_])")


def name_words(name: str) -> tuple[list[str], list[str]]:
    """The given name of a full name, and the parts of its family name; none of a single word."""
    parts = _NAME_WORD.findall(name.lower())
    return (parts[:1], parts[-1].split("-")) if len(parts) >= 2 else ([], [])


def least_sharing(families: int) -> float:
    """How many of the family names must share an ending: a fiftieth."""
    return max(3, families / 50)


class GivenNames:
    """The listed given names, and every pair of a stem and an ending."""

    def __init__(self, listed: frozenset[str], stems: frozenset[str], tails: frozenset[str]):
        self.listed, self.stems, self.tails = listed, stems, tails

    def __contains__(self, word: str) -> bool:
        return word in self.listed or any(word[:k] in self.stems and word[k:] in self.tails for k in range(2, len(word) - 1))


class NameForms:
    """Given names, and endings of family names, learned from a list of full names.

    ``learned_forms`` counts the same over a table of any length.
    """

    def __init__(self, names: list[str]):
        given: set[str] = set()
        family: set[str] = set()
        for n in names:
            g, f = name_words(n)
            given.update(g)
            family.update(f)
        # endings of three to six letters
        ends = Counter(f[-k:] for f in family for k in range(3, min(7, len(f) - 1)))
        common = {e for e, n in ends.items() if n >= least_sharing(len(family))}
        # given names are made of a stem and an ending: any pair of those that each occur with several partners
        pairs = [(g[:k], g[k:]) for g in given for k in range(2, len(g) - 1)]
        stems = Counter(s for s, _ in pairs)
        tails = Counter(t for s, t in pairs if stems[s] >= PARTNERS)
        good_tails = frozenset(t for t, n in tails.items() if n >= PARTNERS)
        own = Counter(s for s, t in pairs if t in good_tails)
        self._take(family, common, GivenNames(frozenset(given), frozenset(s for s, n in own.items() if n >= PARTNERS), good_tails))

    @classmethod
    def counted(cls, families: set[str], common: set[str], given: GivenNames) -> NameForms:
        """From what was counted elsewhere: the family names, the endings they share, the given names."""
        forms = cls.__new__(cls)
        forms._take(families, common, given)
        return forms

    def _take(self, families: set[str], common: set[str], given: GivenNames) -> None:
        self.families, self.given = frozenset(families), given
        # the longest ending stands for its tails
        self.endings = tuple(sorted(e for e in common if not any(e != x and e.endswith(x) for x in common)))
        # tokens worth a look end like any listed family name; whether they are one is_family tells
        self.last = frozenset(f[-3:] for f in families if not f.endswith(self.endings))
        self._chunks: dict[str, tuple[tuple[int, int], ...]] = {}

    def chunk(self, c: str) -> tuple[tuple[int, int], ...]:
        """Where family names stand in a piece between blanks; remembered, as pieces repeat."""
        own = self._chunks.get(c)
        if own is None:
            if len(self._chunks) > 300_000:
                self._chunks.clear()
            found, at = [], 0
            while m := _TOKEN.search(c, at):
                if not self.ends_like_family(m[1].lower()):
                    at = m.end(1)
                    continue
                at = m.end()
                if self.is_family(m[0]):
                    found.append(m.span())
            own = self._chunks[c] = tuple(found)
        return own

    def ends_like_family(self, word: str) -> bool:
        return word.endswith(self.endings) or word[-3:] in self.last or word[-2:] in self.last or word[-1:] in self.last

    def families_in(self, text: str) -> list[tuple[int, int]]:
        out = []
        for c in set(text.split()):
            own = self.chunk(c)
            if own:
                at = text.find(c)
                while at >= 0:
                    end = at + len(c)
                    if (at == 0 or text[at - 1].isspace()) and (end == len(text) or text[end].isspace()):
                        out.extend((at + a, at + e) for a, e in own)
                    at = text.find(c, at + 1)
        out.sort()
        return out

    def is_family(self, word: str) -> bool:
        parts = word.lower().split("-")
        return all(p in self.families or (len(p) >= 6 and p.endswith(self.endings)) for p in parts)


_BEFORE_GIVEN = re.compile(rf"(?<![^\W_])([^\W\d_]{{2,}})(?:{GAP}[^\W\d_]\.?)?{GAP}\Z")
_BEFORE_INITIAL = re.compile(rf"(?<![^\W_'’])[^\W\d_]\.{GAP}?(?:[^\W\d_]\.{GAP}?)?\Z")
_AFTER = re.compile(rf"(?:,{GAP}?|{GAP})([^\W\d_]{{2,}})(?![\w@]|[._+-]\w)")
_AFTER_INITIAL = re.compile(rf",{GAP}?[^\W\d_]\.(?![^\W_])")
_NEXT = re.compile(rf"{GAP}?([^\W\d_]+(?:-[^\W\d_]+)?)")


def persons(text: str, forms: NameForms) -> Iterator[Found]:
    done = 0
    for start, end in forms.families_in(text):
        if start < done:
            continue
        lo = max(done, start - 40)
        before = text[lo:start]
        g = _BEFORE_GIVEN.search(before)
        if g and g[1].lower() in forms.given:
            done = end
            yield Found(lo + g.start(1), end, "person", 0.9)
            continue
        i = _BEFORE_INITIAL.search(before)
        if i and not before[: i.start()].endswith((".", "-", "_", "+", "@")):
            done = end
            yield Found(lo + i.start(), end, "person", 0.75)
            continue
        a = _AFTER.match(text, end)
        if a and a[1].lower() in forms.given:
            # without a comma the given name may belong to a family name behind it
            n = None if text[end] == "," else _NEXT.match(text, a.end())
            if n is None or not forms.is_family(n[1]):
                done = a.end()
                yield Found(start, a.end(), "person", 0.85)
                continue
        b = _AFTER_INITIAL.match(text, end)
        if b:
            done = b.end()
            yield Found(start, b.end(), "person", 0.6)


# --- card and account numbers

_CARD = re.compile(r"(?<![\w+(.-])[2-6]\d(?:[ -]?\d){11,17}(?![\w-])")
_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")


def accounts(text: str) -> Iterator[Found]:
    for m in _CARD.finditer(text):
        if luhn(re.sub(r"\D", "", m[0])):
            yield Found(m.start(), m.end(), "card_number", 0.9)
    for m in _IBAN.finditer(text):
        if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x):
            yield Found(m.start(), m.end(), "bank_account", 0.9)


def find(text: str, forms: NameForms) -> list[Found]:
    """All spans of a text, without overlaps, by position."""
    found: list[Found] = [*emails(text)]
    if _DIGIT.search(text):
        found += identity_numbers(text)
        found += phones(text)
        found += street_addresses(text)
        found += accounts(text)
    found += persons(text, forms)
    found = sorted(f for f in (in_context(text, f) for f in found) if f.score >= THRESHOLD)
    if all(a.end <= b.start for a, b in zip(found, found[1:])):
        return found
    kept: list[Found] = []
    for f in sorted(found, key=lambda f: (-f.score, f.start, -f.end)):
        if all(f.end <= k.start or k.end <= f.start for k in kept):
            kept.append(f)
    return sorted(kept)


def replaced(text: str, found: list[Found]) -> str:
    out, at = [], 0
    for f in found:
        out += [text[at : f.start], f"[{f.kind.upper()}]"]
        at = f.end
    return "".join(out) + text[at:]


def learned_forms(people: DataFrame, name_col: str = "display_name") -> NameForms:
    """``NameForms`` of all names of a table: its words, endings, stems and their partners are counted
    by Spark, and what comes to the driver are different words, not names."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [name_words(n) for n in b.column(0).to_pylist()]
            given = {w for g, _ in words for w in g}
            family = {w for _, f in words for w in f}
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(given) + [False] * len(family), pa.bool_()), pa.array([*given, *family], pa.string())], names=["given", "word"])

    def of(kind: str, words: DataFrame) -> DataFrame:
        return words.select(F.lit(kind).alias("kind"), F.col(words.columns[0]).alias("word"))

    def partnered(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PARTNERS).select(key)

    names = people.select(name_col).where(F.col(name_col).isNotNull())
    words = persisted(names.mapInArrow(split, "given boolean, word string").distinct(), "namewords")
    given, family = words.where("given").select("word"), words.where("not given").select("word")
    length = F.length("word")
    cut = given.where(length >= 4).select("word", F.explode(F.sequence(F.lit(2), length - 2)).alias("k"))
    pairs = cut.select(F.expr("left(word, k)").alias("stem"), F.expr("substring(word, k + 1)").alias("tail"))
    tails = partnered(pairs.join(partnered(pairs, "stem"), "stem", "left_semi"), "tail")
    stems = partnered(pairs.join(tails, "tail", "left_semi"), "stem")
    ends = family.where(length >= 5).select("word", F.explode(F.sequence(F.lit(3), F.least(F.lit(6), length - 2))).alias("k"))
    ends = ends.groupBy(F.expr("right(word, k)").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    common = ends.where(F.col("n") >= least_sharing(family.count())).select("end")
    got = of("given", given).unionByName(of("family", family)).unionByName(of("stem", stems)).unionByName(of("tail", tails)).unionByName(of("end", common)).toArrow()
    kinds, found = got["kind"], got["word"]

    def all_of(kind: str) -> frozenset[str]:
        return frozenset(found.filter(pc.equal(kinds, kind)).to_pylist())

    return NameForms.counted(all_of("family"), all_of("end"), GivenNames(all_of("given"), all_of("stem"), all_of("tail")))


def personal_spans(rows: DataFrame, people: DataFrame, id_col: str = "row_id", text_col: str = "body", name_col: str = "display_name") -> DataFrame:
    """``(id_col, kind, char_start, char_end)``, 0-based code points, one row per piece.

    Defined results: null and empty texts have none; a repeated row comes out as often as it
    stands; other columns are not read. Kinds are ``email``, ``phone``, ``id_number``,
    ``street_address``, ``person``, ``card_number`` and ``bank_account``. ``people`` is a staff
    list; the name forms are learned from all of its names. A family name that is not among
    these and has no ending that several of them share is not found.
    """
    learned = rows.sparkSession.sparkContext.broadcast(learned_forms(people, name_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = learned.value
        for b in batches:
            at: list[int] = []
            found: list[Found] = []
            known: dict[str, list[Found]] = {}
            for k, t in enumerate(b.column(1).to_pylist()):
                if t:
                    own = known.get(t)
                    if own is None:
                        own = known[t] = find(t, forms)
                    found += own
                    at += [k] * len(own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.array(at, np.int64))), pa.array([f.kind for f in found], pa.string()),
                 pa.array([f.start for f in found], pa.int64()), pa.array([f.end for f in found], pa.int64())],
                names=[id_col, "kind", "char_start", "char_end"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, kind string, char_start bigint, char_end bigint")


def redacted(rows: DataFrame, people: DataFrame, id_col: str = "row_id", text_col: str = "body", name_col: str = "display_name") -> DataFrame:
    """``(id_col, redacted)``: the text with ``[KIND]`` placeholders, card and bank account numbers
    included; null stays null."""
    learned = rows.sparkSession.sparkContext.broadcast(learned_forms(people, name_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = learned.value
        for b in batches:
            out = [t and replaced(t, find(t, forms)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "redacted"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, redacted string")
