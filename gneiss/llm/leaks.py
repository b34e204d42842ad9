"""Evaluation texts that leak into a corpus, by template windows.

Texts are brought into one form and cut into tokens: words, or single letters and digits for
languages written without spaces. Numbers, names and units become typed placeholders, so every
window of tokens is a template with slots. Windows are joined by the hash of their template;
a match must fill its slots consistently (equal slots stay equal, different ones different),
which also catches questions asked again with other parameters, and for a literal repeat the
slots must be equal as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.canonical import Transducer
from gneiss.operators.batches import by_bytes
from gneiss.session import cut_lineage

#: Consecutive words, or letters and digits, that make a repeat.
WORDS, LETTERS = 12, 24
#: Languages whose texts are compared by letters and digits.
LETTER_LANGS = ("ja", "zh")
#: Largest item table, in characters, that is held in each worker; a larger one is joined by shuffle. A character is at most
#: one window of about 45 bytes and one token, so this is at most 0.2 GB a worker.
HELD_CHARS = 4 << 20
#: What a row counts besides its text.
ROW_CHARS = 64
#: Most names of a larger item table that are held in each worker, at 8 bytes each; more are joined by shuffle.
NAMES_HELD = 2_000_000
#: Most tokens whose hashes a worker of the shuffle join remembers.
CACHED = 250_000
# Tokens that count as units.
UNITS = frozenset("mg g kg t mm cm m km l ml cl s min h kwh percent".split())
NUMBER, NAME, UNIT = 1, 2, 3

_WORD = re.compile(r"[^\W_]+").findall
_MID_NAME = re.compile(r"(?<=[^\W\d_,;] )[^\W\d_a-z]\w+")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--)>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_MARK = re.compile(r"\*+|`+|~~|\b_+|_+\b")


class Tokens:
    """Cuts text into the tokens that are compared."""

    def __init__(self):
        self.form = Transducer().one_form

    def plain(self, text: str) -> str:
        """One form without markup; the case stays."""
        if "<" in text:
            text = _TAG.sub(" ", _INLINE.sub("", text))
        if "](" in text:
            text = _LINK.sub("]", text)
        if "&" in text:
            text = html.unescape(text)
        if "*" in text or "`" in text or "_" in text or "~" in text:
            text = _MARK.sub("", text)
        return self.form(text)

    def words(self, text: str) -> list[str]:
        return _WORD(self.plain(text).casefold())


def by_letters(text: str, lang: str | None) -> bool:
    """By language; without one, by script."""
    if lang:
        return lang.strip().lower()[:2] in LETTER_LANGS
    return 2 * len(_UNSPACED.findall(text)) > len(text)


def names_of(text: str) -> set[str]:
    """Words written with a capital within a sentence, in lower case."""
    return {w.casefold() for w in _MID_NAME.findall(text)}


def token_code(token: str, names: frozenset[str]) -> int:
    """Placeholder for a number, name or unit; else a hash of the token, never below 16."""
    if token.isdecimal():
        return NUMBER
    if token in names:
        return NAME
    if token in UNITS:
        return UNIT
    return xxhash.xxh64_intdigest(token) | 16


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n codes; 0 where a window holds code 0."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ codes[j : j + count]) * factor
            out ^= out >> np.uint64(29)
    known = np.concatenate([[0], np.cumsum(codes != 0)])
    out[known[n:] - known[:-n] < n] = 0
    return out


def slot_pattern(slots: tuple[str, ...]) -> tuple[int, ...]:
    """Which slots are equal. Two fillings of a template map onto each other one to one exactly if these agree."""
    first: dict[str, int] = {}
    return tuple(first.setdefault(s, len(first)) for s in slots)


def slots_hash(slots: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(slots))


def _mixed(template: int, other: int) -> int:
    """One hash of two, the second of which is well mixed."""
    return (template * 0x9E3779B97F4A7C15 ^ other) & 0xFFFFFFFFFFFFFFFF


@dataclass
class Side:
    """Windows of all items that are compared in one way, as sorted arrays of hashes; about 45 bytes a window."""

    n: int
    #: token of an item -> code
    codes: dict[str, int] = field(default_factory=dict)
    #: distinct template hashes
    templates: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: hashes of template and slots, with the number of the item; several items may hold one
    filled: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    #: hashes of template and slot pattern, with the smallest number of an item
    patterns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def build(self, docs: list[list[str]], numbers: list[int]) -> None:
        templates, filled, patterns, owners = ([] for _ in range(4))
        for tokens, number in zip(docs, numbers):
            hashes = window_hashes(np.array([self.codes[t] for t in tokens], np.uint64), self.n)
            templates.append(hashes)
            owners.append(np.full(len(hashes), number, np.int32))
            for k, h in enumerate(hashes.tolist()):
                slots = self.slots(tokens[k : k + self.n])
                filled.append(_mixed(h, slots_hash(slots)))
                patterns.append(_mixed(h, xxhash.xxh64_intdigest(repr(slot_pattern(slots)))))
        if not filled:
            return
        owner = np.concatenate(owners)
        self.templates = np.unique(np.concatenate(templates))
        pairs = np.unique(np.rec.fromarrays([np.array(filled, np.uint64), owner]))
        self.filled, self.item = pairs.f0.copy(), pairs.f1.copy()
        pairs = np.unique(np.rec.fromarrays([np.array(patterns, np.uint64), owner]))
        self.patterns, at = np.unique(pairs.f0, return_index=True)
        self.first = pairs.f1[at].copy()

    def slots(self, tokens: list[str]) -> tuple[str, ...]:
        return tuple([t for t in tokens if self.code(t) < 16])

    def code(self, token: str) -> int:
        """Code of a token, 0 if no item has it; numbers and units are never unknown, and numbers are not remembered."""
        found = self.codes.get(token)
        return found if found is not None else NUMBER if token.isdecimal() else UNIT if token in UNITS else 0

    def matches(self, docs: list[list[str]]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """Document, template hash and the document's own slots, of each window whose template an item has."""
        known = self.templates
        if not len(known):
            return
        codes: list[int] = []
        starts = [0]
        held = self.codes.get
        for tokens in docs:
            codes += [c if (c := held(t)) is not None else self.code(t) for t in tokens]
            codes.append(0)
            starts.append(len(codes))
        hashes = window_hashes(np.array(codes, np.uint64), self.n)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hits = np.flatnonzero((known[at] == hashes) & (hashes != 0))
        owner = np.searchsorted(starts, hits, "right") - 1
        for k, d in zip(hits.tolist(), owner.tolist()):
            lo = k - starts[d]
            yield d, int(hashes[k]), self.slots(docs[d][lo : lo + self.n])

    def items(self, template: int, slots: tuple[str, ...]) -> list[int]:
        """Numbers of the items with this template and these slots."""
        lo, hi = (int(np.searchsorted(self.filled, np.uint64(_mixed(template, slots_hash(slots))), side)) for side in ("left", "right"))
        return self.item[lo:hi].tolist()

    def alike(self, template: int, slots: tuple[str, ...]) -> int | None:
        """Smallest number of an item with this template whose slots these ones fit consistently."""
        wanted = np.uint64(_mixed(template, xxhash.xxh64_intdigest(repr(slot_pattern(slots)))))
        at = int(np.searchsorted(self.patterns, wanted))
        return int(self.first[at]) if at < len(self.patterns) and self.patterns[at] == wanted else None


class ItemIndex:
    """Template windows of the items, for words and for letters: made once, on the driver, and held by each worker process."""

    def __init__(self, items: list[tuple], words: int = WORDS, letters: int = LETTERS):
        tokens = Tokens()
        self.sides = {False: Side(words), True: Side(letters)}
        self.ids = sorted({i for i, _, text in items if text})
        number = {i: n for n, i in enumerate(self.ids)}
        items = [(number[i], by_letters(text, lang), text) for i, lang, text in items if text]
        names = frozenset().union(*(names_of(tokens.plain(t)) for _, letters_side, t in items if not letters_side))
        for letters_side, side in self.sides.items():
            mine = [(n, tokens.words(t)) for n, on, t in items if on == letters_side]
            docs = [list("".join(w)) if letters_side else w for _, w in mine]
            none = frozenset()
            side.codes = {t: token_code(t, none if letters_side else names) for d in docs for t in d}
            side.build(docs, [n for n, _ in mine])

    def cut(self, texts: list[str | None]) -> dict[bool, list[list[str]]]:
        if not _tokens:
            _tokens.append(Tokens())
        words = [_tokens[0].words(t) if t else [] for t in texts]
        unspaced = [list("".join(w)) if t and _UNSPACED.search(t) else [] for t, w in zip(texts, words)]
        return {False: words, True: unspaced}

    def repeats(self, texts: list[str | None]) -> list[set]:
        """Items that each text repeats."""
        found: list[set] = [set() for _ in texts]
        for letters, docs in self.cut(texts).items():
            side = self.sides[letters]
            for d, template, slots in side.matches(docs):
                found[d].update(self.ids[n] for n in side.items(template, slots))
        return found

    def variants(self, texts: list[str | None]) -> list[dict]:
        """Of each text: the smallest item of each window that asks an item's template with other parameters."""
        found: list[dict] = [{} for _ in texts]
        for letters, docs in self.cut(texts).items():
            side = self.sides[letters]
            for d, template, slots in side.matches(docs):
                if slots and (n := side.alike(template, slots)) is not None and not side.items(template, slots):
                    found[d][self.ids[n]] = found[d].get(self.ids[n], 0) + 1
        return found


_tokens: list[Tokens] = []


def _items(items: DataFrame, item_col: str, text_col: str, lang_col: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())


def find_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", lang_col: str = "lang", held_chars: int = HELD_CHARS) -> DataFrame:
    """``doc_col, item_col``: each document with each item of which it repeats WORDS words (LETTERS letters) in a row.

    Case, punctuation, spacing, character forms, invisible characters and markup don't matter.
    Null, empty and short texts repeat nothing. Documents of one text each give their rows; a
    document gives an item once. Empty tables give no row. Only the named columns are read.

    Items up to ``held_chars`` characters are held in every worker and documents pass by without a
    shuffle; larger item tables are joined on window hashes (``find_leaks_by_join``).
    """
    kept = _items(items, item_col, text_col, lang_col)
    if (kept.agg(F.sum(F.length("text") + ROW_CHARS)).first()[0] or 0) > held_chars:
        return find_leaks_by_join(docs, items, doc_col, item_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in kept.collect()]))  # at most held_chars characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value  # read once a worker process
        for batch in batches:
            for part in by_bytes(batch, "text"):
                found = index.repeats(part.column("text").to_pylist())
                rows = [(d, i) for d, each in enumerate(found) for i in sorted(each)]
                ids = part.column("id").take(pa.array([d for d, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in rows], item_arrow)], [doc_col, item_col])

    item_arrow = _arrow_type(items, item_col)
    kinds = f"`{doc_col}` {docs.schema[doc_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}"
    return docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[df.schema[column].dataType.simpleString()]


def word_hash(token: str) -> int:
    """Hash of a token whether it is a name, a unit or neither; a number counts as one."""
    return NUMBER if token.isdecimal() else xxhash.xxh64_intdigest(token) | 16


_UNIT_HASHES = np.sort(np.array([word_hash(u) for u in UNITS], np.uint64))


def _is_in(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _hashes(seq: list[str], cache: dict[str, int]) -> np.ndarray:
    """``word_hash`` of each token; the cache starts anew beyond ``CACHED`` tokens."""
    if len(cache) > CACHED:
        cache.clear()
    for t in seq:
        if t not in cache:
            cache[t] = word_hash(t)
    return np.array([cache[t] for t in seq], np.uint64)


def _texts(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """``id, text, body`` of the rows with a text, and ``lang`` if one is named; ``body`` is a hash of the text."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"), *([F.col(lang_col).alias("lang")] if lang_col else []))
    return kept.where("text <> ''")


def _name_rows(texts: DataFrame) -> DataFrame:
    """``name``: hashes of the distinct names of the texts that are compared by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                pairs = zip(part.column("text").to_pylist(), part.column("lang").to_pylist())
                names = set().union(*(names_of(tokens.plain(text)) for text, lang in pairs if not by_letters(text, lang)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([word_hash(t) for t in names], np.uint64).view(np.int64))], ["name"])

    return texts.select("text", "lang").mapInArrow(run, "name bigint").distinct()


def _with_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` with ``names``, the hashes of those of its words that are names, by shuffle: for any number of names."""
    held = _bit_filter(names, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        cache: dict[str, int] = {}
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                bits = np.frombuffer(held.value, np.uint8)
                found = [np.unique(_hashes(tokens.words(text), cache)) for text in part.column("text").to_pylist()]
                found = [x[_passes(bits, x)] for x in found]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                words = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("body").take(owner), part.column("other").take(owner), pa.array(words)], ["body", "other", "name"])

    keyed = texts.withColumn("other", F.xxhash64(F.lit(1), "text"))
    words = keyed.select("body", "other", "text").mapInArrow(run, "body bigint, other bigint, name bigint")
    found = words.join(names, "name", "left_semi").groupBy("body", "other").agg(F.collect_set("name").alias("names"))
    return keyed.join(found, ["body", "other"], "left").select(*texts.columns, "names")


def _window_rows(texts: DataFrame, held=None, names=None) -> DataFrame:
    """``of, body, template, slots, pattern, times``: distinct windows of each text, as hashes; slots are 0 where a window has none.

    ``times`` is how often the text has the window. With a filter ``held`` only windows whose template passes it are looked at
    further. Words are names if their hashes are in the broadcast array ``names`` or in the column of that name. With a column
    ``lang`` a text is cut in one way, without it in both.
    """
    by_lang, own_names = "lang" in texts.columns, "names" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, none = Tokens(), np.zeros(0, np.uint64)
        known = names.value if names is not None else none
        cache: dict[str, int] = {}
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                owner: list[int] = []
                rows: list[tuple[int, int, int, int]] = []
                langs = part.column("lang").to_pylist() if by_lang else [None] * len(part)
                for d, (text, lang) in enumerate(zip(part.column("text").to_pylist(), langs)):
                    words = tokens.words(text)
                    if own_names:
                        mine = part.column("names")[d].values
                        known = none if mine is None else np.sort(mine.to_numpy().view(np.uint64))
                    sides = (by_letters(text, lang),) if by_lang else (False, True) if _UNSPACED.search(text) else (False,)
                    for letters in sides:
                        seq = list("".join(words)) if letters else words
                        n = LETTERS if letters else WORDS
                        coded = _hashes(seq, cache)
                        is_name = _is_in(none if letters else known, coded)
                        coded[_is_in(_UNIT_HASHES, coded)] = UNIT
                        coded[is_name] = NAME
                        codes = coded.tolist()
                        hashes = window_hashes(coded, n)
                        at = np.arange(len(hashes)) if held is None else np.flatnonzero(_passes(np.frombuffer(held.value, np.uint8), hashes))
                        seen: Counter[tuple[int, int, int]] = Counter()
                        for k, h in zip(at.tolist(), hashes[at].tolist()):
                            slots = tuple([t for t, c in zip(seq[k : k + n], codes[k : k + n]) if c < 16])
                            seen[h, slots_hash(slots) if slots else 0, xxhash.xxh64_intdigest(repr(slot_pattern(slots))) if slots else 0] += 1
                        owner += [d] * len(seen)
                        rows += [(*window, times) for window, times in seen.items()]
                at = pa.array(owner, pa.int64())
                columns = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("body").take(at), *(pa.array(columns[:, i]) for i in range(4))], ["of", "body", "template", "slots", "pattern", "times"])

    return texts.mapInArrow(run, f"of {texts.schema['id'].dataType.simpleString()}, body bigint, template bigint, slots bigint, pattern bigint, times bigint")


#: Bits of a filter that holds the templates or the names of the items, as a power of two: 16 MB for each task that reads it.
FILTER_BITS = 27


def _places(values: np.ndarray) -> Iterator[np.ndarray]:
    """The two bits that stand for each value."""
    for factor in (1, 0xC2B2AE3D27D4EB4F):
        yield ((values * np.uint64(factor)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    good = np.ones(len(values), bool)
    for at in _places(values):
        good &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return good


def _bit_filter(df: DataFrame, column: str):
    """Broadcast filter of 2**FILTER_BITS bits that every value of ``column`` passes, or-ed together from one filter a part."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                bits |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    parts = df.select(column).repartition(16, column).mapInArrow(part, "bits binary")
    whole = parts.repartition(1).mapInArrow(merged, "bits binary").first()  # sixteen filters of fixed size
    return df.sparkSession.sparkContext.broadcast(whole[0])


def find_leaks_by_join(docs: DataFrame, items: DataFrame, doc_col: str, item_col: str, text_col: str, lang_col: str) -> DataFrame:
    """As ``find_leaks`` for item tables of any size: windows as 128-bit hashes of template and slots, joined by shuffle.

    Windows of documents whose template no item has are left out before the shuffle by a filter of fixed size. Items that share
    a window are met once for each document that has it, and a window of many documents is split by AQE's skew join.
    """
    right = cut_lineage(_window_rows(_texts(items, item_col, text_col, lang_col)).select(F.col("of").alias("item"), "template", "slots"))
    texts = _texts(docs, doc_col, text_col)
    left = _window_rows(texts, _bit_filter(right, "template")).select("of", "body", "template", "slots")
    found = left.join(right, ["template", "slots"]).select("of", "body", "item").distinct()
    return _each_copy(found, texts).select(F.col("of").alias(doc_col), F.col("item").alias(item_col))


def _each_copy(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Each row of ``found`` (``of, body, ...``) once for each row of ``texts`` with its id and text; ``copies`` is their number."""
    copies = texts.groupBy("id", F.col("body").alias("its_body")).agg(F.count("*").cast("int").alias("copies")).where("copies > 1")
    whole = found.join(copies, F.col("of").eqNullSafe(F.col("id")) & (F.col("body") == F.col("its_body")), "left").drop("id", "its_body")
    return whole.withColumn("copies", F.coalesce("copies", F.lit(1))).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))


def find_variants_by_join(docs: DataFrame, items: DataFrame, doc_col: str, item_col: str, text_col: str, lang_col: str, names_held: int = NAMES_HELD) -> DataFrame:
    """As ``find_variants`` for item tables of any size: windows joined by shuffle on template and slot pattern.

    Up to ``names_held`` names are held in every worker as a sorted array of hashes; more are found by joining the words of each text.
    """
    asked, texts = _texts(items, item_col, text_col, lang_col), _texts(docs, doc_col, text_col)
    names = cut_lineage(_name_rows(asked))
    held = None
    if names.count() <= names_held:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(names.toArrow().column("name").to_numpy().view(np.uint64)))  # at most names_held
    right = _window_rows(asked if held else _with_names(asked, names), None, held).where("pattern <> 0")
    right = cut_lineage(right.groupBy("template", "pattern", "slots").agg(F.min("of").alias("item")))
    left = _window_rows(texts if held else _with_names(texts, names), _bit_filter(right, "template"), held).where("pattern <> 0")
    alike = left.join(right.groupBy("template", "pattern").agg(F.min("item").alias("item")), ["template", "pattern"])
    other = alike.join(right.select("template", "slots"), ["template", "slots"], "left_anti")
    found = other.groupBy("of", "body").agg(F.sum("times").alias("windows"), F.countDistinct("item").cast("int").alias("items"))
    return _each_copy(found, texts).select(F.col("of").alias(doc_col), F.expr("int(windows div copies)").alias("windows"), "items")


def find_variants(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", lang_col: str = "lang", held_chars: int = HELD_CHARS) -> DataFrame:
    """``doc_col, windows, items``: documents that ask templates of items with other parameters.

    ``windows`` counts the windows that fit an item's template with consistent, different slots, ``items`` the
    different items that stand for them (the smallest id of each set of equal templates). One row per document
    with such a window; nulls and empty tables give none. Items beyond ``held_chars`` characters are joined by
    shuffle (``find_variants_by_join``), with the same rows.
    """
    kept = _items(items, item_col, text_col, lang_col)
    if (kept.agg(F.sum(F.length("text") + ROW_CHARS)).first()[0] or 0) > held_chars:
        return find_variants_by_join(docs, items, doc_col, item_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in kept.collect()]))  # at most held_chars characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows = [(d, sum(x.values()), len(x)) for d, x in enumerate(index.variants(part.column("text").to_pylist())) if x]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], [doc_col, "windows", "items"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{doc_col}` {kind}, windows int, items int")
