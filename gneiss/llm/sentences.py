"""Sentence units across languages and scripts.

Blank lines part a text into blocks. In a block every terminal mark outside quotations and
brackets, and every quotation or bracket that closes on one, is a candidate boundary. A
maximum-entropy model looks at the tokens around it, their case, length, digits and script,
and at the quotation it closes, and decides. The model is trained by ``train_sentences`` on
reliable boundaries and stored beside this module.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.batches import by_bytes

MODEL_PATH = os.path.join(os.path.dirname(__file__), "models", "sentences.json")

# Terminal marks, marks that need no white space after them, polite particles that end Thai sentences.
TERMINALS = ".!?…。！？؟۔।॥｡‼⁇⁈⁉"
UNSPACED_TERMINALS = "。！？｡।॥؟۔"
THAI_ENDINGS = ("ครับ", "ค่ะ", "คะ", "ครับผม", "จ้ะ", "จ้า")
# Opening marks and their closing marks.
PAIRS = {"(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“”", "»": "«", "｢": "｣"}
QUOTES = frozenset("「『«“„\"｢»")
# Words of speech after a quotation, by which it is part of a longer sentence.
SPEECH = re.compile(
    r"\b(?:asked|said|called|cried|reads?|replied|fragte|sagte|rief|demanda|dit|cria|preguntó|dijo|gritó)\b|[问問答喊说說]道|と|라고|이라고|ने कहा"
)

#: What the features see: characters before a mark, after a boundary, and of the clause after a quotation. They are features of
#: the model, fitted with these sizes, not limits of the text: tokens are cut to 14 characters anyway, and a clause of speech
#: that has no word of speech in its first 60 characters counts as one without.
BEFORE, AFTER, CLAUSE = 24, 48, 60

_BLANK = re.compile(r"(?>\r\n|\n|\r)(?:[^\S\r\n]*(?>\r\n|\n|\r))+")
_MARKER = re.compile(r"\s*(?:[-*•・‣▪◦–—]\s+|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)、．）]\s+|[①-⑳]\s*)")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if c not in (0xFF08, 0xFF09, 0xFF3B, 0xFF3D, 0xFF01, 0xFF1F)}
_HAS_WIDE = re.compile("[！-～]").search
_UNSPACED = re.compile("[\u3005\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]")
_THAI = re.compile("[฀-๿]")
_EVENT = re.compile(r"[.!?…。！？؟۔।॥｡‼⁇⁈⁉]+|[()\[\]（）［］【】〔〕「」『』《》〈〉«»“”„\"｢｣]|(?<=[฀-๿])\s+")
_TAIL = re.compile(r"[^\s!?\"“”«»]*$")
# A sentence that begins right after another's full stop.
_STUCK = re.compile(r".*[a-zß-öø-ÿ]{3,}\.(?=[A-Z])")
_HEAD = re.compile(r"\s*([^\s]*)(?:\s+([^\s]*))?")
# A word with a capital that is no part of an address, or a lone capital word.
_CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ](?:[a-zß-öø-ÿ]+(?![\w.]*\.\w)|(?=[’']?\s))")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_CLOSERS = ")]）］】〕」』》〉»”’'\"“｣"
_OPENERS = "([（［【〔「『《〈«“„¿¡\"'‘｢"


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _spans(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[re.Match]]:
    """Outermost matched quotations and brackets of a block, and its events."""
    events = list(_EVENT.finditer(text, lo, hi))
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for m in events:
        ch = m[0]
        if len(ch) > 1 or ch.isspace() or ch in TERMINALS:
            continue
        k = m.start()
        if ch == '"':
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), None)
            if open_at is not None:
                pairs.append((stack[open_at][1], k))
                del stack[open_at:]
            else:
                stack.append((ch, k))
            continue
        open_at = next((i for i in range(len(stack) - 1, -1, -1) if ch in PAIRS.get(stack[i][0], "")), None)
        if open_at is not None:
            pairs.append((stack[open_at][1], k))
            del stack[open_at:]
        elif ch in PAIRS:
            stack.append((ch, k))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer, events


def _glued(text: str, before: str, at: int) -> bool:
    """Whether a sentence may begin at ``at`` though no white space parts it from the one before."""
    last = before[-1:]
    if "가" <= last <= "힣":
        return "가" <= text[at] <= "힣"
    m = _CAPITAL.match(text, at)
    if not m or before.lower() == "www" or (last.isupper() and not before.endswith("°C")):
        return False
    return len(m[0]) > 1 or not last.isdigit()


class Candidate:
    """A possible boundary: the unit would end at ``end``, the next one begins after white space there."""

    __slots__ = ("end", "mark", "before", "after", "second", "space", "quote", "speech", "cased")

    def __init__(self, end, mark, before, after, second, space, quote, speech, cased):
        self.end, self.mark, self.before, self.after, self.second = end, mark, before, after, second
        self.space, self.quote, self.speech, self.cased = space, quote, speech, cased

    def key(self) -> tuple:
        return (self.mark, self.before, self.after, self.second, self.space, self.quote, self.speech, self.cased)


def fold(text: str) -> str:
    """Full-width ASCII as ASCII, position by position."""
    return text.translate(_WIDE) if _HAS_WIDE(text) else text


def _before(text: str, lo: int, at: int) -> str:
    """The token that ends at a mark."""
    token = _TAIL.search(text, max(lo, at - BEFORE), at)[0].lstrip(_OPENERS)
    if _UNSPACED.search(token[-1:]):
        return token[-2:]
    return _DIGITS.sub("0", _STUCK.sub("", token))[-14:]


def _after(text: str, at: int, hi: int) -> tuple[str, str]:
    """The next tokens: words, or the first characters of a script without spaces."""
    m = _HEAD.match(text, at, min(hi, at + AFTER))
    first, second = m[1] or "", m[2] or ""
    bare = first.lstrip(_OPENERS)
    opener = first[: len(first) - len(bare)][:1]
    if _UNSPACED.search(bare[:1]):
        return opener + bare[:1], bare[1:2]
    if _THAI.search(bare[:1]):
        return opener + bare[:3], ""
    return opener + _DIGITS.sub("0", bare)[:14], _DIGITS.sub("0", second)[:10]


def candidates(text: str, lo: int, hi: int) -> list[Candidate]:
    """Candidate boundaries within the block [lo, hi) of a folded text; its end is none."""
    spans, events = _spans(text, lo, hi)
    start = _MARKER.match(text, lo, hi)
    floor = start.end() if start else lo
    block = text[lo:hi]
    cased = block != block.lower()
    stop = lo + len(block.rstrip())
    found: list[Candidate] = []
    s = 0
    begun = floor  # where the sentence that runs now may have begun
    for m in events:
        k, e = m.span()
        mark = m[0]
        if k < floor:
            continue
        while s < len(spans) and spans[s][1] < k:
            s += 1
        inside = s < len(spans) and spans[s][0] <= k
        if mark.isspace():  # Thai
            if inside or not text.endswith(THAI_ENDINGS, lo, k) or e >= hi:
                continue
            after, second = _after(text, e, hi)
            found.append(Candidate(k, "th", text[max(lo, k - 3) : k], after, second, True, "", False, cased))
            begun = e
            continue
        terminal = mark[0] in TERMINALS
        quote, speech = "", False
        end = e
        if inside:
            a, b = spans[s]
            if k != b or terminal:
                continue  # marks within a quotation or bracket
            body = text[a + 1 : b].rstrip()
            if not body or body[-1] not in TERMINALS:
                continue
            mark = body[-1]
            lead = text[begun:a].strip()
            kind = "q" if text[a] in QUOTES else "b"
            quote = kind + ("0" if not lead else ":" if lead[-1] in ":：" else "," if lead[-1] in ",，、" else "x")
            end = b + 1
            before = _before(text, a, len(body) + a + 1 - 1)
        elif terminal:
            if mark == "." and e < hi and k > lo and text[k - 1] < "\u0900" and (text[e].isdigit() or text[e].islower()):
                continue  # within a number or an address
            before = _before(text, lo, k)
        else:
            continue
        while end < hi and text[end] in _CLOSERS and not (s < len(spans) and any(x[0] == end for x in spans[s : s + 2])):
            end += 1
        if end >= stop:
            continue
        spaced = text[end].isspace()
        nxt = text[end]
        if not spaced:
            wide = mark[-1] in UNSPACED_TERMINALS or bool(before and _UNSPACED.match(before[-1]))
            if not (wide or quote and (_UNSPACED.match(nxt) or nxt in _OPENERS) or _glued(text, before, end)):
                continue
            if nxt in ",，、;；:：" or nxt in TERMINALS:
                continue
            if not quote and set(mark) == {"…"}:
                continue  # a pause
        after, second = _after(text, end, hi)
        if quote:
            clause = re.match(r"[^.!?。！？،,，：:]*", text[end : end + CLAUSE])[0]
            speech = bool(SPEECH.search(clause)) and text[end + len(clause) : end + len(clause) + 1] not in (":", "：")
        shape = mark if len(mark) == 1 else "..." if set(mark) <= {".", "…"} else mark[-1] + "+"
        found.append(Candidate(end, shape, before, after, second, spaced, quote, speech, cased))
        if not quote or quote[1] in "0:," and not speech and not (cased and after[:1].islower()):
            begun = end
    return found


def _case(token: str) -> str:
    bare = token.lstrip(_OPENERS)
    c = bare[:1]
    kind = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "c" if _UNSPACED.match(c) else "-" if not c else "o" if c.isalpha() else "p"
    return ("(" if len(bare) < len(token) else "") + kind


def _shape(token: str) -> str:
    if not token:
        return "none"
    if token[-1].isdigit():
        return "digit"
    if not token[-1].isalpha():
        return "mark"
    if "." in token:
        return "inner"
    if len(token) == 1:
        return "one"
    return ("Cap" if token[0].isupper() else "low" if token.isascii() or token[0].islower() else "oth") + str(min(len(token), 5))


def features(c: Candidate) -> list[str]:
    before, after = c.before.lower(), c.after.lower()
    shape, case = _shape(c.before), _case(c.after) if c.cased else "nocase"
    f = [
        f"m={c.mark}", f"b={before}", f"s={shape}", f"c={case}", f"a={after}", f"m={c.mark}|c={case}", f"b={before}|c={case}", f"s={shape}|c={case}",
        f"m={c.mark}|s={shape}", f"a={after}|{c.second.lower()}", f"b={before}|a={after}",
    ]
    if c.quote:
        f += [f"q={c.quote}", f"q={c.quote[0]}|v={c.speech}", f"q={c.quote}|c={case}", f"q|a={after}", f"q={c.quote}|v={c.speech}|c={case}"]
    return f


class SentenceModel:
    """Maximum-entropy weights; ``boundary`` remembers the answers to repeated contexts."""

    def __init__(self, weights: dict[str, float], keep: int = 300_000):
        self.weights, self.keep = weights, keep
        self.known: dict[tuple, bool] = {}

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> SentenceModel:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f)["weights"])

    def score(self, c: Candidate) -> float:
        w = self.weights.get
        return w("bias", 0.0) + sum([w(x, 0.0) for x in features(c)])

    def boundary(self, c: Candidate) -> bool:
        key = c.key()
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            found = self.known[key] = self.score(c) > 0
        return found

    def probability(self, c: Candidate) -> float:
        return 1 / (1 + math.exp(-self.score(c)))

    def units(self, text: str) -> list[tuple[int, int]]:
        """Code-point positions of the sentence units, without white space around them."""
        out: list[tuple[int, int]] = []
        folded = fold(text)
        for lo, hi in blocks(folded):
            at = lo
            for end in [*(c.end for c in candidates(folded, lo, hi) if self.boundary(c)), hi]:
                piece = text[at:end]
                bare = piece.strip()
                if bare:
                    first = at + len(piece) - len(piece.lstrip())
                    out.append((first, first + len(bare)))
                at = end
        return out


def split_sentences(df: DataFrame, id_col: str, text_col: str, model: SentenceModel | None = None) -> DataFrame:
    """``id_col, start_char, end_char`` of every sentence unit, by code points from 0, end exclusive.

    Null, empty and blank texts have none; neither has an empty table. Repeated rows give their
    units once each, null ids stay. Whole texts are cut, however long. Only the two named columns
    are read. One pass without a shuffle; the model is a few hundred KB and goes with the tasks.
    """
    weights = df.sparkSession.sparkContext.broadcast((model or SentenceModel.load()).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for batch in batches:
            for part in by_bytes(batch, "text"):
                cut = cut or SentenceModel(weights.value)
                rows: list[int] = []
                starts: list[int] = []
                ends: list[int] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    if text:
                        for a, b in cut.units(text):
                            rows.append(i)
                            starts.append(a)
                            ends.append(b)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [id_col, "start_char", "end_char"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, start_char int, end_char int")
