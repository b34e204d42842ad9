"""Trains the page model: ``python -m gneiss.llm.train_pages crawls.parquet``.

Lines of a bounded sample are labelled by evidence that any crawl holds: on how many hosts a form
of a line stands, whether it stands among sentences that stand nowhere else, what follows it, its
shape, and words that sites of any kind use. No phrase of the sample is listed here. Gradient-boosted
trees are fitted to those labels and written beside this module; serving reads only the trees. A part
of the pages is learned a second time as if none of their words were known, so that the trees judge
pages of other corpora by shape, place and neighbours.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter, defaultdict

import numpy as np

from gneiss.llm.boosting import fit
from gneiss.llm.canonical import Transducer
from gneiss.llm.pages import KINDS, MODEL_PATH, SHAPE, PageReader, generic_words
from gneiss.llm.residue import learn_filler, line_kind

#: Most pages taken for training, by a seeded sample.
PAGES = 8_000
#: Tokens kept, by how often they are seen.
TOKENS = 3_000
#: Share of pages that are learned again without the words of all, or of half, of their lines.
UNKNOWN = 0.7
#: Hosts from which a form is common, and from which it may head a sidebar.
COMMON, HEADS = 5, 12
#: Share of neighbours that are sentences of their own, from which a common sentence is text; more where it has words that sites use.
AMONG, AMONG_GENERIC = 0.31, 0.42
_KIND = {k: i for i, k in enumerate(KINDS)}
MAIN = frozenset(("text", "list", "heading"))

_STOPPED = re.compile(r"[.!?。！？…][\"»”“」』)）'’\s]*$").search
_WIDE = re.compile("[぀-ヿ㐀-鿿]")
_SEPARATED = re.compile(r"\s*[|·•]\s*|\s+[>›/–-]\s+|\s{2,}")
_BULLET = re.compile(r"[-•・*–] ?")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_WORD = re.compile(r"\w+")
_NAMES = re.compile(r"§(?:[ .,&]*(?:§|[A-Z]\w*\.?))*")
_SENTENCE = re.compile(r".*?[.!?。！？]+[\"»”“」』)）'’]*(?=\s|[^\x00-\x7f]|$)")


def form_of(line: str, host: str) -> str:
    """A line with numbers as 0 and the words of its host's name as a mark."""
    bare = re.sub(r"[^a-z0-9]", "", host.lower())
    line = _NUMBER.sub("0", line)
    named = lambda m: "§" if len(m[0]) > 3 and (m[0][0].isupper() or "." in line[max(0, m.start() - 1) : m.end() + 1]) and m[0].lower() in bare else m[0]
    return _NAMES.sub("§", _WORD.sub(named, line))


class Form:
    """What a form of a line shows by itself, and on how many hosts it stands."""

    __slots__ = ("hosts", "sentence", "words", "generic", "parts", "bulleted", "bare")

    def __init__(self, form: str, hosts: int):
        self.hosts = hosts
        self.bulleted = bool(_BULLET.match(form))
        self.bare = _BULLET.sub("", form, count=1).strip() if self.bulleted else form
        parts = [x.strip() for x in _SEPARATED.split(form.strip(" •|>·")) if x.strip()]
        self.parts = parts
        self.sentence = bool(_STOPPED(form)) and len(parts) == 1
        self.words = max(1, len(_WIDE.findall(form)) // 2) if _WIDE.search(form) else len(_WORD.findall(form))
        found = generic_words(form)
        self.generic = bool(found) and (not self.sentence or sum(map(len, found)) >= 0.12 * len(form))

    @property
    def short(self) -> bool:
        return not self.sentence and self.words <= 14 and len(self.parts) == 1 and not self.generic and not self.bulleted


def beside(page: list[str], at: int) -> list[str]:
    return page[max(0, at - 1) : at] + page[at + 1 : at + 2]


class Evidence:
    """Labels of the lines of a sample: ``pages`` are lists of forms without blank lines and residue."""

    def __init__(self, pages: list[list[str]], hosts: list[str]):
        on = defaultdict(set)
        for page, host in zip(pages, hosts):
            for form in page:
                on[form].add(host)
        self.forms = {f: Form(f, len(h)) for f, h in on.items()}
        self._sentences(pages)
        self._sidebars(pages)
        self._entries(pages)
        self._items(pages)

    def _sentences(self, pages: list[list[str]]) -> None:
        """Sentences that stand nowhere else are text; common ones are if they stand among such."""
        forms = self.forms
        text = {f: x.sentence and x.words >= 4 and x.hosts < COMMON and not x.generic for f, x in forms.items()}
        for _ in range(2):
            among = defaultdict(lambda: [0, 0])
            for page in pages:
                for at, form in enumerate(page):
                    near = beside(page, at)
                    among[form][0] += sum(text[f] for f in near)
                    among[form][1] += 2
            share = {f: (a + 1.4) / (n + 4) for f, (a, n) in among.items()}
            text = {
                f: x.sentence and (x.words >= 2 and share[f] >= (AMONG_GENERIC if x.generic else AMONG) if x.hosts >= COMMON else x.words >= 4 and not x.generic)
                for f, x in forms.items()
            }
        begins = defaultdict(lambda: [0, 0])  # lines that begin with the same sentence are judged together where they are rare
        first = {f: (m[0] if (m := _SENTENCE.match(f)) else f) for f, x in forms.items() if x.sentence}
        for f, s in first.items():
            begins[s][0] += among[f][0]
            begins[s][1] += among[f][1]
        for f, s in first.items():
            a, n = begins[s]
            if forms[f].hosts < COMMON and n >= 30 and not 0.2 <= a / n < 0.3:
                text[f] = a / n >= 0.3
        self.text = text

    def _sidebars(self, pages: list[list[str]]) -> None:
        """Common short lines that rarer short lines follow head a sidebar; what stands right below one is a title."""
        forms, follow = self.forms, defaultdict(lambda: [0, 0])
        for page in pages:
            for form, after in zip(page, [*page[1:], None]):
                x = forms[form]
                if x.hosts >= HEADS and not x.sentence and not x.bulleted and len(x.parts) == 1 and x.words <= 5:
                    follow[form][0] += after is not None and forms[after].short and forms[after].hosts * 1.5 < x.hosts
                    follow[form][1] += 1
        self.heads = {f for f, (a, n) in follow.items() if 2 * a > n}
        below, total = Counter(), Counter()
        for page in pages:
            total.update(page)
            below.update(after for form, after in zip(page, page[1:]) if form in self.heads and after not in self.heads)
        self.titles = {f for f, n in below.items() if n >= 2 and n >= 0.04 * total[f] and not forms[f].sentence}

    def _entries(self, pages: list[list[str]]) -> None:
        """Parts of lines that separators cut into three or more are entries of menus; so are lines made of them."""
        seen: Counter[str] = Counter()
        for page in pages:
            for form in page:
                x = self.forms[form]
                if not x.sentence and len(x.parts) >= 3:
                    seen.update(set(x.parts))
        entries = {e for e, n in seen.items() if n >= COMMON and e not in self.titles}

        def covered(words: list[str]) -> bool:
            at = held = 0
            while at < len(words):
                size = next((k for k in range(min(4, len(words) - at), 0, -1) if " ".join(words[at : at + k]).strip(",") in entries), 0)
                held += size
                at += size or 1
            return held >= 0.6 * len(words)

        self.menu = {f for f, x in self.forms.items() if not x.sentence and (all(p in entries for p in x.parts) or x.words <= 14 and covered(x.bare.split(" ")))}

    def _items(self, pages: list[list[str]]) -> None:
        """Lines with a number that stand beside text, or beside other items, are items of lists."""
        self.items: set[str] = set()
        for _ in range(5):
            near = defaultdict(lambda: [0, 0])
            for page in pages:
                for at, form in enumerate(page):
                    x = self.forms[form]
                    if "0" in form and not x.sentence and len(x.parts) <= 2 and not x.generic:
                        near[form][0] += any(self.text[f] or f in self.items for f in beside(page, at))
                        near[form][1] += 1
            self.items = {f for f, (a, n) in near.items() if (a + 0.4) / (n + 1) >= (0.34 if self.forms[f].bulleted else 0.5)}

    def labels(self, page: list[str]) -> list[str]:
        """The kind of each line of a page."""
        forms, kinds = self.forms, []
        for form in page:
            x = forms[form]
            sentence = x.sentence and x.words >= 2
            kinds.append("short" if not sentence else "text" if self.text[form] else "open" if x.hosts < COMMON else "foot")
        for at, form in enumerate(page):
            if kinds[at] == "open":
                near = kinds[max(0, at - 1) : at] + kinds[at + 1 : at + 2]
                kinds[at] = "text" if near.count("text") >= (2 if forms[form].generic and len(near) > 1 else 1) else "foot"
        below = False
        for at, form in enumerate(page):
            x = forms[form]
            if kinds[at] != "short":
                below = below and kinds[at] == "text"
            elif form in self.heads:
                kinds[at], below = "side", True
            elif form in self.items and not below:
                kinds[at] = "list"
            elif below and (form in self.titles or not (x.generic or len(x.parts) > 1 or form in self.menu or x.hosts >= 3 * HEADS)):
                kinds[at] = "teaser"
            elif form in self.titles and not x.generic:
                kinds[at] = "heading"
            elif x.generic or len(x.parts) > 1 or form in self.menu or x.hosts >= COMMON:
                kinds[at], below = "menu", False
            else:
                kinds[at] = "rare"
        for at, form in enumerate(page):
            if kinds[at] == "rare":  # by its neighbours
                before, after = kinds[at - 1] if at else "", kinds[at + 1] if at + 1 < len(page) else ""
                kinds[at] = "list" if "list" in (before, after) or forms[form].bulleted and before == "text" else "heading" if after == "text" else "menu"
        return kinds


def label(pages: list[list[str]], hosts: list[str], filler: frozenset[str]) -> list[list[str]]:
    """The kind of each line of pages in their one form; blank lines and residue are ``rest``."""
    residue = {line for page in pages for line in page if line and line_kind(line, filler)}
    kept = [[i for i, line in enumerate(page) if line and line not in residue] for page in pages]
    forms = [[form_of(page[i], host) for i in at] for page, at, host in zip(pages, kept, hosts)]
    evidence = Evidence(forms, hosts)
    out = []
    for page, at, form in zip(pages, kept, forms):
        kinds = ["rest"] * len(page)
        for i, kind in zip(at, evidence.labels(form)):
            kinds[i] = kind
        out.append(kinds)
    return out


def train(texts: list[str], hosts: list[str], seed: int = 0) -> dict:
    one_form = Transducer().one_form
    pages = [[one_form(x.replace("�", "")) for x in t.split("\n")] for t in texts]
    filler = learn_filler([line for page in pages for line in page])
    kinds = label(pages, hosts, filler)
    # Attribute scores: log-odds of a token in each kind of line against all lines, distinct lines counting once.
    blank = PageReader({"tokens": [], "scores": [], "filler": sorted(filler)})
    counts: dict[str, np.ndarray] = {}
    totals = np.zeros(len(KINDS))
    seen = {(line, k) for p, ks in zip(pages, kinds) for line, k in zip(p, ks)}
    for line, k in sorted(seen):
        column = _KIND["teaser" if k == "heading" else k]
        for t in set(blank.tokens(line)):
            if t not in counts:
                counts[t] = np.zeros(len(KINDS))
            counts[t][column] += 1
        totals[column] += 1
    heavy = Counter(line for p in pages for line in p)
    for line, n in heavy.items():  # whole lines are known by how often they stand, not by how many differ
        whole = [t for t in blank.tokens(line) if t[0] == "="]
        if whole and n >= 20:
            counts[whole[0]] *= n / counts[whole[0]].sum()
    kept = sorted(sorted(counts, key=lambda t: (-counts[t].sum(), t))[:TOKENS])
    seen_in = np.array([counts[t] for t in kept]) + 0.05
    share = seen_in / (totals + 1)
    scores = np.log(share) - np.log(share.sum(1, keepdims=True))
    model = {"tokens": kept, "scores": np.round(scores, 2).ravel().tolist(), "filler": sorted(filler)}
    reader = PageReader(model)
    rng = np.random.default_rng(seed)
    again = np.flatnonzero(rng.random(len(texts)) < UNKNOWN)
    parts = []
    for chosen, known in ((np.arange(len(texts)), True), (again, False)):
        page, number, sizes, local = reader.nodes([texts[i] for i in chosen])
        if not known:
            hidden = rng.random(len(page)) < np.where(rng.random(len(chosen)) < 0.6, 1.0, 0.5)[page]
            local[hidden, SHAPE:] = 0
        block = reader.blocks(page, local)
        lines, blocks = reader.features(page, number, sizes, local, block)
        y = np.array([k in MAIN for i in chosen for k in kinds[i]], float)
        parts.append((lines, blocks, y, np.maximum.reduceat(y, np.flatnonzero(np.diff(block, prepend=-1)))))
    lines, blocks, y, yb = (np.concatenate(x) for x in zip(*parts))
    model["lines"] = fit(lines, y, trees=60, depth=4).dump()
    model["blocks"] = fit(blocks, yb, trees=25, depth=4).dump()
    return model


def compare(model: dict, pages: list[tuple[str, set[int]]]) -> tuple[float, float]:
    """Shares of body lines found and of found lines that are right, against pages whose body lines are known."""
    reader = PageReader(model)
    page, number, _ = reader.main_lines([text for text, _ in pages])
    got = set(zip(page.tolist(), number.tolist()))
    want = {(i, n) for i, (_, body) in enumerate(pages) for n in body}
    return len(got & want) / max(len(want), 1), len(got & want) / max(len(got), 1)


def main(path: str, seed: int = 0) -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(path, columns=["host", "text"])
    rows = [(h or "", t) for h, t in zip(table["host"].to_pylist(), table["text"].to_pylist()) if t]
    if len(rows) > PAGES:
        rows = [rows[i] for i in np.sort(np.random.default_rng(seed).choice(len(rows), PAGES, replace=False))]
    model = train([t for _, t in rows], [h for h, _ in rows], seed)
    with open(MODEL_PATH, "w", encoding="utf-8") as f:
        json.dump(model, f, ensure_ascii=False)


if __name__ == "__main__":
    main(sys.argv[1])
