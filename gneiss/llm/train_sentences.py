"""Trains the sentence model on reliable boundaries: ``python -m gneiss.llm.train_sentences documents.parquet``.

Reliable boundaries are those that the layout shows: a block that ends in a terminal mark,
followed by another block, is read as if a space joined them. Reliable non-boundaries are
candidates whose token before the mark never ends a block, or whose next token never begins
one, though each was seen often enough. Candidates of which both are certain the other way
are boundaries, and so are those of an ordinary word before a capital: one that often stands
without a mark, or that is too long for an abbreviation. The rest is left out.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter

import numpy as np

from gneiss.llm.sentences import MODEL_PATH, TERMINALS, Candidate, _after, _before, _case, blocks, candidates, features, fold

#: Most documents taken for training.
DOCUMENTS = 10_000
#: Sightings after which a token's habit counts as reliable, and the share below which it counts as never.
SEEN, NEVER = 8, 0.02
#: Letters from which a word is no abbreviation.
LONG = 6
EPOCHS, RATE, DECAY = 12, 0.2, 1e-6


def _ends(text: str, lo: int, hi: int):
    body = text[lo:hi].rstrip()
    closed = body.rstrip("\"»”“」』）)] \xa0 ")
    return (closed[-1:], _before(text, lo, lo + len(closed) - 1)) if closed[-1:] and closed[-1] in TERMINALS else None


def collect(texts: list[str]):
    """Statistics of block ends and starts, and all candidates."""
    ends, starts, before, after = Counter(), Counter(), Counter(), Counter()
    pairs, inner = [], []
    for text in map(fold, texts):
        last = None
        for lo, hi in blocks(text):
            lo += len(text[lo:hi]) - len(text[lo:hi].lstrip())
            if lo >= hi:
                continue
            end = _ends(text, lo, hi)
            found = candidates(text, lo, hi)
            inner += found
            if end:
                first, second = _after(text, lo, hi)
                ends[end[1].lower()] += 1
                starts[first if text[lo:hi] != text[lo:hi].lower() else first.lower()] += 1
                if last:
                    pairs.append(Candidate(0, *last, first, second, True, "", False, True))
                last = end
            else:
                last = None
    for c in inner:
        before[c.before.lower()] += 1
    for c in inner:
        if not _never_ends(c, ends, before):
            after[c.after if c.cased else c.after.lower()] += 1
    for counter in (starts, after):  # what has no case to show is looked up in lower case
        for token, n in list(counter.items()):
            if token != token.lower():
                counter["", token.lower()] += n
            else:
                counter["", token] += n
    return ends, starts, before, after, pairs, inner


def _never_ends(c: Candidate, ends: Counter, before: Counter) -> bool:
    b = c.before.lower()
    return before[b] >= SEEN and ends[b] < NEVER * before[b]


_PLAIN_WORD = re.compile(r"[^\W\d_]{2,}(?=[\s,;:])")


def ordinary_words(texts: list[str], before: Counter) -> set[str]:
    """Words that stand without a full stop at least SEEN times, and a third as often as with one."""
    seen = Counter(w.lower() for t in texts for w in _PLAIN_WORD.findall(fold(t)))
    return {w for w, n in seen.items() if n >= max(SEEN, before[w] / 3)}


def label(texts: list[str]):
    ends, starts, before, after, pairs, inner = collect(texts)
    ordinary = ordinary_words(texts, before)
    rows: list[tuple[Candidate, int]] = [(c, 1) for c in pairs]
    for c in inner:
        b, a = c.before.lower(), c.after if c.cased else ("", c.after.lower())
        no_end = _never_ends(c, ends, before)
        no_start = after[a] >= SEEN and starts[a] < 3 * NEVER * after[a]
        if c.quote:
            if c.speech and c.quote[1] == "0" or c.quote == "qx" or c.quote[0] == "b" and c.quote[1] != "0":
                rows.append((c, 0))
            elif c.quote == "b0" or c.quote == "q0" and _case(c.after)[-1] == "c":
                rows.append((c, 1))  # stands alone; in a script without spaces a word of speech would follow at once
            elif starts[a] or not no_start:
                rows.append((c, 1))
            else:
                rows.append((c, 0))
        elif c.mark == "." and (c.before.lower() in ordinary or len(c.before) >= LONG and c.before.isalpha()) and _case(c.after)[-1] == "A":
            rows.append((c, 1))
        elif c.mark == "." or c.mark == "...":
            if no_end or no_start or c.mark == "...":
                rows.append((c, 0))
            elif ends[b] >= NEVER * before[b] and starts[a] >= 6 * NEVER * after[a]:
                rows.append((c, 1))
        else:
            rows.append((c, 1))
    return rows


def train(texts: list[str], seed: int = 0) -> dict[str, float]:
    rows = label(texts)
    weight = Counter((c.key(), y) for c, y in rows)
    one = {c.key(): c for c, _ in rows}
    data = [(features(one[k]), y, min(n, 20) ** 0.5) for (k, y), n in weight.items()]
    names = {name: i for i, name in enumerate(sorted({f for x, _, _ in data for f in x} | {"bias"}))}
    coded = [(np.array([names["bias"], *(names[f] for f in x)]), y, n) for x, y, n in data]
    w, g = np.zeros(len(names)), np.full(len(names), 1e-8)
    rng = random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(coded)
        for x, y, n in coded:
            step = n * (1 / (1 + np.exp(-w[x].sum())) - y) + DECAY * w[x]
            g[x] += step * step
            w[x] -= RATE * step / np.sqrt(g[x])
    wrong = sum((w[x].sum() > 0) != y for x, y, _ in coded)
    print(f"{len(rows)} reliable candidates, {len(coded)} different, {wrong} of them not fitted")
    return {name: round(float(w[i]), 3) for name, i in names.items() if abs(w[i]) > 0.05}


def main(path: str) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist()[:DOCUMENTS] if t]
    with open(MODEL_PATH, "w", encoding="utf-8") as f:
        json.dump({"weights": train(texts)}, f, ensure_ascii=False, indent=0, sort_keys=True)


if __name__ == "__main__":
    main(sys.argv[1])
