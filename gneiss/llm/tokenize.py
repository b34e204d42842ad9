"""Byte-level BPE encoding of a corpus by merge replay over its distinct words."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.batches import by_bytes

#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies, with its white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct words kept by a worker; beyond it the table starts anew, which costs time and changes no result.
WORDS_KEPT = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeReplay:
    """A vocabulary: ``encode`` gives the token ids of distinct words.

    An inverted index leads from each token pair to the positions where it stands in any of
    the words. The pairs are applied in rank order, each at all its positions, and only the
    neighbours of a merged position get new index entries.
    """

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        ids = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in byte_letters().items():
            self.byte_id[byte] = ids[letter]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
        self.pair_of = {rank: (key >> 20, key & 0xFFFFF, new) for key, (rank, new) in self.merges.items()}

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        byte_id, merges, pair_of = self.byte_id, self.merges, self.pair_of
        token: list[int] = [-1]
        starts: list[int] = []
        for word in words:
            starts.append(len(token))
            token += [byte_id[b] for b in word]
            token.append(-1)  # no pair spans two words
        following = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index: dict[int, list[int]] = {}
        for p in range(len(token) - 1):
            if token[p] >= 0 and (hit := merges.get(token[p] << 20 | token[p + 1])) if token[p + 1] >= 0 else None:
                index.setdefault(hit[0], []).append(p)
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            a, b, new = pair_of[rank]
            places = index.pop(rank)
            places.sort()
            for p in places:
                q = following[p]
                if token[p] != a or token[q] != b:
                    continue  # touched by an earlier merge
                token[p], token[q] = new, -2
                after, left = following[q], before[p]
                following[p] = after
                before[after] = p
                for x, y, at in ((token[left], new, left), (new, token[after], p)):
                    if x >= 0 and y >= 0 and (hit := merges.get(x << 20 | y)):
                        if hit[0] in index:
                            index[hit[0]].append(at)
                        else:
                            index[hit[0]] = [at]
                            heapq.heappush(queue, hit[0])
        return [[t for t in token[s:e] if t >= 0] for s, e in zip(starts, [*starts[1:], len(token)])]


class _Words(dict):
    """Word to number; an unknown word gets the next number and waits for its ids."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        return n


class CorpusEncoder:
    """Encodes Arrow arrays of texts, replaying merges over each block's unseen words."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.replay = MergeReplay(vocabulary)
        self.find = regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        number = self.words.__getitem__
        words: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts.to_pylist()):
            if text:
                found = self.find(text)
                counts[i] = len(found)
                words.extend(map(number, found))
        if self.words.waiting:
            coded = self.replay.encode(w.encode() for w in self.words.waiting)
            self.words.waiting.clear()
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((t for x in coded for t in x), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        at = np.array(words, np.int64)
        lo = self.start[at]
        size = self.start[at + 1] - lo
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)
        bound = np.concatenate([[0], ends])
        offsets = bound[np.concatenate([[0], np.cumsum(counts)])]
        if len(self.words) > WORDS_KEPT:
            ids = self.ids
            self._reset()
        else:
            ids = self.ids
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[where], pa.int32()))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str, pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>): the token ids of each text by a byte-level BPE vocabulary file.

    Empty and null texts give an empty list. Strings that look like special tokens are ordinary
    text. Every row gives one row: repeated rows and null ids stay, an empty table gives none.
    Only the two named columns are read, so extra columns and their names don't matter.

    No shuffle. The vocabulary file is read on the driver and broadcast; its size is fixed by
    its kind (a few MB) and checked. A worker keeps at most WORDS_KEPT distinct words.
    """
    with open(vocabulary_path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"{vocabulary_path} has {len(raw)} bytes; a vocabulary of at most 64 MB is expected")
    vocabulary = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in by_bytes(batch, "text"):
                encoder = encoder or CorpusEncoder(vocabulary.value, pattern)
                yield pa.RecordBatch.from_arrays([part.column("id"), encoder.encode(part.column("text"))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
