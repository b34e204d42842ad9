"""Main body of web pages: boosted trees over the nodes of a page, decoded from ancestors down.

A page is a tree of page, blocks and lines; a block is a stretch of lines of one make. Each
line node has attribute scores (how its tokens are shared out among kinds of lines), its own
shape, its place (plain text has no depth), statistics of its siblings and of the block around it. One model
judges blocks, one judges lines, and decoding takes the likeliest labels in which no line is
main in a block that isn't and every main block has a main line.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.boosting import Boosted
from gneiss.llm.canonical import Transducer
from gneiss.llm.residue import CLASSICAL, PLACEHOLDER, line_kind, spoken_of
from gneiss.operators.batches import by_bytes

MODEL_PATH = os.path.join(os.path.dirname(__file__), "models", "pages.json")
#: Kinds of lines whose attribute scores are kept; the training names them.
KINDS = ("menu", "foot", "side", "teaser", "text", "list", "rest")
#: Distinct lines that a worker remembers; beyond it the table starts anew.
LINES_KEPT = 60_000

_TOKEN = re.compile(r"0|[^\W\d_぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]|[|>·•/›»«\[\]©@%&]").findall
_STOPS = ".!?。！？"
_STOPS_AT_END = re.compile(r"[.!?。！？…][\"»”“」』)）'’\s]*$").search
_SEPARATORS = "|>·/›"
_DIGITS = re.compile(r"\d+")
_BULLET = re.compile(r"[-•・*–] ?")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")
# Words that sites of any kind use in menus, notices, prompts and footers.
GENERIC = (
    "about us", "accept all", "add to cart", "all rights reserved", "archives", "back to top", "basket", "breadcrumb", "browser", "careers", "cart", "categories", "checkout", "comments",
    "contact", "cookie policy", "cookie settings", "copyright", "create account", "disclaimer", "e-mail address", "faq", "follow us", "help", "home", "imprint", "javascript", "leave a comment", "leave a reply", "legal",
    "log in", "login", "log out", "menu", "my account", "newsletter", "next post", "older posts", "post comment", "powered by", "previous", "privacy", "read more", "recent posts", "register", "related",
    "search", "settings", "share", "sign in", "sign up", "site map", "sitemap", "skip to", "sponsored", "subscribe", "tags", "terms", "toggle", "view all", "wishlist", "©",
    "agb", "anmelden", "datenschutz", "impressum", "kontakt", "nach oben", "startseite", "suche", "teilen", "über uns", "warenkorb", "weiterlesen", "alle rechte vorbehalten",
    "accueil", "connexion", "confidentialité", "mentions légales", "panier", "partager", "plan du site", "recherche", "s’abonner", "tous droits réservés", "lire la suite", "haut de page",
    "aviso legal", "buscar", "carrito", "compartir", "contacto", "iniciar sesión", "inicio", "leer más", "mapa del sitio", "privacidad", "suscríbase", "todos los derechos reservados", "volver arriba",
    "set cookies", "use cookies", "uses cookies", "utilise des cookies", "utilizamos cookies", "verwenden cookies", "お問い合わせ", "カート", "クッキーを使用", "サイトマップ", "シェア", "プライバシー", "ホーム", "メニュー", "ログイン", "会社概要", "個人情報", "検索", "無断転載", "ページの先頭", "もっと見る", "利用規約",
    "登录", "关于我们", "联系我们", "购物车", "首页", "隐私", "版权所有", "返回顶部", "分享", "搜索", "главная", "контакты", "политика конфиденциальности", "войти", "поиск", "cookies policy",
)
_SPLIT = re.compile(r"[^\W_]+|©").findall
_UNSPACED_GENERIC = tuple(g for g in GENERIC if "\u3040" <= g[0] <= "\u9fff")
#: First word to the phrases that begin with it, as words, the longest first.
_PHRASES: dict[str, list[tuple[int, list[str], str]]] = {}
for _phrase in sorted(set(GENERIC) - set(_UNSPACED_GENERIC), key=len, reverse=True):
    _cut = _SPLIT(_phrase)
    _PHRASES.setdefault(_cut[0], []).append((len(_cut), _cut, _phrase))


def generic_words(line: str) -> list[str]:
    """The words of GENERIC that stand in a line, whole or in the plural; words of unspaced scripts as they stand."""
    low = line.lower()
    found = [g for g in _UNSPACED_GENERIC if g in low] if not low.isascii() else []
    words = _SPLIT(low)
    for at, word in enumerate(words):
        for n, cut, phrase in _PHRASES.get(word) or (_PHRASES.get(word[:-1], ()) if word[-1] == "s" else ()):
            if n == 1 or words[at + 1 : at + n - 1] == cut[1:-1] and words[at + n - 1 : at + n] in ([cut[-1]], [cut[-1] + "s"]):
                found.append(phrase)
                break
    return found


SHAPE = 15
#: Where the shape has the kind of residue.
KIND_AT = 11


def _count(line: str, marks: str) -> int:
    return sum(map(line.count, marks))


def shape(line: str, filler: frozenset[str]) -> tuple:
    """What a line in its one form shows by itself."""
    generic = generic_words(line)
    n = len(line)
    wide = len(_UNSPACED.findall(line)) if not line.isascii() else 0
    first = line[:1]
    return (
        n + wide, line.count(" ") + 1, bool(_STOPS_AT_END(line, max(0, n - 12))), _count(line, _STOPS), bool(_BULLET.match(line)), _count(line, _SEPARATORS),
        _count(line, "0123456789"), first.islower(), first.isdigit(), line.isupper(), wide > 0, line_kind(line, filler), "@" in line or "www." in line, len(generic), sum(map(len, generic)) / max(n, 1),
    )


class PageReader:
    """Turns texts into nodes with features, and features into main lines."""

    def __init__(self, model: dict):
        self.vocabulary: dict[str, int] = {t: i for i, t in enumerate(model["tokens"])}
        scores = np.array(model["scores"], np.float32).reshape(len(self.vocabulary), len(KINDS))
        self.scores = np.vstack([scores, np.zeros((1, len(KINDS)), np.float32)])  # the last row is for unknown tokens
        self.line_model = Boosted.load(model["lines"]) if "lines" in model else None
        self.block_model = Boosted.load(model["blocks"]) if "blocks" in model else None
        self.filler = frozenset(model.get("filler", CLASSICAL))
        self.form = Transducer().one_form
        self._reset()

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> PageReader:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.local = np.zeros((0, SHAPE + len(KINDS) + 2), np.float32)

    def tokens(self, line: str) -> list[str]:
        """Attribute tokens: words and characters, with the first, the last and the whole line marked."""
        found = _TOKEN(_DIGITS.sub("0", line))
        if found:
            found += ["^" + found[0], found[-1] + "$"]
            if len(found) <= 14:
                found.append("=" + " ".join(found[:-2]))
        return found

    def _learn(self, lines: list[str]) -> None:
        """Local features of lines not met before."""
        get, unknown = self.vocabulary.get, repeat(len(self.vocabulary))
        ids: list[int] = []
        ends = np.zeros(len(lines), np.int64)
        shapes = np.zeros((len(lines), SHAPE), np.float32)
        for i, raw in enumerate(lines):
            line = self.form(raw.replace("�", ""))
            shapes[i] = shape(line, self.filler)
            ids.extend(map(get, self.tokens(line), unknown))
            ends[i] = len(ids)
        ids.append(len(self.vocabulary))
        codes = np.array(ids, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(self.scores[codes], starts, axis=0)
        sizes = np.add.reduceat((codes < len(self.vocabulary)).astype(np.int64), starts)
        sums[ends == starts], sizes[ends == starts] = 0, 0
        means = sums / np.maximum(sizes, 1)[:, None]
        self.local = np.vstack([self.local, np.hstack([shapes, means, sums[:, [4]], sizes[:, None]]).astype(np.float32)])

    def nodes(self, texts: list[str | None]):
        """Line nodes of the pages: page number, line number, local features and block numbers."""
        if len(self.numbers) > LINES_KEPT:
            self._reset()
        numbers = self.numbers
        codes: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        for p, text in enumerate(texts):
            if not text:
                continue
            lines = text.split("\n")
            counts[p] = len(lines)
            for line in lines:
                n = numbers.get(line)
                if n is None:
                    n = numbers[line] = len(numbers)
                    waiting.append(line)
                codes.append(n)
        if waiting:
            self._learn(waiting)
        page = np.repeat(np.arange(len(texts)), counts)
        starts = np.cumsum(counts) - counts
        number = np.arange(len(page)) - starts[page]
        local = self.local[np.array(codes, np.int64)]
        for p in np.unique(page[local[:, KIND_AT] == PLACEHOLDER]).tolist():  # what a page only shows is none
            lines = texts[p].split("\n")
            shown = spoken_of(lines, local[starts[p] : starts[p] + counts[p], KIND_AT].astype(int).tolist())
            local[starts[p] + np.array(shown, np.int64), KIND_AT] = 0
        return page, number, counts, local

    @staticmethod
    def blocks(page: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Block number of each line: a new block begins where the make of the lines changes."""
        scores = local[:, SHAPE : SHAPE + len(KINDS)]
        make = np.where(local[:, 0] == 0, 0, np.where(local[:, 2] > 0, 1, np.where(local[:, 4] > 0, 2, 3)))
        make = make * 16 + scores.argmax(1)
        first = np.ones(len(page), bool)
        first[1:] = (page[1:] != page[:-1]) | (make[1:] != make[:-1])
        return np.cumsum(first) - 1

    def features(self, page: np.ndarray, number: np.ndarray, counts: np.ndarray, local: np.ndarray, block: np.ndarray):
        """Features of lines and of blocks."""
        n = len(page)
        scores = local[:, SHAPE : SHAPE + len(KINDS)]
        key = np.hstack([scores, local[:, [0, 2, 4, KIND_AT, 13]]])

        def shifted(by: int) -> np.ndarray:
            out = np.full_like(key, -9)
            if by > 0:
                same = page[by:] == page[:-by]
                out[by:][same] = key[:-by][same]
            else:
                same = page[by * -1 :] == page[:by]
                out[:by][same] = key[-by:][same]
            return out

        starts = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(np.append(starts, n))
        page_of = page[starts]
        block_mean = np.add.reduceat(np.hstack([scores, local[:, [0, 2, 4, 5, 6, 13]]]), starts, axis=0) / size[:, None] if n else np.zeros((0, len(KINDS) + 6))
        at = number[starts] / np.maximum(counts[page_of], 1)
        before = np.full_like(block_mean, -9)
        after = np.full_like(block_mean, -9)
        if len(starts) > 1:
            same = page_of[1:] == page_of[:-1]
            before[1:][same] = block_mean[:-1][same]
            after[:-1][same] = block_mean[1:][same]

        # Siblings before: lines since the last that is likeliest the heading of a sidebar, or likeliest something that closes one.
        kind = scores.argmax(1)
        index = np.arange(n)
        page_start = (np.cumsum(counts) - counts)[page]

        def since(flag: np.ndarray) -> np.ndarray:
            last = np.maximum.accumulate(np.where(flag, index, -1))
            return np.where(last >= page_start, index - last, 60).clip(0, 60)

        side, closing, text = since(kind == KINDS.index("side")), since((kind == KINDS.index("foot")) | (kind == KINDS.index("menu"))), since((kind == KINDS.index("text")) & (local[:, 2] > 0))
        ahead = index[::-1]

        def until(flag: np.ndarray) -> np.ndarray:
            last = np.minimum.accumulate(np.where(flag, index, n + 60)[::-1])[::-1]
            end = (np.cumsum(counts))[page]
            return np.where(last < end, last - index, 60).clip(0, 60)

        ahead = until((kind == KINDS.index("text")) & (local[:, 2] > 0))
        content = np.bincount(page, (kind == KINDS.index("text")) & (local[:, KIND_AT] == 0), len(counts))[page]
        residue = np.bincount(page, local[:, KIND_AT] > 0, len(counts))[page]
        place = np.stack([number, number / np.maximum(counts[page], 1), counts[page], side, closing, text, ahead, (side < closing), content, residue], axis=1)
        lines = np.hstack([local, shifted(1), shifted(-1), shifted(2), shifted(-2), place, size[block][:, None], block_mean[block][:, -6:]]).astype(np.float32)
        pad = lambda a: a[starts][:, None]
        blocks = np.hstack([block_mean, before, after, size[:, None], at[:, None], pad(side), pad(closing), pad(ahead), pad(content), pad(residue), counts[page_of][:, None]]).astype(np.float32)
        return lines, blocks

    def main_lines(self, texts: list[str | None], only_residue: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Page and number of each main line, and the number of lines of each page that are residue.

        With ``only_residue`` main lines are found only on pages with a line of residue.
        """
        page, number, counts, local = self.nodes(texts)
        residue = np.bincount(page, local[:, KIND_AT] > 0, len(texts)).astype(np.int64)
        if only_residue:
            kept = residue[page] > 0
            page, number, local = page[kept], number[kept], local[kept]
            counts = np.where(residue > 0, counts, 0)
        if not len(page):
            return page, number, residue
        block = self.blocks(page, local)
        lines, blocks = self.features(page, number, counts, local, block)
        main = decode(self.line_model.score(lines), self.block_model.score(blocks), block)
        main &= (local[:, 0] > 0) & (local[:, KIND_AT] == 0)
        return page[main], number[main], residue


def decode(line: np.ndarray, block: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Likeliest consistent labels from log-odds of lines and blocks."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    gain = np.add.reduceat(np.maximum(line, 0), starts)
    best = np.maximum.reduceat(line, starts)
    gain = np.where(best > 0, gain, best)  # a main block has one main line at least
    taken = gain + block > 0
    return taken[of] & ((line > 0) | (line == best[of]))


def main_body(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, line_no`` of every line of a page's main body, counted from 0 after splitting at line feeds.

    Null, empty and blank texts have none, nor has an empty table. Repeated rows give their lines
    once each; null ids stay. Pages of any length are read whole. Only the two named columns are
    read. One pass without a shuffle; a worker remembers LINES_KEPT distinct lines at most.
    """
    return _per_page(df, id_col, text_col, lambda page, number, residue: (page, number), "line_no int")


def residue_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` of the rows that hold nothing but template residue, filler, errors or demands for scripts.

    Menus, notices, sidebars and footers are set aside by the page model; a row is a case if some
    line is residue and no line belongs to a main body. Null, empty and blank texts are none.
    """

    def cases(page: np.ndarray, number: np.ndarray, residue: np.ndarray):
        return np.flatnonzero((residue > 0) & (np.bincount(page, minlength=len(residue)) == 0)), None

    return _per_page(df, id_col, text_col, cases, None, only_residue=True)


_readers: dict[str, PageReader] = {}


def _reader(model: str) -> PageReader:
    """The reader of a model, made once a worker process."""
    if model not in _readers:
        _readers.clear()
        _readers[model] = PageReader(json.loads(model))
    return _readers[model]


def _per_page(df: DataFrame, id_col: str, text_col: str, pick, extra: str | None, only_residue: bool = False) -> DataFrame:
    with open(MODEL_PATH, encoding="utf-8") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # about 1 MB, fixed by training
    names = [id_col] + ([extra.split()[0]] if extra else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model.value)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows, values = pick(*reader.main_lines(part.column("text").to_pylist(), only_residue))
                columns = [part.column("id").take(pa.array(rows))] + ([pa.array(values, pa.int32())] if extra else [])
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}" + (f", {extra}" if extra else ""))
