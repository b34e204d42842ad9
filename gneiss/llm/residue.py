"""Template residue, filler and error text, line by line.

Placeholders are found by one grammar for each kind of delimiter. A line of them counts as
residue by density: few words for each placeholder, no sentence without one, and no sign that
the text speaks about placeholders (code marks, tutorial words). Filler is found by repetition,
by words that no language has, and by phrases of page builders; errors and demands for scripts
by patterns that must cover every sentence of the line.
"""

from __future__ import annotations

import re
from collections import Counter

from gneiss.llm.canonical import Transducer

NONE, PLACEHOLDER, FILLER, ERROR, SCRIPTS = range(5)

_NAME = r"[A-Za-z_][\w. \-|:]*?"
# One grammar for each kind of delimiter.
GRAMMARS = (
    r"\{\{\{?\s*[#/^>!&]?" + _NAME + r"\s*\}?\}\}", r"\{%\s*" + _NAME + r"\s*%\}", r"<%=?\s*" + _NAME + r"\s*%>", r"\$\{\s*" + _NAME + r"\s*\}", r"\{\$\s*" + _NAME + r"\s*\}", r"\*\|[A-Z_][\w:. ]*\|\*",
    r"#\{\s*" + _NAME + r"\s*\}", r"\{\s*" + _NAME + r"\s*\}", r"\[\[\s*" + _NAME + r"\s*\]\]", r"\[\s*" + _NAME + r"\s*\]", r"%%" + _NAME + r"%%",
    r"%[A-Za-z_][\w.]*%", r"__[A-Za-z][\w.]*?__", r"@@[A-Za-z_][\w.]*@@",
)
PLACEHOLDERS = re.compile("|".join(GRAMMARS))
_MAY_HOLD = re.compile(r"[{\[]|%\w|__|<%|@@|\*\|")
_BUTTONS = re.compile(r"\[(?:Allow|Manage choices|OK|Accept|Reject|Settings|More|Close|Menu)\]", re.I)
# Signs that a line speaks about placeholders: code marks and tutorial words.
_ABOUT = re.compile(r"`|<code|</?pre|\b(?:fills? in|filled in|variables?|tutorial|syntax|for example|e\.g\.|replaced? by|stands for|merge fields?|template language|escap(?:e|ed))\b", re.I)
_SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]*")
_WORD = re.compile(r"[^\W_]+")
_SCRIPT = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\u0400-\u04ff\u0600-\u06ff\u0900-\u0dff\u0e00-\u0e7f]").search
_WORDLIKE = re.compile(r"[A-Za-zÀ-ÿ]+|[぀-ヿ㐀-鿿]{2}")

_REPEATED = re.compile(r"(.+?)(?:\s*\1){2,}[\s.…]*(.*)", re.S)
_STOPPED = re.compile("[.!?。！？]")
_MASHED = re.compile(r"[asdfghjkl]{2,}(?:\s+[asdfghjkl]{2,}){3,}[.!]?", re.I)
# Words of the classical filler text that are words of no living language in this form, mostly.
CLASSICAL = frozenset((
    "accumsan", "adipiscing", "aenean", "aliqua", "aliquam", "aliquet", "aliquip", "amet", "aptent", "auctor", "augue", "bibendum", "blandit", "cillum", "class",
    "commodo", "condimentum", "congue", "consectetuer", "consectetur", "consequat", "conubia", "convallis", "cubilia", "culpa", "cupidatat", "curabitur", "curae",
    "cursus", "dapibus", "deserunt", "dictum", "dictumst", "dignissim", "dolor", "dolore", "donec", "efficitur", "egestas", "eiusmod", "eleifend", "elementum",
    "elit", "enim", "etiam", "euismod", "excepteur", "exercitation", "facilisi", "facilisis", "fames", "faucibus", "felis", "fermentum", "feugiat", "finibus",
    "fringilla", "fugiat", "fusce", "gravida", "habitant", "habitasse", "hendrerit", "himenaeos", "iaculis", "imperdiet", "incididunt", "integer", "interdum",
    "ipsum", "irure", "justo", "labore", "laboris", "laborum", "lacinia", "lacus", "laoreet", "lectus", "libero", "ligula", "litora", "lobortis", "lorem", "luctus",
    "maecenas", "magna", "malesuada", "massa", "mattis", "mauris", "maximus", "metus", "minim", "molestie", "mollis", "mollit", "montes", "morbi", "nascetur",
    "natoque", "neque", "netus", "nibh", "nisi", "nostra", "nostrud", "nulla", "nullam", "nunc", "occaecat", "officia", "ornare", "pariatur", "parturient",
    "pellentesque", "penatibus", "pharetra", "phasellus", "placerat", "platea", "porta", "porttitor", "posuere", "potenti", "praesent", "pretium", "primis",
    "proident", "proin", "pulvinar", "purus", "quis", "quisque", "reprehenderit", "rhoncus", "ridiculus", "risus", "sagittis", "sapien", "scelerisque", "semper",
    "senectus", "suscipit", "tempor", "tincidunt", "tortor", "tristique", "turpis", "ullamco", "ultrices", "varius", "vehicula", "velit", "veniam", "vestibulum",
    "vivamus", "viverra", "voluptate", "volutpat", "vulputate",
))
# Phrases that page builders leave.
_SAMPLES = re.compile(
    r"(?:this is (?:a|your) (?:sample|first|example) (?:page|post)[^.!?]*|(?:replace|edit or delete) it(?: with your own words)?|hello world|(?:example|sample) (?:heading|text|title) (?:goes )?here|"
    r"your (?:text|copy|content) (?:goes )?here|(?:click|add) (?:here )?to edit[^.!?]*|insert (?:your )?(?:text|slogan|title)[^.!?]*|coming soon|"
    r"muster-?text:? ?(?:bitte ersetzen)?|blindtext|beispieltext[^.!?]*|texto de ejemplo,? ?(?:sustitúyalo)?|texte d['’]exemple[^.!?]*|exemple de texte[^.!?]*|"
    r"これはサンプルページです|内容を書き換えてください|(?:サンプル|ダミー)(?:文章|テキスト)?(?:です|が入ります)?|文章が入ります|見出しテキスト|ここに(?:文章|テキスト)[^。]*|"
    r"这是示例(?:页面|文字)[^。]*|示例(?:文字|文本)[^。]*|在此输入[^。]*|请替换[^。]*)"
)
# The rest of a sentence, with or without a code in parentheses at its end. Only the first code after the last
# closed parenthesis is tried, so that a long line takes linear time.
_REST = r"(?:(?>(?:[^.!?)]*\))*)(?>[^.!?)]*?%s\((?:%s) )[^)]*+\)|[^.!?]*)"
# What errors are said of, and what they say.
_THING = r"(?:the |this |that |your |our |an? )?(?:requested )?(?:page|site|web ?site|link|server|document|shop(?: system)?|address|request|file|resource|service|domain|account|url)(?: you (?:asked for|requested|are looking for))?(?: at this address)?"
_FAILS = (
    r"(?:no longer exists?|could not be (?:processed|found|loaded|opened|displayed)|cannot be (?:reached|found|shown|displayed)(?: right now)?|did not answer in time|is blocked in your area|"
    r"(?:has|have) (?:been )?moved(?: or (?:was|been) removed)?|was (?:moved or )?removed|(?:is|was) not (?:found|available|ready yet)|is closed for repair|"
    r"is parked|has been suspended|does not (?:exist|lead anywhere)|is under (?:construction|maintenance)|was refused by the server|timed out)"
)
# Letters that look Latin read as Latin in the one form, so phrases in Cyrillic do as well.
_RUSSIAN = "|".join(re.escape(Transducer().one_form(x)) + "[^!?]*" for x in ("ошибка 40", "ошибка 50", "страница не найдена", "доступ запрещен", "доступ запрещён", "включите javascript"))
_DOWN = r"(?:is|are) (?:temporarily |currently )?(?:unavailable|down)" + _REST % ("", "code|error")
_TAIL = r"(?: ?\((?:code|error) [^)]*\)| ?[-–] ?please retry in [^.!?]*| ?[-–:,] ?(?:error|code) ?\w+)?"
_AFTER = (
    r"our staff has been told|go back or try the (?:start|home) ?page|try the (?:home|start) ?page|please (?:come back|try again|retry)[^.!?]*|(?:please )?come back later|"
    r"slow down|we are sorry[^.!?]*|sorry|oops|thank you|ref: ?[\w\-]+|reference:? ?[\w\-]+|please wait"
)
_ERRORS = re.compile(
    rf"(?:(?:error|http|code|status)? ?[45]\d\d\b ?[-–:]? ?)?{_THING} (?:{_FAILS}{_TAIL}|{_DOWN})|{_AFTER}|(?:error|erreur|fehler|エラー|错误|http)[ :#]*[45]\d\d(?: ?[-–:：] ?[^.!?。]*)?|[45]\d\d ?[-–:]? ?(?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway time-?out)|"
    r"\S+/[\d.]+ (?:gateway time-?out|bad gateway|not found)|(?:fatal |parse |internal )?(?:server )?error: [^!?]*|fatal error|internal server error|database connection failed|(?:bad|gateway|connection) (?:gateway|time-?out|refused|reset)|not found|access (?:denied|forbidden|to this resource was refused by the server)|"
    r"too many requests(?: ?[-–] ?slow down)?|service (?:temporarily )?unavailable|(?:sorry, )?nothing was found here|that address does not lead anywhere|we are down for maintenance[^!?]*|we will be back[^!?]*|"
    r"(?:wegen wartung|zurzeit|derzeit)[^.!?]*nicht erreichbar|seite nicht gefunden|die seite (?:wurde|existiert|ist)[^.!?]*|zugriff verweigert|page introuvable|accès refusé|site en maintenance[^.!?]*|revenez plus tard|"
    r"sitio en mantenimiento[^.!?]*|vuelva más tarde|(?:no se encontró la página|página no encontrada|acceso denegado)|"
    r"error establishing a database connection|(?:sorry, )?you have been blocked|you (?:do not|don['’]t) have permission to access[^!?]*|(?:on )?this server|the requested url[^!?]*was not found[^!?]*|(?:http )?error \d+(?:\.\d+)?(?: [-–] )?[^.!?]*|"
    r"unable to connect[^.!?]*|this (?:site|page) (?:can['’]t|cannot) be (?:reached|displayed)|(?:oops|whoops)[!,.]? ?(?:that|this) page (?:can['’]t|could not|cannot) be found|it looks like nothing was found at this location[^!?]*|"
    r"a? ?(?:critical|fatal|application|server-side) (?:error|exception)[^!?]*|(?:no|an?) (?:healthy upstream|internal error|unexpected error)[^!?]*|(?:your )?connection (?:timed out|was interrupted|is not private)|request (?:blocked|rejected)[^!?]*|"
    rf"page not found|(?:the )?page (?:isn['’]t|is not) available(?: right now)?|nothing (?:was )?found|web server is down|origin dns error|{_RUSSIAN}|(?:strona|strony) nie (?:została )?znalezion[ao][^!?]*|"
    r"nie znaleziono strony[^!?]*|pagina non trovata[^!?]*|página não encontrada[^!?]*|pagina niet gevonden[^!?]*|sidan hittades inte[^!?]*|페이지를 찾을 수 없습니다[^!?]*|요청하신 페이지[^!?]*|접근이 거부되었습니다[^!?]*|"
    r"お探しのページは見つかりませんでした|このページは(?:削除|移動)[^。]*|(?:ただいま|現在)(?:システム)?メンテナンス中です|しばらく(?:お待ち|して)[^。]*|アクセスが拒否されました|ページが(?:見つかりません|存在しません)[^。]*|サーバー?エラー[^。]*|"
    r"抱歉[,，]?(?:您访问的)?(?:页面|网页)[^。]*|(?:您访问的)?页面(?:不存在|未找到)[^。]*|系统维护中[^。]*|请稍后再试|访问被拒绝|服务器错误[^。]*"
)
_MEANS = (
    r"(?:(?:please )?(?:switch|turn) (?:on )?(?:javascript|scripts|scripting|active content)(?: on)?|(?:please )?turn off your (?:script|ad) ?blocker|(?:please )?allow (?:javascript|scripts|cookies)|(?:please )?(?:enable|activate) (?:javascript|scripts|active content|cookies)|"
    r"use (?:a|another) browser with (?:scripting|javascript|scripts))"
)
_DEMANDS = re.compile(
    rf"(?:(?:to|for|before|in order to|if)\b[^.!?,]*, )?{_MEANS}(?: (?:in|for) your browser(?: settings)?)?(?: (?:(?:and|then) (?:reload|try again)|to (?:see|view|use|run|continue)){_REST % (" ", "error")}| \(error [^)]*\))?|"
    r"you need to enable javascript[^.!?]*|your browser (?:is too old|does not support|blocks)[^.!?]*|(?:javascript|scripts?) (?:is|are|must be|has been) (?:disabled|off|blocked|required|enabled|on|turned off)[^.!?]*|switch it on(?: and reload)?|"
    r"this (?:shop|site|page|app)(?: \w+)? (?:does not work|cannot be shown|will not work|requires?|needs)(?: without| with)? ?(?:javascript|scripts?|cookies)[^.!?]*|scripts and cookies must be on|checking (?:that|if) you are (?:not a robot|human)|"
    r"loading|please wait|some features need scripts|just a moment|"
    r"bitte (?:aktivieren|schalten) sie javascript[^.!?]*|ohne (?:skripte|javascript)[^.!?]*|javascript (?:ist|muss)[^.!?]*|veuillez activer javascript[^.!?]*|activez javascript[^.!?]*|activ[ea] javascript[^.!?]*|(?:habilite|active) javascript[^.!?]*|chargement|cargando|"
    r"このページを表示するにはjavascript[^。]*|(?:スクリプト|javascript)(?:が|を)[^。]*(?:オフ|無効|有効)[^。]*|読み込み中です|ブラウザの設定をご確認ください|请(?:启用|开启|打开)(?:javascript|脚本)[^。]*|正在加载[,，]?(?:请开启脚本)?"
)
_EMPTY_VALUES = frozenset(("undefined", "null", "nan", "none", "[object object]", "n/a", "todo", "tbd"))
_NUMBERED = re.compile(r"^[>*•\-\s]+")
# Full stops that end a sentence, not those in numbers, names of files and pauses.
_SPLIT = re.compile(r"(?<=[.!?。！？])(?:\s+|(?<=[。！？]))|(?<=\.\.\.)\s*|(?<=;)\s+")


def _placeholders(line: str) -> int:
    """PLACEHOLDER if the line is made of placeholders and their frame."""
    shown = _BUTTONS.sub("", line)
    found = PLACEHOLDERS.findall(shown)
    if not found or _ABOUT.search(shown):
        return NONE
    bare = PLACEHOLDERS.sub("\x00", shown)
    words = len(_WORDLIKE.findall(bare))
    if words > 9 * len(found):
        return NONE
    if any("\x00" not in s and len(_WORDLIKE.findall(s)) > 3 for s in _SENTENCE.findall(bare)):
        return NONE
    return PLACEHOLDER


def _filler(line: str, low: str, filler: frozenset[str]) -> int:
    words = low.split()
    # A unit that stands three times has a third of the words; scripts without spaces are one word.
    m = _REPEATED.fullmatch(low) if len(words) < 6 or 2 * len(set(words)) <= len(words) else None
    if m and _WORD.search(m[1]) and not _STOPPED.search(m[1]) and not m[1].strip().isdigit() and m[1].startswith(m[2].rstrip(" .…")) and (len(m[1]) > 1 or len(low) > 5):
        return FILLER
    if _MASHED.fullmatch(low):
        return FILLER
    if len(words) < 3 or filler.isdisjoint(words):
        return NONE
    words = _WORD.findall(low)
    if sum(w in filler for w in words if len(w) > 2) >= 0.7 * sum(len(w) > 2 for w in words):
        return FILLER
    return NONE


def learn_filler(lines: list[str], least: int = 3) -> frozenset[str]:
    """Words of filler that a corpus shows, by the company they keep, with the classical ones.

    Words of lines that begin as the classical text does may be filler. A word is, if nine of ten of the lines it
    stands in, and ``least`` of them, are made of such words by seven tenths.
    """
    cut = [(x.lower().startswith("lorem ipsum"), {w for w in _WORD.findall(x.lower()) if len(w) > 2 and not w[0].isdigit()}) for x in set(lines) if not _SCRIPT(x)]
    may_be = CLASSICAL.union(*(words for opens, words in cut if opens))
    seen: Counter[str] = Counter()
    among: Counter[str] = Counter()
    for _, words in cut:
        words_here = words & may_be
        seen.update(words_here)
        if len(words) > 3 and len(words_here) >= 0.7 * len(words):
            among.update(words_here)
    return CLASSICAL | {w for w, n in among.items() if n >= least and n >= 0.9 * seen[w]}


_FENCE = re.compile(r"\s*(?:```|~~~)|\s*</?(?:pre|code)\b", re.I)


def spoken_of(lines: list[str], kinds: list[int]) -> list[int]:
    """Numbers of placeholder lines that a page only shows: within code fences, under a line that leads up to them, or on a page about templates.

    A line leads up to the next two if it speaks about placeholders or ends in a colon after words of its own. A page is about
    templates if lines that speak about them, and hold none on their own, outnumber those of placeholders outside code.
    """
    fenced = False
    shown, plain, about = [], [], 0
    leads = -9
    for n, (line, kind) in enumerate(zip(lines, kinds)):
        if _FENCE.match(line):
            fenced = not fenced if line.lstrip()[:3] in ("```", "~~~") else "</" not in line
            continue
        if kind == PLACEHOLDER:
            (shown if fenced or n - leads <= 2 else plain).append(n)
        elif kind == NONE and _ABOUT.search(line) and len(_WORDLIKE.findall(line)) > 5:
            about += 1
            leads = n
        elif kind == NONE and line.rstrip().endswith((":", "：")) and len(_WORDLIKE.findall(line)) > 3:
            leads = n
    return shown + plain if about > len(plain) else shown


def _sentences(line: str):
    """Sentences one by one, as the first that is content ends the search."""
    at = 0
    for m in _SPLIT.finditer(line):
        yield line[at : m.start()]
        at = m.end()
    yield line[at:]


def line_kind(line: str, filler: frozenset[str] = CLASSICAL) -> int:
    """Kind of residue that a line in its one form is; NONE for boilerplate and content. ``filler`` has the words of filler text."""
    if not line:
        return NONE
    low = line.lower()
    if low.strip(" .") in _EMPTY_VALUES:
        return PLACEHOLDER
    if _MAY_HOLD.search(line) and (kind := _placeholders(line)):
        return kind
    if kind := _filler(line, low, filler):
        return kind
    kind = NONE
    for sentence in _sentences(_NUMBERED.sub("", low)):
        bare = sentence.strip(" .!?。！？;…")
        if not bare:
            continue
        if _SAMPLES.fullmatch(bare):
            kind = kind or FILLER
        elif _DEMANDS.fullmatch(bare):
            kind = kind or SCRIPTS
        elif _ERRORS.fullmatch(bare):
            kind = kind or ERROR
        else:
            return NONE
    return kind
