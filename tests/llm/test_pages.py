import json

import numpy as np
import pytest

from gneiss.llm.boosting import Boosted, fit
from gneiss.llm.pages import MODEL_PATH, PageReader, decode, main_body, residue_pages
from gneiss.llm.residue import ERROR, FILLER, NONE, PLACEHOLDER, SCRIPTS, learn_filler, line_kind, spoken_of
from gneiss.llm.train_pages import MAIN as MAIN_KINDS
from gneiss.llm.train_pages import compare, label
from tests.llm.pages_by_hand import CONTENT, RESIDUE, bodies

PAGE = "MENU\n• Recipes\n• Contact\nHome > Log in – Mufa Cafe\nHow we grade oat cookies\nA partner mill near Teruma grades fresh crates by rail. Our cookies are baked at 9 a.m.\n- Rice vinegar, 37 g x 21\nRelated pages\nHow we grade rice vinegar\nOur year with barley miso\nBack to top\nImprint | Privacy | Terms | Sitemap"
MAIN = [4, 5, 6]


@pytest.mark.parametrize(
    "line,kind",
    [
        ("{{ site.tagline }}", PLACEHOLDER), ("Welcome to [[x]], your partner for %Y% in <%= z %>.", PLACEHOLDER), ("© {year} [owner]", PLACEHOLDER), ("undefined", PLACEHOLDER),
        ("Our mail tool fills in {{name}} and [city] for you, at 30 cents per letter.", NONE), ("[Allow] [Manage choices]", NONE), ("Use `{{name}}` in your page.", NONE),
        ("lorem ipsum dolor sit amet", FILLER), ("Print proofs come with lorem ipsum until your own text arrives.", NONE), ("xxx xxx xxx xxx", FILLER), ("asdf jkl sdfg hjkl fds", FILLER),
        ("ダミー文章です。ダミー文章です。ダミー文章です。", FILLER), ("404 - the page you asked for could not be found", ERROR), ("The server did not answer in time (code 504).", ERROR),
        ('Our studio writes 404 pages and friendly "page not found" texts for shops.', NONE), ("Fehler 404: Seite nicht gefunden", ERROR), ("お探しのページは見つかりませんでした。", ERROR),
        ("To view this content, switch JavaScript on in your browser settings.", SCRIPTS), ("We teach JavaScript to 44 pupils, and each must enable scripts in the lab browser.", NONE),
        ("请启用JavaScript以查看本页。", SCRIPTS), ("", NONE), ("A" * 100_000, FILLER), ("No words repeat here, but " * 1 + "many follow. " + "x1 y2 " * 3 + "end of it " * 9_000, NONE), ("经理说:“周一装车。绝不延误。”经理说:“周一装车。绝不延误。”经理说:“周一装车。绝不延误。”", NONE),
    ],
)
def test_residue_lines(line, kind):
    assert line_kind(line) == kind


def test_trees_learn_and_survive_storage():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y, trees=20, depth=3)
    again = Boosted.load(model.dump())
    assert ((model.score(x) > 0) == y).mean() > 0.97
    assert np.allclose(model.score(x), again.score(x), atol=0.01) and len(model.score(x[:0])) == 0


def test_decoding_is_consistent():
    rng = np.random.default_rng(1)
    of = np.sort(rng.integers(0, 60, 300))
    of = np.cumsum(np.diff(of, prepend=of[0]) > 0)
    line, block = rng.normal(size=300) * 3, rng.normal(size=of.max() + 1) * 3
    main = decode(line, block, of)
    for b in range(of.max() + 1):
        mine = np.flatnonzero(of == b)
        options = [(0.0, 0)] + [(block[b] + sum(line[i] for k, i in enumerate(mine) if m >> k & 1), m) for m in range(1, 1 << len(mine))] if len(mine) < 12 else None
        if options:
            best = max(options)[1]
            assert [bool(best >> k & 1) for k in range(len(mine))] == main[mine].tolist()


def test_pages_written_by_hand():
    """Pages unlike those of the training: few false lines, most lines found; the figures are in the README."""
    reader = PageReader.load()
    recall, precision = compare(json.load(open(MODEL_PATH, encoding="utf-8")), bodies())
    assert recall > 0.75 and precision > 0.95
    for pages, cases in ((RESIDUE, len(RESIDUE)), (CONTENT, 1)):
        page, _, residue = reader.main_lines(pages)
        assert ((residue > 0) & (np.bincount(page, minlength=len(pages)) == 0)).sum() == cases


def test_labels_come_from_repetition_and_neighbours():
    nav, foot = ["Alpha", "Beta", "Gamma"], "Made by Nobody"
    pages, hosts = [], []
    for n in range(60):
        word = "".join(chr(97 + n * k % 26) for k in (1, 3, 5, 7))
        pages.append([" | ".join(nav), f"The tale of {word}", f"A {word} lived by the sea with its {word[::-1]}.", f"Nobody knew why the {word} had come there.", "Seen lately", f"The tale of {chr(97 + n % 9)}{n % 9}", foot])
        hosts.append(f"{word}{n}.example")
    kinds = label(pages, hosts, frozenset())
    assert kinds[0][0] == "menu" and kinds[0][2:4] == ["text"] * 2 and kinds[0][-1] not in MAIN_KINDS
    assert all(k[2] == k[3] == "text" and k[4] not in MAIN_KINDS and k[6] not in MAIN_KINDS for k in kinds)


def test_filler_words_are_learned_from_their_company():
    lines = ["Lorem ipsum " + " ".join(f"{a}{b}um" for b in "xyz") for a in "bcdf" for _ in range(3)] + [f"{a}xum {a}yum {b}zum {b}xum" for a in "bcdf" for b in "bcdf" if a != b]
    words = learn_filler(lines + ["the cat sat on the lorem mat", "a dog and bxum ran", "cats like dogs and more"])
    assert {"cyum", "fzum"} <= words and not words & {"cat", "dog", "the", "and"}
    assert line_kind("Cyum fzum cxum dyum.", words) == FILLER and line_kind("Cyum fzum cxum dyum.") == NONE


def test_placeholders_that_a_page_only_shows():
    lines = ["How merge fields work", "A variable in braces is replaced by the value when the page is shown.", "{{ name }}", "```", "[[city]]", "```", "The same holds for the town, as the next example of the syntax shows."]
    assert spoken_of(lines, [line_kind(x) for x in lines]) == [2, 4]
    assert spoken_of(["{{ a }}", "{{ b }}"], [PLACEHOLDER] * 2) == []


def test_operators(spark):
    bad = "Home | Contact\n{{ about_text }} [[city]]\nLoading ... please wait\nImprint | Privacy | Terms | Sitemap"
    rows = [(1, PAGE, 5), (1, PAGE, 5), (2, None, 0), (3, "", 0), (4, " \n ", 0), (5, bad, 0), (6, PAGE.replace("\n", "\r\n"), 0), (None, bad, 0), (7, PAGE + "\n%%FOOTER_NOTE%%", 0)]
    df = spark.createDataFrame(rows, "crawl_id bigint, text string, line_no int")
    got = sorted((r.crawl_id, r.line_no) for r in main_body(df, "crawl_id", "text").collect())
    assert got == sorted([(1, n) for n in MAIN] * 2 + [(6, n) for n in MAIN] + [(7, n) for n in MAIN])
    assert sorted(r.crawl_id or -1 for r in residue_pages(df, "crawl_id", "text").collect()) == [-1, 5]
    assert main_body(df.limit(0), "crawl_id", "text").count() == residue_pages(df.limit(0), "crawl_id", "text").count() == 0


def test_very_long_page():
    reader = PageReader.load()
    page, number, _ = reader.main_lines([PAGE + "\n" + "Our cookies are baked at 9 a.m. in Teruma.\n" * 50_000])
    assert set(MAIN) <= set(number.tolist()) and len(number) > 49_000


@pytest.mark.parametrize(
    "line,kind",
    [
        ("The page you asked for could not be found. " * 2 + "Please try again later. " * 20, ERROR), ("To view this content, please enable JavaScript in your browser settings. " + "Please wait. Loading. " * 30, SCRIPTS),
        ("To see the prices, the stock of every shop and all offers of this week in full, enable JavaScript.", NONE), ("To see all of the prices and the stock of every single shop of ours today, enable JavaScript.", SCRIPTS),
        ("This is a sample page. Your text goes here. Add your text here. ".replace("Add your text here. ", "Coming soon. ") * 12, FILLER), ("Warm and fresh from our own oven in the old town " * 4, FILLER),
        ("{{ site.settings.footer.address.second_line_of_the_company_name }}", PLACEHOLDER), ("The page you asked for could not be found. " * 20 + "We grade cookies by hand.", NONE),
        ("the page is down " + "(code x " * 30_000 + "3.5", NONE), ("please enable javascript and reload" + " to see (error x" * 20_000 + " 3.5", NONE), ("".join(f"[a{i} " for i in range(30_000)), NONE), ("ab abc " + "".join(map(str, range(30_000))), NONE),
    ],
)
def test_residue_of_any_length(line, kind):
    assert line_kind(line) == kind


def test_pages_of_one_long_line_of_residue(spark):
    long = "The page you asked for could not be found. " + "Please try again later. " * 20
    df = spark.createDataFrame([(1, long), (2, "MENU\n• Recipes\n" + long), (3, PAGE)], "crawl_id bigint, text string")
    assert sorted(r.crawl_id for r in residue_pages(df, "crawl_id", "text").collect()) == [1, 2]
    assert {r.crawl_id for r in main_body(df, "crawl_id", "text").collect()} == {3}
