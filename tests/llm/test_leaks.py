import random

import pytest

from gneiss.llm.leaks import ItemIndex, Tokens, find_leaks, find_leaks_by_join, find_variants, find_variants_by_join

EN = "Meanwhile 841 drovers of Danquay argue that amber anchors outweigh 786 scarlet beehives before the 12 grocers of Ixmere close."
JA = "渡し守は提灯を874列に並べ、銀のものから先に運び出す。では砂見岬の鍛冶師が得る藍色の太鼓は何個になるか？"
ITEMS = [(1, "en", EN), (2, "ja", JA), (3, "de", None), (4, "en", "too short"), (5, None, EN)]
WORDS = EN.replace(",", "").rstrip(".").split()


def brute(text, items=ITEMS):
    cut = Tokens().words
    found = set()
    for i, lang, t in items:
        if t and text:
            a, b = (cut(x) for x in (t, text))
            n = 12
            if lang == "ja":
                a, b, n = list("".join(a)), list("".join(b)), 24
            grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
            if any(tuple(b[k : k + n]) in grams for k in range(len(b) - n + 1)):
                found.add(i)
    return found


@pytest.mark.parametrize(
    "text,expected",
    [
        ("x " + " ".join(WORDS[:12]) + " y", {1, 5}), (" ".join(WORDS[:11]), set()), (" ".join(WORDS[3:15]).upper(), {1, 5}),
        (" ".join(f"<em>{w}</em>" if i % 5 == 0 else w for i, w in enumerate(WORDS[:13])), {1, 5}), ("**Meanwhile** " + "; ".join(WORDS[1:12]), {1, 5}),
        (" ".join(WORDS[:6]) + "\u200b " + "\r\n".join(WORDS[6:12]), {1, 5}), (EN.replace("841", "842").replace("786", "787").replace("12 ", "13 "), set()),
        (JA[:29].replace("、", " "), {2}), (JA[:24], set()), ("ｘ" + JA[8:40], {2}), ("", set()), (None, set()), ("[Meanwhile](http://a.example/b) " + " ".join(WORDS[1:12]), {1, 5}),
    ],
)
def test_repeats(text, expected):
    assert ItemIndex(ITEMS).repeats([text]) == [expected] == [brute(text)]


def test_variants_need_consistent_slots():
    item = [(1, "en", "If 5 apples and 5 pears cost 9 coins then 9 grocers pay for the 5 crates")]
    index = ItemIndex(item)
    same = "If 7 apples and 7 pears cost 8 coins then 8 grocers pay for the 7 crates"
    other = "If 7 apples and 7 pears cost 8 coins then 6 grocers pay for the 7 crates"
    assert index.variants([same, other, item[0][2]])[0] and not index.variants([other])[0] and not index.variants([item[0][2]])[0]
    assert index.repeats([same]) == [set()]


def test_random_texts_agree_with_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4)] + ["1", "2", "Kg"]
    items = [(i, "en", " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(5)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(9)) + " " + " ".join(items[rng.randrange(5)][2].split()[k : k + rng.randint(8, 16)]) for k in range(14) for _ in range(20)]
    index = ItemIndex(items)
    assert index.repeats(texts) == [brute(t, items) for t in texts]


def test_operator_and_join_agree(spark):
    texts = ["a " + EN, JA, None, "", EN.upper() + JA, "nothing " * 5000, EN]
    docs = spark.createDataFrame([(i, t, 9, "z") for i, t in enumerate(texts)] + [(6, EN, 9, "z")], "doc_id bigint, text string, item_id int, template string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, lang string, text string")
    expected = {(0, 1), (0, 5), (1, 2), (4, 1), (4, 2), (4, 5), (6, 1), (6, 5)}
    rows = [tuple(r) for r in find_leaks(docs, items).collect()]
    assert set(rows) == expected and len(rows) == 10
    assert {tuple(r) for r in find_leaks_by_join(docs, items, "doc_id", "item_id", "text", "lang").collect()} == expected
    assert {tuple(r) for r in find_leaks(docs, items, held_chars=10).collect()} == expected
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert find_variants(docs, items).count() == 0


def test_variants_agree_with_their_join(spark):
    rng = random.Random(5)
    items = [(i, "en", " ".join(f"w{rng.randrange(40)}" if k % 4 else str(rng.randrange(3)) for k in range(40))) for i in range(6)]
    texts = []
    for k in range(40):
        words = items[k % 6][2].split()
        names = {str(n): str(n + 10 * (k % 3)) for n in range(3)}
        texts.append("x " * (k % 5) + " ".join(names.get(w, w) for w in words[k % 7 : k % 7 + 10 + k % 9]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id bigint, text string")
    frame = spark.createDataFrame(items, "item_id bigint, lang string, text string")
    held, joined = ({tuple(r) for r in find_variants(docs, frame, held_chars=n).collect()} for n in (1 << 20, 1))
    assert held == joined and 5 < len(held) < 40


def test_variants_do_not_depend_on_the_size_of_the_items(spark):
    gift = "the grocer Adam gives the clerk Berta five pears and some plums before noon on this day"
    meeting = "later the clerk Clara met the grocer Adam at 5 kg per box near the old mill by the river"
    items = [(1, "en", gift), (2, "en", meeting), (2, "en", gift), (4, "ja", JA), (5, None, JA), (6, "en", None), (7, "en", "of Kg"), (8, "en", "")]
    named = gift.replace("Adam", "Clara").replace("Berta", "Adam")
    texts = [named, f"{named}. {named}", meeting.replace("5 kg", "5 ml"), meeting.replace("5 kg", "5 of"), meeting.replace("5", "6"), gift, JA.replace("874", "21"), f"{named} {JA.replace('874', '5')}", None, "", "Clara " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, named), (0, meeting.replace("5", "6")), (None, named)], "doc_id bigint, text string").repartition(3)
    frame = spark.createDataFrame(items, "item_id bigint, lang string, text string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    held, joined = (sorted(find_variants(docs, frame, held_chars=n).collect(), key=key) for n in (1 << 20, 1))
    shuffled = sorted(find_variants_by_join(docs, frame, "doc_id", "item_id", "text", "lang", names_held=0).collect(), key=key)
    assert held == joined == shuffled
    assert [key(r) for r in held if r[0] in (None, 0, 1)] == [(-1, 6, 1), (0, 6, 1), (0, 6, 1), (0, 9, 1), (1, 12, 1)] and {r[0] for r in held} == {None, 0, 1, 4, 6, 7}
    assert not find_variants(docs, frame.limit(0), held_chars=-1).count() and not find_variants(docs.limit(0), frame, held_chars=1).count()
    assert not find_variants_by_join(docs, frame.limit(0), "doc_id", "item_id", "text", "lang", names_held=-1).count()


def test_random_variants_agree_with_their_joins(spark):
    rng = random.Random(11)
    vocabulary = "a b Adam Berta Clara kg km 1 2 adam c".split()
    items = [(i % 25, "en", " ".join(rng.choice(vocabulary) for _ in range(24))) for i in range(30)]
    texts = []
    for _ in range(150):
        other = dict(zip(["Adam", "Berta", "kg", "1"], rng.choice([["Berta", "Adam", "km", "3"], ["Clara", "Berta", "g", "1"], ["Adam", "Berta", "kg", "2"]])))
        texts.append(" ".join(other.get(w, w) if rng.random() < 0.99 else "b" for w in rng.choice(items)[2].split() * 2))
    docs = spark.createDataFrame([(i % 140, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    frame = spark.createDataFrame(items, "item_id bigint, lang string, text string")
    columns = ("doc_id", "item_id", "text", "lang")
    found = [sorted(tuple(r) for r in df.collect()) for df in (find_variants(docs, frame), *(find_variants_by_join(docs, frame, *columns, names_held=n) for n in (10, 0)))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_copies_of_a_document_each_give_their_rows(spark):
    docs = spark.createDataFrame([(1, EN), (1, EN), (1, JA), (None, EN), (None, EN)], "doc_id bigint, text string")
    frame = spark.createDataFrame(ITEMS + [ITEMS[0]], "item_id bigint, lang string, text string")
    held, joined = (sorted((r[0] or 0, r[1]) for r in find_leaks(docs, frame, held_chars=n).collect()) for n in (1 << 20, 1))
    assert held == joined and len(held) == 9


def test_numbers_of_a_corpus_are_not_remembered():
    index = ItemIndex(ITEMS)
    size = len(index.sides[False].codes)
    index.repeats([" ".join(map(str, range(20_000)))])
    assert len(index.sides[False].codes) == size
