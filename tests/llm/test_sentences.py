import pytest

from gneiss.llm.sentences import SentenceModel, blocks, split_sentences


@pytest.fixture(scope="module")
def model():
    return SentenceModel.load()


CASES = [
    ["Capt. Ibrun of Osk Bros. Inc. blends tea, i.e. never on a Friday.", "The gate in Oskavel shuts at 6 p.m.", "Our buyer, J. R. Haldum, weighs 5.3 kg."],
    ['"Two more!" he called, "and then we close."', "Yes, from 17 cases on!", "(Ask for tea at the gate in Brakstad.)", "Each branch ships tea."],
    ["Dr. Velmora sagte: „Wir laden am Montag. Danach ist Schluss.“", "Am 6. Mai öffnet das Lager in Teruma.", "Die Kühlkette hält 27,8 °C bzw. weniger."],
    ["« Est-ce sec ? » demanda le chauffeur à Nordhusk.", "« Tout part frais. »", "Nous vendons p. ex. thé vert, etc. aux hôtels."],
    ["El Sr. Tansky dijo: «Cargamos el lunes. Nadie espera».", "¡Pida antes de las 9 p. m. del viernes!", "«¿Está seco?», preguntó el chófer en Teruma."],
    ["श्री क. ख. तांस्की हरी चाय तौलते हैं।", "कृपया 31 पेटी मँगाएँ!"],
    ["โกดังเปิดเวลา 8 น. ทุกวันครับ", "เรารับสินค้าจาก บจก. สมมุติ จำนวน 11 ลังค่ะ"],
    ["قال د. فلمورا: «نحمّل يوم الإثنين. لا شيء ينتظر.»", "هل لديكم شاي أخضر؟"],
    ['"유자청 제품은 다 말랐나요?"라고 기사가 물었다.', "가격이 3.4% 올랐습니다."],
]
UNSPACED = [
    ["担当者は「明日出荷します。遅れません。」と答えた。", "「ごま油です。」", "霧代市の倉庫（28.3℃で管理。見学可。）から毎週発送します。", "来月から値段を下げる予定…と聞いています。"],
    ["“还有纸箱！”他喊道，“然后就关门。”", "经理说：“周一装车。绝不延误。”", "“纸箱干了吗？”云浦市的司机问道。", "自1944年以来，公司一直经营纸箱……从未中断。"],
]


@pytest.mark.parametrize("sentences", CASES + UNSPACED)
def test_languages(model, sentences):
    for joint in ("",) if sentences in UNSPACED else (" ", "\n", "  ", "\r\n"):
        text = joint.join(sentences)
        assert [text[a:b] for a, b in model.units(text)] == sentences


def test_layout(model):
    text = "  Heading of a page \r\n \r\n1. First item\n\n- 45 cases, Fresh\n\u3000\nOne line\nbroken. Next one.\n\n\n"
    assert [text[a:b] for a, b in model.units(text)] == ["Heading of a page", "1. First item", "- 45 cases, Fresh", "One line\nbroken.", "Next one."]
    assert model.units("") == model.units(" \n\r\n\u3000") == []
    assert list(blocks("a\r\nb")) == [(0, 4)]


def test_odd_texts(model):
    for text in ["...", "!", '"', "((((", ")))", "“”", "😀. A", "A" * 100_000, "One. " * 20_000, '"' * 3001, "．｡！"]:
        units = model.units(text)
        assert "".join(text[a:b] for a, b in units).replace(" ", "") == "".join(text.split())
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in units)
    assert len(model.units("The road is shut. " * 20_000)) == 20_000
    assert [b - a for a, b in model.units("The road is shut.The tea is dry.")] == [17, 15]


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello there. 😀 It is dry.", 0), (1, "Hello there. 😀 It is dry.", 0), (2, None, 0), (3, " ", 0), (None, "x", 0)], "doc_id bigint, text string, start_char int")
    got = sorted((r.doc_id or -1, r.start_char, r.end_char) for r in split_sentences(df, "doc_id", "text").collect())
    assert got[0] == (-1, 0, 1) and got[1:] and got[1::2] == got[2::2]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_long_tokens_are_judged_like_short_ones():
    cut = SentenceModel.load()
    for word in ("harbour", "h" * 500 + "arbour"):
        text = f"We sailed to the {word}. The others waited there. They had tea at {'x' * 300}. It was late."
        assert [text[a:b].split()[0] for a, b in cut.units(text)] == ["We", "The", "They", "It"]
