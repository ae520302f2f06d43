import random
import time

import pytest

from quillspark.llm import sentences as s

CASES = {
    "english": ["Dr. Smith mixed it at 82.9 dB.", "It fell to no. 59 in Nov. that year!", "Really?!", "In the U.K. the single sold.", "They stopped at 5 a.m.", "The tape fades out…", "J. R. Ray left."],
    "quotes": ["“Why me?” she asked, and went on.", "“Turn it up!” Karl shouted from the street.", "“It was over.”", '"No," she said, "not that."', "The end."],
    "brackets": ["(It was the only take.)", "He says (see p. 4, fig. 2) that it was cut.", "Wait... did it just come in?", "moth & kiln never played again."],
    "german": ["Die 55. Fassung klingt besser, d. h. wärmer.", "Nr. 34 ist leiser als Nr. 9.", "Warum?", "Es entstand am 3. Oktober in Bonn.", "„Noch einmal!“ rief Kurt.", "Das stammt u. a. von ihm."],
    "french": ["Où est-il ?", "« Encore ! » cria Max depuis la salle.", "« On ne garde rien. »", "M. Roux arrive à 21 h. 30 du soir.", "Une rivière, p. ex. la Vane, et un pont."],
    "spanish": ["¿Por qué no?, preguntó con calma.", "—¡Más alto! —gritó desde el patio.", "El Sr. Paz grabó la pág. 47 del folleto.", "¡Otra vez!", "En EE. UU. salió con otra portada."],
    "ukrainian": ["«Ще раз!» — вигукнув бас-гітарист.", "Вул. Зоряна, буд. 28 згадується двічі.", "Пісню записали 1987 р. у студії.", "Театр ім. Весни зачинено."],
    "arabic": ["قال د. فيلان إن الطبل كان بعيدا.", "من يغني الآن؟", "«مرة أخرى!» صاح العازف من الباب.", "ثم الصمت."],
    "hindi": ["डॉ. वेलन ने आवाज़ कम की।", '"एक बार और!" उसने पुकारा।', "कौन गा रहा है?"],
    "thai": ["ท่อนฮุกยาว131.1นาที", "ไม่มีใครจำทำนองได้เลย", "เงาหายไปไหน"],
}
TIGHT = {
    "chinese": ["“再来一遍！”她在门口喊道。", "谁还记得？", "他说：「不要把灯关掉。」", "第56轨长67.6分钟。", "鼓声停了……", "没有人。", "听上去像窗户……", "“河流！”他们一起唱。", "鼓声停了……", "24番。"],
    "japanese": ["「もう一回！」と彼女は叫んだ。", "「静かにして。」", "窓を返して！", "ドラムが止まった……", "庭だった。", "ように聞こえる……", "「庭！」とみんなで歌った。", "ように聞こえる……", "24番の歌詞。"],
}


def split(text):
    return [text[a:b] for a, b in s.units(text)]


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("space", [" ", "  ", "\n"])
def test_languages_with_spaces(name, space):
    assert split(space.join(CASES[name])) == CASES[name]


@pytest.mark.parametrize("name", TIGHT)
def test_languages_without_spaces(name):
    assert split("".join(TIGHT[name])) == TIGHT[name]


def test_all_in_one_order_or_another():
    rng = random.Random(4)
    parts = [x for k in ("english", "german", "french", "spanish", "ukrainian") for x in CASES[k]]
    for _ in range(30):
        rng.shuffle(parts)
        assert split(" ".join(parts)) == parts


def test_headings_and_blank_lines():
    assert split("﻿THE TITLE\n \nOne line\nand its rest.\r\n\r\nSide 4\n\n") == ["THE TITLE", "One line\nand its rest.", "Side 4"]


def test_lists_have_levels():
    text = "1. First thing. It goes on.\n2. Second\n- nested\n- again. More.\n3. Third"
    assert split(text) == ["1. First thing.", "It goes on.", "2. Second", "- nested", "- again.", "More.", "3. Third"]
    wrapped = "Es kam erst am\n3. Oktober und war\n12) davon."
    assert split(wrapped) == [wrapped]


def test_wrapped_lines_are_white_space():
    assert split("He said\nnothing.  She\nlaughed.") == ["He said\nnothing.", "She\nlaughed."]


@pytest.mark.parametrize("text", [None, "", " \n\t", "﻿", "​ \n"])
def test_no_units(text):
    assert s.units(text) == []


def test_places_are_code_points():
    text = "  🎸 plays. 太鼓。"
    assert s.units(text) == [(2, 10), (11, 14)]


def test_marks_without_partner():
    assert split("He said “no. She left. (And so on. Then.") == ["He said “no.", "She left.", "(And so on.", "Then."]


def test_units_are_in_order_and_lose_nothing():
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choices("aB. !?…“”„«»()\"\n\t1-—,。」「กñ", k=rng.randint(0, 60)))
        spans = s.units(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(c for c in text if not c.isspace()) == "".join(c for a, b in spans for c in text[a:b] if not c.isspace())


@pytest.mark.parametrize("text", ["(" * 100_000, "(" * 50_000 + ")" * 50_000, "“(" * 40_000 + "”" * 40_000, "am 3. " * 60_000, "a. " * 100_000, "word " * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    s.units(text)
    assert time.time() - began < 10


def test_table(spark):
    rows = [(1, "One. Two.", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (1, "One. Two.", "x", 1), (None, "No id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, unit string, end_pos int")
    got = [(r.doc_id, r.sentence, r.start_pos, r.end_pos, r.unit) for r in s.sentence_units(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 4, "One."), (1, 1, 5, 9, "Two.")] * 2 + [(None, 0, 0, 5, "No id")], key=str)
    assert s.sentence_units(df.limit(0)).count() == 0


def test_who_spoke_is_told_by_structure_whatever_the_distance():
    def split(t):
        return [t[a:b] for a, b in s.units(t)]

    for said in ("Anna barked at him.", "Anna quickly and loudly said no.", "Mary Ann Lee-Smith muttered.", "She " + "very " * 60 + "softly said so.", "The man outside shouted."):
        assert split(f'“Stop!” {said} Then.') == [f'“Stop!” {said}', "Then."]
    for new in ("The crowd went home.", "Nobody moved.", "Everything was packed.", "Anna was late.", "Niemand kannte die Melodie.", "She had said so."):
        assert split(f'“Stop!” {new}') == ["“Stop!”", new]


def test_bracket_after_a_quotation():
    text = 'I have played "When the Harvest Met!" (3 times, at least) and still miss it. End.'
    assert [text[a:b] for a, b in s.units(text)] == [text[:-5], "End."]
    text = '"Who?" (It was late.) Then.'
    assert [text[a:b] for a, b in s.units(text)] == ['"Who?"', "(It was late.)", "Then."]


def test_ordinals_behind_any_white_space():
    assert len(s.units("Er kam am" + " \n" * 1 + " " * 5000 + "3. Mai an.")) == 1
