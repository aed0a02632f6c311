import re

import pytest

from quarrystone.llm.sentences import SAMPLE, annotated, candidates, line_groups, sentence_units, trained, units
from tests.conftest import rows_of

# Held-out texts with their units, none of them in the sample.
CASES = [
    ["The boat left.", "It was late!", "Was it?"],
    ["Dr. Moreau paid 3.50 to Mrs. Finch, i.e. the owner.", "She left at 4 p.m.", "He stayed."],
    ["See fig. 7.", "Everything else is in sec. 12 of the book."],
    ["Read setup.md and main.swift first.", "Then rest."],
    ["“The lid is off. Close it,” said Una.", "Nobody moved."],
    ["(The lid was off. It rained.)", "So we ran."],
    ["Der Zug hat ca. 5 Minuten, d. h. wenig.", "Am 4. Oktober fuhr er."],
    ["Frau Prof. Weiss fragte: „Wo ist der Hut?“", "Alle lachten."],
    ["« Où est le chat ? » demanda Lou.", "Personne ne dort."],
    ["La Dra. Sanz preguntó: «¿Y la llave?»", "Nadie la tiene.", "¡Corre!"],
    ["И. В. Орлов ушёл в 7 ч. вечера.", "См. рис. 2.", "«Где шар?» — спросили дети."],
    ["وصل د. فؤاد صباحا.", "أين القطار؟"],
    ["डॉ. शर्मा घर गए।", "पृ. 9 देखो।"],
    ["ปลาว่ายน้ำ", "นกบินเวลา 6.15 น.ที่ท่าเรือ", "ม้าวิ่ง 4 ตัวเร็วมาก"],
]
JOINED = [["她说：“下雨了。回家！”然后就哭了。", "「谁在唱歌？」他问。", "等等……灯又亮了。"], ["「船はどこ？」と聞かれました。", "（もう来ません。）", "重さは2.5キロです。"]]


@pytest.mark.parametrize("case", CASES)
def test_held_out(case):
    text = " ".join(case)
    assert [text[a:b] for a, b in units(text, trained())] == case


@pytest.mark.parametrize("case", JOINED)
def test_held_out_without_blanks(case):
    text = "".join(case)
    assert [text[a:b] for a, b in units(text, trained())] == case


# Running text in many languages, written for this test alone; a bar stands where a unit ends.
HELD_OUT = """
The committee met on Tuesday.|Nobody had read the draft.|It was sent back to Lt. Okafor, who signed it.
Water boils at 99.6 degrees in Davos.|That is lower than at sea level.|Pressure matters.
The firm Hartmann Bros. was sold in 1931.|Its owner moved to Lisbon.
The U.S. Senate voted at noon.|The bill failed by 3.5 points.
She asked, “Have you seen my umbrella?”|He shook his head.
Visit www.example.org for details.|The office opens at 9.30 on weekdays.
“Stop the engine,” shouted the captain.|The crew obeyed at once.
What a view!|Can you see the lighthouse?|It was built by J. R. Mortimer.
The parcel weighs 2.4 kg.|Postage is extra.|Ask Sgt. Pell for a receipt.
He lives on St. Olaf's Square.|His sister lives nearby.
Der Bericht umfasst 4.000 Seiten.|Niemand hat ihn gelesen.|Dr. Vogt war am 12. Mai krank.
Die Brücke ist z. B. im Winter gesperrt.|Autos fahren dann über den Hafen.
„Kommst du mit?“, fragte Lena.|Er nickte nur.
Le musée ferme à 18 h.|M. Garnier garde les clés.|Où sont les billets ?
« Asseyez-vous », dit le juge.|La salle devint silencieuse.
La reunión empezó tarde.|El Sr. Quiroga no vino.|¿Quién tiene el acta?
¡Qué calor!|Abre la ventana.|El termómetro marca 38.5 grados.
Поезд ушёл в 7.15 утра.|Мы опоздали.|Где начальник станции?
Книга вышла в 1904 г. в Казани.|Её давно нет в продаже.
وصل القطار متأخرا.|أين المسافرون؟|لا أحد يعرف!
بارش ہو رہی ہے۔|لوگ گھر چلے گئے۔|کیا آپ آئیں گے؟
ट्रेन देर से आई।|यात्री कहाँ हैं?|सब घर चले गए।
火车晚点了。|乘客在哪里？|没有人知道！
她问：“你吃饭了吗？”|他摇了摇头。
電車が遅れています。|乗客はどこですか？|誰も知りません。
「もう帰ろう。」と父が言った。|外は雪だった。
บ้านหลังนี้เก่ามาก|ไม่มีใครอยู่|ประตูเปิดอยู่
ລົດໄຟມາຊ້າ|ບໍ່ມີໃຜຮູ້|ຝົນຕົກແລ້ວ
រថភ្លើងមកយឺត។|គ្មាននរណាដឹងទេ។|ភ្លៀងធ្លាក់ហើយ។
ရထားနောက်ကျသည်။|ဘယ်သူမှမသိပါ။|မိုးရွာနေသည်။
ባቡሩ ዘገየ።|ማንም አያውቅም።|ዝናብ ይዘንባል።
Գնացքը ուշացավ։|Ոչ ոք չգիտի։|Անձրև է գալիս։
The lecture starts at 6 p.m.|Bring a pen.|Prof. Ilves will speak on fig. 4 of her book.
In Sept. 1998 the mill closed.|In Oct. 1999 it burned down.
Corp. Daly and Pvt. Osei kept watch.|The night was calm.
Mix flour, eggs, milk, etc. in a bowl.|Wait ten minutes.
The file config.yaml is missing.|Run setup.sh again.|It takes 1.5 minutes.
(See the appendix.)|The table lists all ships.
We drove from Mt. Baldy to Ft. Worth.|The trip took two days.
Mrs. Adeyemi vs. the council was in the news.|She won.
""".strip().split("\n")


def test_held_out_precision_and_recall():
    both = found = right = 0
    for line in HELD_OUT:
        parts = line.split("|")
        text = ("" if re.search("[぀-ヿ㐀-鿿]", line) else " ").join(parts)
        gold, at = set(), 0
        for p in parts:
            gold.add((text.index(p, at), text.index(p, at) + len(p)))
            at = text.index(p, at) + len(p)
        got = set(units(text, trained()))
        both, found, right = both + len(gold & got), found + len(got), right + len(gold)
    assert both / found >= 0.9 and both / right >= 0.9


@pytest.mark.parametrize("case", [["The U.S. Army came.", "Sgt. Hill and Col. Ray left."], ["Foo Corp. in Paris grew."], ["یہ کتاب ہے۔", "وہ آیا۔"], ["ሰላም ነው።", "እሱ መጣ።"], ["ຂ້ອຍໄປຕະຫຼາດ", "ລາວຢູ່ເຮືອນ"], ["What‼", "He ran."]])
def test_other_scripts_and_words_cut_short(case):
    text = " ".join(case)
    assert [text[a:b] for a, b in units(text, trained())] == case


def test_layout():
    text = "# Head 1.2\n\nFirst one. Second\nline.\n \n- item seven. more\n- item b\n3. third\n[10:20] Ann: (It ran. Far.) Hi.\n[10:21] Bo: no mark"
    got = [text[a:b] for a, b in units(text, trained())]
    assert got == ["# Head 1.2", "First one.", "Second\nline.", "- item seven.", "more", "- item b", "3. third", "[10:20] Ann: (It ran. Far.)", "Hi.", "[10:21] Bo: no mark"]
    assert list(line_groups("")) == [] and list(line_groups(" \n\n")) == []


def test_units_partition_what_is_not_blank():
    for sample in SAMPLE:
        text = annotated(sample)[0]
        spans = units(text, trained())
        assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "")


def test_model_fits_the_sample():
    right = wrong = 0
    for sample in SAMPLE:
        text, ends = annotated(sample)
        cs = candidates(text, 0, len(text))
        for c, t in zip(cs, trained().decode(cs), strict=True):
            right, wrong = right + (t == int(c.end in ends)), wrong + (t != int(c.end in ends))
    assert wrong / (right + wrong) < 0.01
    assert trained().weights == trained.__wrapped__().weights


def test_thai_digits_are_no_letters():
    text = "มีแมว \u0e51\u0e52 ตัว นกบิน"
    assert [text[a:b] for a, b in units(text, trained())] == ["มีแมว \u0e51\u0e52 ตัว", "นกบิน"]


def test_unclosed_marks_enclose_nothing():
    text = "He said “go. Then he left. (And so. It ended"
    assert [text[a:b] for a, b in units(text, trained())] == ["He said “go.", "Then he left.", "(And so.", "It ended"]


def test_many_marks_take_no_long_time():
    import time

    began = time.perf_counter()
    units("“" * 50_000 + ")" * 50_000 + "(" * 50_000 + "a. B", trained())
    assert time.perf_counter() - began < 5


def test_frame(frame):
    schema = "doc_id long, text string, lang string, unit_no string, start_char int"
    rows = [(1, "One. Two.", "xx", "", 0), (2, None, None, None, None), (3, "", "", "", 0), (4, " \n ", "", "", 0), (None, "No id", "", "", 0), (1, "One. Two.", "", "", 0), (5, "ab. " * 20_000, "", "", 0)]
    got = sentence_units(frame(rows, schema))
    assert rows_of(got.where("doc_id = 1")) == [(1, 0, 0, 4), (1, 0, 0, 4), (1, 1, 5, 9), (1, 1, 5, 9)]
    assert rows_of(got.where("doc_id IS NULL")) == [(None, 0, 0, 5)]
    assert got.where("doc_id IN (2, 3, 4)").count() == 0 and got.where("doc_id = 5").count() > 0
    assert [r.text for r in sentence_units(frame(rows[:1], schema), with_text=True).orderBy("unit_no").collect()] == ["One.", "Two."]
    assert sentence_units(frame([], schema)).count() == 0
