"""The books' layouts on made-up pages, and the rows of a lexicon."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import entries as D
from lexloom.operators import dictionaries as B


def parsed(spark, layout, text, **options):
    rows = [(v, i, line) for v in ("one", "two") for i, line in enumerate(text.strip("\n").split("\n"))]
    found = B.parse(spark.createDataFrame(rows, "volume string, line_no int, line string"), layout, **options)
    assert found.columns == B.RECORD
    rows = found.orderBy("ord").collect()
    half = len(rows) // 2
    assert [r[2:] for r in rows[:half]] == [r[2:] for r in rows[half:]]  # both volumes give the same
    return rows[:half]


def layout(name):
    return next(x for x in B.LAYOUTS if x.source == name)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_book_of_1863(spark):
    text = """
preface, n. not here
PART I. CHINOOK—ENGLISH.
A.
Ab'-ba, adv. Chinook, AMPA. Well then; how
so. Ex. Abba, see.
An-ah, interj. Ah! oh! of pain, dis-
pleasure, or sorrow.
2  DICTIONARY OF THE CHINOOK JARGON.
Ats, or Ots, n. Chinook, idem. A sister younger than the speaker.
Zinc, Chinook. out of its place
B.
Be-be, «. French. A word used towards children. It means a kiss. Third.
Bed, See Bit.
PART I. CHINOOK ENGLISH. 4
Bit, n. v. English. A dime.
nothing that starts one
ENGLISH-CHINOOK.
After, n. Not here.
"""
    rows = parsed(spark, layout("gibbs1863"), text)
    assert [(r.head, r.pos, r.gloss_en, r.page) for r in rows] == [
        ("Ab'-ba", "adv", "Well then; how so", "1"),
        ("An-ah", "interj", "Ah! oh! of pain, displeasure, or sorrow", "1"),
        ("Ats", "n", "A sister younger than the speaker", "2"),
        ("Be-be", "", "A word used towards children", "2"),
        ("Bed", "", "", "2"),
        ("Bit", "n,v", "A dime. nothing that starts one", "4"),
    ]
    assert rows[0].notes == {"pos_ocr": "", "etym": "Chinook, AMPA"} and rows[2].variants == ["Ats", "Ots"] and rows[2].notes["etym"] == "Chinook, idem"
    assert rows[3].notes == {"pos_ocr": "garbled", "etym": "French"} and rows[4].notes == {"xref": "Bit", "type": "crossref"}


def test_book_of_1889(spark):
    text = """
PART I. CHINOOK-ENGLISH.
Aha, adv. Yes.
Al-ta A present time; now.
Zum, n. Out of order.
See. Not a head.
Chuck, or Tsuk. Water; a river or stream.
PART II. ENGLISH-CHINOOK.
"""
    rows = parsed(spark, layout("hibben1889"), text)
    assert [(r.head, r.variants, r.pos, r.gloss_en, r.page) for r in rows] == [
        ("Aha", ["Aha"], "adv", "Yes", "3"),
        ("Al-ta", ["Al-ta"], "", "A present time; now", "3"),
        ("Chuck", ["Chuck", "Tsuk"], "", "Water; a river or stream", "3"),
    ]


def test_book_of_1909(spark):
    text = """
A LEXICON
Ahn-kut-te, or An-kut-tie, adv. (C) (Clatsop, ANKUTTI.) Formerly; before now. Example: Ahnkutte.
7
Al-ki, adv. Chihalis, Alki.) In the fu-
ture. Later.
THE CHINOOK JARGON
Chuck. (See Salt-chuck)
SUPPLEMENTAL VOCABULARY
Less Familiar Words
Cal-li-peen, or Calipeen, (F). A rifle; a kind
of gun.
9
Snass, (Wasco word) Rain.
Lum, (J) Rum.
PRONOUNCING VOCABULARY
"""
    rows = parsed(spark, layout("shaw1909"), text)
    assert [(r.head, r.pos, r.gloss_en, r.page, r.notes.get("origin"), r.notes.get("etym")) for r in rows] == [
        ("Ahn-kut-te", "adv", "Formerly; before now", "", "Chinook", "Clatsop, ANKUTTI"),
        ("Al-ki", "adv", "In the future. Later", "7", "", "Chihalis, Alki"),
        ("Chuck", "", "", "7", None, None),
    ]
    assert rows[2].notes == {"xref": "Salt-chuck", "type": "crossref", "section": "lexicon"}
    more = parsed(spark, B.SUPPLEMENT, text, first_page=7)
    assert [(r.head, r.variants, r.gloss_en, r.page, r.notes["origin"]) for r in more] == [
        ("Cal-li-peen", ["Cal-li-peen", "Calipeen"], "A rifle; a kind of gun", "7", "French"),
        ("Snass", ["Snass"], "Rain", "9", "Wasco"),
        ("Lum", ["Lum"], "Rum", "9", "Jargon"),
    ]


def test_tagged_books(spark):
    text = """
CHINOOK ENGLISH
CHINOOK DICTIONARY. 48
Al4h, or more commonly Alah (J). Surprise. "Alah, my
friend."
Boat (E). A ship of any kind that goes upon water. Second sentence.
50
By by (J). After a time.
Cole (E.). Cold.
See Boat.
C-stone (J). See Stone.
CONVERSATIONAL PHRASES
"""
    rows = parsed(spark, layout("gill1909"), text)
    assert [(r.head, r.variants, r.gloss_en, r.page, r.notes["origin"]) for r in rows] == [
        ("Alah", ["Alah", "Al4h", "Alah"], "Surprise", "48", "Jargon"),
        ("Boat", ["Boat"], "A ship of any kind that goes upon water", "48", "English"),
        ("Cole", ["Cole"], "Cold. See Boat", "50", "English"),
        ("C-stone", ["C-stone"], "", "50", "Jargon"),
    ]
    assert rows[0].notes["ocr"] and rows[3].notes["xref"] == "Stone" and rows[3].notes["type"] == "crossref"
    old = parsed(spark, layout("gill1887"), text.replace("CHINOOK ENGLISH", "HINOOK ENGLISH").replace("CONVERSATIONAL PHRASES", "Yoot-skut. Short"))
    assert [(r.head, r.notes["type"]) for r in old] == [("Alah", ""), ("Boat", ""), ("By by", "phrase"), ("Cole", ""), ("C-stone", "crossref")]


def test_parts_of_entries(spark):
    assert one(spark, D.gloss(F.lit("A dog. Ex. My dog."))) == "A dog" and one(spark, D.gloss(F.lit("Same as Fr. chien in all its uses. Second one. Third"))) == "Same as Fr. chien in all its uses"
    assert one(spark, D.gloss(F.lit("One thing, i. e. another, e.g. this; cf. that. Two"))) == "One thing, i. e. another, e.g. this; cf. that"
    assert one(spark, D.closing(F.lit("(a (b) c) d"))) == 9 and one(spark, D.closing(F.lit("(a"))) is None and one(spark, D.closing(F.lit("a)"))) is None
    assert one(spark, D.repaired(F.lit("K4m0oks"))) == "Kamooks" and one(spark, D.repaired(F.lit("téSn9e" + "x" * 2_000 + "4"))) == "téange" + "x" * 2_000 + "a"
    for text, expected in {
        "Chinook, OPITSAKH. A knife.": ("Chinook, OPITSAKH.", "A knife."),
        "French, COSHO. Chinook. A hog. Chinook. Pork": ("French, COSHO. Chinook.", "A hog. Chinook. Pork"),
        "Can. French, COSHO. A hog": ("", "Can. French, COSHO. A hog"),
        "(Hale.) Quaere. To do": ("(Hale.) Quaere.", "To do"),
        "A knife.": ("", "A knife."),
        "": ("", ""),
        "Chinook " + "very " * 40 + "LONG. A knife": ("", "Chinook " + "very " * 40 + "LONG. A knife"),
    }.items():
        assert tuple(one(spark, D.etymology(F.lit(text)))) == expected


def test_rows_by_source(spark):
    rows = [
        ("s", 1, "Boat.", ["Bote", "boat"], "A ship", "", "n", "", {"etym": "", "type": "x"}),
        ("s", 2, "BOAT", ["BOAT", "***"], "a SHIP", "bateau", "n,v", "7", {"etym": "English"}),
        ("s", 3, "boat", [], "A vessel", "", "", "8", {"more": None}),
        ("t", 4, "“Boat”", [], "", "", "adj", "9", {}),
        ("s", 5, "x", [], "too short", "", "", "", {}),
        ("s", 6, "a b c d e", [], "too many words", "", "", "", {}),
        ("s", 7, "w" * 45, [], "too long", "", "", "", {}),
        ("s", 8, "123", [], "no letters", "", "", "", {}),
    ]
    df = spark.createDataFrame(rows, "source string, ord int, head string, variants array<string>, gloss_en string, gloss_fr string, pos string, page string, notes map<string,string>")
    out = {(r.source, r.headword): r for r in B.rows_by_source(df).collect()}
    assert out.keys() == {("s", "boat"), ("t", "boat")}
    r = out["s", "boat"]
    assert (r.variants, r.gloss_en, r.gloss_fr, r.pos, r.page, r.n_raw) == (["Boat", "Bote", "boat", "BOAT"], "A ship | A vessel", "bateau", "n,v", "7", 3)
    assert r.notes == {"etym": "", "type": "x", "more": ""} and out["t", "boat"].variants == ["Boat"]
    assert B.rows_by_source(df.limit(0)).collect() == []


def test_merged_rows(spark):
    rows = [
        ("b", "boat", ["Boat"], "A ship | a vessel", "bateau", "n", "B"),
        ("a", "boat", ["Bote", "Boat"], "A SHIP", "", "v,n", "A"),
        ("c", "boat", ["Boot"], "unseen", "vu", "adj", "C"),
        ("c", "only", ["Only"], "unseen", "", "adj", "C"),
        ("a", "many", [f"V{i:02d}" for i in range(20)], " | ".join(f"g{i}" for i in range(9)), " | ".join(f"f{i}" for i in range(5)), "", "A"),
    ]
    df = spark.createDataFrame(rows, "source string, headword string, variants array<string>, gloss_en string, gloss_fr string, pos string, conf string")
    out = {r.headword: r for r in B.merged(df, {"a": 0, "b": 1, "c": 2}, ["c"], {"variants": 14, "gloss_en": 6, "gloss_fr": 3}).collect()}
    r = out["boat"]
    assert tuple(r[1:]) == (2, "a|b", False, "A", "Bote|Boat|Boot", "A SHIP | a vessel", "bateau", "v,n", "unvalidated_candidates_in=c; flagged_candidate_only")
    assert tuple(out["only"][1:5]) == (0, "", False, "C") and out["only"].gloss_en == "" and out["only"].variants == "Only"
    assert out["many"].variants.count("|") == 13 and out["many"].gloss_en == "g0 | g1 | g2 | g3 | g4 | g5" and out["many"].gloss_fr == "f0 | f1 | f2"


def test_layouts_start_where_they_should(spark):
    cases = {
        "start_1863": ["Boat, n. x", "Boat, or Bote, adv. x", "Boat, 11. Chinook x", "Boat, English x", "Boat, See x"],
        "start_1889": ["Boat, n. x", "Boat. x", "Bo-at A x"],
        "start_1909": ["Boat, n. x", "Boat n. adv. x", "Boat. (See x)"],
    }
    bad = ["boat, n. x", "", "Boat", "Ex. x", "Boat, word x", "A, Chinook"]
    for name, good in cases.items():
        rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad[:4]], "t string, ok boolean")
        assert [r.t for r in rows.where(~(getattr(D, name)(F.col("t")).isNotNull().eqNullSafe(F.col("ok")))).collect()] == [], name


@pytest.mark.parametrize("layout_", [B.LAYOUTS[0], B.LAYOUTS[3]], ids=lambda x: x.source)
def test_text_without_the_section(spark, layout_):
    df = spark.createDataFrame([("v", 0, "Boat, n. x"), ("v", 1, None)], "volume string, line_no int, line string")
    assert B.parse(df, layout_).collect() == [] and B.parse(df.limit(0), layout_).collect() == []
