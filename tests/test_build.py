"""The command line, end to end on made-up books."""

import json

from lexloom.__main__ import main
from lexloom.sources import files

OLD = """PART I. CHINOOK-ENGLISH.
A.
Alta, adv. Chinook, ALTA. Now; at present.
B.
Boat, n. English. A ship.
C.
Chuck, n. Nootka, CHAUK. Water; a river.
ENGLISH-CHINOOK.
"""
NEW = """A LEXICON
Al-ta, adv. (C) Now, the present time.
12
Chuck, n. (N) Water.
Moo-la, n. (F) A mill for sawing.
SUPPLEMENTAL VOCABULARY
Lum, (J) Rum.
PRONOUNCING VOCABULARY
"""


def test_build(spark, tmp_path, capsys):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/gibbs1863.txt").write_text(OLD)
    (tmp_path / "texts/shaw1909.txt").write_text(NEW)
    out = str(tmp_path / "out")
    assert main(["build", "--texts", str(tmp_path / "texts"), "--out", out, "--flagged", "shaw1909", "--least", "gibbs1863=3"]) == 0
    rows = {(r.headword, r.source_key): r for r in files.lexicon(spark, f"{out}/lexicon", "C").collect()}
    assert rows.keys() == {("alta", "gibbs1863"), ("boat", "gibbs1863"), ("chuck", "gibbs1863"), ("alta", "shaw1909"), ("chuck", "shaw1909"), ("moola", "shaw1909"), ("lum", "shaw1909")}
    assert {k: r.confidence for k, r in rows.items()} == {k: "A" if k[0] in ("alta", "chuck") else "B" for k in rows}
    r = rows["lum", "shaw1909"]
    assert (r.gloss_en, r.source_page, r.kamloops) == ("Rum", "12", True) and "section=supplemental" in r.notes and rows["alta", "gibbs1863"].pos == "adv"
    merged = {r.headword: r for r in files.tsv_columns(spark, f"{out}/lexicon_merged", ["headword", "n_sources", "sources", "gloss_en", "kamloops", "skeleton"]).collect()}
    assert tuple(merged["alta"])[1:] == ("2", "gibbs1863|shaw1909", "Now; at present | Now, the present time", "yes", "lt") and merged["boat"].kamloops == "no"
    capsys.readouterr()
    assert main(["build", "--texts", str(tmp_path / "texts"), "--out", out, "--least", "gibbs1863=4", "gill1909=1"]) == 2
    assert capsys.readouterr().out.endswith("gibbs1863: 3 rows, 4 expected\ngill1909: 0 rows, 1 expected\n")


def test_score_and_check(spark, tmp_path, capsys):
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": "1", "language": "chn", "tokens_rule": "A L T A"}, {"id": "2", "language": "en"})))
    (tmp_path / "keys.jsonl").write_text(json.dumps({"id": "1", "page": 3, "line": 1}))
    (tmp_path / "b_3_read.json").write_text(json.dumps({"item": "b", "leaf": 3, "words": [{"line": 1, "index": 1, "free_tokens": "A L T", "top5": [{"tokens": "A L T A"}], "free_best": {"tokens": "A L T"}}]}))
    (tmp_path / "words.tsv").write_text("headword\tbest_conf\ttokens\tsource\nalta\tA\t\tx\n")
    at = lambda name: str(tmp_path / name)
    assert main(["score", "--rows", at("rows.jsonl"), "--keys", at("keys.jsonl"), "--readings", at("b_3_read.json"), "--lexicon", at("words.tsv")]) == 0
    told = [x.strip() for x in capsys.readouterr().out.split("\n")[3].strip("|").split("|")]
    assert told == ["labelled", "1", "1", "1", "0", "0", "1", "1", "1", "0", "1", "4"]
    sign = {"id": "P", "category": "consonant", "unicode": ["U+1BC02"], "unicode_name": "x", "chinook_value": "p", "lejeune_latin": "p", "stroke": "s", "joining": "j", "confusables": [], "sources": ["key p. 1"], "confidence": "high", "notes": ""}
    (tmp_path / "signs.jsonl").write_text(json.dumps(sign))
    assert main(["check", "--signs", at("signs.jsonl"), "--sources", "key"]) == 0
    (tmp_path / "signs.jsonl").write_text(json.dumps(sign | {"confidence": "sure"}))
    assert main(["check", "--signs", at("signs.jsonl")]) == 1 and "bad confidence" in capsys.readouterr().out
