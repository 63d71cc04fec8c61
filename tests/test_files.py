import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.sources import catalogue, files, writers
from lexloom.streaming import events


def test_word_list(spark, tmp_path):
    path = tmp_path / "lexicon.tsv"
    path.write_text('headword\tvariants\tgloss_en\tgloss_fr\tpos\tsource_key\tsource_page\tkamloops\tnotes\nb\tB|"b\t"quoted\t\tn\ts1\t1\tyes\tconf=B\na\t\tx\t\t\ts2\t\tno\tconf=C\nc\t\ty\t\t\ts2\t\tno\t\n')
    rows = {r.headword: r for r in files.lexicon(spark, str(path)).collect()}
    assert rows.keys() == {"b", "c"} and rows["b"].variants == ["B", '"b'] and rows["b"].gloss_en == '"quoted' and rows["b"].kamloops and rows["c"].confidence == "A"
    assert [r.headword for r in files.lexicon(spark, str(path), "C", ["s2"]).orderBy("headword").collect()] == ["a", "c"]
    assert files.tsv_columns(spark, str(path), ["headword", "tokens"]).where("headword = 'a'").first().tokens == ""


def test_json_and_text(spark, tmp_path):
    (tmp_path / "gt.jsonl").write_text('{"id": "1", "language": "chn", "bbox_latin": [1, 2, 3, 4], "frame": {"deskew_deg": 0.5}}\n\n{"id": "2"}\n')
    rows = files.json_lines(spark, str(tmp_path / "gt.jsonl")).orderBy("id").collect()
    assert [r.id for r in rows] == ["1", "2"] and rows[0].frame.deskew_deg == 0.5
    (tmp_path / "b_3_read.json").write_text(json.dumps({"item": "b", "leaf": 3, "words": [{"line": 1, "index": 1, "top5": [{"headword": "x", "score": 1.5}], "boxes": ["1.1"]}, {"line": 1, "index": 2}]}))
    words = files.readings(spark, str(tmp_path / "b_3_read.json")).select("*", *files.book_and_leaf(F.col("file"))).orderBy("index").collect()
    assert len(words) == 2 and words[0].top5[0].score == 1.5 and words[0].boxes == ["1.1"] and words[0].book == "b"
    (tmp_path / "text.txt").write_bytes(b"one\r\ntwo\fthree")
    assert [(r.line_no, r.line) for r in files.text_lines(spark, str(tmp_path / "text.txt")).orderBy("line_no").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "page.xml").write_text('<d><OBJECT width="100" height="50"><LINE/><WORD coords="1,20,9,10">Hi </WORD><WORD coords="10,20,19,11">you</WORD></OBJECT></d>')
    boxes = files.word_boxes(spark, str(tmp_path / "page.xml")).orderBy("word_no").collect()
    assert {r.page for r in boxes} == {0} and [(r.text, r.x0, r.ytop, r.x1, r.ybottom, r.page_w) for r in boxes] == [("Hi", 1, 10, 9, 20, 100), ("you", 10, 11, 19, 20, 100)]
    (tmp_path / "names.txt").write_text("@\tignored\n1BC00\tSIGN H\n\t* a note\n\t* more\n1BC01\tSIGN X\n")
    names = {r.code: r for r in files.names_list(files.text_lines(spark, str(tmp_path / "names.txt"))).collect()}
    assert names[0x1BC00].name == "SIGN H" and names[0x1BC00].notes == ["* a note", "* more"] and names[0x1BC01].notes == []
    pages = spark.createDataFrame([('<span class="keycap x">\U0001bc02a</span><i data-string="&#x1BC05;&#x41;">',)], "html string")
    assert sorted(r.code for r in files.key_codes(pages, "html").collect()) == [0x1BC02, 0x1BC05]


def test_lines_and_pages_of_files_in_blocks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, n in (("a.txt", 4_000), ("b.txt", 10)):
        (tmp_path / "t" / name).write_text("".join(f"{name} line {i}\r\n" if i % 7 else f"{name} line {i}\f" for i in range(n)))
    (tmp_path / "p.xml").write_text("<d>" + "".join(f'<OBJECT width="{i}" height="1"><WORD coords="1,2,3,4">w</WORD></OBJECT>\n' for i in range(500)) + "</d>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        lines = files.text_lines(spark, str(tmp_path / "t"))
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 1
        rows = lines.collect()
        for name, n in (("a.txt", 4_000), ("b.txt", 10)):
            own = sorted((r.line_no, r.line) for r in rows if r.file.endswith(name))
            assert own == [(i, f"{name} line {i}") for i in range(n)]
        pages = files.word_boxes(spark, str(tmp_path / "p.xml")).collect()
        assert sorted((r.page, r.page_w) for r in pages) == [(i, i) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_yaml(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text(yaml.safe_dump({"tokens": {"P": {"latin": ["p"], "sign": "P"}, "DH": {"latin": []}}}))
    rows = {r.token: r for r in files.yaml_table(spark, str(tmp_path / "t.yaml"), "tokens", "token string, sign string, latin array<string>").collect()}
    assert rows["P"].latin == ["p"] and rows["DH"].sign is None


def test_archives_and_crops(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p_2.txt", "two")
        z.writestr("p_1.txt", "one")
        z.writestr("other", "x")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("q.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"q"))
    rows = files.archive_members(spark, str(tmp_path / "a.*"), ".txt").orderBy("name").collect()
    assert [(r.leaf, r.name, bytes(r.content)) for r in rows] == [(0, "p_1.txt", b"one"), (1, "p_2.txt", b"two"), (0, "q.txt", b"q")]
    np.savez_compressed(tmp_path / "b_1_words.npz", flat=np.arange(10, dtype=np.uint8), shapes=np.array([[2, 3], [1, 4]]), boxes=np.array([[0, 0, 3, 2], [1, 1, 5, 2]]), line=np.array([1, 1]), index=np.array([1, 2]))
    crops = files.packed_crops(spark, str(tmp_path / "b_1_words.npz")).orderBy("idx").collect()
    assert [(r.h, r.w, bytes(r.pixels)) for r in crops] == [(2, 3, bytes(range(6))), (1, 4, bytes(range(6, 10)))]
    found = files.digests(spark, str(tmp_path / "a.zip"))
    ledger = spark.createDataFrame([("a.zip", found.first().md5), ("gone.zip", "x")], "file string, md5 string")
    assert [r.file for r in files.unverified(ledger, found).collect()] == ["gone.zip"]


def test_selection_and_specs(spark, tmp_path):
    (tmp_path / "i1.json").write_text(json.dumps({"identifier": "i1", "files": [{"name": "i1_jp2.zip"}, {"name": "i1_djvu.txt"}, {"name": "history/x_djvu.txt"}]}))
    (tmp_path / "i2.json").write_text(json.dumps({"identifier": "i2", "files": [{"name": "i2_orig_jp2.tar"}, {"name": "i2_jp2.zip"}]}))
    listed = catalogue.items(spark, str(tmp_path / "*.json"))
    assert sorted(r.name for r in files.select_files(listed, ["orig", "text"]).collect()) == ["i1_djvu.txt", "i1_jp2.zip", "i2_orig_jp2.tar"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(files.number_ranges(F.lit("15-18,130"))) == [15, 16, 17, 18, 130]
    assert one(files.settings(F.lit("A=0.5,B=2"))) == {"A": 0.5, "B": 2.0}


def test_writers(spark, tmp_path):
    sources = spark.createDataFrame([("s1", 'A "title"', "x", 1900), ("s2", "T", None, None)], "key string, title string, author string, year int")
    writers.catalogue(spark, sources, spark.createDataFrame([("s1", 3)], "key string, n int"), str(tmp_path / "yaml"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "yaml")).collect())
    assert '"A \\"title\\""' in text and "n_rows: 3" in text and "n_rows: 0" in text
    for i in range(2):
        writers.append_lines(spark.createDataFrame([(i,)], "i int"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2
    rows = spark.createDataFrame([("p", None, 1), ("p", 2, 2), ("p", 1, 3)], "page string, seq int, ord int")
    assert [(r.ord, r.line) for r in writers.pages_of_rows(rows, ["page"], ["seq"]).orderBy("line").collect()] == [(1, 1), (3, 2), (2, 3)]


def test_streams(spark, sf_dir, tmp_path):
    stream = events.read_files(spark, sf_dir, "events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").withColumn("at", F.col("ts").cast("timestamp"))
    sliding = events.run_to_end(events.window_counts(stream, "at", [], "2 days", "1 day", value="value"), str(tmp_path / "w"))
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert sliding.agg(F.sum("n")).first()[0] == 2 * n
    doubled = lambda batch: batch.select("user_id", "event_id")
    for _ in range(2):
        events.incremental(stream, "event_id", str(tmp_path / "i"), doubled)
    assert spark.read.parquet(str(tmp_path / "i/done")).count() == n
    assert events.run_to_end(events.distinct_within(stream, "at", ["user_id"], "60 days"), str(tmp_path / "d"), "append").count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def test_command_line(spark, tmp_path, capsys):
    from lexloom.__main__ import lookup, main

    path = tmp_path / "lexicon.tsv"
    path.write_text("headword\tvariants\tgloss_en\tgloss_fr\tpos\tsource_key\tsource_page\tkamloops\tnotes\nkamooks\tcomox|kamuks\tdog\t\tn\ts1\t1\tyes\tconf=A\nmoola\t\tmill\t\tn\ts2\t\tno\tconf=B\n")
    rows = [(r.q, r.headword, r.distance, r.glosses) for r in lookup(spark, ["Comox", "mola", "zzzzzz"], str(path)).collect()]
    assert rows == [("Comox", "kamooks", 0, ["dog"]), ("mola", "moola", 1, ["mill"])]
    main(["spell", "kamooks"])
    assert "K A M OO K S" in capsys.readouterr().out


def test_sql_functions(spark):
    from lexloom.functions import registration

    registration.register(spark)
    for text, k, expected in (("abc", 2, {"abc", "ab", "ac", "bc", "a", "b", "c"}), ("aa", 1, {"aa", "a"}), ("a", 2, {"a", ""}), ("", 2, {""}), ("abc", 0, {"abc"})):
        got = spark.sql(f"SELECT deletion_variants('{text}', {k}) AS v").first().v
        assert got[0] == text and len(got) == len(set(got)) and set(got) == expected
    row = spark.sql("SELECT align_tokens(array('a', 'b'), array('a')) AS x, deletion_variants('ab', 1) AS v").first()
    assert [tuple(s) for s in row.x] == [("a", "a"), ("b", None)] and sorted(row.v) == ["a", "ab", "b"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM cuts('abc')").collect()] == [(1, "a", "bc"), (2, "ab", "c")]


def test_word_list_build(spark):
    from lexloom.operators import wordlist

    entries = spark.createDataFrame([("a", "A"), ("c", "C")], "headword string, best_conf string")
    rows = spark.createDataFrame([("chn", "S T", "st", "x", 1), ("chn", "S T", "s.t", "x", 0), ("chn", "", "n", "x", 2), ("en", "A", "a", "y", 3)], "language string, tokens_rule string, latin string, source string, ord int")
    out = {tuple(r) for r in wordlist.build(entries, rows, ["x"], "chn").collect()}
    assert out == {("a", "A", "", "lexicon"), ("s.t", "A", "S T", "x")}
    with pytest.raises(ValueError, match="y"):
        wordlist.build(entries, rows, ["x", "y"], "chn")


@pytest.mark.parametrize("values", [[-0.34645670652389526, 0.29921257495880127, 0.3858267664909363, 0.0], [-2.0, 3.0, float("nan"), float("inf"), float("-inf"), 0.0, 0.5, -0.5]])
def test_pixels_are_reckoned_in_single_precision_as_in_sql(spark, tmp_path, values):
    import duckdb

    from lexloom.plans import ORACLE_SQL, QUERIES

    # in double precision -0.346..., 0.299... and 0.385... are a pixel value less
    rows = [(1, values * (64 // len(values)), 0), (2, [0.0] * 63 + values[:1], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["packed_crop_round_trip"](spark, str(tmp_path)).orderBy("label").collect()]
    assert got == sorted(con.sql(ORACLE_SQL["packed_crop_round_trip"]).fetchall())
