import pytest
import os

from pyspark.sql import functions as F

from talkloom.functions.names import assign_names, replace_untranscribed_names
from talkloom.plans import composites as Q
from talkloom.sources import chat as src, tables

FILE = """@UTF8
@Begin
@Participants:\tCHI Anna Target_Child, MOT Eva Mother
@ID:\teng|X|CHI|2;06.15|||
*CHI:\tme goed [: went] [*] home . \x151000_2000\x15
%mor:\tpro|me v|go n|home .
%gra:\t1|2|SUBJ 2|0|ROOT 3|2|JCT
%err:\tgoed = went
*MOT:\tyou went
\thome ?
*CHI:\tyes Mwww .
@End
"""


def test_chat_files(spark, tmp_path):
    os.makedirs(tmp_path / "Corp" / "Anna")
    (tmp_path / "Corp" / "Anna" / "020615.cha").write_text(FILE)
    (tmp_path / "Corp" / "Anna" / "empty.cha").write_text("@UTF8\n@End\n")
    d = src.read_chat(spark, f"{tmp_path}/*/*/*.cha")
    rows = d.orderBy("utterance_id").collect()
    assert [r["speaker_code"] for r in rows] == ["CHI", "MOT", "CHI"] and rows[1]["transcript_raw"] == "you went home ?"
    r = rows[0]
    assert (r["start_time"], r["end_time"], r["age"], r["child_name"], r["corpus"], r["error"], r["pos"][:2], r["gra"][0]["rel"]) == (1000, 2000, 30, "Corp_Anna", "Corp", "goed = went", ["pro", "v"], "SUBJ")
    p = Q.preprocess(d, names=[("Mary", "girl"), ("Max", "boy")]).orderBy("row_id").collect()
    assert [x["transcript_clean"] for x in p] == ["me goed home.", "you went home?", "yes Mary."]
    assert Q.annotate_errors(Q.preprocess(d)).where("speaker_code = 'CHI' and not is_grammatical").count() == 1


def test_names():
    got = assign_names(["Mwww", "Jwww", "Mrs_www", "wwww"], [("Mary", "girl"), ("John", "boy")])
    assert got == {"Jwww": "John", "Mrs_www": "Mrs Mary", "Mwww": "Mary"}


def test_names_per_corpus(spark):
    d = spark.createDataFrame([("a", "hi Mwww and Jwww"), ("b", "no name"), ("b", None)], "corpus string, transcript_raw string")
    got = sorted(str(r["transcript_raw"]) for r in replace_untranscribed_names(d, [("Mary", "girl"), ("John", "boy")]).collect())
    assert got == ["None", "hi Mary and John", "no name"]


def test_other_layouts(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("the dog run .\nthe dog runs .\n")
    assert [(r["is_grammatical"], r["transcript_clean"]) for r in src.read_minimal_pairs(spark, str(tmp_path / "pairs.txt")).orderBy("line_no").collect()] == [(0, "the dog run ."), (1, "the dog runs .")]
    (tmp_path / "x.cex").write_text("*CHI: me go .\n*MOT: yes .\n%cof: $ERR = synt:subj; $ERR = other\n\n*CHI: ok .\n*MOT: no .\n%cof: $ERR = 0\n\n*CHI: none .\n*MOT: no .\n%cof: nothing\n\n")
    got = src.read_error_blocks(spark, str(tmp_path / "x.cex")).orderBy("transcript_raw").collect()
    assert [(r["transcript_clean"], r["labels"], r["is_grammatical"]) for r in got] == [("me go.", "subject, other", False), ("ok.", None, True)]
    (tmp_path / "t.csv").write_text("id,tokens,text\n1,\"['a', None, 'b']\",\"x\ny\"\n")
    r = src.read_table_csv(spark, str(tmp_path / "t.csv"), "id long, tokens array<string>, text string").first()
    assert (r["id"], r["tokens"], r["text"]) == (1, ["a", None, "b"], "x\ny")
    (tmp_path / "w.csv").write_text("dog\ncat\ndog\n\n")
    assert src.read_word_list(spark, str(tmp_path / "w.csv")).count() == 2
    assert "a\\_b & 0.500" in src.latex_table(spark.createDataFrame([("a_b", 0.5)], "n string, v double"))


def test_language_model_lines(spark, tmp_path):
    src.write_language_model_lines(spark.createDataFrame([(None, "a."), ("b.", "c.")], "prev_transcript_clean string, transcript_clean string"), str(tmp_path / "lm"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lm")).collect()) == ["[SEP]a.[EOS]", "b.[SEP]c.[EOS]"]


def test_gates(spark):
    d = spark.createDataFrame([("a", "CHI", "O .", None), ("a", "MOT", "[=! door slams] .", 1), ("a", "CHI", ".", 2), ("b", "CHI", "x", 3), ("Interview/c", "CHI", "x", 1), ("Interview/c", "MOT", "y", 1)], "transcript_file string, speaker_code string, transcript_raw string, start_time long")
    kept = src.row_gates(src.transcript_gates(d)).collect()
    assert [(r["transcript_file"], r["transcript_raw"]) for r in kept] == [("a", "0 .")]


def test_stage(spark):
    d = spark.range(10)
    s = tables.stage(d)
    assert s.count() == 10 and "talkloom-" in s._talkloom_path
    tables.drop_stage(s)
    assert not os.path.exists(s._talkloom_path.removeprefix("file://"))
    assert tables.spread(d.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_name_and_age_from_path(spark):
    d = spark.createDataFrame([("Belfast/Tom/020315.cha", "Belfast", None, None), ("A/x/kim1.cha", "Rollins", 20, "Rollins_Target_Child"), ("C/y/z.cha", "C", 0, "C_Z"), ("E/30pc/ab12.cha", "EllisWeismer", 0, None), ("V/02a.cha", "Valian", None, "Valian_Target_Child"), ("Belfast/x/kim.cha", "Belfast", None, "B")], "p string, c string, a int, n string")
    name, age = src.name_and_age_from_path(F.col("p"), F.col("c"), F.col("a"), F.col("n"))
    assert [tuple(r) for r in d.select(name, age).collect()] == [("Belfast_Tom", 27), ("Rollins_kim", 20), ("C_Z", None), ("EllisWeismer_ab12", 30), ("Valian_02", None), ("B", None)]


def test_csv_comes_back(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b", c\nd', ["x", "y"]), (2, None, None)], "id long, t string, ws array<string>")
    src.write_csv(d, str(tmp_path / "c"))
    assert sorted(map(tuple, src.read_table_csv(spark, str(tmp_path / "c"), "id long, t string, ws array<string>").collect())) == [(1, 'a "b", c\nd', ["x", "y"]), (2, None, None)]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.shared_folder(Session)
