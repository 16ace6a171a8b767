import duckdb
from pyspark.sql import functions as F

from plumbline import queries as Q
from plumbline.operators import context as C
from plumbline.operators import evaluate

ARTICLE = """Skip to the content of this page now
A study of growth in many small animals
Abstract
We measured   growth
in animals.
Introduction
3 May 2021 Editor's note: Readers are alerted to Fig. 2b.
This article was corrected
In the version of this article initially published, a panel was mistakenly used. The figures have been corrected.
Fig. 1: Growth of cells.
a, Mean volume. b, Weight; n = 9.
Extended Data Fig. 7 Other rates.
c, Rates of k.
Data availability
Source data are provided.
References
"""


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


def test_sections(spark):
    assert one(spark, ARTICLE, C.title(F.col("text"))) == "A study of growth in many small animals"
    assert one(spark, ARTICLE, C.section(F.col("text"), C.ABSTRACT)) == "We measured growth in animals."
    assert one(spark, ARTICLE, C.section(F.col("text"), C.AVAILABILITY)) == "Source data are provided."
    assert one(spark, "", C.title(F.col("text"))) == ""


def test_captions_and_coverage(spark):
    articles = spark.createDataFrame([(1, ARTICLE)], "article_id long, text string")
    got = [(r.figure_id, r.figure_type, r.panels) for r in C.captions(articles).orderBy("caption_ord").collect() if r.panels]
    assert got == [("Fig.1", "main", ["a", "b"]), ("ED Fig.7", "extended_data", ["c"])]
    maps = C.map_to_figures(spark.createDataFrame([(0, "Source_Data.xlsx", "Extended Data Fig.7k")], "table_index int, source_path string, table_name string"), C.captions(articles))
    row = maps.first()
    assert (row.figure_id, row.figure_type, row.panels, row.mapped) == ("ED Fig.7", "extended_data", ["k"], True) and row.caption
    assert "Fig.1" in {r.summary.split()[0] for r in C.coverage_leads(C.captions(articles), maps).collect()}


def test_figure_and_panel_quirks(spark):
    df = spark.createDataFrame([("Source Data Fig. 2 Source",), ("Fig 3a, b and c",), ("no figure, x and y",), ("Source Data Fig. 4b & d",)], "t string")
    got = [tuple(r) for r in df.select(*C.infer_figure(F.col("t")), C.infer_panels(F.col("t"))).collect()]
    assert got == [("Fig.2", "main", ["s"]), ("Fig.3", "main", ["a", "b", "c", "d", "n"]), ("", "unknown", ["x", "y"]), ("Fig.4", "main", ["b", "d"])]


def test_notices_are_redacted(spark):
    found = C.notices(spark.createDataFrame([(1, ARTICLE)], "article_id long, text string"))
    assert {r.kind for r in found.collect()} == {"editor_note", "author_correction_text"}
    blind = C.notice_leads(found).collect()
    assert blind and all("Fig. 2b" not in r.evidence for r in blind)
    assert any("Fig. 2b" in r.evidence for r in C.notice_leads(spark.createDataFrame([("x", "Fig. 2b was corrected")], "kind string, text string"), reveal=True).collect())


def test_links_and_text(spark):
    page = "<p>a &amp; b<script>var x;</script></p><a href='https://h/x.pdf'>1</a> <a href=\"https://h/x.pdf\">2</a> https://h/b.xlsx"
    assert one(spark, page, C.source_links(F.col("text"))) == ["https://h/b.xlsx", "https://h/x.pdf"]
    assert one(spark, page, C.html_text("text")).split("\n")[:2] == ["a & b", "var x;"]
    assert one(spark, "a &lt; b", C.unescaped("text")) == "a < b"


def test_known_case(spark):
    leads = spark.createDataFrame([(1, "see Fig. 2c"), (2, "see Extended Data Fig. 7a"), (3, "see ED Fig.7k"), (4, "nothing")], "context_rank int, summary string")
    oracle = spark.createDataFrame([("a", "Fig. 2c", "x"), ("b", "Fig. 2d", "x"), ("c", "Extended Data Fig. 7k", "x"), ("d", "Fig. 7k", "x")], "id string, label string, problem_family string")
    results = evaluate.score_labels(leads, oracle)
    assert {r.oracle_id: (r.status, r.first_hit_rank) for r in results.collect()} == {"a": ("true_positive", 1), "b": ("near_miss", 1), "c": ("true_positive", 3), "d": ("missed_oracle", None)}
    assert evaluate.label_rates(results).first() == (0.5, 0.75)


def test_label_leads(spark):
    rows = spark.createDataFrame([(0, "p", "t", i, v) for i, v in enumerate([["a", "", "b"], [" a", "b "], ["c"], ["c"], ["d", "e"]])], "table_index int, source_path string, table_name string, row_i int, values array<string>")
    maps = spark.createDataFrame([(0, "Fig.1")], "table_index int, figure_id string")
    got = C.label_leads(rows, maps).collect()
    assert len(got) == 1 and got[0].context_score == 50.0 and got[0].priority == "Medium"


def test_captions_and_notices_read_the_whole_text(spark, tmp_path):
    long = "Some words that fill a line.\n" * 400
    text = long + "Fig. 9: Late.\na, One. d, Two.\nMethods\nwere used.\nAn Author Correction to this article was published on 4 June 2022\nend"
    spark.createDataFrame([(0, text), (1, long), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.figure_id, r.captions, r.panels) for r in Q.captions(spark, str(tmp_path)).collect()}
    assert got == {("Fig.9", 1, "a,d")} | {(f"{x}Fig.{n}", 1, p) for n in (1, 2, 3) for x, p in (("", "a,b"), ("ED ", "c"))}
    found = {r.text: r.articles for r in Q.notices(spark, str(tmp_path)).collect()}
    assert found == {f"An Author Correction to this article was published on {x}": n for x, n in (("3 May 2021", 3), ("4 June 2022", 1))}


def test_documents_with_headings_of_their_own(spark, tmp_path):
    texts = [None, "", " \n\n", "a\nIntroduction\nb", "see Data availability\n References: x\nb", "Fig. 1 shows\nFig. 1: a, b", "1x\nfig. 1\n", "\ue0001a\ue000\nReferences", "plain  text"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.sections(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLE_SQL['sections']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
