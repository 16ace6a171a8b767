"""What an article says about its figures, and leads that follow from it."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from plumbline.functions.tokens import stripped
from plumbline.sources.store import numbered

# The patterns by which sections, notices and captions are told.
ABSTRACT = r"(?is)\bAbstract\b\s*(.+?)(?:\n\s*(?:Data availability|References|Fig\. 1|Introduction|Author information)\b)"
AVAILABILITY = r"(?is)\bData availability\b\s*(.+?)(?:\n\s*(?:Change history|References|Acknowledgements|Author information)\b)"
NOTICES = {
    "editor_note": r"(?is)(\d{1,2}\s+[A-Z][a-z]+\s+\d{4}\s+Editor's note:.+?)(?=\n\s*(?:An Author Correction|This article|##|Abstract|Fig\.|$))",
    "author_correction_link": r"(?is)(An Author Correction to this article was published on \d{1,2}\s+[A-Z][a-z]+\s+\d{4})",
    "author_correction_text": r"(?is)(In the version of this article initially published,.+?The figures have been corrected.+?)(?=\n|$)",
}
CAPTION = (
    r"(?s)((?:Extended Data Fig\.|Fig\.)\s*\d+[^\n]*?)(?=\n\s*(?:Image|The alternative text|[a-z],|[A-Z][a-z]+)|$)"
    r"(.*?)(?=\n\s*(?:Extended Data Fig\.|Fig\.)\s*\d+|Data availability|References|Methods|Acknowledgements|Supplementary information|$)"
)
FIGURE = r"(Extended Data Fig\.|Fig\.)\s*(\d+)"
LINKS = (r"(?i)https?://[^\"'<>\s]+(?:xlsx|xls|pdf)", r"(?i)static-content\.springer\.com/[^\"'<>\s]+(?:xlsx|xls|pdf)")
CORRECTION = r"(?i)figure preparation|mistakenly|inadvertently|incorrect|corrected"
MENTION = r"(?:Extended Data Fig\.|Fig\.)\s*\d+[a-z]?"
REDACTED = r"(?i)\b(?:DAPI|Merge|WT|KI|HDAC6|sh\s*Tet2|shNC|ΔSE14|0\.41|48 h|60 h)\b"


def norm_space(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append(data.strip())


def _visible(source: str | None) -> str:
    parser = _Text()
    parser.feed(source or "")
    parser.close()
    return "\n".join(parser.found)


@F.pandas_udf(StringType())
def html_text(source: pd.Series) -> pd.Series:
    """The text nodes of a page, a line each; scripts and styles count as text."""
    return source.map(_visible)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: html.unescape(x) if x is not None else None)


def title(text: Column) -> Column:
    """The first line of over 20 characters that isn't a page's furniture."""
    lines = F.transform(F.split(text, r"\R"), norm_space)
    good = F.filter(lines, lambda x: (F.length(x) > 20) & ~F.lower(x).rlike("^(advertisement|skip to)"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def section(text: Column, pattern: str) -> Column:
    return norm_space(F.regexp_extract(text, pattern, 1))


def source_links(raw: Column) -> Column:
    """Distinct links to spreadsheets and PDF files, sorted; entities are left to ``unescaped``."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(raw, F.lit(p), F.lit(0)) for p in LINKS])))


def notices(articles: DataFrame, text: str = "text") -> DataFrame:
    """A row for every notice of (article_id, text)."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), norm_space(x).alias("text")))

    found = F.concat(*[of(k, p) for k, p in NOTICES.items()])
    return articles.select("article_id", F.posexplode(found).alias("notice_ord", "n")).select("article_id", "notice_ord", "n.kind", "n.text")


def captions(articles: DataFrame, text: str = "text") -> DataFrame:
    """A row for every figure caption: figure_id, type, heading, caption, panels."""
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(CAPTION), F.lit(1)).alias("h"), F.regexp_extract_all(text, F.lit(CAPTION), F.lit(2)).alias("b"))
    rows = articles.select("article_id", F.posexplode(pair).alias("caption_ord", "c")).select("article_id", "caption_ord", norm_space(F.col("c.h")).alias("heading"), norm_space(F.col("c.b")).alias("caption"))
    extended = F.regexp_extract("heading", FIGURE, 1).startswith("Extended")
    number = F.regexp_extract("heading", FIGURE, 2)
    rows = rows.where(number != "")
    panels = F.array_sort(F.array_distinct(F.regexp_extract_all("caption", F.lit(r"\b([a-z])\s*,"), F.lit(1))))
    return rows.select("article_id", "caption_ord", F.concat(F.when(extended, "ED Fig.").otherwise("Fig."), number).alias("figure_id"), F.when(extended, "extended_data").otherwise("main").alias("figure_type"), "heading", "caption", panels.alias("panels"))


def infer_figure(text: Column) -> tuple[Column, Column]:
    """The figure that a name stands for, and its type."""
    short = F.regexp_replace(text, "Extended Data", "ED")
    extended, main = F.regexp_extract(short, r"(?i)\bED\s*Fig\.?\s*(\d+)", 1), F.regexp_extract(short, r"(?i)\bFig\.?\s*(\d+)", 1)
    figure = F.when(extended != "", F.concat(F.lit("ED Fig."), extended)).when(main != "", F.concat(F.lit("Fig."), main)).otherwise("")
    return figure, F.when(extended != "", "extended_data").when(main != "", "main").otherwise("unknown")


def infer_panels(text: Column) -> Column:
    """Panel letters after a figure's number, and both of any ``a and b``."""
    chunks = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:Fig|ED Fig)\.?\s*\d+\s*([a-z](?:\s*(?:,|and|&)\s*[a-z])*)"), F.lit(1))
    listed = F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]"), F.lit(0))))
    both = [F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b([a-z])\s*(?:and|&)\s*([a-z])\b"), F.lit(i)), F.lower) for i in (1, 2)]
    return F.array_sort(F.array_distinct(F.concat(listed, *both)))


def map_to_figures(tables: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(table_index, figure_id, figure_type, panels, caption_heading, caption, mapped) of (table_index, source_path, table_name)."""
    name = F.concat_ws(" ", "source_path", "table_name")
    figure, kind = infer_figure(name)
    out = tables.select("table_index", "source_path", "table_name", figure.alias("figure_id"), kind.alias("figure_type"), infer_panels(name).alias("panels"))
    out = out.withColumn("mapped", F.col("figure_id") != "")
    if found is None:
        return out.withColumn("caption_heading", F.lit("")).withColumn("caption", F.lit(""))
    one = found.groupBy("figure_id").agg(F.max_by(F.struct("heading", "caption"), "caption_ord").alias("c"))
    return out.join(one, "figure_id", "left").withColumn("caption_heading", F.coalesce("c.heading", F.lit(""))).withColumn("caption", F.coalesce("c.caption", F.lit(""))).drop("c")


def priority(score: Column) -> Column:
    return F.when(score >= 80, "High").when(score >= 45, "Medium").otherwise("Low")


def _lead(df: DataFrame, kind: str, score: Column, summary: Column, evidence: Column, suggestion: str) -> DataFrame:
    score = score.cast("double")
    return df.select(F.lit(kind).alias("kind"), priority(score).alias("priority"), score.alias("context_score"), summary.alias("summary"), F.to_json(evidence).alias("evidence"), F.lit(suggestion).alias("review_suggestion"))


def notice_leads(found: DataFrame, reveal: bool = False) -> DataFrame:
    """Notices of corrections; figures are hidden unless revealed, so that a blind run stays blind."""
    some = found.where(F.col("text").rlike(CORRECTION))
    figures = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))))
    hidden = F.regexp_replace(F.regexp_replace("text", MENTION, "[figure redacted]"), REDACTED, "[detail redacted]")
    shown = F.struct(F.col("kind").alias("notice_kind"), F.col("text").alias("notice_text"), figures.alias("mentioned_figures"))
    blind = F.struct(F.col("kind").alias("notice_kind"), hidden.alias("notice_text_redacted"), F.lit("redacted_for_blind_benchmark").alias("mentioned_figures"))
    return _lead(some, "article_notice", F.when(F.size(figures) > 0, 95).otherwise(75), F.lit("The article carries a correction or note on its figures."), shown if reveal else blind, "Keep the figures named here from a blind review.")


def coverage_leads(found: DataFrame, mappings: DataFrame) -> DataFrame:
    """Captions whose figure no table belongs to."""
    missing = found.select("figure_id").where("figure_id <> ''").distinct().join(mappings.where("figure_id <> ''").select("figure_id").distinct(), "figure_id", "left_anti")
    return _lead(missing, "source_data_coverage", F.lit(40), F.concat(F.col("figure_id"), F.lit(" has a caption but no source table.")), F.struct("figure_id"), "See whether its data are in another table.")


def column_leads(classes: DataFrame) -> DataFrame:
    """Tables of figures with columns that can be audited."""
    key = ["source_path", "table_name", "figure_id"]
    enough = classes.where("numeric_n >= 5")
    kinds = enough.where("not homepage_eligible").groupBy(*key, "column_type").agg(F.count("*").alias("c")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_type", "c")))).alias("excluded_column_types"))
    good = enough.where("homepage_eligible").groupBy(*key).agg(F.count("*").alias("k"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "column"))), lambda x: x["column"]), 1, 12).alias("eligible_columns"))
    some = good.where("figure_id <> ''").join(kinds, key, "left")
    return _lead(
        some, "mapped_experimental_source_data", 55 + F.least(F.lit(20), 2 * F.col("k")), F.concat(F.col("figure_id"), F.lit(" has "), F.col("k").cast("string"), F.lit(" columns that can be audited.")),
        F.struct(*key, "eligible_columns", "excluded_column_types"), "Recompute the panel's means, error bars and sample sizes from these columns.",
    )


def label_leads(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Tables with repeated rows of labels, blank cells left out. rows: (table_index, source_path, table_name, row_i, values)."""
    bare = rows.withColumn("v", F.filter(F.transform("values", stripped), lambda x: x != "")).where(F.size("v") > 0)
    repeated = bare.groupBy("table_index", "source_path", "table_name", "v").agg(F.count("*").alias("c"), F.min("row_i").alias("first")).where((F.col("c") > 1) & (F.size("v") >= 2))
    some = repeated.withColumn("_k", F.row_number().over(Window.partitionBy("table_index").orderBy("first"))).where("_k <= 5")
    shown = some.groupBy("table_index", "source_path", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "v"))), lambda x: x["v"]).alias("repeated_row_examples"))
    shown = shown.join(mappings.select("table_index", "figure_id"), "table_index", "left").fillna("", ["figure_id"])
    return _lead(
        shown, "repeated_label_or_header_rows", F.when(F.col("figure_id") == "", 35).otherwise(50), F.lit("Rows of labels repeat: several panels may be merged, or labels may be out of step."),
        F.struct("source_path", "table_name", "figure_id", "repeated_row_examples"), "Compare the labels of neighbouring panels.",
    )


def ranked_leads(leads: DataFrame) -> DataFrame:
    """Leads (a few per article) in the order of their scores."""
    return numbered(leads, [F.desc("context_score"), F.col("kind"), F.col("summary"), F.col("evidence")], "context_rank")
