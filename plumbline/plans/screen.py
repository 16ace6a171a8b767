"""The screen from end to end, a stage per function as the command line has them.

Each stage takes and returns DataFrames; ``write_json`` and ``write_document`` are the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import audits, classify, context, dispose, headers
from plumbline.sources import documents, files, tables
from plumbline.sources.store import kept, stored, temporary


def extract(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(cells, statuses) of all files under root. Statuses are the files or arrays that gave no table, and why.

    Files are read once: rows and cells are stored for the stages that follow.
    """
    with temporary(spark):
        rows = stored(tables.numbered(stored(tables.extract_rows(spark, files.inventory(spark, root)), "rows")), "rows")
        statuses = kept(rows.where("status is not null").select("table_index", "source_path", "table_name", "source_confidence", "status", "message"), "statuses")
        return kept(headers.to_cells(rows), "cells"), statuses


def screen(cells: DataFrame, captions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything that the numeric branch makes of cells. Results are stored; what they were made of is deleted."""
    with temporary(cells.sparkSession):
        mappings = kept(context.map_to_figures(cells.select("table_index", "source_path", "table_name").distinct(), captions), "mappings")
        classes = kept(classify.classify_columns(cells, mappings), "classes")
        findings = kept(dispose.with_order(audits.audit(cells)), "findings")
        normalized = kept(dispose.normalize(findings, classes), "normalized")
        leads = context.column_leads(classes).unionByName(context.label_leads(audits.table_rows(cells), mappings))
        if captions is not None:
            leads = leads.unionByName(context.coverage_leads(captions, mappings))
        return {
            "mappings": mappings, "classes": classes, "findings": findings, "normalized": normalized, "ranked": kept(dispose.rank_findings(findings, classes), "ranked"),
            "leads": kept(context.ranked_leads(leads), "leads"), "summary": dispose.assessment_summary(findings, normalized, classes),
        }


def screen_folder(spark: SparkSession, root: str, article: str | None = None) -> dict[str, DataFrame]:
    """A folder of source data, and the article's text if there is one."""
    cells, statuses = extract(spark, root)
    captions = None
    extra = {}
    if article is not None:
        articles = spark.createDataFrame([(0, article)], "article_id long, text string")
        captions = context.captions(articles)
        extra = {"captions": captions, "notice_leads": context.notice_leads(context.notices(articles))}
    return screen(cells, captions) | {"cells": cells, "statuses": statuses} | extra


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, in as many files as df has partitions."""
    df.write.mode("overwrite").json(path)


def write_document(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON document with a list of all rows for each name."""
    documents.write_document(path, **parts)
