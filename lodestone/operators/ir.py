"""Parsed documents as tables: files with roles, blocks with parents, quality and coverage state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ids import stable_id
from lodestone.functions.vocabulary import WARNING_POLICY
from lodestone.sources.shared import dealt


def file_format(content_format: Column, path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.lower(F.coalesce(content_format, F.lit("")))
    return F.when(named.contains("pdf") | (end == "pdf"), "PDF").when(named.contains("html") | end.isin("htm", "html"), "HTML").when(named.contains("xml") | (end == "xml"), "XML").otherwise("OTHER")


def file_role(format_: Column, path: Column, attachment: Column) -> Column:
    """The first that holds: PDF, the viewer's page, the main file, consolidated audit, audit, other HTML, other."""
    name = F.lower(path)
    return (
        F.when(format_ == "PDF", "PDF_FALLBACK")
        .when((format_ == "HTML") & name.rlike(r"(^|/)viewer\.html?$"), "VIEWER_HTML")
        .when(~F.coalesce(attachment, F.lit(False)), "MAIN")
        .when(name.rlike("연결.*감사|consolidated.*audit"), "CONSOLIDATED_AUDIT")
        .when(name.rlike("감사|audit"), "AUDIT")
        .when(format_ == "HTML", "VIEWER_HTML")
        .otherwise("OTHER")
    )


def _failed(w: Column) -> Column:
    return (w["severity"] == "error") | w["code"].rlike("parse_failed|decode_failed")


def files(documents: DataFrame) -> DataFrame:
    """One row for each source file, with role, parse status and what its warnings say."""
    rows = documents.select("document_id", "warnings", F.col("parse_quality.tier").alias("tier"), F.posexplode("source_files").alias("position", "f"))
    own = F.filter(F.coalesce("warnings", F.array().cast("array<struct<rel_path:string,code:string,severity:string,message:string>>")), lambda w: w["rel_path"].eqNullSafe(F.col("f.rel_path")))
    form = file_format(F.col("f.content_format"), F.col("f.rel_path"))
    failed, noted = F.exists(own, _failed), F.size(own) > 0
    return rows.select(
        "document_id",
        "position",
        stable_id("file", "document_id", F.col("f.rel_path")).alias("file_id"),
        F.col("f.rel_path").alias("rel_path"),
        form.alias("format"),
        file_role(form, F.col("f.rel_path"), F.col("f.is_attachment")).alias("role"),
        F.when(failed, "FAILED").when(F.col("tier") == "fallback", "FALLBACK").when(noted, "PARSED_WITH_WARNINGS").otherwise("PARSED").alias("parse_status"),
        F.exists(own, lambda w: w["code"].contains("repair")).alias("repair_used"),
        F.exists(own, lambda w: w["code"].rlike("text_loss|truncat|decode")).alias("text_loss_suspected"),
        F.array_sort(F.array_distinct(F.transform(own, lambda w: w["code"]))).alias("warnings"),
    )


def blocks(documents: DataFrame) -> DataFrame:
    """One row for each node, tables split into header and body rows."""
    rows = documents.select("document_id", F.posexplode("nodes").alias("position", "n"))
    cells = F.coalesce("n.normalized_rows", F.array().cast("array<array<string>>"))
    header = F.coalesce("n.header_row_indices", F.array().cast("array<int>"))
    return rows.select(
        "document_id",
        "position",
        F.col("n.node_id").alias("node_id"),
        F.col("n.kind").alias("kind"),
        F.col("n.section_hierarchy").alias("section_path"),
        F.coalesce("n.text", "n.title_text").alias("text"),
        F.filter(cells, lambda r, i: F.array_contains(header, i)).alias("header_rows"),
        F.filter(cells, lambda r, i: ~F.array_contains(header, i)).alias("body_rows"),
        (F.length(F.coalesce("n.text", F.lit(""))) + F.length(F.coalesce("n.title_text", F.lit(""))) + F.aggregate(F.flatten(cells), F.lit(0), lambda a, c: a + F.length(F.coalesce(c, F.lit(""))))).alias("n_chars"),
    )


def section_parents(blocks_: DataFrame) -> DataFrame:
    """Blocks with the section of their path; if a path names several, the last of the whole document.

    All columns move and are sorted by document and path, in parts of a bounded number of rows; leave out what is not needed.
    """
    path = F.when(F.col("kind") == "section", F.slice("section_path", F.lit(1), F.greatest(F.size("section_path") - 1, F.lit(0)))).otherwise(F.col("section_path"))
    named = blocks_.filter("kind = 'section'").select(F.col("document_id").alias("of_doc"), F.col("section_path").alias("of_path"), "node_id", "position")
    rows, named = dealt((blocks_.withColumn("of", path), ["document_id", "of"]), (named, ["of_doc", "of_path"]), rows=blocks_.count())
    sections = named.groupBy("of_doc", "of_path").agg(F.max_by("node_id", "position").alias("parent_id"))
    return rows.join(sections, (F.col("document_id") == F.col("of_doc")) & (F.col("of") == F.col("of_path")), "left").drop("of_doc", "of_path", "of")


def coverage(documents: DataFrame) -> DataFrame:
    """(document_id, coverage_state, reason) from tier, warnings, number of nodes and file formats."""
    none = F.array().cast("array<struct<rel_path:string,code:string,severity:string,message:string>>")
    warnings = F.coalesce("warnings", none)
    failed = F.exists(warnings, _failed)
    empty = F.coalesce(F.size("nodes"), F.lit(0)) <= 0
    formats = F.transform("source_files", lambda f: file_format(f["content_format"], f["rel_path"]))
    viewer = F.array_contains(formats, "PDF") & F.array_contains(formats, "HTML") & F.exists(warnings, lambda w: F.lower(w["message"]).contains("no <table> found"))
    tier = F.col("parse_quality.tier")
    state = F.when(tier == "structured", "PRESENT").when((tier == "partial") & ~failed, "PRESENT").when(tier == "fallback", "PARTIAL_PARSE_FAILURE").when(failed & empty, "PARSE_FAILED").otherwise("PARTIAL_PARSE_FAILURE")
    reason = (
        F.when(tier == "structured", "PARSE_SUCCESS")
        .when((tier == "partial") & ~failed, "PARSE_SUCCESS_WITH_WARNINGS")
        .when(tier == "fallback", "FALLBACK_TEXT_ONLY")
        .when(failed & empty & viewer, "PDF_VIEWER_EMPTY_NO_TABLES")
        .when(failed & empty, "PARSE_FAILED_NO_BLOCKS")
        .otherwise("PARTIAL_PARSE_FAILURE")
    )
    return documents.select("document_id", state.alias("coverage_state"), reason.alias("reason"))


def warning_policies(documents: DataFrame) -> DataFrame:
    """(document_id, code, classification, text_loss, retrieval_policy, fact_policy) of each distinct warning; unknown codes
    have no policy."""
    policy = documents.sparkSession.createDataFrame(list(WARNING_POLICY), "p_code string, classification string, text_loss boolean, retrieval_policy string, fact_policy string")
    rows = documents.select("document_id", F.explode("warnings").alias("w")).select("document_id", F.col("w.code").alias("code")).distinct()
    return rows.join(F.broadcast(policy), F.col("code") == F.col("p_code"), "left").drop("p_code")
