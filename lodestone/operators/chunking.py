"""Chunks: segments, token windows and packs as set operations over all documents at once.

A segment is a title, a paragraph or a table row. A strategy says which segments belong together (by file, by file and
section, by table) and how a group of them becomes chunks: token windows, whose numbers follow from running sums of
tokens, or greedy packs, which one sorted pass numbers. Pieces of segments are then grouped into chunks, and a chunk's
parent is found among the packs that its segments lie in, else by section path, else by file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import TOKEN, auxiliary_row, canonical_text, linear_row, n_tokens
from lodestone.functions.vocabulary import CHUNK_TYPES
from lodestone.operators.constraints import chunk_parents, unique
from lodestone.operators.coverage import all_of, violations
from lodestone.sources.shared import parts, save

#: Parameters of the strategies: fixed values of the source format.
FIXED = {"id": "fixed-token-512-o64.v0.1.0", "strategy": "fixed-token", "max_tokens": 512, "overlap": 64}
SECTIONS = {"id": "section-aware-flat-512-o64.v0.1.0", "strategy": "section-aware-flat", "max_tokens": 512, "overlap": 64}
TREE = {"id": "doctype-hier-parent-child-table-dual.v0.2.0", "strategy": "hierarchical", "parent_tokens": 1024, "parent_segments": 50, "child_tokens": 384, "child_segments": 4, "row_tokens": 256, "rows": 8}


def window_count(n: Column, most: int, overlap: int) -> Column:
    """Windows of ``most`` tokens that cover n tokens, each ``overlap`` into the one before; the last one ends the text."""
    step = max(1, most - overlap)
    return F.when(n <= 0, 0).when(n <= most, 1).otherwise(F.ceil((n - most) / F.lit(float(step))).cast("int") + 1)


def token_windows(df: DataFrame, key: str, text: str, most: int = 512, overlap: int = 64) -> DataFrame:
    """(key, window, token_start, token_end): token numbers from 0, end exclusive; texts without tokens have none."""
    step = max(1, most - overlap)
    rows = df.select(key, n_tokens(F.col(text)).alias("n")).withColumn("windows", window_count(F.col("n"), most, overlap)).filter("windows > 0")
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    start = F.col("window") * step
    return rows.select(key, F.col("window").cast("int").alias("window"), start.cast("int").alias("token_start"), F.least(start + most, F.col("n")).cast("int").alias("token_end"))


def pack(df: DataFrame, by: list[str], order: list[str], n: str, most: int, most_segments: int, name: str = "pack", placed: bool = False) -> DataFrame:
    """``df`` with two more columns: the number of each row's pack in its group (``name``), and how many packs it takes (``name``_windows).

    Rows of a group, in order, fill packs of at most ``most`` tokens and ``most_segments`` rows. A row with more tokens
    closes the pack before it and becomes packs of its own, of which ``name`` is the first. One sorted pass: a task holds
    a batch and the state of the open pack, however large a group is. placed: no group has rows in two partitions of ``df``.
    """
    rows = df.withColumn("_group", F.xxhash64(*by))
    rows = (rows if placed else rows.repartition("_group")).sortWithinPartitions("_group", *order)
    schema = rows.withColumns({name: F.lit(0).cast("long"), f"{name}_windows": F.lit(0).cast("long")}).schema
    names = schema.names

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, used, held = None, 0, 0, 0  # the open pack: its number, tokens and rows
        for batch in batches:
            if not batch.num_rows:
                continue
            key, size = (batch.column(names.index(c)).to_numpy() for c in ("_group", n))
            size = size.astype(np.int64)
            long, total = size > most, np.concatenate([[0], np.cumsum(size)])
            packs, windows = np.zeros(len(size), np.int64), np.maximum(1, -(-size // most))
            edges = np.append(np.flatnonzero((key[1:] != key[:-1]) | long[1:] | long[:-1]) + 1, len(size))
            i = 0
            while i < len(size):
                if key[i] != group:
                    group, at, used, held = key[i], 0, 0, 0
                if long[i]:
                    packs[i] = at + (held > 0)
                    at, used, held, i = int(packs[i] + windows[i]), 0, 0, i + 1
                    continue
                edge = int(edges[np.searchsorted(edges, i, side="right")])
                j = min(edge, i + most_segments - held, int(np.searchsorted(total, total[i] + most - used, side="right")) - 1)
                packs[i:j] = at
                used, held, i = used + int(total[j] - total[i]), held + j - i, j
                if i < edge:
                    at, used, held = at + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs), pa.array(np.where(long, windows, 1))], names=names)

    return rows.mapInArrow(fill, schema).drop("_group")


def segments(documents: DataFrame) -> DataFrame:
    """(document_id, doc_group, tier, position, row, kind, text, n, node_id, path, file) of documents (document_id, doc_group, tier, nodes).

    Table rows are `cell | cell` and have a row number; blank segments are left out. position: the node's.
    """
    nodes = documents.select("document_id", "doc_group", "tier", F.posexplode("nodes").alias("position", "node"))
    one = lambda row, text: F.struct(row.cast("int").alias("row"), text.alias("text"))
    own = F.when(F.col("node.kind") == "section", F.col("node.title_text")).otherwise(F.col("node.text"))
    parts = F.when(F.col("node.kind") == "table", F.transform("node.normalized_rows", lambda cells, i: one(i, linear_row(cells)))).otherwise(F.array(one(F.lit(None), own)))
    kind = F.when(F.col("node.kind") == "table", "row").otherwise(F.col("node.kind"))
    path, file = F.coalesce("node.section_hierarchy", F.array().cast("array<string>")), F.coalesce("node.source.rel_path", F.lit(""))
    rows = nodes.select("document_id", "doc_group", "tier", "position", F.explode(parts).alias("part"), kind.alias("kind"), F.col("node.node_id").alias("node_id"), path.alias("path"), file.alias("file"))
    rows = rows.filter(F.col("part.text").rlike(r"(?U)\S"))
    return rows.select("document_id", "doc_group", "tier", "position", F.col("part.row").alias("row"), "kind", F.col("part.text").alias("text"), n_tokens(F.col("part.text")).alias("n"), "node_id", "path", "file")


_PLACE = ["position", "row"]


def _led(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the place of the first segment of their group, by which groups are ordered."""
    return rows.withColumn("first", F.min(F.struct(*_PLACE)).over(Window.partitionBy("document_id", *by)))


def _cut(rows: DataFrame, pieces: Column) -> DataFrame:
    """A row for each of ``pieces``, an array of (no, a, z): the segment's tokens a to z in the chunk of that number."""
    rows = rows.withColumn("pieces", pieces)
    partial = F.exists("pieces", lambda p: (p["a"] > 0) | (p["z"] < F.col("n")))
    rows = rows.withColumn("tokens", F.when(partial, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).withColumn("gaps", F.when(partial, F.split("text", TOKEN, -1)))
    rows = rows.withColumn("spaced", F.zip_with("gaps", "tokens", lambda g, t: F.concat(g, t)))

    def text(p: Column) -> Column:
        tail = F.array_join(F.slice("spaced", p["a"] + 2, p["z"] - p["a"] - 1), "")
        return F.when((p["a"] == 0) & (p["z"] == F.col("n")), F.col("text")).otherwise(F.concat(F.get("tokens", p["a"]), tail))

    made = F.transform("pieces", lambda p: F.struct(p["no"].alias("no"), (p["z"] - p["a"]).alias("n"), text(p).alias("text")))
    rows = rows.withColumn("made", made).drop("pieces", "tokens", "gaps", "spaced")
    return rows.select(*[c for c in rows.columns if c not in ("made", "text", "n")], F.explode("made").alias("m")).select("*", "m.no", "m.n", "m.text").drop("m")


def windows(rows: DataFrame, by: list[str], most: Column, overlap: Column) -> DataFrame:
    """The pieces of each group's token windows: rows with ``first``, ``no`` (the window's number), the piece's text and tokens.

    most, overlap: the same for all rows of a group.
    """
    step = F.greatest(F.lit(1), most - overlap)
    n_windows = lambda n: F.when(n <= 0, 0).when(n <= most, 1).otherwise(F.ceil((n - most) / step.cast("double")).cast("int") + 1)
    group = Window.partitionBy("document_id", *by)
    rows = _led(rows, by).withColumn("total", F.sum("n").over(group))
    rows = rows.withColumn("before", F.sum("n").over(group.orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    low = F.greatest(F.lit(0), F.floor((F.col("before") - most) / step.cast("double")) + 1)
    high = F.least(n_windows(F.col("total")) - 1, F.floor((F.col("before") + F.col("n") - 1) / step.cast("double")))
    place = lambda w: F.struct(w.alias("no"), F.greatest(F.lit(0), w * step - F.col("before")).cast("int").alias("a"), F.least(F.col("n"), w * step + most - F.col("before")).cast("int").alias("z"))
    return _cut(rows, F.transform(F.sequence(low.cast("long"), high.cast("long")), place)).drop("total", "before")


def pack_pieces(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The pieces of packs that pack() has numbered; a segment that takes several packs is cut without overlap."""
    place = lambda k: F.struct((F.col(name) + k).alias("no"), (k * most).cast("int").alias("a"), F.least(F.col("n"), (k + 1) * most).cast("int").alias("z"))
    return _cut(rows, F.transform(F.sequence(F.lit(0).cast("long"), F.col(f"{name}_windows") - 1), place))


#: Chunks of a document are ordered by stage (parents, children, tables), group, half (whole tables, then their rows), number.
_ORDER = ["stage", "first", "half", "no"]


def _key(stage: int, first: Column, half: int, no: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), first.alias("first"), F.lit(half).alias("half"), no.cast("long").alias("no"))


def _assembled(pieces: DataFrame, stage: int, half: int, kind: Column, role: Column, parent: Column | None = None) -> DataFrame:
    """Chunks of the pieces that share a group and a number; parent: the key of the chunk that a piece's segment lies in."""
    none = F.lit(None).cast("struct<stage:int,first:struct<position:int,row:int>,half:int,no:bigint>")
    piece = F.struct(*_PLACE, "text", "node_id", "file", "path")
    rows = pieces.groupBy("document_id", "doc_group", "tier", "first", "no").agg(
        F.array_sort(F.collect_list(piece)).alias("parts"),
        F.sum("n").cast("int").alias("n_tokens"),
        F.min("path").alias("low"),
        F.max("path").alias("high"),
        F.min(none if parent is None else parent).alias("parent"),
    )
    # all paths begin as the smallest and the largest of them both do
    same = F.filter(F.sequence(F.lit(0), F.size("low")), lambda k: (k <= F.size("high")) & (F.slice("low", F.lit(1), k) == F.slice("high", F.lit(1), k)))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("raw_text", text).withColumn("section_path", F.slice("low", F.lit(1), F.array_max(same)))
    span = F.array_distinct(F.transform("parts", lambda p: F.struct(p["node_id"].alias("node_id"), p["file"].alias("file"), p["row"].alias("row_start"), p["row"].alias("row_end"))))
    rows = rows.withColumn("source_spans", span).filter("raw_text <> ''")
    return rows.select("document_id", "doc_group", "tier", F.lit(stage).alias("stage"), "first", F.lit(half).alias("half"), F.col("no").cast("long").alias("no"), kind.alias("chunk_type"), role.alias("index_role"), "raw_text", "n_tokens", "section_path", "source_spans", "parent")


def _tree(rows: DataFrame, config: dict, n: int) -> list[DataFrame]:
    """Rows lie in n parts by document; packs are numbered there, and then the rows move to the same parts, since Spark does not
    know where rows that come from Python are."""

    def packed(rows: DataFrame, by: list[str], tokens: str, segments: str, name: str) -> DataFrame:
        return pack(rows, ["document_id", *by], _PLACE, "n", config[tokens], config[segments], name, placed=True).repartition(n, "document_id")

    periodic = F.col("doc_group") == "periodic"
    prose = _led(rows.filter("kind <> 'row'").withColumn("within", F.when(periodic, F.col("path"))), ["file", "within"])
    prose = packed(prose, ["file", "within"], "parent_tokens", "parent_segments", "top").withColumnRenamed("first", "top_first")
    kind = F.when(periodic, "SECTION_PARENT").when(F.col("doc_group") == "holding", "HOLDING_STATUS_PARENT").otherwise("EVENT_PARENT")
    tops = _assembled(pack_pieces(prose.withColumnRenamed("top_first", "first"), "top", config["parent_tokens"]), 0, 0, kind, F.lit("CONTEXT_ONLY"))
    paragraphs = _led(prose.filter("kind <> 'section'"), ["file", "path"])
    paragraphs = packed(paragraphs, ["file", "path"], "child_tokens", "child_segments", "pack")
    children = _assembled(pack_pieces(paragraphs, "pack", config["child_tokens"]), 1, 0, F.when(periodic, "PARAGRAPH_CHILD").otherwise("FIELD_GROUP_CHILD"), F.lit("RETRIEVAL"), _key(0, F.col("top_first"), 0, F.col("top")))
    table = packed(_led(rows.filter("kind = 'row'"), ["node_id"]), ["node_id"], "parent_tokens", "parent_segments", "whole")
    wholes = _assembled(pack_pieces(table, "whole", config["parent_tokens"]), 2, 0, F.lit("TABLE_WHOLE"), F.lit("CONTEXT_ONLY"))
    lines = pack_pieces(packed(table, ["node_id"], "row_tokens", "rows", "pack"), "pack", config["row_tokens"])
    lines = _assembled(lines, 2, 1, F.lit("TABLE_ROW"), F.when(auxiliary_row(F.col("raw_text")), "CONTEXT_ONLY").otherwise("RETRIEVAL"), _key(2, F.col("first"), 0, F.col("whole")))
    return [tops, children, wholes, lines]


def _parents(made: DataFrame) -> DataFrame:
    """``made`` with parent_chunk_id: of the parent by segments, else of the first top chunk of the same section path, else of
    the first one that shares a file. Only whole tables need the latter two. All windows are within a document, where its
    chunks lie, so that no text moves.
    """
    key, file = F.struct("stage", "first", "half", "no"), F.get("source_spans", F.lit(0))["file"]  # a top chunk has one file
    top = F.when((F.col("stage") == 0) & (F.col("index_role") != "AUDIT_ONLY"), F.struct(key.alias("key"), "chunk_id"))
    rows = made.withColumn("by_path", F.min(top).over(Window.partitionBy("document_id", "section_path"))).withColumn("file", file)
    rows = rows.withColumn("by_file", F.when(F.col("file").isNotNull(), F.min(top).over(Window.partitionBy("document_id", "file"))))
    rows = rows.withColumn("of", F.coalesce("parent", key))
    own = F.max(F.when((F.col("index_role") == "CONTEXT_ONLY") & (key == F.col("of")), F.col("chunk_id"))).over(Window.partitionBy("document_id", "of"))
    lost = F.when((F.col("stage") == 2) & (F.col("half") == 0), F.coalesce("by_path", "by_file")["chunk_id"])
    return rows.withColumn("own", own).withColumn("parent_chunk_id", F.when(F.col("parent").isNotNull(), F.col("own")).otherwise(lost)).drop("by_path", "by_file", "file", "of", "own")


def _optional(documents: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in documents.columns else F.lit(None)).cast(kind)


def embed_text(company: Column, report: Column, kind: Column, path: Column, raw: Column) -> Column:
    """The text that is embedded: the company, report, chunk type and section that are known, an empty line, the chunk."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    section = F.when(F.size(path) > 0, F.array_join(path, " > "))
    return F.concat(F.concat_ws("\n", line("기업", company), line("문서", report), line("청크유형", kind), line("섹션", section)), F.lit("\n\n"), raw)


def eligibility(documents: DataFrame) -> DataFrame:
    """(document_id, may_find, may_fact, warning_codes): whether a document's chunks may be found, and facts be read from them.

    The fallback tier and documents without nodes are out; facts need a document without PDF and without parse failure.
    Columns warnings (code) and source_files (content_format) count if they are there.
    """
    codes = F.array_sort(F.array_distinct(F.transform("warnings", lambda w: w["code"]))) if "warnings" in documents.columns else F.array().cast("array<string>")
    pdf = F.exists("source_files", lambda f: f["content_format"] == "pdf") if "source_files" in documents.columns else F.lit(False)
    whole = (F.coalesce("tier", F.lit("fallback")) != "fallback") & (F.size(F.coalesce("nodes", F.array().cast(documents.schema["nodes"].dataType))) > 0)
    rows = documents.select("document_id", whole.alias("may_find"), F.coalesce(codes, F.array().cast("array<string>")).alias("warning_codes"), F.coalesce(pdf, F.lit(False)).alias("pdf"))
    return rows.select("document_id", "may_find", (F.col("may_find") & ~F.col("pdf") & ~F.array_contains("warning_codes", "parse_failed")).alias("may_fact"), "warning_codes")


def mismatched_documents(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """document_id of parsed documents that the manifest does not have: they must not be chunked."""
    return documents.select("document_id").join(manifest.select("document_id"), "document_id", "left_anti")


def chunks(documents: DataFrame, config: dict = TREE, rows: DataFrame | None = None) -> DataFrame:
    """All chunks of documents (document_id, doc_group, tier, nodes), by one strategy.

    Documents without nodes have none; documents of the fallback tier have audit chunks only, windows over the whole
    document. Chunk ids are made of the document, the strategy, the chunk's number and its text. Columns listed_name,
    corp_name, filer_name, report_name, warnings and source_files of ``documents`` are used if they are there.
    rows: their segments(), if they were made before (for several strategies they need to be made once only). Segments move
    to the part of their document, where windows, chunks and their numbers are made without moving text again.
    """
    n = parts(documents.sparkSession, (documents.agg(F.sum(F.size("nodes"))) if rows is None else rows.agg(F.count("*"))).first()[0] or 0)
    rows = (segments(documents) if rows is None else rows).repartition(n, "document_id")
    audit = F.col("tier").eqNullSafe("fallback")
    if config["strategy"] == "hierarchical":
        whole = windows(rows.filter(audit).withColumn("all", F.lit(0)), ["all"], F.lit(512), F.lit(0))
        made = [_assembled(whole, 0, 0, F.lit("DOCUMENT_FALLBACK"), F.lit("AUDIT_ONLY")), *_tree(rows.filter(~audit), config, n)]
        out = all_of(*(x.coalesce(n) for x in made))  # by which Spark unites them as they are, in whatever parts they lie
    else:
        flat = config["strategy"] == "fixed-token"
        rows = rows.withColumn("of_file", F.when(~audit, F.col("file"))).withColumn("of_path", F.when(~audit, F.lit(None).cast("array<string>") if flat else F.col("path")))
        made = windows(rows, ["of_file", "of_path"], F.when(audit, 512).otherwise(config["max_tokens"]), F.when(audit, 0).otherwise(config["overlap"]))
        out = _assembled(made, 0, 0, F.when(audit, "DOCUMENT_FALLBACK").otherwise("FIXED_WINDOW" if flat else "SECTION_FLAT"), F.when(audit, "AUDIT_ONLY").otherwise("RETRIEVAL"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy(*_ORDER)) - 1
    digest = F.sha2("raw_text", 256)
    out = out.withColumn("chunk_index", index.cast("int")).withColumn("content_sha256", digest)
    name = F.concat_ws("\0", "document_id", F.lit(config["id"]), F.col("chunk_index").cast("string"), "raw_text")
    out = out.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.left(F.sha2(name, 256), F.lit(24))))
    if config["strategy"] == "hierarchical":
        out = _parents(out)
    else:
        out = out.withColumn("parent_chunk_id", F.lit(None).cast("string"))
    company = F.coalesce(*(_optional(documents, c) for c in ("listed_name", "corp_name", "filer_name")))
    about = eligibility(documents).join(documents.select(F.col("document_id").alias("a_doc"), company.alias("company"), _optional(documents, "report_name").alias("report")), F.col("document_id") == F.col("a_doc"))
    out = out.join(about.withColumnRenamed("document_id", "e_doc").drop("a_doc").repartition(n, "e_doc"), F.col("document_id") == F.col("e_doc"))
    embedded = embed_text(F.col("company"), F.col("report"), F.col("chunk_type"), F.col("section_path"), F.col("raw_text"))
    seen = F.col("index_role") != "CONTEXT_ONLY"
    out = out.withColumn("embed_text", embedded)
    return out.select(
        "document_id", "chunk_id", "chunk_index", "chunk_type", "index_role", "raw_text", "content_sha256", "n_tokens", "parent_chunk_id", "section_path", "source_spans",
        (F.col("may_find") & seen).alias("retrieval_eligible"), (F.col("may_fact") & seen).alias("fact_eligible"),
        "embed_text", F.sha2("embed_text", 256).alias("embed_sha256"), n_tokens(F.col("embed_text")).alias("n_embed_tokens"),
        F.concat(F.lit("duplicate_"), F.left("content_sha256", F.lit(24))).alias("duplicate_group_id"), "warning_codes",
    )


def manifest(chunks_: DataFrame, config: dict = TREE) -> DataFrame:
    """One row a document: (document_id, chunking_config_id, n_chunks, n_retrieval, n_tokens, chunks_sha256); the hash is of all chunk
    ids and contents in order."""
    line = F.struct("chunk_index", F.concat_ws(":", "chunk_id", "content_sha256").alias("of"))
    rows = chunks_.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if("retrieval_eligible").alias("n_retrieval"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(line)).alias("lines"))
    digest = F.sha2(F.array_join(F.transform("lines", lambda x: x["of"]), "\n"), 256)
    return rows.select("document_id", F.lit(config["id"]).alias("chunking_config_id"), "n_chunks", "n_retrieval", "n_tokens", digest.alias("chunks_sha256"))


def corpus_profile(chunks_: DataFrame) -> DataFrame:
    """(chunk_type, n_chunks, n_retrieval, n_tokens, n_embed_tokens, n_texts, duplicate_rate, n_embedded) by type, null for all types.

    n_texts: different texts of what may be found; n_embedded: different texts to embed.
    """
    found = F.col("retrieval_eligible")
    rows = chunks_.rollup("chunk_type").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(found).alias("n_retrieval"),
        F.coalesce(F.sum(F.when(found, F.col("n_tokens"))), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(found, F.col("n_embed_tokens"))), F.lit(0)).alias("n_embed_tokens"),
        F.count_distinct(F.when(found, F.col("content_sha256"))).alias("n_texts"),
        F.count_distinct(F.when(found, F.col("embed_sha256"))).alias("n_embedded"),
    )
    return rows.withColumn("duplicate_rate", F.round(F.try_divide(F.col("n_retrieval") - F.col("n_texts"), F.col("n_retrieval")), 6))


def duplicates(chunks_: DataFrame) -> DataFrame:
    """(fingerprint, n_rows, n_unique, n_duplicates, duplicate_rate) of what may be found: by exact text, by canonical text
    (white space and forms of characters aside), and by the text that is embedded; one pass, no group is collected."""
    prints = {"exact": F.col("content_sha256"), "canonical": F.sha2(canonical_text(F.col("raw_text")), 256), "embed": F.col("embed_sha256")}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("fingerprint"), of.alias("of")) for name, of in prints.items())))
    counts = chunks_.filter("retrieval_eligible").select(each.alias("e")).groupBy("e.fingerprint", "e.of").agg(F.count("*").alias("n"))
    total = counts.groupBy("fingerprint").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), F.sum(F.col("n") - 1).alias("n_duplicates"))
    return total.withColumn("duplicate_rate", F.round(F.try_divide(F.col("n_duplicates"), F.col("n_rows")), 6))


def problems(chunks_: DataFrame) -> DataFrame:
    """(rule, key, message) of what breaks a batch of chunks before it goes out: closed types, counts, hashes of texts, repeated
    ids and places, gaps in the places of a document, parents that are not in it. Texts are judged in one pass; what is left of
    the chunks without them is written once for all rules."""
    key = "chunk_id"
    rules = {
        "CHUNK_ID": (F.col(key).isNull() | (F.col(key) == ""), "chunk_id is missing"),
        "DOCUMENT_ID": (F.col("document_id").isNull(), "document_id is missing"),
        "CHUNK_TYPE": (~F.coalesce(F.col("chunk_type").isin(list(CHUNK_TYPES)), F.lit(False)), "chunk_type is not one of its values"),
        "TOKENS": (F.col("n_tokens").isNull() | (F.col("n_tokens") <= 0), "a chunk has tokens"),
        "CONTENT_HASH": (~F.col("content_sha256").eqNullSafe(F.sha2("raw_text", 256)), "content_sha256 is not that of the text"),
        "EMBED_HASH": (~F.col("embed_sha256").eqNullSafe(F.sha2("embed_text", 256)), "embed_sha256 is not that of the text"),
    }
    chunks_ = save(chunks_.select(key, "document_id", "chunk_index", "parent_chunk_id", *(bad.alias(f"breaks_{name}") for name, (bad, _) in rules.items())), "judged")
    rules = {name: (F.col(f"breaks_{name}"), message) for name, (_, message) in rules.items()}
    places = chunks_.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    gaps = places.filter("d <> n or low <> 0 or high <> n - 1").select(F.lit("PLACES").alias("rule"), F.col("document_id").alias("key"), F.lit("places must be 0 to n - 1, once each").alias("message"))
    return all_of(violations(chunks_, key, rules), unique(chunks_, key), gaps, chunk_parents(chunks_))


def per_document(chunks_: DataFrame) -> DataFrame:
    """One row: smallest, lower 50, 90 and 99 percent, and largest number of chunks that may be found of a document."""
    counts = chunks_.groupBy("document_id").agg(F.count_if("retrieval_eligible").alias("n"))
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)")
    return counts.agg(F.min("n").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("n").alias("most"))


def last_section(df: DataFrame, by: list[str], order: str, section: Column, name: str = "section") -> DataFrame:
    """Each row with the latest section seen so far in its document (as-of, in document order)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(section, ignorenulls=True).over(w))
