"""Deterministic content ids: prefix, underscore, 24 hex digits of the sha256 of the parts joined by NUL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import DOCUMENT_GROUPS, RELATION_TYPES

#: Kinds of ids: the prefix, and the parts whose hash follows. Fixed values. A document's id is its group and receipt number.
KINDS = {
    "file": ("file", ("document_id", "relative_path")),
    "section": ("section", ("file_id", "source_locator")),
    "chunk": ("chunk", ("strategy_id", "document_id", "ordinal", "content_fingerprint")),
    "event": ("event", ("corp_code", "event_type", "chain_id")),
    "chain": ("chain", ("doc_group", "corp_code", "stable_anchor")),
    "fact": ("fact", ("subject_id", "metric_code", "period_key", "scope", "version_id")),
    "evidence": ("evidence", ("document_id", "source_locator", "quote_sha256")),
    "usage": ("eval_usage", ("assignment_id", "run_id", "used_at")),
    "fact_coverage": ("fact_coverage_snapshot", ("corpus_snapshot_id", "semantic_bundle_version", "created_at")),
    "alias": ("alias", ("corp_code", "alias_type", "normalized_alias")),
    "coverage": ("coverage", ("corpus_snapshot_id", "corp_code", "doc_group", "period_key")),
    "relation": ("relation_candidate", ("source_document_id", "relation_type")),
}
#: What a part must be, where it has a shape or a closed vocabulary.
SHAPES = {"corp_code": "^[0-9]{8}$", "doc_group": f"^({'|'.join(DOCUMENT_GROUPS)})$", "relation_type": f"^({'|'.join(RELATION_TYPES)})$"}


def id_of(kind: str, strict: bool = False, **parts: Column | str) -> Column:
    """The id of a kind from its parts by name; null (an error if ``strict``) if a part is missing or not of its shape."""
    prefix, names = KINDS[kind]
    if set(parts) != set(names):
        raise ValueError(f"{kind} is made of {', '.join(names)}")
    given = {n: (F.col(p) if isinstance(p, str) else p).cast("string") for n, p in parts.items()}
    return stable_id(prefix, *(F.when(given[n].rlike(SHAPES[n]), given[n]) if n in SHAPES else given[n] for n in names), strict=strict)


def stable_id(prefix: str, *parts: Column | str, strict: bool = False) -> Column:
    """The id of the parts. If one is null or empty the id is null, or the query fails if ``strict``."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    missing = F.lit(False)
    for t in texts:
        missing = missing | t.isNull() | (t == "")
    made = F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\0", *texts), 256), 1, 24))
    return F.when(~missing, made).otherwise(F.raise_error(F.lit(f"{prefix}: a part of the id is missing")) if strict else F.lit(None).cast("string"))


def document_id(group: Column | str, receipt: Column | str) -> Column:
    """group_receipt, null unless the receipt number has 14 digits."""
    group, receipt = (F.col(x) if isinstance(x, str) else x for x in (group, receipt))
    return F.when(receipt.rlike("^[0-9]{14}$"), F.concat_ws("_", group, receipt))


def snapshot_id(manifest_sha: Column) -> Column:
    return F.concat(F.lit("corpus_"), F.substring(manifest_sha, 1, 16))
