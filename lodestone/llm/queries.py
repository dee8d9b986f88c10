"""The thin queries over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import centroids, decontaminate, hmm, language, line_dedup, manifest, mixing, neighbours, pii, quality, set_join, suffix_dedup, tokens
from lodestone.llm.common import table

#: Words that DuckDB's patterns need: white space, and a line's ends.
_SPACES = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("h")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS[:4]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_groups(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.vectors(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(rows.filter(F.col("id") % 20 == 0), rows, 20)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    samples = language.learn(docs.filter(remainder(3) != 1))
    found = language.predict(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    gone = F.col("n_bytes") - F.length("kept")
    return cut.select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), remainder(5) == 1)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.vectors(table(spark, sf_dir, "embeddings"), 64)
    found = centroids.cluster(rows, 8, 10, 64, F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"), 256))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = quality.learn(docs.filter(~held_out), table(spark, sf_dir, "labels"), "quality")
    found = quality.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = manifest.leaf([low if c == "text" else F.col(c) for c in columns])
    found = manifest.manifest(table(spark, sf_dir, "documents"), columns, other=F.when(remainder(5) == 0, tampered))
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", "doc_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_set_join": op3_set_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_neighbours": op5_neighbours,
    "op6_language": op6_language,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_hmm": op8_hmm,
    "op9_tokens": op9_tokens,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroids": op11_centroids,
    "op12_quality": op12_quality,
    "op13_manifest": op13_manifest,
}

ORACLE_SQL = {
    "op4_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
               FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
        hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), lambda a, b: a + b) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op10_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d),
        k AS (SELECT doc_id, line, n, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        t AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.*, (t.key IS NOT NULL AND t.low <> k.doc_id) AS gone FROM k LEFT JOIN t ON k.key = t.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}


def _clusters_sql(k: int, rounds: int, width: int) -> str:
    """op11 in SQL: a table of the centroids after each round, then the last assignment."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = lambda r: f"SELECT v.n, v.vec_id, v.x, min((({far})::BIGINT, c.z)) AS best FROM v, c{r} c GROUP BY ALL"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS z, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))""",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest(r)})")
        parts.append(f"m{r} AS MATERIALIZED (SELECT best[2] AS z, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, {width + 1})) AS t(i) GROUP BY ALL)")
        parts.append(f"u{r} AS MATERIALIZED (SELECT z, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY z)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.z, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u USING (z))")
    parts.append(f"a AS ({nearest(rounds)})")
    return f"""WITH {', '.join(parts)}
        SELECT a.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, a.best[1] AS distance, CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a JOIN c{rounds} c ON c.z = a.best[2]"""


def _manifest_sql(levels: int = 4) -> str:
    """op13 in SQL, for trees of up to 16**levels nodes: each level from the one below, a tree's root as soon as one node is left;
    then the siblings of every leaf, and what it folds to."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 by its bits: DuckDB has no function for it
    byte = "(list_reduce(list_prepend(xor(acc, CAST(unicode(s[i]) AS BIGINT)), range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, source, {leaf('text')} AS leaf, {leaf(low)} AS other, CAST(doc_id AS VARCHAR) AS s FROM documents)",
        f"""crc AS MATERIALIZED (WITH RECURSIVE r(n, s, i, acc) AS (SELECT n, s, 1::BIGINT, 4294967295::BIGINT FROM d WHERE s IS NOT NULL UNION ALL SELECT n, s, i + 1, {byte} FROM r WHERE i <= length(s)) SELECT n, xor(acc, 4294967295) % 5 = 0 AS hit FROM r WHERE i = length(s) + 1)""",
        "l AS MATERIALIZED (SELECT d.n, doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS x0, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, d.n) - 1 AS i FROM d LEFT JOIN crc USING (n))",
        "s0 AS MATERIALIZED (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS width FROM l)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i, CASE WHEN below = 1 THEN first ELSE sha256(joined) END AS h, count(*) OVER (PARTITION BY tree) AS width FROM (SELECT tree, i // 16 AS i, max(width) AS below, min(h) AS first, string_agg(h, '' ORDER BY i) AS joined FROM {name}{k} GROUP BY tree, i // 16))")

    climb("s")
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS tree, tree - 1 AS i, h, count(*) OVER () AS width FROM s{levels})")
    climb("t")
    rows, steps = "SELECT n, doc_id, leaf, tree, i, x0 AS x, '' AS proof FROM l", 0
    for name, at in (("s", "q.tree"), ("t", "0")):
        for k in range(levels):
            place = "q.i" if name == "s" else "q.tree - 1"
            own = f"({place}) // {16**k}"
            # left and right siblings of the node on the path, none where the tree has one node
            side = lambda op: f"coalesce((SELECT string_agg(w.h, '' ORDER BY w.i) FROM {name}{k} w WHERE w.tree = {at} AND w.i // 16 = ({own}) // 16 AND w.i {op} {own} AND w.width > 1), '')"  # noqa: B023, E731
            parts.append(f"p{steps} AS MATERIALIZED (SELECT q.*, {side('<')} AS a, {side('>')} AS b, (SELECT max(w.width) FROM {name}{k} w WHERE w.tree = {at}) AS width FROM ({rows}) q)")
            rows = f"SELECT n, doc_id, leaf, tree, i, CASE WHEN width > 1 THEN sha256(a || x || b) ELSE x END AS x, proof || a || b AS proof FROM p{steps}"
            steps += 1
    return f"""WITH {', '.join(parts)}
        SELECT q.doc_id, q.leaf, s.h AS subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.x AS folded_root, q.x = t.h AS verified FROM ({rows}) q JOIN s{levels} s ON s.tree = q.tree, t{levels} t"""


ORACLE_SQL |= {"op11_centroids": _clusters_sql(8, 10, 64), "op13_manifest": _manifest_sql()}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL |= {
    "op3_set_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_SPACES}') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
        n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, u.b FROM reach JOIN u ON reach.o = u.a),
        m AS (SELECT reach.r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = reach.o GROUP BY reach.r)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN m USING (r)
    """,
}
