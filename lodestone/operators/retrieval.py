"""Lexical, dense and hybrid retrieval, invariants of ranked results, and span recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.functions.vocabulary import METHOD_PARTS
from lodestone.sources.shared import dealt, save

K1, B, RRF_K = 1.2, 0.75, 60
#: Vectors in one block of a dense search, and numbers in them, scores that a task works on at once, results that it keeps, and
#: bytes of blocks in one Arrow batch, at most.
BLOCK, BLOCK_NUMBERS, AT_ONCE, RESULTS, BATCH_BYTES = 2048, 1_000_000, 250_000, 1_000_000, "4m"


#: Terms of queries that are looked for in one pass over the documents, rows of a table that is broadcast, and numbers that a
#: task holds at once to score documents (terms of theirs, times queries that have the term), at most.
BLOCK_TERMS, BROADCAST_ROWS, SCORES = 1_000_000, 1_000_000, 1_000_000


class Asked:
    """The terms of some queries: bounded, held by the driver and broadcast."""

    def __init__(self, queries: DataFrame, key: str, terms: Column, part: int = 0, parts: int = 1) -> None:
        rows = queries.select(F.col(key).alias("q"), terms.alias("terms")).filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part) if parts > 1 else queries.select(F.col(key).alias("q"), terms.alias("terms"))
        found = [(r["q"], r["terms"] or []) for r in rows.toLocalIterator()]
        self.keys = [q for q, _ in found]
        self.terms = sorted({t for _, terms in found for t in terms})
        to = {t: i for i, t in enumerate(self.terms, 1)}
        #: queries of each term, terms from 1 on; 0 stands for the document itself
        pairs = np.array([(to[t], i) for i, (_, terms) in enumerate(found) for t in terms], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.first, self.of = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 2)), pairs[:, 1]


def blocks_of(queries: DataFrame, terms: Column) -> int:
    """In how many parts the queries are to be taken, from a count of their own terms."""
    return -(-(queries.select(F.sum(F.size(terms))).first()[0] or 0) // BLOCK_TERMS)


def index(docs: DataFrame, key: str, terms: Column, asked: Asked) -> DataFrame:
    """(key, length, ids) of every document: its number of terms, and the ids of those that are asked for, with repeats.

    One pass over the documents, written to the shared folder; of other terms nothing moves.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([("", 0), *((t, i) for i, t in enumerate(asked.terms, 1))], "term string, id int")
    rows = docs.select(F.col(key).alias("key"), terms.alias("terms"))
    # the empty term stands for the document, so that none is lost; no real term is empty
    each = rows.select("key", F.size("terms").alias("length"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    found = each.join(F.broadcast(table), "term").groupBy("key", "length").agg(F.collect_list(F.when(F.col("id") > 0, F.col("id"))).alias("ids"))
    return save(found, "index")


def _frequencies(indexed: DataFrame, asked: Asked) -> np.ndarray:
    """In how many documents each term stands; a number a term."""
    out = np.zeros(len(asked.terms) + 1)
    for r in indexed.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").count().toLocalIterator():
        out[r["id"]] = r["count"]
    return out


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, digits: int = 6) -> DataFrame:
    """(query, key, rank, score) of the ``k`` best documents of each query by BM25 (k1 1.2, b 0.75).

    The documents are read once for each BLOCK_TERMS terms of the queries: their index is saved, document frequencies and the
    mean length come from it, and a task scores its documents against all queries and gives the k best of each. Equal
    scores are ranked by key.
    """
    lowered = lambda c: tokens(F.lower(F.coalesce(c, F.lit(""))))
    distinct = F.array_distinct(lowered(query_text))
    parts, out = max(1, blocks_of(queries, distinct)), None
    for part in range(parts):
        asked = Asked(queries, query_key, distinct, part, parts)
        indexed = index(docs, key, lowered(text), asked)
        n, mean = indexed.agg(F.count("*"), F.avg("length")).first()
        found = _best(indexed, asked, _frequencies(indexed, asked), n, mean or 1.0, k, digits)
        names = docs.sparkSession.createDataFrame(list(enumerate(asked.keys)), f"q int, query_key {queries.schema[query_key].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "q").select(F.col("query_key").alias(query_key), F.col("key").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc(), key))
    return out.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select(query_key, key, "rank", "score")


def _best(indexed: DataFrame, asked: Asked, df: np.ndarray, n: int, mean: float, k: int, digits: int) -> DataFrame:
    """(q, key, score) of the k best documents of each query in each partition."""
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    first, of, n_queries, n_terms = asked.first, asked.of, len(asked.keys), len(asked.terms) + 1
    held = indexed.sparkSession.sparkContext.broadcast((idf, first, of))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, first, of = held.value
        floor, kept = np.full(n_queries, np.finfo(float).tiny), (np.zeros(0, np.int64), np.zeros(0), None)
        for whole in batches:
            counts = whole.column(2).value_lengths().to_numpy()
            work = np.cumsum(n_queries + np.add.reduceat(np.append((first[1:] - first[:-1])[whole.column(2).flatten().to_numpy()], 0), np.append(0, np.cumsum(counts)[:-1])) * (counts > 0))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + SCORES, side="right")))
                batch, at = whole.slice(at, to - at), to
                ids, length = batch.column(2), batch.column(1).to_numpy().astype(float)
                doc = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy())
                pair, tf = np.unique(doc * n_terms + ids.flatten().to_numpy(), return_counts=True)
                d, t = pair // n_terms, pair % n_terms
                w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / mean))
                many = first[t + 1] - first[t]
                q = of[np.repeat(first[t] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                s = np.bincount(np.repeat(d, many) * n_queries + q, np.repeat(w, many), batch.num_rows * n_queries).reshape(-1, n_queries)
                s = np.floor(s * 10**digits + 0.5) / 10**digits
                r, c = np.nonzero(s >= floor)
                keys = batch.column(0).take(pa.array(r))
                kept = _kept(np.concatenate([kept[0], c]), np.concatenate([kept[1], s[r, c]]), keys if kept[2] is None else pa.concat_arrays([kept[2], keys]), k)
                full = np.bincount(kept[0], minlength=n_queries) >= k
                if full.any():
                    floor[full] = np.minimum.reduceat(kept[1], np.searchsorted(kept[0], np.flatnonzero(full)))
        if kept[2] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), kept[2], pa.array(kept[1])], names=["q", "key", "score"])

    return indexed.mapInArrow(scored, f"q int, key {dict(indexed.dtypes)['key']}, score double")


def _kept(q: np.ndarray, score: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each query the k rows of the largest scores, ties to the smaller key; by query."""
    by_key = np.empty(len(q), np.int64)
    by_key[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(q))
    order = np.lexsort((by_key, -score, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    order = order[place < k]
    return q[order], score[order], keys.take(pa.array(order))


def containing(docs: DataFrame, key: str, text: str, quotes: DataFrame, quote_key: str, quote: str) -> DataFrame:
    """(quote key, key) of the documents that contain a quote as it stands, found by the quote's rarest inner token.

    The documents are read once for an index of the quotes' inner tokens, and once for their texts, against the quotes that
    their tokens allow. A quote of fewer than three tokens has none that must stand whole in the text, so it meets every
    document. Empty quotes stand in every text; null ones in none.
    """
    inner = F.array_distinct(F.slice(tokens(F.col(quote)), F.lit(2), F.greatest(F.lit(0), F.size(tokens(F.col(quote))) - 2)))
    quotes = quotes.filter(F.col(quote).isNotNull())
    long, short = quotes.filter(F.size(inner) > 0), quotes.filter(F.size(inner) == 0)
    spark, parts, pairs = docs.sparkSession, blocks_of(long, inner), None
    for part in range(parts):
        asked = Asked(long, quote_key, inner, part, parts)
        indexed = index(docs, key, tokens(F.coalesce(F.col(text), F.lit(""))), asked)
        df, rarest = _frequencies(indexed, asked), {}
        for t in range(1, len(asked.terms) + 1):
            for q in asked.of[asked.first[t] : asked.first[t + 1]].tolist():
                if q not in rarest or df[t] < df[rarest[q]]:
                    rarest[q] = t
        table = spark.createDataFrame([(t, asked.keys[q]) for q, t in rarest.items()], f"id int, q {quotes.schema[quote_key].dataType.simpleString()}")
        found = indexed.select("key", F.explode(F.array_distinct("ids")).alias("id")).join(F.broadcast(table), "id").select("key", "q")
        pairs = found if pairs is None else pairs.unionByName(found)
    kinds = f"key {docs.schema[key].dataType.simpleString()}, q {quotes.schema[quote_key].dataType.simpleString()}"
    pairs = save(pairs, "pairs") if pairs is not None else spark.createDataFrame([], kinds)
    # texts stay where they are as long as the pairs are few
    some = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
    words = long.select(F.col(quote_key).alias("q"), F.col(quote).alias("quote"))
    words = F.broadcast(words) if parts <= 1 else words
    held = docs.select(F.col(key).alias("own"), F.col(text).alias("whole"))
    hits = held.join(some, F.col("own") == F.col("key")).join(words, "q").filter(F.col("whole").contains(F.col("quote"))).select("q", "own")
    if short.head(1):
        every = short.select(F.col(quote_key).alias("q"), F.col(quote).alias("quote"))
        few = every.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        hits = hits.unionByName(held.join(F.broadcast(every) if few else every, F.col("whole").contains(F.col("quote"))).select("q", "own"))
    return hits.select(F.col("q").alias(quote_key), F.col("own").alias(key))


#: The most results that a request may ask for. Fixed value.
MOST_RESULTS = 100


def request_code(request: dict, pinned: dict) -> str | None:
    """Why a retrieval request is refused before any search; None if it may run. A check of two small dictionaries."""
    if any(not request.get(k) for k in ("query_id", "retrieval_method", *pinned)) or request["retrieval_method"] not in METHOD_PARTS:
        return "RETRIEVER_INVALID_REQUEST"
    if not isinstance(request.get("top_k"), int) or not 1 <= request["top_k"] <= MOST_RESULTS:
        return "RETRIEVER_INVALID_REQUEST"
    return "RETRIEVER_SNAPSHOT_MISMATCH" if any(request[k] != v for k, v in pinned.items()) else None


def retrieve(request: dict, pinned: dict, search) -> tuple[str, DataFrame | None]:
    """(code, results): the envelope around a search, a function of the request that gives (query_id, chunk_id, rank, score).

    The request is checked first; without a search the retriever is unavailable, which is not the same as no results; a
    search that fails, or results that break a rule of ranked lists, are refused. OK else.
    """
    if code := request_code(request, pinned):
        return code, None
    if search is None:
        return "RETRIEVER_UNAVAILABLE", None
    try:
        found = search(dict(request))
    except Exception:  # whatever the search raises is the same refusal
        return "RETRIEVER_ADAPTER_ERROR", None
    if not {"query_id", "chunk_id", "rank", "score"} <= set(found.columns) or invariants(found, "query_id", "chunk_id", request["top_k"]).head(1):
        return "RETRIEVER_INVALID_RESULT", None
    if found.filter(~F.col("query_id").eqNullSafe(F.lit(request["query_id"]))).head(1):
        return "RETRIEVER_REQUEST_RESULT_MISMATCH", None
    return "OK", found


def _packed(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Blocks of vectors of a bounded size, one a row, without a shuffle: (name_keys, name_sizes, name_data), numbers as bytes.

    Vectors that are null, empty or hold a null have size 0. Rows without a key are left out.
    """
    whole = F.when(~F.exists(value, lambda x: x.isNull()), F.col(value).cast("array<double>"))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), whole.alias("v"))
    names = [f"{name}_keys", f"{name}_sizes", f"{name}_data"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, v = batch.column(0).to_numpy(), batch.column(1)
            sizes = v.value_lengths().fill_null(0).to_numpy().astype(np.int32)
            data, ends = v.flatten().to_numpy(), np.append(0, np.cumsum(sizes, dtype=np.int64))
            n = max(1, min(BLOCK, BLOCK_NUMBERS // max(1, int(sizes.max(initial=0)))))
            for a in range(0, len(keys), n):
                z = min(a + n, len(keys))
                row = (keys[a:z], sizes[a:z], data[ends[a] : ends[z]])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=names)

    return rows.mapInArrow(pack, ", ".join(f"{n} binary" for n in names))


_NULL, _NAN, _SAME = -2.0, 2.0, -3.0  # stand for scores; a cosine lies between


def _scores(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], digits: int) -> np.ndarray:
    """Rounded cosines of two blocks, (keys, sizes, data) each, by query and candidate."""
    out = np.full((len(q[0]), len(c[0])), _NULL)
    for d in np.intersect1d(q[1], c[1]):
        if not d:
            continue
        at = [np.flatnonzero(x[1] == d) for x in (q, c)]
        a, b = (x[2][np.repeat(x[1] == d, x[1])].reshape(-1, d) for x in (q, c))
        with np.errstate(all="ignore"):
            norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
            s = (a @ b.T) / norms
            s = np.sign(s) * np.floor(np.abs(s) * 10**digits + 0.5) / 10**digits
        s[np.isnan(s)] = _NAN
        s[norms == 0] = _NULL
        out[np.ix_(*at)] = s
    out[q[0][:, None] == c[0]] = _SAME
    return out


def _nearest(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, key) of the k best of block c for each query of block q, a few queries at once."""
    ends = np.append(0, np.cumsum(q[1], dtype=np.int64))
    order = np.argsort(c[0], kind="stable")  # so that the first of equal scores has the smaller key
    step, found = max(1, AT_ONCE // max(1, len(order))), []
    for a in range(0, len(q[0]), step):
        z = min(a + step, len(q[0]))
        s = _scores((q[0][a:z], q[1][a:z], q[2][ends[a] : ends[z]]), c, digits)[:, order]
        keep = s > _SAME
        if s.shape[1] > k:
            least = np.partition(s, -k, axis=1)[:, -k, None]
            above, ties = s > least, s == least
            keep &= above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
        i, j = np.nonzero(keep)
        found.append((q[0][a:z][i], s[i, j], c[0][order[j]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def dense(vectors: DataFrame, key: str, value: str, queries: DataFrame, query_key: str, query_value: str, k: int, digits: int = 6) -> DataFrame:
    """(query, key, rank, score) by cosine, exactly, for any number of queries; keys are whole numbers.

    Every block of queries meets every block of vectors; a task keeps the k best of each query over the blocks that it meets,
    and these are ranked together. No block is larger than a bound, and none is collected. The session's Arrow batches are small
    from then on.
    """

    def results(kept: tuple[np.ndarray, np.ndarray, pa.Array]) -> pa.RecordBatch:
        q, found, keys = kept
        return pa.RecordBatch.from_arrays([pa.array(q), keys, pa.array(np.where(found == _NAN, np.nan, found), mask=found == _NULL)], names=["q", "c", "score"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = none = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.int64())
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                x = [np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, (np.int64, np.int32, np.float64) * 2, strict=True)]
                # one list a query for all blocks that this task meets
                q, score, keys = _nearest(tuple(x[:3]), tuple(x[3:]), k, digits)
                kept = _kept(np.concatenate([kept[0], q]), np.concatenate([kept[1], score]), pa.concat_arrays([kept[2], pa.array(keys)]), k)
                if len(kept[0]) > RESULTS:
                    yield results(kept)
                    kept = none
        yield results(kept)

    # else a batch has all blocks that a task meets
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    pairs = _packed(queries, query_key, query_value, "q").crossJoin(_packed(vectors, key, value, "c"))
    rows = pairs.mapInArrow(best, "q long, c long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc_nulls_last(), "c"))
    kinds = {query_key: queries.schema[query_key].dataType, key: vectors.schema[key].dataType}
    ranked = rows.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").cast(kinds[query_key]).alias(query_key), F.col("c").cast(kinds[key]).alias(key), "rank", "score")


def rrf(lists: list[DataFrame], query_key: str, key: str, k: int, constant: int = RRF_K, digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, key, rank)."""
    every = lists[0].select(query_key, key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(query_key, key, "rank"))
    fused = every.groupBy(query_key, key).agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc(), key))
    return fused.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def filtered(chunks: DataFrame, any_of: dict[str, list]) -> DataFrame:
    """Chunks that may be found: eligible, and with an admitted value in every restricted column."""
    keep = F.col("retrieval_eligible")
    for column, values in any_of.items():
        if values:
            keep = keep & F.col(column).isin(values)
    return chunks.filter(keep)


def envelopes(requests: DataFrame, results: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """(request_id, code) of every request: why it, or what was found for it, is refused, OK if neither is.

    requests: (request_id, query_id, retrieval_method, top_k, the names of ``pinned``, available: whether there is a retriever
    for it); results: (request_id, query_id, chunk_id, rank, score). A request is checked before its results; no retriever is
    not the same as no results. Each table moves once, by request, in parts of a bounded number of rows.
    """
    requests, results = dealt((requests, ["request_id"]), (results, ["request_id"]))
    missing = F.lit(False)
    for name in ("request_id", "query_id", "retrieval_method", *pinned):
        missing |= F.col(name).isNull() | (F.col(name).cast("string") == "")
    invalid = missing | ~F.coalesce(F.col("retrieval_method").isin(list(METHOD_PARTS)), F.lit(False)) | ~F.coalesce(F.col("top_k").between(1, MOST_RESULTS), F.lit(False))
    moved = F.lit(False)
    for name, value in pinned.items():
        moved |= F.col(name) != value
    asked = requests.select("request_id", F.col("query_id").alias("asked_id"), "top_k")
    found = results.join(asked, "request_id")
    broken = invariants(found, "request_id", "chunk_id", F.col("top_k")).select(F.col("request_id").alias("r_id")).distinct().withColumn("broken", F.lit(True))
    other = found.filter(~F.col("query_id").eqNullSafe(F.col("asked_id"))).select(F.col("request_id").alias("o_id")).distinct().withColumn("other", F.lit(True))
    rows = requests.join(broken, F.col("request_id") == F.col("r_id"), "left").join(other, F.col("request_id") == F.col("o_id"), "left")
    code = F.when(invalid, "RETRIEVER_INVALID_REQUEST").when(moved, "RETRIEVER_SNAPSHOT_MISMATCH").when(~F.coalesce("available", F.lit(False)), "RETRIEVER_UNAVAILABLE")
    code = code.when(F.col("broken"), "RETRIEVER_INVALID_RESULT").when(F.col("other"), "RETRIEVER_REQUEST_RESULT_MISMATCH").otherwise("OK")
    return rows.select("request_id", code.alias("code"))


def invariants(results: DataFrame, query_key: str, key: str, top_k: int | Column) -> DataFrame:
    """(query, code) for ranked results that break a rule: ranks from 1 without gaps, falling scores, no repeats, at most top_k."""
    w = Window.partitionBy(query_key).orderBy("rank", key)
    rows = results.withColumn("before", F.lag("score").over(w)).withColumn("at", F.row_number().over(w)).withColumn("copies", F.count("*").over(Window.partitionBy(query_key, key)))
    code = F.array_compact(F.array(F.when(F.col("rank") != F.col("at"), "RANK_NOT_CONTIGUOUS"), F.when(F.col("score") > F.col("before"), "SCORE_NOT_SORTED"), F.when(F.col("copies") > 1, "DUPLICATE_CHUNK"), F.when(F.col("at") > top_k, "TOO_MANY_RESULTS")))
    return rows.select(query_key, F.explode(code).alias("code")).distinct()


def missing_components(method: Column, present: Column) -> Column:
    """Component scores that a method must have and ``present`` (an array of names) lacks."""
    needed = F.array().cast("array<string>")
    for name, parts in METHOD_PARTS.items():
        needed = F.when(method == name, F.array(*(F.lit(p) for p in parts))).otherwise(needed)
    return F.array_except(needed, present)


def overlaps(a: DataFrame, b: DataFrame, same: list[str], width: int = 1024) -> DataFrame:
    """Rows of a and b that share ``same`` and whose closed row ranges (a_start, a_end; b_start, b_end) overlap.

    Ranges meet in bins of ``width`` rows: each is in the bins that it touches, and a pair is made only in the bin where the
    later of the two starts. So a document with very many ranges is spread over its bins, and ranges that are far apart
    never meet. Ranges that are null or end before they start overlap nothing.
    """
    binned = lambda df, x: df.filter(F.col(f"{x}_start") <= F.col(f"{x}_end")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{x}_start") / width), F.floor(F.col(f"{x}_end") / width))))
    meet = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.floor(F.greatest("a_start", "b_start") / width) == F.col("_bin"))
    return binned(a, "a").join(binned(b, "b"), [*same, "_bin"]).filter(meet).drop("_bin")


def recall_mrr(results: DataFrame, relevant: DataFrame, query_key: str, key: str, cuts: tuple[int, ...] = (1, 5, 10), digits: int = 6) -> DataFrame:
    """One row: share of queries with a relevant result among the first n, for each cut, and the mean reciprocal rank to 10."""
    hits = results.join(relevant.select(query_key, key).distinct(), [query_key, key], "left_semi").groupBy(query_key).agg(F.min("rank").alias("first"))
    every = relevant.select(query_key).distinct().join(hits, query_key, "left")
    shares = [F.round(F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0)), digits).alias(f"recall_{n}") for n in cuts]
    return every.agg(F.count("*").alias("n_queries"), *shares, F.round(F.avg(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)), digits).alias("mrr_10"))
