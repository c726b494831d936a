"""BM25 as tables: postings, lengths and term weights; a query costs its terms' postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import lexical_tokens, token_line
from ..plans.durable import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
PLACES = 9
#: Queries, and terms of them, that are sent to all documents; more meet the documents' postings in joins.
QUERY_BLOCK, QUERY_TERMS = 4096, 1 << 18
#: Characters of token lines that are split at once, and scores that are held at once.
CHARS, PRODUCT = 1 << 22, 1 << 21


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, id, tf."""
    rows = docs.select(F.col(id_col).alias("id"), F.explode(lexical_tokens(F.col(text_col))).alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, len: tokens of every document, those without any included."""
    return docs.select(F.col(id_col).alias("id"), F.size(lexical_tokens(F.col(text_col))).cast("long").alias("len"))


def weights(df: DataFrame, n: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """term, df, idf of terms (term, df) in n documents (one row): ln(n - df + 0.5) - ln(df + 0.5); negative ones become epsilon times the mean over terms."""
    raw = df.join(F.broadcast(n.select("docs"))).select("term", "df", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def idf(posted: DataFrame, sizes: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """weights() of stored postings and lengths."""
    return weights(posted.groupBy("term").agg(F.count("*").alias("df")), sizes.agg(F.count("*").alias("docs")), epsilon)


def slices(lines: pa.Array) -> Iterator[tuple[int, int]]:
    """(s, e): runs of rows with CHARS characters or a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    s = 0
    while s < len(ends):
        before = ends[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(ends, before + CHARS, "right")))
        yield s, e
        s = e


def split_lines(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(the row of each token, its number, the tokens by number) of token lines."""
    parts = pc.split_pattern(lines, " ")
    coded = parts.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lines)), pc.fill_null(parts.value_lengths(), 0).to_numpy(zero_copy_only=False))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    token = code != pc.index(coded.dictionary, "").as_py()
    return owner[token], code[token], coded.dictionary


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """A written table of rows (id, line), which are read once: for each row id, len, codes and tfs of the terms that it holds, as places in the list; for each task's pieces
    term and df of all tokens. What a row isn't for is null."""
    kind = docs.schema["id"].dataType
    told = docs.sparkSession.sparkContext.broadcast(terms)
    names = ["id", "len", "codes", "tfs", "term", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(told.value, pa.string())
        ints = pa.list_(pa.int32())
        for batch in batches:
            for s, e in slices(batch.column(1)):
                owner, code, words = split_lines(batch.column(1).slice(s, e - s))
                n, v = e - s, max(len(words), 1)
                pair, tf = np.unique(owner * v + code, return_counts=True)
                row, word = pair // v, pair % v
                place = pc.fill_null(pc.index_in(words, asked), -1).to_numpy(zero_copy_only=False)
                held = place[word] >= 0 if len(word) else np.zeros(0, bool)
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[held], minlength=n))].astype(np.int32))
                listed = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place[word[held]] if len(word) else tf, tf[held])]
                none = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, n), pa.array(np.bincount(owner, minlength=n)), *listed, *none], names)
                df = np.bincount(word, minlength=len(words))
                seen = np.flatnonzero(df)
                none = [pa.nulls(len(seen), t) for t in (batch.column(0).type, pa.int64(), ints, ints)]
                yield pa.RecordBatch.from_arrays([*none, words.take(pa.array(seen)), pa.array(df[seen])], names)

    return stored(docs.select("id", "line").mapInArrow(run, f"id {kind.simpleString()}, len long, codes array<int>, tfs array<int>, term string, df long"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, term, qtf: a repeated word counts as often as it stands."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.explode(lexical_tokens(F.col(text_col))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def scored(hits: DataFrame, idfs: DataFrame, n: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, id, score of every document that has a query term, from its postings with lengths (term, id, tf, len), weights() and n (docs, mean)."""
    hits = hits.join(terms.join(idfs, "term"), "term").join(F.broadcast(n.select("mean")))
    part = F.col("qtf") * F.col("idf") * weight(F.col("tf"), F.col("len"), F.col("mean"))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), PLACES).alias("score"))


def ranked(found: DataFrame, asked: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: each query's k best of all ids, by score, then id; what isn't in found scores 0.

    A query with k positive scores needs no other document. For the rest the smallest ids that they haven't found do: k and
    as many more as such a query has found at most.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    place = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = stored(place(found))
    full = top.where("score > 0").groupBy("query_id").count().where(F.col("count") >= k)
    few = stored(asked.select("query_id").distinct().join(full, "query_id", "left_anti"))
    if few.isEmpty():
        return top.select("query_id", "rank", "id", "score")
    had = stored(found.join(few, "query_id", "left_semi").select("query_id", "id"))
    most = had.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    first = ids.select("id").distinct().orderBy("id").limit(k + most).agg(F.collect_list("id").alias("ids"))
    rest = few.select("query_id").join(F.broadcast(first)).select("query_id", F.explode("ids").alias("id"))
    rest = rest.join(had, ["query_id", "id"], "left_anti")
    return place(top.select("query_id", "id", "score").unionByName(rest.withColumn("score", F.lit(0.0)))).select("query_id", "rank", "id", "score")


def statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df), and docs and mean length in one row, of counted() documents."""
    df = docs.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    return df, docs.where("codes is not null").agg(F.count("*").alias("docs"), (F.sum("len") / F.count("*")).alias("mean"))


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, positive: bool = False, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text_col: str = "text") -> DataFrame:
    """query_id, rank, id, score of each query's k best documents; documents without a query term score 0.

    `positive` leaves out scores of 0 and below. Texts are tokenised once, into what the statistics and the query terms need. Up to
    QUERY_BLOCK queries are scored where the documents are, and each batch of documents keeps k a query; of more queries, documents' terms are joined to them.
    Rows that repeat an id are documents of their own.
    """
    terms = query_terms(queries, query_col, query_text_col)
    first = terms.limit(QUERY_TERMS + 1).collect()
    names = [r[0] for r in queries.select(query_col).distinct().limit(QUERY_BLOCK + 1).collect()]
    lines = docs.select(F.col(id_col).alias("id"), token_line(F.col(text_col)).alias("line"))
    if len(first) > QUERY_TERMS or len(names) > QUERY_BLOCK:
        return _joined_top_k(docs, queries, terms, k, positive, id_col, text_col, query_col)
    words = sorted({r["term"] for r in first})
    held = counted(lines, words)
    df, n = statistics(held)
    asked = queries.sparkSession.createDataFrame([(w,) for w in words], "term string")
    found = {r["term"]: r["idf"] for r in weights(df, n).join(F.broadcast(asked), "term").select("term", "idf").collect()}
    mean = n.first()["mean"]
    code, place = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(names)}
    each = sorted((code[r["term"]], place[r["query_id"]], r["qtf"]) for r in first)
    starts = np.searchsorted([t for t, _, _ in each], np.arange(len(words) + 1))
    idfs = np.array([found.get(w, 0.0) for w in words], np.float64)
    kind, qkind = held.schema["id"].dataType.simpleString(), queries.schema[query_col].dataType
    told = held.sparkSession.sparkContext.broadcast((pa.array(names, to_arrow_type(qkind)), starts, np.array([q for _, q, _ in each], np.int64), np.array([c for _, _, c in each], np.float64), idfs))

    def scores(codes: pa.Array, tfs: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Documents x queries."""
        names, starts, query, times, idf = told.value
        out = np.zeros(len(sizes) * len(names))
        row = np.repeat(np.arange(len(sizes)), codes.value_lengths().to_numpy(zero_copy_only=False))
        term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (codes, tfs))
        part = idf[term] * weight(tf.astype(np.float64), sizes[row].astype(np.float64), mean)
        many = starts[term + 1] - starts[term]
        # A term's queries, in runs of PRODUCT terms of queries at most.
        bounds = np.r_[0, np.cumsum(many)]
        s = 0
        while s < len(term):
            e = max(s + 1, int(np.searchsorted(bounds, bounds[s] + PRODUCT, "right")) - 1)
            own = np.repeat(np.arange(s, e), many[s:e])
            at = starts[term[own]] + np.arange(len(own)) - (bounds[own] - bounds[s])
            np.add.at(out, row[own] * len(names) + query[at], times[at] * part[own])
            s = e
        return np.round(out, PLACES).reshape(len(sizes), len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = told.value[0]
        step = max(1, PRODUCT // max(1, len(names)))
        for batch in batches:
            batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
            for at in range(0, batch.num_rows if len(names) else 0, step):
                part = batch.slice(at, step)
                got = scores(part.column(2), part.column(3), part.column(1).to_numpy())
                best = np.argsort(-got, axis=0, kind="stable")[:k]
                query = np.broadcast_to(np.arange(len(names)), best.shape)
                score = np.take_along_axis(got, best, axis=0)
                kept = score > 0 if positive else np.ones(best.shape, bool)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query[kept])), part.column(0).take(pa.array(best[kept])), pa.array(score[kept])], ["query_id", "id", "score"])

    near = held.where("codes is not null").select("id", "len", "codes", "tfs").mapInArrow(run, f"query_id {qkind.simpleString()}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _joined_top_k(docs: DataFrame, queries: DataFrame, terms: DataFrame, k: int, positive: bool, id_col: str, text_col: str, query_col: str) -> DataFrame:
    """top_k() for any number of queries."""
    toks = docs.select(F.col(id_col).alias("id"), lexical_tokens(F.col(text_col)).alias("toks"))
    df, n = statistics(counted(docs.select(F.col(id_col).alias("id"), token_line(F.col(text_col)).alias("line")), []))
    each = toks.select("id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
    hits = each.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    found = scored(hits, weights(df, n), n, terms)
    if positive:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    return ranked(found, queries.select(F.col(query_col).alias("query_id")), toks, k)


def upsert(posted: DataFrame, sizes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings and lengths with the given documents new or replaced; weights are aggregates and need no upkeep."""
    ids = docs.select(F.col(id_col).alias("id"))
    return posted.join(ids, "id", "left_anti").unionByName(postings(docs, id_col, text_col)), sizes.join(ids, "id", "left_anti").unionByName(lengths(docs, id_col, text_col))


def delete(posted: DataFrame, sizes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return posted.join(ids, "id", "left_anti"), sizes.join(ids, "id", "left_anti")
