"""Retrieval modes over a batch of questions, and what is asked of a language model around them.

A context is rows (query_id, kind, rank, id, content, tokens); every mode returns one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import models
from ..functions.text import empty_if_null, entity_text, hash_id, relation_text, sentences, tokens
from ..plans.durable import stored
from . import fusion, lexical, safety, vector
from .traverse import valid_at

MODES = ["local", "global", "hybrid", "naive", "mix", "community", "bypass"]
EDGES = 10
HYDE_BELOW = 10


@dataclass
class Corpus:
    """Tables of a corpus; embeddings are columns of each."""

    chunks: DataFrame  # id, content, embedding, acl
    entities: DataFrame  # name, type, description, source_ids, embedding, acl
    relations: DataFrame  # src_id, tgt_id, description, valid_from, valid_to, embedding, acl
    communities: DataFrame | None = None  # community_id, title, summary, findings


@dataclass
class Options:
    mode: str = "mix"
    top_k: int = 20
    chunk_top_k: int = 5
    lexical: bool = True
    rrf_k: int = fusion.RRF_K
    entity_tokens: int = fusion.ENTITY_TOKENS
    relation_tokens: int = fusion.RELATION_TOKENS
    total_tokens: int = fusion.TOTAL_TOKENS
    snapshot_at: Column | None = None
    user: str | None = None
    groups: list[str] = field(default_factory=list)
    reranker: models.Scorer | None = None
    hyde: models.Model | None = None
    #: Local mode takes the chunks that entities came from in place of the nearest.
    sourced: bool = False
    embedder: models.Embedder | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")


def _search(rows: DataFrame, queries: DataFrame, k: int, opt: Options, words: str = "text") -> DataFrame:
    """query_id, rank, id: the nearest vectors, fused with the best lexical matches if asked. They are a written table, so that joins know how few they are and contents stay where they are."""
    near = vector.top_k(rows, queries, k, "cosine", vector.THRESHOLD, "id", "embedding")
    if not opt.lexical:
        return stored(near.select("query_id", "rank", "id"))
    best = lexical.top_k(rows, queries, k, False, "id", "content", "query_id", words)
    return stored(fusion.fuse([near, best], opt.rrf_k).where(F.col("rank") <= k).select("query_id", "rank", "id"))


def _with_tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", F.size(tokens(F.col("content"))).cast("long"))


def _seen(rows: DataFrame, opt: Options) -> DataFrame:
    """Rows that the user may see; a table without policies is open."""
    return safety.visible(rows, opt.user, opt.groups) if "acl" in rows.columns else rows


def _relation_rows(corpus: Corpus, opt: Options) -> DataFrame:
    rows = corpus.relations if opt.snapshot_at is None else corpus.relations.where(valid_at(opt.snapshot_at))
    return _seen(rows, opt).withColumn("id", F.concat_ws("\x1f", "src_id", "tgt_id")).withColumn("content", relation_text(F.col("src_id"), F.col("tgt_id"), F.col("description")))


def _entity_rows(corpus: Corpus, opt: Options) -> DataFrame:
    return _seen(corpus.entities, opt).withColumn("id", F.col("name")).withColumn("content", entity_text(F.col("name"), F.col("description"), F.col("type")))


def _chunk_rows(corpus: Corpus, opt: Options) -> DataFrame:
    return _seen(corpus.chunks, opt)


def naive(corpus: Corpus, queries: DataFrame, opt: Options) -> DataFrame:
    """The best chunks. With a model for made-up answers, short questions are searched by one; lexical search keeps the question."""
    rows = _chunk_rows(corpus, opt)
    if opt.hyde:
        asked = hyde(queries, opt.hyde)
        queries = asked.withColumn("embedding", F.when(F.col("vector_text") == F.col("text"), F.col("embedding")).otherwise(models.embed(F.col("vector_text"), opt.embedder)))
    hits = _search(rows, queries, opt.chunk_top_k, opt)
    return _with_tokens(hits.join(rows.select("id", "content"), "id").select("query_id", F.lit("chunk").alias("kind"), "rank", "id", "content"))


def incident(hits: DataFrame, relations: DataFrame, most: int = EDGES) -> DataFrame:
    """query_id, id, content, rank of relations at hit entities (query_id, rank, id): the first `most` of each entity, once a query."""
    ends = relations.select("id", "content", F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("name"))
    rows = hits.select("query_id", F.col("id").alias("name"), F.col("rank").alias("hit")).join(ends, "name")
    nth = F.row_number().over(Window.partitionBy("query_id", "name").orderBy("id"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    one = rows.groupBy("query_id", "id").agg(F.min(F.struct("hit", "nth")).alias("at"), F.min("content").alias("content"))
    return one.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")).alias("rank"), "id", "content")


def endpoints(hits: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, rank, id: distinct endpoints of hit relations, in the order of the hits."""
    rows = hits.join(relations.select("id", "src_id", "tgt_id"), "id").select("query_id", F.col("rank").alias("hit"), F.posexplode(F.array("src_id", "tgt_id")).alias("end", "name"))
    one = rows.groupBy("query_id", "name").agg(F.min(F.struct("hit", "end")).alias("at"))
    return one.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "name")).alias("rank"), F.col("name").alias("id"))


def source_chunks(hits: DataFrame, corpus: Corpus, opt: Options) -> DataFrame:
    """Chunks that hit entities came from, by the number of hits, chunk_top_k a query."""
    rows = hits.join(corpus.entities.select(F.col("name").alias("id"), F.explode("source_ids").alias("chunk")), "id")
    counts = rows.groupBy("query_id", F.col("chunk").alias("id")).agg(F.count("*").alias("n"), F.min("rank").alias("hit"))
    seen = counts.join(_chunk_rows(corpus, opt).select("id", "content"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "hit", "id"))
    return seen.select("query_id", rank.alias("rank"), "id", "content").where(F.col("rank") <= opt.chunk_top_k)


def near_chunks(asked: DataFrame, corpus: Corpus, opt: Options) -> DataFrame:
    """The nearest chunks of each question, chunk_top_k a query."""
    rows = _chunk_rows(corpus, opt)
    hits = stored(vector.top_k(rows, asked, opt.chunk_top_k, "cosine", vector.THRESHOLD, "id", "embedding"))
    return hits.join(rows.select("id", "content"), "id").select("query_id", "rank", "id", "content")


def _context(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for kind, rows in parts:
        each = rows.select("query_id", F.lit(kind).alias("kind"), "rank", F.col("id").cast("string").alias("id"), "content")
        out = each if out is None else out.unionByName(each)
    return _with_tokens(out)


def local(corpus: Corpus, queries: DataFrame, opt: Options) -> DataFrame:
    """Entities, their relations, and chunks where any of the entities names a source: the nearest, or with opt.sourced those that the entities came from."""
    entities, relations = _entity_rows(corpus, opt), _relation_rows(corpus, opt)
    hits = _search(entities, queries, opt.top_k, opt, "keywords" if "keywords" in queries.columns else "text")
    if opt.sourced:
        chunks = source_chunks(hits, corpus, opt)
    else:
        sourced = hits.join(entities.where(F.size("source_ids") > 0).select("id"), "id", "left_semi").select("query_id").distinct()
        chunks = near_chunks(queries.join(sourced, "query_id", "left_semi"), corpus, opt)
    return _context([("entity", hits.join(entities.select("id", "content"), "id")), ("relation", incident(hits, relations)), ("chunk", chunks)])


def global_(corpus: Corpus, queries: DataFrame, opt: Options) -> DataFrame:
    """Relations, their endpoints, and the nearest chunks."""
    entities, relations = _entity_rows(corpus, opt), _relation_rows(corpus, opt)
    hits = _search(relations, queries, opt.top_k, opt, "keywords" if "keywords" in queries.columns else "text")
    ends = stored(endpoints(hits, relations))
    return _context([("relation", hits.join(relations.select("id", "content"), "id")), ("entity", ends.join(entities.select("id", "content"), "id")), ("chunk", near_chunks(queries, corpus, opt))])


def community(corpus: Corpus, queries: DataFrame, opt: Options) -> DataFrame:
    """Reports by keywords, of those that the user may see."""
    from .community import keyword_rank

    hits = keyword_rank(_seen(corpus.communities, opt), queries, opt.top_k)
    return _context([("community", hits.withColumnRenamed("community_id", "id"))])


def retrieve(corpus: Corpus, queries: DataFrame, opt: Options) -> DataFrame:
    """The context of a mode: retrieved, reranked if asked, valid at the snapshot, visible to the user, within the budgets, numbered.

    queries: query_id, text, embedding and, for keyword search, keywords.
    """
    if opt.mode == "bypass":
        return _finish(_with_tokens(queries.select("query_id", F.lit("chunk").alias("kind"), F.lit(1).alias("rank"), F.lit("").alias("id"), F.lit("").alias("content"))).where("1 = 0"), queries, opt)
    modes = {"local": local, "global": global_, "naive": naive, "community": community}
    if opt.mode == "hybrid":
        rows = fusion.ordered_union(local(corpus, queries, opt), global_(corpus, queries, opt))
    elif opt.mode == "mix":
        rows = fusion.ordered_union(local(corpus, queries, opt), _context([("chunk", naive(corpus, queries, opt))]))
    else:
        rows = modes[opt.mode](corpus, queries, opt)
    return _finish(rows, queries, opt)


def _finish(rows: DataFrame, queries: DataFrame, opt: Options) -> DataFrame:
    if opt.reranker:
        asked = rows.where("kind = 'chunk'").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        rows = rows.where("kind <> 'chunk'").unionByName(fusion.rerank(asked, opt.reranker).select(*rows.columns))
    kept = fusion.fit_context(rows, opt.entity_tokens, opt.relation_tokens, opt.total_tokens)
    return fusion.references(kept).select("query_id", "ref_id", "kind", "rank", "id", "content", "tokens")


def render_history(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, history: `role: text` lines in the order of turns."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    return turns.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def rewrite(queries: DataFrame, histories: DataFrame, model: models.Model | None = None) -> DataFrame:
    """Questions asked anew with their history; without one they stay."""
    rows = queries.join(histories, "conv_id", "left")
    prompt = F.concat(F.col("history"), F.lit("\n"), F.col("text"))
    return rows.withColumn("text", F.when(F.col("history").isNull(), F.col("text")).otherwise(models.complete(prompt, model)))


def decompose(queries: DataFrame, model: models.Model) -> DataFrame:
    """A row for each sub-question of a JSON list; the question itself where there is none."""
    listed = F.from_json(models.complete(F.col("text"), model), "array<string>")
    each = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    return queries.withColumn("each", F.when(F.size(each) > 0, each).otherwise(F.array("text"))).select("*", F.posexplode("each").alias("part", "sub_text")).drop("each")


def retrieve_parts(corpus: Corpus, queries: DataFrame, opt: Options, model: models.Model) -> DataFrame:
    """The contexts of each question's sub-questions together: an item counts at its first place, and references are numbered anew."""
    parts = decompose(queries, model)
    own = F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("part").cast("string"))
    changed = F.when(F.col("sub_text") == F.col("text"), F.col("embedding")).otherwise(models.embed(F.col("sub_text"), opt.embedder))
    asked = parts.select(F.col("query_id").alias("whole"), "part", own.alias("query_id"), F.col("sub_text").alias("text"), changed.alias("embedding"))
    rows = retrieve(corpus, asked.select("query_id", "text", "embedding"), opt)
    rows = rows.join(asked.select("query_id", "whole", "part"), "query_id").drop("query_id", "ref_id").withColumnRenamed("whole", "query_id")
    seen = Window.partitionBy("query_id", "kind", "id").orderBy("part", "rank")
    rows = rows.withColumn("seen", F.row_number().over(seen)).where("seen = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("part", "rank"))).drop("seen", "part")
    kept = fusion.fit_context(rows, opt.entity_tokens, opt.relation_tokens, opt.total_tokens)
    return fusion.references(kept).select("query_id", "ref_id", "kind", "rank", "id", "content", "tokens")


def hyde(queries: DataFrame, model: models.Model | None = None, below: int = HYDE_BELOW) -> DataFrame:
    """vector_text: a made-up answer for questions of fewer than `below` tokens, else the question. Lexical search keeps `text`."""
    return queries.withColumn("vector_text", F.when(F.size(tokens(F.col("text"))) < below, models.complete(F.col("text"), model)).otherwise(F.col("text")))


def keywords(queries: DataFrame, model: models.Model) -> DataFrame:
    """low, high and keywords (both, joined) from a JSON answer."""
    answer = F.from_json(models.complete(F.col("text"), model), "high_level_keywords array<string>, low_level_keywords array<string>")
    none = F.array().cast("array<string>")
    rows = queries.withColumn("a", answer).withColumns({"low": F.coalesce("a.low_level_keywords", none), "high": F.coalesce("a.high_level_keywords", none)}).drop("a")
    return rows.withColumn("keywords", F.array_join(F.concat("low", "high"), " "))


def answers(context: DataFrame, queries: DataFrame, template: str = "{context}\n\n{question}", model: models.Model | None = None, only_prompt: bool = False) -> DataFrame:
    """query_id, prompt and, unless only_prompt, the model's answer without leaked instructions."""
    line = F.concat(F.lit("["), F.col("ref_id"), F.lit("] "), F.col("content"))
    parts = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("ref_id").alias("n"), "ref_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))
    rows = queries.select("query_id", "text").join(parts, "query_id", "left").withColumn("context", empty_if_null(F.col("context")))
    prompt = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("context")), F.lit("{question}"), F.col("text"))
    rows = rows.select("query_id", prompt.alias("prompt"))
    return rows if only_prompt else rows.withColumn("answer", safety.without_markers(models.complete(F.col("prompt"), model)))


def grounded(answered: DataFrame, context: DataFrame, verifier: models.Scorer | None = None, least: float = 0.5) -> DataFrame:
    """query_id, claim_no, claim, score, supporting_id, supported: each claim of an answer against the context's best item."""
    claims = answered.select("query_id", F.posexplode(sentences(F.col("answer"))).alias("claim_no", "claim"))
    both = claims.join(context.select("query_id", "id", "content"), "query_id", "left")
    scored = both.withColumn("score", F.when(F.col("content").isNull(), F.lit(0.0)).otherwise(models.score(F.col("claim"), F.col("content"), verifier)))
    best = scored.groupBy("query_id", "claim_no", "claim").agg(F.max(F.struct("score", "id")).alias("b"))
    return best.select("query_id", "claim_no", "claim", F.col("b.score").alias("score"), F.col("b.id").alias("supporting_id"), (F.col("b.score") >= least).alias("supported"))


def with_spans(checked: DataFrame, context: DataFrame, verifier: models.Scorer | None = None) -> DataFrame:
    """grounded()'s rows with supporting_span: of the supporting item's sentences the one that bears the claim out best, the first of equals; null without an item or a sentence."""
    told = context.select("query_id", F.col("id").alias("supporting_id"), F.posexplode(sentences(F.col("content"))).alias("place", "span"))
    key = ["query_id", "claim_no"]
    scored = checked.select(*key, "claim", "supporting_id").join(told, ["query_id", "supporting_id"]).withColumn("score", models.score(F.col("claim"), F.col("span"), verifier))
    best = scored.groupBy(*key).agg(F.max(F.struct("score", (-F.col("place")).alias("first"), "span"))["span"].alias("supporting_span"))
    return checked.join(best, key, "left")


def retry_prompts(answered: DataFrame, checked: DataFrame) -> DataFrame:
    """Prompts again for answers with unsupported claims, which they list."""
    bad = checked.where("not supported").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))), lambda x: F.concat(F.lit("- "), x["claim"])), "\n").alias("unsupported"))
    return answered.join(bad, "query_id").select("query_id", F.concat(F.col("prompt"), F.lit("\n\nUnsupported claims:\n"), F.col("unsupported")).alias("prompt"))


def through_cache(prompts: DataFrame, cache: DataFrame, model: models.Model | None = None, system: str = "") -> tuple[DataFrame, DataFrame]:
    """(prompts with answers, rows to add to the cache): the model runs once for each distinct miss."""
    keyed = prompts.withColumn("args_hash", hash_id(F.concat(F.col("prompt"), F.lit(system))))
    new = keyed.select("args_hash", "prompt").dropDuplicates(["args_hash"]).join(cache.select("args_hash"), "args_hash", "left_anti")
    new = new.select("args_hash", models.complete(F.col("prompt"), model).alias("content"))
    return keyed.join(cache.select("args_hash", "content").unionByName(new), "args_hash", "left"), new
