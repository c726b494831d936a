"""Documents to a corpus: the whole of ingestion as one plan over all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions.text import entity_text, hash_id, relation_text
from ..operators import chunking, community, extract, graph, safety, simjoin, vector
from ..operators.retrieve import Corpus, Options, retrieve
from ..prompts import PROMPTS, fill
from .durable import connected_components, stored

SAME = 0.88
SAME_NAME = 0.9


@dataclass
class Built:
    chunks: DataFrame
    doc_chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    communities: DataFrame | None
    reports: DataFrame | None

    def corpus(self) -> Corpus:
        return Corpus(self.chunks, self.entities, self.relations, self.reports)


def resolve(names: DataFrame, embedder: models.Embedder | None = None, least: float = SAME, ratio: float = SAME_NAME, model: models.Model | None = None) -> DataFrame:
    """alias, canonical of names whose embeddings are near and whose spelling is too; the smallest name of a component is canonical.

    With a model, near names of another spelling are one if the first line of its answer says SAME.
    """
    vectors = stored(names.select("name").distinct().withColumn("embedding", models.embed(F.col("name"), embedder)).withColumn("id", F.xxhash64("name")))
    pairs = simjoin.neighbor_pairs(vectors, 5, least, "id", "embedding")
    by = lambda c: vectors.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    spelt = pairs.join(by("a"), "a").join(by("b"), "b").withColumn("ratio", vector.indel_ratio(F.col("a_name"), F.col("b_name")))
    if model is not None:
        spelt = stored(spelt)
    close = spelt.where(F.col("ratio") > ratio).select("a", "b")
    if model is not None:
        asked = spelt.where(F.col("ratio") <= ratio).withColumn("answer", models.complete(fill("same_entity", a=F.col("a_name"), b=F.col("b_name")), model))
        close = close.unionByName(asked.where(F.upper(F.trim(F.split("answer", "\n")[0])).startswith("SAME")).select("a", "b"))
    roots = connected_components(close.select("a", "b")).join(vectors.select(F.col("id").alias("node"), "name"), "node")
    first = roots.groupBy("root").agg(F.min("name").alias("canonical"))
    return roots.join(first, "root").where("name <> canonical").select(F.col("name").alias("alias"), "canonical")


def build(docs: DataFrame, model: models.Model, embedder: models.Embedder | None = None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, pii: str = "flag", gleanings: int = 0, with_reports: bool = True, adjudicator: models.Model | None = None, summarizer: models.Model | None = None) -> Built:
    """docs: doc_id, text, acl. The model answers the extraction prompt of each chunk and, with_reports, the report prompt of each community.

    With a summarizer, descriptions of several parts become one; with an adjudicator, it tells whether near names are the same. A chunk may be
    seen by whom any of its documents lets in, an entity or a relation by whom all its chunks do, a report by whom all
    its members and the relations among them do.

    Equal chunks of several documents are one chunk; doc_chunks says whose they are, so that
    deletion counts references.
    """
    if "acl" not in docs.columns:
        docs = docs.withColumn("acl", F.lit(None).cast("struct<owner:string,visible_to_groups:array<string>,visible_to_users:array<string>,public:boolean>"))
    docs = docs.select(F.struct("doc_id", "acl").alias("doc"), safety.apply_policy(F.col("text"), pii).alias("text")).where("text is not null")
    rows = chunking.by_tokens(docs, size, overlap, id_col="doc").withColumnRenamed("doc_id", "doc")
    rows = safety.drop_injected(rows).withColumn("id", hash_id(F.col("content")))
    doc_chunks = rows.select("doc.doc_id", F.col("id").alias("chunk_id"), "chunk_order_index")
    # Policies travel with the chunks, which move once.
    chunks = rows.where("doc.doc_id is not null").groupBy("id").agg(F.min("content").alias("content"), safety.either(F.col("doc.acl")).alias("acl"))
    chunks = stored(chunks.withColumn("embedding", models.embed(F.col("content"), embedder)))
    told = chunks.select(F.struct("id", "acl").alias("chunk"), "content")
    answers = stored(extract.extract(told, PROMPTS["extract"].split("{text}")[0], model, gleanings, PROMPTS["extract_more"], "chunk"))
    source = lambda r: r.withColumns({"acl": F.col("chunk_id.acl"), "seq": F.struct(F.col("chunk_id.id").alias("chunk_id"), "seq"), "chunk_id": F.col("chunk_id.id")})
    mentions = stored(source(extract.entities(answers)))
    aliases = stored(resolve(mentions, embedder, model=adjudicator))
    relations = graph.merge_relations(graph.redirect(source(extract.relations(answers)), aliases))
    relations = graph.summarized(relations, summarizer, PROMPTS["summarize"])
    relations = stored(relations.withColumn("embedding", models.embed(relation_text(F.col("src_id"), F.col("tgt_id"), F.col("description")), embedder)))
    entities = graph.merge_mentions(graph.fold_aliases(mentions, aliases))
    if summarizer is not None:
        entities = graph.summarized(entities, summarizer, PROMPTS["summarize"])
    # A bare endpoint is as open as the relations that name it.
    ends = relations.select(F.explode(F.array("src_id", "tgt_id")).alias("name"), "acl").groupBy("name").agg(safety.either(F.col("acl")).alias("end_acl"))
    bare = F.col("source_ids").isNull()
    entities = graph.with_endpoints(entities, relations).join(ends, "name", "left").withColumn("acl", F.when(bare, F.col("end_acl")).otherwise(F.col("acl"))).drop("end_acl")
    entities = entities.withColumn("description", F.coalesce("description", F.lit("")))
    entities = stored(entities.withColumn("embedding", models.embed(entity_text(F.col("name"), F.col("description")), embedder)))
    groups = stored(community.detect(entities, relations)) if with_reports else None
    reported = stored(community.report_access(community.reports(groups, entities, relations, model), groups, entities, relations)) if with_reports else None
    return Built(chunks, doc_chunks, entities, relations, groups, reported)


def compare(corpus: Corpus, queries: DataFrame, variants: dict[str, Options]) -> DataFrame:
    """Contexts of several options side by side, by variant."""
    out = None
    for name, opt in variants.items():
        rows = retrieve(corpus, queries, opt).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def maintain(built: Built) -> Built:
    """Without orphans that no chunk names, and with communities anew."""
    sourced = F.coalesce(F.size("source_ids"), F.lit(0)) > 0
    on_edges = built.relations.select(F.explode(F.array("src_id", "tgt_id")).alias("name")).distinct()
    kept = built.entities.where(sourced).unionByName(built.entities.where(~sourced).join(on_edges, "name", "left_semi"))
    groups = stored(community.detect(kept, built.relations))
    return Built(built.chunks, built.doc_chunks, kept, built.relations, groups, built.reports)
