"""From files to answers in one plan: ingest a set of files, then ask it a batch of questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import embedding_text, is_blank, locating_prefix
from folioscope.operators import answer, chunk, dense, fuse, lexical, resolve, split
from folioscope.sources import formats, read, write


@dataclass
class Corpus:
    """Tables of an ingested set of files; each is a lazy plan, but for those that ingest has stored. A caller that asks often stores the others first."""

    documents: DataFrame
    blocks: DataFrame
    chunks: DataFrame
    chunk_blocks: DataFrame
    vectors: DataFrame | None
    postings: DataFrame
    held: tuple[str, ...] = ()


def ingest(files: DataFrame, strategies: Sequence[str] = ("layout",), embedder: Callable[[], dense.Embed] | None = None, paged_blocks: DataFrame | None = None, kept: Callable[[DataFrame], DataFrame] | None = None, **how) -> Corpus:
    """files: filename, content and, where known, tenant_id, company_name, form_type, fiscal_year.

    Contents are deduplicated by tenant and hash; a file without a known format is quarantined;
    text files are split into located blocks (bytes that are no UTF-8, and texts without a
    block, fail for good); paged files take their blocks from paged_blocks (document_id and the
    columns of pdf_fragments), as another reader made them. Every strategy's chunks get prefixes,
    vectors and postings. kept: stores files, blocks and chunks as they are made, so that no later
    table makes them again; it writes a frame to shared storage and reads it again.
    """
    once = kept or (lambda df: df)
    have = set(files.columns)
    some = lambda name, kind, default=None: (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)
    got = read.intake(files).where("status = 200")
    rows = formats.detect(got.select("filename", "content", "sha256", some("tenant_id", "string", "default"), some("company_name", "string"), some("form_type", "string"), some("fiscal_year", "int"), some("cik", "string"), some("ticker", "string")))
    rows = rows.withColumn("document_id", F.substring(F.sha2(F.concat_ws("/", "tenant_id", "sha256"), 256), 1, 32))
    # what goes on of a content is its text, where it has one to be split
    flow = F.col("family") == "flow"
    text = F.when(flow, read.decoded_text(F.col("content")))
    status = F.when(F.col("error").isNotNull(), "quarantined").when(flow & is_blank(text), "failed").otherwise("ready")
    rows = rows.withColumn("status", status).withColumn("text", F.when(~is_blank(text), text)).drop("content")
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("document_id",)]), F.col("filename"))
    rows = once(rows.groupBy("document_id").agg(first.alias("r")).select("document_id", "r.*"))
    documents = rows.select("document_id", "tenant_id", F.col("filename").alias("original_name"), "sha256", "mime", "family", "extension", "company_name", "form_type", "fiscal_year", "cik", "ticker", "status", "error")
    flowing = rows.where(F.col("text").isNotNull()).select("document_id", "extension", "text")
    blocks = split.split_flow(flowing).drop("extension").withColumn("page_no", F.lit(None).cast("int")).withColumn("bbox", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")).withColumn("origin", F.lit("native"))
    if paged_blocks is not None:
        blocks = blocks.unionByName(paged_blocks, allowMissingColumns=True)
    blocks = once(write.block_rows(blocks))
    if "semantic" in strategies and embedder is not None:
        how.setdefault("embed", embedder())
    chunks = write.chunk_ids(chunk.chunk(blocks, strategies, **how))
    about = documents.select("document_id", "company_name", "form_type", "fiscal_year", "original_name", "cik", "ticker", "tenant_id")
    prefix = locating_prefix(F.col("company_name"), F.col("form_type"), F.col("fiscal_year"), F.col("original_name"), F.col("section_path"), F.col("page_from"))
    chunks = once(chunks.join(about, "document_id").withColumn("context_prefix", prefix))
    indexed = embedding_text(F.col("context_prefix"), F.col("text"))
    vectors = None
    if embedder is not None:
        payload = [F.coalesce("company_name", "original_name").alias("document_name"), "cik", "ticker", "fiscal_year", "form_type", "page_from", "section_path"]
        vectors = chunks.select(F.col("chunk_id").alias("vec_id"), "tenant_id", "document_id", "strategy", "seq", *payload, dense.embed(indexed, embedder).alias("embedding"))
    chunks = chunks.drop("company_name", "form_type", "fiscal_year", "original_name", "cik", "ticker")
    postings = lexical.placed(chunks.select("chunk_id", "tenant_id", "strategy", indexed.alias("text")), payload=("tenant_id", "strategy"))
    links = write.chunk_links(chunks, ["chunk_id"])
    return Corpus(documents, blocks, chunks, links, vectors, postings, ("blocks", "chunks") if kept else ())


def stored(corpus: Corpus, kept: Callable[[DataFrame], DataFrame], only: Sequence[str] | None = None) -> Corpus:
    """The corpus with its tables (or only some, by name) stored, each once, by kept, which writes a frame to shared storage and reads it again; what ingest has stored is not stored again."""
    names = [f.name for f in fields(corpus) if f.name not in ("held", *corpus.held) and getattr(corpus, f.name) is not None and (only is None or f.name in only)]
    return replace(corpus, **{n: kept(getattr(corpus, n)) for n in names}, held=(*corpus.held, *names))


def ask(corpus: Corpus, questions: DataFrame, embedder: Callable[[], dense.Embed] | None = None, strategy: str = "layout", tenant_id: str = "default", candidates: int = dense.CANDIDATES, limit: int = fuse.TOP, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Passages for each question (query_id, text): fused hits with text, place and position, in order. kept: stores the hits, which are looked up twice."""
    meant = (F.col("strategy") == strategy) & (F.col("tenant_id") == tenant_id)  # vectors and postings say whose they are: no ids are joined
    there = corpus.chunks.where(meant)
    vectors = corpus.vectors.where(meant) if embedder is not None and corpus.vectors is not None else None
    asked = questions.withColumn("query_vector", dense.embed(F.col("text"), embedder)) if vectors is not None else questions
    hits = fuse.hybrid_search(asked, vectors, corpus.postings.where(meant), candidates=candidates, limit=limit)
    hits = hits if kept is None else kept(hits)
    near = hits.select(F.col("id").alias("chunk_id")).distinct()  # places are looked up for hits alone
    targets = resolve.citation_targets(there.join(near, "chunk_id", "left_semi").select("chunk_id", "document_id", "text", "char_start", "char_end", "section_path"), corpus.documents, corpus.chunk_blocks.join(near, "chunk_id", "left_semi"), corpus.blocks)
    out = hits.withColumnRenamed("id", "chunk_id").join(targets, "chunk_id")
    return out.withColumn("score", resolve.passage_fields()).withColumn("page_no", F.try_element_at("regions", F.lit(1))["page_no"])


def answers(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, prompt, answer): what a model would be asked, and the answer that needs none."""
    return answer.build_prompts(questions, passages).join(answer.extractive_answers(questions, passages), "query_id")
