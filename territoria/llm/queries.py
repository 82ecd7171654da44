"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm import alignment, divergence, exact_dedup, html_extract, line_dedup, mixing, ngram_join, packing, pii, sharding, suffixes, toxicity, vector_links

#: Shards that documents are placed on.
SHARDS = [f"shard-{k:04d}" for k in range(256)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at 0.98. Invalid vectors, null labels and null ids have no links; equal vectors are linked; a cosine of 0.98 counts; an empty table gives no rows."""
    return vector_links.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, labelled quality as weight. Null texts have size 0, null sources are one source in last place; ties of keys go by doc_id and size; repeated rows count each; an empty table gives no rows."""
    mixed = mixing.mixed_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text. Null and empty texts score as texts without evidence, a null doc_id is not held out; 0.5 itself counts as toxic; repeated rows score alike; an empty table gives no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels), spans=False)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by doc_id. A null doc_id counts as the empty string; equal ids share a shard; an empty table gives no rows."""
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all lines. Null texts have no lines, blank lines are no copies; a similarity of 0.8 counts; of equal lines the first by doc_id and place is kept; an empty table gives no rows."""
    return line_dedup.line_components(table(spark, sf_dir, "documents")).drop("t")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text, and how many spans there are in all. Null and empty texts have none; repeated rows have equal spans; an empty table gives no rows."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts. Null texts count as empty, empty texts are equal; the largest doc_id stays, a null one never where there is another; repeated rows count each; an empty table gives no rows."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_bytes")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of word n-grams among all documents. Null and wordless texts have none; a similarity of 0.8 counts; the smallest doc_id of a component is kept; repeated rows count as copies; an empty table gives no rows."""
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null, empty and textless pages give an empty text; of containers that score alike the first counts; repeated rows give repeated rows; an empty table gives none."""
    return html_extract.extracted_text(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences. Null and empty texts are one piece of the end id; ties go to the smaller doc_id and start; repeated rows are documents of their own; an empty table gives no rows."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by two tokenizers. Null and empty texts, and those whose bytes a tokenizer doesn't give back, have zeros; ties for the best pair all count; repeated rows are documents each; an empty table gives no rows."""
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of strings that stand twice. Null texts count as empty, texts below 200 bytes stay; touching runs are one span; repeated rows repeat each other; an empty table gives no rows."""
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ. Null lang, source and text count as empty; ties of value go by the item's bytes; repeated rows count each; an empty table gives no rows."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What corpus_pipeline.run makes of all documents; its stages' docstrings say what becomes of nulls, ties and repeats."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_vector_links, op2_mixing, op3_toxicity, op4_sharding, op5_line_dedup, op6_pii, op7_exact_dedup, op8_ngram_join, op9_html_extract, op10_packing, op11_alignment, op12_suffix_dedup, op13_divergence, pipeline)}

#: The groups of equal texts by SQL alone.
EXACT_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
#: Links of vectors by brute force; components by closure over links.
VECTOR_LINKS = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding)),
pairs as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) as (select x, y from pairs union select r.x, p.y from reach r join pairs p on r.y = p.x)
select e.vec_id, (select count(*) from pairs p where p.x = e.vec_id)::bigint as n_links, least(e.vec_id, coalesce((select min(y) from reach r where r.x = e.vec_id), e.vec_id)) as component_id,
  e.vec_id <= coalesce((select min(y) from reach r where r.x = e.vec_id), e.vec_id) as kept
from embeddings e
"""
ORACLE_SQL = {"op1_vector_links": VECTOR_LINKS, "op2_mixing": mixing.ORACLE, "op7_exact_dedup": EXACT_DEDUP, "op12_suffix_dedup": suffixes.ORACLE, "op13_divergence": divergence.ORACLE}
