"""Registered queries of the training-data operators, one per operator and the pipeline.

Each reads its whole table and returns its full result; the operators keep their
own interfaces, and a query derives the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import fim_frames, hard_negatives, licenses

TOKEN_LIMIT = 1024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""
    from clusterloom.llm import toxicity as T

    docs = table(spark, sf_dir, "documents")
    return T.score(docs, T.train(docs, table(spark, sf_dir, "labels")))


@register("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: fixed patterns, and segments that a semi-Markov CRF adds."""
    from clusterloom.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs)).drop("pii")


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash of every whole text and of its text edited with the next document's."""
    from clusterloom.llm.fingerprints import with_next

    return with_next(table(spark, sf_dir, "documents"))


@register("op4_sorted_projections")
def op4_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-duplicates at cosine 0.9 by sorted projection passes."""
    from clusterloom.llm.sorted_projections import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op5_vector_packing")
def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens by the dot-product heuristic of vector bin packing."""
    import public_tokenizers

    from clusterloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op6_golay_simhash")
def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates at three or fewer bits, candidates from Golay codeword indices."""
    from clusterloom.llm.golay_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op7_warc")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to indexed WARC archives and read back by coalesced byte ranges."""
    from clusterloom.llm import warc

    root = warc.archive_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(index, root).drop("url", "payload")


@register("op8_bpe_automaton")
def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the tokenization automaton and decoded again."""
    import public_tokenizers

    from clusterloom.llm.bpe_automaton import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: fixed patterns, and decoded candidates that parse as keys or tokens."""
    from clusterloom.llm.secrets_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents")).drop("secrets")


@register("op10_licenses", licenses.oracle())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text by Dice coefficient over word bigrams; built-in functions only."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", hard_negatives.ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors, from lists that anchor clusters share."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


@register("op12_fill_in_middle", fim_frames.ORACLE)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in fill-in-middle form over seekable compressed frames, and restored from it."""
    return fim_frames.digests(fim_frames.fill_in_middle(table(spark, sf_dir, "documents")))


@register("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, the last of the counts of all its prefixes."""
    import public_tokenizers

    from clusterloom.llm import prefix_counts as P

    stored = P.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = P.tokens_in(F.size("counts") - 1)
    return stored.select("doc_id", "n_bytes", n_tokens.cast("long").alias("n_tokens"),
                         (n_tokens > TOKEN_LIMIT).alias("over_limit"))
