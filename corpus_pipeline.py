"""A corpus pipeline of five stages over documents.

A stage takes (spark, docs, sf_dir). The first four return the columns of documents; the last returns a
row a document of the written token files. Between stages, documents are written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, langid, minhash, mixing, token_output
from matchloom.llm.queries import piece_bpe, word_bpe
from matchloom.llm.storage import prepare, read, scratch, written

#: Documents whose language is less sure than this are rejected.
LEAST_SURE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a text that is null, has no letter, or is in doubt between languages goes.

    Where no document is labelled, no language can be learned, and all texts with a letter stay.
    """
    prepare(spark)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    of = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "lang")}
    model = langid.fit(plain, piece_bpe(), of["text"], of["lang"], of["doc_id"])
    if model is None:
        kept = plain.filter(F.col(of["text"]).rlike("\\p{L}"))
    else:
        kept = langid.predict(plain, model, of["text"]).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SURE))
    return kept.select(*plain.columns).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    prepare(spark)
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, in the order of the mix's slots."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of every document."""
    path = scratch(spark, "tokens")
    token_output.write_tokens(docs, path, word_bpe())
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token-ID output", write_token_ids),
]

#: Signatures, piece models and tokenizers are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = written(docs, f"stage{k}")
    return docs
