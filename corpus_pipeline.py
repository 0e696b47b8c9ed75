"""From documents to training sequences: quality, near duplicates, contamination, private data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlake.llm.decontaminate import find_contamination
from sketchlake.llm.jaccard_join import Join, join_documents
from sketchlake.llm.packing import pack
from sketchlake.llm.quality import FEATURES, base_features, calibrate, with_verdict
from sketchlake.llm.queries import SURROGATE_KEY, vocabulary
from sketchlake.llm.runtime import checkpoint, store, table
from sketchlake.llm.surrogates import replace_entities


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base features and the rules calibrated on the labels, a language being a stratum.

    A null text has no words and goes; a null language is a stratum of its own; rows with a null or repeated id are
    judged each by their own text (labels join by id). An empty table, or one without labels, meets no rules.
    """
    features = base_features(docs).withColumn("stratum", F.coalesce(F.col("row.lang"), F.lit("")))
    counted = checkpoint(features.select("row.doc_id", "stratum", *FEATURES, "base_failed"))
    cutoffs, _ = calibrate(counted, table(spark, sf_dir, "labels"))
    return with_verdict(features, cutoffs).where("kept").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a five-word shingle Jaccard similarity of 0.8, the one with the smallest id.

    Documents without words are alone and stay, as do those without an id. Rows with one id and
    text are one document; different texts under the id that stays all stay, as nothing tells which is meant.
    """
    kept = join_documents(docs, Join()).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).union(docs.where("doc_id is null"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null texts have no words and stay, rows are judged each."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars is theirs. Null texts stay null, all rows and other columns stay as they are."""
    done = replace_entities(docs, SURROGATE_KEY)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their ids (little-endian unsigned 32-bit numbers) and places in sequences; a null text is an end id alone."""
    return pack(docs, vocabulary("word_bpe_49k.json"), id_bytes=True)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii_surrogates", replace_private_data),
    ("best_fit_packing", pack_sequences),
]

#: The rules' binomial walk, the drawn surrogates and the packing have no SQL form; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs)
    return docs
