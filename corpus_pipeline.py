"""The corpus pipeline: five stages, each on all that the one before it kept.

1. quality classifier: documents whose chance of a grade above the lowest is under one half go;
2. SimHash near-dedup: one document of each group of near copies stays (copies beyond the fingerprints'
   radius are linked by their sets of shingles);
3. benchmark decontamination: documents that contain an item of the benchmark go;
4. secret scans: secrets are masked in the texts;
5. best-fit packing: the documents' tokens are packed into sequences.

Stages 1 to 4 return the columns of documents; stage 5 returns a row for each piece of a document.

Defined cases, besides those of the operators: an empty table stays empty in every stage. A null or empty text
passes stage 1 if the model's thresholds alone do, counts as one text without words in stage 2, holds no item
and no secret in stages 3 and 4, and is one end token in stage 5. Very long texts are read whole throughout.
Rows with a null id are kept, but for copies of each other; of rows that share an id one stays (stage 2).
Further columns, whatever their names, are handed on by stages 1 to 4 and left out by stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import decontaminate, packing, quality, secrets, simhash
from sparkweave.llm.common import materialize, shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the rated ones among the documents themselves."""
    return quality.select_quality(docs, quality.ratings(table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: Models, components and tokens are beyond SQL; tests hold each stage and run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{i}_{name}")
    return docs
