"""Documents to packed training sequences: five stages in a row.

Each stage takes the documents the one before it kept.  Texts without a certain
language go, one document of each group of near duplicates stays, passages of
test items are cut out (and documents that hold little else go), personal data
is masked, and what is left is packed into sequences.
"""

import uuid

import public_tokenizers

from parleyframe.llm import decontaminate, language, packing, sanitise, simhash
from parleyframe.session import ship
from parleyframe.sources.tables import working_folder

#: Pooled probability of the language below which a document goes.
LEAST_SCORE = 0.3


def language_id(spark, docs, sf_dir):
    ship(spark)
    return language.keep_identified(docs, least_score=LEAST_SCORE)


def simhash_near_dedup(spark, docs, sf_dir):
    ship(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    ship(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items)


def pii(spark, docs, sf_dir):
    ship(spark)
    return sanitise.sanitise(docs)


def best_fit_packing(spark, docs, sf_dir):
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Language scores and token ids have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{working_folder(spark).rstrip('/')}/parleyframe/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
