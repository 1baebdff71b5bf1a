"""Token counts from a cache keyed by content and tokenizer digests.

Each distinct text is digested; a count that an earlier run stored for the same
digest and the same tokenizer is joined back.  Only the texts that are missing
are encoded, once per distinct text, and their counts are appended to the cache.

Null and empty text have no tokens.  Rows may repeat ids or texts; every row is
answered.  An empty table gives an empty result and appends nothing.
"""

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches
from parleyframe.sources.tables import settle

CACHE = "version string, digest binary, n_tokens bigint"
#: Words whose counts a worker remembers before it starts afresh.
REMEMBERED_WORDS = 600_000

_counters = {}


class PieceCounter:
    """Number of pieces the library gives for whole texts.

    No piece of these vocabularies joins a blank to the character before it,
    nor a line feed to anything.  So a text with single blanks has the sum of
    the counts of its words, which repeat.  A text, or a vocabulary, of another
    kind is given to the library as one string.
    """

    def __init__(self, model):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(
            "▁" in piece.lstrip("▁") or "\n" in piece
            or (piece.startswith("▁▁") and piece.strip("▁")) for piece in pieces)
        self.words = {}
        self.by_word = self.by_word and self._lengths(
            ["a b", "a", "b", "\nb", " a", ""]) == [2, 1, 1, 3, 2, 0]

    def _lengths(self, texts):
        return list(map(len, self.model.encode(texts, num_threads=1)))

    def __call__(self, texts):
        counts, whole = [0] * len(texts), []
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        known = self.words
        split = {}
        for i, text in enumerate(texts):
            words = text.replace("\n", " \n").split(" ")
            if not self.by_word or "" in words or "▁" in text:
                if text:
                    whole.append(i)
            else:
                split[i] = words
        missing = list(set().union(*split.values()).difference(known)) if split else []
        for word, length in zip(missing, self._lengths(missing)):
            # A word after a line feed has no blank before it: its prefix does not count.
            known[word] = length - word.startswith("\n")
        for i, words in split.items():
            counts[i] = sum(map(known.__getitem__, words)) + words[0].startswith("\n")
        for i in whole:
            counts[i] = self._lengths([texts[i]])[0]
        return counts


def _counter(model, version):
    if version not in _counters:
        _counters[version] = PieceCounter(model)
    return _counters[version]


def read_cache(spark, path):
    """The stored counts; an empty cache where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs, model_path, cache_path, limit=4096, id_column="doc_id",
                 text_column="text", batch_texts=200):
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    version = hashlib.sha256(model).hexdigest()
    shipped = spark.sparkContext.broadcast(model)

    texts = id_and_text(docs, id_column, text_column).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    cached = read_cache(spark, cache_path).where(F.col("version") == version)
    # One row for each missing digest; by its id too, so that copies are dealt out.
    missing = texts.groupBy("digest").agg(F.min("doc_id").alias("one")).join(
        cached, "digest", "left_anti").withColumnRenamed("digest", "missing")
    todo = texts.join(
        missing, (F.col("digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("one")),
        "left_semi").select("digest", "text")

    def encode(batch):
        counter = _counter(shipped.value, version)
        # Rows that repeat an id and a text stand in one batch, or nearly so.
        batch = pa.Table.from_batches([batch]).group_by("digest", use_threads=False).aggregate(
            [("text", "first")]).rename_columns(["digest", "text"]).combine_chunks()
        counts = []
        for at in range(0, batch.num_rows, batch_texts):
            counts += counter(batch["text"].slice(at, batch_texts).to_pylist())
        return pa.table({
            "version": [version] * batch.num_rows,
            "digest": batch["digest"], "n_tokens": pa.array(counts, pa.int64())})

    map_batches(todo, encode, CACHE).write.mode("append").parquet(cache_path)
    # Two runs at the same time may both store a count.
    counts = settle(
        read_cache(spark, cache_path).where(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return texts.select(
        "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")
    ).join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
