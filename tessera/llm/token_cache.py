"""Token counts through a cache of (content digest, tokenizer digest) -> count.

The normalised content is the text with null as empty; nothing else may be folded, since
counts depend on case and space. Distinct digests that the cache lacks are encoded once and
appended to it; then every row takes its count from the cache by digest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, ship, table, with_labels, written

SCHEMA = "content string, tokenizer string, n_tokens long"
#: Characters of texts that are encoded in one call.
CHARS = 1 << 20


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def counter(path: str):
    """A function that counts the tokens of each text in a list, without added ones; made once for each worker."""
    made = counter.__dict__.setdefault("made", {})
    if path not in made:
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            made[path] = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers

            t = tokenizers.Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            made[path] = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return made[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            texts, out, at = b.column(1).to_pylist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS):
                    size += len(texts[to])
                    to += 1
                out += count(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``cache`` is a Parquet folder that all executors share; it is made if missing. Equal
    texts are encoded once, and never again while the vocabulary and its library stay. Null
    counts as empty: 0 bytes, and as many tokens as the library gives. Repeated rows and
    null ids have a row each; an empty table gives an empty one. Other columns are not read.

    Appending is atomic by job; a digest that two jobs encoded at once is counted once.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_version(path)
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("content", F.sha2("text", 256))
    rows = written(texts.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # Copies are combined before the shuffle; the text that stays is any of the equal ones.
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("content"), "content", "left_anti").select("content", "text")
    (
        misses.mapInArrow(_counts(path), "content string, n_tokens long")
        .select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    )
    counts = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    copies = rows.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))
    labels = written(copies.join(counts, "content"), "counts")
    return with_labels(rows, labels, "content", "copies").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Begins with an empty cache, so that every distinct text is encoded."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
