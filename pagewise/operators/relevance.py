"""Ranked search over an inverted index: BM25, read block by block.

``build`` stores, for texts with an id, the postings (term, document, how often,
where) beside the weight that a posting adds under BM25, the documents per
term, and for blocks of about ``BLOCK_DOCS`` documents the largest weight of
each term.  Postings lie sorted by term and block, in ranges that Spark samples
by both, so a very common term is many files.

A text's postings are made where the text is read: only texts whose id comes
again are exchanged word by word.  A posting carries its document's length, so
no lengths are joined to them.

``search`` first adds up, per block, the largest weights of the query's terms:
no document of the block can score more.  The documents of the most promising
blocks give a k-th best score, and only blocks whose bound reaches it are read.
The result is that of scoring every document.

Defined results: terms are maximal runs of letters in lower case; null and
empty texts, those without a letter and rows without an id are no documents;
rows that share an id are one document; a term that the query repeats
counts once, one that no text holds adds nothing; ties go to the smaller id; a
query without a known term has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.session import state_root

K1, B = 1.2, 0.75
BLOCK_DOCS = 128
FEW_BLOCKS = 1000  # whose numbers go into the scan's filter; more are joined
TERM = r"\p{L}+"
BATCH_WORDS = 1 << 20  # words that are sorted at once, or one text
TABLES = ("postings", "terms", "blocks", "stats")


def terms_of(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


FOUND = "term string, doc_id {}, tf long, positions array<int>, length long, first boolean"


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that begin within the same ``BATCH_WORDS`` words."""
    piece = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)) // BATCH_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(piece)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of texts of an id of their own (doc_id, terms), some texts at a time."""
    for batch in (part for b in batches for part in _cut(b)):
        ids, lists = batch.column("doc_id"), batch.column("terms")
        words, size = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False)
        if not len(words):
            continue
        doc = np.repeat(np.arange(len(size)), size)
        code, place = words.indices.to_numpy(), (np.arange(len(words)) - (np.cumsum(size) - size)[doc]).astype(np.int32)
        key = doc * len(words.dictionary) + code
        order = np.argsort(key, kind="stable")  # places stay in order
        start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        ends, at = np.r_[start, len(order)].astype(np.int32), order[start]
        out = {
            "term": words.dictionary.take(pa.array(code[at])),
            "doc_id": ids.take(pa.array(doc[at])),
            "tf": pa.array(np.diff(ends).astype(np.int64)),
            "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order])),
            "length": pa.array(size[doc[at]].astype(np.int64)),
            "first": pa.array(place[at] == 0),
        }
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _repeated(docs: DataFrame) -> DataFrame:
    """The postings of texts that share an id, which are one document."""
    words = docs.select("doc_id", F.posexplode(terms_of("text")).alias("pos", "term"))
    found = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))  # places of a term in a text
    own = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("length"), F.min("term").alias("_least"))
    return found.join(own, "doc_id").select("term", "doc_id", "tf", "positions", "length", (F.col("term") == F.col("_least")).alias("first"))


def _found(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions, the document's length, and whether this is the first of its postings."""
    docs = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    schema = FOUND.format(docs.schema["doc_id"].dataType.simpleString())

    def made(once: DataFrame) -> DataFrame:
        return once.select("doc_id", terms_of("text").alias("terms")).mapInArrow(_postings, schema)

    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    if not again.take(1):
        return made(docs)
    return made(docs.join(again, "doc_id", "left_anti")).unionByName(_repeated(docs.join(again, "doc_id", "left_semi")))


def build(spark: SparkSession, docs: DataFrame, name: str, block_docs: int = BLOCK_DOCS) -> dict[str, DataFrame]:
    """Store the index of ``docs`` (doc_id, text) under ``name``."""
    root = f"{state_root(spark)}/relevance/{name}"

    def kept(table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{table}")
        return spark.read.parquet(f"{root}/{table}")

    found = kept("found", _found(docs))
    length = F.when(F.col("first"), F.col("length"))
    stats = kept("stats", found.agg(F.count(length).alias("docs"), F.avg(length).alias("mean")))
    n, mean = stats.first()
    kept("terms", found.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // block_docs)))).cast("int")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean or 1.0))
    weight = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)
    rows = found.select("term", block.alias("block"), "doc_id", "tf", weight.alias("weight"), "positions")
    postings = kept("postings", rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block", "doc_id"))
    kept("blocks", postings.groupBy("term", "block").agg(F.max("weight").alias("most")).sortWithinPartitions("term"))
    return read(spark, name)


def read(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{state_root(spark)}/relevance/{name}/{t}") for t in TABLES}


def _scored(index: dict[str, DataFrame], idf: dict[str, float]) -> DataFrame:
    """The postings of the query's terms: block, doc_id, what each adds."""
    own = index["postings"].filter(F.col("term").isin(list(idf)))
    return own.select("block", "doc_id", (_weights(idf) * F.col("weight")).alias("adds"))


def _weights(idf: dict[str, float]) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term"))


def _ranked(postings: DataFrame, k: int) -> DataFrame:
    scores = postings.groupBy("doc_id").agg(F.sum("adds").alias("score"))
    return scores.orderBy(F.col("score").desc(), "doc_id").limit(k)


def promising(index: dict[str, DataFrame], idf: dict[str, float], k: int) -> DataFrame | None:
    """Blocks that can hold one of the k best documents; None if all can."""
    bounds = index["blocks"].filter(F.col("term").isin(list(idf))).groupBy("block").agg(F.sum(_weights(idf) * F.col("most")).alias("bound"))
    first = [r.block for r in bounds.orderBy(F.col("bound").desc(), "block").limit(k).collect()]
    best = [r.score for r in _ranked(_scored(index, idf).filter(F.col("block").isin(first)), k).collect()]
    if len(best) < k:
        return None
    return bounds.filter(F.col("bound") >= best[-1] * (1 - 1e-9)).select("block")  # sums of doubles in another order


def search(index: dict[str, DataFrame], query: str, k: int = 10) -> DataFrame:
    """doc_id, score of the ``k`` best documents for the words of ``query``."""
    spark = index["terms"].sparkSession
    asked = spark.range(1).select(terms_of(F.lit(query)).alias("t")).first().t
    n = index["stats"].first().docs
    known = {r.term: r.df for r in index["terms"].filter(F.col("term").isin(sorted(set(asked)))).collect()}
    if not known:
        return _ranked(index["postings"].limit(0).withColumn("adds", F.col("weight")), k)
    idf = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in sorted(known.items())}
    postings, blocks = _scored(index, idf), promising(index, idf, k)
    if blocks is not None:
        few = [r.block for r in blocks.limit(FEW_BLOCKS + 1).collect()]
        postings = postings.filter(F.col("block").isin(few)) if len(few) <= FEW_BLOCKS else postings.join(blocks, "block", "left_semi")
    return _ranked(postings, k)
