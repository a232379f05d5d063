"""Exact dedup by content-defined chunk recipes.

A text (white space removed) is cut where a rolling hash of its last 16 bytes
has ``MASK_BITS`` zero bits, so equal passages are cut alike wherever they
stand.  The chunk bodies cross the network once, to a distinct chunk store
that gives every body its verified identifier: the 64-bit hash, and a variant
number that tells bodies apart whose hashes agree.  A document is from then on
the ordered list of its chunks' identifiers; only these lists are grouped,
joined and compared, never the texts.

Defined results: null text counts as empty, empty texts are equal; a null
doc_id comes after all others when ties are broken; rows that repeat (same id
and text) are one group, of which one row stays; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import BLANKS, buffers

WINDOW_STEPS = 4  # a rolling window of 2**4 bytes
MASK_BITS = 10  # a cut every 1,024 bytes on average
MIN_CHUNK, MAX_CHUNK = 256, 8192
BODY_BATCH = 4 << 20  # bytes of chunk bodies in an Arrow batch

_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """End offsets of the content-defined chunks of ``data``."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in range(WINDOW_STEPS):
        back = 1 << step
        h[back:] += h[:-back] * np.uint32(pow(2654435761, back, 1 << 32))
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, start = [], 0
    for m in marks.tolist():
        while m - start > MAX_CHUNK:
            start += MAX_CHUNK
            out.append(start)
        if m - start >= MIN_CHUNK:
            out.append(m)
            start = m
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunk_hash(body: bytes, bits: int = 64) -> int:
    return (xxhash.xxh64_intdigest(body) & ((1 << bits) - 1)) - (1 << 63 if bits == 64 else 0)


def _chunks(data: bytes):
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def _bodies(bits: int, with_place: bool):
    def run(batches):
        schema = pa.schema([("h", pa.int64()), ("body", pa.binary())] + ([("text_sha256", pa.string()), ("pos", pa.int32())] if with_place else []))
        for batch in batches:
            hs, bodies, shas, at, held = [], [], [], [], 0
            seen = set()
            for raw in buffers(batch.column("text")):
                data = (raw or b"").translate(None, BLANKS)
                sha = hashlib.sha256(data).hexdigest() if with_place else None
                for pos, body in enumerate(_chunks(data)):
                    h = chunk_hash(body, bits)
                    if with_place:
                        shas.append(sha)
                        at.append(pos)
                    elif (h, body) in seen:
                        continue
                    else:
                        seen.add((h, body))
                    hs.append(h)
                    bodies.append(body)
                    held += len(body)
                if held >= BODY_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([hs, bodies] + [shas, at] * with_place, schema.types)], schema=schema)
                    hs, bodies, shas, at, held, seen = [], [], [], [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([hs, bodies] + [shas, at] * with_place, schema.types)], schema=schema)

    return run


def _recipes(bits: int):
    def run(batches):
        for batch in batches:
            n, sha, lists = [], [], []
            for raw in buffers(batch.column("text")):
                raw = raw or b""
                data = raw.translate(None, BLANKS)
                n.append(len(raw.decode("utf-8", "surrogatepass")))
                sha.append(hashlib.sha256(data).hexdigest())
                lists.append([chunk_hash(b, bits) for b in _chunks(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "n_points", "text_sha256", "recipe"],
            )

    return run


def chunk_store(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Distinct chunks (h, body) of all texts."""
    return docs.select("text").mapInArrow(_bodies(bits, False), "h long, body binary").distinct()


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_points, text_sha256, recipe (verified identifiers in order), variants.

    ``variants`` is empty unless two different chunks share a hash; then it
    tells, for the places of such chunks, which of the bodies stands there.
    ``bits`` is lowered by tests to force such collisions.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_recipes(bits), "doc_id long, n_points long, text_sha256 string, recipe array<long>")
    store = chunk_store(docs, bits)
    clashes = store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    none = F.array().cast("array<string>")
    if not clashes.take(1):  # every hash has one body: the hash is its verified identifier
        return rows.withColumn("variants", none)
    variant = store.join(clashes, "h", "left_semi").withColumn("v", F.row_number().over(Window.partitionBy("h").orderBy("body")) - 1).filter("v > 0")
    places = docs.select("text").mapInArrow(_bodies(bits, True), "h long, body binary, text_sha256 string, pos int")
    by_text = (
        places.join(variant, ["h", "body"])
        .select("text_sha256", F.concat_ws(":", F.format_string("%09d", "pos"), F.col("v")).alias("at"))
        .distinct()
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list("at")).alias("variants"))  # at most one entry for each chunk of one text
    )
    return rows.join(by_text, "text_sha256", "left").withColumn("variants", F.coalesce("variants", none))


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_points, n_chunks.

    Of a group the text with most code points stays, then the smallest doc_id.
    Rows are counted per document before anything is grouped, so a group of
    copies sends one row from each task.
    """
    rows = recipes(docs, bits).groupBy("doc_id", "n_points", "text_sha256", "recipe", "variants").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = rows.groupBy("recipe", "variants").agg(F.sum("n").alias("group_size"), F.min(best).alias("best"))
    groups = groups.select("recipe", "variants", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_points"))
    out = rows.join(groups, ["recipe", "variants"])
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "doc_id", "keep_id", "group_size", (first & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_points", F.size("recipe").alias("n_chunks")
    )
