"""Spelling variants by a bit-sliced position index.

Words are the runs of letters of all texts, counted by Spark.  Two words are
near if one inserted, deleted or replaced code point turns one into the other.
For a slice of the vocabulary there is a bitset per (position, letter): bit w
is set where word w has that letter there.  A query walks its letters and holds
the words that match so far with no error, and those with one error, as three
bitsets: a replaced letter (same position), a letter more in the word (bitsets
shifted one position on) and a letter less (one position back).  All words of
the vocabulary at once take a step by AND and OR on 64 of them at a time.

The vocabulary is cut into slices so that no task holds all of it and work
grows with the words, not with their square.  Pairs whose shorter word has m
letters share their first m // 2 letters or their last m - m // 2, as one edit
can't touch both.  So each word stands in the slices of its first and of its
last half, for m its own length and one less; a pair counts in the slice of the
first half if that half is equal, else in the other.  Slices hold about
``SLICE_CHARS`` characters; halves that more words share are dealt to blocks,
and each pair of blocks is a slice of its own.  Slices return one row per word
(how many are near, and the most frequent), never the pairs.

A form is followed to its root by doubling the step in joins: a form has at
least twice the word's count, so chains are short and have no cycle.

Defined results: null and empty texts have no words; a null doc_id counts as
empty text before the ``:``; rows that repeat count each time; texts and words
of any length are whole; of near words with the same count the first in
code-point order is the form; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import stored

LEAST_LETTERS = 5
LEAST_COUNT = 3
TIMES = 2  # a form stands this many times as often
DROP = 97
SLICE_CHARS = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word, n: words of at least ``letters`` code points that stand ``least`` times or more."""
    # a shorter run only gets shorter, so it is left out here
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    found = found.select("run", F.when(h % drop == 0, (h % size).cast("int")).alias("at"), size.alias("size"))
    word = F.when(F.col("at").isNull(), F.col("run")).otherwise(F.expr("concat(substring(run, 1, at), substring(run, at + 2, size))"))
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= least) & (F.length("word") >= letters))


class Slice:
    """Bit-sliced position index of words of m or m + 1 letters: near pairs among them."""

    def __init__(self, words: list[str], m: int):
        self.words, self.m = words, m
        self.size = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, ids = np.unique(letters, return_inverse=True)
        self.letters = ids.reshape(len(words), m + 1)
        self.lanes = -(-len(words) // 64)

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        """Rows of bits over the words, 64 to a number."""
        out = np.zeros((len(flags), self.lanes * 64), bool)
        out[:, : flags.shape[1]] = flags
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """Bitset of the words that have each letter of the alphabet at ``position``."""
        has = np.zeros((len(self.alphabet), len(self.words)), bool)
        if position <= self.m:
            live = np.flatnonzero(self.size > position)
            has[self.letters[live, position], live] = True
        return self._packed(has)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all near pairs but those of two words of m + 1 letters."""
        short, long = np.flatnonzero(self.size == self.m), np.flatnonzero(self.size == self.m + 1)
        is_short, is_long = self._packed((self.size == self.m)[None]), self._packed((self.size == self.m + 1)[None])
        shape = (len(short), self.lanes)
        exact, replaced, more = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        start, less = np.full((len(long), self.lanes), ~np.uint64(0)), np.zeros((len(long), self.lanes), np.uint64)
        before, here = None, self.at(0)
        for i in range(self.m + 1):
            after = self.at(i + 1)
            if i < self.m and len(short):
                q = self.letters[short, i]
                match = here[q]
                more = (more | exact) & after[q]
                replaced = (replaced & match) | (exact & ~match)
                exact &= match
            if len(long):
                q = self.letters[long, i]
                less = (less & before[q]) | start if i else start.copy()
                start &= here[q]
            before, here = here, after
        found = [(short, (replaced & is_short) | ((more | exact) & is_long)), (long, less & is_short)]
        queries, words = [], []
        for who, bits in found:
            row, w = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")) if len(who) else (np.array([], int),) * 2
            queries.append(who[row])
            words.append(w)
        return np.concatenate(queries), np.concatenate(words)


def _best(key: tuple, part: pa.Table) -> pa.Table:
    """Of each word of a slice: how many words are near, and the most frequent of them."""
    m, side, _, i, j = (x.as_py() for x in key)
    words, n, block = part["word"].to_pylist(), part["n"].to_numpy(), part["block"].to_numpy()
    one_block = i != j and (block == block[0]).all()
    q, w = Slice(words, m).near() if len(words) > 1 and not one_block else (np.zeros(0, int), np.zeros(0, int))
    half: dict[str, int] = {}
    first = np.array([half.setdefault(x[: m // 2], len(half)) for x in words])
    ok = (first[q] == first[w]) == (side == 0)
    if i != j:
        ok &= block[q] != block[w]
    q, w = q[ok], w[ok]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[w], -n[w], q))
    q, w = q[order], w[order]
    who, head, count = np.unique(q, return_index=True, return_counts=True)
    best = w[head]
    return pa.table({"word": pa.array([words[x] for x in who], pa.string()), "n_near": count.astype(np.int64), "best_n": n[best], "best": pa.array([words[x] for x in best], pa.string())})


def near_words(words: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """word, n_near, best_n, best: the words (of word, n) that have near ones."""
    size = F.length("word")
    turns = [F.struct((size - d).alias("m"), F.lit(side).alias("side")) for d in (0, 1) for side in (0, 1)]
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(*turns)).alias("x")).select("word", "n", "size", "x.m", "x.side").filter("m > 0")
    half = F.expr("if(side = 0, substring(word, 1, m div 2), substring(word, size - m + m div 2 + 1, m - m div 2))")
    rows = rows.select("word", "n", "m", "side", F.xxhash64(half).alias("half"))  # halves that meet by chance only share a slice
    chars = (F.count(F.lit(1)) * (F.col("m") + 1)).cast("long")
    # a half with more than a slice is dealt to blocks; of both tables only what is large is shuffled
    hot = rows.groupBy("m", "side", "half").agg(chars.alias("chars"), F.count(F.lit(1)).alias("k")).filter(F.col("chars") > slice_chars)
    hot = hot.select("m", "side", "half", F.least(F.ceil(F.col("chars") / slice_chars), F.col("k")).cast("int").alias("blocks"))  # of a word at least
    lengths = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("k"))
    lengths = lengths.select(F.explode(F.array("size", F.col("size") - 1)).alias("m"), "k").groupBy("m").agg(F.sum("k").alias("k"))
    lengths = lengths.select("m", F.ceil(F.col("k") * (F.col("m") + 1) / slice_chars).cast("long").alias("slices"))  # a row for each length
    rows = rows.join(lengths, "m").join(hot, ["m", "side", "half"], "left")
    own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.select(
        "m", "side", F.when(F.col("blocks").isNull(), F.pmod("half", "slices")).otherwise(F.col("half")).alias("slice"),
        F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.least("block", "other")).alias("i"),
        F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.greatest("block", "other")).alias("j"), "word", "n", "block",
    )
    best = rows.groupBy("m", "side", "slice", "i", "j").applyInArrow(_best, "word string, n_near long, best_n long, best string")
    best = best.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def followed(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) end; each round doubles the step."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").take(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word."""
    words = stored(vocabulary(docs), "spelling_words")
    best = near_words(words, slice_chars)
    taken = F.col("best_n") >= TIMES * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.when(taken, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best_n")).alias("form_n")
    )
    out = stored(out, "spelling_forms")
    roots = followed(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
