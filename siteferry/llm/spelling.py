"""Spelling variants: words one edit apart, found by asymmetric chunks, grouped under their most frequent form.

Of two words one contributes two disjoint chunks (its halves) and the other its grams of those lengths. One edit
spoils one chunk at most, so the other stands in the longer or equally long word: at the same place, or one further
where the edit was an insertion before it. Words are joined on a kept chunk and its place, and verified. A gram at
another place cannot be a kept chunk and is not emitted.

A chunk that very many words share would pair them all. Such a chunk is narrowed: the rest of the word, in which the
edit then lies, is cut into two chunks again, one of which is kept as well. So groups are split until their pairs are
few or only one letter is left open, and no word is dropped. Where an edit could lie in either part, as in a doubled
letter, the rightmost place counts, so each pair is found exactly once.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions.scale import broadcast_if_small
from siteferry.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
DAMAGE_EVERY = 97
MIN_LENGTH = 5
MIN_COUNT = 3

# A group of more possible pairs than this is narrowed.
GROUP_PAIRS = 4096

_BLOCK = 1 << 20
_FLUSH_CHARS = 8 << 20


def _blocks(text: str, run: re.Pattern, size: int = _BLOCK) -> Iterator[str]:
    """The text in blocks of about `size` characters that cut no run."""
    at = 0
    while at < len(text):
        to = min(at + size, len(text))
        if to < len(text) and (rest := run.match(text, to)):
            to = rest.end()
        yield text[at:to]
        at = to


def _count(every: int, least: int):
    """Tasks' share of the counting: words of whole texts with their damage, added up before anything is shuffled."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(RUN)
        counts: Counter = Counter()
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{key.as_py()}:".encode())
                found: Counter = Counter()
                # lower case of bytes changes A to Z alone
                lower = text.encode().lower().decode()
                for block in _blocks(lower, runs):
                    found.update(runs.findall(block))
                for word, n in found.items():
                    digest = zlib.crc32(word.encode(), seed)
                    if digest % every == 0:
                        at = digest % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        before = len(counts)
                        counts[word] += n
                        if len(counts) > before:
                            held += len(word) + 40
                if held > _FLUSH_CHARS:
                    yield emit(counts)
                    counts, held = Counter(), 0
        if counts:
            yield emit(counts)

    return run


def word_counts(
    documents: DataFrame, every: int = DAMAGE_EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, n): letter runs of whole texts in lower case (A to Z only), damaged by their digest, and their counts.

    Only words of `min_length` code points and `min_count` occurrences are kept. Null and empty texts have no words;
    a null identifier counts as empty in the digest. Rows that repeat count each time.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text"))
    parts = rows.mapInArrow(_count(every, min_length), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _windows(lo: Column, hi: Column, size: Column) -> Column:
    """What stays open where either chunk of the open part [lo, hi) is kept: the other one."""
    middle = lo + (size / 2).cast("int")
    return F.array(
        F.struct(middle.alias("lo"), hi.alias("hi")),
        F.struct(lo.alias("lo"), middle.alias("hi")),
    )


def _keyed(postings: DataFrame) -> DataFrame:
    """Adds the key: the text outside the open part, its place, and the length of the chunk word."""
    # in a gram word the open part is one longer
    rest = F.col("hi") + F.when(F.col("side") == "gram", 2).otherwise(1)
    outside = F.xxhash64(
        F.col("side") == "same", "size", "lo", "hi",
        F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), rest, F.length("word")),
    )
    return postings.withColumn("key", outside)


def _postings(words: DataFrame, min_length: int) -> DataFrame:
    """Each word as equally long word, as shorter word with its chunks, and as longer word with its grams."""
    length = F.length("word")
    sides = F.array(
        F.struct(F.lit("same").alias("side"), length.alias("size")),
        F.struct(F.lit("chunk").alias("side"), length.alias("size")),
        F.struct(F.lit("gram").alias("side"), (length - 1).alias("size")),
    )
    each = words.select("word", "n", F.inline(sides)).filter(F.col("size") >= min_length)
    return each.select("word", "n", "side", "size", F.inline(_windows(F.lit(0), F.col("size"), F.col("size"))))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of words that differ by exactly one code point inserted, deleted or replaced.

    `words` holds each word once, none shorter than `min_length` code points. Each pair is one row: equally long words
    with a < b, else a is the shorter. No words, or null words, give no pairs.
    """
    postings = cut_lineage(_keyed(_postings(words.filter(F.col("word").isNotNull()), min_length)))
    found = []
    while True:
        count = lambda side: F.sum(F.when(F.col("side") == side, 1).otherwise(0))
        sizes = postings.groupBy("key").agg(
            count("same").alias("e"), count("chunk").alias("c"), count("gram").alias("g"),
            F.max(F.col("hi") - F.col("lo")).alias("open"),
        )
        wide = (F.col("e") * F.col("e") + F.col("c") * F.col("g") > group_pairs) & (F.col("open") > 1)
        hot = broadcast_if_small(sizes.filter(wide).select("key"))
        none = hot.isEmpty()
        found.append(_pairs(postings if none else postings.join(hot, "key", "left_anti")))
        if none:
            break
        narrowed = postings.join(hot, "key", "left_semi").select(
            "word", "n", "side", "size", F.inline(_windows(F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo")))
        )
        postings = cut_lineage(_keyed(narrowed))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _pairs(postings: DataFrame) -> DataFrame:
    def side(kinds: list[str], to: str) -> DataFrame:
        chosen = postings.filter(F.col("side").isin(kinds))
        return chosen.select(
            "key", F.col("word").alias(to), F.col("n").alias(f"n_{to}"), F.col("side").alias(f"side_{to}"),
            *([F.col("size"), F.col("lo"), F.col("hi")] if to == "a" else []),
        )

    joined = side(["same", "chunk"], "a").join(side(["same", "gram"], "b"), "key")
    rightful = ((F.col("side_a") == "same") & (F.col("side_b") == "same") & (F.col("a") < F.col("b"))) | (
        (F.col("side_a") == "chunk") & (F.col("side_b") == "gram")
    )
    head = lambda c, to: F.substring(F.col(c), F.lit(1), F.col(to))
    # the first difference lies in the open part: the pair has this one place alone
    here = (head("a", "lo") == head("b", "lo")) & (
        (F.col("hi") == F.col("size")) | (head("a", "hi") != head("b", "hi"))
    )
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return joined.filter(rightful & here & near).select("a", "n_a", "b", "n_b")


def spelling_variants(words: DataFrame, min_length: int = MIN_LENGTH, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row (word, n) of `words`, which holds each word once.

    The form of a word is its near word of largest n, the smallest in code-point order among equals, if that n is at
    least twice the word's own; else null. The root is where the forms lead, the word itself without one. No words give
    no rows; columns beside word and n are left out.
    """
    words = cut_lineage(words.select("word", "n"))
    pairs = near_words(words, min_length, group_pairs)
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("m"), F.col("b").alias("near")),
                F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("m"), F.col("a").alias("near")),
            )
        )
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct("m", "near")).alias("best")
    )
    follows = -F.col("best.m") >= 2 * F.col("n")
    formed = cut_lineage(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(follows, F.col("best.near")).alias("form"),
            F.when(follows, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """Follows links to their ends, twice as far in each round. Counts at least double along a link: there is no ring."""
    current = cut_lineage(links)
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(current.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        current = moved.select("word", "root")
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return current


register_pickle_by_value(sys.modules[__name__])
