"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of `window` words; a shorter item is one
window. A document contains a window if all its words stand there in order, so
the required overlap is the whole window and one prefix token is enough: the
window's rarest word by its count over all documents. Documents are joined on
those tokens alone. A token's position gives where the window would begin, which
must leave room for it before and after (positional and length bounds), and then
the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; a larger benchmark is joined by shuffles.
BROADCAST_ROWS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Of ASCII texts the built-in lower case is the same and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def bench_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win): the distinct windows of each item."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("win")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each input row.

    n_hit counts the words inside any occurrence of a window; n_items the items of which a window occurs; items_sha256 is of
    their ids as strings, sorted and joined by commas (of the empty string without any). Null and empty texts have no words.
    Items without id or words are ignored; items that repeat an id count as one. Rows that repeat a doc_id with another
    text are told apart by their text. Other columns of both tables are ignored.
    """
    return _judged(docs, benchmark, window, broadcast_rows).drop("th")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that decontaminate() does not flag, with all their columns.

    A verdict holds for the rows of its doc_id, which can be null, and text: rows without doc_id are judged like any other,
    and of rows that repeat a doc_id only those go whose own text is contaminated.
    """
    leaks = _judged(docs, benchmark, window, broadcast_rows).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    return docs.join(leaks, same, "left_anti")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_rows: int) -> DataFrame:
    """decontaminate() with th, the hash of each row's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    pairs = bench_windows(benchmark, window)
    bounded = (pairs.select(F.sum(F.size("win")).alias("n")).first().n or 0) <= broadcast_rows
    hint = F.broadcast if bounded else (lambda df: df)

    of_windows = pairs.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    vocabulary = pairs.select(F.explode("win").alias("word")).distinct()
    plain = rows.select(F.explode(words(F.col("text"))).alias("word"))
    counts = (plain.join(F.broadcast(vocabulary), "word", "left_semi") if bounded else plain).groupBy("word").count()
    rarity = vocabulary.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("count"))
    ranked = pairs.select("win", F.posexplode("win").alias("off", "word")).join(rarity, "word")
    rarest = ranked.groupBy("win").agg(F.min(F.struct("count", "word", "off")).alias("p")).select("win", F.size("win").alias("n"), "p.word", "p.off")
    prefix = rarest.join(of_windows, "win")

    # the words themselves stay behind: an exploded row carries one word, its position and the number of words
    sized = rows.select("doc_id", "th", words(F.col("text")).alias("w")).select("doc_id", "th", F.size("w").alias("len"), "w")
    tokens = sized.select("doc_id", "th", "len", F.posexplode("w").alias("pos", "word"))
    fits = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("n") <= F.col("len"))
    near = tokens.join(hint(prefix), "word").where(fits)
    begin = F.struct((F.col("pos") - F.col("off")).alias("a"), "n", "win", "items")
    near = near.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.array_sort(F.collect_set(begin)).alias("near"))

    there = rows.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    # explode() of one element keeps the optimizer from putting the split into the filter, where each candidate would repeat it
    there = there.select("doc_id", "th", "text", "near", F.explode(F.array(F.when(F.col("near").isNotNull(), words(F.col("text"))))).alias("w"))
    # A-Z are word characters too where the text is not lower-cased first
    n_words = F.when(F.col("near").isNotNull(), F.size("w")).otherwise(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).cast("long")
    found = there.select("doc_id", "th", n_words.alias("n_words"), F.explode(F.array(F.filter("near", lambda c: F.slice("w", c["a"] + 1, c["n"]) == c["win"]))).alias("found"))
    # occurrences come by their begin; each adds what lies beyond the furthest end before it
    step = lambda acc, c: F.struct((acc["n"] + F.greatest(F.lit(0), c["a"] + c["n"] - F.greatest(c["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], c["a"] + c["n"]).alias("end"))
    hit = F.aggregate("found", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    out = found.select("doc_id", "th", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
