"""Benchmark decontamination by a prefix-filtered set join, in DataFrame expressions only.

A benchmark item's sets are its item-sized windows: each run of ``size`` words (an item of fewer words is one
window). Containment must be whole, so by the prefix-filter principle one token of a window is necessary: with the
words ordered by how rarely they occur in the documents, the rarest. Documents' words meet only those prefix words;
the position of the word inside its window bounds where the window could begin, its length must fit into the rest of
the document, and the words there are then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, WORD_GAP, Workspace, cut

WINDOW_WORDS = 10
#: Windows that are broadcast at a time (about 200 bytes each); more are taken in further passes over the documents.
BLOCK_WINDOWS = 50_000


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_GAP), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """(key, window array<string>, item): the windows of every item; equal windows have the same key."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return each.select(F.sha2(F.array_join("window", " "), 256).alias("key"), "window", "item").distinct()


def rarest(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """(key, window, place, rare): each window's word that all documents hold least often, and its first place there.

    A window with a word that no document holds occurs nowhere and is left out. ``windows`` is a block, so its words and
    their counts may be broadcast.
    """
    wanted = windows.select(F.explode("window").alias("word")).distinct()
    seen = docs.select(F.explode(words(F.col(text_col))).alias("word")).join(F.broadcast(wanted), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("key", "window", F.posexplode("window").alias("place", "word")).join(F.broadcast(counts), "word", "left")
    least = placed.groupBy("key").agg(F.min_by(F.struct("window", "place", "word"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place")).alias("p"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return least.where("n > 0").select("key", "p.window", "p.place", F.col("p.word").alias("rare"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW_WORDS, block: int = BLOCK_WINDOWS
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, hits (array of (first word, words) of occurring windows), items
    (ids as sorted strings) and contaminated (n_hit > 0). A word is hit if it lies inside an occurring window.

    Null or empty texts and items have no words; repeated documents get a row each; items of equal text all count;
    null item ids are written as empty strings. An empty benchmark hits nothing. Other columns are not looked at.
    The benchmark's windows are broadcast in blocks of at most ``block``, each of which reads all documents twice; the
    items that hold them are joined to the windows that occur.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), words(F.col(text_col)).alias("w"))
    with Workspace(docs.sparkSession) as work:
        holders = work.cut(item_windows(benchmark, item_col, item_text_col, size), few=True)
        windows = work.cut(holders.select("key", "window").distinct(), few=True)
        n_blocks = max(1, -(-windows.count() // block))
        found: DataFrame | None = None
        for k in range(n_blocks):
            own = work.cut(rarest(docs, windows.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == k), text_col), few=True)
            # One row beyond the last word stands for the document itself, so that those without any hit stay.
            dealt = source.select("id", "print", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "word"))
            at = F.col("at") - F.col("place")
            fits = (F.col("word") == F.col("rare")) & (at >= 0) & (at + F.size("window") <= F.size("w"))
            same = F.slice("w", F.when(at >= 0, at + 1).otherwise(F.lit(1)), F.size("window")) == F.col("window")
            met = dealt.join(F.broadcast(own), fits & same, "left").where((F.col("at") == F.size("w")) | F.col("rare").isNotNull())
            met = met.select("id", "print", F.size("w").alias("n_words"), (F.col("at") == F.size("w")).alias("self"), F.when(F.col("rare").isNotNull(), F.struct(at.alias("first"), F.size("window").alias("n"))).alias("hit"), "key")
            met = met if k == 0 else met.where("not self")
            found = met if found is None else found.union(met)
        rows = work.cut(found.groupBy("id", "print").agg(
            F.max("n_words").alias("n_words"), F.count(F.when(F.col("self"), 1)).alias("times"), F.array_sort(F.collect_set("hit")).alias("hits"), F.collect_set("key").alias("keys"),
        ), few=True)
        # Items come by the keys of the windows that occur: a plain join, in which a common passage may be split.
        met = rows.where("size(keys) > 0").select("id", "print", F.explode("keys").alias("key")).join(holders.select("key", "item"), "key").select("id", "print", "item").distinct()
        met = met.groupBy(F.col("id").alias("i"), F.col("print").alias("p")).agg(F.array_sort(F.collect_list("item")).alias("items"))
        rows = rows.drop("keys").join(met, rows["id"].eqNullSafe(met["i"]) & rows["print"].eqNullSafe(met["p"]), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        return cut(_told(rows, id_col), few=True)


def _told(rows: DataFrame, id_col: str) -> DataFrame:
    # Hits are sorted by their first word: a word is counted by the first window that reaches it.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, h: F.struct(
        F.greatest(acc["end"], h["first"] + h["n"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), h["first"] + h["n"] - F.greatest(acc["end"], h["first"]))).alias("n")
    )
    out = rows.select("id", "n_words", F.aggregate("hits", start, step, lambda acc: acc["n"]).alias("n_hit"), "hits", "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "hits", "items", (F.col("n_hit") > 0).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
