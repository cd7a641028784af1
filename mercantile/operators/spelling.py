"""Misspelt queries: an index of deletions, and ladders that drop words by rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialise
from .skew import dealt_join

#: Letters from which a word may have one edit, and two.
ONE_EDIT, TWO_EDITS = 4, 8


def edits(word: Column) -> Column:
    """How many edits a word of this length may have."""
    return F.when(F.length(word) >= TWO_EDITS, 2).when(F.length(word) >= ONE_EDIT, 1).otherwise(0)


def without_one(words: Column) -> Column:
    """The words of an array, and each of them without one of its letters."""
    shorter = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
    return F.array_distinct(F.concat(words, F.flatten(shorter)))


def deletions(word: Column, many: Column) -> Column:
    """A word, and what is left of it without up to ``many`` (2 at most) letters."""
    own = F.array(word)
    return F.when(many == 2, without_one(without_one(own))).when(many == 1, without_one(own)).otherwise(own)


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): the words of lower-cased texts, with the number of texts that hold each."""
    return texts.select(F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def corrected(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(word, found, distance, n) of words (word): the known word nearest to each by Levenshtein
    distance, within the edits that the asked word may have; ties go to the commoner, then smaller one.
    Words that nothing is near are not in the result.

    Two words within k edits share what is left of both after up to k deletions, so candidates come
    from an equi-join of deletions: some dozens a word, of different words only, and none is compared
    with all. The known word is cut as if two edits were allowed, as either word may be the longer one.
    """
    one = materialise(asked.select("word").distinct())
    left = one.select("word", F.explode(deletions(F.col("word"), edits(F.col("word")))).alias("rest"))
    most = F.when(F.length("found") >= TWO_EDITS - 2, 2).when(F.length("found") >= ONE_EDIT - 1, 1).otherwise(0)
    right = known.select(F.col("word").alias("found"), "n").withColumn("rest", F.explode(deletions(F.col("found"), most)))
    met = dealt_join(materialise(left), materialise(right), ["rest"], by=F.col("found")).select("word", "found", "n").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "found")).where(F.col("distance") <= edits(F.col("word")))
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("few"), "found")).alias("x"))
    return best.select("word", "x.found", "x.distance", (-F.col("x.few")).alias("n"))


def rare_ladder(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, rung, words, n_words): the corrected words of each query, then without its commonest word, and
    so on to the rarest alone. Words that cannot be corrected are left out. ``queries``: (query_id, text)."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower(F.trim("text")), r"\s+"))).alias("word"))
    better = corrected(words, known)
    own = words.join(broadcast_if_small(better), "word").groupBy("query_id", "found").agg(F.max("n").alias("n"))
    order = Window.partitionBy("query_id").orderBy("n", "found")
    placed = own.withColumn("place", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy("query_id")))
    # the word at place p is in the rungs that keep p words or more
    kept = placed.withColumn("n_words", F.explode(F.sequence(F.col("place"), F.col("all").cast("int"))))
    return kept.groupBy("query_id", "n_words", "all").agg(F.array_sort(F.collect_list("found")).alias("words")).select("query_id", (F.col("all") - F.col("n_words") + 1).cast("int").alias("rung"), "words", "n_words")


def spelled_hits(queries: DataFrame, products: DataFrame, *, id_col: str, name: str) -> DataFrame:
    """(query_id, rung, words, n_hits, best_id): the first rung of each query that finds products whose
    names hold all of its words. Names meet rungs word by word and are counted."""
    known = materialise(vocabulary(products, name))
    rungs = materialise(rare_ladder(queries, known))
    asked = rungs.select("query_id", "rung", "n_words", F.explode("words").alias("word"))
    # products of equal names are one
    names = products.select(F.col(id_col).alias("id"), F.lower(name).alias("name")).groupBy("name").agg(F.min("id").alias("best_id"), F.count("*").alias("n"))
    index = materialise(names.select("name", "best_id", "n", F.explode(F.array_distinct(F.split("name", r"\s+"))).alias("word")))
    met = dealt_join(materialise(asked), index, ["word"], by=F.col("name"))
    whole = met.groupBy("query_id", "rung", "n_words", "name").agg(F.count("*").alias("k"), F.first("best_id").alias("best_id"), F.first("n").alias("n")).where("k = n_words")
    hits = whole.groupBy("query_id", "rung").agg(F.sum("n").alias("n_hits"), F.min("best_id").alias("best_id"))
    first = hits.groupBy("query_id").agg(F.min(F.struct("rung", "n_hits", "best_id")).alias("x")).select("query_id", "x.*")
    return first.join(rungs.select("query_id", "rung", "words"), ["query_id", "rung"]).select("query_id", "rung", F.array_join("words", " ").alias("words"), "n_hits", "best_id")
