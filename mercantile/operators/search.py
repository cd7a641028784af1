"""Searching: ladders of translated queries, projects, watchlists, comparisons, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialise
from .skew import dealt_join

#: Turkish words, language and translation.
DICTIONARY = (
    *(("halka", "en", "ring"), ("dişli", "en", "gear"), ("cıvata", "en", "bolt"), ("kırmızı", "en", "red"), ("mavi", "en", "blue"), ("küçük", "en", "small"), ("sıcak", "en", "hot")),
    *(("halka", "de", "ring"), ("dişli", "de", "zahnrad"), ("kırmızı", "de", "rot")),
    *(("halka", "zh", "环"), ("dişli", "zh", "齿轮"), ("cıvata", "zh", "螺栓"), ("kırmızı", "zh", "红色"), ("mavi", "zh", "蓝色"), ("küçük", "zh", "小号"), ("sıcak", "zh", "热")),
)
DICTIONARY_ROWS = ", ".join(map(str, DICTIONARY))
#: Queries as SQL rows (query_id, text).
QUERY_ROWS = "(1, 'kırmızı halka'), (2, 'mavi dişli'), (3, 'küçük cıvata'), (4, 'sıcak halka'), (5, 'ahşap dişli'), (6, 'ahşap masa'), (7, 'KIRMIZI HALKA')"
DICTIONARY_SQL = f"select * from (values {DICTIONARY_ROWS}) as t(word, lang, translated)"
QUERIES_SQL = f"select * from (values {QUERY_ROWS}) as t(query_id, text)"


def turkish_lower(c):
    """Lower case by Turkish rules: I is ı, İ is i."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.sql(DICTIONARY_SQL)


def lowered(text: Column, lang: Column) -> Column:
    """Lower case by the rules of the text's language."""
    return F.when(lang == "tr", turkish_lower(text)).otherwise(F.lower(text))


def to_english() -> dict[str, str]:
    """Words of all languages of the dictionary, and their English."""
    english = {t: x for t, lang, x in DICTIONARY if lang == "en"}
    return english | {x: english[t] for t, lang, x in DICTIONARY if lang != "en" and x not in english.values()}


def in_english(words: Column) -> Column:
    """An array of words with those that the dictionary knows in English, each once."""
    known = F.create_map(*[F.lit(x) for pair in to_english().items() for x in pair])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)))


def ladder(queries: DataFrame, words: DataFrame, *, lang: str) -> DataFrame:
    """(query_id, rung, text): the whole translated query, then its last word.

    A rung needs all of its words translated; for Turkish itself they are as they stand. ``words`` is
    a dictionary of one row a word and language; a query's words are grouped by query.
    """
    own = words.where(F.col("lang") == lang).select(F.col("word"), "translated")
    parts = queries.select("query_id", F.posexplode(F.split(turkish_lower(F.trim("text")), r"\s+")).alias("at", "word"))
    found = parts.withColumn("translated", F.col("word")) if lang == "tr" else parts.join(broadcast_if_small(own), "word", "left")
    one = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "translated"))).alias("t"))
    every = F.transform("t", lambda x: x["translated"])
    whole = F.when(F.forall(every, lambda x: x.isNotNull()), F.array_join(every, " "))
    rungs = one.select("query_id", F.posexplode(F.array(whole, F.element_at(every, -1))).alias("rung", "text"))
    return rungs.where("text is not null").select("query_id", (F.col("rung") + 1).alias("rung"), "text")


def first_hits(rungs: DataFrame, products: DataFrame, *, id_col: str, name: str) -> DataFrame:
    """(query_id, rung, text, n_hits, best_id): the first rung of each query that finds products.

    Whole names are matched by an equi-join, single words by one over the words of the names.
    """
    names = products.select(F.col(id_col).alias("id"), F.lower(name).alias("n"))
    index = names.select("id", F.explode(F.array_distinct(F.concat(F.array("n"), F.split("n", r"\s+")))).alias("text"))
    hits = index.join(broadcast_if_small(rungs), "text").groupBy("query_id", "rung", "text").agg(F.count("*").alias("n_hits"), F.min("id").alias("best_id"))
    return hits.groupBy("query_id").agg(F.min(F.struct("rung", "text", "n_hits", "best_id")).alias("x")).select("query_id", "x.*")


def ladder_hits(rungs: DataFrame, offers: DataFrame) -> DataFrame:
    """``offers`` with the query_id and rung that found them: for each query its first rung with hits.

    ``rungs`` (query_id, lang, rung, text) hits an offer of its language whose title holds all of its
    words. A rung is joined by its last word, and the others are looked for in the titles that hold that one, so
    nothing is counted and no offer is shuffled for a small table of rungs. ``rungs`` may be of any size.
    """
    asked = rungs.select("query_id", "lang", "rung", F.array_distinct(F.split("text", " ")).alias("words")).distinct()
    asked = asked.select("query_id", "lang", "rung", "words", F.element_at("words", -1).alias("word"))
    names = offers.columns
    title = F.array_distinct(F.split(lowered(F.col("title"), F.col("lang")), r"\s+"))
    seen = offers.where("title is not null").select(F.struct(*names).alias("offer"), "lang", title.alias("held"))
    seen = seen.select("offer", "lang", "held", F.explode("held").alias("word"))
    hits = seen.join(broadcast_if_small(asked), ["lang", "word"]).where(F.size(F.array_except("words", "held")) == 0)
    hits = materialise(hits.select("query_id", "rung", "offer.*"))
    first = hits.groupBy("query_id").agg(F.min("rung").alias("rung"))
    return hits.join(broadcast_if_small(first), ["query_id", "rung"], "left_semi")


def members(offers: DataFrame, project: DataFrame, *, key: str) -> DataFrame:
    """Offers of a project."""
    return offers.join(project.select(key).distinct(), key, "left_semi")


def price_drops(chain: DataFrame, watched: DataFrame, *, key: str, share: float) -> DataFrame:
    """Steps of a price chain, of watched products only, that fall by ``share`` or more."""
    own = members(chain, watched, key=key)
    return own.where((F.col("before") > 0) & (F.col("price") <= F.col("before") * F.lit(1.0 - share)))


def comparison(offers: DataFrame, *, rows: str, columns: str, values: list[str], cost: str) -> DataFrame:
    """One row for each product, one column for each market: the least cost there."""
    return offers.groupBy(rows).pivot(columns, values).agg(F.min(cost))


def interval_join(points: DataFrame, intervals: DataFrame, *, at: str, start: str, stop: str, width: float, by: list[str] = ()) -> DataFrame:
    """Rows of ``points`` with each interval [start, stop) that holds them, of the same ``by``.

    An interval is stored by the level of its length: cells are ``width`` at level 0, twice as wide at
    each further one, and an interval stands in the two cells at most that it touches at the first
    level whose cells are as long as itself. A point is looked up in its cell of each level that
    there is, a few dozen at most whatever the lengths; so it is an equi-join, and no interval is
    spread over its whole range. Cells of many points are dealt over tasks.
    """
    names, kept = points.columns, intervals.columns
    sides = [F.col(c).alias(f"__{c}") for c in by]
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))
    long = (F.col(start) < F.col(stop)) & F.col(start).isNotNull()
    stored = intervals.where(long).withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2((F.col(stop) - F.col(start)).cast("double") / width))).cast("int"))
    stored = stored.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / size).cast("long"), F.floor(F.col(stop) / size).cast("long"))))
    stored = materialise(stored.select(F.struct(*kept).alias("__interval"), *sides, "__level", "__cell"))
    levels = sorted(r[0] for r in stored.select("__level").distinct().collect())
    asked = points.where(F.col(at).isNotNull()).select(F.struct(*names).alias("__point"), *sides, F.col(at).alias("__at"), F.explode(F.lit(levels).cast("array<int>")).alias("__level"))
    asked = materialise(asked.withColumn("__cell", F.floor(F.col("__at") / size).cast("long")))
    met = dealt_join(stored, asked, [*(f"__{c}" for c in by), "__level", "__cell"], by=F.xxhash64("__point"))
    inside = met.where((F.col("__at") >= F.col(f"__interval.{start}")) & (F.col("__at") < F.col(f"__interval.{stop}")))
    return inside.select(*[F.col(f"__point.{c}") for c in names], *[F.col(f"__interval.{c}") for c in kept if c not in by])


def overlap_join(left: DataFrame, right: DataFrame, *, start: str, stop: str, width: float, by: list[str] = ()) -> DataFrame:
    """(a, b): structs of the rows of both sides whose intervals [start, stop) overlap, of the same ``by``.

    Of two that overlap, one begins within the other: those of the left that begin in one of the right,
    and those of the right that begin in one of the left, but not with it. Empty intervals meet none.
    """

    def packed(side: DataFrame, name: str, *more: Column) -> DataFrame:
        return side.where(F.col(start) < F.col(stop)).select(F.struct(*side.columns).alias(name), *by, *more)

    def spans(side: DataFrame, name: str) -> DataFrame:
        return packed(side, name, F.col(start).alias("__from"), F.col(stop).alias("__to"))

    ends = {"start": "__from", "stop": "__to", "at": "__at", "width": width, "by": list(by)}
    first = interval_join(packed(left, "a", F.col(start).alias("__at")), spans(right, "b"), **ends)
    then = interval_join(packed(right, "b", F.col(start).alias("__at")), spans(left, "a"), **ends).where(F.col("__at") > F.col("__from"))
    return first.select("a", "b").unionByName(then.select("a", "b"))


def sessions(events: DataFrame, *, by: str, at: str, gap_seconds: int) -> DataFrame:
    """(by, n_events, first, last) of each run of events that are less than the gap apart."""
    t = events.where(F.col(at).isNotNull()).withColumn("__t", F.col(at).cast("timestamp"))
    one = t.groupBy(by, F.session_window("__t", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return one.select(by, "n_events", "first_at", "last_at")


def top_per_group(rows: DataFrame, *, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups within tasks before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
