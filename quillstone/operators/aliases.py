"""Many aliases in many texts: token sequences, joined by their rarest token.

An alias stands in a text where it occurs as it is written and no letter, digit or underscore touches its ends. Texts and aliases are lower-cased and cut into
words and single other characters, white space included, so that an occurrence is an equal run of tokens. Each alias waits at its anchor, the token of it that the
texts have least of; text tokens meet anchors by a join on the token, and only then are the tokens around compared. Work grows with the tokens and with
the occurrences of rare tokens, not with texts times aliases. Aliases are broadcast below a bound of their number; beyond it tokens are dealt
out with as many neighbours as the longest alias has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.routing import METRIC_WORDS
from quillstone.session import BROADCAST_ROWS, settled

_WORD = r"^[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Words, and every other character on its own, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"), F.lit(0))


def metric_aliases(spark: SparkSession) -> DataFrame:
    """(alias, value, turn): the words for metrics in order of declaration."""
    rows = [(word, metric) for metric, words in METRIC_WORDS.items() for word in words]
    return spark.createDataFrame([(word, metric, i) for i, (word, metric) in enumerate(rows)], "alias string, value string, turn int")


def anchored(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases (alias, value, turn) with their tokens, and the place and token of the anchor: the rarest in texts (text), the first of several."""
    words = aliases.where(F.length("alias") > 0).select("alias", "value", "turn", tokens(F.col("alias")).alias("alias_tokens"))
    own = words.select(F.explode("alias_tokens").alias("token")).distinct()
    own = F.broadcast(own) if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else own
    counts = texts.select(F.explode(tokens(F.col("text"))).alias("token")).join(own, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    places = words.select("turn", "alias", F.posexplode("alias_tokens").alias("place", "token")).join(counts, "token", "left")
    # Marks and spaces are anchors only where an alias has no word.
    best = places.groupBy("turn", "alias").agg(F.min(F.struct(~F.col("token").rlike(_WORD), F.coalesce("n", F.lit(0)).alias("n"), "place", "token")).alias("a"))
    return words.join(best, ["turn", "alias"]).select("alias", "value", "turn", "alias_tokens", F.col("a.place").alias("place"), F.col("a.token").alias("token"))


def occurrences(texts: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, at, alias, value, turn) for each occurrence in texts (key, text), at being the number of its first token."""
    found = settled(anchored(texts, aliases), "aliases")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("alias_tokens")), F.lit(0)).alias("most")).first()
    rows = texts.select(F.col(key).alias("q_key"), tokens(F.col("text")).alias("near"))
    rows = rows.select("q_key", "near", F.posexplode("near").alias("pos", "token"))
    base = F.lit(0)
    if size["n"] <= BROADCAST_ROWS:
        found = F.broadcast(found)
    else:
        base = F.greatest(F.col("pos") - size["most"], F.lit(0))
        rows = rows.withColumn("near", F.slice("near", base + 1, 2 * size["most"] + 1))
    met = rows.join(found, "token")
    start = F.col("pos") - F.col("place") - base
    run = F.when(start >= 0, F.slice("near", F.greatest(start, F.lit(0)) + 1, F.size("alias_tokens")))
    word = lambda token: F.coalesce(token.rlike(_WORD), F.lit(False))
    free = ~word(F.when(start > 0, F.get("near", start - 1))) & ~word(F.get("near", start + F.size("alias_tokens")))
    return met.where((run == F.col("alias_tokens")) & free).select(F.col("q_key").alias(key), (F.col("pos") - F.col("place")).alias("at"), "alias", "value", "turn")


def first_values(texts: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, value, n_aliases): the value of the alias that is declared first among those of a text, and how many of them it has."""
    hits = occurrences(texts, aliases, key)
    return hits.groupBy(key).agg(F.min_by("value", "turn").alias("value"), F.count_distinct("turn").alias("n_aliases"))
