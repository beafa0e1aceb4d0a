"""Which names stand within texts, by an inverted index of grams in which each name looks under its rarest one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.staging import small_or_shuffled, staged

#: Widths of grams, from the first one tried; texts under a gram beyond which a name asks for a wider one; characters of a piece of a text.
WIDTHS, HOT, PIECE = (3, 6, 12), 256, 512


def _grams(text: Column, width: int) -> Column:
    """The distinct grams of a text; none if it is shorter."""
    own = F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substring(text, i, width))
    return F.when(F.length(text) >= width, F.array_distinct(own)).otherwise(F.array().cast("array<string>"))


def pieces(texts: DataFrame, longest: int, text: str = "text") -> DataFrame:
    """(text) of distinct pieces of texts: each string of at most `longest` characters of a text lies whole in one of its pieces."""
    own = F.col(f"`{text}`")
    starts = F.sequence(F.lit(1), F.greatest(F.length(own), F.lit(1)), F.lit(PIECE))
    return texts.where(own.isNotNull()).select(F.explode(F.transform(starts, lambda i: F.substr(own, i, F.lit(PIECE + longest - 1)))).alias("text")).where("text <> ''").distinct()


def contained(names: DataFrame, texts: DataFrame, name: str = "name", text: str = "text", widths: tuple[int, ...] = WIDTHS, hot: int = HOT) -> DataFrame:
    """The distinct names (name) that stand within some text.

    How many pieces of texts hold each gram of the names is counted. A name one of whose grams no text holds is done; another one is compared
    with the texts under its rarest gram if these are no more than `hot`, and else tries the next width. What is left then, and names that are
    shorter than a width, are matched by equality with the texts' strings of their lengths, once each. So no name meets more than `hot` texts, however
    frequent its parts are. Null names and texts match nothing, nor does the empty name.
    """
    todo = staged(names.select(F.col(f"`{name}`").alias("name")).where("name <> ''").distinct())
    longest = todo.agg(F.max(F.length("name"))).head()[0]
    if longest is None:
        return todo
    held = staged(pieces(texts, longest, text))
    found, exact = [], []
    for width in widths:
        exact.append(todo.where(F.length("name") < width))
        own = staged(todo.where(F.length("name") >= width).select("name", F.explode(_grams(F.col("name"), width)).alias("gram")))
        if own.isEmpty():
            todo = todo.limit(0)
            break
        seen = staged(held.select("text", F.explode(_grams(F.col("text"), width)).alias("gram")).join(small_or_shuffled(own.select("gram").distinct()), "gram", "left_semi"))
        counts = seen.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = staged(own.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("best")).select("name", "best.*").where("n > 0"))
        pairs = rarest.where(F.col("n") <= hot).drop("n").join(seen, "gram")
        found.append(pairs.where(F.contains("text", F.col("name"))).select("name").distinct())
        todo = rarest.where(F.col("n") > hot).select("name")
    rest = staged(reduce(DataFrame.unionByName, [*exact, todo]))
    lengths = [r[0] for r in rest.select(F.length("name")).distinct().collect()]  # no more than the longest name has characters
    if lengths:
        few = small_or_shuffled(rest)
        found += [held.select(F.explode(_grams(F.col("text"), n)).alias("name")).join(few, "name", "left_semi").distinct() for n in lengths]
    return reduce(DataFrame.unionByName, found).distinct() if found else todo
