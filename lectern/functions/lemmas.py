"""How a surface becomes a term. No tagger is at hand, so this is pluggable."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize


class Lemmatizer(ABC):
    """Gives the terms of surfaces, for tables of tokens and for query strings."""

    @abstractmethod
    def apply(self, tokens: DataFrame) -> DataFrame:
        """tokens (with the column surface) and the column term."""

    @abstractmethod
    def lemma(self, surface: str) -> str: ...

    def column(self, surface: Column) -> Column | None:
        """The term as an expression of the surface, if there is one; it saves joins and shuffles."""
        return None

    def lemmas(self, text: str) -> list[str]:
        import regex

        return [self.lemma(w) for w in regex.findall(r"[\p{L}\p{N}]+", text)]


class LowerCase(Lemmatizer):
    """A surface's term is its lower-case form."""

    def column(self, surface: Column) -> Column:
        return F.lower(surface)

    def apply(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("term", self.column(F.col("surface")))

    def lemma(self, surface: str) -> str:
        return surface.lower()


class Lookup(Lemmatizer):
    """Terms from a table (surface, lemma) of lower-case surfaces; others are their lower-case form.

    The table is joined, so it may be of any size. For query strings, which are short, pass
    the entries that they need as `known`.
    """

    def __init__(self, table: DataFrame, known: dict[str, str] | None = None) -> None:
        self.table = table.select(F.lower("surface").alias("__surface"), "lemma").dropDuplicates(["__surface"])
        self.known = known

    def apply(self, tokens: DataFrame) -> DataFrame:
        joined = tokens.join(self.table, F.lower("surface") == F.col("__surface"), "left")
        return joined.withColumn("term", F.coalesce("lemma", F.lower("surface"))).drop("__surface", "lemma")

    def lemma(self, surface: str) -> str:
        key = surface.lower()
        if self.known is None:
            row = self.table.where(F.col("__surface") == key).first()
            return row["lemma"] if row else key
        return self.known.get(key, key)


class LightFrench(Lemmatizer):
    """Lower case without plural endings: -aux to -al, and a last -s or -x of longer words gone."""

    # Endings in the order in which they are tried.
    ENDINGS = ((r"(\p{L}{3,})eaux$", "$1eau"), (r"(\p{L}{2,})aux$", "$1al"), (r"(\p{L}{3,})[sx]$", "$1"))

    def column(self, surface: Column) -> Column:
        out = F.lower(surface)
        ways = None
        for pattern, into in self.ENDINGS:
            changed = F.regexp_replace(out, pattern, into)
            ways = F.when(out.rlike(f"^{pattern}"), changed) if ways is None else ways.when(out.rlike(f"^{pattern}"), changed)
        return ways.otherwise(out)

    def apply(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("term", self.column(F.col("surface")))

    def lemma(self, surface: str) -> str:
        import regex

        word = surface.lower()
        for pattern, into in self.ENDINGS:
            if regex.match(pattern, word):
                return regex.sub(pattern, into.replace("$1", r"\1"), word)
        return word


def normalized(terms: list[str]) -> list[str]:
    return [normalize(t) for t in terms]
