"""Rules stated at several scopes, and names that need quoting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.operators.lists import PIECE_ITEMS, ordered_list
from tablelens.plans.joins import balanced_join


def scoped_rules(
    rules: DataFrame,
    entities: DataFrame,
    entity_key: str,
    scopes: Mapping[str, str | None],
    by: Sequence[str] = (),
    piece_items: int = PIECE_ITEMS,
) -> DataFrame:
    """The rules that apply to each entity, listed per scope.

    ``rules`` has ``(scope, key, rule, *by)``. ``scopes`` maps a scope to the
    entity column that its keys name, or to None for a scope that covers every
    entity. The result is ``(entity_key, scope, *by, piece, rules)``; an
    entity has no row for a scope without rules.

    The rules become lists first, so an entity meets one row per scope and
    list, and all scopes are one equi-join on (scope, key).
    """
    target = F.when(F.col("scope").isin([s for s, c in scopes.items() if c is None]), "").otherwise(
        F.col("key").cast("string")
    )
    keyed = rules.select("scope", target.alias("key"), "rule", *by)
    lists = ordered_list(
        keyed, ["scope", "key", *by], ["rule"], "rule", name="rules", piece_items=piece_items
    )
    places = F.array(
        *[
            F.struct(
                F.lit(s).alias("scope"),
                (F.lit("") if c is None else F.col(c).cast("string")).alias("key"),
            )
            for s, c in scopes.items()
        ]
    )
    places_of = entities.select(entity_key, F.inline(places))
    return balanced_join(places_of, lists, ["scope", "key"]).select(
        entity_key, "scope", *by, "piece", "rules"
    )


# What the state letter of a rule stands for.
STATE_WORDS = {"D": "DENY", "G": "GRANT", "W": "GRANT"}
STATE_OPTIONS = {"W": "WITH GRANT OPTION"}


def state_words(state: Column) -> Column:
    """A struct ``(word, option)`` for the state letter of a rule."""

    def chosen(words: Mapping[str, str]) -> Column:
        return F.coalesce(*[F.when(state == s, w) for s, w in words.items()], F.lit(""))

    return F.struct(chosen(STATE_WORDS).alias("word"), chosen(STATE_OPTIONS).alias("option"))


def name_audit(df: DataFrame, col: str, keywords: Iterable[str] | None = None) -> DataFrame:
    """The distinct names with their quoted form: ``(name, quoted, needs_quotes)``.

    A name needs quotes when it starts with a digit, holds a character other
    than letters, digits, ``_`` and ``@``, or is a keyword in any case: those
    given, or else the keywords of Spark SQL. Quotes are square brackets with a
    closing bracket inside doubled.
    """
    names = df.select(F.col(col).alias("name")).where(F.col(col).isNotNull()).distinct()
    if keywords is None:
        listed = df.sparkSession.sql("SELECT keyword FROM sql_keywords()").collect()
        keywords = [r["keyword"] for r in listed]
    odd = F.col("name").rlike("^[0-9]|[^0-9A-Za-z_@]")
    needs = odd | F.upper("name").isin([k.upper() for k in keywords])
    quoted = F.concat(F.lit("["), F.replace(F.col("name"), F.lit("]"), F.lit("]]")), F.lit("]"))
    return names.select(
        "name", F.when(needs, quoted).otherwise(F.col("name")).alias("quoted"), needs.alias("needs_quotes")
    )
