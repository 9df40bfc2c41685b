"""Where queries and the SQL that checks them are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurus.functions.text import SPACE

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


# Pieces of SQL that say in DuckDB what lurus.functions.text says in Spark.


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def nopunct(x: str) -> str:
    return squeezed(f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_{SPACE}]', '', 'g')")


def token_list(x: str) -> str:
    return f"list_filter(string_split({squeezed(f'coalesce({x}, {chr(39) * 2})')}, ' '), lambda t: t <> '')"


def word_distance(a: str, b: str) -> str:
    """Over two normal texts, with fewer than 90 distinct words between them."""
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
    both = f"list_sort(list_distinct(list_concat({words(a)}, {words(b)})))"
    packed = lambda x: f"coalesce(array_to_string(list_transform({words(x)}, lambda w: chr((33 + list_position({both}, w))::INT)), ''), '')"
    return f"levenshtein({packed(a)}, {packed(b)})"


def char_distance(a: str, b: str) -> str:
    """DuckDB's distance counts bytes: each different character of the two texts outside of printable ASCII first becomes one byte, up to 31 of them."""
    odd = f"array_to_string(list_sort(list_distinct(regexp_extract_all({a} || {b}, '[^ -~]'))), '')"
    pool = "array_to_string(list_transform(range(1, 32), lambda i: chr(i::INT)), '')"
    packed = lambda x: f"translate({x}, {odd}, substr({pool}, 1, length({odd})))"
    return f"levenshtein({packed(a)}, {packed(b)})"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def over(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def prf(tp: str, fp: str, fn: str) -> str:
    p, r = over(tp, f"{tp} + {fp}"), over(tp, f"{tp} + {fn}")
    f = lambda w: over(f"(1 + {w}) * {p} * {r}", f"{w} * {p} + {r}")
    return f"({tp})::BIGINT AS tp, ({fp})::BIGINT AS fp, ({fn})::BIGINT AS fn, round({p}, 6) AS p, round({r}, 6) AS r, round({f(1.0)}, 6) AS f1, round({f(0.25)}, 6) AS f05"
