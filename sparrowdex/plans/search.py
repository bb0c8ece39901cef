"""Name search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.operators.search import fuzzy, name_tokens, prefix
from sparrowdex.plans.binding import bound

_FUZZY = ("new", "unwarp", "budget", "GetSesion")
_PREFIX = ("get", "Read", "bud", "x")


def _values(words) -> str:
    return ", ".join(f"('{w}')" for w in words)


_FORMS = r"""names AS (SELECT DISTINCT name FROM symbols WHERE kind <> 'sentinel' AND name IS NOT NULL),
parts AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM names),
forms AS (SELECT name, list_concat([lower(name)], CASE WHEN len(t) = 1 AND t[1] = lower(name) THEN [] ELSE t END) AS forms FROM parts)"""

QUERIES = {
    "N01_name_tokens": bound(lambda t: t.symbols.filter("kind <> 'sentinel'").select("name").distinct().select("name", F.array_join(name_tokens(F.col("name")), " ").alias("tokens"))),
    "N02_fuzzy": bound(lambda t: fuzzy(t.symbols.filter("kind <> 'sentinel'"), _FUZZY)),
    "N04_prefix": bound(lambda t: prefix(t.symbols.filter("kind <> 'sentinel'"), _PREFIX)),
}

SQL = {
    "N01_name_tokens": f"WITH {_FORMS} SELECT name, array_to_string(forms[2:], ' ') AS tokens FROM forms",
    "N02_fuzzy": f"""WITH {_FORMS}, q AS (SELECT * FROM (VALUES {_values(_FUZZY)}) v(query)),
d AS (SELECT query, name, list_min(list_transform(forms, lambda x: levenshtein(x, lower(query)))) AS distance FROM forms, q)
SELECT query, name, CAST(distance AS INT) AS distance, 1 / (1 + distance) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, name) AS INT) AS rank FROM d WHERE distance <= 2 QUALIFY rank <= 20""",
    "N04_prefix": f"""WITH {_FORMS}, q AS (SELECT * FROM (VALUES {_values(_PREFIX)}) v(query)),
d AS (SELECT query, name, list_min(list_transform(list_filter(forms, lambda x: starts_with(x, lower(query))), lambda x: strlen(x))) AS matched FROM forms, q)
SELECT query, name, CAST(matched AS INT) AS matched, strlen(query) / matched AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY matched, name) AS INT) AS rank FROM d WHERE matched IS NOT NULL QUALIFY rank <= 20""",
}
