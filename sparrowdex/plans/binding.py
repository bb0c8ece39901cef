"""How the queries bind the operators to tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowdex.operators.lookup import symbol_view
from sparrowdex.runtime import table

#: The name that holds about a tenth of all symbols.
NAME = "new"

SYM = """sym AS (SELECT s.id, s.file_id, f.path AS file, f.lang, s.name, s.qualified, s.kind, s.parent_id, p.name AS parent,
  s.line_start, s.line_end, s.signature, s.visibility
  FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN symbols p ON p.id = s.parent_id)"""

HITS = """hits AS (SELECT d.name, f.path AS file, s.file_id, e.line, e.src_symbol_id, s.name AS src_name, e.kind
  FROM edges e JOIN symbols d ON d.id = e.dst_symbol_id JOIN symbols s ON s.id = e.src_symbol_id JOIN files f ON f.id = s.file_id)"""

DRAWER = """drawer AS (SELECT d.id, w.name AS wing, r.name AS room, d.session_id, d.source_id, d.body, d.created_at, d.sha256
  FROM drawers d JOIN wings w ON w.id = d.wing_id LEFT JOIN rooms r ON r.id = d.room_id)"""


class Tables:
    """The tables of one directory by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)

    @property
    def sym(self) -> DataFrame:
        return symbol_view(self.symbols, self.files)

    @property
    def drawer(self) -> DataFrame:
        wings = self.wings.selectExpr("id AS wing_id", "name AS wing")
        rooms = self.rooms.selectExpr("id AS room_id", "name AS room")
        return self.drawers.join(wings, "wing_id").join(rooms, "room_id", "left")


def bound(build):
    """A query (spark, sf_dir) from a function of Tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    query.__name__, query.__doc__ = build.__name__, build.__doc__
    return query
