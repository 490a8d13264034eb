"""Articles, cards and their relations, derived from the tables of a test directory.

The views are stated once as SQL templates, and filled in for Spark and for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ["documents", "labels", "pages", "benchmark", "events", "conversations"]

# {day(x)}: the date x days after 2024-01-01; {str}: the string type
TEMPLATES = {
    "articles": """SELECT CAST(d.doc_id AS {str}) AS id, d.doc_id, substr(d.text, 1, 60) AS title, d.text AS body,
  concat('https://example.test/', CAST(d.doc_id % 800 AS {str})) AS url, d.source, d.lang,
  CAST(0.5 + 0.5 * coalesce(l.quality, 0) AS DOUBLE) AS source_authority,
  {published} AS published_on, {updated} AS updated_on, CASE WHEN d.doc_id % 7 <> 0 THEN {published} END AS first_seen_on,
  CASE d.doc_id % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'saved' ELSE 'expired' END AS candidate_status,
  CASE WHEN d.doc_id % 4 = 1 AND d.doc_id % 5 <> 0 THEN {updated} END AS reviewed_on,
  CASE WHEN d.doc_id % 11 <> 0 THEN {updated} END AS last_fetched_on,
  CASE WHEN d.doc_id % 4 = 2 THEN concat('c', CAST(d.doc_id AS {str})) END AS saved_card_id,
  CASE WHEN d.doc_id % 9 = 0 THEN '["a","b"]' WHEN d.doc_id % 9 = 1 THEN 'not json' ELSE '[]' END AS tags_json
FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "cards": """SELECT concat('c', CAST(doc_id AS {str})) AS id, substr(text, 1, 60) AS title, text AS body,
  CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 100) END AS summary,
  CASE WHEN doc_id % 2 = 0 THEN concat('https://example.test/', CAST(doc_id % 800 AS {str})) ELSE '' END AS url,
  CASE doc_id % 3 WHEN 0 THEN 'memo' WHEN 1 THEN 'note' ELSE 'idea' END AS type,
  doc_id % 10 = 0 AS archived, CASE WHEN doc_id % 6 <> 5 THEN concat('g', CAST(doc_id % 21 AS {str})) END AS kj_group_id,
  {published} AS created_on, {updated} AS updated_on, doc_id AS seq FROM {documents}""",
    "card_tags": """SELECT concat('c', CAST(doc_id AS {str})) AS card_id, lang AS tag FROM {documents}
UNION ALL SELECT concat('c', CAST(doc_id AS {str})), source FROM {documents}""",
    "card_links": """SELECT concat('c', CAST(doc_id AS {str})) AS source_card_id, concat('c', CAST((doc_id * 7) % 1009 AS {str})) AS target_card_id
FROM {documents} WHERE doc_id % 2 = 0""",
    "kj_groups": """SELECT DISTINCT concat('g', CAST(doc_id % 20 AS {str})) AS id, concat('group ', CAST(doc_id % 20 AS {str})) AS name,
  CASE WHEN doc_id % 2 = 0 THEN '#FF6B6B' END AS color, CAST(doc_id % 20 AS BIGINT) AS seq FROM {documents} WHERE doc_id < 20""",
    "jobs": """SELECT concat('j', CAST(event_id AS {str})) AS id, event_type AS type, user_id,
  CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status,
  event_id AS seq, CASE WHEN event_id % 4 = 2 THEN props END AS result_json FROM {events}""",
}
SPARK = {"str": "STRING", "published": "date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT))", "updated": "date_add(DATE'2024-01-01', CAST(doc_id % 365 + doc_id % 30 AS INT))"}
DUCK = {"str": "VARCHAR", "published": "DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER)", "updated": "DATE '2024-01-01' + CAST(doc_id % 365 + doc_id % 30 AS INTEGER)"}


def _own(name: str, words: dict[str, str]) -> dict[str, str]:
    """Column names are qualified where two tables are read."""
    return {k: v.replace("doc_id", "d.doc_id") if name == "articles" and k in ("published", "updated") else v for k, v in words.items()}


def duck(select: str, *also: str) -> str:
    """A DuckDB statement over the derived tables; also: further common table expressions."""
    views = [f"{name} AS ({template.format(**_own(name, DUCK), **{b: b for b in BASE})})" for name, template in TEMPLATES.items()]
    return f"WITH {', '.join([*views, *also])}\n{select}"


class Tables:
    """The tables of one directory, base and derived, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        template = TEMPLATES[name]
        frames = {b: self.base(b) for b in BASE if f"{{{b}}}" in template}
        return self.spark.sql(template.format(**_own(name, SPARK), **{b: f"{{{b}}}" for b in BASE}), **frames)

    articles = cached_property(lambda self: self._derived("articles"))
    cards = cached_property(lambda self: self._derived("cards"))
    card_tags = cached_property(lambda self: self._derived("card_tags"))
    card_links = cached_property(lambda self: self._derived("card_links"))
    kj_groups = cached_property(lambda self: self._derived("kj_groups"))
    jobs = cached_property(lambda self: self._derived("jobs"))
