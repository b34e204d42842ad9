"""Queries of problem 1: nested records into flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.nested import child_table, nested_objects
from gneiss.session import spread, table

SOURCES = (("records", "record_id", "record_json"), ("candidates", "candidate_id", "payload_json"))


def _objects(spark: SparkSession, sf_dir: str, with_json: bool = False) -> DataFrame:
    parts = [
        nested_objects(spread(table(spark, sf_dir, name).select(key, text)), key, text, with_json=with_json).select(F.lit(name).alias("parent_table"), "*")
        for name, key, text in SOURCES
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).select("parent_table", "parent_id", "path")


def p1_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of all records as a flat table keyed by record and path."""
    return child_table(table(spark, sf_dir, "records"), "record_id", "record_json", "claims", "type string, evidence_url string, evidence_text_original string")


def p1_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search results of all candidates, each with the path of its search run."""
    return child_table(table(spark, sf_dir, "candidates"), "candidate_id", "payload_json", "results", "rank int, url string, title string")


_LISTS = "'claims', 'sources', 'spans', 'emails', 'contact_forms', 'exclusion_checks', 'reassessment_history', 'changes', 'search_runs', 'results', 'osm_elements', 'hints'"


def walk_sql(sources: str) -> str:
    """Every object in a list of ``sources`` (t, id, v): CTE ``found`` with t, id, path, up (the object above) and v.

    One step opens a text that is JSON, an object's members or a list's elements; how a value counts goes with it.
    """
    return f"""WITH RECURSIVE src AS ({sources}),
    walk AS (
        SELECT t, id, '' AS path, '' AS up, 'plain' AS role, ltrim(v, chr(65279))::JSON AS v FROM src WHERE json_valid(ltrim(v, chr(65279)))
        UNION ALL
        SELECT t, id, path, up, role, v FROM (
            SELECT t, id, path, up, role, ltrim(v->>'$', chr(65279))::JSON AS v FROM walk WHERE json_type(v) = 'VARCHAR' AND json_valid(ltrim(v->>'$', chr(65279)))
            UNION ALL
            SELECT t, id, path || (CASE WHEN role = 'lone' THEN '[0]' ELSE '' END) || (CASE WHEN path = '' THEN '' ELSE '.' END) || k,
                CASE WHEN role = 'plain' THEN up ELSE path || (CASE WHEN role = 'lone' THEN '[0]' ELSE '' END) END, CASE WHEN k IN ({_LISTS}) THEN 'lone' ELSE 'plain' END,
                json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT')
            UNION ALL
            SELECT t, id, path || '[' || n || ']', up, 'element', json_extract(v, '$[' || n || ']') FROM (SELECT *, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS n FROM walk WHERE json_type(v) = 'ARRAY')
        )
    ),
    found AS (SELECT t, id, path || (CASE WHEN role = 'lone' THEN '[0]' ELSE '' END) AS path, up, v FROM walk WHERE role <> 'plain' AND json_type(v) = 'OBJECT')
    """


_RECORDS = "SELECT 'records' AS t, record_id AS id, record_json AS v FROM records"
_CANDIDATES = "SELECT 'candidates' AS t, candidate_id AS id, payload_json AS v FROM candidates"
_CHILD = "SELECT id AS parent_id, path, up AS parent_path, CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS INTEGER) AS position"


def field_sql(name: str, kind: str | None = None) -> str:
    """A field of ``v``: text as it says, all else as written; with ``kind`` only what is no text and reads as one."""
    if kind:
        return f"CASE WHEN json_type(v->'{name}') <> 'VARCHAR' THEN TRY_CAST(v->>'{name}' AS {kind}) END AS {name}"
    return f"CASE WHEN json_type(v->'{name}') <> 'NULL' THEN v->>'{name}' END AS {name}"


def of_list(name: str) -> str:
    return f"regexp_matches(path, '(^|\\.){name}(\\[\\d+\\])+$')"


QUERIES = {"p1_found": p1_found, "p1_claims": p1_claims, "p1_results": p1_results}
SQL: dict[str, str] = {
    "p1_found": walk_sql(f"{_RECORDS} UNION ALL {_CANDIDATES}") + "SELECT t AS parent_table, id AS parent_id, path FROM found",
    "p1_claims": walk_sql(_RECORDS) + f"{_CHILD}, {field_sql('type')}, {field_sql('evidence_url')}, {field_sql('evidence_text_original')} FROM found WHERE {of_list('claims')}",
    "p1_results": walk_sql(_CANDIDATES) + f"{_CHILD}, {field_sql('rank', 'INTEGER')}, {field_sql('url')}, {field_sql('title')} FROM found WHERE {of_list('results')}",
}
