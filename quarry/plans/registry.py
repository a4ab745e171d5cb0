"""The reference operators' queries and their SQL."""

from __future__ import annotations

from . import audit, graphs, models, profiles, rules, tables

FLAGSHIP = "corpus_findings_by_task"
QUERIES: dict = {**tables.QUERIES, **audit.QUERIES, **models.QUERIES, **rules.QUERIES, **profiles.QUERIES, **graphs.QUERIES}
SQL: dict[str, str] = {**tables.SQL, **audit.SQL, **models.SQL, **rules.SQL, **profiles.SQL, **graphs.SQL}
