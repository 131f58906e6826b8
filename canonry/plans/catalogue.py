"""All queries of the core, and their SQL."""

from __future__ import annotations

from canonry.plans import answers, graph, problems, retrieval, sessions, subgraph, texts

_PARTS = (problems, retrieval, texts, graph, sessions, answers, subgraph)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
SQL["sector_histogram"] = f"SELECT val AS sector, count(*) AS n FROM ({SQL['p2_found']}) WHERE field_name = 'sectors_str' GROUP BY val ORDER BY n DESC, val LIMIT 5"
