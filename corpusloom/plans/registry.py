"""The registered queries of the library's own operators and their DuckDB counterparts.

Each module of ``corpusloom.plans`` maps names to (query, SQL or None); a query takes (spark, sf_dir) and reads the
tables of that folder.
"""

from __future__ import annotations

from corpusloom.plans import access_q, corpus_q, eval_q, flow_q, more_q, report_q, search_q, stream_q, text_q

_ALL = {}
for _module in (access_q, text_q, search_q, report_q, corpus_q, eval_q, more_q, flow_q, stream_q):
    _ALL |= _module.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
