"""All queries of this subpackage."""

from __future__ import annotations

from nearfield.llm import mixing, packing, proportions, sentences, similar, spectral, spelling, stable, topn

MODULES = [topn, similar, spelling, spectral, proportions, stable, packing, mixing, sentences]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
