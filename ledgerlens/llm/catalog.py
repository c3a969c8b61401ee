"""All queries of the subpackage and their DuckDB SQL."""
from __future__ import annotations

from . import q_other, q_text

QUERIES = {name: (fn, sql) for name, (fn, sql) in sorted({**q_text.QUERIES, **q_other.QUERIES}.items(),
                                                         key=lambda e: int(e[0][2:].split("_")[0]))}
