"""Named CTEs with dependencies, assembled into one WITH clause per query."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _deps(sql: str) -> list[str]:
    words = set(re.findall(r"\b([a-z_][a-z0-9_]*)\b", sql))
    return [n for n in CTES if n in words]


def with_ctes(final_sql: str) -> str:
    order: list[str] = []
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen:
            return
        seen.add(n)
        for d in _deps(CTES[n]):
            if d != n:
                visit(d)
        order.append(n)

    for d in _deps(final_sql):
        visit(d)
    if not order:
        return final_sql.strip()
    shared = "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    final = final_sql.strip()
    if final[:5].upper() == "WITH ":        # the query's own CTEs follow the shared ones
        return f"{shared},\n{final[5:]}"
    return f"{shared}\n{final}"
