"""All oracle SQL keyed like the registered queries."""

from __future__ import annotations

from oracle import race
from oracle.cte import with_ctes


def oracle_sql() -> dict[str, str]:
    out = {n: with_ctes(f"SELECT * FROM {n}") for n in race.STAGING + race.MARTS}
    try:
        from oracle import queries as q
        out.update({k: with_ctes(v) for k, v in q.SQL.items()})
    except ImportError:
        pass
    try:
        from oracle import generic as g
        out.update({k: with_ctes(v) for k, v in g.SQL.items()})
    except ImportError:
        pass
    return out
