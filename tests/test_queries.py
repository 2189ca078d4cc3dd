"""Every registered query of the engine's own operators: against SQL where there is some."""

import pytest

from corpusmill.plans.catalog import ORACLE_SQL, QUERIES
from corpusmill.streaming.limits import take
from tests.conftest import oracle, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, medium, name):
    same(QUERIES[name](spark, medium), oracle(ORACLE_SQL[name], medium))


def test_requests(spark, medium):
    events = sorted((r.user_id, r.ts.timestamp(), r.event_id) for r in spark.read.parquet(f"{medium}/events.parquet").collect())
    state, want = {}, {}
    for user, at, event in events:
        tokens, updated = state.get(user, (None, 0.0))
        tokens, allowed, _ = take(tokens, updated, at, 2, 86_400)
        state[user], want[event] = (tokens, max(updated, at)), allowed
    got = {r.event_id: r.allowed for r in QUERIES["admitted_requests"](spark, medium).collect()}
    assert got == want and len(set(want.values())) == 2
