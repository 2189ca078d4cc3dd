"""Golden records against SQL, and against a plain reading of the rules record by record."""

import datetime as dt
import random
import re

import pytest
from corpusmill.llm import survivorship
from corpusmill.llm.queries import ORACLE_SQL

from tests.conftest import oracle, same

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, n int, `at` string, `top` int"
TRUST = {"partner": 0, "store": 1, "web": 2, "crm": 3}


def plain(rows):
    clusters, out = {}, {}
    blank = lambda s: None if s is None or re.fullmatch(r"[\x20\x09-\x0D]*", s) else s
    for c, m, source, at, name, email, city, nation, segment, balance, *_ in rows:
        clusters.setdefault(c if m is None else m, []).append((c, TRUST.get(source, 4), at, blank(name), blank(email), blank(city), nation, blank(segment), None if balance is None or balance != balance or abs(balance) >= 9e16 else balance))
    for cluster, held in clusters.items():
        top = max((r[2] for r in held if r[2]), default=None)
        stale = lambda r: r[2] is None or r[2] < top - dt.timedelta(hours=720)  # noqa: B023, E731
        nulls = lambda *vs: tuple((v is None, [-ord(x) for x in v] + [1] if isinstance(v, str) else -v if v is not None else 0) for v in vs)  # noqa: E731  greater first
        held = sorted(held, key=lambda r: (nulls(r[3], r[4], r[7], r[5], r[6], r[8])))
        held.sort(key=lambda r: (r[2] is None, -(r[2] - dt.datetime(2000, 1, 1)).total_seconds() if r[2] else 0, r[1], r[0] is None, r[0] or 0))
        trusted = sorted(held, key=lambda r: (stale(r), r[1]))
        seg = next((r for r in held if r[7] is not None), None)
        ruling = seg[7] if seg else None
        email = next((r for r in trusted if r[4] is not None), None)
        name = min((r for r in trusted if r[3] is not None), key=lambda r: -len(r[3]), default=None)
        place = min(trusted, key=lambda r: -((r[5] is not None) + (r[6] is not None)))
        money = min((r for r in held if r[8] is not None), key=lambda r: r[7] != ruling, default=None)
        out[cluster] = (
            cluster, len(held), sum(map(stale, held)), name and name[3], email and email[4], ruling, place[5], place[6], money and int((100 * money[8] + 0.5) // 1),
            name and name[0], email and email[0], seg and seg[0], money and money[0], place[0] if (place[5], place[6]) != (None, None) else None,
        )
    return out


def some(rng, n, clusters):
    start = dt.datetime(2024, 1, 1)
    text = lambda *vs: rng.choice([None, "", " \t", *vs])
    times = [start + dt.timedelta(microseconds=k) for k in (0, 1, 30 * 86_400_000_000 - 1, 30 * 86_400_000_000, 30 * 86_400_000_000 + 1, 60 * 86_400_000_000)]
    return [
        (
            rng.choice([None, rng.randrange(5 * n)]), rng.choice([None, *range(clusters)]), rng.choice(["partner", "store", "web", "crm", "CRM", None]), rng.choice([None, *times]), text("Ann", "Bea ", " Ann", "Zoë𝄞", "Zoëx"),
            text("a@x", "b@x", "ä@x"), text("Bern", "Rome"), rng.choice([None, 1, 2]), text("retail", "export", "retail "), rng.choice([None, 1.005, -0.005, 2.675, float("nan"), float("inf"), 1e300, -3.25]), 7, "x", None,
        )
        for _ in range(n)
    ]


def rows_of(df):
    return {r.cluster_id: tuple(r) for r in df.collect()}


def test_sql(spark, medium):
    same(survivorship.golden_records(spark.read.parquet(f"{medium}/clients.parquet")), oracle(ORACLE_SQL["op11_golden_records"], medium))


@pytest.mark.parametrize("held, large", [(100_000, 1000), (20, 1000), (20, 30)])
def test_against_plain(spark, held, large, monkeypatch):
    """Nulls in any column, blanks, ties to the last field, repeats, other sources; rows pruned once, often, and in two steps."""
    rng = random.Random(held + large)
    rows = some(rng, 700, 12)
    rows += rng.sample(rows, 60)
    monkeypatch.setattr(survivorship, "HELD_ROWS", held)
    monkeypatch.setattr(survivorship.large_clusters, "__defaults__", (4, large))
    assert rows_of(survivorship.golden_records(spark.createDataFrame(rows, CLIENTS).repartition(7))) == plain(rows)


def test_large_cluster_leaves_few_survivors(spark):
    rng = random.Random(3)
    rows = [(k, 1, rng.choice(list(TRUST)), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k * 97), f"n{k % 7}", None if k % 3 else f"e{k}", "c", k % 5, f"s{k}", float(k), 1, "", 1) for k in range(20_000)]
    df = spark.createDataFrame(rows, CLIENTS).repartition(16)
    left = survivorship.survivors(df)
    assert left.count() < 16 * 30  # segments and times all differ: neither grows what is left
    assert rows_of(survivorship.golden_records(df)) == plain(rows)


def test_nothing_and_no_ids(spark):
    none = spark.createDataFrame([], CLIENTS)
    assert survivorship.golden_records(none).count() == 0
    lone = [(None, None, "web", None, None, None, None, None, None, None, 1, "", 1), (None, None, "web", dt.datetime(1, 3, 1), "x" * 100_000, None, None, None, None, -0.0, 1, "", 1)]
    assert rows_of(survivorship.golden_records(spark.createDataFrame(lone, CLIENTS))) == plain(lone)


def test_timestamps_with_a_zone(spark):
    df = spark.sql("SELECT 1L AS client_id, 1L AS master_id, 'web' AS source, timestamp'2024-03-31 02:30:00' AS updated_at, 'a' AS name, 'b' AS email, 'c' AS city, 1 AS nation_id, 's' AS segment, 1.0D AS balance")
    assert rows_of(survivorship.golden_records(df))[1][:3] == (1, 1, 0)
