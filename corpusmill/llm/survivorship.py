"""Golden records: one record per cluster of client records, its fields taken by rules of survivorship.

Each task first prunes what it reads to the records that may still win a slot of their cluster (a field, a level of
trust, a segment), and to counts of what may be stale; only these are shuffled and merged in pandas, by the same
pruning. Clusters that hold a large part of the table are known beforehand with their latest time and their segment.
Their survivors are then a number of slots that does not grow, and meet in two steps, salted first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Sources by falling trust; any other, null too, comes after them.
TRUST = ("partner", "store", "web", "crm")
#: A record this much older than its cluster's latest is stale.
FRESH_US = 30 * 24 * 3600 * 1_000_000
#: Rows of a task that are held before they are pruned.
HELD_ROWS = 100_000
#: White space that makes a string count as null.
BLANK = " \t\n\x0b\x0c\r"

FIELDS = ("name", "email", "segment", "city", "nation_id", "balance")
#: What goes between the steps. n: how many records a row stands for; at: microseconds; top, chosen: of large clusters alone.
STATE = "cluster_id long, client_id long, trust int, at long, name string, email string, segment string, city string, nation_id int, balance double, n long, top long, chosen string, salt int"
GOLDEN = (
    "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id int, balance_cents long, "
    "name_from long, email_from long, segment_from long, balance_from long, address_from long"
)


def records(clients: DataFrame) -> DataFrame:
    """The columns of STATE that a record has by itself: blank strings null, trust by number, balances that are no number null."""
    rows = shared.columns_only(clients, "client_id", "master_id", "source", "updated_at", *FIELDS)
    text = {c: F.when(F.length(F.btrim(c, F.lit(BLANK))) > 0, F.col(c)) for c in ("name", "email", "segment", "city")}
    level = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in TRUST]), F.col("source")) - 1, F.lit(-1))
    number = F.when((F.abs("balance") < 9e16) & ~F.isnan("balance"), F.col("balance"))
    return rows.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"), F.col("client_id").cast("long"), F.when(level < 0, len(TRUST)).otherwise(level).cast("int").alias("trust"),
        F.col("updated_at"), text["name"].alias("name"), text["email"].alias("email"), text["segment"].alias("segment"), text["city"].alias("city"),
        F.col("nation_id").cast("int"), number.cast("double").alias("balance"),
    )


def recent() -> Column:
    """RECENT as a value whose maximum comes first; equal records in all of it are told apart by their fields, greater ones first."""
    return F.struct("updated_at", -F.col("trust"), -F.col("client_id"), *FIELDS)


def large_clusters(rows: DataFrame, share: int = 4, least: int = 1000) -> DataFrame:
    """(cluster, top, chosen) of clusters above a ``share``-th of a shuffle partition's fair part: their latest time and their segment.

    There are ``share`` for each partition at most, whatever the size of the table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(least, rows.count() // (share * parts))
    large = shared.cut(rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("cluster_id").alias("cluster")))
    held = rows.join(F.broadcast(large), F.col("cluster_id").eqNullSafe(F.col("cluster")))
    chosen = F.max_by("segment", F.when(F.col("segment").isNotNull(), recent()))
    return shared.cut(held.groupBy("cluster").agg(F.max("updated_at").alias("top"), chosen.alias("chosen"))).withColumn("known", F.lit(True))


def _ordered(df):
    """The rows by cluster, then RECENT, then falling fields; nulls last everywhere."""
    df = df.sort_values(["cluster_id", *FIELDS], ascending=[True, *[False] * len(FIELDS)], kind="stable", na_position="last")
    for column, rising in (("client_id", True), ("trust", True), ("at", False), ("cluster_id", True)):
        df = df.sort_values(column, ascending=rising, kind="stable", na_position="last")
    return df.reset_index(drop=True)


def _first(df, keys: list[str]):
    """Positions of the first row of each group."""
    return df.index[~df.duplicated(keys)]


def _slots(df):
    """df (ordered) with what its slots are told by: points of the name, non-null values of the address, how the segment counts."""
    big = df["top"].notna() | df["salt"].ne(0)
    by_choice = (df["segment"] == df["chosen"]) | (df["segment"].isna() & df["chosen"].isna())
    segment = df["segment"].fillna("").where(~big, by_choice.map({True: "y", False: "n"}))
    return df.assign(points=df["name"].map(len, na_action="ignore").astype("float64").fillna(0), filled=df["city"].notna().astype("int8") + df["nation_id"].notna().astype("int8"), kind=segment)


def prune(df):
    """The rows of STATE that may still matter, given others of the same clusters: winners of slots, and counts.

    Within a level of trust TRUSTED is RECENT, fresh records being the later ones; so a field's winner under any final
    latest time is among its RECENT firsts of each level, a balance's among those of each segment. A row that is stale
    by what is known here is so for good; the others are counted by their time, of large clusters by that they are fresh.
    """
    df = _slots(_ordered(df))
    kept = [
        _first(df[df["email"].notna()], ["cluster_id", "trust"]),
        _first(df[df["segment"].notna()], ["cluster_id"]),
        _first(df[df["balance"].notna()], ["cluster_id", "kind"]),
        _first(df[df["points"] > 0].sort_values("points", ascending=False, kind="stable"), ["cluster_id", "trust"]),
        _first(df[df["filled"] > 0].sort_values("filled", ascending=False, kind="stable"), ["cluster_id", "trust"]),
    ]
    latest = df.groupby("cluster_id", dropna=False)["at"].transform("max")
    latest = df["top"].fillna(latest)
    fresh = df["at"].notna() & (df["at"] >= latest - FRESH_US)
    df["clock"] = df["at"].where(df["top"].isna(), df["top"]).where(fresh)
    n = df.groupby(["cluster_id", "clock"], dropna=False)["n"].transform("sum")
    wins = df.index.isin(kept[0].union(kept[1]).union(kept[2]).union(kept[3]).union(kept[4]))
    # a winner carries the count of its time; where a time has no winner, a row without fields does
    chief = ~df.assign(last=~wins).sort_values("last", kind="stable").duplicated(["cluster_id", "clock"]).sort_index()
    df["n"] = n.where(chief, 0)
    bare = chief & ~wins
    df.loc[bare, "at"] = df.loc[bare, "clock"]
    for c in ("client_id", *FIELDS):
        df[c] = df[c].mask(bare)
    df["trust"] = df["trust"].mask(bare, len(TRUST) + 1)
    return df[wins | chief]


def golden(df):
    """One row of GOLDEN for each cluster of df, which holds all survivors of its clusters."""
    import numpy as np
    import pandas as pd

    df = _slots(_ordered(df))
    groups = df.groupby("cluster_id", dropna=False, sort=False)
    latest = groups["at"].transform("max")
    df["stale"] = df["at"].isna() | (df["at"] < latest - FRESH_US)
    trusted = df.sort_values("trust", kind="stable").sort_values("stale", kind="stable")
    base = df.loc[_first(df, ["cluster_id"]), ["cluster_id"]]

    def first(rows, **columns):
        """The named columns of the first row of each cluster."""
        return rows.loc[_first(rows, ["cluster_id"]), ["cluster_id", *columns.values()]].set_axis(["cluster_id", *columns], axis=1)

    segment = first(df[df["segment"].notna()], segment="segment", segment_from="client_id")
    own = df.merge(segment[["cluster_id", "segment"]].rename(columns={"segment": "ruling"}), "left", "cluster_id")
    own["other"] = own["segment"].ne(own["ruling"]) & own["ruling"].notna()
    address = trusted[trusted["filled"] > 0].sort_values("filled", ascending=False, kind="stable")
    parts = [
        df.groupby("cluster_id", dropna=False, sort=False)["n"].sum().rename("n_records").reset_index(),
        df[df["stale"]].groupby("cluster_id", dropna=False, sort=False)["n"].sum().rename("n_stale").reset_index(),
        first(trusted[trusted["points"] > 0].sort_values("points", ascending=False, kind="stable"), name="name", name_from="client_id"),
        first(trusted[trusted["email"].notna()], email="email", email_from="client_id"),
        segment,
        first(address, city="city", nation_id="nation_id", address_from="client_id"),
        first(own[own["balance"].notna()].sort_values("other", kind="stable"), balance="balance", balance_from="client_id"),
    ]
    out = base
    for part in parts:
        out = out.merge(part, "left", "cluster_id")
    out["n_stale"] = out["n_stale"].fillna(0)
    cents = np.floor(100 * out["balance"].astype("float64") + 0.5)
    out["balance_cents"] = pd.array(cents.fillna(0).astype("int64"), dtype="Int64")
    out.loc[out["balance"].isna(), "balance_cents"] = pd.NA
    return out


def _frame(table):
    """An Arrow table as pandas; whole numbers stay whole where some are null."""
    import pandas as pd
    import pyarrow as pa

    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)


def _batches(df, schema: list[tuple[str, object]]) -> Iterator:
    import pyarrow as pa

    table = pa.table({name: pa.array(df[name], type=kind, from_pandas=True) for name, kind in schema})
    yield from table.to_batches(max_chunksize=10_000)


def _arrow(schema: str) -> list[tuple[str, object]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields]


def _prune_task(schema: list[tuple[str, object]], salts: int) -> Callable[[Iterable], Iterator]:
    """Prunes the rows of a task. They are held up to HELD_ROWS; where pruning no longer halves them they go on as they are."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        held, n, salt = [], 0, 1 + TaskContext.get().partitionId() % salts
        for batch in batches:
            if not batch.num_rows:
                continue
            df = _frame(pa.Table.from_batches([batch]))
            held.append(df.assign(salt=df["salt"].where(df["salt"].eq(0), salt)))
            n += len(df)
            if n >= HELD_ROWS:
                held = [prune(pd.concat(held, ignore_index=True))]
                n = len(held[0])
                if n > HELD_ROWS // 2:
                    yield from _batches(held[0], schema)
                    held, n = [], 0
        if held:
            yield from _batches(prune(pd.concat(held, ignore_index=True)), schema)

    return run


def _merge_task(schema: list[tuple[str, object]]) -> Callable[[Iterable], Iterator]:
    """Golden records of rows that come sorted by cluster: whole clusters in vectors, the last one held over."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            df = _frame(pa.Table.from_batches([batch]))
            held = df if held is None else pd.concat([held, df], ignore_index=True)
            last = held["cluster_id"].iloc[-1]
            open_ = held["cluster_id"].isna() if pd.isna(last) else held["cluster_id"].eq(last).fillna(False).astype(bool)
            if not open_.all():
                yield from _batches(golden(held[~open_]), schema)
            held = held[open_]
            if len(held) > HELD_ROWS:
                held = prune(held)
        if held is not None:
            yield from _batches(golden(held), schema)

    return run


def survivors(clients: DataFrame, salts: int = 64) -> DataFrame:
    """The rows of STATE that are left of each cluster: pruned in the task that reads them, large clusters by salt once more."""
    shared.ship(clients.sparkSession)
    rows = records(clients)
    large = F.broadcast(large_clusters(rows))
    marked = rows.join(large, F.col("cluster_id").eqNullSafe(F.col("cluster")), "left")
    state = _arrow(STATE)
    asked = [F.col(name) if name in rows.columns else value for name, value in (
        *[(c, None) for c in ("cluster_id", "client_id", "trust")], ("at", _micros("updated_at").alias("at")), *[(c, None) for c in FIELDS],
        ("n", F.lit(1).cast("long").alias("n")), ("top", _micros("top").alias("top")), ("chosen", F.col("chosen")), ("salt", F.coalesce("known", F.lit(False)).cast("int").alias("salt")),
    )]
    pruned = shared.cut(marked.select(*asked).mapInArrow(_prune_task(state, salts), STATE))
    warm = pruned.filter("salt > 0").repartition("cluster_id", "salt").mapInArrow(_prune_task(state, 1), STATE)
    return pruned.filter("salt = 0").unionByName(warm)


def _micros(column: str) -> Column:
    """A timestamp, with or without a zone, in microseconds of its own clock."""
    since = F.col(column).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), since).cast("long")
    seconds = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
    return F.when(F.col(column).isNotNull(), ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + seconds)


def golden_records(clients: DataFrame) -> DataFrame:
    """One row of GOLDEN per cluster_id (master_id, else client_id) of clients.

    The rules: RECENT is the latest updated_at (null last), then higher trust, then the smaller client_id. TRUSTED is
    fresh before stale, higher trust, RECENT. Segment by RECENT; email by TRUSTED; name by most code points, then
    TRUSTED; balance from records of the chosen segment, then RECENT; city and nation_id of one record, by most non-null
    values, then TRUSTED. Records with neither id form one cluster, with null for its id. Sources not in TRUST rank below
    all others; a null client_id comes after any other; records alike in time, trust and id are told apart by their
    fields, greater ones (code points) first, nulls last. Balances that are NaN, infinite or of 9e16 and more are null.
    A cluster's survivors are bounded by slots: five for each level of trust, one for each segment, and for clusters
    below the bound of ``large_clusters`` a row for each time of the last 30 days. No rows give none.
    """
    return survivors(clients).repartition("cluster_id").sortWithinPartitions("cluster_id").mapInArrow(_merge_task(_arrow(GOLDEN)), GOLDEN)
