"""Queries over what a service stores and sends: snapshots, addresses, limits, streams, recovered JSON, display tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import held
from ..operators import digest, graph, search, summaries
from ..sources import commits, snapshots
from ..streaming import events, keyed, limits
from .registry import pick, pick_sql, query, table

# ---- addresses and limits

_URLS = [
    "https://github.com/{}/{}.git", "git@github.com:{}/{}.git", "www.github.com/{}/{}", "HTTPS://GitHub.com/{}/{}/", "http://github.com/{}/{}", "https://u:p@github.com/{}/{}", "https://github.com:444/{}/{}", "https://github.com/{}/{}?tab=x", "https://github.com/{}/{}#top",
    "https://github.com/{}/x/{}", "https://evil.com/{}/{}", "https://github.com/-{}/{}", "  ", "ftp://github.com/{}/{}", "github.com/{}/{}",
]
_REASONS = ["", "", "scheme", "", "scheme", "credentials", "port", "query", "fragment", "segments", "host", "name", "empty", "scheme", "scheme"]


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 15 AS INTEGER) AS k, 'own' || p_partkey % 7 AS o, 'repo.' || p_partkey AS n FROM part)
    SELECT p_partkey, {pick_sql(_REASONS, 'k')} AS reason, CASE WHEN {pick_sql(_REASONS, 'k')} = '' THEN 'https://github.com/' || o || '/' || n END AS url, CASE WHEN {pick_sql(_REASONS, 'k')} = '' THEN substr(sha256('https://github.com/' || o || '/' || n), 1, 12) END AS repo_id FROM p""")
def url_admission(spark, sf_dir):
    """Addresses of repositories in three accepted spellings, and refused ones for nine reasons."""
    p, raw = F.col("p_partkey"), F.lit("")
    for k, shape in enumerate(_URLS):
        pieces = shape.split("{}")
        values = [F.concat(F.lit("Own" if k < 4 else "own"), (p % 7).cast("string")), F.concat(F.lit("repo."), p.cast("string"))]
        text = F.concat(*[x for i, part in enumerate(pieces) for x in (F.lit(part), *([values[i]] if i < len(pieces) - 1 else []))])
        raw = F.when(p % len(_URLS) == k, text).otherwise(raw)
    seen = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", X.admit_url(F.col("raw")).alias("a"))
    return seen.select("p_partkey", "a.reason", "a.url", X.repo_id(F.col("a.url")).alias("repo_id"))


_SPECS = ["5/60", " 3 / 2M ", "1/1h", "0/5", "x", "", "7/0", "12/3600s", "-1/5", "2/3d"]
_NUMBERS = ["12", "a 7 b", "none", "", "3.9", "-4", "99999999999"]
_SLUGS = ["demo", "a/b", "..", ".hid", "a\\b", "", "ok-1"]
_CALLS = ["<tool_call>x", "read_file (a)", "my.read_file(a)", "I will read_file now", "search_code('x')", "plain", "< function = x >", "research_code(x)"]
_SECRETS = ["Bearer abc.def-1", "key sk-12345678abc end", "nothing", "ghp_abcdefgh12 tvly-zzzzzzzz1"]


@query(f"""WITH p AS (SELECT p_partkey AS k, {pick_sql(_SPECS, 'p_partkey')} AS spec, {pick_sql(_NUMBERS, 'p_partkey')} AS num, {pick_sql(_SLUGS, 'p_partkey')} AS slug, {pick_sql(_CALLS, 'p_partkey')} AS said, {pick_sql(_SECRETS, 'p_partkey')} AS t, p_size FROM part),
    q AS (SELECT *, TRY_CAST(regexp_extract(lower(trim(spec)), '^(\\d+)\\s*/\\s*(\\d+)\\s*([smh]?)$', 1) AS BIGINT) AS n, TRY_CAST(regexp_extract(lower(trim(spec)), '^(\\d+)\\s*/\\s*(\\d+)\\s*([smh]?)$', 2) AS BIGINT) * CASE regexp_extract(lower(trim(spec)), '^(\\d+)\\s*/\\s*(\\d+)\\s*([smh]?)$', 3) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 1 END AS w FROM p)
    SELECT k, CASE WHEN n > 0 AND w > 0 THEN n ELSE 9 END AS allowed, CASE WHEN n > 0 AND w > 0 THEN w ELSE 99 END AS seconds, coalesce(CASE WHEN regexp_matches(num, '^[-]?\\d+$') THEN TRY_CAST(num AS INTEGER) END, CASE WHEN num = '3.9' THEN 3 END, TRY_CAST(regexp_extract(num, '(\\d+)', 1) AS INTEGER), 5) AS safe,
        slug <> '' AND NOT contains(slug, '/') AND NOT contains(slug, '\\') AND NOT starts_with(slug, '.') AS slug_ok, regexp_matches(said, '(?i)<\\s*/?\\s*(?:tool_call|function_call|function\\s*=|tool)\\b') OR regexp_matches(said, '(^|[^\\w.])(read_file|search_code)\\s*\\(') AS is_call,
        CASE WHEN t LIKE 'Bearer%' THEN 'Bearer [redacted]' WHEN t LIKE 'key%' THEN 'key [redacted] end' WHEN t LIKE 'ghp%' THEN '[redacted] [redacted]' ELSE t END AS redacted, CASE WHEN k % 3 = 0 THEN 'hop' || k ELSE 'host' END AS client, substr(sha256('guest:h' || k % 5), 1, 16) AS guest,
        greatest(2, least(24, CAST(round_even(2 + 0.6 * p_size + 1.2 * (k % 5) + 0.4 * (k % 3) + 2 * (k % 2), 0) AS INTEGER))) AS node_size FROM q""")
def request_facts(spark, sf_dir):
    """Limits, numbers, slugs, texts that call tools, secrets, callers and sizes, as they come."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_size", k.alias("k"), X.parse_limit(pick(_SPECS, k), 9, 99).alias("limit"), pick(_NUMBERS, k).alias("num"), pick(_SLUGS, k).alias("slug"), pick(_CALLS, k).alias("said"), pick(_SECRETS, k).alias("t"))
    k = F.col("k")
    return p.select(
        "k", F.col("limit.count").alias("allowed"), F.col("limit.window").alias("seconds"), X.safe_int(F.col("num"), 5).alias("safe"), X.demo_slug_ok(F.col("slug")).alias("slug_ok"), X.is_tool_call_text(F.col("said"), ["read_file", "search_code"]).alias("is_call"), X.redact(F.col("t")).alias("redacted"),
        X.client_key(F.when(k % 3 == 0, F.concat(F.lit(" hop"), k.cast("string"), F.lit(", other"))), F.lit("host")).alias("client"), X.guest_id(F.concat(F.lit("h"), (k % 5).cast("string"))).alias("guest"), X.size_value(F.col("p_size"), k % 5, k % 3, k % 2).alias("node_size"),
    )


@query()
def admitted_runs(spark, sf_dir):
    """Events as requests to analyse: joined to a run, started, or refused while four go on; sequential, so tests hold it against a plain loop."""
    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("event_type").alias("instance"), "event_id", (F.col("user_id") % 12).cast("string").alias("url"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), ((F.col("user_id") % 7 + 1) * 9000.0).alias("seconds"))
    return limits.admit_runs(requests)


@query("SELECT event_type AS kind, CAST(10 AS BIGINT) AS capacity, CAST(60 AS BIGINT) AS \"window\", count(DISTINCT user_id) AS tracked FROM events GROUP BY event_type")
def tracked_buckets(spark, sf_dir):
    return summaries.buckets(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.lit(10).cast("bigint").alias("capacity"), F.lit(60).cast("bigint").alias("window"), F.col("user_id").alias("key")))


@query("SELECT count_if(o_orderkey % 5 = 0) AS running, count_if(o_orderkey % 5 <> 0) AS finished, count_if(o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0) AS failed FROM orders")
def described_jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    return summaries.jobs(table(spark, sf_dir, "orders").select(F.when(k % 5 != 0, F.col("o_orderdate")).alias("finished_at"), F.when(k % 3 == 0, "broken").otherwise("").alias("error")))


# ---- JSON

_JSON = "p AS (SELECT p_partkey AS k, p_size AS n, 't' || p_partkey % 9 || ' {x]' AS t FROM part)"


@query(f"WITH {_JSON} SELECT k, CASE WHEN k % 8 = 7 THEN -1 ELSE n END AS n, CASE WHEN k % 8 IN (0, 1, 3) THEN t END AS t, CASE WHEN k % 8 IN (2, 4) THEN 'true' END AS b FROM p")
def recovered_json(spark, sf_dir):
    """Numbers and texts out of JSON as models write it: plain, fenced, with Python's words, trailing commas, comments, prose, curly quotes and brackets inside texts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("n"), F.concat(F.lit("t"), (F.col("p_partkey") % 9).cast("string"), F.lit(" {x]")).alias("t"))
    n, t = F.col("n"), F.col("t")
    shapes = [
        F.concat(F.lit('{"n": '), n, F.lit(', "t": "'), t, F.lit('"}')), F.concat(F.lit('Sure:\n```json\n{"n": '), n, F.lit(', "t": "'), t, F.lit('"}\n```\nDone')), F.concat(F.lit('{"n": '), n, F.lit(', "b": True, "z": None,}')),
        F.concat(F.lit('I found {"t": "'), t, F.lit('", "n": '), n, F.lit("} and [1]")), F.concat(F.lit("{“n”: "), n, F.lit(", “b”: True}")), F.concat(F.lit('{"n": '), n, F.lit("} // as asked")), F.concat(F.lit('text {"n": '), n, F.lit(', "a": [1, 2,]} text')), F.concat(F.lit("{broken "), n),
    ]
    raw = F.lit(None).cast("string")
    for k, s in enumerate(shapes):
        raw = F.when(F.col("k") % 8 == k, s).otherwise(raw)
    found = p.select("k", X.extract_json(raw).alias("j"))
    get = lambda path, kind: F.try_variant_get("j", path, kind)
    return found.select("k", F.coalesce(get("$.n", "int"), F.lit(-1)).alias("n"), get("$.t", "string").alias("t"), get("$.b", "boolean").cast("string").alias("b"))


# ---- streams

_EVENTS = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, regexp_replace(text, '\\r\\n|\\r', chr(10), 'g') AS data FROM conversations"


@query(f"SELECT CAST(conv_id AS VARCHAR) AS stream_id, CAST(place AS INTEGER) AS place, role AS event, md5(data) AS data FROM ({_EVENTS})")
def parsed_events(spark, sf_dir):
    """Turns framed as server-sent events, cut into chunks of eleven characters, and parsed again."""
    c = table(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", events.frame(F.col("role"), F.col("text")).alias("f")))), lambda x: x["f"]), "")
    whole = c.groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(text.alias("t"))
    cut = whole.select("stream_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 11).cast("int"))).alias("seq")).select("stream_id", "seq", F.substring(F.col("t"), F.col("seq") * 11 + 1, F.lit(11)).alias("chunk"))
    return events.parse(cut).select("stream_id", "place", "event", F.md5("data").alias("data"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n, md5(string_agg(text, '' ORDER BY turn)) AS t FROM conversations GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS stream_id, CASE WHEN conv_id % 4 = 3 THEN md5('') ELSE t END AS text, 'f' || conv_id AS sources, CASE conv_id % 4 WHEN 1 THEN 'broken' WHEN 3 THEN 'empty' END AS error, CASE WHEN conv_id % 4 IN (1, 3) THEN 'false' ELSE 'true' END AS done FROM s""")
def answered_streams(spark, sf_dir):
    """Answers as events: sources, pieces, and how they ended; some break at the end, some never say anything."""
    c = table(spark, sf_dir, "conversations").withColumn("stream_id", F.col("conv_id").cast("string"))
    heard = c.filter("conv_id % 4 <> 3").select("stream_id", F.col("turn").cast("bigint").alias("seq"), F.col("text").alias("piece"))
    broken = c.filter("conv_id % 4 = 1").select("stream_id").distinct().select("stream_id", F.lit(1 << 40).alias("seq"), F.lit(None).cast("string").alias("piece"))
    named = c.select("stream_id").distinct().select("stream_id", F.concat(F.lit("f"), "stream_id").alias("file_path"), F.lit(0).alias("place"))
    out = events.answer_events(heard.unionByName(broken), named)
    of = lambda e: F.max(F.when(F.col("event") == e, F.col("data")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("place", "data")))), lambda x: x["data"]), "")
    return out.groupBy("stream_id").agg(F.md5(said).alias("text"), F.get_json_object(of("sources"), "$[0]").alias("sources"), of("error").alias("error"), of("done").alias("done"))


@query("""WITH s AS (SELECT user_id AS job, user_id * 2 AS subscriber, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT user_id, user_id * 2 + 1, max(ts) FROM events GROUP BY user_id)
    SELECT subscriber, job, event_id AS seq, e.ts < s.ts AS replayed FROM events e JOIN s ON e.user_id = s.job""")
def replayed_messages(spark, sf_dir):
    """Every user's events as a job's log, for two subscribers each: one who is there from the start, one who comes with the last."""
    e = table(spark, sf_dir, "events")
    messages = e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("message"))
    first, last = (e.groupBy(F.col("user_id").alias("job")).agg(f("ts").alias("at")).select((F.col("job") * 2 + k).alias("subscriber"), "at", "job") for k, f in enumerate((F.min, F.max)))
    return events.subscribe(messages, first.unionByName(last)).select("subscriber", "job", "seq", "replayed")


def _in_batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows of a stream dealt to n batches by hash, so that many come before their turn; the last batch has some of the first again."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("stream_id", "seq"), F.lit(n)))
    again = dealt.filter("_b = 0 and seq % 3 = 0").withColumn("_b", F.lit(n - 1))
    every = dealt.unionByName(again)
    return [every.filter(F.col("_b") == b).drop("_b") for b in range(n)]


@query(f"SELECT CAST(conv_id AS VARCHAR) AS stream_id, CAST(place AS INTEGER) AS place, role AS event, md5(data) AS data FROM ({_EVENTS})")
def streamed_events(spark, sf_dir):
    """The chunks of parsed_events as a stream of three micro-batches, out of order and partly twice, with a restart between them."""
    c = table(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", events.frame(F.col("role"), F.col("text")).alias("f")))), lambda x: x["f"]), "")
    whole = c.groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.regexp_extract_all(text, F.lit("(?s).{1,37}"), F.lit(0)).alias("pieces"))
    cut = whole.select("stream_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "piece")).select("stream_id", F.col("seq").cast("bigint").alias("seq"), "piece", (F.col("seq") == F.col("n") - 1).alias("last"))
    return keyed.replayed(_in_batches(cut, 3), keyed.parsed, "events").select("stream_id", "place", "event", F.md5("data").alias("data"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n, md5(string_agg(text, '' ORDER BY turn)) AS t FROM conversations GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS stream_id, CASE WHEN conv_id % 4 = 3 THEN md5('') ELSE t END AS text, 'f' || conv_id AS sources, CASE conv_id % 4 WHEN 1 THEN 'broken' WHEN 3 THEN 'empty' END AS error, CASE WHEN conv_id % 4 IN (1, 3) THEN 'false' ELSE 'true' END AS done, 1 AS ends FROM s""")
def streamed_answers(spark, sf_dir):
    """Answers as streams of pieces in two micro-batches: each begins with its sources and has one end, whatever becomes of it."""
    c = table(spark, sf_dir, "conversations").withColumn("stream_id", F.col("conv_id").cast("string"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint")
    heard = c.filter("conv_id % 4 <> 3").select("conv_id", "stream_id", place.alias("seq"), F.col("text").alias("piece"))
    counts = c.groupBy("conv_id", "stream_id").agg(F.count(F.lit(1)).alias("n"))
    heads = counts.select("conv_id", "stream_id", F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit('["f'), "stream_id", F.lit('"]')).alias("piece"), (F.col("conv_id") % 4 == 3).alias("last"))
    broken = counts.filter("conv_id % 4 = 1").select("conv_id", "stream_id", (F.col("n") + 1).alias("seq"), F.lit(None).cast("string").alias("piece"), F.lit(True).alias("last"))
    said = heard.join(counts, ["conv_id", "stream_id"]).select("conv_id", "stream_id", "seq", "piece", ((F.col("seq") == F.col("n")) & (F.col("conv_id") % 4 != 1)).alias("last"))
    rows = heads.unionByName(said).unionByName(broken).drop("conv_id")
    out = keyed.replayed(_in_batches(rows, 2), keyed.answered, "answers")
    of = lambda e: F.max(F.when(F.col("event") == e, F.col("data")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("place", "data")))), lambda x: x["data"]), "")
    return out.groupBy("stream_id").agg(F.md5(text).alias("text"), F.get_json_object(of("sources"), "$[0]").alias("sources"), of("error").alias("error"), of("done").alias("done"), F.count_if(F.col("event") == "done").cast("int").alias("ends"))


@query()
def streamed_runs(spark, sf_dir):
    """The requests of admitted_runs as a stream of three micro-batches, up to 200 seconds out of order; the same decisions."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_type").alias("instance"), "event_id", (F.col("user_id") % 12).cast("string").alias("url"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), ((F.col("user_id") % 7 + 1) * 9000.0).alias("seconds"), F.col("ts").cast("timestamp").alias("ts"),
    )
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    third = F.floor((F.col("at") + F.pmod(F.xxhash64("event_id"), F.lit(200)) - first) * 3 / (last - first + 1))
    dealt = [rows.filter(F.least(third, F.lit(2)) == b) for b in range(3)]
    # a row far ahead moves the watermark past all others, and the batch after it lets their timers go
    ahead = lambda days: rows.limit(1).select(F.lit("").alias("instance"), F.lit(-days).cast("bigint").alias("event_id"), "url", F.lit(last + days * 86_400.0).alias("at"), F.lit(0.0).alias("seconds"), F.timestamp_seconds(F.lit(last + days * 86_400.0)).alias("ts"))
    return keyed.replayed([*dealt, ahead(1), ahead(2)], limits.admit_runs, "runs").filter("event_id >= 0")


@query("""WITH s AS (SELECT user_id AS subscriber, user_id % 20 AS job, min(ts) AS since FROM events GROUP BY user_id)
    SELECT subscriber, s.job, count(*) FILTER (e.ts < since) AS n_replayed, count(*) FILTER (e.ts >= since) AS n_followed, arg_min(event_id, {'a': ts, 'b': event_id}) FILTER (e.ts >= since) AS first_followed FROM s JOIN (SELECT user_id % 20 AS job, event_id, ts FROM events) e ON e.job = s.job GROUP BY subscriber, s.job""")
def subscriber_offsets(spark, sf_dir):
    """Every user subscribes to a job when first seen: how much of its log is replayed, and where what is new begins."""
    e = table(spark, sf_dir, "events")
    messages = e.select((F.col("user_id") % 20).alias("job"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    who = e.groupBy(F.col("user_id").alias("subscriber")).agg(F.min("ts").alias("at")).withColumn("job", F.col("subscriber") % 20)
    return events.offsets(messages, who)


# ---- stores

_SHOTS = "s AS (SELECT 'i' || o_orderkey AS repo_id, 'u' || o_custkey AS repo_url, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'h' || o_orderkey % 4 END AS head_sha, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN NULL ELSE false END AS truncated, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '/c' END AS repo_path, o_orderdate FROM orders)"


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("i"), k.cast("string")).alias("repo_id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("repo_url"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("h"), (k % 4).cast("string"))).alias("head_sha"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, None).otherwise(False).alias("truncated"), F.when(k % 7 == 0, "").otherwise("/c").alias("repo_path"), F.col("o_orderdate").cast("timestamp").alias("modified"),
    )


@query(f"WITH {_SHOTS} SELECT repo_id FROM s WHERE head_sha <> '' AND head_sha = 'h' || CAST(substr(repo_url, 2) AS BIGINT) % 4 AND truncated IS DISTINCT FROM true AND repo_path <> ''")
def current_snapshots(spark, sf_dir):
    shots = _shots(spark, sf_dir)
    heads = shots.select("repo_url").distinct().select("repo_url", F.concat(F.lit("h"), (F.substring("repo_url", 2, 20).cast("bigint") % 4).cast("string")).alias("head_sha"))
    return snapshots.current(shots, heads).select("repo_id")


@query(f"WITH {_SHOTS} SELECT repo_id, truncated IS NOT NULL AND truncated AS truncated, false AS cached, '[]' AS files, repo_url FROM s WHERE CAST(substr(repo_id, 2) AS BIGINT) % 3 <> 0")
def public_results(spark, sf_dir):
    """Registered snapshots less the forgotten ones, as the public sees them."""
    shots = _shots(spark, sf_dir)
    left = snapshots.forget(shots, shots.filter(F.substring("repo_id", 2, 20).cast("bigint") % 3 == 0))
    return snapshots.public(left).select("repo_id", "truncated", "cached", "files", "repo_url")


@query(f"""WITH {_SHOTS}, b AS (SELECT repo_id, repo_url, o_orderdate AS modified, o_orderdate >= TIMESTAMP '1997-06-01' AS fresh FROM s), r AS (SELECT *, row_number() OVER (ORDER BY modified DESC, repo_id DESC) AS rn FROM b),
    k AS (SELECT * FROM r WHERE fresh OR (rn <= 200 AND modified > TIMESTAMP '1997-01-01')) SELECT repo_url, arg_max(repo_id, {{'m': modified, 'r': repo_id}}) AS repo_id FROM k GROUP BY repo_url""")
def registered_snapshots(spark, sf_dir):
    """A registry after new snapshots came and old ones expired, by address."""
    shots = _shots(spark, sf_dir).select("repo_id", "repo_url", "modified")
    fresh = F.col("modified") >= F.lit(datetime.datetime(1997, 6, 1))
    again = shots.filter(fresh).withColumn("modified", F.col("modified") - F.expr("interval 900 days"))
    kept = snapshots.register(shots.filter(~fresh).unionByName(again), shots.filter(fresh), datetime.datetime(1997, 1, 2), 24, 200)
    return snapshots.index(kept)


# ---- tables for display

_LANGS = ["Python", "", "go", "PYTHON", "rust", "c", "java", "lua", None]
_LANG_SQL = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in _LANGS) + "]"


@query(f"""WITH n AS (SELECT doc_id % 3 AS repo, doc_id, CASE WHEN coalesce({_LANG_SQL}[CAST(doc_id * doc_id % 9 AS BIGINT) + 1], '') = '' THEN 'other' ELSE lower({_LANG_SQL}[CAST(doc_id * doc_id % 9 AS BIGINT) + 1]) END AS language FROM documents),
    c AS (SELECT repo, language, count(*) AS files, min(doc_id) AS first FROM n GROUP BY ALL) SELECT repo, language, files, CAST(row_number() OVER (PARTITION BY repo ORDER BY files DESC, first, language) AS INTEGER) AS place FROM c QUALIFY place <= 5""")
def language_legend(spark, sf_dir):
    d = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in _LANGS]), (d * d % 9 + 1).cast("int"))
    return summaries.legend(table(spark, sf_dir, "documents").select((d % 3).alias("repo"), name.alias("language"), d.alias("ord")), ["repo"])


_SEV = ["high", "HIGH", "Low", "", "critical"]
_ISSUES = f"i AS (SELECT doc_id, source AS repo, {pick_sql(_SEV, 'doc_id')} AS severity, CASE WHEN toxic = 1 THEN 'dismissed' WHEN doc_id % 2 = 0 THEN 'pending' END AS triage FROM labels JOIN documents USING (doc_id))"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo")), "doc_id")
    return both.select("doc_id", "repo", pick(_SEV, d).alias("severity"), F.when(F.col("toxic") == 1, "dismissed").when(d % 2 == 0, "pending").alias("triage"))


@query(f"WITH {_ISSUES} SELECT repo, CASE WHEN severity = '' THEN 'UNKNOWN' ELSE upper(severity) END AS severity, count(*) AS n FROM i WHERE triage IS DISTINCT FROM 'dismissed' GROUP BY ALL")
def live_severities(spark, sf_dir):
    return summaries.live_severities(_issues(spark, sf_dir), ["repo"])


@query(f"WITH {_ISSUES} SELECT doc_id, upper(severity) AS severity FROM i WHERE upper(severity) = 'HIGH' UNION ALL SELECT -1, severity FROM (SELECT DISTINCT upper(severity) AS severity FROM i)")
def filtered_severities(spark, sf_dir):
    f = _issues(spark, sf_dir)
    return summaries.of_severity(f, "high").select("doc_id", F.upper("severity").alias("severity")).unionByName(summaries.severities(summaries.of_severity(f)).select(F.lit(-1).cast("bigint").alias("doc_id"), "severity"))


@query("""WITH v AS (SELECT o_custkey AS k, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS spot, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT k, max(CASE WHEN spot = n // 2 THEN x END) AS median, max(CASE WHEN spot = CASE WHEN n > 48 THEN CAST(ceil(n * 0.98) AS BIGINT) - 1 ELSE n - 1 END THEN x END) AS reach FROM v GROUP BY k
    UNION ALL SELECT -1 - l_linenumber, max(CASE WHEN spot = n // 2 THEN x END), max(CASE WHEN spot = CASE WHEN n > 48 THEN CAST(ceil(n * 0.98) AS BIGINT) - 1 ELSE n - 1 END THEN x END)
        FROM (SELECT l_linenumber, l_extendedprice AS x, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) - 1 AS spot, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem) GROUP BY l_linenumber""")
def framing_values(spark, sf_dir):
    """The median and the framing distance of small groups and of large ones."""
    small = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("k"), F.col("o_totalprice").alias("x"))
    large = table(spark, sf_dir, "lineitem").select((-1 - F.col("l_linenumber")).cast("bigint").alias("k"), F.col("l_extendedprice").alias("x"))
    both = small.unionByName(large)
    return summaries.median(both, ["k"], "x").join(summaries.reach(both, ["k"], "x"), "k")


@query("""WITH d AS (SELECT p_partkey % 3 AS repo, 'n' || p_partkey % 100 AS name, p_partkey % 7 AS file_ord, p_partkey AS ord, 'v' || p_partkey AS version FROM part) SELECT repo, name, arg_min(version, {'f': file_ord, 'o': ord}) AS version FROM d GROUP BY ALL""")
def dependency_view(spark, sf_dir):
    p = F.col("p_partkey")
    deps = table(spark, sf_dir, "part").select((p % 3).alias("repo"), F.concat(F.lit("n"), (p % 100).cast("string")).alias("name"), (p % 7).alias("file_ord"), p.alias("ord"), F.concat(F.lit("v"), p.cast("string")).alias("version"))
    return summaries.dependency_view(deps.unionByName(deps.limit(1).withColumn("name", F.lit(""))), ["repo"])


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN repeat('row' || chr(10), 5000) WHEN doc_id % 50 = 1 THEN repeat('x', 130000) ELSE coalesce(text, '') END AS t FROM documents), c AS (SELECT doc_id, t, substr(t, 1, 120000) AS cut FROM d), n AS (SELECT *, len(string_split(cut, chr(10))) AS lines FROM c)
    SELECT doc_id, greatest(0, lines - 4000) AS hidden_lines, CASE WHEN length(t) > 120000 THEN '120,000' WHEN lines > 4000 THEN '4,000 lines' END AS truncated_at,
        md5(CASE WHEN lines > 4000 THEN array_to_string(string_split(cut, chr(10))[1:4000], chr(10)) || chr(10) || '… ' || format('{:,}', lines - 4000) || ' more lines not shown' ELSE cut END) AS content FROM n""")
def file_previews(spark, sf_dir):
    d = F.col("doc_id")
    text = F.when(d % 50 == 0, F.repeat(F.lit("row\n"), 5000)).when(d % 50 == 1, F.repeat(F.lit("x"), 130_000)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", summaries.preview(text).alias("p")).select("doc_id", F.col("p.hidden_lines").cast("bigint").alias("hidden_lines"), "p.truncated_at", F.md5("p.content").alias("content"))


@query("""SELECT l_returnflag AS step, l_linestatus AS model, count(*) AS calls, CAST(sum(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END) AS BIGINT) AS prompt_tokens, CAST(sum(l_partkey) AS BIGINT) AS completion_tokens, CAST(sum(l_partkey + l_linenumber) AS BIGINT) AS total_tokens, count_if(l_linenumber = 2) AS cut_short FROM lineitem GROUP BY ALL""")
def usage_totals(spark, sf_dir):
    n = F.col("l_linenumber")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("step"), F.col("l_linestatus").alias("model"), F.when(n != 1, n).alias("prompt_tokens"), F.col("l_partkey").alias("completion_tokens"), (F.col("l_partkey") + n).alias("total_tokens"), F.when(n == 2, "length").otherwise("stop").alias("finish_reason"))
    return summaries.usage(calls, [])


@query("SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'm' || p_partkey ELSE p_name END AS name, p_size AS context_length FROM part")
def listed_models(spark, sf_dir):
    p = F.col("p_partkey")
    return summaries.models(table(spark, sf_dir, "part").select(F.concat(F.lit("m"), p.cast("string")).alias("id"), F.when(p % 2 != 0, F.col("p_name")).alias("name"), F.col("p_size").alias("context_length")))


@query("""SELECT l_orderkey AS search, CAST(r AS INTEGER) AS place, substr(repeat('t' || l_partkey, 60), 1, 200) AS title, 'u' || l_suppkey AS url, round(l_partkey / 16.0, 3) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3""")
def top_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("search"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.repeat(F.concat(F.lit("t"), F.col("l_partkey").cast("string")), 60).alias("title"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("url"), F.lit(None).cast("string").alias("snippet"), (F.col("l_partkey") / 16.0).cast("double").alias("score"))
    return summaries.top_sources(rows, ["search"]).select("search", "place", "title", "url", "score")


@query("""WITH s AS (SELECT o_custkey AS repo, count(*) AS total_files, CAST(sum(o_orderkey % 3) AS BIGINT) AS c, CAST(sum(o_orderkey % 5) AS BIGINT) AS h FROM orders GROUP BY 1) SELECT repo, total_files AS files, CAST(0 AS BIGINT) AS edges, c + h AS findings, c + h AS severe, CAST(0 AS BIGINT) AS hotspots, CAST(0 AS BIGINT) AS dependencies FROM s""")
def run_overview(spark, sf_dir):
    k = F.col("o_orderkey")
    stats = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.count(F.lit(1)).alias("total_files"), F.sum(k % 3).alias("critical_vulnerabilities"), F.sum(k % 5).alias("high_vulnerabilities"), F.sum(k % 3 + k % 5).alias("total_vulnerabilities"))
    return summaries.overview(stats, ["repo"])


@query("""WITH f AS (SELECT doc_id % 4 AS repo, count(*) AS total_files, count_if(doc_id % 5 <> 0) AS source_files, CAST(sum(CASE WHEN doc_id % 5 <> 0 THEN n_chars ELSE 0 END) AS BIGINT) AS total_loc FROM documents GROUP BY 1),
    h AS (SELECT doc_id % 4 AS repo, count(*) AS hotspot_count FROM documents WHERE n_chars % 9 = 0 GROUP BY 1), l AS (SELECT doc_id % 4 AS repo, count(DISTINCT doc_id // 3) AS graph_links FROM documents GROUP BY 1),
    d AS (SELECT doc_id % 4 AS repo, count(DISTINCT doc_id % 6) AS dependency_manifests, count(*) AS dependencies FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), v AS (SELECT doc_id % 4 AS repo, count_if(doc_id % 3 = 0) AS vulnerable_dependencies, count_if(doc_id % 3 = 1) AS outdated_dependencies, count_if(doc_id % 3 <> 2) AS research_queries FROM documents GROUP BY 1)
    SELECT repo, total_files, source_files, total_loc, coalesce(hotspot_count, 0) AS hotspot_count, coalesce(graph_links, 0) AS graph_links, coalesce(dependency_manifests, 0) AS dependency_manifests, coalesce(dependencies, 0) AS dependencies, coalesce(vulnerable_dependencies, 0) AS vulnerable_dependencies,
        coalesce(outdated_dependencies, 0) AS outdated_dependencies, coalesce(research_queries, 0) AS research_queries, 'sha' || repo AS head_sha, CAST(1.23 AS DOUBLE) AS elapsed_seconds FROM f LEFT JOIN h USING (repo) LEFT JOIN l USING (repo) LEFT JOIN d USING (repo) LEFT JOIN v USING (repo)""")
def full_statistics(spark, sf_dir):
    """The rest of a run's statistics: hotspots, links, manifests, searches, commit and time."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("repo", d % 4)
    files = docs.select("repo", (d % 5 != 0).alias("is_source"), F.col("n_chars").alias("loc"))
    none = files.limit(0).select("repo", F.lit("").alias("severity"), F.lit("").alias("source"), F.lit("").alias("triage"), F.lit("").alias("reference"))
    links = docs.select("repo", F.lit("s").alias("source"), F.floor(d / 3).cast("string").alias("target"))
    deps = docs.filter("doc_id % 2 = 0").select("repo", (d % 6).cast("string").alias("file_path"), d.cast("string").alias("name"))
    checked = docs.select("repo", F.when(d % 3 == 0, "vulnerable").when(d % 3 == 1, "outdated").otherwise("unverified").alias("status"), F.when(d % 3 != 2, "q").alias("query"), F.lit(None).cast("string").alias("reason"))
    runs = docs.select("repo").distinct().select("repo", F.concat(F.lit("sha"), F.col("repo").cast("string")).alias("head_sha"), F.lit(1.2345).alias("elapsed"))
    out = digest.full_stats(files, none, ["repo"], docs.filter("n_chars % 9 = 0").select("repo"), links, deps, checked, runs)
    return out.select("repo", "total_files", "source_files", "total_loc", "hotspot_count", "graph_links", "dependency_manifests", "dependencies", "vulnerable_dependencies", "outdated_dependencies", "research_queries", "head_sha", "elapsed_seconds")


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 40 ELSE 0 END + least(20, 8 * (doc_id % 4)) + least(15, (doc_id % 200) / 8) + least(10, doc_id % 13) + CASE WHEN doc_id % 6 = 0 THEN 5 ELSE 0 END AS context_score FROM documents WHERE doc_id % 10 <> 9) SELECT doc_id, CAST(context_score AS DOUBLE) AS context_score FROM m WHERE context_score > 0""")
def model_context(spark, sf_dir):
    """The files most worth showing a model: entry points, findings, complexity, links, manifests; no documents."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), d.cast("string")).alias("file_path"), (d % 9 == 0).alias("is_entry"), (d % 4).alias("finding_count"), (d % 200).alias("complexity"), (d % 13).alias("fan_in"), (d % 6 == 0).alias("is_manifest"), (d % 10 == 9).alias("is_document"))
    return search.model_context_score(rows).select("doc_id", F.col("context_score").cast("double").alias("context_score"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem) SELECT 's' || s AS path, string_agg('p' || t, ',' ORDER BY 'p' || t) AS dependencies FROM e GROUP BY s")
def file_dependencies(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    return graph.dependents(links).filter(F.startswith("node", F.lit("s"))).select(F.col("node").alias("path"), F.array_join("dependencies", ",").alias("dependencies"))


@query("SELECT 'p' || doc_id AS file_path, md5(substr(text, 1, 8000)) AS content, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines, length(text) > 8000 AS truncated FROM documents WHERE doc_id = 17")
def read_one_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    return search.read_file(docs, "p17").select("file_path", F.md5("content").alias("content"), "lines", "truncated")


@query("""WITH o AS (SELECT o_orderkey AS k, 'r' || o_custkey % 60 AS repo_id, 'u' || o_custkey % 20 AS repo_url, o_totalprice AS price, o_custkey % 60 AS r FROM orders),
    kept AS (SELECT *, CASE WHEN r % 3 = 0 OR r % 5 = 0 THEN 2 ELSE 1 END AS version FROM o WHERE r % 7 <> 0 AND (r % 3 = 0 OR r % 5 = 0 OR k % 2 = 0))
    SELECT repo_id, max(repo_url) AS repo_url, version, count(*) AS n, sum(k) AS keys, round(sum(CASE WHEN version = 2 THEN -price ELSE price END), 2) AS price FROM kept GROUP BY repo_id, version""")
def committed_snapshots(spark, sf_dir):
    """Orders as snapshots of sixty repositories: saved in part, replaced for some of them, some forgotten; what the last version holds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("r"), (F.col("o_custkey") % 60).cast("string")).alias("repo_id"), F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")).alias("repo_url"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_custkey") % 60).alias("r"))
    shared = commits.Registry(spark, held.scratch(spark, "registry"), "k bigint, price double, version int")
    at = datetime.datetime(2024, 1, 1)
    shared.save(o.filter("k % 2 = 0").withColumn("version", F.lit(1)), at, most=100)
    shared.save(o.filter("r % 3 = 0 or r % 5 = 0").withColumn("version", F.lit(2)).withColumn("price", -F.col("price")), at + datetime.timedelta(hours=1), most=100)
    shared.forget(o.filter("r % 7 = 0").select("repo_id"))
    return shared.read().groupBy("repo_id", "version").agg(F.max("repo_url").alias("repo_url"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"), F.round(F.sum("price"), 2).alias("price"))
