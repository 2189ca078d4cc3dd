"""The ten operators against plain versions, SQL, round trips and held-out labels; and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import decontam, licences, line_dedup, media, mixing, quality, sharding, shared, simhash, token_store, warc
from corpusmill.llm.queries import ORACLE_SQL, QUERIES, table, tokenizer_path
from tests.conftest import oracle, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `key` string, `rank` int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated and null ids, clashing extra columns."""
    rows = [
        (1, "One two three.\nShared line here.", "en", "a", 1), (1, "One two three.\nShared line here.", "en", "a", 1), (1, "another text, same id", "en", "b", 1),
        (2, None, None, None, None), (3, "", "en", "a", 0), (None, "text without id", "en", "b", 1), (None, None, "en", "c", 1), (4, " \n\t\n ", "en", "c", 1),
        (5, "word " * 50_000, "en", "a", 1), (6, "naïve café’s 'quoted' it's 日本語   ﬁ 12½\r\n\r\n  end ", "fr", "d", 1), (7, "Shared line here.", "en", "d", 1), (8, "Released under the MIT License.\nShared line here.", "en", "e", 1), (9, "One two three.\nShared line here.", "en", "f", 1),
    ]
    return spark.createDataFrame([(*r, 5, "k", 9) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, medium, name):
    same(QUERIES[name](spark, medium), oracle(ORACLE_SQL[name], medium))


# 1


def test_lines_near_and_far_from_the_threshold(spark):
    rows = [(i, f"rare {i}\nseen by {n}" , f"s{i % n}") for n in (1, 4, 5, 6, 40) for i in range(n * 3)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5).toPandas()
    assert {int(t.split()[-1]) for t in out.text if "seen by" in t} == {1, 4}
    assert sorted(out.n_dropped) == [0] * 15 + [1] * 153  # 3 + 12 documents keep their line, 15 + 18 + 120 lose it


def test_lines_odd(odd, empty):
    out = line_dedup.dedup_lines(odd, 4).toPandas()
    assert len(out) == odd.count() and line_dedup.dedup_lines(empty, 4).count() == 0
    by = out.dropna(subset=["doc_id"]).groupby("doc_id")
    assert by.get_group(7).text.tolist() == [""] and by.get_group(8).text.tolist() == ["Released under the MIT License."]
    assert sorted(by.get_group(1).text) == ["One two three.", "One two three.", "another text, same id"] and by.get_group(2).text.isna().all()


# 2


def test_quality_on_held_out_labels(spark, medium):
    out = QUERIES["op2_quality_classifier"](spark, medium).toPandas().set_index("doc_id")
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index]) and out.score.between(0, 1).all()
    labels = table(spark, medium, "labels").toPandas().set_index("doc_id").quality
    held = out[out.held_out].join(labels, how="inner")
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_odd(spark, odd, empty, medium):
    docs = table(spark, medium, "documents")
    model = quality.fit(docs, table(spark, medium, "labels"))
    out = quality.score(odd, model).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all() and quality.score(empty, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    nothing = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert set(quality.score(odd, nothing).toPandas().score) == {0.5}
    long = ("".join(r.text for r in docs.limit(3).collect()) * 200).encode()
    assert quality.Model.score(model, long) >= 0 and len(model.features(b"x")) == 6


# 3


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        spare = total - sum(capped.values())
        new = {s: spare * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if new[s] > 2 * sizes[s]]
        if not over:
            return capped | new
        capped |= {s: 2.0 * sizes[s] for s in over}


def plain_best(sizes, target):
    """The most words up to the rounded target: every document as often as fits, then the best subset of single ones."""
    base = min(2, int(target // sum(sizes))) if sum(sizes) else 0
    budget, reach = round(target - base * sum(sizes)) if base < 2 else 0, 1
    for n in sizes:
        reach |= reach << n
    return base * sum(sizes) + (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_mix(spark, medium):
    docs = table(spark, medium, "documents").toPandas()
    out = QUERIES["op3_source_mixing"](spark, medium).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert len(out) == len(docs) and (out["size"] == [len(re.findall(shared.WORD, t)) for t in out.text]).all()
    sizes = out.groupby("source")["size"].sum().to_dict()
    want = plain_targets(sizes)
    for s, g in out.groupby("source"):
        assert (g.source_size == sizes[s]).all() and np.allclose(g.target, want[s])
        assert g.taken.sum() == plain_best(g["size"].tolist(), want[s]) and (g.taken <= 2 * g["size"]).all() and (g.taken % g["size"].clip(lower=1) == 0).all()
    again = QUERIES["op3_source_mixing"](spark, medium).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == out.sort_values("doc_id").taken.tolist()


def test_mix_odd(odd, empty):
    out = mixing.mix(odd).toPandas()
    assert len(out) == odd.count() and mixing.mix(empty).count() == 0 and (out.taken <= 2 * out["size"]).all()
    rows = mixing.mixed_documents(odd)
    assert rows.columns == odd.columns and rows.count() == out.repeats.sum()
    total = rows.select(F.sum(F.regexp_count("text", F.lit(shared.WORD)))).first()[0]
    assert total == out.taken.sum()


def test_fit_budget_is_exact_where_a_subset_is():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = sorted(set(rng.integers(1, 60, 8).tolist()))
        counts = rng.integers(1, 4, len(sizes)).tolist()
        budget = int(rng.integers(0, sum(s * c for s, c in zip(sizes, counts)) + 1))
        taken = mixing.fit_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and sum(s * t for s, t in zip(sizes, taken)) <= budget
    big = mixing.fit_budget([3, 1000, 99_991], [10**6, 10**6, 10**6], 40_000_000_007)
    assert 0 <= 40_000_000_007 - sum(s * t for s, t in zip([3, 1000, 99_991], big)) <= 3


# 4


def test_licences(spark, medium):
    docs = table(spark, medium, "documents").toPandas().set_index("doc_id").text
    out = QUERIES["op4_licence_scan"](spark, medium).toPandas().set_index("doc_id")
    lines = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "Proprietary": "All rights reserved."}
    for doc, text in docs.items():
        assert out.families[doc] == ",".join(sorted(f for f, ln in lines.items() if ln in text.split("\n"))), (doc, text[:200])


def test_licence_families_and_strangers(spark, odd, empty):
    lines = [(t, f) for f, ts in licences.TEMPLATES.items() for t in ts] + [(t, "") for t in licences.OTHERS]
    found = {r.paragraph: r for r in licences.classify(spark.createDataFrame(lines, "paragraph string, f string")).collect()}
    wrong = [(t, f, found.get(t)) for t, f in lines if (found[t].family if t in found and found[t].confirmed else "") != f]
    assert not wrong
    out = licences.scan(odd).toPandas()
    assert len(out) == odd.count() and licences.scan(empty).count() == 0 and sorted(out.families.unique()) == ["", "MIT"]


def test_licence_scan_is_native(spark, small):
    plan = QUERIES["op4_licence_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5


def test_media_round_trip(spark, small):
    docs = table(spark, small, "documents").toPandas().set_index("doc_id").text
    out = QUERIES["op5_media_columns"](spark, small).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index)
    for doc, text in docs.items():
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out.loc[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_media_odd_ranges_and_retries(spark, odd, empty, tmp_path):
    assert media.write_archives(odd.repartition(3), f"file://{tmp_path}/a", archive_bytes=500) == odd.count()
    rows = media.read_archives(spark, f"file://{tmp_path}/a", range_bytes=200)
    assert sorted(r.n_bytes for r in media.describe(rows).collect()) == sorted(len((r.text or "").encode()) for r in odd.collect())
    assert rows.select("archive", "member_offset").distinct().count() == odd.count()
    assert media.media_columns(empty).count() == 0
    reader = media.ArchiveReader(f"{tmp_path}/a", 1 << 20, 2)
    part = reader.partitions()[0]
    good = [b.to_pylist() for b in reader.read(part)]
    store, _ = shared.open_store(f"{tmp_path}/a")

    class Failing:
        """The first handle gives damaged bytes: members must be read again by offset, one by one."""

        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            return bytes(n)

    import zipfile

    with store.open_input_file(part.path) as f:
        infos = zipfile.ZipFile(f).infolist()
        assert [reader._member(store, part.path, Failing(f), i) for i in infos] == [r["media"] for b in good for r in b]
    path = part.path
    with open(path, "r+b") as f:  # lasting damage is an error, not a missing row
        f.seek(infos[0].header_offset + 60)
        f.write(b"\xff\x00\xff\x00\xff")
    with pytest.raises(OSError, match="checksum"):
        list(reader.read(part))


# 6


def test_tokens_equal_the_library(spark, small, odd, empty):
    from tokenizers import Tokenizer

    library, marked = Tokenizer.from_file(tokenizer_path()), odd.limit(1).withColumn("text", F.lit("a <|endoftext|> b<|endoftext|>"))
    for docs in (table(spark, small, "documents"), odd.unionByName(marked)):
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
        rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.th))  # nulls first; rows of one id by a hash of the text
        want, at = [], 0
        for r in rows:
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        folder = shared.new_folder(spark, "tokens")
        assert sorted(map(tuple, token_store.token_table(docs, tokenizer_path(), folder).collect()), key=lambda r: r[1]) == want
        assert sorted(map(tuple, token_store.read_shards(spark, folder, token_store.manifest(folder)).collect()), key=lambda r: r[1]) == want
    assert token_store.token_table(empty, tokenizer_path()).count() == 0


def test_encoder_on_hard_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), token_store.Encoder(tokenizer_path())
    rng, parts = np.random.default_rng(5), ["'", "'s", "'re", "'ll", "'T", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "\x1c", "a", "é", "B2", "²", "½", "3", "!", "_", "-", "ß", "ÿ", "Ȿ", "日", "<|endoftext|>", "\x00", "😀", "e", "ve", "l"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)] + ["", None, " ", "'", "''s", "a's't", "\n's"]
    got = own.column(pa.array(texts))
    assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_perfect_hash():
    keys = np.random.default_rng(2).choice(1 << 62, 20_000, replace=False) - (1 << 61)
    h, _ = token_store.PerfectHash.unpack(token_store.PerfectHash.build(keys).pack())
    assert sorted(h.numbers(keys).tolist()) == list(range(len(keys))) and len(h.numbers(np.array([], np.int64))) == 0
    with pytest.raises(ValueError, match="distinct"):
        token_store.PerfectHash.build(np.array([1, 1]))


def test_strangers_are_not_found(tmp_path):
    (tmp_path / "s.mph").write_bytes(token_store.pack_index([None, 3, 3, 9], [1, 2, 3, 4], 2))
    store, path = shared.open_store(str(tmp_path))
    shard = token_store.Shard(store, f"{path}/s")
    assert shard.find([3, 9]) == [(1, 2), (3, 1)] and shard.find(list(range(100, 1100))).count(None) == 1000


# 7


def test_warc(spark, small, tmp_path):
    pages = table(spark, small, "pages")
    records = warc.responses(pages).cache()
    assert warc.write_warc(records, f"file://{tmp_path}/w") == pages.count()
    assert {r.record for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()} == {r.record for r in records.collect()}
    by = {r.page_id: r for r in pages.collect()}
    for r in warc.derivatives(records).collect():
        for kind, block in (("conversion", r.conversion), ("metadata", r.metadata)):
            head, body = warc.parse(block)
            head = dict(head)
            assert head["WARC-Type"] == kind and head["WARC-Refers-To"] == r.response_id and head["WARC-Target-URI"] == by[r.page_id].url
            assert head["WARC-Source-Payload-Digest"] == warc.digest(by[r.page_id].html.encode()) and head["WARC-Block-Digest"] == warc.digest(body)
        assert dict(warc.parse(r.metadata)[0])["WARC-Concurrent-To"] == r.conversion_id
        assert "track(0)" not in r.text and "<" not in re.sub(r"&lt;|<(?![a-z/!])", "", r.text)


def test_warc_text_and_odd_pages(spark):
    assert warc.plain_text("<p>A &amp; b</p><script>x</script><!-- c --><ul><li>one<li>two</ul>") == "A & b\none\ntwo"
    assert warc.outlinks('<a class=x href="/a?b=1&amp;c">t</a><img src=i.png>') == ["a@/href /a?b=1&c", "img@/src i.png"]
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "http://a/\r\nX: y", "<p>t</p>", "x"), (1, "u", "", "x"), (2, "u", "<b>" * 50_000 + "é", "x")], "page_id long, url string, html string, record string")
    out = warc.derivatives(warc.responses(odd)).collect()
    assert len(out) == 4 and len({r.response_id for r in out}) == 4 and warc.derivatives(warc.responses(odd.limit(0))).count() == 0


# 8


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    values = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3).tolist():
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash(spark, medium):
    docs = table(spark, medium, "documents").toPandas()
    out = QUERIES["op8_simhash_near_dedup"](spark, medium).toPandas().set_index("doc_id").loc[docs.doc_id]
    prints = [plain_fingerprint(t) for t in docs.text]
    assert out.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert out.component_id.tolist() == plain_components(docs.doc_id.tolist(), prints)


def test_links_of_planted_fingerprints(spark):
    """Chains and clouds at 0 to 5 bits, across the halves and the sign bit, against all pairs."""
    rng, values = np.random.default_rng(9), []
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(0, 2))
        for d in (0, 1, 2, 3, 4, 5):
            values.append(x ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    values += [0, 1, 1 << 63, 7, (1 << 64) - 1, (1 << 63) | (1 << 31) | 1]
    distinct = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in distinct]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    assert all((int(r.a) ^ int(r.b)) & ((1 << 64) - 1) and bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 3 for r in found)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert [roots.get(v, v) for v in signed] == plain_components(signed, distinct)


def test_simhash_odd(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], plain_components([r.doc_id for r in rows], prints)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(odd).collect()) == want
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({(f, c) if c is None else c for _, f, c in want} | {x for x in [("t", r.text) for r in rows if r.text == "another text, same id"]})


# 9


def plain_shards(sizes, shards=8):
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


def test_shards(spark, medium):
    docs = table(spark, medium, "documents").toPandas().set_index("doc_id").text
    out = QUERIES["op9_sharding"](spark, medium).toPandas()
    assert sorted(out.doc_id) == sorted(docs.index) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    assert (out["size"] == [len(docs[d].encode()) + 1 for d in out.doc_id]).all() and (out.text_crc32 == [zlib.crc32(docs[d].encode()) for d in out.doc_id]).all()
    assert out.groupby(out.doc_id.map(docs)).shard.nunique().max() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    groups = Counter()
    for t in docs:
        groups[t] += len(t.encode()) + 1
    assert sorted(out.groupby("shard")["size"].sum()) == sorted(plain_shards(groups.values()))


def test_schedule_is_the_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(200):
        hist = sorted(((int(s), int(c)) for s, c in zip(rng.choice(50, 6, replace=False) + 1, rng.integers(1, 60, 6))), reverse=True)
        loads = [0] * 5
        for size, given in sharding.schedule(iter(hist), 5):
            loads = [a + size * g for a, g in zip(loads, given)]
        assert loads == plain_shards([s for s, c in hist for _ in range(c)], 5)


def test_shards_odd(odd, empty, spark):
    out = sharding.assign(odd, 3).toPandas()
    assert len(out) == odd.count() and sharding.assign(empty, 3).count() == 0
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    hot = spark.range(5000).select(F.lit(1).alias("g"), F.col("id"), shared.order_hash(F.col("id")).alias("h"))
    ranks = shared.ranked(hot, ["g"], "h", ["id"], least=100).orderBy("h").toPandas()
    assert ranks["rank"].tolist() == list(range(5000))


# 10


def plain_hits(text, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(10, len(w))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(doc) - k + 1):
            if k and tuple(doc[i : i + k]) in want:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_odd(spark, odd, empty, block):
    items = [(1, "ONE two"), (2, "word " * 12), (3, "café"), (None, "shared line here"), (5, None), (6, "..."), (7, "three shared line here"), (2, "same id"), (12, "one")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, row string")
    rows = odd.select("doc_id", "text").collect()
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])
    got = decontam.scan(odd, benchmark, block_bytes=block).select("doc_id", "n_words", hit.alias("h"), "items").collect()
    known = [i for i in items if i[1] is not None]
    want = Counter((r.doc_id, *plain_hits(r.text, known)[:4]) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.h, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in got) == want
    clean = decontam.drop_contaminated(odd, benchmark, block_bytes=block)
    assert clean.columns == odd.columns and clean.count() == sum(n for w, n in want.items() if not w[2])
    assert decontam.scan(empty, benchmark).count() == 0 and decontam.contamination(odd, benchmark.limit(0)).filter("contaminated").count() == 0


def test_mix_draws_rare_lengths_alike():
    """2,000 documents of lengths of their own, half of the words: as many from each quarter, and the budget met."""
    sizes = np.unique(np.random.default_rng(0).integers(20, 4000, 3200))[:2000].tolist()
    for start in (0.0, 0.4, 0.999):
        taken = mixing.fit_budget(sizes, [1] * len(sizes), sum(sizes) // 2, start)
        assert sum(s * k for s, k in zip(sizes, taken)) == sum(sizes) // 2 and max(taken) == 1
        quarter = [np.mean(taken[len(sizes) * q // 4 : len(sizes) * (q + 1) // 4]) for q in range(4)]
        assert max(quarter) - min(quarter) < 0.06 and abs(sum(s * k for s, k in zip(sizes, taken)) / sum(taken) / np.mean(sizes) - 1) < 0.03


def test_fits_where_lengths_do_not_meet_the_budget():
    assert mixing.fit_budget([10, 20], [5, 5], 55) == [5, 0] or sum(s * k for s, k in zip([10, 20], mixing.fit_budget([10, 20], [5, 5], 55))) == 50
    assert mixing.fit_budget([0, 7], [3, 0], 5) == [0, 0] and mixing.fit_budget([], [], 5) == []
    taken = mixing.fit_budget([1_000_000], [10], 5_500_000)
    assert taken == [5]


def test_places_in_order(spark):
    rows = [(None if i == 7 else f"s{i:02d}",) for i in range(30)]
    out = shared.numbered(spark.createDataFrame(rows, "source string").repartition(4), [F.col("source").isNull(), F.col("source")]).collect()
    assert [r.source for r in sorted(out, key=lambda r: r.place)] == sorted(r[0] for r in rows if r[0]) + [None]
    assert shared.numbered(spark.createDataFrame([], "source string"), [F.col("source")]).count() == 0


def test_benchmark_in_blocks_is_compact(spark):
    """Every item of a benchmark of 300,000 words is found in documents that quote it, through blocks of a tenth of it."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(2000)])
    items = [(f"i{k}", " ".join(words[rng.integers(0, 2000, 150)])) for k in range(2000)]
    docs = [(k, "before " + " ".join(items[k][1].split()[20:32]) + " after") for k in range(0, 2000, 7)] + [(9999, " ".join(words[:9]))]
    out = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=200_000).collect()
    assert {r.doc_id: [(x.a, x.b) for x in r.spans] for r in out} == {d: [(1, 13)] if d < 9999 else [] for d, _ in docs}
    assert all(r["items"] == [f"i{r.doc_id}"] for r in out if r.doc_id < 9999)


def test_rows_alike_but_for_other_columns(spark):
    """Of rows of one id and text the row of least hash stays, whatever their order."""
    rows = [(1, "a b c d", k) for k in range(6)]
    kept = {tuple(simhash.keep_one(spark.createDataFrame(rows[::d], "doc_id long, text string, extra int").repartition(n)).collect()[0]) for d in (1, -1) for n in (1, 3)}
    assert len(kept) == 1


def test_warc_pages_without_ends(spark):
    """Beginnings without an end, tens of thousands of them: read in time that grows with the page alone."""
    import time

    for part in ("<script ", "<!-- ", "<", "<title>", "<a href=", "<style>x", "<p "):
        began = time.time()
        text = warc.plain_text(page := part * 40_000 + "<b>end</b>")
        warc.outlinks(page), warc.title_of(page)
        assert "end" in text and time.time() - began < 5
    assert warc.visible("a<!-- x --><SCRIPT src=u>var</script >b<style>c") == "a <SCRIPT src=u>b<style>c" and warc.title_of("<title>never<title>A &amp; <b>b</b></title>") == "neverA & b"


def test_warc_broken_records_are_rows(spark):
    good = warc.response("u", "<p>x</p>")
    wrong = good.replace(b"<p>x</p>", b"<p>y</p>")
    rows = [(1, good), (2, b"nonsense"), (3, None), (4, good[:-20]), (5, wrong)]
    out = {r.page_id: r for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()}
    assert out[1].error is None and out[1].text == "x" and all(out[k].error and out[k].text is None for k in (2, 3, 4, 5))
    data = b"".join(__import__("gzip").compress(good) for _ in range(3))
    assert list(warc.read_records(iter([data[k : k + 7] for k in range(0, len(data), 7)]))) == [good] * 3


def test_publishing_twice(tmp_path):
    store, path = shared.open_store(str(tmp_path))
    for k in range(2):
        (tmp_path / f".{k}").write_text("same")
        shared.publish(store, f"{path}/.{k}", f"{path}/x")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x"]
