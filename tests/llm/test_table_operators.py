"""Line dedup, URL filters, archives, mixing, near-duplicates and the pipeline."""

import base64
import gzip
import hashlib
import io
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle_tools import connect, rows_of
from tideline import storage
from tideline.llm import mixing, near
from tideline.llm.lines import LineRuns, dedup_lines
from tideline.llm.mixing import MOST, mix, pivotal
from tideline.llm.near import near_duplicates
from tideline.llm.queries import ORACLE_SQL, QUERIES
from tideline.llm.urls import filter_urls
from tideline.llm.warc import archive_pages, inflate, normalize_stream, read_member, record_bytes, records, response_record

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    found = connect(SF).sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())


# --- lines


def brute_lines(rows, min_chars=10):
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(lower(strip(x)), set()).add((1 << 63) - 1 if i is None else i)
    out = []
    for i, t in rows:
        lines, me = (t or "").split("\n"), (1 << 63) - 1 if i is None else i
        kept = [x for x in lines if not (len(k := lower(strip(x))) >= min_chars and len(holders[k]) > 1 and min(holders[k]) != me)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_lines_against_brute_force(spark, batches):
    rng = np.random.default_rng(batches)
    pool = ["A common line here", "  a COMMON line here\t", "short", "", "ÉCOLE normale sup", "école normale sup", "only once %d", "x" * 50, "another shared line\r"]
    rows = [(int(i), "\n".join(str(pool[j]) % i if "%d" in pool[j] else pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 9)))) for i in range(60)]
    rows += [(None, "A common line here\nnull id line"), (None, None), (61, None), (62, ""), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, drops string")
    out = dedup_lines(df, batches=batches, fanout=2, buckets=3)
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()) == brute_lines(rows)
    assert {"key", "drops"} <= set(out.columns)


def test_lines_of_no_documents(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_runs_are_disjoint_and_compacted(spark):
    runs = LineRuns(spark, buckets=2, fanout=2)
    for a in range(0, 60, 10):
        keys = spark.range(a, a + 15).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"))
        seen = runs.known(keys)
        assert {r.h1 for r in seen.where("known").collect()} == (set(range(a, a + 5)) if a else set())
        runs.add(seen.where("not known"))
    assert [len(level) for level in runs.levels] == [0, 1, 1] and sum(spark.table(n).count() for n, _ in runs.runs()) == 65
    plan = runs.known(keys)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    runs.close()
    assert not runs.runs()


def test_runs_are_deleted_when_a_batch_fails(spark, monkeypatch):
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")}
    before, known = tables(), LineRuns.known
    calls = []

    def failing(self, keys):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return known(self, keys)

    monkeypatch.setattr(LineRuns, "known", failing)
    docs = spark.createDataFrame([(i, f"a line of text {i % 3}\nand another {i}") for i in range(40)], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        dedup_lines(docs)
    assert tables() == before


def test_a_very_long_text_and_a_very_frequent_line(spark):
    rows = [(i, "a very frequent line\n" * 50 + f"own line {i}") for i in range(300)] + [(1000, "\n".join(f"line number {i % 20_000}" for i in range(60_000)))]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()) == brute_lines(rows)


# --- urls


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def test_urls_against_brute_force(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("a.net", "", "block"), ("", "", "block"), ("bad.org", "/x?y", "block")]
    urls = [None, "", "no scheme", "http://", "http://com/en/1", "https://A.Example.COM/en/7?q#f", "https://example.com/en/8", "ftp://x.a.net", "http://a.net#f", "http://notnet/de/", "http://x.net/de/1://y", "://com/en/", "http://com", "http://e.com:80/en/", "http://Écom.com/en/é"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls * 2)] + [(None, "http://com/en/", "k")], "page_id long, url string, key string")
    out = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls) * 2 + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id % len(urls)] if r.page_id is not None else "http://com/en/", rules)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_many_listed_urls_have_no_false_positives(spark, monkeypatch, limit):
    monkeypatch.setattr("tideline.llm.urls.MOST_BROADCAST", limit)
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id")).alias("host"), F.concat(F.lit("/p"), F.col("id") % 10, F.lit("/")).alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit("/p"), F.col("id") % 10, F.lit("/z")).alias("url"))
    out = filter_urls(pages, listed)
    assert out.where("(verdict = 'block') <> (page_id < 3000)").isEmpty() and out.count() == 6000
    assert filter_urls(pages.limit(0), listed).isEmpty() and filter_urls(pages, listed.limit(0)).where("verdict <> 'allow'").isEmpty()


def test_a_list_of_many_shapes(spark):
    """Thousands of lengths and depths of hosts make one small plan; hosts and paths are not mixed up."""
    rules = [("x" * (i % 7) + f"h{i}.net", "/" + "p" * i, "block") for i in range(2000)] + [("a", "b", "block"), ("ab", "", "allow"), ("a.b.c.d.e.f", "/z", "block")]
    pages = [(i, f"http://sub.{'x' * (i % 7)}h{i}.net/" + "p" * (i + i % 3 - 1)) for i in range(0, 2000, 50)] + [(9000, "http://ab"), (9001, "http://a/b"), (9002, "http://1.a.b.c.d.e.f/z")]
    out = filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {(r.page_id, r.rule, r.verdict) for r in out.collect()} == {(i, *brute_url(u, rules)[2:]) for i, u in pages}
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 100_000


# --- archives


def test_normaliser_gives_members_and_offsets():
    raw = b"".join(response_record(str(i), f"http://x/{i}", b"payload" * i + b"\r\n\r\n") for i in range(20))
    for source in (gzip.compress(raw), gzip.compress(raw[:500]) + gzip.compress(raw[500:])):
        target = io.BytesIO()
        index = normalize_stream(io.BytesIO(source), target)
        assert len(index) == 20 and b"".join(inflate(io.BytesIO(target.getvalue()))) == b"".join(record_bytes({k: v for k, v in h.items() if k != "Content-Length"}, b) for h, b in records(iter([raw])))
        headers, block = read_member(target, index[7]["offset"], index[7]["length"])
        assert headers["X-Page-Id"] == "7" and block.endswith(b"payload" * 7 + b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(records(iter([raw[:-30]])))
    assert list(records(iter([b""]))) == []


def brute_pages(rows):
    out = Counter()
    groups = {}
    for i, (p, h) in enumerate(rows):
        groups.setdefault(h or "", []).append((-1 if p is None else p, i))
    for i, (p, h) in enumerate(rows):
        raw = (h or "").encode()
        top = max(groups[h or ""])
        ties = [j for q, j in groups[h or ""] if q == top[0]]
        first = i == ties[0]
        out[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first or top[0] < 0 else top[0]] += 1
    return out


def test_archives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tideline.llm.warc.MOST_RECORDS", 7)
    rows = [(i, ["<p>é</p>", None, "", "x" * 5000, f"own {i}"][i % 5]) for i in range(40)] + [(39, "own 39"), (3, "<p>é</p>"), (None, "null id"), (None, "")]
    pages = spark.createDataFrame([(p, "http://x/\r\ny", h, "z") for p, h in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    got = Counter(tuple(r) for r in archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == brute_pages(rows)
    assert archive_pages(pages.limit(0)).isEmpty()


# --- mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 1)), max_size=60), st.integers(0, 1000))
def test_pivotal_keeps_mass_and_leaves_one(items, seed):
    weight, share = [w for w, _ in items], [s for _, s in items]
    out = pivotal(weight, share, [hash((i, seed)) for i in range(len(items))], seed)
    assert sum(0 < s < 1 for s in out) <= 1 and all(0 <= s <= 1 for s in out)
    assert sum(w * s for w, s in zip(weight, out, strict=True)) == pytest.approx(sum(w * s for w, s in zip(weight, share, strict=True)), abs=1e-4)


def test_pivotal_is_unbiased():
    weight, share = [3, 7, 5, 2, 11], [0.3, 0.8, 0.5, 0.1, 0.4]
    runs = np.array([[s if s in (0, 1) else float(np.random.default_rng(k).random() < s) for s in pivotal(weight, share, [1, 2, 3, 4, 5], k)] for k in range(4000)])
    assert np.allclose(runs.mean(0), share, atol=0.04)


def brute_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= MOST * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = MOST * sizes[s]
            free.remove(s)
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    names = ["a", "b", "Z", "é", None, "empty", "tiny"]
    rows = [(i, " w" * (0 if (s := names[min(int(rng.exponential(2)), 4)]) == "empty" else int(rng.integers(0, 60))), "en", s, 0) for i in range(3000)]
    rows += [(5000, None, None, "empty", None), (5001, " \n", None, "empty", None), (5002, "one", None, "tiny", None), (1, rows[1][1], "en", rows[1][3], 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mix(docs, leaf=64, fan_in=4).toPandas()
    source = {r[0]: r[3] for r in rows}
    size = Counter()
    for i, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    expected, taken = brute_targets(size), Counter()
    for r in out.itertuples():
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(expected[s]) and r.taken == r.copies * r.size and 0 <= r.copies <= MOST
        taken[s] += r.taken
    assert len(out) == len(rows)
    assert all(abs(taken[s] - expected[s]) <= 60 for s in size)
    again = mix(docs.repartition(7), leaf=64, fan_in=4).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mix(docs.limit(0)).isEmpty()


def test_one_id_on_many_rows_is_dealt_out(spark):
    """A third of all rows have one id and size, others no id: no group is larger than the rest."""
    rows = [(7, "one two three", "a")] * 20_000 + [(None, "four", "a")] * 20_000 + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(100, 20_100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    sizes = []
    work = mixing.round_groups

    def counted(rows, seed, last):
        sizes.append(rows.groupBy("source_key", "bucket").agg(F.sum("times").alias("n")).agg(F.max("n")).first()[0])
        return work(rows, seed, last)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "round_groups", counted)
        out = mix(docs, leaf=512)
    assert max(sizes) < 4 * 512 and out.count() == len(rows)
    got = out.groupBy("doc_id", "size").count().where("doc_id = 7 or doc_id is null").collect()
    assert {(r.doc_id, r.size, r["count"]) for r in got} == {(7, 3, 20_000), (None, 1, 20_000)}
    by = out.groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(by) == 2 and all(abs(r.taken - r.target) <= 10 for r in by)
    again = mix(docs.repartition(3), leaf=512).groupBy("doc_id", "taken").count()
    assert again.exceptAll(out.groupBy("doc_id", "taken").count()).isEmpty()


def test_large_ids_beside_null_ids_stay_exact(spark):
    big = (1 << 62) + 1
    out = mix(spark.createDataFrame([(big, "a b", "s"), (None, "c", "s"), (big + 1, "d", None)], "doc_id long, text string, source string"))
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, big, big + 1]


# --- near-duplicates


def brute_near(rows, k, percent=80):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if w and len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        up[i] = i

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and (c := len(sets[x] & sets[y])) and 100 * c >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def variants(rng, n, words, edits):
    base = [f"w{rng.integers(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [1024, 8])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    """Near copies around the threshold, chains, exact copies and odd texts; with tiny nodes the
    dense groups take the way over pivots and blocks."""
    monkeypatch.setattr(near, "SMALL", small)
    rng = np.random.default_rng(9)
    texts = variants(rng, 40, 120, 6) + variants(rng, 15, 60, 4) + variants(rng, 10, 200, 3) + ["the same text of six words", "The SAME text of six words"] * 3
    texts += [" ".join(f"u{rng.integers(10**6)}" for _ in range(50)) for _ in range(30)] + ["two words", "two  words", "", " ", "x"]
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[s : s + 100]) for s in range(0, 60, 6)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(docs, words=4).collect()}
    assert got == brute_near(rows, 4)


def templates(rng, n, slots=0):
    """Pages of 88 shared words and 12 own ones, below the threshold for each other; with ``slots`` the
    own words come from so many, and their number differs."""
    core = [f"t{i}" for i in range(88)]
    own = (lambda: f"s{rng.integers(slots)}") if slots else (lambda: f"o{rng.integers(10**9)}")
    return [" ".join([own() for _ in range(int(rng.integers(4, 14)) if slots else 12)] + core) for _ in range(n)]


@pytest.mark.parametrize("rare", [2, 16])
def test_crowded_nodes_against_brute_force(spark, monkeypatch, rare):
    """Many components in nodes that do not shrink: the prefix filter finds all links."""
    monkeypatch.setattr(near, "SMALL", 16)
    monkeypatch.setattr(near, "RARE", rare)
    rng = np.random.default_rng(rare)
    texts = templates(rng, 60) + templates(rng, 60, 12) + variants(rng, 20, 120, 6)
    for _ in range(30):
        words = [f"t{i}" for i in range(88)]
        for _ in range(int(rng.integers(1, 6))):
            words[int(rng.integers(88))] = f"z{rng.integers(40)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == brute_near(rows, 4)


def test_shingles_of_one_page_are_not_joined(spark, monkeypatch):
    """Of a crowded node's shingles only those leave their count that several of its pages have."""
    monkeypatch.setattr(near, "SMALL", 64)
    stored, made = near.materialize, {}

    def watched(df, name, *more):
        made[name] = stored(df, name, *more)
        if name == "near-ranked":
            made["most"], made["least"] = made[name].count(), made[name].agg(F.min("f")).first()[0]
        return made[name]

    monkeypatch.setattr(near, "materialize", watched)
    rng = np.random.default_rng(8)
    texts = templates(rng, 150) + [x for t in templates(rng, 50) for x in (t, f"{t} end")]
    rows = list(enumerate(texts))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert made["least"] == 2 and made["most"] > 0
    assert got == brute_near(rows, 4)


def test_crowded_nodes_with_equal_ids(spark, monkeypatch):
    """A document that comes twice, with equal sets of shingles, holds every shingle once: pages with 14
    words of their own are linked with those with 7, over frequent shingles only."""
    monkeypatch.setattr(near, "SMALL", 16)
    monkeypatch.setattr(near, "RARE", 4)
    core = " ".join(f"t{i}" for i in range(88))
    rows = [(i, " ".join(f"o{i}x{j}" for j in range(7 if i in (20, 40) else 14)) + f" {core}") for i in range(60)]
    docs = spark.createDataFrame([(i, x) for i, t in rows for x in (t, t.upper())], "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(docs, words=4).collect()}
    assert got == brute_near(rows, 4)


def test_pages_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    """Rows in cells and small nodes of the second pass grow in proportion to the pages."""
    monkeypatch.setattr(near, "SMALL", 64)
    made, blocks, links = [], near.NearJoin.blocks, near.NearJoin.links_across
    for n in (300, 600):
        seen = []

        def counted(self, rows, seen=seen):
            seen.append(rows.count())
            return links(self, rows)

        monkeypatch.setattr(near.NearJoin, "links_across", counted)
        docs = spark.createDataFrame(list(enumerate(templates(np.random.default_rng(n), n))), "doc_id long, text string")
        assert near_duplicates(docs, words=4).where("kept").count() == n
        made.append(sum(seen))
    assert made[1] <= 3 * max(made[0], n) and near.NearJoin.blocks is blocks


def test_full_sets_of_large_nodes_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(near, "MOST_BYTES", 1000)
    rng = np.random.default_rng(5)
    rows = list(enumerate(variants(rng, 25, 120, 6) + variants(rng, 25, 90, 6)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == brute_near(rows, 4)


def test_near_copies_of_a_very_long_text(spark):
    rng = np.random.default_rng(6)
    words = [f"w{rng.integers(10**6)}" for _ in range(30_000)]
    other = [w if i % 100 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:20_000])), (4, " ".join(words[::-1]))]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and out[1][0] == len({tuple(words[i : i + 5]) for i in range(29_996)})


def test_near_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (None, "same words here", "c"), (3, "same words here", "d"), (4, "same words here", "e"), (4, "same words here", "e")], "doc_id long, text string, hi string")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert out == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False)]
    assert near_duplicates(docs.limit(0)).isEmpty()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 250)], "a long, b long")
    got = {r.id: r.label for r in near.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200, 250: 200}


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "1234 5678", "en", "src0", 9), (900_002, None, None, None, None)], DOCS)
    docs = docs.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "mixing", "SentencePiece"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if name != "SentencePiece":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language ID":
            gone = before.select("doc_id").subtract(docs.select("doc_id"))
            assert {r.doc_id for r in gone.collect()} >= {900_001, 900_002} and gone.count() < 5
        if name == "line dedup":
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((i, t) for i, t, *_ in brute_lines([(r.doc_id, r.text) for r in before.collect()]).elements())
        if name == "MinHash near-dedup":
            kept = {i for i, _, _, k in brute_near([(r.doc_id, r.text) for r in before.collect()], 5) if k}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "mixing":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= MOST
            before_words, words = (sum(len((r.text or "").split()) for r in d.collect()) for d in (before, docs))
            assert abs(words - before_words) < 0.1 * before_words
    assert seen[-1].count() == seen[-2].count()


def test_pipeline_drops_unlearned_scripts(spark):
    rng = np.random.default_rng(4)
    scripts = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x9000), (0x627, 0x64A)]
    word = lambda a, b: "".join(map(chr, rng.integers(a, b, rng.integers(2, 9))))
    strange = [(1_000_000 + i, " ".join(word(*scripts[i % 4]) for _ in range(40)), None, "src0", 1) for i in range(200)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(strange, DOCS)), SF).select("doc_id").collect()
    kept = [r.doc_id for r in out]
    assert sum(i >= 1_000_000 for i in kept) < 10
    assert sum(i < 1_000_000 for i in kept) >= docs.count() - 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    """Empty tables, repeated rows, null ids and nulls in every column, extra columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], DOCS)
    assert stage(spark, empty, SF).isEmpty()
    text = "the quick brown fox and the lazy dog of the old town\nwith another line of words"
    rows = [(i, f"{text} number {i} {'x' * i}", "en", "s", 1, "k") for i in range(20)] + [(3, text, "en", "s", 1, "k")] * 3 + [(None, f"{text} of no id", "en", None, None, None)] * 2 + [(50, None, None, None, None, None), (51, "", "en", "s", 0, "k")]
    docs = spark.createDataFrame(rows, f"{DOCS}, size string").withColumn("drops", F.col("size"))
    out = stage(spark, docs, SF)
    if name != "SentencePiece":
        assert out.columns == corpus_pipeline.COLUMNS
    got = Counter(r.doc_id for r in out.collect())
    every = Counter(r[0] for r in rows)
    if name in ("line dedup", "SentencePiece"):
        assert got == every
    if name == "language ID":
        assert got == every - Counter([50, 51])
    if name == "MinHash near-dedup":
        assert got[None] == 2 and got[50] == got[51] == 1 and sum(got.values()) < len(rows)
    if name == "mixing":
        assert got[50] == got[51] == 0 and set(got) < set(every) and all(n % every[i] == 0 for i, n in got.items()) and sum(got.values()) > 5


def test_run_deletes_what_it_stored(spark, tmp_path):
    """The whole pipeline, and what is left in the shared folder afterwards."""
    spark.createDataFrame([(i, f"the quick brown fox number {i} and the lazy dog\nline {i % 3}", "en", f"s{i % 3}", 1) for i in range(60)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    before = len(storage._MADE)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = storage._MADE[before:]
    assert out.count() > 0 and len([p for p in left if storage.exists(spark, p)]) == 1


def test_mixing_stage_keeps_null_ids(spark):
    docs = spark.createDataFrame([(i if i else None, f"some clean words of text {i}", "en", "s", 1) for i in range(6)], DOCS)
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.mixing(spark, docs, SF).collect()) == list(range(6))
