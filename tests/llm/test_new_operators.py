"""WARC archives, spelling variants and ranked search against brute force, damaged archives and edge cases."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import ranking, spelling, warc

from .test_llm import edge_docs

# WARC

PAGES = "page_id long, url string, html string, key string, payload string"
BIG = "<p>page</p>" * 40


def page_rows():
    rows = [(i, f"http://a/{i}", BIG if i % 3 == 0 else f"<p>{i}</p>" * (i % 30), "k", "p") for i in range(1, 60)]
    return rows + [(100, None, None, None, None), (101, "http://a/ b\r\nX: yé", "é" * 200, None, None), (1, "http://a/1", "<p>1</p>", "k", "p"), (None, "u", BIG, None, None), (None, "u", "z" * 300, None, None), (None, "u", "z" * 300, None, None), (102, "", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", None, None), (103, "big", "x" * 17_000_000, None, None)]


def expected_pages(rows):
    firsts = {}
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        if key is not None and len(body) >= 100:
            firsts[body] = min(firsts.get(body, key), key)
    out = []
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        first = firsts.get(body)
        again = first is not None and key != first
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_warc_round_trip(spark, tmp_path):
    rows = page_rows()
    path = warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w", date="2024-01-01T00:00:00Z")
    read, gaps = warc.read_archives(spark, path, payload=True)
    got = [(None if r["key"] is None else int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in read.collect()]
    assert sorted(got, key=str) == sorted(expected_pages(rows), key=str)
    assert gaps.count() == 0
    bodies = collections.Counter(hashlib.sha256((html or "").encode()).hexdigest() for _, _, html, *_ in rows)
    for r in read.where("record_type = 'response'").collect():
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] in bodies
    assert read.where("key = '101'").first()["target_uri"] == "http://a/%20b%0D%0AX:%20yé"
    for f in (tmp_path / "w").glob("part-*"):  # whole archives, as any gzip tool reads them
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1")


def test_warc_many_revisits_are_joined_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = page_rows()[:-1]
    read, _ = warc.read_archives(spark, warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w"))
    assert read.select("file").distinct().count() > 3
    got = [(None if r["key"] is None else int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in read.collect()]
    assert sorted(got, key=str) == sorted(expected_pages(rows), key=str)


def test_warc_empty_table(spark, tmp_path):
    read, gaps = warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/w"))
    assert (read.count(), gaps.count()) == (0, 0)


def some_records(n, rng):
    out = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(400))) if i % 4 else f"WARC/1.1 in page {i}\r\n".encode() * 3
        out.append(warc.record("response", str(i), f"http://a/{i}", body, hashlib.sha256(body).hexdigest(), None, "2024-01-01T00:00:00Z"))
    return out


@pytest.mark.parametrize("packed", [True, False, None])
def test_warc_salvage(packed):
    """Damage of any kind costs the records it touches and no other; records and gaps cover the archive. None: members and plain records mixed."""
    rng = random.Random(3)
    for trial in range(120):
        pieces = [warc.member(r, 6) if packed or (packed is None and rng.random() < 0.5) else r for r in some_records(12, rng)]
        data = bytearray(b"".join(pieces))
        bounds, at = [], 0
        for p in pieces:
            bounds.append((at, at + len(p)))
            at += len(p)
        kind = ["none", "flip", "cut", "insert", "drop", "zero"][trial % 6]
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.randrange(1, 300))
        touched = set()
        if kind == "flip":
            data[a] ^= 1 << rng.randrange(8)
            touched = {i for i, (x, y) in enumerate(bounds) if x <= a < y}
        elif kind == "cut":
            del data[a:]
            touched = {i for i, (x, y) in enumerate(bounds) if y > a}
        elif kind == "drop":
            del data[a:b]
            touched = {i for i, (x, y) in enumerate(bounds) if x < b and y > a}
        elif kind == "zero":
            data[a:b] = bytes(b - a)
            touched = {i for i, (x, y) in enumerate(bounds) if x < b and y > a}
        elif kind == "insert":
            data[a:a] = bytes(rng.randrange(256) for _ in range(50))
            touched = {i for i, (x, y) in enumerate(bounds) if x < a < y}
        found = list(warc.records(bytes(data)))
        keys = {r["key"] for _, _, r, _ in found if r}
        assert {str(i) for i in range(12) if i not in touched} <= keys, kind
        if packed:  # only unchecked bytes of a gzip header (time, system) may be hurt and pass; a plain record's header has more such
            assert len(keys & {str(i) for i in touched}) <= (1 if kind in ("flip", "zero") else 0), kind
        assert [(x, y) for x, y, _, _ in found] == sorted((x, y) for x, y, _, _ in found)
        covered = 0
        for x, y, _, _ in found:
            assert x == covered
            covered = y
        assert covered == len(data)
        if kind == "none":
            assert not any(why for *_, why in found)


def test_warc_foreign_archives():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"hi").digest()).decode()
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http;\r\n msgtype=response\r\nWARC-Payload-Digest: " + sha1.encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    found = list(warc.records(warc.member(info + one, 6) + warc.member(b"no record", 6) + info + warc.EMPTY))
    assert [(r and r["record_type"], why) for _, _, r, why in found] == [("warcinfo", None), ("response", None), (None, "member without a record"), ("warcinfo", None)]
    assert found[1][2]["payload"] == b"hi" and found[1][2]["key"] is None
    wrong = one.replace(sha1.encode(), sha1[:-1].encode() + (b"A" if not sha1.endswith("A") else b"B"))
    assert [why for *_, why in warc.records(wrong + one)] == ["payload digest differs", None]
    assert list(warc.records(b"")) == [] and [w for *_, w in warc.records(b"junk")] == ["no version line"]


def test_warc_damage_on_disk(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 50, "k", "p") for i in range(40)]
    path = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w")
    file = next((tmp_path / "w").glob("part-*"))
    data = bytearray(file.read_bytes())
    hurt = data.find(warc.GZIP, len(data) // 2) - 6  # in a member's checksum
    data[hurt] ^= 255
    (tmp_path / "damaged").mkdir()
    (tmp_path / "damaged" / "a.warc.gz").write_bytes(data)
    (tmp_path / "damaged" / "empty.warc.gz").write_bytes(b"")
    read, gaps = warc.read_archives(spark, f"{tmp_path}/damaged")
    gap = gaps.collect()
    assert read.count() == 39 and len(gap) == 1
    assert gap[0]["offset"] <= hurt < gap[0]["offset"] + gap[0]["n_bytes"] and "damaged" in gap[0]["reason"]


# Spelling variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    form, near = {}, {}
    for w in counts:
        near[w] = [v for v in counts if v != w and one_apart(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("hot", [spelling.HOT, 7])
def test_variants_brute_force(spark, hot, monkeypatch):
    """Words of 1 to 9 letters, many in one block, with equal runs; also with blocks in parts."""
    monkeypatch.setattr(spelling, "near_words", lambda v, f=spelling.near_words: f(v, hot))
    rng = random.Random(5)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 10))) for _ in range(260)} | {"aaaaaa" + x for x in ("", "a", "b", "ab", "é", "ÿ")}
    counts = {w: rng.choice([5, 5, 6, 30, 30, 200, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("x"))
    assert {tuple(r) for r in spelling.variants(df).collect()} == brute_variants(counts)


def test_long_chains_of_forms(spark):
    counts = {"b" * i + "a" * (12 - i): 5 * 5**i for i in range(12)}
    out = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(out.values()) == {"b" * 11 + "a"}


def test_word_counts(spark):
    text = "Straße STRASSE straße ÀÉÎÕÜß x×÷y naïve-naïveté 東京naïveté١ " + "zzzzzzzz " * 7
    rows = [(i, text, "mine") for i in range(300)] + [(None, text, None), (5, None, None), (6, "", None), (7, "a" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = collections.Counter()
    for key, body, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", body or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{w}".encode())
            if h % 19 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    assert dict(spelling.word_counts(df, slips=19).collect()) == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    plain = dict(spelling.word_counts(df).collect())
    assert plain["zzzzzzzz"] == 7 * 301 and plain["straße"] == 2 * 301 and plain["strasse"] == 301


def test_spelling_edges(spark):
    counts = spelling.word_counts(edge_docs(spark))
    assert {r["word"] for r in counts.collect()} == set()  # no long word stands five times but in LONG, whose words are short
    assert spelling.variants(counts).count() == 0
    assert spelling.word_counts(edge_docs(spark).limit(0)).count() == 0


# Ranked search


def brute_ranking(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, collections.Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n_docs // length
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in collections.Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(index, queries, **options):
    return sorted([tuple(r) for r in ranking.search(index, queries, **options).collect()], key=str)


def zipf_texts(rng, n, longest=60):
    words = [f"w{i}" for i in range(80)] + ["Éa", "x1", "東京"]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("pairs", [None, 3, 100_000])
def test_ranking_brute_force(spark, pairs, monkeypatch):
    """Many small shards, with floors from some of them; with all pairs of the queries, few, or none listed."""
    monkeypatch.setattr(ranking, "SHARD_BYTES", 1500)
    rng = random.Random(11)
    docs = list(enumerate(zipf_texts(rng, 400)))
    docs += [(1000 + i, docs[i][1]) for i in range(30)] + [(None, docs[3][1]), (7, docs[7][1])]  # ties, repeated and null keys
    items = list(enumerate(zipf_texts(rng, 25, 30))) + [(90, None), (91, "nowhere"), (92, "W0, w0! w0 w1"), (92, "W0, w0! w0 w1")]
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    q = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, key string")
    index = ranking.build_index(d, None if pairs is None else q, max_pairs=pairs or 0)
    assert index.shards.count() > 20
    assert ranked(index, q) == brute_ranking(docs, items)
    assert ranked(index, q, k=3) == brute_ranking(docs, items, 3)


def test_ranking_in_blocks_and_with_other_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 20)
    rng = random.Random(12)
    docs = [(f"d{i}", t) for i, t in enumerate(zipf_texts(rng, 60))]
    items = [(f"q{i}", t) for i, t in enumerate(zipf_texts(rng, 12, 20))]
    index = ranking.build_index(spark.createDataFrame(docs, "id string, body string"), key="id", text="body")
    found = ranking.search(index, spark.createDataFrame(items, "name string, body string"), 5, key="name", text="body")
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_ranking(docs, items, 5)


def test_ranking_edges(spark):
    items = spark.createDataFrame([(1, "fox dog"), (2, None), (3, "ß 12 x")], "item_id long, text string")
    docs = edge_docs(spark)
    assert ranked(ranking.build_index(docs, items), items) == brute_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "fox dog"), (2, None), (3, "ß 12 x")])
    assert ranked(ranking.build_index(docs.limit(0), items), items) == []
    assert ranked(ranking.build_index(docs, items.limit(0)), items.limit(0)) == []


def test_pair_bounds_skip_more_than_single_ones(spark, monkeypatch):
    """Two frequent terms that never meet: their joint bound keeps documents of one of them from being looked at."""
    monkeypatch.setattr(ranking, "SHARD_BYTES", 1 << 20)
    docs = [(i, "left fill" if i % 2 else "right fill") for i in range(2000)] + [(5000 + i, "rare left fill") for i in range(20)]
    items = [(1, "rare left right")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    index = ranking.build_index(d, q)
    shard = index.shards.select("pairs", "joint", "common").first()
    assert (shard["pairs"], shard["joint"], shard["common"]) == (b"left right", bytes(8), b"")
    assert ranked(index, q) == brute_ranking(docs, items)


# Earlier operators


def test_url_hosts_with_control_characters(spark):
    """A host that goes on behind any character is another host."""
    from barloom.llm import urlfilter

    rules = spark.createDataFrame([("block", "com", ""), ("block", "a.b", "/x")], "verdict string, host string, path string")
    urls = ["http://com\x01zzz/a", "http://com\x00/a", "http://com/a", "http://q.com#", "http://a.b/x?#", "http://a.b\x01/x", "http://b\x01/x/x"]
    out = urlfilter.url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    assert {r["url"]: r["rule"] for r in out} == dict(zip(urls, [None, None, "com", "com", "a.b/x", None, None], strict=True))


def test_languages_are_learned_from_long_words(spark):
    from barloom.llm import langid

    rows = [(i, "ab" * 600 if i % 2 else "cd" * 600, "x" if i % 2 else "y") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "abab"), (2, "cdcdcd")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.language_of(asked, docs).collect()} == {1: "x", 2: "y"}
