"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, extra columns, and against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import components, decontaminate, exact_dedup, hmm, kernel, mixing, near_dedup, quality, scratch, substring_dedup, toxicity, training, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, kept string, score string, n int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(1)
    base = [words(rng.randint(30, 120), i) for i in range(12)]
    rows: list[str | None] = [None, "", " \n\t", "one", "One", "two words", *base]
    rows += [base[0], base[0].upper().replace("É", "é").replace("SS", "ß"), base[1], base[1] + " tail", base[2] + " x y", "  ".join(base[3].split(" "))]
    for k in range(8):
        w = base[4].split()
        w[rng.randrange(len(w))] = f"changed{k}"
        rows.append(" ".join(w))
    rows += ["a" * 400, "ab" * 300, "a" * 99, "a" * 100, "é" * 300, words(3000, 99)]
    shared = words(60, 77)
    rows += [f"{words(20, 200 + i)} {shared} {words(20, 300 + i)}" for i in range(6)]
    return [(i, t, "en", ["x", "y", None, "zé"][i % 4], "k", "s", 1) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


# --- substring dedup ---------------------------------------------------------


def brute_removed(rows: list[tuple], length: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            if text[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(text[s : s + length])
        left = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(text), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("salted", [False, True])
def test_substring_dedup(spark, docs, monkeypatch, salted):
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 2 if salted else 4096)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs, 100).collect()}
    assert got == brute_removed(corpus(), 100)


def test_substring_dedup_edges(spark, empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    t = words(40, 5)
    rows = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t), (5, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(rows).collect()), key=str)
    assert got == sorted([(None, 0), (3, 0), (3, 0), (4, len(t.encode())), (5, 0)], key=str)
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(rows, 10)


def test_substring_dedup_repeated_identifiers(spark):
    """Rows of one identifier are rows of their own, in the order of their texts' hashes; equal rows are cut alike."""
    shared, own = words(40, 11), words(300, 12)
    rows = [(4, own + shared), (4, "short"), (4, words(200, 13)), (2, shared), (4, shared + words(30, 14)), (4, own + shared), (7, words(90, 13) + own), (7, own), (9, None), (9, shared)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, text_hash string").repartition(3)
    place = {r["text"] or "": r["h"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted({(i, place[t or ""], t or "") for i, t in rows})
    at = {(i, t): k for k, (i, _, t) in enumerate(order)}
    want = brute_removed([(k, t) for k, (_, _, t) in enumerate(order)], 100)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == sorted((i, *want[at[i, t or ""]]) for i, t in rows)
    assert sum(r[2] > 0 for r in got) >= 3


def test_prefix_classes_match_sorting():
    rng = np.random.default_rng(3)
    for n, k in ((50, 3), (400, 6), (2000, 8)):
        text = rng.integers(97, 100, n).astype(np.uint8)
        text[-1] = 255
        sa, bound = substring_dedup.prefix_classes(text, k)
        s = bytes(text) * 2
        strings = [s[p : p + k] for p in sa.tolist()]
        assert strings == sorted(strings)
        assert [bool(b) for b in bound] == [True, *(a != b for a, b in zip(strings, strings[1:], strict=False))]


def test_suffix_order_sorts_ties_only(monkeypatch):
    """Places that differ from all others are sorted once; orders are right with packed keys and without."""
    rng, plain, counted = np.random.default_rng(4), substring_dedup._sorted, []
    monkeypatch.setattr(substring_dedup, "_sorted", lambda key, at, n: counted.append(len(at)) or plain(key, at, n))
    text = rng.integers(0, 250, 4000).astype(np.uint8)
    text[3000:3200], text[-1] = text[:200], 255
    sa = substring_dedup.suffix_order(text, 101)
    assert counted[0] == 4000 and len(counted) > 3 and counted[1] < 1000 and max(counted[2:]) <= 450
    s = bytes(text) * 2
    assert [s[p : p + 101] for p in sa.tolist()] == sorted(s[p : p + 101] for p in range(4000))
    for n in (1, 2, 5, 300, (1 << 21) + 9):
        text = rng.integers(97, 99, n).astype(np.uint8)
        text[-1] = 255
        s, sa = bytes(text) * (2 + 40 // n), substring_dedup.suffix_order(text, 40)
        strings = [s[p : p + 40] for p in sa[:5000].tolist()]
        assert strings == sorted(strings) and (np.sort(sa) == np.arange(n)).all()


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_components_of_small_and_large_tables(spark, small):
    """A small edge table takes a few jobs, not several rounds of them; both ways have the same result."""
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(-5, 7), (7, 7), (1 << 40, 7)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(120)]
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in pairs:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    edges = spark.createDataFrame(pairs, "u long, v long")
    spark.sparkContext.setJobGroup(f"components-{small}", "components")
    try:
        found = components.components(edges, small=small)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{small}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = [(r["id"], r["component"]) for r in found.collect()]
    assert len(rows) == len(want) and dict(rows) == want
    assert not small or jobs <= 8
    assert components.components(edges.where("u = v"), small=small).count() == 0


# --- WARC ----------------------------------------------------------------------


def test_warc_round_trip(spark):
    tricky = "head WARC/1.1\r\nWARC-Type: response\r\n\r\n tail" + "é" * 5000 + "\x00\x1f\n\r\n\r\n"
    html = [None, "", "same", "same", "same", tricky, "ü" * 40000, "x" * 8192, tricky, ""]
    rows = [(i, f"http://h/{i}\r\nX: y", t, "extra") for i, t in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    path = scratch.new_path(spark, "warc-test")
    warc.write_warc(pages, path, segment_bytes=3000, chunk_bytes=700)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(html):
        payload = (t or "").encode()
        holder = max(j for j, u in enumerate(html) if (u or "") == (t or ""))
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), warc.digest32(payload))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == holder else ("revisit", holder))
    assert got[6]["segments"] > 20


def test_warc_marker_before_framing(spark):
    html = ["ends in WARC/1.1", "WARC/1.1", "a" * 12 + "WARC/1.1" + "b" * 40, "WARC/1.1" * 9, "x" * 50 + "WARC/1.1\n", "plain"]
    rows = [(i, "http://h/WARC/1.1", t) for i, t in enumerate(html)]
    for size in (20, 8):
        path = scratch.new_path(spark, "warc-test")
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment_bytes=60, chunk_bytes=size)
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_warc(spark, path).collect()}
        assert got == {i: (len(t), warc.digest32(t.encode())) for i, t in enumerate(html)}


def test_warc_min_bytes_and_empty(spark):
    schema = "page_id long, url string, html string"
    path = scratch.new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(1, None, "ab"), (2, "u", "ab"), (None, "u", "long enough"), (4, "u", "long enough")], schema), path, min_bytes=5)
    got = {r["page_id"]: r["record_type"] for r in warc.read_warc(spark, path).collect()}
    assert got == {1: "response", 2: "response", None: "revisit", 4: "response"}
    path = scratch.new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], schema), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_repeated_rows(spark):
    """Repeated pages, segmented or not, come back as often as they went in; equal identifiers with different payloads stay apart."""
    big, other = words(9000, 70), words(8000, 71)
    html = [(1, big), (1, big), (1, "tiny"), (1, "tiny"), (2, "tiny"), (3, other), (3, big), (None, other), (None, other)]
    pages = spark.createDataFrame([(i, None, t, "x", 3) for i, t in html], "page_id long, url string, html string, digest string, n int").repartition(3)
    path = scratch.new_path(spark, "warc-test")
    warc.write_warc(pages, path, compression=None)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect())
    size = {t: len(t.encode()) for _, t in html}
    assert got == {(3, size[big], "response", None): 1, (1, size[big], "revisit", 3): 2, (2, 4, "response", None): 1, (1, 4, "revisit", 2): 2, (3, size[other], "response", None): 1, (None, size[other], "revisit", 3): 2}
    path = scratch.new_path(spark, "warc-test")
    warc.write_warc(pages.where("page_id = 1"), path)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"]) for r in warc.read_warc(spark, path).collect())
    assert got == {(1, size[big], "response"): 2, (1, 4, "response"): 2}


def test_warc_records_have_the_mandatory_fields(spark):
    path = scratch.new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(i, f"http://h/{i}", words(400, i)) for i in (1, 2)] + [(3, "u", words(400, 1))], "page_id long, url string, html string"), path, compression=None, segment_bytes=900, date="2024-01-02T03:04:05Z")
    records = [r[0] for r in spark.read.option("lineSep", warc.MAGIC).text(path).collect() if r[0]]
    idents = []
    for r in records:
        fields, block = warc._header(r.encode())
        assert fields["warc-date"] == "2024-01-02T03:04:05Z" and int(fields["content-length"]) == len(block) and r.encode().endswith(b"\r\n\r\n")
        idents.append(fields["warc-record-id"])
        if fields["warc-type"] == "response":
            assert fields["content-type"] == "application/http; msgtype=response"
    kinds = Counter(warc._header(r.encode())[0]["warc-type"] for r in records)
    assert len(set(idents)) == len(idents) and kinds["warcinfo"] >= 1 and kinds["response"] == 2 and kinds["revisit"] == 1 and kinds["continuation"] > 4


def test_warc_reads_archives_of_others(spark):
    body = bytes(range(256))
    record = lambda kind, ident, more, block: b"\r\n".join([b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"warc-record-id:<{ident}>".encode(), b"WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}".encode(), b"", block]) + b"\r\n\r\n"
    raw = record("warcinfo", "urn:a", [], b"x: y") + record("request", "urn:r", [], b"GET / HTTP/1.1\r\n\r\n") + record("response", "urn:b", [b"WARC-Target-URI: http://h/"], b"HTTP/1.1 200 OK\r\nContent-Type: image/x\r\n\r\n" + body)
    path = scratch.new_path(spark, "warc-foreign").removeprefix("file://")
    import os

    os.makedirs(path)
    with open(f"{path}/a.warc", "wb") as f:
        f.write(raw)
    got = warc.read_records(spark, f"file://{path}").collect()
    assert [(r["uri"], r["page_id"], r["payload_bytes"], r["digest"]) for r in got] == [("http://h/", None, 256, warc.digest32(body))]


def test_chunked_framing():
    for payload in (b"", b"x", b"WARC/1.1\r\n" * 5, "é".encode() * 999):
        body = warc.encode_chunked(payload, 10)
        assert warc.decode_chunked(body) == payload and b"WARC/1.1\r\n" not in body
    assert warc.decode_chunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.decode_chunked(b"2\r\nabc\r\n0\r\n\r\n")


def test_segments_are_verified(spark):
    from pyspark.errors import PythonException

    rows = spark.createDataFrame([("o", 1, 1, None, "D", b"ab"), ("o", 1, 3, 4, None, b"cd")], "ident string, page_id long, segment int, total long, digest string, block binary")
    with pytest.raises(PythonException, match="segments"):
        warc.reassemble(rows).collect()


# --- near dedup ----------------------------------------------------------------


def shingles(text: str | None) -> set:
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows: list[tuple], percent: int) -> dict[int, tuple]:
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("block", [4096, 3])
def test_near_dedup(docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == brute_components(corpus(), 85)


def test_near_dedup_finds_links_beside_the_forest(spark):
    """Chains of small edits, in which neighbours are linked and distant members are not."""
    rng, rows = random.Random(4), []
    for g in range(4):
        w = words(150, 500 + g).split()
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            w[rng.randrange(len(w))] = f"n{len(rows)}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 85)


def test_near_dedup_edges(spark, empty):
    assert near_dedup.near_dedup(empty).count() == 0
    t = words(50, 6)
    got = near_dedup.near_dedup(spark.createDataFrame([(None, t), (7, t), (7, t), (9, t)], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(None, None, True), (7, 7, True), (7, 7, True), (9, 7, False)], key=str)


def test_near_dedup_repeated_identifiers(spark):
    """A document is its identifier, with all texts of its rows."""
    a, b, c = words(60, 21), words(60, 22), words(60, 23)
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (5, c), (5, c), (5, c.upper() if c.isascii() else c), (4, c + " x"), (6, ""), (6, c), (8, None), (None, a)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, id string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()), key=str)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 8: 8}
    expected = [(i, len(shingles(t)), (want[i] if shingles(t) else i) if i else None, not i or (want[i] if shingles(t) else i) == i) for i, t in rows]
    assert got == sorted(expected, key=str)


def boilerplate(pairs: int, share: float, common: int = 120) -> list[tuple]:
    """Documents that share a text; half of them have one near-copy each, beside which they are linked with nothing."""
    same, rows = words(common, 31), []
    for k in range(pairs):
        own = words(int(common * (1 - share) / share), 4000 + k).split()
        rows.append((len(rows), f"{same} {' '.join(own)}"))
        if k % 2 == 0:
            own[len(own) // 2] = "changed"
            rows.append((len(rows), f"{same} {' '.join(own)}"))
    return rows


@pytest.mark.parametrize("share", [0.4, 0.6])
def test_near_dedup_large_buckets(spark, monkeypatch, share):
    """Buckets and clusters of many blocks: pairs whose members share a text with all others are found; what guests send stays near the candidates."""
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    rows = boilerplate(120, share)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = []
    visits = near_dedup._visits
    monkeypatch.setattr(near_dedup, "_visits", lambda *a: (sent.append(out := visits(*a).persist()), out)[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()}
    want = brute_components(rows, 85)
    linked = {i for i, w in want.items() if w[1] != i}
    assert len(linked) >= 60
    assert sum(got[i] == want[i] for i in linked) / len(linked) >= 0.95
    assert all(got[i][1] == want[i][1] or i in linked for i in want)
    blocks = -(-len(rows) // 12)
    assert sum(x.count() for x in sent) < len(rows) * (blocks - 1)


def test_near_dedup_large_bucket_loses_no_pair(spark, monkeypatch):
    """All links of sets that meet in one bucket only, which has many blocks and several visit blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    one = F.concat(F.array(F.lit(5).cast("long")), F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.xxhash64("doc_id", k)))
    signatures = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda *a: signatures(*a).withColumn("bands", one))
    rows = boilerplate(30, 0.75, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == brute_components(rows, 85)


def shuffled(spark) -> int:
    """Bytes of shuffle written by the session so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_near_dedup_moves_no_text_of_no_cluster(spark):
    """Nor any band key that no other set has for a second time."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(600))) for i in range(400)]
    rows += [(1000, rows[0][1] + " more"), (1001, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    docs.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()}
        assert shuffled(spark) - before < sum(len(t) for _, t in rows) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: (596 + (i == 1000), i % 1000, i < 1000) for i, _ in rows}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7)] + [(1000, k) for k in range(1001, 1050)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100, **{k: 1000 for k in range(1000, 1050)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    p, q = (np.frombuffer(near_dedup.pack(near_dedup.minima(x)), np.uint64) for x in (a, b))
    assert abs(near_dedup.estimate(p, q[None])[0] - 900 / 1100) < 0.12


# --- exact dedup -----------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(docs, keep, fan_in):
    groups = defaultdict(list)
    for r in corpus():
        groups[(r[1] or "").translate(UPPER)].append(r[0])
    pick = min if keep == "smallest" else max
    want = {i: (pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs, keep=keep, fan_in=fan_in).collect()}
    assert got == want


def test_exact_dedup_edges(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (None, "b"), (2, "A"), (2, "A")], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == sorted([(None, 2, 3, False), (None, None, 1, True), (2, 2, 3, True), (2, 2, 3, True)], key=str)
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(empty, keep="any").collect()


def test_exact_dedup_merges_sorted_runs(spark):
    """Runs are sorted and merged: no aggregation in the plan; blocks of every run are in rising order; any block size gives the same groups."""
    rows = [(i, f"text {i % 400}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = {hashlib.sha256(f"text {k}".encode()).digest(): (k, len(range(k, 3000, 400))) for k in range(400)}
    for block in (8192, 7):
        table = scratch.materialise(exact_dedup.digests(docs), "digests-test")
        groups = exact_dedup.merge_runs(table, fan_in=2, block=block)
        plan = groups._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Sort [") >= 2 and plan.count("MapInArrow") >= 3
        got = {bytes(r["key"][:32]): (r["keep_id"], r["group_size"]) for r in groups.collect()}
        assert got == want
        last: dict = {}
        for r in exact_dedup.sorted_runs(table, "smallest", 3, block).collect():
            keys = [x.ljust(exact_dedup.KEY_BYTES, b"\0") for x in np.frombuffer(r["block"], exact_dedup.RECORD)["key"].tolist()]
            assert keys == sorted(set(keys)) and keys[0] == bytes(r["first"]) and len(keys) <= block
            assert keys[0] > last.get(r["run"], b"")
            last[r["run"]] = keys[-1]


# --- URL filter ------------------------------------------------------------------


def test_url_filter(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "a.b.example.com", "WWW.example.COM", "x.www.example.com", "notexample.com", "net", "a.net", "b.org", "", "a..net", "example.com:80", "u@com"]
    paths = ["", "/", "/en/", "/en/1", "/EN/1", "/es/?q", "/fr/x#y", "/en", "/es"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}{rng.choice(['', '?a=://b', '#f'])}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/en/", "http://h\n/en/"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].translate(UPPER)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"), u


def test_bloom_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 20_000, 37)]
    cascade = url_filter.BloomCascade(universe, 20_000, listed)
    got = {r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == set(listed) and len(cascade.levels) >= 3 and cascade.sizes[1] < 3 * len(listed)


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(pages, [("a.b", "/", "block")]).count() == 0
    assert url_filter.url_filter(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), []).first()["verdict"] == "allow"


# --- mixing ----------------------------------------------------------------------


def test_mixing_targets():
    got = mixing.targets({"a": 100, "b": 10, None: 1000, "c": 0}, [5, 2, 1], 1.5, 2)
    assert got["a"] == 200 and got["b"] == 20 and got["c"] == 0 and math.isclose(got[None], 1665 - 220)


def test_mixing(spark, docs, empty):
    rows = mixing.mix_sources(docs, [5, 2, 1]).collect()
    assert len(rows) == len(corpus())
    sizes = {r[0]: len(split(r[1])) for r in corpus()}
    per, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
        per[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for r in rows:
        assert abs(per[r["source"]] - r["target"]) <= most[r["source"]]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(2), [5, 2, 1], level_bits=3).collect()))
    assert mixing.mix_sources(empty, [1]).count() == 0


def test_mixing_rows_without_identifier(spark):
    """Their hash is that of their text, so the mix can come near its target; repeated identifiers go together."""
    rows = [(None, words(10, i), "a") for i in range(300)] + [(7, words(20, 1), "b"), (7, words(20, 2), "b")] + [(i, words(10, i), "b") for i in range(100, 130)]
    docs = spark.createDataFrame([(*r, "h", 3) for r in rows], "doc_id long, text string, source string, hash string, size int").repartition(3)
    got = mixing.mix_sources(docs, [1, 1], 0.8, 2.0).collect()
    for source, most in (("a", 10), ("b", 40)):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 1


# --- classifiers -----------------------------------------------------------------


def labelled(n: int) -> tuple[list, list]:
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        w = words(60, 1000 + i).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grobling", "groblingen", "fiend"])
        if bad:
            w = [x + rng.choice(["***", "$$$"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_quality_and_toxicity(spark, empty):
    rows, labels = labelled(600)
    docs = spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    use = training.fold(F.col("doc_id"), 3) != 1
    net = quality.fit_quality(docs, known, use)
    assert isinstance(net, quality.ByteConvNet)
    lexicon = toxicity.fit_toxicity(docs, known, use)
    for scored, label in ((quality.score_quality(docs, net), 1), (toxicity.score_toxicity(docs, lexicon), 2)):
        got = {r["doc_id"]: r["score"] for r in scored.collect()}
        assert len(got) == 602 and got[600] == got[601] and all(0 <= s <= 1 for s in got.values())
        held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 == 1]
        assert sum((got[x[0]] >= 0.5) == x[label] for x in held) / len(held) > 0.95
    assert quality.score_quality(empty, net).count() == 0 and toxicity.score_toxicity(empty, lexicon).count() == 0
    assert quality.fit_quality(docs, known.where("quality = 1"), use) > 0.5
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(empty, known, use)).first()["score"] == 0.5


def test_chunks_cover_whole_texts():
    sizes = np.array([0, 1, 255, 256, 257, 448, 449, 5000])
    n, starts = quality.chunk_starts(sizes)
    at = 0
    for size, k in zip(sizes.tolist(), n.tolist(), strict=True):
        own = starts[at : at + k]
        assert own[0] == 0 and own[-1] + quality.CHUNK >= size and (k == 1 or own[-1] + quality.CHUNK - quality.STEP < size)
        at += k


def test_quality_scores_by_brute_force():
    """One byte, one filter, one chunk at a time."""
    net = quality.ByteConvNet(3)
    net.p["bias"] += 0.1
    texts = [b"", b"a", bytes(range(1, 200)) * 4, words(90, 3).encode(), b"x" * 127, b"yz" * 64]
    want = []
    for t in texts:
        starts = [0]
        while starts[-1] + quality.CHUNK < len(t):
            starts.append(starts[-1] + quality.STEP)
        units = []
        for s in starts:
            chunk = t[s : s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            pooled = []
            for f in range(quality.FILTERS):
                values = []
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.HOP):
                    seen = np.concatenate([net.p["embed"][chunk[at + j]] for j in range(quality.WIDTH)])
                    values.append(float(seen @ net.p["filters"][:, f]))
                pooled.append(max(0.0, max(values) + float(net.p["bias"][f])))
            units.append(np.maximum(np.array(pooled) @ net.p["dense"] + net.p["lift"], 0))
        units = np.array(units)
        logit = np.concatenate([units.mean(axis=0), units.max(axis=0)]) @ net.p["out"] + net.p["offset"][0]
        want.append(1 / (1 + math.exp(-logit)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert np.allclose(net.scores(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 3), want, atol=1e-5)


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)] + [(3, "other"), (7, "y" * 900), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    got = training.labelled_sample(docs, labels, "toxic", F.lit(True), 1000, 4000).collect()
    assert 3500 < sum(len(r["text"]) for r in got) <= 4000 and len({r["doc_id"] for r in got}) == len(got) and None not in {r["doc_id"] for r in got}
    again = training.labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), 1000, 4000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def machines() -> list:
    return [toxicity.insults(), *(f(toxicity.PRIOR) for f in (toxicity.threats, toxicity.targets, toxicity.negations, toxicity.reports))]


def brute_grammar(tape: list[str]) -> list[tuple[str, float]]:
    """The five transducers one after another over symbols with weights."""
    now = [(c, 1.0) for c in tape]
    for m in machines():
        out = m.run([c for c, _ in now])
        now = [(c, w * v) for (c, w), (_, v) in zip(out, now, strict=True) if c]
    return now


def test_composition_is_the_transducers_in_a_row():
    rng = random.Random(2)
    composed = toxicity.grammar(toxicity.PRIOR)
    automaton = toxicity.Automaton(toxicity.PRIOR)
    for _ in range(300):
        tape = [rng.choice("oooihtnq") for _ in range(rng.randint(0, 9))] + ["|"]
        want = brute_grammar(tape)
        got = [(c, w) for c, w in composed.run(tape) if c]
        assert [c for c, _ in got] == [c for c, _ in want]
        assert np.allclose([w for _, w in got], [w for _, w in want])
        assert all(math.isclose(w, math.prod(v for k, v in toxicity.PRIOR.items() if toxicity._FACTORS[k] in c)) for c, w in got)
        found, score = automaton.run(np.array([toxicity.SYMBOLS.index(c) for c in tape]), np.ones(len(tape)), np.array([len(tape)]))
        assert math.isclose(score[0], sum(w for _, w in want), abs_tol=1e-12) and found.sum() == len(want)
    reads_nothing = toxicity.Transducer(0, {(0, ""): ("x", 2.0, 1), (1, "o"): ("y", 3.0, 1)})
    writes_nothing = toxicity.Transducer(0, {(0, "a"): ("", 5.0, 1), (1, "a"): ("o", 7.0, 0)})
    both = toxicity.compose(writes_nothing, reads_nothing)
    assert both.arcs[(0, 0), "a"] == ("", 5.0, (1, 0)) and both.arcs[(1, 0), ""] == ("x", 2.0, (1, 1)) and both.arcs[(1, 1), "a"] == ("y", 21.0, (0, 1))


def test_grammar():
    score = lambda tape: sum(w for _, w in brute_grammar([*tape, "|"]))
    assert score("ti") > score("oi") > score("qi") > 0
    assert score("ni") < score("oi") == score("noooi")
    assert score("th") == score("ht") == score("hoot") > score("oh") > 0
    assert score("nth") < score("th") and score("qht") < score("ht") and score("hti") > score("hi")
    assert score("ooo") == 0


def brute_text(lexicon: toxicity.Lexicon, text: str) -> tuple[list[str], float, float]:
    """Classes of the words, sum and maximum of the clauses' scores: by regular expressions and single transducers."""
    kinds = {h: (k, w) for h, k, w in zip(lexicon.hashes.tolist(), lexicon.classes.tolist(), lexicon.weights.tolist(), strict=True)}
    total, most, seen = 0.0, 0.0, []
    for clause in re.split(r"[.!?;:,|()\"\n\r]", text):
        tape, weights = [], []
        for w in re.findall(r"[^\W\d_]*n['’]t(?![^\W\d_])|[^\W\d_]+", clause):
            raw = np.frombuffer(w.lower().encode(), np.uint8)
            _, _, whole, stems = toxicity.token_hashes(raw, np.array([0, len(raw)]))
            kind, weight = kinds.get(int(whole[0]), (toxicity.OTHER, 1.0))
            insults = [kinds[int(h[0])][1] for h in (whole, *stems.values()) if kinds.get(int(h[0]), (0, 0))[0] == toxicity.INSULT]
            kind, weight = (toxicity.INSULT, max(insults)) if insults else (kind, 1.0)
            tape.append(toxicity.SYMBOLS[kind])
            weights.append(weight)
        seen += tape
        steps = toxicity.grammar(lexicon.arcs).run([*tape, "|"])
        score = sum(w * v for (c, w), v in zip(steps, [*weights, 1.0], strict=True) if c)
        total, most = total + score, max(most, score)
    return seen, total, most


def test_text_features_by_brute_force():
    rng = random.Random(9)
    forms = ["grobling", "fiend", "wicht"]
    lexicon = toxicity.Lexicon.of({int(h): 3.0 + k for k, h in enumerate(toxicity._hash_words(forms))})
    pool = ["you", "don't", "isn’t", "cant", "not", "said", "kill", "grobling", "Fiend", "wicht", "l'ami", "l’ami", "été", "one", "two", "three", "four", "'fiend'", "rock'n't", "x"]
    texts = ["", "don't", " ".join(rng.choice(pool) for _ in range(2000))] + [" ".join(rng.choice(pool) + rng.choice(["", "", "", ".", ",", "!"]) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    features, matches = toxicity.text_features(lexicon, toxicity.Automaton(lexicon.arcs), data, offsets)
    for k, t in enumerate(texts):
        seen, total, most = brute_text(lexicon, t)
        assert math.isclose(math.expm1(features[k, 0]), total, abs_tol=1e-9) and math.isclose(features[k, 1], most, abs_tol=1e-9), t
        assert math.isclose(math.expm1(features[k, 3]), seen.count("i"), abs_tol=1e-9)
    assert brute_text(lexicon, "You aren't a fiend")[1] < brute_text(lexicon, "You are a fiend")[1]


def test_arcs_are_fitted():
    """Negated matches that are never toxic lose weight, aimed ones that always are gain."""
    rng = np.random.default_rng(4)
    at = {m: k for k, m in enumerate(toxicity.MATCHES)}
    x, y = np.zeros((900, len(toxicity.MATCHES))), np.zeros(900)
    for i in range(900):
        kind = rng.choice(["I-", "J", "I", "none"])
        if kind != "none":
            x[i, at[kind]] = 3
        y[i] = kind == "J" or (kind == "I" and rng.random() < 0.5)
    w = toxicity.fit_arcs(x, y)
    assert w["negated"] < toxicity.PRIOR["negated"] and w["aimed"] > toxicity.PRIOR["aimed"] and math.isclose(w["idle"], toxicity.PRIOR["idle"], rel_tol=0.05)


# --- decontamination ---------------------------------------------------------------


def test_masks_tolerate_two_substitutions():
    for a in range(13):
        for b in range(a, 13):
            assert any(all((s + j) not in (a, b) for j, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for s in range(13 - len(m) + 1)), (a, b)


def tokens_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return decontaminate.words(data, np.array([0, len(data)]))[0]


def brute_overlaps(text: str | None, items: list[tuple], window: int = 13, min_share: float = 0.8) -> list[tuple]:
    """Every item on every diagonal, a word at a time."""
    t, out = tokens_of(text).tolist(), []
    for ident, item in items:
        w = tokens_of(item).tolist()
        size, best = min(window, len(w)), 0
        need = size if len(w) < 6 else next(n for n in range(size + 1) if n >= min_share * size)
        for d in range(-len(w) + 1, len(t)) if w else ():
            same = [t[i] == w[i - d] for i in range(max(0, d), min(len(t), d + len(w)))]
            best = max([best, *(sum(same[i : i + size]) for i in range(len(same) - size + 1))])
        if size and best >= need:
            out.append((ident, round(best / size, 9)))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0))


def found_overlaps(docs, bench, **more) -> dict:
    rows = decontaminate.decontaminate(docs, bench, **more).collect()
    return {r["doc_id"]: [(x["item_id"], round(x["share"], 9)) for x in r["overlaps"]] for r in rows}


@pytest.mark.parametrize("filter_bytes", [64 << 20, 2])
def test_decontaminate(spark, empty, filter_bytes):
    items = [(i, words(25, 900 + i).replace("ß", "s")) for i in range(5)] + [(5, "short one"), (None, None), (None, words(14, 950)), (6, "same " * 40), (7, ""), (5, "short one")]
    changed = items[1][1].split()
    changed[3] = changed[11] = changed[19] = "other"
    rows = [
        (0, words(80, 1)), (1, f"{words(30, 2)} {items[0][1]} {words(30, 3)}"), (2, f"{words(30, 4)} {' '.join(changed)}"), (3, items[2][1].upper().replace(" ", ", ")),
        (4, None), (5, ""), (6, " ".join(items[3][1].split()[:6])), (7, f"{items[4][1]} {items[0][1]}"), (8, " ".join(reversed(items[1][1].split()))), (9, "a short one"),
        (10, items[7][1]), (11, "same " * 500), (12, items[1][1]), (13, "one short"),
    ]
    docs = spark.createDataFrame([(*r, "o", 5) for r in rows], "doc_id long, text string, overlaps string, k1 int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_overlaps(t, items) for i, t in rows}
    assert found_overlaps(docs, bench, max_filter_bytes=filter_bytes) == want
    assert want[9] == [(5, 1.0), (5, 1.0)] and want[10] == [(None, 1.0)] and want[11] == [(6, 1.0)] and want[2] == [(1, want[2][0][1])] and not want[8]
    kept = decontaminate.decontaminate(docs.withColumnRenamed("overlaps", "own"), bench, keep=("own", "k1"))
    assert {(r["own"], r["k1"]) for r in kept.collect()} == {("o", 5)}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())
    repeated = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (1, "other"), (None, items[0][1])], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in decontaminate.decontaminate(repeated, bench).collect()) == [("1", False), ("1", True), ("1", True), ("None", True)]


def test_items_of_any_length_are_found_at_every_admitted_substitution(spark):
    """All patterns of substitutions that the share admits, for items of 1 to 26 words, against all diagonals."""
    items, rows = [], []
    for n in range(1, 27):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        size = min(n, 13)
        most = 0 if n < 6 else size - decontaminate.least_equal(size, 0.8)
        for gone in itertools.combinations(range(size), most):
            changed = ["x" if i in gone else w for i, w in enumerate(item[:size])]
            rows.append((n, f"a b c {' '.join(changed)} d e f"))
        if most < size:
            rows.append((-n, f"a b c {' '.join(['x'] * (most + 1) + item[most + 1 : size])} d e f"))  # one substitution too many
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, n long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["overlaps"]] for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, (n, text) in enumerate(rows):
        assert got[i] == ([n] if n > 0 else []), (n, text)


def test_decontaminate_against_all_diagonals(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 30)))) for i in range(25)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200)))) for i in range(30)]
    for i in range(30, 60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w[rng.randint(0, 3) :])))
    got = found_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == {i: brute_overlaps(t, items) for i, t in rows}


def test_decontaminate_unspaced_scripts(spark):
    item = "床前明月光,疑是地上霜。举头望明月"
    thai = "ภาษาไทยเป็นภาษาที่มีระดับเสียง"
    bench = spark.createDataFrame([(0, item), (1, thai), (2, "𠀀𠀁𠀂𠀃𠀄𠀅𠀆")], "item_id long, text string")
    rows = [(0, f"前言如下{item.replace(',', '、')}以上"), (1, f"abc{thai}def"), (2, "x𠀀𠀁𠀂𠀃𠀄𠀅𠀆y"), (3, "床前明月"), (4, "完全不同的一段文字没有任何重复"), (5, item.replace("疑", "不"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["overlaps"]] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [], 4: [], 5: [0]}


# --- language model ------------------------------------------------------------------


def test_hmm_base_and_counts(spark, docs, empty):
    held = training.fold(F.col("doc_id"), 5) == 1
    rows = hmm.score_texts(docs, held, rounds=2).collect()
    tokens = {r[0]: [*split(r[1]), None] for r in corpus()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    assert hmm.score_texts(empty, held).count() == 0


def test_hmm_rare_words_are_joined(spark, docs, monkeypatch):
    held = training.fold(F.col("doc_id"), 5) == 1
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in hmm.score_texts(docs, held, rounds=1).collect()}
    monkeypatch.setattr(hmm, "DICTIONARY", 20)
    monkeypatch.setattr(hmm, "TOP", 10)
    got = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in hmm.score_texts(docs, held, rounds=1).collect()}
    assert got == want


def brute_forward(m: hmm.Model, x: list[int]) -> float:
    a = m.start * m.emit[x[0]]
    for s in x[1:]:
        a = (a @ m.move) * m.emit[s]
    return math.log(a.sum())


def test_hmm_likelihood_and_learning():
    rng = np.random.default_rng(1)
    m = hmm.Model.first(rng.random(hmm.SYMBOLS) * 50)
    lens = np.array([1, 7, 30, 2, 30])
    flat = rng.integers(0, hmm.SYMBOLS, lens.sum()).astype(np.int16)
    begin = np.cumsum(lens) - lens
    want = [brute_forward(m, flat[b : b + n].tolist()) for b, n in zip(begin, lens, strict=True)]
    assert np.allclose(hmm.log_likelihood(m, flat, begin, lens), want)
    long = rng.integers(0, hmm.SYMBOLS, 9000).astype(np.int16)
    for piece in (1024, 70, 9000):
        both = np.concatenate([long, flat, long[:5000]])
        got = hmm.log_likelihood(m, both, np.array([0, 9000, 9000 + len(flat)]), np.array([9000, len(flat), 5000]), 4096, piece)
        assert np.allclose(got, [brute_forward_scaled(m, x) for x in (long, flat, long[:5000])], rtol=1e-12)
    sums = hmm.expected_counts(m, flat, begin, lens)
    assert math.isclose(sums[: hmm.STATES].sum(), len(lens)) and math.isclose(sums[hmm.STATES + hmm.STATES**2 : -1].sum(), lens.sum())
    assert math.isclose(sums[hmm.STATES : hmm.STATES + hmm.STATES**2].sum(), lens.sum() - len(lens))
    share = np.full(hmm.SYMBOLS, 1e-9)
    before = hmm.log_likelihood(m, flat, begin, lens).sum()
    assert math.isclose(sums[-1], before)
    for _ in range(3):
        m = hmm.Model.of(hmm.expected_counts(m, flat, begin, lens), share)
        after = hmm.log_likelihood(m, flat, begin, lens).sum()
        assert after > before
        before = after


def brute_forward_scaled(m: hmm.Model, x: np.ndarray) -> float:
    a, total = m.start * m.emit[x[0]], 0.0
    for s in x[1:].tolist():
        total += math.log(a.sum())
        a = (a / a.sum() @ m.move) * m.emit[s]
    return total + math.log(a.sum())


def brute_counts(m: hmm.Model, x: list[int]) -> np.ndarray:
    """Forward-backward over one sequence, a symbol at a time."""
    alpha, beta = [m.start * m.emit[x[0]]], [np.ones(hmm.STATES)]
    for s in x[1:]:
        a = alpha[-1] / alpha[-1].sum()
        alpha.append((a @ m.move) * m.emit[s])
    for s in reversed(x[1:]):
        b = m.move @ (m.emit[s] * beta[-1])
        beta.append(b / b.sum())
    beta.reverse()
    start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.SYMBOLS, hmm.STATES))
    for t, s in enumerate(x):
        g = alpha[t] * beta[t]
        emit[s] += g / g.sum()
        if t:
            xi = alpha[t - 1][:, None] * m.move * (m.emit[s] * beta[t])[None]
            move += xi / xi.sum()
    start += alpha[0] * beta[0] / (alpha[0] * beta[0]).sum()
    return np.concatenate([start, move.ravel(), emit.ravel()])


def test_pieces_do_not_change_the_counts():
    """Long sequences in pieces against one symbol at a time."""
    rng = np.random.default_rng(5)
    m = hmm.Model.first(rng.random(hmm.SYMBOLS) * 50)
    m.move = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    lens = np.array([3, 40, 1, 151, 97, 64])
    flat = rng.integers(0, hmm.SYMBOLS, lens.sum()).astype(np.int16)
    begin = np.cumsum(lens) - lens
    want = sum(brute_counts(m, flat[b : b + n].tolist()) for b, n in zip(begin, lens, strict=True))
    for long, piece, at_once in ((4096, 1024, 500_000), (50, 16, 100), (10, 7, 1), (0, 32, 90), (45, 41, 300)):
        got = hmm.expected_counts(m, flat, begin, lens, long, piece, at_once)
        assert np.allclose(got[:-1], want, atol=1e-10), (long, piece)
        assert math.isclose(got[-1], sum(brute_forward_scaled(m, flat[b : b + n]) for b, n in zip(begin, lens, strict=True)))


def test_sums_come_in_one_job(spark):
    """Vectors of many partitions are added in a number of jobs that does not grow with the partitions."""
    sums = {i: np.random.default_rng(i).random(hmm.SUMS + 1) for i in range(40)}
    rows = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in sums.items()], "slot int, sums binary").repartition(40)
    spark.sparkContext.setJobGroup("sums", "sums")
    try:
        got = hmm._add_up(rows, 32)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sums")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got, sum(sums.values()))


def test_hmm_scores_by_brute_force(spark):
    """Vocabulary, rounds and scores from the words themselves; and the same scores however the rows are partitioned."""
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "xyzuv" for b in ("ing", "ed", "s", "ly")]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "unseen zebra"), (1, "xing"), (62, "Xing " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens long, symbols string")
    held = training.fold(F.col("doc_id"), 5) == 1
    out = [sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in hmm.score_texts(docs.repartition(k), held, rounds=3, settle=0).collect()) for k in (1, 5)]
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(*out, strict=True))
    use = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = Counter(w for _, t in use for w in split(t))
    number = lambda w: int(kernel.signed(kernel.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0])[0])
    rank = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], number(w))))}
    suffix = lambda w: int(hmm.tokens_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0])
    symbols = lambda t: [rank[w] if w in rank else hmm.TOP + suffix(w) for w in split(t)] + [hmm.END]
    seen = np.zeros(hmm.SYMBOLS)
    for w, n in count.items():
        seen[rank[w]] = n
    seen[hmm.END] = len(use)
    m, share = hmm.Model.first(seen), (seen + 0.1) / (seen + 0.1).sum()
    for _ in range(3):
        m = hmm.Model.of(np.append(sum(brute_counts(m, symbols(t)) for _, t in use), 0.0), share)
    for (i, n, score), (j, t) in zip(out[0], sorted(rows, key=lambda r: (r[0], len(split(r[1])) + 1)), strict=False):
        assert i == j and n == len(split(t)) + 1
        inner = sum(math.log10(0.5 / 0.5) for w in split(t) if w not in rank)  # alone in its suffix's symbol, which no training word has
        assert math.isclose(score, brute_forward_scaled(m, np.array(symbols(t))) / math.log(10) + inner, rel_tol=1e-9), i


# --- kernels and scratch ---------------------------------------------------------------


def test_words_and_chunks():
    import pyarrow as pa

    texts = [None, "", "A b\tc", "x", " é  ÉÉ ", "a b c d e f"]
    for limit in (1, 8, 1 << 20):
        got = []
        for _, _, data, offsets in kernel.text_chunks(pa.array(texts), limit):
            starts, ends, rows = kernel.word_bounds(kernel.SPACE[data], offsets)
            raw = bytes(kernel.LOWER[data])
            got += [[raw[starts[k] : ends[k]].decode() for k in range(a, b)] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        assert got == [split(t) for t in texts]


def test_scratch_reads_the_session(spark):
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)


def test_hash_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"] for r in training.hash_sample(rows, "k", 500, 1).collect()}
    assert 400 < len(got) < 600 and got == {r["k"] for r in training.hash_sample(rows.repartition(3), "k", 500, 1).collect()}
    assert training.hash_sample(rows, "k", 5000, 1).count() == 5000


def test_dictionary_has_the_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(hmm, "DICTIONARY", 50)
    counts = spark.createDataFrame([(i, i % 7, max(1, 1000 // (i + 1))) for i in range(1000)], "word long, suffix short, n long")
    v = hmm.vocabulary(counts, 3)
    assert 0 < len(v.hashes) <= 50 and v.counts.min() >= 1000 // 51 and v.distinct == 1001
    assert v.tokens == sum(max(1, 1000 // (i + 1)) for i in range(1000)) + 3
