"""Embedding links against brute force, WARC round trips, and pushdown."""

import gzip
import hashlib

import numpy as np
import pytest

from nodeloom.llm import hnsw, queries, warc
from tests.conftest import SF, same_rows


def brute(rows, threshold=0.93):
    """{key: (links, component)} of (key, vector, label) rows."""
    ok = {}
    for k, v, la in rows:
        if k is None or la is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        u = np.array(v, float)
        ok[k] = (u / np.linalg.norm(u), la)
    links = {k: set() for k, *_ in rows}
    for a in ok:
        for b in ok:
            if a != b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold:
                links[a].add(b)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[k] = (len(links[k]), min(seen) if k is not None else None)
    return out


def test_embeddings_equal_sql(spark, duck):
    same_rows(queries.op1_embedding_near_dedup(spark, SF), duck.sql(queries.ORACLE_SQL["op1_embedding_near_dedup"]))


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 16))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 16)) * rng.choice([0.05, 0.25, 1.0], (n, 1))
    x[: n // 4] = centres[0] + rng.normal(size=(n // 4, 16)) * 0.05  # a group with a quarter of all rows
    return x.astype(np.float32)


def hits(bits, n):
    return [np.flatnonzero(row).tolist() for row in np.unpackbits(bits, axis=1, count=n)]


class NarrowIndex:
    """Finds only the large group of near copies and a query itself until its beam is wide."""

    def __init__(self, x, group):
        self.x, self.group = x, group

    def within(self, q, floor, beam):
        sims = q @ self.x.T
        near = sims >= floor
        return near if beam >= 256 else near & ((np.arange(len(self.x)) < self.group) | (sims > 1 - 1e-6))


@pytest.mark.parametrize("group,pairs,fresh", [(1200, 100, 0), (1200, 100, 800), (0, 1, 998)])
def test_hnsw_audit_counts_queries_with_few_links(group, pairs, fresh):
    """Links of a large group of copies, self hits and blocks (nearly) without links don't hide what is missed."""
    rng = np.random.default_rng(3)
    ends = hnsw.unit(rng.normal(size=(pairs, 64)))
    x = np.concatenate([hnsw.unit(np.eye(1, 64) + rng.normal(size=(group, 64)) * 0.005), ends, hnsw.unit(rng.normal(size=(fresh, 64))), hnsw.unit(ends + rng.normal(size=ends.shape) * 0.005)])
    want = [np.flatnonzero(x @ q >= 0.93).tolist() for q in x]
    found, beam = hnsw.linked_in_shard(NarrowIndex(x, group), x, x, 0.93, 32, 64, 0.999, own=True)
    assert hits(found, len(x)) == want and beam == 256


def test_graph_is_searched_with_the_audited_recall():
    """The graph's own answers, in shards larger than the beam, reach what the audit asks for; the beam that passed is below brute force."""
    for n, seed in ((60, 1), (1500, 2), (5000, 3)):
        x = hnsw.unit(clustered(n, seed))
        index = hnsw.Hnsw(x)
        again = hnsw.Hnsw.of(x, index.parts())
        found, beam = hnsw.linked_in_shard(again, x, x, 0.93, own=True)
        assert beam is not None and beam < 2 * n
        want = x @ x.T >= 0.93
        got = np.unpackbits(found, axis=1, count=n).view(bool)
        assert not (got & ~want).any() and (got & want).sum() >= 0.999 * want.sum()


def test_planted_queries_are_linked():
    x = hnsw.unit(clustered(500))
    q = hnsw.planted(x, 0.93, 200)
    best = (q @ x.T).max(1)
    assert (best >= 0.93 - 1e-12).all() and best.min() < 0.95 and np.allclose(np.linalg.norm(q, axis=1), 1)


@pytest.mark.parametrize("own", [True, False])
def test_links_count_for_both_ends(own):
    """A link found from one end only counts for both."""
    rng = np.random.default_rng(0)
    n, m = 700, 700 if own else 300
    want = rng.random((n, m)) < 0.01
    if own:
        want = np.triu(want, 1)
        want |= want.T
    half = rng.random(want.shape) < 0.5
    there, back = want & half, want.T & ~(half & half.T if own else half.T)
    if own:
        there = want & (np.triu(half) | ~np.triu(np.ones_like(half)) & ~half.T)  # each link from one end
        back = there
    copies = rng.integers(1, 4, n), rng.integers(1, 4, m)
    if own:
        copies = copies[0], copies[0]
    counts, other, parent = hnsw.united(np.packbits(there, axis=1), np.packbits(back, axis=1), own, copies)
    assert (counts == want @ copies[1]).all() and (own or (other == copies[0] @ want).all())
    from tests.llm.test_text_ops import brute_components  # noqa: F401

    label = np.arange(n if own else n + m)
    for u, v in zip(*np.nonzero(want), strict=True):
        a, b = label[u], label[v if own else n + v]
        label[label == max(a, b)] = min(a, b)
    assert (parent == label).all()


@pytest.mark.parametrize("least_shards,capacity,most_values", [(1, 100_000, 1 << 24), (4, 150, 1 << 24), (1, 100_000, 16 * 100)])
def test_hnsw_recall(spark, least_shards, capacity, most_values):
    x = clustered(900)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, least_shards=least_shards, capacity=capacity, most_values=most_values, task_vectors=200).collect()}
    want = brute([(i, [float(c) for c in v], la) for i, v, la in rows])
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) <= links and sum(n for n, _ in got.values()) >= 0.999 * links
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_audit_widens_to_brute_force():
    x = hnsw.unit(clustered(400))
    index = hnsw.Hnsw(x)
    index.base[:] = -1  # a graph without edges finds nothing: the audit must notice
    found, beam = hnsw.linked_in_shard(index, x, x[:50], 0.93, 8, 16, 0.98)
    assert beam is None and hits(found, len(x)) == [np.flatnonzero(x @ q >= 0.93).tolist() for q in x[:50]]


def test_one_key_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (0, [0.02, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == [(0, 2, 0), (1, 1, 1), (1, 2, 0), (2, 1, 1), (3, 2, 0)]


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [2.0, 0.0], 2), (None, [1.0, 0.0], 1), (13, [1e300, 0.0], 2)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rep int, hash string")
    got = hnsw.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[3] == (2, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 11):
        assert by[k] == (0, k, True)
    assert by[12] == (1, 12, True) and by[13] == (1, 12, False) and by[None] == (0, None, False)
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_warc_equals_sql(spark, duck):
    same_rows(queries.op10_warc(spark, SF), duck.sql(queries.ORACLE_SQL["op10_warc"]))


def test_warc_odd_rows(spark, tmp_path):
    page = "<p>" + "é" * 200
    rows = [(3, "u3", page, 1), (1, "u1", page, 1), (1, "u1", page, 1), (None, "u0", page, 1), (4, None, None, None), (5, "u\r\n5", "", 1), (6, "u6", "short", 1), (7, "u7", "short", 1), (8, "u8", "x" * 3_000_000, 1), (9, "u9", "a\r\n\r\nb" * 30, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    path = f"file://{tmp_path}/arc"
    warc.write_pages(pages.repartition(3), path)
    back = warc.read_pages(spark, path)
    got = [(r.page_id or -1, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in back.collect()]
    want = [(3, "revisit", 1, None), (1, "response", None, page), (1, "response", None, page), (-1, "revisit", 1, None), (4, "response", None, ""), (5, "response", None, ""), (6, "response", None, "short"), (7, "response", None, "short"), (8, "response", None, "x" * 3_000_000), (9, "response", None, "a\r\n\r\nb" * 30)]
    assert sorted(got, key=str) == sorted(want, key=str)
    told = {r.page_id: r.told_digest for r in back.collect()}
    assert told[3] == hashlib.sha256(page.encode()).hexdigest()
    # Standard tools read the files: one gzip stream of plain records.
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "arc").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 10 and not list((tmp_path / "arc").glob("_uncommitted*"))
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_pushdown_and_headers_only(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/p{i}", f"<p>{i % 5}" + "z" * 500) for i in range(30)], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/arc"
    warc.write_pages(pages, path)
    load = lambda: spark.read.format("warc").option("path", path).option("partitionBytes", "1").load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    few = spark.read.format("warc").option("path", path).option("partitionBytes", "1").option("pushdown", "true").load().where("warc_type = 'revisit' and target_uri like 'http://h1/%'")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "Filter (" not in plan and few.count() == sum(i % 3 == 1 for i in range(5, 30))
    n = few.count()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    heads = spark.read.format("warc").option("path", path).option("payload", "false").load()
    assert heads.where("payload is null").count() == 30 and heads.agg({"content_length": "sum"}).first()[0] > 0
    assert load().where("record_id = '<urn:page:3>'").first().http_headers.startswith("HTTP/1.1 200")
    # The same predicates by option; frames may be used again and joined.
    again, first = warc.records(spark, path, warc_type="revisit", target_uri={"startsWith": "http://h1/"}), warc.records(spark, path, payload=False, warc_type=["response"])
    assert again.count() == n and first.count() == 5 and again.unionByName(first).count() == n + 5 and again.count() == n
    assert warc.records(spark, path, record_id={"endsWith": ":3>"}, warc_date={"contains": "1970"}).count() == 1
    with pytest.raises(ValueError):
        warc.records(spark, path, payload_digest="x")


def test_plain_and_foreign_archives(spark, tmp_path):
    record = lambda kind, body: warc.header_block(kind, {"WARC-Record-ID": "<urn:x>", "WARC-Date": warc.EPOCH}, len(body)) + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record("warcinfo", b"software: x") + record("resource", b"payload one") + record("resource", b""))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("resource", b"two" * 90_000)) + gzip.compress(record("metadata", b"three")))
    got = spark.read.format("warc").option("path", f"file://{tmp_path}").load() if warc.register(spark) is None else None
    assert sorted((r.warc_type, len(r.payload)) for r in got.collect()) == [("metadata", 5), ("resource", 0), ("resource", 11), ("resource", 270_000), ("warcinfo", 11)]
    assert got.where("warc_type = 'metadata'").first().payload == bytearray(b"three")


def _record(kind, body, more=None):
    return warc.header_block(kind, {"WARC-Record-ID": "<urn:x>", "WARC-Date": warc.EPOCH, **(more or {})}, len(body)) + body + b"\r\n\r\n"


def test_many_records_in_one_member_and_empty_members(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "sub").mkdir()
    three = [_record("resource", b"one"), _record("metadata", b"two" * 100_000), _record("resource", b"three")]
    (tmp_path / "sub" / "a.warc.gz").write_bytes(gzip.compress(b"".join(three)))
    # A record that goes over two members, empty members, and padding at the end.
    split = _record("resource", b"four" * 50_000)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"") + gzip.compress(split[:1000]) + gzip.compress(split[1000:]) + gzip.compress(b"") + gzip.compress(_record("resource", b"five")) + b"\0" * 512)
    # Two records in a member that tells its lengths.
    (tmp_path / "c.warc.gz").write_bytes(warc.gzip_member(_record("metadata", b"six" * 70_000) + _record("resource", b"seven"), 3) + warc.gzip_member(_record("metadata", b"eight"), 3))
    got = spark.read.format("warc").option("path", f"file://{tmp_path}").load()
    want = [("metadata", 5), ("metadata", 210_000), ("metadata", 300_000), ("resource", 3), ("resource", 4), ("resource", 5), ("resource", 5), ("resource", 200_000)]
    assert sorted((r.warc_type, len(r.payload)) for r in got.collect()) == want
    assert sorted(bytes(r.payload) for r in got.where("warc_type = 'resource'").collect()) == [b"five", b"four" * 50_000, b"one", b"seven", b"three"]
    heads = spark.read.format("warc").option("path", f"file://{tmp_path}").option("payload", "false").load()
    assert heads.count() == 8 and heads.where("warc_type = 'metadata'").count() == 3


def test_header_names_have_no_case(spark, tmp_path):
    warc.register(spark)
    body = b"lower case"
    head = f"WARC/1.0\r\nwarc-type: resource\r\nWARC-RECORD-ID: <urn:y>\r\ncontent-length: {len(body)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + body + b"\r\n\r\n" + _record("metadata", b"next"))
    got = spark.read.format("warc").option("path", f"file://{tmp_path}").load()
    r = got.where("warc_type = 'resource' and record_id = '<urn:y>'").first()
    assert bytes(r.payload) == body and r.content_length == len(body) and r.headers["warc-type"] == "resource" and got.count() == 2


def test_page_ids_that_are_no_integers(spark):
    pages = spark.createDataFrame([("a", "u", "x" * 200), ("b", "u", "x" * 200), ("3", "u", "short")], "page_id string, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=str)
    assert got == [(3, "response", None), (None, "response", None), (None, "revisit", None)]


def test_cut_off_archives_raise(spark, tmp_path):
    warc.register(spark)
    whole = gzip.compress(_record("resource", b"x" * 1000))
    (tmp_path / "a.warc.gz").write_bytes(whole[:-30])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("warc").option("path", f"file://{tmp_path}").load().collect()


def test_every_vector_is_led_to():
    """Choosing diverse neighbours leaves some vectors without an in-link; each gets one, so a narrow beam finds whole groups."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(1, 24))
    x = hnsw.unit(np.concatenate([centre + 0.04 * rng.normal(size=(420, 24)), rng.normal(size=(300, 24))])[rng.permutation(720)])
    index = hnsw.Hnsw(x.astype(np.float32))
    led_to = np.unique(index.base[index.base >= 0])
    assert len(led_to) == len(x)
    again = hnsw.Hnsw.of(x.astype(np.float32), index.parts())
    bits, beam = hnsw.linked_in_shard(again, x, x, 0.93, own=True)
    found = np.unpackbits(bits, axis=1, count=len(x)).astype(bool)
    assert beam is not None and beam <= 64 and not (found & (x @ x.T < 0.93)).any() and found.sum() >= 0.999 * (x @ x.T >= 0.93).sum()
    one = hnsw.Hnsw(x[:1].astype(np.float32))
    assert one.base.max() == -1
