"""Archives by exact round trip, URL filters against their SQL and by hand."""

import base64
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from relscope.llm import url_filters, warc

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [
    (1, "http://a.example.com/en/x?q#f", "<p>WARC/1.0\r\n\r\nContent-Length: 9\r\n</p>", "x"),
    (2, "https://WWW.Example.com/en/", "same é", "x"),
    (3, None, "same é", "x"),
    (4, "no scheme", None, "x"),
    (5, "http://n.net/es/1\r\nWARC-Type: x", "", "x"),
    (6, "http://n.net/de/1", '<a href="http://bad.org/">', "x"),
    (7, "http://n.net/fr/", "same é", "x"),
    (8, "http://bad.org/q", "<a HREF='//N.net/x'><a href=https://good.com/>", "x"),
    (9, "http://bad.org", "long" * 90_000, "x"),
    (None, "://", "same é", "x"),
]


def test_archives_round_trip(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op3_warc(spark, str(tmp_path)).collect()}
    last = {}
    for i, _, html, _ in ROWS:
        last[html or ""] = max(last.get(html or "", -1), i if i is not None else -1)
    for i, _, html, _ in ROWS:
        data = (html or "").encode()
        first = last[html or ""] == i
        assert tuple(got[i]) == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[html or ""])


def test_filters_are_pushed_down_and_payloads_left_alone(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(2), path, 1)
    some = warc.read(spark, path).where("record_type = 'response' AND page_id IN (4, 5, 7, 9)")
    got = {r.page_id: bytes(r.payload).decode() for r in some.collect()}
    assert got == {4: "", 5: "", 7: "same é", 9: "long" * 90_000}
    heads = warc.read(spark, path, payload=False)
    assert "payload" not in heads.columns and heads.count() == len(ROWS)
    assert heads.where("target_uri LIKE 'http://n.net/%'").count() == 3
    reader = warc.Reader({"path": path})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(kept) == 1 and len(reader.filters) == 1
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"), lambda r: True, True))


def test_the_query_reads_revisits_by_their_headers(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(2), path)
    plan = warc.read_back(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "record_type" in plan
    # What the source takes over, Spark doesn't compare again.
    assert "= response" not in plan and "= revisit" not in plan
    assert warc.read_back(spark, path).where("record_type = 'revisit'").count() == sum(r.record_type == "revisit" for r in warc.read_back(spark, path).collect()) > 2


def test_a_host_with_very_many_pages_is_split(spark, monkeypatch):
    rows = [(i, f"http://big.net/{i}", "", "x") for i in range(300)] + [(1000 + i, None, None, "x") for i in range(100)] + [(2000, "http://a.example.com/en/", "", "x"), (None, "http://big.net/fr/", "", "x")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(tuple, url_filters.judged(pages).collect()), key=str)
    monkeypatch.setattr(url_filters.graphs, "PART", 20)
    monkeypatch.setattr(url_filters.graphs.parts, "__defaults__", (20,))
    assert sorted(map(tuple, url_filters.judged(pages).collect()), key=str) == want and len(want) == len(rows)


def test_records_are_gzip_members_of_bounded_archives(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{tmp_path}/w", most=4)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 3
    alone = []
    for file in files:
        data = file.read_bytes()
        assert data.endswith(warc.GAP.encode("latin-1"))
        while data:
            member = zlib.decompressobj(31)
            text = member.decompress(data)
            data = member.unused_data
            alone += list(warc.records(io.BytesIO(text), lambda r: True, True)) if text else []
            assert text == b"" or text.startswith(b"WARC/1.0\r\n") and text.endswith(b"\r\n\r\n")
    assert len(alone) == len(ROWS)
    assert sorted(map(str, alone)) == sorted(str(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    plain = tmp_path / "plain.warc"
    plain.write_bytes(b"".join(gzip.decompress(f.read_bytes()) for f in files))
    assert warc.read(spark, f"file://{plain}", payload=False).count() == len(ROWS)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op3_warc(spark, str(tmp_path)).collect() == []
    assert url_filters.op6_url_filters(spark, str(tmp_path)).collect() == []


def test_url_filters_match_their_sql(spark, tmp_path):
    rows = ROWS + [(k, f"http://h{k % 7}.org/{k}", "".join(f'<a href="http://h{(k * j) % 7}.org">' for j in range(3)) + '<a href="http://n.net/">', "x") for k in range(20, 60)]
    rows += [(70 + k, "http://n.net/es/2", "<a href='http://h3.org'>", "x") for k in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in url_filters.op6_url_filters(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(url_filters.oracle()).fetchall(), key=str)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by[3] == ("", "", None, "allow") == by[4]
    assert by[6][3] == "block" and by[7][2] == "net/fr/" and by[9][:3] == ("bad.org", "", None)


def test_a_farm_of_links_to_blocked_hosts_is_blocked(spark):
    rows = [(k, f"http://s{k % 10}.net/es/{k}", "", "x") for k in range(30)]
    rows += [(100 + k, f"http://farm.org/{k}", "<a href='http://s1.net/'> <a href='http://s2.net/'>", "x") for k in range(400)]
    rows += [(600 + k, f"http://good.com/{k}", "<a href='http://fine.org/'>", "x") for k in range(5)]
    rows += [(700, "http://fine.org/a", None, "x"), (701, "http://alone.org/b", "", "x"), (702, None, None, "x"), (100, "http://farm.org/0", "", "x")]
    got = {}
    for r in url_filters.judged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.page_id, []).append((r.rule, r.verdict))
    assert len(got[100]) == 2 and all(v == (None, "block") for k in range(100, 500) for v in got[k])
    assert got[0] == [("net/es/", "block")] and got[600] == [("com/", "allow")]
    assert got[700] == got[701] == got[702] == [(None, "allow")]


def test_ranks_are_those_of_plain_iteration(spark, monkeypatch):
    import numpy as np

    from relscope.llm import graphs

    monkeypatch.setattr(graphs.parts, "__defaults__", (2,))
    rng = np.random.default_rng(3)
    hosts = [f"h{k}" for k in range(12)]
    pairs = {(hosts[a], hosts[b]): int(rng.integers(1, 5)) for a, b in rng.integers(0, 12, (30, 2)) if a != b}
    out = {h: sum(n for (s, _), n in pairs.items() if s == h) for h in hosts}
    seeds = [(h, int(rng.integers(0, 3)), int(rng.integers(0, 3))) for h in hosts[:9]]
    edges = spark.createDataFrame([(s, d, n / out[s], n) for (s, d), n in pairs.items()], "src string, dst string, share double, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_filters.propagated(spark.createDataFrame(seeds, "host string, good long, bad long"), edges).collect()}
    names = sorted(got)
    forth = np.zeros((len(names), len(names)))
    for (s, d), n in pairs.items():
        forth[names.index(d), names.index(s)] = n
    back = forth.T.copy()
    for m in (forth, back):
        for k in range(len(names)):
            m[:, k] = m[:, k] / m[:, k].sum() if m[:, k].any() else np.eye(len(names))[k]
    for at, m in ((0, forth), (1, back)):
        seed = np.array([dict((h, v) for h, *v in seeds).get(h, (0, 0))[at] for h in names], float)
        seed /= seed.sum()
        limit = np.linalg.solve(np.eye(len(names)) - 0.85 * m, 0.15 * seed)
        assert np.abs(np.array([got[h][at] for h in names]) - limit).sum() <= url_filters.TOLERANCE
