"""The paged source against the table behind it, and its refusals."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from folioloom.sources import paged


@pytest.fixture
def server():
    """Serves .rows in pages; .fails answers come first; .counted says whether Content-Range is sent."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            if host.fails:
                host.fails -= 1
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            rows = host.rows[asked["offset"] : asked["offset"] + min(asked["limit"], host.most)]
            host.asked.append(asked["offset"])
            self.send_response(200)
            if host.counted:
                self.send_header("Content-Range", f"0-9/{len(host.rows)}")
            self.end_headers()
            self.wfile.write(json.dumps(rows).encode())

        def log_message(self, *_):
            pass

    host = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    host.rows, host.fails, host.counted, host.most, host.asked = [{"id": k, "name": f"n{k}", "more": [k]} for k in range(47)], 0, False, 1000, []
    threading.Thread(target=host.serve_forever, daemon=True).start()
    yield host
    host.shutdown()


def url(server):
    return f"http://127.0.0.1:{server.server_address[1]}/rows"


@pytest.mark.parametrize("rows", [0, 1, 999, 1000, 1001, 2500])
def test_parquet_pages(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    spark.range(rows).selectExpr("id", "id * 2 as twice", "cast(null as string) as none").coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    found = paged.scan(spark, "id", path=path, pageRows=1000, pageColumn="page")
    assert sorted((r.id, r.twice, r.page) for r in found.collect()) == [(k, 2 * k, k // 1000) for k in range(rows)]


def test_a_partition_a_page(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(2500).coalesce(1).write.parquet(path)
    assert paged.scan(spark, path=path).rdd.getNumPartitions() == 3
    assert paged.scan(spark, path=path, pageRows=2500).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("counted", [True, False])
@pytest.mark.parametrize("size", [10, 47, 48])
def test_http_pages(spark, server, counted, size):
    server.counted, server.fails = counted, 2
    found = paged.scan(spark, "id", "id long, name string", url=url(server), pageRows=size, readers=3)
    assert sorted(map(tuple, found.collect())) == [(k, f"n{k}") for k in range(47)]


def test_readers_end_on_a_short_page(spark, server):
    assert paged.scan(spark, None, "id long", url=url(server), pageRows=10, readers=2).count() == 47
    assert max(server.asked) == 50  # the page after the short one of the other reader, and none beyond


def test_repeated_keys_are_refused(spark, server):
    server.rows = server.rows + [{"id": 5, "name": "again"}]
    with pytest.raises(Exception, match="id 5 repeats"):
        paged.scan(spark, "id", "id long, name string", url=url(server), pageRows=10).collect()
    server.rows = [{"id": 1}, {"id": 1}]
    with pytest.raises(Exception, match="repeats within page 0"):
        paged.scan(spark, "id", "id long", url=url(server), pageRows=10).collect()
    server.rows = [{"id": None, "name": str(k)} for k in range(30)] + [{"id": 1, "name": "x"}]
    assert paged.scan(spark, "id", "id long, name string", url=url(server), pageRows=7).count() == 31


def test_a_table_that_changed_is_refused(spark, server):
    server.counted, server.most = True, 7
    with pytest.raises(Exception, match="changed during the scan"):
        paged.scan(spark, "id", "id long", url=url(server), pageRows=10).collect()


def test_waits(server, monkeypatch):
    waits = []
    monkeypatch.setattr(paged.time, "sleep", waits.append)
    server.fails = 3
    assert len(paged.HttpPages(url(server))._get(5, 0)[0]) == 5
    assert waits == [0, 0, 0]
    server.shutdown()
    server.server_close()
    with pytest.raises(OSError):
        paged.HttpPages(url(server))._get(5, 0)
    assert waits[3:] == [0.5, 1, 2, 4]
