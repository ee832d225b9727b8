"""A paged source that breaks and grows, the queue in batches, and late log rows."""

import datetime as dt
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from wikilake.sources.paged import Paged
from wikilake.streaming import queue, windows


def write(folder, n, size=5, broken=None):
    for page in range(-(-n // size)):
        items = [{"_id": k, "title": f"t{k}", "link": None, "tags": ["x"]} for k in range(page * size, min(n, (page + 1) * size))]
        (folder / f"{page}.json").write_text("{" if page == broken else json.dumps({"count": n, "items": items}))


def test_a_stream_of_pages_gives_each_item_once(spark, tmp_path):
    spark.dataSource.register(Paged)
    pages = tmp_path / "pages"
    pages.mkdir()

    def run():
        rows = spark.readStream.format("paged").option("url", f"{pages}/{{page}}.json").option("pageSize", 5).load()
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.bookmark_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write(pages, 8)
    assert run() == list(range(8))
    write(pages, 23, broken=3)
    with pytest.raises(Exception):  # noqa: B017
        run()
    write(pages, 23)  # mended: the stream goes on where it stood, in the middle of page 1
    assert run() == list(range(23))
    assert run() == list(range(23))
    write(pages, 24)
    assert run() == list(range(24))


def test_pages_in_batch(spark, tmp_path):
    spark.dataSource.register(Paged)
    read = lambda: spark.read.format("paged").option("url", f"file://{tmp_path}/{{page}}.json").option("pageSize", 5).load()
    assert read().count() == 0
    write(tmp_path, 12)
    assert sorted(r.bookmark_id for r in read().collect()) == list(range(12)) and read().rdd.getNumPartitions() == 3
    (tmp_path / "1.json").write_text(json.dumps({"count": 12, "items": [{"_id": 5}]}))
    with pytest.raises(Exception, match="page 1 has 1 items, 5 were to come"):
        read().collect()
    for page in range(3):  # a source that doesn't count
        (tmp_path / f"{page}.json").write_text(json.dumps({"items": [{"_id": page * 5 + k} for k in range(5 if page < 2 else 1)]}))
    assert sorted(r.bookmark_id for r in read().collect()) == list(range(11))


def test_pages_over_http(spark, tmp_path):
    spark.dataSource.register(Paged)
    (tmp_path / "token").write_text("secret\n")
    failed = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = int(self.path.rpartition("=")[2])
            if self.headers["Authorization"] != "Bearer secret" or page == 1 and page not in failed and not failed.add(page):
                return self.send_error(503)
            body = json.dumps({"count": 7, "items": [{"_id": k, "collection": {"$id": 3}} for k in range(page * 5, min(7, page * 5 + 5))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/items?page={{page}}").option("pageSize", 5).option("tokenFile", f"{tmp_path}/token").load()
    assert sorted((r.bookmark_id, r.collection_id) for r in rows.collect()) == [(k, 3) for k in range(7)]
    server.shutdown()


def test_queue_in_two_batches_equals_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(6), k, rng.choice([*queue.LEADS_TO, "start", "what"])) for k in range(200)]
    frame = spark.createDataFrame(rows, "id long, seq long, command string")
    state, want = {}, []
    for i, k, c in rows:
        before = state.get(i)
        why = queue.verdict(before, c)
        state[i] = before if why else queue.LEADS_TO[c]
        want.append((i, k, c, before, why is None, state[i], why))
    assert sorted(map(tuple, queue.answered(frame).collect()), key=lambda r: r[1]) == want
    assert {r[6] for r in want} == {None, queue.EXISTS, queue.MISSING, queue.FINISHED, queue.UNKNOWN}
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, queue.PROVIDER)
    try:
        for k, part in enumerate((frame.where("seq < 90"), frame.where("seq >= 90"))):
            part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in/*")
            queue.replayed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r[1]) == want


def test_late_and_repeated_log_rows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(1), "a", "ok"), (at(1), "a", "ok"), (at(2), "a", "ok")], [(at(1, 30), "b", "ok"), (at(2), "a", "ok"), (at(9), "c", "no")], [(at(2, 30), "d", "late"), (at(9), "c", "no"), (at(8, 30), "e", "ok")]]
    kind = "ts timestamp, slug string, outcome string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = windows.logged_once(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    log = spark.createDataFrame([(k, *r) for k, rows in enumerate(batches) for r in rows], f"batch int, {kind}")
    want = windows.lateness(log).where(~F.col("late")).select("ts", "slug", "outcome").distinct()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))
    assert {r.slug for r in want.collect()} == {"a", "b", "c", "e"}
