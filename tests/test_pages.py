"""Page access, the page cache, streams that stop and go on."""

import pytest
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import images, pages
from leafloom.sources.pagecache import PageCache
from leafloom.streaming import progress


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, page bigint, text string")


ROWS = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_page_access(spark):
    p = frame(spark, ROWS)
    assert sorted((r.doc_id, r.position, r.page) for r in pages.select_pages(p, [2, 1, 2, 9]).collect()) == [(1, 0, 2), (1, 1, 1), (1, 2, 2), (2, 1, 1)]
    asked = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (1, None)], "doc_id bigint, page bigint")
    assert {(r.doc_id, r.page, r.problem is None) for r in pages.bounds(asked, p).collect()} == {(1, 2, True), (2, 2, False), (3, 1, False), (1, None, False)}
    with pytest.raises(Exception, match="page 2 is not within 1 to 1"):
        pages.checked(asked, p).collect()
    assert pages.checked(asked.limit(1), p).count() == 1
    one = lambda text, page: spark.range(1).select(T.page_by_marker(F.lit(text), F.lit(page)).alias("t")).first().t
    assert one("--- PAGE 1 ---\nx\n--- PAGE 2 ---\ny", 2) == "\ny" and one("a\nb\nc\nd", 2) == "c\nd" and one("PAGE 7 z", 2) == "" and one("PAGE 3", 3) == ""


def test_page_cache(spark):
    cache = PageCache(spark)
    assert cache.stats().first().documents == 0
    make = lambda rows: spark.createDataFrame(rows, "key string, page bigint, body string")
    cache.write(make([("aa1", 1, "x"), ("aa1", 2, "yy"), ("bb2", 1, "z")]))
    cache.write(make([("aa1", 1, "new")]))
    assert [(r.page, r.body) for r in cache.read("aa1").collect()] == [(1, "new")] and cache.read("bb2", 2).count() == 0
    assert tuple(cache.stats().first()) == (2, 2, 4)
    cache.clear(make([("bb2", 1, "")]).select("key"))
    assert [r.key for r in cache.info().collect()] == ["aa1"]
    cache.clear()
    assert cache.stats().first().pages == 0


def test_stream_stops_and_goes_on(spark, tmp_path):
    """A stream that ended reads only what came later when it is started again from its checkpoint."""
    folder = str(tmp_path / "in")
    frame(spark, ROWS[:2]).withColumn("total_pages", F.lit(2).cast("bigint")).select("doc_id", "page", "total_pages", "text").write.parquet(folder)
    seen: dict[str, list[int]] = {"start": [], "complete": []}
    calls = {k: (lambda rows, k=k: seen[k].append(rows.count())) for k in seen}

    def run():
        made = progress.events(progress.read_pages(spark, folder))
        write = lambda batch, n: [calls[k](batch.filter(F.col("event") == k)) for k in calls]
        q = made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    stats = progress.query_stats(run())
    assert stats["rows"] == 2 and not stats["is_active"] and sum(seen["complete"]) == 1
    frame(spark, ROWS[2:]).withColumn("total_pages", F.lit(1).cast("bigint")).select("doc_id", "page", "total_pages", "text").write.mode("append").parquet(folder)
    run()
    assert sum(seen["start"]) == 2 and sum(seen["complete"]) == 2
    assert progress.wants_stream(200 << 20) and not progress.wants_stream(10, 20)


def test_sizes_and_references(spark):
    x = spark.createDataFrame([(1, 1, "7", None), (1, 1, "8", "f.png")], "doc_id bigint, page bigint, id string, filename string").withColumn("ord", F.col("id").cast("int"))
    made = images.insert_prefixed(frame(spark, [(1, 1, "title\nbody"), (1, 2, "")]), x).orderBy("page").collect()
    assert [r.text for r in made] == ["title\n[IMG:img_7] img_p1_7.jpg\n[IMG:img_8] f.png\nbody", ""]
    sizes = [r.t for r in spark.createDataFrame([(12,), (1536,), (3 << 20,)], "n bigint").select(T.byte_size(F.col("n")).alias("t")).collect()]
    assert sizes == ["12 B", "1.5 KB", "3.0 MB"]


def test_events_of_a_group_take_no_pandas_steps(monkeypatch):
    """Pages of several frames in any order, images unknown; a document costs no joining and sorting of frames."""
    import pandas as pd

    class State:
        exists, removed = False, False

        def remove(self):
            self.removed = True

    def refuse(*a, **k):
        raise AssertionError("a pandas step for each document")

    monkeypatch.setattr(pd, "concat", refuse)
    monkeypatch.setattr(pd.DataFrame, "sort_values", refuse)
    frame = lambda page, images, error: pd.DataFrame({"doc_id": [1], "page": [page], "total_pages": [2], "text": ["ab"], "images": [images], "error": [error]})
    state = State()
    made = next(progress._events(9, True)((1,), iter([frame(2, None, "torn"), frame(1, 1.0, None)]), state))
    assert state.removed and list(made.event) == ["start", "page", "image", "error", "progress", "complete"]
    assert list(made.characters) == [0, 2, 2, 2, 2, 2] and list(made.image.dropna()) == [1] and made.message[3] == "torn"
