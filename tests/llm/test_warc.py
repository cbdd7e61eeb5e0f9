import hashlib

from pyspark.sql import functions as F

from tidemark.llm import warc as W

NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute_force(rows):
    payloads = [(p, (h or "").encode()) for p, h in rows]
    first = {}
    for page_id, payload in payloads:
        if page_id is not None and len(payload) >= 100:
            first[payload] = min(page_id, first.get(payload, page_id))
    out = []
    for page_id, payload in payloads:
        target = first.get(payload)
        again = target is not None and target != page_id
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response",
                    target if again else None))
    return sorted(out, key=repr)


def read_back(index):
    return sorted((tuple(r) for r in W.read_archive(index).select(*NAMES).collect()), key=repr)


def test_pages_come_back(pages):
    assert read_back(W.archive(pages)) == brute_force([tuple(r) for r in pages.select("page_id", "html").collect()])


def test_odd_pages(spark):
    copy = "<p>" + "ä" * 80 + "</p>"
    rows = [
        (5, "http://a.org/x y\r\n?q=ü", copy, "z"), (3, "http://b.org/", copy, None), (3, "http://b.org/", copy, None),
        (None, None, copy, None), (None, "no scheme", "x" * 200, None), (None, "", "x" * 200, None),
        (7, "http://c.org", "short", None), (8, "http://c.org", "short", None), (9, None, None, None), (10, "u", "", None),
        (2**60 + 1, "http://d.org", "\r\n\r\nWARC/1.1\r\n\r\n" * 30, None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, offset string").repartition(4)
    index = W.archive(frame)
    assert read_back(index) == brute_force([(r[0], r[2]) for r in rows])
    texts = W.read_archive(index).filter("page_id = 3").select("payload").collect()
    assert [bytes(r[0]).decode() for r in texts] == [copy, copy]
    assert W.archive(frame.limit(0)).all_captures().count() == 0


def test_index_is_sorted_and_look_ups_find_all_captures(spark, pages):
    many = pages.union(pages.withColumn("page_id", F.col("page_id") + 1000))
    captures = W.write_archives(many, W.new_folder(spark, "test"))
    index = W.build_index(captures.repartition(5), block_captures=7)
    blocks = index.directory().orderBy("part", "block").collect()
    assert len(blocks) >= 100 // 7 and sum(b["n"] for b in blocks) == 100
    keys = [x for b in blocks for x in (b["first_key"], b["last_key"])]
    assert keys == sorted(keys)
    urls = [r[0] for r in pages.select("url").orderBy("page_id").limit(9).collect()]
    found = W.read_urls(spark, index, [*urls, "http://absent.example/none"])
    wanted = many.filter(F.col("url").isin(urls)).select("page_id", "url").collect()
    assert sorted(map(tuple, found.select("page_id", "url").collect())) == sorted(map(tuple, wanted))
    assert index.look_up([]).count() == 0


def test_url_keys(spark):
    rows = spark.createDataFrame([("HTTP://Www.Example.com:80/A?b#c",), ("x",), (None,)], "url string")
    assert [r[0] for r in rows.select(W.url_key(F.col("url"))).collect()] == ["com:80,example,www)/A?b#c", "x)", ")"]
