import gzip
import hashlib

from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, payload string"


def want(pages):
    best, out = {}, []
    for page_id, _, html, *_ in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            best[data] = min(best.get(data, page_id), page_id)
    for page_id, url, html, *_ in pages:
        data = (html or "").encode()
        to = best.get(data)
        revisit = to is not None and page_id is not None and page_id != to
        out.append((page_id, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_archive(spark):
    long = "<p>ünï</p>" * 30
    pages = [(i, f"https://www.h{i % 5}.example.com:80/a/{i % 40}?q={i}#f", long if i % 3 == 0 else f"<p>{i}</p>", "x") for i in range(700)]
    pages += [(900 + i, "http://hot.example.org/", f"hot page {i} " * 20, "x") for i in range(650)]
    pages += [(5001, None, None, "x"), (5002, "", "", "x"), (5003, "no url at all\r\nX: y", long, "x"), (None, "http://ü.example/%20é?a b", long, "x"), (5004, "a://b", "s" * 99, "x"), (5005, "a://b", "s" * 99, "x"), (5004, "a://b", "s" * 99, "x")]
    df = spark.createDataFrame(pages, SCHEMA)
    got = sorted((tuple(r) for r in warc.archive(spark, df).collect()), key=str)
    assert got == want(pages)


def test_lookup_equals_scan(spark):
    pages = [(i, f"http://h{i % 9}.net/{i % 31}", f"text {i} " * 30, "") for i in range(2000)]
    df = spark.createDataFrame(pages, SCHEMA)
    folder = shared_dir(spark, "warc")
    parts = warc.write(df, folder)
    keys = df.where("page_id % 7 = 0").select(warc.url_key(F.col("url")).alias("k"))
    asked = {r.k for r in keys.collect()} | {"missing)/"}
    rows = warc.lookup(spark.createDataFrame([(k,) for k in [*asked, None]], "k string"), parts).collect()
    near = df.withColumn("k", warc.url_key(F.col("url"))).where(F.col("k").isin(*asked)).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in near)
    n = 0
    for part in parts.collect():
        data = gzip.decompress(open(part.warc[len("file://"):], "rb").read())
        n += data.count(b"WARC/1.1\r\n")
        assert part.n == data.count(b"WARC/1.1\r\n")
    assert n == 2000


def test_empty(spark):
    assert warc.archive(spark, spark.createDataFrame([], SCHEMA)).count() == 0
