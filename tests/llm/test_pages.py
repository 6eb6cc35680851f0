"""Archives and URL verdicts."""

from __future__ import annotations

import hashlib
import re

import pytest

from marketframe.functions.storage import new_table
from marketframe.llm import url_filter, warc
from marketframe.llm.batches import text_bytes

MAGIC = "WARC/1.1\r\n"
INNER = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
LONG = "x" * 1200
PAGES = [
    (1, "http://a/", LONG), (2, None, LONG), (3, "u\r\nWARC-Type: evil", "short"), (4, "http://a/", None), (5, "b", ""),
    (6, "c", INNER * 3 + "tail"), (7, "d", MAGIC * 50), (8, "d", "é" * 700 + MAGIC), (None, "e", LONG), (9, "http://a/", LONG),
    (10, "z", "end\r\n\r\n"), (11, "z", "\r\n\r\n" + INNER), (11, "z", "q"), (12, "z", "y" * 999), (13, "z", "y" * 999),
    *[(100 + i, "k", f"p{i}" + INNER * (i % 3)) for i in range(40)], (300, "k", INNER * 400),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")


def stored(spark, df):
    path = new_table(spark)
    warc.write_archives(df.select("page_id", "url", text_bytes("html").alias("payload")), path)
    return path


def wanted(rows):
    out = []
    for k, _, html in rows:
        raw = (html or "").encode()
        last = max((i for i, _, h in rows if h == html and i is not None), default=None)
        refers = last if len(raw) >= warc.LEAST_REVISIT and k is not None and k != last else None
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["700b", "128m"])
def test_archives_give_back_every_page_and_no_embedded_record(spark, split):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((tuple(r) for r in warc.read_archives(spark, stored(spark, pages(spark).repartition(3))).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == wanted(PAGES)


def test_files_are_valid_records_one_after_the_other(spark):
    files = spark.read.format("binaryFile").load(stored(spark, pages(spark))).select("content").collect()
    n = 0
    for f in files:
        data, at = bytes(f.content), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(MAGIC.encode()) and len(re.findall(rb"^WARC-Type:", head, re.M)) == 1
            length = int(re.search(rb"^Content-Length: (\d+)", head, re.M).group(1))
            at += len(head) + 4 + length
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            n += 1
    assert n == len(PAGES)


def test_a_file_without_a_record_at_its_start_has_none(spark, tmp_path):
    (tmp_path / "odd.warc").write_text("noise " + INNER)
    assert warc.read_archives(spark, str(tmp_path)).count() == 0
    assert warc.read_archives(spark, stored(spark, pages(spark, PAGES[:1]).limit(0))).count() == 0


URLS = [
    (1, "https://WWW.Example.COM/en/x?utm_source=a&b=1#top"), (2, "http://blog.example.com/en/"), (3, "http://example.com/en"), (4, "http://a.net/es/1"),
    (5, "http://net/fr/"), (6, "http://notexample.com"), (7, "http://notexample.com/en/q"), (8, None), (9, "no scheme"), (10, ""), (11, "x://"),
    (12, "http://a.org:80/p/?utm_x=1"), (13, "HTTP://A.ORG/p"), (14, "http://a.org/p/#z"), (15, "ftp://b.org/?q=http://c.com/"), (16, "http://b.org/other"),
    (17, "http://ÉCOLE.net/es/é"), (None, "http://a.org/p"), (18, "http://a.org/p"), (18, "http://a.org/p"), (19, "http://x.com?a/b"), (20, "http://d.org/" + "y" * 50_000),
]


def verdict_of(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    for rule, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            return host, path, rule, verdict
    return host, path, None, "block" if url in listed else "allow"


def test_verdicts(spark):
    rows = spark.createDataFrame([(*r, "mine") for r in URLS], "page_id bigint, url string, host string")
    listed = spark.createDataFrame([("http://a.org/p",), ("https://a.org/p/",), (None,), ("junk",), ("http://b.org/?q=http://c.com/",)], "url string")
    hit = {u for _, u in URLS if u and re.match(r"(?i)http://a.org(:80)?/p|ftp://b.org", u)}
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, listed).collect()), key=repr)
    assert got == sorted(((k, *verdict_of(u, hit)) for k, u in URLS), key=repr)
    assert url_filter.judge(rows, listed.limit(0)).where("listed").count() == 0
    assert url_filter.judge(rows.limit(0), listed).count() == 0


def test_filter_passes_all_listed_urls_and_few_others(spark):
    listed = spark.range(4000).selectExpr("concat('h', id, '.org/p') AS canonical")
    others = spark.range(4000, 12000).selectExpr("concat('h', id, '.org/p') AS canonical")
    bloom = url_filter.bloom_filter(listed, 500)

    def passing(df):
        from pyspark.sql import functions as F

        keyed = df.withColumns({"_block": url_filter._block(F.col("canonical"), 500), "_bits": url_filter._bits(F.col("canonical"))})
        return keyed.join(bloom, "_block").where("(_word & _bits) = _bits").count()

    assert passing(listed) == 4000 and passing(others) < 800
    assert url_filter.listed_among(others.union(listed), listed).count() == 4000


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame(URLS, "page_id bigint, url string")
    plan = url_filter.judge(rows, rows.select("url"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
