from __future__ import annotations

import json

import pytest

from quern.sources import remote


def test_retries():
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return b"ok"

    assert remote.http_get("u", wait=0, opener=opener) == b"ok" and len(calls) == 3
    with pytest.raises(OSError, match="down"):
        remote.http_get("u", tries=1, opener=lambda u, t: (_ for _ in ()).throw(OSError("down")))


def test_search_and_listing():
    seen = []

    def opener(url, timeout):
        seen.append(url)
        return json.dumps({"esearchresult": {"idlist": ["1", "2"]}}).encode() if "esearch" in url else b"<R><CommonPrefixes><Prefix>x.2/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>x.10/</Prefix></CommonPrefixes></R>"

    assert remote.search_ids("a b", 5, "2020", "2021", opener) == ["1", "2"] and "mindate=2020" in seen[0] and "retmax=5" in seen[0]
    found = remote.list_prefixes("b", "x", opener)
    assert remote.latest_prefix(found) == "x.10/" and remote.latest_prefix(["y"]) is None


def test_sources_of_recorded_pages(spark, tmp_path):
    import json

    from pyspark.errors import PySparkException
    from quern.sources import pages

    pages.register(spark)
    start = "https://own.s3.amazonaws.com/?list-type=2&prefix=p%2F&delimiter=%2F"
    replies = [(remote.search_url(query, 5), json.dumps({"esearchresult": {"idlist": ids}})) for query, ids in [("a b", ["7", "3"]), ("none", [])]]
    replies.append((start, "<CommonPrefixes><Prefix>p/x.1/</Prefix></CommonPrefixes><NextContinuationToken>a&amp;b</NextContinuationToken>"))
    replies.append((start + "&continuation-token=a%26b", "<CommonPrefixes><Prefix>p/x.10/</Prefix></CommonPrefixes>"))
    pages.record(spark.createDataFrame(replies, "url string, body string"), str(tmp_path))
    found = spark.read.format("article_search").option("over", json.dumps(["a b", "none"])).option("most", 5).option("pages", str(tmp_path)).load()
    assert found.rdd.getNumPartitions() == 2 and sorted(map(tuple, found.collect())) == [("a b", 1, "7"), ("a b", 2, "3")]
    listed = spark.read.format("prefix_listing").option("over", '["p/"]').option("bucket", "own").option("pages", str(tmp_path)).load()
    assert sorted(map(tuple, listed.collect())) == [("p/", "p/x.1/", False), ("p/", "p/x.10/", True)]
    with pytest.raises(PySparkException):
        spark.read.format("article_search").option("over", '["unknown"]').option("pages", str(tmp_path)).option("wait", 0).load().collect()
