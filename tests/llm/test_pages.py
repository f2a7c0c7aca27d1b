"""WARC round trips with revisits, and the URL filter, against SQL and plain versions."""

import gzip
import hashlib
import math

from check import compare
from tokenloom.llm import urlfilter, warc
from tokenloom.llm.queries import CHECKS, QUERIES


def test_warc_query_matches_sql(spark, duck, sf_dir):
    name = "op7_warc_revisits"
    verdict, _, _ = compare(spark, duck, sf_dir, name, QUERIES[name], CHECKS[name])
    assert verdict.startswith("ok"), verdict


def test_warc_odd_rows(spark, tmp_path):
    page = "<p>é WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n</p>" * 60
    rows = [
        (1, "http://a/\r\nX: y", page), (5, None, page), (3, "", page), (5, "u", page),
        (None, "u", page), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"),
        (11, "u", "z" * 300_000),
    ]
    pages = spark.createDataFrame(
        [(*r, "v", 1) for r in rows], "page_id long, url string, html string, value string, n int"
    )
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [
        (0, "response", None), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None),
        (5, "response", None), (7, "response", None), (8, "response", None),
        (9, "response", None), (10, "response", None), (11, "response", None),
    ]
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r["payload_bytes"] == len(html[r["page_id"]])
        assert r["payload_digest"] == hashlib.sha1(html[r["page_id"]]).hexdigest()
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[r["page_id"]]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*"))
    assert raw.count(b"WARC-Profile: ") == 2 and b"\r\nX: y" not in raw


def test_warc_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def plain_rule(host, path):
    fits = []
    for verdict, rule in urlfilter.RULES:
        rule_host, _, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x=/en/1#y", "http://example.org/en/12",
    "http://notexample.org/en/1", "http://a.com?x=http://b.com/de/", "http://a.com#/fr/", "http://org/",
    "http://x.com/fr/3", "x://y.com/de/://z", "http://é.com/DE/", "http://x.com/" + "a" * 20_000,
    "http://a\nb.com/de/q", "http://x.net/",
]


def test_url_parts_and_rules(spark):
    rows = [(i, u, "h", 2) for i, u in enumerate(URLS)] + [(None, "http://x.org/", "h", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    got = urlfilter.judge(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://x.org/" if r["page_id"] is None else URLS[r["page_id"]]
        assert (r["host"], r["path"]) == plain_parts(url)
        rule, verdict = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule and 0 <= r["score"] <= 1
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert urlfilter.judge(pages.limit(0), model).count() == 0


def test_scores_are_those_of_the_regression(spark):
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    pages = spark.createDataFrame([(0, "http://cheap-pills.test/en/buy")], "page_id long, url string")
    host, path = urlfilter.host_of(pages.url), urlfilter.path_of(pages.url)
    grams = pages.select(urlfilter.features(host, path)).first()[0]
    z = sum(model[0][g - 1] for g in grams) / math.sqrt(len(grams)) + model[1]
    score = urlfilter.judge(pages, model).first()["score"]
    assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9 and score > 0.5


def test_model_separates_its_table(spark):
    labelled = urlfilter.labelled_urls(spark)
    pages = labelled.withColumnRenamed("label", "page_id")
    got = urlfilter.judge(pages, urlfilter.train(labelled), rules=[]).collect()
    right = sum((r["verdict"] == "block") == bool(r["page_id"]) for r in got)
    assert right >= 0.95 * len(got)
    weights, bias = urlfilter.train(labelled.limit(0))
    assert not weights.any() and bias == 0
    assert len(QUERIES) == 10
