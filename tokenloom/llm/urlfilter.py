"""URL filter: explicit rules first, then logistic regression on hashed character n-grams.

Host and path are cut out of the url by position. Their character n-grams are hashed
into a fixed number of buckets; weights are trained on a small table of labelled urls
and enter the plan as one constant array, so scoring is a pure expression and the url
column is the only one that the scan reads.

A null url, or one without ``://``, has an empty host and path and is judged by the
model's bias alone. Very long urls are hashed whole. Repeated rows are judged alike.
Columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
L2 = 0.01
STEPS = 3000
#: Labelled urls are fitted on the driver; a larger table is refused, not cut.
MAX_LABELLED = 20_000
THRESHOLD = 0.5

# The rules of the shipped filter.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# A small labelled table of invented urls. Hosts and paths of advertising,
# betting, pills, adult and malware sites are to be blocked, ordinary ones are not.
BLOCKED = """
http://cheap-pills.test/en/buy
https://www.cheap-pills.test/offer/12
http://discount-pills.test/order
https://pills-online.test/cheap/7
http://best-pharmacy-pills.test/
https://www.casino-win.test/en/1
http://casino-win.test/bonus
https://online-casino.test/play/99
http://m.casino-royal.test/win-big
https://free-bets.test/en/5
http://www.free-bets.test/odds
https://bets-bonus.test/free
http://sports-bets.test/live/33
https://poker-win.test/jackpot
http://slots-jackpot.test/spin
https://ads-track.test/click?id=9
http://m.ads-track.test/pixel
https://ads-server.test/banner/4
http://track-click.test/redirect
https://popup-ads.test/show
http://spam-farm.test/en/1
https://www.spam-farm.test/links
http://link-farm.test/seo/page/8
https://spam-links.test/more
http://seo-spam.test/buy-links
https://adult-x.test/en/3
http://www.adult-x.test/videos
https://xxx-adult.test/cam/12
http://adult-dating.test/hot
https://hot-xxx.test/free
http://free-money.test/win
https://win-prizes.test/claim
http://crypto-double.test/send
https://quick-loans.test/apply
http://payday-loans.test/cash
https://replica-watches.test/cheap
http://cheap-replica.test/bags
https://crack-keygen.test/download
http://free-keygen.test/serial
https://warez-download.test/crack
http://malware-update.test/install.exe
https://fake-login.test/verify-account
http://account-verify.test/login.php
https://miracle-diet.test/lose-weight
http://weight-loss-pills.test/free-trial
""".split()
ORDINARY = """
http://history.test/en/1
https://www.history.test/articles/12
http://blog.gardening.test/en/spring.html
https://gardening.test/de/77
http://library.test/catalogue/5
https://m.library.test/fr/opening
http://university.test/faculty/physics
https://www.university.test/en/825
http://weather.test/es/today
https://blog.weather.test/en/450
http://news.test/world/2020/story.html
https://m.news.test/fr/919
http://museum.test/exhibits
https://www.museum.test/de/448
http://recipes.test/en/soup.html
https://blog.recipes.test/es/533
http://travel.test/guide/mountains
https://www.travel.test/en/680
http://science.test/papers/3
https://science.test/en/676
http://thatone.test/en/22
https://www.theother.test/fr/98
http://m.something.test/en/345?page=2
https://blog.another.test/de/249.html
http://threeand.test/en/132?utm_source=feed
https://thing.test/es/918
http://www.nation.test/en/196
https://blog.inner.test/en/710.html
http://reader.test/fr/371#top
https://m.station.test/en/518.html
http://other.test/en/77
https://www.sharing.test/de/945
http://school.test/timetable
https://forum.test/thread/1209
http://wiki.test/page/Mathematics
https://www.government.test/forms/en
http://docs.test/reference/index.html
https://blog.photography.test/en/963
http://music.test/fr/concerts
https://m.music.test/en/231
http://hospital.test/en/contact
https://transport.test/timetable/de
http://www.bookshop.test/en/novels
https://theatre.test/es/programme
http://village.test/en/council.html
""".split()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(verdict, rule)`` of the longest fitting rule, the smaller text on a tie; else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _grams(part: Column, mark: str, buckets: int) -> Column:
    """Bucket numbers, from 1, of all n-grams of a text with marked ends."""
    text = F.concat(F.lit("^"), part, F.lit("$"))
    arrays = []
    for n in SIZES:
        starts = F.when(
            F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))
        ).otherwise(F.array().cast("array<int>"))
        arrays.append(
            F.transform(
                starts,
                lambda i, n=n: (
                    F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(buckets))
                    + 1
                ).cast("int"),
            )
        )
    return F.concat(*arrays)


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    return F.concat(_grams(host, "host", buckets), _grams(path, "path", buckets))


def _constant(values: Sequence[float]) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The shipped table ``(url, label)``, label 1 for urls to be blocked."""
    rows = [(u, 1) for u in BLOCKED] + [(u, 0) for u in ORDINARY]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by full-batch gradient steps.

    ``labelled`` has ``url`` and ``label``; rows with a null in either teach nothing. At
    most ``MAX_LABELLED`` rows are taken; more are an error. An empty table gives zeros.
    """
    rows = (
        labelled.where("url is not null and label is not null")
        .select(features(host_of(F.col("url")), path_of(F.col("url")), buckets), "label")
        .limit(MAX_LABELLED + 1)
        .collect()
    )
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    weights, bias = np.zeros(buckets), 0.0
    if not rows:
        return weights, bias
    rows = sorted((list(r[0]), int(r[1])) for r in rows)
    x = np.zeros((len(rows), buckets))
    for i, (grams, _) in enumerate(rows):
        np.add.at(x[i], np.asarray(grams, dtype=np.int64) - 1, 1.0 / np.sqrt(max(1, len(grams))))
    y = np.array([label for _, label in rows], dtype=float)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ weights + bias))) - y
        weights -= 8.0 * (x.T @ error / len(y) + L2 / len(y) * weights)
        bias -= 2.0 * error.mean()
    return weights, float(bias)


def judge(
    pages: DataFrame,
    model: tuple[np.ndarray, float],
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every page."""
    weights, bias = model
    table = _constant(weights)
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rows = rows.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    grams = features(F.col("host"), F.col("path"), len(weights))
    rows = rows.withColumn("grams", grams)
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.element_at(table, g))
    logit = total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double")) + F.lit(bias)
    score = 1 / (1 + F.exp(-logit))
    by_model = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), by_model).alias("verdict"),
        score.alias("score"),
    )
