"""URL filters (operator 4): host and path rules, and logistic regression for the rest.

The regression reads hashed character n-grams of host and path.  Hashing is plain
arithmetic on code points and the weights are rounded to integers, so a verdict is an
exact sum that any SQL engine computes alike.  It is trained on the driver from a small
labelled table (at most ``MAX_LABELLED`` rows); the table of pages is judged with
DataFrame functions alone, without a shuffle.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, UPPER, ascii_lower, column, refuse, table

#: (host, path, verdict): a rule fits its host and all subdomains, and paths that start with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

SLOTS, SIZES, SCALE = 2039, (3, 4), 1 << 16
MAX_LABELLED = 5_000
#: The character that marks the ends of a host, and the number that tells path grams from host grams.
EDGE, PATH_SALT = "^", 977
#: The labelled table has as many of both kinds; among pages, about one in ten is to be blocked.
BLOCKED_SHARE = 0.1

#: A small labelled URL table: hosts and paths of the kind to block, and of the kind to allow.
BLOCKED_HOSTS = "cheap-pills.shop casino-win.biz free-bets.info best-casino.club poker-bonus.site online-slots.top pills-direct.store viagra-cheap.online replica-watch.shop cheap-meds.biz hot-singles.date xxx-cams.live adult-chat.fun free-money.win payday-loan.loans quick-loans.cash bet-now.bet lucky-bets.io jackpot-slots.vip win-prizes.click cheap-watches.store weight-loss-pills.info porn-tube.xyz sexy-cams.tv betting-tips.club casino-bonus.games free-spins.casino cheap-viagra.pharmacy buy-followers.win crypto-double.cash ads-server.net ad-tracker.com track-clicks.biz spam-links.info link-farm.top adult-videos.xyz adult-shop.club popup-ads.click".split()
ALLOWED_HOSTS = "library.org museum.org university.edu docs.python.org news-site.com weather.gov city-council.gov recipes.com garden-club.org history-society.org blog.writer.com cooking.net science.org health.gov schools.edu travel-notes.com books.com music-review.com open-data.gov wiki.org research-lab.edu theatre.com old-maps.org river-trust.org photo-journal.com bird-watch.org the-gazette.com local-history.com language-forum.org engineering.edu mathematics.org astronomy.com poetry.org railway-museum.com".split()
BLOCKED_PATHS = "/buy-now /free-bonus /win /casino/slots /cheap/pills /bets/today /signup?bonus=1 /xxx /cams/live /order-pills".split()
ALLOWED_PATHS = "/ /about /en/12 /de/34 /fr/56.html /articles/2020/03 /page/7 /index.html /archive/old /contact".split()


def labelled_urls() -> list[tuple[str, int]]:
    """URLs with label 1 (block) or 0, made of the tables above; each host with several paths."""
    rows = []
    for hosts, paths, label in ((BLOCKED_HOSTS, BLOCKED_PATHS, 1), (ALLOWED_HOSTS, ALLOWED_PATHS, 0)):
        for k, host in enumerate(hosts):
            for prefix in ("", "www.", "m."):
                rows.append((f"https://{prefix}{host}{paths[k % len(paths)]}", label))
                rows.append((f"http://{prefix}{host}{ALLOWED_PATHS[(3 * k + 1) % len(ALLOWED_PATHS)]}", label))
    return rows


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host.translate(str.maketrans(UPPER, LOWER)), tail[:end]


def grams(host: str, path: str) -> list[int]:
    out = []
    for text, salt in ((EDGE + host + EDGE, 0), (EDGE + path + EDGE, PATH_SALT)):
        points = [ord(c) for c in text]
        for n in SIZES:
            for i in range(len(points) - n + 1):
                h = 0
                for p in points[i : i + n]:
                    h = (h * 31 + p) % 1_000_003
                out.append((h + salt * n) % SLOTS)
    return out


def train(rows: list[tuple[str, int]], *, rounds: int = 150, rate: float = 2.0, decay: float = 1e-4) -> tuple[list[int], int]:
    """Integer weights and bias of the regression on the mean of a URL's grams."""
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    data = [(grams(*host_and_path(u)), y) for u, y in rows]
    weight, bias = [0.0] * SLOTS, 0.0
    gain = 8.0  # grams of a URL are many; their mean is small
    for turn in range(rounds):
        step = rate / (1 + turn / 50)
        for own, y in data:
            if not own:
                continue
            z = bias + gain * sum(weight[g] for g in own) / len(own)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            bias -= 0.05 * step * error
            pull = step * error * gain / len(own)
            for g in own:
                weight[g] -= pull + decay * weight[g]
    share = sum(y for _, y in rows) / max(1, len(rows))
    if 0 < share < 1:  # from the labelled table's share to that of pages
        bias += math.log(BLOCKED_SHARE / (1 - BLOCKED_SHARE)) - math.log(share / (1 - share))
    return [round(w * gain * SCALE) for w in weight], round(bias * SCALE)


@lru_cache(maxsize=4)
def _model(rows: tuple[tuple[str, int], ...] | None = None) -> tuple[tuple[int, ...], int]:
    weight, bias = train(list(rows) if rows else labelled_urls())
    return tuple(weight), bias


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] | None = None) -> DataFrame:
    """``id_col, host, path, rule, verdict, spam_score`` for every row of ``pages``.

    The longest rule that fits decides; without one, the regression blocks at a
    probability of one half or more.  ``spam_score`` is that probability.

    Defined cases: a null url or one without ``://`` has an empty host and path, is fitted
    by no rule and judged by the bias and its empty ends.  Rows with equal or null ids are
    judged each.  An empty table gives an empty table.  Other columns are not read; an id column
    with the name of a result is refused.
    """
    refuse(id_col, "host", "path", "rule", "verdict", "spam_score")
    weight, bias = _model(labelled)
    parts = "://([^/?#]*)([^?#]*)"
    url = column(url_col)
    out = pages.select(column(id_col).alias("__id"), F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")).alias("__host"), F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")).alias("path"))
    out = out.withColumn("host", ascii_lower(F.col("__host")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)

    def points(col: str):
        return F.transform(F.regexp_extract_all(F.concat(F.lit(EDGE), F.col(col), F.lit(EDGE)), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))

    out = out.select("__id", "host", "path", rule.alias("rule"), verdict.alias("__verdict"), points("host").alias("__h"), points("path").alias("__p"), F.split(F.lit(",".join(map(str, weight))), ",").cast("array<long>").alias("__w"))

    def total(col: str, salt: int, n: int):
        def at(i):
            h = F.lit(0)
            for k in range(n):
                h = (h * 31 + F.get(F.col(col), i + k)) % 1_000_003
            return F.get(F.col("__w"), ((h + salt * n) % SLOTS).cast("int"))

        count = F.greatest(F.size(col) - (n - 1), F.lit(0)).cast("long")
        spots = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(spots, F.lit(0).cast("long"), lambda a, i: a + at(i)), count

    sums = [total(col, salt, n) for col, salt in (("__h", 0), ("__p", PATH_SALT)) for n in SIZES]
    total_weight, n_grams = sum((s for s, _ in sums[1:]), sums[0][0]), sum((c for _, c in sums[1:]), sums[0][1])
    out = out.select("__id", "host", "path", "rule", "__verdict", (total_weight + n_grams * F.lit(bias)).alias("__sum"), n_grams.alias("__n"))
    score = 1 / (1 + F.exp(-F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).otherwise(F.lit(float(bias))) / SCALE))
    method = F.when(F.when(F.col("__n") > 0, F.col("__sum")).otherwise(F.lit(bias)) >= 0, "block").otherwise("allow")
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__verdict", method).alias("verdict"), score.alias("spam_score"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).drop("spam_score")


def op4_sql() -> str:
    weight, bias = _model()
    sums = []
    for col, salt in (("host", 0), ("path", PATH_SALT)):
        for n in SIZES:
            h = "0"
            for k in range(n):
                h = f"(({h}) * 31 + {col}_p[i + {k}]) % 1000003"
            sums.append(f"coalesce(list_sum(list_transform(range(1, greatest(len({col}_p) - {n - 2}, 1)), lambda i: w[(({h}) + {salt * n}) % {SLOTS} + 1])), 0)")
    counts = " + ".join(f"greatest(len({c}_p) - {n - 1}, 0)" for c in ("host", "path") for n in SIZES)
    cases = {"rule": "", "verdict": ""}
    for host, path, say in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases["rule"] += f" WHEN {fits} THEN '{host}{path}'"
        cases["verdict"] += f" WHEN {fits} THEN '{say}'"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
points AS (
  SELECT page_id, host, path, list_transform(string_split('{EDGE}' || host || '{EDGE}', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS host_p,
         list_transform(string_split('{EDGE}' || path || '{EDGE}', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS path_p,
         CAST([{", ".join(map(str, weight))}] AS BIGINT[]) AS w FROM parts),
scored AS (
  SELECT page_id, host, path, {" + ".join(sums)} + ({counts}) * ({bias}) AS total FROM points)
SELECT page_id, host, path, CASE{cases["rule"]} END AS rule,
       CASE{cases["verdict"]} WHEN total >= 0 THEN 'block' ELSE 'allow' END AS verdict
FROM scored
"""
