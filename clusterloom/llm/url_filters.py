"""URL filters: list rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Suffixes below which names are registered, besides the last label.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.nz", "co.in", "co.za")

#: Bounds of a prior's estimated weight, and the weight where nothing can be estimated.
LEAST_STRENGTH, MOST_STRENGTH, UNKNOWN_STRENGTH = 1.0, 1000.0, 20.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at, below = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def beta_low(a: Column, b: Column, z: float, tail: float) -> Column:
    """The point of a beta distribution below which ``tail`` of it lies, z being the normal distribution's for that tail:
    the approximation by a normal deviate (Abramowitz and Stegun 26.5.22), and by the powers near either end where a
    parameter is below 1."""
    x, y = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h, lam = 2 / (x + y), (z * z - 3) / 6
    w = z * F.sqrt(h + lam) / h - (y - x) * (lam + 5 / 6 - 2 / (3 * h))
    t, u = F.exp(a * F.log(a / (a + b))) / a, F.exp(b * F.log(b / (a + b))) / b
    near_0, near_1 = F.pow(a * (t + u) * tail, 1 / a), 1 - F.pow(b * (t + u) * (1 - tail), 1 / b)
    return F.when((a > 1) & (b > 1), a / (a + b * F.exp(2 * w))).otherwise(F.when(tail < t / (t + u), near_0).otherwise(near_1))


def strength_of(n: Column, b: Column, mean: Column) -> Column:
    """The weight, in pages, of the prior that a level's groups have: by the method of moments for beta-binomial counts.

    The squared distances of rates from their prior means, weighted by pages, are as large as chance makes them times 1 +
    (n - 1) / (weight + 1) on average. The weight is kept between LEAST_STRENGTH and MOST_STRENGTH; groups of one page
    each say nothing on it: then it is UNKNOWN_STRENGTH.
    """
    v = mean * (1 - mean)
    excess, scale = F.sum(n * (b / n - mean) * (b / n - mean) - v), F.sum(v * (n - 1))
    share = F.when(scale > 0, F.greatest(F.lit(1 / (1 + MOST_STRENGTH)), F.least(F.lit(1 / (1 + LEAST_STRENGTH)), excess / scale))).otherwise(F.lit(1 / (1 + UNKNOWN_STRENGTH)))
    return 1 / share - 1


def reputation(outcomes: DataFrame, hosts: DataFrame | None = None, z: float = 1.645, tail: float = 0.05) -> DataFrame:
    """(host, n_labels, n_bad, bad_rate, bad_low): posterior mean and lower bound of each host's bad rate.

    outcomes: host and bad (0 or 1), a row for each labelled page; null hosts or outcomes are left out. hosts: (host) of
    further hosts to rate, which may have no labels. Each level is a beta-binomial whose prior has the mean of the level
    above and a weight that is estimated from that level's own counts: suffixes around all pages, registered domains
    around their suffix, hosts around their domain. A host without labels has its domain's rate as prior, else its
    suffix's, else that of all pages, at the smallest weight of the levels between. bad_low is the ``tail`` quantile of the
    posterior (z is the normal one's). Counts are summed by host first, so the levels above shuffle a row for each host
    and task, not for each page. Without outcomes there are no rows.
    """
    seen = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
    own = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
    own = own.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = own.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))

    def one(rows: DataFrame, *columns: Column) -> DataFrame:
        return F.broadcast(rows.agg(*columns))  # one row

    def shrunk(rows: DataFrame, above: str, weight: str, mean: str) -> DataFrame:
        level = rows.join(one(rows, strength_of(F.col("n"), F.col("b"), F.col(above)).alias(weight)))
        return level.withColumn(mean, (F.col("b") + F.col(weight) * F.col(above)) / (F.col("n") + F.col(weight)))

    whole = one(suffixes, ((F.sum("b") + 0.5) / (F.sum("n") + 1)).alias("p0"))
    by_suffix = shrunk(suffixes.join(whole), "p0", "s1", "p1").select("suffix", "p1")
    by_domain = shrunk(domains.join(by_suffix, "suffix"), "p1", "s2", "p2").select("domain", "p2")
    s1 = one(suffixes.join(whole), strength_of(F.col("n"), F.col("b"), F.col("p0")).alias("s1"))
    s2 = one(domains.join(by_suffix, "suffix"), strength_of(F.col("n"), F.col("b"), F.col("p1")).alias("s2"))
    s3 = one(own.join(by_domain, "domain"), strength_of(F.col("n"), F.col("b"), F.col("p2")).alias("s3"))
    if hosts is not None:
        named = hosts.select("host").where("host is not null").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
        own = named.join(own.select("host", "n", "b"), "host", "left").fillna(0, ["n", "b"])
    every = own.join(by_domain, "domain", "left").join(by_suffix, "suffix", "left").join(whole).join(s1).join(s2).join(s3).where("p0 is not null")
    mean = F.coalesce("p2", "p1", "p0")
    weight = F.when(F.col("p2").isNotNull(), F.col("s3")).when(F.col("p1").isNotNull(), F.least("s2", "s3")).otherwise(F.least("s1", "s2", "s3"))
    every = every.select("host", "n", "b", (F.col("b") + weight * mean).alias("up"), (F.col("n") - F.col("b") + weight * (1 - mean)).alias("down"))
    up, down = F.col("up"), F.col("down")
    return every.select("host", F.col("n").alias("n_labels"), F.col("b").alias("n_bad"), (up / (up + down)).alias("bad_rate"), beta_low(up, down, z, tail).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", *, rules=RULES, limit: float = 0.3, **prior) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_low), a row for each row of pages.

    outcomes: (page_id, bad) of labelled pages. The longest rule that fits decides; else the page is blocked if the
    lower posterior bound of its host's bad rate is above ``limit``. Hosts without labels are judged by their domain,
    suffix or all pages (see reputation()). Urls that are null or have no ``://`` (host and path empty) have no bound
    (null) and are allowed, as is every url if no page has a label. Null page ids stay in the result but match no outcome.
    Repeated pages each give a row; a label counts once for each of its rows, spread over the rows of its page. Urls of
    any length are read whole. Empty tables give no rows or no bounds. Other columns are not read.
    """
    own = pick(pages, page_id=page_id, url=url).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = own.where(F.col("host") != "")
    labelled = named.select("page_id", "host").join(pick(outcomes, page_id="page_id", bad="bad"), "page_id")
    known = reputation(labelled.select("host", "bad"), named.select("host"), **prior).select("host", "bad_low")
    # Hot hosts: the known side has one row a host, so skewed partitions of pages can be split.
    own = own.join(known, "host", "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.coalesce(F.col("bad_low") > limit, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return own.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("bad_low", 6).alias("bad_low"))


def query(spark, sf_dir: str) -> DataFrame:
    """The pages against the labels of the same ids: low quality or toxic is bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(pages, bad)


def _strength_sql(mean: str) -> str:
    share = f"greatest({1 / (1 + MOST_STRENGTH)!r}::DOUBLE, least({1 / (1 + LEAST_STRENGTH)!r}::DOUBLE, sum(n * (b / n - {mean}) * (b / n - {mean}) - {mean} * (1 - {mean})) / sum({mean} * (1 - {mean}) * (n - 1))))"
    return f"1 / CASE WHEN sum({mean} * (1 - {mean}) * (n - 1)) > 0 THEN {share} ELSE {1 / (1 + UNKNOWN_STRENGTH)!r}::DOUBLE END - 1"


_DOUBLE = ", ".join(f"'{x}'" for x in DOUBLE_SUFFIXES)
SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id,
        translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT q.host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS bad
      FROM q JOIN labels l ON l.doc_id = q.page_id WHERE q.host <> ''),
parts AS (SELECT host, string_split(host, '.') AS a FROM (SELECT DISTINCT host FROM q WHERE host <> '')),
names AS (SELECT host, CASE WHEN array_to_string(a[-2:], '.') IN ({_DOUBLE}) THEN array_to_string(a[-2:], '.') ELSE array_to_string(a[-1:], '.') END AS suffix,
        CASE WHEN array_to_string(a[-2:], '.') IN ({_DOUBLE}) THEN array_to_string(a[-3:], '.') ELSE array_to_string(a[-2:], '.') END AS domain FROM parts),
h AS (SELECT host, suffix, domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS b FROM o JOIN names USING (host) GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY ALL),
w0 AS (SELECT (sum(b) + 0.5::DOUBLE) / (sum(n) + 1) AS p0 FROM s),
w1 AS (SELECT {_strength_sql("p0")} AS s1 FROM s, w0),
p1 AS (SELECT suffix, (b + s1 * p0) / (n + s1) AS p1 FROM s, w0, w1),
w2 AS (SELECT {_strength_sql("p1")} AS s2 FROM d JOIN p1 USING (suffix)),
p2 AS (SELECT domain, (b + s2 * p1) / (n + s2) AS p2 FROM d JOIN p1 USING (suffix), w2),
w3 AS (SELECT {_strength_sql("p2")} AS s3 FROM h JOIN p2 USING (domain)),
e AS (SELECT names.host, coalesce(h.n, 0) AS n, coalesce(h.b, 0) AS b, coalesce(p2, p1, p0) AS m,
        CASE WHEN p2 IS NOT NULL THEN s3 WHEN p1 IS NOT NULL THEN least(s2, s3) ELSE least(s1, s2, s3) END AS w
      FROM names LEFT JOIN h USING (host) LEFT JOIN p2 ON p2.domain = names.domain LEFT JOIN p1 ON p1.suffix = names.suffix, w0, w1, w2, w3 WHERE p0 IS NOT NULL),
ab AS (SELECT host, b + w * m AS a, n - b + w * (1 - m) AS b FROM e),
xy AS (SELECT *, 1 / (2 * a - 1) AS x, 1 / (2 * b - 1) AS y, exp(a * ln(a / (a + b))) / a AS t, exp(b * ln(b / (a + b))) / b AS u, (1.645::DOUBLE * 1.645::DOUBLE - 3) / 6 AS lam FROM ab),
k AS (SELECT host, CASE WHEN a > 1 AND b > 1
        THEN a / (a + b * exp(2 * (1.645::DOUBLE * sqrt(2 / (x + y) + lam) / (2 / (x + y)) - (y - x) * (lam + 5::DOUBLE / 6 - 2 / (3 * (2 / (x + y)))))))
        WHEN 0.05::DOUBLE < t / (t + u) THEN pow(a * (t + u) * 0.05::DOUBLE, 1 / a) ELSE 1 - pow(b * (t + u) * (1 - 0.05::DOUBLE), 1 / b) END AS low FROM xy),
r AS (SELECT page_id, host, path, low, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM q LEFT JOIN k USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN coalesce(low > 0.3::DOUBLE, false) THEN 'block' ELSE 'allow' END AS verdict, round(low, 6) AS bad_low
FROM r
"""
