"""URL verdicts: fixed rules first, then the reputation of the host.

Reputation is empirical Bayes over labelled pages. The rate of bad pages under a public suffix has the overall rate
as its prior, a registered domain that of its suffix, a host that of its domain; each prior weighs as many pages as
the method of moments finds in how much the rates of that level differ. A host is blocked when it is surely worse than
usual: when the lower bound of its posterior beta distribution, at probability 1 - SURE, reaches WORSE times the overall
rate of bad pages. The limit moves with the corpus, so it means the same where bad pages are rare and where they aren't.

Public suffixes come from a rule, as the full list changes weekly and isn't ours to ship: behind a country's two letters, a
label of at most three letters, or one of the usual longer ones, belongs to the suffix. A list can be given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, passing

#: Rules as given: verdict and host/path prefix. They are few and fixed, so they are part of the expression.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Labels that belong to the suffix in front of a country's two letters, for names with three labels or more.
SECOND = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "go", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "school")
#: How many times the overall rate a host must surely reach, and the normal quantile of "surely" (90 percent, one-sided).
WORSE, SURE = 1.5, 1.2816


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _dotted(host: Column) -> Column:
    """Whether the last two labels are one suffix."""
    return F.substring_index(host, ".", -1).rlike("^[a-z]{2}$") & F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(*SECOND) & host.contains(".")


def suffix_of(host: Column) -> Column:
    return F.when(_dotted(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(_dotted(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of equally long ones the more special host wins, then block."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/", 1)[0]), r[0] == "block")):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def weight(level: DataFrame, rate: str) -> float:
    """The weight, in pages, of the prior of a level by the method of moments; n, k and the parent's rate are its columns. One
    number crosses to the driver."""
    n, k, p = F.col("n"), F.col("k"), F.col(rate)
    spread = F.sum(n * (k / n - p) * (k / n - p))
    chance = F.sum(n * p * (1 - p)) / F.sum(n)
    free = F.count("*") - 1
    apart = F.sum(n) - F.sum(n * n) / F.sum(n) - free
    rho = F.least(F.lit(0.9), F.greatest(F.lit(0.001), F.when((chance > 0) & (apart > 0), (spread / chance - free) / apart).otherwise(0.001)))
    return float(level.where("n > 0").agg(F.coalesce(1 / rho - 1, F.lit(999.0)).alias("m")).collect()[0]["m"])


def beta_bound(mean: Column, weight: Column) -> Column:
    """Lower quantile of a beta distribution with this mean and sum of parameters, at 1 - SURE, after Paulson: the cube roots of
    the two gamma variables it is made of are nearly normal, so it keeps in 0 to 1 and is skewed as it should be, for few pages too."""
    a, b = F.greatest(mean * weight, F.lit(1e-6)), F.greatest((1 - mean) * weight, F.lit(1e-6))
    u, v, z = 1 / (9 * a), 1 / (9 * b), F.lit(SURE)
    # the ratio r of cube roots at which (1 - v) r - (1 - u) is z deviations low: a quadratic in r
    inside = F.greatest(F.lit(0.0), (1 - u) * (1 - u) * v + (1 - v) * (1 - v) * u - z * z * u * v)
    lead = (1 - v) * (1 - v) - z * z * v
    root = ((1 - u) * (1 - v) - z * F.sqrt(inside)) / lead
    r = F.when((lead > 0) & (root > 0), root).otherwise(0.0)
    odds = a / b * r * r * r
    return odds / (1 + odds)


def reputation(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, float]:
    """host, posterior mean and lower bound, and the overall rate. pages: host and page_id; outcomes: page_id and bad (0 or 1), one row a page.

    Four numbers cross to the driver: the overall rate and the weight of each level's prior.
    """
    # every level is summed before its shuffle, so a suffix that a third of all hosts have is a few rows
    counted = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    with passing() as kept:
        hosts = materialise(counted.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
        sums = F.sum("n").alias("n"), F.sum("k").alias("k")
        domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
        suffixes = materialise(domains.groupBy("suffix").agg(*sums), "suffixes")
        overall = suffixes.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("p0")).collect()[0]["p0"]
        suffixes = _shrunk(suffixes.withColumn("p0", F.lit(overall)), "p0").select("suffix", F.col("p").alias("p1"))
        domains = materialise(domains.join(suffixes, "suffix"), "domains")
        domains = _shrunk(domains, "p1").select("domain", F.col("p").alias("p2"))
        hosts = materialise(hosts.join(domains, "domain"), "hosts")
        kept.append(hosts)
        found = _shrunk(hosts, "p2").select("host", F.col("p").alias("bad_rate"), beta_bound(F.col("p"), F.col("n") + F.col("m")).alias("bad_bound"))
    return found, overall


def _shrunk(level: DataFrame, rate: str) -> DataFrame:
    """Adds m and the posterior mean p to a level with n, k and its parent's rate."""
    m = F.lit(weight(level, rate))
    return level.withColumn("m", m).withColumn("p", (F.col("k") + m * F.col(rate)) / (F.col("n") + m))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_bound for every page.

    A page is labelled when a row of labels has its number as doc_id: bad if any such row is toxic or of quality 0.
    Null and odd urls have an empty host, which has a reputation like any other. Without labels nothing is blocked
    but by rule. Repeated rows are judged each.
    """
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    outcomes = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    known, overall = reputation(parts.select("page_id", "host"), outcomes)
    method = F.when((F.col("bad_bound") >= WORSE * overall) & F.lit(overall > 0), "block").otherwise("allow")
    return parts.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


def oracle() -> str:
    """The same in DuckDB."""
    url = "coalesce(url, '')"
    host = f"translate(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    dotted = f"(regexp_matches(one, '^[a-z]{{2}}$') AND len(s) > 1 AND s[-2] IN ({', '.join(repr(x) for x in SECOND)}))"
    name, verdict = "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
    for kind, rule in sorted(RULES, key=lambda r: (len(r[1]), len(r[1].split("/", 1)[0]), r[0] == "block")):
        own, _, rest = rule.partition("/")
        fits = f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}'))"
        name, verdict = f"CASE WHEN {fits} THEN '{rule}' ELSE {name} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"

    def m(level, rate):
        return f"""(SELECT coalesce(1 / least(0.9, greatest(0.001, CASE WHEN chance > 0 AND apart > 0 THEN (spread / chance - free) / apart ELSE 0.001 END)) - 1, 999.0) FROM (
            SELECT sum(n * (k / n - {rate}) * (k / n - {rate})) AS spread, sum(n * {rate} * (1 - {rate})) / sum(n) AS chance,
                   count(*) - 1 AS free, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS apart FROM {level} WHERE n > 0))"""

    return f"""
WITH parts AS (SELECT page_id, {host} AS host, regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host),
tails AS (SELECT *, string_split(host, '.') AS s FROM counted),
named AS (SELECT host, n, k, s, array_to_string(s[-2:], '.') AS two, array_to_string(s[-3:], '.') AS three, s[-1] AS one FROM tails),
hosts0 AS (SELECT host, n, k, CASE WHEN {dotted} THEN three ELSE two END AS domain, CASE WHEN {dotted} THEN two ELSE one END AS suffix FROM named),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.0) FROM hosts0) AS p0 FROM hosts0 GROUP BY suffix),
suffixes AS (SELECT suffix, (k + m * p0) / (n + m) AS p1 FROM (SELECT *, {m("suffixes0", "p0")} AS m FROM suffixes0)),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts0 GROUP BY domain, suffix),
domains1 AS (SELECT * FROM domains0 JOIN suffixes USING (suffix)),
domains AS (SELECT domain, (k + m * p1) / (n + m) AS p2 FROM (SELECT *, {m("domains1", "p1")} AS m FROM domains1)),
hosts1 AS (SELECT * FROM hosts0 JOIN domains USING (domain)),
posterior AS (SELECT host, p, greatest(p * (n + m), 1e-6) AS a, greatest((1 - p) * (n + m), 1e-6) AS b FROM (SELECT *, (k + m * p2) / (n + m) AS p FROM (SELECT *, {m("hosts1", "p2")} AS m FROM hosts1))),
roots AS (SELECT *, 1 / (9 * a) AS u, 1 / (9 * b) AS v, (1 - v) * (1 - v) - {SURE} * {SURE} * v AS lead FROM posterior),
ratios AS (SELECT *, ((1 - u) * (1 - v) - {SURE} * sqrt(greatest(0.0, (1 - u) * (1 - u) * v + (1 - v) * (1 - v) * u - {SURE} * {SURE} * u * v))) / lead AS r0 FROM roots),
odds AS (SELECT host, p, a / b * power(CASE WHEN lead > 0 AND r0 > 0 THEN r0 ELSE 0.0 END, 3) AS o FROM ratios),
known AS (SELECT host, p, o / (1 + o) AS bound, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.0) FROM hosts0) AS p0 FROM odds)
SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN p0 > 0 AND bound >= {WORSE} * p0 THEN 'block' ELSE 'allow' END) AS verdict, round(p, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM parts LEFT JOIN known USING (host)"""
