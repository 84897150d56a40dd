"""URL filters by rules and by an empirical-Bayes reputation of hosts.

Rules are ``host/path`` prefixes.  A rule fits its host, all its subdomains and
every path that starts with its path; the longest rule that fits wins.  A url's
candidate rules are its host suffixes (a short array) joined with the rules'
hosts, so the plan is an equi-join and a partial aggregate whatever the number
of rules.

The rules' outcomes label the pages: 1 where a rule blocks, 0 where one allows,
and ``unruled`` (None for no label, or 0) elsewhere.  The block rate of a host's
labelled pages is shrunk by beta-binomial priors level by level: all pages,
public suffix (one label, or two of ``TWO_LABELS``), registered domain, host.  The
weight of a prior is its level's by the method of moments (how much the rates of
its children differ, pre-aggregated per level, so a hot host is one row); a child
counts for its parent only as much as its pages tell of other children.  A page
without a rule is blocked if the lower bound of its host's posterior rate is over
``limit``.

Native: only DataFrame functions.  Defined cases: a null url, or one without
``://``, has an empty host and path, no rule, and is judged by the reputation of
the empty host; a null page id is carried; repeated pages get one row each and
count once each; without labelled pages the prior is uniform and nothing is
blocked; very long urls are whole; rules with equal host and path keep the first
by verdict (allow before block), and of fitting rules of one length the greater
rule wins; an empty table gives an empty result; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize

#: rule (``host/path``) and verdict
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


#: Public suffixes of two labels.  All others are taken to be one label.
TWO_LABELS = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "ac.nz", "govt.nz",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "com.br", "org.br", "net.br", "gov.br", "co.in", "org.in", "net.in", "gov.in", "ac.in", "co.za", "org.za", "com.cn", "net.cn", "org.cn", "gov.cn",
    "com.mx", "com.ar", "com.tr", "com.tw", "com.hk", "com.sg", "com.my", "co.kr", "or.kr", "co.il", "org.il", "com.ua", "com.pl", "com.co", "co.id", "co.th",
)

SALTS = 16


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return _lower(host), path


def host_suffixes(host: Column) -> Column:
    """The host and the domains that it is in, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def public_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(parent: Column, weight: Column, bad: Column, n: Column) -> Column:
    return (weight * parent + bad) / (weight + n)


def _moments() -> Column:
    """Prior weight of a level: the beta-binomial's by moments, between 1 and 1000.

    An aggregate over one row per group with its pages ``n`` and blocked ``bad``.
    """
    total, bad = F.sum("n"), F.sum("bad")
    p = F.when(total > 0, bad / total).otherwise(0.5)
    groups = F.count(F.lit(1))
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) / F.when(total > 0, total) - p * p  # size-weighted variance of the rates
    within = p * (1 - p) * groups / F.when(total > 0, total)  # what binomial noise adds
    between = spread - within
    raw = F.when((between > 0) & (p * (1 - p) > 0), p * (1 - p) / between - 1).otherwise(1000.0)
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(raw, F.lit(1000.0))))


def reputations(judged: DataFrame, z: float) -> DataFrame:
    """Per host of ``judged`` (host, bad 0/1/null): the posterior block rate and its lower bound.

    The hosts' counts are cut once; what the levels say as a whole are single numbers.
    """

    def weight(level: DataFrame) -> Column:
        return F.lit(level.filter(F.col("n") > 0).agg(_moments().alias("w")).first()["w"])

    def over(children: DataFrame, w: Column, *keys: str) -> DataFrame:
        """A child of n pages tells as much of its parent's rate as n w / (n + w) pages of different children."""
        share = w / (w + F.col("n"))
        return children.groupBy(*keys).agg(F.sum(F.col("n") * share).alias("n"), F.sum(F.col("bad") * share).alias("bad"))

    counts = judged.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = materialize(counts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host"))))
    wh = weight(hosts)
    domains = over(hosts, wh, "domain", "suffix")
    wd = weight(domains)
    suffixes = over(domains, wd, "suffix")
    ws = weight(suffixes)
    n, bad = over(suffixes, ws).select(F.coalesce("n", F.lit(0.0)), F.coalesce("bad", F.lit(0.0))).first() or (0.0, 0.0)

    s = suffixes.select("suffix", _shrunk(F.lit((bad + 1) / (n + 2)), ws, F.col("bad"), F.col("n")).alias("suffix_rate"))
    d = domains.join(s, "suffix").select("domain", _shrunk(F.col("suffix_rate"), wd, F.col("bad"), F.col("n")).alias("domain_rate"))
    rate = _shrunk(F.col("domain_rate"), wh, F.col("bad"), F.col("n"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (wh + F.col("n") + 1))
    return hosts.join(d, "domain").withColumn("rate", rate).select("host", F.col("n").alias("labelled"), "rate", F.greatest(F.lit(0.0), F.col("rate") - z * sd).alias("bound"))


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url", z: float = 1.645, limit: float = 0.5, unruled: int | None = None) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, rate, bound``.

    ``rules`` has ``rule`` (``host/path``) and ``verdict`` (allow or block).
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string") if rules is None else rules
    rule_host = F.substring_index("rule", "/", 1)
    by_host = (
        rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.min("verdict").alias("verdict"))
        .select(_lower(rule_host).alias("_at"), F.struct(F.length("rule").alias("size"), "rule", "verdict", F.substring(F.col("rule"), F.length(rule_host) + 1, F.length("rule")).alias("prefix")).alias("r"))
        .groupBy("_at").agg(F.collect_list("r").alias("rules"))
    )
    host, path = url_parts(F.col(url))
    # a hot host's pages are dealt to SALTS tasks; what joins them has a copy for each
    salt = F.pmod(F.xxhash64(F.col(page_id), path), F.lit(SALTS)).cast("int")
    rows = pages.select(F.col(page_id).alias("_id"), host.alias("host"), path.alias("path"), salt.alias("_salt"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    # the rules of each host: distinct hosts (pre-aggregated) against the rules' hosts
    fits = (
        rows.select("host").distinct().withColumn("_at", F.explode(host_suffixes(F.col("host"))))
        .join(by_host, "_at").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    )
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    judged = rows.join(fits.select("host", "rules", copies), ["host", "_salt"], "left").select("_id", "host", "path", "_salt", best.alias("best"))
    judged = judged.withColumn("bad", F.when(F.col("best.verdict") == "block", 1).when(F.col("best.verdict") == "allow", 0).otherwise(F.lit(unruled).cast("int")))
    known = reputations(judged.select("host", "bad"), z)
    out = judged.join(known.select("*", copies), ["host", "_salt"], "left")
    verdict = F.coalesce("best.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return out.select(F.col("_id").alias(page_id), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "rate", "bound")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _moments_sql(level: str) -> str:
    return f"""SELECT coalesce(least(1000.0, greatest(1.0, CASE WHEN q - p * p - p * (1 - p) * g / t > 0 AND p * (1 - p) > 0 THEN p * (1 - p) / (q - p * p - p * (1 - p) * g / t) - 1 ELSE 1000.0 END)), 1000.0) AS w
    FROM (SELECT count(*) AS g, sum(n) AS t, CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END AS p, sum(bad * bad / n) / sum(n) AS q FROM {level} WHERE n > 0)"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)

OP8_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(rh, rp, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
f AS (SELECT p.page_id, p.host, p.path, max(struct_pack(s := length(r.rule), rule := r.rule, v := r.verdict)) AS best
      FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp) GROUP BY ALL),
j AS (SELECT page_id, host, path, best.rule AS rule, best.v AS v, CASE best.v WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM f),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, two IN ({_TWO}) AS pair, string_split(host, '.') AS labels,
             CASE WHEN pair THEN array_to_string(list_slice(labels, -3, -1), '.') ELSE two END AS domain, CASE WHEN pair THEN two ELSE list_extract(labels, -1) END AS suffix
      FROM (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two FROM j) GROUP BY host, two),
wh AS ({_moments_sql("h")}),
d AS (SELECT domain, suffix, sum(n * w / (w + n)) AS n, sum(bad * w / (w + n)) AS bad FROM h, wh GROUP BY ALL),
wd AS ({_moments_sql("d")}),
s AS (SELECT suffix, sum(n * w / (w + n)) AS n, sum(bad * w / (w + n)) AS bad FROM d, wd GROUP BY ALL),
ws AS ({_moments_sql("s")}),
top AS (SELECT (coalesce(sum(bad * w / (w + n)), 0) + 1) / (coalesce(sum(n * w / (w + n)), 0) + 2) AS rate FROM s, ws),
sr AS (SELECT suffix, (w * rate + bad) / (w + n) AS rate FROM s, top, ws),
dr AS (SELECT domain, (w * sr.rate + bad) / (w + n) AS rate FROM d JOIN sr USING (suffix), wd),
hr AS (SELECT host, n, w, (w * dr.rate + bad) / (w + n) AS rate FROM h JOIN dr USING (domain), wh)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.v, CASE WHEN hr.rate - 1.645 * sqrt(hr.rate * (1 - hr.rate) / (hr.w + hr.n + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN hr ON hr.host = j.host
"""
