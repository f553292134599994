"""Host reputation by empirical Bayes, and a URL filter that rules and posterior bounds decide.

Labelled page outcomes are counted by host. Rates are shrunk from the whole web to the suffix, from there to the
registered domain, and from there to the host, each time through a beta prior whose strength is estimated from how far
the units' counts scatter around their parent's rate (moments of the beta-binomial). What a host's prior says comes from
other hosts only, and weighs no more pages than they and their own prior have. A host is blocked if the lower bound
of its posterior rate of bad pages is above the rate of all labelled pages; a host without labels has its domain's prior.

Null urls and those without :// have an empty host and path, no reputation, and are allowed unless a rule says otherwise.
Repeated labels of one page count once, as the worst; repeated pages are judged each. Urls may be of any length. An empty
table of pages gives no rows, and one of labels leaves every verdict to the rules. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels; all others have one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: One-sided normal quantile of the bound.
Z = 1.645
#: Range of the intra-class correlation, 1 / (strength + 1).
LEAST_RHO, MOST_RHO = 0.001, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """What lies above registered domains; suffixes: those of two labels."""
    name = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    name = F.regexp_replace(host, r"^.*@|:\d*$", "")
    return F.when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def strength(units: DataFrame) -> float:
    """units: n, k, and the parent's rate p -> the prior's weight in pages."""
    seen = units.where("n > 0 AND p > 0 AND p < 1")
    s, m, more = seen.agg(F.sum((F.col("k") - F.col("n") * F.col("p")) ** 2 / (F.col("n") * F.col("p") * (1 - F.col("p")))), F.count("*"), F.sum(F.col("n") - 1)).first()
    rho = (s - m) / more if more else MOST_RHO
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def posterior(m: float) -> Column:
    return (F.col("k") + m * F.col("p")) / (F.col("n") + m)


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """outcomes: host, bad (1, 0, or null if unlabelled) -> a row for each non-empty host: n, k, a, b, rate, low, high, and the
    rate of all labelled pages, base."""
    host = outcomes.where("host <> ''").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    host = common.stash(host.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "hosts")
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = host.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    p0 = (k + 0.5) / (n + 1.0)
    suffix = suffix.withColumn("p", F.lit(p0))
    m_suffix = strength(suffix)
    suffix = suffix.select("suffix", posterior(m_suffix).alias("p"), F.col("n").alias("n_suffix"), F.col("k").alias("k_suffix"))
    domain = common.stash(common.salted_join(domain, suffix, ["suffix"], F.col("domain")), "domains")
    m_domain = strength(domain)
    domain = domain.select("domain", posterior(m_domain).alias("p"), F.col("n").alias("n_domain"), F.col("k").alias("k_domain"), "n_suffix", "k_suffix")
    host = common.stash(common.salted_join(host, domain, ["domain"], F.col("host")), "host-priors")
    m_host = strength(host)
    # the host's own pages are taken out of its suffix and its domain
    host = host.withColumn("p_suffix", (F.col("k_suffix") - F.col("k") + m_suffix * p0) / (F.col("n_suffix") - F.col("n") + m_suffix)).withColumn("w_domain", F.least(F.lit(m_domain), F.col("n_suffix") - F.col("n") + m_suffix))
    host = host.withColumn("p", (F.col("k_domain") - F.col("k") + F.col("w_domain") * F.col("p_suffix")) / (F.col("n_domain") - F.col("n") + F.col("w_domain"))).withColumn("w", F.least(F.lit(m_host), F.col("n_domain") - F.col("n") + F.col("w_domain")))
    a, b = F.col("a"), F.col("b")
    rate, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return host.withColumns({"a": F.col("k") + F.col("w") * F.col("p"), "b": F.col("n") - F.col("k") + F.col("w") * (1 - F.col("p"))}).withColumns({"rate": rate, "low": rate - z * sd, "high": rate + z * sd, "base": F.lit(p0)})


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none fits. Rules: (block or allow, host, path)."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, reputation: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages: page_id, host, path -> with rule, verdict, and the host's labelled and bad pages, posterior rate and bounds (null
    if it has none)."""
    rows = common.salted_join(pages, reputation.select("host", "n", "k", "rate", "low", "high", "base"), ["host"], F.col("page_id"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("_r", rule).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.when(F.col("low") > F.col("base"), "block").otherwise("allow")).alias("verdict"), "n", "k", "rate", "low", "high")


#: The rules of OP1_SQL and of older tests; "net" and "example.net" have each other's word here. The query goes by CONTRACT_RULES.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]
CONTRACT_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_url_reputation(spark, sf_dir: str) -> DataFrame:
    """A page is of the document whose id its path has; a document of low quality is a bad outcome."""
    url = F.col("url").cast("string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = common.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    about = pages.select("host", F.expr(r"try_cast(nullif(regexp_extract(path, '^/[a-z]+/(\\d+)', 1), '') AS BIGINT)").alias("doc_id"))
    # pages of no document would all meet in the join as one key
    outcomes = about.where("doc_id IS NOT NULL").join(labels, "doc_id", "left").select("host", "bad").unionByName(about.where("doc_id IS NULL").select("host", F.lit(None).cast("int").alias("bad")))
    return rounded(judge(pages, host_reputation(outcomes), CONTRACT_RULES))


def rounded(judged: DataFrame) -> DataFrame:
    """Rates to six places, so that they don't depend on the order in which sums were made."""
    return judged.withColumns({c: F.round(c, 6) for c in ("rate", "low", "high")})


def _rate(k: str, n: str, p: str, m: str) -> str:
    return f"(({k} + {m} * {p}) / ({n} + {m}))"


def _strength(units: str) -> str:
    return f"(SELECT 1 / least({MOST_RHO}, greatest({LEAST_RHO}, coalesce((sum((k - n * p) ** 2 / (n * p * (1 - p))) - count(*)) / nullif(sum(n - 1), 0), {MOST_RHO}))) - 1 FROM {units} WHERE n > 0 AND p > 0 AND p < 1)"


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_NAME = r"regexp_replace(host, '^.*@|:\d*$', '')"
_LAST = lambda n: f"array_to_string(list_slice(string_split({_NAME}, '.'), -{n}, -1), '.')"

OP1_SQL = rf"""
WITH pg AS (SELECT page_id, CASE WHEN url IS NULL THEN '' ELSE translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') END AS host,
                   CASE WHEN url IS NULL THEN '' ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END AS path FROM pages),
lb AS (SELECT doc_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k FROM pg LEFT JOIN lb ON lb.doc_id = TRY_CAST(nullif(regexp_extract(path, '^/[a-z]+/(\d+)', 1), '') AS BIGINT) WHERE host <> '' GROUP BY host),
h1 AS (SELECT *, CASE WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain, CASE WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix FROM h0),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h1 GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM h1) AS p FROM d0 GROUP BY suffix),
m1 AS (SELECT {_strength("s0")} AS m_suffix),
s1 AS (SELECT suffix, {_rate("k", "n", "p", "m_suffix")} AS p, p AS p0, n AS n_suffix, k AS k_suffix FROM s0, m1),
d1 AS (SELECT d0.*, s1.p, p0, n_suffix, k_suffix FROM d0 JOIN s1 USING (suffix)),
m2 AS (SELECT {_strength("d1")} AS m_domain),
d2 AS (SELECT domain, {_rate("k", "n", "p", "m_domain")} AS p, n AS n_domain, k AS k_domain, p0, n_suffix, k_suffix FROM d1, m2),
h2 AS (SELECT h1.*, d2.p, n_domain, k_domain, p0, n_suffix, k_suffix FROM h1 JOIN d2 USING (domain)),
m3 AS (SELECT {_strength("h2")} AS m_host),
o1 AS (SELECT host, n, k, n_domain, k_domain, m_host, p0, (k_suffix - k + m_suffix * p0) / (n_suffix - n + m_suffix) AS p_suffix, least(m_domain, n_suffix - n + m_suffix) AS w_domain FROM h2, m1, m2, m3),
o2 AS (SELECT host, n, k, p0, (k_domain - k + w_domain * p_suffix) / (n_domain - n + w_domain) AS p, least(m_host, n_domain - n + w_domain) AS w FROM o1),
h3 AS (SELECT host, n, k, p0, k + w * p AS a, n - k + w * (1 - p) AS b FROM o2),
h4 AS (SELECT host, n, k, p0, a / (a + b) AS rate, {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS margin FROM h3),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}) t(v, h, p)),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM pg JOIN r ON (pg.host = r.h OR ends_with(pg.host, '.' || r.h)) AND starts_with(pg.path, r.p) GROUP BY page_id)
SELECT pg.page_id, pg.host, pg.path, m.rule, coalesce(m.v, CASE WHEN h4.rate - margin > p0 THEN 'block' ELSE 'allow' END) AS verdict,
       h4.n, h4.k, round(h4.rate, 6) AS rate, round(h4.rate - margin, 6) AS low, round(h4.rate + margin, 6) AS high
FROM pg LEFT JOIN h4 USING (host) LEFT JOIN m USING (page_id)
"""
