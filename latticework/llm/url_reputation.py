"""URL filter: rules first, then empirical-Bayes host reputation, with DataFrame operations only.

Labelled page outcomes are counted by host, registered domain and suffix. At each level a
beta-binomial prior takes its mean from the level above and its strength from the spread of
that level's rates (method of moments), so a host with few labels leans on its domain, that on
its suffix, and that on the whole. A url is blocked where the lower quantile of its host's beta
posterior for the rate of bad pages is over the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

#: verdict and rule: host, then path
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: suffixes of two labels; every other suffix is the last label
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def host_and_path(url):
    """Columns host and path: both empty where the url is null or has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return C.ascii_lower(part(1)), part(2)


def rule_for(host, path, rules=RULES):
    """The longest rule that fits as a struct (rule, verdict), else null."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(level: DataFrame) -> float:
    """Prior strength from the spread of rates: one row comes to the driver."""
    r = level.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    if not r.n or r.k < 2 or r.bad in (0, r.n):
        return 10.0
    p = r.bad / r.n
    between = (r.bb - r.n * p * p - (r.k - 1) * p * (1 - p)) / (r.n - r.nn / r.n) if r.n > r.nn / r.n else 0.0
    rho = min(0.5, max(0.001, between / (p * (1 - p))))
    return 1 / rho - 1


def _let(value, body):
    """body(value) with the value computed once: a lambda's variable, as plain columns are computed again in every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def beta_quantile(a, b, tail: float, steps: int = 400):
    """Column: the quantile of Beta(a, b) at ``tail``, from the density at ``steps`` places up to eight deviations around the mean."""
    mean = a / (a + b)
    wide = 8 * F.sqrt(mean * (1 - mean) / (a + b + 1))
    given = F.struct(a.alias("a"), b.alias("b"), F.greatest(F.lit(0.0), mean - wide).alias("lo"), F.least(F.lit(1.0), mean + wide).alias("hi"))
    at = lambda g, k: g["lo"] + (k + 0.5) / steps * (g["hi"] - g["lo"])
    logs = lambda g: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: (g["a"] - 1) * F.ln(at(g, k)) + (g["b"] - 1) * F.ln(1 - at(g, k)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"))

    def place(shares, total):
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["k"] + (s["sum"] + x < tail * total).cast("int")).alias("k"))
        return F.least(F.aggregate(shares, start, step)["k"], F.lit(steps - 1))

    def quantile(g):
        found = lambda w: _let(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda total: place(w, total))
        shares = lambda ls: _let(F.array_max(ls), lambda most: _let(F.transform(ls, lambda x: F.exp(x - most)), found))
        return at(g, _let(logs(g), shares))

    return _let(given, quantile)


def host_reputation(hosts: DataFrame, tail: float = 0.05) -> DataFrame:
    """(host, n, bad) to (host, labelled, bad_rate, bad_rate_low): the posterior's mean and its quantile at ``tail``."""
    labels = F.split("host", r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), F.lit(k)), ".")
    two = last(2).isin(*TWO_LABEL_SUFFIXES)
    hosts = C.stage(hosts.withColumns({"suffix": F.when(two, last(2)).otherwise(last(1)), "domain": F.when(two, last(3)).otherwise(last(2))}), "url-hosts")
    total = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes = total("suffix", "domain"), total("suffix")
    all_n, all_bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    p0 = (all_bad + 1) / (all_n + 2) if all_n else 0.0
    shrunk = lambda m, prior: (F.col("bad") + F.lit(m) * prior) / (F.col("n") + F.lit(m))
    suffixes = suffixes.select("suffix", shrunk(_strength(suffixes), F.lit(p0)).alias("ps"))
    m = _strength(domains)
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(m, F.col("ps")).alias("pd"))
    m = _strength(hosts)
    hosts = hosts.join(domains, ["suffix", "domain"]).withColumn("bad_rate", shrunk(m, F.col("pd")))
    hosts = hosts.withColumns({"a": F.col("bad") + F.lit(m) * F.col("pd"), "b": F.col("n") - F.col("bad") + F.lit(m) * (1 - F.col("pd"))})
    low = F.when((F.col("a") > 0) & (F.col("b") > 0), beta_quantile(F.col("a"), F.col("b"), tail)).otherwise(F.col("bad_rate"))
    return hosts.select("host", F.col("n").alias("labelled"), "bad_rate", low.alias("bad_rate_low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.5, tail: float = 0.05) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, then labelled, bad_rate, bad_rate_low.

    ``outcomes``: (page_id, bad 0/1); several per page count as bad if one is. Null urls and urls
    without ``://`` have empty host and path and share the empty host's reputation. Without any
    labels nothing but rules blocks. Repeated pages stay; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = C.need(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = C.need(outcomes, "page_id", "bad").where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counts = parsed.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    judged = parsed.join(host_reputation(counts, tail), "host", "left")
    fit = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate_low") > threshold, "block").otherwise("allow")
    out = judged.withColumn("fit", fit)
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "labelled", "bad_rate", "bad_rate_low")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labels of the test tables as page outcomes: bad is low quality or toxic, ids are shared."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad"))
