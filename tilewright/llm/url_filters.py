"""URL filters: exact rules first, then empirical-Bayes host reputation.

A rule is a host and a path prefix; it fits that host and its subdomains, and the longest
fitting rule decides. A page that no rule fits is judged by its host. Outcomes are labelled
pages: where a rule fits, whether it blocks; elsewhere what a table of labels says of the page. Pages without either are
no outcomes. Beta-binomial
priors shrink each host's rate to that of the other hosts of its registered domain, these to the
other domains of its suffix, and those to all other pages: no page counts twice. The strength of
each prior is estimated from the data: with m a group's prior rate, excess dispersion rho = (sum (y - n m)^2 - sum n m (1-m)) / sum n (n-1) m (1-m), kept
within [0.001, 0.5], and strength 1/rho - 1. A page is blocked if the posterior mean less two
posterior deviations of its host exceeds one half: only a host that is surely bad is lost. A host without outcomes has its prior.

The suffix is the last label, the registered domain one label more; `suffixes` names others, such as co.uk, below which
names have different owners. Reputation knows hosts without user and port. Hosts are grouped before anything is joined, so a host with a
third of all pages is one row per task in the aggregates; pages meet reputations in a join
whose page side Spark may split.

Defined results: a null url or one without `://` has empty host and path, no rule, and is judged
as the host ''. Labels may be missing, and a label that is null is none. Each input row gives one row, repeated rows and null ids
included. An empty table gives an empty result. A very long url is handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: Fixed rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEVIATIONS, LINE = 2.0, 0.5
BROADCAST_RULES = 50_000
#: Fixed suffixes of two labels: public ones, and those under which the reserved names stand for different owners.
SUFFIXES = (
    *("ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "org.nz"),
    *("ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "com.cn", "net.cn", "org.cn", "com.tw", "com.hk", "co.in", "com.sg"),
    *("com.br", "net.br", "org.br", "com.ar", "com.mx", "com.co", "com.pe", "co.za", "org.za", "com.tr", "co.il", "com.ua", "com.pl"),
    *("example.com", "example.net", "example.org"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) to distinct (host, path) rows."""
    rules = rules.select(
        F.regexp_extract("rule", r"^[^/]*", 0).alias("rule_host"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("rule_path"), "rule", "verdict"
    )
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    tried = pages.select("host", "path", F.explode(tails).alias("rule_host")).where("host != ''")
    met = tried.join(F.broadcast(rules) if small else rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("h"), "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def domains(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def _with_prior(groups: DataFrame, above: Column | float, strength: float) -> tuple[DataFrame, float]:
    """Adds m, the rate of a group's siblings (all_n, all_bad less its own) shrunk to `above` with `strength`;
    and finds the strength that a prior about m has for groups at this level: one number."""
    n, y = F.col("n"), F.col("bad")
    groups = materialize(groups.withColumn("m", (F.col("all_bad") - y + strength * above) / (F.col("all_n") - n + strength)), "priors")
    m = F.col("m")
    var = m * (1 - m)
    r = groups.agg(F.sum((y - n * m) * (y - n * m)), F.sum(n * var), F.sum(n * (n - 1) * var)).first()
    rho = min(0.5, max(0.001, (r[0] - r[1]) / r[2])) if r[2] else 0.5
    return groups, 1 / rho - 1


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """`outcomes` (host, n, bad; some rows a host) to host, n, rate, strength, bound."""
    domain, suffix = domains(F.col("host"), suffixes)
    hosts = outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    add = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    up = lambda df, *keys: df.select(*keys, F.col("n").alias("all_n"), F.col("bad").alias("all_bad"), F.col("m").alias("above"))
    top = hosts.agg(F.sum("n"), F.sum("bad")).first()
    whole = {"all_n": F.lit(top[0] or 0.0), "all_bad": F.lit(top[1] or 0.0)}
    # half a bad page in one stands above all
    by_suffix, k = _with_prior(add(hosts, "suffix").withColumns(whole), 0.5, 1.0)
    by_domain, k = _with_prior(add(hosts, "domain", "suffix").join(up(by_suffix, "suffix"), "suffix"), F.col("above"), k)
    own, k = _with_prior(hosts.drop("suffix").join(up(by_domain, "domain"), "domain"), F.col("above"), k)
    own = own.select("host", "n", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("rate"), F.lit(k).alias("strength"))
    bound = F.col("rate") - DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k + 1))
    return own.select("host", "n", "rate", "strength", bound.alias("bound"))


def page_number(path: Column) -> Column:
    """The first number that stands alone at the head of a part of the path: which text the page shows."""
    return F.regexp_extract(path, r"/([0-9]{1,18})", 1).try_cast("long")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, label_key=page_number, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per page row: id, host, path, rule, verdict, bound.

    `rules`: (rule, verdict). `labels`: (key, bad: 1 or 0), of pages that no rule fits; `label_key` makes the key of a page from its path.
    """
    host, path = url_parts(F.col(url_col))
    rows = materialize(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), "urls")
    places = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    ruled = with_rules(places.select("host", "path"), rules)
    ruled = places.join(ruled, ["host", "path"])
    bad = F.when(F.col("rule").isNotNull(), (F.col("rule_verdict") == "block").cast("int"))
    if labels is not None:
        labels = labels.toDF("label_key", "label").groupBy("label_key").agg(F.max("label").alias("label"))
        ruled = ruled.join(labels, label_key(F.col("path")) == F.col("label_key"), "left")
        bad = F.coalesce(bad, F.col("label").cast("int"))
    site = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    ruled = materialize(ruled.select("host", "path", "pages", "rule", "rule_verdict", bad.alias("bad"), site.alias("site")), "ruled")
    known = F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)
    outcomes = ruled.groupBy("site").agg(F.sum(known).alias("n"), F.sum(known * F.coalesce("bad", F.lit(0))).alias("bad"))
    bounds = reputations(outcomes.withColumnRenamed("site", "host"), suffixes).select(F.col("host").alias("site"), "bound")
    judged = ruled.select("host", "path", "rule", "rule_verdict", "site").join(bounds, "site", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bound") > LINE, "block").otherwise("allow"))
    return rows.join(judged, ["host", "path"], "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "bound")
