"""URL filter: rules by host and path, else a host's reputation by beta-binomial shrinkage. DataFrames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Fixed values: (verdict, host and path) of the rules that the query applies.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Public suffixes of two labels that are common enough to matter.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Bounds on a group's prior weight, in pages, and the number of standard deviations of the posterior bound.
LEAST_PRIOR, MOST_PRIOR, SIGMAS = 2.0, 200.0, 1.645


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule list is short: it becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer rules wrap the shorter ones
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The public suffix: two labels where these are a known one, else the last label; ports are left out."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def prior_weight(groups: DataFrame) -> float:
    """The prior's weight in pages for the groups (n, bad, prior) of one level, from how far their rates scatter around ``prior``.

    Method of moments for the beta-binomial: the variance between groups beyond what binomial draws
    explain gives the prior's weight; no excess gives the most, all of it the least. The driver sees one row;
    sums are of decimals, so that the order of rows changes nothing.
    """
    p, n, x = F.col("prior"), F.col("n"), F.col("bad")
    noise, seen = p * (1 - p), n * F.pow(x / n - p, 2)
    parts = {"a": noise, "b": seen, "c": noise * (n - 1)}
    r = groups.where("n > 1").agg(*[F.sum(F.round(c, 9).cast("decimal(38,9)")).cast("double").alias(k) for k, c in parts.items()]).first()
    if not r["c"]:
        return MOST_PRIOR
    rho = max(1e-9, min(1.0, (r["b"] - r["a"]) / r["c"]))
    return max(LEAST_PRIOR, min(MOST_PRIOR, 1 / rho - 1))


def reputations(labelled: DataFrame) -> tuple[float, dict[str, float], DataFrame, DataFrame, DataFrame]:
    """(mean of everything, prior weight of each level, suffixes, domains, hosts): counts n and bad, prior, and posterior mean m.

    ``labelled`` has host, domain, suffix and bad (0 or 1). Everything starts from a uniform prior; each
    level's prior has the posterior mean of the level above and a weight from the level's own scatter.
    Sums are by group with partial aggregation, so a suffix with a third of all pages costs no more. Pages
    are counted once, by host; that table and those of the levels above it are staged.
    """
    host = stage(labelled.groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "hosts")
    add = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = host.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (top["bad"] + 1) / (top["n"] + 2)
    weights: dict[str, float] = {}

    def level(name: str, groups: DataFrame, above: DataFrame | None, on: list[str]) -> DataFrame:
        if above is None:
            told = groups.withColumn("prior", F.lit(mean))
        else:
            told = groups.join(above.select(*on, F.col("m").alias("prior")), on)
        w = weights[name] = prior_weight(told)
        return stage(told.withColumn("m", (w * F.col("prior") + F.col("bad")) / (w + F.col("n"))), name)

    suffixes = level("suffix", host.groupBy("suffix").agg(*add), None, [])
    domains = level("domain", host.groupBy("suffix", "domain").agg(*add), suffixes, ["suffix"])
    return mean, weights, suffixes, domains, level("host", host, domains, ["suffix", "domain"])


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", key: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation of every row of ``pages``.

    A fitting rule decides, the longest first. Otherwise the host's reputation does: ``labels`` (key, bad
    0 or 1) gives outcomes of some pages, which shrink from host to registered domain to public suffix to
    everything; a page is blocked only if the lower bound of its posterior (the mean less SIGMAS standard deviations)
    is above ``threshold``. A host without outcomes has the posterior of a group without pages: the mean of
    its domain, if that has outcomes, at the prior weight of hosts; else the mean of its suffix at the
    weight of domains; else the mean of everything at the weight of suffixes.

    Null urls and urls without :// have empty host and path, fit no rule and are allowed. Labels that are
    null or name no page don't count; pages labelled more than once count each time. Repeated pages come
    back as often. Without any label everything that no rule blocks is allowed, as the mean is then 1/2. An
    empty table gives an empty one. Other columns aren't looked at.
    """
    u = F.col(url).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host")))
    outcomes = labels.select(F.col(labels.columns[0]).cast("long").alias("page_id"), F.col(labels.columns[1]).cast("long").alias("bad")).where("bad is not null")
    labelled = rows.where("host <> ''").join(outcomes, "page_id").select("host", "domain", "suffix", "bad")
    mean, weights, suffixes, domains, hosts = reputations(labelled)
    known = rows.select("host", "domain", "suffix").where("host <> ''").distinct()
    best = known.join(hosts.select("host", "prior", "n", "bad"), "host", "left").join(domains.select("domain", F.col("m").alias("dm")), "domain", "left").join(suffixes.select("suffix", F.col("m").alias("sm")), "suffix", "left")
    weight = F.when(F.col("n").isNotNull() | F.col("dm").isNotNull(), F.lit(weights["host"])).when(F.col("sm").isNotNull(), F.lit(weights["domain"])).otherwise(F.lit(weights["suffix"]))
    prior = F.coalesce("prior", "dm", "sm", F.lit(mean))
    pages_ = weight + F.coalesce("n", F.lit(0))
    best = best.select("host", ((weight * prior + F.coalesce("bad", F.lit(0))) / pages_).alias("m"), pages_.alias("pages"))
    bound = F.col("m") - SIGMAS * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("pages") + 1))
    judged = rows.join(best.select("host", F.round(bound, 9).alias("reputation")), "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("reputation") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "reputation")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the label of the same number; bad is toxic or of low quality. These are synthetic, as the tables are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select("doc_id", bad.alias("bad"))).drop("reputation")


def op8_sql() -> str:
    """The same chain as aggregates: moments of each level, posterior means, the bound of each host."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    fits = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))

    def rule(text: str) -> str:
        name, _, rest = text.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"

    def chosen(at: int) -> str:
        return "CASE " + " ".join(f"WHEN {rule(r[1])} THEN '{r[at]}'" for r in fits) + " END"

    def weight(table: str) -> str:
        moments = "sum(p * (1 - p)) AS a, sum(n * (bad / n - p) ** 2) AS b, sum(p * (1 - p) * (n - 1)) AS c"
        rho = "greatest(1e-9, least(1.0, (b - a) / c))"
        return f"SELECT CASE WHEN coalesce(c, 0) = 0 THEN {MOST_PRIOR} ELSE greatest({LEAST_PRIOR}, least({MOST_PRIOR}, 1 / {rho} - 1)) END AS w FROM (SELECT {moments} FROM {table} WHERE n > 1)"

    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM u),
t AS (SELECT *, array_to_string(labels[-2:], '.') IN ({two}) AS two FROM l),
r AS (SELECT page_id, host, path, CASE WHEN two THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix,
    CASE WHEN two THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM t),
o AS (SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad FROM labels),
h0 AS (SELECT suffix, domain, host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM r JOIN o ON o.doc_id = r.page_id WHERE host <> '' AND bad IS NOT NULL GROUP BY ALL),
top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM h0),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(top.m) AS p FROM h0, top GROUP BY suffix), ws AS ({weight("s0")}),
s AS (SELECT suffix, (w * p + bad) / (w + n) AS m FROM s0, ws),
d0 AS (SELECT suffix, domain, sum(h0.n) AS n, sum(h0.bad) AS bad, any_value(s.m) AS p FROM h0 JOIN s USING (suffix) GROUP BY suffix, domain), wd AS ({weight("d0")}),
d AS (SELECT domain, (w * p + bad) / (w + n) AS m FROM d0, wd),
h AS (SELECT host, n, bad, d.m AS p FROM h0 JOIN d USING (domain)), wh AS ({weight("h")}),
k AS (SELECT host, CASE WHEN h.n IS NOT NULL OR d.m IS NOT NULL THEN wh.w WHEN s.m IS NOT NULL THEN wd.w ELSE ws.w END AS w,
    coalesce(h.p, d.m, s.m, top.m) AS p, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
  FROM (SELECT DISTINCT host, domain, suffix FROM r WHERE host <> '') x LEFT JOIN h USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), wh, wd, ws, top),
b AS (SELECT host, (w * p + bad) / (w + n) AS m, w + n AS pages FROM k),
j AS (SELECT r.*, round(m - {SIGMAS} * sqrt(m * (1 - m) / (pages + 1)), 9) > 0.5 AS bad FROM r LEFT JOIN b USING (host))
SELECT page_id, host, path, {chosen(1)} AS rule, coalesce({chosen(0)}, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
