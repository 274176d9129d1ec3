"""URL verdicts from rules and host reputation.

Labelled outcomes are counted per host, registered domain and suffix. A suffix is shrunk to
the mean of all, a domain to its suffix, a host to its domain, each with a beta-binomial
prior whose strength is estimated from the spread of the groups on that level. A host is
blocked if the lower bound of its posterior rate of bad pages is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.scratch import stage

# --- fixed values: rules as host/path prefix, and two-part suffixes ---
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
TWO_PART_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
    "or.jp", "com.br", "com.ar", "com.mx", "co.za", "co.in", "co.kr", "com.cn", "com.tr",
)
# --- end of fixed values ---
BLOCK_RATE = 0.5
BOUND_DEVIATIONS = 1.645
STRENGTH_RANGE = (2.0, 500.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits the host or a parent domain and the path's beginning."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        domain, _, start = rule.partition("/")
        fits = (host == domain) | host.endswith(f".{domain}")
        found = F.when(fits & path.startswith(f"/{start}"), F.lit(rule)).otherwise(found)
    return found


def suffix(host: Column) -> Column:
    """The last label of the host, or the last two if they are a known two-part suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain(host: Column) -> Column:
    """The suffix and the label before it."""
    labels = F.when(
        F.substring_index(host, ".", -2).isin(*TWO_PART_SUFFIXES),
        F.substring_index(host, ".", -3),
    )
    return F.coalesce(labels, F.substring_index(host, ".", -2))


def _strength(groups: DataFrame) -> float:
    """How many pages a prior is worth, from the variance between groups beyond chance."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    row = groups.agg(
        F.count("*").alias("groups"), F.sum(n).alias("n"), F.sum(bad).alias("bad"),
        F.sum(n * n).alias("squares"), F.sum(bad * bad / n).alias("between"),
    ).first()
    low, high = STRENGTH_RANGE
    if row["groups"] < 2 or not 0 < row["bad"] < row["n"]:
        return high
    rate, spare = row["bad"] / row["n"], row["groups"] - 1
    noise = rate * (1 - rate)
    seen = row["between"] - row["n"] * rate * rate
    room = row["n"] - row["squares"] / row["n"] - spare
    correlation = (seen - noise * spare) / (noise * room) if room > 0 else 0.0
    return high if correlation <= 0 else min(high, max(low, 1 / correlation - 1))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad 0/1) per labelled page -> host, domain, suffix posteriors:
    level, name, alpha, beta of the rate of bad pages. Rows with nulls are left out."""
    known = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    # Written, since every level and every join reads them again.
    hosts = stage(hosts, "hosts").withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total["bad"] + 1) / (total["n"] + 2) if total["n"] else 0.5

    def shrunk(groups: DataFrame, prior: Column) -> DataFrame:
        strength = F.lit(_strength(groups))
        return groups.withColumns({
            "alpha": F.col("bad") + strength * prior,
            "beta": F.col("n") - F.col("bad") + strength * (1 - prior),
        })

    def above(groups: DataFrame, key: str) -> DataFrame:
        rate = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior")
        return groups.select(key, rate)

    suffixes = shrunk(suffixes, F.lit(mean))
    domains = shrunk(domains.join(above(suffixes, "suffix"), "suffix"), F.col("prior")).drop("prior")
    hosts = shrunk(hosts.join(above(domains, "domain"), "domain"), F.col("prior"))
    hosts, domains = stage(hosts, "hosts"), stage(domains, "domains")
    parts = [
        part.select(F.lit(level).alias("level"), F.col(key).alias("name"), "alpha", "beta")
        for level, key, part in (
            ("host", "host", hosts), ("domain", "domain", domains), ("suffix", "suffix", suffixes)
        )
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: dict[str, str] = RULES,
    block_rate: float = BLOCK_RATE,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, lower_bound.

    `outcomes` has host and bad (0/1) of labelled pages. The verdict is the rule's; without
    one, block if the lower bound of the posterior of the host is above `block_rate`, else
    allow. A host without outcomes takes its domain's posterior, then its suffix's; without
    any, it is allowed and the bound is null. Null urls and urls without `://` have an empty
    host and path. Repeated rows are judged each, null page_ids kept, other columns not read.
    """
    parsed = pages.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")
    )
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    bound = mean - F.lit(BOUND_DEVIATIONS) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    reputation = host_reputation(outcomes).select("level", "name", bound.alias("bound"))
    hosts = parsed.groupBy("host").agg(F.count("*").alias("pages")).select(
        "host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix")
    )
    for level in ("host", "domain", "suffix"):
        own = reputation.where(F.col("level") == level).select(
            F.col("name").alias(level), F.col("bound").alias(f"{level}_bound")
        )
        hosts = hosts.join(own, level, "left")
    # Written, so that the join has a plain shuffle on both sides and may split a hot host.
    hosts = stage(
        hosts.select(
            "host", F.coalesce("host_bound", "domain_bound", "suffix_bound").alias("lower_bound")
        ),
        "bounds",
    )
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")]
    learned = F.when(F.col("lower_bound") > block_rate, "block").otherwise("allow")
    return (
        parsed.join(hosts, "host", "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.when(F.col("rule").isNotNull(), ruled).otherwise(learned))
        .select("page_id", "host", "path", "rule", "verdict", "lower_bound")
    )
