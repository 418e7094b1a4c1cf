"""URL filter: host rules, and trust and distrust spread over the host graph for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, fold, own_names

# Rules as host and path, longest wins.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

# Fixed value: absolute links in a page.
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>:]+)"""
MOST_RULES = 2_000        # rules travel in the plan
DAMPING = 0.85
ROUNDS = 12               # of spread() without another number
EPSILON = 1e-6            # mass that settled() leaves under way, over all hosts; a page of a seed has 1 - DAMPING
STEP = 6                  # rounds between two looks at it
THRESHOLD = 0.5           # of a host's pages, in blocked pages net of trusted ones


def host_of(url: Column) -> Column:
    return fold(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is ``host`` or a parent domain and whose path starts ``path``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):              # the last one that fits stays
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``src, dst, w``: absolute links between hosts, and a host with its parent domain (both ways) if that is a host too.

    Self links count nowhere.  A host's edges weigh 1 in sum.
    """
    links = (pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
             .select("src", fold(F.col("dst")).alias("dst")))
    parent = F.expr("substring(host, instr(host, '.') + 1)")
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where(F.instr("dst", ".") > 0)
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    edges = (links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
             .where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    return edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank ``host, mass`` over ``src, dst, w`` from ``host, seed``.

    Every round is one join and one pre-aggregated sum; lineage is cut after
    each third.  Mass on a host without outgoing edges stays out of the next round.
    """
    start = _start(seeds, damping)
    return _rounds(edges, start, cut(start), rounds, damping)


def settled(edges: DataFrame, seeds: DataFrame, epsilon: float = EPSILON, damping: float = DAMPING) -> DataFrame:
    """As ``spread``, with as many rounds as leave at most ``epsilon`` of mass to come, summed over all hosts.

    So no host's mass is off by more.  Mass only grows, and a round adds at most ``damping`` times what the
    round before added; that bounds the rest from what the last rounds added.
    """
    start = cut(_start(seeds, damping))
    mass, total = start, start.agg(F.sum("mass")).first()[0] or 0.0
    left = total * damping / (1 - damping)
    while left > epsilon:
        mass = _rounds(edges, start, mass, STEP, damping)
        now = mass.agg(F.sum("mass")).first()[0]
        left = min(left * damping ** STEP, max(0.0, now - total) / STEP * damping / (1 - damping))
        total = now
    return mass


def _start(seeds: DataFrame, damping: float) -> DataFrame:
    return seeds.select("host", (F.col("seed") * (1 - damping)).alias("mass"))


def _rounds(edges: DataFrame, start: DataFrame, mass: DataFrame, rounds: int, damping: float) -> DataFrame:
    for i in range(rounds):
        moved = (edges.join(mass, edges.src == mass.host)
                 .select(F.col("dst").alias("host"), (damping * F.col("w") * F.col("mass")).alias("mass")))
        mass = moved.unionByName(start).groupBy("host").agg(F.sum("mass").alias("mass"))
        if i % 3 == 2 or i == rounds - 1:
            mass = cut(mass)
    return mass


@own_names("url", "html")
def judge(pages: DataFrame, rules: dict[str, str] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` (``url, html`` and more) plus ``host, path, rule, verdict, trust, distrust``, without ``html``.

    A page under a rule gets the rule's verdict.  Hosts with allowed pages are
    trusted seeds and hosts with blocked pages distrusted ones, by their number
    of such pages.  Trust goes along links from seed hosts; distrust goes
    against them, to hosts that link to distrusted ones.  A page without a rule
    is blocked if its host's distrust, net of its trust, is at least
    ``threshold`` of what the host would have if all its pages were blocked.
    Both are spread until at most ``EPSILON`` of mass over all hosts is still to come.

    A null url, or one without ``://``, has an empty host and path, no rule and is
    allowed (nothing is known against it); a null html has no links.  Repeated
    rows are judged alike; an empty table gives no rows.  Clashing columns are replaced.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    kept = [c for c in pages.columns if c not in (*new, "html")]
    url = F.coalesce("url", F.lit(""))
    judged = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    judged = judged.withColumn("said", said)
    hosts = cut(judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("said") == "allow").alias("good"),
        F.count_if(F.col("said") == "block").alias("bad")))
    edges = cut(host_edges(pages.select(host_of(url).alias("host"), "html"), hosts.select("host")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    trust = settled(edges, hosts.where("good > 0").select("host", F.col("good").cast("double").alias("seed")))
    distrust = settled(back, hosts.where("bad > 0").select("host", F.col("bad").cast("double").alias("seed")))
    scores = (hosts.join(trust.withColumnRenamed("mass", "trust"), "host", "left")
              .join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
              .select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    scores = cut(scores.withColumn("low", (F.col("host") != "") & (
        F.col("distrust") - F.col("trust") >= threshold * (1 - DAMPING) * F.col("pages"))).drop("pages"))
    return judged.join(scores, "host").select(
        *kept, "host", "path", "rule",
        F.coalesce("said", F.when(F.col("low"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
