"""URL verdicts: longest-match rules first, then trust and distrust propagated over the host link graph.

Personalised PageRank runs forward from trusted hosts; distrust runs over reversed links from blocked hosts.
Everything is DataFrame functions; ranks are cut from their lineage in the shared folder at each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifstream.llm.common import ascii_lower, materialize, release

#: Fixed rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, RATIO = 0.85, 1.0
SQL_ROUNDS = 40  # of the SQL, which cannot go on until scores settle
SETTLED, LEAST = 1e-6, 1e-300  # relative change, and score, below which a score no longer counts as moving
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as ``host/path``) and its verdict; nulls where none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many links lead from one host to another; links inside a host are left out."""
    links = F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))
    out = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    out = out.select("src", ascii_lower(F.regexp_extract("link", r"//([^/?#]*)", 1)).alias("dst"))
    return out.filter((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust; each column sums to about 1).

    Each round is one join on the host a score flows from (adaptive execution splits hot hosts) and one sum
    with partial aggregation. Rounds go on until every host's scores are settled, those of hosts first reached
    included, so links are followed however far they lead; ``rounds`` asks for so many instead.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    fwd = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("out_w")).alias("pt"), F.lit(0.0).alias("pd"))
    rev = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("pt"), (F.col("w") / F.col("in_w")).alias("pd"))
    flow = materialize(fwd.unionByName(rev), "host-edges")
    if flow.isEmpty():
        return seeds
    ranks, done = seeds, 0
    while rounds is None or done < rounds:
        got = flow.join(ranks, flow["a"] == ranks["host"]).groupBy(F.col("b").alias("host")).agg(
            F.sum(F.col("pt") * F.col("trust")).alias("gt"), F.sum(F.col("pd") * F.col("distrust")).alias("gd"))
        parts = got.select("host", (damping * F.col("gt")).alias("trust"), (damping * F.col("gd")).alias("distrust")).unionByName(
            seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust")))
        before, ranks = ranks, materialize(parts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-ranks")
        done += 1
        if rounds is None:
            was = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
            moves = lambda new, old: F.abs(F.col(new) - F.coalesce(old, F.lit(0.0))) > SETTLED * F.col(new) + LEAST
            settled = ranks.join(was, "host", "left").filter(moves("trust", "t") | moves("distrust", "d")).isEmpty()
        if before is not seeds:
            release(before)
        if rounds is None and settled:
            break
    return ranks


def judge_urls(pages: DataFrame, rules=RULES, *, damping: float = DAMPING, rounds: int | None = None, floor: float = 0.0, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule and verdict for every page.

    Hosts of pages that a rule allows are the trusted seeds, hosts of pages that a rule blocks the distrusted
    ones. Where no rule fits, a host is blocked if its distrust is above ``floor`` and above ``ratio`` times its
    trust. Seeds share a mass of 1, so any ``floor`` but 0 blocks less the more seeds and links there are. Null urls and html, repeated rows and empty tables are fine: no host, no links, no rows.
    """
    host, path = url_parts(F.coalesce("url", F.lit("")))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    edges = host_edges(named)
    per_host = materialize(ruled.filter(F.col("by_rule").isNotNull()).groupBy("host").agg(
        F.max((F.col("by_rule") == "allow").cast("int")).alias("good"), F.max((F.col("by_rule") == "block").cast("int")).alias("bad")), "host-seeds")
    n = per_host.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    seeds = per_host.select("host", (F.col("good") / F.lit(max(1, n["g"] or 0))).alias("trust"), (F.col("bad") / F.lit(max(1, n["b"] or 0))).alias("distrust"))
    ranks = propagate(edges, seeds, damping=damping, rounds=rounds)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((distrust > floor) & (distrust > ratio * trust), "block").otherwise("allow")
    return ruled.join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"))


def op9_linkgraph(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(k, h, p)}'" for k, h, p in ordered) + " END"
    rounds, last = [], "seeds"
    for i in range(SQL_ROUNDS):
        rounds.append(f"""r{i} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
            SELECT f.b AS host, {DAMPING} * f.pt * r.trust AS trust, {DAMPING} * f.pd * r.distrust AS distrust FROM flow f JOIN {last} r ON r.host = f.a
            UNION ALL SELECT host, (1 - {DAMPING}) * trust, (1 - {DAMPING}) * distrust FROM seeds) GROUP BY host)""")
        last = f"r{i}"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    link = LINK.replace("'", "''")
    return f"""WITH cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        named AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT page_id, host, path, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS by_rule FROM named),
        links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM named WHERE host <> ''),
        edges AS (SELECT src, dst, count(*) AS w FROM (SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{upper}', '{lower}') AS dst FROM links) WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
        flow AS (SELECT src AS a, dst AS b, w / sum(w) OVER (PARTITION BY src) AS pt, 0.0::DOUBLE AS pd FROM edges
            UNION ALL SELECT dst, src, 0.0::DOUBLE, w / sum(w) OVER (PARTITION BY dst) FROM edges),
        per_host AS (SELECT host, max((by_rule = 'allow')::INT) AS good, max((by_rule = 'block')::INT) AS bad FROM ruled WHERE by_rule IS NOT NULL GROUP BY host),
        seeds AS (SELECT host, (good / greatest(1, sum(good) OVER ()))::DOUBLE AS trust, (bad / greatest(1, sum(bad) OVER ()))::DOUBLE AS distrust FROM per_host),
        {", ".join(rounds)}
        SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > 0 AND coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled LEFT JOIN {last} USING (host)"""


QUERIES = {"op9_linkgraph": op9_linkgraph}
SQL = {"op9_linkgraph": _sql()}
