"""URL filter: rules by host and path; where none fits, trust and distrust that links carry from host to host decide."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import forget, save

# fixed values: verdict, and host with the beginning of the path
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Share of a host's trust that goes on over its links, rounds at most, and the largest change that ends them.
DAMPING, ROUNDS, SMALL = 0.85, 30, 1e-9
#: A host is blocked whose distrust is over its trust by more than this.
LIMIT = 0.5

#: Hosts of links of a page that name one.
LINK = r"""(?i)<a\s[^<>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _lower(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A to Z in lower case; empty without a ://."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """verdict and text of the longest rule that fits, or null: it names the host or a part of its end, and the path begins as the rule's.

    Rules are an expression of the scan, so pages don't move for them: meant for some hundreds at most.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """a, b of hosts that differ and one of which has pages with a link to the other, once each."""
    to = pages.select(host_of(F.col("url")).alias("a"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("b"))
    return to.select("a", _lower(F.col("b")).alias("b")).where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).select("a", "b")


def host_seeds(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, allowed, blocked: the shares of a host's pages that rules allow and block."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(host.alias("host"), rule_for(host, path, rules)["verdict"].alias("v")).where("host <> ''")
    share = lambda v: F.count_if(F.col("v") == v) / F.count(F.lit(1))
    return rows.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust: personalised PageRank from allowed shares along links, and from blocked shares against them.

    A host passes ``damping`` of what it has on, in equal parts to those that it links to (distrust:
    to those that link to it), and has what it gets besides its own share. So ranks are those of
    walks that begin at seeds and end with a host without links, scaled so that a seed that nothing
    else reaches has its share. Each round is a written table.
    """
    both = links.select(F.lit("trust").alias("kind"), "a", "b").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b")))
    both = save(both, "links")
    degree = both.groupBy("kind", "a").agg(F.count(F.lit(1)).alias("d"))
    edges = save(both.join(degree, ["kind", "a"]).select("kind", "a", "b", (F.lit(damping) / F.col("d")).alias("w")), "edges")
    own = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("allowed"), F.lit("distrust"), F.col("blocked"))).alias("kind", "s"))
    own = own.unionByName(both.select(F.col("b").alias("host"), "kind", F.lit(0.0).alias("s")))
    now = save(own.groupBy("kind", "host").agg(F.max("s").alias("s")).withColumn("t", F.col("s")), "ranks")
    forget(both)
    for _ in range(rounds):
        sent = edges.join(now.where("t > 0").select("kind", F.col("host").alias("a"), "t"), ["kind", "a"])
        got = sent.groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.col("t") * F.col("w")).alias("g"))
        then = now.join(got, ["kind", "host"], "left").select("kind", "host", "s", F.col("t").alias("was"), (F.col("s") + F.coalesce("g", F.lit(0.0))).alias("t"))
        then = save(then, "ranks")
        change = then.agg(F.max(F.abs(F.col("t") - F.col("was")))).first()[0]
        forget(now)
        now = then
        if change is None or change <= SMALL:
            break
    rank = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("t"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(rank("trust"), rank("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    The longest rule that fits decides. Where none fits, a page is blocked if its host's distrust is
    above its trust by more than ``limit``, else allowed: links carry trust from hosts whose pages
    rules allow, and distrust back to hosts that link to those whose pages rules block, each by the
    share of a host's pages. Links to the own host carry nothing.

    A null url, or one without ://, has an empty host and path and, as no rule fits, is allowed, with
    ranks of 0; its links count for no host. A null html has no links. Rows that repeat are judged each, and
    count each for their host's shares. Other columns are not looked at; an empty table gives no rows.
    """
    p = pages.select("page_id", "url", "html")
    hosts = propagated(host_links(p), host_seeds(p, rules))
    rows = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.join(hosts, "host", "left").withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    rank = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own = F.when(rank("distrust") - rank("trust") > limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), rank("trust").alias("trust"), rank("distrust").alias("distrust"))


def _url_sql(rules=RULES) -> str:
    """The same in DuckDB's SQL, a step for each round."""
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    by_length = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in by_length) + " END"
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    link = LINK.replace("'", "''").replace("(?i)", "")
    steps = [
        f"p AS (SELECT page_id, html, coalesce({lower(r'''regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')''')}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)",
        f"q AS (SELECT page_id, host, path, html, {case(1)} AS rule, {case(0)} AS verdict FROM p)",
        f"l AS (SELECT DISTINCT host AS a, {lower('b')} AS b FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS b FROM q) WHERE host <> '' AND b <> '' AND host <> {lower('b')})",
        "k AS (SELECT 'trust' AS kind, a, b FROM l UNION ALL SELECT 'distrust', b, a FROM l)",
        f"e AS (SELECT *, {DAMPING}::double / count(*) OVER (PARTITION BY kind, a) AS w FROM k)",
        "s AS (SELECT kind, host, max(s) AS s FROM (SELECT 'trust' AS kind, host, avg(CASE WHEN verdict = 'allow' THEN 1.0::double ELSE 0.0 END) AS s FROM q WHERE host <> '' GROUP BY host "
        "UNION ALL SELECT 'distrust', host, avg(CASE WHEN verdict = 'block' THEN 1.0::double ELSE 0.0 END) FROM q WHERE host <> '' GROUP BY host UNION ALL SELECT kind, b, 0.0 FROM k) GROUP BY kind, host)",
        "t0 AS (SELECT kind, host, s, s AS t FROM s)",
    ]
    for r in range(ROUNDS):
        steps.append(f"t{r + 1} AS (SELECT x.kind, x.host, x.s, x.s + coalesce(g, 0.0) AS t FROM t{r} x LEFT JOIN (SELECT e.kind, e.b, sum(y.t * e.w) AS g FROM e JOIN t{r} y ON y.kind = e.kind AND y.host = e.a GROUP BY ALL) z ON z.kind = x.kind AND z.b = x.host)")
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps]
    return "WITH " + ",\n".join(steps) + f"""
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.t, 0) - coalesce(u.t, 0) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN (SELECT host AS h, t FROM t{ROUNDS} WHERE kind = 'distrust') d ON d.h = q.host LEFT JOIN (SELECT host AS h, t FROM t{ROUNDS} WHERE kind = 'trust') u ON u.h = q.host"""


URL_SQL = _url_sql()
