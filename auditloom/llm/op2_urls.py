"""URL filters: rules first, then propagation over the graph of hosts.

Pages that a rule allows are trusted seeds, pages that a rule blocks are distrusted ones. Trust spreads along host edges
(personalised PageRank from the trusted seeds), distrust against them (from the blocked seeds). A host is blocked if its
own and inherited distrust a page is above that of the whole table, and above its trust. Only DataFrame functions are used.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table, written

#: Fixed rules of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of a score that moves along edges in a round; what has not settled after k rounds is DAMPING^k of the seeds.
DAMPING = 0.5
#: Rounds go on until less than this share of one page's score is left unsettled in the whole graph.
TOLERANCE = 0.001
#: A host is blocked from this many times the table's distrust a page, if its trust a page is less.
THRESHOLD = 1.0
#: Digits that scores are rounded to before they are compared, so that the order of sums decides nothing.
DIGITS = 6
#: Pages of one host are dealt to so many parts when they meet their host's verdict.
SALTS = 64


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, w)``: links between hosts, counted, from absolute and scheme-relative addresses in ``html``.

    A host and the hosts above it (``a.b.c.d``, ``b.c.d`` and ``c.d``, whether they have pages or not) also stand for
    each other one by one, with the weight of one link: relative links stay on a host, and hosts of one site belong together.
    """
    found = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(found)).alias("url"))
    linked = linked.select("src", host_of(F.concat(F.lit("x://"), F.regexp_extract("url", r"//(.*)$", 1))).alias("dst"))
    counted = linked.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).select(F.split("host", r"\.").alias("parts"))
    from_label = lambda i: F.array_join(F.slice("parts", i, F.size("parts")), ".")
    up = hosts.where("size(parts) > 2").select("parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 2)).alias("i")).select(from_label(F.col("i")).alias("src"), from_label(F.col("i") + 1).alias("dst")).distinct()
    tree = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    return counted.unionByName(tree).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def rounds_for(seeds: float, damping: float = DAMPING) -> int:
    """Rounds after which less than TOLERANCE of all ``seeds`` is unsettled, whatever the graph."""
    return ceil(log2(max(seeds, 1.0) / TOLERANCE) / -log2(damping))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank ``(kind, host, score)`` from ``seeds(kind, host, seed)`` along ``edges(kind, src, dst, w)``.

    Kinds spread side by side, each over its own edges. A round is a join on the source, so a hub's edges can be split,
    and a sum with partial aggregates; every fourth round is written to the shared folder. The number of rounds follows
    from the seeds' sum. A host without edges keeps what it has.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all_w"))
    shares = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all_w")).alias("share")), "shares")
    ends = seeds.select("kind", "host").unionByName(shares.select("kind", F.col("dst").alias("host"))).distinct().join(shares.select("kind", F.col("src").alias("host")).distinct(), ["kind", "host"], "left_anti")
    loops = ends.select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    shares = written(shares.unionByName(loops), "shares")
    score = seeds.select("kind", "host", F.col("seed").alias("score"))
    for k in range(rounds_for(seeds.agg(F.sum("seed")).first()[0] or 0.0, damping)):
        moved = score.withColumnRenamed("host", "src").join(shares, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = moved.unionByName(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            score = written(score, "score")
    return score


def host_verdicts(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(host, trust, distrust, verdict)`` from ``pages(host, html, ruled)``, ruled being the rule's verdict or null.

    Trust and distrust are scores a page. The threshold is a multiple of what all hosts with pages have together, so it
    follows the table and not its size.
    """
    counts = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "hosts")
    links = host_edges(pages)
    edges = written(links.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "edges")
    seeds = counts.select("host", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("double").alias("seed")) for kind, c in (("trust", "good"), ("distrust", "bad"))))).alias("s")).select("s.kind", "host", "s.seed").where("seed > 0")
    scores = propagate(edges, written(seeds, "seeds")).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("score"))).alias(kind) for kind in ("trust", "distrust")))
    both = counts.join(scores, "host", "left").select("host", "n", *(F.coalesce(kind, F.lit(0.0)).alias(kind) for kind in ("trust", "distrust")))
    both = written(both, "ranked")
    usual = both.agg(F.round(F.sum("distrust") / F.sum("n") * threshold, DIGITS)).first()[0] or 0.0  # one number
    each = both.select("host", *(F.round(F.col(kind) / F.col("n"), DIGITS).alias(kind) for kind in ("trust", "distrust")))
    return each.withColumn("verdict", F.when((F.col("distrust") > usual) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages(page_id, url, html)``.

    Trust and distrust are the host's. Nulls: a null url, or one without ``://``, has an empty host and path and fits no
    rule; such pages are one host without links. A null html has no links; a null page_id is kept. Rules of equal length
    that both fit: the later one. Very long urls and pages: whole, by built-in expressions. Repeated rows: a row each.
    Empty table: no rows. Other columns are not read.
    """
    host, path = host_of(pages["url"]), path_of(pages["url"])
    named = pages.select(pages["page_id"], host.alias("host"), path.alias("path"), pages["html"])
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumn("rule", rule).withColumn("ruled", ruled)
    # each page of a hot host meets one of SALTS copies of its host's row
    told = host_verdicts(named.select("host", "html", "ruled"), threshold)
    told = told.select("host", "trust", "distrust", F.col("verdict").alias("spread"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = named.drop("html").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    return salted.join(told, ["host", "salt"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread").alias("verdict"), "trust", "distrust")


def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _rank_sql(name: str, edges: str, seeds: str) -> str:
    """Common table expressions of a propagation; the last one, ``name``, has the scores.

    The recursion moves what is left of the seeds; a score is the part that each round leaves behind and the last rest.
    """
    return f"""{name}_o AS (SELECT src, sum(w) AS t FROM {edges} GROUP BY src),
 {name}_s AS (SELECT src, dst, w/t AS share FROM {edges} JOIN {name}_o USING (src) UNION ALL SELECT host, host, 1.0 FROM (SELECT host FROM {seeds} UNION SELECT dst FROM {edges}) WHERE host NOT IN (SELECT src FROM {edges})),
 {name}_m AS (SELECT 0 AS k, host, seed AS x FROM {seeds} UNION ALL SELECT k+1, dst, sum(x*share*{DAMPING}) FROM {name}_m JOIN {name}_s ON src=host WHERE k<(SELECT rounds FROM rounds) GROUP BY k, dst),
 {name} AS (SELECT host, sum(CASE WHEN k=(SELECT rounds FROM rounds) THEN x ELSE x*{1 - DAMPING} END) AS score FROM {name}_m GROUP BY host)"""


def _oracle() -> str:
    lower = "translate(coalesce(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    pick = lambda i: "CASE " + " ".join(f"WHEN (host='{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(kind, h + p)[i]}'" for kind, h, p in longest) + " END"
    links = r"""unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)))"""
    return f"""WITH RECURSIVE p AS (SELECT page_id, html, {lower.format("url")} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), r AS (SELECT *, {pick(1)} AS rule, {pick(0)} AS ruled FROM p),
 h AS (SELECT host, count(*) AS n, (count(*) FILTER (ruled='allow'))::DOUBLE AS good, (count(*) FILTER (ruled='block'))::DOUBLE AS bad FROM r GROUP BY host),
 l AS (SELECT host AS src, {lower.format("'x://' || regexp_extract(u, '//(.*)$', 1)")} AS dst FROM (SELECT host, {links} AS u FROM r)),
 up AS (SELECT DISTINCT array_to_string(q[i:], '.') AS a, array_to_string(q[i+1:], '.') AS b FROM (SELECT q, unnest(generate_series(1, len(q)-2)) AS i FROM (SELECT string_split(host, '.') AS q FROM h))),
 e AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT src, dst, 1 AS w FROM l WHERE src<>'' AND dst<>'' AND src<>dst UNION ALL SELECT a, b, 1 FROM up UNION ALL SELECT b, a, 1 FROM up) GROUP BY ALL), back AS (SELECT dst AS src, src AS dst, w FROM e),
 sg AS (SELECT host, good AS seed FROM h WHERE good>0), sb AS (SELECT host, bad AS seed FROM h WHERE bad>0), rounds AS (SELECT ceil(log2(greatest(coalesce(sum(seed), 0), 1)/{TOLERANCE})/{-log2(DAMPING)})::INT AS rounds FROM (SELECT seed FROM sg UNION ALL SELECT seed FROM sb)), {_rank_sql("trust", "e", "sg")}, {_rank_sql("distrust", "back", "sb")},
 z AS (SELECT h.host, n, coalesce(t.score, 0) AS t, coalesce(d.score, 0) AS d FROM h LEFT JOIN trust t USING (host) LEFT JOIN distrust d USING (host)),
 v AS (SELECT host, round(t/n, {DIGITS}) AS trust, round(d/n, {DIGITS}) AS distrust, (SELECT round(sum(d)/sum(n)*{THRESHOLD}, {DIGITS}) FROM z) AS usual FROM z)
 SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust>usual AND distrust>trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM r JOIN v USING (host)"""


QUERIES = {"op2_url_graph": op2_url_graph}
ORACLE_SQL = {"op2_url_graph": _oracle()}
