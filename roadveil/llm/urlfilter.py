"""Operator 2: URL rules, and trust and distrust carried over the host graph.

Columns and SQL functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadveil.llm.common import ascii_lower, staged

#: (verdict, host and path) of the rules that hold for a host and all its subdomains
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UNIT = 10**15
DAMPING = 0.85
ROUNDS = 10
STAGED_ROUNDS = 5
#: the run ends when the scores of a kind change by less than an even share of all hosts over this, summed
FINENESS = 200
LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?(?:https?:)?//([^/?#"' \t\r\n>]+)"""
LONGEST_HOST = 253


def host_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, w)``: hyperlinks between hosts by their number, and a host and the domain
    above it (two labels at least) once in either direction."""
    links = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w"))
    hosts = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")).distinct().filter((F.length("host") <= LONGEST_HOST) & (F.size(F.split("host", r"\.")) >= 3))
    labels = hosts.select(F.split("host", r"\.").alias("l"))
    above = labels.select("l", F.explode(F.expr("sequence(1, size(l) - 2)")).alias("i")).selectExpr("array_join(slice(l, i, size(l) - i + 1), '.') AS below", "array_join(slice(l, i + 1, size(l) - i), '.') AS above").distinct()
    both = above.selectExpr("below AS src", "above AS dst", "1L AS w").unionByName(above.selectExpr("above AS src", "below AS dst", "1L AS w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def host_scores(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """``(host, trust, distrust)`` in units of 1e-15: personalised PageRank from hosts with
    allowed pages, and the same against the links from hosts with blocked pages.

    Rounds go on until what is still to come is below 1 / (FINENESS n) for n hosts: a round's summed
    change shrinks by the damping at least, so all later rounds add up to change * d / (1 - d).
    Scores are whole numbers, every contribution rounded down, so sums do not depend
    on their order. What a hub receives is pre-aggregated; its outgoing rows are an ordinary
    join side that may be split.
    """
    edges = staged(spark, host_edges(pages), "edges")
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("w").alias("total"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("w").alias("total"))
    share = (F.lit(DAMPING) * F.col("w")) / F.col("total")
    forward = edges.join(out, edges["src"] == out["host"]).select(F.lit("trust").alias("kind"), "src", "dst", share.alias("share"))
    backward = edges.join(into, edges["dst"] == into["host"]).select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), share.alias("share"))
    steps = staged(spark, forward.unionByName(backward), "steps")

    ruled = judged(pages, rules).filter("ruled IS NOT NULL AND host <> ''").groupBy("host", "ruled").agg(F.count("*").alias("n"))
    ruled = staged(spark, ruled.select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "n"), "seeds")
    totals = {r[0]: r[1] for r in ruled.groupBy("kind").agg(F.sum("n")).collect()}  # two rows
    whole = F.when(F.col("kind") == "trust", F.lit(totals.get("trust", 1))).otherwise(F.lit(totals.get("distrust", 1)))
    seeds = ruled.select("kind", "host", F.floor(F.lit(float(UNIT)) * F.col("n") / whole).cast("long").alias("score"))
    rest = seeds.select("kind", "host", F.floor(F.col("score") * F.lit(1 - DAMPING)).cast("long").alias("score"))
    n = max(1, edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct().count())
    state, left = seeds, None
    while left is None or left > UNIT // (FINENESS * n) and left < before:
        before = UNIT**2 if left is None else left
        for _ in range(STAGED_ROUNDS):
            last = state
            carried = state.join(steps, (state["host"] == steps["src"]) & (state["kind"] == steps["kind"])).select(state["kind"], F.col("dst").alias("host"), F.floor(F.col("score") * F.col("share")).cast("long").alias("score"))
            state = carried.unionByName(rest).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        both = state.join(last.withColumnRenamed("score", "was"), ["kind", "host"], "full").select("kind", "host", "score", "was")
        both = staged(spark, both, "scores")
        change = both.groupBy("kind").agg(F.sum(F.abs(F.coalesce("score", F.lit(0)) - F.coalesce("was", F.lit(0)))).alias("change"))
        left = (change.agg(F.max("change")).first()[0] or 0) * DAMPING / (1 - DAMPING)  # one number
        state = both.filter("score IS NOT NULL").select("kind", "host", "score")
    per_host = state.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).alias(k) for k in ("trust", "distrust")])
    return per_host


def judge(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, host, path, rule, verdict)``, one row each.

    The longest fitting rule decides. Elsewhere a page is blocked if its host's distrust
    exceeds its trust by more than half an even share of all hosts in the graph, else
    allowed. Null url or no ``://``: empty host and path, allowed. Null html has no
    links. Hosts of over 253 characters are judged but have no place in the domain tree.
    Repeated rows and null ids are kept; empty tables give no rows; further columns are
    ignored.
    """
    pages = pages.select("page_id", "url", "html")
    scores = staged(spark, host_scores(spark, pages, rules), "hosts")
    n = max(1, scores.count())
    bad = scores.filter(F.col("distrust") - F.col("trust") > UNIT // (2 * n)).select(F.col("host").alias("bad"))
    bad = staged(spark, bad, "bad")
    rows = judged(pages, rules)
    return rows.join(bad, rows["host"] == bad["bad"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def oracle_sql(rules=RULES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB, every round written out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    link = LINK.replace("'", "''")
    rule, ruled = "NULL", "NULL"
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}'))"
        rule, ruled = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {ruled} END"
    parts = [
        f"""parts AS (SELECT page_id, html,
      CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), '{upper}', '{lower}') ELSE '' END AS host,
      CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)""",
        f"judged AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM parts)",
        f"links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{upper}', '{lower}') AS dst FROM parts)",
        f"labels AS (SELECT DISTINCT string_split(host, '.') AS l FROM parts WHERE length(host) <= {LONGEST_HOST})",
        "tree AS (SELECT DISTINCT array_to_string(list_slice(l, i, len(l)), '.') AS below, array_to_string(list_slice(l, i + 1, len(l)), '.') AS above FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels WHERE len(l) >= 3))",
        """edges AS (SELECT src, dst, sum(w) AS w FROM (
      SELECT src, dst, count(*) AS w FROM links WHERE src <> '' AND src <> dst GROUP BY ALL
      UNION ALL SELECT below, above, 1 FROM tree UNION ALL SELECT above, below, 1 FROM tree) GROUP BY src, dst)""",
        f"""steps AS (SELECT 'trust' AS kind, src, dst, (CAST({DAMPING} AS DOUBLE) * w) / sum(w) OVER (PARTITION BY src) AS share FROM edges
      UNION ALL SELECT 'distrust', dst, src, (CAST({DAMPING} AS DOUBLE) * w) / sum(w) OVER (PARTITION BY dst) FROM edges)""",
        "ruled AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL)",
        f"s0 AS (SELECT kind, host, CAST(floor(CAST({UNIT} AS DOUBLE) * n / sum(n) OVER (PARTITION BY kind)) AS BIGINT) AS score FROM ruled)",
        f"rest AS (SELECT kind, host, CAST(floor(score * CAST({1 - DAMPING!r} AS DOUBLE)) AS BIGINT) AS score FROM s0)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"""s{k} AS MATERIALIZED (SELECT kind, host, CAST(sum(score) AS BIGINT) AS score FROM (
      SELECT s.kind, dst AS host, CAST(floor(score * share) AS BIGINT) AS score FROM s{k - 1} s JOIN steps t ON s.host = t.src AND s.kind = t.kind
      UNION ALL SELECT * FROM rest) GROUP BY kind, host)""")
    parts.append(f"hosts AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM s{rounds} GROUP BY host)")
    parts.append(f"bad AS (SELECT host FROM hosts WHERE distrust - trust > (SELECT {UNIT} // (2 * greatest(1, count(*))) FROM hosts))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"
