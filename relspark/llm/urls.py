"""URL filter: rules by host and path, else trust and distrust spread over the links between hosts.

DataFrame functions only. A host is a trusted (blocked) seed if rules allow (block) at least half of its pages. Trust
is personalised PageRank from trusted seeds along links, distrust the same from blocked seeds against them. A host is
blocked if its distrust reaches THRESHOLD and exceeds its trust. Scores are whole numbers in units of 1 / SCALE, so
they don't depend on the order in which tasks add. Links are taken once for each pair of hosts; a host's links to
itself don't count. Propagation starts from the restart mass and goes on until no score changes by more than TOLERANCE,
a millionth of THRESHOLD; as a round's changes sum to at most 85 % of the last one's, that takes a number of rounds
logarithmic in the seeds' total mass. sql() takes ROUNDS rounds, after which one seed's changes are below TOLERANCE.

Few rules are one expression. More than MOST_RULES are tables, joined on the suffixes of hosts and the prefixes of paths that
some rule of that host has the length of, so that any number of rules will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 10**12
DAMPING = 85  # per cent
ROUNDS = 102  # of sql()
THRESHOLD = SCALE // 100
#: Largest change of a host's score at which propagation stops.
TOLERANCE = THRESHOLD // 10**6
MOST_ROUNDS = 1000
#: Most rules that are put into one expression.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
Rule = tuple[str, str, str]  # verdict, host, path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def strength(rule: Rule) -> tuple[int, int, str]:
    """What decides between rules that fit: the length, then the longer host, then the later verdict by name (block)."""
    verdict, host, path = rule
    return len(host + path), len(host), verdict


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=strength):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def matched(own: DataFrame, rules: DataFrame) -> DataFrame:
    """own (host, path and others) with rule and verdict of the longest rule that fits, or nulls. rules: (verdict, host, path).

    Different hosts and paths are matched once. A url has a row for each suffix of its host and each length of a path that rules
    of that suffix have, at most its own length; the strongest match (see strength) is a pre-aggregated maximum.
    """
    listed = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    listed = written(listed.withColumn("n", F.char_length("p")), "rules")
    lengths = listed.select("h", "n").distinct()
    asked = written(own.select("host", "path").distinct(), "asked")
    suffix = F.explode(F.expr("transform(sequence(1, size(split(host, '[.]', -1))), i -> substring_index(host, '.', -i))"))
    ways = asked.select("host", "path", suffix.alias("h")).join(lengths, "h").where(F.char_length("path") >= F.col("n"))
    fits = ways.select("host", "path", "h", F.expr("substring(path, 1, n)").alias("p")).join(listed, ["h", "p"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.char_length("h") + F.col("n")).alias("size"), F.char_length("h").alias("host"), F.concat("h", "p").alias("rule"), "verdict")).alias("best"))
    return own.join(best.select("host", "path", "best.rule", F.col("best.verdict").alias("own")), ["host", "path"], "left")


def propagate(links: DataFrame, seeds: DataFrame, tolerance: int = TOLERANCE, damping: int = DAMPING) -> DataFrame:
    """(kind, host, score), settled. links: (kind, source, target, degree), seeds: (kind, host, mass)."""
    base = seeds.select("kind", "host", F.expr(f"mass * {100 - damping} DIV 100").alias("score"))
    now = written(base, "scores")

    def after(scores: DataFrame) -> DataFrame:
        sent = links.join(scores.withColumnRenamed("host", "source"), ["kind", "source"])
        sent = sent.groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.expr(f"(score DIV degree) * {damping} DIV 100")).alias("score"))
        return sent.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score")).where("score > 0")

    for _ in range(MOST_ROUNDS):  # two rounds, the second compared with the first
        was = written(after(now), "scores")
        now = written(after(was), "scores")
        change = now.alias("x").join(was.alias("y"), ["kind", "host"], "full").select(F.max(F.abs(F.coalesce("x.score", F.lit(0)) - F.coalesce("y.score", F.lit(0))))).first()[0]
        if (change or 0) <= tolerance:
            return now
    raise RuntimeError("scores did not settle")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict) of each row: the longest rule's verdict, else block or allow by the host's scores.

    Null urls and urls without "://" have an empty host, which is no seed, has no links and is allowed unless a rule
    says else. Null html has no links. Repeated rows are judged alike; other columns are ignored. rules: a list, or a table
    (verdict, host, path) of any size.
    """
    host, path = host_path(F.col(url))
    own = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    if isinstance(rules, DataFrame):
        own = written(matched(own, rules), "matched")
    else:
        rule, verdict = match(F.col("host"), F.col("path"), rules)
        own = own.withColumns({"rule": rule, "own": verdict})
    share = lambda v: F.sum((F.col("own") == v).cast("int"))
    hosts = own.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), share("allow").alias("a"), share("block").alias("b"))
    kinds = F.filter(F.array(F.when(F.expr("2 * a >= n"), F.lit("trust")), F.when(F.expr("2 * b >= n"), F.lit("distrust"))), lambda k: k.isNotNull())
    seeds = written(hosts.select(F.explode(kinds).alias("kind"), "host", F.lit(SCALE).cast("long").alias("mass")), "seeds")
    ends = pages.select(host.alias("a"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("b"))
    ends = ends.select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a <> '' AND a <> b").distinct()
    ways = F.explode(F.expr("array(struct('trust' AS kind, a AS source, b AS target), struct('distrust' AS kind, b AS source, a AS target))"))
    ways = ends.select(ways.alias("w")).select("w.*")
    degrees = ways.groupBy("kind", "source").agg(F.count("*").alias("degree"))
    links = written(ways.join(degrees, ["kind", "source"]), "links")
    scores = propagate(links, seeds) if not links.isEmpty() else seeds.withColumnRenamed("mass", "score")
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0))
    bad = scores.groupBy("host").agg(of("trust").alias("t"), of("distrust").alias("d")).where(f"d >= {THRESHOLD} AND d > t").select("host", F.lit("block").alias("spread"))
    out = own.join(bad, "host", "left")
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))


def sql(rules: list[Rule]) -> str:
    """The same rows in DuckDB over the table pages."""
    cases = sorted(rules, key=strength, reverse=True)
    fits = lambda r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in cases) + " END"
    link = LINK.replace("'", "''")
    text = f"""
WITH r AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
own AS (SELECT page_id, host, path, html, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS own FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE own = 'allow') AS a, count(*) FILTER (WHERE own = 'block') AS b FROM own WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, {SCALE} AS mass FROM h WHERE 2 * a >= n UNION ALL SELECT 'distrust', host, {SCALE} FROM h WHERE 2 * b >= n),
ends AS (SELECT DISTINCT a, b FROM (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS b FROM own) WHERE a <> '' AND a <> b),
ways AS (SELECT 'trust' AS kind, a AS source, b AS target FROM ends UNION ALL SELECT 'distrust', b, a FROM ends),
links AS (SELECT *, count(*) OVER (PARTITION BY kind, source) AS degree FROM ways),
base AS (SELECT kind, host, mass * {100 - DAMPING} // 100 AS score FROM seeds),
s0 AS (SELECT * FROM base)"""
    for n in range(ROUNDS):
        text += f""",
s{n + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(score) AS BIGINT) AS score FROM (
  SELECT l.kind, l.target AS host, sum((score // degree) * {DAMPING} // 100) AS score FROM links l JOIN s{n} s ON s.kind = l.kind AND s.host = l.source GROUP BY ALL
  UNION ALL FROM base) GROUP BY kind, host HAVING sum(score) > 0)"""
    return text + f""",
last AS (SELECT * FROM s{ROUNDS} WHERE EXISTS (FROM links) UNION ALL SELECT kind, host, mass FROM seeds WHERE NOT EXISTS (FROM links)),
bad AS (SELECT host FROM last GROUP BY host HAVING coalesce(max(score) FILTER (WHERE kind = 'distrust'), 0) >= {THRESHOLD}
  AND coalesce(max(score) FILTER (WHERE kind = 'distrust'), 0) > coalesce(max(score) FILTER (WHERE kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM own
"""
