"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each text gets counts in one pass without a shuffle. Rules are rates that junk has much of; a rule rejects from a
cutoff on. Labelled rows that the base rules keep are split by the MD5 of the key as text: a quarter of them learn, the
rest is the holdout. Learning rows give a path of rule sets, each one cutoff stricter than the one before. For each rule and each of
SHARES, a cutoff is the lowest of the grid that turns away at most so many thousandths of the good ones; it counts if its gain (bad rows
turned away, each good one counting COST times) is positive. Cutoffs join the path one at a time, by their share, then the greatest gain: the
path begins with the single best rule, and a rule that only looks good on the learning rows comes after those that are.

The holdout certifies the steps: a step passes if a binomial test rejects "its rules together turn away at least RISK of the good
rows": P(Bin(n, RISK) <= k) <= LEVEL / tests, k of the n good holdout rows being turned away by any rule. This is the exact (Clopper-Pearson)
upper bound below RISK; testing stops at the first step that fails (fixed sequence; k never falls along the path), Bonferroni covers the
tests, whose number depends on the strata's sizes only. Of the steps that pass, the one of largest gain on both parts is taken, ties going to the mildest, and none without gain.

A stratum with enough good holdout rows to certify anything, if none is turned away, has a path of its own. If that certifies nothing, it
takes the steps of the path of all rows that its own holdout certifies, by a test of its own. So with probability 1 - LEVEL no such stratum
loses more than RISK of its good rows to all rules together. Smaller strata, for which no such statement can be made, take the mildest
step of the path of all rows only, and only if that is certified on all rows: the limit then holds for all rows taken together. Strata
without any labelled row keep their rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, written

RISK = 0.02
LEVEL = 0.05
COST = 5
#: Keys whose MD5 comes before it learn: a quarter.
LEARN = "4"
#: False rejections of a rule among learning rows, in thousandths, by step.
SHARES = [0, 1, 2, 3, 5, 8, 12, 20]
#: Grid of cutoffs of every rule, in thousandths.
GRID = [5, 10, 20, 30, 40, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900, 1000]
#: The group of all rows, for strata too small for one of their own.
POOL = "*"
#: Rules: thousandths by name.
RULES = {
    "symbols": "1000 * n_symbols DIV greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines DIV greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words DIV greatest(n_words, 1)",
    "capitals": "1000 * n_capitals DIV greatest(word_chars, 1)",
    "exclaims": "1000 * n_exclaims DIV greatest(n_words, 1)",
}
BROADCAST_ROWS = 10_000


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM x) WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
f AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims, coalesce(l.n, 0) AS n_lines, coalesce(l.d, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (SELECT doc_id, lang, base_failed, unnest([{", ".join(f"{{'rule': '{n}', 'v': {e.replace(' DIV ', ' // ')}}}" for n, e in RULES.items())}], recursive := true) FROM b),
o AS (SELECT doc_id, row_number() OVER () AS r, lang, quality = 1 AS good, md5(CAST(doc_id AS VARCHAR)) < '{LEARN}' AS learn FROM b JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
z AS (SELECT lang, count(*) FILTER (WHERE good AND NOT learn) AS n FROM o GROUP BY 1),
own AS (SELECT lang, pow(1 - {RISK}, n) <= {LEVEL} / (2 * count(*) OVER () + 1) AS able FROM z),
y AS (SELECT {LEVEL} / (2 * count(*) FILTER (WHERE able) + 1) AS level FROM own),
x2 AS (SELECT lang, 's' || lang AS grp FROM own WHERE able UNION ALL SELECT lang, '{POOL}' FROM own),
c AS (SELECT grp, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND v >= cutoff) AS k, count(*) FILTER (WHERE NOT good AND v >= cutoff) AS bad
  FROM o JOIN x2 USING (lang) JOIN v USING (doc_id) CROSS JOIN (SELECT unnest({GRID}) AS cutoff) WHERE learn GROUP BY ALL),
p AS (SELECT grp, rule, t, arg_min(cutoff, cutoff) AS cutoff, arg_min(bad - {COST} * k, cutoff) AS gain FROM c CROSS JOIN (SELECT unnest({SHARES}) AS share, unnest(range({len(SHARES)})) AS t) WHERE 1000 * k <= share * n GROUP BY ALL),
path AS (SELECT grp, rule, cutoff, row_number() OVER (PARTITION BY grp ORDER BY min(t), any_value(gain) DESC, list_position({list(RULES)}, rule), cutoff DESC) AS j FROM p WHERE gain > 0 GROUP BY grp, rule, cutoff),
u AS (SELECT lang, 's' || lang AS grp, 's' || lang AS unit FROM own WHERE able UNION ALL SELECT lang, '{POOL}', 's' || lang FROM own WHERE able UNION ALL SELECT lang, '{POOL}', '{POOL}' FROM own),
h AS (SELECT r, u.grp, u.unit, good, learn, min(path.j) AS first FROM o JOIN u USING (lang) JOIN v ON v.doc_id = o.doc_id LEFT JOIN path ON path.grp = u.grp AND path.rule = v.rule AND v.v >= path.cutoff GROUP BY ALL),
q AS (SELECT h.grp, unit, j, count(*) FILTER (WHERE good AND NOT learn) AS n, count(*) FILTER (WHERE good AND first <= j AND NOT learn) AS k, count(*) FILTER (WHERE NOT good AND first <= j) - {COST} * count(*) FILTER (WHERE good AND first <= j) AS gain FROM h JOIN path ON path.grp = h.grp GROUP BY ALL),
s AS (SELECT grp, unit, j, gain, CASE WHEN k >= n * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) END <= level AS ok FROM q, y),
g AS (SELECT grp, unit, arg_max(j, gain * 1000 - j) AS j FROM s WHERE ok AND gain > 0 GROUP BY 1, 2),
e AS (SELECT lang, CASE WHEN a.j IS NOT NULL THEN 's' || lang ELSE '{POOL}' END AS grp, coalesce(a.j, CASE WHEN able THEN b.j WHEN w.j IS NOT NULL THEN 1 END) AS j
  FROM own LEFT JOIN g a ON a.grp = 's' || lang AND a.unit = a.grp LEFT JOIN g b ON b.grp = '{POOL}' AND b.unit = 's' || lang LEFT JOIN g w ON w.grp = '{POOL}' AND w.unit = w.grp),
broken AS (SELECT v.doc_id, string_agg(DISTINCT v.rule, ',' ORDER BY list_position({list(RULES)}, v.rule)) AS broken FROM v JOIN e USING (lang) JOIN path p ON p.grp = e.grp AND p.j <= e.j AND p.rule = v.rule WHERE v.v >= p.cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken FROM b LEFT JOIN broken USING (doc_id)
"""


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs without the text, and the counts of each text (null: empty)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(*kept, t.alias("_t"))
    out = out.withColumn("_w", F.array_remove(F.split("_t", WORD_SEPARATORS, -1), ""))
    own = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words"]
    lines = F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    grams = F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)))")
    out = out.select(
        *[c for c in kept],
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("_t", r"[^!]+", "")).cast("long").alias("n_exclaims"),
        lines.alias("_l"),
        F.when(F.size("_w") >= 3, grams).otherwise(F.expr("array()").cast("array<bigint>")).alias("_g"),
    )
    out = out.withColumns({"_d": F.size(F.array_distinct("_g")), "_n": F.size("_g")})
    sorted_grams = F.expr("sort_array(transform(_g, (h, i) -> struct(h AS h, i AS i)))")
    out = out.withColumn("_s", F.when(F.col("_d") < F.col("_n"), sorted_grams))
    places = F.expr("array_sort(transform(filter(transform(_s, (x, i) -> IF(get(_s, i - 1).h = x.h OR get(_s, i + 1).h = x.h, x.i, NULL)), i -> i IS NOT NULL), i -> i))")
    covered = F.expr("aggregate(_p, struct(-3 AS l, 0 AS n), (a, i) -> struct(i AS l, a.n + least(3, i - a.l) AS n), a -> a.n)")
    out = out.withColumn("_p", places)
    return out.select(
        *[c for c in kept],
        "n_words", "word_chars", "n_symbols", "n_capitals", "n_exclaims",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    ).select(*kept, *own)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def tail(k: str, n: str, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 where k is at least n * p, where it can't be small.

    Summed from the largest term down, over so many terms (in proportion to the standard deviation) that the rest is nothing.
    """
    gamma = lambda x: f"(({x} + 7.5D) * ln({x} + 8.0D) - ({x} + 8.0D) + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * ({x} + 8.0D)) - 1 / (360 * pow({x} + 8.0D, 3)) + 1 / (1260 * pow({x} + 8.0D, 5)) - ln({x} + 0.0D) - ln({x} + 1.0D) - ln({x} + 2.0D) - ln({x} + 3.0D) - ln({x} + 4.0D) - ln({x} + 5.0D) - ln({x} + 6.0D) - ln({x} + 7.0D))"  # noqa: E731  of its logarithm
    top = f"{gamma(f'({n} + 1)')} - {gamma(f'({k} + 1)')} - {gamma(f'({n} - {k} + 1)')} + {k} * {math.log(p)!r}D + ({n} - {k}) * {math.log1p(-p)!r}D"
    down = f"ln(CAST(greatest({k} - i, 1) AS DOUBLE)) - ln(CAST({n} - {k} + i + 1 AS DOUBLE)) + {math.log1p(-p) - math.log(p)!r}D"
    terms = f"least({k}, CAST(50 + 12 * sqrt({n} * {p!r}D) AS BIGINT))"
    total = f"aggregate(sequence(0L, {terms}), struct({top} AS t, 0.0D AS s), (a, i) -> struct(a.t + {down} AS t, a.s + exp(a.t) AS s), a -> a.s)"
    return F.expr(f"CASE WHEN {k} >= {n} * {p!r}D THEN 1.0D ELSE {total} END")


def thresholds(features: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cutoffs: map of rule to cutoff) of the strata with certified rules. labels: (key, label), 1 good, 0 bad, null ignored.

    A key's several labels count as that many rows. A row for each stratum at most; what is counted is pre-aggregated.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), (F.col(label) == 1).alias("good"), (F.md5(F.col(key).cast("string").cast("binary")) < LEARN).alias("learn"))
    values = F.array(*[F.expr(e).cast("long") for e in RULES.values()])
    known = features.where(~base_failed()).join(known, features[key] == F.col("_key")).select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "good", "learn", values.alias("v"))
    known = written(known, "known")
    strata = written(known.groupBy("stratum").agg(F.count_if(F.expr("good AND NOT learn")).alias("n")), "strata")
    found = strata.count()
    strata = strata.select("stratum", (F.pow(F.lit(1 - risk), "n") <= level / (2 * found + 1)).alias("able"), F.concat(F.lit("s"), "stratum").alias("own"))
    level /= 2 * strata.where("able").count() + 1
    small = lambda df: F.broadcast(df) if found <= BROADCAST_ROWS else df
    known = known.join(small(strata), "stratum")

    rank = F.expr(f"transform(v, x -> size(filter(array({', '.join(map(str, GRID))}), c -> c <= x)))")
    groups = F.explode(F.expr(f"IF(able, array(own, '{POOL}'), array('{POOL}'))"))
    cells = known.where("learn").withColumn("group", groups).select("group", "good", F.posexplode(rank).alias("rule", "rank")).groupBy("group", "rule", "rank").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    cells = cells.groupBy("group", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("rank", "good", "bad")).alias("cells"))  # at most a cell for each rank
    above = lambda what: f"aggregate(cells, 0L, (a, c) -> IF(c.rank > at, a + c.{what}, a))"
    cutoffs = F.transform(F.array(*map(F.lit, GRID)), lambda c, i: F.struct(c.alias("cutoff"), i.alias("at")))
    at = cells.select("group", "rule", "n", "cells", F.inline(cutoffs)).withColumns({"k": F.expr(above("good")), "bad": F.expr(above("bad"))})
    steps = at.select("group", "rule", "cutoff", "k", "bad", F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.expr(f"1000 * k <= {share} * n").alias("fits")) for t, share in enumerate(SHARES)])))
    steps = steps.where("fits").groupBy("group", "rule", "t").agg(F.min(F.struct("cutoff", (F.col("bad") - COST * F.col("k")).alias("gain"))).alias("best"))
    steps = steps.where("best.gain > 0").groupBy("group", "rule", "best.cutoff").agg(F.min("t").alias("t"), F.min(-F.col("best.gain")).alias("loss"))
    path = F.sort_array(F.collect_list(F.struct("t", "loss", "rule", (-F.col("cutoff")).alias("less"), "cutoff")))  # at most a cutoff for each rule and share
    path = written(steps.groupBy("group").agg(path.alias("path")), "path")

    units = F.inline(F.expr(f"IF(able, array(struct(own AS group, own AS unit), struct('{POOL}' AS group, own AS unit), struct('{POOL}' AS group, '{POOL}' AS unit)), array(struct('{POOL}' AS group, '{POOL}' AS unit)))"))
    first = F.expr("array_min(transform(path, (s, i) -> IF(v[s.rule] >= s.cutoff, i + 1, NULL)))")  # the step from which on a row is turned away
    judged = known.select("good", "learn", "v", units).join(small(path), "group").select("group", "unit", "good", "learn", first.alias("j"))
    held = F.expr("good AND NOT learn")
    sums = judged.groupBy("group", "unit", "j").agg(F.count_if(held).alias("k"), (F.count_if(~F.col("good")) - COST * F.count_if("good")).alias("gain"))
    unit = Window.partitionBy("group", "unit")  # a row for each step
    tests = sums.withColumn("n", F.sum("k").over(unit)).where("j IS NOT NULL")
    tests = tests.withColumns({c: F.sum(c).over(unit.orderBy("j")) for c in ("k", "gain")})
    passed = tests.where((tail("k", "n", risk) <= F.lit(level)) & (F.col("gain") > 0))
    chosen = written(passed.groupBy("group", "unit").agg(F.max_by("j", F.struct("gain", -F.col("j"))).alias("j")), "steps")
    of = lambda group, unit, name: chosen.where(group & unit).select(F.col("unit").alias(f"unit_{name}"), F.col("j").alias(name))
    pooled = F.col("group") == POOL
    taken = strata.join(of(~pooled, F.col("unit") != POOL, "mine"), F.col("own") == F.col("unit_mine"), "left").join(of(pooled, F.col("unit") != POOL, "lent"), F.col("own") == F.col("unit_lent"), "left").join(of(pooled, F.col("unit") == POOL, "every"), F.lit(POOL) == F.col("unit_every"), "left")
    taken = taken.select("stratum", F.when(F.col("mine").isNotNull(), F.col("own")).otherwise(POOL).alias("group"), F.coalesce("mine", F.when(F.col("able"), F.col("lent")).when(F.col("every").isNotNull(), 1)).alias("j"))
    least = lambda n: F.array_min(F.transform(F.filter(F.slice("path", F.lit(1), F.col("j")), lambda s: s["rule"] == n), lambda s: s["cutoff"]))
    every = F.create_map(*[x for n, name in enumerate(RULES) for x in (F.lit(name), least(n))])
    return taken.where("j IS NOT NULL").join(path, "group").select("stratum", F.map_filter(every, lambda _, c: c.isNotNull()).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """Key, stratum, counts, base_failed, the rules that a row breaks, and kept, one row for each row of docs, and columns to carry.

    Null, empty and word-less texts have no words and fail the base rules. Rows with a null stratum form a stratum
    of their own, as do rows whose stratum has no labels (they keep what base rules keep). Rows with a null key have no
    label and are judged like others. Repeated rows are judged alike. Other columns of docs are ignored.
    """
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(carry or [])])
    features = written(counts(docs.select(F.col(key), F.col(stratum).alias("lang"), F.col(text).alias("text"), rest.alias("_carry")), "text"), "counts")
    by_stratum = written(thresholds(features, labels, key, "lang", label), "thresholds")
    if by_stratum.count() <= BROADCAST_ROWS:
        by_stratum = F.broadcast(by_stratum)
    out = features.withColumn("_s", F.coalesce(F.col("lang").cast("string"), F.lit(""))).join(by_stratum, F.col("_s") == F.col("stratum"), "left")
    broken = F.array(*[F.when(F.expr(e) >= F.element_at("cutoffs", F.lit(n)), F.lit(n)) for n, e in RULES.items()])
    out = out.withColumns({"base_failed": base_failed(), "broken": F.concat_ws(",", broken)})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == "")).drop("_s", "stratum", "cutoffs")
    return out.select(*[c for c in out.columns if c != "_carry"], *[F.col(f"_carry.c{n}").alias(c) for n, c in enumerate(carry or [])])
