"""URL filters by a path-template tree.

Each host has a tree of path segments. Runs of digits in a segment become ``#``; a node's segments become
``*`` where they vary: at least ``MIN_DISTINCT`` different ones that make up at least ``DISTINCT_SHARE`` of
the pages. Levels are walked until no node of a level has two ways on: below it nothing could be a wildcard or
merge, however deep the paths are; levels where no node has two ways on are passed at once. Then, from the leaves up, branches of a node whose share of bad labels doesn't differ from the other branches' by a
two-proportion z-test merge into one. A leaf's share is smoothed towards its host's and that towards the
whole corpus'; templates above ``MAX_BAD`` are rejected. Fixed rules come before the method.

Only DataFrame functions run here. A node with a third of all pages is summed before it is shuffled.
Nulls: a null url, or one without ``://``, has empty host and path; pages without a label count for
variety only. Pages with one id are judged each. An empty table gives no rows; without labels nothing is
rejected. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

MIN_DISTINCT = 20
DISTINCT_SHARE = 0.3
Z = 1.96
WEIGHT = 5.0
MAX_BAD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by text) and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def _upto(templates: str, k: int) -> Column:
    """The node at level k: the first k segments, which have no slash."""
    return F.array_join(F.slice(templates, 1, k), "/") if k else F.lit("")


def template_verdicts(pages: DataFrame, labels: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """``pages`` (page_id, host, path, label_key) with the method's verdict; ``labels`` has label_key and bad (0 or 1)."""
    told = labels.groupBy("label_key").agg(F.max("bad").alias("bad"))
    paths = pages.select("page_id", "host", "path", "label_key", _segments(F.col("path")).alias("parts"))
    # Most pages of a site may have no key: they go round the join, which would gather them in one task.
    told = written(told, "url-labels")
    known = paths.filter("label_key is not null").join(told.hint("shuffle_merge"), "label_key", "left").select("host", "parts", "bad")
    nodes = (
        known.unionByName(paths.filter("label_key is null").select("host", "parts", F.lit(None).cast("int").alias("bad")))
        .groupBy("host", "parts")
        .agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    )
    source = nodes = written(nodes.withColumn("t", F.array().cast("array<string>")), "url-nodes")
    drop_written(told)
    # Generalise: t has a segment or a wildcard for each level; a path that has ended goes on with empty segments.
    depth, levels = 0, []
    while True:
        above, own = _upto("t", depth), F.coalesce(F.get("parts", F.lit(depth)), F.lit(""))
        tail = F.slice("parts", depth + 1, 1 << 20)
        at = nodes.withColumns({"above": above, "own": own, "tail": tail})
        # Written apart from the join, so that Spark can split a host with many nodes there.
        variety = at.groupBy("host", "above").agg(F.count_distinct("own").alias("kinds"), F.sum("pages").alias("all_pages"), F.min("tail").alias("low"), F.max("tail").alias("high"))
        # All tails of a node go together as far as the least and the greatest do.
        together = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False) - 1
        variety = written(variety.select("host", "above", "kinds", "all_pages", F.when(F.col("low") != F.col("high"), together).alias("together")), "url-variety")
        passed = variety.agg(F.min("together")).first()[0]
        if passed is None:
            drop_written(variety)
            break
        if passed:
            drop_written(variety)
            nodes = nodes.withColumn("t", F.concat("t", F.array(*(F.coalesce(F.get("parts", F.lit(depth + j)), F.lit("")) for j in range(passed)))))
            depth += passed
            continue
        variable = (F.col("kinds") >= MIN_DISTINCT) & (F.col("kinds") >= DISTINCT_SHARE * F.col("all_pages"))
        found = at.join(variety.hint("shuffle_merge"), ["host", "above"]).withColumn("t", F.concat("t", F.array(F.when(variable, "*").otherwise(F.col("own")))))
        nodes, before = written(found.select("host", "parts", "pages", "n", "b", "t"), "url-templates"), source
        for used in (variety, before):
            drop_written(used)
        levels.append(depth)
        source, depth = nodes, depth + 1
    # Merge from the leaves: m has for each of these levels t's segment, or * if the branch is like the others of its node.
    source = nodes = nodes.withColumn("m", F.array().cast("array<string>"))
    for k in reversed(levels):
        at = nodes.withColumns({"above": _upto("t", k), "own": F.get("t", F.lit(k))})
        branch = written(at.groupBy("host", "above", "own").agg(F.sum("n").alias("bn"), F.sum("b").alias("bb")), "url-branches")
        whole = written(branch.groupBy("host", "above").agg(F.sum("bn").alias("wn"), F.sum("bb").alias("wb")), "url-wholes")
        on, ob = F.col("wn") - F.col("bn"), F.col("wb") - F.col("bb")
        spread = F.col("wb") * (F.col("wn") - F.col("wb"))
        # z squared without division: (b1 n2 - b2 n1)^2 n / (n1 n2 w (n - w)) for w bad of n.
        apart = (F.col("bn") * on > 0) & ((F.col("bb") * on - ob * F.col("bn")).cast("double") ** 2 * F.col("wn") > Z * Z * (F.col("bn") * on).cast("double") * spread.cast("double"))
        merged = branch.join(whole.hint("shuffle_merge"), ["host", "above"]).select("host", "above", "own", F.when(apart, F.col("own")).otherwise("*").alias("now"))
        found = at.join(merged.hint("shuffle_merge"), ["host", "above", "own"]).withColumn("m", F.concat(F.array("now"), "m"))
        nodes = written(found.select("host", "parts", "pages", "n", "b", "t", "m"), "url-merging")
        for used in (branch, whole, source):
            drop_written(used)
        source = nodes
    nodes = written(nodes.select("host", "parts", "m", "n", "b"), "url-merged")
    drop_written(source)
    by_template = nodes.groupBy("host", "m").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    by_host = by_template.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    every = by_host.agg(F.sum("hn").alias("n"), F.sum("hb").alias("b")).first()
    prior = (every["b"] or 0) / every["n"] if every["n"] else 0.0
    host_share = (F.col("hb") + WEIGHT * prior) / (F.col("hn") + WEIGHT)
    share = (F.col("b") + WEIGHT * host_share) / (F.col("n") + WEIGHT)
    verdicts = by_template.join(by_host.hint("shuffle_merge"), "host").select("host", "m", F.when(share > max_bad, "block").otherwise("allow").alias("verdict"))
    shapes = nodes.join(verdicts.hint("shuffle_merge"), ["host", "m"]).select("host", "parts", "verdict")
    return paths.join(shapes.hint("shuffle_merge"), ["host", "parts"]).select("page_id", "host", "path", "verdict")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are by document; a page's document is the first number of its path."""
    host, path = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    key = F.expr("try_cast(regexp_extract(path, '[0-9]+', 0) AS long)")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_key"), bad.alias("bad")).filter("label_key is not null")
    judged = template_verdicts(pages.withColumn("label_key", key), labels)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("verdict")).alias("verdict"))


#: The SQL walks a fixed number of levels, the operator as many as there are; a level where nothing parts changes nothing.
SQL_LEVELS = 12


def _op3_sql() -> str:
    names, t, m = ([f"{x}{k}" for k in range(SQL_LEVELS)] for x in "stm")
    sql = [
        f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p0 AS MATERIALIZED (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p1 AS MATERIALIZED (SELECT *, try_cast(regexp_extract(path, '[0-9]+', 0) AS BIGINT) AS label_key,
       list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS parts FROM p0),
p AS MATERIALIZED (SELECT page_id, host, path, label_key, {", ".join(f"coalesce(parts[{k + 1}], '') AS s{k}" for k in range(SQL_LEVELS - 1))}, array_to_string(parts[{SQL_LEVELS}:], '/') AS s{SQL_LEVELS - 1} FROM p1),
l AS MATERIALIZED (SELECT doc_id AS label_key, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g0 AS MATERIALIZED (SELECT host, {", ".join(names)}, count(*) AS pages, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM p LEFT JOIN l USING (label_key) GROUP BY ALL)"""
    ]
    for k in range(SQL_LEVELS):
        above = ", ".join(["host", *t[:k]])
        sql.append(
            f"g{k + 1} AS MATERIALIZED (SELECT x.*, CASE WHEN kinds >= {MIN_DISTINCT} AND kinds >= {DISTINCT_SHARE} * all_pages THEN '*' ELSE s{k} END AS t{k} "
            f"FROM g{k} x JOIN (SELECT {above}, count(DISTINCT s{k}) AS kinds, sum(pages) AS all_pages FROM g{k} GROUP BY {above}) USING ({above}))"
        )
    last = f"g{SQL_LEVELS}"
    for k in reversed(range(SQL_LEVELS)):
        above = ", ".join(["host", *t[:k]])
        sql.append(
            f"""b{k} AS MATERIALIZED (SELECT {above}, t{k}, sum(n) AS bn, sum(b) AS bb FROM {last} GROUP BY {above}, t{k}),
c{k} AS MATERIALIZED (SELECT {above}, t{k}, CASE WHEN bn * (wn - bn) > 0 AND pow(CAST(bb * (wn - bn) - (wb - bb) * bn AS DOUBLE), 2) * wn > {Z * Z} * CAST(bn * (wn - bn) AS DOUBLE) * CAST(wb * (wn - wb) AS DOUBLE) THEN t{k} ELSE '*' END AS m{k}
  FROM b{k} JOIN (SELECT {above}, sum(bn) AS wn, sum(bb) AS wb FROM b{k} GROUP BY {above}) USING ({above})),
d{k} AS MATERIALIZED (SELECT x.*, m{k} FROM {last} x JOIN c{k} USING ({above}, t{k}))"""
        )
        last = f"d{k}"
    ms = ", ".join(["host", *m])
    case = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{q}') THEN '{{}}'".replace("{}", f"{what}|{text}")
        for what, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
        for h, _, q in [text.partition("/")]
    )
    sql.append(
        f"""e AS (SELECT {ms}, sum(n) AS n, sum(b) AS b FROM {last} GROUP BY {ms}),
h AS (SELECT host, sum(n) AS hn, sum(b) AS hb FROM e GROUP BY host),
w AS (SELECT CASE WHEN sum(hn) > 0 THEN CAST(sum(hb) AS DOUBLE) / CAST(sum(hn) AS DOUBLE) ELSE 0 END AS prior FROM h),
v AS (SELECT {", ".join("e." + c for c in ["host", *m])}, CASE WHEN (b + {WEIGHT}::DOUBLE * ((hb + {WEIGHT}::DOUBLE * prior) / (hn + {WEIGHT}::DOUBLE))) / (n + {WEIGHT}::DOUBLE) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM e JOIN h USING (host), w),
o AS (SELECT host, {", ".join(names)}, verdict FROM {last} JOIN v USING ({ms})),
r AS (SELECT page_id, host, path, CASE {case} END AS fit, verdict FROM p JOIN o USING (host, {", ".join(names)}))
SELECT page_id, host, path, split_part(fit, '|', 2) AS rule, coalesce(split_part(fit, '|', 1), verdict) AS verdict FROM r"""
    )
    return ",\n".join(sql)


OP3_SQL = _op3_sql()
