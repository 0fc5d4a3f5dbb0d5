"""URL filter: a character language-model ratio between accepted and rejected URLs.

Rules on host and path judge some URLs. Two variable-order Markov models over characters, one of the accepted and one
of the rejected URLs, judge the others by the difference of their log-likelihoods for each character, against a limit
calibrated on labelled URLs that the models did not see. Everything is DataFrame functions.

Model: contexts of 0 to ORDER characters. P_k(c | ctx) = (n(ctx c) + S * P_{k-1}(c | shorter ctx)) / (n(ctx) + S), ending in
a uniform 1/256; a context that the class never had passes to the shorter one unchanged, so the order varies by context.

Nulls and urls without ``://``: empty host and path, no rule; scored on the text they have. An empty URL scores 0 and
is allowed when the limit is at most 0. Repeated rows get equal verdicts. Without labelled URLs on either side, no model
can be had and all unruled URLs are allowed. A very long URL costs its length. Empty tables give no rows. Other
columns, of any name, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, table

#: Longest context in characters.
ORDER = 3
#: Strength of the shorter context's estimate.
SMOOTHING = 2.0
#: Each labelled URL whose hash falls to 0 of this many parts calibrates the limit; the others teach the models.
HOLD_OUT = 5
#: Scores are calibrated on this grid, in nats for each character.
GRID = 0.01

#: (verdict, host suffix, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _AZ, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, label (the rule's verdict)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return out.withColumns({"rule": rule, "label": verdict})


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of each URL: the kept columns, ``ctx`` (the ORDER characters before it, \\u0002 before the start) and ``ch``."""
    padded = F.concat(F.lit("\u0002" * ORDER), F.translate("url", _AZ, _LOW))
    # single characters once, so that a long URL costs no more than its length
    out = urls.where(F.length("url") > 0).select(*keep, F.filter(F.split(padded, ""), lambda c: c != "").alias("_c"))
    at = lambda i: F.struct(F.concat(*(F.get("_c", i + k) for k in range(ORDER))).alias("ctx"), F.get("_c", i + ORDER).alias("ch"))
    return out.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.size("_c") - (ORDER + 1)), at)).alias("_g")).select(*keep, "_g.ctx", "_g.ch")


def llr_table(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ctx, ch, llr) for each distinct (ctx, ch) of ``wanted``: log of accepted over rejected smoothed probability.

    ``counts`` has (label, ctx, ch, n) of order ORDER; lower orders are sums of it, made for all orders and both labels at
    once. All tables here hold distinct character n-grams, which the alphabet bounds, not the number of URLs.
    """
    orders = F.sequence(F.lit(0), F.lit(ORDER))
    short = lambda k: F.substring(F.col("ctx"), F.lit(ORDER + 1) - k, k)
    by_order = lambda df, *keep: df.select(*keep, F.explode(F.transform(orders, lambda k: F.struct(k.alias("k"), short(k).alias("c")))).alias("o")).select(*keep, "o.k", "o.c")
    each = lambda f: [F.sum(F.when(F.col("label") == kind, F.col(f))).alias(f"{f}_{kind}") for kind in ("allow", "block")]
    n = by_order(counts, "label", "ch", "n").groupBy("k", "c", "ch").agg(*each("n"))
    totals = by_order(counts.groupBy("label", "ctx").agg(F.sum("n").alias("t")), "label", "t").groupBy("k", "c").agg(*each("t"))
    met = by_order(wanted, "ctx", "ch").join(n, ["k", "c", "ch"], "left")
    # of order 0 there is one context: its total for either label is a number, and no join key that all n-grams share
    whole = {r["label"]: int(r["t"]) for r in counts.groupBy("label").agg(F.sum("n").alias("t")).collect()}
    met = met.withColumn("j", F.when(F.col("k") > 0, F.col("c")).otherwise(F.concat("ctx", "ch"))).join(totals.where("k > 0").withColumnRenamed("c", "j"), ["k", "j"], "left")
    met = met.withColumns({f"t_{kind}": F.when(F.col("k") > 0, F.col(f"t_{kind}")).otherwise(F.lit(whole.get(kind)).cast("long")) for kind in ("allow", "block")})
    out = met.groupBy("ctx", "ch").agg(F.sort_array(F.collect_list(F.struct("k", "n_allow", "n_block", "t_allow", "t_block"))).alias("o"))

    def smoothed(kind: str) -> Column:
        step = lambda p, x: F.when(x[f"t_{kind}"].isNull(), p).otherwise((F.coalesce(x[f"n_{kind}"], F.lit(0)) + SMOOTHING * p) / (x[f"t_{kind}"] + SMOOTHING))
        return F.aggregate("o", F.lit(1 / 256), step)

    return out.select("ctx", "ch", (F.log(smoothed("allow")) - F.log(smoothed("block"))).alias("llr"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) for each row.

    Distinct URLs are scored once, with the characters' n-grams counted before any join, so that repeated URLs and hot
    hosts cost no more than their distinct texts.
    """
    rows = ruled(pages, id_col, url_col)
    urls = cut(rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.first("label").alias("label")), "url-markov")
    # the part comes from the URL itself: reruns and other SQL engines agree
    part = F.conv(F.substring(F.md5("url"), 1, 6), 16, 10).cast("long") % HOLD_OUT
    # each URL becomes as many rows as it has characters: so many tasks as a shuffle has, however small the URLs are
    urls = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")
    keyed = urls.withColumn("_k", F.unhex(F.md5("url"))).withColumn("held", F.col("label").isNotNull() & (part == 0))
    chars = cut(grams(keyed, "_k", "label", "held"), "url-grams")
    counts = chars.where(F.col("label").isNotNull() & ~F.col("held")).groupBy("label", "ctx", "ch").agg(F.count(F.lit(1)).alias("n"))
    scored = chars.where(F.col("label").isNull() | F.col("held"))
    llr = llr_table(counts, scored.select("ctx", "ch").distinct())
    # both sides shrink before they meet: a URL's equal n-grams are one row
    each = scored.groupBy("_k", "label", "ctx", "ch").agg(F.count(F.lit(1)).alias("n"))
    score = cut(each.join(llr, ["ctx", "ch"]).groupBy("_k", "label").agg((F.sum(F.col("n") * F.col("llr")) / F.sum("n")).alias("score")), "url-scores")
    taught = {r["label"] for r in counts.select("label").distinct().collect()}
    limit = calibrate(score.where(F.col("label").isNotNull())) if len(taught) == 2 else float("-inf")
    unruled = score.where(F.col("label").isNull()).select("_k", "score")
    out = rows.join(unruled, F.unhex(F.md5("url")) == F.col("_k"), "left")
    verdict = F.when(F.coalesce(F.round("score", 9), F.lit(0.0)) >= F.lit(limit), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("label"), verdict).alias("verdict"), F.round("score", 6).alias("score"))


def calibrate(labelled: DataFrame) -> float:
    """The limit with the greatest sum of the accepted share at or above it and the rejected share below it; ties: the lowest.

    Only a histogram on a fixed grid between -6 and 6 nats comes to the driver.
    """
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-6.0)), F.lit(6.0)) / GRID + 1e-9)
    bins = sorted((r["b"], r["good"], r["bad"]) for r in labelled.groupBy(step.alias("b")).agg(F.count_if(F.col("label") == "allow").alias("good"), F.count_if(F.col("label") == "block").alias("bad")).collect())
    goods, bads = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not goods or not bads:
        return 0.0
    best, at, below_good, below_bad = -1.0, 0.0, 0, 0
    for b, good, bad in bins:
        value = (goods - below_good) / goods + below_bad / bads
        if value > best + 1e-12:
            best, at = value, b * GRID
        below_good, below_bad = below_good + good, below_bad + bad
    return at


def op10_url_markov(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """The same in DuckDB."""
    url = f"translate(url, '{_AZ}', '{_LOW}')"
    fits = {h: f"(host = '{h}' OR ends_with(host, '.{h}'))" for _, h, _ in RULES}
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits[h]} AND starts_with(path, '{p}') THEN '{value(k, h, p)}'" for k, h, p in order) + " END"
    steps, last = [], {}
    for kind in ("allow", "block"):
        steps.append(f"q_{kind} AS (SELECT ctx, ch, 1.0 / 256 AS p FROM wanted)")
        last[kind] = f"q_{kind}"
        for k in range(ORDER + 1):
            short = f"substr(ctx, {ORDER + 1 - k}, {k})" if k else "''"
            steps += [
                f"n_{kind}{k} AS (SELECT {short} AS c, ch AS h, sum(n) AS n FROM counts WHERE label = '{kind}' GROUP BY 1, 2)",
                f"t_{kind}{k} AS (SELECT c, sum(n) AS t FROM n_{kind}{k} GROUP BY 1)",
                f"p_{kind}{k} AS (SELECT ctx, ch, CASE WHEN t IS NULL THEN p ELSE (coalesce(n, 0) + {SMOOTHING} * p) / (t + {SMOOTHING}) END AS p FROM {last[kind]} LEFT JOIN n_{kind}{k} n ON n.c = {short} AND n.h = ch LEFT JOIN t_{kind}{k} t ON t.c = {short})",
            ]
            last[kind] = f"p_{kind}{k}"
    return rf"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_AZ}', '{_LOW}'), '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
rows_ AS (SELECT *, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS label FROM b),
urls AS (SELECT url, min(label) AS label, min(label) IS NOT NULL AND ('0x' || substr(md5(url), 1, 6))::BIGINT % {HOLD_OUT} = 0 AS held FROM rows_ WHERE url IS NOT NULL GROUP BY url),
padded AS (SELECT url, label, held, repeat(chr(2), {ORDER}) || {url} AS u, unnest(generate_series(1, length(url))) AS i FROM urls WHERE length(url) > 0),
chars AS (SELECT url, label, held, substr(u, i, {ORDER}) AS ctx, substr(u, i + {ORDER}, 1) AS ch FROM padded),
counts AS (SELECT label, ctx, ch, count(*) AS n FROM chars WHERE label IS NOT NULL AND NOT held GROUP BY ALL),
scored AS (SELECT * FROM chars WHERE label IS NULL OR held),
wanted AS (SELECT DISTINCT ctx, ch FROM scored),
{", ".join(steps)},
llr AS (SELECT x.ctx, x.ch, ln(x.p) - ln(y.p) AS llr FROM {last["allow"]} x JOIN {last["block"]} y ON x.ctx = y.ctx AND x.ch = y.ch),
score AS (SELECT url, label, avg(llr) AS score FROM scored JOIN llr USING (ctx, ch) GROUP BY url, label),
bins AS (SELECT floor(least(greatest(score, -6), 6) / {GRID} + 1e-9) AS b, count(*) FILTER (label = 'allow') AS good, count(*) FILTER (label = 'block') AS bad FROM score WHERE label IS NOT NULL GROUP BY 1),
cum AS (SELECT b, (sum(good) OVER () - coalesce(sum(good) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(good) OVER () + coalesce(sum(bad) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(bad) OVER () AS v FROM bins),
lim AS (SELECT CASE WHEN (SELECT count(DISTINCT label) FROM counts) < 2 THEN '-infinity'::DOUBLE ELSE coalesce((SELECT b * {GRID} FROM cum WHERE v IS NOT NULL ORDER BY round(v, 10) DESC, b LIMIT 1), 0) END AS lim)
SELECT page_id, host, path, rule, coalesce(rows_.label, CASE WHEN coalesce(round(score.score, 9), 0) >= lim.lim THEN 'allow' ELSE 'block' END) AS verdict
FROM rows_ LEFT JOIN (SELECT url, score FROM score WHERE label IS NULL) score ON score.url = rows_.url, lim
"""


ORACLE = _oracle()
