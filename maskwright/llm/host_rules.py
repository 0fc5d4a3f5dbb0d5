"""Quality rules of documents, with verdicts on whole hosts.

Each document gets base features and a base verdict, and fails or passes each of RULES. Failures are added up by host for
each rule, and each host's rate is shrunk towards a beta prior that is fitted to all hosts' rates of that rule by moments.
A host is rejected, with all its documents, if its shrunk rate of any rule is above that rule's limit. The limit follows from the
prior: SPREAD standard deviations above its mean, but at least TIMES its mean, so that hosts that differ a little don't go
however well that is known, and at most MOST, so that hosts go that fail mostly, however many do.

Nulls: a null text has no words; a null host is a host of its own. Repeated rows count each. Ties: a rate that equals the
limit is kept. A very long text costs its length. Empty tables give no rows. Other columns, of any name, play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, table, uncollected, words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: What a document fails, by its features; the first two are the base verdict.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "20 * n_dup_lines > n_words",
}
#: The limit of a rule's shrunk rate: see above.
SPREAD, TIMES, MOST = 3.0, 2.0, 0.5

_SPACE = b" \t\n\v\f\r"
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]


def repeated_words(seen: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more, first occurrences included. Linear in the words."""
    windows = list(zip(seen, seen[1:], seen[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen = words(text)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    return len(seen), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(seen)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, the features and base_failed, in one pass without a shuffle."""
    kinds = [docs.select(F.col(id_col).alias("doc_id")).schema[0], docs.select(F.col(host_col).alias("host")).schema[0]]
    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in kinds) + ", " + ", ".join(f"{n} long" for n, _ in _FIELDS)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(features(x.as_py()) for x in b.column(2)))) or [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS))], ["doc_id", "host", *(n for n, _ in _FIELDS)])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumn("base_failed", F.expr(f"({RULES['short']}) OR ({RULES['repeats']})"))


def host_rates(rated: DataFrame) -> DataFrame:
    """A row for each host: n, and for each rule rate_<rule>, shrunk by the rule's prior, and over_<rule>, whether it is above
    the limit. Partial counts are added before the shuffle; one row for all hosts reaches the driver."""
    failed = [F.sum(F.expr(f"CAST({rule} AS LONG)")).alias(f"failed_{name}") for name, rule in RULES.items()]
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failed)
    sums = [F.sum(f"failed_{name}").alias(f"failed_{name}") for name in RULES]
    sums += [F.sum(F.col(f"failed_{name}") * F.col(f"failed_{name}") / F.col("n")).alias(f"npp_{name}") for name in RULES]
    total = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *sums).first()
    out = hosts
    for name in RULES:
        a, b = beta_prior(total["n"] or 0, total[f"failed_{name}"] or 0, total["k"], total[f"npp_{name}"] or 0.0)
        rate = (F.col(f"failed_{name}") + a) / (F.col("n") + (a + b))
        out = out.withColumns({f"rate_{name}": rate, f"over_{name}": rate > limit(a, b)})
    return out


def limit(a: float, b: float) -> float:
    """The shrunk rate above which a host is rejected, from the prior's mean and standard deviation."""
    m = a / (a + b)
    return min(max(m + SPREAD * math.sqrt(m * (1 - m) / (a + b + 1)), TIMES * m), MOST)


def beta_prior(n: int, failed: int, k: int, npp: float) -> tuple[float, float]:
    """Beta parameters with the mean of all rows and the variance between hosts, the binomial part taken off."""
    if not n:
        return 1.0, 1.0
    m = failed / n
    between = npp / n - m * m - m * (1 - m) * k / n
    strength = min(max(m * (1 - m) / between - 1, 1e-3), 1e6) if between > 1e-12 else 1e6
    return max(m * strength, 1e-9), max((1 - m) * strength, 1e-9)


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, host, features, base_failed, host_rate (the highest of the host's rates), host_rules (the rules that reject it,
    with commas) and kept: false if the base rules fail or the host is rejected.

    The narrow feature rows are written once; both the host counts and the verdicts read them. The join is on the
    host; AQE splits a hot host's rows or broadcasts the hosts where they are small.
    """
    rated = cut(with_features(docs, **columns), "host-rules")
    over = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"over_{name}"), F.lit(name)) for name in RULES))), ",")
    hosts = host_rates(rated).select(F.col("host").alias("_host"), F.greatest(*(f"rate_{name}" for name in RULES)).alias("host_rate"), over.alias("host_rules"))
    out = rated.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rules") == ""))


def op5_host_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"), "host_rules")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (
  SELECT d.k, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.k = d.k LEFT JOIN lines ON lines.k = d.k),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
u AS (SELECT source, unnest([NAMES]) AS rule, unnest([TESTS]) AS failed FROM b),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS failed FROM u GROUP BY source, rule),
m AS (SELECT rule, sum(n) AS n, sum(failed) / sum(n) AS m, count(*) AS k, sum(failed * failed / n) / sum(n) AS pp FROM h GROUP BY rule),
v AS (SELECT *, pp - m * m - m * (1 - m) * k / n AS between_v FROM m),
s AS (SELECT *, CASE WHEN between_v > 1e-12 THEN least(greatest(m * (1 - m) / between_v - 1, 1e-3), 1e6) ELSE 1e6 END AS strength FROM v),
p AS (SELECT rule, greatest(m * strength, 1e-9) AS a, greatest((1 - m) * strength, 1e-9) AS b FROM s),
l AS (SELECT *, a / (a + b) AS pm, least(greatest(pm + SPREAD * sqrt(pm * (1 - pm) / (a + b + 1)), TIMES * pm), MOST) AS lim FROM p),
r AS (SELECT source, max((failed + a) / (n + a + b)) AS rate, coalesce(string_agg(rule, ',' ORDER BY list_position([NAMES], rule)) FILTER ((failed + a) / (n + a + b) > lim), '') AS host_rules
      FROM h JOIN l USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rules = '' AS kept, round(rate, 9) AS host_rate, host_rules
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
for _name, _value in (("NAMES", ", ".join(f"'{n}'" for n in RULES)), ("TESTS", ", ".join(RULES.values())), ("SPREAD", str(SPREAD)), ("TIMES", str(TIMES)), ("MOST", str(MOST))):
    ORACLE = ORACLE.replace(_name, _value)
