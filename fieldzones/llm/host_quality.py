"""Host-level quality rules, in DataFrame functions only.

Every document is measured (words, symbols, repeated lines and word windows) and held against
``RULES``.  Rule failures are counted by host (``source``; null is a host of its own), and each
host's failure rate is shrunk towards all hosts by a beta prior, whose two parameters come from
the mean and variance of the hosts' rates (method of moments), so that a host of a few documents
is not judged by them alone.  A host whose shrunk rate is over ``REJECT`` for a rule loses all its
documents, one over ``SUSPECT`` those that break the rule themselves; documents that fail the
base rule go in any case.

Windows of five words are compared by 64-bit hashes inside one text.  Null or empty text: no
words, base_failed.  Repeated rows are documents of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

REJECT, SUSPECT = 0.5, 0.25
_SPACE = "[\\x20\\x09-\\x0D]+"
#: name: does a measured document break the rule
RULES = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that a text has twice or more."""
    windows = F.transform(words, lambda _, i: F.xxhash64(F.slice(words, i + 1, 5)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def cover(placed):
        same = F.filter(placed, lambda p, k: (p["h"] == F.get(placed, k - 1)["h"]) | (p["h"] == F.get(placed, k + 1)["h"]))
        return F.aggregate(F.sort_array(F.transform(same, lambda p: p["i"])), zero, lambda a, i: F.struct(
            (a["n"] + i + 5 - F.greatest(i, a["to"])).alias("n"), (i + 5).alias("to")), lambda a: a["n"])

    def count(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, cover))

    return F.when(F.size(words) < 5, 0).otherwise(let(F.slice(windows, 1, F.size(words) - 4), count))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    found = docs.select("doc_id", F.col(host).alias("host"), of_words.alias("w"), of_lines.alias("l"),
                        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"))
    return base.stored(found).select("doc_id", "host", "w.n_words", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines", "word_chars", "n_symbols")


def host_rates(measured: DataFrame) -> DataFrame:
    """Of each host: documents, and for each rule the shrunk failure rate ``rate_<rule>``."""
    hosts = base.stored(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(f"k_{r}") for r, rule in RULES.items()]))
    rate = {r: F.col(f"k_{r}") / F.col("n") for r in RULES}
    row = hosts.agg(*[x for r in RULES for x in (F.avg(rate[r]).alias(f"m_{r}"), F.var_pop(rate[r]).alias(f"v_{r}"))]).first()
    shrunk = []
    for r in RULES:
        m, v = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        weight = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6  # alpha + beta
        shrunk.append(((F.col(f"k_{r}") + m * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
    return hosts.select("host", "n", *shrunk)


def judge(measured: DataFrame, reject: float = REJECT, suspect: float = SUSPECT) -> DataFrame:
    """``measured`` with base_failed, host_failed and kept."""
    rates = base.stored(host_rates(measured)).withColumnRenamed("host", "host_")
    found = measured.join(rates, F.col("host").eqNullSafe(F.col("host_")))
    gone = F.lit(False)
    for r, rule in RULES.items():
        gone = gone | (F.col(f"rate_{r}") > reject) | ((F.col(f"rate_{r}") > suspect) & F.expr(rule))
    return found.withColumn("base_failed", F.expr(RULES["base"])).withColumn("host_failed", gone).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


_SQL_RULES = " , ".join(f"({rule}) AS f_{r}" for r, rule in RULES.items())
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM
        (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
m AS (SELECT d.r, doc_id, host, len(w)::BIGINT AS n_words, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM d JOIN w ON d.r = w.r LEFT JOIN rep ON d.r = rep.r),
m2 AS (SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM m),
f AS (SELECT *, {_SQL_RULES} FROM m2),
h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (f_{r}) AS k_{r}" for r in RULES)} FROM f GROUP BY host),
p AS (SELECT {", ".join(f"avg(k_{r} / n) AS m_{r}, var_pop(k_{r} / n) AS v_{r}" for r in RULES)} FROM h),
q AS (SELECT {", ".join(f"m_{r}, CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), 1e6) ELSE 1e6 END AS w_{r}" for r in RULES)} FROM p),
s AS (SELECT host, {", ".join(f"(k_{r} + m_{r} * w_{r}) / (n + w_{r}) AS rate_{r}" for r in RULES)} FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
       NOT f_base AND NOT ({" OR ".join(f"rate_{r} > {REJECT} OR (rate_{r} > {SUSPECT} AND f_{r})" for r in RULES)}) AS kept
FROM f JOIN s ON f.host IS NOT DISTINCT FROM s.host
"""


@register("op2_host_rules", ORACLE)
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(measure(base.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
