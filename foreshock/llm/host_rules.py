"""Quality rules on documents and their hosts, with DataFrame functions only.

Rules are counted per document.  Failures are added up per host (``source``);
a host's rate is drawn towards all hosts' by a beta prior whose two numbers come
from the mean and variance of the hosts' own rates, so a host with few documents
is not condemned by one of them.  Documents of a host with a high rate go too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import stored

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A host is rejected when more than this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.5


def _repeated(ordered: Column) -> Column:
    """Words covered by the windows in ``ordered`` (hash, place; sorted) that equal a neighbour."""
    same = F.filter(ordered, lambda x, j: (x["h"] == F.get(ordered, j - 1)["h"]) | (x["h"] == F.get(ordered, j + 1)["h"]))
    starts = F.array_sort(F.transform(same, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n")),
        lambda a: a["n"],
    )


def document_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of every whole text.

    A null text has no words; a null source is the host ''.  Windows of words
    are compared by 64-bit hashes.  Each step is a projection of its own, so
    that no array is computed inside the loop over another.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("t"))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    d = d.select(
        "doc_id",
        "host",
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), has_word).alias("_lines"),
        F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_w"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    d = d.select(
        "doc_id",
        "host",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= WINDOW, windows).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_o", F.when(F.col("_h").isNotNull() & repeats, ordered)).drop("_h")
    counted = F.when(F.col("_o").isNotNull(), _repeated(F.col("_o"))).otherwise(0)
    d = d.withColumn("n_repeat_words", counted.cast("long")).drop("_o")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk) and host_kept, from per-document rules."""
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    weight = 0.0 if m is None else 1e6 if not v or v <= m * (1 - m) * 1e-6 else max(1e-6, m * (1 - m) / v - 1)
    shrunk = (F.col("host_failed") + F.lit(weight * (m or 0.0))) / (F.col("host_docs") + F.lit(weight))
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= MAX_HOST_RATE).alias("host_kept"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    One row per row of ``docs``; repeated rows are judged alike and each counts
    for its host.  An empty table gives no rows.
    """
    rules = stored(document_rules(docs), "rules")
    verdicts = host_verdicts(rules).select(F.col("host").alias("_host"), "host_rate", "host_kept")
    kept = ~F.col("base_failed") & F.col("host_kept")
    return rules.join(verdicts, F.col("host") == F.col("_host")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate"
    )


JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w ON d.doc_id = w.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN cover ON d.doc_id = cover.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CAST(base_failed AS INTEGER)) AS x FROM f GROUP BY host),
p AS (SELECT avg(x / n) AS mu, var_pop(x / n) AS v FROM h),
q AS (SELECT mu, CASE WHEN v <= mu * (1 - mu) * 1e-6 OR v = 0 THEN 1e6 ELSE greatest(1e-6, mu * (1 - mu) / v - 1) END AS weight FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (x + weight * mu) / (n + weight) <= 0.5 AS kept
FROM f JOIN h ON f.host = h.host CROSS JOIN q"""
