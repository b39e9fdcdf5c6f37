"""Quality rules with host-level verdicts (operator 10), in DataFrame functions only.

Each text is measured without any shuffle: words are runs outside 0x20 and 0x09-0x0D; repeated 8-word windows are found
by their 64-bit hashes in arrays, and the array of (hash, position) is only sorted for texts that have a repeat.

Rules of two strengths apply to a document. The base rule fails n_words < 20 or 100 * n_repeat_words > 30 * n_words.
The soft rules are suspicions: many symbols per word, many repeated lines, unusual mean word length. For each rule, failures are counted by host; a beta prior is fitted to the hosts' rates by moments; a host's
rate is shrunk to (failures + alpha) / (documents + alpha + beta). A host whose shrunk rate of a rule exceeds that
rule's limit gets a verdict, which is joined back: there, a document that fails that soft rule is not kept. A document
that fails no rule is always kept, whatever its host; a document of a sound host is only dropped by the base rule.

Sums by host are combined before the shuffle, so a host with a third of all rows costs one row a task; the verdicts
are one row a host and rule. Null texts have no words (base_failed is true). A null host is a host of its own.
Repeated rows count as often as they come. Columns of the input are kept; the measures replace columns with the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import written

WINDOW = 8
#: Spaces that part words, as a Java character class.
SPACE = "[\\x20\\x09-\\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "host_failed", "kept")
#: rule -> (SQL over the measures, most of a host's shrunk rate).
SOFT = {
    "symbols": ("n_symbols > 0.1 * n_words", 0.25),
    "lines": ("n_dup_lines > 0", 0.25),
    "lengths": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", 0.25),
}
BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of 8 words which is found twice or more in the array."""

    def by_hash(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            starts = F.array_sort(
                F.transform(
                    F.filter(
                        p,
                        lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            )
            return F.aggregate(
                starts,
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
                lambda s: s["n"],
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    hashed = _let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: _let(windows(w), by_hash))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(hashed)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five measures of its texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    made = F.transform(
        F.array(F.struct(words.alias("w"), lines.alias("l"))),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.aggregate(s["w"], F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            repeat_words(s["w"]).alias("n_repeat_words"),
        ),
    )
    at = "__measures"
    out = docs.withColumn(at, F.get(made, F.lit(0)))
    kept = [out[c] for c in docs.columns if c.lower() not in MEASURES]
    return out.select(*kept, *(F.col(f"{at}.{m}").alias(m) for m in MEASURES))


def host_rates(docs: DataFrame, host: str) -> DataFrame:
    """host, rule, n, failures, alpha, beta, rate, bad: one row for each host and soft rule, over measured documents."""
    sums = docs.groupBy(host).agg(
        F.count("*").alias("n"), *(F.sum(F.expr(f"CAST({test} AS INT)")).alias(rule) for rule, (test, _) in SOFT.items())
    )
    stack = ", ".join(f"'{rule}', {rule}, {limit}D" for rule, (_, limit) in SOFT.items())
    long = sums.selectExpr(f"`{host}` AS host", "n", f"stack({len(SOFT)}, {stack}) AS (rule, failures, most)")
    p = F.col("failures") / F.col("n")
    prior = (
        long.groupBy("rule")
        .agg(F.avg(p).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"))
        .withColumn("strength", F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1.0)))
        .select("rule", (F.col("m") * F.col("strength")).alias("alpha"), ((1 - F.col("m")) * F.col("strength")).alias("beta"))
    )
    rate = (F.col("failures") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))
    return long.join(prior, "rule").withColumn("rate", rate).withColumn("bad", F.col("rate") > F.col("most"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns in keep, all by default) with the measures, base_failed, host_failed and kept.

    The measures are taken once: they are written to the shared folder, and both the hosts' sums and the verdicts'
    join read them there."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*MEASURES, *VERDICTS)]
    base = measured(docs, text).withColumn("__from", F.col(host)).select(*keep, "__from", *MEASURES)
    base = written(base, "quality-measures")
    rates = host_rates(base, "__from")
    verdicts = rates.where("bad").groupBy(F.col("host").alias("__host")).agg(
        *(F.max(F.expr(f"rule = '{rule}'")).alias(f"__{rule}") for rule in SOFT)
    )
    verdicts = written(verdicts, "quality-verdicts")  # of known size: few bad hosts are broadcast, many are joined by a shuffle
    out = base.join(verdicts, base["__from"].eqNullSafe(verdicts["__host"]), "left")
    bad = " OR ".join(f"(coalesce(__{rule}, false) AND ({test}))" for rule, (test, _) in SOFT.items())
    out = out.select(*keep, *MEASURES, F.expr(f"({BASE})").alias("base_failed"), F.expr(f"({bad})").alias("host_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 7)) AS c FROM k),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS o FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT source, 'symbols' AS rule, count(*) AS n, count(*) FILTER (n_symbols > 0.1 * n_words) AS x FROM m GROUP BY source
      UNION ALL SELECT source, 'lines', count(*), count(*) FILTER (n_dup_lines > 0) FROM m GROUP BY source
      UNION ALL SELECT source, 'lengths', count(*), count(*) FILTER (word_chars < 2 * n_words OR word_chars > 12 * n_words) FROM m GROUP BY source),
p AS (SELECT rule, avg(x / n) AS mu, coalesce(var_samp(x / n), 0) AS v FROM f GROUP BY rule),
s AS (SELECT rule, mu, CASE WHEN v > 0 AND mu * (1 - mu) > v THEN mu * (1 - mu) / v - 1 ELSE 1.0 END AS strength FROM p),
h AS (SELECT source, rule FROM f JOIN s USING (rule) WHERE (x + mu * strength) / (n + strength) > 0.25),
b AS (SELECT source, bool_or(rule = 'symbols') AS b1, bool_or(rule = 'lines') AS b2, bool_or(rule = 'lengths') AS b3 FROM h GROUP BY source),
q AS (SELECT m.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
             (coalesce(b1, false) AND n_symbols > 0.1 * n_words) OR (coalesce(b2, false) AND n_dup_lines > 0)
             OR (coalesce(b3, false) AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)) AS host_failed
      FROM m LEFT JOIN b ON m.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept FROM q
"""
