"""URL filter: the ratio of two character language models, one of accepted and one of rejected URLs.

A URL, in lower case and with every digit as 0, is read as characters behind ``ORDER`` start marks and before an
end mark.  Each model is a variable-order Markov model: the chance of a character after its last k characters is
(count + T * chance after the last k - 1) / (N + T), where N counts what followed that context and T its kinds
(Witten-Bell); below order 0 every character has 1/``ALPHABET``.  A URL's score is the log-likelihood under
the rejected model less that under the accepted one, divided by its characters.  The threshold is calibrated on
accepted URLs that trained nothing: at most ``FALSE_REJECTS`` of those lie above it, and it is 0 at least.

The caller says by seed words what is rejected: a URL is rejected for training if a seed word begins a word of its
host; accepted if the document that its path names is labelled good and not toxic, and its host has no seed word.  A
quarter of the accepted URLs, chosen by MD5, is held out for the threshold; the others and all rejected ones train.
Labels of bad documents are not used: those pages stand on the same hosts as the good ones.

All of it is joins and sums over character runs: counts of the longest runs are summed up from all URLs, the
shorter ones from those, and each position of a URL is joined to its run's log ratio.

Defined results
* a null URL has no score (null) and is kept; the empty URL is its end mark alone;
* an unseen context passes to the next shorter one; a class without a URL has the uniform model;
* without a URL that is held out the threshold is 0; repeated rows are scored each;
* scores are rounded to six places before they are compared; URLs of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ORDER = 5
ALPHABET = 256.0
FALSE_REJECTS = 0.01
#: The words that the registered query rejects by.
SEEDS = ("adult", "casino", "pills", "bets", "ads-", "spam")
#: First hexadecimal digits of the MD5 of URLs that are held out.
HELD = "3"
_START, _END = "\u0002", "\u0003"


def _pattern(seeds: tuple[str, ...]) -> str:
    return f"(^|[^a-z0-9])({'|'.join(map(re.escape, seeds))})"


def labelled(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """(page_id, url, accepted, rejected, held) of every page; held: accepted, and trains nothing."""
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1)
    bad = F.coalesce(host.rlike(_pattern(seeds)), F.lit(False))
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("named")).distinct().withColumn("good", F.lit(True))
    named = F.regexp_extract("url", "/([0-9]{1,18})", 1)
    rows = pages.select("page_id", "url", bad.alias("rejected"), F.when(named != "", named.cast("long")).alias("named")).join(good, "named", "left")
    accepted, held = F.coalesce("good", F.lit(False)) & ~F.col("rejected"), F.coalesce(F.substring(F.md5("url"), 1, 1) <= HELD, F.lit(False))
    return rows.select("page_id", "url", (accepted & ~held).alias("accepted"), "rejected", (accepted & held).alias("held"))


def _runs(urls: DataFrame, order: int) -> DataFrame:
    """``urls`` with a row for each character and its run of order + 1 characters."""
    shape = F.concat(F.lit(_START * order), F.regexp_replace(F.lower("url"), "[0-9]", "0"), F.lit(_END))
    return urls.where("url IS NOT NULL").withColumn("shape", shape).select(*urls.columns, F.explode(F.expr(f"transform(sequence(1, char_length(shape) - {order}), i -> substring(shape, i, {order + 1}))")).alias("run"))


def _model(runs: DataFrame, order: int) -> DataFrame:
    """(run, ratio) of every run that occurs: log chance of its last character, rejected less accepted."""
    counts = [runs.groupBy("run").agg(F.sum(F.col("accepted").cast("long")).alias("na"), F.sum(F.col("rejected").cast("long")).alias("nr"))]
    counts[0] = written(counts[0], "runs")
    for k in range(order, 0, -1):
        counts.append(counts[-1].groupBy(F.substring("run", 2, k).alias("run")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr")))
    below = None
    for k, now in enumerate(reversed(counts)):
        context = F.substring("run", 1, k)
        totals = now.groupBy(context.alias("context")).agg(*(F.sum(n).alias(f"s{n}") for n in ("na", "nr")), *(F.sum((F.col(n) > 0).cast("long")).alias(f"t{n}") for n in ("na", "nr")))
        joined = now.withColumn("context", context).join(totals, "context")
        if below is None:
            joined = joined.withColumns({"bna": F.lit(1 / ALPHABET), "bnr": F.lit(1 / ALPHABET)})
        else:
            joined = joined.withColumn("shorter", F.substring("run", 2, k)).join(below, "shorter")
        chance = {n: F.when(F.col(f"s{n}") > 0, (F.col(n) + F.col(f"t{n}") * F.col(f"b{n}")) / (F.col(f"s{n}") + F.col(f"t{n}"))).otherwise(F.col(f"b{n}")) for n in ("na", "nr")}
        level = joined.select("run", chance["na"].alias("bna"), chance["nr"].alias("bnr"))
        below = level.withColumnRenamed("run", "shorter")
    return level.select("run", (F.log("bnr") - F.log("bna")).alias("ratio"))


def scored(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...], order: int = ORDER, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """(page_id, url, score, threshold, kept) of every page."""
    rows = written(labelled(pages, labels, seeds), "urls")
    model = written(_model(_runs(rows, order), order), "model")
    kinds = rows.select("url").distinct()
    ratio = _runs(kinds, order).join(model, "run").groupBy("url").agg(F.round(F.sum("ratio") / F.count("*"), 6).alias("score"))
    found = written(rows.join(ratio, "url", "left"), "scores")
    counts = found.where("held").groupBy("score").agg(F.count("*").alias("n"))
    # one row for each rounded score, however many URLs there are
    steps = counts.select("score", F.sum("n").over(Window.orderBy("score")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("whole"))
    enough = F.when(F.col("upto") >= F.col("whole") * F.lit(1 - false_rejects), F.col("score"))
    threshold = steps.agg(F.coalesce(F.greatest(F.min(enough), F.lit(0.0)), F.lit(0.0)).alias("threshold"))
    return found.crossJoin(F.broadcast(threshold)).select("page_id", "url", "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))


def oracle(seeds: tuple[str, ...] = SEEDS, order: int = ORDER, false_rejects: float = FALSE_REJECTS) -> str:
    """The same in DuckDB's SQL."""
    levels = []
    for k in range(order + 1):
        c, p = f"c{k}", f"p{k}"
        lower = f"JOIN p{k - 1} b ON b.run = substr(x.run, 2)" if k else ""
        bna, bnr = ("b.pa", "b.pr") if k else (f"1 / {ALPHABET}", f"1 / {ALPHABET}")
        levels.append(f"""
        {c} AS (SELECT substr(run, {order - k + 1}) AS run, sum(na) AS na, sum(nr) AS nr FROM counts GROUP BY 1),
        t{k} AS (SELECT substr(run, 1, {k}) AS context, sum(na) AS sa, sum(nr) AS sr, sum((na > 0)::INT) AS ta, sum((nr > 0)::INT) AS tr FROM {c} GROUP BY 1),
        {p} AS (SELECT x.run, CASE WHEN sa > 0 THEN (x.na + ta * {bna}) / (sa + ta) ELSE {bna} END AS pa,
                CASE WHEN sr > 0 THEN (x.nr + tr * {bnr}) / (sr + tr) ELSE {bnr} END AS pr
            FROM {c} x JOIN t{k} ON context = substr(x.run, 1, {k}) {lower})""")
    return f"""
    WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
        marked AS (SELECT page_id, url, regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '{_pattern(seeds)}') AS rejected,
            TRY_CAST(nullif(regexp_extract(url, '/([0-9]{{1,18}})', 1), '') AS BIGINT) AS named FROM pages),
        known AS (SELECT page_id, url, coalesce(rejected, false) AS rejected, doc_id IS NOT NULL AND NOT coalesce(rejected, false) AS good, coalesce(substr(md5(url), 1, 1) <= '{HELD}', false) AS ours FROM marked LEFT JOIN good ON named = doc_id),
        pages_in AS (SELECT page_id, url, rejected, good AND NOT ours AS accepted, good AND ours AS held FROM known),
        shapes AS (SELECT *, repeat(chr(2), {order}) || regexp_replace(lower(url), '[0-9]', '0', 'g') || chr(3) AS shape FROM pages_in WHERE url IS NOT NULL),
        runs AS (SELECT url, accepted, rejected, substr(shape, i::INT, {order + 1}) AS run FROM (SELECT *, unnest(range(1, length(shape) - {order} + 1)) AS i FROM shapes)),
        counts AS (SELECT run, sum(accepted::INT) AS na, sum(rejected::INT) AS nr FROM runs GROUP BY 1),
        {",".join(levels)},
        ratios AS (SELECT url, round(sum(ln(pr) - ln(pa)) / count(*), 6) AS score FROM runs JOIN p{order} USING (run) GROUP BY 1),
        scores AS (SELECT page_id, url, held, score FROM pages_in LEFT JOIN ratios USING (url)),
        steps AS (SELECT score, sum(count(*)) OVER (ORDER BY score) AS upto, sum(count(*)) OVER () AS whole FROM scores WHERE held GROUP BY 1),
        limits AS (SELECT greatest(coalesce(min(score) FILTER (upto >= whole * (1 - {false_rejects})), 0.0), 0.0) AS threshold FROM steps)
    SELECT page_id, url, score + 0.0 AS score, threshold::DOUBLE AS threshold, coalesce(score <= threshold, true) AS kept FROM scores, limits"""
