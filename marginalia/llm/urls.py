"""URL filter by a ratio of character language models, in DataFrame operations only.

URLs that a rule accepts or rejects are the examples of two variable-order Markov models over the characters of host and
path (digits count as one character). The probability of a character after a context of k is interpolated with that
after a context one shorter, down to a uniform one, so a context that was never seen hands its weight to the shorter one.
A URL's score is the difference of its log-likelihoods per character. The threshold is calibrated on examples that the
models haven't seen, a quarter of them chosen by a hash: the score that makes the fewest errors, both kinds weighed by
their share.

All texts are first counted, so that neither a frequent URL nor a frequent character run makes a hot key. Log ratios are
kept as integers (millionths), so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise

#: Rule: host with its subdomains, beginning of the path, verdict. The longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters of context.
ORDER = 4
#: Weight of the shorter context against the counts of the longer one, and the number of characters of the uniform one.
SHORTER, ALPHABET = 2.0, 96.0
#: Scores are calibrated in steps of a hundredth, between these steps.
STEPS = 1000
#: Rows of a table, and bytes of its texts, up to which it is sent to all executors; above, it is joined by shuffle.
SMALL, SMALL_BYTES = 200_000, 32 << 20


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path): the host is what stands between the first :// and the next / ? # or the end, A-Z lower-cased; the path goes on to ? # or the end. Both are empty without ://, and for null."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr("_url", "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("_url")).withColumn("_rest", rest)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return out.select("page_id", lower.alias("host"), path.alias("path"))


def rule_of(rules: tuple = RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _padded(text: str) -> F.Column:
    return F.concat(F.lit("~" * ORDER), F.col(text))


def _runs(texts: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of `shape`: the run of ORDER characters before it and itself."""
    places = F.explode(F.expr("sequence(1, length(shape))")).alias("_at")
    return texts.where("shape <> ''").select(*keep, _padded("shape").alias("_text"), places).select(*keep, F.expr(f"substr(_text, _at, {ORDER + 1})").alias("run"))


def _keys() -> F.Column:
    """For each order the run's end and its context, named by the order; the context of order 0 is empty."""
    return F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"concat('{k}:', right(run, {k + 1}))").alias("gram"), F.expr(f"concat('{k}<', substr(run, {ORDER + 1 - k}, {k}))").alias("context")) for k in range(ORDER + 1)))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A stored table whose first column is a text, marked for broadcast if its rows are few and short enough."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col(df.columns[0]).cast("binary"))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size.n <= SMALL and size.bytes <= SMALL_BYTES else df


def held_out(shape: str = "shape") -> F.Column:
    """Whether an example is kept for the threshold: a quarter of the different texts."""
    return F.substring(F.md5(F.col(shape).cast("binary")), 1, 1).isin("0", "1", "2", "3")


def ratios(shapes: DataFrame) -> DataFrame:
    """(run, ratio) for every run of characters in shapes(shape, n, verdict): millionths of the log of the accepted model's probability over the rejected one's. Rows with a null verdict are no examples."""
    weight = lambda says: F.sum(F.when(F.col("verdict") == says, F.col("n")).otherwise(0))
    runs = materialise(_runs(shapes, "n", "verdict").groupBy("run").agg(weight("allow").alias("allow"), weight("block").alias("block")), "runs")
    exploded = runs.select("allow", "block", F.explode(_keys()).alias("key"))
    sums = [F.sum("allow").alias("allow"), F.sum("block").alias("block")]
    counts = exploded.where("allow + block > 0").select(F.explode(F.array("key.gram", "key.context")).alias("key"), "allow", "block").groupBy("key").agg(*sums)
    counts = _maybe_broadcast(materialise(counts, "counts"))
    asked = runs.select("run", F.explode(_keys()).alias("key")).select("run", "key.k", "key.gram", "key.context")
    gram = counts.select(F.col("key").alias("gram"), F.col("allow").alias("ga"), F.col("block").alias("gb"))
    context = counts.select(F.col("key").alias("context"), F.col("allow").alias("ca"), F.col("block").alias("cb"))
    found = asked.join(gram, "gram", "left").join(context, "context", "left")
    found = found.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("k", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("ga", "ca", "gb", "cb"))))).alias("orders"))

    def log(g: str, c: str) -> F.Column:
        p = F.aggregate("orders", F.lit(1.0) / F.lit(ALPHABET), lambda p, o: (o[g] + F.lit(SHORTER) * p) / (o[c] + F.lit(SHORTER)))
        return F.log(p)

    return found.select("run", F.round((log("ga", "ca") - log("gb", "cb")) * 1000000).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (step): the score, in hundredths, below which URLs are rejected. scored(n, verdict, score), verdict null where no example."""
    step = F.least(F.greatest(F.floor(F.col("score") / 10000), F.lit(-STEPS)), F.lit(STEPS)).alias("step")
    weight = lambda says: F.sum(F.when(F.col("verdict") == says, F.col("n")).otherwise(0)).alias(says)
    table = scored.where("verdict is not null").groupBy(step).agg(weight("allow"), weight("block"))
    every = scored.sparkSession.range(-STEPS, STEPS + 1).select(F.col("id").alias("step"))
    table = every.join(table, "step", "left").select("step", F.coalesce("allow", F.lit(0)).alias("allow"), F.coalesce("block", F.lit(0)).alias("block"))
    all_rows, before = Window.partitionBy(), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    wrong = lambda part, of: F.coalesce(part, F.lit(0)) / F.greatest(F.sum(of).over(all_rows), F.lit(1))
    errors = wrong(F.sum("allow").over(before), "allow") + wrong(F.sum("block").over(all_rows) - F.coalesce(F.sum("block").over(before), F.lit(0)), "block")
    return table.select("step", F.round(errors, 9).alias("errors")).orderBy("errors", F.abs("step"), "step").limit(1).select("step")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of pages.

    The verdict is the longest fitting rule's, else the models': block if the score is under the threshold. A URL without
    host and path has score 0. URLs may have any length. Null ids and repeated rows are rows like others; other columns are
    ignored; an empty table gives none.
    """
    name, says = rule_of(rules)
    known = parsed(pages, id_col, url_col).withColumns({"rule": name, "said": says})
    shape = F.regexp_replace(F.concat("host", "path"), "[0-9]", "0")
    known = known.withColumn("shape", shape)
    shapes = materialise(known.groupBy("shape", F.col("said").alias("verdict")).agg(F.count("*").alias("n")), "shapes")
    ratio = _maybe_broadcast(materialise(ratios(shapes.withColumn("verdict", F.when(~held_out(), F.col("verdict")))), "ratios"))
    texts = shapes.select("shape").distinct()
    sums = _runs(texts, "shape").join(ratio, "run").groupBy("shape").agg((F.sum("ratio") / F.count("*")).alias("score"))
    sums = _maybe_broadcast(materialise(sums, "scores"))
    scored = shapes.join(sums, "shape").select("n", F.when(held_out(), F.col("verdict")).alias("verdict"), "score")
    # at most one row, and one number: as a literal it reaches every task
    step = threshold(scored).first()["step"]
    score = F.coalesce(F.col("score"), F.lit(0.0))
    verdict = F.coalesce("said", F.when(score < F.lit(step * 10000), "block").otherwise("allow"))
    return known.join(sums, "shape", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


#: The same query for DuckDB.
SQL = """
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))
), known AS (
  SELECT *, split_part(fit, ' ', 1) AS rule, split_part(fit, ' ', 2) AS said, regexp_replace(host || path, '[0-9]', '0', 'g') AS shape
  FROM (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/ allow'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/ block'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/ allow'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/ block' END AS fit FROM parsed)
), shapes AS (
  SELECT shape, said, substr(md5(shape), 1, 1) IN ('0', '1', '2', '3') AS held, count(*) AS n FROM known GROUP BY shape, said
), runs AS (
  SELECT run, sum(CASE WHEN said = 'allow' AND NOT held THEN n ELSE 0 END) AS allow, sum(CASE WHEN said = 'block' AND NOT held THEN n ELSE 0 END) AS block
  FROM (SELECT said, n, held, substr('~~~~' || shape, i, 5) AS run FROM (SELECT *, unnest(range(1, length(shape) + 1)) AS i FROM shapes)) GROUP BY run
), keyed AS (
  SELECT run, allow, block, k, k || ':' || right(run, k + 1) AS gram, k || '<' || substr(run, 5 - k, k) AS context
  FROM (SELECT *, unnest(range(0, 5)) AS k FROM runs)
), counts AS (
  SELECT key, sum(allow) AS allow, sum(block) AS block
  FROM (SELECT gram AS key, allow, block FROM keyed UNION ALL SELECT context, allow, block FROM keyed) GROUP BY key
), found AS (
  SELECT run, max(CASE WHEN k = 0 THEN o END) AS o0, max(CASE WHEN k = 1 THEN o END) AS o1, max(CASE WHEN k = 2 THEN o END) AS o2, max(CASE WHEN k = 3 THEN o END) AS o3, max(CASE WHEN k = 4 THEN o END) AS o4
  FROM (SELECT run, k, [g.allow::DOUBLE, c.allow::DOUBLE, g.block::DOUBLE, c.block::DOUBLE] AS o
    FROM keyed JOIN counts g ON g.key = gram JOIN counts c ON c.key = context) GROUP BY run
), ratios AS (
  SELECT run, round((ln(a4) - ln(b4)) * 1000000)::BIGINT AS ratio FROM (
    SELECT run, (o4[1] + 2.0::DOUBLE * a3) / (o4[2] + 2.0::DOUBLE) AS a4, (o4[3] + 2.0::DOUBLE * b3) / (o4[4] + 2.0::DOUBLE) AS b4 FROM (
    SELECT *, (o3[1] + 2.0::DOUBLE * a2) / (o3[2] + 2.0::DOUBLE) AS a3, (o3[3] + 2.0::DOUBLE * b2) / (o3[4] + 2.0::DOUBLE) AS b3 FROM (
    SELECT *, (o2[1] + 2.0::DOUBLE * a1) / (o2[2] + 2.0::DOUBLE) AS a2, (o2[3] + 2.0::DOUBLE * b1) / (o2[4] + 2.0::DOUBLE) AS b2 FROM (
    SELECT *, (o1[1] + 2.0::DOUBLE * a0) / (o1[2] + 2.0::DOUBLE) AS a1, (o1[3] + 2.0::DOUBLE * b0) / (o1[4] + 2.0::DOUBLE) AS b1 FROM (
    SELECT *, (o0[1] + 2.0::DOUBLE * (1.0::DOUBLE / 96.0::DOUBLE)) / (o0[2] + 2.0::DOUBLE) AS a0, (o0[3] + 2.0::DOUBLE * (1.0::DOUBLE / 96.0::DOUBLE)) / (o0[4] + 2.0::DOUBLE) AS b0 FROM found)))))
), scores AS (
  SELECT shape, sum(ratio)::DOUBLE / count(*) AS score
  FROM (SELECT shape, substr('~~~~' || shape, i, 5) AS run FROM (SELECT shape, unnest(range(1, length(shape) + 1)) AS i FROM (SELECT DISTINCT shape FROM shapes))) JOIN ratios USING (run) GROUP BY shape
), steps AS (
  SELECT i AS step, coalesce(allow, 0) AS allow, coalesce(block, 0) AS block FROM range(-1000, 1001) t(i) LEFT JOIN (
    SELECT least(greatest(floor(score / 10000), -1000), 1000)::BIGINT AS step, sum(CASE WHEN said = 'allow' THEN n ELSE 0 END) AS allow, sum(CASE WHEN said = 'block' THEN n ELSE 0 END) AS block
    FROM shapes JOIN scores USING (shape) WHERE said IS NOT NULL AND held GROUP BY 1) s ON s.step = i
), errors AS (
  SELECT step, round(coalesce(sum(allow) OVER below, 0)::DOUBLE / greatest(sum(allow) OVER (), 1)::DOUBLE + (sum(block) OVER () - coalesce(sum(block) OVER below, 0))::DOUBLE / greatest(sum(block) OVER (), 1)::DOUBLE, 9) AS errors
  FROM steps WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (SELECT step FROM errors ORDER BY errors, abs(step), step LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(score, 0) < (SELECT step FROM chosen) * 10000 THEN 'block' ELSE 'allow' END) AS verdict
FROM known LEFT JOIN scores USING (shape)
"""
