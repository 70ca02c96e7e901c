"""URL filters: given block and allow rules, and rules that FP-growth mines from labels. DataFrame functions only.

A URL's items are its tokens. Frequent sets of tokens and label make association rules; those that lead to "block"
with enough confidence, lift and support are kept, of any number of tokens. An inverted index has each rule under
its rarest token, so a URL meets only rules that share a token with it; then all of the rule's tokens are asked for.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: (verdict, host, path): a rule fits its host and subdomains, where the path starts with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
CONFIDENCE, LIFT, SUPPORT, LEAST_COUNT = 0.6, 1.2, 0.005, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "=block"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Lower-cased (A-Z) from the first :// up to / ? # or the end; empty if there is none or url is null."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(h: Column, p: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does. For lists of up to some hundreds."""
    rule = verdict = None
    for what, rh, rp in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        rule, verdict = (F.when(fits, v) if c is None else c.when(fits, v) for c, v in ((rule, rh + rp), (verdict, what)))
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct runs of letters, digits, _ and - after the ://, lower-cased (A-Z); of digits alone: #. Sorted."""
    found = F.regexp_extract_all(F.translate(_rest(F.coalesce(url, F.lit(""))), _UPPER, _LOWER), F.lit("[a-z0-9_-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.when(t.rlike("^[0-9]+$"), "#").otherwise(t))))


def mined(labelled: DataFrame) -> DataFrame:
    """(tokens): what rules to block ask for, from rows (tokens: array<string>, block: boolean). No labels, no rules."""
    n, blocked = labelled.agg(F.count("*"), F.count_if("block")).first()
    none = labelled.select("tokens").where("false")
    if not blocked:
        return none
    least = max(LEAST_COUNT, -(-n * int(SUPPORT * 1000) // 1000))
    sets = labelled.select(F.when(F.col("block"), F.concat("tokens", F.array(F.lit(_BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (least - 0.5) / n)), minConfidence=CONFIDENCE).fit(sets)
    rules = model.associationRules.where((F.element_at("consequent", 1) == _BLOCK) & (F.col("confidence") >= CONFIDENCE) & (F.col("confidence") * n >= LIFT * blocked))
    return rules.select(F.array_sort("antecedent").alias("tokens"))


def matched(urls: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(url): distinct urls (url, tokens) that hold all tokens of a rule. counts: (token, n) sets a rule's index token."""
    numbered = rules.distinct().withColumn("rule", F.xxhash64("tokens"))
    rarest = numbered.select("rule", "tokens", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("asked"))
    each = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    return each.join(rarest, "token").where(F.size(F.array_except("asked", "tokens")) == 0).select("url").distinct()


def judge(scratch: Scratch, pages: DataFrame, labels: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict for every page.

    labels: (id, block) of pages; a label of no page is not used, one of null says nothing. Null urls have no tokens
    and no host: the verdict is allow. Rows are kept as often as they come.
    """
    pages = pages.select(id_col, F.col(url_col).alias("url"))
    known = pages.join(labels.where("block IS NOT NULL").select(F.col("id").alias(id_col), "block"), id_col).select(tokens(F.col("url")).alias("tokens"), "block")
    known = scratch.put(known, "labelled")
    found = scratch.put(mined(known), "rules")
    counts = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    h, p = host(F.col("url")), path(F.col("url"))
    judged = pages.withColumn("host", F.coalesce(h, F.lit(""))).withColumn("path", F.coalesce(p, F.lit("")))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("verdict", verdict)
    if found.isEmpty():
        return judged.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    hit = scratch.put(matched(pages.where("url IS NOT NULL").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens")), found, counts), "hit")
    out = judged.join(hit.withColumn("hit", F.lit(True)), "url", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict. A page is labelled by the row of `labels` with its id: block if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block"))
    return judge(Scratch(spark, "op9"), table(spark, sf_dir, "pages"), labels)


SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_distinct(list_transform(regexp_extract_all(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_-]+'),
          lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '#' ELSE t END)) AS tok FROM u),
lab AS (SELECT row_number() OVER () AS k, tok, (toxic = 1 OR quality = 0) AS block FROM p JOIN labels ON page_id = doc_id WHERE (toxic = 1 OR quality = 0) IS NOT NULL),
n AS (SELECT count(*) AS n, count(*) FILTER (block) AS b FROM lab),
t AS (SELECT k, block, unnest(tok) AS t FROM lab),
sets AS (SELECT k, block, [t] AS s, t AS top FROM t UNION ALL SELECT x.k, x.block, list_append(x.s, y.t), y.t FROM sets x JOIN t y ON x.k = y.k AND x.top < y.t),
rules AS (SELECT s FROM sets, n GROUP BY s, n.n, n.b
  HAVING count(*) FILTER (block) >= greatest(20, ceil(n.n * 0.005)) AND count(*) FILTER (block) / count(*) >= 0.6
     AND (count(*) FILTER (block) / count(*)) * n.n >= 1.2 * n.b),
hit AS (SELECT DISTINCT url FROM p JOIN rules ON list_has_all(tok, s)),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM p), r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule,
  coalesce(best.verdict, CASE WHEN hit.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best ON p.url = best.url LEFT JOIN hit ON p.url = hit.url
"""
