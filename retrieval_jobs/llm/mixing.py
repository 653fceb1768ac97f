"""Mixing sources to target weights, with DataFrame functions only.

A tree root -> domain -> language -> source carries a weight at every node. The token budget flows
down: each node's children share its budget in proportion to their weights, a child never gets more
than its subtree can supply (tokens x ``max_epochs``), and what a short child leaves is shared
again among its siblings. Because every node's supply is the supply of its whole subtree, a shortage
reaches an ancestor's siblings only when the whole subtree is exhausted. The shares have a closed
form: with children ordered by supply / weight, the fill level after saturating the first ones is
(budget - their supply) / (weight of the rest), and the first child whose supply exceeds its share at
that level fixes the level for all later ones.

A leaf with budget b and t tokens is read floor(b / t) whole times; the rest is the longest prefix,
in the seeded order of the next epoch, whose running token count stays within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Documents of one leaf are ordered in pieces of about so many, so that no task sorts a whole leaf.
PIECE = 256


def domain_of(source: Column) -> Column:
    """Domain of a source by the number its name ends with; other sources form domain ``other``."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("dom"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("other"))


def target_weights(leaves: DataFrame) -> DataFrame:
    """Production weights: domains 4:3:2:1 (other 1), English 6, every other language 2, sources alike."""
    digit = F.regexp_extract("domain", r"^dom([0-9]+)$", 1)
    return leaves.select(
        *LEVELS,
        F.when(digit != "", F.lit(4.0) - digit.cast("double")).otherwise(1.0).alias("w_domain"),
        F.when(F.col("lang") == "en", 6.0).otherwise(2.0).alias("w_lang"),
        F.lit(1.0).alias("w_source"),
    )


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` of each parent among its children (columns ``weight``, ``supply``); adds ``share``."""
    live = children.where("weight > 0 and supply > 0")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = by.orderBy(F.col("supply") / F.col("weight"), name)
    before = F.coalesce(F.sum("supply").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    live = live.withColumn("rn", F.row_number().over(ordered)).withColumn("level", (F.col("budget") - before) / rest)
    short = F.col("supply") <= F.col("level") * F.col("weight")
    live = live.withColumn("open", F.min(F.when(~short, F.col("rn"))).over(by))
    live = live.withColumn("top", F.max(F.when(F.col("rn") == F.col("open"), F.col("level"))).over(by))
    share = F.when(F.col("open").isNull() | (F.col("rn") < F.col("open")), F.col("supply")).otherwise(
        F.greatest(F.lit(0.0), F.least("supply", F.col("top") * F.col("weight")))
    )
    return live.withColumn("share", share).drop("rn", "level", "open", "top")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, leaf_docs, leaf_tokens, budget) of leaves (domain, lang, source, leaf_docs, leaf_tokens)."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"w.{c}")) for c in LEVELS]
    tree = leaves.alias("l").join(weights.alias("w"), on).select("l.*", "w.w_domain", "w.w_lang", "w.w_source")
    tree = tree.withColumn("supply0", F.col("leaf_tokens").cast("double") * max_epochs)
    domains = tree.groupBy("domain").agg(F.max("w_domain").alias("weight"), F.sum("supply0").alias("supply"), F.sum("leaf_tokens").alias("t"))
    total = F.sum("t").over(Window.partitionBy(F.lit(0)))
    domains = fill(domains.withColumn("budget", F.floor(total * budget_share).cast("double")), [], "domain").select("domain", F.col("share").alias("budget"))
    langs = tree.groupBy("domain", "lang").agg(F.max("w_lang").alias("weight"), F.sum("supply0").alias("supply"))
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    sources = tree.select("domain", "lang", "source", "leaf_docs", "leaf_tokens", F.col("w_source").alias("weight"), F.col("supply0").alias("supply"))
    sources = fill(sources.join(langs, ["domain", "lang"]), ["domain", "lang"], "source")
    return sources.select(*LEVELS, "leaf_docs", "leaf_tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, budget_share: float = 0.5, max_epochs: int = 3, seed: int = 7, weights=target_weights, keep: tuple[str, ...] = ()) -> DataFrame:
    """Choose documents so that leaf token totals follow the target weights.

    Input: ``doc_id, text, lang, source`` (more columns are ignored, those named in ``keep`` are carried along). Returns one row per chosen
    document: doc_id, domain, lang, source, n_tokens long, copies long (how often it is read, the
    last partial epoch included), partial boolean (it belongs to the partial epoch's prefix).
    Null text or text without words: no tokens, never chosen. Null or blank lang and source form leaves of their own
    (``und`` and ``none``). Repeated rows are rows: each counts. Ties in the seeded order go to the smaller doc_id. An empty
    table, or no tokens at all, gives no rows. ``weights`` maps leaves to w_domain, w_lang, w_source; leaves without a
    positive weight get nothing."""
    # texts are read once; what follows works on the counted rows, a few words each
    rows = docs.select(
        "doc_id", *keep,
        domain_of(F.col("source")).alias("domain"),
        F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang"),
        F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("none")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")
    rows = settled(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.count("*").alias("leaf_docs"), F.sum("n_tokens").alias("leaf_tokens"))
    plan = leaf_budgets(leaves, weights(leaves), budget_share, max_epochs).where("budget > 0")
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("leaf_tokens")).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens"))
    plan = settled(plan.withColumn("pieces", F.ceil(F.col("leaf_docs") / F.lit(PIECE)).cast("long")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(*[F.col(c).cast("string") for c in ("doc_id", *keep)])).cast("binary"))
    # a plan row per leaf: the number of leaves is the number of distinct (domain, lang, source)
    drawn = rows.join(plan.drop("leaf_docs", "leaf_tokens", "budget"), list(LEVELS)).withColumn("key", key)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumn("piece", F.floor(place * F.col("pieces") / F.lit(1 << 32)).cast("long"))
    pieces = drawn.groupBy(*LEVELS, "piece").agg(F.sum("n_tokens").alias("t"))
    ahead = F.coalesce(F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*LEVELS, "piece", ahead.alias("ahead"))
    inner = Window.partitionBy(*LEVELS, "piece").orderBy("key", "doc_id", *keep).rowsBetween(Window.unboundedPreceding, 0)
    run = drawn.join(pieces, [*LEVELS, "piece"]).withColumn("running", F.col("ahead") + F.sum("n_tokens").over(inner))
    partial = F.col("running") <= F.col("rest")
    out = run.select("doc_id", *keep, *LEVELS, "n_tokens", (F.col("whole") + partial.cast("long")).alias("copies"), partial.alias("partial"))
    return out.where("copies > 0")


#: DuckDB text of ``mix_sources`` with its default parameters over a relation {docs}.
SQL = """
WITH r0 AS (
  SELECT doc_id, regexp_extract(source, '([0-9]{{1,9}})$', 1) AS num,
         coalesce(nullif(trim(lang), ''), 'und') AS lang, coalesce(nullif(trim(source), ''), 'none') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {docs}),
r AS (SELECT doc_id, CASE WHEN coalesce(num, '') <> '' THEN 'dom' || (num::BIGINT % 4)::VARCHAR ELSE 'other' END AS domain, lang, source, n_tokens
  FROM r0 WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS t, sum(n_tokens)::DOUBLE * 3 AS supply,
  CASE WHEN domain LIKE 'dom%' THEN 4.0::DOUBLE - substr(domain, 4)::DOUBLE ELSE 1.0::DOUBLE END AS wd,
  CASE WHEN lang = 'en' THEN 6.0::DOUBLE ELSE 2.0::DOUBLE END AS wl FROM r GROUP BY ALL),
d0 AS (SELECT domain, max(wd) AS weight, sum(supply) AS supply, (SELECT floor(sum(t) * 0.5::DOUBLE) FROM leaf)::DOUBLE AS budget FROM leaf GROUP BY domain),
d1 AS (SELECT *, row_number() OVER w AS rn, (budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM d0 WHERE weight > 0 WINDOW w AS (ORDER BY supply / weight, domain)),
d2 AS (SELECT *, min(CASE WHEN supply > level * weight THEN rn END) OVER () AS op FROM d1),
d3 AS (SELECT *, max(CASE WHEN rn = op THEN level END) OVER () AS top FROM d2),
d AS (SELECT domain, CASE WHEN op IS NULL OR rn < op THEN supply ELSE greatest(0.0, least(supply, top * weight)) END AS budget FROM d3),
l0 AS (SELECT x.domain, lang, max(wl) AS weight, sum(supply) AS supply, max(d.budget) AS budget FROM leaf x JOIN d USING (domain) GROUP BY x.domain, lang),
l1 AS (SELECT *, row_number() OVER w AS rn, (budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l0 WINDOW w AS (PARTITION BY domain ORDER BY supply / weight, lang)),
l2 AS (SELECT *, min(CASE WHEN supply > level * weight THEN rn END) OVER (PARTITION BY domain) AS op FROM l1),
l3 AS (SELECT *, max(CASE WHEN rn = op THEN level END) OVER (PARTITION BY domain) AS top FROM l2),
l AS (SELECT domain, lang, CASE WHEN op IS NULL OR rn < op THEN supply ELSE greatest(0.0, least(supply, top * weight)) END AS budget FROM l3),
s0 AS (SELECT x.domain, x.lang, source, t, supply, 1.0::DOUBLE AS weight, l.budget FROM leaf x JOIN l ON x.domain = l.domain AND x.lang = l.lang),
s1 AS (SELECT *, row_number() OVER w AS rn, (budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s0 WINDOW w AS (PARTITION BY domain, lang ORDER BY supply / weight, source)),
s2 AS (SELECT *, min(CASE WHEN supply > level * weight THEN rn END) OVER (PARTITION BY domain, lang) AS op FROM s1),
s3 AS (SELECT *, max(CASE WHEN rn = op THEN level END) OVER (PARTITION BY domain, lang) AS top FROM s2),
s AS (SELECT domain, lang, source, t, floor(CASE WHEN op IS NULL OR rn < op THEN supply ELSE greatest(0.0, least(supply, top * weight)) END + 1e-6)::BIGINT AS budget FROM s3),
p AS (SELECT *, budget // t AS whole, budget - (budget // t) * t AS rest FROM s WHERE budget > 0),
q AS (SELECT r.*, whole, rest, sum(r.n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY md5('7:' || whole::VARCHAR || ':' || doc_id::VARCHAR), doc_id
  ROWS UNBOUNDED PRECEDING) AS running FROM r JOIN p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source)
SELECT doc_id, domain, lang, source, n_tokens, whole + (running <= rest)::BIGINT AS copies, running <= rest AS partial FROM q WHERE whole > 0 OR running <= rest
"""
