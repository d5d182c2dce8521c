"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Documents are leaves' rows in a tree of domain, language and source. A budget of tokens is split from the root down: children
share their parent's budget by their weights, no child gets more than its subtree holds in MAX_EPOCHS epochs, and what a child
can't take goes to its siblings by their weights before any of it would be missing at the parent (an exact water filling: children
sorted by capacity per weight). A leaf's stream is epoch after epoch, each in an order of its own by a seeded hash; the leaf
takes the prefix of the stream that holds its budget, the last document whole. Full epochs are counted, not enumerated by rank;
in the last one the prefix's end is found by sums over cells of the order, 16 ** DIGITS of them in a leaf, then over cells of the cell
that it ends in, until that holds about SLICE documents: only those are sorted, so that no leaf's rows meet in one task. Rows get their
leaf's plan by a broadcast as long as there are at most LEAVES leaves (counted first), else by a join on leaf and salt; texts are
never shuffled in the first case. Shares are rounded down, so that up to one token a sibling isn't given out.

All arithmetic is of integers; tokens are words divided by white space. Null text: 0 tokens; null language or source: a
node of its own ('' in the tree); null doc_id: ordered last, by text. Documents without tokens come with their
leaf's first epoch if its budget isn't 0. Repeated rows: each is taken or not (ties in the order go together by text). Empty
table: empty result. Extra columns are kept; a column named like one that is made here is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

MAX_EPOCHS, SEED, SLICE, DIGITS = 4, 17, 1024, 2
#: Leaves whose plan is broadcast, at about 100 bytes each; beyond, a leaf's rows are dealt to SALTS parts.
LEAVES, SALTS = 100_000, 64
LEVELS = ("domain", "tree_lang", "tree_source")
#: Weights of children by name, 1 for all others.
WEIGHTS = {"domain": {"web": 3, "reference": 2, "forum": 1}, "tree_lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "tree_source": {}}
_DOMAIN = "element_at(array('web', 'reference', 'forum'), cast(pmod(coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as int), 0), 3) + 1 as int))"


def tokens(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _filled(children: DataFrame, parent: list[str]) -> DataFrame:
    """budget of each child: parent_budget by weight w, never over capacity cap, what one can't take shared by the others."""
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")), *(F.col(c) for c in LEVELS if c in children.columns))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Sorted by capacity per weight, those that are full come first; the first that isn't and all after it share what is left.
    x = children.withColumn("w_rest", F.sum("w").over(rest)).withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("full", F.expr("cast(cap as decimal(38,0)) * w_rest <= cast(greatest(parent_budget - cap_before, 0) as decimal(38,0)) * w"))
    every = Window.partitionBy(*parent)
    x = x.withColumn("taken", F.coalesce(F.sum(F.expr("if(full, cap, 0)")).over(every), F.lit(0))).withColumn("w_open", F.coalesce(F.sum(F.expr("if(full, 0, w)")).over(every), F.lit(0)))
    share = F.expr("cast(cast(greatest(parent_budget - taken, 0) as decimal(38,0)) * w div greatest(w_open, 1) as long)")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("w_rest", "cap_before", "full", "taken", "w_open")


def budgets(leaves: DataFrame, total: int | None = None, epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS) -> DataFrame:
    """leaves (LEVELS, n_docs, leaf_tokens) with budget; total: tokens to give out, all that the leaves hold once if None."""
    own = leaves.withColumn("leaf_cap", F.col("leaf_tokens") * epochs)
    whole = own.agg(F.sum("leaf_tokens").alias("held")).select(F.lit(total).cast("long").alias("parent_budget") if total is not None else F.coalesce("held", F.lit(0)).alias("parent_budget"))
    up: DataFrame = own.select(*LEVELS, F.col("leaf_cap").alias("cap"))
    given, path = None, []
    for level in LEVELS:
        parent, path = list(path), [*path, level]
        children = up.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        # One row holds the root's budget.
        children = children.join(F.broadcast(whole)) if given is None else children.join(given, parent)
        given = _filled(children, parent).select(*path, F.col("budget").alias("parent_budget"))
    return own.drop("leaf_cap").join(given.withColumnRenamed("parent_budget", "budget"), list(LEVELS))


def _by_leaf(rows: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    """rows with the columns of their leaf, of which there are at most n; a hot leaf's rows stay where they are, or are dealt out by a salt."""
    if n <= LEAVES:
        return rows.join(F.broadcast(leaves), list(LEVELS))
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "_salt"]).drop("_salt")


def mix(docs: DataFrame, total: int | None = None, epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED, domain: str = _DOMAIN) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) once for each epoch in which a document is taken, with domain, epoch, n_tokens, leaf_budget."""
    made = ["domain", "tree_lang", "tree_source", "n_tokens", "epoch", "leaf_budget"]
    own = ("doc_id", "text", "lang", "source")
    others = [c for c in docs.columns if c.lower() not in (*own, *made)]  # kept apart: their names may be those of columns made on the way
    rows = docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in others) if others else [F.lit(0)]).alias("others"))
    rows = rows.withColumn("domain", F.expr(domain)).withColumn("tree_lang", F.coalesce("lang", F.lit(""))).withColumn("tree_source", F.coalesce("source", F.lit(""))).withColumn("n_tokens", tokens(F.col("text")))
    # What is ranked, written once: ids and tokens, without the texts.
    slim = cut(rows.select(*LEVELS, "doc_id", "n_tokens", F.expr("if(doc_id is null, md5(text), null)").alias("text_key")))
    leaves = slim.groupBy(*LEVELS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("leaf_tokens"))
    plan = cut(budgets(leaves, total, epochs, weights))
    n_leaves = plan.count()
    plan = plan.withColumn("full_epochs", F.expr("if(leaf_tokens > 0, budget div leaf_tokens, 0)")).withColumn("left", F.expr("if(leaf_tokens > 0, budget % leaf_tokens, 0)"))
    place = lambda key: F.md5(F.concat_ws(":", F.lit(seed), "full_epochs", F.coalesce(F.col("doc_id").cast("string"), key, F.lit(""))))
    edge = plan.where("left > 0").select(*LEVELS, "full_epochs", "left", F.lit("").alias("cell"), F.lit(0).cast("long").alias("before"), F.col("n_docs").alias("n"))
    digits, most = 0, edge.agg(F.max("n")).first()[0] or 0
    ends = lambda: _by_leaf(slim, edge, n_leaves).withColumn("place", place(F.col("text_key"))).where(F.substr("place", F.lit(1), F.lit(digits)) == F.col("cell"))
    while most > SLICE and digits < 30:
        found = ends()
        digits += DIGITS
        found = found.groupBy(*LEVELS, "full_epochs", "left", "before", F.substr("place", F.lit(1), F.lit(digits)).alias("cell")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("held"))
        earlier = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(earlier), F.lit(0))).where("before < left")
        # Only the cell in which a leaf's prefix ends is looked into; those before it are taken whole.
        edge = cut(found.groupBy(*LEVELS, "full_epochs", "left").agg(F.max(F.struct("cell", "before", "n")).alias("e")).select(*LEVELS, "full_epochs", "left", "e.*"))
        most = edge.agg(F.max("n")).first()[0] or 0
    run = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of one place, which are one document's copies, count as one.
    last = ends().groupBy(*LEVELS, "before", "left", "place").agg(F.sum("n_tokens").alias("n_tokens"))
    last = last.withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).where("before < left")
    last = last.groupBy(*LEVELS).agg(F.max("place").alias("last_place"))
    plan = cut(plan.join(last, list(LEVELS), "left").select(*LEVELS, "full_epochs", "last_place", F.col("budget").alias("leaf_budget")))
    out = _by_leaf(rows, plan, n_leaves).withColumn("_place", place(F.md5("text")))
    out = out.withColumn("_times", F.col("full_epochs") + F.expr("if(last_place is not null and _place <= last_place, 1, 0)")).where("_times > 0")
    out = out.withColumn("epoch", F.explode(F.expr("sequence(0l, _times - 1)")))
    return out.select(*(F.col(c) if c.lower() in own else F.col(f"others.`{c}`") for c in docs.columns if c.lower() not in made), "domain", "epoch", "n_tokens", "leaf_budget")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "leaf_budget")


def _sql_level(level: str, parent: list[str], up: str) -> str:
    """One level of the tree in SQL: up names the query that has the parents' budgets, '' at the root."""
    path = [*parent, level]
    cases = " ".join(f"when {level} = '{n}' then {w}" for n, w in WEIGHTS[level].items())
    weight = f"case {cases} else 1 end" if cases else "1"
    part, order = f"partition by {', '.join(parent)} " if parent else "", ", ".join(path)
    source = f"c join {up} using ({', '.join(parent)})" if up else "c, (select coalesce(sum(leaf_tokens), 0) parent_budget from leaves)"
    return f"""{level}_b as (with c as (select {order}, sum(leaf_tokens * {MAX_EPOCHS})::hugeint cap, ({weight})::hugeint w from leaves group by {order}),
 x as (select *, sum(w) over ({part}order by cap / w, {order} rows between current row and unbounded following) w_rest, coalesce(sum(cap) over ({part}order by cap / w, {order} rows between unbounded preceding and 1 preceding), 0) cap_before from {source}),
 y as (select *, cap * w_rest <= greatest(parent_budget - cap_before, 0) * w is_full from x),
 z as (select *, sum(case when is_full then cap else 0 end) over ({part}) taken, sum(case when is_full then 0 else w end) over ({part}) w_open from y)
 select {order}, (case when is_full then cap else greatest(parent_budget - taken, 0)::hugeint * w::hugeint // greatest(w_open, 1)::hugeint end)::hugeint parent_budget from z)"""


SQL = f"""with d as (select doc_id, text, lang, source, ['web', 'reference', 'forum'][(coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as int), 0) % 3) + 1] as domain, coalesce(lang, '') tree_lang, coalesce(source, '') tree_source,
 len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))::bigint n_tokens from documents),
leaves as (select domain, tree_lang, tree_source, sum(n_tokens)::bigint leaf_tokens from d group by all),
{_sql_level("domain", [], "")},
{_sql_level("tree_lang", ["domain"], "domain_b")},
{_sql_level("tree_source", ["domain", "tree_lang"], "tree_lang_b")},
p as (select l.*, b.parent_budget::bigint leaf_budget, case when leaf_tokens > 0 then (b.parent_budget // leaf_tokens)::bigint else 0 end full_epochs, case when leaf_tokens > 0 then (b.parent_budget % leaf_tokens)::bigint else 0 end rest from leaves l join tree_source_b b using (domain, tree_lang, tree_source)),
r as (select d.*, leaf_budget, full_epochs, rest, md5('{SEED}:' || full_epochs || ':' || coalesce(doc_id::varchar, md5(text), '')) place from d join p using (domain, tree_lang, tree_source)),
s as (select *, coalesce(sum(n_tokens) over (partition by domain, tree_lang, tree_source order by place, doc_id rows between unbounded preceding and 1 preceding), 0) before from r),
t as (select *, full_epochs + case when before < rest then 1 else 0 end times from s)
select doc_id, domain, lang, source, unnest(range(times))::bigint as epoch, n_tokens, leaf_budget from t where times > 0"""
