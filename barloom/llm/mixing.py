"""Mixing sources to target weights: a Pfair schedule of source blocks, in DataFrame operations only.

Block i (from 1) of a source with the share w of the weights is released at floor((i-1)/w) and due at ceil(i/w);
earliest deadline first over the released blocks gives each slot its source. The shares add up to one, so every block
meets its deadline, and after any number of slots a source is less than one block away from its share, as long as no
source has run out. The slots are scheduled one after the other, in periods that only bound what is in hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import table

#: Slots that are scheduled in one go: a unit of work, it changes no result.
PERIOD = 1000
#: Slots by which a release or deadline may be off through the arithmetic of doubles.
SLACK = 1e-6
#: Documents of a block.
BLOCK_DOCS = 8
#: Documents of a source that one window group orders, about.
GROUP_DOCS = 2000


def target_weights(docs: DataFrame, temperature: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, weight): the share of documents to the power of temperature, so that small sources gain."""
    return docs.groupBy(F.coalesce(source_col, F.lit("")).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(temperature)).alias("weight"))


def schedule(weights: DataFrame, blocks: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, block, slot, release, deadline), a row for each slot until all blocks have one; block is from 0, and
    sources that have run out go on with blocks that there are not.

    weights: (source, weight), a row for each source; blocks: (source, blocks). A source with no positive weight has
    no share: its blocks come after all others, by name. If no weight is positive, all are equal. Ties between
    deadlines go to the first name. One task makes as many steps as there are slots, each over all sources."""
    clean = weights.select("source", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).cast("double").alias("weight"))
    clean = clean.withColumn("weight", F.when(F.sum("weight").over(Window.partitionBy()) > 0, F.col("weight")).otherwise(1.0))
    every = F.sum("weight").over(Window.partitionBy()) / F.col("weight")  # slots for each block
    given = clean.withColumn("every", F.when(F.col("weight") > 0, every)).join(blocks, "source", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))

    one = given.filter("every is not null").agg(F.array_sort(F.collect_list(F.struct("source", "every", "blocks"))).alias("s"))
    one = one.withColumn("slots", F.expr(f"coalesce(array_max(transform(s, x -> ceil(x.blocks * x.every - {SLACK}))), 0L)"))
    # the state of the fold: the next block of each source, and which source had each slot
    block = f"named_struct('late', ceil(({{i}} + 1) * {{every}} - {SLACK}), 'ready', floor({{i}} * {{every}} + {SLACK}), 'k', {{k}}, 'block', {{i}}, 'every', {{every}})"
    ran = "array<int>"
    step = f"""(st, t) -> transform(array(array_min(filter(st.next, e -> e.ready <= t))),
                 p -> named_struct('next', transform(st.next, e -> if(e.k = p.k, {block.format(i="(e.block + 1L)", every="e.every", k="e.k")}, e)),
                   'ran', concat(st.ran, array(p.k))))[0]"""
    inner = f"aggregate(sequence(c * {period}L, c * {period}L + {period - 1}L), named_struct('next', o.next, 'ran', cast(array() as {ran})), {step})"
    fold = one.filter("slots > 0").select("s", "slots", F.expr(f"""
        aggregate(sequence(0L, (slots - 1) div {period}L),
          named_struct('next', transform(s, (x, k) -> {block.format(i="0L", every="x.every", k="k")}), 'ran', cast(array() as array<{ran}>)),
          (o, c) -> transform(array({inner}), r -> named_struct('next', r.next, 'ran', concat(o.ran, array(r.ran))))[0],
          o -> o.ran) as periods"""))
    turns = fold.select("s", "slots", F.posexplode("periods").alias("c", "ran")).select("s", "slots", "c", F.posexplode("ran").alias("i", "k"))
    timed = turns.select(F.element_at("s", F.col("k") + 1).alias("x"), (F.col("c").cast("long") * period + F.col("i")).alias("slot"), "slots").filter("slot < slots")
    timed = timed.select("x.source", "x.every", "slot").withColumn("block", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1)
    timed = timed.select("source", "block", "slot", F.floor(F.col("block") * F.col("every") + SLACK).alias("release"), F.ceil((F.col("block") + 1) * F.col("every") - SLACK).alias("deadline"))

    before = F.sum("blocks").over(Window.orderBy("source")) - F.col("blocks")  # a row for each source without a share
    rest = given.filter("every is null and blocks > 0").withColumn("before", before).crossJoin(one.select("slots"))
    rest = rest.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("slots") + F.col("before"))
    rest = rest.toDF("source", "block", "begin").select("source", "block", (F.col("begin") + F.col("block")).alias("slot"))
    return timed.unionAll(rest.select("source", "block", "slot", F.col("slot").alias("release"), (F.col("slot") + 1).alias("deadline")))


def mix(docs: DataFrame, weights: DataFrame, period: int = PERIOD, block_docs: int = BLOCK_DOCS, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", group_docs: int = GROUP_DOCS) -> DataFrame:
    """docs with the columns mix_block (from 0 within the source), mix_slot (global, from 0), mix_release and
    mix_deadline (slots) and mix_offset (place within its block); reading by (mix_slot, mix_offset) gives the mix.

    Documents of a source come in the order of md5(seed:id), then id; block_docs of them make a block. No document is
    left out or repeated: when a source has run out, its slots stay empty and the others go on. A null source counts
    as "", a null id as "null"; equal rows are in any order among themselves; columns named like the new ones are
    replaced; no rows give no rows. A source that weights does not name raises.

    A large source is ordered in groups of about group_docs documents by the leading hex digits of the hash; the
    groups' sizes, a few numbers a source, add up to where each group begins. Slots are found by a join of blocks with
    the schedule; period is the number of slots scheduled in one go.
    """
    base = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset")]
    keyed = docs.select(*base, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("__key"))
    digits = 1
    total = docs.count()
    while total > group_docs * 16**digits and digits < 8:
        digits += 1
    keyed = keyed.withColumn("__group", F.substring("__key", 1, digits))
    sizes = keyed.groupBy("__source", "__group").agg(F.count("*").alias("__n"))
    begins = sizes.select("__source", "__group", (F.sum("__n").over(Window.partitionBy("__source").orderBy("__group")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__source", "__group").orderBy("__key", id_col)) - 1
    ranked = keyed.withColumn("__rank", within).join(begins, ["__source", "__group"])
    number = F.col("__before") + F.col("__rank")
    blocked = ranked.withColumn("mix_block", F.floor(number / block_docs)).withColumn("mix_offset", (number % block_docs).cast("int"))

    blocks = sizes.groupBy(F.col("__source").alias("source")).agg(F.ceil(F.sum("__n") / block_docs).alias("blocks"))
    plan = schedule(weights, blocks, period).toDF("__source", "mix_block", "__slot", "__release", "__deadline")
    timed = blocked.join(plan, ["__source", "mix_block"], "left")
    slot = F.when(F.col("__slot").isNull(), F.raise_error(F.lit("a source without a weight"))).otherwise(F.col("__slot"))
    return timed.select(*base, "mix_block", slot.alias("mix_slot"), F.col("__release").alias("mix_release"), F.col("__deadline").alias("mix_deadline"), "mix_offset")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix with square-root weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, target_weights(docs))


OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
w AS (SELECT s, sqrt(count(*)) AS weight FROM d GROUP BY s),
i AS (SELECT s, weight / sum(weight) OVER () * ({PERIOD} - count(*) OVER ()) AS ideal, {PERIOD} - count(*) OVER () AS spare FROM w),
b AS (SELECT s, ideal, spare, floor(round(ideal, 9))::INT AS base FROM i),
o AS (SELECT s, 1 + base + CASE WHEN row_number() OVER (ORDER BY round(base - ideal, 9), s) <= spare - sum(base) OVER () THEN 1 ELSE 0 END AS slots FROM b),
job AS (SELECT s, slots, j.i AS idx, floor((j.i - 1) * {PERIOD} / slots)::BIGINT AS rel, ceil(j.i * {PERIOD} / slots)::BIGINT AS due FROM o, LATERAL (SELECT unnest(range(1, slots + 1)) AS i) j),
listed AS (SELECT list({{'due': due, 's': s, 'rel': rel, 'idx': idx}} ORDER BY due, s) AS jobs FROM job),
run AS (
  SELECT -1::BIGINT AS t, jobs, {{'due': 0::BIGINT, 's': '', 'rel': 0::BIGINT, 'idx': 0::BIGINT}} AS pick FROM listed
  UNION ALL
  SELECT t + 1, list_filter(jobs, lambda x: x != list_filter(jobs, lambda y: y.rel <= t + 1)[1]), list_filter(jobs, lambda y: y.rel <= t + 1)[1] FROM run WHERE t + 1 < {PERIOD}
),
plan AS (SELECT pick.s AS s, pick.idx AS idx, pick.rel AS rel, pick.due AS due, t AS slot, count(*) OVER (PARTITION BY pick.s) AS slots FROM run WHERE t >= 0),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS n FROM d),
q AS (SELECT doc_id, source, s, n // {BLOCK_DOCS} AS block, n % {BLOCK_DOCS} AS off FROM r)
SELECT q.doc_id, q.source, block::BIGINT AS mix_block, (block // slots * {PERIOD} + slot)::BIGINT AS mix_slot,
       (block // slots * {PERIOD} + rel)::BIGINT AS mix_release, (block // slots * {PERIOD} + due)::BIGINT AS mix_deadline, off::INT AS mix_offset
FROM q JOIN plan ON q.s = plan.s AND plan.idx = block % slots + 1
"""
