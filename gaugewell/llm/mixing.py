"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a shuffled order and laid end to end; the stream
is cut into blocks of equal numbers of words. The points frac(i * golden ratio), i = 0,
1, ... (in whole numbers, so that no fraction is lost), fall through the cumulative weights of the sources: point i gives slot i to a
source. Slots are ranked per source, and the slot of rank r takes block r modulo the
source's number of blocks. Golden-ratio points fill every interval evenly, so any
stretch of the schedule mixes the sources in proportion, and each source's slots
differ from its share by a few blocks at most.

Running sums and ranks of one source are computed in chunks (chunk totals first), so
that a source with a third of all rows is spread over many tasks.

Defined results: a null text has size 0 and is never taken; a null source is a source
of its own, last in order; equal ids are told apart by their text; an empty table gives
an empty result; only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.sources.shared import materialise

#: The golden ratio's fraction in 2**-GOLDEN_BITS: its multiples stay exact up to 2**44 slots.
GOLDEN_BITS = 40
GOLDEN = 679535556991
#: Weights in turn, by source in code-point order, null last.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
BLOCK_WORDS = 512
LEAST_BLOCKS = 256
#: Chunks of a source's shuffled order, and slots in a chunk of the schedule.
ORDER_CHUNKS = 4096
SLOT_CHUNK = 8192
#: Cells of the number line in which points meet intervals.
CELLS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words. A boundary is a place where a word ends."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (src): source_size, weight, target.

    Closed form of sharing out by weight with a ceiling of MOST_EPOCHS times the size:
    a source is at its ceiling if ceiling / weight is among the smallest; going up in that
    order, the level is what remains divided by the weights that remain.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    w = by.select("*", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).alias("weight"))
    ceiling = (F.col("source_size") * MOST_EPOCHS).cast("double")
    w = w.select("*", ceiling.alias("ceiling"), (ceiling / F.col("weight")).alias("turn"))
    up = Window.orderBy("turn", F.col("src").asc_nulls_last())
    every = Window.partitionBy()
    w = w.select(
        "*",
        (TOTAL_SHARE * F.sum("source_size").over(every) - (F.sum("ceiling").over(up) - F.col("ceiling"))).alias("left"),
        (F.sum("weight").over(every) - (F.sum("weight").over(up) - F.col("weight"))).alias("left_weight"),
    )
    # the first source, going up, that its share leaves below the ceiling sets the level for itself and all above
    w = w.select("*", (F.col("left") / F.col("left_weight")).alias("share"))
    w = w.select("*", F.min(F.when(F.col("share") <= F.col("turn"), F.struct("turn", "src", "share"))).over(every)["share"].alias("level"))
    target = F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling")))
    return w.select("src", "source_size", "weight", target.alias("target"))


def order_key(id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> Column:
    """What the shuffled order goes by: of the id and the text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.md5(F.coalesce(F.col(text_col), F.lit("~")))).cast("binary"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 17, key_col: str | None = None) -> DataFrame:
    """Per row: id, size, source_size, target, taken; under the name key_col, if given, its order_key()."""
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), order_key(id_col, text_col, seed).alias("key"))
    docs = materialise(docs.withColumn("chunk", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ORDER_CHUNKS / 2**32).cast("int")), "mix-docs")
    sources = materialise(_schedule(targets(docs), block_words), "mix-sources")
    out = _taken(_places(docs, sources), _taken_blocks(sources))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", *([F.col("key").alias(key_col)] if key_col else []))


def _schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Blocks and slots of each source, and its interval of the number line [0, n_slots)."""
    n_blocks = F.least(F.col("source_size"), F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(LEAST_BLOCKS))).cast("long")
    s = sources.select("src", "source_size", "target", n_blocks.alias("n_blocks"))
    s = s.select("*", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0)).alias("slots"))
    s = s.select(
        "*",
        F.expr("source_size div greatest(n_blocks, 1L)").alias("block_size"),
        F.expr("source_size % greatest(n_blocks, 1L)").alias("longer"),
        F.sum("slots").over(Window.orderBy(F.col("src").asc_nulls_last())).alias("high"),
    )
    s = s.select("*", (F.col("high") - F.col("slots")).alias("low"), F.max("high").over(Window.partitionBy()).alias("n_slots"))
    # the last interval is open above, so that rounding loses no point
    last = F.col("high") == F.col("n_slots")
    return s.select("*", F.when(last, F.lit(float("inf"))).otherwise(F.col("high")).alias("upper"))


def _taken_blocks(sources: DataFrame) -> DataFrame:
    """Per source and block: how many slots take it."""
    n = sources.agg(F.coalesce(F.max("n_slots"), F.lit(0.0)).alias("n_slots")).select("n_slots", F.round("n_slots").cast("long").alias("n"))
    chunks = n.where("n > 0").select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLOT_CHUNK})")).alias("slot_chunk"))
    chunks = chunks.repartition(F.col("slot_chunk"))
    slots = chunks.select("n_slots", "slot_chunk", F.explode(F.expr(f"sequence(slot_chunk * {SLOT_CHUNK}, least(n, (slot_chunk + 1) * {SLOT_CHUNK}) - 1)")).alias("slot"))
    # slot * GOLDEN modulo 2**GOLDEN_BITS, by halves that don't overflow
    whole = 1 << GOLDEN_BITS
    turn = F.expr(f"pmod(pmod((slot >> 22) * {GOLDEN}L, {whole}L) * {1 << 22}L + (slot & {(1 << 22) - 1}L) * {GOLDEN}L, {whole}L)")
    slots = slots.select("n_slots", "slot_chunk", "slot", (turn / float(whole) * F.col("n_slots")).alias("point"))
    cell = lambda c: F.least(F.lit(CELLS - 1).cast("long"), F.floor(c / F.col("n_slots") * CELLS))
    slots = slots.select("slot_chunk", "slot", "point", cell(F.col("point")).alias("cell"))
    # a point meets only the sources whose interval reaches into its cell
    reach = sources.where("slots > 0").select("src", "n_blocks", "low", "upper", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    hit = slots.join(reach, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("upper"))).select("src", "n_blocks", "slot_chunk", "slot")
    ranked = hit.select("src", "n_blocks", "slot_chunk", (F.row_number().over(Window.partitionBy("src", "slot_chunk").orderBy("slot")) - 1).alias("r"))
    counts = hit.groupBy(F.col("src").alias("b_src"), F.col("slot_chunk").alias("b_chunk")).agg(F.count("*").alias("c"))
    before = counts.select("b_src", "b_chunk", (F.sum("c").over(Window.partitionBy("b_src").orderBy("b_chunk")) - F.col("c")).alias("before"))
    ranked = ranked.join(before, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("slot_chunk") == F.col("b_chunk")))
    ranked = ranked.select("src", "n_blocks", (F.col("before") + F.col("r")).alias("rank")).where(F.col("rank") < MOST_EPOCHS * F.col("n_blocks"))
    return ranked.groupBy(F.col("src").alias("t_src"), F.pmod("rank", F.col("n_blocks")).alias("t_block")).agg(F.count("*").alias("times"))


def _places(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each document's words lie in its source's stream: from (in) to (out)."""
    chunk_sums = docs.groupBy(F.col("src").alias("b_src"), F.col("chunk").alias("b_chunk")).agg(F.sum("size").alias("c"))
    before = chunk_sums.select("b_src", "b_chunk", (F.sum("c").over(Window.partitionBy("b_src").orderBy("b_chunk")) - F.col("c")).alias("before"))
    head = sources.select(F.col("src").alias("s_src"), "source_size", "target", "n_blocks", "block_size", "longer")
    before = before.join(head, F.col("b_src").eqNullSafe(F.col("s_src"))).drop("s_src")
    in_chunk = Window.partitionBy("src", "chunk").orderBy("key")
    placed = docs.select("*", F.row_number().over(in_chunk).alias("nth"), F.sum("size").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    placed = placed.join(before, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("chunk") == F.col("b_chunk")))
    to = F.col("before") + F.col("upto")
    return placed.select("id", "key", "src", "chunk", "nth", "size", "source_size", "target", "block_size", "longer", (to - F.col("size")).alias("from"), to.alias("to"))


def _taken(places: DataFrame, per_block: DataFrame) -> DataFrame:
    """The first ``longer`` blocks hold a word more than the others."""
    start = lambda b: b * F.col("block_size") + F.least(b, F.col("longer"))
    block = "CASE WHEN {w} < longer * (block_size + 1) THEN {w} div (block_size + 1) ELSE longer + ({w} - longer * (block_size + 1)) div block_size END"
    some = places.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence({block.format(w='`from`')}, {block.format(w='(`to` - 1)')})")))
    some = some.withColumn("words", F.least("to", start(F.col("block") + 1)) - F.greatest("from", start(F.col("block"))))
    # the blocks grow with the words: joined alike at every size
    some = some.join(per_block.hint("merge"), F.col("src").eqNullSafe(F.col("t_src")) & (F.col("block") == F.col("t_block")), "left")
    out = some.groupBy("id", "key", "src", "chunk", "nth", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = places.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["id", "key", "size", "source_size", "target", "taken"]
    return out.select(cols).unionAll(none.select(cols))


def oracle(block_words: int = BLOCK_WORDS, seed: int = 17) -> str:
    """DuckDB SQL for the query's rows: plain windows, no chunks or cells."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{seed}|' || coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, '~'))) AS key FROM documents),
w AS (SELECT src, source_size, ([{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}])[(row_number() OVER (ORDER BY src NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
    ({MOST_EPOCHS} * source_size)::DOUBLE AS ceiling FROM (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src)),
l AS (SELECT *, ({TOTAL_SHARE}::DOUBLE * sum(source_size) OVER () - (sum(ceiling) OVER up - ceiling)) / (sum(weight) OVER () - (sum(weight) OVER up - weight)) AS share
    FROM w WINDOW up AS (ORDER BY ceiling / weight, src NULLS LAST)),
t AS (SELECT src, source_size, least(ceiling, coalesce((SELECT arg_min(share, ceiling / weight) FROM l WHERE share <= ceiling / weight) * weight, ceiling)) AS target FROM l),
b AS (SELECT *, least(source_size, greatest(ceil(source_size / {block_words}::DOUBLE), {LEAST_BLOCKS}))::BIGINT AS n_blocks FROM t),
s AS (SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS slots FROM b),
i AS (SELECT *, source_size // greatest(n_blocks, 1) AS q, source_size % greatest(n_blocks, 1) AS m, sum(slots) OVER (ORDER BY src NULLS LAST) AS high, sum(slots) OVER () AS n_slots FROM s),
p AS (SELECT slot, ((slot::HUGEINT * {GOLDEN}) % {1 << GOLDEN_BITS})::DOUBLE / {1 << GOLDEN_BITS}::DOUBLE * n AS point FROM (SELECT unnest(range(round(n)::BIGINT)) AS slot, n FROM (SELECT max(high) AS n FROM i))),
r AS (SELECT src, n_blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS r
    FROM p JOIN (SELECT src, n_blocks, high - slots AS low, CASE WHEN high = (SELECT max(high) FROM i) THEN 'infinity'::DOUBLE ELSE high END AS upper FROM i WHERE slots > 0)
    ON point >= low AND point < upper),
k AS (SELECT src, r % n_blocks AS block, count(*) AS times FROM r WHERE r < {MOST_EPOCHS} * n_blocks GROUP BY ALL),
z AS (SELECT rid, doc_id, size, d.src, source_size, target, n_blocks, q, m, sum(size) OVER (PARTITION BY d.src ORDER BY key, rid) AS upto FROM d JOIN i ON d.src IS NOT DISTINCT FROM i.src),
e AS (SELECT rid, src, q, m, upto - size AS f, upto AS u, unnest(range(
    (CASE WHEN upto - size < m * (q + 1) THEN (upto - size) // (q + 1) ELSE m + (upto - size - m * (q + 1)) // q END)::BIGINT,
    (CASE WHEN upto - 1 < m * (q + 1) THEN (upto - 1) // (q + 1) ELSE m + (upto - 1 - m * (q + 1)) // q END + 1)::BIGINT)) AS block FROM z WHERE size > 0),
g AS (SELECT rid, sum((least(u, (e.block + 1) * q + least(e.block + 1, m)) - greatest(f, e.block * q + least(e.block, m))) * times) AS taken
    FROM e JOIN k ON e.src IS NOT DISTINCT FROM k.src AND e.block = k.block GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM z LEFT JOIN g USING (rid)"""
