"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are packed end to end and cut into blocks of ``block_words``. A source's target share fixes
how many block slots it gets. Each slot draws its output shard, so that a source's counts over the shards are one
multinomial draw, whose total is the source's number of slots: every shard is random and every target is met. A slot
maps through a keyed pseudorandom permutation of the source's block indices (another one each time all blocks have been
used) and is joined to the blocks by index. The permutation is a swap-or-not shuffle: in each round an index x trades
places with K - x, or not, as a hash of the greater of the two says. It is a bijection for any number of blocks.

Targets are found in closed form: order the sources by cap over weight, and the level at which the first uncapped
source stands is what is left of the total over what is left of the weights. That needs one row for each source.

A hot source does no harm: documents are packed in chunks dealt by a hash of their id, a chunk's start comes from the
chunks' totals, slots are drawn in runs of bounded length, and (source, block) is never a frequent key. Nothing that grows
with the documents is broadcast. Hashes are plain arithmetic below 2**62, so that other engines can repeat a mix.

Defined cases: a null source is a source of its own, last in order; a null or empty text has no words, takes none and
is given back with ``taken`` 0; ids may be of any kind, null or repeat (rows of the same id and size may trade places);
no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, WORD_CLASS, fresh, materialize, table

WEIGHTS = (5, 2, 1)
CHUNK_DIGITS = 3
#: Slots that are drawn together, and slots whose runs are listed together.
RUN, MANY = 1 << 15, 1 << 33
ROUNDS = 16
PRIME = 2147483647


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, cap: int = 2, block_words: int = 128) -> DataFrame:
    """One row for each source: no (0, 1, ... in code point order, null last), source_size, target, n_blocks, n_slots."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    src = src.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    src = src.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.col("no") % len(weights)).cast("double"))
    src = src.withColumn("cap", F.col("source_size") * float(cap))
    upto = Window.orderBy(F.col("cap") / F.col("w"), "no")
    src = (
        src.withColumn("total", F.sum("source_size").over(everything) * total_share)
        .withColumn("cap_before", F.sum("cap").over(upto.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_from", F.sum("w").over(upto.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("cap_before", F.lit(0.0))) / F.col("w_from"))
    )
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "no", "level"))).over(everything)["level"]
    src = src.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("w")))
    src = src.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    slots = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), cap * F.col("n_blocks"))
    return src.select("source", "no", "source_size", "target", "n_blocks", F.when(F.col("source_size") > 0, slots).otherwise(0).alias("n_slots"))


def _hash(*parts: str) -> str:
    """SQL of a number below PRIME made from BIGINT expressions, none of them negative."""
    return f"aggregate(array({parts[0]} div {PRIME}, {', '.join(f'bigint({p})' for p in parts[1:])}), {parts[0]} % {PRIME}, (h, c) -> (h * h + c * 48271 + 11) % {PRIME})"


def round_keys(n_blocks: str, no: str, cap: int, seed: int) -> Column:
    """The keys K of all rounds of a source's permutations, one permutation after the other."""
    key = f"({_hash('i', no, str(2 * seed))} * {PRIME} + {_hash('i', no, str(2 * seed + 1))}) % {n_blocks}"
    return F.expr(f"transform(sequence(0L, {cap * ROUNDS - 1}L), i -> {key})")


def permuted(slot: str, n_blocks: str, no: str, keys: str = "keys") -> Column:
    """The block index of a slot: the permutation of the source and of how often its blocks have been used up."""
    key = f"{keys}[int(i + {ROUNDS} * ({slot} div {n_blocks}))]"
    other = f"pmod({key} - x, {n_blocks})"
    swaps = f"{_hash(f'greatest(x, {other})', f'i + {ROUNDS} * ({slot} div {n_blocks})', no)} div 4096 % 2 = 1"
    return F.expr(f"aggregate(sequence(0L, {ROUNDS - 1}L), {slot} % {n_blocks}, (x, i) -> CASE WHEN {swaps} THEN {other} ELSE x END)")


def draw_slots(src: DataFrame, slots_per_shard: int = 4096, seed: int = 1, cap: int = 2) -> DataFrame:
    """(shard, no, slot, block): which block of which source stands at which slot of which shard."""
    all_slots = F.sum("n_slots").over(Window.partitionBy())
    src = src.where("n_slots > 0").select("no", "n_blocks", "n_slots", F.ceil(all_slots / slots_per_shard).cast("long").alias("shards"), round_keys("n_blocks", "no", cap, seed).alias("keys"))
    long = lambda n: F.lit(n).cast("long")
    many = src.select("*", F.explode(F.sequence(long(0), F.col("n_slots") - 1, long(MANY))).alias("begin"))
    runs = many.select("*", F.explode(F.sequence("begin", F.least(F.col("begin") + MANY, F.col("n_slots")) - 1, long(RUN))).alias("first"))
    # by number, as these few rows become many, and would else be dealt to one task
    runs = runs.repartition(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), "no", "first")
    drawn = runs.select("no", "n_blocks", "shards", "keys", F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("n_slots")) - 1)).alias("slot"))
    shard = F.expr(f"{_hash('slot', 'no', str(seed), '7')} * shards div {PRIME}")
    return drawn.select(shard.alias("shard"), "no", "slot", permuted("slot", "n_blocks", "no").alias("block"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, no, n): the drawn counts of each source in each output shard."""
    return slots.groupBy("shard", "no").agg(F.count(F.lit(1)).alias("n"))


def offsets(sized: DataFrame, src: DataFrame) -> DataFrame:
    """(rid, size, no, source_size, target, off): at which word of its source each row begins."""
    chunk = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, CHUNK_DIGITS)
    rows = sized.select("rid", "doc_id", "size", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), chunk.alias("chunk"))
    before = Window.partitionBy("s", "none", "chunk").orderBy("doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))

    chunks = sized.groupBy("source", chunk.alias("chunk")).agg(F.sum("size").alias("n"))
    starts = F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("start", F.coalesce(starts, F.lit(0)))
    at = chunks.join(src, chunks["source"].eqNullSafe(src["source"])).select(F.coalesce(chunks["source"], F.lit("")).alias("s"), chunks["source"].isNull().alias("none"), "chunk", "start", "no", "source_size", "target")
    return rows.join(at.hint("merge"), ["s", "none", "chunk"]).select("rid", "size", "no", "source_size", "target", (F.col("start") + F.col("within")).alias("off"))


def pack(sized: DataFrame, src: DataFrame, block_words: int) -> DataFrame:
    """(rid, no, source_size, target, block, share): the words that each row has in each block of its source; a row without
    words comes once, with neither block nor share."""
    rows = offsets(sized, src)
    last = F.expr(f"(off + size - 1) div {block_words}")
    pieces = rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"off div {block_words}"), last))).alias("block"))
    share = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("off", F.col("block") * block_words)
    return pieces.select("rid", "no", "source_size", "target", "block", share.alias("share"))


def plan_mix(sized: DataFrame, block_words: int = 128, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, cap: int = 2, seed: int = 1) -> DataFrame:
    """sized has rid (unique), doc_id, source and size. Gives rid, source_size, target, taken (words, repeats counted) and
    n_shards (output shards that hold some of them) for each of its rows."""
    src = source_targets(sized, weights, total_share, cap, block_words)
    slots = draw_slots(src, seed=seed, cap=cap).select("no", "block", "shard")
    mixed = pack(sized, src, block_words).join(slots.hint("merge"), ["no", "block"], "left")
    in_shard = mixed.groupBy("rid", "source_size", "target", "shard").agg(F.sum("share").alias("share"))
    held = F.when(F.col("shard").isNotNull(), F.col("share"))
    return in_shard.groupBy("rid", "source_size", "target").agg(F.coalesce(F.sum(held), F.lit(0)).alias("taken"), F.count("shard").alias("n_shards"))


def block_texts(rows: DataFrame, block_words: int) -> DataFrame:
    """(no, block, words) of rows (no, off, size, text): the words of each block, of all rows that reach into it, in their order. A row gives
    its blocks slices of its words, so no text is copied for each."""

    def slices(words: Column) -> Column:
        blocks = F.sequence(F.expr(f"off div {block_words}"), F.expr(f"(off + size - 1) div {block_words}"))

        def one(b: Column) -> Column:
            begin = F.greatest("off", b * block_words)
            count = F.least(F.col("off") + F.col("size"), (b + 1) * block_words) - begin
            return F.struct(b.alias("block"), begin.alias("begin"), F.slice(words, (begin - F.col("off") + 1).cast("int"), count.cast("int")).alias("words"))

        return F.transform(blocks, one)

    words = F.array_remove(F.split("text", SPACE_CLASS + "+", -1), "")
    pieces = rows.where("size > 0").select("no", F.explode(F.get(F.transform(F.array(words), slices), 0)).alias("p"))
    # a block has no more rows than words
    inner = F.array_sort(F.collect_list(F.struct("p.begin", "p.words")))
    return pieces.groupBy("no", F.col("p.block").alias("block")).agg(F.flatten(F.transform(inner, lambda x: x["words"])).alias("words"))


def mixed_blocks(docs: DataFrame, block_words: int = 128, slots_per_shard: int = 4096, seed: int = 1) -> DataFrame:
    """The mix itself: (shard, place, source, block, words), one row for each drawn slot. place counts the slots of a shard, in an
    order that mixes its sources; words are those of the block that the slot maps to, joined by index. The last block of a
    source may be short. Documents are packed, and slots drawn, as plan_mix does it, whose taken words are those that come here."""
    base = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text", count_words(docs["text"]).alias("size")), "mix-texts")
    src = source_targets(base, block_words=block_words)
    at = offsets(base.select("rid", "doc_id", "source", "size"), src)
    blocks = block_texts(base.select("rid", "text").join(at.hint("merge"), "rid"), block_words)
    drawn = draw_slots(src, slots_per_shard, seed).join(blocks.hint("merge"), ["no", "block"]).join(src.select("no", "source"), "no")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("no", "slot"), "no", "slot")
    return drawn.select("shard", (F.row_number().over(order) - 1).alias("place"), "source", "block", "words")


def mix_documents(docs: DataFrame, block_words: int = 128) -> DataFrame:
    """Documents as the mix repeats them: each row comes 0, 1 or 2 times, as often as its words are taken, rounded up or
    down by a hash of its id so that the expected number of words is right. The columns are those of docs; rows without words go."""
    rid, size, times, copy = (fresh(docs, c) for c in ("mix_rid", "mix_size", "mix_times", "mix_copy"))
    base = materialize(docs.select("*", F.monotonically_increasing_id().alias(rid), count_words(docs["text"]).alias(size)), "mix-input")
    plan = plan_mix(base.select(F.col(rid).alias("rid"), "doc_id", "source", F.col(size).alias("size")), block_words)
    plan = plan.where("taken > 0").select(F.col("rid").alias(rid), F.col("taken").alias(times))
    toss = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col(rid).cast("string"))), F.lit(1000)) / 1000
    out = base.join(plan.hint("merge"), rid).withColumn(times, F.floor(F.col(times) / F.col(size) + toss).cast("int"))
    out = out.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[out[f"`{c}`"] for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", count_words(docs["text"]).alias("size")), "mix-sizes")
    plan = plan_mix(sized)
    return sized.join(plan.hint("merge"), "rid").select("doc_id", "size", "source_size", "target", "taken", "n_shards")


OP9_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), lv AS (SELECT level FROM s2 WHERE level * w <= cap ORDER BY cap / w, no LIMIT 1),
src AS (
  SELECT source, no, source_size, least(cap, coalesce((SELECT level FROM lv), 'inf'::DOUBLE) * w) AS target,
         ceil(source_size / 128)::BIGINT AS nb FROM s2
), counts AS (
  SELECT no, nb, least(round(target * nb / source_size)::BIGINT, 2 * nb) AS n_slots FROM src WHERE source_size > 0
), shards AS (SELECT ceil(sum(n_slots) / 4096)::BIGINT AS shards FROM counts),
keyed AS (  -- thirty-two round keys for each source: sixteen for each time that its blocks are used
  SELECT no, nb, n_slots, list_transform(range(32), lambda i:
      ((list_reduce([i % 2147483647, i // 2147483647, no, 2], lambda h, c: (h * h + c * 48271 + 11) % 2147483647)) * 2147483647
       + list_reduce([i % 2147483647, i // 2147483647, no, 3], lambda h, c: (h * h + c * 48271 + 11) % 2147483647)) % nb) AS keys
  FROM counts
), slots AS (
  SELECT no, nb, keys, k, (k // nb) * 16 AS r0,
         list_reduce([k % 2147483647, k // 2147483647, no, 1, 7], lambda h, c: (h * h + c * 48271 + 11) % 2147483647) * (SELECT shards FROM shards) // 2147483647 AS shard
  FROM (SELECT *, unnest(range(n_slots)) AS k FROM keyed)
), used AS (
  SELECT no, shard, list_reduce(list_prepend(k % nb, range(16)), lambda x, i:
      CASE WHEN list_reduce([greatest(x, (keys[i + r0 + 1] - x + nb) % nb) % 2147483647, greatest(x, (keys[i + r0 + 1] - x + nb) % nb) // 2147483647, i + r0, no],
                            lambda h, c: (h * h + c * 48271 + 11) % 2147483647) // 4096 % 2 = 1
           THEN (keys[i + r0 + 1] - x + nb) % nb ELSE x END) AS block
  FROM slots
), c AS (
  SELECT d.*, no, source_size, target, substr(md5(coalesce(doc_id::VARCHAR, size::VARCHAR)), 1, 3) AS chunk
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), p AS (
  SELECT *, (sum(size) OVER (PARTITION BY no ORDER BY chunk, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING))::BIGINT - size AS off FROM c
), pieces AS (
  SELECT rid, no, off, size, unnest(range(off // 128, (off + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0
), taken AS (
  SELECT rid, sum(least(off + size, (block + 1) * 128) - greatest(off, block * 128))::BIGINT AS taken, count(DISTINCT shard)::BIGINT AS n_shards
  FROM pieces JOIN used USING (no, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_shards, 0)::BIGINT AS n_shards FROM p LEFT JOIN taken USING (rid)
"""
