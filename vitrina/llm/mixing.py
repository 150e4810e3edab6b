"""Mixing sources to target weights, as DataFrame operations only.

Every source is one stream of words: its documents in a pseudorandom but fixed order, packed into blocks of ``block_words``
words. Output shards of ``shard_slots`` slots draw their source counts from the multinomial over the sources' slot quotas;
the draws of a source are numbered through the shards, and number j stands for block perm(j mod blocks) of pass
j div blocks, where perm is an affine index permutation of its own for each source and pass. Slots drawn beyond a
source's quota stay empty and those it did not draw are dealt to settling shards, so each source gives exactly its target
(its last slot may be a part of a block). Slots and documents' pieces meet in an equi-join on (source, block).

The permutation leaves the short last block of a source to the end of the pass. A source never gives more than two passes,
so no document gives more than twice its words. All numbers come from md5, so reruns agree.

Null and empty texts have size 0 and give nothing. A null source is a source of its own, after all others. Rows that agree
in doc_id, source and text are told apart by a copy number. An empty table gives an empty result. Other columns are not
read by ``mix``; ``mixed_documents`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.base import WORD, hash60, let, stored

# Weights by the rank of the source, share of all words, passes over one source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Multipliers of the permutations: primes, so one that does not divide the number of blocks is prime to it.
PRIMES = (99999989, 99999971, 99999959, 99999941, 99999931, 99999847, 99999839, 99999827)
CHUNKS = 1024
CELLS = 4096
KEY = ["doc_id", "source", "size", "text_hash"]


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"))


def targets(sizes: DataFrame) -> DataFrame:
    """source_no, source, source_size, target of each source; ``sizes`` has source and size.

    The windows below run over one row per source. With weights w and limits c the targets are min(c, level * w): sorted
    by c / w, the first source whose limit is not reached at the level left for it and those after it gives the level.
    """
    first = Window.orderBy(F.col("source").asc_nulls_last())
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        (F.row_number().over(first) - 1).cast("long").alias("source_no"), "source", "source_size").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    whole, before = Window.partitionBy(), Window.orderBy("steep", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = each.withColumn("most", (F.col("source_size") * MOST).cast("double")).withColumn(
        "steep", F.col("most") / F.col("weight")).withColumn(
        "left", F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn(
        "level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).withColumn(
        "fair", F.max(F.when(F.col("level") <= F.col("steep"), F.col("level"))).over(whole))
    return level.select("source_no", "source", "source_size",
                        F.least("most", F.coalesce(F.col("fair"), F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(each: DataFrame, block_words: int) -> DataFrame:
    """Adds blocks, full passes, words and slots of the last pass, and the slot quota of each source."""
    wanted = F.round("target").cast("long")
    return each.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "full", F.floor(wanted / F.col("source_size"))).withColumn(
        "rest", wanted - F.col("full") * F.col("source_size")).withColumn(
        "quota", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block_words))


def draws(quotas: DataFrame, shard_slots: int) -> DataFrame:
    """source_no, shard, first, n: how many slots each shard drew from each source, and where their numbers begin."""
    spark = quotas.sparkSession
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    running = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    edges = quotas.where("quota > 0").withColumn("hi", F.sum("quota").over(running) / F.lit(float(max(total, 1)))).withColumn(
        "lo", F.col("hi") - F.col("quota") / F.lit(float(max(total, 1))))
    cells = edges.select("source_no", "lo", "hi", F.explode(F.sequence(
        F.floor(F.greatest(F.col("lo"), F.lit(0.0)) * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    u = hash60(F.lit("draw"), F.col("id")) / float(1 << 60)
    slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), u.alias("u")).withColumn(
        "cell", F.floor(F.col("u") * CELLS))
    drawn = slots.join(cells, "cell").where("u >= lo and u < hi").groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    numbered = drawn.withColumn("first", F.sum("n").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("n"))
    used = numbered.join(quotas.select("source_no", "quota"), "source_no").where("first < quota").select(
        "source_no", "shard", "first", F.least("n", F.col("quota") - F.col("first")).alias("n"))
    late = quotas.join(drawn.groupBy("source_no").agg(F.sum("n").alias("had")), "source_no", "left").select(
        "source_no", F.lit(-1).cast("long").alias("shard"), F.coalesce("had", F.lit(0)).alias("first"),
        (F.col("quota") - F.coalesce("had", F.lit(0))).alias("n")).where("n > 0")
    return used.union(late)


def slots(quotas: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """source_no, shard, pass, block, words: every slot of the mix (shard -1: dealt to settling shards)."""
    primes = F.array(*map(F.lit, PRIMES))
    each = draws(quotas, shard_slots).where("n > 0").select(
        "source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    full = each.join(quotas, "source_no").withColumn("pass", F.floor(F.col("j") / F.col("blocks"))).withColumn(
        "pos", F.col("j") % F.col("blocks"))
    turn = (hash60(F.lit("turn"), F.col("source_no"), F.col("pass")) % len(PRIMES)).cast("int")
    fit = F.filter(F.concat(F.slice(primes, turn + 1, F.lit(len(PRIMES))), F.slice(primes, F.lit(1), turn)),
                   lambda p: F.col("blocks") % p != 0)
    block = F.pmod((F.element_at(fit, 1) % F.col("blocks")) * (F.col("pos") + 1) - 1, F.col("blocks"))
    words = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    return full.select("source_no", "shard", "pass", block.alias("block"), F.when(
        F.col("pass") < F.col("full"), words).otherwise(F.least(words, F.col("rest") - F.col("pos") * block_words)).alias("words"))


def placed(sizes: DataFrame, each: DataFrame) -> DataFrame:
    """KEY columns, source_no, copy and start: where each document's words begin in the stream of its source.

    A source is cut into CHUNKS by a hash of doc_id, so running sums are taken chunk by chunk, also for a source with a
    third of all rows; the sums of the chunks are few.
    """
    rows = sizes.groupBy(*KEY).agg(F.count("*").alias("copies")).withColumn("chunk", hash60(F.col("doc_id")) % CHUNKS)
    rows = rows.join(each.select("source_no", F.col("source").alias("s"), "target", "source_size"),
                     F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("all", F.col("size") * F.col("copies"))
    sums = rows.groupBy("source_no", "chunk").agg(F.sum("all").alias("chunk_words"))
    base = sums.withColumn("base", F.sum("chunk_words").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("chunk_words"))
    inner = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size", "text_hash")
    at = rows.withColumn("before", F.sum("all").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("all"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return at.join(base.select("source_no", "chunk", "base"), ["source_no", "chunk"]).select(
        *KEY, "source_no", "source_size", "target", (F.col("base") + F.col("before")).alias("begin"), copy).withColumn(
        "start", F.col("begin") + F.col("copy") * F.col("size")).drop("begin")


def mix(docs: DataFrame, block_words: int = 256, shard_slots: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): ``placed`` rows, and the pieces of documents that the slots take.

    A piece: KEY columns, source_no, copy, shard, pass, from (words before it in its document) and n (its words).
    """
    sizes = sized(docs)
    each = stored(targets(sizes), "mix-targets")
    quotas = plan(each, block_words)
    rows = stored(placed(sizes, each), "mix-places")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    met = parts.join(slots(quotas, block_words, shard_slots), ["source_no", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    pieces = met.select(*KEY, "source_no", "copy", "shard", "pass", (begin - F.col("start")).alias("from"), (end - begin).alias("n"))
    return rows, pieces.where("n > 0")


def taken(docs: DataFrame, block_words: int = 256, shard_slots: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows, pieces = mix(docs, block_words, shard_slots)
    id_cols = [*KEY, "copy"]
    got = pieces.select(*id_cols, F.col("n").alias("n"), F.lit(None).cast("long").alias("source_size"),
                        F.lit(None).cast("double").alias("target"))
    none = rows.select(*id_cols, F.lit(0).cast("long").alias("n"), "source_size", "target")
    return got.unionByName(none).groupBy(*id_cols).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("n").alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = 256, shard_slots: int = 4096) -> DataFrame:
    """The mix as documents with the columns of the input: one row for each pass that takes words of a document.

    A document taken whole keeps its text; of others the taken word ranges remain, in order, each word with the white space
    before it. n_chars, where present, is the new length. Documents not taken go.
    """
    _, pieces = mix(docs, block_words, shard_slots)
    runs = pieces.groupBy(*KEY, "copy", "pass").agg(
        F.sum("n").alias("_n"), F.array_sort(F.collect_list(F.struct("from", "n"))).alias("_runs")).drop("copy", "pass")
    texts = docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn(
        "_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "_size", "_hash"])
    runs = runs.select(*[F.col(c).alias(f"_k_{c}") for c in KEY], "_n", "_runs")
    joined = texts.join(runs, F.col("doc_id").eqNullSafe(F.col("_k_doc_id")) & F.col("source").eqNullSafe(F.col("_k_source"))
                        & (F.col("_size") == F.col("_k_size")) & (F.col("_hash") == F.col("_k_text_hash")))
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = let(words, lambda w: F.array_join(F.flatten(F.transform(
        "_runs", lambda r: F.slice(w, (r["from"] + 1).cast("int"), r["n"].cast("int")))), ""))
    out = joined.withColumn("text", F.when(F.col("_n") == F.col("_size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
