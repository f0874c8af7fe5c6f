"""Mixing sources to target weights: a low-discrepancy schedule of slots over equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_names, guarded, own_name

#: Documents that share a running sum, slots that share a rank, how many of such groups share the next level, and cells in the lookup of sources.
BUCKET, CHUNK, FAN, CELL_BITS = 256, 1024, 1024, 12
#: Words of a block at least, and slots of a mix at most: a larger mix has blocks of twice, four times ... as many words.
LEAST_BLOCK, MOST_SLOTS = 32, 1 << 22
#: Points have POINT_BITS bits; GOLDEN is the golden ratio's fraction in as many, an odd number.
POINT_BITS, HALF = 40, 20
GOLDEN = int(0.6180339887498949 * (1 << POINT_BITS)) | 1
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def word_count(text: str | Column) -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """One row per source: source, sid (0, 1, ... by code point, null last), source_size, target, quota, most.

    The sources share `share` times the whole size by their weights, which
    repeat in source order; a target stops at `ceiling` times its source's size
    and what is above is reshared by weight among the rest until none is above:
    the level is found in closed form from running sums in order of
    ceiling / weight. quota is the target as whole words, most what the ceiling
    allows. The table has a row per source, so the global windows here are over
    that many rows.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size")).withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * share - gone("cap")) / (F.sum("w").over(everything) - gone("w")))
    per = per.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")))
    return per.select(source, "sid", "source_size", "target", F.least(F.round("target"), F.floor("cap")).cast("long").alias("quota"), F.floor("cap").cast("long").alias("most"))


def shape(per: DataFrame, block: int | None = None) -> tuple[int, int]:
    """Slots of the mix, and words of a block: LEAST_BLOCK, doubled until there are MOST_SLOTS slots at most, unless it is given."""
    total = per.agg(F.sum("quota")).first()[0] or 0
    if block is None:
        block = LEAST_BLOCK
        while -(-total // block) > MOST_SLOTS:
            block *= 2
    return -(-total // block), block


def point(k: Column) -> Column:
    """The k-th golden-ratio point, as an integer below 2 ** POINT_BITS: k * GOLDEN modulo that, in halves, so that no product overflows up to k = 2 ** POINT_BITS."""
    low, high = GOLDEN & (1 << HALF) - 1, GOLDEN >> HALF
    return (k * low + F.shiftleft((k * high).bitwiseAND((1 << HALF) - 1), HALF)).bitwiseAND((1 << POINT_BITS) - 1)


def _ahead(counts: DataFrame, group: str, at: str, n: str) -> DataFrame:
    """group, at, ahead: the sum of n over the group's smaller places; counts has each (group, at) once.

    Sums run within FAN places and then over these, so a group of any size is not in one task.
    """
    wide = counts.withColumn("__wide", F.floor(F.col(at) / FAN))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = wide.groupBy(group, "__wide").agg(F.sum(n).alias("__n")).select(group, "__wide", F.coalesce(F.sum("__n").over(before(group).orderBy("__wide")), F.lit(0)).alias("__top"))
    near = wide.select(group, at, "__wide", F.coalesce(F.sum(n).over(before(group, "__wide").orderBy(at)), F.lit(0)).alias("__near"))
    return near.join(tops, [group, "__wide"]).select(group, at, (F.col("__near") + F.col("__top")).alias("ahead"))


def schedule(per: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): which source fills each slot, and with which of its blocks, counted from 0.

    Slot k belongs to the source in whose part of the unit interval, laid out by
    quota, the point of k + 1 falls; so the schedule alone says how many blocks a
    source gives. Ranks within a source are counted by chunks of slots, then over
    chunks. Sources are looked up by the leading bits of the point.
    """
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    edge = lambda c: F.floor(c / F.sum("quota").over(Window.partitionBy()) * float(1 << POINT_BITS)).cast("long")
    part = per.where("quota > 0").select("sid", edge(upto - F.col("quota")).alias("low"), edge(upto).alias("high")).where("low < high")
    cell = lambda c: F.shiftright(c, POINT_BITS - CELL_BITS)
    cells = part.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    drawn = per.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = drawn.join(cells, "cell").where("u >= low and u < high").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    ahead = _ahead(drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "sid", "chunk", "n")
    ranked = drawn.withColumn("own", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(ahead, ["sid", "chunk"])
    return ranked.select("slot", "sid", (F.col("ahead") + F.col("own")).alias("rank"))


def sized(docs: DataFrame, keys: list[str | Column], doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """keys (a struct), id, source, size and a row number that stays, written to the shared folder."""
    own = docs.select(F.struct(*keys).alias("keys"), F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    return cut(own.withColumn("row", F.monotonically_increasing_id()), "sizes")


def mix(rows: DataFrame, per: DataFrame, block: int | None = None) -> DataFrame:
    """The mix: slot, sid, block, row, epoch, word_from, word_to (half-open, within the document).

    rows: id, source, size, row; per: targets(rows). Each source's documents
    are put in the order of a hash, and its words in that order, again and again,
    are cut into blocks; block b goes to the slot of rank b and blocks without a
    slot are not taken, nor is what lies past the ceiling. Running sums are
    within buckets of about BUCKET documents, then over buckets, so a source of
    any size is spread over many tasks. Documents without words are never taken;
    a null source is a source; the tie order of rows that repeat id and size
    doesn't show in the result; an empty table gives no row.
    """
    slots, block = shape(per, block)
    order = cut(schedule(per, slots), "schedule")
    given = per.where("quota > 0").join(order.groupBy("sid").agg(F.count("*").alias("blocks")), "sid").select("sid", F.col("source").alias("__of"), "source_size", F.least("most", F.col("blocks") * block).alias("words"))
    h = F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(rows.count() // BUCKET + 1)
    named = rows.where("size > 0").join(given, F.col("source").eqNullSafe(F.col("__of"))).select("sid", "row", "size", "source_size", "words", "id", h.alias("h"), bucket.alias("bucket"))
    by_hash = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size", "row")
    named = named.withColumn("start", F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = rows.where("size > 0").join(given, F.col("source").eqNullSafe(F.col("__of"))).groupBy("sid", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    named = named.join(_ahead(sums, "sid", "bucket", "n"), ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("ahead"))
    again = named.select("*", F.explode(F.expr("sequence(0L, (words - 1) div source_size)")).alias("epoch")).withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
    again = again.where("start < words").withColumn("end", F.least(F.col("start") + F.col("size"), F.col("words")))
    pieces = again.select("sid", "row", "epoch", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))
    pieces = pieces.select("sid", "block", "row", "epoch", (F.greatest("start", F.col("block") * block) - F.col("start")).alias("word_from"), (F.least("end", (F.col("block") + 1) * block) - F.col("start")).alias("word_to"))
    return pieces.join(order.withColumnRenamed("rank", "block"), ["sid", "block"]).select("slot", "sid", "block", "row", "epoch", "word_from", "word_to")


def taken(docs: DataFrame, keys: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int | None = None, **share) -> DataFrame:
    """keys, size, source_size, target, taken, slots, first_slot: one row per row of docs.

    taken counts the words that the mix takes, repeats counted, slots the slots
    that take them, first_slot is the first of these (null where nothing is
    taken). Null and empty texts have size 0 and are never taken; null ids and
    sources are values like any other; each of repeated rows is mixed on its own,
    and which of them gets what is left open where id and size are equal.
    """
    rows = sized(docs, [F.col(f"`{k}`") for k in keys], doc_id, source, text)
    per = cut(targets(rows, **share), "targets")
    words = mix(rows, per, block).groupBy("row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first_slot"))
    named = rows.join(per.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return named.join(words, "row", "left").select(*[F.col("keys").getField(k).alias(k) for k in keys], "size", "source_size", "target", zero("taken"), zero("slots"), "first_slot")


@guarded
def mixed_stream(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int | None = None, added: tuple[str, str, str, str] = ("slot", "epoch", "word_from", "word_to"), **share) -> DataFrame:
    """The mixed stream in slot order: the columns of docs, of which text is what a slot takes of a document, and the four added ones.

    A row is a stretch of a document's words, with the white space before each,
    in one slot: slot, epoch (0 at the first time round its source) and the
    half-open stretch. The partitions hold ranges of slots in order, sorted, so
    files written from them are the stream. Documents of which the mix takes no
    word have no row. Rows that repeat doc_id, source and text are one document
    that is taken so often; their other columns are those of any of them. The
    columns of docs may not have an added name.
    """
    free_names(docs, added)
    key, got = own_name(docs, "__key", "__got")
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    keyed = docs.withColumn(key, F.md5(F.concat_ws("\x1f", *[part(F.col(c)) for c in (doc_id, source, text)])))
    rows = sized(keyed, [F.col(key).alias("key")], doc_id, source, text)
    per = cut(targets(rows, **share), "targets")
    slots, _ = shape(per, block)
    pieces = mix(rows, per, block).join(rows.select("row", F.col("keys.key").alias(key)), "row")
    found = pieces.groupBy(key).agg(F.collect_list(F.struct("slot", "epoch", "word_from", "word_to")).alias(got))
    both = keyed.dropDuplicates([key]).join(found, key)
    words = F.regexp_extract_all(F.col(text), F.lit(SPACED_WORD), F.lit(0))
    stretch = lambda w, p: F.struct(*[p[c].alias(c) for c in ("slot", "epoch", "word_from", "word_to")], F.array_join(F.slice(w, p["word_from"].cast("int") + 1, (p["word_to"] - p["word_from"]).cast("int")), "").alias("text"))
    own = F.transform(F.array(words), lambda w: F.transform(F.col(got), lambda p: stretch(w, p)))[0]  # a text is split once
    out = both.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.explode(own).alias(got))
    out = out.select(*[F.col(f"{got}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{got}.{c}").alias(a) for c, a in zip(("slot", "epoch", "word_from", "word_to"), added)])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = out.repartitionById(n, F.expr(f"cast({added[0]} * {n} div {max(1, slots)} as int)"))
    return placed.sortWithinPartitions(added[0], doc_id, added[1], added[2])
