"""Operator 1, document fingerprints: SimHash, with DataFrame functions only.

A document's terms are its runs of SHINGLE words (a shorter text is one term). Each occurrence of a term casts its
64-bit hash as signed votes, so a term weighs as often as it stands in the text; a fingerprint's bit is set where more
than half of the votes are. Two counters share one long, so 32 sums count 64 bits.

Search: the 64 bits fall into BLOCKS blocks. Fingerprints within RADIUS bits differ in at most RADIUS blocks, so they
agree in some BLOCKS - RADIUS of them; there is one table for each choice, keyed by those blocks moved to the front.
A join on the keys finds every fingerprint within the radius, and the distance is checked on each candidate.

Texts that share four fifths of their terms lie about 10 bits apart, 13 at most as a rule: NEAR_RADIUS. For so wide a
radius the bits fall into NEAR_BLOCKS blocks, one table each, and a query asks for its own block and for those that
differ in a few bits (`probes`): as many in each block that, by counting, a fingerprint within the radius has one block
no further off. So nothing within the radius is missed here either, and a fingerprint is stored only once a block. Of
all pairs of a query and a fingerprint the join looks at about one in forty.

Nulls are empty texts; a text without words has fingerprint 0. A null doc_id comes before all others. Rows with the
same id follow in order of their text; equal rows get equal results. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import shared

SHINGLE = 5
RADIUS = 3
BLOCKS = 6
NEAR_RADIUS = 13
NEAR_BLOCKS = 4
RANGE_ROWS = 1024
MOST_RANGES = 4096
_STRIDE = 64
_LANES = 0x100000001


def simhash(docs: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """(key, fp long, carried) for each row of docs; `key` names a row, carried longs come along; fp is null without words."""
    words = docs.select(key, *carried, F.regexp_extract_all(text, F.lit(shared.WORD), F.lit(0)).alias("words"))
    runs = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))).alias(f"w{i}") for i in range(SHINGLE)])
    terms = words.select(key, *carried, F.explode_outer(F.when(F.size("words") > 0, runs)).alias("t"))
    terms = terms.select(key, *carried, F.when(F.col("t").isNotNull(), F.xxhash64(*[F.col(f"t.w{i}") for i in range(SHINGLE)])).alias("h"))
    votes = terms.groupBy(key).agg(F.count("h").alias("n"), *[F.max(c).alias(c) for c in carried], *[F.coalesce(F.sum(F.shiftright("h", i).bitwiseAND(F.lit(_LANES))), F.lit(0)).alias(f"v{i}") for i in range(32)])
    bits = [_bit(F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(32)] + [_bit(F.shiftrightunsigned(f"v{i}", 32), i + 32) for i in range(32)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return votes.select(key, F.when(F.col("n") > 0, fp).alias("fp"), *carried)


def _bit(votes: Column, i: int) -> Column:
    return F.when(votes * 2 > F.col("n"), F.lit((1 << i) - (1 << 64) * (i == 63))).otherwise(F.lit(0).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def tables(fps: DataFrame, fp: str, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fps once per table, with its key there."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    return fps.select("*", F.explode(keys).alias("_k")).select("*", "_k.table", "_k.key").drop("_k")


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q, fp, distance): for each different fingerprint of queries(fp), those of fps(fp) within the radius."""
    q = tables(queries.select(F.col("fp").alias("q")).distinct(), "q", radius, blocks)
    f = tables(fps.select("fp").distinct(), "fp", radius, blocks)
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    return q.join(f, ["table", "key"]).where(distance <= radius).select("q", "fp", distance.alias("distance")).distinct()


def probes(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(table, mask of its block, bits to flip): what a query asks for, so that no fingerprint within the radius is missed.

    The flips allowed in each block, and one more for each, add up to radius + 1.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for t in range(blocks):
        bits = range(edges[t], edges[t + 1])
        most = (radius + 1 + blocks - 1 - t) // blocks - 1
        out += [(t, _signed(sum(1 << b for b in bits)), _signed(sum(1 << b for b in flip))) for k in range(most + 1) for flip in combinations(bits, k)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_wide(queries: DataFrame, fps: DataFrame, radius: int = NEAR_RADIUS, blocks: int = NEAR_BLOCKS) -> DataFrame:
    """What within() returns, by tables of single blocks and flipped queries, for a radius of many bits."""
    asked = probes(radius, blocks)
    masks = sorted({(t, m) for t, m, _ in asked})
    literal = lambda x: "(-9223372036854775807L - 1)" if x == -(1 << 63) else f"{x}L"
    flips = F.expr("array(" + ",".join(f"named_struct('table', {t}, 'mask', {literal(m)}, 'flip', {literal(x)})" for t, m, x in asked) + ")")
    q = queries.select(F.col("fp").alias("q")).distinct().select("q", F.explode(flips).alias("_k"))
    q = q.select("q", "_k.table", F.col("q").bitwiseXOR(F.col("_k.flip")).bitwiseAND(F.col("_k.mask")).alias("key"))
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in masks])
    f = fps.select("fp").distinct().select("fp", F.explode(keys).alias("_k")).select("fp", "_k.table", "_k.key")
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    # The probes grow out of few queries, whose size Spark would take for theirs and broadcast them.
    return q.hint("merge").join(f, ["table", "key"]).where(distance <= radius).select("q", "fp", distance.alias("distance")).distinct()


def hexed(c: Column | str) -> Column:
    """64 bits as 16 digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text of the next row in ascending doc_id, row and next_row naming them.

    Cut points that are ids of the table deal the rows into ranges; a range also gets the first row of the one after
    it, and the last range that of the first. So no task holds more than a range, and the texts move once.
    """
    known = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    count = min(MOST_RANGES, max(1, -(-known.n // RANGE_ROWS)))
    cuts: list[int] = []
    if count > 1 and known.ids:
        at = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(count)], 50 * count)).first()[0]
        cuts = sorted(set(at))[0 if known.ids < known.n else 1 :]
    first = docs.agg(F.min("doc_id")).first()[0] if known.ids == known.n else None
    home = F.lit(0)
    if cuts:
        coarse = F.array(*[F.lit(c) for c in cuts[::_STRIDE]])
        fine = F.array(*[F.lit(c) for c in cuts])
        block = F.greatest(F.size(F.filter(coarse, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))
        inside = F.size(F.filter(F.slice(fine, block * _STRIDE + 1, F.lit(_STRIDE)), lambda c: c <= F.col("doc_id")))
        home = F.when(F.col("doc_id").isNull(), 0).otherwise(block * _STRIDE + inside)
    rows = docs.select("doc_id", "text", home.cast("long").alias("home"))
    is_cut = F.array_contains(F.array(*[F.lit(c) for c in cuts]), F.col("doc_id")) if cuts else F.lit(False)
    places = [F.struct(F.col("home").alias("range"), F.lit(False).alias("guard")), F.when(is_cut, F.struct((F.col("home") - 1).alias("range"), F.lit(True).alias("guard")))]
    places.append(F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("long")), F.struct(F.lit(len(cuts)).cast("long").alias("range"), F.lit(True).alias("guard"))))
    rows = rows.select("doc_id", "text", "home", F.explode(F.array_compact(F.array(*places))).alias("p")).select("doc_id", "text", "home", "p.range", "p.guard")
    order = Window.partitionBy("range").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("row", (F.col("home") * F.lit(1 << 32) + F.row_number().over(order)).cast("long"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_guard", F.lead("guard").over(order)).withColumn("next_home", F.lead("home").over(order))
    next_row = F.when(F.col("next_guard"), F.col("next_home") * F.lit(1 << 32) + 1).otherwise(F.col("row") + 1)
    return rows.where(~F.col("guard")).select("doc_id", "text", "next_text", "row", next_row.alias("next_row"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, neighbours: bool = False) -> DataFrame:
    """The contract's row for every document, and n_near for each hundredth id.

    n_near: how many other documents lie within the radius of it, from the block tables.
    neighbours: also `near`, the fingerprints within the radius, its own among them, by distance: each with its
    distance, the number of its documents and the least doc_id of them. The result's rows with that fingerprint are
    all the documents, so copies are not listed once a pair.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text")))
    # What else a text gives goes along with its votes, as longs, so that texts move once.
    sha = [f"sha{i}" for i in range(4)]
    rows = rows.select("row", "next_row", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    parts = [F.conv(F.substring(F.sha2("edited", 256), 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    none = [F.lit(None).cast("long").alias(c) for c in sha]
    two = F.array(F.struct((F.col("row") * 2).alias("key"), F.col("text").alias("text"), *none), F.struct((F.col("row") * 2 + 1).alias("key"), F.col("edited").alias("text"), *parts))
    both = rows.select("next_row", "doc_id", "n_chars", F.explode(two).alias("s")).select("next_row", "doc_id", "n_chars", "s.*")
    prints = simhash(both, "key", "text", "next_row", "doc_id", "n_chars", *sha)
    is_base = F.col("key") % 2 == 0
    row = F.shiftright(F.col("key"), 1).alias("row")
    paired = prints.groupBy(row).agg(
        *[F.max(c).alias(c) for c in ("next_row", "doc_id", "n_chars", *sha)], F.max(F.when(is_base, F.col("fp"))).alias("fp"), F.max(F.when(~is_base, F.col("fp"))).alias("edited_fp")
    )
    paired = shared.written(paired, "fingerprints")
    base = paired.select("row", "doc_id", "fp").where("fp is not null")
    edited_sha256 = F.concat(*[hexed(c) for c in sha]).alias("edited_sha256")
    following = paired.select(F.col("row").alias("next_row"), F.col("fp").alias("next_fp"))
    out = paired.select("doc_id", "n_chars", edited_sha256, "fp", "edited_fp", "next_row").join(following.hint("merge"), "next_row")
    fps = base.groupBy("fp").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"))
    asked = base.where(F.pmod("doc_id", F.lit(100)) == 0)
    pairs = (within if radius <= RADIUS else within_wide)(asked, fps, radius).join(fps, "fp")
    one = F.struct("distance", hexed("fp").alias("fingerprint"), "docs", "first_id")
    # Written, so that it joins by a plain exchange, of which Spark splits the part of a fingerprint that very many texts have.
    near = pairs.groupBy(F.col("q").alias("fp")).agg((F.sum("docs") - 1).alias("near"), *([F.array_sort(F.collect_list(one)).alias("pairs")] if neighbours else []))
    near = shared.written(near, "neighbours")
    out = out.join(near.hint("merge"), "fp", "left").na.fill(0, ["fp", "edited_fp", "next_fp"])
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.pmod("doc_id", F.lit(100)) == 0, F.coalesce("near", F.lit(0))).cast("long").alias("n_near"),
        *([F.when(F.pmod("doc_id", F.lit(100)) == 0, F.col("pairs")).alias("near")] if neighbours else []),
    )
