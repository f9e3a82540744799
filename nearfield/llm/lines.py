"""Fuzzy line dedup with DataFrame and SQL functions only.

A line is normalised to its lower-case words of letters and digits. Its SimHash has ``BLOCKS`` blocks of bits. The features
are its runs of three words; each belongs to one block and votes there, bit by bit, with the signs of its hash and with a weight
that falls by more than half from one feature to the next in a fixed order of all features. With such weights the heaviest
feature outvotes the rest together, so a block's bits are simply that feature's. Blocks are joined on as pigeonholes: lines whose SimHashes differ in fewer than all blocks meet in a bucket, and are linked if the edit similarity
of their word sequences reaches the threshold. Of each connected group the occurrence with the least (doc_id, line number) stays.

Equal weights don't do: one edited word in twenty then flips six of 64 bits, and no radius that can be joined on gets there.
With these, a block stays whole as long as its heaviest feature does. The order puts common features last, as
counted in all rows, so that few lines meet by chance.

In a bucket of few lines all are compared. In a larger one, lines are compared with one pivot first, the same in all buckets of
a group of variants, and only what is not connected by then is compared with each other; so a line with thousands of variants
costs what it has rows, not pairs. Before words are fetched, pairs whose maps of words differ in more bits than the allowed
edits can change are dropped; no similar pair is.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.components import components
from nearfield.storage import materialise

#: Only lines without a word are never removed.
MIN_WORDS = 1
THRESHOLD = 0.8
#: Blocks of the SimHash; if two lines' features agree in a share of j, they share one with a chance of about 1 - (1 - j) ** BLOCKS.
BLOCKS = 4
_BLOCK_BITS = 2
#: Lines of fewer words have blocks of pairs of words, too.
SHORT = 12
#: Common features are counted in every row (one row in one), by this many low bits of their hash.
SAMPLE = 1
LEVELS = 1 << 17
#: Lines in a bucket up to which all are compared at once.
FEW = 32
#: Rows of at most 50 bytes up to which a side is sent to all executors; a larger one is shuffled.
SENT_ROWS = 100_000
#: Words of 64 bits, at most, of a map of wanted keys that is sent to all executors.
MAP_WORDS = 1 << 18
#: Signs other than letters and digits, and blanks after them. The first ranges only spare most characters the slower tests.
_SIGNS = r"[^a-z \n0-9\p{L}\p{N}]+ *"


def _once(e: F.Column) -> F.Column:
    """e as the output of a generator, so that what reads it several times doesn't compute it again."""
    return F.explode(F.array(e))


def _row_key(text: str) -> F.Column:
    """Names a row; rows that are equal in doc_id and text are one."""
    return F.xxhash64(F.col("doc_id"), F.col(text))


def words_of(line: F.Column) -> F.Column:
    """Words of a folded line."""
    line = F.trim(line)
    return F.when((line == "") | line.contains("  "), F.array_remove(F.split(line, " "), "")).otherwise(F.split(line, " "))


def folded(text: F.Column) -> F.Column:
    """A text, or a line, in lower case, each run of signs other than letters and digits a blank."""
    return F.regexp_replace(F.lower(text), _SIGNS, " ")


def folded_texts(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, row, folded) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(text).alias("row"), folded(F.col(text)).alias("folded"))


def _plain(line: F.Column) -> F.Column:
    """A folded line with one blank between words and none around them."""
    line = F.trim(line)
    return F.when(line.contains("  "), F.array_join(words_of(line), " ")).otherwise(line)


def _lines_of(texts: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row, pos, line, n) of every line with at least ``min_words`` words; n, their number."""
    lines = texts.select("doc_id", "row", F.posexplode(F.split("folded", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", _once(_plain(F.col("line"))).alias("line"))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return lines.withColumn("n", F.when(F.col("line") == "", 0).otherwise(blanks + 1)).where(F.col("n") >= min_words)


def _allowed(n: F.Column, threshold: float) -> F.Column:
    """Edits allowed if the longer line has n words."""
    return F.floor(n * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")


_BLOCK_SHIFT = 64 - _BLOCK_BITS
#: Bits of a feature below its block's number and its level.
_LOW = _BLOCK_SHIFT - 7


_LOW_BITS = (1 << _LOW) - 1
#: Bits of a run of three words: a block's number in the highest bits, and a hash in the lowest.
_FEATURE_BITS = -(1 << _BLOCK_SHIFT) | _LOW_BITS


def _run(i: F.Column, n: int) -> F.Column:
    """Hash of the run of n words of w from i on."""
    return F.xxhash64(*[F.xxhash64(F.get("w", i + k)) for k in range(n)])


def _runs(n: int, kept: int) -> F.Column:
    """Hashes of the runs of n words by their hashes h, of which only the bits ``kept`` are left."""
    rest = lambda i: [F.get("h", i + k) for k in range(1, n)]
    return F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *rest(i)).bitwiseAND(F.lit(kept)))


def _common(docs: DataFrame, text: str) -> list[int]:
    """By the low bits of a feature, 0, or a level that grows with the occurrences of the features that have them, in all rows.

    What rare features add up to in most slots is taken off; what stands out of it by less than four deviations is none, nor is
    a count of up to FEW, as buckets of so few lines are compared in full.
    """
    return _levels(folded_texts(docs, text))


def _levels(texts: DataFrame) -> list[int]:
    """``_common`` of folded texts."""
    n, i = F.col("n"), F.col("i")
    runs = F.greatest(n - 2, F.lit(0))
    several = runs + F.when(n < SHORT, n - 1).otherwise(0)  # a short line's pairs come after its runs
    lines = _lines_of(texts, 2).select(runs.alias("runs"), several.alias("several"), _once(F.split("line", " ")).alias("w"))
    each = lines.select("w", "runs", F.explode(F.sequence(F.lit(0), F.col("several") - 1)).alias("i"))
    feature = F.when(i < F.col("runs"), _run(i, 3)).otherwise(_run(i - F.col("runs"), 2))
    got = each.select(feature.bitwiseAND(F.lit(LEVELS - 1)).alias("slot")).groupBy("slot").count().toArrow()
    counts = np.zeros(LEVELS)
    counts[got["slot"].to_numpy()] = got["count"].to_numpy()
    usual = np.median(counts)
    excess = counts - usual
    levels = np.where(excess > max(FEW, 4 * usual**0.5), np.minimum(127, 6 * np.log2(np.maximum(excess, 0) + 1)), 0)
    return levels.astype(np.int64).tolist()


def _placed(common: list[int]):
    """A function that gives a feature its level, in the bits above its hash."""
    # small numbers: the driver keeps the text of every plan
    levels = F.from_json(F.lit(json.dumps(common, separators=(",", ":"))), "array<bigint>")
    return lambda x: x.bitwiseOR(F.shiftleft(F.get(levels, x.bitwiseAND(F.lit(LEVELS - 1)).cast("int")), _LOW))


def _bit(h: F.Column, half: int) -> F.Column:
    """The bit of a word's hash in that half of the map of a line's words, or 0."""
    own = h.bitwiseAND(F.lit(64)) == F.lit(64 * half)
    return F.when(own, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))


def line_places(texts: DataFrame, common: list[int], threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, pos, k, n, blocks, s, t) of every line; k, a hash of all words; the rest is as in ``blocks_of_long``, and null for long lines.

    A short line has further blocks, of one pair of neighbouring words each: its heaviest pairs, two for each edit allowed and
    two more, so that similar short lines always share one.
    """
    where = ["doc_id", "row", "pos", "k", "n"]
    lines = _lines_of(texts, min_words).select("doc_id", "row", "pos", F.xxhash64("line").alias("k"), "n", F.when(F.col("n") < SHORT, F.col("line")).alias("line"))
    d = lines.select(*where, _once(F.transform(F.split("line", " "), lambda x: F.xxhash64(x))).alias("h"))
    edits = _allowed(F.col("n") + 1, threshold)  # of it and a line of a word more
    placed = _placed(common)
    first = F.slice(F.sort_array(F.array_distinct(F.transform(_runs(2, _LOW_BITS), placed))), F.lit(1), 2 * edits + 2)
    some = (edits > 0) & F.col("h").isNotNull()
    d = d.select(*where, "h", F.when(some, first).alias("p"), _once(F.when(some, F.sort_array(F.transform(_runs(3, _FEATURE_BITS), placed)))).alias("f"))
    # the first of each block: what stands before it, if anything, is of another
    heaviest = F.filter("f", lambda x, i: ~F.shiftright(x.bitwiseXOR(F.get("f", i - 1)), _BLOCK_SHIFT).eqNullSafe(0))
    bits = lambda half: F.when(some, F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(_bit(x, half))))
    return d.select(*where, F.concat(heaviest, "p").alias("blocks"), bits(0).alias("s"), bits(1).alias("t"))


def blocks_of_long(texts: DataFrame, common: list[int], threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, n, b0, .., s, t) of the distinct lines of SHORT words or more: the SimHash, and a map of the line's words.

    In a block the features come by level, rare ones first, and then by hash; the first is the heaviest. The block's number is
    part of its value. A block without a feature is null. A word sets one of the 128 bits of s and t.
    """
    long = _lines_of(texts, max(min_words, SHORT)).where(_allowed(F.col("n") + 1, threshold) > 0)
    long = long.select(F.xxhash64("line").alias("k"), "n", _once(F.split("line", " ")).alias("w"))
    i = F.col("i")
    each = long.select("k", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    each = each.select("k", "n", F.xxhash64(F.get("w", i)).alias("x"), F.when(i < F.col("n") - 2, _run(i, 3).bitwiseAND(F.lit(_FEATURE_BITS))).alias("f"))
    each = each.select("k", "n", "x", _placed(common)(F.col("f")).alias("f"))
    block = F.shiftrightunsigned("f", _BLOCK_SHIFT)
    least = [F.min(F.when(block == b, F.col("f"))).alias(f"b{b}") for b in range(BLOCKS)]
    return each.groupBy("k", "n").agg(*least, *[F.bit_or(_bit(F.col("x"), half)).alias(c) for half, c in enumerate("st")])


def _blocks() -> F.Column:
    """The blocks of a long line that have a feature."""
    return F.array_compact(F.array(*[f"b{b}" for b in range(BLOCKS)]))


def line_table(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, pos, k, n, blocks, s, t) of every line with at least ``min_words`` words; no blocks where no edit is allowed."""
    texts = folded_texts(docs, text)
    common = _levels(texts)
    places = line_places(texts, common, threshold, min_words)
    long = blocks_of_long(texts, common, threshold, min_words).select("k", _blocks().alias("long"), F.col("s").alias("ls"), F.col("t").alias("lt"))
    none = F.array().cast("array<bigint>")
    both = places.join(long, "k", "left")
    return both.select("doc_id", "row", "pos", "k", "n", F.coalesce("blocks", "long", none).alias("blocks"), F.coalesce("s", "ls").alias("s"), F.coalesce("t", "lt").alias("t"))


def _small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df, of rows of fixed width, to be broadcast if it has few."""
    return F.broadcast(df) if df.count() <= rows else df


def _pruned(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """df without most of the rows whose key is not in ``wanted``: a map of bits, of bounded size, is sent to all executors.

    Wanted rows are never lost. With more keys than the map has room for, more others pass.
    """
    words = 1 << min(MAP_WORDS.bit_length() - 1, max(0, math.ceil(math.log2((8 * wanted.count() + 1) / 64))))
    slot = F.xxhash64(F.lit(5), key).bitwiseAND(F.lit(64 * words - 1))
    at = lambda e: F.shiftright(e, 6)
    mark = wanted.select(slot.alias("slot")).select(at(F.col("slot")).alias("word_"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
    marks = materialise(mark.groupBy("word_").agg(F.bit_or("bit").alias("bits_")), "line-marks")
    held = df.withColumn("slot_", slot).withColumn("word_", at(F.col("slot_"))).join(F.broadcast(marks), "word_")
    return held.where("(shiftrightunsigned(bits_, CAST(slot_ & 63 AS INT)) & 1L) = 1L").select(*df.columns)


def _codes(texts: DataFrame, table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, codes) of the wanted distinct lines: one character for each word, from one occurrence of the line."""
    wanted = materialise(wanted, "line-wanted")
    # no semi-join: the optimizer would put it below the pruning
    at = _pruned(table.select("k", "row", "pos"), "k", wanted).join(_small(wanted), "k").dropDuplicates(["k"])
    at = materialise(at.select("k", "row", "pos"), "line-places")
    rows = _pruned(texts.select("row", "folded"), "row", at.select("row").distinct())
    each = rows.select("row", F.posexplode(F.split("folded", "\n", -1)).alias("pos", "line"))
    place = F.xxhash64("row", "pos").alias("place")
    held = _pruned(each.select(place, "line"), "place", at.select(place)).join(_small(at.select(place, "k")), "place")
    words = held.select("k", _once(words_of(F.col("line"))).alias("w"))
    char = F.transform("w", lambda x: F.hex(F.pmod(F.xxhash64(x), F.lit(40000)) + 0x3400))
    return words.select("k", F.decode(F.unhex(F.array_join(char, "")), "UTF-16BE").alias("codes")).dropDuplicates(["k"])  # rows may repeat


def _edges(codes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs of distinct lines whose word sequences are similar: 1 - edits / words of the longer one."""
    codes = materialise(codes, "line-codes")
    both = pairs.join(codes.select(F.col("k").alias("a"), F.col("codes").alias("ca")), "a").join(codes.select(F.col("k").alias("b"), F.col("codes").alias("cb")), "b")
    most = _allowed(F.greatest(F.char_length("ca"), F.char_length("cb")), threshold)
    near = both.withColumn("most", most).where(F.abs(F.char_length("ca") - F.char_length("cb")) <= F.col("most")).where("levenshtein(ca, cb, most) >= 0")
    return materialise(near.select("a", "b"), "line-edges")


_LINE = ("k", "n", "s", "t")


def _members(entries: DataFrame) -> DataFrame:
    """(bucket, k, n, s, t, c): lines of buckets with two distinct lines at least; c, the bucket's lines.

    A bucket's hot value meets only in partial counts, and in a join that Spark can split.
    """
    shared = materialise(entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "line-shared")
    return materialise(_pruned(entries, "bucket", shared.select("bucket")).join(_small(shared), "bucket").select("bucket", *_LINE, "c"), "line-members")


def _candidates(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the distinct pairs of (ka, na, sa, ta, kb, nb, sb, tb) that their lengths and words allow to be similar.

    An edit takes one word away, adds one, or does both, so it changes two bits of the map of words at most: no similar pair is lost.
    """
    most = _allowed(F.greatest("na", "nb"), threshold)
    differing = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("ta").bitwiseXOR(F.col("tb")))
    fine = pairs.where(F.col("ka") != F.col("kb")).where(F.abs(F.col("na") - F.col("nb")) <= most).where(differing <= 2 * most)
    return fine.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def _side(of: str, end: str) -> list[F.Column]:
    """The columns of a line, named for one end of a pair."""
    return [F.col(f"{of}{c}").alias(c + end) for c in _LINE]


def _pairs_of_few(members: DataFrame) -> DataFrame:
    """All pairs of lines in each bucket of at most FEW."""
    lists = members.where(F.col("c") <= FEW).groupBy("bucket").agg(F.collect_list(F.struct(*_LINE)).alias("l"))
    left = lists.select("l", F.posexplode("l").alias("i", "p")).select("p", F.explode(F.slice("l", F.col("i") + 2, F.lit(FEW))).alias("q"))
    return left.select(*_side("p.", "a"), *_side("q.", "b"))


def _pairs_with_pivot(live: DataFrame) -> DataFrame:
    """Each line of a bucket with the one whose hash is least."""
    pivot = live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("k").alias("o"), *_LINE)).alias("p"))
    pivot = materialise(pivot.select("bucket", *_side("p.", "b")), "line-pivots")
    return live.join(_small(pivot), "bucket").select(*_side("", "a"), *[c + "b" for c in _LINE])


def linked(texts: DataFrame, places: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the distinct lines that are linked to another; a group's lines have one root.

    places: (k, row, pos) of all occurrences; entries: (bucket, k, n, s, t) of the distinct lines, each once a bucket.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "line-pairs")
        ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
        return _edges(_codes(texts, places, ends), pairs, threshold)

    members = _members(entries)
    live = members.where(F.col("c") > FEW).select("bucket", *_LINE)
    pairs = _pairs_of_few(members)
    if live.isEmpty():
        return components(verified(_candidates(pairs, threshold)), least=False)
    edges = verified(_candidates(pairs.union(_pairs_with_pivot(live)), threshold))
    roots = components(edges, least=False)
    named = live.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("bucket", *_LINE, F.coalesce("root", "k").alias("g"))
    named = materialise(named, "line-named")
    open_ = materialise(named.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("bucket"), "line-open")
    left, right = (named.join(_small(open_), "bucket").select("bucket", *_side("", x), F.col("g").alias("g" + x)) for x in "ab")
    rest = left.join(right, "bucket").where("ka < kb AND ga <> gb")
    return components(edges.union(verified(_candidates(rest, threshold))), least=False)


def linked_lines(docs: DataFrame, table: DataFrame, distinct: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) as ``linked`` gives them, of a ``line_table``; copies of a line count once, whatever ``distinct`` says of them."""
    return linked(folded_texts(docs, text), table, table.select(F.explode("blocks").alias("bucket"), *_LINE).distinct(), threshold)


def removed_lines(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, removed): for rows that lose lines, their numbers from 0, in order."""
    texts = materialise(folded_texts(docs, text), "line-texts")  # three passes and the codes read them
    common = _levels(texts)
    table = materialise(line_places(texts, common, threshold, min_words), "lines")
    long = materialise(blocks_of_long(texts, common, threshold, min_words), "line-long")
    short = materialise(table.select(F.explode("blocks").alias("bucket"), *_LINE).distinct(), "line-short")
    roots = linked(texts, table, long.select(F.explode(_blocks()).alias("bucket"), *_LINE).union(short), threshold)
    distinct = materialise(table.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "line-repeated")
    linked_ = roots.select(F.col("node").alias("k"), "root")
    again = materialise(linked_.union(distinct.select("k", F.col("k").alias("root")).join(linked_.select("k"), "k", "left_anti")), "line-again")
    held = _pruned(table.select("doc_id", "row", "pos", "k"), "k", again.select("k")).join(_small(again), "k")
    held = materialise(held.select("doc_id", "row", "pos", "root").distinct(), "line-held")
    place = F.struct("doc_id", "row", "pos")
    first = materialise(held.groupBy("root").agg(F.min(place).alias("first")), "line-first")
    gone = held.join(_small(first), "root").where(~place.eqNullSafe(F.col("first"))).select("row", "pos")
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def report(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (numbers from 0) of every row.

    Lines end at \\n. A null text has no lines, an empty one a single line. Lines of fewer than ``min_words`` words stay. A
    null doc_id comes before every other in the order of occurrences. Rows equal in doc_id and text are one and get equal
    results. Other columns are ignored. An empty table gives no rows. Lines that differ but hash alike in 64 bits would be
    taken for equal: a chance of 1e-7 among a million distinct lines. Similar lines that share no block aren't compared: see
    README for the measured recall.
    """
    gone = removed_lines(docs, text, threshold, min_words)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(text).alias("row"), F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return every.join(gone, "row", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed_lines"))


def dedup(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the repeated lines; a row that lost lines and has no word left goes. n_chars, if there, follows the text."""
    gone = removed_lines(docs, text, threshold, min_words).select(F.col("row").alias("row_"), F.col("removed").alias("removed_"))
    both = docs.withColumn("row_", _row_key(text)).join(gone, "row_", "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col("removed_"), i)), "\n")
    both = both.withColumn(text, F.when(F.col("removed_").isNull(), F.col(text)).otherwise(kept))
    both = both.where(F.col("removed_").isNull() | F.col(text).rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("removed_").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType)))
    return both.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6_line_dedup over all documents."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
