"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its tokens (runs without space, tab or carriage return). Two lines match if the Jaccard similarity of their sets is
at least NUM / DEN. Every line that matches an earlier one (by doc_id, then line number) is removed, equal lines of course
among them, however short a line is. Lines without a token (blank lines) stay.

1. Equal lines become one row, the first occurrence, in a partial aggregate, however many copies there are.
2. Tokens are ordered by rarity. Long tokens are the rare ones, so their length in bytes stands for it. The last tokens of all
   prefixes are counted: if a line shares its own with more than ``CROWD`` others on average, all tokens are counted, hashed
   into ``BUCKETS`` levels of one byte, and the prefixes are taken by these counts. Any order gives the same matches.
3. A line needs one earlier match, not all of them. So it first meets the earliest line that shares two neighbouring tokens
   of that order, at one of three places: three comparisons for each line, so large groups of near copies are settled without
   pairing their members. This only saves work; it decides nothing on its own.
4. All other pairs: the prefixes of the lines (the tokens of which a match must share one) are shuffled once by token and
   power of two of the size, and joined with themselves (a shorter line also enters the next power if a match may lie there);
   length, position and a 128-bit parity bitmap of the set rule out pairs inside the join
   (a token in one of two sets only changes one bit, so the sets differ in at least as many tokens as bits).
   Pairs of which both lines are settled are left out.
5. What is left is verified on the texts. If there are at most ``FEW`` pairs, their ids are broadcast to fetch the
   texts; beyond, all lines are shuffled for it.

Between the steps tables are written to the shared folder and the shuffle files of the step before are let go.

Null texts have no lines; an empty table gives an empty result. Ids are numbers or texts; null ids sort first. Lines of equal
place (equal id, line number and text) are one line. Rows of equal doc_id and text share one result and each get their row.
Long lines and texts are taken whole. Extra columns are carried along as fields of ``_doc``.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import packed, shared_folder

NUM, DEN, BUCKETS, FEW, CROWD = 4, 5, 1 << 17, 1_000_000, 500
LONGEST, HASH = 63, 57  # a key holds LONGEST less the length, then so many bits of the hash
#: Keys in the middle of the tokens of 6, 4 and 3 bytes: from there on the tokens are taken that lead to a line's hubs.
PLACES = [(2 * (LONGEST - n) + 1) << (HASH - 1) for n in (6, 4, 3)]


def tokens_of(line: Column) -> Column:
    """Different tokens of a line."""
    return F.array_distinct(_words(line))


def _words(text: Column) -> Column:
    return F.array_remove(_pieces(text), "")


def _pieces(text: Column) -> Column:
    """Tokens, and an empty text for each further space in a row."""
    return F.split(F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")), " ")


def _blank(line: Column) -> Column:
    """Whether a line has no token; looks no further than its first one."""
    return F.ltrim(line, F.lit(" \t\r")) == ""


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so once their tables are garbage.

    Twice, with a pause: Python gives up its handles on the driver's objects in the background.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # Hashes and different lines hardly repeat.
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def token_levels(docs: DataFrame) -> bytes:
    """One byte per bucket: how often its tokens occur in all texts, on a logarithmic scale of 0 to 126.

    Counting is a partial aggregate over all texts; BUCKETS bytes reach the driver, whatever the input.
    """
    words = docs.select(F.explode(_pieces(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("t")).where("t <> ''")
    found = words.groupBy(F.xxhash64("t").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.floor(2.5 * F.log2(F.col("n") + 1)), F.lit(126)).cast("int")
    every = docs.sparkSession.range(BUCKETS).join(found, F.col("id") == F.col("b"), "left")
    row = F.struct("id", F.lpad(F.hex(F.coalesce(level, F.lit(0))), 2, "0").alias("level"))
    levels = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.level), "").alias("hex"))
    return bytes.fromhex(levels.first().hex)


def first_lines(docs: DataFrame) -> DataFrame:
    """Different lines of at least one token, each with the place of its first occurrence."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_text"), lines_of(F.col("text")).alias("_lines"))
    lines = rows.select("doc_id", "_text", F.posexplode("_lines").alias("line_no", "line"))
    lines = lines.where(~_blank(F.col("line")))
    place = F.struct("doc_id", "line_no", "_text", "line")
    first = lines.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.min(place).alias("f"))
    return first.select("f.*")


def _token_key(token: Column) -> Column:
    """Orders tokens by length, longest first, then by hash; an empty text comes last."""
    short = F.greatest(F.lit(LONGEST) - F.octet_length(token), F.lit(0)).cast("bigint")
    return F.shiftleft(short, HASH).bitwiseOR(F.xxhash64(token).bitwiseAND((1 << HASH) - 1))


def _prefix(keys: Column, size: Column) -> Column:
    return F.slice(keys, F.lit(1), size - _ceil(size * NUM, DEN) + 1)


def with_prefixes(lines: DataFrame, levels: bytes | None = None) -> DataFrame:
    """Add lid, size, prefix (rarest tokens first), bitmap and the hashes of neighbouring tokens to the different lines.

    Without ``levels`` the longest tokens count as the rarest.
    """
    keys = F.array_distinct(F.transform(_pieces(F.col("line")), _token_key))
    rows = lines.withColumn("_k", F.sort_array(F.array_remove(keys, _token_key(F.lit("")))))
    # How many keys are below each place, told without a step per token outside compiled code.
    places = [F.lit(p).cast("bigint") for p in PLACES]
    rows = rows.withColumn("_s", F.sort_array(F.concat("_k", F.array(*places))))
    rows = rows.withColumns({f"_n{i}": (F.array_position("_s", p) - (i + 1)).cast("int") for i, p in enumerate(places)})
    size = F.size("_k")
    halves = F.slice("_k", F.lit(1), F.col("_n0")), F.slice("_k", F.col("_n0") + 1, size)
    return rows.select(
        F.monotonically_increasing_id().alias("lid"), "doc_id", "line_no", "_text", "line", size.alias("size"),
        *[_parity(half).alias(f"p{i}") for i, half in enumerate(halves)],
        (_prefix(F.col("_k"), size) if levels is None else counted_prefix(F.col("line"), levels)).alias("prefix"),
        F.array(*[F.xxhash64(F.lit(i), *[F.get("_k", F.pmod(F.col(f"_n{i}") + j, size)) for j in (0, 1)]) for i in range(len(PLACES))]).alias("ends"),
    )


def counted_prefix(line: Column, levels: bytes) -> Column:
    """Prefix of a line by counts of tokens."""
    # One literal, folded before the tasks start. Coalesced, as longs that are never null are sorted much faster.
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")

    def key(h: Column) -> Column:
        """Orders by rarity, then by 56 bits of the hash; tokens that share a key only cost a comparison."""
        level = F.coalesce(table[h.bitwiseAND(BUCKETS - 1)], F.lit(0).cast("bigint"))
        return F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1))

    hashes = F.array_distinct(F.transform(_pieces(line), lambda t: F.xxhash64(t)))
    keys = F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), key))
    return _prefix(keys, F.size(keys))


def _power(size: Column) -> Column:
    return F.floor(F.log2(size))


def crowded(lines: DataFrame) -> bool:
    """Whether the last token of a prefix, the least rare, is that of more than ``CROWD`` others on average; told by counts in buckets."""
    token = F.xxhash64(F.element_at("prefix", -1), _power(F.col("size")))
    groups = lines.groupBy(token.bitwiseAND((1 << 16) - 1).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, squares = groups.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()
    return squares - n * n / (1 << 16) > CROWD * n  # less what falls into a bucket by chance


def _parity(half: Column) -> Column:
    """64 of 128 parities of the set: each token flips the one bit that its key's half and last six bits name."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return F.aggregate(half, none, lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))))


def _apart(a: str, b: str) -> Column:
    """At least so many tokens are in one of two sets only."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in (0, 1)), F.lit(0))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Line ids (x) that match an earlier line among the pairs (a, b)."""
    few = pairs.count() <= FEW
    # The same ids for both sides: the texts are read and shuffled once.
    ids = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()

    def side(p: str) -> DataFrame:
        wanted = lines.join(F.broadcast(ids) if few else ids, "lid", "left_semi")
        place = F.struct("doc_id", "line_no", "_text")
        return wanted.select(F.col("lid").alias(p), place.alias(f"at_{p}"), tokens_of(F.col("line")).alias(f"of_{p}"), F.col("size").alias(f"size_{p}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    match = both.where(shared * (NUM + DEN) >= (F.col("size_a") + F.col("size_b")) * NUM)
    return match.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("x")).distinct()


def _hub_pairs(lines: DataFrame) -> DataFrame:
    """Each line with the earliest holders of its three pairs of hashes: at most three pairs for each line."""
    keyed = lines.select("lid", "size", "p0", "p1", "doc_id", "line_no", F.explode("ends").alias("key"))
    hub = F.min(F.struct(
        "doc_id", "line_no", F.col("lid").alias("b"), F.col("size").alias("b_size"), F.col("p0").alias("q0"), F.col("p1").alias("q1")))
    hubs = keyed.groupBy("key").agg(hub.alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = hubs.select("key", "hub.b", "hub.b_size", "hub.q0", "hub.q1")
    met = keyed.drop("doc_id", "line_no").join(hubs, "key")
    small, large = F.least("size", "b_size"), F.greatest("size", "b_size")
    both = F.col("size") + F.col("b_size")
    like = (large * NUM <= small * DEN) & (_apart("p", "q") <= both - 2 * _ceil(both * NUM, NUM + DEN))
    return met.where((F.col("lid") != F.col("b")) & like).select(F.col("lid").alias("a"), "b").distinct()


def _prefix_pairs(lines: DataFrame) -> DataFrame:
    """Pairs by prefix, length, position and bitmap; ``lines`` have a flag ``settled``."""
    size, whole = F.col("size").cast("bigint"), (1 << 30) - 1
    last = size - _ceil(size * (2 * NUM), NUM + DEN)  # of the tokens that the shorter line of a match needs
    power = _power(size)
    again = _power(F.floor(size * DEN / NUM)) > power  # a longer match may have the next power

    def entries(p: str) -> DataFrame:
        twice = F.when(again, F.concat("prefix", F.slice("prefix", F.lit(1), (last + 1).cast("int")))).otherwise(F.col("prefix"))
        rows = lines.select(
            F.posexplode(twice).alias("j", "token"), F.size("prefix").alias("whole"), F.col("lid").alias(p),
            F.col("p0").alias(f"{p}0"), F.col("p1").alias(f"{p}1"), "size", "settled", power.alias("power"), last.alias("last"),
        )
        more = F.col("j") >= F.col("whole")
        i = F.col("j") - F.when(more, F.col("whole")).otherwise(0)
        # From the highest bit: whether it is a later token than the shorter line of a match needs, size, settled, next power, position.
        high = size.bitwiseOR(F.when(i <= F.col("last"), 0).otherwise(1 << 30).cast("bigint"))
        low = i.cast("bigint").bitwiseOR((F.when(F.col("settled"), 1 << 31).otherwise(0) + F.when(more, 1 << 30).otherwise(0)).cast("bigint"))
        token = F.xxhash64("token", F.col("power") + more.cast("int"))
        return rows.select(token.alias("token"), p, f"{p}0", f"{p}1", F.shiftleft(high, 32).bitwiseOR(low).alias(f"{p}_info"))

    # Both sides are the same table, so Spark shuffles it once; a later token is longer than any line as ``bsize``.
    x, y = entries("a"), entries("b")
    asize, bsize = F.shiftright("a_info", 32).bitwiseAND(whole), F.shiftright("b_info", 32)
    ai, bi = (F.col(c).bitwiseAND((1 << 30) - 1) for c in ("a_info", "b_info"))
    # Not both are settled, and a is in its own power: one test of both sides, so that Spark filters neither before the shuffle.
    free = F.col("a_info").bitwiseAND(F.col("b_info").bitwiseOR(1 << 30)).bitwiseAND(3 << 30) == 0
    once = (bsize < asize) | (bsize == asize) & (F.col("b") < F.col("a"))
    both = asize + bsize
    enough = lambda shared: shared * (NUM + DEN) >= both * NUM
    room = F.least(asize - ai, bsize - bi)  # positions count from 0: the shared token and those after it
    condition = once & (asize * NUM <= bsize * DEN) & free & enough(room) & enough(F.shiftright(both - _apart("a", "b"), 1))
    return x.join(y, (x.token == y.token) & condition).select("a", "b").distinct()


def copied_lines(docs: DataFrame) -> DataFrame:
    """Kept places per text: doc_id, _text, kept (numbers of the kept lines among those with a token)."""
    spark = docs.sparkSession
    lines = _stored(with_prefixes(first_lines(docs)), "lines")
    _release(spark)
    hubs = _stored(_hub_pairs(lines), "hubs")
    _release(spark)
    near = _stored(_verified(hubs, lines), "settled")
    _release(spark)
    flagged = lines.join(near.select(F.col("x").alias("lid"), F.lit(True).alias("s")), "lid", "left")
    prefix = counted_prefix(F.col("line"), token_levels(docs)) if crowded(lines) else F.col("prefix")
    flagged = flagged.select("lid", "size", "p0", "p1", prefix.alias("prefix"), F.col("s").isNotNull().alias("settled"))
    pairs = _stored(_prefix_pairs(flagged), "pairs")
    _release(spark)
    later = _stored(_verified(pairs, lines), "later")
    _release(spark)
    removed = near.unionByName(later).distinct()
    removed = F.broadcast(removed) if removed.count() <= FEW else removed
    kept = lines.select("lid", "doc_id", "_text", "line_no").join(removed, F.col("lid") == F.col("x"), "left_anti")
    return kept.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))


def remove_copied_lines(docs: DataFrame) -> DataFrame:
    """Documents with copied lines removed: ``_doc`` (the row), text (rewritten), n_lines, n_removed, n_left.

    ``n_left`` counts the lines with a token that stay.
    """
    found = copied_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "kept")
    text = F.col("_doc.text")
    rows = packed(docs).withColumn("_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = rows.join(found, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    # A flag for each line up to the last kept one, in one pass over the kept numbers.
    gaps = F.transform(
        F.coalesce("kept", F.array().cast("array<int>")),
        lambda k, i: F.concat(
            F.array_repeat(F.lit(False), k - F.coalesce(F.get(F.col("kept"), i - 1), F.lit(-1)) - 1), F.array(F.lit(True))
        ),
    )
    stays = F.zip_with(lines_of(text), F.flatten(gaps), lambda line, flag: F.when(F.coalesce(flag, F.lit(False)) | _blank(line), line))
    rows = rows.select("_doc", "kept", stays.alias("_stays"))
    left = F.array_compact("_stays")
    return rows.select(
        "_doc", F.when(text.isNotNull(), F.array_join(left, "\n")).alias("text"), F.size("_stays").alias("n_lines"),
        (F.size("_stays") - F.size(left)).alias("n_removed"), F.coalesce(F.size("kept"), F.lit(0)).alias("n_left"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_removed, n_left (lines with a token that stay), text."""
    rows = remove_copied_lines(docs.select("doc_id", "text"))
    return rows.select("_doc.doc_id", "n_lines", "n_removed", "n_left", "text")
