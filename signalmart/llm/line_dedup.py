"""Line dedup: an exact set-similarity join over the lines of all documents, in DataFrame operations only.

A line's tokens are its different lower-cased words.  A line is removed if an
earlier line has the same tokens (at least one), or, if it has ``min_tokens`` or more, if any earlier
such line has Jaccard similarity of at least ``threshold`` with it, whether that one is itself removed
or not.  Lines are ordered by (doc_id, text hash, place in the text).

1. Rarity: every word of the corpus is counted in one of 2**18 hash buckets, and
   the buckets' sizes are kept as 16 classes by powers of two.
   A token is its word's hash below the class of its bucket, so sorting tokens
   sorts them by rarity.  (Any total order keeps the filters exact; this one
   has a fixed size and travels as a constant.)
2. Lines with equal token sets, however short, collapse to the earliest; the others go.
3. Prefix filter: similar sets share one of their first n - ceil(t n) + 1
   tokens.  Rows (token, line) meet by token; length, positional and bitmap
   filters bound the overlap from above, as do a pair's number of shared prefix
   tokens and a quarter of its words; pairs that stay are verified on the
   whole token sets, tokenised anew from the texts.  A bit of the bitmap is the parity of its tokens, so it bounds the
   difference of two lines however many tokens they have; it has 64 bits, 128 for lines of ``WIDE`` tokens or more.
4. First each line is compared with the earliest line of each of its tokens and with the ``BEFORE`` lines
   next before it there, which is linear; only lines without a match there enter the full join, so
   large groups of near-equal lines are hardly compared pair by pair.  What was compared is not
   joined again: of a token's lines the earliest and the last ``BEFORE + 1`` are left out on the earlier side, the first
   ``BEFORE + 2`` on the later side, so a token of that many lines has no row there.  What is left
   grows with the square of a group only for lines near the threshold without a similar line among those compared.
   (A pair that is yet undecided may lack rows there for some of its shared tokens, but only such as met in the
   window; if the filters passed it there, it was verified.)  Tokens of
   the classes from ``HOT_CLASS`` are dealt over ``PARTS`` parts there (any
   other bucket has at most 1/1024 of all words); the full join is an equi-join
   that adaptive execution can split.

Tokens are 63-bit hashes of words (59 bits and a class), verified on 64 bits; two words of one pair of lines sharing a
hash is the only way in which a result could differ from one on the words.

Defined cases: null or empty texts have no lines; lines without words stay;
rows that repeat a doc_id and text are one document and get the same result;
null ids order first, each text of theirs being a document of its own, known by 89 bits of hashes
(ids below -2**62 would mix with them); line ends are ``\\n`` alone; extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.common import drop_shared, shared_table, small_side
from signalmart.llm.sharding import row_numbers

THRESHOLD = 0.8
MIN_TOKENS = 5
BUCKET_BITS = 18
HOT_CLASS = 10
PARTS = 64
OTHER_SPACE = "\t\x0b\f\r"
LINE_BITS = 36
WIDE = 24
BEFORE = 16


def _ceil_div(top: str, by: int) -> str:
    return f"(({top}) + {by - 1}) div {by}"


def spaced(text: str = "text") -> Column:
    """The lower-cased text with blanks for the other white space within lines."""
    low = F.lower(F.col(text))
    return F.when(low.rlike(f"[{OTHER_SPACE}]"), F.translate(low, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(low)


def word_hashes(line: str) -> Column:
    """The different words of a line, as 64-bit hashes."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def part_of(text: str = "text") -> Column:
    """The upper bits of a text's hash, which tell documents of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(F.col(text)), LINE_BITS + 1)


def own_id(id_col: str = "doc_id", text: str = "text") -> Column:
    """The id; in place of null a number below all ids, from another hash of the text than ``part_of``."""
    low = F.shiftrightunsigned(F.xxhash64(F.lit("null id"), F.col(text)), 2) + F.lit(-(1 << 63))
    return F.coalesce(F.col(id_col).cast("long"), low)


def rarity(docs: DataFrame) -> Column:
    """A constant array: the class of each bucket of words of ``docs``.

    Class c > 0 holds buckets with from 2**(c - 2) times the mean number of
    words.  The driver reads 16 lists of buckets, 2**18 small integers in all.
    """
    words = docs.select(F.explode(F.split(spaced(), "\n")).alias("line")).select(F.explode(F.split("line", " ")).alias("word"))
    counts = shared_table(words.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - BUCKET_BITS).cast("int").alias("bucket")).count(), "word-buckets")
    total = counts.agg(F.sum("count")).first()[0] or 1
    ratio = F.col("count") * float(1 << BUCKET_BITS) / float(total)
    classed = counts.select("bucket", F.least(F.lit(15), F.greatest(F.lit(0), F.floor(F.log2(ratio)).cast("int") + 2)).alias("class"))
    out = ["0"] * (1 << BUCKET_BITS)
    for row in classed.filter("class > 0").groupBy("class").agg(F.collect_list("bucket").alias("buckets")).collect():
        for bucket in row["buckets"]:
            out[bucket] = str(row["class"])
    drop_shared(counts)
    return F.split(F.lit(",".join(out)), ",").cast("array<bigint>")


def tokenised(lines: DataFrame, classes: Column, num: int, den: int, min_tokens: int) -> DataFrame:
    """Of rows with ``line``: number of tokens, set hash, bitmap and prefix (none where there are too few tokens).

    A prefix token is a hash of the token, odd if its class is hot; such hashes
    only bring pairs together.  There is no filter here:
    pushed down, it would tokenise every line twice.
    """

    def token(h: Column) -> Column:
        return F.shiftleft(F.get(classes, F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")), 59).bitwiseOR(F.shiftrightunsigned(h, 5))

    rows = lines.select("doc_id", "lkey", F.sort_array(F.transform(word_hashes("line"), token)).alias("keys"))
    return rows.select(
        "doc_id",
        "lkey",
        F.size("keys").alias("n"),
        F.xxhash64("keys").alias("sig"),
        # a shift takes its distance modulo 64; every token turns a bit of ``bits``, odd ones one of ``bits2`` too
        F.expr("aggregate(keys, 0L, (acc, k) -> acc ^ shiftleft(1L, hash(k)))").alias("bits"),
        F.expr(f"if(size(keys) < {WIDE}, 0L, aggregate(keys, 0L, (acc, k) -> acc ^ shiftleft(k & 1L, hash(k))))").alias("bits2"),
        F.expr(
            f"if(size(keys) < {min_tokens}, array(), transform(slice(keys, 1, cast(size(keys) - {_ceil_div(f'{num}L * size(keys)', den)} + 1 as int)),"
            f" k -> if(k >= {HOT_CLASS << 59}L, hash(k) | 1, hash(k) & -2)))"
        ).alias("prefix"),
    )


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, lkey, line): lkey orders the lines of a doc_id, by text hash and then place."""
    lines = docs.select("doc_id", part_of().alias("part"), F.posexplode(F.split(spaced(), "\n")).alias("place", "line"))
    return lines.select("doc_id", F.shiftleft("part", LINE_BITS).bitwiseOR(F.col("place").cast("long")).alias("lkey"), "line")


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and bitmap filters for rows a and b that share a token."""
    need = _ceil_div(f"{num}L * ({a}n + {b}n)", num + den)
    # odd and even tokens apart, where both lines have both
    apart = (
        f"if({a}n < {WIDE} or {b}n < {WIDE}, bit_count({a}bits ^ {b}bits),"
        f" bit_count({a}bits2 ^ {b}bits2) + bit_count({a}bits ^ {a}bits2 ^ {b}bits ^ {b}bits2))"
    )
    return F.expr(
        f"least({a}n, {b}n) * {den} >= {num} * greatest({a}n, {b}n)"
        f" and least({a}pos, {b}pos) + 1 + least({a}n - {a}pos - 1, {b}n - {b}pos - 1) >= {need}"
        f" and ({a}n + {b}n - {apart}) div 2 >= {need}"
    )


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Of pairs of line numbers (lid, p_lid), the lids whose partner is similar; the pairs' table goes."""
    ends = pairs.select("lid").union(pairs.select("p_lid")).distinct().join(firsts.select("lid", "doc_id", "lkey"), "lid")
    wanted = ends.groupBy("doc_id", F.shiftright("lkey", LINE_BITS).alias("part")).agg(F.collect_list(F.struct("lid", "lkey")).alias("ends"))
    wanted = shared_table(wanted, "wanted-lines")
    keyed = docs.select("doc_id", part_of().alias("part"), F.split(spaced(), "\n").alias("lines"))  # before the join, so that a text is split once
    lines = keyed.join(small_side(wanted, 200_000), ["doc_id", "part"]).select("lines", F.explode("ends").alias("end")).select(
        "end.lid", F.element_at("lines", (F.col("end.lkey").bitwiseAND(F.lit((1 << LINE_BITS) - 1)) + 1).cast("int")).alias("line")
    )
    sets = shared_table(lines.select("lid", word_hashes("line").alias("words")).dropDuplicates(["lid"]).withColumn("sample", F.filter("words", lambda w: w.bitwiseAND(F.lit(3)) == 0)), "line-words")
    # a quarter of the words bounds the overlap of most pairs well enough; only the rest carry all words
    half = sets.select("lid", F.size("words").alias("n"), "sample")
    near = pairs.join(half, "lid").join(half.select(*(F.col(c).alias(f"p_{c}") for c in half.columns)), "p_lid")
    apart = F.size("sample") + F.size("p_sample") - 2 * F.size(F.array_intersect("sample", "p_sample"))
    near = near.filter((F.col("n") + F.col("p_n") - apart) * (num + den) >= 2 * num * (F.col("n") + F.col("p_n"))).select("lid", "p_lid")
    both = near.join(sets.select("lid", "words"), "lid").join(sets.select(F.col("lid").alias("p_lid"), F.col("words").alias("p_words")), "p_lid")
    shared = both.select("lid", F.size(F.array_intersect("words", "p_words")).alias("o"), (F.size("words") + F.size("p_words")).alias("both"))
    found = shared_table(shared.filter(F.expr(f"o * {den} >= {num} * (both - o)")).select("lid").distinct(), name)
    for used in (pairs, wanted, sets):
        drop_shared(used)
    return found


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, part, places): for each document (``own_id``, ``part_of``) with removed lines, their places in ascending order."""
    num, den = round(threshold * 1000), 1000
    docs = docs.select(own_id(f"`{id_col}`", f"`{text_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    lines = shared_table(tokenised(exploded(docs), rarity(docs), num, den, min_tokens), "lines").filter("n > 0")
    firsts = lines.groupBy("sig").agg(F.min(F.struct("doc_id", "lkey")).alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("bits2").alias("bits2"), F.any_value("prefix").alias("prefix"))
    firsts = shared_table(firsts.select("sig", "first.doc_id", "first.lkey", "n", "bits", "bits2", "prefix"), "first-lines")
    # the rest needs the lines' places only
    places = shared_table(lines.select("sig", "doc_id", "lkey"), "line-places")
    drop_shared(lines)
    # numbered in order, so that a line is one number in the rows that meet by token
    found_firsts, firsts = firsts, row_numbers(firsts, ["doc_id", "lkey"]).withColumnRenamed("row", "lid")
    drop_shared(found_firsts)

    rows = firsts.select("lid", "n", "bits", "bits2", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.withColumn("deal", F.when(F.col("token").bitwiseAND(F.lit(1)) == 1, F.pmod(F.hash("lid"), F.lit(PARTS)) + 1).otherwise(0))
    group = Window.partitionBy("token", "deal")
    order = group.orderBy("lid")
    rows = rows.withColumn("own", F.struct("lid", "n", "pos", "bits", "bits2"))
    met = F.first("own").over(order), *(F.lag("own", i).over(order) for i in range(1, BEFORE + 1))
    partners = {f"p{i}": p for i, p in enumerate(met)}
    rows = rows.select("*", *(p.alias(c) for c, p in partners.items()), F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(group).alias("rows"))
    # place 0 is the row itself, for the join; the others are the lines met, null where there are fewer
    rows = rows.filter("rows > 1 or deal > 0").select("*", F.posexplode(F.array(F.lit(None).cast(rows.schema["own"].dataType), *partners)).alias("i", "p"))
    sides = F.expr(f"i = 0 and (deal > 0 or rank > {BEFORE + 2})").alias("later"), F.expr(f"i = 0 and (deal > 0 or (rank > 1 and rank < rows - {BEFORE}))").alias("early")
    close = F.col("p").isNotNull() & (F.col("lid") != F.col("p.lid")) & _may_match("", "p.", num, den)
    rows = rows.select("token", "lid", "n", "pos", "bits", "bits2", F.when(close, F.col("p.lid")).alias("p_lid"), *sides)
    rows = shared_table(rows.filter("p_lid is not null or later or early"), "prefixes")

    with_near = rows.filter("p_lid is not null").select("lid", "p_lid").distinct()
    gone = _verified(shared_table(with_near, "pairs-with-near"), firsts, docs, num, den, "similar-to-near")

    left = rows.filter("later").join(small_side(gone), "lid", "left_anti").select("token", "lid", "n", "pos", "bits", "bits2")
    earlier = rows.filter("early").select(*(F.col(c).alias(f"p_{c}") for c in ("token", "lid", "n", "pos", "bits", "bits2")))
    found = left.join(earlier, (F.col("token") == F.col("p_token")) & (F.col("p_lid") < F.col("lid")) & _may_match("", "p_", num, den))
    # all shared prefix tokens of a pair are known here: they, and what lies behind the last of them, bound the overlap
    counted = found.groupBy("lid", "p_lid").agg(F.count(F.lit(1)).alias("shared"), F.max("pos").alias("pos"), F.max("p_pos").alias("p_pos"), F.max("n").alias("n"), F.max("p_n").alias("p_n"))
    bound = F.expr(f"shared + least(n - pos, p_n - p_pos) - 1 >= {_ceil_div(f'{num}L * (n + p_n)', num + den)}")
    rest = shared_table(counted.filter(bound).select("lid", "p_lid"), "pairs")
    drop_shared(rows)
    more = _verified(rest, firsts, docs, num, den, "similar")

    copies = places.join(firsts.select("sig", F.col("doc_id").alias("f_doc"), F.col("lkey").alias("f_lkey")), "sig")
    similar = firsts.join(gone.union(more), "lid").select("doc_id", "lkey")
    every = copies.filter("doc_id <> f_doc or lkey <> f_lkey").select("doc_id", "lkey").unionByName(similar)
    return every.groupBy("doc_id", F.shiftright("lkey", LINE_BITS).alias("part")).agg(
        F.array_sort(F.collect_set(F.col("lkey").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int"))).alias("places")
    )


def _with_kept(docs: DataFrame, text_col: str, id_col: str, threshold: float, min_tokens: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the kept text and the removed places (null: none) under names that are free, and these names."""
    gone = shared_table(removed_lines(docs, threshold, min_tokens, text_col, id_col), "removed")
    taken, free = {c.lower() for c in docs.columns}, []
    for name in ("lines", "own", "part", "places", "kept", "gone_id", "gone_part"):
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        free.append(name)
    lines, own, part, places, kept, gone_id, gone_part = free
    gone = small_side(gone.select(F.col("doc_id").alias(gone_id), F.col("part").alias(gone_part), F.col("places").alias(places)), 200_000)
    keyed = docs.select("*", own_id(f"`{id_col}`", f"`{text_col}`").alias(own), part_of(f"`{text_col}`").alias(part), F.split(F.col(f"`{text_col}`"), "\n").alias(lines))
    found = keyed.join(gone, (F.col(own) == F.col(gone_id)) & (F.col(part) == F.col(gone_part)), "left")
    # kept lines in order, in time linear in the lines
    text = F.expr(f"if({places} is null, `{text_col}`, array_join(transform(array_except(sequence(0, size({lines}) - 1), {places}), i -> element_at({lines}, i + 1)), '\n'))")
    return found.withColumn(kept, text), kept, places


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None) -> DataFrame:
    """``docs`` with later equal and similar lines taken out of the texts; ``length_col``, if given, becomes the new length where a text changed."""
    found, kept, places = _with_kept(docs, text_col, id_col, threshold, min_tokens)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(kept).alias(c))
        elif c == length_col:
            out.append(F.when(F.col(places).isNull(), F.col(f"`{c}`")).otherwise(F.length(kept)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return found.select(*out)


def summary(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found, kept, places = _with_kept(docs, "text", "doc_id", threshold, min_tokens)
    return found.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )
