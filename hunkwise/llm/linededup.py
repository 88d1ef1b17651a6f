"""Line dedup by a segment-partition edit join. DataFrame operations only.

Equal lines form a class, whatever their length, and so do near lines. Two lines are near if

- both have at least ``WORDS`` words, and they are within ``tau`` edits (insertion, deletion, substitution of a word), tau
  being 2 where the shorter line has up to 127 words, and 3 above; or
- both have fewer than ``WORDS`` + 2 words and at least ``CHARS`` characters, and they are within 2 edits of a character.

Classes are the connected components. Of a class the first occurrence in the corpus stays (by doc_id, then position) and
the others are dropped from their documents. Lines without a word are no lines to this operator, and stay.

The join: a line is split into tau+1 segments of even length. If two lines are within tau edits, some segment of the
shorter one stands unchanged in the other, and only at few places (by the length difference and the number of edits that
can lie left and right of it). Index keys are hashes of (segment number, length, segment), probe keys those of the runs
at these places, for the line's own and each smaller length in reach. Only keys that two different lines have go on; a
first pass over the lines finds these keys, a second one the lines that have them (by a sieve of bits where the keys are
too many to be broadcast; what falls through it is alone with its key and goes then). What is left is compared by the
parities of its words' hashes, in the join's condition, and candidates are verified by edit distance: common ends are
trimmed, then a banded bit-parallel pass follows, whose column of 2*tau+1 differences is held in two bit vectors.

Keys are made of lines, not occurrences, so a line that a third of the documents share counts once; equal lines never
pair. A key of more than ``HOT`` lines (slightly differing copies of one line) is not joined with itself. One of its lines,
that whose words' parities are nearest to the usual ones (then the most frequent), is the pivot, and every other line is compared with that. Lines within tau of the pivot are in its class, so their own
pairs need not be made. For the others count what they add to the pivot (words, the k-th of a kind apart) and what they
lack: an edit adds one word and takes away one at most, so a line that adds more than tau words shares one of any tau+1 of
these with every line within tau of it, and likewise for lacking. Such lines are grouped with those that share the word,
and the groups are treated as keys again, until none is hot (a group of over half of the lines that it came from is joined
with itself, so the groups shrink). Lines that neither add nor lack more than tau words and yet
are further from the pivot (words in another order) are compared with their like. So all classes are whole, and the work
follows the number of lines, not its square.

Defined results: a null text has no lines and stays null; rows that agree in id and text count as one document; a null
doc_id is ordered last; documents without a dropped line are untouched. Further columns don't matter, except that columns
named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_shuffles, free, free_when_done, fresh_name, is_small, min_labels, scratch_until_done, tasks_for, written

WORDS = 10
CHARS = 32
HOT = 64
#: Numbers of words from which tau is the next larger.
STEPS = ((0, 2), (128, 3))
CHAR_TAU = 2
_MOST = STEPS[-1][1]
#: Words of 64 bits in a row of the sieve, and at most in the whole sieve (64 MB).
_ROW, _SIEVE = 256, 1 << 23
#: Lines from which their keys are shuffled in two slices, slices at most, and lengths in a row that are in one slice.
_SLICE, _SLICES, _BLOCK = 6_000_000, 2, 8
_LAST = (1 << 63) - 1
_BY_WORD, _BY_CHAR = 0, 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words(line: Column) -> Column:
    """What stands between spaces; a run of k spaces makes k - 1 empty words."""
    return F.split(line, " ")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def tau(n: Column) -> Column:
    """Edits allowed between two lines of which the shorter one has ``n`` words."""
    found = F.lit(STEPS[0][1])
    for start, value in STEPS[1:]:
        found = F.when(n >= start, value).otherwise(found)
    return found


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters that both strings begin with, by halving steps (up to two million)."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    least = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= least) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n))


def common_start(a: Column, b: Column) -> Column:
    """Number of elements that both arrays begin with."""
    least = F.least(F.size(a), F.size(b))
    return _let(F.array_position(F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x == y), F.lit(False)).cast("int"), lambda at: F.when(at == 0, least).otherwise(at - 1))


def _banded(p: Column, t: Column, tau: int) -> Column:
    """Edit distance of two arrays, or some number above ``tau`` where it is above it.

    Differences between neighbouring cells of the column are two bit vectors over the rows j-tau..j+tau of column j; one
    step per element of ``t``. The value is followed along the band's lowest diagonal, then along the last row.
    """
    band = (1 << (2 * tau + 1)) - 1
    m, n = F.size(p), F.size(t)

    def equal(j: Column) -> Column:
        c = F.get(t, j)
        bits = [F.when((j + (k - tau) >= 0) & (F.get(p, j + (k - tau)) == c), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * tau + 1)]
        return sum(bits[1:], bits[0])

    def step(s: Column, j: Column) -> Column:
        vp, vn, dist = s["vp"], s["vn"], s["dist"]

        def after(eq: Column) -> Column:
            d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(band))
            return _let(d0, with_d0)

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(band)))
            return _let(F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(vp).alias("hn")), moved)

        def moved(x: Column) -> Column:
            down = F.shiftright(x["d0"], 1)
            row = m - 1 - j + tau  # the last row's place in the band
            at_row = F.call_function("shiftright", x["hp"], row).bitwiseAND(F.lit(1)) - F.call_function("shiftright", x["hn"], row).bitwiseAND(F.lit(1))
            diagonal = F.lit(1) - F.shiftright(x["d0"], 2 * tau).bitwiseAND(F.lit(1))
            return F.struct(
                x["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(x["hp"])).bitwiseAND(F.lit(band))).alias("vp"),
                down.bitwiseAND(x["hp"]).alias("vn"),
                (dist + F.when(j + tau < m, diagonal).otherwise(at_row)).alias("dist"),
            )

        return _let(equal(j), after)

    # rows 0..tau of column 0, in the band's upper part; a pattern shorter than the band starts on its last row
    first = F.struct(F.lit(band ^ ((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(tau)).alias("dist"))
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), first, step, lambda s: s["dist"])
    return F.when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(whole)


def banded_distance(a: Column, b: Column, tau: int = CHAR_TAU) -> Column:
    """Edit distance of two strings by characters, or some number above ``tau`` where it is above it."""

    def trimmed(ends: Column) -> Column:
        head = ends["head"]
        mid_a, mid_b = F.substring(a, head + 1, F.length(a)), F.substring(b, head + 1, F.length(b))
        return _let(F.struct(mid_a.alias("a"), mid_b.alias("b"), common_prefix(F.reverse(mid_a), F.reverse(mid_b)).alias("tail")), middle)

    def middle(x: Column) -> Column:
        left = F.substring(x["a"], F.lit(1), F.length(x["a"]) - x["tail"])
        right = F.substring(x["b"], F.lit(1), F.length(x["b"]) - x["tail"])
        return _let(F.struct(chars(left).alias("p"), chars(right).alias("t")), lambda y: _banded(y["p"], y["t"], tau))

    far = F.abs(F.length(a) - F.length(b)) > tau
    return F.when(far, F.lit(tau + 1)).otherwise(_let(F.struct(common_prefix(a, b).alias("head")), trimmed))


def word_distance(a: Column, b: Column, tau: int = _MOST) -> Column:
    """Edit distance of two arrays of words, or some number above ``tau`` where it is above it."""

    def trimmed(x: Column) -> Column:
        rest = F.struct(F.slice(x["a"], x["head"] + 1, F.size(x["a"])).alias("a"), F.slice(x["b"], x["head"] + 1, F.size(x["b"])).alias("b"))
        return _let(rest, lambda y: _let(F.struct(y["a"].alias("a"), y["b"].alias("b"), common_start(F.reverse(y["a"]), F.reverse(y["b"])).alias("tail")), middle))

    def middle(x: Column) -> Column:
        cut = lambda side: F.slice(x[side], 1, F.size(x[side]) - x["tail"])
        return _let(F.struct(cut("a").alias("p"), cut("b").alias("t")), lambda y: _banded(y["p"], y["t"], tau))

    far = F.abs(F.size(a) - F.size(b)) > tau
    return F.when(far, F.lit(tau + 1)).otherwise(_let(F.struct(a.alias("a"), b.alias("b"), common_start(a, b).alias("head")), trimmed))


def near(first: Column, second: Column, kind: Column) -> Column:
    """Whether two lines are near by words or by characters."""
    by_word = _let(F.struct(words(first).alias("a"), words(second).alias("b")), lambda x: word_distance(x["a"], x["b"]) <= tau(F.least(F.size(x["a"]), F.size(x["b"]))))
    return F.when(kind == _BY_WORD, by_word).otherwise(banded_distance(first, second) <= CHAR_TAU)


def places(t: int) -> list[tuple[int, int, int]]:
    """The keys of a line under ``t`` edits: how much shorter the line sought is, segment, and shift of the segment."""
    return [(less, i, shift) for less in range(t + 1) for i in range(t + 1) for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1)]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, pos, line, id`` of every line that has a word; ``id`` is the line's 128-bit hash."""
    text = F.col(f"`{text_col}`")
    lines = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.col("line")
    return lines.where(line.rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))


def entries(lines: DataFrame, slices: int = 1, which: int = 0) -> DataFrame:
    """``key, id, line, kind, t, index``: index and probe keys of every line; with ``slices``, those keys that are in slice
    ``which``. Equal keys are in one slice, since that follows from the length that they are made for."""
    n, size = F.col("n"), F.col("size")

    def asked(*kinds: tuple[int, int]) -> Column:
        rows = [F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for k, t in kinds for less, i, shift in places(t)]
        return F.array(*rows).cast("array<struct<kind:int,t:int,less:int,i:int,shift:int>>")

    by_char, first = (_BY_CHAR, CHAR_TAU), (_BY_WORD, STEPS[0][1])
    long = size >= CHARS
    choice = F.when(n < WORDS, F.when(long, asked(by_char)).otherwise(asked())).when(n < WORDS + 2, F.when(long, asked(by_char, first)).otherwise(asked(first)))
    for (_, t), (start, up) in zip(STEPS, STEPS[1:], strict=False):  # a line just above a step also seeks those below it
        choice = choice.when(n < start, asked((_BY_WORD, t))).when(n < start + t, asked((_BY_WORD, t), (_BY_WORD, up)))
    choice = choice.otherwise(asked((_BY_WORD, _MOST)))
    ours = lambda of: F.expr(f"({of}) div {_BLOCK} % {slices} = {which}")
    if slices > 1:  # lines without a key in the slice go before they are taken apart
        spaces = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
        lines = lines.withColumn("spaces", spaces).where((F.col("spaces") < WORDS + 1) | reduce(Column.__or__, [ours(f"spaces + 1 - {less}") for less in range(_MOST + 1)]))
    rows = lines.select("id", "line", words(F.col("line")).alias("ws"), F.length("line").alias("size")).withColumn("n", F.size("ws"))
    rows = rows.select("id", "line", "ws", "size", "n", F.explode(choice).alias("p")).select("id", "line", "ws", "p.*", (F.when(F.col("p.kind") == _BY_WORD, n).otherwise(size) - F.col("p.less")).alias("of"))
    rows = rows.where(F.when(F.col("kind") == _BY_WORD, (F.col("of") >= WORDS) & (tau(F.col("of")) == F.col("t"))).otherwise(F.col("of") >= CHARS))
    if slices > 1:
        rows = rows.where(ours("of"))
    short, more = F.expr("of div (t + 1)").cast("int"), F.col("t") + 1 - F.expr("of % (t + 1)")  # the longer segments come last
    rows = rows.withColumn("at", short * F.col("i") + F.greatest(F.lit(0), F.col("i") - more) + F.col("shift") + 1).withColumn("width", short + (F.col("i") >= more).cast("int"))
    of_words = F.xxhash64(F.lit("w"), F.col("i"), F.col("of"), F.slice("ws", F.col("at"), F.col("width")))
    of_chars = F.xxhash64(F.lit("c"), F.col("i"), F.col("of"), F.substring(F.col("line"), F.col("at"), F.col("width")))
    return rows.select(F.when(F.col("kind") == _BY_WORD, of_words).otherwise(of_chars).alias("key"), "id", "line", "kind", "t", ((F.col("less") == 0) & (F.col("shift") == 0)).alias("index"))


def _units(line: Column, kind: Column) -> Column:
    return F.when(kind == _BY_WORD, words(line)).otherwise(chars(line))


def parities(units: Column) -> Column:
    """60 bits: whether an odd number of units falls in each. An edit changes two at most."""
    return F.aggregate(units, F.lit(0).cast("long"), lambda s, u: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(u), F.lit(60)).cast("int"))))


def tokens(units: Column) -> Column:
    """Hashes of the units, the k-th of a kind apart (from the eighth on alike, so they count as one)."""

    def of(s: Column) -> Column:
        same = lambda u, i: sum((F.coalesce(F.get(s, i - k) == u, F.lit(False)).cast("int") for k in range(1, 8)), F.lit(0))
        return F.array_distinct(F.transform(s, lambda u, i: F.xxhash64(u, same(u, i))))

    return _let(F.array_sort(units), of)


def _pairs(members: DataFrame, other: DataFrame, which: Column) -> DataFrame:
    """``first, second, kind``: pairs of different lines of one group that may be near; ``which`` refers to x and y."""
    x, y = members.alias("x"), other.alias("y")
    close = F.bit_count(F.col("x.sig").bitwiseXOR(F.col("y.sig"))) <= 2 * F.col("x.t")
    made = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.id") != F.col("y.id")) & which & close)
    return made.select(F.least("x.id", "y.id").alias("first"), F.greatest("x.id", "y.id").alias("second"), "x.kind")


def _lines_of(texts: DataFrame, ids: DataFrame, tasks: int) -> DataFrame:
    """``id, line`` of ``texts`` where ``ids`` has the id, and few others, so that a join with them moves no other line."""
    line = texts.select("id", "line")
    if is_small(line):
        return F.broadcast(line)
    ids = ids.distinct()
    if is_small(ids):
        asked = line.join(F.broadcast(ids), "id", "left_semi")
    else:
        asked = sieved(line.withColumn("key", F.xxhash64("id")), ids.select(F.xxhash64("id").alias("key"))).drop("key")
    return broadcast_if_small(written(asked, "lines-asked", tasks=tasks))


def _verified(pairs: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """The pairs that are near, as links ``a, b``."""
    pairs = written(pairs.distinct(), "lines-pairs", small=True, tasks=tasks)
    lines = _lines_of(texts, pairs.select(F.explode(F.array("first", "second")).alias("id")), tasks)
    found = pairs.join(lines.toDF("first", "first_line"), "first").join(lines.toDF("second", "second_line"), "second")
    return found.where(near(F.col("first_line"), F.col("second_line"), F.col("kind"))).select(F.col("first").alias("a"), F.col("second").alias("b"))


def _split(hot: DataFrame, texts: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hot groups by their pivots: links to the pivots, pairs still to be verified, and the next groups' members."""
    line = _lines_of(texts, hot.select("id"), tasks)
    sums = hot.groupBy("g").agg(F.count("*").alias("n"), *[F.expr(f"sum(shiftright(sig, {b}) & 1L) as b{b}") for b in range(60)])
    usual = sums.select("g", F.expr(" | ".join(f"if(2 * b{b} > n, shiftleft(1L, {b}), 0L)" for b in range(60))).alias("usual"))
    off = F.struct(F.bit_count(F.col("sig").bitwiseXOR(F.col("usual"))).alias("off"), (-F.col("times")).alias("rare"), F.col("id"))
    pivots = hot.join(broadcast_if_small(written(usual, "lines-usual", tasks=tasks)), "g").groupBy("g").agg(F.min(off).alias("x")).select("g", F.col("x.id").alias("pivot"))
    pivots = pivots.join(line.toDF("pivot", "pivot_line"), "pivot")
    each = hot.join(line, "id").join(broadcast_if_small(written(pivots, "lines-pivots", tasks=tasks)), "g")
    ours, its = (tokens(_units(F.col(c), F.col("kind"))) for c in ("line", "pivot_line"))
    each = each.withColumns({"ours": ours, "its": its}).withColumns({"adds": F.array_except("ours", "its"), "lacks": F.array_except("its", "ours")}).drop("ours", "its")
    sort = F.when(F.size("adds") > F.col("t"), "adds").when(F.size("lacks") > F.col("t"), "lacks")
    each = each.withColumn("sort", F.coalesce(sort, F.when(near(F.col("line"), F.col("pivot_line"), F.col("kind")), "near").otherwise("else")))
    each = written(each.drop("line", "pivot_line"), "lines-compared", tasks=tasks)
    to_pivot = each.where((F.col("sort") == "near") & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    alike = each.where(F.col("sort").isin("near", "else"))
    pairs = _pairs(each.where("sort = 'else'"), alike, (F.col("y.sort") == "near") | (F.col("x.id") < F.col("y.id")))

    def grouped(sort: str) -> DataFrame:
        """Lines by the words that they add or lack, where a line of this sort has the word among its tau+1."""
        asks = F.col("sort") == sort
        rows = each.select("g", "id", "kind", "t", "sig", "times", "size", F.explode(F.transform(F.array_sort(sort), lambda x, i: F.struct(x.alias("token"), (asks & (i <= F.col("t"))).alias("index")))).alias("x"))
        return rows.select(F.xxhash64("g", F.lit(sort), "x.token").alias("g"), "id", "kind", "t", "sig", "times", F.col("size").alias("parent"), "x.index")

    return to_pivot, pairs, grouped("adds").unionByName(grouped("lacks"))


def sieved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in the written table ``keys``, and few others: each key sets four bits of a word, and there
    is a word for two keys at most (beyond ``_SIEVE`` words for more, so that more others pass). ``rows`` aren't shuffled."""
    n = min(1 << max(8, (keys.count() // 2).bit_length()), _SIEVE)
    key, one = F.col("key"), F.lit(1).cast("long")
    word = key.bitwiseAND(F.lit(n - 1).cast("long"))
    four = [F.call_function("shiftleft", one, F.shiftrightunsigned(key, b).bitwiseAND(F.lit(63).cast("long")).cast("int")) for b in (40, 46, 52, 58)]
    mask = reduce(Column.bitwiseOR, four)
    row = lambda w: F.expr(f"{w} div {_ROW}")
    cells = keys.select(word.alias("word"), mask.alias("bits")).union(keys.sparkSession.range(n).select("id", F.lit(0).cast("long")))
    cells = cells.withColumn("row", row("word")).repartition("row").groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))
    cells = cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    asked = rows.withColumn("word", word)
    held = F.get(F.col("bits"), (F.col("word") % _ROW).cast("int")).bitwiseAND(mask) == mask
    return asked.join(F.broadcast(cells), (row("word") == F.col("row")) & held, "left_semi").drop("word")


def shared_keys(lines: DataFrame, slices: int) -> list[DataFrame]:
    """Tables of the keys that two different lines have, one as index key. Keys are shuffled slice by slice, and each
    slice's shuffle files go before the next, so they don't lie on the disks all at once."""
    made = []
    for k in range(slices):
        keys = entries(lines, slices, k).groupBy("key").agg(F.min("id.a").alias("lo"), F.max("id.a").alias("hi"), F.max("index").alias("index"))
        made.append(written(keys.where("index and lo <> hi").select("key"), "lines-keys", small=True))
        del keys
        drop_shuffles(lines.sparkSession)
    return made


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 0) -> DataFrame:
    """Links ``a, b`` between ids of distinct lines; their components are those of the near lines. ``rows`` is about the
    number of lines; where these are many, their keys are found in several passes."""
    lines = occurrences(docs, id_col, text_col).select("id", "line")
    found = entries(lines)
    parts = shared_keys(lines, min(_SLICES, 1 + rows // _SLICE))
    shared = reduce(DataFrame.union, parts)
    raw = written(found.join(F.broadcast(shared), "key") if is_small(shared) else sieved(found, shared), "lines-raw")
    tasks = tasks_for(raw)
    members = raw.groupBy(F.col("key").alias("g"), "id", "kind", "t").agg(F.max("index").alias("index"))
    texts = raw.groupBy("id").agg(F.first("line").alias("line"), F.count("*").alias("times"))
    by_char = F.when(F.size(words(F.col("line"))) < WORDS + 2, parities(chars(F.col("line"))))
    texts = written(texts.select("*", parities(words(F.col("line"))).alias("word_sig"), by_char.alias("char_sig")), "lines-texts", tasks=tasks)
    sig = F.when(F.col("kind") == _BY_WORD, F.col("word_sig")).otherwise(F.col("char_sig"))
    signed = members.join(broadcast_if_small(texts.drop("line")), "id").select("g", "id", "kind", "t", "index", "times", sig.alias("sig"), F.lit(1 << 62).alias("parent"))
    links: list[DataFrame] = []
    while True:
        sized = signed.groupBy("g").agg(F.count("*").alias("size"), F.max("index").alias("any")).where("any and size > 1").select("g", "size")
        now = written(signed.join(sized, "g"), "lines-groups", tasks=tasks).withColumn("hot", (F.col("size") > HOT) & (2 * F.col("size") <= F.col("parent")))
        cold = now.where("not hot")
        if not links:
            free(*parts, raw)
            drop_shuffles(docs.sparkSession)
        links.append(written(_verified(_pairs(cold, cold, (F.col("x.id") < F.col("y.id")) & (F.col("x.index") | F.col("y.index"))), texts, tasks), "lines-links", small=True, tasks=tasks))
        hot = now.where("hot").drop("parent", "hot")
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, links).distinct()
        to_pivot, pairs, signed = _split(hot, texts, tasks)
        links += [to_pivot, written(_verified(pairs, texts, tasks), "lines-links", small=True, tasks=tasks)]


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, drops, linked``: each document's dropped positions, and how many of its lines have near lines; a table
    written to be kept, so that what it was made of can go."""
    slim = written(occurrences(docs, id_col, text_col).select("doc_id", "th", "pos", "id"), "lines-all")
    tasks = tasks_for(slim)
    labels = min_labels(written(links(docs, id_col, text_col, slim.count()), "lines-near", tasks=tasks), "lines-classes")
    classed = slim.join(broadcast_if_small(labels.withColumnRenamed("node", "id")), "id", "left").select("doc_id", "th", "pos", F.coalesce("root", "id").alias("class"), F.col("root").isNotNull().alias("linked"))
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.col("doc_id").isNull().alias("bare"), F.col("th"), F.col("pos"))
    # most lines stand once; only the others are ordered
    several = written(classed.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "lines-several", small=True, tasks=tasks)
    drop_shuffles(docs.sparkSession)
    shared = written(classed.join(broadcast_if_small(several), "class", "left_semi").withColumn("place", place), "lines-shared")
    firsts = written(shared.groupBy("class").agg(F.min("place").alias("first")), "lines-firsts", tasks=tasks)
    marked = shared.join(broadcast_if_small(firsts), "class")
    made = marked.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.when(F.col("place") != F.col("first"), F.col("pos")))).alias("drops"), F.size(F.collect_set(F.when(F.col("linked"), F.col("pos")))).alias("linked"))
    return written(made, "lines-drops", keep=True, tasks=tasks)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_text`` (the text without dropped lines), ``_lines``, ``_dropped`` and ``_linked``."""
    others = [c for c in docs.columns if c.lower() not in ("_text", "_lines", "_dropped", "_linked")]
    d, th, drops, linked = (fresh_name(docs, n) for n in ("key_id", "key_text", "drops", "linked"))
    with scratch_until_done(docs.sparkSession):
        found = dropped(docs, id_col, text_col)
    free_when_done(found)
    found = found.toDF(d, th, drops, linked)
    drop_shuffles(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    joined = docs.join(broadcast_if_small(found), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(th)), "left")
    lines = F.split(text, "\n")
    kept = _let(F.struct(lines.alias("l"), F.col(drops).alias("d")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["d"]), lambda i: F.get(x["l"], i)), "\n"))
    none = F.coalesce(F.size(drops), F.lit(0)) == 0
    return joined.select(
        *[F.col(f"`{c}`") for c in others],
        F.when(none, text).otherwise(kept).alias("_text"),
        F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("_lines"),
        F.when(none, 0).otherwise(F.size(drops)).alias("_dropped"),
        F.coalesce(linked, F.lit(0)).alias("_linked"),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lines, dropped, near_lines, kept_chars, kept_md5``."""
    made = dedup(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return made.select("doc_id", F.col("_lines").cast("long").alias("lines"), F.col("_dropped").cast("long").alias("dropped"), F.col("_linked").cast("long").alias("near_lines"), F.length("_text").cast("long").alias("kept_chars"), F.md5("_text").alias("kept_md5"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without their dropped lines, in the same columns; documents of which no word is left go. ``chars_col``,
    if there is one, gets the new length."""
    others = [c for c in docs.columns if c != text_col]
    apart = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = dedup(apart)
    left = made.where((F.col("_dropped") == 0) | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("_dropped") == 0, F.col(f"row.`{chars_col}`")).otherwise(F.length("_text")).cast(docs.schema[chars_col].dataType)
    return left.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
