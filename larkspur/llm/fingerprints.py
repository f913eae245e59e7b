"""Document fingerprints: Order MinHash, whose likeness falls with edit distance and not only with common content.

A text's k-mers are runs of `k` words (a shorter text is one), numbered by occurrence, so that the second "a b" differs from the first.
Each of `slots` hash functions orders them and selects the two least; these keep the order that they have
in the text, and the slot is a hash of that tuple (of a single k-mer where there is no other). The fingerprint is the slots, in hexadecimal; two are as alike as the
share of slots that agree.

Built-in functions only. Occurrences are numbered within a row: the k-mers' hashes are sorted with their places in the low
bits, and an element's number is found by bisection back to the first of its equals. K-mers are then exploded
and reduced by minima, in one partition as they are already dealt by document, first to the least of each order, then to the least above
it: memory is bounded by one document's words.

Nulls: a null text is empty; empty texts have the fingerprint of no k-mers. A null id comes last in descending order. Rows that repeat id and
text have one place in the order, and a row each in the result; ties of ids are ordered by a hash of the text. A very long text is
one task's work. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .text import let, sql_words

_LOW = (1 << 31) - 1
SLOTS = 40


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def numbered_kmers(text: Column, k: int) -> Column:
    """array<bigint>: for each k-mer a hash of it and of its occurrence number, its place in the low 31 bits."""

    def hashes(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
        one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: _high(one(i)).bitwiseOR(i.cast("bigint"))))

    def number(s: Column, steps: Column) -> Column:
        def occurrence(x: Column, i: Column) -> Column:
            same = lambda d: (i >= d) & (_high(F.get(s, i - d)) == _high(x))
            back = F.aggregate(steps, F.lit(0), lambda d, p: F.when(same(d + p), d + p).otherwise(d))
            return F.when(same(F.lit(1)), back).otherwise(F.lit(0))

        return F.transform(s, lambda x, i: _high(F.xxhash64(_high(x), occurrence(x, i))).bitwiseOR(_low(x)))

    def steps(s: Column) -> Column:
        """Powers of two below the size, descending."""
        bits = F.floor(F.log2(F.greatest(F.size(s), F.lit(1)).cast("double"))).cast("int")
        return F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2.0), b).cast("int"))

    return let(sql_words(text), lambda w: let(F.sort_array(hashes(w)), lambda s: let(steps(s), lambda p: number(s, p))))


def signatures(texts: DataFrame, keys: list[str], *, side: str | None = None, carry: tuple[str, ...] = (), k: int = 2, slots: int = SLOTS, text_col: str = "text") -> DataFrame:
    """keys, side, carry and `slots` (array<int>, null where there is no k-mer).

    texts: a row per keys and side (an int, at most a few of one key), none null, dealt by keys, so that nothing is shuffled. The
    k-mers are reduced to the least of each order, and then to the least of those above it.
    """
    own = [*keys, *([side] if side else [])]
    places = [F.xxhash64("h", F.lit(j)) for j in range(slots)]
    place = [_high(x).bitwiseOR(F.col("at")) for x in places]
    kmers = texts.select(*own, *carry, numbered_kmers(F.col(text_col), k).alias("v"))
    parted = lambda df, *more: df.select(*own, *more, F.explode_outer("v").alias("v")).select(*own, *more, _high(F.col("v")).alias("h"), _low(F.col("v")).alias("at"))
    least = parted(kmers).groupBy(*own).agg(*[F.min(x).alias(f"a{j}") for j, x in enumerate(place)])
    least = least.select(*[F.col(c).alias(f"_{c}") for c in own], *[f"a{j}" for j in range(slots)])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in keys])
    if side:  # not as a key of the join, whose partitioning it would change
        same = same & (F.col(side) - F.col(f"_{side}") == 0)
    both = parted(kmers.join(least, same), *carry, *[f"a{j}" for j in range(slots)])
    out = both.groupBy(*own, *carry).agg(*[F.min(f"a{j}").alias(f"a{j}") for j in range(slots)], *[F.min(F.when(x > F.col(f"a{j}"), x)).alias(f"b{j}") for j, x in enumerate(place)])

    def slot(j: int) -> Column:
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        in_order = F.xxhash64(F.when(b.isNull() | (_low(a) <= _low(b)), F.struct(_high(a), _high(b))).otherwise(F.struct(_high(b), _high(a))))
        return F.when(a.isNotNull(), F.shiftright(in_order, 32).cast("int"))

    return out.select(*own, *carry, F.array(*[slot(j) for j in range(slots)]).alias("slots"))


def as_text(slots: Column) -> Column:
    """Eight hexadecimal digits a slot; no text for no k-mers."""
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def neighbours(docs: DataFrame) -> DataFrame:
    """id, th and the next document's next_id, next_th, descending by id and round to the first.

    Ids are dealt to ranges; each range is walked by itself, and its last row gets the first of the next range that has rows.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the ranges' bounds are sampled, so which range a row is in is written down before it is used twice
    ids = saved(docs.select("id", "th").distinct().repartitionByRange(parts, F.col("id").desc(), "th").withColumn("part", F.spark_partition_id()), "ids")
    at = F.struct(F.col("id").alias("id"), F.col("th").alias("th"))
    walked = ids.withColumn("next", F.lead(at).over(Window.partitionBy("part").orderBy(F.col("id").desc(), "th")))
    heads = ids.groupBy("part").agg(F.min_by(at, F.struct(F.bitwise_not("id"), "th")).alias("head"))  # a row per range
    every = Window.orderBy("part")
    follow = heads.select(F.col("part").alias("_part"), F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("follow"))
    out = walked.join(F.broadcast(follow), F.col("part") == F.col("_part"))  # `parts` rows
    return out.select("id", "th", F.coalesce("next", "follow").alias("next")).select("id", "th", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def fingerprint_edits(docs: DataFrame, *, k: int = 2, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    A document's edited text has its last half (rounded down) replaced by as many code points, or all, of the next
    document's, by descending id; the last is followed by the first.
    """
    # keys that are never null, so that joins and groupings by them share one partitioning; the lowest bit of th marks a null id, so that no
    # branch carries a column that another drops, and exchanges of texts are written once and read again
    th = F.xxhash64("text").bitwiseAND(F.lit(~1)).bitwiseOR(F.col("none").cast("long"))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", th.alias("th"), "text")
    rows, distinct = own.agg(F.count(F.lit(1)), F.count_distinct(F.struct("id", "th"))).first()
    every = own.select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    if rows != distinct:
        own = own.groupBy("id", "th").agg(F.min("text").alias("text"))
    next_ = saved(neighbours(own), "next")
    size = own.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.length("text").alias("n"))
    same = lambda a, b: (F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))
    halves = next_.join(size, same(("id", "th"), ("_id", "_th"))).select(F.col("id").alias("to"), F.col("th").alias("to_th"), F.col("next_id").alias("_id"), F.col("next_th").alias("_th"), (F.col("n") / 2).cast("int").alias("half"))
    tails = own.join(halves, same(("id", "th"), ("_id", "_th"))).select("to", "to_th", "half", F.expr("substring(text, 1, half)").alias("tail"))
    edited = own.join(tails, same(("id", "th"), ("to", "to_th")))
    whole = F.concat(F.expr("substring(text, 1, length(text) - half)"), F.col("tail"))
    both = edited.select("id", "th", F.length("text").cast("long").alias("n_chars"), "text", whole.alias("edited"))
    side = lambda i, sha, text: F.struct(F.lit(i).alias("side"), sha.alias("sha"), F.col(text).alias("text"))
    sides = both.select("id", "th", "n_chars", F.explode(F.array(side(0, F.lit(""), "text"), side(1, F.sha2("edited", 256), "edited"))).alias("s")).select("id", "th", "n_chars", "s.side", "s.sha", "s.text")
    signed = signatures(sides, ["id", "th"], side="side", carry=("n_chars", "sha"), k=k, slots=slots)
    # both sides are in one partition still: a row per document, with the next one's key, so that only the next one's slots are joined later
    of = lambda i: F.max(F.when(F.col("side") == i, F.col("slots")))
    pairs = signed.groupBy("id", "th").agg(F.max("n_chars").alias("n_chars"), F.max("sha").alias("sha"), of(0).alias("a"), of(1).alias("b"))
    step = next_.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "next_id", "next_th")
    pairs = saved(pairs.join(step, same(("id", "th"), ("_id", "_th"))).drop("_id", "_th"), "signatures")
    c = pairs.select(F.col("id").alias("nid"), F.col("th").alias("nth"), F.col("a").alias("c"))
    out = pairs.join(c, same(("next_id", "next_th"), ("nid", "nth")))
    if rows != distinct:
        out = every.join(out, same(("_id", "_th"), ("id", "th")))
    return out.select(F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
