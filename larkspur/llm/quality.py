"""Quality rules: cross-document line frequency, with the plain counts of words, symbols and repeats.

Lines are normalised (lower case, one space between words) and hashed; a host's line counts in the documents
that have it. Lines in more than a limit of a host's documents (`min_docs`, or `share` of them if that is more)
are removed, and documents are rejected that fail the plain rules or of which too little is left.

Built-in functions only. A document gives each of its lines once (rows that repeat an id meet first), so a common line is summed before the shuffle; the
limits' share bounds a host's frequent lines to 1/share times its mean lines a document (or its lines / min_docs where it
is small), and they are broadcast only while few in all, else joined by host.

Nulls: a null text has no words and fails; a null host is a host of its own; a row with a null doc_id is judged as any, but not counted among
the documents that have a line. Rows that repeat an id count as one document of a line, and are judged each. A limit that is just met keeps the line. Blank lines are
never removed. Very long texts are judged whole, within their row. An empty table gives no rows. Extra columns pass through `line_frequency`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut
from .text import BLANKS, GAP, let, sql_words

#: With more frequent lines than this (8 bytes each) they are joined and not broadcast.
BROADCAST_LINES = 200_000
_LOW = (1 << 31) - 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), GAP, " ")))


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of `width` words that the text has twice or more.

    Windows are sorted by half a hash with their place in the low bits; those with an equal neighbour are sorted again by
    the whole hash, and the places of equal ones are walked once: n log n in the text's words.
    """

    def whole(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(width)])

    def twins(sorted_: Column, key) -> Column:
        return F.filter(sorted_, lambda x, i: F.coalesce((i > 0) & (key(F.get(sorted_, i - 1)) == key(x)), F.lit(False)) | F.coalesce(key(F.get(sorted_, i + 1)) == key(x), F.lit(False)))

    half = lambda x: F.shiftright(x, 31)
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: whole(i).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    likely = let(packed, lambda s: F.transform(twins(s, half), lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")))
    exact = let(F.array_sort(F.transform(likely, lambda i: F.struct(whole(i).alias("h"), i.alias("i")))), lambda s: F.transform(twins(s, lambda x: x["h"]), lambda x: x["i"]))
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(F.sort_array(exact), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")))["n"]
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(covered).cast("long")


def base_counts(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    with_words = F.filter(lines(text), has_word)
    whole = F.coalesce(text, F.lit(""))
    return let(
        sql_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(with_words, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def frequent_lines(docs: DataFrame, *, min_docs: int, share: float, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row per host: the hashes of its lines above the limit."""
    own = F.array_distinct(F.transform(F.filter(lines(F.col(text_col)), has_word), line_hash))
    each = docs.select(F.col(host_col).cast("string").alias("__ls_host"), F.col(id_col).alias("__ls_id"), F.explode(own).alias("__ls_line"))
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__ls_n")).where((F.col("__ls_n") > 1) & F.col(id_col).isNotNull()).limit(1).count():
        each = each.distinct()
    counted = each.groupBy("__ls_host", "__ls_line").agg(F.count("__ls_id").alias("__ls_n"))
    hosts = docs.groupBy(F.col(host_col).cast("string").alias("__ls_of")).agg(F.count(F.lit(1)).alias("__ls_docs"))
    above = counted.where(F.col("__ls_n") > min_docs).join(hosts, F.col("__ls_host").eqNullSafe(F.col("__ls_of")))
    return above.where(F.col("__ls_n") > F.col("__ls_docs") * share).groupBy("__ls_host").agg(F.sort_array(F.collect_list("__ls_line")).alias("__ls_frequent"))


def line_frequency(docs: DataFrame, *, min_docs: int = 20, share: float = 0.02, min_left: float = 0.5, min_words: int = 10, max_repeat: int = 20, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs with the base counts, base_failed, n_frequent_lines, words_left, cleaned (the text without frequent
    lines) and kept. Columns of these names are replaced."""
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_lines", "words_left", "cleaned", "kept"}
    docs = docs.drop(*(new - {id_col, text_col, host_col}))
    table = frequent_lines(docs, min_docs=min_docs, share=share, id_col=id_col, text_col=text_col, host_col=host_col)
    table = cut(table)
    n = table.agg(F.sum(F.size("__ls_frequent"))).first()[0] or 0
    table = F.broadcast(table) if n <= BROADCAST_LINES else table
    joined = docs.join(table, docs[host_col].cast("string").eqNullSafe(table["__ls_host"]), "left")
    frequent = F.coalesce("__ls_frequent", F.array().cast("array<bigint>"))
    is_frequent = lambda x: has_word(x) & F.array_contains(frequent, line_hash(x))
    text = F.col(text_col)
    told = F.transform(lines(text), lambda x: F.struct(x.alias("line"), is_frequent(x).alias("gone")))
    words = lambda t: F.aggregate(t, F.lit(0), lambda a, x: a + F.when(x["gone"], F.size(sql_words(x["line"]))).otherwise(0))
    left = lambda t: F.array_join(F.transform(F.filter(t, lambda x: ~x["gone"]), lambda x: x["line"]), "\n")
    split = lambda t: F.struct(F.size(F.filter(t, lambda x: x["gone"])).cast("long").alias("lines"), words(t).cast("long").alias("words"), F.when(text.isNotNull(), left(t)).alias("left"))
    none = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"), text.alias("left"))
    out = joined.withColumns({"__ls_base": base_counts(text), "__ls_gone": F.when(F.size(frequent) > 0, let(told, split)).otherwise(none)}).withColumn("cleaned", F.col("__ls_gone.left"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = out.select(*[c for c in out.columns if c not in ("__ls_host", "__ls_frequent", "__ls_base", "__ls_gone")], *[F.col(f"__ls_base.{n}").alias(n) for n in names], F.col("__ls_gone.lines").alias("n_frequent_lines"), (F.col("__ls_base.n_words") - F.col("__ls_gone.words")).alias("words_left"))
    failed = reduce(lambda a, b: a | b, [F.col("n_words") < min_words, 100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")])
    depleted = (F.col("n_frequent_lines") > 0) & ((F.col("words_left") < min_words) | (F.col("words_left") < min_left * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)
