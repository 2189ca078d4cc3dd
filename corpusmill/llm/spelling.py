"""Spelling variants of the words of a corpus, without pairs: wildcard groups for replacements, deletions for the rest.

Everything is DataFrame expressions. A word of L code points is dealt once to each of its rests, which lack one of them, with that one's place and letter, and to itself. Words of one rest and place differ in that code point alone, so
that they are no more than the alphabet has letters (some ninety). Their number and the two leading ones say what each is
told of the others. Insertions and deletions meet where the rest is itself a word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: What a word is made of; only A-Z are lowered.
RUN = r"[A-Za-zÀ-ÿ]+"
#: A run of one document in so many loses a code point, as the contract's planted misspellings do.
ONE_IN = 199
#: How many times as frequent as a word its form has to be.
LEAD = 5


def occurrences(docs: DataFrame, least_points: int = 6) -> DataFrame:
    """(word): one row for each run of a text that has ``least_points`` code points or more once its code point, if any, is gone.

    h is the CRC-32 of `<doc_id>:<run>`; where 199 divides it the run loses its code point h % length. A null doc_id
    stands as the empty string, a null text has no runs, and repeated rows count each time.
    """
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    long = F.filter(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0)), lambda w: F.length(w) >= least_points)
    runs = shared.columns_only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(long).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    gone = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return runs.withColumn("h", h).select(F.when(F.col("h") % ONE_IN == 0, gone).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_points)


def vocabulary(docs: DataFrame, least_points: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): the words that occur ``least_n`` times or more; counted on the map side first."""
    return occurrences(docs, least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def meetings(words: DataFrame) -> DataFrame:
    """(word, near, best): for each of its rests, how many words near a word meet it there, and their leading one.

    A word stands at each rest that it has less one code point, with that place and letter, and at place 0 of itself. Words
    of one rest and place differ in that letter alone (replacements); a word at place 0 has one code point less than
    the others (deletions, told to both). Of equal letters in a row only the first is a deletion, so that each shorter
    word is met once. One row holds a rest's places: no more than the alphabet has letters for each.
    """
    spots = words.select("word", (-F.col("n")).alias("m"), F.explode(F.expr("sequence(0, length(word))")).alias("i"))
    rest = F.expr("if(i = 0, word, concat(substring(word, 1, i - 1), substring(word, i + 1)))")
    # a rest, a place and a letter tell the word: nothing more is dealt, and once for both kinds
    dealt = spots.select(rest.alias("rest"), F.col("i").cast("short").alias("i"), F.expr("if(i = 0, '', substring(word, i, 1))").alias("c"), "m").repartition("rest")
    places = dealt.groupBy("rest", "i").agg(F.sort_array(F.collect_list(F.struct("m", "c"))).alias("held"))
    groups = places.groupBy("rest").agg(F.collect_list(F.struct("i", "held")).alias("places")).filter(F.expr("size(places) > 1 and exists(places, p -> p.i = 0) or exists(places, p -> size(p.held) > 1)"))
    whole = "concat(substring(rest, 1, p.i - 1), h.c, substring(rest, p.i))"
    first = "(p.i = 1 or substring(rest, p.i - 1, 1) <> h.c)"
    own = groups.withColumn("own", F.expr("get(get(filter(places, p -> p.i = 0), 0).held, 0).m"))
    longer = own.withColumn("longer", F.expr(f"if(own is null, null, flatten(transform(filter(places, p -> p.i > 0), p -> transform(filter(p.held, h -> {first}), h -> named_struct('m', h.m, 'w', {whole})))))"))
    other = "get(p.held, if(k = 0, 1, 0))"
    swapped = f"if(size(p.held) > 1, named_struct('m', {other}.m, 'w', {whole.replace('h.c', other + '.c')}), null)"
    shorter = f"if(own is not null and {first}, named_struct('m', own, 'w', rest), null)"
    told = F.expr(
        f"""flatten(transform(filter(places, p -> p.i > 0), p -> transform(p.held, (h, k) ->
        named_struct('word', {whole}, 'near', size(p.held) - 1 + if(own is not null and {first}, 1, 0), 'best', least({swapped}, {shorter})))))"""
    )
    itself = F.expr("if(size(longer) > 0, array(named_struct('word', rest, 'near', size(longer), 'best', array_min(longer))), array())")
    met = longer.select(F.explode(F.concat(told, itself)).alias("x")).filter("x.near > 0")
    return met.select("x.word", F.col("x.near").cast("bigint").alias("near"), "x.best")


def roots(forms: DataFrame, most_n: int) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last by joins that double the way each time.

    n grows by LEAD with each step and starts at 1 at least, so that log(most_n) of them bound any way.
    """
    ways = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(max(most_n, 1), LEAD)))))):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = shared.cut_small(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return ways


def variants(docs: DataFrame, least_points: int = 6, least_n: int = 5) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point tells them apart. The form is the near word of
    largest n (of equal ones the first by code points), if that is LEAD times the word's own; the root is the end of
    the way of forms. Nulls and repeats are as in ``occurrences``; extra columns are left behind; an empty table, or one
    without frequent words, gives no rows.
    """
    words = shared.cut_small(vocabulary(docs, least_points, least_n))
    met = meetings(words).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    leads = -F.col("best.m") >= LEAD * F.col("n")
    known = shared.cut_small(
        words.join(met, "word", "left").select(
            "word", F.when(leads, F.col("best.w")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"), F.when(leads, -F.col("best.m")).alias("form_n")
        )
    )
    ends = roots(known.filter("form is not null"), known.agg(F.max("n")).first()[0] or 1)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
