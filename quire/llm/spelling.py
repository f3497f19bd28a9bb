"""Spelling variants grouped without pairs: words that differ by one code point meet in wildcard groups.

Two words that differ by one replaced code point share (position, what stands before, what stands after), and just once. A
word that lacks one code point of another is one of the other's deletions, so deletions join the vocabulary. Each word goes
to its wildcard groups, to the groups of its distinct deletions, and to its own group, where those that have it as a
deletion are. A group holds no more words than the alphabet has letters, times the word's length; of each group a word
gets the size and the best word other than itself (the first of the two most frequent). Those are added up word by word,
so what is worked with is a few rows a word and never a row a pair.

Words are known by their number in code-point order, and groups by two 64-bit hashes of what they share, so rows are of one
size whatever the length of a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, cut_narrow, lower_ascii, text_of

LETTERS = r"[^A-Za-zÀ-ÿ]+"


def observed_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, drop_one_in: int = 31) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z in lower case, counted over all documents.

    Where drop_one_in divides h, the crc32 of "doc_id:run", the run loses its code point h % length: a deterministic rate
    of typing errors. The explode and the count before the shuffle stay in generated code.
    """
    runs = F.array_remove(F.split(lower_ascii(text_of(F.col(f"`{text}`"))), LETTERS), "")
    each = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.where(F.char_length("run") >= min_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = each.select(F.when(F.col("h") % drop_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(*shared: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *shared).alias(f"k{seed}") for seed in (1, 2)]


def variant_groups(vocabulary: DataFrame) -> DataFrame:
    """(k1, k2, role, n, id): each row of (id, word, n) in its own group (role 0), in those of its deletions (1) and in its
    wildcard groups (2). Of a run of equal code points only the first is deleted: the others give the same word."""
    word, p = F.col("word"), F.col("p")
    each = vocabulary.select("id", "n", "word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("p"))
    before, after = F.substring(word, F.lit(1), p - 1), F.substring(word, p + 1, F.char_length(word))
    fresh = (p == 1) | (F.substring(word, p, F.lit(1)) != F.substring(word, p - 1, F.lit(1)))
    own = vocabulary.select(*_keys(word), F.lit(0).alias("role"), "n", "id")
    deleted = each.where(fresh).select(*_keys(F.concat(before, after)), F.lit(1).alias("role"), "n", "id")
    wild = each.select(*_keys(p, before, after), F.lit(2).alias("role"), "n", "id")
    return own.union(deleted).union(wild)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, best): for each id of (id, word, n) that has words near, how many, and the most frequent, a struct
    (minus, id) of its n negated and its id; ties go to the smaller id. A group is sorted once: role 0, then by n."""
    w = Window.partitionBy("k1", "k2").orderBy("role_first", F.col("n").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct((-F.col("n")).alias("minus"), "id", "role")
    grouped = variant_groups(vocabulary).withColumn("role_first", (F.col("role") > 0).cast("int"))
    grouped = grouped.select("id", "role", F.count("*").over(w).alias("size"), F.first(row).over(w).alias("first"), F.nth_value(row, 2).over(w).alias("second"))
    is_first = F.col("first.id") == F.col("id")
    there = (F.col("size") > 1) & ((F.col("role") == 2) | (F.col("first.role") == 0))
    count = F.when((F.col("role") == 1), F.lit(1)).otherwise(F.col("size") - 1)
    other = F.when(is_first, F.col("second")).otherwise(F.col("first"))
    given = grouped.where(there).select("id", count.alias("n_near"), F.struct(other["minus"].alias("minus"), other["id"].alias("id")).alias("best"))
    return given.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root): from each row (id, form), follow forms to the last. Reach doubles each round, until none moves."""
    reach = cut_narrow(forms.select("id", F.col("form").alias("root")))
    while True:
        further = reach.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = cut_narrow(reach.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moves")))
        reach = moved.select("id", "root")
        if moved.where("moves").isEmpty():
            return reach


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, ratio: int = 10, drop_one_in: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least min_length code points and min_count occurrences.

    n_near words differ from it by one inserted, deleted or replaced code point; form is the most frequent of them (ties:
    the smallest in code-point order) where it is at least ratio times as frequent, else null; root is where following
    forms ends, the word itself if it has none. n grows by ratio with each step, so there are no rings.

    Defined results: a null or empty text has no words; a row without doc_id counts as one with an empty id; repeated rows
    are counted as often; an empty table gives no rows; other columns of docs are not read. A text is taken apart in its
    own row; a word's work grows with the square of its length, its rows with the length.
    """
    ordered = observed_words(docs, doc_id, text, min_length, min_count, drop_one_in)
    ordered = ordered.repartitionByRange("word").sortWithinPartitions("word")
    vocabulary = cut(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = cut_narrow(near_words(vocabulary))
    far = F.col("best.minus") <= -ratio * F.col("n")
    known = vocabulary.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.id")).alias("form_id"), F.when(far, -F.col("best.minus")).alias("form_n"))
    known = cut_narrow(known)
    forms = known.where("form_id is not null").select("id", F.col("form_id").alias("form"))
    named = vocabulary.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    rooted = last_forms(forms).join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    linked = known.join(named, "form_id").join(rooted, "id")
    columns = ["word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"]
    alone = known.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return linked.select(*columns).union(alone)
