"""Spelling variant grouping by bands of letter-parity bitmasks.

A word's mask has one bit for each letter, set where the letter occurs an odd number of times. One inserted
or deleted letter flips one bit, a replaced one two at most, so of three bands of the mask one stays equal.
One edit also leaves the half of the word before it or the half after it as it was. Words meet where a band,
the length of the shorter word and one of these halves are equal; then whole masks and lengths are held
against each other, and what is left is verified by the edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ascii_lower, stored, table

#: Fixed values of the contract: one run of letters in PERIOD loses a letter, words' least length and count, how often a form is as frequent.
PERIOD, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 31, 7, 2, 10
#: Runs below LEAST_LENGTH can't give a word; a longer run's match is the whole run.
RUN = "[A-Za-zÀ-ÿ]{7,}"
BITS, BANDS = 63, 3
BAND_MASKS = [sum(1 << i for i in range(k, BITS, BANDS)) for k in range(BANDS)]
#: Counts are longs and grow tenfold at each step, so no chain of forms has 2 ** ROUNDS steps.
ROUNDS = 5


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs after the deletions, and how often each occurs."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    run, length = F.col("run"), F.char_length("run")
    runs = runs.select("doc", ascii_lower(run).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = (F.col("h") % length).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    words = runs.select(F.when(F.col("h") % PERIOD == 0, shorter).otherwise(run).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def parity_mask(word: Column) -> Column:
    """A long with the parity of each letter's count; letters that share a bit only make masks more alike."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(bit(c))))


def _half(word: Column, short: Column, side: int) -> Column:
    """The first or last letters of a word that an edit on the other side leaves alone, for a pair whose shorter word has `short` letters."""
    h = F.floor(short / 2).cast("int")
    return F.substr(word, F.lit(1), h) if side == 0 else F.substr(word, F.char_length(word) - h + 1, h)


def _keyed(words: DataFrame, name: str, longer: tuple[int, ...]) -> DataFrame:
    """One row a word, band, half and assumed length of the shorter word; tag tells the three, key hashes band and half."""
    keys = []
    for more in longer:
        short = F.col("size") - more
        for side in (0, 1):
            for k in range(BANDS):
                own = F.xxhash64(F.col("mask").bitwiseAND(F.lit(BAND_MASKS[k])), _half(F.col("word"), short, side))
                keys.append(F.struct((short * 2 * BANDS + side * BANDS + k).cast("int").alias("tag"), own.alias("key")))
    named = [F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "size", "mask")]
    return words.select(*named, F.explode(F.array(*keys)).alias("k")).select(*named_back(name), "k.tag", "k.key")


def named_back(name: str) -> list[str]:
    return [f"{name}_{c}" for c in ("word", "n", "size", "mask")]


def near_pairs(words: DataFrame) -> DataFrame:
    """a_word, a_n, b_word, b_n: each pair of words at one edit's distance once. words has word, n, size and mask.

    A pair can meet at several keys; it counts at its first one only, so nothing needs to be made distinct.
    """
    a_word, b_word = F.col("a_word"), F.col("b_word")
    both = _keyed(words, "a", (0,)).join(_keyed(words, "b", (0, 1)), ["tag", "key"])
    longer = F.col("b_size") - F.col("a_size")
    differ = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    same_half = [_half(a_word, F.col("a_size"), s) == _half(b_word, F.col("a_size"), s) for s in (0, 1)]
    same_band = [differ.bitwiseAND(F.lit(m)) == 0 for m in BAND_MASKS]
    side = F.when(same_half[0], 0).when(same_half[1], BANDS)
    band = F.when(same_band[0], 0).when(same_band[1], 1).when(same_band[2], 2)
    # The tag names the shorter word's length; the first word has it, the second has it or one more.
    asked = (F.floor(F.col("tag") / (2 * BANDS)) == F.col("a_size")) & ((longer == 1) | ((longer == 0) & (a_word < b_word)))
    first = F.col("tag") % (2 * BANDS) == side + band
    return both.where(asked & (F.bit_count(differ) <= 2) & first & (F.levenshtein(a_word, b_word, 1) == 1)).select("a_word", "a_n", "b_word", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word of each chain of forms, for the words that have a form; each round doubles the steps taken."""
    chain = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-chain")
    for _ in range(ROUNDS):
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = stored(chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-chain")
        moved = chain.where("moved").limit(1).count()
        chain = chain.drop("moved")
        if not moved:
            break
    return chain


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs.

    Null texts have no words, a null doc_id is read as an empty one, repeated rows count each, other columns
    are ignored, an empty table gives an empty one. Ties for a form go to the word that comes first in code-point order.
    """
    words = stored(word_counts(docs).select("word", "n", F.char_length("word").alias("size"), parity_mask(F.col("word")).alias("mask")), "spelling-words")
    ends = F.explode(F.array(*[F.struct(F.col(f"{x}_word").alias("word"), F.struct((-F.col(f"{y}_n")).alias("n"), F.col(f"{y}_word").alias("form")).alias("near")) for x, y in ("ab", "ba")]))
    best = near_pairs(words).select(ends.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    joined = words.join(best, "word", "left")
    has = -F.col("near.n") >= FORM_RATIO * F.col("n")
    form, form_n = F.when(has, F.col("near.form")), F.when(has, -F.col("near.n"))
    forms = stored(joined.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 is stated by its table; near words by equal strings after the deletion of one letter.
ORACLE = r"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select coalesce(cast(doc_id as varchar), '') as d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
each_ as (select d, run, count(*) as n, hex(encode(d || ':' || run)) as hx from runs where length(run) >= 7 group by d, run),
hashed as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: cast('0x' || hx[2 * i + 1:2 * i + 2] as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from each_, crc),
made as (select case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed),
w as (select word, cast(sum(n) as bigint) as n from made where length(word) >= 7 group by word having sum(n) >= 2),
x as (select word, n, unnest(range(length(word))) as i from w),
cut as (select word, n, i, word[:i] || word[i + 2:] as rest from x),
pairs as (select a.word as a, b.word as b, b.n as bn from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select w.word, cut.word, cut.n from w join cut on w.word = cut.rest union select cut.word, w.word, w.n from w join cut on w.word = cut.rest),
ranked as (select a, b, bn, count(*) over (partition by a) as n_near, row_number() over (partition by a order by bn desc, b) as r from pairs),
f as (select w.word, case when bn >= 10 * n then b end as form, n, coalesce(n_near, 0) as n_near, case when bn >= 10 * n then bn end as form_n from w left join ranked on w.word = a and r = 1),
chain as (select word, word as root, 0 as step from f union all select chain.word, f.form, step + 1 from chain join f on f.word = chain.root where f.form is not null),
last as (select word, arg_max(root, step) as root from chain group by word)
select f.word, form, root, n, n_near, form_n from f join last on last.word = f.word
"""
