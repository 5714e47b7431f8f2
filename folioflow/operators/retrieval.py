"""Lexical retrieval of catalog entries for documents: IDF cosine, BM25, sparse semantic vectors, rank fusion.

Documents meet the catalog on tokens, so no pair without a common token is ever made. Statistics come
from the catalog only. Documents are dealt by id once, in parts of bounded size, and both lexical
scores come of one join and one aggregation there.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import STOP_WORDS, bigrams, keyword_hits, tokens

K1, B, SQUASH = 1.2, 0.75, 8.0
#: A candidate below this hybrid score isn't reported.
ABSTAIN = 0.12
#: Rank fusion: the constant beside a rank.
FUSION = 60
#: Rows up to which a side of a join is broadcast; beyond, the planner shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one task holds.
PART_BYTES = 4_000_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has `rows` rows at most."""
    return df.limit(rows + 1).count() <= rows


def measured(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast only if it has `rows` rows at most, which is counted first."""
    return F.broadcast(df) if fits(df, rows) else df


def postings(df: DataFrame, id_: str, text: str, words: Column | None = None) -> DataFrame:
    """id, token, tf: how often each token occurs in a text."""
    own = tokens(F.col(text)) if words is None else words
    return df.select(F.col(id_).alias("id"), F.explode(own).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def token_set(runs: Column) -> Column:
    """The distinct tokens among runs of ASCII letters and digits, as `tokens` has them."""
    return F.array_except(runs, F.array(*[F.lit(x) for x in (*STOP_WORDS, *string.ascii_lowercase, *string.digits)]))


def dealt(documents: DataFrame, id_: str, text: str) -> DataFrame:
    """doc_id, runs: each document's lower-case runs of two ASCII letters and digits or more, with repeats; rows of one id together.

    Documents are dealt by id once, whole, into parts of about PART_BYTES, so what a task holds doesn't grow with the
    table. All that is grouped by document keeps to that. The texts themselves are sent, since their runs take three times
    the memory of the task that deals them; texts of one id are joined by line ends, which no run crosses.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = documents.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).repartition(max(1, -(-size // PART_BYTES)), "doc_id")
    texts = rows.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return texts.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0)).alias("runs"))


def gathered(documents: DataFrame, id_: str, text: str) -> DataFrame:
    """doc_id, texts: documents dealt by id once, whole, into parts of about PART_BYTES; the texts of one id together, a null as an empty one.

    What a task holds doesn't grow with the table, and all that is grouped by document keeps to that. Several parts of a
    plan that begin with the same gathered documents share one exchange, as long as all need the same columns.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = documents.where(F.col(id_).isNotNull()).select(F.col(id_).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition(max(1, -(-size // PART_BYTES)), "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def words_of(text: Column) -> Column:
    """As `tokens`, where many texts are taken apart: stop words are looked up in a set."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda x: ~x.isin(*STOP_WORDS))


def statistics(catalog: DataFrame) -> DataFrame:
    """token, df, n, avgdl over the catalog's postings."""
    total = catalog.agg(F.countDistinct("id").alias("n"), F.sum("tf").alias("length")).select("n", (F.col("length") / F.col("n")).alias("avgdl"))
    return catalog.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(total))  # one row


def weights(catalog: DataFrame) -> DataFrame:
    """item_id, token, w2 (squared idf), bm (the token's part of BM25), cn (the item's norm), n_item (its tokens) for the catalog's postings (id, token, tf)."""
    stats = statistics(catalog)
    idf = F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1
    bm_idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    item = Window.partitionBy("id")  # an item's tokens
    norm = F.col("tf") + K1 * (1 - B + B * F.sum("tf").over(item) / F.col("avgdl"))
    df = catalog.join(stats, "token").withColumn("w2", F.pow(idf, 2)).withColumn("bm", bm_idf * F.col("tf") * (K1 + 1) / norm)
    return df.select(F.col("id").alias("item_id"), "token", "w2", "bm", F.sqrt(F.sum("w2").over(item)).alias("cn"), F.count("*").over(item).alias("n_item"))


def lexical(documents: DataFrame, id_: str, text: str, catalog: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, bm25, share for every pair with a common token; catalog has postings (id, token, tf).

    cosine is over sets of tokens weighted by idf = ln((n + 1) / (df + 1)) + 1; document tokens outside
    the catalog don't count. bm25 takes the document as a query, its counts capped at 2, and is squashed
    to 1 - exp(-score / SQUASH). share is that of `overlap`. Documents are dealt once; counts, norms and sums keep to that.
    """
    known = measured(weights(catalog))
    # The catalog's vocabulary leaves out stop words already.
    words = measured(known.select("token", "w2").distinct())
    # The size is taken before the rows are exploded, else it is taken once a token.
    rows = dealt(documents.dropna(subset=[id_]), id_, text).select("doc_id", "runs", F.size(token_set(F.col("runs"))).alias("n_own"))
    found = rows.select("doc_id", "n_own", F.explode("runs").alias("token")).join(words, "token")
    own = found.groupBy("doc_id", "token", "w2").agg(F.least(F.count("*"), F.lit(2)).alias("qtf"), F.first("n_own").alias("n_own"))
    own = own.withColumn("dn", F.sqrt(F.sum("w2").over(Window.partitionBy("doc_id"))))
    first = [F.first(c).alias(c) for c in ("dn", "cn", "n_own", "n_item")]
    both = own.join(known.drop("w2"), "token").groupBy("doc_id", "item_id").agg(F.sum("w2").alias("dot"), F.sum(F.col("bm") * F.col("qtf")).alias("s"), F.count("*").alias("n"), *first)
    share = F.round(F.col("n") / F.least("n_own", "n_item"), 6).alias("share")
    return both.select("doc_id", "item_id", F.round(F.col("dot") / (F.col("dn") * F.col("cn")), 6).alias("cosine"), F.round(1 - F.exp(-F.col("s") / SQUASH), 6).alias("bm25"), share)


def semantic_vectors(df: DataFrame, id_: str, text: str, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """id, token, w: tokens and the members of their synonym groups weigh 1, bigrams 1.35; each term once."""
    words = tokens(F.col(text))
    one = df.select(F.col(id_).alias("id"), F.explode(F.array_distinct(words)).alias("token"))
    if groups:
        pairs = [(a, b) for group in groups for a in group for b in group if a != b]
        lexicon = df.sparkSession.createDataFrame(pairs, "token string, other string")
        one = one.union(one.join(F.broadcast(lexicon), "token").select("id", "other"))
    two = df.select(F.col(id_).alias("id"), F.explode(F.array_distinct(bigrams(words))).alias("token"))
    return one.distinct().withColumn("w", F.lit(1.0)).union(two.withColumn("w", F.lit(1.35)))


def sparse_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, cosine of two tables of sparse vectors."""
    norm = lambda v, name: v.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    dot = left.select(F.col("id").alias("left_id"), "token", "w").join(right.select(F.col("id").alias("right_id"), "token", F.col("w").alias("v")), "token")
    dot = dot.groupBy("left_id", "right_id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    a, b = norm(left, "a").withColumnRenamed("id", "left_id"), norm(right, "b").withColumnRenamed("id", "right_id")
    return dot.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", F.round(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("cosine"))


def whole(c: str | Column) -> Column:
    """A score of six places as a whole number of millionths, so that a cut doesn't depend on how a sum of doubles falls."""
    return F.rint(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) * 1e6).cast("long")


def six(c: Column) -> Column:
    """c, which isn't negative, rounded to six places as SQL engines do it by a factor; F.round goes by the digits of each number, which takes far longer."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def hybrid_score() -> Column:
    """0.45 cosine + 0.55 bm25 cut to four places."""
    return F.floor((45 * whole("cosine") + 55 * whole("bm25")) / 10_000) / 10_000.0


def hybrid(scored: DataFrame, *more: str) -> DataFrame:
    """doc_id, item_id, score = 0.45 cosine + 0.55 bm25 cut to four places, from ABSTAIN on; more names further columns to keep."""
    return scored.select("doc_id", "item_id", hybrid_score().alias("score"), *more).where(F.col("score") >= ABSTAIN)


def top(df: DataFrame, by: str, k: int, key: str = "doc_id", tie: str = "item_id") -> DataFrame:
    """The k best of each key with rank; ties go to the smaller item."""
    w = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(scored: DataFrame, components: Sequence[str], depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of the score columns `components` of (doc_id, item_id, ...): rrf, the sum of 1 / (FUSION + rank)
    over the components in which a pair is positive, by the best possible sum. With depth only the best so many ranks count."""
    ranked = scored
    for c in components:
        w = Window.partitionBy("doc_id").orderBy(F.desc(c), "item_id")
        ranked = ranked.withColumn(f"__{c}", F.row_number().over(w))
    counts = lambda c: (F.col(c) > 0) & (F.lit(True) if depth is None else F.col(f"__{c}") <= depth)
    part = lambda c: F.when(counts(c), 1.0 / (FUSION + F.col(f"__{c}"))).otherwise(0.0)
    total = sum((part(c) for c in components), F.lit(0.0))
    out = ranked.withColumn("rrf", F.round(F.least(total / (len(components) / (FUSION + 1)), F.lit(1.0)), 6))
    return out.drop(*[f"__{c}" for c in components])


def diverse(ranked: DataFrame, k: int, group: str, share: float = 0.2, most: int = 4, wider: str | None = None) -> DataFrame:
    """Greedy top k of each doc_id with at most ceil(share * k) (1..most) items of a group, then the skipped ones in order.

    Of a value of wider at most twice the share (2..2 * most) is taken. k candidates or fewer stay in order.

    A fold over the ordered candidates of one document. Only those are gathered that it can choose: of one group and value of
    wider it takes the first cap at most, and of the 2 k best at least k are skipped, more than are ever asked for.
    """
    cap = max(1, min(most, -(-int(share * k * 1000) // 1000)))
    wide = max(2, min(2 * most, -(-int(2 * share * k * 1000) // 1000))) if wider else k
    named = ranked.select("doc_id", "rank", "item_id", F.col(group).cast("string").alias("g"), (F.col(wider) if wider else F.lit(None)).cast("string").alias("w"))
    alike = F.row_number().over(Window.partitionBy("doc_id", "g", "w").orderBy("rank", "item_id"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "item_id"))
    few = named.withColumns({"__m": first, "__n": alike}).where((F.col("__n") <= min(cap, wide)) | (F.col("__m") <= 2 * k))
    rows = few.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "g", "w"))).alias("c"))
    kind = "array<struct<rank:int,item_id:bigint,g:string,w:string>>"
    start = F.struct(F.array().cast(kind).alias("take"), F.array().cast(kind).alias("skip"))
    held = lambda a, x, of: F.size(F.filter(a["take"], lambda t: t[of].eqNullSafe(x[of])))
    fits = lambda a, x: (F.size(a["take"]) < k) & (held(a, x, "g") < cap) & (held(a, x, "w") < wide)
    add = lambda a, x: F.array_append(a, x)
    folded = F.aggregate(
        F.col("c").cast(kind),
        start,
        # At most k skipped ones are ever asked for.
        lambda a, x: F.when(fits(a, x), F.struct(add(a["take"], x).alias("take"), a["skip"].alias("skip"))).when(F.size(a["skip"]) < k, F.struct(a["take"].alias("take"), add(a["skip"], x).alias("skip"))).otherwise(a),
    )
    chosen = rows.select("doc_id", "c", folded.alias("f"))
    chosen = chosen.select("doc_id", F.when(F.size("c") <= k, F.col("c").cast(kind)).otherwise(F.slice(F.concat("f.take", "f.skip"), 1, k)).alias("c"))
    return chosen.select("doc_id", F.posexplode("c").alias("place", "x")).select("doc_id", (F.col("place") + 1).alias("place"), F.col("x.item_id").alias("item_id"))


def overlap(documents: DataFrame, id_: str, text: str, catalog: DataFrame) -> DataFrame:
    """doc_id, item_id, n_common, share of the smaller token set, for pairs with a common token; catalog has postings (id, token)."""
    items = measured(catalog.select(F.col("id").alias("item_id"), "token", F.count("*").over(Window.partitionBy("id")).alias("n_item")))
    own = dealt(documents.dropna(subset=[id_]), id_, text).select("doc_id", token_set(F.col("runs")).alias("t")).select("doc_id", "t", F.size("t").alias("n_own")).select("doc_id", "n_own", F.explode("t").alias("token"))
    both = own.join(items, "token").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_common"), F.first("n_own").alias("n_own"), F.first("n_item").alias("n_item"))
    return both.select("doc_id", "item_id", "n_common", F.round(F.col("n_common") / F.least("n_own", "n_item"), 6).alias("share"))


def bonus(n: Column, each: float, most: float) -> Column:
    """A field's bonus: `each` for every common token, `most` at most."""
    return F.round(F.least(F.lit(most), n * each), 6)


def phrase_bonus(text: Column, phrase: Column, least: int = 12, points: float = 0.25) -> Column:
    """Points where the text holds the whole phrase, case aside, and that is long enough."""
    low = F.lower(F.trim(F.coalesce(phrase, F.lit(""))))
    return F.when((F.length(low) >= least) & (F.instr(F.lower(F.coalesce(text, F.lit(""))), low) > 0), points).otherwise(0.0)


def feedback_bonus(terms: DataFrame, learned: DataFrame, most: float = 0.18) -> DataFrame:
    """doc_id, bonus for documents whose terms (doc_id, token) are among the learned (term_hash, precision): hashes only are compared."""
    hits = terms.select("doc_id", F.sha2("token", 256).alias("term_hash")).join(measured(learned), "term_hash").distinct()
    return hits.groupBy("doc_id").agg(F.round(F.least(F.lit(most), F.sum(0.08 + F.col("precision") * 0.06)), 6).alias("bonus"))


def context_scores(df: DataFrame, id_: str, text: Column, classes: Mapping[str, Sequence[str]], most: float = 0.35) -> DataFrame:
    """id, context, score: hits of each class's keywords against those of the best class; classes without hits are left out."""
    hits = F.array(*[F.struct(F.lit(name).alias("context"), F.size(keyword_hits(text, words)).alias("n")) for name, words in classes.items()])
    rows = df.select(id_, hits.alias("h")).withColumn("best", F.array_max(F.transform("h", lambda x: x["n"])))
    rows = rows.select(id_, "best", F.explode("h").alias("x")).where(F.col("x.n") > 0)
    return rows.select(id_, "x.context", F.round(F.least(F.lit(most), F.col("x.n") / F.col("best") * most), 4).alias("score"))


def topic(text: Column, topics: Mapping[str, Sequence[str]]) -> Column:
    """The topic with most keyword hits, the first named of equals, null without hits; keywords of four letters or fewer must stand alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda w: low.rlike(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)") if len(w) <= 4 else F.instr(low, w) > 0
    scored = [F.struct(sum((hit(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(topics.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"])


def with_terms(df: DataFrame, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """df, whose t are a text's tokens, with base (each once), own (these, then the members of their synonym groups that aren't among them), two (each bigram once) and
    norm2, the square of the norm of their sparse semantic vector, in which own weigh 1 and two 1.35."""
    df = df.withColumn("base", F.array_distinct("t"))
    if groups:
        pairs = F.create_map(*[x for g in _synonyms(groups).items() for x in (F.lit(g[0]), F.array(*[F.lit(o) for o in g[1]]))])
        more = F.flatten(F.transform("base", lambda x: F.coalesce(F.try_element_at(pairs, x), F.array().cast("array<string>"))))
        df = df.withColumn("own", F.array_distinct(F.concat("base", more)))
    else:
        df = df.withColumn("own", F.col("base"))
    df = df.withColumn("two", F.array_distinct(bigrams(F.col("t"))))
    return df.withColumn("norm2", F.size("own") + 1.35 * 1.35 * F.size("two"))


def _synonyms(groups: Sequence[Sequence[str]]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for g in groups:
        for a in g:
            found[a] = sorted({*found.get(a, []), *(b for b in g if b != a)})
    return found


#: Points for each common token of a field and their bound.
FIELDS = {"description": (0.035, 0.18), "hint": (0.06, 0.24), "hierarchy": (0.04, 0.16)}
#: Hundredths of each part of the full score, and of a shortlist beside it.
PARTS = {"bm25": 30, "cosine": 25, "semantic": 30, "rrf": 15}
LOCAL, SHORTLIST = 65, 35


def item_terms(items: DataFrame, fields: DataFrame, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """item_id, token, w2, bm, v, one column for each of FIELDS and n for every term of the catalog.

    items has item_id, text; fields item_id, field, text. Terms are tokens, synonyms and bigrams. w2 and bm are those of `weights`, v is
    the weight in the sparse semantic vector, a field's column and n count the item's rows whose field or text has the token.
    """
    rows = items.select("item_id", tokens(F.col("text")).alias("t"))
    lexical_ = weights(postings(items, "item_id", "text")).select("item_id", "token", "w2", "bm")
    term = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("token"), F.lit(w).alias("w")))
    vectors = with_terms(rows, groups).select("item_id", F.inline(F.concat(term("own", 1.0), term("two", 1.35)))).groupBy("item_id", "token").agg(F.sum("w").alias("v"))
    held = fields.select("item_id", "field", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    held = held.groupBy("item_id", "token").agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f) for f in FIELDS])
    n = rows.select("item_id", F.explode(F.array_distinct("t")).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("n"))
    both = vectors
    for other in (lexical_, held, n):
        both = both.join(other, ["item_id", "token"], "left")
    return both.where("item_id is not null").na.fill(0)


def item_norms(items: DataFrame, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """item_id, cn and sn: the norms of an item's terms weighted as `weights` does and of its sparse semantic vector."""
    rows = items.select("item_id", tokens(F.col("text")).alias("t"))
    semantic_ = with_terms(rows, groups).groupBy("item_id").agg(F.sqrt(F.sum("norm2")).alias("sn"))
    return semantic_.join(weights(postings(items, "item_id", "text")).select("item_id", "cn").distinct(), "item_id", "left")


def asked(items: DataFrame, least: int = 12) -> DataFrame:
    """item_id, phrase, n, token for each different text that is long enough as a phrase; items has item_id, text, n counts equal rows.

    A text that holds a phrase, case aside, has the phrase's tokens next to each other, but for the first and the last, which may be parts of
    longer words there. So it has the token given here, the rarest of the phrase's inner bigrams, null if there is none.
    """
    phrase = F.trim(F.coalesce("text", F.lit("")))
    low = items.where(F.length(phrase) >= least).groupBy("item_id", F.lower(phrase).alias("phrase")).agg(F.count("*").alias("n"))
    inner = tokens(F.regexp_extract("phrase", "(?s)^[^a-z0-9]*[a-z0-9]+(.*[^a-z0-9])[a-z0-9]+[^a-z0-9]*$", 1))
    pairs = low.withColumn("t", inner).select("item_id", "phrase", "n", F.explode_outer(F.array_distinct(bigrams(F.col("t")))).alias("token"))
    rare = F.struct(F.count("*").over(Window.partitionBy("token")).alias("df"), "token")
    return pairs.withColumn("rare", rare).groupBy("item_id", "phrase", "n").agg(F.min("rare")["token"].alias("token"))


def held(pairs: DataFrame, texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """pairs (doc_id, item_id, may, ...) with held, the number of the document's texts that hold the item's phrase, times its equal rows.

    phrases are those of `asked`; texts are read for pairs that may hold one only, and no pair carries a text on.
    """
    own = phrases.groupBy("item_id").agg(F.collect_list(F.struct("phrase", "n")).alias("phrases"))
    both = pairs.join(texts.select(F.col("doc_id").alias("id"), "texts"), (F.col("doc_id") == F.col("id")) & F.col("may"), "left")
    both = both.join(measured(own.withColumnRenamed("item_id", "own")), (F.col("item_id") == F.col("own")) & F.col("may"), "left")
    with_ = lambda p: F.size(F.filter("texts", lambda x: F.instr(F.lower(x), p["phrase"]) > 0)) * p["n"]
    n = F.aggregate("phrases", F.lit(0).cast("long"), lambda a, p: a + with_(p))
    return both.withColumn("held", F.when(F.col("may") & F.col("phrases").isNotNull(), n).otherwise(0).cast("int")).drop("may", "id", "texts", "own", "phrases")


def full_scores(texts: DataFrame, items: DataFrame, terms: DataFrame, few: bool, about: Sequence[str], groups: Sequence[Sequence[str]] = (), most: float = 0.18) -> DataFrame:
    """doc_id, item_id, cosine, bm25, semantic, fields, feedback, asked and the columns `about` of every pair with a common term.

    texts are gathered documents with columns `about`, items has item_id, text, terms is `item_terms` with points (a learned term's, else 0) and
    asked (whether a phrase asks for it, else 0); few: they may be broadcast. cosine and bm25 are those of `lexical`, semantic the cosine of the sparse semantic vectors, whose terms
    outside the catalog count for the norm alone, fields and feedback the bonuses of common tokens by field and of learned ones.

    A document's terms meet the catalog's in one join and one aggregation, for which nothing but the texts was dealt.
    """
    known = F.broadcast(terms) if few else terms
    words = terms.select("token", "w2").groupBy("token").agg(F.max("w2").alias("w2")).union(texts.sparkSession.createDataFrame([("", 0.0)], "token string, w2 double"))
    rows = with_terms(texts.select("doc_id", *about, F.explode("texts").alias("text")).select("doc_id", *about, words_of(F.col("text")).alias("t")), groups)
    # tf: a token occurs, has: a text has the token, w: a term's semantic weight; the empty term carries the text's norm.
    term = lambda x, tf, has, w, norm2=0.0: F.struct(x.alias("token"), F.lit(tf).alias("tf"), F.lit(has).alias("has"), F.lit(w).alias("w"), F.lit(norm2).alias("norm2"))
    owned = F.transform("own", lambda x, i: term(x, 0, (i < F.size("base")).cast("int"), 1.0))
    parts = [F.transform("t", lambda x: term(x, 1, 0, 0.0)), owned, F.transform("two", lambda x: term(x, 0, 0, 1.35)), F.array(term(F.lit(""), 0, 0, 0.0, F.col("norm2").cast("double")))]
    found = rows.select("doc_id", *about, F.inline(F.concat(*parts))).join(F.broadcast(words) if few else words, "token")
    found = found.groupBy("doc_id", *about, "token", "w2").agg(*[F.sum(c).alias(c) for c in ("tf", "has", "w", "norm2")])
    # Synonyms that the text itself lacks have no part in the lexical scores.
    found = found.withColumns({"w2": F.when(F.col("tf") > 0, F.col("w2")).otherwise(0.0), "tf": F.least("tf", F.lit(2))})
    own = Window.partitionBy("doc_id")
    found = found.withColumns({"dn": F.sqrt(F.sum("w2").over(own)), "dsn": F.sqrt(F.sum("norm2").over(own))}).drop("norm2").where("token != ''")
    pairs = found.join(known.withColumnRenamed("w2", "both"), "token")
    # An item that has a term as a synonym only has no weight for it.
    sums = {"dot": F.when(F.col("tf") > 0, F.col("both")).otherwise(0.0), "s": F.col("bm") * F.col("tf"), "sem": F.col("w") * F.col("v"), "feedback": F.col("points") * F.col("has"), "asked": F.col("asked")}
    sums |= {f: F.col(f) * F.col("has") for f in FIELDS}
    pairs = pairs.groupBy("doc_id", *about, "dn", "dsn", "item_id").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    pairs = pairs.join(measured(item_norms(items, groups)), "item_id")
    points = sum((F.least(F.lit(bound), F.col(f) * each) for f, (each, bound) in FIELDS.items()), F.lit(0.0))
    return pairs.select(
        "doc_id", "item_id", *about,
        six(F.coalesce(F.try_divide(F.col("dot"), F.col("dn") * F.col("cn")), F.lit(0.0))).alias("cosine"),
        six(1 - F.exp(-F.col("s") / SQUASH)).alias("bm25"),
        six(F.col("sem") / (F.col("dsn") * F.col("sn"))).alias("semantic"),
        points.alias("fields"),
        six(F.least(F.lit(most), F.col("feedback"))).alias("feedback"),
        "asked",
    )


def intent(text: Column, rules: Sequence[tuple[str, str, float]], item: Column, least: float = -0.35, most: float = 0.55) -> Column:
    """Sum of the adjustments of the rules (pattern of the query, pattern of the item, points) that both sides match, clamped."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    total = F.lit(0.0)
    for q, i, points in rules:
        total = total + F.when(low(text).rlike(q) & low(item).rlike(i), points).otherwise(0.0)
    return F.round(F.greatest(F.lit(least), F.least(F.lit(most), total)), 6)


def blended(fused: DataFrame) -> DataFrame:
    """doc_id, item_id, score of every candidate from ABSTAIN on.

    fused has bm25, cosine, semantic and rrf, whose blend and `bonus` make the local score, at most 1; relevance is
    what a shortlist says of the pair, it is blended in where the column is there. Nulls count as 0, scores are cut to four places.
    """
    local = sum((w * whole(c) for c, w in PARTS.items()), F.lit(0)) / 100 + whole("bonus")
    local = F.greatest(F.lit(-1e6), F.least(F.lit(1e6), local))
    if "relevance" in fused.columns:
        local = (LOCAL * local + SHORTLIST * whole("relevance")) / 100
    score = F.floor(local / 100 + 1e-6) / 10_000.0
    return fused.select("doc_id", "item_id", score.alias("score")).where(F.col("score") >= ABSTAIN)


def accepted(terms: DataFrame, key: str, vocabulary: DataFrame, synonyms: Sequence[Sequence[str]] = (), most: int = 6) -> DataFrame:
    """key, token of expansion terms (key, place, token) that the catalog's vocabulary or a synonym group has; each once, the first `most` of a key."""
    known = vocabulary.select("token").distinct()
    words = sorted({w for g in synonyms for w in g})
    if words:
        known = known.union(vocabulary.sparkSession.createDataFrame([(w,) for w in words], "token string")).distinct()
    once = terms.groupBy(key, F.lower("token").alias("token")).agg(F.min("place").alias("place")).join(measured(known), "token", "left_semi")
    w = Window.partitionBy(key).orderBy("place", "token")
    return once.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select(key, "token")


def shortlisted(proposals: DataFrame, key: str, catalog: DataFrame, item: str, most: int = 8) -> DataFrame:
    """proposals (key, place, item, relevance) whose item is in the catalog; an item once, at its first place, the first `most` of a key; relevance clamped to 0..1."""
    real = proposals.join(measured(catalog.select(item).distinct()), item, "left_semi")
    once = real.groupBy(key, item).agg(F.min(F.struct("place", "relevance")).alias("x")).select(key, item, "x.place", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.relevance", F.lit(0.0)))).alias("relevance"))
    w = Window.partitionBy(key).orderBy("place", item)
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("place")


def merged(local: DataFrame, model: DataFrame, key: str, item: str) -> DataFrame:
    """key, item, score, origin: local candidates (key, item, score) with a model's; where both have one the mean counts, a model's alone counts half."""
    a, b = local.select(key, item, F.col("score").alias("a")), model.select(key, item, F.col("score").alias("b"))
    origin = F.when(F.col("a").isNull(), "model").when(F.col("b").isNull(), "local").otherwise("both")
    score = F.when(F.col("a").isNull(), F.col("b") / 2).when(F.col("b").isNull(), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    return a.join(b, [key, item], "full").select(key, item, F.round(score, 6).alias("score"), origin.alias("origin"))


#: Fixed values of the earlier ranking: least number of query tokens that overlap is shared by, and bonuses for names, sections and descriptions.
LEAST_TOKENS, NAME_POINTS, SECTION_POINTS, DESCRIPTION_POINTS = 5, 0.12, 0.10, 0.12


def earlier_score(documents: DataFrame, id_: str, text: str, name: str, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, reasons of the earlier ranking; items has item_id, code, section, text.

    Tokens of three letters or more; their overlap over the document's tokens, plus bonuses where the document's
    name holds the code or its tokens meet those of the section or the text; at most 1. Reasons name the bonuses, three at most.
    """
    own = documents.select(F.col(id_).alias("doc_id"), F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias("name"), F.array_distinct(tokens(F.col(text), 3)).alias("t"))
    parts = lambda c: F.array_distinct(tokens(F.col(c), 3))
    terms = items.select("item_id", "code", parts("section").alias("s"), parts("text").alias("x")).withColumn("token", F.explode(F.array_distinct(F.concat("s", "x"))))
    terms = terms.select("item_id", "code", "token", F.array_contains("s", F.col("token")).alias("in_section"), F.array_contains("x", F.col("token")).alias("in_text"))
    hits = own.select("doc_id", "name", F.size("t").alias("n_query"), F.explode("t").alias("token")).join(measured(terms), "token")
    df = hits.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n"), F.first("n_query").alias("n_query"), F.first("name").alias("name"), F.first("code").alias("code"), F.bool_or("in_section").alias("in_section"), F.bool_or("in_text").alias("in_text")
    )
    named = (F.length("code") > 0) & (F.instr(F.col("name"), F.lower("code")) > 0)
    bonus_ = F.when(named, NAME_POINTS).otherwise(0.0) + F.when(F.col("in_section"), SECTION_POINTS).otherwise(0.0) + F.when(F.col("in_text"), DESCRIPTION_POINTS).otherwise(0.0)
    score = F.floor(F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("n_query"), F.lit(LEAST_TOKENS)) + bonus_) * 10_000 + 1e-6) / 10_000.0
    reasons = F.slice(F.array_compact(F.array(F.when(named, F.lit("name")), F.when(F.col("in_section"), F.lit("section")), F.when(F.col("in_text"), F.lit("text")), F.when(F.col("n") >= 5, F.lit("many tokens")))), 1, 3)
    return df.select("doc_id", "item_id", score.alias("score"), reasons.alias("reasons"))
