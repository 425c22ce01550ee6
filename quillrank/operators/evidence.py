"""Evidence terms, query wording and supporting sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank import scale
from quillrank.functions.text import bind, content_tokens, normalize_numbers, strip, token_text, tokens


def term_coverage(results: DataFrame, texts: DataFrame, cases: DataFrame) -> DataFrame:
    """Best evidence chunk per case and the share of the case's terms it holds.

    Candidates are results from an expected chapter, or the first result when there is
    none. results: query_id, chunk_id, chapter, rank. texts: chunk_id, text. cases:
    query_id, expected (array), terms (array).
    """
    near = results.join(cases, "query_id").withColumn("_exp", F.array_contains("expected", F.col("chapter")))
    any_expected = near.groupBy("query_id").agg(F.max("_exp").alias("_any"))
    chosen = near.join(any_expected, "query_id").where(
        F.col("_exp") | (~F.col("_any") & (F.col("rank") == 1))
    )
    body = normalize_numbers(F.col("text"))
    scored = (
        chosen.join(texts, "chunk_id").withColumn("_body", body)
        .withColumn(
            "present",
            F.size(F.filter("terms", lambda t: F.contains(F.col("_body"), normalize_numbers(t)))),
        )
    )
    best = scored.groupBy("query_id").agg(
        F.max_by(F.struct("chunk_id", "chapter", "present"), F.struct(F.col("present"), -F.col("rank"))).alias("b")
    )
    total = F.size("terms")
    return cases.join(best, "query_id", "left").select(
        "query_id", F.col("b.chunk_id").alias("evidence_chunk"), F.col("b.chapter").alias("evidence_chapter"),
        total.alias("terms_total"), F.coalesce("b.present", F.lit(0)).alias("terms_present"),
        F.when(total > 0, F.round(F.coalesce("b.present", F.lit(0)) / total, 4)).otherwise(0.0).alias("coverage"),
    )


def coverage_summary(coverage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return coverage.groupBy(*by).agg(
        F.count("*").alias("cases"), F.avg("coverage").alias("avg_coverage"),
        F.avg((F.col("coverage") == 1.0).cast("double")).alias("full_coverage"),
        F.min("coverage").alias("min_coverage"),
    )


def audit_terms(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Per (case, term): absent from the expected chapters, chapters that hold it, generic.

    cases: query_id, expected (array of chapters), terms (array). documents: chapter, text.
    Each chapter is tested where it is read. A term may also cross from one chapter to the next,
    so of a chapter only its ends, as long as the case's longest term, are joined in order.
    """
    needles = F.transform("terms", token_text)
    longest = F.coalesce(F.array_max(F.transform(needles, F.length)), F.lit(0))
    wanted = cases.select("query_id", "terms", longest.alias("_l"), F.posexplode("expected").alias("_at", "chapter"))
    # Only documents that some case expects are read.
    found = documents.join(wanted, "chapter").withColumn("_t", token_text(F.col("text")))
    held = F.filter("terms", lambda t: (token_text(t) != "") & F.contains(F.col("_t"), token_text(t)))
    ends = F.when(F.length("_t") <= 2 * F.col("_l"), F.col("_t")).otherwise(
        F.concat(F.left("_t", F.col("_l")), F.lit("\x00"), F.right("_t", F.col("_l")))
    )
    parts = found.select("query_id", held.alias("_held"), F.struct("_at", ends.alias("t")).alias("p")).groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list("_held"))).alias("_held"),
        F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), " ").alias("_ends"),
    )
    asked = cases.select("query_id", F.explode("terms").alias("term"))
    needle = token_text(F.col("term"))
    crosses = (needle != "") & F.contains(F.coalesce("_ends", F.lit("")), needle)
    inside = F.coalesce(F.array_contains("_held", F.col("term")), F.lit(False))
    absent = (
        cases.join(parts, "query_id", "left").select("query_id", F.explode("terms").alias("term"), "_held", "_ends")
        .select("query_id", "term", (~(inside | crosses)).alias("absent"))
    )
    counts = chapters_with_all_tokens(asked.select("term").distinct(), documents)
    listed = F.array(*[F.lit(t) for t in K.GENERIC_TERMS])
    distinct_tokens = F.array_distinct(tokens(F.col("term")))
    single = (F.size(distinct_tokens) == 1) & F.array_contains(listed, F.try_element_at(distinct_tokens, F.lit(1)))
    return absent.join(counts, "term", "left").withColumn(
        "chapter_count", F.coalesce("chapter_count", F.lit(0))
    ).withColumn(
        "generic",
        (F.col("chapter_count") >= K.GENERIC_CHAPTER_COUNT) | F.coalesce(single, F.lit(False)),
    )


def chapters_with_all_tokens(terms: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, chapter_count): chapters whose token set holds every token of the term."""
    parts = terms.select("term", F.array_distinct(tokens(F.col("term"))).alias("_t")).select(
        "term", F.size("_t").alias("_need"), F.explode("_t").alias("token")
    )
    held = documents.select(
        "chapter", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")
    )
    met = scale.join_sized(held, parts, ["token"])
    full = met.groupBy("term", "chapter", "_need").agg(F.count("*").alias("_got")).where(
        F.col("_got") == F.col("_need")
    )
    return full.groupBy("term").agg(F.count("*").alias("chapter_count"))


GRAM = 4
GRAM_SLOTS = 1 << 16


def _grams(chars: Column, size: Column) -> Column:
    """Distinct runs of `size` neighbouring characters."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(chars) - size + 1), lambda i: F.array_join(F.slice(chars, i, size), "")
    )
    return F.array_distinct(runs)


def _key_grams(phrases: DataFrame, phrase: str) -> DataFrame:
    """(_phrase, _g, _gram): of each phrase the gram that the fewest phrases hold; GRAM characters, or the whole phrase."""
    text = F.col("_phrase")
    own = phrases.where(F.length(phrase) > 0).select(F.col(phrase).alias("_phrase")).distinct()
    held = own.select("_phrase", F.least(F.length(text), F.lit(GRAM)).cast("int").alias("_g")).select(
        "_phrase", "_g", F.explode(bind(F.split(text, ""), lambda chars: _grams(chars, F.col("_g")))).alias("_gram")
    )
    shared = held.groupBy("_g", "_gram").agg(F.count("*").alias("_n"))
    return scale.join_sized(held, shared, ["_g", "_gram"], bound=phrases).groupBy("_phrase", "_g").agg(
        F.min(F.struct("_n", "_gram")).alias("_m")
    ).select("_phrase", "_g", F.col("_m._gram").alias("_gram"))


def _gram_slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_SLOTS)).cast("int")


def _gram_bits(grams: DataFrame) -> DataFrame:
    """One row: the grams' slots as bits of GRAM_SLOTS / 64 numbers, of the same size for any number of grams."""
    slot = _gram_slot(F.col("_gram"))
    bits = grams.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63)).alias("b"))
    entries = F.map_from_entries(F.collect_list(F.struct("w", "v")))
    return bits.groupBy("w").agg(F.bit_or("b").alias("v")).agg(entries.alias("m")).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(GRAM_SLOTS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
        ).alias("bits")
    )


def phrases_in(texts: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Pairs (key, phrase) where the phrase occurs anywhere in the text, also inside words.

    Texts and phrases meet on one gram of the phrase, the one that the fewest phrases hold, then the
    whole phrase is checked. A text's grams are tested in the row against the bits of all those
    grams, so that only candidates become rows.
    """
    keys = _key_grams(phrases, phrase)
    # Texts are cut only to the lengths that some phrase's gram has, at most GRAM of them.
    lengths_used = keys.agg(F.collect_set("_g").alias("g")).scalar()
    cut = texts.select(
        key, F.col(text).alias("_text"), _gram_bits(keys).scalar().alias("_bits"),
        F.explode(F.concat(lengths_used, F.array().cast("array<int>"))).alias("_g"),
    ).where(F.length("_text") >= F.col("_g"))

    def known(gram: Column) -> Column:
        return bind(_gram_slot(gram), lambda slot: F.getbit(F.get("_bits", F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1)

    # A gram carries the key only; the text is fetched again for candidates.
    grams = cut.select(
        key, "_g",
        F.explode(F.filter(bind(F.split("_text", ""), lambda chars: _grams(chars, F.col("_g"))), known)).alias("_gram"),
    )
    met = scale.join_sized(grams, keys, ["_g", "_gram"], bound=phrases).select(key, "_phrase").distinct()
    checked = met.join(texts.select(key, F.col(text).alias("_text")), key)
    return checked.where(F.contains("_text", F.col("_phrase"))).select(key, F.col("_phrase").alias("phrase")).distinct()


def query_realism(queries: DataFrame, chapters: DataFrame) -> DataFrame:
    """How much a query gives away the chapter names.

    queries: query_id, query, query_type, candidates (array of chapters). chapters: chapter.
    Overlap is the share of a name's distinct tokens found in the query. With no overlap at
    all the best chapter is the first by name.
    """
    spoken = F.replace(F.col("chapter"), F.lit("-"), F.lit(" "))
    names = chapters.select("chapter", token_text(spoken).alias("phrase"), F.array_distinct(tokens(spoken)).alias("_t"))
    parts = names.select("chapter", F.size("_t").alias("_n"), F.explode("_t").alias("token"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    overlap = (
        scale.join_sized(asked, parts, ["token"])
        .groupBy("query_id", "chapter", "_n").agg((F.count("*") / F.col("_n")).alias("overlap"))
    )
    best = overlap.groupBy("query_id").agg(
        F.min(F.struct((-F.col("overlap")).alias("o"), F.col("chapter"))).alias("_b")
    )
    texts = queries.select("query_id", token_text(F.col("query")).alias("_q"))
    hits = phrases_in(texts, names.select("phrase"), "query_id", "_q", "phrase").join(
        names.select("phrase", "chapter"), "phrase"
    )
    counted = hits.groupBy("query_id").agg(F.count("*").alias("phrase_hits"))
    candidates = queries.select("query_id", F.explode("candidates").alias("chapter")).distinct()
    near = candidates.join(overlap, ["query_id", "chapter"]).groupBy("query_id").agg(
        F.max("overlap").alias("candidate_overlap")
    )
    named = candidates.join(hits, ["query_id", "chapter"], "left_semi").groupBy("query_id").agg(
        F.count("*").alias("candidate_hits")
    )
    first = names.agg(F.min("chapter").alias("c"))
    return (
        queries.select("query_id", "query_type").join(best, "query_id", "left").join(counted, "query_id", "left")
        .join(near, "query_id", "left").join(named, "query_id", "left")
        .select(
            "query_id", "query_type",
            F.coalesce("_b.chapter", first.scalar()).alias("best_chapter"),
            F.coalesce(-F.col("_b.o"), F.lit(0.0)).alias("best_overlap"),
            F.coalesce("phrase_hits", F.lit(0)).alias("phrase_hits"),
            F.coalesce("candidate_overlap", F.lit(0.0)).alias("candidate_overlap"),
            F.coalesce("candidate_hits", F.lit(0)).alias("candidate_hits"),
        )
    )


def realism_summary(rows: DataFrame, by: tuple[str, ...] = ("query_type",)) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("queries"), F.avg("best_overlap").alias("avg_best_overlap"),
        F.avg("candidate_overlap").alias("avg_candidate_overlap"),
        F.avg((F.col("phrase_hits") > 0).cast("double")).alias("phrase_hit_rate"),
        F.avg((F.col("candidate_hits") > 0).cast("double")).alias("candidate_hit_rate"),
    )


def support_sentences(
    pairs: DataFrame, claim: str = "claim", passage: str = "passage",
    keys: tuple[str, ...] = ("claim_id", "chunk_id"), limit: int = 2, min_chars: int = 24,
) -> DataFrame:
    """Best sentences of each passage for its claim: overlap share, then overlap, then order."""
    split = F.split(F.col(passage), K.SENTENCE_BREAK)
    rows = pairs.withColumn("_want", content_tokens(F.col(claim))).where(F.size("_want") > 0).select(
        *keys, "_want", F.posexplode(split).alias("position", "_s")
    )
    rows = rows.withColumn("sentence", strip(F.col("_s"))).where(F.length("sentence") >= min_chars)
    shared = F.size(F.array_intersect("_want", content_tokens(F.col("sentence"))))
    rows = rows.withColumn("overlap", shared).where(F.col("overlap") > 0).withColumn(
        "share", F.col("overlap") / F.greatest(F.lit(1), F.size("_want"))
    )
    order: list[Column] = [F.col("share").desc(), F.col("overlap").desc(), F.col("position").asc()]
    return scale.top_k(rows, list(keys), order, limit).select(
        *keys, "sentence", "position", "overlap", "share", "rank"
    )
