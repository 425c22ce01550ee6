"""Splitting texts into chunks. Every strategy is one array expression per document row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank.functions.text import bind, strip, tokens, words
from quillrank.session import stored

PIECE = "array<struct<text:string,start:int,end:int>>"


def _find(text: Column, needle: Column, start: Column) -> Column:
    """0-based position of needle at or after 0-based `start`; -1 when absent."""
    return F.call_function("locate", needle, text, start + 1) - 1


BLOCK = 1 << 14


def _text_blocks(text: Column) -> Column:
    """The text with its length and cut into blocks of BLOCK characters, to be searched by position."""
    return F.struct(
        text.alias("text"), F.length(text).alias("size"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
    )


def _find_near(at: Column, needle: Column, start: Column) -> Column:
    """As _find, on _text_blocks: looks in the block of `start` and the next before the whole text."""
    block = F.floor(start / BLOCK).cast("int")
    here = F.concat(F.coalesce(F.get(at["blocks"], block), F.lit("")), F.coalesce(F.get(at["blocks"], block + 1), F.lit("")))
    near = F.call_function("locate", needle, here, start - block * BLOCK + 1)
    return bind(near, lambda n: F.when(n > 0, block * BLOCK + n - 1).otherwise(_find(at["text"], needle, start)))


def _piece(text: Column, start: Column, end: Column) -> Column:
    return F.struct(
        text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end")
    )


def window_texts(text: Column, target: int, overlap: int) -> Column:
    """array<struct<text, head>>: the joined words of each window and its first word."""
    step = max(1, target - overlap)

    def build(ws: Column) -> Column:
        n = F.size(ws)
        last = F.greatest(F.ceil((n - target) / F.lit(float(step))), F.lit(0)).cast("int")
        return F.when(n == 0, F.array().cast("array<struct<text:string,head:string>>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(
                    F.array_join(F.slice(ws, i * step + 1, target), " ").alias("text"),
                    F.element_at(ws, i * step + 1).alias("head"),
                ),
            )
        )

    return bind(words(text), build)


def fixed_windows(text: Column, target: int, overlap: int) -> Column:
    """Word windows with offsets.

    An offset is the first place the window's first word occurs at or after the previous
    window's offset, also inside a longer word; the end uses the joined text's length.
    """

    def place(ws: Column, whole: Column) -> Column:
        start = F.struct(F.lit(0).alias("cursor"), F.array().cast(PIECE).alias("out"))

        def step(acc: Column, w: Column) -> Column:
            def add(found: Column) -> Column:
                at = F.greatest(found, F.lit(0))
                end = F.least(whole["size"], at + F.length(w["text"]))
                return F.struct(
                    F.greatest(acc["cursor"], at).cast("int").alias("cursor"),
                    F.concat(acc["out"], F.array(_piece(w["text"], at, end))).alias("out"),
                )

            return bind(_find_near(whole, w["head"], acc["cursor"]), add)

        return F.aggregate(ws, start, step, lambda acc: acc["out"])

    return bind(_text_blocks(text), lambda whole: bind(window_texts(text, target, overlap), lambda ws: place(ws, whole)))


def heading_parts(text: Column) -> Column:
    """Stripped non-blank parts that start at each section heading."""
    return F.filter(
        F.transform(F.split(text, K.HEADING_PATTERN), strip), lambda p: p != ""
    )


def _locate_parts(text: Column, parts: Column) -> Column:
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(PIECE).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        def add(at: Column) -> Column:
            end = at + F.length(part)
            return F.struct(
                end.cast("int").alias("cursor"),
                F.concat(acc["out"], F.array(_piece(part, at, end))).alias("out"),
            )

        return bind(_find(text, part, acc["cursor"]), add)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def boundary_starts(text: Column) -> Column:
    """Kept boundary positions: 0, then each cue more than the minimum gap after the last kept."""

    def walk(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("kept"))

        def step(acc: Column, piece: Column) -> Column:
            kept = acc["kept"]
            far = acc["at"] - F.element_at(kept, -1) > K.BOUNDARY_MIN_GAP
            return F.struct(
                (acc["at"] + F.length(piece)).alias("at"),
                F.when(far, F.concat(kept, F.array(acc["at"]))).otherwise(kept).alias("kept"),
            )

        return F.aggregate(pieces, start, step, lambda acc: acc["kept"])

    return bind(F.split(text, K.BOUNDARY_PATTERN), walk)


def boundary_parts(text: Column) -> Column:
    """Text cut at the kept boundaries, stripped, with exact offsets; blank parts dropped."""

    def cut(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.length(text)))

        def part(start: Column, end: Column) -> Column:
            def trimmed(raw: Column) -> Column:
                lead = F.length(raw) - F.length(F.ltrim(raw, F.lit(K.SPACE_CHARS)))
                bare = strip(raw)
                return _piece(bare, start + lead, start + lead + F.length(bare))

            return bind(F.substring(text, start + 1, end - start), trimmed)

        return F.filter(F.zip_with(starts, ends, part), lambda p: p["text"] != "")

    return bind(boundary_starts(text), cut)


def limit_parts(text: Column, parts: Column, target: int, overlap: int) -> Column:
    """Re-window parts with more than 1.3 x target tokens; offsets lifted to the whole text."""

    def one(part: Column, source: Column) -> Column:
        whole = F.array(_piece(part["text"], part["start"], part["start"] + F.length(part["text"])))

        def lift(w: Column) -> Column:
            head = F.get(words(w["text"]), F.lit(0))

            def at(found: Column) -> Column:
                start = F.when(found < 0, part["start"] + w["start"]).otherwise(found)
                size = F.least(F.length(w["text"]), w["end"] - w["start"])
                return _piece(w["text"], start, start + size)

            return bind(_find_near(source, head, part["start"] + w["start"]), at)

        long = F.size(tokens(part["text"])) > target * K.OVERSIZE_FACTOR
        return F.when(long, F.transform(fixed_windows(part["text"], target, overlap), lift)).otherwise(whole)

    return bind(_text_blocks(text), lambda source: F.flatten(F.transform(parts, lambda part: one(part, source))))


def chunk_array(text: Column, strategy: str) -> Column:
    """Chunks of one text under a named strategy, as array<struct<text,start,end>>."""
    if strategy not in K.STRATEGIES:
        raise ValueError(
            f"unknown chunking strategy {strategy!r}; expected one of: {', '.join(sorted(K.STRATEGIES))}"
        )
    mode, target, overlap = K.STRATEGIES[strategy]
    plain = fixed_windows(text, target, overlap)
    if mode == "fixed":
        return plain

    def by_parts(parts: Column) -> Column:
        placed = _locate_parts(text, parts)
        if mode == "heading":
            alone = plain
        else:
            placed = bind(placed, lambda p: limit_parts(text, p, target, overlap))
            alone = bind(
                boundary_parts(text),
                lambda p: F.when(F.size(p) > 1, limit_parts(text, p, target, overlap)).otherwise(plain),
            )
        return (
            F.when(F.size(parts) == 0, F.array().cast(PIECE))
            .when(F.size(parts) == 1, alone)
            .otherwise(placed)
        )

    return bind(heading_parts(text), by_parts)


def chunk_documents(
    documents: DataFrame,
    strategies: str | Sequence[str] = K.DEFAULT_STRATEGY,
    chapter: str = "chapter",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per chunk: strategy, chapter, kept columns, index, id, text, offsets.

    All strategies are computed in one pass over the documents; there is no shuffle.
    """
    names = [strategies] if isinstance(strategies, str) else list(strategies)
    body = F.col(text)
    if len(names) == 1:
        found, pieces = documents.withColumn("_s", F.lit(names[0])), chunk_array(body, names[0])
    else:
        options = F.array(
            *[F.struct(F.lit(n).alias("s"), chunk_array(body, n).alias("c")) for n in names]
        )
        found = documents.withColumn("_o", F.explode(options)).select(
            "*", F.col("_o.s").alias("_s"), F.col("_o.c").alias("_c")
        )
        pieces = F.col("_c")
    exploded = found.select(
        F.col("_s").alias("strategy"), F.col(chapter).alias("chapter"), *keep,
        F.posexplode(pieces).alias("chunk_index", "_p"),
    )
    return exploded.select(
        "strategy", "chapter", *keep, "chunk_index",
        F.concat_ws(":", F.col("chapter").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("_p.text").alias("text"),
        F.col("_p.start").alias("char_start"), F.col("_p.end").alias("char_end"),
    )


def route_subjects(chunks: DataFrame, routes: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Add subject, subjects and content_hash from a chapter dimension.

    routes: chapter, primary_subject, secondary_subjects. Unknown chapters get the default.
    """
    dim = routes.select(
        F.col("chapter").alias(chapter), F.col("primary_subject").alias("subject"),
        F.concat(F.array("primary_subject"), F.coalesce("secondary_subjects", F.array())).alias("subjects"),
    )
    return (
        chunks.join(dim, chapter, "left")
        .withColumn("subject", F.coalesce("subject", F.lit(K.DEFAULT_SUBJECT)))
        .withColumn("subjects", F.coalesce("subjects", F.array(F.lit(K.DEFAULT_SUBJECT))))
        .withColumn("content_hash", F.sha2("text", 256))
    )


def embedding_text(chapter: Column, subjects: Column, text: Column) -> Column:
    return F.concat(
        F.lit("chapter: "), chapter, F.lit("\nsubjects: "), F.array_join(subjects, ", "),
        F.lit("\n\n"), text,
    )


def evidence_preview(text: Column) -> Column:
    return F.replace(F.substring(text, 1, K.PREVIEW_CHARS), F.lit("\n"), F.lit(" "))


def evidence_sets(
    results: DataFrame, chunks: DataFrame, queries: DataFrame, query_id: str = "query_id"
) -> DataFrame:
    """One row per query: its fields and its ranked evidence as an array of structs.

    A query's array holds at most the k rows its ranking kept.
    """
    ranked = results.join(chunks, "chunk_id").select(
        query_id,
        F.struct(
            "rank", "chunk_id", "chapter", "subject", F.round("score", 3).alias("score"),
            evidence_preview(F.col("text")).alias("preview"),
        ).alias("e"),
    )
    grouped = ranked.groupBy(query_id).agg(F.sort_array(F.collect_list("e")).alias("evidence"))
    return queries.join(grouped, query_id, "left").withColumn(
        "evidence", F.coalesce("evidence", F.array())
    )


def chunk_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Per strategy: count, mean, 95th percentile, longest, and chunks over 1000 tokens."""
    from quillrank.operators.quantiles import quantiles

    sized = chunks.select("strategy", F.size(tokens(F.col(text))).alias("n_tokens")).where(
        F.col("n_tokens").isNotNull()
    )
    # Token counts repeat, so everything below works on the counts of each distinct size, and
    # texts are cut once for all of it.
    sizes = stored(sized.groupBy("strategy", "n_tokens").agg(F.count("*").alias("_times")), "sizes")
    summary = sizes.groupBy("strategy").agg(
        F.sum("_times").alias("chunks"),
        (F.sum(F.col("n_tokens") * F.col("_times")) / F.sum("_times")).alias("mean_tokens"),
        F.max("n_tokens").cast("long").alias("max_tokens"),
        F.sum(F.when(F.col("n_tokens") > 1000, F.col("_times")).otherwise(0)).alias("over_1000"),
    )
    p95 = quantiles(
        sizes, ["strategy"], "n_tokens", {"p95_tokens": ("linear", 0.95)}, times="_times"
    )
    return summary.join(p95, "strategy")
