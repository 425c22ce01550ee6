"""Queries on chunking and text functions.

Stand-ins: a chapter is a doc_id; section headings are put at line breaks, and cue phrases
after sentence ends, since the tables hold neither.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.operators import chunking as C
from quillrank.operators import labels as J
from quillrank.plans.registry import SPACES, query, sql_tokens, sql_words, table


def sql_strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^{SPACES}+', ''), '{SPACES}+$', '')"


def sql_windows(docs: str, target: int, overlap: int) -> str:
    """CTEs ending in `win(id, text, i, body, head)` over `docs(id, text)`."""
    step = max(1, target - overlap)
    return f"""
    wl AS (SELECT id, text, {sql_words('text')} AS w FROM ({docs})),
    win AS (
      SELECT id, text, i, array_to_string(w[i*{step}+1 : i*{step}+{target}], ' ') AS body, w[i*{step}+1] AS head
      FROM (SELECT id, text, w, unnest(range(0, greatest(ceil((len(w)-{target})/{float(step)})::BIGINT, 0) + 1)) AS i
            FROM wl WHERE len(w) > 0))"""


SQL_OFFSETS = """
    pos AS (
      SELECT id, i, greatest(strpos(text, head) - 1, 0) AS loc FROM win WHERE i = 0
      UNION ALL
      SELECT w.id, w.i, CASE WHEN strpos(substr(w.text, p.loc + 1), w.head) = 0 THEN 0
                        ELSE strpos(substr(w.text, p.loc + 1), w.head) - 1 + p.loc END
      FROM pos p JOIN win w ON w.id = p.id AND w.i = p.i + 1)"""

DOCS = "SELECT doc_id AS id, text FROM documents"
HEADED = r"'## [§0] ' || replace(text, chr(10), chr(10) || '## [§n] ')"


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), "text")


def headed(spark, sf):
    body = F.concat(F.lit("## [§0] "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## [§n] ")))
    return documents(spark, sf).withColumn("text", body)


def cued(spark, sf):
    return documents(spark, sf).withColumn("text", F.replace(F.col("text"), F.lit(". "), F.lit(". Second, ")))


@query("C1_tokenize", f"""
    SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)""")
def c1(spark, sf):
    return documents(spark, sf).withColumn("t", X.tokens(F.col("text"))).select(
        F.col("chapter").alias("doc_id"), F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


@query("C2_fixed_windows", f"""
    WITH {sql_windows(DOCS, 300, 50)}
    SELECT id AS doc_id, i::INTEGER AS chunk_index, md5(body) AS text_md5 FROM win""")
def c2(spark, sf):
    win = documents(spark, sf).select("chapter", F.posexplode(C.window_texts(F.col("text"), 300, 50)).alias("i", "w"))
    return win.select(
        F.col("chapter").alias("doc_id"), F.col("i").alias("chunk_index"), F.md5("w.text").alias("text_md5")
    )


@query("C3_window_offsets", f"""
    WITH RECURSIVE {sql_windows(DOCS, 300, 50)}, {SQL_OFFSETS}
    SELECT w.id AS doc_id, w.i::INTEGER AS chunk_index, p.loc::INTEGER AS char_start,
           least(length(w.text), p.loc + length(w.body))::INTEGER AS char_end
    FROM win w JOIN pos p USING (id, i)""")
def c3(spark, sf):
    return C.chunk_documents(documents(spark, sf), "fixed-300").select(
        F.col("chapter").alias("doc_id"), "chunk_index", "char_start", "char_end"
    )


HEAD_PARTS = f"""
    hp AS (SELECT doc_id, h, unnest(p) AS piece, generate_subscripts(p, 1) AS n FROM (
             SELECT doc_id, {HEADED} AS h,
                    string_split(regexp_replace({HEADED}, '(## \\[§[^\\]]+\\])', chr(1) || '\\1', 'g'), chr(1)) AS p
             FROM documents)),
    placed AS (SELECT doc_id, n, piece, {sql_strip('piece')} AS part,
                      coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS loc FROM hp),
    parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS idx
              FROM placed WHERE part <> '')"""


@query("C4_heading_split", f"""
    WITH {HEAD_PARTS}
    SELECT doc_id, idx::INTEGER AS part_index, loc::INTEGER AS char_start,
           (loc + length(part))::INTEGER AS char_end, md5(part) AS text_md5 FROM parts""")
def c4(spark, sf):
    placed = headed(spark, sf).select(
        "chapter", F.posexplode(X.bind(C.heading_parts(F.col("text")), lambda p: C._locate_parts(F.col("text"), p))).alias("i", "p")
    )
    return placed.select(
        F.col("chapter").alias("doc_id"), F.col("i").alias("part_index"), F.col("p.start").alias("char_start"),
        F.col("p.end").alias("char_end"), F.md5("p.text").alias("text_md5"),
    )


BOUNDARIES = """
    cued AS (SELECT doc_id, replace(text, '. ', '. Second, ') AS t, string_split(text, '. ') AS p FROM documents),
    cuts AS (SELECT doc_id, t, list_transform(range(1, len(p)),
               lambda j: list_sum(list_transform(p[1:j], lambda x: length(x))) + 10 * (j - 1)) AS b FROM cued),
    kept AS (SELECT doc_id, t, b, 0::HUGEINT AS loc, 0 AS n FROM cuts
             UNION ALL
             SELECT doc_id, t, b, list_min(list_filter(b, lambda x: x > loc + 350)), n + 1 FROM kept
             WHERE len(list_filter(b, lambda x: x > loc + 350)) > 0),
    spans AS (SELECT doc_id, t, n, loc, coalesce(lead(loc) OVER (PARTITION BY doc_id ORDER BY n), length(t)) AS stop FROM kept)"""


@query("C5_boundary_split", f"""
    WITH RECURSIVE {BOUNDARIES},
    raw AS (SELECT doc_id, n, loc, substr(t, (loc + 1)::BIGINT, (stop - loc)::BIGINT) AS r FROM spans)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS part_index,
           (loc + length(r) - length(regexp_replace(r, '^{SPACES}+', '')))::INTEGER AS char_start,
           md5({sql_strip('r')}) AS text_md5
    FROM raw WHERE {sql_strip('r')} <> ''""")
def c5(spark, sf):
    parts = cued(spark, sf).select("chapter", F.posexplode(C.boundary_parts(F.col("text"))).alias("i", "p"))
    return parts.select(
        F.col("chapter").alias("doc_id"), F.col("i").alias("part_index"), F.col("p.start").alias("char_start"),
        F.md5("p.text").alias("text_md5"),
    )


STRIPPED = f"SELECT doc_id AS id, {sql_strip('text')} AS text FROM documents WHERE len({sql_tokens('text')}) > 300 * 1.3"


@query("C6_limit_long_parts", f"""
    WITH RECURSIVE {sql_windows(STRIPPED, 300, 50)}, {SQL_OFFSETS},
    lead_in AS (SELECT doc_id AS id, length(text) - length(regexp_replace(text, '^{SPACES}+', '')) AS off FROM documents)
    SELECT w.id AS doc_id, w.i::INTEGER AS chunk_index, (p.loc + off)::INTEGER AS char_start,
           (off + p.loc + least(length(w.body), least(length(w.text), p.loc + length(w.body)) - p.loc))::INTEGER AS char_end
    FROM win w JOIN pos p USING (id, i) JOIN lead_in l USING (id)
    UNION ALL
    SELECT doc_id, 0, (length(text) - length(regexp_replace(text, '^{SPACES}+', '')))::INTEGER,
           (length(text) - length(regexp_replace(text, '^{SPACES}+', '')) + length({sql_strip('text')}))::INTEGER
    FROM documents WHERE len({sql_tokens('text')}) <= 300 * 1.3 AND {sql_strip('text')} <> ''""")
def c6(spark, sf):
    text = F.col("text")
    limited = documents(spark, sf).select(
        "chapter", F.posexplode(X.bind(C._locate_parts(text, F.filter(F.array(X.strip(text)), lambda p: p != "")),
                                       lambda p: C.limit_parts(text, p, 300, 50))).alias("i", "p")
    )
    return limited.select(
        F.col("chapter").alias("doc_id"), F.col("i").alias("chunk_index"),
        F.col("p.start").alias("char_start"), F.col("p.end").alias("char_end"),
    )


def sql_count(words: str, target: int, overlap: int) -> str:
    step = max(1, target - overlap)
    return f"CASE WHEN {words} = 0 THEN 0 ELSE greatest(ceil(({words}-{target})/{float(step)}), 0) + 1 END"


@query("C7_strategy_dispatch", f"""
    WITH {HEAD_PARTS},
    whole AS (SELECT doc_id, len({sql_words(HEADED)}) AS w FROM documents),
    np AS (SELECT doc_id, count(*) AS n,
                  sum(CASE WHEN len({sql_tokens('part')}) > 845 THEN {sql_count("len(" + sql_words('part') + ")", 650, 90)} ELSE 1 END) AS lim
           FROM parts GROUP BY doc_id),
    every AS (
      SELECT 'fixed-300' AS strategy, {sql_count('w', 300, 50)} AS n FROM whole UNION ALL
      SELECT 'fixed-512', {sql_count('w', 512, 80)} FROM whole UNION ALL
      SELECT 'fixed-800', {sql_count('w', 800, 120)} FROM whole UNION ALL
      SELECT 'heading-aware', CASE WHEN n = 1 THEN {sql_count('w', 450, 70)} ELSE n END FROM whole JOIN np USING (doc_id) UNION ALL
      SELECT 'framework-aware', CASE WHEN n = 1 THEN {sql_count('w', 650, 90)} ELSE lim END FROM whole JOIN np USING (doc_id))
    SELECT strategy, sum(n)::BIGINT AS chunks FROM every GROUP BY strategy""")
def c7(spark, sf):
    from quillrank import constants as K

    chunks = C.chunk_documents(headed(spark, sf), list(K.STRATEGIES))
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"))


def routes(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("chapter"), F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("primary_subject"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("secondary_subjects"),
    )


ROUTED = f"""
    WITH {sql_windows(DOCS, 512, 80)},
    routed AS (SELECT id, i, body, coalesce('quality-' || quality, 'offers') AS subject,
                      coalesce('quality-' || quality, 'offers') || CASE WHEN toxic = 1 THEN ', toxic' ELSE '' END AS subjects
               FROM win LEFT JOIN labels ON doc_id = id)"""


def routed_chunks(spark, sf):
    return C.route_subjects(C.chunk_documents(documents(spark, sf), "fixed-512"), routes(spark, sf))


@query("C8_chunk_ids_routes_hash", f"""{ROUTED}
    SELECT id || ':' || i AS chunk_id, subject, subjects, sha256(body) AS content_hash FROM routed""")
def c8(spark, sf):
    return routed_chunks(spark, sf).select(
        "chunk_id", "subject", F.array_join("subjects", ", ").alias("subjects"), "content_hash"
    )


@query("C9_embedding_text", f"""{ROUTED}
    SELECT id || ':' || i AS chunk_id,
           md5('chapter: ' || id || chr(10) || 'subjects: ' || subjects || chr(10) || chr(10) || body) AS text_md5
    FROM routed""")
def c9(spark, sf):
    return routed_chunks(spark, sf).select(
        "chunk_id", F.md5(C.embedding_text(F.col("chapter").cast("string"), F.col("subjects"), F.col("text"))).alias("text_md5")
    )


@query("C10_chunk_statistics", "WITH " + ", ".join(
    sql_windows(DOCS, t, o).replace("wl AS", f"wl{t} AS").replace("FROM wl", f"FROM wl{t}").replace("win AS", f"win{t} AS")
    for t, o in ((300, 50), (512, 80), (800, 120))
) + f""", sized AS (
    {" UNION ALL ".join(f"SELECT 'fixed-{t}' AS strategy, len({sql_tokens('body')}) AS n FROM win{t}" for t in (300, 512, 800))})
    SELECT strategy, count(*)::BIGINT AS chunks, round(avg(n), 6) AS mean_tokens, max(n)::BIGINT AS max_tokens,
           count(*) FILTER (n > 1000)::BIGINT AS over_1000, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95_tokens
    FROM sized GROUP BY strategy""")
def c10(spark, sf):
    chunks = C.chunk_documents(documents(spark, sf), ["fixed-300", "fixed-512", "fixed-800"])
    return C.chunk_statistics(chunks).select(
        "strategy", "chunks", F.round("mean_tokens", 6).alias("mean_tokens"), "max_tokens", "over_1000",
        F.round("p95_tokens", 6).alias("p95_tokens"),
    )


def _sql_sizes(name: str, docs: str, target: int, overlap: int) -> str:
    """CTEs ending in `name`(n), the tokens of each window."""
    windows = sql_windows(docs, target, overlap).replace("wl AS", f"{name}_w AS").replace("FROM wl", f"FROM {name}_w")
    return f"{windows.replace('win AS', f'{name}_c AS')}, {name} AS (SELECT len({sql_tokens('body')}) AS n FROM {name}_c)"


WHOLE = f"SELECT doc_id AS id, {HEADED} AS text FROM documents"
ALONE = f"{WHOLE} JOIN np USING (doc_id) WHERE pieces = 1"
LARGE = f"len({sql_tokens('part')}) > 845"


@query("C10_statistics_of_all_strategies", f"""
    WITH {HEAD_PARTS}, np AS (SELECT doc_id, count(*) AS pieces FROM parts GROUP BY 1),
    {_sql_sizes('f300', WHOLE, 300, 50)}, {_sql_sizes('f512', WHOLE, 512, 80)}, {_sql_sizes('f800', WHOLE, 800, 120)},
    {_sql_sizes('ha', ALONE, 450, 70)}, {_sql_sizes('fa', ALONE, 650, 90)},
    {_sql_sizes('fp', f"SELECT doc_id * 100000 + n AS id, part AS text FROM parts JOIN np USING (doc_id) WHERE pieces > 1 AND {LARGE}", 650, 90)},
    sized AS (
      SELECT 'fixed-300' AS strategy, n FROM f300 UNION ALL SELECT 'fixed-512', n FROM f512 UNION ALL SELECT 'fixed-800', n FROM f800 UNION ALL
      SELECT 'heading-aware', n FROM ha UNION ALL
      SELECT 'heading-aware', len({sql_tokens('part')}) FROM parts JOIN np USING (doc_id) WHERE pieces > 1 UNION ALL
      SELECT 'framework-aware', n FROM fa UNION ALL SELECT 'framework-aware', n FROM fp UNION ALL
      SELECT 'framework-aware', len({sql_tokens('part')}) FROM parts JOIN np USING (doc_id) WHERE pieces > 1 AND NOT {LARGE})
    SELECT strategy, count(*)::BIGINT AS chunks, round(avg(n), 6) AS mean_tokens, max(n)::BIGINT AS max_tokens,
           count(*) FILTER (n > 1000)::BIGINT AS over_1000, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95_tokens
    FROM sized GROUP BY strategy""")
def c10_all(spark, sf):
    from quillrank import constants as K

    return C.chunk_statistics(C.chunk_documents(headed(spark, sf), list(K.STRATEGIES))).select(
        "strategy", "chunks", F.round("mean_tokens", 6).alias("mean_tokens"), "max_tokens", "over_1000",
        F.round("p95_tokens", 6).alias("p95_tokens"),
    )


@query("X1_normalize_text", """
    SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS out_md5 FROM documents""")
def x1(spark, sf):
    return documents(spark, sf).select(F.col("chapter").alias("doc_id"), F.md5(X.normalize_text(F.col("text"))).alias("out_md5"))


@query("X2_normalize_query", f"""
    SELECT conv_id, turn, md5(lower(array_to_string({sql_words('text')}, ' '))) AS lowered_md5,
           md5(array_to_string({sql_words('text')}, ' ')) AS kept_md5 FROM conversations""")
def x2(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(X.normalize_query(text)).alias("lowered_md5"), F.md5(X.collapse_spaces(text)).alias("kept_md5")
    )


NUMBERED = "replace(replace(lower(text), ' the ', ' two '), ' de ', '-ten ')"


def _sql_numbers() -> str:
    from quillrank import constants as K

    out = f"' ' || replace(lower({NUMBERED}), '-', ' ') || ' '"
    for word, digits in K.NUMBER_WORDS:
        out = f"replace({out}, ' {word} ', ' {digits} ')"
    return out


@query("X3_number_words", f"""
    SELECT doc_id, md5(array_to_string({sql_words(_sql_numbers())}, ' ')) AS out_md5 FROM documents""")
def x3(spark, sf):
    text = F.replace(F.replace(F.lower("text"), F.lit(" the "), F.lit(" two ")), F.lit(" de "), F.lit("-ten "))
    return documents(spark, sf).select(F.col("chapter").alias("doc_id"), F.md5(X.normalize_numbers(text)).alias("out_md5"))


@query("X4_phrase_in", f"""
    SELECT doc_id, contains(array_to_string({sql_tokens('text')}, ' '), CASE lang WHEN 'en' THEN 'on the' WHEN 'fr' THEN 'de la' ELSE 'en' END) AS found
    FROM documents""")
def x4(spark, sf):
    phrase = F.when(F.col("lang") == "en", "on THE").when(F.col("lang") == "fr", "de  la").otherwise("en")
    return table(spark, sf, "documents").select("doc_id", X.phrase_in(F.col("text"), phrase).alias("found"))


@query("X5_extract_numbers", f"""
    SELECT doc_id,
      coalesce(round(list_sum(list_transform(regexp_extract_all(text, '\\$([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), lambda v: replace(v, ',', '')::DOUBLE)), 6), 0.0) AS dollars,
      coalesce(round(list_sum(list_transform(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?){SPACES}*%', 1), lambda v: v::DOUBLE / 100)), 6), 0.0) AS percents,
      len(regexp_extract_all(lower(text), '([0-9]+(?:\\.[0-9]+)?){SPACES}+months?', 1))::INTEGER AS month_mentions
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + page_id, html FROM pages)""")
def x5(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("doc_id"), F.col("html").alias("text"))
    both = table(spark, sf, "documents").select("doc_id", "text").unionByName(pages)

    def total(values):
        return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 6)

    text = F.col("text")
    return both.select(
        "doc_id", total(X.money_values(text)).alias("dollars"), total(X.percent_values(text)).alias("percents"),
        F.size(X.month_values(text)).alias("month_mentions"),
    )


@query("X11_query_validity", f"""
    SELECT coalesce(CASE WHEN text IS NULL THEN 'query must be a string'
             WHEN {sql_strip('text')} = '' THEN 'query must not be empty'
             WHEN {sql_strip('text')} LIKE '%' || chr(10) || '%' OR {sql_strip('text')} LIKE '%' || chr(13) || '%' THEN 'query must be one line'
             WHEN length({sql_strip('text')}) > 400 THEN 'query must be no more than 400 characters' END, 'ok') AS verdict,
           count(*)::BIGINT AS queries
    FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM documents) GROUP BY 1""")
def x11(spark, sf):
    texts = (
        table(spark, sf, "conversations").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
        .unionByName(table(spark, sf, "documents").select("text"))
    )
    return texts.groupBy(F.coalesce(X.query_error(F.col("text")), F.lit("ok")).alias("verdict")).agg(F.count("*").alias("queries"))


@query("X12_tokens_used", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice)::BIGINT END AS tokens FROM orders""")
def x12(spark, sf):
    said = F.format_number(F.floor("o_totalprice"), 0)
    log = F.when(F.col("o_orderstatus") == "P", "no count").otherwise(F.concat(F.lit("done\nTokens used\n"), said, F.lit("\n")))
    return table(spark, sf, "orders").select("o_orderkey", X.tokens_used(log).alias("tokens"))


LOG_SQL = """CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'start' || chr(10) || 'exec' || chr(10) || 'cat in /work/run-1/a'
    WHEN 'error' THEN 'read search_allowed from /srv/own/evals Quota reached' WHEN 'purchase' THEN 'ls in /work/run-10/b' ELSE 'open /tmp/x ' || props END"""


@query("X13_log_flags", """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'missing_command_transcript' WHEN 'click' THEN 'unexpected_tool_call'
             WHEN 'error' THEN 'evaluation_artifact_reference,original_repo_reference'
             WHEN 'purchase' THEN 'command_outside_trial_runtime' ELSE 'temp_path_outside_trial_runtime' END AS flags,
           CASE WHEN event_type = 'error' AND value > 10 THEN 'quota' END AS infra
    FROM events""")
def x13(spark, sf):
    kind = F.col("event_type")
    log = (
        F.when(kind == "view", "").when(kind == "click", "start\nexec\ncat in /work/run-1/a")
        .when(kind == "error", "read search_allowed from /srv/own/evals Quota reached")
        .when(kind == "purchase", "ls in /work/run-10/b").otherwise(F.concat(F.lit("open /tmp/x "), F.col("props")))
    )
    code = F.when(F.col("value") > 10, 1).otherwise(0)
    return table(spark, sf, "events").select(
        "event_id", F.array_join(X.log_flags(log, F.lit("/srv/own"), F.lit("/work/run-1")), ",").alias("flags"),
        X.infra_failure(code, log).alias("infra"),
    )


SECRET = "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|[0-9]{4,}"


@query("X14_redact", f"""
    SELECT doc_id, md5(list_reduce(list_prepend(text, regexp_extract_all(text, '{SECRET}')), lambda a, b: replace(a, b, '[REDACTED]'))) AS text_md5,
           len(regexp_extract_all(text, '{SECRET}')) > 0 AS exposed FROM documents""")
def x14(spark, sf):
    secrets = F.regexp_extract_all("text", F.lit(SECRET), F.lit(0))
    done = documents(spark, sf).select("chapter", X.redact(F.col("text"), secrets).alias("r"))
    return done.select(F.col("chapter").alias("doc_id"), F.md5("r.text").alias("text_md5"), F.col("r.exposed").alias("exposed"))


@query("X15_service_detector", """
    SELECT page_id, regexp_matches(lower(concat_ws(' ', url, html)), 'service|consulting|agency|design|implementation') AS service FROM pages""")
def x15(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.looks_like_service(F.col("url"), F.col("html")).alias("service"))


@query("X16_overlap_subjects", """
    WITH listed AS (SELECT doc_id AS case_id, unnest([doc_id, doc_id * 7 % 1000, doc_id + 1]) AS ch, unnest([0, 1, 2]) AS loc FROM documents),
    subs AS (SELECT case_id, loc, unnest(CASE WHEN toxic = 1 THEN ['quality-' || quality, 'toxic'] WHEN quality IS NOT NULL THEN ['quality-' || quality] ELSE ['offers'] END) AS s,
                    unnest(CASE WHEN toxic = 1 THEN [0, 1] ELSE [0] END) AS k
             FROM listed LEFT JOIN labels ON doc_id = ch),
    firsts AS (SELECT case_id, s, min(loc * 10 + k) AS o FROM subs GROUP BY ALL)
    SELECT case_id, string_agg(s, ',' ORDER BY o) AS subjects FROM firsts GROUP BY case_id""")
def x16(spark, sf):
    d = F.col("doc_id")
    ids = F.array(*[F.concat(c.cast("string"), F.lit(":0")) for c in (d, d * 7 % 1000, d + 1)])
    cases = table(spark, sf, "documents").select(d.alias("case_id"), ids.alias("chunk_ids"))
    dim = routes(spark, sf).withColumn("chapter", F.col("chapter").cast("string"))
    return J.overlap_subjects(cases, dim).select("case_id", F.array_join("subjects", ",").alias("subjects"))
