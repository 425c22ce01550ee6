"""Queries on label joins, ranking metrics, windows and set operations.

Stand-ins: relevance comes from the labels table, an expected chapter is a document source,
latency and token counts are event values, and a model is an event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank import scale
from quillrank.functions.text import bind, token_text, tokens
from quillrank.operators import chunking as C
from quillrank.operators import evidence as E
from quillrank.operators import fusion as R
from quillrank.operators import labels as J
from quillrank.operators import lexical as L
from quillrank.operators import metrics as M
from quillrank.operators.quantiles import quantiles
from quillrank.plans.registry import query, sql_tokens, sql_words, table
from quillrank.plans.retrieval import VARIANTS_SQL, bench, bm25, dense, docs, sql_bm25, sql_dense, variants
from quillrank.plans.text import _sql_numbers
from quillrank.session import stored


def labels(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), "quality", "toxic")


def events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").withColumn("k", k)


EV = "(SELECT *, json_extract(props, '$.k')::INT AS k FROM events)"


def alt(spark, sf, k=5):
    return bm25(spark, sf, k, k1=0.4, b=0.3)


ALT = sql_bm25(5, k1=0.4, b=0.3, name="alt")


# --- joins -----------------------------------------------------------------

def corrected(labels):
    """Each label as its second line, after a contrary first one, in no order."""
    lines = labels.withColumn("line_number", F.explode(F.array(F.lit(2), F.lit(1))))
    return lines.withColumn("useful", F.col("useful") == (F.col("line_number") == 2)).repartition(7)


@query("J1_label_override", f"""
    WITH {sql_bm25(5)}
    SELECT query_id AS case_id, chunk_id, CASE WHEN toxic = 1 THEN FALSE WHEN quality IS NOT NULL THEN quality = 1 ELSE lang = 'en' END AS useful,
           CASE WHEN toxic = 1 THEN 'model_comparison' WHEN quality IS NOT NULL THEN 'semantic_adjudication' ELSE 'span_transfer' END AS label_source
    FROM lex JOIN documents d ON d.doc_id = chunk_id LEFT JOIN labels l ON l.doc_id = chunk_id""")
def j1(spark, sf):
    pairs = stored(
        bm25(spark, sf, 10).select(F.lit("bm25").alias("strategy"), F.col("query_id").alias("case_id"), "chunk_id", "rank"), "pairs"
    )
    judged = pairs.join(labels(spark, sf), "chunk_id")
    moved = pairs.join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), (F.col("lang") == "en").alias("useful")), "chunk_id")
    done = J.adjudicate(
        pairs.where(F.col("rank") <= 5), corrected(moved), corrected(judged.withColumn("useful", F.col("quality") == 1)),
        corrected(judged.where(F.col("toxic") == 1).withColumn("useful", F.lit(False))),
    )
    return done.select("case_id", "chunk_id", "useful", "label_source")


def spans(spark, sf, target, step):
    n = F.size("w")
    last = F.greatest(F.ceil((n - target) / F.lit(float(step))), F.lit(0)).cast("int")
    from quillrank.functions.text import words

    found = docs(spark, sf).select(F.col("doc_id").alias("chapter"), words(F.col("text")).alias("w")).where(n > 0)
    return found.select("chapter", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("id")).select(
        "chapter", "id", (F.col("id") * step).alias("start"), F.least(F.col("id") * step + target, F.col("n")).alias("end")
    )


def sql_spans(target, step):
    return f"""SELECT doc_id, i, i * {step} AS s, least(i * {step} + {target}, n) AS e FROM (
        SELECT doc_id, n, unnest(range(0, greatest(ceil((n - {target}) / {float(step)})::BIGINT, 0) + 1)) AS i
        FROM (SELECT doc_id, len({sql_words('text')}) AS n FROM documents) WHERE n > 0)"""


@query("J2_span_label_transfer", f"""
    WITH a AS ({sql_spans(300, 250)}), b AS (SELECT x.* FROM ({sql_spans(512, 432)}) x JOIN labels USING (doc_id) WHERE quality = 1),
    p AS (SELECT a.doc_id, a.i, least(a.e, b.e) - greatest(a.s, b.s) AS o, least(a.e - a.s, b.e - b.s) AS sh FROM a JOIN b ON a.doc_id = b.doc_id AND least(a.e, b.e) > greatest(a.s, b.s)),
    g AS (SELECT doc_id, i, count(*) AS m, bool_or(o >= 20 AND round(o::DOUBLE / greatest(1, sh), 4) >= 0.15) AS u FROM p GROUP BY ALL)
    SELECT a.doc_id, a.i::INTEGER AS chunk_index, coalesce(u, FALSE) AS useful, coalesce(m, 0)::BIGINT AS matches FROM a LEFT JOIN g USING (doc_id, i)""")
def j2(spark, sf):
    good = labels(spark, sf).where(F.col("quality") == 1).select(F.col("chunk_id").alias("chapter"))
    known = spans(spark, sf, 512, 432).join(good, "chapter", "left_semi")
    done = J.transfer_labels(spans(spark, sf, 300, 250), known, ("chapter",))
    return done.select(F.col("chapter").alias("doc_id"), F.col("id").alias("chunk_index"), "useful", "matches")


@query("J2_exact_labels", f"""
    WITH a AS ({sql_spans(300, 250)})
    SELECT a.doc_id, a.i::INTEGER AS chunk_index, coalesce(quality = 1, FALSE) AS useful FROM a LEFT JOIN labels USING (doc_id)""")
def j2_exact(spark, sf):
    """Labelled chunks of the same strategy, met by id; a labelled chunk may be named twice."""
    good = labels(spark, sf).where(F.col("quality") == 1).select(F.col("chunk_id").alias("chapter"))
    all_spans = spans(spark, sf, 300, 250)
    useful = all_spans.join(good, "chapter", "left_semi")
    done = J.exact_labels(all_spans, useful.unionByName(useful), ("chapter",))
    return done.select(F.col("chapter").alias("doc_id"), F.col("id").alias("chunk_index"), "useful")


@query("J3_token_span_location", f"""
    WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
    x AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 300) / 250.0)::BIGINT, 0) + 1)) AS i FROM w WHERE len(w) > 0),
    t AS (SELECT doc_id, i, len({sql_tokens("array_to_string(w[i*250+1 : i*250+300], ' ')")}) AS n FROM x)
    SELECT doc_id, i::INTEGER AS chunk_index, n::INTEGER AS span_tokens, TRUE AS run_matches FROM t WHERE n > 0""")
def j3(spark, sf):
    """Spans of every window; the oracle checks that each span holds the window's tokens.

    Windows are compared inside the row, so that no text is copied for each of its windows.
    """
    text = F.col("text")

    def compared(pieces, source):
        def one(piece, span):
            return bind(tokens(piece["text"]), lambda needle: F.struct(
                F.size(needle).alias("n"), (span["end"] - span["start"]).alias("span_tokens"),
                (F.slice(source, span["start"] + 1, F.size(needle)) == needle).alias("run_matches"),
            ))

        return F.zip_with(pieces, J.chunk_spans(text, pieces), one)

    found = bind(C.chunk_array(text, "fixed-300"), lambda pieces: bind(tokens(text), lambda source: compared(pieces, source)))
    rows = docs(spark, sf).select("doc_id", F.posexplode(found).alias("chunk_index", "p"))
    return rows.where(F.col("p.n") > 0).select("doc_id", "chunk_index", "p.span_tokens", "p.run_matches")


def both_searches(spark, sf, k):
    """The k best of the usual search and of `alt`, from one reading of the texts; written, for several uses."""
    variants = {"base": (K.BM25_K1, K.BM25_B), "alt": (0.4, 0.3)}
    found = stored(L.search_variants(docs(spark, sf), bench(spark, sf), variants, k, chunk_id="doc_id"), "searches")
    return [found.where(F.col("variant") == name).drop("variant") for name in variants]


def claims(spark, sf, found):
    return found.join(labels(spark, sf), "chunk_id").select(
        (F.col("query_id") * 1000000 + F.col("chunk_id")).alias("claim_id"), "query_id",
        F.when(F.col("quality") == 1, "accepted").otherwise("proposed").alias("status"),
        F.when(F.col("toxic") == 0, F.array(F.col("chunk_id"), F.col("chunk_id") + 1)).otherwise(F.array().cast("array<bigint>")).alias("supporting"),
    )


CLAIMS = f"""{sql_bm25(5)}, {sql_bm25(20, k1=0.4, b=0.3, name='cl')},
    claims AS (SELECT query_id * 1000000 + chunk_id AS claim_id, query_id, chunk_id, CASE quality WHEN 1 THEN 'accepted' ELSE 'proposed' END AS status, toxic
               FROM cl JOIN labels ON doc_id = chunk_id),
    sup AS (SELECT c.*, EXISTS (SELECT 1 FROM lex l WHERE l.query_id = c.query_id AND l.chunk_id IN (c.chunk_id, c.chunk_id + 1)) AS ok FROM claims c WHERE toxic = 0)"""


@query("J4_claim_support", f"WITH {CLAIMS} SELECT claim_id, query_id, ok AS supported FROM sup WHERE status = 'accepted'")
def j4(spark, sf):
    base, other = both_searches(spark, sf, 20)
    return J.claim_support(claims(spark, sf, other), base.where(F.col("rank") <= 5))


@query("J4_claim_coverage", f"""
    WITH {CLAIMS} SELECT count(*)::BIGINT AS claims, count(*) FILTER (ok)::BIGINT AS supported, count(*) FILTER (NOT ok)::BIGINT AS unsupported,
    round(avg(ok::INT), 6) AS coverage FROM sup""")
def j4_cov(spark, sf):
    base, other = both_searches(spark, sf, 20)
    support = J.claim_support(claims(spark, sf, other), base.where(F.col("rank") <= 5), True)
    return J.support_coverage(support).withColumn("coverage", F.round("coverage", 6))


@query("J5_novel_pair_audit", f"""
    WITH {sql_bm25(5)}, {ALT},
    nv AS (SELECT a.query_id, a.chunk_id FROM alt a WHERE NOT EXISTS (SELECT 1 FROM lex l WHERE l.query_id = a.query_id AND l.chunk_id = a.chunk_id)),
    j AS (SELECT nv.*, quality, lang = 'en' AS old FROM nv JOIN documents d ON d.doc_id = chunk_id LEFT JOIN labels b ON b.doc_id = chunk_id)
    SELECT count(*)::BIGINT AS novel, count(quality)::BIGINT AS reviewed, count(*) FILTER (quality IS NULL)::BIGINT AS unreviewed,
           count(*) FILTER (quality = 1 AND NOT old)::BIGINT AS false_negative_corrections, count(*) FILTER (quality = 0 AND old)::BIGINT AS false_positive_corrections FROM j""")
def j5(spark, sf):
    def pairs(df):
        return df.select(F.col("query_id").alias("case_id"), "chunk_id")

    other = stored(pairs(alt(spark, sf)), "pairs")
    reviewed = other.join(labels(spark, sf), "chunk_id").withColumn("useful", F.col("quality") == 1)
    old = other.join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), (F.col("lang") == "en").alias("useful")), "chunk_id")
    return J.audit_novel(J.novel_pairs(pairs(bm25(spark, sf)), other, corrected(reviewed), corrected(old)))


SIDES = f"""
    {sql_bm25(5)}, {ALT},
    a AS (SELECT query_id, min(rank) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS u, list(chunk_id ORDER BY rank) AS ids FROM lex LEFT JOIN labels ON doc_id = chunk_id GROUP BY 1),
    b AS (SELECT query_id, min(rank) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS u, list(chunk_id ORDER BY rank) AS ids FROM alt LEFT JOIN labels ON doc_id = chunk_id WHERE query_id % 10 <> 3 GROUP BY 1)"""


def condition_rows(spark, sf, df, name):
    ranked = df.join(labels(spark, sf), "chunk_id", "left").groupBy("query_id").agg(
        F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("first_rank"),
        F.count(F.when(F.col("quality") == 1, 1)).alias("useful_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias("returned"),
    )
    return ranked.select(F.lit(name).alias("condition"), F.col("query_id").alias("case_id"), "first_rank", "useful_count", "returned")


@query("J6_paired_conditions", f"""
    WITH {SIDES}
    SELECT coalesce(a.query_id, b.query_id) AS case_id, a.r::INTEGER AS a_rank, a.u::BIGINT AS a_useful, b.r::INTEGER AS b_rank, b.u::BIGINT AS b_useful,
           (b.u - a.u)::BIGINT AS delta, a.ids IS DISTINCT FROM b.ids AS changed,
           CASE WHEN a.query_id IS NULL THEN 'base' WHEN b.query_id IS NULL THEN 'alt' END AS missing_in
    FROM a FULL JOIN b ON a.query_id = b.query_id""")
def j6(spark, sf):
    # One case in ten has no result under the second condition.
    second = condition_rows(spark, sf, alt(spark, sf), "alt").where(F.col("case_id") % 10 != 3)
    return J.compare_conditions(condition_rows(spark, sf, bm25(spark, sf), "base").unionByName(second), "base", "alt")


@query("J6_latency_conditions", f"""
    WITH {SIDES}
    SELECT a.query_id AS case_id, (a.query_id % 50)::DOUBLE AS before_ms, (a.query_id % 20)::DOUBLE AS after_ms, a.ids = b.ids AS same,
           (a.query_id % 30)::DOUBLE AS selected_ms, b.u::BIGINT AS selected_useful FROM a JOIN b ON a.query_id = b.query_id""")
def j6_latency(spark, sf):
    base, other = condition_rows(spark, sf, bm25(spark, sf), "before"), condition_rows(spark, sf, alt(spark, sf), "after")
    other = other.where(F.col("case_id") % 10 != 3)
    sides = [(base, "before", 50), (other, "after", 20), (other, "selected", 30)]
    rows = [df.withColumn("condition", F.lit(n)).withColumn("latency_ms", (F.col("case_id") % m).cast("double")) for df, n, m in sides]
    return J.compare_latencies(J.concat_cases(*rows), "before", "after", "selected")


@query("J8_condition_matrix", """
    WITH gen AS (SELECT conv_id, role, 'm' || (turn % 2) AS model, min(text) AS q FROM conversations GROUP BY ALL),
    grid AS (SELECT conv_id, m, w, b FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('user', 'm0'), ('assistant', 'm1'), ('system', 'm0')) c(m, w), (VALUES ('bm25'), ('hybrid')) d(b))
    SELECT g.conv_id AS case_id, m AS method, w AS model, b AS backend, md5(CASE WHEN length(q) <= 400 THEN q END) AS query_md5,
           CASE WHEN q IS NULL THEN 'missing generation' WHEN length(q) > 400 THEN 'invalid generation' END AS error
    FROM grid g LEFT JOIN gen ON gen.conv_id = g.conv_id AND role = m AND gen.model = w""")
def j8(spark, sf):
    talk = table(spark, sf, "conversations")
    gen = talk.groupBy(
        F.col("conv_id").alias("case_id"), F.col("role").alias("method"),
        F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("model"),
    ).agg(F.min("text").alias("query")).withColumn("valid", F.length("query") <= 400)
    grid = J.condition_matrix(
        talk.select(F.col("conv_id").alias("case_id")).distinct(), gen,
        [("user", "m0"), ("assistant", "m1"), ("system", "m0")], ["bm25", "hybrid"],
    )
    return grid.select("case_id", "method", "model", "backend", F.md5("query").alias("query_md5"), "error")


@query("J12_annotator_agreement", """
    SELECT quality AS label_a, toxic AS label_b, count(*)::BIGINT AS pairs, (SELECT count(*) FROM labels)::BIGINT AS total,
           round((SELECT avg((quality = toxic)::INT) FROM labels), 6) AS agreement FROM labels GROUP BY ALL""")
def j12(spark, sf):
    return J.agreement(labels(spark, sf), "quality", "toxic").withColumn("agreement", F.round("agreement", 6))


@query("J12_disagreement_queue", """
    SELECT doc_id AS chunk_id, quality || '->' || toxic AS transition FROM labels WHERE quality <> toxic""")
def j12_queue(spark, sf):
    return J.disagreements(labels(spark, sf), "quality", "toxic").select("chunk_id", "transition")


# --- metrics ---------------------------------------------------------------

def expected_source(q):
    return F.concat(F.lit("src"), (q % 20).cast("string"))


def first_ranks(spark, sf, found):
    hit = F.col("source") == expected_source(F.col("query_id"))
    ranked = found.join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    ranks = M.first_hit_rank(ranked, hit, ["query_id"])
    return bench(spark, sf).select("query_id").join(ranks, "query_id", "left")


FIRST = """fr AS (SELECT item_id AS query_id, min(rank) FILTER (source = 'src' || (item_id % 20)) AS first_rank
    FROM benchmark LEFT JOIN lex ON query_id = item_id LEFT JOIN documents ON doc_id = chunk_id GROUP BY 1)"""

HITS = """count(*)::BIGINT AS queries, round(avg(coalesce((first_rank = 1)::INT, 0)), 6) AS hit_at_1,
    round(avg(coalesce((first_rank <= 5)::INT, 0)), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr"""


def hits(df, *by):
    return df.select(*by, "queries", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "mrr")])


@query("M1_hit_mrr", f"WITH {sql_bm25(20)}, {FIRST} SELECT {HITS} FROM fr")
def m1(spark, sf):
    return hits(M.hit_metrics(first_ranks(spark, sf, bm25(spark, sf, 20))))


def case_rows(spark, sf):
    info = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.size(tokens(F.col("text"))).alias("n"))
    rows = bm25(spark, sf).join(labels(spark, sf), "chunk_id", "left").join(info, "chunk_id").groupBy("query_id").agg(
        F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("first_rank"),
        F.count(F.when(F.col("quality") == 1, 1)).alias("useful_count"), F.sum("n").alias("words"),
    )
    timed = table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms"))
    return stored(
        rows.join(timed, "query_id").withColumn("error", F.when(F.col("query_id") % 4 == 0, "cli_timeout")), "cases"
    )


CASES = f"""{sql_bm25(5)},
    cr AS (SELECT query_id, min(rank) FILTER (quality = 1) AS first_rank, count(*) FILTER (quality = 1) AS useful, sum(len({sql_tokens('d.text')})) AS words,
                  any_value(value) AS latency, CASE WHEN query_id % 4 = 0 THEN 'cli_timeout' END AS error
           FROM lex JOIN documents d ON d.doc_id = chunk_id LEFT JOIN labels l ON l.doc_id = chunk_id JOIN events ON event_id = query_id GROUP BY query_id)"""


def rounded(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("M2_useful_rank_summary", f"""
    WITH {CASES}
    SELECT count(*)::BIGINT AS cases, round(100 * avg(coalesce((first_rank = 1)::INT, 0)), 6) AS hit_at_1_pct, round(100 * avg(coalesce((first_rank <= 3)::INT, 0)), 6) AS hit_at_3_pct,
           round(100.0::DOUBLE * count(first_rank) / count(*), 6) AS hit_at_5_pct, round(avg(first_rank), 6) AS mean_first_rank,
           round(100.0::DOUBLE * sum(useful) / (count(*) * 5), 6) AS useful_pct, round(100 - 100.0::DOUBLE * sum(useful) / (count(*) * 5), 6) AS noise_pct,
           round(avg(words), 6) AS mean_words, round(quantile_cont(words::DOUBLE, 0.5), 6) AS p50_words, round(avg(latency), 6) AS mean_latency_ms,
           round(quantile_cont(latency, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency, 0.95), 6) AS p95_latency_ms FROM cr""")
def m2(spark, sf):
    return rounded(M.useful_rank_summary(case_rows(spark, sf).withColumn("all", F.lit(1)), 5, ["all"]).drop("all"))


@query("M2_misses", f"WITH {CASES} SELECT query_id FROM cr WHERE first_rank IS NULL")
def m2_misses(spark, sf):
    return M.misses(case_rows(spark, sf)).select("query_id")


@query("M3_completed_only", f"""
    WITH {CASES}, ok AS (SELECT * FROM cr WHERE error IS NULL)
    SELECT (SELECT count(*) FROM cr)::BIGINT AS cases, count(*)::BIGINT AS completed, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM cr), 6) AS coverage_pct,
           (SELECT count(*) FROM cr WHERE error IS NOT NULL)::BIGINT AS errors, round(100.0::DOUBLE * count(*) FILTER (first_rank = 1) / count(*), 6) AS hit_at_1_pct,
           round(100.0::DOUBLE * count(*) FILTER (first_rank <= 3) / count(*), 6) AS hit_at_3_pct, round(100.0::DOUBLE * count(first_rank) / count(*), 6) AS hit_at_5_pct,
           round(avg(first_rank), 6) AS mean_first_rank, sum(useful)::BIGINT AS useful_results, (count(*) * 5)::BIGINT AS result_slots, round(avg(useful), 6) AS mean_useful,
           round(quantile_cont(useful::DOUBLE, 0.5), 6) AS median_useful, round(100.0::DOUBLE * sum(useful) / (count(*) * 5), 6) AS precision_pct,
           round(100 - 100.0::DOUBLE * sum(useful) / (count(*) * 5), 6) AS noise_pct, round(avg(latency), 6) AS mean_latency_ms,
           count(*) FILTER (useful = 0)::BIGINT AS bar_0, count(*) FILTER (useful = 2)::BIGINT AS bar_2 FROM ok""")
def m3(spark, sf):
    done = M.completed_scores(case_rows(spark, sf), 5)

    def bar(n):
        return F.coalesce(F.try_element_at("histogram", F.lit(n)), F.lit(0)).cast("long").alias(f"bar_{n}")

    return rounded(done.select("*", bar(0), bar(2)).drop("histogram"))


def judged_pool(spark, sf):
    # Both parameter pairs score one pass over the texts.
    pairs = {"bm25": (K.BM25_K1, K.BM25_B), "alt": (0.4, 0.3)}
    found = L.search_variants(docs(spark, sf), bench(spark, sf), pairs, 10, chunk_id="doc_id").select(
        "variant", "query_id", "chunk_id", "rank", "score"
    )
    grades = labels(spark, sf).select("chunk_id", (F.col("quality") + F.col("toxic")).alias("relevance"))
    # A judged pool is an artifact of its own: it is kept, then labelled and scored.
    return stored(M.build_pool(found).join(grades, "chunk_id", "left"), "pool")


POOL = f"""{sql_bm25(10)}, {sql_bm25(10, k1=0.4, b=0.3, name='alt')},
    hitlist AS (SELECT 'bm25' AS variant, * FROM lex UNION ALL SELECT 'alt', * FROM alt),
    pool AS (SELECT query_id, chunk_id, quality + toxic AS rel FROM (SELECT DISTINCT query_id, chunk_id FROM hitlist) JOIN labels ON doc_id = chunk_id),
    ideal AS (SELECT query_id, sum((2 ** rel - 1) / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS i FROM pool) WHERE i <= 5 GROUP BY 1),
    tot AS (SELECT query_id, count(*) FILTER (rel > 0) AS total FROM pool GROUP BY 1),
    rk AS (SELECT variant, query_id, rel, row_number() OVER (PARTITION BY variant, query_id ORDER BY rank) AS i FROM hitlist JOIN pool USING (query_id, chunk_id)),
    sc AS (SELECT variant, query_id, sum((2 ** rel - 1) / log2(i + 1)) FILTER (i <= 5) AS dcg, count(*) FILTER (i <= 5 AND rel > 0) AS hits FROM rk GROUP BY ALL)"""


@query("M4_graded_scores", f"""
    WITH {POOL}
    SELECT variant, query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg, round(hits / 5.0::DOUBLE, 6) AS "precision",
           round(CASE WHEN total > 0 THEN hits / total::DOUBLE ELSE 0 END, 6) AS recall FROM sc JOIN ideal USING (query_id) JOIN tot USING (query_id)""")
def m4(spark, sf):
    return rounded(M.graded_scores(judged_pool(spark, sf), {"bm25": ["bm25"], "alt": ["alt"]}, 5))


@query("M4_graded_summary_all_queries", f"""
    WITH {POOL}, g AS (SELECT query_id, ideal, total, v AS variant FROM ideal JOIN tot USING (query_id), (VALUES ('bm25'), ('alt')) t(v)),
    z AS (SELECT g.variant, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS nd, coalesce(hits, 0) / 5.0::DOUBLE AS p,
                 CASE WHEN total > 0 THEN coalesce(hits, 0) / total::DOUBLE ELSE 0 END AS r FROM g LEFT JOIN sc USING (variant, query_id))
    SELECT variant, count(*)::BIGINT AS queries, round(avg(nd), 6) AS ndcg, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall FROM z GROUP BY variant""")
def m4_all(spark, sf):
    return rounded(M.graded_summary(M.graded_scores(judged_pool(spark, sf), {"bm25": ["bm25"], "alt": ["alt"]}, 5, all_queries=True)))


BLIND = f"""{sql_bm25(10)}, {sql_bm25(10, k1=0.4, b=0.3, name='alt')},
    hitlist AS (SELECT 'bm25' AS variant, * FROM lex UNION ALL SELECT 'alt', * FROM alt)"""


@query("M5_pool_builder", f"""
    WITH {BLIND}
    SELECT query_id || '::' || chunk_id AS pool_id, sha256(query_id || ':' || chunk_id) AS order_key,
           string_agg(variant || ' ' || rank, ', ' ORDER BY variant) AS found_by FROM hitlist GROUP BY query_id, chunk_id""")
def m5(spark, sf):
    found_by = F.array_join(F.transform("retrieved_by", lambda r: F.concat_ws(" ", r["variant"], r["rank"].cast("string"))), ", ")
    return judged_pool(spark, sf).select("pool_id", "order_key", found_by.alias("found_by"))


@query("W6_blinded_order", f"""
    WITH {BLIND} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || ':' || chunk_id))::INTEGER AS position
    FROM (SELECT DISTINCT query_id, chunk_id FROM hitlist)""")
def w6(spark, sf):
    return M.blinded(judged_pool(spark, sf)).select("query_id", "chunk_id", "position")


@query("M6_M7_M8_percentiles", """
    WITH s AS (SELECT event_type, list_sort(list(value)) AS a, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, round(quantile_cont(value, 0.95), 6) AS linear_95, round(quantile_cont(value, 0.5), 6) AS linear_50,
           (SELECT round(a[(CASE WHEN ((n-1)*0.5) % 1 = 0.5 THEN 2 * round((n-1)*0.5/2.0) ELSE round((n-1)*0.5) END)::BIGINT + 1], 6) FROM s WHERE s.event_type = e.event_type) AS rounded_50,
           (SELECT round((a[greatest(1, least(19*(n+1)//20, n-1))] * (20 - (19*(n+1) - 20*greatest(1, least(19*(n+1)//20, n-1))))
                   + a[greatest(1, least(19*(n+1)//20, n-1)) + 1] * (19*(n+1) - 20*greatest(1, least(19*(n+1)//20, n-1)))) / 20, 6) FROM s WHERE s.event_type = e.event_type) AS exclusive_95
    FROM events e GROUP BY event_type""")
def m6(spark, sf):
    specs = {
        "linear_95": ("linear", 0.95), "linear_50": ("linear", 0.5), "rounded_50": ("rounded", 0.5), "exclusive_95": ("exclusive", 19),
    }
    return rounded(quantiles(table(spark, sf, "events"), ["event_type"], "value", specs))


@query("M6_narrow_times", """
    SELECT user_id % 3 AS g, quantile_cont(t, 0.95) AS p95, quantile_cont(t, 0.5) AS p50 FROM (
        SELECT user_id, 1.7e9 + event_id / 8.0::DOUBLE AS t FROM events) GROUP BY 1""")
def m6_narrow(spark, sf):
    """Times of a narrow range: thousands of values in one bin, which is split by value."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 3).alias("g"), (F.lit(1.7e9) + F.col("event_id") / 8.0).alias("t"))
    return quantiles(rows, ["g"], "t", {"p95": ("linear", 0.95), "p50": ("linear", 0.5)})


@query("M9_provenance_counts", """
    SELECT quality AS relevance, coalesce(nullif(CASE lang WHEN 'en' THEN 'ai' WHEN 'fr' THEN '' END, ''), 'manual') AS source, lang AS provider,
           coalesce(CASE WHEN toxic = 1 THEN 'm1' END, 'none') AS model, 'manual_unspecified' AS reviewer, count(*)::BIGINT AS "rows"
    FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def m9(spark, sf):
    rows = labels(spark, sf).join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id").select(
        F.col("quality").alias("relevance"), F.when(F.col("lang") == "en", "ai").when(F.col("lang") == "fr", "").alias("source"),
        F.col("lang").alias("provider"), F.when(F.col("toxic") == 1, "m1").alias("model"), F.lit(None).cast("string").alias("reviewer"),
    )
    return M.provenance_counts(rows)


def long_terms(text):
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 8))


def evidence_cases(spark, sf):
    q = bench(spark, sf)
    return q.select(
        "query_id", F.array(expected_source(F.col("query_id")), expected_source(F.col("query_id") + 7)).alias("expected"),
        long_terms(F.col("query")).alias("terms"),
    )


def sql_norm(col):
    return f"array_to_string({sql_words(_sql_numbers().replace(NUMBERED_TEXT, col))}, ' ')"


NUMBERED_TEXT = "replace(replace(lower(text), ' the ', ' two '), ' de ', '-ten ')"

COVERAGE = f"""{sql_bm25(5)},
    cs AS (SELECT item_id AS query_id, ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] AS ex, list_distinct(list_filter({sql_tokens('text')}, lambda t: length(t) > 8)) AS terms FROM benchmark),
    nr AS (SELECT l.query_id, l.chunk_id, l.rank, source, {sql_norm('d.text')} AS body, terms, list_contains(ex, source) AS e FROM lex l JOIN documents d ON d.doc_id = chunk_id JOIN cs USING (query_id)),
    ch AS (SELECT *, bool_or(e) OVER (PARTITION BY query_id) AS any_e FROM nr),
    pr AS (SELECT *, len(list_filter(terms, lambda t: contains(body, array_to_string({sql_words("replace(t, '-', ' ')")}, ' ')))) AS present FROM ch WHERE e OR (NOT any_e AND rank = 1)),
    best AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY present DESC, rank) = 1),
    cov AS (SELECT query_id, b.chunk_id, b.source, len(cs.terms) AS total, coalesce(present, 0) AS present,
                   CASE WHEN len(cs.terms) > 0 THEN round(coalesce(present, 0) / len(cs.terms)::DOUBLE, 4) ELSE 0 END AS coverage FROM cs LEFT JOIN best b USING (query_id))"""


def coverage(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("chapter"), "text")
    found = stored(bm25(spark, sf).join(d.select("chunk_id", "chapter"), "chunk_id"), "found")
    return E.term_coverage(found, d.select("chunk_id", "text"), evidence_cases(spark, sf))


@query("M10_evidence_coverage", f"""
    WITH {COVERAGE} SELECT query_id, chunk_id AS evidence_chunk, source AS evidence_chapter, total::INTEGER AS terms_total, present::INTEGER AS terms_present, coverage::DOUBLE AS coverage FROM cov""")
def m10(spark, sf):
    return coverage(spark, sf)


@query("M10_coverage_summary", f"""
    WITH {COVERAGE} SELECT count(*)::BIGINT AS cases, round(avg(coverage), 6) AS avg_coverage, round(avg((coverage = 1)::INT), 6) AS full_coverage, round(min(coverage), 6)::DOUBLE AS min_coverage FROM cov""")
def m10_sum(spark, sf):
    return rounded(E.coverage_summary(coverage(spark, sf)))


@query("M11_evidence_term_audit", f"""
    WITH b AS (SELECT item_id AS query_id, [item_id, item_id + 1] AS ex, {sql_tokens('text')} AS t FROM benchmark),
    ts AS (SELECT query_id, ex, unnest(list_distinct(list_filter(t, lambda x: length(x) > 8) || [t[1] || ' ' || t[2]])) AS term FROM b),
    d AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
    body AS (SELECT query_id, string_agg(array_to_string(t, ' '), ' ' ORDER BY doc_id) AS body FROM (SELECT query_id, unnest(ex) AS doc_id FROM b) JOIN d USING (doc_id) GROUP BY query_id),
    tk AS (SELECT term, list_distinct({sql_tokens('term')}) AS parts FROM (SELECT DISTINCT term FROM ts)),
    cnt AS (SELECT term, count(*) AS n FROM tk JOIN d ON list_has_all(d.t, parts) GROUP BY term)
    SELECT query_id, term, NOT contains(coalesce(body, ''), term) AS absent, coalesce(n, 0)::BIGINT AS chapter_count,
           coalesce(n, 0) >= 8 OR term IN ({', '.join(f"'{g}'" for g in K.GENERIC_TERMS)}) AS generic
    FROM ts LEFT JOIN body USING (query_id) LEFT JOIN cnt USING (term)""")
def m11(spark, sf):
    t = tokens(F.col("query"))
    terms = F.array_distinct(F.concat(F.filter(t, lambda x: F.length(x) > 8), F.array(F.array_join(F.slice(t, 1, 2), " "))))
    cases = bench(spark, sf).select("query_id", F.array(F.col("query_id"), F.col("query_id") + 1).alias("expected"), terms.alias("terms"))
    d = docs(spark, sf).select(F.col("doc_id").alias("chapter"), "text")
    return E.audit_terms(cases, d).select("query_id", "term", "absent", "chapter_count", "generic")


HOST = "regexp_extract(url, '://(?:m[.])?([^./]+)', 1)"
REALISM = f"""
    ch AS (SELECT DISTINCT {HOST} AS c FROM pages), q AS (SELECT conv_id * 1000 + turn AS query_id, text, role FROM conversations),
    qt AS (SELECT query_id, {sql_tokens('text')} AS t, role FROM q),
    hit AS (SELECT query_id, c, list_contains(t, c)::INT::DOUBLE AS o, contains(array_to_string(t, ' '), c) AS ph FROM qt, ch),
    best AS (SELECT query_id, arg_min(c, (-o, c)) AS best, max(o) AS bo, count(*) FILTER (ph) AS phs FROM hit GROUP BY 1),
    cand AS (SELECT query_id, {HOST} AS c FROM q JOIN pages ON page_id = query_id // 1000),
    near AS (SELECT query_id, coalesce(max(o), 0) AS co, count(*) FILTER (ph) AS chs FROM cand JOIN hit USING (query_id, c) GROUP BY 1),
    rows_ AS (SELECT query_id, role AS query_type, best, bo, phs, coalesce(co, 0) AS co, coalesce(chs, 0) AS chs FROM qt JOIN best USING (query_id) LEFT JOIN near USING (query_id))"""


def realism(spark, sf):
    host = F.regexp_extract("url", r"://(?:m[.])?([^./]+)", 1)
    pages = table(spark, sf, "pages").select("page_id", host.alias("chapter"))
    talk = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), F.col("role").alias("query_type"), "conv_id"
    )
    asked = talk.join(pages, F.col("conv_id") == F.col("page_id"), "left").select(
        "query_id", "query", "query_type",
        F.when(F.col("chapter").isNotNull(), F.array("chapter")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
    return E.query_realism(asked, pages.select("chapter").distinct())


@query("M12_query_realism", f"""
    WITH {REALISM} SELECT query_id, query_type, best AS best_chapter, bo::DOUBLE AS best_overlap, phs::BIGINT AS phrase_hits, co::DOUBLE AS candidate_overlap, chs::BIGINT AS candidate_hits FROM rows_""")
def m12(spark, sf):
    return realism(spark, sf)


@query("M12_realism_summary", f"""
    WITH {REALISM} SELECT query_type, count(*)::BIGINT AS queries, round(avg(bo), 6) AS avg_best_overlap, round(avg(co), 6) AS avg_candidate_overlap,
    round(avg((phs > 0)::INT), 6) AS phrase_hit_rate, round(avg((chs > 0)::INT), 6) AS candidate_hit_rate FROM rows_ GROUP BY 1""")
def m12_sum(spark, sf):
    return rounded(E.realism_summary(realism(spark, sf)))


@query("M13_search_gate", f"""
    WITH g AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'search' ELSE 'no' END AS x, value > 5 AS ok, k > 9 AS valid FROM {EV})
    SELECT model, count(*)::BIGINT AS trials, count(*) FILTER (valid)::BIGINT AS valid_trials, round(avg(ok::INT) FILTER (valid), 6) AS accuracy,
           round(avg(ok::INT) FILTER (valid AND x = 'search'), 6) AS required_recall, round(avg(ok::INT) FILTER (valid AND x = 'no'), 6) AS prohibited_accuracy FROM g GROUP BY 1""")
def m13(spark, sf):
    rows = events(spark, sf).select(
        F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, K.SEARCH_ACTION).otherwise("no_search").alias("expected"),
        (F.col("value") > 5).alias("correct"), (F.col("k") > 9).alias("valid"),
    )
    return rounded(M.gate_confusion(rows))


@query("M16_run_performance", f"""
    WITH r AS (SELECT event_type AS model, value, k, CASE WHEN k % 10 = 0 THEN 'timeout' END AS error FROM {EV}),
    ok AS (SELECT model, list_sort(list(value)) AS a, count(*) AS n, sum(k) AS p, sum(2 * k) AS c, quantile_cont(value, 0.5) AS p50 FROM r WHERE error IS NULL GROUP BY 1)
    SELECT r.model, count(*)::BIGINT AS requests, count(error)::BIGINT AS errors, any_value(p)::BIGINT AS prompt_tokens, any_value(c)::BIGINT AS completion_tokens, round(any_value(p50), 6) AS p50_latency_ms,
           round(any_value((a[greatest(1, least(19*(n+1)//20, n-1))] * (20 - (19*(n+1) - 20*greatest(1, least(19*(n+1)//20, n-1)))) + a[greatest(1, least(19*(n+1)//20, n-1)) + 1] * (19*(n+1) - 20*greatest(1, least(19*(n+1)//20, n-1)))) / 20), 6) AS p95_latency_ms,
           round(any_value(CASE WHEN r.model = 'view' THEN 0.0 ELSE (p * 150 + c * 600) / 1e6 END), 6)::DOUBLE AS cost_usd, round(any_value(CASE WHEN r.model = 'view' THEN 0.0 ELSE (p * 150 + c * 600) / 1e6 / n END), 6)::DOUBLE AS cost_per_case_usd
    FROM r JOIN ok USING (model) GROUP BY r.model""")
def m16(spark, sf):
    runs = events(spark, sf).select(
        F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), F.col("k").alias("prompt_tokens"),
        (F.col("k") * 2).alias("completion_tokens"), F.when(F.col("k") % 10 == 0, "timeout").alias("error"),
    )
    prices = runs.select("model").distinct().where(F.col("model") != "view").select(
        "model", F.lit(150.0).alias("prompt_rate"), F.lit(600.0).alias("completion_rate")
    )
    return rounded(M.run_performance(runs, prices))


def tier_runs(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("tier"), F.when(F.col("user_id") % 2 == 0, "tool_use").otherwise("source_need").alias("suite"),
        (F.col("k") % 3).alias("run_id"), (F.col("value") > 10).alias("passed"),
    )


TIERS = f"pr AS (SELECT event_type AS tier, CASE WHEN user_id % 2 = 0 THEN 'tool_use' ELSE 'source_need' END AS suite, k % 3 AS run_id, avg((value > 10)::INT) AS rate FROM {EV} GROUP BY ALL)"


@query("M17_repeated_runs", f"WITH {TIERS} SELECT tier, suite, count(*)::BIGINT AS runs, round(avg(rate), 6) AS mean_pass_rate, round(min(rate), 6) AS worst_run, round(max(rate), 6) AS best_run FROM pr GROUP BY ALL")
def m17(spark, sf):
    return rounded(M.repeated_runs(tier_runs(spark, sf)))


@query("M17_per_run_rates", f"WITH {TIERS} SELECT tier, suite, run_id, round(rate, 6) AS rate FROM pr")
def m17_runs(spark, sf):
    return rounded(M.per_run_rates(tier_runs(spark, sf)))


@query("M17_mean_rates", f"""
    WITH r AS (SELECT event_type AS tier, CASE WHEN user_id % 2 = 0 THEN 'tool_use' ELSE 'source_need' END AS suite, k % 3 AS run_id,
                      avg(value) AS recall, avg((k % 4 = 0)::INT) AS false_search FROM {EV} GROUP BY ALL)
    SELECT tier, suite, count(*)::BIGINT AS runs, round(avg(recall), 6) AS mean_recall, round(avg(false_search), 6) AS mean_false_search FROM r GROUP BY ALL""")
def m17_means(spark, sf):
    k = F.col("k")
    runs = events(spark, sf).select(
        F.col("event_type").alias("tier"), F.when(F.col("user_id") % 2 == 0, "tool_use").otherwise("source_need").alias("suite"),
        (k % 3).alias("run_id"), F.col("value").alias("recall"), (k % 4 == 0).alias("false_search"),
    )
    return rounded(M.repeated_run_means(runs, ["recall", "false_search"]))


@query("M17_failure_modes_by_run", f"""
    SELECT event_type AS tier, k % 3 AS run_id, reason, count(*)::BIGINT AS cases FROM (
      SELECT event_type, k, unnest(CASE WHEN k % 2 = 0 THEN ['even'] ELSE [] END || CASE WHEN value > 20 THEN ['slow'] ELSE [] END) AS reason FROM {EV}) GROUP BY ALL""")
def m17_modes(spark, sf):
    reasons = F.array_compact(F.array(F.when(F.col("k") % 2 == 0, "even"), F.when(F.col("value") > 20, "slow")))
    rows = events(spark, sf).select(F.col("event_type").alias("tier"), (F.col("k") % 3).alias("run_id"), reasons.alias("failure_reasons"))
    return M.failure_modes(rows, by=["tier", "run_id"])


@query("M18_failure_modes", f"""
    SELECT reason, count(*)::BIGINT AS cases FROM (SELECT unnest(CASE WHEN k % 2 = 0 THEN ['even'] ELSE [] END || CASE WHEN value > 20 THEN ['slow'] ELSE [] END || CASE WHEN event_type = 'error' THEN ['failed'] ELSE [] END) AS reason FROM {EV}) GROUP BY 1""")
def m18(spark, sf):
    reasons = F.array_compact(F.array(
        F.when(F.col("k") % 2 == 0, "even"), F.when(F.col("value") > 20, "slow"), F.when(F.col("event_type") == "error", "failed")
    ))
    return M.failure_modes(events(spark, sf).withColumn("failure_reasons", reasons))


@query("M19_grouped_passes", f"""
    SELECT category, scenario, grouping(category, scenario)::BIGINT AS level, count(*)::BIGINT AS cases, count(*) FILTER (ok)::BIGINT AS passed, sum(k)::BIGINT AS claims, sum(k // 2)::BIGINT AS supported_claims
    FROM (SELECT event_type AS category, user_id % 5 AS scenario, value > 5 AS ok, k FROM {EV}) GROUP BY GROUPING SETS ((category), (scenario), ())""")
def m19(spark, sf):
    rows = events(spark, sf).select(
        F.col("event_type").alias("category"), (F.col("user_id") % 5).alias("scenario"), (F.col("value") > 5).alias("passed"),
        F.col("k").alias("claims"), F.floor(F.col("k") / 2).alias("supported_claims"),
    )
    return M.grouped_passes(rows)


def variant_metrics(spark, sf):
    position = F.element_at(F.create_map(*[F.lit(x) for p in zip(("click", "error", "purchase", "signup", "view"), range(5)) for x in p]), F.col("variant"))
    return events(spark, sf).groupBy((F.col("user_id") % 25).alias("suite"), F.col("event_type").alias("variant")).agg(
        F.round(F.avg("k") / 100, 9).alias("mrr"), F.round(F.avg((F.col("value") > 10).cast("double")), 9).alias("hit_at_1"),
        F.round(F.avg((F.col("value") > 8).cast("double")), 9).alias("avg_coverage"), F.round(F.avg((F.col("value") > 12).cast("double")), 9).alias("full_coverage"),
        F.round(F.avg("k"), 9).alias("useful_pct"), F.round(F.avg("value"), 9).alias("mean_first_rank"),
        F.round(F.avg((F.col("value") > 3).cast("double")), 9).alias("hit_at_5_pct"), F.count(F.when(F.col("k") == 0, 1)).alias("open_pairs"),
    ).withColumn("position", position)


VARIANTS = f"""v AS (SELECT user_id % 25 AS suite, event_type AS variant, round(avg(k) / 100, 9) AS mrr, round(avg((value > 10)::INT), 9) AS h, round(avg((value > 8)::INT), 9) AS ac,
    round(avg((value > 12)::INT), 9) AS fc, round(avg(k), 9) AS u, round(avg(value), 9) AS r, round(avg((value > 3)::INT), 9) AS h5, count(*) FILTER (k = 0) AS opn FROM {EV} GROUP BY ALL)"""


@query("M20_adopt_variant", f"""
    WITH {VARIANTS}, b AS (SELECT suite, variant, mrr, h FROM v QUALIFY row_number() OVER (PARTITION BY suite ORDER BY mrr DESC, h DESC, variant) = 1), base AS (SELECT suite, mrr, h FROM v WHERE variant = 'view')
    SELECT suite, b.variant AS best_variant, round(b.mrr - base.mrr, 6) AS mrr_delta, round(b.h - base.h, 6) AS hit_at_1_delta,
           CASE WHEN b.variant = 'view' OR b.h - base.h > 0 OR b.mrr - base.mrr >= 0.01 THEN b.variant ELSE 'view' END AS adopted FROM b LEFT JOIN base USING (suite)""")
def m20(spark, sf):
    return rounded(M.adopt_variant(variant_metrics(spark, sf), "view"))


@query("M20_adopt_for_coverage", f"""
    WITH {VARIANTS}, b AS (SELECT suite, variant, ac, fc FROM v QUALIFY row_number() OVER (PARTITION BY suite ORDER BY ac DESC, fc DESC, variant) = 1), base AS (SELECT suite, ac, fc FROM v WHERE variant = 'view')
    SELECT suite, b.variant AS best_variant, CASE WHEN b.variant = 'view' OR b.ac - base.ac >= 0.05 OR b.fc - base.fc >= 0.10 THEN b.variant ELSE 'view' END AS adopted FROM b LEFT JOIN base USING (suite)""")
def m20_cov(spark, sf):
    return M.adopt_for_coverage(variant_metrics(spark, sf), "view")


@query("M20_adopt_model", f"""
    WITH {VARIANTS}, s AS (SELECT * FROM v WHERE variant = 'view'), l AS (SELECT * FROM v WHERE variant = 'click'), o AS (SELECT suite, max(opn) AS mo FROM v GROUP BY 1)
    SELECT suite, round(l.u - s.u, 6) AS useful_gain, round(s.r - l.r, 6) AS rank_gain, mo::BIGINT AS unreviewed,
           CASE WHEN mo = 0 AND l.h5 >= s.h5 AND (l.u - s.u >= 2 OR s.r - l.r >= 0.10) THEN 'click' ELSE 'view' END AS decision FROM o LEFT JOIN s USING (suite) LEFT JOIN l USING (suite)""")
def m20_model(spark, sf):
    return rounded(M.adopt_model(variant_metrics(spark, sf), "view", "click", F.col("open_pairs")))


@query("M21_split_coverage", """
    WITH c AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'regression' ELSE 'holdout' END AS split, max(turn) AS t FROM conversations GROUP BY 1)
    SELECT split, count(*)::BIGINT AS total, count(*) FILTER (t > 3)::BIGINT AS scored, count(*) = count(*) FILTER (t > 3) AS complete FROM c GROUP BY 1""")
def m21(spark, sf):
    return split_rows(spark, sf)


@query("M21_dev_regression_gate", """
    WITH c AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1)
    SELECT coalesce(bool_and(t > 3) FILTER (conv_id % 3 < 2), TRUE) AS complete FROM c""")
def m21_gate(spark, sf):
    return M.dev_regression_complete(split_rows(spark, sf))


def split_rows(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.max("turn").alias("t"))
    third = F.col("case_id") % 3
    split = F.when(third == 0, "dev").when(third == 1, "regression").otherwise("holdout")
    done = c.withColumn("status", F.when(F.col("t") > 3, "scored").otherwise("not_run"))
    return M.split_coverage(c.withColumn("split", split).select("case_id", "split"), done.select("case_id", "status"))


@query("M22_variant_table", f"""
    WITH {sql_bm25(20)}, {sql_bm25(20, k1=0.4, b=0.3, name='alt')}, {sql_dense(20)},
    li AS (SELECT query_id, chunk_id, rank, 0 AS source FROM lex UNION ALL SELECT query_id, chunk_id, rank, 1 FROM den),
    fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(source) AS s, arg_min(rank, source) AS r FROM li GROUP BY ALL),
    hy AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, s, r) AS rank FROM fu QUALIFY rank <= 20),
    every AS (SELECT 'bm25' AS variant, query_id, chunk_id, rank FROM lex UNION ALL SELECT 'bm25-flat', query_id, chunk_id, rank FROM alt
              UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM den UNION ALL SELECT 'hybrid', * FROM hy),
    fr AS (SELECT variant, query_id, min(rank) FILTER (source = 'src' || (query_id % 20)) AS first_rank FROM every JOIN documents ON doc_id = chunk_id GROUP BY ALL)
    SELECT variant, {HITS} FROM fr GROUP BY variant""")
def m22(spark, sf):
    (lex, flat), den = both_searches(spark, sf, 20), stored(dense(spark, sf, 20), "dense")
    parts = {"bm25": lex, "bm25-flat": flat, "dense": den, "hybrid": R.fuse(R.stack(lex, den), 20)}
    rows = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("variant"), "query_id", "chunk_id", "rank")
        rows = one if rows is None else rows.unionByName(one)
    ranked = rows.join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    ranks = M.first_hit_rank(ranked, F.col("source") == expected_source(F.col("query_id")), ["variant", "query_id"])
    return hits(M.hit_metrics(ranks, ["variant"]), "variant")


def variant_ranks(spark, sf, results, names):
    """First hit and latency of every (variant, query); results: variant, query_id, chunk_id, rank.

    The latency of a query is its event's value, times the length of the variant's name.
    """
    sources = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source")
    ranked = results.join(sources, "chunk_id").withColumn("hit", F.col("source") == expected_source(F.col("query_id")))
    first = M.first_hit_rank(ranked, F.col("hit"), ["variant", "query_id"])
    asked = bench(spark, sf).select("query_id").join(
        table(spark, sf, "events").select(F.col("event_id").alias("query_id"), "value"), "query_id", "left"
    )
    # Every query has a row for each variant, also where nothing was found.
    each = asked.withColumn("variant", F.explode(F.array(*map(F.lit, names))))
    return each.join(first, ["variant", "query_id"], "left").withColumn("latency_ms", F.col("value") * F.length("variant"))


SIDE_BY_SIDE = f"""
    fr AS (SELECT variant, query_id, min(rank) FILTER (source = 'src' || (query_id % 20)) AS first_rank FROM every JOIN documents ON doc_id = chunk_id GROUP BY ALL),
    side AS (SELECT v.variant, item_id AS query_id, first_rank, value * length(v.variant) AS latency
             FROM benchmark, (SELECT DISTINCT variant FROM every) v LEFT JOIN fr ON fr.variant = v.variant AND fr.query_id = item_id LEFT JOIN events ON event_id = item_id)"""
COMPARED = f"""SELECT variant, {HITS}, count(*) FILTER (first_rank IS NULL)::BIGINT AS missed,
    round(quantile_cont(latency, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency, 0.95), 6) AS p95_latency_ms FROM side GROUP BY variant"""
RETRIEVERS = f"""{sql_bm25(20)}, {sql_dense(20)},
    li AS (SELECT query_id, chunk_id, rank, 0 AS source FROM lex UNION ALL SELECT query_id, chunk_id, rank, 1 FROM den),
    fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(source) AS s, arg_min(rank, source) AS r FROM li GROUP BY ALL),
    hy AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r, s, chunk_id) AS rank FROM fu QUALIFY rank <= 5),
    ah AS (SELECT query_id, chunk_id, 0 AS l, rank AS o FROM hy WHERE rank <= 4 UNION ALL
           SELECT query_id, chunk_id, 1, rank FROM lex WHERE NOT EXISTS (SELECT 1 FROM hy WHERE hy.rank <= 4 AND hy.query_id = lex.query_id AND hy.chunk_id = lex.chunk_id)),
    an AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY l, o) AS rank FROM ah QUALIFY rank <= 5),
    every AS (SELECT 'bm25' AS variant, query_id, chunk_id, rank FROM lex WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM den WHERE rank <= 5
              UNION ALL SELECT 'hybrid', * FROM hy UNION ALL SELECT 'anchored', * FROM an), {SIDE_BY_SIDE}"""


def retrievers(spark, sf):
    lex, den = stored(bm25(spark, sf, 20), "lexical"), stored(dense(spark, sf, 20), "dense")
    both, top = R.stack(lex, den), F.col("rank") <= 5
    parts = {"bm25": lex.where(top), "dense": den.where(top), "hybrid": R.fuse_by_rank(both, 5), "anchored": R.fuse_with_anchor(both, 5)}
    named = [p.select(F.lit(name).alias("variant"), "query_id", "chunk_id", "rank") for name, p in parts.items()]
    return stored(variant_ranks(spark, sf, J.concat_cases(*named), list(parts)), "retrievers")


@query("M22_retrievers", f"WITH {RETRIEVERS} {COMPARED}")
def m22_retrievers(spark, sf):
    return rounded(M.compare_variants(retrievers(spark, sf)))


@query("M22_misses", f"WITH {RETRIEVERS} SELECT variant, query_id FROM side WHERE first_rank IS NULL")
def m22_misses(spark, sf):
    return M.misses(retrievers(spark, sf)).select("variant", "query_id")


WRITER = "CASE query_id % 10 WHEN 0 THEN 'whole' WHEN 1 THEN 'first' ELSE 'second' END"


@query("M22_query_writers", f"""
    WITH {sql_bm25(5, VARIANTS_SQL, name='var')}, every AS (SELECT {WRITER} AS variant, query_id // 10 AS query_id, chunk_id, rank FROM var), {SIDE_BY_SIDE}
    {COMPARED}""")
def m22_writers(spark, sf):
    """Three writers of one case: the whole text, its first half, its second half."""
    found = L.search(docs(spark, sf), variants(spark, sf), 5, chunk_id="doc_id")
    place = F.col("query_id") % 10
    writer = F.when(place == 0, "whole").when(place == 1, "first").otherwise("second")
    results = stored(found.select(writer.alias("variant"), F.floor(F.col("query_id") / 10).alias("query_id"), "chunk_id", "rank"), "writers")
    return rounded(M.compare_variants(variant_ranks(spark, sf, results, ["whole", "first", "second"])))


@query("M23_query_quality", f"""
    WITH {sql_bm25(10)},
    cs AS (SELECT item_id AS case_id, text, 'src' || (item_id % 20) AS src, list_distinct(list_filter({sql_tokens('text')}, lambda t: length(t) > 8)) || ['zzz'] AS terms FROM benchmark),
    r AS (SELECT case_id, min(rank) FILTER (quality = 1) AS u, bool_or(source = src OR lang = 'fr') FILTER (rank = 1) AS t1, bool_or(source = src OR lang = 'fr') FILTER (rank <= 5) AS t5, count(*) AS n
          FROM cs JOIN lex ON query_id = case_id JOIN documents d ON d.doc_id = chunk_id LEFT JOIN labels l ON l.doc_id = chunk_id GROUP BY 1)
    SELECT case_id, u::INTEGER AS useful_rank, coalesce(u <= 3, FALSE) AS useful_at_3, coalesce(t1, FALSE) AS top1_subject_match, coalesce(t5, FALSE) AS any_subject_match,
           round(len(list_filter(terms, lambda t: contains(lower(text), t))) / len(terms)::DOUBLE, 6) AS focus_recall, coalesce(n, 0)::BIGINT AS merged_results, 3 AS vector_searches
    FROM cs LEFT JOIN r USING (case_id)""")
def m23(spark, sf):
    info = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.array("lang", "source").alias("subjects"))
    found = stored(
        bm25(spark, sf, 10).join(info, "chunk_id").select(F.col("query_id").alias("case_id"), "chunk_id", "rank", "subjects"), "found"
    )
    good = found.join(labels(spark, sf).where(F.col("quality") == 1), "chunk_id").groupBy("case_id").agg(F.collect_list("chunk_id").alias("useful"))
    none = F.array().cast("array<bigint>")
    spaces = F.array(F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("a"), F.lit("b")))
    cases = bench(spark, sf).withColumnRenamed("query_id", "case_id").join(good, "case_id", "left").select(
        "case_id", F.col("query").alias("query_text"), F.coalesce("useful", none).alias("useful"),
        F.array(expected_source(F.col("case_id")), F.lit("fr")).alias("expected_subjects"),
        F.concat(long_terms(F.col("query")), F.array(F.lit("zzz"))).alias("focus_terms"), spaces.alias("namespaces"),
    )
    return rounded(M.query_quality(found, cases))


# --- windows and set operations --------------------------------------------

@query("W1_topk_stable_ties", """
    SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice)::INTEGER AS rank FROM lineitem QUALIFY rank <= 3""")
def w1(spark, sf):
    order = [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")]
    return scale.top_k(table(spark, sf, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("W2_newest_n", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS newest FROM events QUALIFY newest <= 3")
def w2(spark, sf):
    from quillrank.sources.files import newest_turns

    return newest_turns(table(spark, sf, "events"), 3, "user_id", ("event_id",)).select("user_id", "event_id", "newest")


@query("W3_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def w3(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value")
    )


@query("W4_first_hit_rank", "SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS first_rank FROM lineitem GROUP BY 1")
def w4(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("rank", F.col("l_linenumber"))
    return M.first_hit_rank(rows, F.col("l_returnflag") == "R", ["l_orderkey"])


STOPS = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"


def sql_content(col):
    return f"list_distinct(list_filter({sql_tokens(col)}, lambda t: length(t) > 2 AND NOT list_contains({STOPS}, t)))"


@query("W5_support_sentences", f"""
    WITH {sql_bm25(5)},
    s AS (SELECT query_id, chunk_id, want, p, trim(unnest(parts), ' ' || chr(10)) AS sentence, generate_subscripts(parts, 1) - 1 AS position FROM (
            SELECT query_id, chunk_id, {sql_content('b.text')} AS want, 0 AS p, string_split(regexp_replace(d.text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)) AS parts
            FROM lex JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id)),
    o AS (SELECT *, len(list_intersect(want, {sql_content('sentence')})) AS ov FROM s WHERE length(sentence) >= 24 AND len(want) > 0)
    SELECT query_id AS claim_id, chunk_id, md5(sentence) AS sentence_md5, position::INTEGER AS position, ov::INTEGER AS overlap, round(ov / len(want)::DOUBLE, 6) AS share,
           row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY ov DESC, position)::INTEGER AS rank FROM o WHERE ov > 0 QUALIFY rank <= 2""")
def w5(spark, sf):
    pairs = bm25(spark, sf).join(bench(spark, sf), "query_id").join(
        docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage")), "chunk_id"
    ).select(F.col("query_id").alias("claim_id"), "chunk_id", F.col("query").alias("claim"), "passage")
    return E.support_sentences(pairs).select(
        "claim_id", "chunk_id", F.md5("sentence").alias("sentence_md5"), "position", "overlap", F.round("share", 6).alias("share"), "rank"
    )


@query("O1_concat_cases", """
    SELECT case_id, role, count(*)::BIGINT AS n FROM (SELECT conv_id AS case_id, role FROM conversations UNION ALL SELECT item_id, NULL FROM benchmark) GROUP BY ALL""")
def o1(spark, sf):
    a = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), "role")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"))
    return J.concat_cases(a, b).groupBy("case_id", "role").agg(F.count("*").alias("n"))


@query("O2_upsert_pools", """
    WITH n AS (SELECT doc_id // 3 AS doc_id, n_chars AS quality FROM documents WHERE n_chars < 900), b AS (SELECT doc_id // 2 AS doc_id, doc_id AS quality FROM labels),
    nk AS (SELECT doc_id, max(quality) AS quality FROM n GROUP BY 1), bk AS (SELECT doc_id, max(quality) AS quality FROM b GROUP BY 1)
    SELECT * FROM nk UNION ALL SELECT doc_id, quality FROM bk WHERE doc_id NOT IN (SELECT doc_id FROM nk)""")
def o2(spark, sf):
    """Keys repeat on both sides; the last row by quality wins."""
    newer = docs(spark, sf).where(F.col("n_chars") < 900).select(F.floor(F.col("doc_id") / 3).alias("doc_id"), F.col("n_chars").alias("quality"))
    base = table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 2).alias("doc_id"), F.col("doc_id").alias("quality"))
    return J.upsert(base, newer, ["doc_id"], order="quality")


@query("O3_pair_sets", f"""
    WITH {sql_bm25(5)}, {ALT}, a AS (SELECT query_id, chunk_id FROM lex), b AS (SELECT query_id, chunk_id FROM alt)
    SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def o3(spark, sf):
    a, b = (stored(d.select("query_id", "chunk_id"), "pairs") for d in (bm25(spark, sf), alt(spark, sf)))
    sides = (("both", a.intersect(b)), ("first", a.exceptAll(b)), ("second", b.exceptAll(a)))
    out = None
    for name, df in sides:
        part = df.withColumn("side", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("O4_routing_errors", """
    WITH r AS (SELECT doc_id FROM documents WHERE contains(text, '%') OR n_chars > 3000), e AS (SELECT doc_id FROM documents WHERE lang = 'fr')
    SELECT doc_id AS query_id, 'false_positive' AS kind FROM r WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT doc_id, 'false_negative' FROM e WHERE doc_id NOT IN (SELECT doc_id FROM r)""")
def o4(spark, sf):
    d = docs(spark, sf).withColumnRenamed("doc_id", "query_id")
    return J.routing_errors(d.where(F.contains("text", F.lit("%")) | (F.col("n_chars") > 3000)), d.where(F.col("lang") == "fr"))


@query("O5_ordered_distinct", f"""
    WITH t AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)),
    f AS (SELECT doc_id, term, min(i) AS i FROM t GROUP BY ALL)
    SELECT doc_id, count(*)::INTEGER AS terms, md5(string_agg(term, ' ' ORDER BY i)) AS terms_md5 FROM f GROUP BY 1""")
def o5(spark, sf):
    terms = F.array_distinct(tokens(F.col("text")))
    return docs(spark, sf).where(F.size(terms) > 0).select("doc_id", F.size(terms).alias("terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


@query("C11_evidence_preview", f"""
    WITH {sql_bm25(5)}
    SELECT query_id, rank::INTEGER AS rank, chunk_id, md5(replace(left(text, 360), chr(10), ' ')) AS preview_md5, round(score, 3) AS score FROM lex JOIN documents ON doc_id = chunk_id""")
def c11(spark, sf):
    chunks = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("chapter"), F.col("lang").alias("subject"), "text")
    found = bm25(spark, sf).select("query_id", "chunk_id", "rank", "score")
    sets = C.evidence_sets(found, chunks, bench(spark, sf))
    return sets.select("query_id", F.explode("evidence").alias("e")).select(
        "query_id", "e.rank", "e.chunk_id", F.md5("e.preview").alias("preview_md5"), "e.score"
    )
