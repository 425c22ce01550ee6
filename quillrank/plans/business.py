"""Queries on unit economics, diagnosis and business snapshots.

Stand-ins: price is extended price per unit, cost a share of it by discount and tax, a
business is a customer, and its snapshot fields come from its orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import economics as U
from quillrank.functions import text as X
from quillrank.operators import snapshot as S
from quillrank.plans.registry import query, table

LINES = "(SELECT *, l_extendedprice / l_quantity AS price, l_extendedprice / l_quantity * (l_discount * 8 + l_tax) AS cogs FROM lineitem)"


def lines(spark, sf):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").withColumn("price", price).withColumn(
        "cogs", price * (F.col("l_discount") * 8 + F.col("l_tax"))
    )


@query("U1_gross_profit_margin", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, round(price - cogs, 9) AS gross_profit, round(CASE WHEN l_returnflag <> 'R' THEN (price - cogs) / price END, 9) AS gross_margin FROM {LINES}""")
def u1(spark, sf):
    # Returned lines count as having no price, which has no margin.
    sold = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("price"))
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(U.gross_profit(F.col("price"), F.col("cogs")), 9).alias("gross_profit"),
        F.round(U.gross_margin(sold, F.col("cogs")), 9).alias("gross_margin"),
    )


MONTHLY = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(DISTINCT o_custkey) FILTER (o_orderstatus <> 'O') AS buyers, sum(o_totalprice) AS revenue, count(*) AS orders,
    avg(o_totalprice) * 1.0001234567 AS avg_price, avg((o_orderstatus = 'F')::INT) AS churn FROM orders GROUP BY 1)"""


def monthly(spark, sf):
    # The factors keep results away from rounding ties, which engines settle differently.
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(
        F.countDistinct(F.when(F.col("o_orderstatus") != "O", F.col("o_custkey"))).alias("buyers"), F.sum("o_totalprice").alias("revenue"),
        F.count("*").alias("orders"), (F.avg("o_totalprice") * 1.0001234567).alias("avg_price"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("churn"),
    )


def rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("U2_cac", f"WITH {MONTHLY} SELECT ym, round(CASE WHEN buyers > 0 THEN revenue * 0.1234567891 / buyers END, 4) AS cac FROM m")
def u2(spark, sf):
    return rounded(monthly(spark, sf).select("ym", U.cac(F.col("revenue") * 0.1234567891, F.col("buyers")).alias("cac")))


@query("U3_lifetime_value", f"""WITH {MONTHLY} SELECT ym, round(CASE WHEN churn > 0 THEN avg_price / churn END, 4) AS lifetime_revenue,
    round(CASE WHEN churn > 0 THEN avg_price / churn * 0.4 END, 4) AS lifetime_gp FROM m""")
def u3(spark, sf):
    p, c = F.col("avg_price"), F.col("churn")
    return rounded(monthly(spark, sf).select(
        "ym", U.lifetime_revenue(p, c).alias("lifetime_revenue"), U.lifetime_gross_profit(p, c, F.lit(0.4)).alias("lifetime_gp")
    ))


@query("U4_ltgp_to_cac", f"WITH {MONTHLY} SELECT ym, round(CASE WHEN buyers > 0 THEN (avg_price / churn * 0.4) / (revenue * 0.1234567891 / buyers) END, 4) AS ratio FROM m WHERE churn > 0")
def u4(spark, sf):
    m = monthly(spark, sf).where(F.col("churn") > 0)
    ltgp = U.lifetime_gross_profit(F.col("avg_price"), F.col("churn"), F.lit(0.4))
    return rounded(m.select("ym", U.ltgp_to_cac(ltgp, U.cac(F.col("revenue") * 0.1234567891, F.col("buyers"))).alias("ratio")))


@query("U5_payback_months", """
    SELECT o_orderkey, CASE WHEN o_totalprice * 0.3 <= c_acctbal * 10 THEN 1.0::DOUBLE WHEN o_orderstatus = 'F' THEN 'inf'::DOUBLE ELSE round(1 + (o_totalprice * 0.3 - c_acctbal * 10) / 500.0::DOUBLE, 6) END AS months
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def u5(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    recurring = F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(500.0)
    return j.select("o_orderkey", F.round(U.payback_months(F.col("o_totalprice") * 0.3, F.col("c_acctbal") * 10, recurring), 6).alias("months"))


@query("U6_cfa_level", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN CASE WHEN l_tax * 1000 >= 2 * l_discount * 1000 THEN 3 WHEN l_tax * 1000 >= l_discount * 1000 THEN 2 ELSE 1 END END AS level FROM lineitem""")
def u6(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", U.cfa_level(F.col("l_discount") * 1000, F.col("l_tax") * 1000).alias("level")
    )


@query("U7_metric_dispatch", """
    WITH e AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)
    SELECT event_id, event_type AS kind,
      round(CASE event_type WHEN 'click' THEN CASE WHEN k % 7 <> 0 THEN value / (k % 7) END WHEN 'view' THEN value - k WHEN 'error' THEN CASE WHEN value > 0 THEN (value - k) / value END
            WHEN 'purchase' THEN CASE WHEN value <= k THEN 1 WHEN k % 5 = 0 THEN 'inf'::DOUBLE ELSE 1 + (value - k) / (k % 5) END END, 6) AS value,
      CASE event_type WHEN 'click' THEN CASE WHEN k % 7 = 0 THEN 'new_customers must be greater than zero' END WHEN 'error' THEN CASE WHEN value <= 0 THEN 'price must be greater than zero' END
            WHEN 'signup' THEN 'unsupported metric: churn' END AS error FROM e""")
def u7(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int").cast("double")
    metric = (
        F.when(kind == "click", "cac").when(kind == "view", "gross-profit").when(kind == "error", "gross-margin")
        .when(kind == "purchase", "payback").otherwise("churn")
    )

    def pairs(**named):
        return F.create_map(*[x for n, c in named.items() for x in (F.lit(n), c)])

    inputs = (
        F.when(kind == "click", pairs(total_acquisition_cost=v, new_customers=k % 7))
        .when(kind == "purchase", pairs(cac=v, month_one_gp=k, monthly_recurring_gp=k % 5)).otherwise(pairs(price=v, cogs=k))
    )
    done = table(spark, sf, "events").withColumn("r", U.calculate(metric, inputs))
    return done.select("event_id", kind.alias("kind"), F.round("r.value", 6).alias("value"), F.col("r.error").alias("error"))


@query("U7_ltgp_and_level", """
    WITH e AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)
    SELECT event_id,
      round(CASE event_type WHEN 'click' THEN CASE WHEN k % 4 > 0 THEN value * 0.5 / (k % 4) END
            WHEN 'view' THEN CASE WHEN k % 6 > 0 THEN CASE WHEN value >= 2 * (k % 6) THEN 3 WHEN value >= k % 6 THEN 2 ELSE 1 END END END, 6) AS value,
      CASE event_type WHEN 'click' THEN CASE WHEN k % 4 <= 0 THEN 'monthly_churn_rate must be greater than zero' END
            WHEN 'view' THEN CASE WHEN k % 6 <= 0 THEN 'acquisition_cost must be greater than zero' END ELSE 'missing input: gross_margin' END AS error FROM e""")
def u7_more(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int").cast("double")

    def pairs(**named):
        return F.create_map(*[x for n, c in named.items() for x in (F.lit(n), c)])

    inputs = (
        F.when(kind == "click", pairs(monthly_price=v, monthly_churn_rate=k % 4, gross_margin=F.lit(0.5)))
        .when(kind == "view", pairs(cac=k % 6, first_30_day_gp=v)).otherwise(pairs(monthly_price=v, monthly_churn_rate=F.lit(1.0)))
    )
    metric = F.when(kind == "view", "cfa-level").otherwise("ltgp")
    done = table(spark, sf, "events").withColumn("r", U.calculate(metric, inputs))
    return done.select("event_id", F.round("r.value", 6).alias("value"), F.col("r.error").alias("error"))


@query("U8_constraint_diagnosis", """
    WITH e AS (SELECT o_orderkey, o_totalprice * 0.05 AS cac, c_acctbal * 4 AS f30, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 900.0 END AS rec,
                      CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN c_acctbal * 9 END AS lt, (c_acctbal + 2000) / 12000 AS mg, c_mktsegment = 'HOUSEHOLD' AS svc
               FROM orders JOIN customer ON c_custkey = o_custkey),
    d AS (SELECT *, CASE WHEN NOT cac > 0 THEN NULL WHEN cac <= f30 THEN 1 WHEN rec <= 0 THEN 'inf'::DOUBLE ELSE 1 + (cac - f30) / rec END AS pb,
                 CASE WHEN NOT cac > 0 THEN NULL WHEN f30 >= 2 * cac THEN 3 WHEN f30 >= cac THEN 2 ELSE 1 END AS lv FROM e),
    o AS (SELECT *, CASE WHEN NOT cac > 0 THEN NULL WHEN lt / cac < 3 THEN 'viability' WHEN svc AND mg < 0.8 THEN 'gross-margin' WHEN lv = 1 THEN 'monetization' WHEN pb > 6 THEN 'cash-constraint'
                 WHEN lv = 2 THEN 'cfa-level-2' ELSE 'scale-ready' END AS c FROM d)
    SELECT o_orderkey, c AS "constraint", CASE WHEN c = 'viability' THEN CASE WHEN lt / cac < 1 THEN 2 ELSE 3 END WHEN c = 'gross-margin' THEN 1 WHEN c = 'cash-constraint' THEN 3 WHEN c IS NOT NULL THEN 2 END AS sections,
           round(lt / cac, 2) AS ltgp_to_cac, CASE WHEN c IN ('monetization', 'cash-constraint', 'cfa-level-2', 'scale-ready') THEN lv END AS cfa_level,
           CASE WHEN c IN ('monetization', 'cash-constraint', 'cfa-level-2', 'scale-ready') THEN CASE WHEN pb = 'inf'::DOUBLE THEN 'inf' ELSE round(pb, 2)::VARCHAR END END AS payback FROM o""")
def u8(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    bal = F.col("c_acctbal")
    d = U.diagnose(
        F.col("o_totalprice") * 0.05, bal * 4, F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(900.0),
        F.when(F.col("o_orderpriority").rlike("^[12]"), bal * 9), (bal + 2000) / 12000, F.col("c_mktsegment") == "HOUSEHOLD",
    )
    return j.select("o_orderkey", d.alias("d")).select(
        "o_orderkey", "d.constraint", F.size("d.sections").alias("sections"), "d.ltgp_to_cac", "d.cfa_level", "d.payback"
    )


# --- snapshots -------------------------------------------------------------

def payloads(spark, sf):
    """(business, payload): one JSON snapshot per customer, sections missing for some."""
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("p")
    )
    c = table(spark, sf, "customer").join(orders, "c_custkey", "left")
    business = F.struct(
        F.col("c_mktsegment").alias("business_type"), F.when(key % 3 != 0, F.col("c_name")).alias("icp"),
        F.when(key % 11 == 0, F.lit("x")).alias("colour"),
    )

    def position(test):
        return F.struct(F.when(test, F.lit(True)).alias("exists"))

    model = F.struct(
        position(key % 5 != 0).alias("attraction_offer"),
        F.struct(F.when(F.col("n") > 0, F.lit("orders")).alias("description"), F.col("p").alias("price")).alias("core_offer"),
        position(key % 7 != 0).alias("upsell"), position(F.lit(True)).alias("downsell"), position(F.lit(True)).alias("continuity"),
    )
    econ = F.struct(
        F.when(key % 4 != 0, F.lit(400.0)).alias("cac"), F.when(bal > 0, bal / 10).alias("first_30_day_gross_profit"),
        F.when(F.col("n") > 8, F.lit(40.0)).alias("monthly_recurring_gross_profit"),
    )
    problem = F.struct(
        F.when(key % 9 != 0, F.lit("grow")).alias("user_goal"),
        F.when(key % 13 == 0, F.array(F.lit("viability"))).otherwise(F.array().cast("array<string>")).alias("diagnosed_constraints"),
        F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.col("c_mktsegment")).alias("reported_symptoms"),
    )
    full = F.to_json(F.struct(business.alias("business"), model.alias("money_model"), econ.alias("economics"), problem.alias("problem")))
    bare = F.to_json(F.struct(business.alias("business"), F.lit(1).alias("extra")))
    return c.select(key.alias("business"), F.when(key % 10 == 0, bare).otherwise(full).alias("payload"))


SNAP = """
    o AS (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 2) AS p FROM orders GROUP BY 1),
    s AS (SELECT c_custkey AS k, c_mktsegment AS bt, CASE WHEN k % 3 <> 0 THEN c_name END AS icp, k % 10 = 0 AS bare,
                 CASE WHEN NOT bare AND k % 5 <> 0 THEN TRUE END AS att, CASE WHEN NOT bare AND n > 0 THEN 'orders' END AS core, CASE WHEN NOT bare AND k % 7 <> 0 THEN TRUE END AS ups,
                 CASE WHEN NOT bare AND k % 4 <> 0 THEN 400.0::DOUBLE END AS cac, CASE WHEN NOT bare AND c_acctbal > 0 THEN c_acctbal / 10 END AS f30, CASE WHEN NOT bare AND n > 8 THEN 40.0::DOUBLE END AS rec,
                 CASE WHEN NOT bare AND k % 9 <> 0 THEN 'grow' END AS goal, NOT bare AND k % 13 = 0 AS diag, p
          FROM customer LEFT JOIN o ON o_custkey = c_custkey),
    f AS (SELECT *, coalesce(f30 < cac AND rec IS NULL, FALSE) AS needs_rec,
                 list_filter([CASE WHEN goal IS NULL THEN 'problem.user_goal' END, CASE WHEN icp IS NULL THEN 'business.icp' END, CASE WHEN core IS NULL THEN 'money_model.core_offer.description' END,
                   CASE WHEN att IS NULL THEN 'money_model.attraction_offer.exists' END, CASE WHEN ups IS NULL THEN 'money_model.upsell.exists' END,
                   CASE WHEN bare THEN 'money_model.downsell.exists' END, CASE WHEN bare THEN 'money_model.continuity.exists' END, CASE WHEN cac IS NULL THEN 'economics.cac' END,
                   CASE WHEN f30 IS NULL THEN 'economics.first_30_day_gross_profit' END, CASE WHEN f30 < cac AND rec IS NULL THEN 'economics.monthly_recurring_gross_profit' END], lambda x: x IS NOT NULL) AS miss FROM s)"""



def named(spark, sf):
    """Parsed and refreshed snapshots with the customer key as `id`."""
    raw = payloads(spark, sf).withColumnRenamed("business", "id")
    return S.refresh(S.parse_snapshots(raw))


@query("S4_snapshot_scan", f"""
    WITH {SNAP} SELECT k AS id, bt AS business_type, core AS core_description, cac, CASE WHEN bare THEN 0 ELSE 4 END AS symptoms,
           array_to_string(list_filter([CASE WHEN bare THEN 'extra' END, CASE WHEN k % 11 = 0 THEN 'business.colour' END], lambda x: x IS NOT NULL), ',') AS unknown_keys FROM s""")
def s4(spark, sf):
    return named(spark, sf).select(
        "id", "business.business_type", F.col("money_model.core_offer.description").alias("core_description"), "economics.cac",
        F.size("problem.reported_symptoms").alias("symptoms"), F.array_join("unknown_keys", ",").alias("unknown_keys"),
    )


@query("U9_snapshot_refresh", f"""
    WITH {SNAP} SELECT k AS id, round(CASE WHEN cac IS NULL OR f30 IS NULL OR needs_rec THEN NULL WHEN cac <= f30 THEN 1 WHEN coalesce(rec, 0) <= 0 THEN NULL ELSE 1 + (cac - f30) / rec END, 6)::DOUBLE AS payback_period_months,
      array_to_string(miss, ',') AS missing, NOT list_has_any(miss, ['problem.user_goal', 'money_model.core_offer.description', 'economics.cac', 'economics.first_30_day_gross_profit', 'economics.monthly_recurring_gross_profit']) AS payback_ready,
      NOT list_has_any(miss, ['problem.user_goal', 'business.icp', 'money_model.core_offer.description', 'money_model.attraction_offer.exists', 'money_model.upsell.exists', 'money_model.downsell.exists', 'money_model.continuity.exists']) AS stack_ready,
      CASE WHEN diag AND stack_ready THEN 'recommendable' WHEN diag THEN 'diagnosed' WHEN payback_ready THEN 'diagnosable' ELSE 'insufficient_context' END AS advisory_status FROM f""")
def u9(spark, sf):
    return named(spark, sf).select(
        "id", F.round("payback_period_months", 6).alias("payback_period_months"), F.array_join("missing_fields", ",").alias("missing"),
        F.col("ready_for_payback_diagnosis").alias("payback_ready"), F.col("ready_for_offer_stack_diagnosis").alias("stack_ready"), "advisory_status",
    )


ASSIGNED = """
    a AS (SELECT o_custkey AS business, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'economics.cac' WHEN '2-HIGH' THEN 'business.icp' WHEN '3-MEDIUM' THEN 'money_model.upsell.exists' WHEN '5-LOW' THEN 'problem.user_goal' ELSE 'business.colour' END AS field,
                 CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice::VARCHAR WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE 'shops' END WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END ELSE '"goal ' || o_orderkey || '"' END AS value,
                 CASE WHEN o_orderstatus = 'F' THEN 'file' ELSE 'conversation' END AS source_type FROM orders),
    l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY business, field ORDER BY seq DESC) = 1)"""


def assignments(spark, sf):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    field = (
        F.when(p == "1-URGENT", "economics.cac").when(p == "2-HIGH", "business.icp").when(p == "3-MEDIUM", "money_model.upsell.exists")
        .when(p == "5-LOW", "problem.user_goal").otherwise("business.colour")
    )
    value = (
        F.when(p == "1-URGENT", F.col("o_totalprice").cast("string")).when(p == "2-HIGH", F.when(k % 4 == 0, "null").otherwise("shops"))
        .when(p == "3-MEDIUM", F.when(k % 2 == 0, "true").otherwise("false")).otherwise(F.concat(F.lit('"goal '), k.cast("string"), F.lit('"')))
    )
    file = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("business"), k.alias("seq"), field.alias("field"), value.alias("value"),
        F.when(file, "file").otherwise("conversation").alias("source_type"), F.when(file, F.concat(F.lit("docs/"), k.cast("string"))).alias("source"),
        F.when(file, F.concat(F.lit("sha256:"), F.sha2(k.cast("string"), 256))).alias("source_hash"),
    )


@query("U10_latest_assignments", f"""
    WITH {ASSIGNED} SELECT business, field, seq, value, source_type, CASE WHEN source_type = 'file' THEN 'sha256:' || sha256(seq::VARCHAR) END AS source_hash FROM l""")
def u10(spark, sf):
    return S.latest_assignments(assignments(spark, sf)).select("business", "field", "seq", "value", "source_type", "source_hash")


@query("U10_snapshot_fold", f"""
    WITH {ASSIGNED} SELECT business, max(CASE WHEN field = 'economics.cac' THEN value::DOUBLE END) AS cac, max(CASE WHEN field = 'business.icp' THEN nullif(value, 'null') END) AS icp,
      bool_or(CASE WHEN field = 'money_model.upsell.exists' THEN value = 'true' END) AS upsell, max(CASE WHEN field = 'problem.user_goal' THEN trim(value, '"') END) AS goal, count(*)::INTEGER AS sources
    FROM (SELECT * FROM l WHERE field <> 'business.colour' AND (field <> 'economics.cac' OR try_cast(value AS DOUBLE) IS NOT NULL)) GROUP BY 1""")
def u10_fold(spark, sf):
    folded, _ = S.fold_assignments(S.latest_assignments(assignments(spark, sf)))
    return folded.select(
        "business", "economics.cac", "business_info.icp", F.col("money_model.upsell.exists").alias("upsell"),
        F.col("problem.user_goal").alias("goal"), F.size("field_sources").alias("sources"),
    )


@query("U10_unknown_fields", f"WITH {ASSIGNED} SELECT business, 'unknown snapshot field path: ' || field AS error FROM l WHERE field = 'business.colour'")
def u10_bad(spark, sf):
    return S.fold_assignments(S.latest_assignments(assignments(spark, sf)))[1].select("business", "error")


@query("U11_known_facts", f"""
    WITH {SNAP} SELECT k AS id, (1 + (icp IS NOT NULL)::INT + (att IS NOT NULL)::INT + (core IS NOT NULL)::INT + (NOT bare AND p IS NOT NULL)::INT + (ups IS NOT NULL)::INT + 2 * (NOT bare)::INT + (cac IS NOT NULL)::INT + (f30 IS NOT NULL)::INT
           + (rec IS NOT NULL)::INT + (NOT (cac IS NULL OR f30 IS NULL OR needs_rec OR (cac > f30 AND coalesce(rec, 0) <= 0)))::INT + (goal IS NOT NULL)::INT)::INTEGER AS facts,
           CASE WHEN bare THEN 0 ELSE 4 END AS symptom_count, CASE WHEN bare THEN '' ELSE 'b,c,' || bt END AS recent FROM f""")
def u11(spark, sf):
    return S.known_facts(named(spark, sf)).select(
        "id", F.size("facts").alias("facts"), "symptom_count", F.array_join("recent_symptoms", ",").alias("recent")
    )


@query("U8_snapshot_diagnosis", f"""
    WITH {SNAP} SELECT k AS id, CASE WHEN cac IS NULL THEN NULL WHEN coalesce(f30, 0) >= 2 * cac THEN 'scale-ready' WHEN coalesce(f30, 0) >= cac THEN 'cfa-level-2' ELSE 'monetization' END AS "constraint", FALSE AS service FROM s""")
def u8_snap(spark, sf):
    return S.diagnose_snapshots(named(spark, sf)).select(
        "id", F.col("diagnosis.constraint").alias("constraint"), F.col("service_business").alias("service")
    )


@query("X6_answer_cleaning", """
    WITH r AS (SELECT o_custkey AS business, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'economics.cac' WHEN '2-HIGH' THEN 'economics.gross_margin' WHEN '3-MEDIUM' THEN 'money_model.upsell.exists' WHEN '5-LOW' THEN 'money_model.core_offer.description' ELSE 'business.icp' END AS field, * FROM orders),
    v AS (SELECT business, seq, field, CASE o_orderpriority WHEN '1-URGENT' THEN round(o_totalprice, 2) WHEN '2-HIGH' THEN (o_orderkey % 100) / 100.0::DOUBLE END AS num,
                 CASE o_orderpriority WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END WHEN '5-LOW' THEN 'item ' || o_orderkey WHEN '4-NOT SPECIFIED' THEN 'b' || o_custkey END AS txt,
                 o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS bad FROM r WHERE NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0))
    SELECT business, seq, field, CASE WHEN NOT bad THEN round(num, 4) END AS num, CASE WHEN NOT bad THEN txt END AS txt, bad AS failed FROM v
    UNION ALL SELECT business, seq, 'money_model.core_offer.exists', NULL, 'true', FALSE FROM v WHERE field LIKE '%description'""")
def x6(spark, sf):
    p, k, st = F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderstatus")
    field = (
        F.when(p == "1-URGENT", "economics.cac").when(p == "2-HIGH", "economics.gross_margin").when(p == "3-MEDIUM", "money_model.upsell.exists")
        .when(p == "5-LOW", "money_model.core_offer.description").otherwise("business.icp")
    )
    raw = (
        F.when(p == "1-URGENT", F.when(st == "P", "a lot").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2))))
        .when(p == "2-HIGH", F.concat((k % 100).cast("string"), F.lit("%")))
        .when(p == "3-MEDIUM", F.when(st == "F", "Yes").when(st == "O", "no").otherwise("maybe"))
        .when(p == "5-LOW", F.concat(F.lit("item "), k.cast("string")))
        .otherwise(F.when(k % 2 == 0, "  ").otherwise(F.concat(F.lit("b"), F.col("o_custkey").cast("string"))))
    )
    answers = table(spark, sf, "orders").select(F.col("o_custkey").alias("business"), k.alias("seq"), field.alias("field"), raw.alias("raw"))
    clean = S.clean_answers(answers)
    numeric = F.startswith("field", F.lit("economics."))
    return clean.select(
        "business", "seq", "field", F.when(numeric, F.round(F.expr("try_cast(value AS double)"), 4)).alias("num"),
        F.when(~numeric, F.col("value")).alias("txt"), F.col("error").isNotNull().alias("failed"),
    )


@query("X6_nested_answers", """
    WITH r AS (SELECT o_custkey AS business, o_orderkey AS seq, o_orderkey % 7 AS k, * FROM orders WHERE o_orderkey % 11 > 0),
    v AS (
      SELECT business, seq, 'economics.cac' AS field, CASE WHEN k <> 3 THEN round(o_totalprice, 2) END AS num, NULL AS txt, k = 3 AS failed FROM r
      UNION ALL SELECT business, seq, 'money_model.upsell.price', o_custkey + 0.5::DOUBLE, NULL, FALSE FROM r WHERE k <> 4
      UNION ALL SELECT business, seq, 'money_model.upsell.description', NULL, 'item "' || o_orderkey || '"', FALSE FROM r WHERE k <> 5
      UNION ALL SELECT business, seq, 'money_model.upsell.exists', NULL, 'true', FALSE FROM r WHERE k <> 5
      UNION ALL SELECT business, seq, 'money_model.continuity.exists', NULL, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, FALSE FROM r
      UNION ALL SELECT business, seq, 'business.icp', NULL, '["' || o_orderstatus || '",' || k || ']', FALSE FROM r
      UNION ALL SELECT business, seq, 'problem.user_goal', NULL, o_orderpriority, FALSE FROM r)
    SELECT business, seq, field, round(num, 4) AS num, txt, failed FROM v
    UNION ALL SELECT o_custkey, o_orderkey, NULL, NULL, NULL, TRUE FROM orders WHERE o_orderkey % 11 = 0""")
def x6_nested(spark, sf):
    """Answers two levels deep with a list, nulls, blanks, an empty object, and records that are no object."""
    k = F.col("o_orderkey") % 7
    price = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    answers = F.struct(
        F.struct(F.when(k == 3, "a lot").otherwise(price).alias("cac")).alias("economics"),
        F.struct(
            F.struct(
                F.when(k != 4, F.col("o_custkey") + F.lit(0.5)).alias("price"),
                F.when(k == 5, " ").otherwise(F.concat(F.lit('item "'), F.col("o_orderkey").cast("string"), F.lit('"'))).alias("description"),
            ).alias("upsell"),
            F.struct((k % 2 == 0).alias("exists")).alias("continuity"),
            F.create_map().cast("map<string,string>").alias("attraction"),
        ).alias("money_model"),
        F.col("o_orderpriority").alias("problem.user_goal"),
        F.struct(F.lit(None).cast("string").alias("business_type"), F.lit("@").alias("icp")).alias("business"),
    )
    text = F.to_json(answers, {"ignoreNullFields": "false"})
    listed = F.concat(F.lit('["'), F.col("o_orderstatus"), F.lit('", '), k.cast("string"), F.lit("]"))
    records = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("business"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 22 == 0, "[1]").when(F.col("o_orderkey") % 11 == 0, "{not")
        .otherwise(F.replace(text, F.lit('"@"'), listed)).alias("answers"),
    )
    clean = S.clean_records(records)
    numeric = F.coalesce(F.col("field").rlike(r"^economics\.|price$"), F.lit(False))
    return clean.select(
        "business", "seq", "field", F.when(numeric, F.round(F.expr("try_cast(value AS double)"), 4)).alias("num"),
        F.when(~numeric, F.col("value")).alias("txt"), F.col("error").isNotNull().alias("failed"),
    )


@query("B2_field_projection", f"""
    WITH {SNAP} SELECT k AS id, bt AS business_type, cac, NOT bare AS has_model, goal AS user_goal FROM s""")
def b2(spark, sf):
    shown = S.visible_sections(named(spark, sf))

    def pick(path):
        return F.get_json_object("facts_json", path)

    return shown.select(
        "id", pick("$.business.business_type").alias("business_type"), pick("$.economics.cac").cast("double").alias("cac"),
        pick("$.money_model").isNotNull().alias("has_model"), pick("$.problem.user_goal").alias("user_goal"),
    )


FACTS = """SELECT p_partkey, coalesce('{' || nullif(concat_ws(',', CASE WHEN p_size % 3 <> 0 THEN '"name":"' || p_name || '"' END, '"size":' || p_size || ',"on":false',
    CASE WHEN p_size % 2 = 0 THEN '"tags":["' || p_type || '"]' END, CASE WHEN p_size % 5 = 0 THEN '"deep":{"n":0}' END), '') || '}', '') AS js FROM part"""


def facts(spark, sf):
    size = F.col("p_size")
    body = F.struct(
        F.when(size % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), size.alias("size"), F.lit(False).alias("on"),
        F.array(F.when(size % 2 == 0, F.col("p_type")).otherwise(""), F.lit(None).cast("string")).alias("tags"),
        F.struct(F.when(size % 5 == 0, F.lit(0)).alias("n"), F.lit(None).cast("string").alias("m")).alias("deep"),
        F.create_map(F.lit("k"), F.lit("")).alias("notes"),
    )
    rows = table(spark, sf, "part").select("p_partkey", "p_name", body.alias("b"))
    return rows.withColumn("js", F.to_json(X.prune_empty(F.col("b"), rows.schema["b"].dataType)))


@query("X10_prune_empty", f"SELECT p_partkey, md5(js) AS json_md5 FROM ({FACTS})")
def x10(spark, sf):
    return facts(spark, sf).select("p_partkey", F.md5("js").alias("json_md5"))


@query("X17_prompt_table", f"""
    SELECT p_partkey, md5('Write one query.' || chr(10) || chr(10) || '## Current user question' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '## Saved business facts' || chr(10) || chr(10) || '```json' || chr(10) || js || chr(10) || '```' || chr(10)) AS prompt_md5
    FROM ({FACTS}) JOIN part USING (p_partkey)""")
def x17(spark, sf):
    return facts(spark, sf).select("p_partkey", F.md5(X.prompt_text("Write one query.", F.col("p_name"), F.col("js"))).alias("prompt_md5"))


@query("X17_prompt_with_guide", f"""
    SELECT p_partkey, md5('Write one query.' || chr(10) || chr(10) || '## Current user question' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '## Saved business facts' || chr(10) || chr(10) || '```json' || chr(10) || js || chr(10) || '```'
      || chr(10) || chr(10) || 'Use the guide.' || chr(10) || chr(10) || '## Corpus guide' || chr(10) || chr(10) || '```json' || chr(10) || '["' || p_name || '"]' || chr(10) || '```' || chr(10)) AS prompt_md5
    FROM ({FACTS}) JOIN part USING (p_partkey)""")
def x17_guide(spark, sf):
    guide = F.concat(F.lit('["'), F.col("p_name"), F.lit('"]'))
    return facts(spark, sf).select(
        "p_partkey", F.md5(X.prompt_text("Write one query.", F.col("p_name"), F.col("js"), guide, "Use the guide.")).alias("prompt_md5")
    )
