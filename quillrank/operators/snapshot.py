"""Business snapshots: reading, updating by field assignments, and derived state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank import constants as K
from quillrank.functions import economics
from quillrank.functions.text import strip

POSITION = T.StructType(
    [
        T.StructField("exists", T.BooleanType()),
        T.StructField("description", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)
BUSINESS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("business_type", "icp", "delivery_model")]
)
MONEY_MODEL = T.StructType([T.StructField(n, POSITION) for n in K.STACK_POSITIONS])
ECONOMICS = T.StructType([T.StructField(n, T.DoubleType()) for n in K.ECONOMICS_FIELDS])
PROBLEM = T.StructType(
    [
        T.StructField("user_goal", T.StringType()),
        T.StructField("reported_symptoms", T.ArrayType(T.StringType())),
        T.StructField("diagnosed_constraints", T.ArrayType(T.StringType())),
    ]
)
SECTIONS = {"business": BUSINESS, "money_model": MONEY_MODEL, "economics": ECONOMICS, "problem": PROBLEM}
TOP_KEYS = ("schema_version", *SECTIONS, "advisor_state", "field_sources")

LIST_FIELDS = ("problem.reported_symptoms", "problem.diagnosed_constraints")
FIELDS = {
    **{f"business.{f.name}": "string" for f in BUSINESS.fields},
    **{
        f"money_model.{p}.{f.name}": f.dataType.simpleString()
        for p in K.STACK_POSITIONS for f in POSITION.fields
    },
    **{f"economics.{n}": "double" for n in K.ECONOMICS_FIELDS},
    "problem.user_goal": "string",
    **{n: "array<string>" for n in LIST_FIELDS},
}
# Levels of nested answers that are opened.
NESTING = 8


def _prefixed(keys: Column, section: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{section}."), k))


def parse_snapshots(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse JSON snapshots; missing sections take defaults, unknown keys are listed.

    Adds schema_version, one struct column per section and unknown_keys.
    """
    text = F.col(payload)
    top = F.from_json(text, "map<string,string>")
    out = df.withColumn("_top", top)
    unknown = [F.array_except(F.map_keys("_top"), F.array(*[F.lit(k) for k in TOP_KEYS]))]
    for name, kind in SECTIONS.items():
        section = F.try_element_at("_top", F.lit(name))
        parsed = F.coalesce(F.from_json(section, kind), F.from_json(F.lit("{}"), kind))
        if name == "money_model":
            parsed = F.struct(
                *[F.coalesce(parsed[p], F.from_json(F.lit("{}"), POSITION)).alias(p) for p in K.STACK_POSITIONS]
            )
        if name == "problem":
            parsed = F.struct(
                parsed["user_goal"].alias("user_goal"),
                *[
                    F.coalesce(parsed[c], F.array().cast("array<string>")).alias(c)
                    for c in ("reported_symptoms", "diagnosed_constraints")
                ],
            )
        out = out.withColumn(name, parsed)
        known = F.array(*[F.lit(f.name) for f in kind.fields])
        keys = F.coalesce(F.map_keys(F.from_json(section, "map<string,string>")), F.array())
        extra = F.array_except(keys, known)
        # Positions of the money model may carry any name; unknown ones are ignored.
        if name != "money_model":
            unknown.append(_prefixed(extra, name))
    return out.withColumn(
        "schema_version", F.coalesce(F.try_element_at("_top", F.lit("schema_version")), F.lit(K.SNAPSHOT_VERSION))
    ).withColumn("unknown_keys", F.flatten(F.array(*unknown))).drop("_top")


def payback(econ: Column) -> Column:
    """Derived payback months: null when unknown or never reached."""
    cac, first, monthly = econ["cac"], econ["first_30_day_gross_profit"], econ["monthly_recurring_gross_profit"]
    months = economics.payback_months(cac, first, F.coalesce(monthly, F.lit(0.0)))
    return (
        F.when(cac.isNull() | first.isNull(), F.lit(None))
        .when((first < cac) & monthly.isNull(), F.lit(None))
        .otherwise(F.when(months != economics.INFINITY, months))
    ).cast("double")


def _known_payback(econ: Column) -> Column:
    cac, first, monthly = econ["cac"], econ["first_30_day_gross_profit"], econ["monthly_recurring_gross_profit"]
    return cac.isNotNull() & first.isNotNull() & ~F.coalesce((first < cac) & monthly.isNull(), F.lit(False))


def missing_fields() -> Column:
    """Missing field names over the section columns, in a fixed order."""
    econ = F.col("economics")
    cac, first = econ["cac"], econ["first_30_day_gross_profit"]

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    checks: list[tuple[str, Column]] = [
        (n, blank(n))
        for n in ("problem.user_goal", "business.business_type", "business.icp", "money_model.core_offer.description")
    ]
    checks += [
        (f"money_model.{p}.exists", F.col(f"money_model.{p}.exists").isNull())
        for p in ("attraction_offer", "upsell", "downsell", "continuity")
    ]
    checks += [
        ("economics.cac", cac.isNull()),
        ("economics.first_30_day_gross_profit", first.isNull()),
        (
            "economics.monthly_recurring_gross_profit",
            (first < cac) & econ["monthly_recurring_gross_profit"].isNull(),
        ),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def refresh(snapshots: DataFrame) -> DataFrame:
    """Add payback_period_months, missing_fields, both readiness flags and the status."""
    def ready(needs: tuple[str, ...]) -> Column:
        return ~F.arrays_overlap("missing_fields", F.array(*[F.lit(n) for n in needs]))

    diagnosed = F.size(F.coalesce(F.col("problem.diagnosed_constraints"), F.array())) > 0
    out = (
        snapshots.withColumn("payback_period_months", payback(F.col("economics")))
        .withColumn("missing_fields", missing_fields())
        .withColumn("ready_for_payback_diagnosis", ready(K.PAYBACK_NEEDS))
        .withColumn("ready_for_offer_stack_diagnosis", ready(K.STACK_NEEDS))
        .withColumn(
            "advisory_status",
            F.when(diagnosed & F.col("ready_for_offer_stack_diagnosis"), "recommendable")
            .when(diagnosed, "diagnosed")
            .when(F.col("ready_for_payback_diagnosis"), "diagnosable")
            .otherwise("insufficient_context"),
        )
        .withColumn("payback_is_calculated", _known_payback(F.col("economics")))
    )
    return out.withColumn("economics", F.col("economics").withField("payback_period_months", F.col("payback_period_months")))


def latest_assignments(assignments: DataFrame) -> DataFrame:
    """Last value and provenance per (business, field); ties in seq go to the larger value.

    Works on batches and, with an output mode of update or complete, on streams.
    """
    return assignments.groupBy("business", "field").agg(
        F.max(F.struct("seq", "value", "source_type", "source", "source_hash")).alias("_l")
    ).select("business", "field", "_l.*")


def fold_assignments(latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots with section structs and field_sources, rows with unknown fields)."""
    known = F.col("field").isin(list(FIELDS))
    bad = latest.where(~known).withColumn("error", F.concat(F.lit("unknown snapshot field path: "), F.col("field")))
    # An assigned value is JSON where it reads as JSON: null words clear, quotes are dropped.
    given = F.col("value")
    quoted = F.from_json(F.concat(F.lit("["), given, F.lit("]")), "array<string>")
    plain = F.when(F.lower(given).isin("none", "null"), F.lit(None)).when(
        given.rlike(r'^".*"$'), F.coalesce(F.get(quoted, F.lit(0)), given)
    ).otherwise(given)
    raw = {f: F.max(F.when(F.col("field") == f, plain)).alias(f.replace(".", "__")) for f in FIELDS}
    source = F.struct("source_type", "source", "source_hash")
    # One entry per known field: the map cannot grow with the number of assignments.
    wide = latest.where(known).groupBy("business").agg(
        *raw.values(), F.map_from_entries(F.collect_list(F.struct("field", source))).alias("field_sources")
    )

    def value(field: str) -> Column:
        col = F.col(field.replace(".", "__"))
        kind = FIELDS[field]
        if kind == "array<string>":
            return F.coalesce(F.from_json(col, kind), F.array().cast(kind))
        if kind == "boolean":
            return F.when(F.lower(col).isin("true", "false"), F.lower(col) == "true")
        return F.expr(f"try_cast(`{field.replace('.', '__')}` AS {kind})")

    def section(prefix: str, names) -> Column:
        return F.struct(*[value(f"{prefix}.{n}").alias(n) for n in names])

    out = wide.select(
        "business",
        section("business", [f.name for f in BUSINESS.fields]).alias("business_info"),
        F.struct(
            *[section(f"money_model.{p}", [f.name for f in POSITION.fields]).alias(p) for p in K.STACK_POSITIONS]
        ).alias("money_model"),
        section("economics", K.ECONOMICS_FIELDS).alias("economics"),
        section("problem", [f.name for f in PROBLEM.fields]).alias("problem"),
        "field_sources",
    )
    return out, bad


def clean_answers(answers: DataFrame) -> DataFrame:
    """Typed answer rows: (business, seq, field, value, error).

    answers: business, seq, field, raw. Money signs, thousands commas and percent signs
    are read; yes and no words become booleans; blanks are dropped; a description also
    sets its position's `exists`.
    """
    raw = strip(F.col("raw"))
    number = F.regexp_replace(raw, "[$,]", "")
    is_percent = F.endswith(number, F.lit("%"))
    parsed = F.expr("try_cast(_n AS double)")
    kind = (
        F.when(F.col("field").rlike(r"^economics\.|\.price$"), "double")
        .when(F.endswith("field", F.lit(".exists")), "boolean").otherwise("string")
    )
    low = F.lower(raw)
    flag = F.when(low.isin(list(K.YES_WORDS)), "true").when(low.isin(list(K.NO_WORDS)), "false")
    rows = (
        answers.where(F.coalesce(raw, F.lit("")) != "")
        .withColumn("_kind", kind)
        .withColumn("_n", F.when(is_percent, F.regexp_replace(number, "%$", "")).otherwise(number))
        .withColumn("_num", F.when(is_percent, parsed / 100).otherwise(parsed))
        .withColumn(
            "value",
            F.when(F.col("_kind") == "double", F.col("_num").cast("string"))
            .when(F.col("_kind") == "boolean", flag).otherwise(raw),
        )
        .withColumn(
            "error",
            F.when(F.col("value").isNull(), F.concat(F.lit("cannot parse "), F.col("_kind"), F.lit(" value: "), raw)),
        )
        .select("business", "seq", "field", "value", "error")
    )
    described = F.col("field").rlike(r"^money_model\..*\.description$")
    implied = F.when(
        described & F.col("error").isNull(),
        F.array(
            F.struct("business", "seq", F.regexp_replace("field", r"\.description$", ".exists").alias("field"),
                     F.lit("true").alias("value"), F.lit(None).cast("string").alias("error"))
        ),
    ).otherwise(F.array())
    own = F.array(F.struct("business", "seq", "field", "value", "error"))
    return rows.select(F.explode(F.concat(own, implied)).alias("r")).select("r.*")


def flatten_answers(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers business, seq, field, raw; errors business, seq, field, value, error) from nested answers.

    records: business, seq, answers (JSON text). Objects are opened to dotted fields, level by level; texts,
    numbers, truth values and lists (as JSON) are raw values. Nulls and empty objects give no row.
    Records that hold no object, and objects below NESTING levels, come back as errors.
    """
    def is_object(value: str) -> str:
        return f"schema_of_variant({value}) LIKE 'OBJECT%'"

    def members(value: str, name: str) -> str:
        return f"transform(map_entries(cast({value} AS map<string, variant>)), m -> struct({name} AS field, m.value AS value))"

    opened = members("v", "m.key")
    for _ in range(NESTING - 1):
        inner = members("e.value", "concat(e.field, '.', m.key)")
        opened = f"flatten(transform({opened}, e -> if({is_object('e.value')}, {inner}, array(e))))"
    parsed = records.select("business", "seq", "answers", F.try_parse_json("answers").alias("v"))
    known = F.expr(f"coalesce({is_object('v')}, false)")
    found = parsed.where(known).select("business", "seq", F.expr(f"inline({opened})"))
    deep = F.expr(is_object("value"))
    raw = F.expr("cast(value AS string)")
    answers = found.where(~deep & raw.isNotNull()).select("business", "seq", "field", raw.alias("raw"))
    kind = F.lit(None).cast("string")
    errors = parsed.where(~known).select(
        "business", "seq", kind.alias("field"), kind.alias("value"),
        F.concat(F.lit("answers are no JSON object: "), F.coalesce("answers", F.lit("null"))).alias("error"),
    ).unionByName(
        found.where(deep & (raw != "{}")).select(
            "business", "seq", "field", kind.alias("value"), F.concat(F.lit("nested too deep: "), raw).alias("error")
        )
    )
    return answers, errors


def clean_records(records: DataFrame) -> DataFrame:
    """`clean_answers` of nested answers (business, seq, answers), with the records that cannot be read."""
    answers, errors = flatten_answers(records)
    return clean_answers(answers).unionByName(errors)


def known_facts(snapshots: DataFrame) -> DataFrame:
    """Add facts (map of non-empty fields), symptom_count and the last three symptoms."""
    entries: list[Column] = []
    for field, kind in FIELDS.items():
        if field in LIST_FIELDS:
            continue
        entries += [F.lit(field), F.col(field).cast("string")]
    symptoms = F.coalesce(F.col("problem.reported_symptoms"), F.array().cast("array<string>"))
    return snapshots.withColumn(
        "facts", F.map_filter(F.create_map(*entries), lambda _k, v: v.isNotNull() & (v != ""))
    ).withColumn("symptom_count", F.size(symptoms)).withColumn(
        "recent_symptoms", F.slice(symptoms, F.greatest(F.lit(1), F.size(symptoms) - 2), 3)
    ).withColumn("constraints", F.col("problem.diagnosed_constraints"))


def diagnose_snapshots(snapshots: DataFrame) -> DataFrame:
    from quillrank.functions.text import looks_like_service

    service = looks_like_service(
        F.col("business.business_type"), F.col("business.delivery_model"), F.col("money_model.core_offer.description")
    )
    e = F.col("economics")
    return snapshots.withColumn("service_business", service).withColumn(
        "diagnosis",
        economics.diagnose(
            e["cac"], e["first_30_day_gross_profit"], e["monthly_recurring_gross_profit"],
            e["lifetime_gross_profit"], e["gross_margin"], service,
        ),
    )


def visible_sections(snapshots: DataFrame) -> DataFrame:
    """Only the four sections a query writer may see, pruned of empty members, as JSON."""
    from quillrank.functions.text import prune_empty

    kinds = {f.name: f.dataType for f in snapshots.schema.fields}
    view = F.struct(*[prune_empty(F.col(n), kinds[n]).alias(n) for n in SECTIONS])
    return snapshots.withColumn("facts_json", F.to_json(view))
