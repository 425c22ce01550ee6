"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank import constants as K


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN), F.lit(0))


def words(text: Column) -> Column:
    """Words between runs of blank space, Unicode spaces included."""
    return F.array_remove(F.split(text, K.SPACE_CLASS + "+"), "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(K.SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    return F.array_join(words(text), " ")


def normalize_query(text: Column) -> Column:
    return F.lower(collapse_spaces(text))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_numbers(text: Column) -> Column:
    """Lower, hyphens to spaces, then spelled numbers to digits one word at a time.

    A replacement eats the blanks around its word, so the second of two equal number
    words in a row stays as it is.
    """
    out = F.concat(F.lit(" "), F.replace(F.lower(text), F.lit("-"), F.lit(" ")), F.lit(" "))
    for word, digits in K.NUMBER_WORDS:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {digits} "))
    return collapse_spaces(out)


def token_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def phrase_in(text: Column, phrase: Column) -> Column:
    """Phrase found in the token text; a plain substring test, empty phrases never match."""
    needle = token_text(phrase)
    return (needle != "") & F.contains(token_text(text), needle)


def money_values(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit("")).cast("double"))


def percent_values(text: Column) -> Column:
    pattern = rf"([0-9]+(?:\.[0-9]+)?){K.SPACE_CLASS}*%"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda v: v.cast("double") / 100)


def month_values(text: Column) -> Column:
    pattern = rf"([0-9]+(?:\.[0-9]+)?){K.SPACE_CLASS}+months?"
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda v: v.cast("double"))


def query_error(query: Column) -> Column:
    """Reason a search query is not acceptable, null when it is."""
    bare = strip(query)
    return (
        F.when(query.isNull(), "query must be a string")
        .when(bare == "", "query must not be empty")
        .when(bare.contains("\n") | bare.contains("\r"), "query must be one line")
        .when(
            F.length(bare) > K.MAX_QUERY_CHARS,
            f"query must be no more than {K.MAX_QUERY_CHARS} characters",
        )
    )


def tokens_used(log: Column) -> Column:
    """Token count a run log reports, null when it reports none."""
    raw = F.regexp_extract(log, K.TOKENS_USED, 1)
    return F.try_to_number(F.nullif(F.replace(raw, F.lit(","), F.lit("")), F.lit("")), F.lit("9" * 18)).cast("long")


def log_flags(log: Column, own_root: Column, run_root: Column) -> Column:
    """Sorted signs that a run saw its answer key or left its own folder."""
    outside = F.exists(
        F.regexp_extract_all(log, F.lit(K.COMMAND_FOLDER), F.lit(1)),
        lambda path: ~F.startswith(F.concat(strip(path), F.lit("/")), F.concat(run_root, F.lit("/"))),
    )
    scrubbed = F.replace(log, run_root, F.lit(""))
    checks = [
        (F.rlike(log, F.lit(K.LEAK_WORDS)), "evaluation_artifact_reference"),
        (F.contains(log, own_root), "original_repo_reference"),
        (F.rlike(scrubbed, F.lit(K.TEMP_PATH)), "temp_path_outside_trial_runtime"),
        (F.rlike(log, F.lit(K.TOOL_LINE)), "unexpected_tool_call"),
        (outside, "command_outside_trial_runtime"),
        (F.coalesce(log, F.lit("")) == "", "missing_command_transcript"),
    ]
    return F.sort_array(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])))


def infra_failure(return_code: Column, log: Column) -> Column:
    lowered = F.lower(log)
    hit = F.coalesce(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in K.INFRA_FAILURES])
    return F.when(return_code != 0, hit)


def redact(text: Column, secrets: Column) -> Column:
    """struct(text, exposed) after replacing each secret in turn."""
    start = F.struct(text.alias("text"), F.lit(False).alias("exposed"))

    def step(acc: Column, secret: Column) -> Column:
        found = (F.coalesce(secret, F.lit("")) != "") & F.contains(acc["text"], secret)
        return F.when(
            found,
            F.struct(
                F.replace(acc["text"], secret, F.lit(K.REDACTED)).alias("text"),
                F.lit(True).alias("exposed"),
            ),
        ).otherwise(acc)

    return F.aggregate(secrets, start, step)


def looks_like_service(*parts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *parts))
    found = F.lit(False)
    for word in K.SERVICE_WORDS:
        found = found | F.contains(text, F.lit(word))
    return found


def prune_empty(value: Column, kind: T.DataType) -> Column:
    """Drop null, "", [] and {} members at every depth; 0 and false stay."""
    if isinstance(kind, T.StructType):
        parts = [prune_empty(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        anything = F.lit(False)
        for part in parts:
            anything = anything | part.isNotNull()
        return F.when(anything, F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(
            F.transform(value, lambda v: prune_empty(v, kind.elementType)), lambda v: v.isNotNull()
        )
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(
            F.transform_values(value, lambda _k, v: prune_empty(v, kind.valueType)),
            lambda _k, v: v.isNotNull(),
        )
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    return value


def prompt_text(instruction: str, question: Column, facts_json: Column, guide_json: Column | None = None,
                guide_instruction: str = "") -> Column:
    blocks = [
        F.lit(instruction),
        F.concat(F.lit("## Current user question\n\n"), question),
        F.concat(F.lit("## Saved business facts\n\n```json\n"), facts_json, F.lit("\n```")),
    ]
    if guide_json is not None:
        blocks += [
            F.lit(guide_instruction),
            F.concat(F.lit("## Corpus guide\n\n```json\n"), guide_json, F.lit("\n```")),
        ]
    return F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n"))


def content_tokens(text: Column, stop: Sequence[str] = K.STOP_WORDS) -> Column:
    """Distinct tokens longer than two characters that are not stop words."""
    stops = F.array(*[F.lit(w) for w in stop])
    return F.array_distinct(
        F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stops, t))
    )
