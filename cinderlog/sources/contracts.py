"""Request contracts: what a request must hold, as JSON Schema, as a Spark type, and as a check of each row.

A contract is a tree of fields. From it come a JSON Schema (required fields, types, defaults, nested definitions), the Spark
type of a request, an expression that walks a parsed request and names every violation by path and reason, and one
that builds the request with its defaults. A row with violations becomes an error row; it never fails a job.

Values are read as leniently as the service reads them: whole numbers may come as strings or as 3.0, truth values as
0, 1 or their usual words; a string must be a string. Unknown fields are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cinderlog.functions import regex
from cinderlog.workers import materialised

MISSING = "missing"
#: Reasons by kind of value.
REASONS = {"string": "string_type", "integer": "int_type", "number": "float_type", "boolean": "bool_type", "array": "list_type", "object": "model_type", "free": "dict_type"}
_UNSET = object()


@dataclass(frozen=True)
class Value:
    """A field's value. kind: string, integer, number, boolean, array (of `items`), object (of `fields`) or free (any object, kept as JSON)."""

    kind: str
    default: object = _UNSET  # none: the field is required
    nullable: bool = False
    wide: bool = False  # an integer of 64 bits
    items: Value | None = None
    fields: Mapping[str, Value] | None = None
    name: str = ""

    @property
    def required(self) -> bool:
        return self.default is _UNSET


def _text(default: object = _UNSET) -> Value:
    return Value("string", default)


def _maybe(kind: str, wide: bool = False) -> Value:
    return Value(kind, None, True, wide)


def _whole(default: object = _UNSET, wide: bool = False) -> Value:
    return Value("integer", default, wide=wide)


def _flag(default: bool) -> Value:
    return Value("boolean", default)


def _list(items: Value) -> Value:
    return Value("array", (), items=items)


def _object(title: str, /, **fields: Value) -> Value:
    return Value("object", fields=fields, name=title)


# The fields of requests, with their defaults.
_FILE = _object("ChangedFile", path=_text(), change_type=_text("modified"), additions=_whole(0), deletions=_whole(0), is_config=_flag(False), is_dependency=_flag(False), patch=_maybe("string"), patch_truncated=_flag(False))
_WINDOW = _object("SourceWindow", path=_text(), line=_whole(), start_line=_whole(), end_line=_whole(), content=_text())
CONTRACTS = {
    "analyze_requests": _object(
        "AnalyzeRequest",
        contract_version=_text("v1"),
        team_id=_whole(wide=True),
        failure=_object("FailureContext", uuid=_text(), occurrence_index=_whole(1), is_flaky=_flag(False), signature_hash=_maybe("string"), ecosystem=_maybe("string")),
        project=_object("ProjectContext", id=_maybe("integer", True), uuid=_text(), name=_text(), tech_stack=_list(_text()), provider=_text("unknown"), default_branch=_text("main")),
        pipeline=_object("PipelineContext", iid=_maybe("integer"), ref=_text("unknown"), source=_text("push"), commit_sha=_maybe("string"), commit_message=_maybe("string"), duration_seconds=_maybe("integer"), previous_status=_maybe("string"), changed_files=_list(_FILE)),
        job=_object("JobContext", name=_maybe("string"), stage_name=_maybe("string"), status=_text("failed"), exit_code=_maybe("integer"), duration_seconds=_maybe("integer"), failure_reason=_maybe("string"), baseline_duration_seconds=_maybe("number")),
        log_excerpt=_text(""),
        error_block=_maybe("string"),
        stack_trace=_maybe("string"),
        source_context=_list(_WINDOW),
        use_rag=_flag(True),
        use_llm=_flag(True),
        force_llm=_flag(False),
        llm_override=_maybe("free"),
    ),
    "process_log_requests": _object("ProcessLogRequest", raw_log=_text(), job_name=_maybe("string"), stage_name=_maybe("string"), exit_code=_maybe("integer"), strict_redaction=_flag(True)),
    "classify_requests": _object("ClassifyRequest", text=_text(), ecosystem=_maybe("string")),
    "embed_requests": _object("EmbedRequest", text=_text(), category=_maybe("string"), ecosystem=_maybe("string"), job_name=_maybe("string")),
    "similar_requests": _object("SimilarRequest", team_id=_whole(wide=True), error_message=_text(), category=_maybe("string"), ecosystem=_maybe("string"), job_name=_maybe("string"), exclude_failure_id=_maybe("integer", True), limit=_maybe("integer"), threshold=_maybe("number")),
    "chunk_requests": _object("ChunkEmbedRequest", text=_text(), title=_maybe("string"), target_tokens=_whole(150), overlap_tokens=_whole(25)),
    "provider_requests": _object("TestProviderRequest", provider=_text(), api_key=_maybe("string"), model=_maybe("string"), base_url=_maybe("string")),
}


# -- Spark types and JSON Schema --------------------------------------------------------


def type_of(value: Value) -> DataType:
    if value.kind == "array":
        return ArrayType(type_of(value.items))
    if value.kind == "object":
        return StructType([StructField(k, type_of(v)) for k, v in value.fields.items()])
    return {"integer": LongType() if value.wide else IntegerType(), "number": DoubleType(), "boolean": BooleanType()}.get(value.kind, StringType())


def json_schema(value: Value) -> dict:
    """The JSON Schema of a contract; nested objects are definitions of their own."""
    definitions: dict[str, dict] = {}

    def body(v: Value) -> dict:
        out: dict = {"type": "object", "title": v.name, "properties": {k: one(x) for k, x in v.fields.items()}}
        required = [k for k, x in v.fields.items() if x.required]
        return out | ({"required": required} if required else {})

    def one(v: Value) -> dict:
        if v.kind == "object":
            definitions[v.name] = body(v)
            out: dict = {"$ref": f"#/$defs/{v.name}"}
        elif v.kind == "array":
            out = {"type": "array", "items": one(v.items)}
        elif v.kind == "free":
            out = {"type": "object", "additionalProperties": True}
        else:
            out = {"type": v.kind} | ({"format": "int64" if v.wide else "int32"} if v.kind == "integer" else {})
        if v.nullable:
            out = {"anyOf": [out, {"type": "null"}]}
        return out if v.required else out | {"default": list(v.default) if isinstance(v.default, tuple) else v.default}

    top = body(value)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | top | ({"$defs": definitions} if definitions else {})


def from_json_schema(schema: dict) -> Value:
    """The contract that a JSON Schema of json_schema's kind describes."""

    def one(s: dict, required: bool) -> Value:
        default = _UNSET if required else tuple(s["default"]) if isinstance(s.get("default"), list) else s.get("default")
        nullable = "anyOf" in s
        inner = s["anyOf"][0] if nullable else s
        if "$ref" in inner:
            return Value("object", default, nullable, fields=fields(target := schema["$defs"][inner["$ref"].rsplit("/", 1)[1]]), name=target["title"])
        if inner["type"] == "array":
            return Value("array", default, nullable, items=one(inner["items"], True))
        if inner["type"] == "object":
            return Value("free", default, nullable)
        return Value(inner["type"], default, nullable, inner.get("format") == "int64")

    def fields(s: dict) -> dict[str, Value]:
        return {k: one(x, k in s.get("required", ())) for k, x in s["properties"].items()}

    return Value("object", fields=fields(schema), name=schema["title"])


def breaking(old: Value, new: Value, path: str = "") -> list[tuple[str, str]]:
    """(path, reason) of each change that a caller who sends `old`, or reads it, would notice: removed and newly required fields, other types, nulls no longer allowed."""
    if old.kind != new.kind or old.wide and not new.wide:
        return [(path, f"type changed from {old.kind} to {new.kind}" if old.kind != new.kind else "integer narrowed")]
    out = [(path, "null no longer allowed")] if old.nullable and not new.nullable else []
    if new.required and not old.required:
        out.append((path, "now required"))
    if old.kind == "array":
        out += breaking(old.items, new.items, f"{path}[]")
    if old.kind == "object":
        at = lambda k: f"{path}.{k}" if path else k
        out += [(at(k), "removed") for k in old.fields if k not in new.fields]
        out += [(at(k), "new and required") for k, v in new.fields.items() if k not in old.fields and v.required]
        for k in old.fields:
            if k in new.fields:
                out += breaking(old.fields[k], new.fields[k], at(k))
    return out


# -- rows ------------------------------------------------------------------------------

VIOLATIONS = "array<struct<path:string,reason:string>>"
_TRUTH = ("true", "false", "t", "f", "yes", "no", "y", "n", "on", "off", "1", "0")


def _one(path: Column, reason: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))


def _none() -> Column:
    return F.array().cast(VIOLATIONS)


def _fits(x: Column, kind: Column, value: Value) -> Column:
    """Whether a variant of a kind (as schema_of_variant names it) may be read as a simple value."""
    text = F.try_variant_get(x, "$", "string")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if value.kind == "string":
        return kind == "STRING"
    if value.kind == "boolean":
        return (kind == "BOOLEAN") | ((kind == "STRING") & F.lower(text).isin(*_TRUTH)) | (number & F.try_variant_get(x, "$", "double").isin(0.0, 1.0))
    if value.kind == "number":
        return number | (kind == "BOOLEAN") | ((kind == "STRING") & F.expr("true") & text.try_cast("double").isNotNull())
    least, most = (-(2**63), 2**63 - 1) if value.wide else (-(2**31), 2**31 - 1)
    whole = F.try_variant_get(x, "$", "decimal(38,9)")
    in_range = (whole == F.floor(whole)) & (whole >= F.lit(least).cast("decimal(20,0)")) & (whole <= F.lit(most).cast("decimal(20,0)"))
    said = regex.matches(F.trim(text), r"\A[+-]?\d{1,19}(?:\.0*)?\z") & F.coalesce(in_range, F.lit(False))
    return (kind == "BOOLEAN") | (number & F.coalesce(in_range, F.lit(False))) | ((kind == "STRING") & said)


def violations(x: Column, value: Value, path: Column | None = None) -> Column:
    """(path, reason) of all that a variant lacks to be a request of this contract, in the order of its fields."""
    path = F.lit("") if path is None else path
    wrong = _one(path, REASONS[value.kind])

    def check(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        if value.kind == "free":
            return F.when(kind.startswith("OBJECT"), _none()).otherwise(wrong)
        if value.kind == "array":

            def item(y: Column, i: Column) -> Column:
                return violations(y, value.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))

            return F.when(kind.startswith("ARRAY"), F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), item))).otherwise(wrong)
        if value.kind == "object":
            parts = []
            for name, inner in value.fields.items():
                at = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
                absent = _one(at, MISSING) if inner.required else _none()
                parts.append(regex.let(F.try_variant_get(v, f"$.{name}", "variant"), _field(inner, at, absent)))
            return F.when(kind.startswith("OBJECT"), F.concat(*parts)).otherwise(wrong)
        return F.when(F.coalesce(_fits(v, kind, value), F.lit(False)), _none()).otherwise(wrong)

    return regex.let(x, check)


def _field(value: Value, path: Column, absent: Column):  # noqa: ANN202
    def check(y: Column) -> Column:
        null = _none() if value.nullable else _one(path, REASONS[value.kind])
        return F.when(y.isNull(), absent).when(F.is_variant_null(y), null).otherwise(violations(y, value, path))

    return check


def built(x: Column, value: Value) -> Column:
    """A sound variant as a value of type_of(value), defaults filled in."""

    def make(v: Column) -> Column:
        if value.kind == "free":
            return F.to_json(v)
        if value.kind == "array":
            return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda y: built(y, value.items))
        if value.kind == "object":
            return F.struct(*(_filled(F.try_variant_get(v, f"$.{k}", "variant"), f).alias(k) for k, f in value.fields.items()))
        if value.kind == "boolean":
            text = F.lower(F.try_variant_get(v, "$", "string"))
            return text.isin("true", "t", "yes", "y", "on", "1", "1.0")
        if value.kind == "integer":
            kind = F.schema_of_variant(v)
            plain = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).otherwise(F.try_variant_get(v, "$", "decimal(38,9)"))
            return plain.cast(type_of(value))
        if value.kind == "number":
            return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        return F.try_variant_get(v, "$", "string")

    return regex.let(x, make)


def _filled(x: Column, value: Value) -> Column:
    default = F.lit(None) if value.required or value.default is None else F.array() if isinstance(value.default, tuple) else F.lit(value.default)
    return regex.let(x, lambda y: F.when(y.isNull() | F.is_variant_null(y), default.cast(type_of(value))).otherwise(built(y, value)))


def checked(lines: DataFrame, contract: Value, column: str = "value") -> DataFrame:
    """lines with `request` (null where there are violations) and `errors` (path, reason; empty where there are none)."""
    parsed = F.try_parse_json(F.col(column))
    errors = F.when(F.col("__parsed").isNull(), _one(F.lit(""), "json_invalid")).otherwise(violations(F.col("__parsed"), contract))
    df = lines.withColumn("__parsed", parsed).withColumn("errors", errors)
    return df.withColumn("request", F.when(F.size("errors") == 0, built(F.col("__parsed"), contract))).drop("__parsed")


def split(lines: DataFrame, contract: Value, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests, quarantine): sound requests' fields, and the other lines with their errors; lines are read and checked once."""
    df = checked(lines, contract, column)
    df = materialised(df.withColumn(column, F.when(F.size("errors") > 0, F.col(column))))
    return df.where("request IS NOT NULL").select("request.*"), df.where("request IS NULL").select(column, "errors")
