"""JSON texts with sorted keys at every depth, and strict reading of JSON candidates with codes instead of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StructType

ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
CONTROLS = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in ESCAPES}


def json_string(s: Column) -> Column:
    """A quoted string; other letters than ASCII ones stay as they are."""
    s = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), ESCAPES.items(), s)
    rare = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in CONTROLS.items()])
    return F.concat(F.lit('"'), F.when(F.regexp_like(s, F.lit(r"[\x00-\x1f]")), F.aggregate(rare, s, lambda a, r: F.replace(a, r["c"], r["t"]))).otherwise(s), F.lit('"'))


def json_double(x: Column) -> Column:
    """The shortest decimal that reads back as x, with an exponent below 1e-4 and from 1e16 on; NaN and infinities by name."""

    def text(t: Column) -> Column:
        mantissa, exponent = F.regexp_extract(t, r"^[0-9.]+", 0), F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        whole = F.length(F.split_part(mantissa, F.lit("."), F.lit(1)))
        every = F.replace(mantissa, F.lit("."), F.lit(""))
        digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
        ten = whole + exponent - 1 - F.length(F.regexp_extract(every, "^0*", 0))
        n = F.length(digits)
        rest = lambda at: F.when(F.length(digits) > at, F.substring(digits, at + 1, n)).otherwise("0")
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -ten - 1), digits)
        large = F.concat(F.rpad(F.substring(digits, F.lit(1), ten + 1), ten + 1, F.lit("0")), F.lit("."), rest(ten + 1))
        power = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(ten < 0, "e-").otherwise("e+"), F.lpad(F.abs(ten).cast("string"), 2, "0"))
        power = F.when(F.abs(ten) > 99, F.concat(F.regexp_extract(power, r"^.*e[+-]", 0), F.abs(ten).cast("string"))).otherwise(power)
        return F.when(n == 0, "0.0").when((ten < -4) | (ten >= 16), power).when(ten < 0, small).otherwise(large)

    # The platform's own text may have a digit too many: fewer digits are taken where they read back as x.
    size = F.abs(x)
    reads = lambda n: F.when(F.format_string(f"%.{n}e", size).try_cast("double") == size, F.format_string(f"%.{n}e", size))
    least = F.when(size < 2.3e-308, F.coalesce(*map(reads, range(14))))  # digits fade out below the normal numbers
    shortest = F.coalesce(least, *map(reads, (14, 15, 16)), size.cast("string"))
    body = F.get(F.transform(F.array(shortest), text), F.lit(0))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(F.concat(sign, body))


def json_text(c: Column, kind: DataType, comma: str = ", ", colon: str = ": ") -> Column:
    """c as JSON: keys of structs and maps sorted at every depth, nulls written out. Other types than JSON's become strings."""
    again = lambda x, k: json_text(x, k, comma, colon)
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(colon), again(c.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: again(x, kind.elementType)), comma), F.lit("]"))
    elif isinstance(kind, MapType):
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(json_string(k.cast("string")), F.lit(colon), again(F.element_at(c, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, comma), F.lit("}"))
    elif isinstance(kind, BooleanType | IntegralType | DecimalType):
        out = c.cast("string")
    elif isinstance(kind, DoubleType | FloatType):
        out = json_double(c.cast("double"))
    else:
        out = json_string(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(out)


# A candidate's fields with their types, and what a reply may aim at.
FIELDS = {"response": "STRING", "policy_target": "STRING", "evidence_ids": "ARRAY", "proposed_action": "OBJECT", "uncertainty_acknowledged": "BOOLEAN"}
REQUIRED = ["response", "policy_target"]
TARGETS = ["support", "ask", "abstain", "escalate", "propose", "confirm", "refine", "monitor"]


def candidate(text: Column) -> tuple[Column, Column]:
    """(candidate, code) of a reply's JSON text; the candidate is null if there is a code, the first that holds of

    NOT_JSON (null, malformed, a key twice), NOT_OBJECT, UNKNOWN_FIELD, MISSING_FIELD, WRONG_TYPE, RESPONSE_EMPTY, TARGET_UNKNOWN and
    ACTION_INVALID (no tool, not a dry run, or without confirmation). Types are not converted: a number is no response. A null
    or empty action is none; a null flag or list counts as left out only for the action.
    """
    v = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    shape = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)
    has = lambda k: F.array_contains(keys, k)
    wrong = F.lit(False)
    for k, t in FIELDS.items():
        fits = shape(f"$.{k}").isin([t, "VOID"] if k == "proposed_action" else [t])
        wrong = wrong | (has(k) & ~F.coalesce(fits, F.lit(False)))
    ids = F.try_variant_get(v, "$.evidence_ids", "array<variant>")
    wrong = wrong | F.coalesce(F.exists(ids, lambda i: F.coalesce(F.schema_of_variant(i), F.lit("")) != "STRING"), F.lit(False))
    action = has("proposed_action") & (F.size(F.coalesce(F.json_object_keys(F.get_json_object(text, "$.proposed_action")), F.array().cast("array<string>"))) > 0)
    tool, mode, ask = of("$.proposed_action.tool_name", "string"), of("$.proposed_action.execution_mode", "string"), of("$.proposed_action.requires_confirmation", "boolean")
    bad_action = action & ((F.trim(F.coalesce(tool, F.lit(""))) == "") | (F.coalesce(mode, F.lit("dry_run")) != "dry_run") | ~F.coalesce(ask, F.lit(True)))
    response, target = of("$.response", "string"), of("$.policy_target", "string")
    code = (
        F.when(v.isNull(), "NOT_JSON").when(keys.isNull(), "NOT_OBJECT").when(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "UNKNOWN_FIELD")
        .when(~(has("response") & has("policy_target")), "MISSING_FIELD").when(wrong, "WRONG_TYPE").when(F.regexp_replace(response, r"\s+", "") == "", "RESPONSE_EMPTY")
        .when(~target.isin(TARGETS), "TARGET_UNKNOWN").when(bad_action, "ACTION_INVALID")
    )
    none = F.array().cast("array<string>")
    parsed = F.struct(response.alias("response"), F.upper(target).alias("policy_target"), F.coalesce(of("$.evidence_ids", "array<string>"), none).alias("evidence_ids"), F.when(action, tool).alias("tool_name"), F.coalesce(of("$.uncertainty_acknowledged", "boolean"), F.lit(False)).alias("uncertainty_acknowledged"))
    return F.when(code.isNull(), parsed), code
