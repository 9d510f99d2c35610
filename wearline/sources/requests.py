"""Strict ingest of JSON requests.

A body is parsed to VARIANT, so that the JSON type of every field is seen
before any cast: a number in quotes, a boolean or a null where a number belongs
is a fault and never a value.  Unknown and absent keys are listed.  A request
is one row and its verdict is local to that row: nothing is shuffled, a faulty
request costs no other one, and all of its faults are reported at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C


@dataclass(frozen=True)
class Field:
    """One field of an object: ``integer``, ``number`` or ``choice``, with its bounds or choices."""

    name: str
    kind: str = "number"
    above: float | None = None
    least: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Form:
    """``nested``: an object ``{unit_id, observations: [...]}``; else the body is one observation."""

    fields: tuple[Field, ...]
    nested: bool = True

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


_CYCLE = Field("cycle", "integer", above=0)
RUL_REQUEST = Form((_CYCLE, *[Field(c) for c in C.OPERATIONAL_SETTINGS[:3] + C.RETAINED_SENSORS]))
ANOMALY_REQUEST = Form((_CYCLE, *[Field(c) for c in C.RETAINED_SENSORS]))
FAILURE_REQUEST = Form((
    Field("type", "choice", choices=("L", "M", "H")), Field("air_temperature", above=0), Field("process_temperature", above=0),
    Field("rotational_speed", above=0), Field("torque", least=0), Field("tool_wear", least=0)), nested=False)

_MAP = "map<string,variant>"
_FAULT = "struct<place:string,field:string,reason:string>"


def _wrong_type(found: Column, wanted: str) -> Column:
    """Reason for a JSON type that does not fit, else null; ``found`` is the type's name."""
    reason = (F.when(found == "VOID", "null").when(found == "BOOLEAN", "boolean")
              .when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array"))
    if wanted != "choice":
        reason = reason.when(found == "STRING", "text")
    else:
        reason = reason.when(found != "STRING", "number")
    return reason.when(found != "BIGINT", "not an integer") if wanted == "integer" else reason


def _reason(field: Field, found: Column, number: Column, text: Column) -> Column:
    """First fault of one field: absent, wrong type, not finite, out of bounds."""
    reason = F.when(found.isNull(), "missing")
    wrong = _wrong_type(found, field.kind)
    reason = reason.when(wrong.isNotNull(), wrong)
    if field.kind == "choice":
        return reason.when(~text.isin(*field.choices), "not a choice")
    reason = reason.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), "not finite")
    if field.above is not None:
        reason = reason.when(number <= field.above, "too small")
    if field.least is not None:
        reason = reason.when(number < field.least, "too small")
    return reason


def _fault(place: Column, field: Column, reason: Column) -> Column:
    return F.struct(place.alias("place"), field.alias("field"), reason.alias("reason"))


def _observation_faults(form: Form, place: Column, object_: Column) -> Column:
    """Faults of one observation, ``object_`` = its keys, and by field its types, numbers and texts."""
    checks = [_reason(f, object_["types"][i], object_["numbers"][i], object_["texts"][i]) for i, f in enumerate(form.fields)]
    own = F.filter(F.array(*[_fault(place, F.lit(f.name), c) for f, c in zip(form.fields, checks, strict=True)]),
                   lambda x: x["reason"].isNotNull())
    unknown = F.transform(F.array_except(object_["keys"], F.array(*[F.lit(n) for n in form.names])),
                          lambda k: _fault(place, k, F.lit("unknown")))
    no_object = F.array(_fault(place, F.lit(""), F.lit("not an object")))
    return F.when(object_["keys"].isNull(), no_object).otherwise(F.concat(own, unknown))


def _seen(form: Form, observation: Column) -> Column:
    """What one observation holds, taken from the VARIANT once."""
    values = [F.try_variant_get(observation, f"$.{n}", "variant") for n in form.names]
    wanted = {"integer": "bigint", "number": "double", "choice": "string"}

    def read(kind: str) -> Column:
        return F.array(*[F.try_variant_get(v, "$", wanted[kind]) if f.kind == kind or kind == "number" else F.lit(None).cast(wanted[kind])
                         for f, v in zip(form.fields, values, strict=True)])

    return F.struct(
        F.map_keys(F.try_variant_get(observation, "$", _MAP)).alias("keys"), F.array(*[F.schema_of_variant(v) for v in values]).alias("types"),
        read("number").alias("numbers"), read("choice").alias("texts"), read("integer").alias("integers"))


def _evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, which the optimizer does not copy into their uses: each is evaluated once."""
    once = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.withColumn("_once", once).select(*df.columns, *[F.col("_once")[name].alias(name) for name in columns])


def checked_requests(df: DataFrame, form: Form, body: str = "body", key: str = "request_id") -> DataFrame:
    """(key, unit_id, observations, faults) of every request.

    ``faults`` holds every fault as (place, field, reason): the place is empty
    for the body and ``observations[i]`` below.  Text that is not one JSON
    value, an object with a key twice included, is ``malformed``.  A null or
    empty body is malformed too.  Other columns of ``df`` are not read.
    """
    # one value between brackets: text behind the value, or none, does not pass
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("_body"), F.lit("]")))
    parsed = _evaluated(df.select(F.col(key).alias("_key"), F.col(body).alias("_body")),
                        _values=F.try_variant_get(whole, "$", "array<variant>"))
    parsed = _evaluated(parsed.drop("_body"), _v=F.when(F.size("_values") == 1, F.element_at("_values", 1))).drop("_values")
    malformed = F.col("_v").isNull()
    here = F.lit("")
    if form.nested:
        parsed = _evaluated(parsed, _top=F.try_variant_get("_v", "$", _MAP), _list=F.try_variant_get("_v", "$.observations", "variant"),
                            _unit=F.try_variant_get("_v", "$.unit_id", "variant"))
        parsed = _evaluated(parsed, _items=F.try_variant_get("_list", "$", "array<variant>"))
        list_type, unit_type = F.schema_of_variant("_list"), F.schema_of_variant("_unit")
        list_fault = (F.when(F.col("_list").isNull(), "missing").when(F.col("_items").isNull(), F.coalesce(
            _wrong_type(list_type, "number"), F.lit("number"))).when(F.size("_items") == 0, "empty"))
        wrong_unit = F.coalesce(_wrong_type(unit_type, "choice"), F.lit("number"))
        unit_fault = F.when(F.col("_unit").isNotNull() & ~unit_type.isin("VOID", "STRING", "BIGINT"), wrong_unit)
        unknown = F.transform(F.array_except(F.map_keys("_top"), F.array(F.lit("unit_id"), F.lit("observations"))),
                              lambda k: _fault(here, k, F.lit("unknown")))
        body_faults = F.concat(F.filter(F.array(
            _fault(here, F.lit("unit_id"), unit_fault), _fault(here, F.lit("observations"), list_fault)),
            lambda x: x["reason"].isNotNull()), unknown)
        body_faults = F.when(F.col("_top").isNull(), F.array(_fault(here, F.lit(""), F.lit("not an object")))).otherwise(body_faults)
        unit = F.try_variant_get("_unit", "$", "string")
        place = lambda i: F.concat(F.lit("observations["), i.cast("string"), F.lit("]"))
    else:
        parsed = parsed.withColumn("_items", F.when(~malformed, F.array("_v")))
        body_faults = F.array().cast(f"array<{_FAULT}>")
        unit, place = F.lit(None).cast("string"), lambda i: here
    items = F.coalesce("_items", F.array().cast("array<variant>"))
    seen = _evaluated(parsed, _seen=F.transform(items, lambda o: _seen(form, o)))
    observed = F.flatten(F.transform("_seen", lambda o, i: _observation_faults(form, place(i), o)))
    faults = F.when(malformed, F.array(_fault(here, F.lit(""), F.lit("malformed")))).otherwise(F.concat(body_faults, observed))
    out = _evaluated(seen, _unit_id=unit, _faults=faults)
    return out.select(F.col("_key").alias(key), F.col("_unit_id").alias("unit_id"), F.col("_seen").alias("observations"), F.col("_faults").alias("faults"))


def accepted_rows(checked: DataFrame, form: Form, key: str = "request_id") -> DataFrame:
    """One row per observation of the requests without a fault, ``arrival`` = place in the request."""
    rows = checked.where(F.size("faults") == 0).select(key, "unit_id", F.posexplode("observations").alias("arrival", "_o"))
    source = {"integer": "integers", "number": "numbers", "choice": "texts"}
    values = [F.col("_o")[source[f.kind]][i].alias(f.name) for i, f in enumerate(form.fields)]
    return rows.select(key, *(["unit_id", "arrival"] if form.nested else []), *values)


def rejections(checked: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per fault: key, place, field, reason."""
    return checked.select(key, F.explode("faults").alias("_f")).select(key, "_f.*")


def read_requests(df: DataFrame, form: Form, body: str = "body", key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(observations of faultless requests, faults of the others)."""
    checked = checked_requests(df, form, body, key)
    return accepted_rows(checked, form, key), rejections(checked, key)
