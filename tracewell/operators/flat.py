"""Raw events as flat rows: the columns that need no page state, by built-in functions on the event's JSON.

A value of a type that its column can't hold becomes null and is counted in ``wrong_typed``; the raw event keeps it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import exprs as X

# Fields of an event that its row doesn't repeat, attributes too bulky for it, pointer names, and lengths of cuts.
STRUCTURE = ("source", "type", "id", "positions", "adds", "removes", "texts", "attributes", "ranges", "node", "initialOffset", "styles", "styleIds", "define", "commands", "isAttachIframe")
BULKY = ("_cssText", "d", "srcset", "data-srcset")
POINTERS = {0: "Mouse", 1: "Pen", 2: "Touch"}
VALUE_CAP, EXTRA_CAP = 20_000, 200

#: Fields with columns of their own.
NAMED = ("url", "href", "title", "referrer", "x", "y", "pointerType")
INCREMENTAL, IDENTIFY, INPUT, MOVES = 3, 72, 5, (1, 6, 12)


#: How the names of JSON types begin in a variant's schema, which for a decimal has more (fixed values).
TEXT, BOOLEAN, NUMBERS = "STR", "BOO", ("BIG", "DOU", "DEC")


def _kind(value: Column) -> Column:
    """What JSON type a value has; null for a field that isn't there or is null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def _is(value: Column, *kinds: str) -> Column:
    """Whether a value is of one of these JSON types, told by how their names begin."""
    return F.coalesce(F.substring(F.schema_of_variant(value), 1, 3).isin(*kinds), F.lit(False))


def _is_there(value: Column) -> Column:
    """Whether a field is there and isn't null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def _of(value: Column, right: Column, kind: str) -> tuple[Column, Column]:
    """The value if it is of the right type, and whether it is there but isn't."""
    return F.when(right, F.try_variant_get(value, "$", kind)), _is_there(value) & ~right


def text_value(value: Column) -> tuple[Column, Column]:
    return _of(value, _is(value, TEXT), "string")


def number_value(value: Column) -> tuple[Column, Column]:
    return _of(value, _is(value, *NUMBERS), "double")


def _short(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(text.startswith("data:"), X.page_address(text)).otherwise(X.truncate(text, EXTRA_CAP))


def flattened(events: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds type_str, url, title, referrer, user_id, x, y, pointer_type, input, extra and wrong_typed.

    raw: an event's JSON text; a text that is no object has nulls throughout. A batch of moves stands where its last position is. ``extra`` is
    a JSON object of all other scalar fields, null without any.
    """
    type_ = F.get_json_object(raw, "$.type").cast("int")
    data = F.from_json(F.get_json_object(raw, "$.data"), "map<string,variant>")
    e = events.withColumn("_type", type_).withColumn("_data", F.coalesce(data, F.from_json(F.lit("{}"), "map<string,variant>")))
    get = lambda name: F.try_element_at("_data", F.lit(name))
    # what is asked for often stands in columns, as expressions that are repeated in branches and lambdas are evaluated anew in each
    e = e.withColumn("_source", F.try_variant_get(get("source"), "$", "int"))
    incremental, source, sub = F.col("_type") == INCREMENTAL, F.col("_source"), F.try_variant_get(get("type"), "$", "int")
    e = e.withColumn("_is_input", F.coalesce(incremental & (source == INPUT), F.lit(False)))
    is_input = F.col("_is_input")
    is_move = F.coalesce(incremental & source.isin(*MOVES), F.lit(False))
    wrong: list[Column] = []

    def text(value: Column, where: Column | None = None) -> Column:
        value, bad = text_value(value)
        wrong.append(bad if where is None else bad & where)
        return value if where is None else F.when(where, value)

    e = e.withColumn("_last", F.when(is_move, F.try_element_at(F.from_json(F.get_json_object(raw, "$.data.positions"), "array<map<string,variant>>"), F.lit(-1))))
    place = {}
    for c in "xy":
        plain, bad = number_value(get(c))
        moved, moved_bad = number_value(F.try_element_at("_last", F.lit(c)))
        on = F.col("_last").isNotNull()
        place[c] = X.rounded(F.when(on, moved).otherwise(plain)).cast("long")
        wrong += [bad, moved_bad & on]
    pointer, bad = number_value(get("pointerType"))
    wrong.append(bad)
    pointer = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in POINTERS.items() for x in p)), pointer.cast("int")), F.when(pointer.isNotNull(), F.format_string("%.0f", pointer)))

    e = e.withColumn("_typed", F.when(is_input, text_value(get("text"))[0]))
    typed, chars = F.col("_typed"), F.col("_chars")  # characters only of what can be too long
    e = e.withColumn("_chars", F.when(F.octet_length(typed) > VALUE_CAP, F.char_length(typed)))
    long_ = F.coalesce(chars > VALUE_CAP, F.lit(False))
    cut = F.when(long_, F.concat(F.substring(typed, 1, VALUE_CAP - 1), F.lit("…"))).otherwise(typed)
    no_text = ~_is_there(get("text"))
    checked = _is(get("isChecked"), BOOLEAN)
    wrong += [is_input & typed.isNull() & ~no_text, is_input & no_text & F.map_contains_key("_data", F.lit("isChecked")) & ~checked]
    value = F.when(is_input, F.coalesce(cut, F.when(no_text & checked, F.try_variant_get(get("isChecked"), "$", "string"))))

    href, href_bad = text_value(get("href"))
    url, url_bad = text_value(get("url"))
    wrong += [href_bad, url_bad]
    names = lambda *more: F.array(*(F.lit(x) for x in (*STRUCTURE, *BULKY, *NAMED, *more)))
    dropped = F.when(is_input, names("text", "isChecked")).when(F.coalesce(F.col("_type") == IDENTIFY, F.lit(True)), names("userId")).otherwise(names())
    # fields are looked at one by one only where any are left by name
    e = e.withColumn("_left", F.array_except(F.map_keys("_data"), dropped))
    left = F.col("_left")
    rest = F.map_filter("_data", lambda k, v: F.array_contains(left, k) & _is(v, TEXT, BOOLEAN, *NUMBERS))
    rest = F.transform_values(rest, lambda k, v: F.when(_is(v, TEXT), _short(v).cast("variant")).otherwise(v))
    rest = F.when(long_, F.map_concat(rest, F.create_map(F.lit("input_chars"), chars.cast("variant")))).otherwise(rest)
    extra = F.when((F.size(left) > 0) | long_, F.nullif(F.to_json(rest), F.lit("{}")))
    out = {
        "type_str": X.kind_name(F.col("_type"), source, sub),
        "url": F.coalesce(href, url),
        "title": text(get("title")),
        "referrer": text(get("referrer")),
        "user_id": text(get("userId"), F.coalesce(F.col("_type") == IDENTIFY, F.lit(False))),
        **place,
        "pointer_type": pointer,
        "input": value,
        "extra": extra,
    }
    return e.withColumns({**out, "wrong_typed": reduce(add, (b.cast("int") for b in wrong))}).drop("_type", "_data", "_source", "_is_input", "_last", "_typed", "_chars", "_left")


def residue(flat: DataFrame) -> DataFrame:
    """One row: events, fields of the wrong type, and kinds that have no name but their number."""
    unnamed = F.col("type_str").rlike(r"^[0-9]+$|:")
    return flat.agg(F.count("*").alias("events"), F.coalesce(F.sum("wrong_typed"), F.lit(0)).cast("long").alias("wrong_typed"), F.count_if(unnamed).alias("unknown_kinds"))
