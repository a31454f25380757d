"""The scalar functions. All are column expressions that Catalyst sees through, but for the few in `pandas_only`."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.functions import text_search, vectors


@dataclass
class Context:
    """What a builder may ask: the type of an argument, the session's seed and sequences."""

    type_of: Callable[[Column], T.DataType]
    seed: int | None = None
    sequences: Any = None
    names: list[str] = field(default_factory=list)


Builder = Callable[..., Column]
SCALARS: dict[str, Builder] = {}
lit = F.lit


def define(*names: str) -> Callable[[Builder], Builder]:
    """Registers a builder that takes the context first."""

    def put(f: Builder) -> Builder:
        for x in names:
            SCALARS[x] = f
        return f

    return put


def plain(f: Builder, *names: str) -> None:
    """Registers a builder that needs no context."""
    define(*names)(lambda ctx, *a: f(*a))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def double(f: Callable[..., Column]) -> Builder:
    return lambda *a: f(*(x.cast("double") for x in a)).cast("double")


# ---- arithmetic


@define("+")
def add(ctx: Context, a: Column, b: Column) -> Column:
    ta, tb = ctx.type_of(a), ctx.type_of(b)
    if is_list(ta) or is_list(tb):
        return F.concat(a if is_list(ta) else F.array(a), b if is_list(tb) else F.array(b))
    if is_text(ta) or is_text(tb):
        return F.concat(a.cast("string"), b.cast("string"))
    return a + b


@define("/")
def divide(ctx: Context, a: Column, b: Column) -> Column:
    return F.call_function("div", a, b) if is_whole(ctx.type_of(a)) and is_whole(ctx.type_of(b)) else a / b


plain(lambda a, b: a - b, "-")
plain(lambda a, b: a * b, "*")
plain(lambda a, b: a % b, "%", "mod")
plain(double(F.pow), "^", "pow", "power")
plain(F.abs, "abs")
plain(double(F.ceil), "ceil", "ceiling")
plain(double(F.floor), "floor")
plain(lambda x, d=None: F.round(x.cast("double"), d if d is not None else 0), "round")
plain(double(F.log10), "log10")
plain(double(F.log2), "log2")
plain(double(F.ln), "log", "ln")
for _name in ("sqrt", "cbrt", "cot", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "degrees", "radians", "sinh", "cosh", "tanh"):
    plain(double(getattr(F, _name)), _name)
plain(lambda x: F.signum(x.cast("double")).cast("long"), "sign")
plain(lambda: F.pi(), "pi")
plain(lambda x: F.factorial(x.cast("int")), "factorial")


@define("even")
def even(ctx: Context, x: Column) -> Column:
    """The nearest even number away from zero for fractions; odd whole numbers go up by one."""
    if is_whole(ctx.type_of(x)):
        return x + F.pmod(x, lit(2))
    c = F.ceil(x.cast("double"))
    return (c + F.pmod(c, lit(2))).cast("double")


@define("rand", "random")
def rand(ctx: Context) -> Column:
    return F.rand(ctx.seed) if ctx.seed is not None else F.rand()


@define("set_seed")
def set_seed(ctx: Context, x: Column) -> Column:
    return lit(0).cast("long")


def series_udf(f: Callable, kind: str, series: type):
    """A pandas UDF of a function from series to series; its hints are set here, as pandas is imported late."""
    f.__annotations__ = dict.fromkeys([*f.__code__.co_varnames[: f.__code__.co_argcount], "return"], series)
    return F.pandas_udf(f, kind)


@functools.cache
def pandas_only(name: str):
    """Functions that Spark has no expression for, as vectorised pandas UDFs."""
    import math

    import pandas as pd

    def gamma(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v != v else math.inf if v <= 0 and v == int(v) else math.gamma(v) if v < 171 else math.inf)

    def lgamma(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v != v else math.inf if v <= 0 and v == int(v) else math.lgamma(v))

    return series_udf({"gamma": gamma, "lgamma": lgamma}[name], "double", pd.Series)


plain(lambda x: pandas_only("gamma")(x.cast("double")), "gamma")
plain(lambda x: pandas_only("lgamma")(x.cast("double")), "lgamma")


def gcd_of(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold; 93 steps do for any pair of 64-bit numbers."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, lit(0)).otherwise(F.try_mod(s["a"], s["b"])).cast("long").alias("b"))
    return F.aggregate(F.sequence(lit(1), lit(93)), start, step, lambda s: s["a"])


plain(gcd_of, "gcd")
plain(lambda a, b: F.when((a == 0) | (b == 0), lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a, gcd_of(a, b)) * b)), "lcm")
plain(lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), "bitwise_and", "&")
plain(lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), "bitwise_or", "|")
plain(lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")), "bitwise_xor", "#")
plain(lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")), "bit_shift_left", "<<")
plain(lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")), "bit_shift_right", ">>")

# ---- comparison and logic

plain(lambda a, b: a == b, "=")
plain(lambda a, b: a != b, "<>")
plain(lambda a, b: a < b, "<")
plain(lambda a, b: a <= b, "<=")
plain(lambda a, b: a > b, ">")
plain(lambda a, b: a >= b, ">=")
plain(lambda x: x.isNull(), "is null")
plain(lambda x: x.isNotNull(), "is not null")
plain(lambda a, b: a & b, "and")
plain(lambda a, b: a | b, "or")
plain(lambda a, b: a != b, "xor")
plain(lambda x: ~x, "not")
plain(lambda x: -x, "neg")

# ---- strings

plain(lambda *a: F.concat(*(x.cast("string") for x in a)), "concat")
plain(lambda a, b: F.contains(a, b), "contains")
plain(lambda a, b: F.startswith(a, b), "starts_with", "prefix", "starts with")
plain(lambda a, b: F.endswith(a, b), "ends_with", "suffix", "ends with")
plain(lambda a, b: F.like(a, F.replace(b, lit("\\"), lit("\\\\"))), "like")
plain(F.upper, "to_upper", "upper", "ucase")
plain(F.lower, "to_lower", "lower", "lcase")
plain(lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "trim")
plain(lambda x: F.regexp_replace(x, r"(?U)^\s+", ""), "ltrim")
plain(lambda x: F.regexp_replace(x, r"(?U)\s+$", ""), "rtrim")
plain(lambda x, k: F.repeat(x, k.cast("int")), "repeat")
plain(lambda x, a, b: F.replace(x, a, b), "replace")
plain(lambda x, a, k=None: F.substring(x, a.cast("int"), k.cast("int") if k is not None else lit(2**31 - 1)), "substring", "substr")
plain(lambda x, p: F.regexp_like(x, p), "regex_matches", "regexp_matches")
plain(lambda x, p, r: F.regexp_replace(x, p, r), "regex_replace", "regexp_replace")
plain(lambda x, d=None: F.split(x, F.concat(lit("\\Q"), d if d is not None else lit(","), lit("\\E"))), "split")
plain(lambda x, k=None: F.left(x, k.cast("int") if k is not None else lit(1)), "head", "left")
plain(lambda x, k=None: F.right(x, k.cast("int") if k is not None else lit(1)), "tail", "right")
plain(lambda x, k, p=None: F.call_function("lpad", x, k.cast("int"), p if p is not None else lit(" ")), "lpad")
plain(lambda x, k, p=None: F.call_function("rpad", x, k.cast("int"), p if p is not None else lit(" ")), "rpad")
plain(lambda x: F.concat(F.upper(F.left(x, lit(1))), F.lower(F.substring(x, 2, 2**31 - 1))), "initcap")
plain(lambda d, *a: F.when(functools.reduce(lambda p, q: p | q, [x.isNull() for x in (d, *a)]), lit(None)).otherwise(F.call_function("concat_ws", d, *a)), "concat_ws")
plain(lambda x, d, k: F.split_part(x, d, k.cast("int")), "split_part")
plain(lambda x, i: F.when(i > 0, F.substring(x, F.least(i, F.length(x)).cast("int"), lit(1))).otherwise(F.substring(x, i.cast("int"), lit(1))), "array_extract")
plain(lambda x, p: F.regexp_like(x, F.concat(lit("^(?:"), p, lit(")$"))), "regexp_full_match")
plain(lambda x, p, g=None: F.call_function("regexp_extract", x, p, g.cast("int") if g is not None else lit(0)), "regexp_extract")
plain(lambda x, p, g=None: F.regexp_extract_all(x, p, g.cast("int") if g is not None else lit(0)), "regexp_extract_all")
plain(lambda x, p: F.split(x, p), "regexp_split_to_array")
plain(lambda a, b: F.levenshtein(a, b), "levenshtein")
plain(F.soundex, "soundex")


@define("length", "size", "cardinality")
def size(ctx: Context, x: Column) -> Column:
    """Characters of a string, elements of a list or map, hops of a path."""
    t = ctx.type_of(x)
    if isinstance(t, T.StructType) and "_length" in t.names:
        return x["_length"].cast("long")
    return (F.size(x) if isinstance(t, (T.ArrayType, T.MapType)) else F.length(x)).cast("long")


@define("reverse", "list_reverse")
def reverse(ctx: Context, x: Column) -> Column:
    return F.reverse(x)


# ---- hashes, blobs

plain(lambda x: F.md5(x.cast("binary")), "md5")
plain(lambda x: F.sha2(x.cast("binary"), 256), "sha256")
plain(lambda x: F.xxhash64(x), "hash")
plain(lambda x: F.encode(x, "UTF-8"), "encode")
plain(lambda x: F.decode(x, "UTF-8"), "decode")
plain(F.octet_length, "octet_length")
plain(lambda x: x.cast("binary"), "blob_from_bytes", "blob")
plain(lambda x: F.base64(x.cast("binary")), "to_base64")
plain(F.unbase64, "from_base64")

# ---- dates and times

_PARTS = {"year": "YEAR", "month": "MONTH", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "quarter": "QUARTER", "dayofyear": "DOY", "week": "WEEK"}


def literal_of(x: Column) -> str:
    """The text of a literal argument."""
    return x._jc.toString().strip("'").lower()


def part_of(part: str, x: Column) -> Column:
    if part in _PARTS:
        return F.date_part(lit(_PARTS[part]), x).cast("long")
    micros = F.unix_micros(x.cast("timestamp"))
    known = {"second": lambda: F.second(x), "millisecond": lambda: F.call_function("div", F.pmod(micros, lit(60_000_000)), lit(1000)), "microsecond": lambda: F.pmod(micros, lit(60_000_000)), "epoch": lambda: F.unix_seconds(x.cast("timestamp")), "century": lambda: F.ceil(F.year(x) / 100), "decade": lambda: F.floor(F.year(x) / 10), "weekofyear": lambda: F.weekofyear(x)}
    if part in ("dayofweek", "dow", "isodow", "weekday"):
        return (F.weekday(x) + 1).cast("long")
    if part not in known:
        raise ValueError(f"unknown part of a date: {part}")
    return known[part]().cast("long")


plain(lambda p, x: part_of(literal_of(p), x), "date_part")
for _name in ("year", "month", "day", "hour", "minute", "second", "century"):
    plain(functools.partial(part_of, _name), _name)


def truncated(p: Column, x: Column) -> Column:
    part = literal_of(p)
    return F.date_trunc(part, x) if part in ("hour", "minute", "second", "millisecond", "microsecond") else F.trunc(x, part)


plain(truncated, "date_trunc")


def months_between(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def difference(p: Column, a: Column, b: Column) -> Column:
    part = literal_of(p)
    days = F.datediff(b.cast("date"), a.cast("date"))
    out = {"year": lambda: F.year(b) - F.year(a), "quarter": lambda: F.floor(months_between(a, b) / 3), "month": lambda: months_between(a, b), "week": lambda: F.call_function("div", days, lit(7)), "day": lambda: days}
    if part not in out:
        raise ValueError(f"date_diff has no part {part}")
    return out[part]().cast("long")


plain(difference, "date_diff", "datediff")


def later(p: Column, k: Column, x: Column) -> Column:
    part, k, d = literal_of(p), k.cast("int"), x.cast("date")
    months = {"year": 12, "quarter": 3, "month": 1}
    return F.add_months(d, k * months[part]) if part in months else F.date_add(d, k * {"week": 7, "day": 1}[part])


plain(later, "date_add")
plain(lambda: F.current_date(), "current_date")
plain(lambda: F.current_timestamp(), "current_timestamp")
plain(lambda x: F.date_format(x, "EEEE"), "dayname")
plain(lambda x: F.date_format(x, "MMMM"), "monthname")
plain(F.last_day, "last_day")
plain(lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")), "make_date")
plain(lambda x: F.timestamp_millis(x.cast("long")), "epoch_ms")
plain(lambda x: F.timestamp_seconds(x.cast("double")), "to_timestamp")
plain(lambda x: F.unix_millis(x.cast("timestamp")), "to_epoch_ms")

# ---- intervals: calendar intervals

for _at, _name in enumerate(("years", "months", "weeks", "days", "hours", "minutes")):
    plain(functools.partial(lambda at, x: F.make_interval(*[x.cast("int") if i == at else lit(0) for i in range(at + 1)]), _at), f"to_{_name}")
for _name, _unit in (("seconds", 1), ("milliseconds", 1000), ("microseconds", 1_000_000)):
    plain(functools.partial(lambda unit, x: F.make_interval(lit(0), lit(0), lit(0), lit(0), lit(0), lit(0), (x.cast("long") / unit).cast("decimal(18,6)")), _unit), f"to_{_name}")

# ---- casts

TYPES = {"string": "string", "int64": "long", "int": "long", "integer": "long", "int32": "int", "int16": "short", "int8": "byte", "uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)", "int128": "decimal(38,0)", "uint128": "decimal(38,0)", "serial": "long", "double": "double", "float": "float", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamp_sec": "timestamp_ntz", "timestamp_ms": "timestamp_ntz", "timestamp_ns": "timestamp_ntz", "timestamp_tz": "timestamp", "blob": "binary", "uuid": "string", "json": "string", "time": "long", "interval": "interval"}


def spark_type(name: str) -> str:
    """Spark's name of one of the language's types."""
    t = name.strip()
    if t.endswith("[]"):
        return f"array<{spark_type(t[:-2])}>"
    head, _, inner = t.partition("(")
    if inner:
        parts, depth, at, body = [], 0, 0, inner[:-1]
        for i, c in enumerate(body):
            depth += (c in "(<") - (c in ")>")
            if c == "," and not depth:
                parts.append(body[at:i])
                at = i + 1
        parts.append(body[at:])
        if head.lower() == "map":
            return f"map<{spark_type(parts[0])},{spark_type(parts[1])}>"
        if head.lower() == "decimal":
            return t.lower()
        fields = [p.strip().split(" ", 1) for p in parts]
        return "struct<" + ",".join([*(["tag:string"] if head.lower() == "union" else []), *(f"{c}:{spark_type(k)}" for c, k in fields)]) + ">"
    if t.lower() not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[t.lower()]


plain(lambda x, t=None: x.cast(spark_type(literal_of(t)) if t is not None else "string"), "cast")
plain(lambda x: x.cast("string"), "cast_string", "string", "to_string")
plain(lambda x: x.cast("long"), "cast_int64", "int64", "int", "to_int64")
plain(lambda x: x.cast("double"), "cast_double", "float", "double", "to_double")
plain(lambda x: x.cast("boolean"), "cast_bool", "bool", "boolean", "to_bool")
plain(lambda x: F.to_date(x), "date")
plain(lambda x: F.to_timestamp_ntz(x), "timestamp")

# ---- lists


def listed(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


plain(lambda *a: F.array(*a), "list_creation", "array_value")
plain(lambda x, i: F.element_at(x, i.cast("int")), "list_extract", "list_element")


@define("list_concat", "list_cat", "array_concat", "array_cat")
def list_concat(ctx: Context, *a: Column) -> Column:
    return F.concat(*(x if is_list(ctx.type_of(x)) else F.array(x) for x in a))


plain(lambda x: F.size(x).cast("long"), "list_len", "array_length")
plain(F.sort_array, "list_sort")
plain(lambda x: F.sort_array(x, asc=False), "list_reverse_sort")
plain(lambda x, v: F.array_contains(x, v), "list_contains", "array_contains", "array_has")
plain(lambda x, v: F.array_append(x, v), "list_append", "array_append", "array_push_back")
plain(lambda x, v: F.array_prepend(x, v), "list_prepend", "array_prepend", "array_push_front")
plain(lambda x, a, b: F.slice(x, a.cast("int"), (b - a + 1).cast("int")), "list_slice", "array_slice")


def stretch(a: Column, b: Column | None = None, step: Column | None = None) -> Column:
    low, high = (lit(0).cast("long"), a) if b is None else (a, b)
    by = lit(1).cast("long") if step is None else step
    empty = F.array().cast("array<bigint>")
    return F.when(F.signum(high - low) * F.signum(by) < 0, empty).otherwise(F.sequence(low.cast("long"), high.cast("long"), by.cast("long")))


plain(stretch, "range")
plain(lambda x: F.array_distinct(listed(x)), "list_distinct")
plain(lambda x: F.size(F.array_distinct(listed(x))).cast("long"), "list_unique")


def folded(ctx: Context, x: Column, start: Any, step: Callable[[Column, Column], Column]) -> Column:
    t = ctx.type_of(x)
    kind = "long" if is_list(t) and is_whole(t.elementType) else "double"
    return F.aggregate(listed(x), lit(start).cast(kind), lambda a, v: step(a, v.cast(kind)))


define("list_sum")(lambda ctx, x: folded(ctx, x, 0, lambda a, v: a + v))
define("list_product")(lambda ctx, x: folded(ctx, x, 1, lambda a, v: a * v))
plain(lambda x: F.try_element_at(listed(x), lit(1)), "list_any_value")
plain(lambda d, x: F.array_join(F.transform(listed(x), lambda v: v.cast("string")), literal_text(d)), "list_to_string")
plain(lambda x, v: F.array_position(x, v), "list_position", "list_indexof", "array_position", "array_indexof")
plain(lambda a, b: F.size(F.array_except(listed(b), a)) == 0, "list_has_all")
plain(lambda a, b: F.size(F.array_intersect(listed(a), listed(b))) > 0, "list_has_any")
plain(lambda x, v: F.size(F.filter(x, lambda e: e == v)).cast("long"), "list_count")
plain(F.array_min, "list_min")
plain(F.array_max, "list_max")


def literal_text(x: Column) -> str:
    return x._jc.toString().strip("'")


def truthy(ctx: Context, x: Column) -> Callable[[Column], Column]:
    t = ctx.type_of(x)
    whole = is_list(t) and not isinstance(t.elementType, T.BooleanType)
    return lambda v: F.coalesce((v != 0) if whole else v, lit(False))


define("any")(lambda ctx, x: F.exists(x, truthy(ctx, x)))
define("all")(lambda ctx, x: (F.size(x) > 0) & F.forall(x, truthy(ctx, x)))
define("none")(lambda ctx, x: ~F.exists(x, truthy(ctx, x)))
define("single")(lambda ctx, x: F.size(F.filter(x, truthy(ctx, x))) == 1)

# ---- vectors

for _name, _f in vectors.FUNCTIONS.items():
    plain(_f, _name)
plain(lambda a, b: F.filter(a, lambda v: F.array_contains(b, v)), "array_intersect")

# ---- maps, structs, unions


@define("map_creation", "map")
def map_creation(ctx: Context, *a: Column) -> Column:
    if len(a) == 2 and is_list(ctx.type_of(a[0])):
        return F.map_from_arrays(*a)
    return F.create_map(*a)


define("map_extract", "element_at")(lambda ctx, m, k: F.element_at(m, k) if isinstance(ctx.type_of(m), T.MapType) else F.element_at(m, k.cast("int")) if is_list(ctx.type_of(m)) else m.getField(literal_text(k)))


@define("map_keys")
def map_keys(ctx: Context, m: Column) -> Column:
    t = ctx.type_of(m)
    return F.array(*map(lit, t.names)) if isinstance(t, T.StructType) else F.map_keys(m)


@define("map_values")
def map_values(ctx: Context, m: Column) -> Column:
    t = ctx.type_of(m)
    return F.array(*(m.getField(x) for x in t.names)) if isinstance(t, T.StructType) else F.map_values(m)


plain(F.map_from_entries, "map_from_entries")
plain(lambda *a: F.struct(*(v.alias(literal_text(k)) for k, v in zip(a[::2], a[1::2], strict=True))), "struct_creation", "struct_pack")
plain(lambda s, k: s.getField(literal_text(k)), "struct_extract", "union_extract")
plain(lambda k, v=None: F.struct((lit("_value") if v is None else k).alias("tag"), (k if v is None else v).alias("_value" if v is None else literal_text(k))), "union_value")
plain(lambda u: u.getField("tag"), "union_tag")

# ---- utility

plain(lambda *a: F.coalesce(*a), "coalesce", "ifnull")
plain(lambda a, b: F.nullif(a, b), "nullif")


def nulls_win(f: Callable[..., Column]) -> Builder:
    return lambda *a: F.when(functools.reduce(lambda p, q: p & q, [x.isNotNull() for x in a]), f(*a)) if len(a) > 1 else a[0]


plain(nulls_win(F.greatest), "greatest")
plain(nulls_win(F.least), "least")
plain(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a), "constant_or_null")
plain(lambda m: F.raise_error(m), "error")
plain(lambda *a: lit(True), "pg_isready")
TYPE_NAMES = {"bigint": "Int64", "int": "Int32", "smallint": "Int16", "tinyint": "Int8", "double": "Double", "float": "Float", "string": "String", "boolean": "Bool", "date": "Date", "timestamp": "Timestamp", "timestamp_ntz": "Timestamp", "binary": "Blob", "interval": "Interval"}


@define("typeof")
def typeof(ctx: Context, x: Column) -> Column:
    t = ctx.type_of(x).simpleString()
    name = TYPE_NAMES.get(t) or {"array": "List", "map": "Map", "struct": "Struct", "decimal": "Int128"}.get(t.split("<")[0].split("(")[0], t)
    return F.when(x.isNotNull(), lit(name))


plain(lambda *a: F.uuid(), "gen_random_uuid", "uuid")
define("nextval")(lambda ctx, x: lit(ctx.sequences.next(literal_text(x))))
define("currval")(lambda ctx, x: lit(ctx.sequences.current(literal_text(x))))

# ---- elements of graphs and paths


def field_or(ctx: Context, x: Column, *names: str, default: Any = None) -> Column:
    t = ctx.type_of(x)
    have = [k for k in names if isinstance(t, T.StructType) and k in t.names]
    return x.getField(have[0]) if have else lit(default)


define("id", "rowid", "internal_id")(lambda ctx, x: field_or(ctx, x, "_id"))
define("offset")(lambda ctx, x: field_or(ctx, x, "offset", "_id") if isinstance(ctx.type_of(x), T.StructType) else x)
define("start_node")(lambda ctx, x: field_or(ctx, x, "_src"))
define("end_node")(lambda ctx, x: field_or(ctx, x, "_dst"))
define("label", "labels")(lambda ctx, x: field_or(ctx, x, "_label"))
define("cost")(lambda ctx, x: F.coalesce(field_or(ctx, x, "_cost", "cost", default=0.0).cast("double"), lit(0.0)))
define("nodes")(lambda ctx, x: field_or(ctx, x, "_nodes"))
define("rels", "relationships")(lambda ctx, x: field_or(ctx, x, "_rels"))
define("is_trail")(lambda ctx, x: F.size(F.array_distinct(x["_rels"])) == F.size(x["_rels"]))
define("is_acyclic")(lambda ctx, x: F.size(F.array_distinct(x["_nodes"])) == F.size(x["_nodes"]))


@define("properties")
def properties(ctx: Context, x: Column, key: Column | None = None) -> Column:
    if key is not None:
        k = literal_text(key)
        return F.transform(x, lambda v: v.getField(k))
    names = [k for k in ctx.type_of(x).names if not k.startswith("_")]
    return F.create_map(*[y for k in names for y in (lit(k), x.getField(k).cast("string"))])


# ---- JSON


def json_path(p: Column) -> str:
    text = literal_text(p)
    return text if text.startswith("$") else "$" + (text if text.startswith("[") else "." + text)


plain(lambda j, p: F.get_json_object(j, json_path(p)), "json_extract")
plain(lambda j: F.json_array_length(j).cast("long"), "json_array_length")
plain(lambda j: F.when(j.isNotNull(), F.try_parse_json(j).isNotNull()), "json_valid")
plain(lambda j: F.json_object_keys(j), "json_keys")


@functools.cache
def json_udf(name: str):
    import json

    import pandas as pd

    def load(x):
        try:
            return True, json.loads(x)
        except (TypeError, ValueError):
            return False, None

    def kind(v) -> str:
        return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"

    def within(a, b) -> bool:
        if isinstance(b, dict):
            return isinstance(a, dict) and all(k in a and within(a[k], v) for k, v in b.items())
        if isinstance(a, list):
            return all(any(within(x, y) for x in a) for y in (b if isinstance(b, list) else [b]))
        return kind(a) == kind(b) and a == b

    def outline(v, indent: int = 0) -> list[str]:
        pad = "  " * indent
        if isinstance(v, dict):
            return [pad + "object", *(line for k, x in v.items() for line in [f"{pad}  {k}:", *outline(x, indent + 2)])]
        if isinstance(v, list):
            return [pad + "array", *dict.fromkeys(line for x in v for line in outline(x, indent + 1))]
        return [pad + kind(v)]

    def one(f):
        return lambda s: s.map(lambda x: (lambda ok, v: f(v) if ok else None)(*load(x)))

    def contains(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            (p, v), (q, w) = load(x), load(y)
            out.append(within(v, w) if p and q else None)
        return pd.Series(out, dtype="object")

    def type_name(s: pd.Series) -> pd.Series:
        return one(kind)(s)

    def structure(s: pd.Series) -> pd.Series:
        return one(lambda v: "\n".join(outline(v)))(s)

    f, t = {"contains": (contains, "boolean"), "type": (type_name, "string"), "structure": (structure, "string")}[name]
    return series_udf(f, t, pd.Series)


plain(lambda a, b: json_udf("contains")(a, b), "json_contains")
plain(lambda a: json_udf("type")(a), "json_type")
plain(lambda a: json_udf("structure")(a), "json_structure")

# ---- text search

plain(text_search.stem, "stem")
plain(text_search.tokens, "tokenize")


@functools.cache
def fetch_udf():
    def fetch(url: str | None) -> str | None:
        import urllib.request

        if url is None:
            return None
        with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310 - the user asks for this address
            return r.read().decode("utf-8", "replace")

    return F.udf(fetch, "string").asNondeterministic()


plain(lambda u: fetch_udf()(u), "http_get")
EMBEDDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def embedding(text: Column, provider: Column | None = None, model: Column | None = None) -> Column:
    """A registered embedder's vectors. `hashing`, the default, needs no network: signed token counts in 64 dimensions."""
    import pandas as pd

    name = literal_text(provider) if provider is not None else "hashing"
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name}; register one in EMBEDDERS")
    f = EMBEDDERS[name]

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(f([x or "" for x in s]))

    return series_udf(run, "array<double>", pd.Series)(text)


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    import math
    import re
    import zlib

    out = []
    for t in texts:
        v = [0.0] * 64
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % 64] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


EMBEDDERS["hashing"] = hashing_embedder
plain(embedding, "create_embedding")
