"""Column expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.schema import ACTIVITY, EVENT_TYPES, MEDIA, MOUSE, SOURCES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_activity(type_str: Column | str = "type_str", extra: Column | str = "extra") -> Column:
    """Acts of the user among flat events: scripts' inputs are none."""
    scripted = (_col(type_str) == "Input") & F.get_json_object(_col(extra), "$.userTriggered").eqNullSafe("false")
    return F.coalesce(_col(type_str).isin(*ACTIVITY) & ~scripted, F.lit(False))


def is_activity_raw(type_: Column, source: Column, kind: Column, user_triggered: Column) -> Column:
    """The same on raw events; here media acts count under whatever name."""
    acts = source.isin(1, 3, 4, 6, 7, 12, 14) | ((source == 2) & ~kind.isin(5, 6)) | ((source == 5) & ~user_triggered.eqNullSafe(F.lit(False)))
    return F.coalesce(type_.isin(69, 70) | ((type_ == 3) & acts), F.lit(False))


def _names(names: dict[int, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def kind_name(type_: Column, source: Column, kind: Column) -> Column:
    """Flat name of a raw event; unknown kinds keep their numbers."""
    source_name = F.coalesce(F.try_element_at(_names(SOURCES), source), source.cast("string"))
    sub = F.when(source == 2, F.try_element_at(_names(MOUSE), kind)).when(source == 7, F.try_element_at(_names(MEDIA), kind))
    sub = F.when(source.isin(2, 7), F.coalesce(sub, F.concat(source_name, F.lit(":"), kind.cast("string"))))
    return F.when(type_ == 3, F.coalesce(sub, source_name)).otherwise(F.coalesce(F.try_element_at(_names(EVENT_TYPES), type_), type_.cast("string")))


def canonical_ts(type_: Column, source: Column, timestamp: Column, offsets: Column) -> Column:
    """A batch of moves stands where its last position stands."""
    batch = (type_ == 3) & source.isin(1, 6, 12) & (F.size(offsets) > 0)
    return F.when(batch, timestamp + F.element_at(offsets, -1)).otherwise(timestamp)


def on_canonical_clock(offsets: Column, shift: Column) -> Column:
    return F.transform(offsets, lambda o: o - shift)


def rounded(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def slice_open_ms(recorder_slice: Column | str) -> Column:
    return F.try_to_number(F.split_part(_col(recorder_slice), F.lit("-"), F.lit(1)), F.lit("9" * 19)).cast("long")


def is_slice_id(recorder_slice: Column | str) -> Column:
    return _col(recorder_slice).rlike(r"\A\d{14}-[a-z0-9]{4}\z")


def utc_day(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_col(ms)), "yyyy-MM-dd")


def utc_stamp(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_col(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_stamp(ms: Column | str, label: Column | None = None) -> Column:
    """[MM:SS.mmm], or with a label before; minutes grow beyond two digits, times before the origin count as it."""
    at = F.greatest(_col(ms), F.lit(0)).cast("long")
    clock = F.format_string("%02d:%02d.%03d", F.floor(at / 60000), F.floor(at / 1000) % 60, at % 1000)
    return F.concat(F.lit("["), clock if label is None else F.concat(label, F.lit(" "), clock), F.lit("]"))


def coarse_duration(ms: Column | str) -> Column:
    s = F.floor(_col(ms) / 1000).cast("long")
    return (
        F.when(s < 1, "seconds")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    )


def age(ms: Column | str) -> Column:
    m = F.floor(_col(ms) / 60000).cast("long")
    return (
        F.when(m >= 1440, F.format_string("%dd %dh", F.floor(m / 1440), F.floor(m / 60) % 24))
        .when(m >= 60, F.format_string("%dh %dm", F.floor(m / 60), m % 60))
        .otherwise(F.format_string("%dm", m))
    )


def route_key(url: Column | str) -> Column:
    """Address without its query; the fragment stays as it is."""
    return F.regexp_replace(_col(url), r"^([^?#]*)\?[^#]*", "$1")


def url_host(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))


def describe_url(url: Column | str, cap: int = 2000) -> Column:
    """Long addresses shed their query and keep its size; what is still too long is cut."""
    u = _col(url)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    size = F.when(F.length(query) < 1000, F.concat(F.length(query).cast("string"), F.lit(" chars"))).otherwise(F.concat(F.round(F.length(query) / 1000, 1).cast("string"), F.lit("kB")))
    shed = F.concat(F.regexp_extract(u, r"^([^?#]*)", 1), F.lit("?… ("), size, F.lit(" query)"), F.regexp_extract(u, r"(#.*)$", 1))
    short = F.when(query == "", u).otherwise(shed)
    return F.when(F.length(u) <= cap, u).otherwise(F.when(F.length(short) <= cap, short).otherwise(F.concat(F.substring(short, 1, cap - 1), F.lit("…"))))


def page_address(url: Column | str, cap: int = 2000) -> Column:
    """Addresses over the cap, in UTF-16 units, shed their query and keep its size; what is still too long is cut itself, on a whole character."""
    u = _col(url)
    units = lambda c: (F.length(F.encode(c, "UTF-16BE")) / 2).cast("long")
    base = F.substring_index(u, "#", 1)
    asked = F.instr(base, "?")
    n = units(F.substr(base, asked + 1))
    size = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" chars"))).otherwise(F.concat(F.bround(n / 1024, 0).cast("long").cast("string"), F.lit("kB")))
    shed = F.concat(F.substr(base, F.lit(1), asked - 1), F.lit("?… ("), size, F.lit(" query)"), F.substr(u, F.length(base) + 1))
    wide = F.encode(u, "UTF-16BE")
    split = F.hex(F.substring(wide, 2 * cap - 3, 2)).between("D800", "DBFF")
    cut = F.decode(F.when(split, F.substring(wide, 1, 2 * cap - 4)).otherwise(F.substring(wide, 1, 2 * cap - 2)), "UTF-16BE")
    return F.when(units(u) <= cap, u).when((asked > 0) & (units(shed) <= cap), shed).otherwise(F.concat(cut, F.lit("…")))


def escape_value(text: Column | str) -> Column:
    out = F.replace(_col(text), F.lit("\\"), F.lit("\\\\"))
    for raw, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(written))
    return out


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def truncate(text: Column | str, n: int) -> Column:
    t = _col(text)
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def truncate_words(text: Column | str, n: int) -> Column:
    """Cut at the last space within n characters."""
    t = _col(text)
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n - 1), r"\s+\S*\z", ""), F.lit("…")))


def cut_note(text: Column | str, cap: int) -> Column:
    t = _col(text)
    return F.when(F.char_length(t) <= cap, t).otherwise(F.concat(F.substring(t, 1, cap), F.format_string(" (first %d of %d chars)", F.lit(cap), F.char_length(t))))


def _common(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.zip_with(F.slice(F.split(a, ""), F.lit(1), n), F.slice(F.split(b, ""), F.lit(1), n), lambda x, y: x == y)
    return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("int")


def edit_delta(before: Column | str, after: Column | str) -> Column:
    """What one change of a value changed: (at, old, new), with what both begin and end with left out, the beginning first."""
    a, b = _col(before), _col(after)
    head = _common(a, b)
    old, new = F.substr(a, head + 1), F.substr(b, head + 1)
    tail = _common(F.reverse(old), F.reverse(new))
    return F.struct(head.alias("at"), F.substr(old, F.lit(1), F.char_length(old) - tail).alias("old"), F.substr(new, F.lit(1), F.char_length(new) - tail).alias("new"))


def split_meta(text: Column | str, header: str = "## Ambiguities and Feedback") -> Column:
    """A reply cut at the line that is the header: (answer, channel), the latter null without one."""
    parts = F.split(_col(text), r"(?m)^[ \t]*\Q" + header + r"\E[ \t]*\r?$", 2)
    return F.struct(F.rtrim(F.get(parts, F.lit(0)), F.lit(" \t\r\n")).alias("answer"), F.nullif(F.trim(F.get(parts, F.lit(1)), F.lit(" \t\r\n")), F.lit("")).alias("channel"))


def field_tokens(name: Column | str) -> Column:
    """A field name's words: humps and signs are borders, digits stay with their word."""
    apart = F.regexp_replace(F.regexp_replace(_col(name), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def field_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(name)), r"[^\p{L}\p{N}]+", "")


# Words that name a secret or a means of payment.
SECRETS = ("password", "passwd", "passcode", "passphrase", "secret", "otp", "cvv", "cvc", "csc", "pin", "cardnumber", "ccnumber", "iban", "ssn")


def is_credential(name: Column | str, words: tuple[str, ...] = SECRETS) -> Column:
    """Names of fields that hold credentials: one of the words stands alone, as a run of words, or, if it is long, within."""
    tokens, whole = field_tokens(name), field_name(name)
    long_ = F.lit(False)
    for w in words:
        long_ |= (whole == w) | (whole.contains(w) if len(w) > 5 else F.lit(False))
    return F.coalesce(long_ | F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(False))


def is_local_host(host: Column | str) -> Column:
    h = F.lower(_col(host))
    return F.coalesce(h.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0") | h.endswith(".localhost") | h.endswith(".local") | h.rlike(r"^(10|192\.168|172\.(1[6-9]|2\d|3[01]))\."), F.lit(False))


def call_cost(fresh: Column, cached: Column, out: Column, thoughts: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    """USD, from prices for a million tokens."""
    return F.round((fresh * price_in + cached * price_cached + (out + thoughts) * price_out) / 1_000_000, 8)


def device(user_agent: Column | str, touch_points: Column, width: Column, height: Column) -> Column:
    """Tablets that ask for desktop pages give themselves away by touch points and their screens' shape."""
    ua = _col(user_agent)
    wide = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    has = ua.contains
    return (
        F.when(has("iPad") | (has("Android") & ~has("Mobile")), "tablet")
        .when(has("iPhone") | has("iPod") | has("Mobile"), "mobile")
        .when(has("Macintosh") & (touch_points > 1), F.when(wide >= 1.6, "mobile").otherwise("tablet"))
        .when(ua.isNull() | (ua == ""), F.lit(None))
        .otherwise("desktop")
    )


def os_name(user_agent: Column | str) -> Column:
    has = _col(user_agent).contains
    return F.when(has("Windows"), "Windows").when(has("iPhone") | has("iPad"), "iOS").when(has("Android"), "Android").when(has("Mac OS X"), "Mac OS X").when(has("CrOS"), "Chrome OS").when(has("Linux"), "Linux")


def browser_name(user_agent: Column | str) -> Column:
    has = _col(user_agent).contains
    return F.when(has("Edg/"), "Edge").when(has("OPR/"), "Opera").when(has("Firefox/"), "Firefox").when(has("Chrome/"), "Chrome").when(has("Safari/"), "Safari")


def sums_to_nothing(*cells: Column) -> Column:
    """A row whose every cell is null, zero or blank."""
    out = F.lit(True)
    for c in cells:
        out &= F.coalesce(F.trim(c.cast("string")).isin("", "0", "0.0"), F.lit(True))
    return out
