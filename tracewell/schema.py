"""Tables, closed vocabularies and validated settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def _table(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike DDL parsing it needs no session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


IDENTITY = "visitor_id string, timestamp long, type int, counter string, raw_json binary, content_hash string"
PLACEMENT = "slice_id long, session_id long"
DISTILLED = (
    "type_str string, url string, page_url string, tag string, class string, text string, x long, y long, input string, href string, title string, "
    "referrer string, user_id string, pointer_type string, extra string, hidden int, md string, diff string"
)
TESTIMONY = (
    "device string, os string, browser string, language string, time_zone string, screen_width long, screen_height long, internal int, "
    "script_version string, recorder_slice string, snippet string"
)
#: What is frozen at capture, what may be derived again, and what the capture said of itself once.
EVENTS = _table(f"id long, {IDENTITY}, {PLACEMENT}, {DISTILLED}, {TESTIMONY}")
SLICES = _table(
    "visitor_id string, recorder_slice string, start_ts long, end_ts long, n_events long, status string, reason string, absorbed array<string>, snippet string, "
    "url string, device string, os string, browser string, language string, time_zone string, screen_width long, screen_height long, internal int, script_version string"
)
SESSIONS = _table("visitor_id string, snippet string, start_ts long, end_ts long, duration_ms long, pageviews long, user_activity_ms long, engaged int")
LOADED_CHUNKS = _table("key string, etag string, uploaded_ms long")
CHUNK_ERRORS = _table("snippet string, visitor_id string, recorder_slice string, chunk_key string, error string")
SPEND = _table("ts string, model string, label string, usd double, input_tokens long, cached_tokens long, output_tokens long, thoughts_tokens long, record string")
DEFAULTS = {"internal": 0}

# Numbers and names of event kinds in the recording format; so are the columns of the tables above.
EVENT_TYPES = {0: "DomContentLoaded", 1: "Load", 2: "FullSnapshot", 3: "IncrementalSnapshot", 4: "Meta", 5: "Custom", 6: "Plugin", 69: "PageLoad", 70: "PageVisible", 71: "PageHidden", 72: "Identify"}
SOURCES = {0: "Mutation", 1: "MouseMove", 2: "MouseInteraction", 3: "Scroll", 4: "ViewportResize", 5: "Input", 6: "TouchMove", 7: "MediaInteraction", 8: "StyleSheetRule", 9: "CanvasMutation", 10: "Font", 11: "Log", 12: "Drag", 13: "StyleDeclaration", 14: "Selection", 15: "AdoptedStyleSheet", 16: "CustomElement"}
MOUSE = {0: "MouseUp", 1: "MouseDown", 2: "Click", 3: "ContextMenu", 4: "DblClick", 5: "Focus", 6: "Blur", 7: "TouchStart", 8: "TouchMove_Departed", 9: "TouchEnd", 10: "TouchCancel"}
MEDIA = {0: "Play", 1: "Pause", 2: "Seeked", 3: "VolumeChange", 4: "RateChange"}
#: Kinds that are acts of the user.
ACTIVITY = tuple([EVENT_TYPES[t] for t in (69, 70)] + [SOURCES[s] for s in (1, 3, 4, 5, 6, 7, 12, 14)] + [m for m in MOUSE.values() if m not in ("Focus", "Blur")])


@dataclass(frozen=True)
class SessionRule:
    gap_ms: int = 30 * 60 * 1000
    stretch_ms: int = 10_000
    engaged_ms: int = 10_000
    engaged_pageviews: int = 2

    def __post_init__(self) -> None:
        for name in ("gap_ms", "stretch_ms", "engaged_ms", "engaged_pageviews"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a whole number above zero")


@dataclass(frozen=True)
class Retention:
    days: int = 30

    def __post_init__(self) -> None:
        if not isinstance(self.days, int) or self.days <= 0:
            raise ValueError("days must be a whole number above zero")


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with all columns of schema, missing ones null or at their default; a missing column that must not be null refuses."""
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif not f.nullable:
            raise ValueError(f"{f.name} can't be added")
        else:
            out.append(F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*out)
