"""Raw lines to lake rows: detect the source, extract, map, and account for every line.

A line goes to the first source that matches it and whose extractor takes it. What no source takes becomes an unparsed row
with the template of its text, so no line is lost. All of it is one pass: a projection, however many sources there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pipes import choose
from ..functions.text import bound, mask
from ..schema import GOLD, LONGEST
from .extract import syslog
from .mapping import PACK, Source, map_events, once


def envelope(lines: DataFrame, text: str, key: str, recv_ms: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """raw_id, recv_ms, line, raw_ref, raw_sha256 and truncated for rows of raw text, and the columns to ``keep``.

    A line of more than ``LONGEST`` bytes is cut, between two characters, and marked; the hash is of the bytes that are kept.
    """
    long = F.coalesce(F.octet_length(F.col(text)) > LONGEST, F.lit(False))
    # A character that the cut goes through leaves replacement marks at the end, which go too.
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.col(text).cast("binary"), 1, LONGEST).cast("string")), "\ufffd{1,3}$", "")
    cut = lines.withColumn("__line", F.when(long, head).otherwise(F.col(text)))
    return cut.select(F.col(key).cast("string").alias("raw_id"), F.col(recv_ms).cast("long").alias("recv_ms"), F.col("__line").alias("line"), F.concat(F.lit("raw/"), F.col(key).cast("string")).alias("raw_ref"), F.sha2("__line", 256).alias("raw_sha256"), long.alias("truncated"), *keep)


def detect(raw: DataFrame, sources: list[Source]) -> DataFrame:
    """``raw`` with ``fields`` and ``kind`` (source and class, or null): the first source by priority that matches a line
    and extracts it. What no source takes has null fields. A column ``header`` of ``raw`` (see :mod:`..streaming.headers`)
    names the cells of sources of separated cells."""
    ordered = sorted(sources, key=lambda s: (-s.priority, s.id))
    line, head = F.col("line"), F.col("__head")
    framed = any(s.framing == "syslog" for s in sources)
    header = F.col("header") if "header" in raw.columns else None
    raw = once(raw, "__head", syslog(line, F.col("recv_ms")) if framed else F.lit(None))

    def taken(s: Source) -> Column:
        named = lambda fields: F.map_concat(fields, F.create_map(F.lit(PACK), F.lit(s.id)))
        found = s.extract(line, head, header)
        if s.confirms(line, F.col("x")) is not None:  # fields decide too
            found = bound(found, lambda x: F.when(s.confirms(line, x), x))
        return F.when(s.matches(line), named(found))

    tried = [taken(s) for s in ordered]
    out = once(raw, "fields", F.coalesce(*tried) if tried else F.lit(None).cast("map<string,string>"))
    kind = choose([(F.col("fields")[PACK] == s.id, F.concat(F.lit(f"{s.id}|"), s.class_of(F.col("fields")))) for s in ordered])
    return once(out.drop("__head"), "kind", kind.cast("string"))


def unparsed_columns(reason: Column | str = "no_pack") -> dict[str, Column]:
    """Columns of a line that no source takes: class 0, its text as the message, the hash of its template and the reason."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    template = F.substring(F.sha2(mask(F.col("line")), 256), 1, 16)
    event = F.to_json(F.struct(F.make_valid_utf8("line").alias("message"), template.alias("template_id"), reason.alias("reason")))
    return {
        "event_id": F.concat("raw_id", F.lit(":0")), "raw_ref": F.col("raw_ref"), "raw_sha256": F.col("raw_sha256"), "time": F.timestamp_millis("recv_ms"), "recv_time": F.timestamp_millis("recv_ms"),
        "class_uid": F.lit(0), "status": F.lit("unparsed"), "source_id": F.lit("unparsed"), "coverage": F.lit(0.0), "unmapped": F.lit("{}"), "event": event,
    }


def normalize(raw: DataFrame, sources: list[Source]) -> DataFrame:
    """Lake rows for every line of an :func:`envelope`, as many rows as lines, in one pass over them.

    Control lines, where ``raw`` has a column ``control``, are unparsed rows with that reason.
    """
    found = detect(raw, sources)
    found, known = map_events(found, sources)
    rest = unparsed_columns(F.when(F.col("control"), "control_line").otherwise("no_pack") if "control" in raw.columns else "no_pack")
    made = [F.when(F.col("kind").isNull(), rest[f.name].cast(f.dataType) if f.name in rest else F.lit(None).cast(f.dataType)).otherwise(known[f.name].cast(f.dataType)).alias(f.name) for f in GOLD.fields]
    return found.select(*made)
