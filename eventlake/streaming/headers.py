"""Header lines of tab-separated logs: which fields, separator and marks hold for the lines after them in their source.

``#separator``, ``#fields``, ``#unset_field`` and ``#empty_field`` change the state of their source; every line that starts
with ``#`` is a control line. Lines get ``header`` (fields, unset, empty, sep) as it holds for them and ``control``; both
forms keep all lines, so that control lines become unparsed events like others that no source takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rows import carried

#: Marks that hold until a header says otherwise.
UNSET, EMPTY, SEP = "-", "(empty)", "\t"
#: Stands for lines without source.
NO_SOURCE = "unknown"
_HEADER = "header struct<fields:array<string>,unset:string,empty:string,sep:string>, control boolean"


def header_struct(fields: Column, unset: Column, empty: Column, sep: Column) -> Column:
    return F.struct(fields.alias("fields"), F.coalesce(unset, F.lit(UNSET)).alias("unset"), F.coalesce(empty, F.lit(EMPTY)).alias("empty"), F.coalesce(sep, F.lit(SEP)).alias("sep"))


def with_header(lines: DataFrame, source: str, order: str, line: str = "line") -> DataFrame:
    """``lines`` with ``header`` and ``control``. ``order`` tells which line of a source comes first; lines of a null source are one.

    A null line is no control line. The header's fields are null before the first ``#fields`` of a source. Sources of any
    size are carried over ranges, so a hot one is not one task (see :func:`.rows.carried`).
    """
    text = F.col(line)
    code = F.regexp_extract(text, r"^#separator +\\x([0-9A-Fa-f]{2})\s*$", 1)
    said = F.when(code != "", F.char(F.conv(code, 16, 10).try_cast("int")))
    named = lines.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)))
    known = carried(named, ["__source"], [order], {"__sep": said})
    sep = F.coalesce("__sep", F.lit(SEP))
    first = F.call_function("substring_index", text, sep, F.lit(1))
    rest = F.substring(text, F.length(first) + F.length(sep) + 1, F.length(text))
    cells = F.split(rest, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1)
    values = {"__fields": F.when(first == "#fields", cells), "__unset": F.when(first == "#unset_field", rest), "__empty": F.when(first == "#empty_field", rest)}
    made = carried(known, ["__source"], [order], values)
    out = made.withColumns({"header": header_struct(*[F.col(f"__{c}") for c in ("fields", "unset", "empty", "sep")]), "control": F.coalesce(text.startswith("#"), F.lit(False))})
    return out.select(*lines.columns, "header", "control")


@dataclass
class Header:
    """What the control lines of one source have said so far."""

    fields: list[str] | None = None
    unset: str = UNSET
    empty: str = EMPTY
    sep: str = SEP

    def read(self, line: str) -> None:
        if line.startswith("#separator"):
            code = line[len("#separator") :].strip()
            if line[len("#separator") :][:1] == " " and len(code) == 4 and code.startswith("\\x"):
                try:
                    self.sep = chr(int(code[2:], 16))
                except ValueError:
                    pass
            return
        first, _, rest = line.partition(self.sep)
        if first == "#fields":
            self.fields = rest.split(self.sep)
        elif first == "#unset_field":
            self.unset = rest
        elif first == "#empty_field":
            self.empty = rest


class _Headers(StatefulProcessor):
    """State of one bucket of sources: the header of each, at most ``most``; the one that came first goes first."""

    def __init__(self, columns: list[str], line: str, order: str, most: int):
        self.columns, self.line, self.order, self.most = columns, line, order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = "fields array<string>, unset string, empty string, sep string, number long"
        self.known = handle.getMapState("headers", "source string", kind)
        self.last = handle.getValueState("last", "number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows), ignore_index=True)
        held.columns = [*self.columns, "__source", "__bucket"]  # Spark renames those with underscores on the way
        held = held.sort_values(["__source", self.order], kind="stable", ignore_index=True)
        text = held[self.line].fillna("")
        control = text.str.startswith("#")
        header: list = [None] * len(held)
        for source, places in held.groupby("__source", sort=False).indices.items():
            was = self.known.getValue((source,)) if self.known.containsKey((source,)) else None
            now, number = (Header(list(was[0]) if was[0] is not None else None, *was[1:4]), was[4]) if was else (Header(), None)
            for i in places:
                if control[i]:
                    now.read(text[i])
                    header[i] = tuple(astuple(now))
                else:
                    header[i] = header[i - 1] if i > places[0] and not control[i - 1] else tuple(astuple(now))
            if control.iloc[places].any():
                if number is None:
                    number = self._room()
                self.known.updateValue((source,), (*astuple(now), number))
        out = held[self.columns].copy()
        for k, name in enumerate(("__fields", "__unset", "__empty", "__sep")):
            out[name] = [h[k] for h in header]
        out["control"] = control
        yield out

    def _room(self) -> int:
        """The number of a new source; the source with the lowest one is forgotten if there is no room."""
        number = (self.last.get()[0] if self.last.exists() else 0) + 1
        self.last.update((number,))
        held = [(value[4], key[0]) for key, value in self.known.iterator()]
        for _, source in sorted(held)[: max(0, len(held) - self.most + 1)]:
            self.known.removeKey((source,))
        return number

    def close(self) -> None:
        pass


def stream_with_header(lines: DataFrame, source: str, order: str, line: str = "line", most: int = 1024, buckets: int = 16) -> DataFrame:
    """:func:`with_header` for a stream: headers are kept between batches, for some ``most`` sources.

    Sources are dealt to ``buckets`` keys of state by a hash, each with room for its share of ``most`` sources that have sent a
    header. Beyond that the source whose first header is oldest is forgotten: its lines have no header until its next one.
    Lines of a batch are taken by ``order``; those of a batch that belong to one bucket are one task. Needs RocksDB as the
    provider of the state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    named = lines.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)))
    named = named.withColumn("__bucket", F.pmod(F.crc32("__source"), F.lit(buckets)).cast("int"))
    kept = T.StructType([*lines.schema.fields])
    out = T.StructType([*kept.fields, T.StructField("__fields", T.ArrayType(T.StringType())), *[T.StructField(n, T.StringType()) for n in ("__unset", "__empty", "__sep")], T.StructField("control", T.BooleanType())])
    processor = _Headers(lines.columns, line, order, max(1, most // buckets))
    made = named.groupBy("__bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None")
    return made.select(*lines.columns, header_struct(*[F.col(f"__{c}") for c in ("fields", "unset", "empty", "sep")]).alias("header"), "control")
