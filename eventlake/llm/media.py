"""Operator 1, media columns: interleaved document sequences.

HTML becomes an ordered array of parts, each a text or a reference to a medium by digest with its caption. Media live in a
table of their own, keyed by the SHA-256 of the payload, and are resolved by a join on that digest; parts keep their
positions throughout. Payloads are stored as WAV files of unsigned 8-bit samples, which any audio library reads.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, id_key, table
from .extraction import _ATTRIBUTE, pieces

#: Bytes that a payload is a multiple of, and the sample rate written in the files.
FRAME, RATE = 192, 8000

_PART = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
_PART_DDL = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_MEDIA = frozenset(["img", "audio", "video", "source"])
_SKIP = frozenset(["template", "noscript"])
#: Elements whose end also ends the figures, captions and skipped elements left open inside them.
_HOLDERS = frozenset("html body main article section aside header footer nav div blockquote form fieldset ul ol li dl dt dd table tr td th figure figcaption template noscript".split())
_CODE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}


def _attributes(said: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of one that is repeated, the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(said):
        if m[1]:
            found.setdefault(m[1].lower(), unescape(next(v for v in (m[2], m[3], m[4]) if v is not None)))
    return found


class _Sequence:
    """Collects parts in page order. A caption belongs to the media of its own figure; alt text stands in where there is none."""

    def __init__(self):
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.holders: list[str] = []
        self.open: Counter[str] = Counter()
        #: Open figures, each with its media's positions and its caption; and texts of the captions that are open.
        self.figures: list[dict] = []
        self.captions: list[list[str]] = []

    def add(self, kind: str, text: str | None, digest: str | None = None, caption: str | None = None) -> None:
        self.parts.append({"position": len(self.parts), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def flush(self) -> None:
        if self.captions:
            self.captions[-1].append(" ")
        elif said := " ".join("".join(self.text).split()):
            self.add("text", said)
        if not self.captions:
            self.text = []

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        if tag in _HOLDERS:
            self.holders.append(tag)
            self.open[tag] += 1
            if tag == "figure":
                self.figures.append({"media": [], "caption": None})
            elif tag == "figcaption" and self.figures:
                self.captions.append([])
            elif tag == "figcaption":
                self.holders[-1] = "caption"  # of no figure: a block like others
                self.open["caption"] += 1
                self.open[tag] -= 1
        elif tag in _MEDIA and not self.skips and (src := (said := _attributes(attributes)).get("src")):
            if not self.captions:
                self.flush()
            if self.figures:
                self.figures[-1]["media"].append(len(self.parts))
            self.add({"img": "image"}.get(tag, tag), None, src.removeprefix("media:"), said.get("alt"))

    def end(self, tag: str) -> None:
        if tag == "figcaption" and not self.open[tag]:
            tag = "caption"
        if tag in _BLOCKS:
            self.flush()
        if self.open[tag]:
            while self.close() != tag:
                pass

    def close(self) -> str:
        """Ends the innermost open element."""
        tag = self.holders.pop()
        self.open[tag] -= 1
        if tag == "figcaption":
            said = " ".join("".join(self.captions.pop()).split())
            if self.figures[-1]["caption"] is None:
                self.figures[-1]["caption"] = said
        elif tag == "figure":
            self.flush()
            figure = self.figures.pop()
            if figure["caption"] is not None:
                for at in figure["media"]:
                    self.parts[at]["caption"] = figure["caption"]
        return tag

    @property
    def skips(self) -> int:
        return self.open["template"] + self.open["noscript"]

    def say(self, text: str) -> None:
        if not self.skips:
            (self.captions[-1] if self.captions else self.text).append(unescape(text))


def parse_parts(html: str | None) -> list[dict]:
    """The ordered parts of one page, in time linear in it.

    Broken markup: an element that is left open ends with the element around it, at the latest with the page, so an open
    caption or ``template`` takes no more text than that. Scripts and styles without end hide the rest of the page, and a
    tag without ``>`` ends it, as in browsers. A figure's first caption is that of all its media, but of none of a figure
    inside it. A caption outside figures is text. Null html has no parts.
    """
    found = _Sequence()
    for said, closing, attributes in pieces(html or "", _CODE):
        if closing is None:
            found.say(said)
        elif closing:
            found.end(said)
        else:
            found.start(said, attributes)
    while found.holders:
        found.close()
    found.flush()
    return found.parts


def interleave(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` columns and parts: every page as an ordered array of text and media-reference structs.

    Null html has no parts. Text outside captions becomes text parts, one for each run between blocks or media. Repeated rows
    are repeated, an empty table gives no rows, and columns not in ``keep`` are not read. See :func:`parse_parts`.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            parts = pa.array([parse_parts(x) for x in batch.column(len(keep)).to_pylist()], pa.list_(_PART))
            yield pa.record_batch([*batch.columns[: len(keep)], parts], [*keep, "parts"])

    return pages.select(*keep, html).mapInArrow(run, f"{kinds}, parts array<{_PART_DDL}>")


def exploded(sequences: DataFrame) -> DataFrame:
    """One row for each part of ``sequences``, with its other columns."""
    keep = [c for c in sequences.columns if c != "parts"]
    return sequences.select(*keep, F.explode("parts").alias("part")).select(*keep, "part.*")


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """``parts``, media parts with the columns of ``media`` (digest and others), or nulls where no such medium is stored.

    Parts without digest, and all parts if ``media`` is empty, get nulls; repeated parts are each resolved.

    ``media`` holds a digest once. It is dealt as a shuffle of its own, so that Spark can split a digest that very many
    parts name, or broadcast the media if they prove small.
    """
    return parts.join(media.hint("rebalance"), "digest", "left")


def payloads_of(parts: DataFrame, media: DataFrame) -> DataFrame:
    """(digest, stored) of the media that ``parts`` name, each once: the join that resolves payloads.

    Both sides hold a digest once here, so however many parts name a medium, its payload moves to one row and no further.
    """
    named = parts.select("digest").filter("digest IS NOT NULL").distinct()
    return named.join(media, "digest")


def padded(text: Column, frame: int = FRAME) -> Column:
    """The text with spaces up to a positive multiple of ``frame`` bytes."""
    size = F.octet_length(text)
    lack = F.when(size == 0, F.lit(frame)).otherwise(F.pmod(-size, F.lit(frame)))
    return F.concat(text, F.repeat(F.lit(" "), lack))


def wav(payload: bytes) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are ``payload`` (of even length)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(stored: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"fmt " and stored[at + 22 : at + 24] != b"\x08\x00":
            raise ValueError("samples are not of 8 bits")
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _store(batches):
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([wav(x) for x in batch.column(1).to_pylist()], pa.binary())], ["digest", "stored"])


def store(payloads: DataFrame) -> DataFrame:
    """The media table of (digest, payload) rows: (digest, stored), the payload as a media file, each digest once.

    Copies fall together where they lie, before payloads are shuffled.
    """
    return payloads.select("digest", "payload").mapInArrow(_store, "digest string, stored binary").dropDuplicates(["digest"])


def feature(data: bytes) -> str:
    """Loudness, level and zero crossings of the samples: equal samples, equal strings."""
    x = np.frombuffer(data, np.uint8).astype(np.float32) - 128
    crossed = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={float(np.sqrt(np.mean(x * x, dtype=np.float64))):.4f};mean={float(np.mean(x, dtype=np.float64)):.4f};crossings={crossed};peak={int(np.abs(x).max(initial=0))}"


def _read_back(batches):
    for batch in batches:
        rows = []
        for stored in batch.column(1).to_pylist():
            data = samples(stored)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(media: DataFrame) -> DataFrame:
    """Features of each stored medium, from the samples read back."""
    kind = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_read_back, kind)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of a heading and a figure, whose medium is the document's padded text.

    Pages are parsed into sequences, the media that they name are resolved by digest, read back and described, and the
    descriptions come back to the parts. Null text: the empty text. Null doc_id: stays null. Equal texts share one medium.
    Repeated rows are repeated in the result. Extra columns are not read. An empty table gives no rows. Very long texts:
    whole, but a payload has to fit in a task some 6 times.
    """
    docs = table(spark, sf_dir, "documents").select(id_key().alias("__d"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("__d", F.octet_length("text").cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    docs = docs.withColumn("digest", F.sha2("payload", 256))
    media = store(docs.select("digest", F.col("payload").cast("binary").alias("payload")))
    name = F.concat(F.lit("document "), F.col("__d").cast("string"))
    html = F.concat(F.lit("<h1>"), name, F.lit('</h1><figure><audio src="media:'), "digest", F.lit('"></audio><figcaption>'), name, F.lit("</figcaption></figure>"))
    parts = exploded(interleave(docs.select("__d", "n_bytes", html.alias("html")), ["__d", "n_bytes"])).filter("kind = 'audio'")
    found = resolve(parts, read_back(payloads_of(parts, media)))
    return found.select(id_back("__d").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
