"""Interleaved documents: HTML becomes ordered text and media structs; a join on digests resolves the payloads."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of a stored picture.
WIDTH = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
_MEDIA = ("img", "video", "audio", "source")
_HIDDEN = ("script", "style", "template")
_BREAKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "ul", "ol", "table", "blockquote")


#: A tag from its name on, quotes counting only after an equals sign; and its attributes.
_TAG = re.compile(r"""([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
#: Elements whose content has no tags: it ends at their own end tag only.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}


def _marks(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """A page as ("data", text), ("start", tag, attributes) and ("end", tag), in one pass over it.

    What nothing closes, be it a comment, a declaration, a tag or raw content, lasts to the end of the page and is no
    text. So every search either finds its end or is the last, and broken pages take no longer than others.
    """
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "data", unescape(html[at:]), None
            return
        if lt > at:
            yield "data", unescape(html[at:lt]), None
        after = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
        elif after and after in "!?" or after == "/" and not html[lt + 2 : lt + 3].isalpha():
            end = html.find(">", lt)
            at = end + 1 if end >= 0 else n
        elif m := _TAG.match(html, lt + 1 + (after == "/")):
            tag, at = m[1].lower(), m.end()
            if after == "/":
                yield "end", tag, None
                continue
            attributes: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(m[2]) if tag in _MEDIA else ():
                attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
            yield "start", tag, attributes
            if raw := _RAW.get(tag):
                end = raw.search(html, at)
                said, at = html[at : end.start() if end else n], end.start() if end else n
                if tag in ("textarea", "title") and end:
                    yield "data", unescape(said), None
        elif after.isalpha() or after == "/":
            return  # a tag that nothing closes
        else:
            yield "data", "<", None
            at = lt + 1


class _Sequence:
    def __init__(self) -> None:
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0
        self.figure: int | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in _MEDIA and (src := attributes.get("src")):
            self.flush()
            digest = src.removeprefix("sha256:") if src.startswith("sha256:") else None
            self.items.append({"position": len(self.items), "kind": "media", "text": src, "digest": digest, "caption": attributes.get("alt") or None})

    def end(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure :]:  # those since the figure began or since its last caption
                if item["kind"] == "media":
                    item["caption"] = said or item["caption"]
            self.figure = len(self.items)
        elif tag in _BREAKS and self.caption is None:
            self.flush()
            if tag == "figure":
                self.figure = None

    def data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Text and media items of a page in reading order. Broken HTML is read as far as it goes; null has no items."""
    page = _Sequence()
    for kind, said, attributes in _marks(html or ""):
        if kind == "data":
            page.data(said)
        elif kind == "start":
            page.start(said, attributes or {})
        else:
            page.end(said)
    page.flush()
    return page.items


def sequences(df: DataFrame, html_col: str = "html", sequence_col: str = "sequence") -> DataFrame:
    """Adds each page's interleaved sequence: structs of position, kind, text (a media item's source), digest, caption.

    Null and empty pages have an empty sequence. Rows are independent; a column called as the new one is replaced.
    """
    kept = [c for c in df.columns if c != sequence_col]
    at = kept.index(html_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([parse(h) for h in b.column(at).to_pylist()], _SEQUENCE)], names=[*kept, sequence_col])

    return df.select(kept).mapInArrow(run, df.select(kept).withColumn(sequence_col, F.lit(None).cast(SEQUENCE)).schema)


def stored(payload: bytes) -> bytes:
    """A grey picture of 8-bit samples, WIDTH in a row; the payload's length is a positive multiple of WIDTH."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def read_back(media: bytes | None) -> bytes:
    kind, size, depth, samples = [*(media or b"").split(b"\n", 3), b"", b"", b"", b""][:4]
    width, height = map(int, size.split()) if re.fullmatch(rb"\d+ \d+", size) else (0, 0)
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("no such picture")
    return samples


def feature(samples: bytes) -> str:
    """Sixteen bins of the samples, their mean, and the mean change along a row."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    rows = a.reshape(-1, WIDTH).astype(np.int16)
    return ",".join(map(str, bins)) + f";{a.mean():.6f};{np.abs(np.diff(rows, axis=1)).mean():.6f}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def media_of_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page for each text that shows the text's payload as a picture, and the picture: doc_id, html, digest, media.

    Null and empty texts have a picture of one row of zeros; null ids and repeated rows stay as they are.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            raws = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            media = [stored(padded(r)) for r in raws]
            digests = [hashlib.sha256(m).hexdigest() for m in media]
            html = [f'<figure><img src="sha256:{d}"><figcaption>{len(r)} bytes</figcaption></figure>' for d, r in zip(digests, raws)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(html), pa.array(digests), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "html", "digest", "media"])

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, html string, digest string, media binary")


def described(store: DataFrame) -> DataFrame:
    """What each stored picture (digest, media), read back, holds. Bytes that aren't such a picture, null included, raise ValueError."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                samples = read_back(media)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def unique(store: DataFrame) -> DataFrame:
    """One row for each digest; copies go before the shuffle. A null digest resolves nothing and goes too."""
    return store.where("digest is not null").select("digest", "media").groupBy("digest").agg(F.first("media").alias("media"))


def resolve(seqs: DataFrame, store: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """A row for each media item, beside its document's columns: position, caption, digest, and what the store has of it.

    Items whose payload isn't stored keep nulls. `store` has one row for each digest, so no row is multiplied.
    """
    kept = [c for c in seqs.columns if c != sequence_col]
    items = seqs.select(*kept, F.explode(F.filter(sequence_col, lambda x: x["kind"] == "media")).alias("__item"))
    items = items.select(*kept, F.col("__item.position").alias("position"), F.col("__item.caption").alias("caption"), F.col("__item.digest").alias("digest"))
    return items.join(store, "digest", "left")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    made = media_of_texts(df, id_col, text_col)
    seqs = sequences(made.select("doc_id", "n_bytes", "html")).drop("html")
    store = described(unique(made))
    return resolve(seqs, store).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
