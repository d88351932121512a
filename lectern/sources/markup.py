"""Books in zip archives: container, manifest, spine, overlays, sentence spans, titles.

Scans take a table of texts (book, href, body) and return rows; regular parts are regular expressions in the JVM, the
nesting of spans and the zip format are read in Python, a file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.paths import basename, collapse_path
from lectern.functions.times import markup_clock_s


def archive_members(spark: SparkSession, path: str, names: str = r".*\.(opf|smil|x?html|ncx|xml)$") -> DataFrame:
    """(book, href, body) of the members whose names match, of all archives at a path. A broken archive has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        wanted = re.compile(names, re.IGNORECASE)
        for b in batches:
            for book, data in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_buffer())) as z:
                        for n in z.namelist():
                            if wanted.match(n):
                                yield pa.RecordBatch.from_pydict({"book": [book], "href": [n], "body": [z.read(n).decode("utf-8", "replace")]})
                except (zipfile.BadZipFile, OSError):
                    continue

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "book string, href string, body string")


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, NULL if it has none."""
    v = F.regexp_extract(tag, rf"""(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1)
    return F.when(tag.rlike(rf"""(?:^|\s){name}\s*=\s*["']"""), v)


def tags(c: Column, name: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{name}\b[^>]*>"), F.lit(0))


def package_path(members: DataFrame) -> DataFrame:
    """(book, opf): full-path in the container, else any href that ends in .opf."""
    c = members.where(F.col("href").endswith("container.xml"))
    full = F.regexp_extract("body", r'full-path="([^"]+)"', 1)
    any_href = F.regexp_extract("body", r'href="([^"]+\.opf)"', 1)
    return c.select("book", F.when(full != "", full).when(any_href != "", any_href).alias("opf")).where("opf IS NOT NULL")


def manifest(opf: DataFrame) -> DataFrame:
    """(book, id, href, media_type, media_overlay) of self-closing items with id and href; the last of equal ids."""
    t = opf.select("book", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<item\s[^>]*/>"), F.lit(0))).alias("seq", "tag"))
    rows = t.select("book", "seq", attribute(F.col("tag"), "id").alias("id"), attribute(F.col("tag"), "href").alias("href"), attribute(F.col("tag"), "media-type").alias("media_type"), attribute(F.col("tag"), "media-overlay").alias("media_overlay"))
    rows = rows.where("id IS NOT NULL AND href IS NOT NULL")
    return rows.groupBy("book", "id").agg(F.max_by(F.struct("href", "media_type", "media_overlay"), "seq").alias("r")).select("book", "id", "r.*")


def overlays(items: DataFrame) -> DataFrame:
    """(book, doc_href, overlay_href): items joined with the items that are their overlays."""
    o = items.select("book", F.col("id").alias("media_overlay"), F.col("href").alias("overlay_href"))
    return items.where("media_overlay IS NOT NULL").join(o, ["book", "media_overlay"]).select("book", F.col("href").alias("doc_href"), "overlay_href")


def spine(opf: DataFrame, items: DataFrame) -> DataFrame:
    """(book, pos, href) in reading order, by base name."""
    t = opf.select("book", F.posexplode(tags(F.col("body"), "itemref")).alias("pos", "tag")).select("book", (F.col("pos") + 1).alias("pos"), attribute(F.col("tag"), "idref").alias("id"))
    return t.join(items.select("book", "id", "href"), ["book", "id"]).select("book", "pos", basename(F.col("href")).alias("href"))


def overlay_entries(smil: DataFrame) -> DataFrame:
    """(book, smil, seq, text_ref, text_doc, fragment_id, audio_src, start_time, end_time) of the pars with audio.

    smil: book, href, body. References resolve against the overlay's folder; a missing clip is 0."""
    p = smil.select("book", F.col("href").alias("smil"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<par\b[^>]*>(.*?)</par>"), F.lit(1))).alias("seq", "par"))
    audio, text = F.get(tags(F.col("par"), "audio"), F.lit(0)), F.get(tags(F.col("par"), "text"), F.lit(0))
    ref = F.coalesce(attribute(text, "src"), attribute(F.col("par"), "src"))
    folder = F.regexp_extract("smil", r"^(.*/)", 1)
    rows = p.withColumns({"audio": audio, "text_ref": ref}).withColumn("src", attribute(F.col("audio"), "src")).where("audio IS NOT NULL AND src IS NOT NULL")
    doc = F.when(F.instr("text_ref", "#") > 0, F.substring_index("text_ref", "#", 1)).otherwise(F.col("text_ref"))
    return rows.select(
        "book", "smil", "seq", "text_ref",
        collapse_path(F.concat(folder, doc)).alias("text_doc"),
        F.when(F.instr("text_ref", "#") > 0, F.substring_index("text_ref", "#", -1)).alias("fragment_id"),
        collapse_path(F.concat(folder, F.col("src"))).alias("audio_src"),
        markup_clock_s(attribute(F.col("audio"), "clipBegin")).alias("start_time"),
        markup_clock_s(attribute(F.col("audio"), "clipEnd")).alias("end_time"),
    )


#: The entities that are decoded.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&#39;": "'", "&#160;": " "}
SPAN = re.compile(r"<(/?)span\b([^>]*)>", re.IGNORECASE | re.DOTALL)


def span_texts(body: str) -> dict[str, str]:
    """Text of each span with an id. A span's text holds that of the spans inside; the first of equal ids counts."""
    parts: dict[str, str] = {}
    open_: list[tuple[str | None, int]] = []
    for m in SPAN.finditer(body):
        if m[1]:
            if open_:
                name, at = open_.pop()
                if name and name not in parts:
                    raw = re.sub(r"<[^>]*>", "", body[at : m.start()])
                    for k, v in ENTITIES.items():
                        raw = raw.replace(k, v)
                    if text := " ".join(raw.split()):
                        parts[name] = text
        elif not m[2].rstrip().endswith("/"):
            found = re.search(r"""\bid\s*=\s*["']([^"']+)["']""", m[2])
            open_.append((found[1] if found else None, m.end()))
    return parts


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(book, href, fragment_id, text) of the spans of documents (book, href, body)."""

    def run(batches):
        for b in batches:
            rows = [(k, h, i, t) for k, h, body in zip(*(b.column(c).to_pylist() for c in ("book", "href", "body"))) for i, t in span_texts(body or "").items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["book", "href", "fragment_id", "text"])

    return docs.select("book", "href", "body").mapInArrow(run, "book string, href string, fragment_id string, text string")


def chapter_titles(ncx: DataFrame) -> DataFrame:
    """(book, base, title) of a navigation file; the first title of a document, fragments cut off."""
    points = F.regexp_extract_all("body", F.lit(r"(?s)<navPoint\b.*?<content\b[^>]*>"), F.lit(0))
    p = ncx.select("book", F.posexplode(points).alias("seq", "nav"))
    label = F.trim(F.regexp_extract("nav", r"(?s)<text>(.*?)</text>", 1))
    src = F.regexp_extract("nav", r'<content\b[^>]*src="([^"#]*)', 1)
    rows = p.select("book", "seq", basename(src).alias("base"), label.alias("title")).where("base <> '' AND title <> ''")
    return rows.groupBy("book", "base").agg(F.min_by("title", "seq").alias("title"))


def timing(entries: DataFrame, spans: DataFrame, ordered: DataFrame) -> DataFrame:
    """Overlay entries in narrative order with their texts; where a fragment has none its reference stands in."""
    from pyspark.sql import Window as W

    s = spans.select("book", F.col("href").alias("text_doc"), "fragment_id", F.col("text").alias("span_text"))
    j = entries.join(s, ["book", "text_doc", "fragment_id"], "left").join(ordered.select("book", F.col("overlay_href").alias("smil"), F.col("seq").alias("smil_pos")), ["book", "smil"], "left")
    over = W.partitionBy("book").orderBy(F.col("smil_pos").asc_nulls_last(), "smil", "seq")
    return j.withColumn("text", F.coalesce("span_text", "text_ref")).withColumn("seq", F.row_number().over(over)).drop("span_text", "smil_pos")


