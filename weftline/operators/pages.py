"""From raw HTML pages to structured documents and chunks; parsing runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunker, html
from ..functions.text import content_hash, looks_english

PARSED = (
    "page_id long, page_url string, title string, url string, description string, canonical_url string, language string, headings array<string>, "
    "last_modified string, text string, markdown string, entities map<string,string>, links array<string>, n_tags int, has_frame boolean, body_text string"
)
CHUNK = (
    "chunk_id string, url string, title string, section string, content string, token_count int, source_file string, heading_path array<string>, document_hash string, "
    "content_type string, source_section string, parent_chunk_id string, split_index int, split_count int, raw_content string"
)
# Words of challenge pages.
CHALLENGES = ("captcha", "access denied", "verify you are human", "unusual traffic", "robot check", "forbidden", "cloudflare", "blocked")
ENGLISH = ("en", "en-us", "en-gb")
LEAST_HTML, LEAST_TEXT, LEAST_TAGS = 5000, 200, 20


def _parsed(page_id, url: str | None, source: str | None) -> dict:
    root = html.parse(source)
    body = root.find("body")
    out = {
        "page_id": page_id,
        "page_url": url,
        "entities": list(html.entities(root).items()),
        "links": html.links(root, url or ""),
        "n_tags": sum(1 for _ in root.walk()) - 1,
        "has_frame": all(root.find(t) is not None for t in ("html", "head", "body")),
        "body_text": body.text() if body is not None else "",
        **html.metadata(source or "", root, root),
    }
    content = html.main_content(root)  # from here on the tree is without boilerplate
    return out | {"headings": html.headings(content), "text": content.text(), "markdown": html.to_markdown(content)}


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("page_url", pa.string()), ("title", pa.string()), ("url", pa.string()), ("description", pa.string()), ("canonical_url", pa.string()),
        ("language", pa.string()), ("headings", pa.list_(pa.string())), ("last_modified", pa.string()), ("text", pa.string()), ("markdown", pa.string()),
        ("entities", pa.map_(pa.string(), pa.string())), ("links", pa.list_(pa.string())), ("n_tags", pa.int32()), ("has_frame", pa.bool_()), ("body_text", pa.string()),
    ]
)


def _parse(with_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = [_parsed(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                yield out.append_column("html", part.column(2)) if with_html else out

    return run


def parse_pages(pages: DataFrame, with_html: bool = False) -> DataFrame:
    """Metadata, main text, Markdown, entities and links of each page (page_id, url, html), and its html if asked for."""
    return pages.select("page_id", "url", "html").mapInArrow(_parse(with_html), PARSED + (", html string" if with_html else ""))


def documents(pages: DataFrame, least_text: int = html.LEAST_TEXT) -> DataFrame:
    """Pages with enough text as documents, with hash; empty ones go."""
    p = parse_pages(pages).where((F.length("text") >= least_text) & (F.trim("markdown") != ""))
    return p.withColumn("document_hash", content_hash(F.col("markdown")))


def reject_reason(least_html: int = LEAST_HTML):
    """Why a parsed page (with its html) isn't kept, in order, or null."""

    def has_challenge(column):
        out = F.lit(False)
        for c in CHALLENGES:
            out = out | F.contains(F.lower(column), F.lit(c))
        return out

    lang = F.regexp_replace(F.lower(F.trim("language")), "_", "-")
    return (
        F.when(F.length(F.trim("html")) < least_html, "content too small")
        .when(~F.col("has_frame"), "invalid structure")
        .when(F.col("n_tags") < LEAST_TAGS, "too few elements")
        .when((lang != "") & ~lang.isin(*ENGLISH), "language")
        .when(has_challenge(F.col("html")), "challenge page")
        .when(F.length("body_text") < LEAST_TEXT, "text too small")
        .when(has_challenge(F.col("body_text")), "challenge page")
        .when((lang == "") & ~looks_english(F.col("body_text")), "language")
    )


def _chunk(settings: dict):
    names = [f.split(" ")[0] for f in CHUNK.split(", ")]
    types = {"token_count": pa.int32(), "split_index": pa.int32(), "split_count": pa.int32(), "heading_path": pa.list_(pa.string())}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for lo in range(0, batch.num_rows, 200):
                for markdown, h, title, url, source in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    rows += chunker.chunk(markdown, h or "", title=title or "", url=url or "", source_file=source or "", **settings)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def chunk_documents(docs: DataFrame, **settings: int) -> DataFrame:
    """Chunks of documents (markdown, document_hash, title, url, source_file)."""
    return docs.select("markdown", "document_hash", "title", "url", "source_file").mapInArrow(_chunk(settings), CHUNK)
