"""Raw HTML pages to ordered text lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: elements that break lines, elements whose text is dropped
BREAKS = frozenset("article br dd div dt h1 h2 h3 h4 h5 li main p section td th title tr ul".split())
DROPPED = frozenset(("script", "style", "noscript"))


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in DROPPED
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED and self.hidden:
            self.hidden -= 1
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(" ".join(data.split("\n")))


def html_lines(html: str | None) -> list[str]:
    reader = _Lines()
    reader.feed(html or "")
    reader.close()
    return [t for line in "".join(reader.parts).split("\n") if (t := " ".join(line.split()))]


def pages_to_lines(pages: DataFrame) -> DataFrame:
    """(page_id, pos, line) of every page; null and empty pages have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, out = [], [], []
            for i, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                lines = html_lines(html)
                ids += [i] * len(lines)
                pos += range(1, len(lines) + 1)
                out += lines
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(out, pa.string())], ["page_id", "pos", "line"])

    return pages.selectExpr("cast(page_id AS BIGINT) AS page_id", "html").mapInArrow(run, "page_id long, pos int, line string")
