"""Readers of marked-up books and pages: one row a file, faults as a column."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

CHAPTER_BREAK = f"\n\n{X.CHAPTER}\n\n"
SILENT = ("script", "style", "nav", "header", "footer")
BREAKS = ("p", "br", "div", "h1", "h2", "h3")


class _Page(HTMLParser):
    """Text of a page: nothing inside silent tags, however deep, and a new line at breaks."""

    def __init__(self, silent: tuple[str, ...], breaks: tuple[str, ...], between: str = ""):
        super().__init__(convert_charrefs=True)
        self.silent, self.breaks, self.between = silent, breaks, between
        self.depth, self.out = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.silent
        if tag in self.breaks:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            self.depth = max(0, self.depth - 1)
        if tag == "p" and "p" in self.breaks:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data + self.between)


def page_text(html: str, silent: tuple[str, ...] = SILENT, breaks: tuple[str, ...] = BREAKS, between: str = "") -> str:
    page = _Page(silent, breaks, between)
    page.feed(html)
    page.close()
    return "".join(page.out)


def html_text(html: Column) -> Column:
    """The same by built-in functions, for pages whose silent blocks don't nest: blocks, then tags, then entities."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in SILENT:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, r"(?i)<(?:p|br|div|h1|h2|h3)\b[^>]*>|</p\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)</?[A-Za-z!][^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


# --- FictionBook ---


class Book:
    """A FictionBook document as text. Tags are taken without their namespace."""

    INLINE = ("emphasis", "strong", "strikethrough", "sub", "sup", "code")

    def __init__(self, content: bytes, keep_nested: bool = True):
        self.root = ElementTree.fromstring(content)
        self.keep_nested = keep_nested

    @staticmethod
    def name(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2]

    def children(self, e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
        return [c for c in e if self.name(c) in names]

    def inline(self, e: ElementTree.Element) -> str:
        """Running text. Links lose theirs; inline marks keep what stands in them directly, or all of it."""
        out = [e.text or ""]
        for c in e:
            kind = self.name(c)
            if kind in self.INLINE and not self.keep_nested:
                out.append(c.text or "")
            elif kind != "a":
                out.append(self.inline(c))
            out.append(c.tail or "")
        return "".join(out)

    def lines(self, e: ElementTree.Element) -> list[str]:
        """Lines of a quotation or motto: paragraphs, authors, poems."""
        out = []
        for c in e:
            kind = self.name(c)
            if kind == "poem":
                out.append(self.poem(c))
            elif kind in ("p", "text-author") and (t := self.inline(c).strip()):
                out.append(f"— {t}" if kind == "text-author" else t)
        return out

    def poem(self, e: ElementTree.Element) -> str:
        out = []
        for c in e:
            kind = self.name(c)
            if kind == "title":
                out += [t for p in self.children(c, "p") if (t := self.inline(p).strip())]
            elif kind == "stanza":
                out += [*(self.inline(v).strip() for v in self.children(c, "v")), ""]
            elif kind == "text-author" and (t := self.inline(c).strip()):
                out.append(f"— {t}")
        return "\n".join(out)

    def block(self, e: ElementTree.Element) -> str:
        kind = self.name(e)
        if kind in ("title", "epigraph"):
            found = [t for p in self.children(e, "p") if (t := self.inline(p).strip())] if kind == "title" else self.lines(e)
            return "\n".join(found) + "\n" if found else ""
        if kind == "poem":
            return self.poem(e) + "\n"
        if kind == "cite":
            found = self.lines(e)
            return "\n".join(found) + "\n\n" if found else ""
        if kind in ("p", "subtitle"):
            t = self.inline(e).strip()
            return "" if not t else f"{t}\n\n" if kind == "p" else f"\n{t}\n\n"
        if kind == "empty-line":
            return "\n"
        return "" if kind in ("table", "image") else "".join(self.block(c) for c in e)

    def text(self) -> str:
        bodies = []
        for body in self.root.iter():
            if self.name(body) == "body" and body.get("name") != "notes":
                parts, seen = [], False
                for c in self.children(body, "section", "title", "epigraph"):
                    if self.name(c) == "section":
                        if seen:
                            parts.append(CHAPTER_BREAK)
                        seen = True
                    parts.append(self.block(c))
                bodies.append("".join(parts))
        return re.sub(r"\n{4,}", "\n\n\n", "\n\n".join(bodies)).strip()

    def about(self, stem: str) -> dict[str, str]:
        info = next((e for e in self.root.iter() if self.name(e) == "title-info"), None)
        first = lambda *names: next((e for e in (info.iter() if info is not None else ()) if self.name(e) in names), None)
        words = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
        author = first("author")
        name = " ".join(filter(None, (words(c) for c in self.children(author, "first-name", "middle-name", "last-name")))) if author is not None else ""
        date = first("date")
        year = re.search(r"\d{4}", (date.get("value") or words(date)) if date is not None else "")
        led = re.match(r"(\d{4})\s", stem)
        return {"title": words(first("book-title")) or "untitled", "author": name or "unknown", "year": year[0] if year else led[1] if led else ""}


def epub_text(content: bytes, least_words: int = 20) -> str:
    """Documents of an EPUB in reading order, those of more than least_words words."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        order = []
        for opf in (n for n in names if n.endswith(".opf")):
            root = ElementTree.fromstring(z.read(opf))
            base = opf.rpartition("/")[0]
            items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item") and "html" in (e.get("media-type") or "")}
            spine = [e.get("idref") for e in root.iter() if e.tag.endswith("}itemref")]
            order = [f"{base}/{items[i]}".lstrip("/") for i in [*spine, *(i for i in items if i not in spine)] if i in items]
        texts = []
        for n in order or sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))):
            t = page_text(z.read(n).decode("utf-8", "replace"), ("script", "style", "aside"), (), "\n")
            t = "\n".join(line.rstrip() for line in re.sub(r"\n{3,}", "\n\n", t).split("\n")).strip()
            if len(t.split()) > least_words:
                texts.append(t)
    return "\n\n".join(texts)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def read_fb2(spark: SparkSession, folder: str, keep_nested: bool = True) -> DataFrame:
    """path, title, author, year, text, error; a file that can't be parsed or is blank has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    book = Book(bytes(content), keep_nested)
                    text = book.text()
                    about = book.about(re.sub(r"\.[^.]*$", "", path.rpartition("/")[2]))
                    rows.append((path, about["title"], about["author"], about["year"], text or None, None if text else "no text"))
                except ElementTree.ParseError as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "year", "text", "error"])

    return _files(spark, folder, "*.fb2").mapInPandas(run, "path string, title string, author string, year string, text string, error string")


def read_epub(spark: SparkSession, folder: str, least_words: int = 20) -> DataFrame:
    """path, text, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text = epub_text(bytes(content), least_words)
                    rows.append((path, text or None, None if text else "no text"))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return _files(spark, folder, "*.epub").mapInPandas(run, "path string, text string, error string")


#: Marks of a publisher's end matter.
END_MARKS = ["© Оформление", "ISBN ", "УДК ", "ББК ", "Обособленное подразделение", "Интернет-магазин", "Розничная продажа", "Все права защищены. Книга или любая ее часть", "Литературно-художественное издание", "Страна происхождения", "\nОглавление\n", "\nСодержание\n"]
EPUB_END_MARKS = ["© ", "ISBN", "Издательство", "Все права"]


def without_end_matter(text: Column, marks: list[str] = END_MARKS, share: float = 0.95) -> Column:
    """text up to the earliest mark past `share` of its length."""
    cut = F.floor(F.length(text) * share).cast("int") + 1
    places = F.filter(F.array(*(F.call_function("locate", F.lit(m), text, cut) for m in marks)), lambda p: p > 0)
    first = F.array_min(places)
    return F.when(first.isNotNull(), F.regexp_replace(F.substring(text, F.lit(1), first - 1), rf"{X.SPACE}+$", "")).otherwise(text)


def without_last_marks(text: Column, marks: list[str] = EPUB_END_MARKS, share: float = 0.95) -> Column:
    """Mark after mark, text up to the mark's last place if that lies past `share` of what is then left."""
    for m in marks:
        text = F.transform(F.array(text), lambda t, m=m: _cut_last(t, m, share))[0]
    return text


def _cut_last(t: Column, m: str, share: float) -> Column:
    back = F.instr(F.reverse(t), m[::-1])
    at = F.length(t) - back - len(m) + 1  # how many characters stand before it
    return F.when((back > 0) & (at > F.length(t) * share), F.regexp_replace(F.substring(t, F.lit(1), at), rf"{X.SPACE}+$", "")).otherwise(t)


def page_lines(text: Column, running: list[str] = ()) -> Column:
    """A printed page's text without running heads and page numbers."""
    for head in running:
        text = F.regexp_replace(text, rf"(?m)^\s*\Q{head}\E\s*$", "")
    text = F.regexp_replace(text, r"(?m)^\s*\d+\s*$", "")
    return X.trimmed(F.regexp_replace(text, r"(?m)[ \t\x0b\f\r ]+$", ""))


def pages_to_text(pages: DataFrame, doc: str = "doc", page: str = "page_no", text: str = "text", skip_pages: int = 0, running: list[str] = (), skip_until: str | None = None, marks: list[str] = END_MARKS) -> DataFrame:
    """doc, text of books given page by page. Page text extraction itself is pluggable and comes before."""
    clean = pages.where(F.col(page) >= skip_pages).select(doc, page, page_lines(F.col(text), running).alias("t")).where("t <> ''")
    whole = clean.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    if skip_until:
        at = F.instr("t", skip_until)
        whole = whole.withColumn("t", F.when(at > 0, F.substring(F.col("t"), at, F.lit(2**31 - 1))).otherwise(F.col("t")))
    t = F.regexp_replace(X.dehyphenated(F.col("t")), r"\n{3,}", "\n\n")
    return whole.select(doc, without_end_matter(t, marks).alias("text"))


def epub_name(stem: Column, series: str = "") -> Column:
    """A title from an EPUB's file name: no series and year, no bracketed notes, no final dot."""
    out = F.regexp_replace(stem, rf"{series}-\d{{4}}-", "") if series else stem
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\([^)]*\)\s*", ""), r"\.-новый перевод$", "")
    return X.trimmed(F.regexp_replace(out, r"\.$", ""))
