"""Operator 10: main text of web pages by the consensus of each host.

A page is read as a stream of tags into blocks of text, each with the path of its containers.
Every container is scored by the text it holds outside links, and each page votes for the path of
its best container, generalised to tags and classes without digits. Spark sums the votes per host;
a second pass extracts from every page the container that its host agreed on. A page without that
path falls back on its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left
out wherever they stand. Character references are decoded, white space inside a block becomes one
space, and blocks are joined by an empty line. Unclosed and misnested tags are accepted.

Defined cases: a null or empty html gives an empty text; pages without a url or host vote together;
text outside any container counts as in the page's root; very long pages are read whole; equal
votes are decided by the summed score, then by the path; repeated rows are separate rows; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches, staged, table

# Kinds of elements, and class or id words of what is not main text.
CONTAINERS = frozenset("html body main article section div td th tr table tbody thead tfoot ul ol dl figure blockquote nav header footer aside form fieldset details dialog center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary address hr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select button title canvas audio video".split())
NOISE_TAGS = frozenset("nav header footer aside form fieldset dialog menu".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay subscribe subscription newsletter signup login paywall nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside widget widgets related recommended share sharing social footer header masthead topbar toolbar comment comments disqus reply "
    "replies respond pagination pager copyright legal skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
VOID = frozenset("br img input meta link hr area base col embed source track wbr param".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|svg|math|textarea|select|button|title|canvas|audio|video)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*?>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
ROOT = "root"


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[int, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


class Page:
    """Blocks of a page, and the generalised path of each container that is not noise."""

    def __init__(self, source: str) -> None:
        self.paths = [ROOT]  # of container i
        self.noisy = [False]
        self.blocks: list[Block] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [(ROOT, 0)]
        parts: list[str] = []
        linked, in_link, at = 0, 0, 0

        def text(upto: int) -> None:
            nonlocal linked
            if at < upto and not self.noisy[stack[-1][1]]:
                piece = references.unescape(source[at:upto])
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())

        def end_block() -> None:
            nonlocal linked
            if parts:
                whole = " ".join("".join(parts).split())
                if whole:
                    self.blocks.append(Block(tuple(i for _, i in stack), whole, min(linked, len(whole))))
                parts.clear()
            linked = 0

        for m in TOKEN.finditer(source):
            text(m.start())
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag == "a":
                in_link = 0 if m["close"] else 1
            elif tag == "br":
                parts.append("\n")
            elif tag in CONTAINERS:
                end_block()
                in_link = 0
                if not m["close"]:
                    self._open(stack, tag, m["attrs"] or "")
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
            elif tag in BLOCKS:
                end_block()
        text(len(source))
        end_block()

    def _open(self, stack: list[tuple[str, int]], tag: str, attrs: str) -> None:
        above = stack[-1][1]
        name, noisy = tag, tag in NOISE_TAGS
        if attrs:
            for key, *values in ATTRIBUTE.findall(attrs):
                value = next((v for v in values if v), "").lower()
                if key.lower() in ("class", "id"):
                    noisy |= tag not in ("html", "body", "article", "main") and not NOISE_WORDS.isdisjoint(WORD.findall(value))
                    if key.lower() == "class":
                        name += "".join(f".{c}" for c in sorted(set(DIGITS.sub("#", value).split())))
                elif key.lower() == "role":
                    noisy |= value in NOISE_ROLES
                else:
                    noisy |= key.lower() == "hidden" or value == "true"
        self.paths.append(f"{self.paths[above]}>{name}")
        self.noisy.append(noisy or self.noisy[above])
        stack.append((tag, len(self.paths) - 1))

    def best(self) -> tuple[str, float]:
        """The path of the best container and its score: text outside links, held directly or, for
        a third less per level, further inside."""
        scores: dict[str, float] = {}
        for b in self.blocks:
            worth = len(b.text) - 1.5 * b.linked
            depth = {"article": 1.5, "main": 1.2}
            for up, i in enumerate(reversed(b.path)):
                path = self.paths[i]
                tag = path.rsplit(">", 1)[-1].split(".")[0]
                scores[path] = scores.get(path, 0.0) + worth * depth.get(tag, 1.0) / 1.5**up
        if not scores:
            return "", 0.0
        return min(scores.items(), key=lambda s: (-s[1], s[0]))

    def extract(self, path: str) -> str | None:
        """The blocks inside containers of ``path``; None where the page has no such container with text."""
        found = [b.text for b in self.blocks if any(self.paths[i] == path for i in b.path)]
        return "\n\n".join(found) if found else None


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes and summed score."""
    small_batches(pages.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        best = [Page(h or "").best() for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], names=["host", "path", "score"]
        )

    cast = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(lambda b: map_batches(b, work), "host string, path string, score double")
    return cast.filter("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))


def agreed(pages: DataFrame) -> DataFrame:
    """One path per host: most votes, then the highest score, then the first path."""
    ranked = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))
    return votes(pages).withColumn("rank", ranked).filter("rank = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, of every page."""
    chosen = staged(agreed(pages), "host-paths").select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    rows = pages.select("page_id", "url", "html").join(chosen, host(F.col("url")) == F.col("_host"), "left").drop("_host")
    schema = rows.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long"), "path": F.lit("")}).schema

    def one(source: str | None, path: str | None) -> tuple[str, str]:
        page = Page(source or "")
        found = page.extract(path) if path else None
        if found is None:
            path = page.best()[0]
            found = page.extract(path) if path else ""
        return found or "", path or ""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("_path").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()),
            pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string()),
        ], names=["page_id", "url", "text", "n_chars", "path"])

    return rows.mapInArrow(lambda b: map_batches(b, work), schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
