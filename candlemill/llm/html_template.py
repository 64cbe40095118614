"""Main text of web pages by template deduction over equivalence classes of tokens.

A page's tokens are its element starts, told apart by the path of elements around them. Over the pages of a host every
token has an occurrence vector, how often each page has it; tokens with equal vectors form an equivalence class (found
by an order-free fingerprint, so that a host's pages are only ever added up). A class is valid when its tokens nest under
its first one. Valid classes, nested by their paths, are the host's template. Between its tokens lie slots. Slots of
navigation, forms, adverts and the like are left out by name; of the others the template's content class is the deepest
one that comes once a page and holds nearly all text that varies from page to page, an article element before all. A page's main text is what
its slots inside the content class hold, less slots outside any article whose text is the same on every page of the host.

A host's template comes from all its pages. A page without its host's content class is read by its own article or main
element, or else by its whole body. Null and empty pages give an empty text; broken, cut off or deeply nested markup is
read as far as it goes; repeated rows are extracted one by one. Pages may have any length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.scratch import Scratch
from candlemill.llm.url_filter import host_and_path

# Elements by how they are read, and names that tell what is no content.
RAW = {"script", "style", "noscript", "template", "textarea", "xmp", "iframe", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
NO_CONTENT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "math", "canvas", "object", "audio", "video", "dialog", "menu"} | RAW
NO_CONTENT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget",
}
NO_CONTENT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
CLOSES_PARAGRAPH = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "figure", "fieldset", "address"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<end>>|\Z)|(?P<other>[!?/][^>]*(?:>|\Z)))", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Paths deeper than this are told by their first elements.
PATH_DEPTH = 24
#: Share of the varying text a content class must hold.
CONTENT_SHARE = 0.8


class Node:
    __slots__ = ("name", "label", "skip")

    def __init__(self, name: str, label: str, skip: bool) -> None:
        self.name, self.label, self.skip = name, label, skip


def _node(name: str, rest: str, above: bool) -> Node:
    kind, names = "", []
    for key, *values in ATTRIBUTE.findall(rest) if rest else ():
        value = "".join(values).lower()
        if key.lower() in ("class", "id"):
            names += re.split(r"[^a-z0-9]+", value)
            kind = kind or value
        elif key.lower() == "role" and value in NO_CONTENT_ROLES or key.lower() == "hidden":
            names.append("ad")
    skip = above or name in NO_CONTENT or (name not in ("html", "body", "article", "main") and any(n in NO_CONTENT_NAMES for n in names))
    return Node(name, f"{name}.{kind.split()[0]}" if kind.split() else name, skip)


def read(page: str) -> Iterator[tuple[str, str, str | None, bool]]:
    """('open', path, None, skip) for element starts and ('text', path, text, skip) for blocks of text, in page order."""
    stack: list[Node] = []
    text: list[str] = []

    def path() -> str:
        return "/".join(n.label for n in stack[:PATH_DEPTH] if n.name not in INLINE)

    def block():
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            yield "text", path(), joined, bool(stack and stack[-1].skip)

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if not found:
            text.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            text.append(html.unescape(page[at : found.start()]))
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if name == "br":
            text.append(" ")
            continue
        if found["close"]:
            if any(n.name == name for n in reversed(stack)):
                place = max(i for i, n in enumerate(stack) if n.name == name)
                if inline and any(n.name not in INLINE for n in stack[place + 1 :]):
                    continue
                if stack[place].skip or any(n.name not in INLINE for n in stack[place:]):
                    yield from block()
                del stack[place:]
            elif not inline:
                yield from block()
            continue
        if name in RAW:
            end = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        above = bool(stack and stack[-1].skip)
        node = _node(name, found["rest"], above)
        if not inline or node.skip != above:
            yield from block()
        if name in CLOSES_PARAGRAPH and any(n.name == "p" for n in stack):
            place = max(i for i, n in enumerate(stack) if n.name == "p")
            if all(n.name in INLINE for n in stack[place + 1 :]):
                del stack[place:]
        if name in CLOSES_SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in CLOSES_SAME[name]:
                    break
        if name in VOID:
            continue
        if found["rest"].endswith("/") and name in ("path", "circle", "rect", "use"):
            continue
        stack.append(node)
        if not inline:
            yield "open", path(), None, bool(node.skip)
    yield from block()


def _tokens(batches):
    """Per page and path: how often it starts, characters of its own text, a hash of that, and its place."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            found: dict[str, list] = {}
            for place, (kind, path, text, skip) in enumerate(read(row["html"] or "")):
                own = found.setdefault(path, [0, 0, [], place, skip])
                if kind == "open":
                    own[0] += 1
                else:
                    own[1] += len(text)
                    own[2].append(text)
            rows += [(row["host"], row["page"], path, n, chars, "\n".join(texts), place, skip) for path, (n, chars, texts, place, skip) in found.items()]
        if rows:
            columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "path", "n", "chars", "texts", "place", "skip"])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, path, class, pages, n, chars, varies, place, skip, valid): the tokens of each host's template.

    `pages` has host and html. `class` is the fingerprint of the occurrence vector, `varies` whether the text of the
    token's slots differs between pages, `valid` whether the tokens of the class nest under its first one.
    """
    ids = pages.select("host", "html", F.xxhash64("html").alias("page"))
    tokens = ids.mapInArrow(_tokens, "host string, page long, path string, n long, chars long, texts string, place long, skip boolean")
    tokens = tokens.select("host", "page", "path", "n", "chars", F.xxhash64("texts").alias("slot"), "place", "skip")
    found = tokens.groupBy("host", "path").agg(
        # Equal pages have equal parts, which a sum keeps apart by their number; a plain exclusive or would lose pairs.
        F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("class"),
        F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        (F.min("slot") != F.max("slot")).alias("varies"), F.min("place").alias("place"), F.max("skip").alias("skip"),
    )
    first = F.first("path").over(Window.partitionBy("host", "class").orderBy("place", "path"))
    return found.withColumn("valid", F.startswith("path", first))


def content_paths(template: DataFrame) -> DataFrame:
    """(host, content, constant): the path of the content class, and paths of slots with the same text on all pages."""
    slots = template.where(~F.col("skip") & (F.col("chars") > 0))
    weight = F.when(F.col("varies"), F.col("chars")).otherwise(F.lit(0)) + F.col("chars") / F.lit(1e6)
    steps = F.split("path", "/")
    above = slots.select("host", weight.alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("content"))
    mass = above.groupBy("host", "content").agg(F.sum("w").alias("mass"))
    total = slots.groupBy("host").agg(F.sum(weight).alias("total"))
    tokens = template.where("valid and not skip").select("host", F.col("path").alias("content"), (F.col("n") == F.col("pages")).alias("once"))
    mass = mass.join(tokens, ["host", "content"]).join(total, "host")
    name = F.regexp_extract("content", r"([^/.]*)[^/]*$", 1)
    kind = F.when((name == "article") & (F.col("mass") > 0), 3).when((name == "main") & (F.col("mass") > 0), 2).when(F.col("once") & (F.col("mass") >= F.col("total") * CONTENT_SHARE), 1).otherwise(0)
    # The outermost article or main, else the deepest class that holds enough.
    depth = F.size(F.split("content", "/"))
    rank = F.struct(kind.alias("kind"), F.when(kind == 1, depth).otherwise(-depth).alias("depth"), F.col("mass"), F.col("content"))
    best = mass.groupBy("host").agg(F.max(rank).alias("best")).select("host", F.col("best.content").alias("content"))
    constant = template.where("not skip and not varies and chars > 0 and pages > 2 and n = pages").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("constant"))
    return best.join(constant, "host", "left")


def main_text(page: str | None, content: str | None, constant: set[str]) -> str:
    """The page's text within the content class."""
    blocks = [(path, text) for kind, path, text, skip in read(page or "") if kind == "text" and not skip]

    def inside(path: str, root: str) -> bool:
        return path == root or path.startswith(root + "/")

    def named(path: str, *names: str) -> bool:
        return any(step.split(".")[0] in names for step in path.split("/"))

    kept = [b for b in blocks if content and inside(b[0], content)]
    if not kept:
        kept = [b for b in blocks if named(b[0], "article")] or [b for b in blocks if named(b[0], "main")] or blocks
    varying = [b for b in kept if named(b[0], "article", "main") or b[0] not in constant]
    return "\n\n".join(text for _, text in varying or kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; blocks of text stand apart by an empty line."""
    scratch = Scratch(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    found = scratch.keep(content_paths(deduce_templates(rows)), "templates")

    def work(batches):
        for batch in batches:
            texts = [main_text(r["html"], r["content"], set(r["constant"] or ())) for r in batch.select(["html", "content", "constant"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(found, "host", "left").select("page_id", "url", "html", "content", "constant").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
