"""Rows out of raw pages: JSON-LD, Open Graph, simple containers, method fallback, page type, links."""
from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions.text import col, let, recipe_clean


# ---- JSON-LD -----------------------------------------------------------------------------------

def json_ld_nodes(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, seq, node): one row per JSON-LD object; arrays and @graph are opened, unreadable blocks are skipped."""
    blocks = pages.select(page, F.posexplode(H.json_ld_blocks(html)).alias("block", "body"))
    body = F.trim("body")
    items = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.array(body))
    outer = blocks.select(page, "block", F.posexplode(items).alias("i", "node"))
    graph = F.get_json_object("node", "$['@graph']")
    inner = F.when(graph.startswith("["), F.from_json(graph, "array<string>")).when(graph.isNotNull(), F.array(graph)).otherwise(F.array("node"))
    nodes = outer.select(page, "block", "i", F.posexplode(inner).alias("j", "node"))
    return nodes.where(F.get_json_object("node", "$").startswith("{")).select(page, F.struct("block", "i", "j").alias("seq"), "node")


def node_types(node: Column | str) -> Column:
    kind = F.get_json_object(col(node), "$['@type']")
    return F.when(kind.startswith("["), F.from_json(kind, "array<string>")).when(kind.isNotNull(), F.array(kind)).otherwise(F.array().cast("array<string>"))


def json_path(node: Column | str, path: str) -> Column:
    """Text at a dotted path; of a list the first item; objects give null."""
    value = F.get_json_object(col(node), "$." + path)
    first = F.get_json_object(col(node), f"$.{path}[0]")
    return F.when(value.startswith("["), first).when(value.startswith("{"), None).otherwise(value)


def json_ld_events(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    nodes = json_ld_nodes(pages, page, html)
    return nodes.where(F.arrays_overlap(node_types("node"), F.array(*[F.lit(t) for t in rules.EVENT_TYPES])))


def event_details(events: DataFrame, page: str = "page_id") -> DataFrame:
    """Title, description, dates, venue and lowest price of event nodes; nested names and first items are followed."""
    node = F.col("node")
    return events.select(
        page, "seq", json_path(node, "name").alias("title"), json_path(node, "description").alias("desc"),
        json_path(node, "startDate").alias("start"), json_path(node, "endDate").alias("end"),
        F.coalesce(json_path(node, "location.name"), json_path(node, "location")).alias("venue"),
        F.coalesce(json_path(node, "location.address.streetAddress"), json_path(node, "location.address")).alias("address"),
        F.coalesce(json_path(node, "image.url"), json_path(node, "image")).alias("image"),
        F.coalesce(F.get_json_object(node, "$.offers.price"), F.get_json_object(node, "$.offers[0].price")).try_cast("double").alias("price_min"))


PLACE_PATHS = {"name": "name", "description": "description", "image_url": "image", "url": "url"}


def json_ld_places(pages: DataFrame, types: list[str], paths: dict[str, str] = PLACE_PATHS, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Place rows of matching type (substring, any case); all nodes when no type is given."""
    nodes = json_ld_nodes(pages, page, html)
    kind = F.lower(F.array_join(node_types("node"), " "))
    if types:
        nodes = nodes.where(kind.rlike(H.alternation([t.lower() for t in types])))
    fields = [F.when(json_path("node", p).isNotNull(), recipe_clean(json_path("node", p))).alias(n) for n, p in paths.items()]
    rows = nodes.select(page, "seq", *fields).where(F.coalesce(F.col("name"), F.lit("")) != "")
    return rows.join(pages.select(page, F.col(url).alias("source_url")), page)


def open_graph_rows(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    og = H.open_graph(html, url)
    return (pages.select(page, F.col(url).alias("source_url"), og.alias("og")).select(page, "source_url", "og.*")
            .where(F.coalesce(F.col("name"), F.lit("")) != ""))


# ---- containers by tag, class or attribute --------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _selects(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    """Simple selectors: ``tag``, ``.class``, ``tag.class``, ``[attr]``, ``[attr=value]``."""
    if selector.startswith("["):
        name, _, value = selector[1:-1].partition("=")
        return name in attrs and (not value or attrs[name] == value.strip("\"'"))
    want, _, cls = selector.partition(".")
    return (not want or tag == want) and (not cls or cls in (attrs.get("class") or "").split())


class _Cards(HTMLParser):
    """Collects text and attributes of wanted fields inside each container, in one pass."""

    def __init__(self, container: str, fields: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.container, self.fields = container, fields
        self.rows, self.stack = [], []

    def handle_starttag(self, tag, attributes):
        attrs = {k: v or "" for k, v in attributes}
        opens = _selects(self.container, tag, attrs)
        if opens:
            self.rows.append({})
        inside = opens or any(f[1] is not None for f in self.stack)
        row = self.rows[-1] if inside and self.rows else None
        grab = []
        if row is not None:
            for name, spec in self.fields.items():
                selector, _, attr = spec.partition("@")
                if name in row and name not in grab:
                    continue
                if _selects(selector, tag, attrs):
                    if attr:
                        row[name] = attrs.get(attr) or None
                    else:
                        row[name] = ""
                        grab.append(name)
        if tag not in VOID:
            self.stack.append((tag, row if opens else (row if inside else None), grab))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        for _, row, grab in self.stack:
            for name in grab:
                row[name] += data


def css_rows(pages: DataFrame, container: str, fields: dict[str, str], page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per container; ``fields`` maps a column to ``selector`` (text) or ``selector@attribute``.

    A table function in a lateral join: each page gives its rows and keeps its columns, so nothing is joined back by id and a page
    that stands twice gives its rows twice. Null html has no rows. Nothing is shared between pages.
    """
    names = list(fields)

    class Rows:
        def eval(self, text: str | None):
            cards = _Cards(container, fields)
            cards.feed(text or "")
            cards.close()
            for i, row in enumerate(cards.rows):
                yield (i, *(" ".join(row[n].split()) or None if row.get(n) is not None else None for n in names))

    rows = F.udtf(Rows, returnType=", ".join(["pos int", *[f"`{n}` string" for n in names]]), useArrow=True)
    found = pages.select(page, F.col(url).alias("source_url"), F.col(html).alias("_html")).lateralJoin(rows(F.col("_html").outer()))
    return found.select(page, "pos", *names, "source_url")


# ---- several methods --------------------------------------------------------------------------------

def union_methods(parts: dict[str, DataFrame], page: str = "page_id") -> DataFrame:
    """All methods with method name, confidence and order; columns a method lacks are null."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        one = df.withColumn("method", F.lit(name)).withColumn("confidence", F.lit(rules.METHOD_CONFIDENCE[name])).withColumn("priority", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def fallback_rows(rows: DataFrame, page: str = "page_id", enough: int = 3) -> DataFrame:
    """Rows of the methods that would have run: nothing after JSON-LD found a row or any method found ``enough``.

    The stop point of each page is a small count per (page, method), compared as a column.
    """
    n = rows.groupBy(page, "priority", "method").agg(F.count(F.lit(1)).alias("n"))
    stops = n.where(((F.col("method") == "jsonld") & (F.col("n") > 0)) | (F.col("n") >= enough))
    limit = stops.groupBy(page).agg(F.min("priority").alias("_stop"))
    return rows.join(limit, page, "left").where(F.col("priority") <= F.coalesce("_stop", F.lit(1_000_000))).drop("_stop")


def unique_rows(rows: DataFrame, order: list[Column], page: str = "page_id") -> DataFrame:
    """First row per page, name and url."""
    w = Window.partitionBy(page, F.coalesce("name", F.lit("")), F.coalesce("url", F.lit(""))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def images_first(rows: DataFrame, page: str, order: Column, position: str = "position") -> DataFrame:
    """Position within the page: rows with an image first, else arrival order."""
    w = Window.partitionBy(page).orderBy(F.coalesce(F.col("image_url"), F.lit("")) == "", order)
    return rows.withColumn(position, F.row_number().over(w))


# ---- links ---------------------------------------------------------------------------------------------

LINK = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)["']"""


def listing_links(pages: DataFrame, keep: str, cap: int = 50, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, position, link): distinct absolute links that match, in order of first appearance, ``cap`` per page."""
    from ..functions.urls import absolute_url
    links = F.regexp_extract_all(col(html), F.lit(LINK), F.lit(1))
    absolute = F.transform(links, lambda l: absolute_url(l, url))
    wanted = F.array_distinct(F.filter(absolute, lambda l: l.rlike(keep)))
    return pages.select(page, F.posexplode(F.slice(wanted, 1, cap)).alias("position", "link"))


# ---- page type ------------------------------------------------------------------------------------------

PAGE_TYPES = ["list", "article", "gallery", "search", "category"]


def _url_points(p: str) -> float:
    if p.startswith("/"):
        return 0.4 if p.endswith("/") else 0.3
    return 0.25 if "=" in p else 0.2


def _html_points(p: str) -> float:
    if p.startswith("<") and p.endswith(">"):
        return 0.25
    heads = ("list-", "item-", "detail-", "single-", "gallery-", "photo-", "search-", "results-", "category-", "section-")
    return 0.2 if p.startswith(heads) else 0.15


def _text_points(p: str) -> float:
    if "bangkok" in p:
        return 0.15
    words = ("guide", "best", "top", "review", "story", "gallery", "photo", "image", "search", "results")
    return 0.12 if any(w in p for w in words) else 0.1


def pattern_points() -> dict[str, dict[str, list[tuple[str, float]]]]:
    """Per surface and page type, each pattern with its total points (repeats added up)."""
    out: dict = {}
    for surface, table, points in (("url", rules.PAGE_URL_PATTERNS, _url_points), ("html", rules.PAGE_HTML_PATTERNS, _html_points),
                                   ("text", rules.PAGE_TEXT_PATTERNS, _text_points)):
        out[surface] = {}
        for kind, patterns in table.items():
            total: dict[str, float] = {}
            for p in patterns:
                total[p] = round(total.get(p, 0.0) + points(p), 4)
            out[surface][kind] = sorted(total.items())
    return out


def _surface_score(text: Column, patterns: list[tuple[str, float]]) -> Column:
    """Sum of the points of contained patterns, at most 1. The patterns are one constant, so the plan stays small."""
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(int(round(w * 10000))).alias("w")) for p, w in patterns])
    total = let(text, lambda t: F.aggregate(table, F.lit(0), lambda acc, x: acc + F.when(F.contains(t, x["p"]), x["w"]).otherwise(F.lit(0))))
    return F.least(total / F.lit(10000.0), F.lit(1.0))


def _site_bonus(url: Column) -> dict[str, Column]:
    """Extra points of two known sites, as (list, article, gallery, search, category)."""
    first = url.contains("timeout.com") & url.contains("/bangkok/")
    listing = url.rlike("/restaurants|/cafes|/bars")
    single = ~listing & url.rlike("/restaurant/|/cafe/|/bar/")
    gallery = ~listing & ~single & url.contains("/gallery")
    search = ~listing & ~single & ~gallery & url.contains("search")
    second = ~url.contains("timeout.com") & url.contains("bk.asia")
    guides = url.contains("/guides/")
    feature = ~guides & url.contains("/feature/")

    def points(*tests):
        chain = None
        for test, value in tests:
            chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
        return chain.otherwise(F.lit(0.0))
    return {"list": points((first & listing, 0.2), (second & guides, 0.2)), "article": points((first & single, 0.2), (second & feature, 0.2)),
            "gallery": points((first & gallery, 0.2), (second & ~guides & ~feature & url.contains("/gallery"), 0.2)),
            "search": points((first & search, 0.2)), "category": points((first & listing, 0.1))}


def page_type(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds type scores, ``page_type`` and ``type_confidence``: .4 url + .3 html + .3 text, unknown below .3."""
    points = pattern_points()
    base = pages.select(*(keep or pages.columns), F.lower(url).alias("_u"), F.lower(html).alias("_h"), F.lower(H.visible_text(html)).alias("_t"))
    bonus = _site_bonus(F.col("_u"))
    for kind in PAGE_TYPES:
        u = F.least(_surface_score(F.col("_u"), points["url"][kind]) + bonus[kind], F.lit(1.0))
        base = base.withColumn(f"score_{kind}", F.round(0.4 * u + 0.3 * _surface_score(F.col("_h"), points["html"][kind]) + 0.3 * _surface_score(F.col("_t"), points["text"][kind]), 6))
    best = F.greatest(*[F.col(f"score_{k}") for k in PAGE_TYPES])
    chain = F.when(F.col("_best") < 0.3, "unknown")
    for kind in PAGE_TYPES:
        chain = chain.when(F.col(f"score_{kind}") == F.col("_best"), kind)
    return (base.withColumn("_best", best).withColumn("page_type", chain)
            .withColumn("type_confidence", F.when(F.col("_best") < 0.3, F.lit(0.0)).otherwise(F.col("_best"))).drop("_u", "_h", "_t", "_best"))


SIMPLE_TYPES = [("list", ["<ul>", "<ol>", "list-item"]), ("article", ["<article>", "article", "post", "entry"]),
                ("gallery", ["gallery", "slideshow", "carousel", "lightbox"]), ("search", ["search", "results", "query"])]


def simple_type_from_html(html: Column | str) -> Column:
    low = F.lower(col(html))
    chain = None
    for kind, words in SIMPLE_TYPES:
        test = low.rlike(H.alternation(words))
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("unknown")


def simple_type_from_url(url: Column | str, patterns: dict[str, list[str]]) -> Column:
    low = F.lower(col(url))
    chain = F.when(F.lit(False), F.lit(""))
    for kind, words in patterns.items():
        chain = chain.when(low.rlike(H.alternation(words)), kind)
    return chain.otherwise("unknown")
