"""Main text of web pages by a site style tree (Yi, Liu and Li, 2003).

Every page is parsed once, where it lies, into blocks of text with the path of their
element: tags and class or id names from the root. Pages of one host are merged by path:
a node of the style tree is a host and a path. Its importance over the ``m`` pages that
have it is

* of its presentation: the entropy, to base ``m``, of the sequences of tags it holds;
* of its content: one less the mean entropy of its features (texts, link targets, images)
  over the pages, which is 0 if all pages have the same and 1 if each has its own;
* together: ``(1 - g^l) * presentation + g^l * content`` with ``l`` presentations, ``g`` 0.9.

Every block of a node below ``threshold`` is removed. Names speak first: what is called navigation,
footer, advert, form, comment and so on is of importance 0, unless it is a wrapper of the main text
(``_spare_wrappers``); the inside of ``article`` or ``main`` is likely the main text, what stands
beside it is likely not. That counts as ``PRIOR`` pages of importance 1 and 0, so a host of few
pages goes by names and one of many by its tree. Several articles with less than half of the text
are teasers and decide nothing.

Hashes of features are counted before their shuffle, and only the paths of blocks meet the
importances. Texts are shuffled only if the paths that turn a page's blocks against their names
are too many to broadcast; the largest unit held in memory is one page.

Defined results: null html counts as empty and gives an empty text; a null or odd URL has the
host ``''``; a host with one page keeps all that names do not decide; repeated rows come back
as often as they came; pages of a host with the same main text (all text that no name makes noise,
if there is no article) count as one page of its tree; tags left open end with their parent, a cut
off tag or comment at the end is no text; an empty table gives an empty one; a very long page is
parsed whole, in memory that grows with its length, however deep it nests; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

THRESHOLD = 0.3
DAMPING = 0.9
#: Pages for which the names of an article count as evidence.
PRIOR = 4

#: Elements that stand in a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video".split())
NOISE_TAGS = frozenset("nav footer aside form button select textarea input option fieldset dialog menu".split())
#: Noise by tag, which may yet be a wrapper of the whole page.
FORM_TAGS = frozenset("form fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: What may stand in a head; any other element, and text, ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta noscript script style template title".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: With one of these in it (has-sidebar, comments-open) a class names no noise; the style tree decides.
MODIFIERS = frozenset("has with no non not without is show hide open closed free enabled disabled ready supports".split())
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening the first ends the open second, up to the third.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _named(names: str) -> set[str]:
    """The words of classes and ids that may name noise."""
    return {w for token in names.split() if not (parts := set(re.split(r"[^a-z]+", token))) & MODIFIERS for w in parts}


class Element:
    __slots__ = ("tag", "path", "parent", "own", "main", "begins_main", "children", "inline", "size", "role")

    def __init__(self, tag: str, names: str, parent: Element | None) -> None:
        words = _named(names)
        inside = parent is not None and parent.main
        self.tag, self.parent, self.inline = tag, parent, tag in INLINE
        self.begins_main = tag in MAIN_TAGS or "role=main" in names
        self.main = inside or self.begins_main
        #: What names this element noise: its tag, a form, a class, or nothing.
        self.own = ""
        if tag in FORM_TAGS:
            self.own = "form"
        elif tag in UNSEEN or tag in NOISE_TAGS or tag == "header" and not inside:
            self.own = "tag"
        elif tag not in ("html", "body") and (words & NOISE_NAMES or "header" in words and not inside):
            self.own = "class"
        step = tag if not names else f"{tag}.{names}"
        # a digest of the path, so that deep nesting takes no more than its elements
        self.path = hashlib.blake2b(step.encode("utf-8", "replace"), digest_size=16, key=parent.path if parent else b"").digest()
        self.role = "role=main" in names or parent is not None and parent.role
        self.children: list[str] = []
        self.size = 0

    def line(self):
        """The element and those around it, from the inside out."""
        element = self
        while element is not None:
            yield element
            element = element.parent


class Page(HTMLParser):
    """Blocks ``(path, main, text)`` of a page in order, and per path what its elements hold."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", "", None)]
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []
        self.mains: list[Element] = []
        self.forms: list[Element] = []
        self.held: list[tuple[Element, str]] = []
        self.styles: dict[str, list[str]] = {}
        self.features: dict[str, list[str]] = {}
        self.feed(html)
        if re.match(r"<[!/?a-zA-Z]", self.rawdata):  # a tag or comment that was cut off
            self.rawdata = ""
        self.close()
        self._to(0)
        self._block()
        self._spare_wrappers()
        self.blocks = self._judged()

    def _spare_wrappers(self) -> None:
        """A form or a class around the main text names no noise.

        A form is a wrapper if it holds a main element or more than half of the text; an element
        with a noisy class if it is, or holds, the one main element that fewest others rule out.
        """
        forms = {e for e in self.forms if 2 * e.size > self.open[0].size}
        forms |= {e for m in self.mains for e in m.line() if e.own == "form"}
        for e in forms:
            e.own = ""
        depths = [sum(bool(e.own) for e in m.line()) for m in self.mains]
        least = [m for m, d in zip(self.mains, depths, strict=True) if d == min(depths)]
        if len(least) == 1 and all(e.own != "tag" for e in least[0].line()):
            for e in least[0].line():
                e.own = ""

    def only_cards(self) -> bool:
        """Whether several articles hold less than half of the text that names leave: teasers beside a story."""
        shown = [m for m in self.mains if not any(e.own for e in m.line())]
        if len(shown) < 2 or any(m.tag != "article" or m.role for m in shown):
            return False
        left = [(main, len(text)) for _, main, noise, text in self.blocks if not noise]
        return 2 * sum(n for main, n in left if main) < sum(n for _, n in left)

    def _judged(self) -> list[tuple[str, bool, bool, str]]:
        noise: dict[Element, bool] = {}
        for holder, _ in self.held:
            line = []
            for e in holder.line():
                if e in noise:
                    break
                line.append(e)
            for e in reversed(line):
                noise[e] = bool(e.own) or e.parent is not None and noise[e.parent]
        return [(holder.path, holder.main, noise[holder], text) for holder, text in self.held]

    def _holder(self) -> Element:
        return next(e for e in reversed(self.open) if not e.inline)

    def _block(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            holder = self._holder()
            holder.size += len(text)
            self.held.append((holder, text))
            self.features.setdefault(holder.path, []).append(text)

    def _to(self, size: int) -> None:
        """Ends elements until so many are open."""
        while len(self.open) > max(1, size):
            if not self.open[-1].inline:
                self._block()
            element = self.open.pop()
            self.opened[element.tag] -= 1
            element.parent.size += element.size
            self.styles.setdefault(element.path, []).append(" ".join(element.children))

    def _end(self, tags, stop=frozenset()) -> None:
        if not any(self.opened[tag] for tag in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._to(i)
                return
            if self.open[i].tag in stop:
                return

    def _end_head(self, tag: str) -> None:
        """What cannot stand in a head ends one that was left open."""
        if tag == "body" or tag not in HEAD_TAGS and self.open[-1].tag in ("head", "title"):
            self._end({"head"})

    def handle_starttag(self, tag, attrs) -> None:
        self._end_head(tag)
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, {"table", "li", "div", "article", "main", "section", "body"})
        if tag in SIBLINGS:
            self._end(*SIBLINGS[tag])
        if tag not in INLINE:
            self._block()
        values = dict(attrs)
        names = " ".join(f"{values[k]}" for k in ("class", "id") if values.get(k)).lower()
        if values.get("role") == "main":
            names += " role=main"
        parent = self.open[-1]
        parent.children.append(tag)
        element = Element(tag, re.sub(r"\d+", "0", names), parent)
        for target in ("href", "src"):
            if values.get(target):
                self.features.setdefault(self._holder().path, []).append(f"{target} {values[target]}")
        if tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self.open.append(element)
            self.opened[tag] += 1
            if element.begins_main and not parent.main:
                self.mains.append(element)
            if element.own == "form":
                self.forms.append(element)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag) -> None:
        if tag not in VOID:
            self._end({tag})

    def handle_data(self, data) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._end_head("")
        if self.open[-1].tag not in UNSEEN:
            self.text.append(data)


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: ``host``, ``blocks`` that no name makes noise, ``nodes`` of the style tree."""
    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))
    schema = source.select(id_col, url_col).schema.add("host", "string")
    schema = schema.add("digest", "long").add("has_main", "boolean").add("blocks", _type("array<struct<path:bigint,main:boolean,text:string>>")).add("nodes", _type("array<struct<path:bigint,main:boolean,style:bigint,features:array<bigint>>>"))

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def key(text: str) -> int:
            value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            return value - (value >> 63 << 64)

        for batch in batches:
            hosts, digests, mains, blocks, nodes = [], [], [], [], []
            for url, html in zip(batch.column(1), batch.column(2), strict=True):
                page = Page(html.as_py() or "")
                hosts.append(host_of(url.as_py()))
                cards = page.only_cards()
                judged = [(p, m and not cards, t) for p, m, noise, t in page.blocks if not noise]
                mains.append(any(m for _, m, _ in judged))
                digests.append(key("\n".join(f"{p}\r{t}" for p, m, t in judged if m or not mains[-1])))
                blocks.append([{"path": key(f"{m} {p.hex()}"), "main": m, "text": t} for p, m, t in judged])
                found = dict.fromkeys((p, m) for p, m, _ in judged)
                nodes.append([{"path": key(f"{m} {p.hex()}"), "main": m, "style": key("|".join(page.styles.get(p, ()))), "features": list({key(f) for f in page.features[p]})} for p, m in found])
            columns = [batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip((hosts, digests, mains, blocks, nodes), list(kinds)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return source.mapInArrow(run, schema)


def _type(text: str):
    from pyspark.sql.types import DataType

    return DataType.fromDDL(text)


def _once(pages: DataFrame) -> DataFrame:
    """One page of each host and digest; ``pages`` has a number of its own in ``row_of_page``.

    Only the numbers of further copies leave their place; Spark broadcasts them if they are few.
    """
    known = pages.select("host", "digest", "row_of_page")
    first = known.groupBy("host", "digest").agg(F.min("row_of_page").alias("first"), F.count("*").alias("n")).where("n > 1")
    further = stored(known.join(first, ["host", "digest"]).where("row_of_page <> first").select("row_of_page"), "page-copies")
    return pages.join(further, "row_of_page", "left_anti")


def importances(pages: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, path, main, beside_main, pages, presentation, content, importance`` of each node of the style trees."""
    nodes = pages.select("host", "has_main", F.explode("nodes").alias("node")).select("host", "has_main", "node.*")
    styles = nodes.groupBy("host", "path", "style").agg(F.count("*").alias("n"), F.max("main").alias("main"), F.max("has_main").alias("beside_main"))
    shown = styles.groupBy("host", "path").agg(F.max("main").alias("main"), F.max("beside_main").alias("beside_main"), F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("sum_n"))
    features = nodes.select("host", "path", F.explode("features").alias("feature")).groupBy("host", "path", "feature").agg(F.count("*").alias("n"))
    held = features.groupBy("host", "path").agg(F.count("*").alias("features"), F.sum(F.log("n")).alias("entropy"))
    many = F.col("pages") > 1
    base = F.log(F.greatest("pages", F.lit(2)))
    presentation = F.when(many, (base - F.col("sum_n") / F.col("pages")) / base).otherwise(1.0)
    content = F.when(many, 1 - F.col("entropy") / F.col("features") / base).otherwise(1.0)
    weight = F.pow(F.lit(damping), F.col("styles"))
    return shown.join(held, ["host", "path"]).select(
        "host", "path", "main", "beside_main", "pages", presentation.alias("presentation"), content.alias("content"), ((1 - weight) * presentation + weight * content).alias("importance")
    )


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, url_col, text, n_chars`` of each page, and ``n_blocks`` that make the text."""
    read = stored(parsed(pages, id_col, url_col, html_col).withColumn("row_of_page", F.monotonically_increasing_id()), "parsed-pages")
    ruled = stored(against_names(importances(_once(read)), threshold), "ruled-paths")
    kept = _decided(read, ruled)
    texts = F.transform("kept", lambda b: b["text"])
    text = F.array_join(texts, "\n")
    return kept.select(id_col, url_col, text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("kept").cast("long").alias("n_blocks"))


def against_names(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, path, inside, beside, alone``: nodes where the style tree decides otherwise than names alone.

    Names keep what is in an article, drop what is beside one, and keep all on a page without. In and
    beside an article they count as ``PRIOR`` pages of importance 1 and 0; without one the tree decides.
    """
    seen = (F.col("pages") - 1) * F.col("importance")
    weight = F.col("pages") - 1 + PRIOR
    inside = F.col("main") & ((seen + PRIOR) / weight < threshold)
    beside = ~F.col("main") & F.col("beside_main") & (seen / weight >= threshold)
    alone = ~F.col("main") & (F.col("importance") < threshold)
    return nodes.select("host", "path", inside.alias("inside"), beside.alias("beside"), alone.alias("alone")).where("inside OR beside OR alone")


def _decided(read: DataFrame, ruled: DataFrame) -> DataFrame:
    """The pages with their ``kept`` blocks. Only paths are shuffled to meet the tree; a page then takes its own back."""
    paths = read.select("row_of_page", "host", "has_main", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["main"].alias("main"))))).alias("p"))
    met = paths.select("row_of_page", "host", "has_main", "p.*").join(ruled, ["host", "path"])
    turned = F.when(F.col("main"), F.col("inside")).when(F.col("has_main"), F.col("beside")).otherwise(F.col("alone"))
    turns = stored(met.where(turned).groupBy("row_of_page").agg(F.collect_set("path").alias("turned")), "turned-paths")
    by_name = lambda b: b["main"] | ~F.col("has_main")
    is_turned = lambda b: F.coalesce(F.array_contains("turned", b["path"]), F.lit(False))
    return read.join(turns, "row_of_page", "left").withColumn("kept", F.filter("blocks", lambda b: by_name(b) != is_turned(b)))
