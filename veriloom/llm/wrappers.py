"""Main text of web pages by wrappers inferred per host.

A page is read as a balanced stream of tokens: tags with their first class or
id, and text. Siblings that follow each other with equal shape fold into a
repeated group, so the stream becomes a union-free regular expression of tags,
text slots, groups that repeat (``+``) and groups that may be absent (``?``).
Two expressions of one host are aligned by their longest common sequence of
labels, inside matched elements again; what only one side has becomes optional.
The result is the wrapper of the host.

With the expression go figures for each text slot: pages, characters, and a
bounded sketch of its distinct values. A slot with one value on all of several
pages of different main text is part of the template.

Wrappers are folded where the pages are: each task keeps one per host and emits
it once; these few rows are merged per host in two steps. A host with a third
of all pages costs each task the same as any other. Expressions grow with the
variety of a host's templates, not with its pages.

The text of a page is what lies in its main region (``article``, ``main`` or a
content element; without one, the whole body) outside of navigation, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles, and
outside of the slots that the wrapper knows as template text. Within an article,
or a main region without one, only whole classes and roles name furniture, and
headings and sections are not judged by name.

Null and empty html, and pages without text, give an empty text. A null url, or
one without a host, belongs to the host "". Repeated rows fold to the same
wrapper. An empty table gives an empty result. Columns named like a result are
replaced.
"""

from __future__ import annotations

import html
import json
import re
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import through_table
from .columns import without

SKETCH = 64
#: A slot is template text from this many pages of different main text with one value, on a host with as many different pages.
TEMPLATE_PAGES = 5
LONGEST_GROUP = 4
RESULT = ["text", "n_chars"]

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "script style noscript template head nav footer aside form button select option input textarea iframe object embed svg canvas "
    "audio video map dialog menu".split()
)
CONTENT = frozenset(["article", "main"])
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("thead", "tbody"), "tbody": ("thead", "tbody"),
}
SCOPE = frozenset("ul ol dl table body html".split())
# Words in class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager topbar footer "
    "bottombar comment comments disqus discussion reply replies respond share sharing social related recommended recommendations popup "
    "modal overlay newsletter subscribe subscription signup login search toolbar widget skip hidden complementary contentinfo "
    "site-header site-footer".split()
)
# Whole class names and ids of what readers and sites add below or beside an article's own text.
ADDED = frozenset(
    "comments comment-list commentlist comments-area comments-section comment-section comment-respond reader-comments disqus_thread "
    "share-buttons share-bar share-links social-share social-links related-posts related-articles related-stories recommended-posts "
    "newsletter-signup ad-slot ad-container".split()
)
#: Dropped outside the main region only: an article's own header holds its title.
HEADERS = frozenset("header masthead".split())
#: Not dropped by name within an article: their names often repeat titles.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLED = HEADINGS | {"section"}
DEEPEST = 300
CONTENT_WORDS = frozenset("article content post entry story maincontent articlebody".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|[^<]+|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|[a-z]+")


class Element:
    __slots__ = ("tag", "label", "furniture", "aside", "header", "content", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.furniture, self.content = tag, tag, tag in DROPPED, tag in CONTENT
        self.aside = tag in DROPPED  # furniture within an article too
        self.header = tag == "header"
        self.children: list = []
        if attributes and "=" in attributes or "hidden" in attributes:
            named = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
            mark = next((w for k in ("class", "id") for w in re.sub(r"\d+", "", named.get(k, "")).lower().split()), "")
            if mark:
                self.label = f"{tag}.{mark}"
            words: set[str] = set()
            for k in ("class", "id", "role", "itemprop"):
                for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", named.get(k, "")).lower().replace("_", "-").split():
                    words |= {token, *token.split("-")}
            if words & CONTENT_WORDS and not words & FURNITURE:
                self.content = self.content or tag in ("div", "section", "td")
            hidden = "hidden" in named or named.get("aria-hidden") == "true"
            if tag not in ("html", "body") and (words & FURNITURE or hidden):
                self.furniture = True
            whole = {token for k in ("class", "role") for token in named.get(k, "").lower().split()}
            self.aside = self.aside or hidden or tag not in TITLED and bool(whole & FURNITURE)
            named_whole = {token for k in ("class", "id") for token in named.get(k, "").lower().split()}
            self.aside = self.aside or tag not in HEADINGS and bool(named_whole & ADDED)
            self.header = self.header or bool(words & HEADERS)
            if named.get("role") == "main" or named.get("itemprop", "").lower() == "articlebody":
                self.content = True


def parse(source: str) -> Element:
    """A tolerant tree: unknown end tags are ignored, open elements end with their parent.

    Elements deeper than ``DEEPEST`` are siblings at that depth; no text is lost.
    """
    root = Element("#root")
    stack = [root]
    at, end = 0, len(source)
    match = _TOKEN.match
    while at < end:
        m = match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                stack[-1].children.append(piece)
            elif piece.startswith("<![CDATA["):
                stack[-1].children.append(piece[9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",), CLOSES_P - {"p"})
        elif tag in SIBLINGS:
            _close(stack, SIBLINGS[tag], SCOPE)
        node = Element(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>?", re.I).search(source, at)
            node.children.append(source[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _close(stack: list[Element], tags: tuple[str, ...], until) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in until:
            return


# ------------------------------------------------ expressions: [label, mark, children]; mark is "", "?", "+" or "*"


def shape(node: Element, path: str, values: dict[str, list[str]]) -> list:
    """The expression of an element; its texts are added to ``values`` by path."""
    out, text = [], []
    for child in node.children:
        if isinstance(child, str):
            text.append(child)
            continue
        if child.tag in INLINE:
            text.append(_flat(child))
            continue
        _slot(text, path, out, values)
        if child.tag in ("script", "style"):
            out.append([child.label, "", []])
        else:
            out.append([child.label, "", shape(child, f"{path}/{child.label}", values)])
    _slot(text, path, out, values)
    return fold(out)


def _flat(node: Element) -> str:
    return "".join(c if isinstance(c, str) else _flat(c) for c in node.children)


def _slot(text: list[str], path: str, out: list, values: dict[str, list[str]]) -> None:
    joined = " ".join("".join(text).split())
    text.clear()
    if joined:
        out.append(["#", "", []])
        values.setdefault(path, []).append(joined)


def _key(seq: list) -> tuple:
    return tuple(x[0] for x in seq)


def fold(seq: list) -> list:
    """Runs of equal labels, or of equal groups of up to ``LONGEST_GROUP`` labels, become one repeated item."""
    for size in range(1, LONGEST_GROUP + 1):
        out, i = [], 0
        while i < len(seq):
            group, n = seq[i : i + size], 1
            while len(group) == size and _key(seq[i + n * size : i + (n + 1) * size]) == _key(group):
                group = merge(group, seq[i + n * size : i + (n + 1) * size])
                n += 1
            if n == 1:
                out.append(seq[i])
                i += 1
            else:
                one = group[0] if len(group) == 1 else ["()", "", group]
                out.append([one[0], "*" if one[1] in ("?", "*") else "+", one[2]])
                i += n * size
        seq = out
    return seq


def merge(a: list, b: list) -> list:
    """Align two expressions; unmatched items become optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append([a[i][0], _both(a[i][1], b[j][1]), merge(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], _absent(a[i][1]), a[i][2]])
            i += 1
        else:
            out.append([b[j][0], _absent(b[j][1]), b[j][2]])
            j += 1
    return out


def _both(x: str, y: str) -> str:
    absent, many = x in "?*" and x != "" or y in "?*" and y != "", x in ("+", "*") or y in ("+", "*")
    return {(True, True): "*", (True, False): "?", (False, True): "+", (False, False): ""}[(bool(absent), many)]


def _absent(x: str) -> str:
    return "*" if x in ("+", "*") else "?"


def written(seq: list) -> str:
    """The expression as text."""
    out = []
    for label, mark, children in seq:
        inner = written(children)
        body = "#text" if label == "#" else inner if label == "()" else f"<{label}>{inner}</>"
        out.append(f"({body}){mark}" if mark or label == "()" else body)
    return "".join(out)


# ------------------------------------------------ wrappers


class Wrapper:
    """Expression and slot figures of one host; ``add`` and ``join`` commute up to the order of optional parts."""

    def __init__(self):
        self.seq: list | None = None
        self.seen: set[str] = set()
        self.pages = 0
        self.different: list[int] = []
        self.slots: dict[str, list] = {}  # path: pages, characters, sketch of values, least digests of main texts

    def add(self, tree: Element) -> None:
        values: dict[str, list[str]] = {}
        seq = shape(tree, "", values)
        # Shapes seen before change nothing; the set is emptied when it is full, which costs time only.
        mark = written(seq)
        if mark not in self.seen:
            if len(self.seen) > 1000:
                self.seen.clear()
            self.seen.add(mark)
            self.seq = seq if self.seq is None else fold(merge(self.seq, seq))
        self.pages += 1
        whole = blake2b(digest_size=8)
        # Copies of an article are one page to its slots, whatever else differs around it.
        main = int.from_bytes(blake2b(main_text(tree, frozenset()).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
        for path, texts in values.items():
            slot = self.slots.setdefault(path, [0, 0, [], []])
            slot[0] += 1
            _sketch(slot[3], main, TEMPLATE_PAGES)
            for t in texts:
                raw = t.encode("utf-8", "surrogatepass")
                slot[1] += len(t)
                whole.update(raw)
                _sketch(slot[2], int.from_bytes(blake2b(raw, digest_size=7).digest(), "big"))
        _sketch(self.different, int.from_bytes(whole.digest(), "big") >> 8)

    def join(self, other: Wrapper) -> None:
        if other.seq is not None:
            self.seq = other.seq if self.seq is None else fold(merge(self.seq, other.seq))
        self.pages += other.pages
        for h in other.different:
            _sketch(self.different, h)
        for path, (pages, size, sketch, different) in other.slots.items():
            slot = self.slots.setdefault(path, [0, 0, [], []])
            slot[0] += pages
            slot[1] += size
            for h in sketch:
                _sketch(slot[2], h)
            for h in different:
                _sketch(slot[3], h, TEMPLATE_PAGES)

    def template(self) -> list[str]:
        if len(self.different) < TEMPLATE_PAGES:
            return []
        return sorted(p for p, (_, _, sketch, different) in self.slots.items() if len(different) >= TEMPLATE_PAGES and len(sketch) == 1)

    def dump(self) -> str:
        return json.dumps([self.seq, self.pages, self.different, self.slots])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        w = cls()
        w.seq, w.pages, w.different, w.slots = json.loads(text)
        return w


def _sketch(least: list[int], value: int, size: int = SKETCH) -> None:
    """Keep the ``size`` least distinct digests."""
    if value in least:
        return
    if len(least) < size:
        least.append(value)
        return
    top = max(least)
    if value < top:
        least[least.index(top)] = value


def _fold_pages(batches):
    """One wrapper per host and task."""
    hosts: dict[str, Wrapper] = {}
    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hosts.setdefault(host, Wrapper()).add(parse(source or ""))
        if len(hosts) > 2000:  # many hosts: hand over what there is
            yield _rows(hosts)
            hosts = {}
    if hosts:
        yield _rows(hosts)


def _rows(hosts: dict[str, Wrapper]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([w.dump() for w in hosts.values()], pa.string())], ["host", "wrapper"])


def _join_rows(frame: pd.DataFrame) -> pd.DataFrame:
    w = Wrapper()
    for text in frame["wrapper"].sort_values():
        w.join(Wrapper.load(text))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "salt": [0], "wrapper": [w.dump()]})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, pages, expression, template`` (paths of template slots as JSON)."""
    part = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        _fold_pages, "host string, wrapper string"
    )
    schema = "host string, salt int, wrapper string"
    some = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)).cast("int")).groupBy("host", "salt").applyInPandas(_join_rows, schema)
    whole = some.groupBy("host").applyInPandas(_join_rows, schema)

    def finish(batches):
        for batch in batches:
            ws = [Wrapper.load(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([w.pages for w in ws], pa.int64()), pa.array([written(w.seq or []) for w in ws], pa.string()),
                    pa.array([json.dumps(w.template()) for w in ws], pa.string()),
                ],
                ["host", "pages", "expression", "template"],
            )

    return whole.mapInArrow(finish, "host string, pages long, expression string, template string")


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# ------------------------------------------------ extraction


def main_text(tree: Element, template: frozenset[str]) -> str:
    """Blocks of the main region in page order, one per line."""
    regions: list[tuple[Element, str]] = []

    def find(node: Element, path: str) -> None:
        for c in node.children:
            if isinstance(c, str) or c.furniture and c.tag != "form":
                continue
            if c.content and c.tag in CONTENT:
                regions.append((c, f"{path}/{c.label}"))
            else:
                find(c, f"{path}/{c.label}")

    marked: list[tuple[Element, str]] = []

    def find_marked(node: Element, path: str) -> None:
        """Elements marked as content by name that neither are nor hold one of the regions."""
        for c in node.children:
            if isinstance(c, str) or c.furniture and c.tag != "form" or any(c is r for r, _ in regions):
                continue
            if c.content and not (regions and _holds(c, regions)):
                marked.append((c, f"{path}/{c.label}"))
            else:
                find_marked(c, f"{path}/{c.label}")

    find(tree, "")
    find_marked(tree, "")
    # An article element may be a teaser beside the text itself.
    if marked and sum(_size(r) for r, _ in marked) > 2 * sum(_size(r) for r, _ in regions):
        regions = marked
    inside = bool(regions)
    blocks: list[str] = []
    text: list[str] = []

    def flush(path: str) -> None:
        block = " ".join(html.unescape("".join(text)).split())
        if block and not (template and path in template and " ".join("".join(text).split())):
            blocks.append(block)
        text.clear()

    def walk(node: Element, path: str, own: bool) -> None:
        own = own or node.tag == "article"
        for c in node.children:
            if isinstance(c, str):
                text.append(c)
            elif (c.aside if own else c.furniture) or c.header and not inside:
                flush(path)
            elif c.tag in INLINE:
                if c.tag == "br":
                    text.append(" ")
                walk(c, path, own)
            elif c.tag in RAW:
                continue
            else:
                flush(path)
                walk(c, f"{path}/{c.label}", own)
                flush(f"{path}/{c.label}")
        if node.tag not in INLINE:
            flush(path)

    for node, path in regions or [(tree, "")]:
        walk(node, path, inside and not _has_article(node))
    if not blocks and not inside:
        # Some sites wrap the whole page in one form.
        for form in _forms(tree):
            walk(form, "/form", False)
    return "\n".join(blocks)


def _forms(node: Element) -> list[Element]:
    """Outermost forms outside other furniture."""
    out = []
    for c in node.children:
        if not isinstance(c, str):
            out += [c] if c.tag == "form" else [] if c.furniture else _forms(c)
    return out


def _size(node: Element) -> int:
    """Characters of text that is not furniture."""
    return sum(len(c.strip()) if isinstance(c, str) else 0 if c.aside or c.tag in RAW else _size(c) for c in node.children)


def _holds(node: Element, regions: list) -> bool:
    return any(not isinstance(c, str) and (any(c is r for r, _ in regions) or _holds(c, regions)) for c in node.children)


def _has_article(node: Element) -> bool:
    return any(not isinstance(c, str) and (c.tag == "article" or _has_article(c)) for c in node.children)


def _extract_pass(names: list[str]):
    """The last two inputs are the html and the template of its host."""

    def run(batches):
        for batch in batches:
            texts = []
            known: dict[str, frozenset[str]] = {}
            for source, template in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                slots = known.get(template or "")
                if slots is None:
                    slots = known[template or ""] = frozenset(json.loads(template) if template else ())
                texts.append(main_text(parse(source or ""), slots))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, *RESULT]
            )

    return run


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars`` appended."""
    wrappers = through_table(infer(pages, url_col, html_col), "wrappers").select(F.col("host").alias("__v_host"), F.col("template").alias("__v_template"))
    base = without(pages, [html_col, *RESULT])
    joined = (
        pages.withColumn("__v_html", F.col(html_col).cast("string"))
        .withColumn("__v_host", host_of(url_col))
        .join(wrappers, "__v_host", "left")
        .select(*[F.col(f"`{c}`") for c in base.columns], "__v_html", "__v_template")
    )
    kinds = [StructField(f.name, f.dataType) for f in base.schema]
    return joined.mapInArrow(_extract_pass(base.columns), StructType([*kinds, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op9_main_text(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract(pages)
