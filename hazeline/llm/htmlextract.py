"""HTML extraction by equivalence classes: what same-host pages share is their template, and the article is what remains in its slots.

Tokens are containers (tag, class and id, under their containers) and whole text blocks. Spark sums a hash of each distinct page and the token's count in
it, so that tokens with one sum share an occurrence vector; the tokens of a vector are a class. A class is valid when it has enough tokens and enough of
the host's distinct pages; valid classes nest by their containers into the template. The template names the slot that holds the article: an article or main
element if it has one, else the outermost slot. Text blocks of the template go wherever they stand, in the slot too: those on enough of the host's pages,
and those on enough of its pages of one layout (with the same containers around the article). For text blocks, pages are told apart by their article's content, so that copies of one article (mirrors, print views) count once; and
blocks that make up most of an article element are its text, however often they recur. Of the slot every other text stays but what lies in
menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments: marked by their element, or by a class, id or role all of whose parts say so.
A container named as the article is never one of these. Hosts with too few pages use the template of all pages; sums are combined before they are shuffled, so a host may hold any share of them.

A null html is an empty page and gives empty text; a null url is a host of its own; repeated rows are extracted alike and count once in the
template; broken markup never fails. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm.tables import written

MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.6, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = frozenset("class id role itemprop aria-label".split())
_RAW = frozenset("script style noscript template textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol dl table figure details dialog fieldset blockquote menu".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre address figcaption summary hr center legend option".split())
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCKS))})(?=[\s/>])", re.IGNORECASE)
_OUTER = frozenset("html body main article".split())
_APART = frozenset("head nav header footer aside form menu dialog button label select".split())
#: Words of a class, id or role that mark what is not the article.
_APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs pagination pager"
    " header masthead footer copyright sidebar aside widget related recommended share sharing social cookie cookies consent notice notices alert gdpr popup modal overlay"
    " newsletter subscribe signup login search form comment comments reply replies respond discussion disqus toolbar toc skip complementary contentinfo".split()
)
#: Parts of a class, id or role that say nothing about what a container holds; they may stand beside the words above.
_NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content entry field fixed global group head heading icon icons inline inner input item items left link links list main"
    " outer overlay page panel placeholder post posts primary right row secondary section side site slot small sticky story tab text title top wrap wrapper".split()
)
_MAIN_WORDS = frozenset("main articlebody post-content entry-content article-body article-content post-body story-body".split())


def _path(parent: str, own: str) -> str:
    """The path of a container under its parent's; a long one is named by its hash, so deep containers stay apart."""
    path = f"{parent}/{own}"
    return path if len(path) <= 400 else f"~{hashlib.md5(path.encode('utf-8', 'replace')).hexdigest()}"


def _says_apart(word: str) -> bool:
    """Whether a class, id or role names what is not the article: no part of it says otherwise."""
    if word in _APART_WORDS:
        return True
    parts = set(re.split("[-_]+", word)) - {""}
    return not parts.isdisjoint(_APART_WORDS) and parts <= _APART_WORDS | _NEUTRAL_WORDS


class Page:
    """Containers (path, parent, apart, role) and texts (container, block, text, in a link) of a page, in page order."""

    def __init__(self, source: str):
        self.paths, self.parents, self.apart, self.roles = [""], [-1], [False], [0]
        self.texts: list[tuple[int, int, str, bool]] = []
        stack, names, block, links, at = [0], [""], 0, 0, 0
        inside = [False]  # containers of the article
        unclosed: set[str] = set()

        def text(a: int, b: int) -> None:
            if a < b:
                self.texts.append((stack[-1], block, entities.unescape(source[a:b]), links > 0))

        while m := _TOKEN.search(source, at):
            text(at, m.start())
            at = m.end()
            name = m[2] and m[2].lower()
            if not name:
                continue
            if m[1]:
                block += name in _BLOCKS
                links = max(0, links - 1) if name == "a" else links
                if name in names[1:]:
                    k = len(names) - 1 - names[::-1].index(name)
                    del stack[k:], names[k:]
                continue
            if name == "br":
                self.texts.append((stack[-1], block, " ", False))
            if name in _VOID:
                block += name == "hr"
                continue
            if name in _RAW and not m[3].endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, at)
                if not end:  # what is never closed ends where a block begins
                    unclosed.add(name)
                    begun = _BLOCK_TAG.search(source, at)
                at = end.end() if end else begun.start() if begun else len(source)
                continue
            if name in _BLOCKS:
                block += 1
                if names[-1] == "p":  # an open p ends where a block begins
                    stack.pop()
                    names.pop()
            links += name == "a"
            label, words, hidden = "", set(), False
            for a in _ATTRIBUTE.finditer(m[3]) if m[3] else ():
                value, what = (a[2] or a[3] or a[4] or "").lower(), a[1].lower()
                hidden |= what == "hidden" and value != "until-found" or what == "aria-hidden" and value.strip() == "true"
                if what not in _NAMING:
                    continue
                words |= {*value.split()}
                if what in ("class", "id"):
                    label += f"{'.' if what == 'class' else '#'}{re.sub('[0-9]+', '0', value)}"
            role = 2 if name == "article" or "articlebody" in words else 1 if name == "main" or words & _MAIN_WORDS else 0
            # Classes of the page and of the main slot tell how it is laid out ("with-sidebar"), not what it is.
            if name == "article":
                named = not words.isdisjoint(_APART_WORDS)
            else:
                named = not role and name not in _OUTER and any(map(_says_apart, words))
            # An article's own header holds its title.
            own_header = name == "header" and inside[stack[-1]] and not named
            apart = name in _APART and not own_header or hidden or named
            if name in _CONTAINERS or apart or words & _MAIN_WORDS:
                self.paths.append(_path(self.paths[stack[-1]], f"{name}{label}".replace("/", ":")))
                inside.append(inside[stack[-1]] or role > 0)
                self.parents.append(stack[-1])
                self.apart.append(apart or self.apart[stack[-1]])
                self.roles.append(role)
                stack.append(len(self.paths) - 1)
                names.append(name)
        text(at, len(source))

    def blocks(self, main: str | None = None) -> list[tuple[str, str]]:
        """(path, text) of the blocks that aren't apart, under main if it is given."""
        inside = [main is None] + [False] * (len(self.paths) - 1)
        for k in range(1, len(self.paths)):
            inside[k] = inside[self.parents[k]] or self.paths[k] == main
        out: list[tuple[str, list[str]]] = []
        last = None
        for node, block, text, _ in self.texts:
            if inside[node] and not self.apart[node]:
                if block != last:
                    out.append((self.paths[node], []))
                    last = block
                out[-1][1].append(text)
        return [(path, joined) for path, parts in out if (joined := " ".join("".join(parts).split()))]

    def content(self) -> int:
        """A hash of the article's text: of what lies in the best role, or of all that isn't apart."""
        best = max((r for r, apart in zip(self.roles, self.apart, strict=True) if not apart), default=0)
        main = next((p for r, p, apart in zip(self.roles, self.paths, self.apart, strict=True) if r == best and not apart), None) if best else None
        return _hashed("\n".join(text for _, text in self.blocks(main)))

    def tokens(self) -> dict[tuple[str, str], list]:
        """(path, block text or empty): count, characters, characters in links, role of containers that aren't apart, and their parent."""
        found: dict[tuple[str, str], list] = {("", ""): [1, 0, 0, 0, ""]}
        for path, apart, role, parent in zip(self.paths[1:], self.apart[1:], self.roles[1:], self.parents[1:], strict=True):
            if not apart:
                found.setdefault((path, ""), [0, 0, 0, role, self.paths[parent]])[0] += 1
        for node, _, text, link in self.texts:
            n, at = len(text.strip()), node
            while n and at > 0:
                if not self.apart[at]:
                    own = found[self.paths[at], ""]
                    own[1] += n
                    own[2] += n * link
                at = self.parents[at]
        for path, text in self.blocks():
            found.setdefault((path, text), [0, len(text), 0, 0, ""])[0] += 1
        return found

    def layout(self) -> str:
        """A hash of the containers that aren't apart, without those inside an article or main element."""
        inside, seen = [False], set()
        for k in range(1, len(self.paths)):
            parent = self.parents[k]
            inside.append(inside[parent] or self.roles[parent] > 0)
            if not inside[k] and not self.apart[k]:
                seen.add(self.paths[k])
        return hashlib.md5("\n".join(sorted(seen)).encode("utf-8", "replace")).hexdigest()[:16]


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:8], "big", signed=True)


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


#: In place of a block's hash: counts the different contents of a host or layout.
_CONTENTS = -1
_TOKENS = "host string, page bigint, path string, block bigint, n int, chars bigint, link_chars bigint, role int, parent string"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(9)]
        for host, page, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            parsed = Page(source or "")
            content = parsed.content()
            layout = f"{host}\n{parsed.layout()}"
            tokens = [(path, _hashed(text) if text else 0, *figures) for (path, text), figures in parsed.tokens().items()]
            for path, block, *figures in [*tokens, ("", _CONTENTS, 1, 0, 0, 0, "")]:
                for key in (host, "*", layout) if block or not path else (host, "*"):
                    for column, value in zip(columns, (key, content if block else page, path, block, *figures), strict=True):
                        column.append(value)
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _TOKENS.split(", ")])


def classes(pages: DataFrame) -> DataFrame:
    """Tokens of valid classes: (host, path, parent, block, members, pages, chars, link_chars, role). block 0: a container. The host of a layout's text blocks has the layout after a line end."""
    rows = pages.select(_host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    once = rows.mapInArrow(_emit, _TOKENS).groupBy("host", "path", "parent", "block", "page").agg(*(F.max(c).alias(c) for c in ("n", "chars", "link_chars", "role")))
    mark = F.xxhash64("page", "n")
    low, high = mark.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(mark, 33)  # sums of these can't overflow
    sums = once.groupBy("host", "path", "parent", "block").agg(
        F.sum(low).alias("low"), F.sum(high).alias("high"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.max("role").alias("role"),
    )
    sums = written(sums.filter((F.col("block") == 0) | (F.col("pages") >= MIN_PAGES)), "tokens")  # rarer text blocks are of no template
    vectors = sums.groupBy("host", "low", "high").agg(F.count("*").alias("tokens"), F.count_if(F.col("block") == 0).alias("members"), F.max("pages").alias("of"))
    hosts = sums.filter("path = '' AND block = 0").select("host", F.col("pages").alias("host_pages"))
    valid = vectors.join(hosts, "host").filter((F.col("tokens") >= MIN_TOKENS) & (F.col("of") >= MIN_PAGES) & (F.col("of") >= F.col("host_pages") * MIN_SHARE))
    # A text block is of the template by its own share of the different contents: texts of one vector with a container are rare.
    contents = sums.filter(f"path = '' AND block = {_CONTENTS}").select("host", F.col("pages").alias("host_pages"))
    blocks = sums.filter((F.col("block") != 0) & (F.col("block") != _CONTENTS))
    own = blocks.join(contents, "host").filter((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= F.col("host_pages") * MIN_SHARE))
    tokens = sums.filter("block = 0").join(valid.select("host", "low", "high", "members"), ["host", "low", "high"]).select("host", "path", "parent", "block", "members", "pages", "chars", "link_chars", "role")
    return tokens.unionByName(own.select("host", "path", "parent", "block", F.lit(1).cast("bigint").alias("members"), "pages", "chars", "link_chars", "role"))


def nested(tokens: list[tuple[str, str, int, int, int]]) -> str:
    """The main slot of containers (path, parent, chars, link chars, role): only those whose containers are in the template too, and of them the best role, then text without links, then the outermost."""
    under = {path: parent for path, parent, *_ in tokens}
    depths: dict[str, int] = {"": 0}

    def depth(path: str) -> int:
        """Containers above a path, -1 where one of them is not in the template."""
        above = []
        while path not in depths and path in under:
            above.append(path)
            path = under[path]
        found = depths.get(path, -1)
        for path in reversed(above):
            found = depths[path] = found + 1 if found >= 0 else -1
        return found

    kept = [t for t in tokens if t[0] and depth(t[0]) > 0]
    return max(kept, key=lambda t: (t[4], t[2] - t[3], -depth(t[0]), t[0]))[0] if kept else ""


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, blocks): path of the article's slot, and the hashes of the template's text blocks, of each host with a template. Host * is of all pages; a layout has blocks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nested([(t["path"], t["parent"], t["chars"], t["link_chars"], t["role"]) for t in tokens]) for tokens in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(2)], ["host", "main", "blocks"])

    # A token is on three of five of the host's pages, so there are at most as many as on two of its pages.
    token = F.when(F.col("block") == 0, F.struct("path", "parent", "chars", "link_chars", "role"))
    grouped = classes(pages).groupBy("host").agg(F.collect_list(token).alias("tokens"), F.collect_set(F.when(F.col("block") != 0, F.col("block"))).alias("blocks"))
    return grouped.select("host", "tokens", "blocks").mapInArrow(run, "host string, main string, blocks array<bigint>")


def article(source: str | None, main: str | None, blocks: frozenset[int] = frozenset()) -> str:
    """The page's text in the main slot, or in the whole page where it has none, without the template's blocks."""
    page = Page(source or "")
    roles = [role if not apart else 0 for role, apart in zip(page.roles, page.apart, strict=True)]
    if main not in page.paths or max(roles) > max((r for r, p in zip(roles, page.paths, strict=True) if p == main), default=0):
        # The page differs from the template: its own best role, or all of it.
        main = next((p for r, p in zip(roles, page.paths, strict=True) if r == max(roles)), None) if max(roles) else None
    found = [text for _, text in page.blocks(main or None)]
    kept = [text for text in found if _hashed(text) not in blocks]
    if max(roles) and 2 * sum(map(len, kept)) < sum(map(len, found)):
        kept = found  # most of an article is no template: its pages are copies of one another
    return " ".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""
    known = written(templates(pages), "templates")
    common = known.filter("host = '*'").select("main", "blocks").first()
    fallback = (common.main, frozenset(common.blocks)) if common else (None, frozenset())
    of_layout = F.col("host").contains("\n")
    own = known.filter(~of_layout & (F.col("host") != "*")).withColumnRenamed("host", "template_host")
    laid = known.filter(of_layout).select(F.col("host").alias("layout_host"), F.col("blocks").alias("layout_blocks"))
    schema = T.StructType([*pages.select("page_id", "url", "html").schema.fields, T.StructField("host", T.StringType()), T.StructField("layout", T.StringType())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = [f"{host}\n{Page(source or '').layout()}" for source, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layouts, pa.string())], schema.names)

    hosted = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).mapInArrow(lay, schema)
    both = hosted.join(own, hosted.host == own.template_host, "left").join(laid, hosted.layout == laid.layout_host, "left").select("page_id", "url", "html", "main", "blocks", "layout_blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, main, blocks, more in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                slot, common_blocks = (main, frozenset(blocks or ())) if main is not None else fallback
                out.append(article(source, slot, common_blocks.union(more or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = pages.schema
    fields = [T.StructField("page_id", kinds["page_id"].dataType), T.StructField("url", kinds["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return both.mapInArrow(run, T.StructType(fields))
