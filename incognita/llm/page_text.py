"""Main texts of web pages, by wrappers that are inferred for each host.

Wrappers (see wrappers.py) are folded where the pages are: each task aligns its pages host by host, so a host with a third
of all pages gives one row a task, and these rows are merged FAN at a time, in as many rounds as it takes. A host's wrapper
then tells which of its parts hold articles: its `article` elements, else its `main` ones; else the smallest part that holds
most of the text that differs from page to page, without texts that all pages share and without lists of links. Parts whose
names say menu, header, footer, sidebar, notice, advert, form or comments are left out anywhere, unless the wrapper shows that
they hold the article. Pages of hosts that have a thousandth of all pages (a thousand hosts at most) get what was decided
by a broadcast, others by a join on the host.

Character references are decoded once, white space in a block becomes one space, and blocks are joined in page order by an
empty line. A line break is white space; other tags within a block leave nothing.

Defined cases: null and empty pages have an empty text; a null url, or one without a host, belongs to one host without a
name. Pages cut off anywhere give what is there. Very long pages are read whole. Repeated rows give equal rows. A page of a
host with articles that has none itself is read like pages without. Which parts of a host without `article` and `main`
count is decided from all its pages, and may, as alignment depends on order, change with how the pages are dealt to tasks.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.llm import session, wrappers
from incognita.llm.wrappers import SLOT, Node

#: Wrappers merged at once, and hosts that a task holds.
FAN, HOSTS = 32, 256
#: A host has that share of all pages if its rules are broadcast.
LARGE = 1000
#: Pages that have to agree on a text before it counts as part of the template.
AGREE = 3
DROPPED, ARTICLE, CHOSEN, HOLDS = 1, 2, 4, 8

# Elements and words of their names that say that what they hold is no part of an article.
TAGS = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head iframe input label map math menu nav noframes noscript object option script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts adsense banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookiebar cookies copyright disqus footer form forms gdpr login "
    "masthead menu menus modal nav navbar navigation navs newsletter notice notices notification notifications overlay pager pagination popup promo promoted promotion related reply replies respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
HEADS = frozenset(["header", "topheader", "pageheader", "siteheader"])
#: Names like has-sidebar tell of something else than the element itself.
_ABOUT = re.compile(r"^(?:has|with|without|no|not|is|hide|show|above|below|before|after)[-_]", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_KEPT = ("html", "body", "main")


def _names(told: dict[str, str]) -> set[str]:
    """First and last words of the classes and the id of an element."""
    found = set()
    for name in (told.get("class", "") + " " + told.get("id", "")).split():
        if not _ABOUT.match(name) and (pieces := _PIECE.findall(name)):
            found |= {pieces[0].lower(), pieces[-1].lower(), "".join(pieces).lower()}
    return found


def left_out(tag: str, told: dict[str, str], in_article: bool) -> bool:
    """Whether an element's name says that what it holds is no part of an article."""
    if tag in TAGS or tag == "header" and not in_article:
        return True
    if tag in _KEPT or not told:
        return False
    if told.get("role", "").lower() in ROLES:
        return True
    names = _names(told)
    return bool(names & WORDS) or not in_article and bool(names & HEADS)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _partial_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, pages and wrapper: what a task's pages of a host have in common. Of many hosts, the rarer ones go out first."""
    held: dict[str, Node] = {}

    def out(hosts: list[str]) -> pa.RecordBatch:
        nodes = [held.pop(h) for h in hosts]
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([n.pages for n in nodes], pa.int64()), pa.array(map(wrappers.write, nodes), pa.string())], ["host", "pages", "wrapper"])

    digest = lambda text: zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            node = wrappers.of_page(page.as_py() or "", digest)
            held[host] = wrappers.bounded(wrappers.merged(held[host], node)) if host in held else node
            if len(held) > HOSTS:
                yield out(sorted(held, key=lambda h: held[h].pages)[: HOSTS - HOSTS // 4])
    if held:
        yield out(list(held))


def _merge_wrappers(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "wrapper"])
    node = wrappers.read(rows["wrapper"].iloc[0])
    for text in rows["wrapper"].iloc[1:]:
        node = wrappers.bounded(wrappers.merged(node, wrappers.read(text)))
    return pd.DataFrame({"host": rows["host"].iloc[:1], "pages": [node.pages], "wrapper": [wrappers.write(node)], "part": rows["part"].iloc[:1] // FAN})


def infer_wrappers(pages: DataFrame, tables: session.Tables) -> DataFrame:
    """host, pages and wrapper of all hosts of pages (url, html)."""
    rows = session.columns(pages, "url", "html").select(host_of(F.col("url")).alias("host"), "html")
    found = rows.mapInArrow(_partial_wrappers, "host string, pages long, wrapper string").withColumn("part", F.spark_partition_id().cast("long"))
    found = tables.keep(found, "wrappers-0")
    parts, k = (found.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        bucket = F.col("part") - F.col("part") % FAN
        found = tables.keep(found.groupBy("host", bucket.alias("bucket")).applyInPandas(_merge_wrappers, "host string, pages long, wrapper string, part long"), f"wrappers-{k + 1}")
        tables.drop(f"wrappers-{k}")
        parts, k = -(-parts // FAN), k + 1
        if parts == 1:
            return found.drop("part")


def _weight(node: Node, varying: bool) -> int:
    """Letters of the slots below that stand in no link (and that differ from page to page)."""
    own = max(node.chars - node.linked, 0) if node.key == SLOT and not (varying and _template(node)) else 0
    return own + sum(_weight(k, varying) for k in node.kids if not _out(k))


def _template(slot: Node) -> bool:
    return slot.same is not None and slot.pages >= AGREE


def _parsed(key: str) -> tuple[str, dict[str, str]]:
    tag, _, rest = re.match(r"([^.$@]*)(([.$@]?).*)", key, re.S).groups()[0], None, key
    marks = re.findall(r"([.$@])([^.$@]*)", rest[len(tag) :])
    return tag, {"class": " ".join(v for m, v in marks if m == "."), "id": "".join(v for m, v in marks if m == "$"), "role": "".join(v for m, v in marks if m == "@")}


def _out(node: Node) -> bool:
    return node.key not in ("", SLOT) and left_out(*_parsed(node.key), False) and not _holds(node)


def _holds(node: Node) -> bool:
    """Whether an article stands somewhere in a part whose name tells of something else."""
    tag, told = _parsed(node.key)
    if tag in TAGS:
        return False
    return any(_parsed(k.key)[0] in ("article", "main") and not left_out(*_parsed(k.key), True) or _holds(k) for k in node.kids if k.key != SLOT)


def decide(root: Node) -> list:
    """What the parts of a host's wrapper are: [key, flags, kids], with only those that are something."""
    flags: dict[int, int] = {}

    def mark(node: Node, wanted: tuple[str, ...]) -> bool:
        """Marks the outermost elements of a name."""
        tag, told = _parsed(node.key)
        if node.key != SLOT and tag in wanted or told.get("role", "").lower() == "main" and "main" in wanted:
            if not left_out(tag, told, True):
                flags[id(node)] = flags.get(id(node), 0) | ARTICLE
                return True
        if node.key not in ("", SLOT) and left_out(tag, told, False):
            if not _holds(node):
                return False
            flags[id(node)] = flags.get(id(node), 0) | HOLDS
        return any([mark(k, wanted) for k in node.kids])

    mark(root, ("article",)) or mark(root, ("main",))
    # For pages that have none of these: the smallest part with most of the text that differs.
    varying = _weight(root, True) > 0
    node = root
    while True:
        kids = [k for k in node.kids if k.key != SLOT and not _out(k)]
        full = _weight(node, varying)
        best = max(kids, key=lambda k: _weight(k, varying), default=None)
        if best is None or best.many or _weight(best, varying) < 0.8 * full or not any(k.key != SLOT for k in best.kids):
            break
        node = best
    flags[id(node)] = flags.get(id(node), 0) | CHOSEN

    def trim(part: Node) -> None:
        """Within the part, texts of the template and lists of links are no data."""
        for k in part.kids:
            chars, linked = _sums(k)
            if k.key != SLOT and not _holds(k) and (chars and 2 * linked > chars and _parsed(k.key)[0] in ("ul", "ol", "div", "table", "section", "dl") or varying and k.kids and all(_template(s) for s in _slots(k))):
                flags[id(k)] = flags.get(id(k), 0) | DROPPED
            else:
                trim(k)

    trim(node)

    def rows(part: Node) -> list | None:
        kids = [r for k in part.kids if k.key != SLOT for r in ([rows(k)] if k.key else [rows(g) for g in k.kids if g.key != SLOT]) if r]
        own = flags.get(id(part), 0)
        return [part.key, own, kids] if own or kids else None

    return rows(root) or ["", 0, []]


def _slots(node: Node) -> list[Node]:
    return [s for k in node.kids for s in ([k] if k.key == SLOT else _slots(k))]


def _sums(node: Node) -> tuple[int, int]:
    slots = [node] if node.key == SLOT else _slots(node)
    return sum(s.chars for s in slots), sum(s.linked for s in slots)


class Rules:
    """decide's rows, by kind of child."""

    def __init__(self, row: list):
        self.flags, self.kids = row[1], {}
        for kid in row[2]:
            found = self.kids.get(kid[0])
            # The same kind at several places: what it is at any of them.
            self.kids[kid[0]] = Rules(kid) if found is None else found.joined(kid)

    def joined(self, row: list) -> Rules:
        self.flags |= row[1]
        for kid in row[2]:
            self.kids[kid[0]] = self.kids[kid[0]].joined(kid) if kid[0] in self.kids else Rules(kid)
        return self


def main_text(page: str, rules: Rules) -> str:
    """The article of a page."""
    #: Of each open element: its tag, its rules, and whether it and what is around it is left out, in an article, or chosen.
    stack: list[tuple[str, Rules | None, bool, bool, bool]] = [("", rules, False, False, bool(rules.flags & CHOSEN))]
    blocks: list[tuple[int, str]] = []
    buffer: list[str] = []
    articles = False

    def close(article: bool, chosen: bool) -> None:
        if buffer and (text := " ".join("".join(buffer).split())):
            blocks.append((2 if article else 1 if chosen else 0, text))
        buffer.clear()

    for what, value, told in wrappers.events(page):
        tag, own, out, article, chosen = stack[-1]
        if what == "text":
            if not out:
                buffer.append(entities.unescape(value) if "&" in value else value)
        elif what == "<":
            if value not in wrappers.INLINE:
                close(article, chosen)
                own = own.kids.get(wrappers.kind(value, told)) if own is not None else None
                flags = own.flags if own is not None else 0
                begins = bool(flags & ARTICLE) and not out
                articles |= begins
                named = left_out(value, told, article or begins) and not flags & (HOLDS | ARTICLE)
                kept = named or bool(flags & DROPPED) and not article and not begins
                stack.append((value, own, out or kept, article or begins, chosen or bool(flags & CHOSEN)))
            else:
                out = out or bool(told) and left_out(value, told, article)
                if value == "br" and not out:
                    buffer.append(" ")
                stack.append((value, own, out, article, chosen))
        else:
            if value not in wrappers.INLINE:
                close(article, chosen)
            stack.pop()
    close(*stack[-1][3:])
    least = 2 if articles else 1 if any(level == 1 for level, _ in blocks) else 0
    return "\n\n".join(text for level, text in blocks if level >= least)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Rules] = {}
    for batch in batches:
        texts = []
        for page, rules in zip(batch.column("html"), batch.column("rules").to_pylist()):
            if rules not in known:
                if len(known) > HOSTS:
                    known.clear()
                known[rules] = Rules(json.loads(rules))
            texts.append(main_text(page.as_py() or "", known[rules]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = [json.dumps(decide(wrappers.read(w)), separators=(",", ":")) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(rules, pa.string())], ["host", "pages", "rules"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of pages (page_id, url, html)."""
    spark = pages.sparkSession
    session.prepare(spark)
    tables = session.Tables(spark, "page-text")
    rules = tables.keep(infer_wrappers(pages, tables).mapInArrow(_decided, "host string, pages long, rules string"), "rules")
    total = rules.agg(F.sum("pages")).first()[0] or 0
    large = F.broadcast(rules.filter(F.col("pages") * LARGE >= total).select("host", "rules"))
    small = rules.filter(F.col("pages") * LARGE < total).select("host", "rules")
    rows = session.columns(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    ruled = rows.join(large, "host")
    if not small.isEmpty():
        ruled = ruled.unionByName(rows.join(large, "host", "left_anti").join(small, "host"))
    return ruled.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "rules").mapInArrow(_extract, "page_id long, url string, text string")
