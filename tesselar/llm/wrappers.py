"""Operator 7: main text of web pages by union-free wrapper inference.

A page is a stream of block tags and texts. Adjacent equal runs of a stream fold
into repeated groups. Pages of one host are aligned one after another with the
wrapper found so far: what both have stays, what only one has becomes optional,
groups of equal body are one, and texts that differ become slots. A wrapper is
thus a regular expression without unions, and its nodes know how much text their
slots hold on all pages together. The host's main container is found in the
wrapper: the smallest element that holds most of the slots' text, without what page
furniture holds. A page's texts are main text where they stand in slots of it. On
pages that mark it (article and main elements), the wrapper takes out of the marked
text what it knows as no slot: lines that every page has, and repeated groups of
elements beside the article (teasers, comments) that are marked as articles, too.
What is not in the wrapper is judged by the page alone.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, blocks, small_batches, table

#: Groups in which a host's partial wrappers are merged first.
SPREAD = 64
#: Hosts whose wrappers a task holds before it hands them on.
HOSTS = 5000
#: Bytes of wrappers up to which they are sent to every task; beyond it they are joined.
SENT_BYTES = 8 << 20
#: Tokens of the longest group that folds. Longer elements that repeat stay node by node, which aligns and extracts the same texts.
GROUP = 12
#: A node stays in a wrapper if at least one in SUPPORT of the pages since its first has it; rarer ones are no part of a host's layout.
SUPPORT = 32
#: Pages from which a line of the marked text that all have is the host's.
SHARED = 3

# Element names by role, and words that name page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas select textarea button head title".split())
RAW = frozenset("script style textarea title noscript template".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
PROSE = frozenset("address blockquote center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset({"li"}), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset({"tr"}), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset({"option"})}
FURNITURE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|article-?body|content-?body|entry-?content|main|main-?content|post-?body|post-?content|story)(?:$|[\s_-])", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


MODIFIER = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is|hide|show)[-_]\S+", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def role(name: str, attributes: str) -> tuple[str, str]:
    """A block's signature and role: 'main', 'furniture' (by its element), 'named' (by its class or id), 'hidden' or ''.

    Names that say what a block has or lacks (has-sidebar), and those of the whole page, say nothing of its role.
    """
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    label = " ".join(x for x in (found.get("class", ""), found.get("id", ""), found.get("role", ""), found.get("itemprop", "")) if x)
    signature = name + ("." + label if label else "")
    if name in HIDDEN or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return signature, "hidden"
    label = MODIFIER.sub("", label) if name not in ("html", "body") else ""
    if name in FURNITURE:
        return signature, "furniture"
    if label and FURNITURE_NAME.search(label):
        return signature, "named"
    if name in MAIN or label and MAIN_NAME.search(label):
        return signature, "main"
    return signature, ""


def holds(where: str, name: str, own: str, marks_win: bool) -> str:
    """The role that holds in a block: its own role ``own`` where ``where`` holds around it."""
    if where == "hidden" or own == "hidden":
        return "hidden"
    if where == "main" and name == "header":
        return "heading"  # an article's header: only its headings are the article's
    if where == "heading":
        return "main" if name in HEADINGS else where
    if where == "furniture" or where == "named" and not (marks_win and name in MAIN and own == "main"):
        return where
    return own or where


def stream(page: str, marks_win: bool = False) -> list[tuple[str, str, str]]:
    """(kind, signature or text, where) of a page's block tags and texts; where is the role that holds there.

    With ``marks_win`` an article or main element is one even in a block whose name speaks of furniture.

    kind is '<', '>' or '#'. Inline tags join their texts, unclosed blocks close
    where HTML closes them or at the end; comments, scripts and hidden blocks go.
    """
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str, str]] = []
    text: list[str] = []

    def end_text() -> None:
        if text:
            t = SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if t:
                out.append(("#", t, stack[-1][2] if stack else ""))

    def close() -> None:
        end_text()
        _, signature, where = stack.pop()
        if where != "hidden":
            out.append((">", signature, where))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if (token[0] != "<" or token == "<") and not (stack and stack[-1][2] == "hidden"):
                text.append(token)
            elif token.startswith("<![CDATA["):
                text.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
        if name in VOID:
            if name == "hr":
                end_text()
            continue
        if m[1]:
            if name in INLINE:
                continue
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        signature, own = role(name, m[3])
        if name in RAW:
            found = RAW_END[name].search(page, at)
            at = page.find(">", found.start()) + 1 or n if found else n
            continue
        if name in INLINE and not own:
            continue
        while stack and name in CLOSES.get(stack[-1][0], ()):
            close()
        end_text()
        where = stack[-1][2] if stack else ""
        where = holds(where, name, own, marks_win)
        if name in INLINE:
            continue
        if m[3].endswith("/") and where == "hidden":
            continue
        stack.append((name, signature, where))
        if where != "hidden":
            out.append(("<", signature, where))
    while stack:
        close()
    end_text()
    return out


def shape(token: tuple[str, str, str]) -> str:
    """What is compared when streams are aligned: the tag, or that there is a text, and the role that holds there."""
    return f"{token[0]}{'' if token[0] == '#' else token[1]}|{token[2]}"


Node = tuple[str, list]  # a tag, '#' or '(body)+', and the tokens it stands for


def fold(tokens: list[tuple[str, str, str]], bodies: set[tuple[str, ...]]) -> list[Node]:
    """Tokens with adjacent equal runs, and runs equal to a known body, as one node each; new bodies are added."""
    shapes = [shape(t) for t in tokens]
    out: list[Node] = []
    at, n = 0, len(tokens)
    while at < n:
        best = 0
        if shapes[at][0] == "<":
            depth, size = 0, 0
            while at + size < n and size < GROUP:
                depth += (shapes[at + size][0] == "<") - (shapes[at + size][0] == ">")
                size += 1
                if depth == 0:
                    break
            body = tuple(shapes[at : at + size])
            if depth == 0 and size > 1:
                end = at + size
                while tuple(shapes[end : end + size]) == body:
                    end += size
                if end - at > size:
                    bodies.add(body)
                if body in bodies:
                    best = end - at
                    out.append(("(" + " ".join(body) + ")+", tokens[at:end]))
        if not best:
            best = 1
            out.append((shapes[at], tokens[at : at + 1]))
        at += best
    return out


def mark_of(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def node_of(x: Node, page: int) -> dict:
    """What a wrapper keeps of a node: shapes, the texts that every page has (those of marked articles by their digests), the number of pages and the characters of neutral texts, and how many pages came before its first.

    ``page`` names the page that has it, or is null once different pages do.
    """
    same = [t[1] for t in x[1] if shape(t) == "#|"]
    size = next((i for i in range(1, len(x[1])) if x[0][0] == "(" and "(" + " ".join(map(shape, x[1][:i])) + ")+" == x[0]), len(x[1]))
    fixed = [mark_of(t[1]) for t in x[1] if shape(t) == "#|main"]
    return {"shape": x[0], "body": [shape(t) for t in x[1][:size]], "optional": False, "same": same, "fixed": fixed, "page": page, "pages": 1, "chars": sum(map(len, same)), "since": 0}


def constant(node: dict) -> list[str]:
    """Texts that every page has at a node; none if one page alone has the node."""
    return node["same"] if node["page"] is None else []


def in_container(tokens: list[tuple[str, str]], changing: list[int]) -> list[bool]:
    """Which texts of a stream of (kind, signature) are main text: those that stand in its container. ``changing`` has the characters of changing texts.

    The container is the smallest element that holds two changing texts and more than
    half of their characters, or one around it as long as that holds prose (text,
    headings, paragraphs, lists, quotes, tables) or elements of the same signature beside it.
    """
    tags, parents, chars, texts, path, owner = [""], [-1], [0], [0], [0], []
    direct = [False]
    for token, weight in zip(tokens, changing, strict=True):
        if token[0] == "<":
            tags.append(token[1])
            parents.append(path[-1])
            chars.append(0)
            texts.append(0)
            direct.append(False)
            path.append(len(tags) - 1)
        owner.append(path[-1])
        if token[0] == ">":
            open_ = next((i for i in range(len(path) - 1, 0, -1) if tags[path[i]] == token[1]), 0)
            if open_:  # in a wrapper, tags of optional nodes may not match
                del path[open_:]
        elif token[0] == "#" and weight:
            direct[path[-1]] = True
            for i in path:
                chars[i] += weight
                texts[i] += 1
    box = max((i for i in range(len(tags)) if texts[i] > 1 and 2 * chars[i] > chars[0]), default=0)  # they are nested: the last is the smallest
    beside: dict[int, list[int]] = {}
    for i in range(1, len(tags)):
        if chars[i]:
            beside.setdefault(parents[i], []).append(i)
    at = box
    while at:
        up = parents[at]
        if tags[at].split(".")[0] in PROSE or direct[up] or any(i != at and (tags[i] == tags[at] or tags[i].split(".")[0] in PROSE) for i in beside[up]):
            box = up
        elif chars[up] > chars[at]:
            break
        at = up
    inside = [False] * len(tags)
    inside[box] = True
    for i in range(box + 1, len(tags)):
        inside[i] = inside[parents[i]]
    return [inside[i] for i in owner]


class Wrapper:
    """A host's wrapper: bodies of repeated groups, and nodes in order. Wrappers of parts of a host's pages merge."""

    def __init__(self, bodies: set[tuple[str, ...]] | None = None, nodes: list[dict] | None = None, pages: int = 0):
        self.bodies, self.nodes, self.pages = bodies or set(), nodes or [], pages

    @classmethod
    def of(cls, page: str) -> Wrapper:
        """The wrapper that is the page itself."""
        bodies: set[tuple[str, ...]] = set()
        number = zlib.crc32(page.encode("utf-8", "surrogatepass"))
        return cls(bodies, [node_of(x, number) for x in fold(stream(page), bodies)], 1)

    @classmethod
    def load(cls, text: str) -> Wrapper:
        bodies, nodes, pages = json.loads(text)
        return cls({tuple(b) for b in bodies}, nodes, pages)

    def dump(self) -> str:
        return json.dumps([sorted(self.bodies), self.nodes, self.pages])

    def _folded(self, bodies: set[tuple[str, ...]]) -> list[dict]:
        """The nodes with runs that equal a body, and neighbouring groups of one body, as one group."""
        if bodies <= self.bodies:
            return self.nodes
        out: list[dict] = []
        shapes, at = [x["shape"] for x in self.nodes], 0
        sizes = sorted({len(b) for b in bodies}, reverse=True)
        while at < len(shapes):
            size = next((n for n in sizes if tuple(shapes[at : at + n]) in bodies), 1)
            node = self.nodes[at]
            if size > 1:
                run = self.nodes[at : at + size]
                pages = {x["page"] for x in run}
                node = {"shape": "(" + " ".join(shapes[at : at + size]) + ")+", "optional": any(x["optional"] for x in run), "same": [t for x in run for t in x["same"]], "fixed": [t for x in run for t in x["fixed"]], "page": pages.pop() if len(pages) == 1 else None}
                node |= {"body": [b for x in run for b in x["body"]], "pages": max(x["pages"] for x in run), "chars": sum(x["chars"] for x in run), "since": min(x["since"] for x in run)}
            if out and out[-1]["shape"] == node["shape"] and node["shape"][0] == "(":
                last = out[-1]
                out[-1] = last | {"same": last["same"] + node["same"], "fixed": last["fixed"] + node["fixed"], "since": min(last["since"], node["since"]), "page": last["page"] if last["page"] == node["page"] else None, "pages": max(last["pages"], node["pages"]), "chars": last["chars"] + node["chars"]}
            else:
                out.append(node)
            at += size
        return out

    def merge(self, other: Wrapper) -> Wrapper:
        """Aligns two wrappers, ``other`` of later pages: nodes of both join, nodes of one become optional, rare ones leave."""
        if not self.nodes or not other.nodes:
            kept = self if self.nodes else other
            return Wrapper(kept.bodies, kept.nodes, self.pages + other.pages)
        bodies, total = self.bodies | other.bodies, self.pages + other.pages
        left, right = self._folded(bodies), other._folded(bodies)
        shapes = [x["shape"] for x in left], [x["shape"] for x in right]
        codes = [("equal", 0, len(left), 0, len(right))] if shapes[0] == shapes[1] else SequenceMatcher(None, *shapes, autojunk=False).get_opcodes()
        out: list[dict] = []
        for op, a, b, c, d in codes:
            if op == "equal":
                out += [self._join(x, y) for x, y in zip(left[a:b], right[c:d], strict=True)]
            else:
                out += [x | {"optional": True} for x in left[a:b]] + [x | {"optional": True, "since": x["since"] + self.pages} for x in right[c:d]]
        return Wrapper(bodies, [x for x in out if x["pages"] * SUPPORT >= total - x["since"]], total)

    @staticmethod
    def _join(x: dict, y: dict) -> dict:
        own, marks = set(y["same"]), set(y["fixed"])
        return x | {"optional": x["optional"] or y["optional"], "same": [t for t in x["same"] if t in own], "fixed": [t for t in x["fixed"] if t in marks], "page": x["page"] if x["page"] == y["page"] else None, "pages": x["pages"] + y["pages"], "chars": x["chars"] + y["chars"]}

    def rules(self) -> dict:
        """What reading a page needs: bodies, shapes, the texts that never change in them, which nodes stand in the host's container, and what marked articles are rid of."""
        never = [constant(x) for x in self.nodes]
        tokens, weights, owner = [], [], []
        for i, x in enumerate(self.nodes):
            # texts that every page has are not the slot's; a node of few pages weighs little of itself
            left = max(x["chars"] - x["pages"] * sum(map(len, never[i])), 0) if any(b == "#|" for b in x["body"]) else 0
            for b in x["body"]:
                signature, _, where = b[1:].rpartition("|")
                tokens.append((b[0], signature))
                weights.append(left if b[0] == "#" and not where else 0)
                left = 0 if weights[-1] else left
                owner.append(i)
        inside = in_container(tokens, weights) if any(weights) else []
        main = [False] * len(self.nodes)
        for i, (kind, _), own in zip(owner, tokens, inside, strict=False):
            main[i] |= own and kind == "#"
        fixed = {t for x in self.nodes if x["page"] is None and x["pages"] >= SHARED for t in x["fixed"]}
        beside, stack = [], []
        for x in self.nodes:
            opens = x["body"][0]
            beside.append(x["shape"][0] == "(" and opens[0] == "<" and opens.endswith("|main") and not any(r == "main" for _, r in stack))
            for b in x["body"]:
                name, _, where = b[1:].rpartition("|")
                if b[0] == "<":
                    stack.append((name, where))
                elif b[0] == ">" and (at := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)) is not None:
                    del stack[at:]
        return {"bodies": self.bodies, "shapes": [x["shape"] for x in self.nodes], "never": never, "main": main, "fixed": fixed, "beside": beside}


def known_nodes(nodes: list[Node], rules: dict) -> list[int | None]:
    """The wrapper's node for each node of a page, where they align."""
    shapes = [x[0] for x in nodes]
    if shapes == rules["shapes"]:
        return list(range(len(nodes)))
    known: list[int | None] = [None] * len(nodes)
    for a, b, size in SequenceMatcher(None, rules["shapes"], shapes, autojunk=False).get_matching_blocks():
        known[b : b + size] = range(a, a + size)
    return known


def of_article(tokens: list[tuple[str, str, str]], rules: dict) -> list[str]:
    """Marked texts of a page without what its host's wrapper knows as no slot.

    Repeated groups beside the article leave if the rest of the marked text is longer
    than they are; lines of all pages leave if more than half of the text stays.
    """
    texts = [(t[1], False) for t in tokens if shape(t) == "#|main"]
    if any(rules["beside"]):
        nodes = fold(tokens, set(rules["bodies"]))
        texts = [(t[1], i is not None and rules["beside"][i]) for node, i in zip(nodes, known_nodes(nodes, rules), strict=True) for t in node[1] if shape(t) == "#|main"]
        if 2 * sum(len(t) for t, aside in texts if aside) >= sum(len(t) for t, _ in texts):
            texts = [(t, False) for t, _ in texts]
    left = [t for t, aside in texts if not aside]
    if rules["fixed"]:
        own = [t for t in left if mark_of(t) not in rules["fixed"]]
        left = own if 2 * sum(map(len, own)) > sum(map(len, left)) else left
    return left


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of pages of one host, merged one after another."""
    out = Wrapper()
    for page in pages:
        out = out.merge(Wrapper.of(page))
    return out


def extract(page: str, rules: dict) -> str:
    """The main text of a page by its host's wrapper, two line ends between blocks.

    A page that marks its article (outside furniture, or at least outside furniture
    elements) gives the texts of it that are not the host's (``of_article``). On a page without marks, texts in slots of the
    host's container are main text, texts that the wrapper knows as the same on all
    pages or outside it are not, and texts it does not know are judged by the page's
    own container.
    """
    tokens = stream(page)
    for marked in (tokens, stream(page, True) if any(t[2] == "named" for t in tokens) else []):
        if any(shape(t) == "#|main" for t in marked):
            return "\n\n".join(of_article(marked, rules))
    nodes = fold(tokens, set(rules["bodies"]))
    known = known_nodes(nodes, rules)
    changing, places = [], []
    for node, i in zip(nodes, known, strict=True):
        gone = set(rules["never"][i]) if i is not None else ()
        changing += [len(t[1]) if shape(t) == "#|" and t[1] not in gone else 0 for t in node[1]]
        places += [i] * len(node[1])
    own = in_container([t[:2] for t in tokens], changing)
    host_knows = any(rules["main"][i] and w for i, w in zip(places, changing, strict=True) if i is not None)
    main = [w and (rules["main"][i] if host_knows and i is not None else mine) for w, i, mine in zip(changing, places, own, strict=True)]
    return "\n\n".join(t[1] for t, keep in zip(tokens, main, strict=True) if keep)


def host(url: Column) -> Column:
    """A URL's host in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from all rows of (host, html).

    Each task merges the pages of a host as it reads them and hands on one wrapper
    a host, or more if it meets very many hosts; partial wrappers are merged in
    SPREAD groups a host, then to one, so no task takes all partial wrappers of a hot host.
    """
    kinds = pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])

    def rows(found: dict[str, Wrapper]) -> pa.RecordBatch:
        task = TaskContext.get().partitionId()  # the same if the task runs again
        parts = [zlib.crc32(f"{h}:{task}".encode()) % SPREAD for h in found]
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip((list(found), parts, [w.dump() for w in found.values()]), kinds, strict=True)], schema=kinds)

    def read(batches):
        found: dict[str, Wrapper] = {}
        for block in blocks(batches, "html"):
            for name, page in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                found[name] = found.get(name, Wrapper()).merge(Wrapper.of(page))
            if len(found) > HOSTS:
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    def one(group: pa.Table) -> pa.Table:
        out = Wrapper()
        for text in sorted(group["wrapper"].to_pylist()):
            out = out.merge(Wrapper.load(text))
        return pa.table({"host": [group["host"][0].as_py()], "part": pa.array([0], pa.int32()), "wrapper": [out.dump()]})

    small_batches(pages.sparkSession)
    partial = pages.where(F.col("html") != "").select("host", "html").mapInArrow(read, "host string, part int, wrapper string")
    for keys in (["host", "part"], ["host"]):
        partial = partial.groupBy(*keys).applyInArrow(one, "host string, part int, wrapper string")
    return partial.select("host", "wrapper")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null html counts as empty and gives an empty text; pages without a host share
    one wrapper. Pages are read whole, however long. Unclosed and stray tags are mended as browsers do; a page that
    its host's wrapper does not fit is judged by its own marks. Repeated rows give
    a row each; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "wrappers")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    found = ws.put(wrappers(rows), "wrappers")
    small = (found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= SENT_BYTES
    joined = rows.join(F.broadcast(found) if small else found, "host", "left").select("page_id", "url", "html", "wrapper")

    def read(batches):
        none = Wrapper().rules()
        known: dict[str | None, dict] = {None: none}
        for block in blocks(batches, "html"):
            out = []
            for page, w in zip(block.column(2).to_pylist(), block.column(3).to_pylist(), strict=True):
                if w not in known:
                    known = {None: none} if len(known) > 1000 else known
                    known[w] = Wrapper.load(w).rules()
                out.append(extract(page, known[w]))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(spark)
    return joined.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")


def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
