"""Main text of web pages: wrappers inferred per host as union-free regular expressions over block structure."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import Scratch

# The names of HTML elements by their part in a page.
BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul noscript".split())
RAW = frozenset("script style textarea title svg iframe template canvas audio video select button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article section div body".split())
ASIDE = frozenset("nav footer aside form noscript menu dialog fieldset".split())
# Words in classes, ids and roles that mark what isn't the article.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADER_WORDS = frozenset("header banner masthead".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Items of two child lists above which a wrapper gives up their order, not what it knows of them; above FEW they are aligned by rows.
MOST_ORDERED, FEW_ITEMS = 4096, 60
#: Smallest hashes that a slot keeps, to tell how many different texts it holds.
SKETCH = 32
#: A slot whose texts recur so often over different pages (distinct texts a text on a page) is the host's own; a block or
#: slot of which so many characters are links leads elsewhere.
OWN, LINKS = 0.1, 0.6
#: Share of the text that changes from page to page which a block must hold for the article to be looked for inside it.
SHARE = 0.5
LEAF = re.compile(r"(p|h[1-6]|li|td|th|pre|blockquote|dt|dd|ul|ol|table|dl|figure)\b")


@dataclass
class Node:
    """A block: its key in wrappers, whether its marks set it aside, and its children: blocks, or (text, link characters)."""

    tag: str
    key: str = ""
    aside: bool = False
    children: list = field(default_factory=list)


def describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Key of a block (its name and classes without digits) and whether it is marked as not the article."""
    aside = tag in ASIDE
    if not attributes:
        return tag, aside
    words: list[str] = []
    key = tag
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            aside = True
        elif name in ("class", "id", "role"):
            words += re.split(r"[\s_\-:]+", value)
            if name == "class" or value == "main":
                key += "." + re.sub(r"\d+", "", value)
    marks = ASIDE_WORDS.intersection(words)
    if tag not in ("html", "body", "article", "main") and marks and not (marks <= HEADER_WORDS and tag in HEADINGS):
        aside = True
    return key, aside


def parse(source: str) -> Node:
    """Blocks of a page. Inline elements belong to the text around them; a block ends an open paragraph."""
    root = Node("#", "#")
    stack, buffer, linked, in_link, pos = [root], [], 0, False, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                stack[-1].children.append((text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(index: int) -> None:
        flush()
        del stack[index:]

    n = len(source)
    while pos < n:
        m = TOKEN.search(source, pos)
        if m is None:
            piece = source[pos:]
        else:
            piece = source[pos : m.start()]
        if piece:
            buffer.append(piece)
            if in_link:
                linked += len(piece)
        if m is None:
            break
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:-3])
            continue
        name = name.lower()
        closing = bool(m[1] or m[4])
        if name in RAW:
            if not closing and not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, pos)
                pos = end.end() if end else n
            continue
        if name not in BLOCKS:
            if name == "a":
                in_link = not closing
            elif name in ("br", "img", "wbr") and name != "wbr":
                buffer.append(" ")
            continue
        in_link = False
        if closing:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), None)
            if at is None:
                flush()
            else:
                close(at)
            continue
        flush()
        if stack[-1].tag == "p" or (name in HEADINGS and stack[-1].tag in HEADINGS):
            close(len(stack) - 1)
        if name in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[name]:
                    close(i)
                    break
                if stack[i].tag in SCOPES and not (name == "tr" and stack[i].tag in ("td", "th")):
                    break
        if name == "hr":
            continue
        key, aside = describe(name, m[3] if m[2] else m[6])
        node = Node(name, key, aside)
        stack[-1].children.append(node)
        stack.append(node)
    close(1)
    return root


#: Key of a group whose items stand in any order.
ANY = "(...)"

# Wrappers. An item is a dictionary: k its key ("#" for a text slot, "(...)" for a group), q its quantifier (1, "?",
# "+" or "*"), n the pages it was seen on, c the items inside; for a slot t and l the characters of text and of links
# in it, T the smallest hashes of its texts and P those of its texts with their pages, so that a page that occurs twice
# counts once. What is known of a slot is sums and sets: it doesn't depend on the order of pages.


def short_hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) >> 11


def item(node: Node | tuple, page: int = 0) -> dict:
    if isinstance(node, tuple):
        data = node[0].encode("utf-8", "surrogatepass")
        return {"k": "#", "q": "1", "n": 1, "t": len(node[0]), "l": node[1], "T": [short_hash(data)], "P": [short_hash(data, page)]}
    return {"k": node.key, "q": "1", "n": 1, "a": node.aside, "c": fold([item(c, page) for c in node.children])}


def union(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[:SKETCH]


def distinct(sketch: list[int]) -> float:
    """About how many values a sketch of the smallest hashes stands for; exactly, while they are few."""
    return len(sketch) if len(sketch) < SKETCH else (SKETCH - 1) / (sketch[-1] / 2**53)


def shape(items: list[dict]) -> str:
    """The regular expression of items, without what is known of their texts."""
    return " ".join(f"{x['k']}{x['q']}" + (f"<{shape(x['c'])}>" if "c" in x else "") for x in items)


def loosest(a: str, b: str) -> str:
    """The tightest quantifier that allows what either allows."""
    if a == b:
        return a
    return "*" if (a in "?*" or b in "?*") and (a in "+*" or b in "+*") else ("?" if "?" in (a, b) else "+")


def merge(a: dict, b: dict, same_page: bool = False) -> dict:
    """One item for two of the same key; slots of different text become variable."""
    out = {"k": a["k"], "q": loosest(a["q"], b["q"]), "n": max(a["n"], b["n"]) if same_page else a["n"] + b["n"]}
    if a["k"] == "#":
        return out | {"t": a["t"] + b["t"], "l": a["l"] + b["l"], "T": union(a["T"], b["T"]), "P": union(a["P"], b["P"])}
    return out | {"a": a.get("a", False) and b.get("a", False), "c": align(a["c"], b["c"], same_page)}


def align(a: list[dict], b: list[dict], same_page: bool = False) -> list[dict]:
    """Two child lists as one: a longest common subsequence is merged, what stands alone becomes optional."""
    ka, kb = [x["k"] for x in a], [x["k"] for x in b]
    if ANY in ka or ANY in kb:
        return [unordered(a, b, same_page)]
    if ka == kb:
        return [merge(x, y, same_page) for x, y in zip(a, b, strict=True)]
    if len(ka) + len(kb) > MOST_ORDERED:
        return [unordered(a, b, same_page)]
    first = preferred(ka, kb)
    out, i, j = [], 0, 0
    while i < len(ka) or j < len(kb):
        if i < len(ka) and j < len(kb) and ka[i] == kb[j]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == len(kb) or (i < len(ka) and first[i][j]):
            out.append(a[i] if a[i]["q"] in "?*" else a[i] | {"q": loosest(a[i]["q"], "?")})
            i += 1
        else:
            out.append(b[j] if b[j]["q"] in "?*" else b[j] | {"q": loosest(b[j]["q"], "?")})
            j += 1
    return fold(out)


def preferred(ka: list[str], kb: list[str]):
    """By places (i, j) in two lists, whether a longest common subsequence of what follows may leave out ka[i] first."""
    if len(ka) + len(kb) <= FEW_ITEMS:
        best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
        for i in range(len(ka) - 1, -1, -1):
            for j in range(len(kb) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
        return [[x >= y for x, y in zip(below, own[1:], strict=False)] for own, below in zip(best, best[1:], strict=False)]
    number = {k: n for n, k in enumerate(dict.fromkeys([*ka, *kb]))}
    a, b = (np.array([number[k] for k in keys], np.int32) for keys in (ka, kb))
    out = np.empty((len(a), len(b)), bool)
    below = np.zeros(len(b) + 1, np.int32)
    for i in range(len(a) - 1, -1, -1):
        own = below.copy()
        own[:-1] = np.maximum(below[:-1], below[1:] + (b == a[i]))
        own = np.maximum.accumulate(own[::-1])[::-1]
        out[i] = below[:-1] >= own[1:]
        below = own
    return out


def unordered(a: list[dict], b: list[dict], same_page: bool = False) -> dict:
    """A group that repeats, with one item for each key of two child lists: all that is known but the order."""

    def by_key(items: list[dict], out: dict[str, dict]) -> dict[str, dict]:
        for x in items:
            if x["k"].startswith("("):
                by_key(x["c"], out)
            else:
                out[x["k"]] = merge(out[x["k"]], x, True) if x["k"] in out else x
        return out

    left, right = by_key(a, {}), by_key(b, {})
    both = {k: merge(x, right[k], same_page) if k in right else x for k, x in left.items()} | {k: x for k, x in right.items() if k not in left}
    out = [x | {"q": "*"} for x in both.values()]
    return {"k": ANY, "q": "*", "n": max((x["n"] for x in out), default=0), "a": False, "c": out}


def fold(items: list[dict]) -> list[dict]:
    """Runs of one item, or of a group of up to four, that repeat become one that repeats."""
    for size in (1, 2, 3, 4):
        out: list[dict] = []
        i = 0
        while i < len(items):
            body = items[i : i + size]
            keys = [x["k"] for x in body]
            j, times = i + size, 1
            while len(body) == size and [x["k"] for x in items[j : j + size]] == keys and (size == 1 or len(set(keys)) > 1):
                body = [merge(x, y, True) for x, y in zip(body, items[j : j + size], strict=True)]
                j, times = j + size, times + 1
            if times == 1:
                out.append(items[i])
                i += 1
            elif size == 1:
                out.append(body[0] | {"q": loosest(body[0]["q"], "+")})
                i = j
            else:
                out.append({"k": "(" + " ".join(keys) + ")", "q": "+", "n": max(x["n"] for x in body), "a": False, "c": body})
                i = j
        items = out
    return items


def walk(items: list[dict], path: str = "") -> Iterator[tuple[str, dict]]:
    """Items with their paths; groups add nothing to a path."""
    for x in items:
        here = path if x["k"].startswith("(") else f"{path}/{x['k']}"
        yield here, x
        yield from walk(x.get("c", []), here)


def slots(x: dict) -> Iterator[dict]:
    if x["k"] == "#":
        yield x
    for c in x.get("c", []):
        yield from slots(c)


def is_own(x: dict) -> bool:
    """Whether a slot's texts are the host's own, by their variability, or lead elsewhere, by their links."""
    return distinct(x["T"]) <= OWN * distinct(x["P"]) or x["l"] >= LINKS * x["t"]


def variable_text(x: dict) -> int:
    """Characters of text that changes between pages and is no link."""
    return sum(y["t"] - y["l"] for y in slots(x) if not is_own(y))


def flat(items: list[dict]) -> list[dict]:
    """Items with those of groups in place of the groups."""
    return [y for x in items for y in (flat(x["c"]) if x["k"].startswith("(") else [x])]


def is_named(x: dict) -> bool:
    return bool(re.match(r"article\b|main\b", x["k"])) or x["k"].endswith(".main")


def article(wrapper: list[dict]) -> str | None:
    """The path of the block that holds the article.

    From the top, the block is entered that holds most of the text that changes from page to page, blocks that few
    pages have counting less (within a tenth of the text, one that isn't marked as something else is preferred), while it
    holds at least SHARE of what is there. Then the block around is taken instead,
    as long as all that changes in it besides lies in paragraphs, headings and the like (a title above the text), and
    at last, if a block around that is no more than the body's is named as an article or main part, that one: between
    these levels the texts' variability doesn't decide, and names do. So they do on a host whose pages all have the same
    article: it is more text than all that changes.
    """
    still = [(sum(y["t"] - y["l"] for y in slots(x)), p) for p, x in walk(wrapper) if is_named(x) and not variable_text(x)]
    if still and max(still)[0] > sum(map(variable_text, wrapper)):
        return max(still)[1]
    pages = max((x["n"] for x in wrapper), default=1)
    chain: list[tuple[str, dict]] = []
    items, path = flat(wrapper), ""
    while inner := [x for x in items if x["k"] != "#"]:
        text = {id(x): variable_text(x) for x in items}
        total = sum(text.values())
        weight = {id(x): text[id(x)] * min(1.0, x["n"] / pages) ** 2 for x in inner}
        top = max(inner, key=lambda x: (round(10 * weight[id(x)] / max(total, 1)), not x.get("a"), weight[id(x)], x["k"]))
        if not text[id(top)] or text[id(top)] < SHARE * total or LEAF.match(top["k"]):
            break
        path, items = f"{path}/{top['k']}", flat(top["c"])
        chain.append((path, top))
    k = len(chain) - 1
    while k > 0 and not re.match(r"(body|html)\b", chain[k - 1][1]["k"]):
        beside = [x for x in flat(chain[k - 1][1]["c"]) if x is not chain[k][1] and variable_text(x) and not x.get("a")]
        if any(x["k"] != "#" and not LEAF.match(x["k"]) for x in beside):
            break
        k -= 1
    named = [i for i in range(k + 1) if is_named(chain[i][1])]
    return chain[named[-1] if named else k][0] if chain else None


def rules(wrapper: list[dict]) -> dict:
    """What extraction needs of a host's wrapper: the article's path, and the paths of slots and blocks that aren't of it.

    These are slots of the host's own texts, and blocks most of whose text is links. A path that stands for several
    items of the wrapper is judged by all of them.
    """
    by_path: dict[str, list[dict]] = {}
    for path, x in walk(wrapper):
        if not x["k"].startswith("("):
            by_path.setdefault(path, []).append(x)
    drop = []
    for path, own in by_path.items():
        inside = [y for x in own for y in slots(x)]
        total, links = sum(y["t"] for y in inside), sum(y["l"] for y in inside)
        joined = {"t": total, "l": links, "T": [], "P": []}
        for y in inside:
            joined |= {"T": union(joined["T"], y["T"]), "P": union(joined["P"], y["P"])}
        if total and (is_own(joined) if own[0]["k"] == "#" else links >= LINKS * total):
            drop.append(path)
    return {"root": article(wrapper), "drop": sorted(drop)}


def blocks(node: Node, path: str, drop: set[str], out: list[str], header: bool = False) -> None:
    """Texts of the blocks inside, in page order, without what is dropped or set aside; of a header only its headings."""
    for c in node.children:
        if isinstance(c, tuple):
            if (not header or node.tag in HEADINGS) and f"{path}/#" not in drop:
                out.append(c[0])
        elif not c.aside and f"{path}/{c.key}" not in drop:
            blocks(c, f"{path}/{c.key}", drop, out, header or c.tag == "header")


def find(node: Node, path: str, want) -> list[tuple[Node, str]]:
    """Outermost blocks, with their paths, that `want` accepts."""
    out = []
    for c in node.children:
        if isinstance(c, Node):
            here = f"{path}/{c.key}"
            out += [(c, here)] if want(c, here) else find(c, here, want)
    return out


def extract(page: Node, rule: dict | None) -> str:
    """Main text of a parsed page: of the blocks at the host's article path, else of its own article, else of its body.

    Where nothing is left of a page's article, as on a host all of whose pages have the same, what its host's pages have
    in common stays.
    """
    rule = rule or {"root": None, "drop": []}
    roots = find(page, "", lambda c, p: p == rule["root"]) if rule["root"] else []
    roots = roots or find(page, "", lambda c, p: not c.aside and (c.tag in ("article", "main") or c.key.endswith(".main")))
    if not roots:
        roots = find(page, "", lambda c, p: c.tag == "body") or [(page, "")]
    for drop in (set(rule["drop"]), set()):
        out: list[str] = []
        for node, path in roots:
            blocks(node, path, drop, out)
        if out:
            break
    return "\n\n".join(out)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers of one page each, those of a host and shape as one: (host, shape, wrapper)."""
    known: dict[tuple[str, str], list[dict]] = {}

    def out() -> pd.DataFrame:
        df = pd.DataFrame({"host": [h for h, _ in known], "shape": [x for _, x in known], "wrapper": [json.dumps(w) for w in known.values()]})
        known.clear()
        return df

    for df in batches:
        for url, source in zip(df["url"], df["html"], strict=True):
            source = source or ""
            page = short_hash(source.encode("utf-8", "surrogatepass"))
            own = fold([item(c, page) for c in parse(source).children])
            key = host(url), xxhash.xxh3_128_hexdigest(shape(own).encode("utf-8", "surrogatepass"))
            known[key] = same_shape(known[key], own) if key in known else own
        if len(known) > 500:
            yield out()
    if known:
        yield out()


def same_shape(a: list[dict], b: list[dict]) -> list[dict]:
    """Two wrappers of one shape as one: item by item."""
    return [merge(x, y) if x["k"] == "#" else merge(x | {"c": []}, y | {"c": []}) | {"c": same_shape(x["c"], y["c"])} for x, y in zip(a, b, strict=True)]


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers that come sorted by host, salt and shape, to one of each host and salt: those of one shape first become
    one, then the shapes are aligned in their order."""
    last = shape_ = None
    whole: list[dict] | None = None
    part: list[dict] | None = None

    def joined() -> list[dict]:
        return part if whole is None else align(whole, part)

    def row() -> pd.DataFrame:
        return pd.DataFrame({"host": [last[0]], "shape": [shape_], "salt": [last[1]], "wrapper": [json.dumps(joined())]})

    for df in batches:
        for h, salt, x, w in zip(df["host"], df["salt"], df["shape"], df["wrapper"], strict=True):
            own = json.loads(w)
            if (h, salt) != last:
                if last is not None:
                    yield row()
                last, whole, part, shape_ = (h, salt), None, own, x
            elif x == shape_:
                part = same_shape(part, own)
            else:
                whole, part, shape_ = joined(), own, x
    if last is not None:
        yield row()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per host, from all its pages: (host, wrapper as JSON).

    Pages of one shape are one first, within their tasks. The shapes of a host are then aligned in the order of their
    hashes, in 256 groups, whose wrappers are aligned in 16, and these in one. Which shapes meet, and in which order,
    depends on the pages alone, neither on their order nor on how they are dealt out.
    """
    kind = "host string, shape string, salt int, wrapper string"
    part = pages.select("url", "html").mapInPandas(learn, "host string, shape string, wrapper string")
    part = part.withColumn("salt", F.pmod(F.crc32(F.col("shape").cast("binary")), F.lit(256)).cast("int"))
    for most in (16, 1, None):
        part = part.repartition("host", "salt").sortWithinPartitions("host", "salt", "shape").select("host", "shape", "salt", "wrapper").mapInPandas(combine, kind)
        if most:
            part = part.withColumn("shape", F.concat(F.lpad(F.col("salt").cast("string"), 4, "0"), "shape")).withColumn("salt", F.pmod("salt", F.lit(most)))
    return part.select("host", "wrapper")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points of text).

    A host's wrapper tells where the article is and what in it is not of it (see article and rules); names of tags,
    classes and roles set aside what remains: scripts, forms, and blocks that are marked as a menu, an advert or comments.
    The order of pages and how they are dealt out change nothing, nor do pages that occur several times.
    Character references are decoded, white space inside a block is one space, blocks are joined by an empty line. Null
    and empty pages have an empty text; a null or odd url is the host "". Unclosed elements and pages that end within
    an element are read as far as they go. Equal rows give equal rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "wrappers")
    wrappers = scratch.keep(infer_wrappers(pages), "wrappers")

    def ruled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in filter(len, batches):
            yield pd.DataFrame({"host_": df["host"], "rule": [json.dumps(rules(json.loads(w))) for w in df["wrapper"]]})

    found = scratch.keep(wrappers.mapInPandas(ruled, "host_ string, rule string"), "rules")
    own = F.pandas_udf(lambda urls: urls.map(host), "string")  # wrappers are known by this function's hosts
    joined = pages.select("page_id", "url", "html", own("url").alias("h_")).join(found, F.col("h_") == F.col("host_"), "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, dict] = {}
        for df in filter(len, batches):
            out = []
            for rule, source in zip(df["rule"], df["html"], strict=True):
                if rule is not None and rule not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[rule] = json.loads(rule)
                out.append(extract(parse(source or ""), cache[rule] if rule is not None else None))
            yield pd.DataFrame({"page_id": df["page_id"], "url": df["url"], "text": out, "n_chars": [len(t) for t in out]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "rule").mapInPandas(texts, f"page_id {kind}, url string, text string, n_chars long")
