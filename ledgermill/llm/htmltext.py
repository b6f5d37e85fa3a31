"""Main text of pages by tree scoring.

Paragraph blocks give points for length and commas to their parent and half to the grandparent,
scaled by one minus link density; an article or main has the points of all its blocks. The best
container grows to the outermost article or main around it; without one, a list, table, quote or
section grows to the page division that holds it. It keeps its blocks. Of its siblings, headings
and text of low link density stay, and divisions with a fifth of its score. Navigation, headers,
footers, forms, scripts and containers named as adverts, notices or comments are left out, and
outside an article or main also the links of containers that are mostly links.

Pages are read in one pass, whole and in linear time. Where </head> is left out, the first tag that
cannot stand in a head ends it. A tag that never closes is text; once a quoted value runs to the end of
the page, quotes no longer count. A null page, or one without text, gives an empty text. Rows are
judged one by one, so repeated rows and ids get a row each; null ids and urls pass through; columns
other than page_id, url and html are not read; an empty table gives no rows.
"""
import html as entities
import re
from collections import Counter
from functools import partial

from pyspark.sql import DataFrame

from .common import add_columns

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
SKIPPED = set("script style noscript template iframe svg nav header footer aside form button select textarea head title".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption".split()) | SKIPPED
WHOLE, DIVISION = {"article", "main"}, {"", "html", "body", "div", "td", "th"}
VOID = set("br hr img input meta link area base col embed source track wbr".split())
SENTENCE = 40
# Tags that may stand in a head.
HEADED = set("html head title style script meta link base noscript template".split())
NAMED = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:ads?|advert\w*|banner|cookies?|notice|sidebar|comments?|menu|promo|related|share|nav\w*|footer|header)\b", re.I)


def pieces(page):
    """(closing, tag, attributes or None, text) for each tag and run of text; comments and declarations are left out."""
    pos, size, quotes, tags = 0, len(page), True, True
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            at = size
        if at > pos:
            yield "", "", None, page[pos:at]
            pos = at
            continue
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = end + 3 if end >= 0 else size
            continue
        name = NAME.match(page, pos) if tags and not page.startswith(("<!", "<?"), pos) else None
        if page.startswith(("<!", "<?"), pos):
            end = page.find(">", pos)
            pos = end + 1 if end >= 0 else size
            continue
        end = -1
        if name:
            end = _tag_end(page, name.end(), quotes)
            if end < 0 and quotes:
                quotes, end = False, page.find(">", name.end())
            tags = end >= 0
        if end < 0:
            yield "", "", None, "<"
            pos += 1
            continue
        jump = yield name.group(1), name.group(2).lower(), page[name.end():end], ""
        pos = jump(end + 1) if jump else end + 1


def _tag_end(page, pos, quotes):
    """Place of the > that ends a tag, -1 if there is none."""
    if not quotes:
        return page.find(">", pos)
    while True:
        pos = PLAIN.match(page, pos).end()
        if pos >= len(page):
            return -1
        if page[pos] == ">":
            return pos
        pos = page.find(page[pos], pos + 1) + 1
        if not pos:
            return -1


def _heading(node):
    return node["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6")


def _owner(node):
    """The container that a block's points go to."""
    return node["up"] if _heading(node) or node["tag"] in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote") else node


def _raw_end(page, tag, pos):
    end = re.compile(f"</{tag}", re.I).search(page, pos)
    return end.start() if end else len(page)


def extract(page) -> str:
    if not page:
        return ""
    root = {"tag": "", "up": None, "skip": False, "score": 0.0, "points": 0.0, "size": 0, "linked": 0.0}
    at, blocks, links, nodes = root, [], 0, [root]
    text, linked = [], 0

    def close():
        nonlocal text, linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line and not at["skip"]:
            blocks.append((at, line, min(1.0, linked / len(line))))
        text, linked = [], 0

    opened, source, jump = Counter(), pieces(page), None
    while True:
        try:
            closing, tag, attributes, run = source.send(jump)
        except StopIteration:
            break
        jump = None
        if attributes is None:
            text.append(run)
            linked += len(run) if links else 0
            continue
        if opened["head"] and tag not in HEADED and not closing:
            # The end tag of the head may be left out.
            close()
            while opened["head"]:
                opened[at["tag"]] -= 1
                at = at["up"]
        if tag == "a":
            links = 0 if closing else 1
        elif tag in VOID:
            text.append(" ")
        elif tag in BLOCK:
            close()
            if closing:
                if opened[tag]:
                    while at["tag"] != tag:
                        opened[at["tag"]] -= 1
                        at = at["up"]
                    opened[tag] -= 1
                    at = at["up"]
                continue
            if at["tag"] == "p" or at["tag"] == tag == "li":
                opened[at["tag"]] -= 1
                at = at["up"]
            skip = at["skip"] or tag in SKIPPED or (tag not in ("html", "body", "article", "main") and bool(NAMED.search(attributes)))
            at = {"tag": tag, "up": at, "skip": skip, "score": 0.0, "points": 0.0, "size": 0, "linked": 0.0}
            opened[tag] += 1
            nodes.append(at)
            if tag in RAW:
                jump = partial(_raw_end, page, tag)
    close()
    if not blocks:
        return ""
    seen = []
    for node, line, density in blocks:
        points = (1 + line.count(",") + min(len(line) / 100, 3)) * (1 - density)
        node["points"] += points
        node["size"] += len(line)
        node["linked"] += len(line) * density
        owner = _owner(node)
        for part in (1.0, 0.5):
            if owner:
                owner["score"] += points * part
                seen.append(owner)
                owner = owner["up"]
    # Later nodes lie deeper, so each is whole before its parent takes its share.
    for node in reversed(nodes):
        if node["tag"] in WHOLE and node["size"]:
            node["score"] = max(node["score"], node["points"])
            seen.append(node)
        if node["up"]:
            for key in ("points", "size", "linked"):
                node["up"][key] += node[key]
    best = max(seen, key=lambda n: (n["score"], n["tag"] in WHOLE))
    top, node = best, best
    while node:
        top, node = node if node["tag"] in WHOLE else top, node["up"]
    whole = top["tag"] in WHOLE
    while not whole and top["tag"] not in DIVISION and not (top["tag"] == "section" and top["up"]["tag"] in ("", "html", "body")):
        top = top["up"]

    def beside(node):
        if node["score"] >= best["score"] / 5 > 0:
            return True
        light = node["linked"] < 0.5 * node["size"]
        # A division of a sentence or more in its own words belongs to the text; a shorter one may be anything.
        return light and node["size"] >= SENTENCE if node["tag"] in DIVISION else _heading(node) or light

    # Parents come before their children.
    top["kept"] = True
    for node in nodes:
        node["kept"] = node is top or bool(node["up"] and (node["up"]["kept"] or (node["up"] is top["up"] and beside(node))))

    def kept(node, density):
        if node is top["up"]:
            return density < 0.5
        if not whole and density >= 0.9:
            owner = _owner(node)
            if owner["linked"] >= 0.5 * owner["size"]:
                return False
        return node["kept"]

    return "\n".join(line for node, line, density in blocks if kept(node, density))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    def judge(pages):
        found = [extract(h) for h in pages]
        return found, [len(t) for t in found]

    return add_columns(pages.select("page_id", "url", "html"), ["page_id", "url"], ["html"], "text string, n_chars long", lambda: judge)
