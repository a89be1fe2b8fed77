"""HTML parsing with the standard library: contents, sections, abstract pages, page cleaning. For use in Pandas UDFs."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element, or a text (tag None), with its children."""

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []

    def walk(self):
        for c in self.children:
            yield c
            yield from c.walk()

    def find_all(self, tag: str, **attrs: str):
        return [n for n in self.walk() if n.tag == tag and all(n.attrs.get(k) == v or v in n.attrs.get(k, "").split() for k, v in attrs.items())]

    def texts(self, sep: str = "") -> str:
        return sep.join(n.text.strip() if sep else n.text for n in self.walk() if n.tag is None and (not sep or n.text.strip()))

    def render(self) -> str:
        if self.tag is None:
            return html.escape(self.text, quote=False)
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        inner = "".join(c.render() for c in self.children)
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(Node(None, text=data))


def parse(text: str | None) -> Node:
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root


def contents(text: str | None) -> list[dict]:
    """Entries (position, name, local) of a help archive's table of contents."""
    out = []
    for node in parse(text).find_all("object", type="text/sitemap"):
        params = {p.attrs.get("name", "").lower(): p.attrs.get("value", "") for p in node.find_all("param")}
        if params.get("local"):
            out.append({"position": len(out), "name": params.get("name", ""), "local": params["local"]})
    return out


def sections(text: str | None, box: str = "content") -> list[dict]:
    """Sections (position, title, text) of the element with id `box`: each h2 and what follows it."""
    found = next((n for n in parse(text).walk() if n.attrs.get("id") == box), None)
    out: list[dict] = []
    for node in found.children if found else []:
        if node.tag == "h2":
            out.append({"position": len(out), "title": node.texts(" "), "text": ""})
        elif out and node.tag is not None and (body := node.texts(" ")):
            out[-1]["text"] = f"{out[-1]['text']} {body}".strip()
    return out


def abstract_page(text: str | None) -> dict:
    """Title, authors, program, college, year and abstract of an abstract page; missing ones are None."""
    out: dict = dict.fromkeys(("title", "authors", "program", "college", "year", "abstract"))
    root = parse(text)
    box = next(iter(root.find_all("div", **{"class": "cont"})), None)
    if box is None:
        return out
    lines = [x for x in (s.replace("\xa0", " ").strip() for s in box.texts("\n").split("\n")) if x]
    heads = ("Title", "Researchers", "Degree", "Year", "Project Description")
    fields: dict[str, list[str]] = {}
    now = None
    for line in lines:
        head = next((h for h in heads if line.startswith(h)), None)
        if head:
            now = fields.setdefault(head, [])
        elif now is not None and (value := line.lstrip(":").strip()):
            now.append(value)
    if "Title" in fields:
        out["title"] = " ".join(fields["Title"])
    if "Researchers" in fields:
        out["authors"] = fields["Researchers"]
    if "Degree" in fields:
        out["program"] = " ".join(fields["Degree"])
        out["college"] = "College of Computer Studies" if "Computer Science" in out["program"] else None
    if fields.get("Year") and fields["Year"][0].isdigit():
        out["year"] = int(fields["Year"][0])
    if "Project Description" in fields:
        for parent in (root, *root.walk()):
            if box in parent.children:
                after = parent.children[parent.children.index(box) + 1 :]
                p = next((n for n in after if n.tag == "p"), None)
                out["abstract"] = p.texts().strip() if p else None
    return out


def clean_page(text: str | None, position: int, images: str = "Images/", logos: tuple[str, ...] = ()) -> str:
    """A page for merging: no div.hd, no first div.footer, no logos, images by lower-case name, a hidden heading first."""
    root = parse(text)
    body = next(iter(root.find_all("body")), root)
    footers = [0]

    def keep(node: Node) -> Node | None:
        kinds = node.attrs.get("class", "").split()
        if node.tag == "div" and "hd" in kinds:
            return None
        if node.tag == "div" and "footer" in kinds:
            footers[0] += 1
            if footers[0] == 1:
                return None
        if node.tag == "img":
            name = re.split(r"[\\/]", node.attrs.get("src", ""))[-1].lower()
            if name in logos:
                return None
            node.attrs["src"] = images + name
        node.children = [k for c in node.children if (k := keep(c)) is not None]
        return node

    keep(body)
    return f'<h2 id="section-{position}" style="display:none"></h2>' + "".join(c.render() for c in body.children)
