"""One page to nodes: the only step that HTML forces out of built-in expressions.

Small on purpose: one pattern finds tags, the tree repairs what forum and article pages get wrong (unclosed
paragraphs, cells, list items and inline marks), and selectors cover what page profiles use.
"""

from __future__ import annotations

import re
from html import unescape

# Fixed values from the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style"}
HEAD_ONLY = set("base link meta title style script".split())
INLINE_MARKS = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set(
    "address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " li main menu nav ol p pre section table ul dd dt".split()
)
# A start tag on the left ends an open element on the right, unless a boundary element is met first.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "table"}),
    "dd": ({"dd", "dt"}, {"dl", "table"}),
    "dt": ({"dd", "dt"}, {"dl", "table"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
P_BOUNDARY = {"table", "td", "th", "button", "caption", "body"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Elements below this one in document order."""
        stack = [child for child in reversed(self.children) if not isinstance(child, str)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(child for child in reversed(node.children) if not isinstance(child, str))

    def text(self):
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def inner_html(self):
        """Serialised children: attributes in double quotes, void elements as <br/>."""
        parts, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                parts.append(node[0])
            elif isinstance(node, str):
                parts.append(escape(node))
            else:
                parts.append("<" + node.tag + "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items()))
                if node.tag in VOID:
                    parts.append("/>")
                else:
                    parts.append(">")
                    stack.append((f"</{node.tag}>",))
                    raw = node.tag in RAW
                    stack.extend((c,) if raw and isinstance(c, str) else c for c in reversed(node.children))
        return "".join(parts)


def escape(text):
    # The five characters the serialiser writes as entities.
    for char, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        if char in text:
            text = text.replace(char, entity)
    return text


# A comment, a declaration, an end tag, or a start tag with its attributes. A quote counts only after "=".
_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|/([a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# In attributes, a reference without ";" that runs on into a word or "=" is plain text, as in query strings.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(?:;|(?![=A-Za-z0-9]))")
# Elements whose content is text up to their end tag; references count in the last two.
_TEXT_ONLY = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style", "title", "textarea")}


def _attributes(text):
    values = {}
    for name, double, single, bare in _ATTR.findall(text):
        value = double or single or bare
        if "&" in value:
            value = _REFERENCE.sub(lambda found: unescape(found[0]), value)
        values.setdefault(name.lower(), value)
    return values


class TreeBuilder:
    def __init__(self):
        self.root = Node("#document", {}, None)
        self.html = self.add("html", {}, self.root)
        self.head = self.add("head", {}, self.html)
        self.body = self.add("body", {}, self.html)
        self.open, self.in_body, self.reopen = [self.head], False, []

    def feed(self, text):
        at = 0
        # Without a ">" ahead no tag ends any more, so the search stops at the last one.
        last = text.rfind(">") + 1
        while found := _TAG.search(text, at, last):
            if found.start() > at:
                self.data(unescape(text[at : found.start()]))
            at = found.end()
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                at = len(text)
            elif found[1]:
                self.end(found[1].lower())
            elif found[2]:
                tag = found[2].lower()
                self.start(tag, _attributes(found[3]) if found[3] else {})
                if tag in _TEXT_ONLY:
                    close = _TEXT_ONLY[tag].search(text, at)
                    stop = close.start() if close else len(text)
                    if stop > at:
                        self.data(text[at:stop] if tag in RAW else unescape(text[at:stop]))
                    at = stop
        if at < len(text):
            self.data(unescape(text[at:]))

    @staticmethod
    def add(tag, attrs, parent):
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        return node

    def enter_body(self):
        if not self.in_body:
            self.in_body, self.open = True, [self.body]

    def pop_through(self, index):
        """Close open elements down to ``index``; inline marks cut off that way start again in what follows."""
        closed, self.open = self.open[index:], self.open[:index]
        for mark in ((n.tag, n.attrs) for n in closed[1:] if n.tag in INLINE_MARKS):
            # Of equal marks no more than three start again, as the HTML standard has it.
            if self.reopen.count(mark) < 3:
                self.reopen.append(mark)

    def end_implied(self, tags, boundary):
        for index in range(len(self.open) - 1, 0, -1):
            if self.open[index].tag in tags:
                return self.pop_through(index)
            if self.open[index].tag in boundary:
                return None
        return None

    def resume_marks(self):
        marks, self.reopen = self.reopen, []
        for tag, attrs in marks:
            self.open.append(self.add(tag, dict(attrs), self.open[-1]))

    def start(self, tag, values):
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for key, value in values.items():
                target.attrs.setdefault(key, value)
            if tag == "body":
                self.enter_body()
            return
        if not self.in_body and tag not in HEAD_ONLY:
            self.enter_body()
        if tag in CLOSES_P:
            self.end_implied({"p"}, P_BOUNDARY)
        if tag in IMPLIED_END:
            self.end_implied(*IMPLIED_END[tag])
        top = self.open[-1].tag
        if tag == "tr" and top == "table":
            self.open.append(self.add("tbody", {}, self.open[-1]))
        elif tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                self.open.append(self.add("tbody", {}, self.open[-1]))
            self.open.append(self.add("tr", {}, self.open[-1]))
        if tag == "a":
            self.reopen = [mark for mark in self.reopen if mark[0] != "a"]
        if self.reopen and tag not in CLOSES_P and tag not in IMPLIED_END:
            self.resume_marks()
        node = self.add(tag, values, self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def end(self, tag):
        if tag == "head":
            self.enter_body()
        if tag in ("html", "head", "body") or tag in VOID:
            return
        if tag in INLINE_MARKS:
            waiting = [i for i, mark in enumerate(self.reopen) if mark[0] == tag]
            if waiting:
                del self.reopen[waiting[-1]]
                return
        for index in range(len(self.open) - 1, 0, -1):
            if self.open[index].tag == tag:
                return self.pop_through(index)
            if self.open[index].tag in ("td", "th", "table") and tag in INLINE_MARKS | {"p", "div", "li"}:
                return None
        if tag == "p" and self.in_body:
            self.add("p", {}, self.open[-1])
        return None

    def data(self, data):
        if not self.in_body and self.open[-1] is self.head:
            if not data.strip():
                return
            self.enter_body()
        if self.reopen and data.strip():
            self.resume_marks()
        parent = self.open[-1]
        if parent.children and isinstance(parent.children[-1], str):
            parent.children[-1] += data
        else:
            parent.children.append(data)


def parse(text):
    builder = TreeBuilder()
    builder.feed(text or "")
    return builder.root


_SIMPLE = re.compile(
    r"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|:nth-child\((?P<nth>\d+)\)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)(?P<q>["']?)(?P<val>[^\]"']*)(?P=q))?\]|(?P<tag>\*|[A-Za-z][\w-]*)"""
)
_compiled = {}


def compile_selector(selector):
    """List of alternatives, each a list of compound selectors joined by descent; None if not understood."""
    if selector not in _compiled:
        try:
            _compiled[selector] = [[_compound(part) for part in _parts(alt)] for alt in re.split(r",(?![^\[]*\])", selector)]
        except ValueError:
            _compiled[selector] = None
    return _compiled[selector]


def _parts(text):
    parts = re.findall(r"(?:\[[^\]]*\]|\S)+", text)
    if not parts:
        raise ValueError(text)
    return parts


def _compound(text):
    """(tag, class, attribute, tests): what an element must have, and predicates for the rest."""
    tag = cls = attr = None
    tests, at = [], 0
    while at < len(text):
        match = _SIMPLE.match(text, at)
        if not match or (match["tag"] and at):
            raise ValueError(text)
        at = match.end()
        if match["tag"]:
            tag = match["tag"].lower() if match["tag"] != "*" else None
        elif match["nth"]:
            tests.append(_nth_test(int(match["nth"])))
        elif match["cls"]:
            cls = cls or match["cls"]
            tests.append(_attr_test("class", "~=", match["cls"]))
        else:
            name, op, value = ("id", "=", match["id"]) if match["id"] else (match["attr"], match["op"], match["val"])
            attr = attr or name
            tests.append(_attr_test(name, op, value))
    return tag, cls, attr, tests


def _attr_test(name, op, want):
    # As in CSS, an empty value matches nothing but equality.
    compare = {
        None: lambda have: True,
        "=": lambda have: have == want,
        "*=": lambda have: want != "" and want in have,
        "^=": lambda have: want != "" and have.startswith(want),
        "$=": lambda have: want != "" and have.endswith(want),
        "~=": lambda have: want in have.split(),
    }[op]
    return lambda node: name in node.attrs and compare(node.attrs[name])


def _nth_test(nth):
    def test(node):
        elements = [child for child in node.parent.children if not isinstance(child, str)]
        return 1 <= nth <= len(elements) and elements[nth - 1] is node

    return test


def _fits(node, compound):
    tag, _, _, tests = compound
    return (tag is None or node.tag == tag) and all(test(node) for test in tests)


def _under(node, chain):
    """Do the ancestors of ``node`` fit the compounds in ``chain``, nearest last?"""
    left = len(chain)
    while left:
        node = node.parent
        if node is None:
            return False
        if node.tag != "#document" and _fits(node, chain[left - 1]):
            left -= 1
    return True


class Scope:
    """The elements below a node, in document order, with those of a tag, class or attribute at hand."""

    __slots__ = ("by_attr", "by_class", "by_tag", "nodes")

    def __init__(self, root):
        self.nodes, self.by_tag, self.by_class, self.by_attr = list(root.walk()), {}, {}, {}
        for node in self.nodes:
            self.by_tag.setdefault(node.tag, []).append(node)
            for name in node.attrs:
                self.by_attr.setdefault(name, []).append(node)
            if "class" in node.attrs:
                for name in set(node.attrs["class"].split()):
                    self.by_class.setdefault(name, []).append(node)

    def _candidates(self, compound):
        tag, cls, attr, _ = compound
        if cls:
            return self.by_class.get(cls, ())
        if attr and not tag:
            return self.by_attr.get(attr, ())
        return self.by_tag.get(tag, ()) if tag else self.nodes

    def select(self, selector):
        """Elements that fit the selector."""
        alternatives = compile_selector(selector)
        if alternatives is None:
            return []
        if len(alternatives) == 1:
            *above, last = alternatives[0]
            return [n for n in self._candidates(last) if _fits(n, last) and (not above or _under(n, above))]
        return [n for n in self.nodes if any(_fits(n, alt[-1]) and _under(n, alt[:-1]) for alt in alternatives)]
