"""Markdown text of one parsed element; called from the page parsing step, which already holds the tree."""

from __future__ import annotations

import re
from urllib.parse import urljoin

BLOCKS = set(
    "address article aside center dd details div dl dt fieldset figure footer form header main nav p section table"
    " tbody thead tfoot tr".split()
)
SKIPPED = {"script", "style", "head", "iframe", "noscript", "template", "input", "textarea"}
WRAPS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "strike": "~~"}
_SPACES = re.compile(r"[ \t\r\n\f]+")
_MARKS = re.compile(r"([\\`*_\[\]])")
_LINE_START = re.compile(r"^(#{1,6}(?=\s|$)|[>+-](?=\s|$)|>)")
_NUMBERED = re.compile(r"^(\d+)([.)])(?=\s|$)")


def resolve(url, root):
    url = url.strip()
    try:
        return urljoin(root, url) if root and url else url
    except ValueError:
        return url


def plain(text):
    return _MARKS.sub(r"\\\1", _SPACES.sub(" ", text))


def guard_line(line):
    """Keep the start of a text line from reading as a heading, quote or list."""
    return _NUMBERED.sub(r"\1\\\2", _LINE_START.sub(r"\\\1", line))


def _completed(call):
    """Result of a generator that yields the calls it waits for: recursion as deep as the page, without the stack's limit."""
    waiting, result = [call], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as done:
            waiting.pop()
            result = done.value
    return result


def blocks_of(node, root):
    """Blocks of an element, as Markdown strings. Text runs become paragraphs. Yields what it waits for."""
    done, run = [], []

    def flush():
        joined = re.sub(r" *\x00 *", "\x00", re.sub(r" {2,}", " ", "".join(run))).strip(" \x00")
        run.clear()
        if joined:
            done.append("  \n".join(guard_line(line) for line in joined.split("\x00")))

    for child in node.children:
        if isinstance(child, str):
            run.append(plain(child))
            continue
        tag = child.tag
        if tag in SKIPPED:
            continue
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            flush()
            title = " ".join(" ".join((yield blocks_of(child, root))).split())
            if title:
                done.append("#" * int(tag[1]) + " " + title)
        elif tag in ("ul", "ol"):
            flush()
            items = [c for c in child.children if not isinstance(c, str) and c.tag == "li"]
            lines = []
            for number, item in enumerate(items, 1):
                mark = "- " if tag == "ul" else f"{number}. "
                body = re.sub(r"\n(?=[^\n])", "\n" + " " * len(mark), "\n\n".join((yield blocks_of(item, root))))
                lines.append(mark + body)
            if lines:
                done.append("\n".join(lines))
        elif tag == "blockquote":
            flush()
            inner = "\n\n".join((yield blocks_of(child, root)))
            if inner:
                done.append("\n".join(("> " + line).rstrip() for line in inner.split("\n")))
        elif tag == "pre":
            flush()
            done.append("```\n" + child.text().strip("\n") + "\n```")
        elif tag == "hr":
            flush()
            done.append("* * *")
        elif tag in BLOCKS or tag in ("td", "th", "li"):
            flush()
            done.extend((yield blocks_of(child, root)))
        elif has_block(child):
            flush()
            done.extend((yield blocks_of(child, root)))
        else:
            run.append((yield inline(child, root)))
    flush()
    return done


def has_block(node):
    return any(
        n.tag in BLOCKS or n.tag in ("ul", "ol", "li", "blockquote", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6")
        for n in node.walk()
    )


def inline(node, root, active=()):
    tag = node.tag
    if tag in SKIPPED:
        return ""
    if tag == "br":
        return "\x00"
    if tag == "img":
        source = resolve(node.attrs.get("src", ""), root)
        alt = node.attrs.get("alt", "").replace("\n", " ").replace("]", "\\]")
        return f"![{alt}]({source})" if source else ""
    if tag == "code":
        text = node.text()
        return f"`{text}`" if text else ""
    mark = WRAPS.get(tag)
    within = active if mark is None or mark in active else (*active, mark)
    parts = []
    for c in node.children:
        parts.append(plain(c) if isinstance(c, str) else (yield inline(c, root, within)))
    inner = "".join(parts)
    if tag == "a":
        target = resolve(node.attrs.get("href", ""), root)
        return f"[{inner.strip()}]({target})" if target and inner.strip() else inner
    if mark and mark not in active and inner.strip(" \x00"):
        # Marks hug their text; outer spaces and breaks stay outside.
        core = inner.strip(" \x00")
        start = inner.index(core)
        return inner[:start] + mark + core + mark + inner[start + len(core) :]
    return inner


def to_markdown(node, root):
    return "\n\n".join(_completed(blocks_of(node, root)))
