"""Untrusted post text to safe HTML: a small Markdown subset, bare links, and an allow-list by construction.

Only what is escaped or written here can appear, so no script, image or remote medium ever does.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A label has no brackets, and an address in brackets 2,048 characters at most, so that what opens often and never closes is scanned once.
_FENCE = re.compile(r"^\s*(```|~~~)")
_INLINE = re.compile(
    r"(?P<code>`+)(?P<body>.+?)(?P=code)|!\[(?P<alt>[^\[\]]*)\]\((?P<image>[^)\s]{1,2048})\)|\[(?P<label>[^\[\]]+)\]\((?P<target>[^)\s]{1,2048})\)"
    r"|(?P<url>https?://[^\s<>\"']+)|\*\*(?P<strong>[^*]+)\*\*|\*(?P<em>[^*\s][^*]*)\*",
    re.I,
)
# Marks that end an address.
#: An address ends before marks that end a sentence, quotes, and brackets that it didn't open.
_END = re.compile(r"""[.,;:!?”’'"]+$""")


def split_url(raw: str) -> tuple[str, str]:
    """(address, prose after it)."""
    end = _END.search(raw)
    size = end.start() if end else len(raw)
    depth = 0
    for letter in raw[:size]:
        depth += (letter == "(") - (letter == ")")
    if depth < 0 and raw[size - 1 : size] == ")":
        size -= 1
    return raw[:size], raw[size:]


def _link(target: str, label: str) -> str:
    return f'<a href="{html.escape(target)}" rel="noopener noreferrer">{label}</a>'


def inline(text: str) -> str:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        if m["code"]:
            out.append(f"<code>{html.escape(m['body'].strip(), quote=False)}</code>")
        elif m["image"]:
            alt = m["alt"].strip()
            out.append(html.escape(f"[image: {alt}]" if alt else "[image.png]", quote=False))
        elif m["target"]:
            label = html.escape(m["label"], quote=False)
            out.append(_link(m["target"], label) if m["target"].lower().startswith(("http://", "https://")) else label)
        elif m["url"]:
            url, after = split_url(m["url"])
            out.append(_link(url, html.escape(url, quote=False)) + html.escape(after, quote=False))
        elif m["strong"]:
            out.append(f"<strong>{inline(m['strong'])}</strong>")
        else:
            out.append(f"<em>{inline(m['em'])}</em>")
    return "".join(out) + html.escape(text[at:], quote=False)


_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*$")
_RULE = re.compile(r"\s*([-*_])\s*(\1\s*){2,}$")
_ITEM = re.compile(r"(?P<indent>\s*)(?P<mark>[-*+]|\d{1,9}[.)])\s+(?P<rest>.*)")
_UNDER = re.compile(r"(=+|-+)\s*$")


def _escaped(lines: list[str]) -> str:
    return html.escape("\n".join(lines), quote=False)


def _paragraph(lines: list[str]) -> str:
    """Lines stay lines; two spaces at an end break one."""
    shown = [inline(line.strip()) + ("<br>" if line.endswith("  ") and k + 1 < len(lines) else "") for k, line in enumerate(lines)]
    return f"<p>{chr(10).join(shown)}</p>"


def _span(lines: list[str], at: int, inside) -> int:
    """Where the run of lines from ``at`` that are ``inside`` ends."""
    while at < len(lines) and inside(lines[at]):
        at += 1
    return at


def _items(lines: list[str], at: int, level: int) -> tuple[str, int]:
    """A list that begins at a line, and where it ends; what is indented below an item belongs to it."""
    first = _ITEM.match(lines[at])
    depth, tag = len(first["indent"]), "ol" if first["mark"][0].isdigit() else "ul"
    out = []
    while at < len(lines):
        own = _ITEM.match(lines[at])
        if own is None or len(own["indent"]) != depth or own["mark"][0].isdigit() != (tag == "ol") or _RULE.match(lines[at]):
            break
        end = _span(lines, at + 1, lambda line: line.strip() and len(line) - len(line.lstrip()) > depth)
        below = [line[min(depth + 2, len(line) - len(line.lstrip())) :] for line in lines[at + 1 : end]]
        out.append(f"<li>{inline(own['rest'])}{chr(10) + blocks(below, level + 1) if below else ''}</li>")
        at = end
    return f"<{tag}>" + "".join(out) + f"</{tag}>", at


#: Quotes and lists inside each other; what lies deeper is text.
DEEPEST = 80


def blocks(lines: list[str], depth: int = 0) -> str:
    """Block structure, by recursion into quotes and lists."""
    out, at, plain = [], 0, []
    if depth > DEEPEST:
        return _paragraph(lines)

    def flush() -> None:
        if plain:
            out.append(_paragraph(plain))
            plain.clear()

    while at < len(lines):
        line = lines[at]
        if _FENCE.match(line):
            flush()
            end = _span(lines, at + 1, lambda x: not _FENCE.match(x))
            out.append(f"<pre><code>{_escaped(lines[at + 1 : end])}</code></pre>")
            at = end + 1
        elif line.lstrip().startswith(">"):
            flush()
            end = _span(lines, at, lambda x: x.lstrip().startswith(">"))
            out.append(f"<blockquote>{blocks([re.sub(r'^ *> ?', '', x) for x in lines[at:end]], depth + 1)}</blockquote>")
            at = end
        elif _HEADING.match(line):
            flush()
            heading = _HEADING.match(line)
            out.append(f"<h{len(heading[1])}>{inline(heading[2])}</h{len(heading[1])}>")
            at += 1
        elif plain and _UNDER.match(line):
            level = 1 if line[0] == "=" else 2
            title = plain.pop()
            flush()
            out.append(f"<h{level}>{inline(title.strip())}</h{level}>")
            at += 1
        elif _RULE.match(line):
            flush()
            out.append("<hr>")
            at += 1
        elif _ITEM.match(line) and not plain:
            made, at = _items(lines, at, depth)
            out.append(made)
        elif line.startswith(("    ", "\t")) and not plain:
            end = _span(lines, at, lambda x: x.startswith(("    ", "\t")))
            out.append(f"<pre><code>{_escaped([re.sub(r'^(    |' + chr(9) + ')', '', x) for x in lines[at:end]])}</code></pre>")
            at = end
        else:
            if line.strip():
                plain.append(line)
            else:
                flush()
            at += 1
    flush()
    return "\n".join(out)


def render(text: str | None) -> str:
    """Paragraphs, headings (a space after the hashes, or a line below; hashtags stay text), nested quotes and lists, rules, and fenced or indented code."""
    return blocks((text or "").splitlines())


#: Texts that are Python objects at a time.
SLICE = 256


@F.arrow_udf(T.StringType())
def rendered(texts: pa.Array) -> pa.Array:
    """In slices, so that no batch becomes Python objects as a whole."""
    made = [pa.array([render(t) for t in texts.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())
