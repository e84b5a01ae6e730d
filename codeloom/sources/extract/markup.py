"""HTML, XML, JSON, Markdown, YAML and regular expressions as symbols."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from codeloom.sources.extract import Symbol

#: Element names by role.
ROLES = {
    "semantic": ("article", "aside", "footer", "header", "main", "nav", "section", "figure", "time"),
    "form": ("form", "input", "button", "select", "textarea", "label", "fieldset", "option"),
    "media": ("img", "video", "audio", "picture", "source", "canvas", "svg", "iframe"),
    "interactive": ("details", "dialog", "summary", "menu"),
}
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Symbol] = []

    def handle_starttag(self, tag, attrs):
        line, column = self.getpos()
        line -= 1
        have = {k: v or "" for k, v in attrs}
        classes = have.get("class", "").split()
        add = lambda name, kind, **more: self.out.append(Symbol(name, kind, line, column, line, column, **more))
        if tag == "script":
            add(f"script[src={have['src']}]" if "src" in have else "script[inline]", "Function", modifiers=["script"])
        elif tag == "style":
            add("style[inline]", "Namespace", modifiers=["style"])
        else:
            name = f"{tag}#{have['id']}" if have.get("id") else f"{tag}.{classes[0]}" if classes else tag
            roles = [r for r, tags in ROLES.items() if tag in tags] + (["custom"] if "-" in tag else [])
            more = [f"id={have['id']}"] if have.get("id") else []
            add(name, "Class", modifiers=["element", tag, *roles, *more, *([f"class={have['class']}"] if classes else [])])
        for k, v in have.items():
            add(k, "Field", modifiers=["attribute"], signature=f"{k}={v}")
        if have.get("id"):
            add(f"#{have['id']}", "Variable", modifiers=["id"])
        for c in dict.fromkeys(classes):
            add(f".{c}", "Class", modifiers=["class"])

    def handle_decl(self, decl):
        line, column = self.getpos()
        self.out.append(Symbol(decl, "Constant", line - 1, column, line - 1, column, modifiers=["doctype"]))


def html(content: str) -> list[Symbol]:
    p = _Html()
    p.feed(content)
    p.close()
    return p.out


XML_TAG = re.compile(r"<(\?[\w:-]+|!DOCTYPE\s+[\w:-]+|!ENTITY\s+%?\s*[\w:-]+|!ELEMENT\s+[\w:-]+|!ATTLIST\s+[\w:-]+|!\[CDATA\[|/?[\w:][\w:.-]*)([^<>]*?)(/?)>|(<!--.*?-->)", re.S)
XML_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*')""")


def xml(content: str) -> list[Symbol]:
    out: list[Symbol] = []
    scope: list[tuple[str, str]] = []
    for m in XML_TAG.finditer(content):
        if m[4]:
            continue
        line = content.count("\n", 0, m.start())
        head, rest = m[1], m[2]
        add = lambda name, kind, **more: out.append(Symbol(name, kind, line, 0, line, 0, tuple(scope), **more))  # noqa: B023, E731
        if head.startswith("/"):
            if scope and scope[-1][0] == head[1:]:
                scope.pop()
            continue
        if head.startswith("?"):
            add(head[1:], "Constant", modifiers=["xml_declaration" if head == "?xml" else "processing_instruction"])
        elif head.startswith("!"):
            word, _, name = head[1:].partition(" ")
            add(name.strip() or word, {"DOCTYPE": "Constant", "ENTITY": "Variable", "ELEMENT": "Type", "ATTLIST": "Field"}.get(word, "Constant"), modifiers=[word.lower()])
        else:
            add(head, "Class", modifiers=["element"])
            for k, v in XML_ATTRIBUTE.findall(rest):
                if k.startswith("xmlns"):
                    add(k.partition(":")[2] or "default", "Namespace", signature=f"{k}={v}")
                else:
                    add(k, "Field", modifiers=["attribute"], signature=f"{k}={v}")
            if not m[3]:
                scope.append((head, "Class"))
    return out


#: JSON keys with a class of their own.
KEY_TAGS = {
    "identifier": ("id", "uuid", "key", "name", "_id"), "version": ("version",), "dependencies": ("dependencies", "devDependencies", "peerDependencies"),
    "schema": ("$schema", "schema", "type", "properties"), "openapi": ("openapi", "swagger", "paths"), "json-ld": ("@context", "@id", "@type"),
}
LONG_TEXT = 100


def _json_type(v) -> str:
    if v is None or isinstance(v, bool):
        return "null" if v is None else "boolean"
    return {dict: "object", list: "array", str: "string", int: "number", float: "number"}[type(v)]


def _text_tag(v: str) -> str | None:
    tests = (("url", r"https?://\S+$"), ("email", r"[\w.+-]+@[\w-]+\.[\w.]+$"), ("version", r"v?\d+\.\d+(\.\d+)?([-+][\w.]+)?$"), ("path", r"\.{0,2}/[\w./-]+$"))
    return next((t for t, p in tests if re.match(p, v)), "long-text" if len(v) > LONG_TEXT else None)


def json_paths(content: str) -> list[Symbol]:
    """A Field per pair named by its dotted path, and a Constant per significant string."""
    try:
        root = json.loads(content)
    except (ValueError, RecursionError):
        return []
    out: list[Symbol] = []
    todo = [("", root)]
    while todo:
        path, v = todo.pop()
        inner = []
        if isinstance(v, dict):
            for k, x in v.items():
                name = f"{path}.{k}" if path else k
                tags = [t for t, keys in KEY_TAGS.items() if k in keys]
                out.append(Symbol(name, "Field", modifiers=["property", f"type={_json_type(x)}", *tags]))
                inner.append((name, x))
                if isinstance(x, str) and (tag := _text_tag(x)):
                    out.append(Symbol(f'{name}="{x}"', "Constant", modifiers=[tag]))
        elif isinstance(v, list):
            inner = [(f"{path}[{i}]", x) for i, x in enumerate(v) if isinstance(x, (dict, list))]
        todo += inner[::-1]
    return out


HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
REFERENCE = re.compile(r"^\s{0,3}\[([^\]]+)\]:\s*(\S+)")


def markdown(content: str) -> list[Symbol]:
    """Headings nest by level; links, references, fences, tables and images are symbols of their section."""
    out: list[Symbol] = []
    scope: list[tuple[int, str]] = []
    lines = content.split("\n")
    i = 0
    add = lambda name, kind, end=None, **more: out.append(Symbol(name, kind, i, 0, i if end is None else end, 0, tuple((n, "Module") for _, n in scope), **more))
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"^\s{0,3}(```+|~~~+)\s*(\w*)", line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            add(f"code_block_{m[2] or 'text'}", "Function", end, documentation="\n".join(lines[i + 1 : end]))
            i = end + 1
            continue
        if (m := HEADING.match(line)) or (i + 1 < len(lines) and line.strip() and re.match(r"^(=+|-{3,})\s*$", lines[i + 1]) and "|" not in line):
            level, name = (len(m[1]), m[2]) if m else (1 if lines[i + 1][0] == "=" else 2, line.strip())
            scope = [s for s in scope if s[0] < level]
            add(name, "Module", modifiers=[f"h{level}"])
            scope.append((level, name))
            i += 1 if m else 2
            continue
        if "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]) and "-" in lines[i + 1]:
            add("|".join(c.strip() for c in line.strip().strip("|").split("|")), "Struct", modifiers=["table"])
        if m := REFERENCE.match(line):
            add(m[1], "Constant", signature=m[2], modifiers=["reference"])
        for bang, name, url in LINK.findall(line):
            add(name, "Constant" if bang else "Import", signature=url, modifiers=["image" if bang else "link"])
        i += 1
    return out


YAML_PAIR = re.compile(r"^(\s*)(?:-\s+)?([\w.$/-]+|\"[^\"]*\"|'[^']*')\s*:(?:\s+(.*))?$")


def yaml(content: str) -> list[Symbol]:
    """Block pairs nest by indent; anchors, aliases, sequence items and longer comments are symbols too."""
    out: list[Symbol] = []
    scope: list[tuple[int, str]] = []
    for i, line in enumerate(content.split("\n")):
        bare = line.strip()
        add = lambda name, kind, **more: out.append(Symbol(name, kind, i, len(line) - len(line.lstrip()), i, len(line), tuple((n, "Namespace") for _, n in scope), **more))  # noqa: B023, E731
        if bare.startswith("#"):
            if len(bare.encode()) > 10:
                add(bare.lstrip("# "), "Variable", modifiers=["comment"])
            continue
        if not bare:
            continue
        indent = len(line) - len(line.lstrip())
        scope = [s for s in scope if s[0] < indent]
        for mark, kind, word in (("&", "Constant", "anchor"), ("*", "Variable", "alias")):
            for name in re.findall(rf"(?:^|\s){re.escape(mark)}([\w-]+)", line):
                add(name, kind, modifiers=[word])
        if m := YAML_PAIR.match(line):
            key, value = m[2].strip("\"'"), (m[3] or "").strip()
            shown = f"{key}: {value}"
            shown = shown if len(shown.encode()) <= 100 else shown[:97] + "..."
            nested = not value or value[0] in "[{|>&" or value.startswith("!")
            add(key, "Namespace" if nested else "Field", signature=shown)
            for k, v in re.findall(r"([\w-]+)\s*:\s*([^,{}]+)", value) if value.startswith("{") else []:
                add(k, "Field", signature=f"{k}: {v.strip()}", modifiers=["flow"])
            if nested:
                scope.append((indent, key))
        elif bare.startswith("- ") and len(bare.encode()) < 100:
            add(bare[2:], "Variable", modifiers=["item"])
    return out


def css(content: str) -> list[Symbol]:
    out: list[Symbol] = []
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), content, flags=re.S)
    for m in re.finditer(r"(@import\s+[^;]+);|(@media|@supports|@keyframes)\s+([^{]+)\{|(--[\w-]+)\s*:|([^{};@]+)\{", text):
        line = text.count("\n", 0, m.start())
        add = lambda name, kind, **more: out.append(Symbol(name.strip(), kind, line, 0, line, 0, **more))  # noqa: B023, E731
        if m[1]:
            add(m[1][7:].strip().strip("\"'"), "Import", modifiers=["import"])
        elif m[2]:
            add(m[3], "Function" if m[2] == "@keyframes" else "Namespace", modifiers=[m[2][1:]])
        elif m[4]:
            add(m[4], "Variable", modifiers=["custom_property"])
        else:
            for s in m[5].split(","):
                add(s, "Class", modifiers=["rule"])
                for c in re.findall(r"\.[\w-]+", s):
                    add(c, "Class", modifiers=["class_selector"])
                for c in re.findall(r"#[\w-]+", s):
                    add(c, "Constant", modifiers=["id_selector"])
                for c in re.findall(r"::?[\w-]+", s):
                    add(c, "Method", modifiers=["pseudo"])
    return out


def regex(content: str) -> list[Symbol]:
    out = [Symbol(m, "Variable", modifiers=["named_group"]) for m in re.findall(r"\(\?P?<([A-Za-z_]\w*)>", content)]
    out += [Symbol(m, "Constant", modifiers=["character_class"]) for m in re.findall(r"\[\^?\]?(?:\\.|[^\]\\])*\]", content)]
    return out


PARSERS = {"html": html, "xml": xml, "json": json_paths, "markdown": markdown, "yaml": yaml, "css": css, "regex": regex}
