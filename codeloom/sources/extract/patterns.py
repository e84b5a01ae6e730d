"""Brace and keyword languages by declaration patterns: an approximation of their grammars.

A language is a list of rules (kind, pattern with a group ``n`` for the name, and optional
groups ``sig`` and ``base``). Strings and comments are blanked first; a declaration whose
line opens a block is the scope of what lies inside it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codeloom.sources.extract import Dependency, Symbol, qualified

N = r"(?P<n>[A-Za-z_$][\w$]*)"
ARGS = r"(?P<sig>\([^{;\n]*)"
BASE = r"(?:\s*(?::|<|extends|implements|\(|with)\s*(?P<base>[^{\n]*))?"
MOD = r"^[ \t]*(?P<mod>(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|override|async|export|default|const|sealed|virtual|readonly|open|fileprivate|unsafe|extern|lazy|implicit|case|partial|required|mutating|synchronized|native|late|inline|constexpr|explicit)\s+)*)"
#: What looks like a call but isn't.
NOT_CALLS = frozenset("if else for while switch match case catch return function fn def func sizeof typeof new throw await in do try class struct enum interface and or not elif when where with until unless".split())

RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [("Function", MOD + r"fn\s+" + N + r"(?:<[^>]*>)?" + ARGS), ("Struct", MOD + r"struct\s+" + N), ("Enum", MOD + r"enum\s+" + N), ("Trait", MOD + r"trait\s+" + N), ("Module", MOD + r"mod\s+" + N), ("Import", MOD + r"use\s+(?P<n>[^;]+);"), ("Constant", MOD + r"(?:static|const)\s+(?:mut\s+)?" + N + r"\s*:"), ("Type", MOD + r"type\s+" + N), ("Macro", r"^[ \t]*macro_rules!\s+" + N), ("Scope", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:(?P<base>[\w:]+)(?:<[^>]*>)?\s+for\s+)?" + N)],
    "javascript": [("Function", MOD + r"function\s*\*?\s*" + N + r"\s*" + ARGS), ("Class", MOD + r"class\s+" + N + BASE), ("Arrow", MOD + r"(?:const|let|var)\s+" + N + r"\s*=\s*(?:async\s*)?(?P<sig>\([^)\n]*\)|\w+)\s*=>"), ("Constant", r"^[ \t]*(?:export\s+)?const\s+" + N), ("Variable", r"^[ \t]*(?:export\s+)?(?:let|var)\s+" + N), ("Import", r"^[ \t]*import\b[^'\"\n]*['\"](?P<n>[^'\"]+)['\"]"), ("Export", r"^[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)?\s*\*?\s*" + N), ("Method", r"^[ \t]+(?P<mod>(?:(?:static|async|get|set)\s+)*)(?!(?:if|for|while|switch|catch|return|function)\b)" + N + r"\s*" + r"(?P<sig>\([^)\n]*\))\s*\{")],
    "java": [("Namespace", r"^[ \t]*package\s+(?P<n>[\w.]+)"), ("Import", r"^[ \t]*import\s+(?:static\s+)?(?P<n>[\w.*]+)"), ("Class", MOD + r"(?:class|record)\s+" + N + BASE), ("Interface", MOD + r"@?interface\s+" + N + BASE), ("Enum", MOD + r"enum\s+" + N), ("Method", MOD + r"(?!(?:return|new|else|throw)\b)(?:<[^>]+>\s+)?[\w<>\[\],.?]+\s+" + N + r"\s*" + r"(?P<sig>\([^){;]*\))\s*(?:throws\s+[\w., ]+)?\s*[{;]"), ("Method", MOD + N + r"\s*(?P<sig>\([^){;=]*\))\s*\{"), ("Field", r"^[ \t]+(?P<mod>(?:(?:public|private|protected|static|final|volatile)\s+)+)[\w<>\[\],.?]+\s+" + N + r"\s*[;=]")],
    "go": [("Namespace", r"^package\s+" + N), ("Import", r"^(?:import\s+)?[ \t]*(?:[\w.]+\s+)?\"(?P<n>[^\"\n]+)\"\s*$"), ("Method", r"^func\s+\((?P<base>[^)]*)\)\s*" + N + r"\s*" + ARGS), ("Function", r"^func\s+" + N + r"(?:\[[^\]]*\])?\s*" + ARGS), ("Struct", r"^[ \t]*(?:type\s+)?" + N + r"\s+struct\b"), ("Interface", r"^[ \t]*(?:type\s+)?" + N + r"\s+interface\b"), ("Type", r"^type\s+" + N + r"\s+(?!struct\b|interface\b)"), ("Variable", r"^var\s+" + N), ("Constant", r"^const\s+" + N)],
    "cpp": [("Import", r"^[ \t]*#\s*include\s*[<\"](?P<n>[^>\"]+)"), ("Module", r"^[ \t]*namespace\s+" + N), ("Class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+" + N + r"(?:\s*:\s*(?P<base>[^{;\n]*))?\s*\{"), ("Struct", r"^[ \t]*(?:typedef\s+)?struct\s+" + N + r"(?:\s*:\s*(?P<base>[^{;\n]*))?\s*\{"), ("Union", r"^[ \t]*union\s+" + N), ("Macro", r"^[ \t]*#\s*define\s+" + N), ("Function", r"^[ \t]*(?P<mod>(?:(?:static|virtual|inline|constexpr|explicit|extern)\s+)*)(?!(?:return|else|new|delete|throw)\b)[\w:<>,*& ]+?[\s*&]+(?:\w+::)*" + N + r"\s*(?P<sig>\([^;{]*\))[^;{\n]*\{"), ("Field", r"^[ \t]+(?:(?:static|const|mutable)\s+)*[\w:<>]+[\s*&]+" + N + r"\s*;")],
    "csharp": [("Import", r"^[ \t]*using\s+(?P<n>[\w.]+)\s*;"), ("Namespace", r"^[ \t]*namespace\s+(?P<n>[\w.]+)"), ("Class", MOD + r"(?:class|record|struct)\s+" + N + BASE), ("Interface", MOD + r"interface\s+" + N + BASE), ("Enum", MOD + r"enum\s+" + N), ("Method", r"^[ \t]+(?P<mod>(?:(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed)\s+)+)(?:[\w<>\[\],.?]+\s+)?" + N + r"\s*(?P<sig>\([^){;]*\))"), ("Field", r"^[ \t]+(?P<mod>(?:(?:public|private|protected|internal|static|readonly|const)\s+)+)[\w<>\[\],.?]+\s+" + N + r"\s*(?:[;=]|\{\s*get)")],
    "php": [("Import", r"^[ \t]*(?:use\s+|(?:include|require)(?:_once)?\s*\(?\s*['\"])(?P<n>[\w\\./-]+)"), ("Namespace", r"^[ \t]*namespace\s+(?P<n>[\w\\]+)"), ("Class", MOD + r"class\s+" + N + BASE), ("Interface", MOD + r"interface\s+" + N), ("Trait", MOD + r"trait\s+" + N), ("Method", r"^[ \t]+(?P<mod>(?:(?:public|private|protected|static|abstract|final)\s+)+)function\s+&?" + N + ARGS), ("Function", r"^[ \t]*function\s+&?" + N + ARGS), ("Field", r"^[ \t]+(?P<mod>(?:(?:public|private|protected|static)\s+)+)(?:\??\w+\s+)?\$" + N), ("Constant", MOD + r"const\s+" + N), ("Variable", r"^[ \t]*\$" + N + r"\s*=(?!=)")],
    "ruby": [("Class", r"^[ \t]*class\s+(?P<n>[A-Z]\w*)(?:\s*<\s*(?P<base>[\w:]+))?"), ("Module", r"^[ \t]*module\s+" + N), ("Method", r"^[ \t]*def\s+(?P<n>(?:self\.)?\w+[?!=]?)(?P<sig>\([^)]*\))?"), ("Import", r"^[ \t]*require(?:_relative)?\s*\(?['\"](?P<n>[^'\"]+)"), ("Constant", r"^[ \t]*(?P<n>[A-Z][A-Z0-9_]+)\s*="), ("Field", r"^[ \t]*(?P<n>@@?\w+)\s*="), ("Variable", r"^[ \t]*(?P<n>[a-z_]\w*)\s*=(?![=~])")],
    "swift": [("Import", r"^[ \t]*import\s+(?P<n>[\w.]+)"), ("Class", MOD + r"(?:class|actor)\s+(?!func|var)" + N + BASE), ("Struct", MOD + r"struct\s+" + N + BASE), ("Enum", MOD + r"enum\s+" + N + BASE), ("Interface", MOD + r"protocol\s+" + N + BASE), ("Function", MOD + r"func\s+" + N + r"(?:<[^>]*>)?" + ARGS), ("Method", MOD + r"(?P<n>init)[?!]?" + ARGS), ("Constant", MOD + r"let\s+" + N), ("Variable", MOD + r"var\s+" + N)],
    "scala": [("Namespace", r"^[ \t]*package\s+(?P<n>[\w.]+)"), ("Import", r"^[ \t]*import\s+(?P<n>[\w.{}, =>*]+)"), ("Class", MOD + r"(?:class|object)\s+" + N + BASE), ("Interface", MOD + r"trait\s+" + N + BASE), ("Function", MOD + r"def\s+" + N + r"(?P<sig>[\[(][^={\n]*)?"), ("Constant", MOD + r"val\s+" + N), ("Variable", MOD + r"var\s+" + N), ("Type", MOD + r"type\s+" + N)],
    "dart": [("Import", r"^[ \t]*(?:import|export)\s+['\"](?P<n>[^'\"]+)"), ("Class", MOD + r"class\s+" + N + BASE), ("Interface", r"^[ \t]*(?:mixin|extension)\s+" + N), ("Enum", r"^[ \t]*enum\s+" + N), ("Type", r"^[ \t]*typedef\s+" + N), ("Function", r"^[ \t]*(?P<mod>(?:static\s+)?)(?!(?:return|else|new|throw|if|for|while|switch)\b)[\w<>?]+\s+" + N + r"\s*(?P<sig>\([^;{=]*\))\s*(?:async\s*)?[{=]"), ("Field", r"^[ \t]+(?:final|late|static|const)\s+[\w<>?]+\s+" + N + r"\s*[;=]"), ("Variable", r"^[ \t]*var\s+" + N)],
    "lua": [("Function", r"^[ \t]*(?P<mod>(?:local\s+)?)function\s+(?P<n>[\w.:]+)\s*" + ARGS), ("Function", r"^[ \t]*(?P<mod>(?:local\s+)?)" + N + r"\s*=\s*function\s*" + ARGS), ("Import", r"require\s*\(?\s*['\"](?P<n>[^'\"]+)"), ("Variable", r"^[ \t]*local\s+" + N + r"\s*=(?!\s*function)")],
    "zig": [("Function", MOD + r"fn\s+" + N + ARGS), ("Struct", MOD + r"const\s+" + N + r"\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)\b"), ("Enum", MOD + r"const\s+" + N + r"\s*=\s*enum\b"), ("Import", MOD + r"(?:const\s+\w+\s*=\s*)?@import\(\"(?P<n>[^\"]+)"), ("Constant", MOD + r"const\s+" + N + r"\s*(?::[^=]+)?=\s*(?!struct|union|enum|packed|extern|@import|error)"), ("Variable", MOD + r"var\s+" + N), ("Type", MOD + r"const\s+" + N + r"\s*=\s*error\b")],
    "objc": [("Import", r"^[ \t]*[#@]\s*import\s*[<\"]?(?P<n>[\w./+-]+)"), ("Class", r"^[ \t]*@(?:interface|implementation)\s+" + N + r"(?:\s*:\s*(?P<base>\w+))?"), ("Interface", r"^[ \t]*@protocol\s+" + N), ("Method", r"^[ \t]*(?P<mod>[-+])\s*\([^)]*\)\s*" + N + r"(?P<sig>[^{;]*)"), ("Field", r"^[ \t]*@property\s*(?:\([^)]*\))?\s*[\w<>]+[\s*]+" + N)],
    "bash": [("Function", r"^[ \t]*(?:function\s+)?(?P<n>[A-Za-z_][\w-]*)\s*\(\)"), ("Function", r"^[ \t]*function\s+(?P<n>[A-Za-z_][\w-]*)\s*\{"), ("Import", r"^[ \t]*(?:source|\.)\s+(?P<n>\S+)"), ("Constant", r"^[ \t]*(?:readonly|declare\s+-r)\s+" + N), ("Variable", r"^[ \t]*(?P<mod>(?:(?:export|local|declare)\s+)?)(?P<n>[A-Za-z_]\w*)=")],
    "jsdoc": [("Type", r"@typedef\s+(?:\{[^}]*\}\s+)?" + N), ("Namespace", r"@namespace\s+" + N), ("Class", r"@class\s+" + N), ("Function", r"@function\s+" + N), ("Parameter", r"@param\s+(?:\{[^}]*\}\s+)?\[?" + N)],
}
RULES["typescript"] = [("Interface", MOD + r"interface\s+" + N + BASE), ("Type", MOD + r"type\s+" + N + r"(?:<[^>]*>)?\s*="), ("Enum", MOD + r"(?:const\s+)?enum\s+" + N), ("Namespace", MOD + r"(?:namespace|module)\s+" + N), *RULES["javascript"]]

HASH = ("ruby", "bash", "php")
SCOPES = ("Class", "Struct", "Enum", "Interface", "Trait", "Module", "Namespace", "Scope", "Function", "Method", "Arrow", "Union")
CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\(")


@lru_cache(maxsize=64)
def _compiled(language: str) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((kind, re.compile(p)) for kind, p in RULES.get(language, ()))


def _blanked(content: str, language: str) -> str:
    """Comments as spaces, so that lines and columns stay."""
    marks = [r"/\*.*?\*/", r"//[^\n]*"] if language not in ("ruby", "bash", "lua", "jsdoc") else []
    marks += [r"#(?![!\[])[^\n]*"] if language in HASH else []
    marks += [r"--\[\[.*?\]\]", r"--[^\n]*"] if language == "lua" else []
    if not marks:
        return content
    strings = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`' if language != "rust" else r'"(?:\\.|[^"\\])*"'
    pattern = re.compile(f"({strings})|" + "|".join(marks), re.S)
    return pattern.sub(lambda m: m[0] if m[1] else re.sub(r"[^\n]", " ", m[0]), content)


def extract(content: str, language: str) -> tuple[list[Symbol], list[Dependency]]:
    rules = _compiled(language)
    if not rules:
        return [], []
    symbols: list[Symbol] = []
    found: list[Dependency] = []
    scope: list[tuple[str, str, int]] = []
    depth = 0
    ends = language in ("ruby", "lua")
    originals = content.split("\n")
    for i, line in enumerate(_blanked(content, language).split("\n")):
        bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""', line)
        here = tuple((n, k) for n, k, _ in scope)
        own = "::".join(n for n, _ in here)
        opened = None
        seen: set[tuple[str, str]] = set()
        for kind, pattern in rules:
            m = pattern.search(line)
            if not m:
                continue
            group = m.groupdict()
            name = group["n"].strip()
            names = [name]
            shown = {"Arrow": "Function", "Scope": None}.get(kind, kind)
            if shown == "Function" and here and here[-1][1] in ("Class", "Struct", "Scope", "Interface", "Trait", "Enum") and language in ("rust", "swift", "scala", "dart", "cpp", "zig"):
                shown = "Method"
            if shown and (name, shown) not in seen and not (shown in ("Method", "Function") and name in NOT_CALLS):
                seen.add((name, shown))
                mods = (group.get("mod") or "").split() + (["arrow"] if kind == "Arrow" else [])
                signature = f"{name}{(group['sig'] or '').rstrip()}" if group.get("sig") else None
                doc = next((x.strip().lstrip("/*!# -").strip() for x in originals[i - 1 : i] if i and re.match(r"\s*(///|//!|\*|/\*\*|#|--)", x)), None) if shown not in ("Variable", "Import") else None
                symbols.append(Symbol(name, shown, i, m.start("n"), i, len(line), here, mods, signature, doc or None))
            if shown == "Import":
                found += [Dependency(own, n, "Imports", i, m.start("n")) for n in names]
            for base in re.findall(r"[A-Za-z_][\w.:]*", group.get("base") or "") if kind in ("Class", "Interface", "Struct", "Scope", "Enum") else []:
                if base not in ("extends", "implements", "public", "private", "protected", "virtual", "with", "for"):
                    found.append(Dependency(qualified(name, here), base, "Implements" if kind == "Scope" or re.search(rf"implements\b.*\b{re.escape(base)}\b", line) else "Inherits", i, m.start("n")))
            if kind in SCOPES and opened is None and ("{" in bare[m.start() :] or ends) and not re.search(r"\{[^{}]*\}\s*;?\s*$", bare[m.start() :]):
                opened = (name, kind)
        if not opened:
            branch = bool(re.match(r"\s*(\}?\s*else\b|if\b|elsif\b|elif\b|switch\b|case\b|match\b)", bare))
            for m in CALL.finditer(bare):
                if m[1] not in NOT_CALLS and (m[1], "Method") not in seen and (m[1], "Function") not in seen:
                    found.append(Dependency(own, m[1], "Calls", i, m.start(1), branch))
        before = depth
        if ends:
            depth += len(re.findall(r"^\s*(?:class|module|def|if|unless|while|until|for|case|begin|function|local function)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*function\b", bare)) - len(re.findall(r"^\s*end\b", bare))
        else:
            depth += bare.count("{") - bare.count("}")
        if opened and depth > before:
            scope.append((*opened, before))
        while scope and depth <= scope[-1][2]:
            scope.pop()
    return symbols, found
