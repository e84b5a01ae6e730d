"""Schemas, kinds and the language table."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of symbols.
SYMBOL_KINDS = (
    "Function", "Method", "Class", "Struct", "Enum", "Interface", "Trait", "Module", "Namespace", "Variable", "Constant",
    "Field", "Parameter", "Import", "Export", "Type", "Macro", "Union",
)

#: Kinds of dependencies, each with a phrase.
DEPENDENCY_TYPES = {
    "Calls": "calls",
    "References": "references",
    "Imports": "imports",
    "Export": "exports",
    "Inherits": "inherits from",
    "Implements": "implements",
    "Uses": "uses",
    "TypeOf": "has type",
    "Assigns": "assigns to",
    "Declares": "declares",
    "ModuleDependency": "depends on module",
    "NamespaceUsage": "uses namespace",
    "MacroInvocation": "invokes macro",
    "TypeParameter": "type parameter",
    "ControlFlow": "control flow",
    "DataFlow": "data flow",
    "ConditionalExecution": "conditional execution",
    "LoopIteration": "loop iteration",
    "ExceptionHandling": "exception handling",
    "SwitchCase": "switch case",
    "ReturnFlow": "return flow",
    "BreakContinue": "break/continue",
}

#: Kinds of relationships, and the dependency types that have one of their own.
RELATIONSHIP_KINDS = ("Calls", "Inherits", "Imports", "References", "DefinedIn", "Implements", "DependsOn", "Overrides", "Composition")
KIND_OF_DEPENDENCY = {
    "Calls": "Calls", "References": "References", "Imports": "Imports", "Inherits": "Inherits", "Implements": "Implements",
    "Uses": "DependsOn", "Assigns": "References", "DataFlow": "References", "ModuleDependency": "DependsOn",
}
#: The same with imports of whole modules as imports and declarations as definitions.
KIND_OF_DEPENDENCY_WIDE = KIND_OF_DEPENDENCY | {"ModuleDependency": "Imports", "Declares": "DefinedIn"}

#: Languages by file extension.
EXTENSIONS = {
    "rust": ("rs",), "javascript": ("js", "mjs", "cjs"), "typescript": ("ts", "mts", "cts"), "python": ("py", "pyw"), "java": ("java",),
    "go": ("go",), "cpp": ("cpp", "cc", "cxx", "c++", "hpp", "hxx", "h++"), "csharp": ("cs",), "php": ("php",), "ruby": ("rb",), "swift": ("swift",),
    "scala": ("scala", "sc"), "dart": ("dart",), "lua": ("lua",), "zig": ("zig",), "objc": ("m", "mm"), "bash": ("sh", "bash"), "css": ("css",),
    "html": ("html", "htm"), "json": ("json",), "yaml": ("yaml", "yml"), "xml": ("xml",), "markdown": ("md", "markdown"),
}
DISPLAY = {
    "cpp": "Cpp", "csharp": "CSharp", "css": "Css", "html": "Html", "json": "Json", "javascript": "JavaScript", "objc": "ObjectiveC",
    "php": "Php", "typescript": "TypeScript", "xml": "Xml", "yaml": "Yaml",
}
LANGUAGE_OF = {e: lang for lang, es in EXTENSIONS.items() for e in es}
LANGUAGES = (*EXTENSIONS, "jsdoc", "regex")


def display_name(language: str) -> str:
    return DISPLAY.get(language, language.capitalize())


SCOPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())]))
SYMBOLS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("start_column", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("end_column", T.LongType()),
        T.StructField("scope_chain", SCOPE),
        T.StructField("modifiers", T.ArrayType(T.StringType())),
        T.StructField("signature", T.StringType()),
        T.StructField("documentation", T.StringType()),
    ]
)
DEPENDENCIES = T.StructType(
    [
        T.StructField("from_symbol", T.StringType()),
        T.StructField("to_symbol", T.StringType()),
        T.StructField("relationship_type", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("start_column", T.LongType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("is_conditional", T.BooleanType()),
    ]
)
