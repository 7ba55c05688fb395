"""What makes outline nodes, per language: lexing, joining of lines, prefixes, declarations.

A text goes through these in order. Strings, comments and regular expressions
are blanked; line ends within brackets become soft, so that a head is one
logical line; a logical line is cut into statements at ``;`` ``{`` ``}``; what
stands in front of a head (annotations, attributes, template and linkage
prefixes) is taken off; and the first rule that fits gives the node.

Patterns are anchored, repeat groups possessively and never put two open-ended
classes in a row, so that a line of a megabyte costs time in proportion to its
length. ``ID`` stands for an identifier, ``ARGS`` for balanced parentheses,
``ANGLE`` for balanced type parameters, ``TYPE`` for a type in front of a name.
"""

from __future__ import annotations

from dataclasses import dataclass

from sylvan import constants as K

_JS_FAMILY = ["javascript", "jsx", "typescript", "tsx"]
_TS = ["typescript", "tsx"]


# --- brackets ----------------------------------------------------------------
def balanced(opening: str, closing: str, levels: int, more: str = "") -> str:
    """A bracketed text with brackets inside, so many levels deep."""
    plain = f"[^{opening}{closing}{more}]"
    out = f"[{opening}]{plain}*+[{closing}]"
    for _ in range(levels - 1):
        out = f"[{opening}](?:{plain}++|{out})*+[{closing}]"
    return out


GROUP = balanced(r"(\[", r")\]", 8)
ARGS = balanced("(", ")", 4)
ANGLE = balanced("<", ">", 3, ";{}")
BRACES = balanced("{", "}", 4)

# --- lexing ------------------------------------------------------------------
# Content that is no code; the first alternative that fits at a place wins. A
# comment that never ends goes to the end of the text.
_LONG = r'"""(?s:.*?)"""'
_DOUBLE = r'"(?:\\.|[^"\\\n])*+"'
_SINGLE = r"'(?:\\.|[^'\\\n])*+'"
_TRIPLE = r"\'\'\'(?s:.*?)\'\'\'"
_SLASHES = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_TICKS = r"`(?:\\(?s:.)|[^`\\])*+`"
_QUOTED = f"{_DOUBLE}|{_SINGLE}"
_NO_WORD = r"(?<![A-Za-z0-9_])"


def _template(levels: int) -> str:
    """A template literal whose ``${}`` parts hold braces and templates again."""
    out = _TICKS
    for _ in range(levels):
        out = r"`(?:\\(?s:.)|\$\{(?:[^`{}]++|\{[^`{}]*+\}|" + out + r")*+\}|[^`\\])*+`"
    return out


# A slash starts a regular expression behind an operator, an opening bracket or
# a word that an operand follows, and at the start of a line; else it divides.
_OPERAND_FOLLOWS = "return|typeof|case|in|of|do|else|void|delete|throw|new|yield|await"
_REGEX = (
    rf"(?=/)(?<=(?:[=(,:\[!&|?{{}};+*%~^-]|=>)[ \t]{{0,8}}|\b(?:{_OPERAND_FOLLOWS})[ \t]{{1,8}}|^[ \t]{{0,40}}|\n[ \t]{{0,40}})"
    r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*+"
)
_HASHED = "|".join(rf'{_NO_WORD}b?r{"#" * n}"(?s:.*?)"{"#" * n}' for n in (3, 2, 1, 0))
OPAQUE = {
    "python": f"{_LONG}|{_TRIPLE}|{_QUOTED}|#[^\\n]*+",
    "rust": _HASHED + r'|"(?:\\(?s:.)|[^"\\])*+"|' + r"'(?:\\[^'\n]++|[^'\\\n])'|" + _SLASHES,
    "go": f"{_TICKS}|{_QUOTED}|{_SLASHES}",
    "c": f"{_QUOTED}|{_SLASHES}",
    "cpp": rf'{_NO_WORD}(?:u8|[uUL])?R"(?<mark>[^()\\ \n]{{0,16}})\((?s:.*?)\)\k<mark>"|{_QUOTED}|{_SLASHES}',
    "csharp": rf'{_LONG}|(?:@\$?|\$@)"(?:[^"]|"")*+"|{_QUOTED}|{_SLASHES}',
    "swift": rf'#"[^\n]*?"#|{_LONG}|{_QUOTED}|{_SLASHES}',
    **dict.fromkeys(("java", "kotlin"), f"{_LONG}|{_QUOTED}|{_SLASHES}"),
    "dart": rf"{_LONG}|{_TRIPLE}|{_NO_WORD}r'[^'\n]*+'|{_NO_WORD}r\"[^\"\n]*+\"|{_QUOTED}|{_SLASHES}",
    **dict.fromkeys(_JS_FAMILY, f"{_template(2)}|{_QUOTED}|{_SLASHES}|{_REGEX}"),
}
# A text without any of these has nothing to blank.
OPAQUE_MARK = r"""["'`#]|//|/\*|/[^/\n]++/"""
# What stays: line ends, and the quotes of what is no comment.
HIDDEN_CHARACTER = r"""[^\n'"`]"""

# --- logical lines -----------------------------------------------------------
# Text whose line ends do not end a line of code.
JOINED = GROUP + r"|(?<=[A-Za-z0-9_])<(?=[ \t]*+\n)[^<>(){};]*+(?:<[^<>(){};]*+>[^<>(){};]*+)*+>"
# A line end in front of these does not end a head either.
_CONTINUES = r"(?:\{|(?:extends|implements|permits|throws|where|noexcept)\b|->|=>|:(?!:))"
CONTINUED = rf"\n(?=(?:[ \t]*+\n){{0,3}}+[ \t]*+{_CONTINUES})"

# --- statements --------------------------------------------------------------
# Several statements on one line, and each of them with what ends it. Import and
# export lists keep their braces.
SEVERAL = r"[;{}][ \t]*+[^ \t;]"
_NAMES = r"^[ \t]*+(?:import|export)\b[^;{}()=]*+\{[^{}]*+\}[^;{}]*+;?|"
PIECE = r"(?:[^;{}()\[\]]++|" + GROUP + r"|[()\[\]])*+(?:;|\{++|\}++)?"
PIECES = dict.fromkeys(_JS_FAMILY, _NAMES + PIECE)
# How far a node goes on its line: to the end of its block, or of its statement.
BLOCK_SPAN = r"^(?:[^;{}()\[\]]++|" + GROUP + r"|[()\[\]])*+(?:;|\{(?:[^{}]++|" + BRACES + r")*+\}?[ \t]*+;?)?"
STATEMENT_SPAN = r"^(?:[^;(){}\[\]]++|" + GROUP + "|" + BRACES + r"|[(){}\[\]])*+;?"
STATEMENT_TYPES = [
    "import_statement", "export_statement", "lexical_declaration", "variable_declaration", "type_alias_declaration",
    "use_declaration", "import_or_export", "let_declaration",
]
# Characters of a line of several statements that are looked at for the text of one.
SPAN_LIMIT = 400
# Languages without statements on one line.
WHOLE_LINES = ["python"]

# --- prefixes of a head ------------------------------------------------------
_AT = rf"@(?!interface\b)[A-Za-z_$][A-Za-z0-9_$.:]*+(?:[ \t]*+{ARGS})?[ \t]*+"
_SQUARE = balanced(r"\[", r"\]", 4) + r"[ \t]*+"
PREFIXES = {
    **dict.fromkeys(_TS, rf"^(?:{_AT}|declare[ \t]++)++"),
    **dict.fromkeys(("javascript", "jsx", "java", "kotlin", "swift", "dart"), rf"^(?:{_AT})++"),
    "csharp": rf"^(?:{_SQUARE})++",
    "rust": rf"^(?:#!?{_SQUARE}|pub(?:{ARGS})?[ \t]++)++",
    "c": r'^(?:extern[ \t]++"[^"]*+"[ \t]++(?!\{)|__attribute__[ \t]*+' + ARGS + r"[ \t]*+)++",
    "cpp": rf"^(?:template[ \t]*+{ANGLE}[ \t]*+|(?:public|private|protected)[ \t]*+:(?!:)[ \t]*+|\[{_SQUARE}\]?[ \t]*+"
    + r'|extern[ \t]++"[^"]*+"[ \t]++(?!\{)|__attribute__[ \t]*+' + ARGS + r"[ \t]*+)++",
}
# Words in front of a declaration that belong to the export node.
EXPORT_PREFIX = r"^[ \t]*+export[ \t]++(?:default[ \t]++)?"

# --- rules -------------------------------------------------------------------
# Where a rule holds: in the body of a type, in a file or namespace, elsewhere.
MEMBER, FILE, LOCAL = 1, 2, 4
OUTSIDE, ANYWHERE = FILE | LOCAL, MEMBER | FILE | LOCAL


@dataclass(frozen=True)
class Rule:
    node_type: str
    pattern: str
    where: int = ANYWHERE
    # could also fit a call or a branch
    loose: bool = False


def _words(words: str) -> str:
    return r"(?:(?:" + "|".join(words.split()) + r")[ \t]++)*+"


_MODIFIERS = _words(
    "public private protected internal static final abstract sealed partial async override virtual readonly open data "
    "inner extern unsafe inline suspend synchronized native fileprivate mutating required convenience factory external "
    "declare default export value annotation operator infix tailrec lateinit companion indirect nonisolated get set "
    "strictfp transient volatile const late covariant base mixin new ref non-sealed fixed"
)
_TYPE = r"[A-Za-z_][A-Za-z0-9_.<>,\[\]?&*: \t]*[ \t*&>\]]"
_END = r"[ \t]*+(?:\{|;)?[ \t]*+$"
# Heads that look like a declaration and are none.
NOT_A_DECLARATION = (
    r"^(?:if|else|for|foreach|while|switch|case|catch|return|throw|new|do|try|await|yield|assert|when|guard|repeat|"
    r"sizeof|delete|goto|using|lock|super|this|typeof|in|defer|match|loop|print|echo|finally|elif|except|with|fixed|"
    r"checked|unchecked|select|go|break|continue|package|import)\b"
)

_JS_MODS = _words("public private protected static async get set readonly override abstract declare accessor")
_JS_NAME = r"(?:[*#][ \t]*+)?(?:ID|\[[^\]]*+\])"
_RETURNS = r"(?::[^;{}]*+)?"
_JS = [
    Rule("import_statement", r"^import\b(?![ \t]*+[(.])"),
    Rule("abstract_class_declaration", r"^abstract[ \t]++class\b"),
    Rule("class_declaration", r"^class\b(?![ \t]*+[:=.,)(])"),
    Rule("interface_declaration", r"^interface[ \t]++ID"),
    Rule("enum_declaration", r"^(?:const[ \t]++)?enum[ \t]++ID"),
    Rule("type_alias_declaration", r"^type[ \t]++ID[^=;(]*+="),
    Rule("internal_module", r"^namespace[ \t]++ID"),
    Rule("module", r"""^(?:module[ \t]++['"A-Za-z]|global[ \t]*+\{)"""),
    Rule("generator_function_declaration", r"^(?:async[ \t]++)?function[ \t]*+\*"),
    Rule("lexical_declaration", r"^(?:const|let)[ \t]++[A-Za-z_$\[{]"),
    Rule("lexical_declaration", r"^(?:const|let)[\[{]"),
    Rule("variable_declaration", r"^var[ \t]*+[A-Za-z_$\[{]"),
]
_FUNCTION = r"^(?:async[ \t]++)?function\b"
_METHOD_HEAD = rf"^{_JS_MODS}{_JS_NAME}[ \t]*+(?:ANGLE)?[ \t]*+ARGS[ \t]*+"
_JS_RULES = [
    *_JS,
    Rule("function_declaration", _FUNCTION),
    Rule("method_definition", _METHOD_HEAD + r"\{", loose=True),
]
_TS_RULES = [
    *_JS,
    Rule("function_signature", _FUNCTION + rf"[ \t]*+ID[ \t]*+(?:ANGLE)?[ \t]*+ARGS[ \t]*+{_RETURNS};?[ \t]*+$"),
    Rule("function_declaration", _FUNCTION),
    Rule("method_definition", _METHOD_HEAD + _RETURNS + r"\{", loose=True),
    Rule("abstract_method_signature", rf"^(?=(?:[a-z]++[ \t]++){{0,8}}?abstract\b){_JS_MODS}{_JS_NAME}\??[ \t]*+(?:ANGLE)?[ \t]*+ARGS[ \t]*+{_RETURNS}[;,]?[ \t]*+$", MEMBER),
    Rule("method_signature", rf"^{_JS_MODS}{_JS_NAME}\??[ \t]*+(?:ANGLE)?[ \t]*+ARGS[ \t]*+{_RETURNS}[;,]?[ \t]*+$", MEMBER, loose=True),
]


def _types(*names: str) -> list[Rule]:
    """Types by keyword, with modifiers in front."""
    return [Rule(f"{n}_declaration", rf"^{_MODIFIERS}{n}[ \t]++ID") for n in names]


_ANGLED = r"(?:ANGLE[ \t]*+)?"
_VALUE = r"[ \t]*+(?:\[[^\]]*+\][ \t]*+)*+(?:=(?!=)|;|,|$)"
_C_TAIL = r"[ \t]*+(?:(?:const|noexcept|override|final|volatile|mutable|&|&&|throw[ \t]*+ARGS|noexcept[ \t]*+ARGS|->[^;{}]*+)[ \t]*+)*+"
_C_NAME = r"(?:ID(?:ANGLE)?::)*+(?:~?ID|operator[^;{}(]*+(?:\(\))?)"
_C_TYPES = [
    Rule(f"{n}_specifier", rf"^(?:typedef[ \t]++)?{n}[ \t]++(?:class[ \t]++)?ID[^;=()]*+$") for n in ("struct", "enum", "union")
]
_C_FUNCTION = Rule("function_definition", rf"^(?:{_TYPE})?{_C_NAME}[ \t]*+ARGS{_C_TAIL}(?::[^;{{}}]*+)?\{{", MEMBER | FILE, loose=True)
_C_OPEN_HEAD = Rule("function_definition", rf"^{_TYPE}{_C_NAME}[ \t]*+ARGS{_C_TAIL}$", FILE, loose=True)
_C_DECLARATOR = Rule(
    "function_declarator", rf"^{_TYPE}{_C_NAME}[ \t]*+ARGS{_C_TAIL}(?:=[ \t]*+(?:0|default|delete)[ \t]*+)?;[ \t]*+$", MEMBER | FILE, loose=True
)
_C_VARIABLE = rf"^{_TYPE}ID{_VALUE}"

RULES: dict[str, list[Rule]] = {
    **dict.fromkeys(("javascript", "jsx"), _JS_RULES),
    **dict.fromkeys(_TS, _TS_RULES),
    "python": [
        Rule("import_statement", r"^import[ \t]"),
        Rule("import_from_statement", r"^from[ \t]++[^ \t]++[ \t]++import\b"),
        Rule("class_definition", r"^class[ \t]++ID"),
        Rule("function_definition", r"^(?:async[ \t]++)?def[ \t]++ID"),
    ],
    "java": [
        Rule("package_declaration", r"^package[ \t]"),
        Rule("import_declaration", r"^import[ \t]"),
        Rule("annotation_type_declaration", rf"^{_MODIFIERS}@interface[ \t]++ID"),
        *_types("class", "interface", "enum"),
        Rule("record_declaration", rf"^{_MODIFIERS}record[ \t]++ID[ \t]*+(?:ANGLE)?[ \t]*+ARGS"),
        Rule("constructor_declaration", rf"^{_MODIFIERS}{_ANGLED}ID[ \t]*+ARGS[^;={{}}]*+\{{", MEMBER, loose=True),
        Rule("method_declaration", rf"^{_MODIFIERS}{_ANGLED}{_TYPE}ID[ \t]*+ARGS[^={{}};]*+(?:default[^{{}};]*+)?{_END}", MEMBER, loose=True),
        Rule("field_declaration", rf"^{_MODIFIERS}{_TYPE}ID{_VALUE}", MEMBER, loose=True),
        Rule("local_variable_declaration", rf"^(?:final[ \t]++)?{_TYPE}ID{_VALUE}", OUTSIDE, loose=True),
    ],
    "kotlin": [
        Rule("package_header", r"^package[ \t]"),
        Rule("import_header", r"^import[ \t]"),
        Rule("class_declaration", rf"^{_MODIFIERS}(?:(?:fun|enum)[ \t]++)?(?:class|interface)[ \t]++ID"),
        Rule("object_declaration", rf"^{_MODIFIERS}object[ \t]++ID"),
        Rule("companion_object", rf"^{_MODIFIERS}object[ \t]*+\{{"),
        Rule("function_declaration", rf"^{_MODIFIERS}fun[ \t]"),
        Rule("secondary_constructor", rf"^{_MODIFIERS}constructor[ \t]*+\(", MEMBER),
        Rule("property_declaration", rf"^{_MODIFIERS}va[lr][ \t]++(?:ID|\(|<)"),
        Rule("type_alias", rf"^{_MODIFIERS}typealias[ \t]"),
    ],
    "csharp": [
        Rule("using_directive", r"^(?:global[ \t]++)?using[ \t]++[^(=;]*+(?:=[^(;]*+)?;", OUTSIDE),
        Rule("file_scoped_namespace_declaration", r"^namespace[ \t]++[^;{]*+;"),
        Rule("namespace_declaration", r"^namespace[ \t]"),
        *_types("class", "interface", "enum", "struct"),
        Rule("record_declaration", rf"^{_MODIFIERS}record[ \t]++(?:class[ \t]++|struct[ \t]++)?ID"),
        Rule("delegate_declaration", rf"^{_MODIFIERS}delegate[ \t]"),
        Rule("constructor_declaration", rf"^{_MODIFIERS}ID[ \t]*+ARGS[ \t]*+(?::[^;{{}}]*+)?(?:\{{|=>)", MEMBER, loose=True),
        Rule("method_declaration", rf"^{_MODIFIERS}{_TYPE}ID[ \t]*+(?:ANGLE)?[ \t]*+ARGS[^;={{}}]*+(?:\{{|;|=>|$)", MEMBER, loose=True),
        Rule("property_declaration", rf"^{_MODIFIERS}{_TYPE}ID[ \t]*+(?:\{{|=>)", MEMBER, loose=True),
        Rule("field_declaration", rf"^{_MODIFIERS}{_TYPE}ID{_VALUE}", MEMBER, loose=True),
        Rule("local_function_statement", rf"^{_MODIFIERS}{_TYPE}ID[ \t]*+(?:ANGLE)?[ \t]*+ARGS[^;={{}}]*+(?:\{{|=>)", OUTSIDE, loose=True),
        Rule("local_declaration_statement", rf"^(?:const[ \t]++)?{_TYPE}ID{_VALUE}", OUTSIDE, loose=True),
    ],
    "dart": [
        Rule("import_or_export", r"""^(?:import|export)[ \t]++['"]"""),
        Rule("class_definition", rf"^{_MODIFIERS}class[ \t]++ID"),
        Rule("enum_declaration", r"^enum[ \t]++ID"),
        Rule("mixin_declaration", r"^(?:base[ \t]++)?mixin[ \t]++(?!class\b)ID"),
        Rule("extension_declaration", r"^extension[ \t]"),
        Rule("type_alias", r"^typedef[ \t]"),
        Rule("constructor_signature", rf"^{_MODIFIERS}[A-Z_][A-Za-z0-9_$]*+(?:\.ID)?[ \t]*+ARGS[ \t]*+(?::[^;{{}}]*+|=>[^;{{}}]*+)?(?:\{{|;)", MEMBER),
        Rule("function_signature", rf"^{_MODIFIERS}(?:{_TYPE})?ID[ \t]*+(?:ANGLE)?[ \t]*+ARGS[ \t]*+(?:async\*?|sync\*?)?[ \t]*+(?:\{{|=>)", loose=True),
        Rule("function_signature", rf"^{_MODIFIERS}{_TYPE}ID[ \t]*+(?:ANGLE)?[ \t]*+ARGS[ \t]*+;", MEMBER, loose=True),
        Rule("declaration", rf"^{_MODIFIERS}(?:{_TYPE})?ID{_VALUE}", MEMBER, loose=True),
        Rule("declaration", rf"^(?:(?:const|final|late|var)[ \t]++)*+(?:{_TYPE})ID{_VALUE}", FILE, loose=True),
        Rule("declaration", rf"^(?:(?:const|final|late|var)[ \t]++)++ID{_VALUE}", FILE),
        Rule("local_variable_declaration", rf"^(?:(?:const|final|late|var)[ \t]++)*+{_TYPE}ID{_VALUE}", LOCAL, loose=True),
        Rule("local_variable_declaration", rf"^(?:(?:const|final|late|var)[ \t]++)++ID{_VALUE}", LOCAL),
    ],
    "swift": [
        Rule("import_declaration", r"^import[ \t]"),
        Rule("protocol_declaration", rf"^{_MODIFIERS}protocol[ \t]++ID"),
        Rule("class_declaration", rf"^{_MODIFIERS}(?:class|struct|enum|extension|actor)[ \t]++(?!func\b|var\b)ID"),
        Rule("function_declaration", rf"^(?:{_MODIFIERS})(?:class[ \t]++)?func[ \t]"),
        Rule("init_declaration", rf"^{_MODIFIERS}init[?!]?[ \t]*+(?:ANGLE)?[ \t]*+\(", MEMBER),
        Rule("deinit_declaration", r"^deinit\b", MEMBER),
        Rule("property_declaration", rf"^{_MODIFIERS}(?:class[ \t]++)?(?:let|var)[ \t]++(?:ID|\()"),
        Rule("typealias_declaration", rf"^{_MODIFIERS}typealias[ \t]"),
    ],
    "go": [
        Rule("package_clause", r"^package[ \t]", FILE),
        Rule("import_declaration", r"^import\b", FILE),
        Rule("function_declaration", r"^func[ \t]++ID", FILE),
        Rule("method_declaration", r"^func[ \t]*+\(", FILE),
        Rule("type_declaration", r"^type[ \t]++(?:ID|\()", OUTSIDE),
        Rule("var_declaration", r"^var[ \t]", OUTSIDE),
        Rule("const_declaration", r"^const[ \t]", OUTSIDE),
        Rule("short_var_declaration", r"^ID[ \t]*+(?:,[ \t]*+ID[ \t]*+)*+:=", LOCAL),
        Rule("method_spec", r"^ID[ \t]*+ARGS[^;{}=]*+;?$", MEMBER),
    ],
    "rust": [
        Rule("use_declaration", r"^use[ \t]"),
        Rule("extern_crate_declaration", r"^extern[ \t]++crate[ \t]"),
        Rule("foreign_mod_item", r"^(?:unsafe[ \t]++)?extern\b[^;{}()]*+\{"),
        Rule("struct_item", r"^struct[ \t]++ID"),
        Rule("enum_item", r"^enum[ \t]++ID"),
        Rule("union_item", r"^union[ \t]++ID[ \t]*+(?:ANGLE)?[^;=()]*+\{"),
        Rule("trait_item", r"^(?:unsafe[ \t]++)?trait[ \t]++ID"),
        Rule("impl_item", r"^(?:unsafe[ \t]++)?impl\b"),
        Rule("mod_item", r"^mod[ \t]++ID"),
        Rule("macro_definition", r"^macro_rules!"),
        Rule("function_signature_item", r'^(?:(?:default|const|async|unsafe|extern(?:[ \t]++"[^"]*+")?)[ \t]++)*+fn[ \t]++ID[^{};]*+;'),
        Rule("function_item", r'^(?:(?:default|const|async|unsafe|extern(?:[ \t]++"[^"]*+")?)[ \t]++)*+fn[ \t]++ID'),
        Rule("const_item", r"^const[ \t]++(?:ID|_[ \t]*+:)"),
        Rule("static_item", r"^static[ \t]++(?:mut[ \t]++)?ID"),
        Rule("type_item", r"^type[ \t]++ID"),
        Rule("let_declaration", r"^let\b", LOCAL),
    ],
    "c": [
        Rule("preproc_include", r"^#[ \t]*+include\b"),
        Rule("linkage_specification", r'^extern[ \t]++"[^"]*+"[ \t]*+\{'),
        *_C_TYPES,
        _C_DECLARATOR,
        _C_FUNCTION,
        _C_OPEN_HEAD,
        Rule("declaration", _C_VARIABLE, OUTSIDE, loose=True),
    ],
    "cpp": [
        Rule("preproc_include", r"^#[ \t]*+include\b"),
        Rule("linkage_specification", r'^extern[ \t]++"[^"]*+"[ \t]*+\{'),
        Rule("namespace_definition", r"^(?:inline[ \t]++)?namespace\b(?![^{};=]*+=)"),
        Rule("alias_declaration", r"^using[ \t]++ID[ \t]*+="),
        Rule("using_declaration", r"^using[ \t]"),
        Rule("class_specifier", r"^class[ \t]++(?:(?:alignas[ \t]*+ARGS|final)[ \t]*+)?ID[^;=()]*+$"),
        *_C_TYPES,
        _C_DECLARATOR,
        _C_FUNCTION,
        _C_OPEN_HEAD,
        Rule("field_declaration", _C_VARIABLE, MEMBER, loose=True),
        Rule("declaration", _C_VARIABLE, OUTSIDE, loose=True),
    ],
}
# Such a line gives an export node besides its declaration.
EXPORTS = _JS_FAMILY
EXPORT_TYPE, EXPORT = "export_statement", r"^export\b"

# Declarations with several names: what stands in front of the first.
DECLARATORS = {
    **dict.fromkeys(_JS_FAMILY, r"^(?:const|let|var)[ \t]++"),
    **dict.fromkeys(("java", "csharp"), rf"^{_MODIFIERS}{_TYPE}(?=ID[ \t]*+=)"),
}
DECLARATOR_TYPE = "variable_declarator"
DECLARATOR_OWNERS = [
    "lexical_declaration", "variable_declaration", "field_declaration", "local_variable_declaration", "local_declaration_statement",
]
DECLARATOR = rf"(?:[^,;(){{}}\[\]<>]++|{GROUP}|{BRACES}|{ANGLE}|[<>(){{}}\[\]])++"

# --- what a block is ---------------------------------------------------------
# Node types whose blocks hold members, and those that hold declarations as a file does.
MEMBER_BLOCKS = (
    "class|interface|struct|enum|record|trait|impl_|protocol|extension_|mixin|union|object|annotation_type|type_declaration"
)
FILE_BLOCKS = "namespace|module|mod_item|linkage|package"
MEMBER_BODY = {
    **dict.fromkeys(("csharp", "rust"), "declaration_list"),
    **dict.fromkeys(("c", "cpp"), "field_declaration_list"),
    "python": "block",
}
OWN_BODY = {"interface_declaration": "interface_body", "enum_declaration": "enum_body"}
FILE_BODY = {
    **dict.fromkeys(("csharp", "rust", "cpp", "c"), "declaration_list"),
    **dict.fromkeys(_JS_FAMILY, "statement_block"),
}
STATEMENT_BODY = {
    **dict.fromkeys(_JS_FAMILY, "statement_block"),
    **dict.fromkeys(("c", "cpp"), "compound_statement"),
}
DEFAULT_MEMBER_BODY, DEFAULT_BODY = "class_body", "block"
ROOT, PLAIN = "program", "statement"
# Where a value stands between a declaration and the block it opens.
VALUE_OWNERS = ["lexical_declaration", "variable_declaration"]
ARROW = r"(?:=>|\bfunction\b[^{}]*+)[ \t]*+\{$"

# Languages whose nesting shows in the indent, not in braces.
INDENT_LANGUAGES = ["python"]
TAB_WIDTH = 8
BLOCK_OPENER = r":[ \t]*+$"
# How a statement ends that opens or closes a block.
OPENS, CLOSES = r"(\{++)[\s;]*+$", r"(\}++)[\s;]*+$"


def filled(pattern: str) -> str:
    return pattern.replace("ARGS", ARGS).replace("ANGLE", ANGLE).replace("ID", K.IDENT)


def families(of: dict) -> dict[tuple, list[str]]:
    """Languages that share a value, so that each is used once."""
    out: dict[tuple, list[str]] = {}
    for language, value in of.items():
        out.setdefault(tuple(value) if isinstance(value, list) else (value,), []).append(language)
    return out
