"""Language profiles: the patterns and rules that drive chunking and call extraction (UDF-1).

A profile table has one row per language; it is read once on the driver (tens of rows)
and becomes expressions, or travels with the small matching helper.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that continue an identifier or mark a variable.
IDENTIFIER = r"[a-zA-Z0-9_\-#$@]"


@dataclass(frozen=True)
class Profile:
    language: str
    extensions: tuple[str, ...] = ()
    function_patterns: tuple[str, ...] = ()
    class_patterns: tuple[str, ...] = ()
    class_group: str = ""
    implementation_keyword: str = ""
    block_rules: tuple[tuple[str, str, str], ...] = ()  # type, open, close
    skip_tokens: tuple[str, ...] = ()
    bare_identifiers: bool = False
    bare_lookahead: str = ""
    call_patterns: tuple[str, ...] = ()
    line_comment: str = "//"
    comment_open: str = "/*"
    comment_close: str = "*/"
    string_delimiters: tuple[str, ...] = ('"',)


PASCAL = Profile(
    "pascal", (".pas", ".dpr"),
    function_patterns=(r"^[ \t]*(?:procedure|function|constructor|destructor)[ \t]+(?:(?P<owner>\w+)\.)?(?P<name>\w+)",),
    class_patterns=(r"^[ \t]*(?P<name>\w+)[ \t]*=[ \t]*class\b",),
    class_group="owner", implementation_keyword="implementation",
    block_rules=(("routine", r"^[ \t]*(?:procedure|function)[ \t]+(?P<name>[\w.]+)", r"^end;"),),
    skip_tokens=("begin", "end", "var", "const", "type", "unit", "uses", "if", "then", "else", "for", "while", "repeat", "until"),
    bare_identifiers=True, bare_lookahead=r"(?!\s*:)", call_patterns=(r"\bcall\s+(?P<callee>\w+)",),
    comment_open="{", comment_close="}", string_delimiters=("'",),
)
MARKUP = Profile(
    "html", (".html",),
    block_rules=(("article", r"<article\b[^>]*(?P<name>)>", r"</article>"), ("nav", r"<nav\b[^>]*(?P<name>)>", r"</nav>")),
    line_comment="", comment_open="<!--", comment_close="-->",
)

# Words that may stand before a declaration, and the start of a line with any of them.
_JVM_WORDS = "public|protected|private|static|final|abstract|synchronized|default|native|sealed"
_NET_WORDS = "public|protected|private|internal|static|virtual|override|abstract|sealed|async|partial|readonly|extern"
_KT_WORDS = "public|protected|private|internal|open|abstract|override|suspend|inline|data|sealed|final|operator|companion"


def _after(words: str, least: str = "*") -> str:
    return rf"^[ \t]*(?:(?:{words})[ \t]+){least}"


_TYPE = r"[\w.<>\[\],?]+(?:[ \t]*<[^>]*>)?"
_C_SKIP = ("if", "for", "while", "switch", "return", "catch", "new", "throw", "else", "do")
_SCRIPT_FUNCTIONS = (
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t*]+(?P<name>[\w$]+)",
    r"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>[\w$]+)(?:[ \t]*:[^=]+)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)]*\)[^=]*=>|[\w$]+[ \t]*=>)",
)
_SCRIPT_CLASSES = (r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(?P<name>[\w$]+)",)

DELPHI = replace(PASCAL, language="delphi", extensions=(".pas", ".dpr", ".inc"))
PYTHON = Profile(
    "python", (".py",), function_patterns=(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)",), class_patterns=(r"^[ \t]*class[ \t]+(?P<name>\w+)",),
    line_comment="#", comment_open='"""', comment_close='"""', string_delimiters=('"', "'"),
)
JAVA = Profile(
    "java", (".java",), function_patterns=(_after(_JVM_WORDS, "+") + rf"(?:<[^>]*>[ \t]*)?(?:{_TYPE}[ \t]+)?(?P<name>\w+)[ \t]*\(",),
    class_patterns=(_after(_JVM_WORDS) + r"(?:class|interface|enum|record)[ \t]+(?P<name>\w+)",), skip_tokens=_C_SKIP,
)
JAVASCRIPT = Profile("javascript", (".js", ".jsx"), _SCRIPT_FUNCTIONS, _SCRIPT_CLASSES, skip_tokens=_C_SKIP, string_delimiters=('"', "'", "`"))
TYPESCRIPT = replace(
    JAVASCRIPT, language="typescript", extensions=(".ts", ".tsx"),
    class_patterns=(*_SCRIPT_CLASSES, r"^[ \t]*(?:export[ \t]+)?(?:interface|enum)[ \t]+(?P<name>[\w$]+)"),
)
CSHARP = Profile(
    "csharp", (".cs",), function_patterns=(_after(_NET_WORDS, "+") + rf"(?:{_TYPE}[ \t]+)?(?P<name>\w+)[ \t]*(?:<[^>]*>)?[ \t]*\(",),
    class_patterns=(_after(_NET_WORDS) + r"(?:class|interface|struct|record|enum)[ \t]+(?P<name>\w+)",), skip_tokens=_C_SKIP,
)
GO = Profile(
    "go", (".go",), function_patterns=(r"^func[ \t]+(?:\([ \t]*\w+[ \t]+\*?(?P<owner>\w+)[^)]*\)[ \t]*)?(?P<name>\w+)[ \t]*[\[(]",),
    class_patterns=(r"^type[ \t]+(?P<name>\w+)[ \t]+(?:struct|interface)\b",), class_group="owner", skip_tokens=_C_SKIP, string_delimiters=('"', "`"),
)
KOTLIN = Profile(
    "kotlin", (".kt",), function_patterns=(_after(_KT_WORDS) + r"fun[ \t]+(?:<[^>]*>[ \t]*)?(?:(?P<owner>\w+)\.)?(?P<name>\w+)[ \t]*\(",),
    class_patterns=(_after(_KT_WORDS) + r"(?:class|interface|object)[ \t]+(?P<name>\w+)",), class_group="owner", skip_tokens=_C_SKIP,
)
COBOL = Profile(
    "cobol", (".cbl", ".cob"), function_patterns=(r"^[ \t\d]{0,7}(?P<name>[a-z0-9][\w-]*)(?:[ \t]+section)?[ \t]*\.[ \t]*$",),
    class_patterns=(r"^[ \t\d]{0,7}program-id[ \t]*\.[ \t]*(?P<name>[\w-]+)",), call_patterns=(r"\bperform\s+(?P<callee>[\w-]+)", r"\bcall\s+['\"](?P<callee>[\w-]+)"),
    line_comment="*>", comment_open="", comment_close="", string_delimiters=("'", '"'),
)
RPG = Profile(
    "rpg", (".rpg", ".rpgle"), function_patterns=(r"^[ \t]*dcl-proc[ \t]+(?P<name>[\w#$@]+)", r"^.{0,40}?\bbegsr[ \t]+(?P<name>[\w#$@]+)", r"^.{0,6}[ \t]+(?P<name>[\w#$@]+)[ \t]+begsr\b"),
    call_patterns=(r"\bexsr\s+(?P<callee>[\w#$@]+)", r"\bcallp\s+(?P<callee>[\w#$@]+)"), comment_open="", comment_close="", string_delimiters=("'",),
)
NATURAL = Profile(
    "natural", (".nat",), function_patterns=(r"^[ \t]*define[ \t]+(?:subroutine|function)[ \t]+(?P<name>[\w#-]+)",),
    call_patterns=(r"\bperform\s+(?P<callee>[\w#-]+)", r"\bcallnat\s+['\"](?P<callee>[\w#-]+)"), line_comment="/*", comment_open="", comment_close="", string_delimiters=("'",),
)
FOCUS = Profile(
    "focus", (".foc",), function_patterns=(r"^[ \t]*-?define[ \t]+function[ \t]+(?P<name>\w+)", r"^-(?P<name>[a-z]\w*)[ \t]*$"),
    call_patterns=(r"-include\s+(?P<callee>\w+)", r"\bex\s+(?P<callee>\w+)", r"-goto\s+(?P<callee>\w+)"), line_comment="-*", comment_open="", comment_close="", string_delimiters=("'",),
)
DEFAULT_PROFILES = {
    p.language: p
    for p in (PASCAL, DELPHI, MARKUP, PYTHON, JAVA, JAVASCRIPT, TYPESCRIPT, CSHARP, GO, KOTLIN, COBOL, RPG, replace(RPG, language="rpgle", extensions=(".rpgle",)), NATURAL, FOCUS)
}


def usable(patterns: tuple[str, ...], group: str = "name") -> list[str]:
    """Patterns that compile and have the wanted group; others are skipped."""
    good = []
    for p in patterns:
        try:
            if group in re.compile(p).groupindex:
                good.append(p)
        except re.error:
            continue
    return good


def from_table(table: DataFrame) -> dict[str, Profile]:
    """Profiles from a table, one row per language, whose columns are the fields of ``Profile``."""
    names = [f for f in Profile.__dataclass_fields__ if f in table.columns]
    out = {}
    for row in table.select(*names).collect():
        values = {n: tuple(row[n]) if isinstance(row[n], list) else row[n] for n in names if row[n] is not None}
        out[row["language"]] = Profile(**values)
    return out


def java_regex(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def by_language(language: Column, profiles: dict[str, Profile], make, otherwise: Column) -> Column:
    """``make(profile)`` for the row's language."""
    out = otherwise
    for name, profile in profiles.items():
        out = F.when(language == name, make(profile)).otherwise(out)
    return out


def code_only(content: Column, profile: Profile) -> Column:
    """TXT-4: text without its declaration line, comments and string contents."""
    text = F.regexp_replace(content, r"^[^\n]*\n?", "\n")
    if profile.line_comment:
        text = F.regexp_replace(text, "(?m)" + quoted(profile.line_comment) + ".*$", "")
    if profile.comment_open and profile.comment_close and profile.comment_open != profile.line_comment:
        text = F.regexp_replace(text, quoted(profile.comment_open) + r"[\s\S]*?" + quoted(profile.comment_close), " ")
    for d in profile.string_delimiters:
        inside = f"[^{quoted(d)}]*" if len(d) == 1 else r"[\s\S]*?"
        text = F.regexp_replace(text, quoted(d) + inside + quoted(d), quoted(d + d) if "$" in d or "\\" in d else d + d)
    return text
