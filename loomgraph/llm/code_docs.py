"""Functions paired with the documentation that describes them.

Method: the declaration is found with one regular expression per language, outside of comments and strings, which one
scanner blanks first, over line ends too; its body is delimited with a stack (of brackets, beside indentation in Python); the comment is attached by line distance: it must end on the last line
above the declaration that is neither an annotation nor, where the language's tools allow it, blank. In Python it is the
first string of the body. The description is what remains of the comment without tags and their texts, the method's
name reworded, inherit markers, to-do notes, rulers, notices and commented-out code.

Defined results: a null, empty or unparsable source, an unknown language or a description of fewer than ``MIN_WORDS``
words gives no pair; repeated rows give one pair each; texts of any length are read whole. Line ends may be LF, CRLF
or CR. Only the named columns are read; ids pass through as stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_WORDS = 6
#: So many blank lines may lie between a documentation comment and its declaration. Go's comments must be adjacent.
BLANK_LINES = {"java": 1, "scala": 1, "typescript": 1, "csharp": 1, "go": 0}

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|export|default|sealed|virtual|readonly|synchronized|native|implicit|inline|lazy|get|set|unsafe|partial|extern|new|declare)\s+)*"
#: Declarations by language; the group is the method's name.
_DECLARATION = {
    "java": _MODIFIERS + r"(?:<[^>]+>\s*)?(?:[\w.$]+(?:<.*>)?(?:\[\])*\s+)?([\w$]+)\s*\(",
    "csharp": _MODIFIERS + r"(?:[\w.]+(?:<.*>)?\??(?:\[\])*\s+)?([\w$]+)\s*(?:<[^>(]*>)?\s*\(",
    "typescript": _MODIFIERS + r"(?:(?:function\s*\*?|const|let|var)\s+)?#?([\w$]+)\s*(?:<[^>(]*>)?\s*(?:\(|[=:])",
    "scala": r"(?:(?:final|override|private|protected|implicit|inline|lazy)(?:\[\w+\])?\s+)*def\s+([\w$]+)\b",
    "go": r"func\s+(?:\([^)]*\)\s*)?([\w$]+)\s*[(\[]",
    "python": r"(?:async\s+)?def\s+([\w$]+)\s*[(\[]",
}
_STATEMENT = re.compile(r"^(?:return|throw|await|new|else|if|for|while|switch|yield|raise)\b")
_ANNOTATION = re.compile(r"^(?:@[\w.$]+(?:\(.*\))?|\[[\w.]+(?:\(.*\))?(?:,.*)?\]|\)|@[\w.$]+\(.*)\s*$")

# What marks a line as a notice, a to-do note or an inherit marker instead of a description.
_TODO = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
_NOTICE = re.compile(r"copyright|\ball rights reserved\b|\blicen[cs]ed? (?:under|to)\b|spdx-|method stub|auto-?generated|created by|generated by|do not (?:edit|modify)|@formatter|nosonar|\bnoinspection\b|eslint-|tslint:|prettier-|@ts-|istanbul|noqa|pylint:|type: ?ignore|nolint|checkstyle|suppresswarnings|resharper|pragma|(?:#|//)?\s*(?:end)?region\b|go:(?:build|generate|noinline|linkname|embed)|\+build|scalastyle|scalafmt|fmt: ?(?:on|off)|stylecop|spotless|ktlint|codespell", re.I)
_INHERIT = re.compile(r"\{@inheritdoc\}|<inheritdoc\b[^>]*>|^\W*(?:\(non-javadoc\)|inherit(?:ed)?doc|@inheritdoc|see (?:the )?(?:base|super|parent)\b[^.]*|see (?:also )?(?:#\w+|\{@link[^}]*\})|inherited from\b.*|overrides? .*\bbase\b.*|same as (?:base|super)\b.*)\W*$", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:\}|//|#(?!\d)|/\*)|=>|:=|^\s*[\w.\[\]]+(?:\s*:\s*\w+)?\s*[-+*]?=[^=]|^\s*(?:await\s+)?[\w.$]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?\s*$"
    r"|^\s*(?:if|for|while|foreach|switch|with|elif|else|try|catch|except)\b.*[:{)]\s*$|^\s*(?:val|var|let|const|final|using)\s+\w+.*=|^\s*(?:return|throw|raise)\s+[\w.]+(?:\(.*\))?\s*$|\breturn\s+(?:None|null|nil|undefined|true|false)\b\W*$|^\s*(?:>>>|\.\.\.|\$)\s"
)
_TAG = re.compile(r"^\s*(?:[@\\](?!code\b|link|literal|value)[a-zA-Z][\w-]*|:\w+[^:]*:)")
_SECTION = re.compile(r"^\s*(?:args|arguments|params?|parameters|other parameters|keyword args|returns?|yields?|raises?|throws|examples?|usage|notes?|see also|references?|attributes|warnings?|warns|todo|deprecated|since|version|authors?|type parameters)\s*:?\s*$|^\s*(?:deprecated|since|author|see also|see|version)\s*:.*$", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][\w.-]*(?:\s[^<>]*)?/?>|\{@(?:code|link|linkplain|literal|value)\s+([^}]*)\}|[`*_]{1,3}(?=\w)|(?<=\w)[`*]{1,3}")
_XML = re.compile(r"</?[a-zA-Z][\w.-]*(?:\s[^<>]*)?/?>")
_CSHARP_TAGGED = re.compile(r"<(param|returns|typeparam|exception|value|seealso|example|permission|include|code)\b[^>]*?(?:/>|>.*?</\1>)", re.S)
_WORD = re.compile(r"[^\W\d_](?:[\w'’]*[^\W_])?")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f]")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_FILLER = frozenset("a an the this that of for to and or in on by with its it from given all is are method function".split())


def _stems(text: str) -> set[str]:
    """Words without endings, so that 'Validates a bucket' and 'validateBucket' share theirs."""
    out = set()
    for word in _CAMEL.findall(text):
        w = word.lower()
        if w in _FILLER:
            continue
        for end in ("ing", "ies", "es", "s", "ed", "ion", "e", "y"):
            if w.endswith(end) and len(w) - len(end) >= 3:
                w = w[: -len(end)]
                break
        out.add(w.rstrip("e"))
    return out


def words(text: str) -> int:
    """Words of any language; in scripts without spaces two characters count as one."""
    dense = len(_DENSE.findall(text))
    return len(_WORD.findall(_DENSE.sub(" ", text))) + dense // 2


def describe(comment: list[str], method_name: str, language: str) -> str:
    """The description in the lines of a comment whose marks are gone."""
    if language == "csharp":
        comment = _CSHARP_TAGGED.sub("", "\n".join(comment)).split("\n")
    name, kept, skipped = _stems(method_name), [], None
    for line in comment:
        indent = len(line) - len(line.lstrip())
        plain = _MARKUP.sub(lambda m: m[1] or " ", line).strip()
        if _INHERIT.search(line) or _INHERIT.search(plain) or _NOTICE.search(plain):
            continue
        if skipped is not None and skipped >= 0 and plain and set(plain) <= {"-", "="}:
            skipped = -1  # an underlined heading: its text has no indentation of its own, and more of them follow
            continue
        if _TAG.match(line) and language != "go":
            skipped = -1  # tags come last: all that follows belongs to them
            continue
        if _SECTION.match(line):
            skipped = indent
            continue
        if skipped is not None:
            if skipped == -1 or not plain or indent > skipped:
                continue
            skipped = None
        if not plain or not any(c.isalpha() for c in plain) or _TODO.match(plain) or _CODE.search(_XML.sub("", line)):
            continue
        kept.append(plain)
    text, out = " ".join(kept), []
    for sentence in re.split(r"(?<=[.!?。])\s+|(?<=。)", text):
        if _stems(sentence) - name or any(ord(c) > 0x24F and c.isalpha() for c in sentence):
            out.append(sentence)
    return " ".join(out)


_FIND = {language: re.compile(r"^\s*(?:(?:@\w+(?:\([^)]*\))?|\[[^\]]*\])\s+)*" + form) for language, form in _DECLARATION.items()}


# What isn't code: comments and strings, which may reach over lines. Of a construct without its end, the rest of the text.
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_PLAIN, _TRIPLE = r'"(?:\\.|[^"\\\n])*(?:"|$)', r'"""(?:\\.|.)*?(?:"""+|\Z)'
_CHARACTER = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_OPAQUE = {
    language: re.compile("|".join(forms), re.S | re.M)
    for language, forms in {
        "java": (_LINE, _BLOCK, _TRIPLE, _PLAIN, _CHARACTER),
        "scala": (_LINE, _BLOCK, r'"""(?:(?!""").)*(?:"""+|\Z)', _PLAIN, _CHARACTER),
        "csharp": (_LINE, _BLOCK, r'"""(?:(?!""").)*(?:"""+|\Z)', r'(?:\$@|@\$|@)"(?:""|[^"])*(?:"|\Z)', _PLAIN, _CHARACTER),
        "typescript": (_LINE, _BLOCK, _PLAIN, r"'(?:\\.|[^'\\\n])*(?:'|$)", r"`(?:\\.|[^`\\])*(?:`|\Z)", r"(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"),
        "go": (_LINE, _BLOCK, _PLAIN, r"`[^`]*(?:`|\Z)", r"'(?:\\[^'\n]+|[^'\\\n])'"),
        "python": (r"#[^\n]*", r'"""(?:\\.|.)*?(?:"""|\Z)', r"'''(?:\\.|.)*?(?:'''|\Z)", _PLAIN, r"'(?:\\.|[^'\\\n])*(?:'|$)"),
    }.items()
}
_NESTED = re.compile(r"/\*|\*/")


def bare(source: str, language: str) -> tuple[list[str], list[bool]]:
    """The lines of a source in which comments and strings, but for the first character of these, are blank, and which lines
    begin within a string."""
    out, at, within = [], 0, set()
    line = 0
    find = _OPAQUE[language]
    while m := find.search(source, at):
        start, end = m.span()
        comment = source[start] == "#" or source.startswith(("//", "/*"), start)
        if language == "scala" and source.startswith("/*", start):  # comments nest
            depth, end = 0, len(source)
            for mark in _NESTED.finditer(source, start):
                depth += 1 if mark[0] == "/*" else -1
                if not depth:
                    end = mark.end()
                    break
        if end == start:
            end = start + 1
        kept = source[at:start] + ("" if comment else source[start])
        body = source[start + (not comment) : end]
        out.append(kept)
        out.append("\n".join(" " * len(x) for x in body.split("\n")))
        line += kept.count("\n")
        lines = body.count("\n")
        if not comment:
            within.update(range(line + 1, line + lines + 1))
        line += lines
        at = end
    out.append(source[at:])
    plain = "".join(out).split("\n")
    return plain, [k in within for k in range(len(plain))]


_PAIRS = {")": "(", "]": "[", "}": "{"}
_BRACKETS = re.compile(r"[()\[\]{}]")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def body_end(lines: list[str], plain: list[str], within: list[bool], start: int, language: str) -> int:
    """The line after the last one of the body of the declaration at ``start``. ``plain`` and ``within`` come from bare."""
    indent, end, stack, opened = _indent(lines[start]), start + 1, [], False
    for k in range(start, len(lines)):
        code = plain[k].strip()
        if language == "python":
            if k > start and code and not within[k] and not stack and _indent(plain[k]) <= indent:
                break
            if within[k] or code or lines[k].strip() and _indent(lines[k]) > indent:
                end = k + 1
        for c in _BRACKETS.findall(plain[k]):
            if c in "([{":
                opened |= c == "{" and not stack
                stack.append(c)
            elif stack and stack[-1] == _PAIRS[c]:
                stack.pop()
        if language == "python" or stack or not code:
            continue
        if opened or code[-1] == ";":
            return k + 1
        if language in ("scala", "typescript") and code[-1] not in "=,>":  # an expression without brackets ends with its indentation
            after = next((x for x in plain[k + 1 :] if x.strip()), "")
            if not after or _indent(after) <= indent and after.strip()[0] not in ".{":
                return k + 1
    return end if language == "python" else len(lines)


_STRING = re.compile(r'(?i)^\s*(?:r|u|ur)?("""|\'\'\'|"|\')')


def _python_comment(lines: list[str], plain: list[str], start: int) -> list[str] | None:
    depth, k = 0, start
    while k < len(lines):  # the end of the signature
        code = plain[k]
        depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
        if depth <= 0 and ":" in code:
            rest = code.rsplit(":", 1)[1].strip() if code.rstrip()[-1] != ":" else ""
            if rest:
                return None
            break
        k += 1
    k += 1
    while k < len(lines) and (not lines[k].strip() or lines[k].lstrip().startswith("#")):
        k += 1
    if k >= len(lines) or not (m := _STRING.match(lines[k])):
        return None
    mark, first = m[1], lines[k][m.end() :]
    text = "\n".join([first, *lines[k + 1 :]]) if len(mark) == 3 else first
    end = re.search(r"(?<!\\)" + re.escape(mark), text)
    if end is None or text[end.end() :].split("\n", 1)[0].lstrip()[:1] not in ("", "#", ";"):
        return None
    body = text[: end.start()].split("\n")
    indent = len(lines[k]) - len(lines[k].lstrip())
    return [body[0].strip(), *(x[min(indent, len(x) - len(x.lstrip())) :] for x in body[1:])]


def comment_of(lines: list[str], plain: list[str], start: int, language: str) -> list[str] | None:
    """The lines of the documentation comment of the declaration at ``start``, without marks; None if there is none."""
    if language == "python":
        return _python_comment(lines, plain, start)
    k, blank = start - 1, 0
    while k >= 0 and (_ANNOTATION.match(s := lines[k].strip()) or not s):
        blank += not s
        k -= 1
    if k < 0 or blank > BLANK_LINES.get(language, 0):
        return None
    mark = {"csharp": "///", "go": "//"}.get(language)
    if mark:
        top = k
        while top >= 0 and lines[top].lstrip().startswith(mark) and not (mark == "///" and lines[top].lstrip().startswith("////")):
            top -= 1
        return [re.sub(r"^\s*/+ ?", "", x) for x in lines[top + 1 : k + 1]] or None
    if not lines[k].rstrip().endswith("*/"):
        return None
    top = k
    while top >= 0 and "/*" not in lines[top]:
        top -= 1
    if top < 0 or not (m := re.match(r"^\s*/\*\*(?![*/])", lines[top])):
        return None
    text = [lines[top][m.end() :], *lines[top + 1 : k + 1]]
    text[-1] = text[-1].rstrip()[:-2].rstrip("*")
    return [text[0].strip(), *(re.sub(r"^\s*\*? ?", "", x) for x in text[1:])]


def pair(source: str | None, method_name: str | None, language: str | None, signature: str | None = None) -> tuple[str, str] | None:
    """(code, description) of a method, or None."""
    if not source or not language:
        return None
    name = method_name or (re.search(r"(\w+)\(", signature or "") or [None, ""])[1]
    find = _FIND.get(language)
    if find is None or not name:
        return None
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    lines, plain, within = source.split("\n"), None, []
    for k, line in enumerate(lines):
        if name in line and (m := find.match(line)) and m[1] == name and not _STATEMENT.match(line.strip()):
            if plain is None:
                plain, within = bare(source, language)
            if plain[k][m.start(1) : m.end(1)] != name:
                continue  # within a comment or a string
            comment = comment_of(lines, plain, k, language)
            text = describe(comment, name, language) if comment else ""
            if words(text) < MIN_WORDS:
                return None
            return "\n".join(lines[k : body_end(lines, plain, within, k, language)]), text
    return None


def code_pairs(methods: DataFrame) -> DataFrame:
    """(id, language, code, description) for each row of ``methods`` whose documentation says something; a narrow step."""
    read = methods.select("id", "language", "method_name", "signature", "source").filter("source is not null and length(source) > 0")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = batch.to_pydict()
            rows = [(i, lang, *found) for i, lang, name, sig, src in zip(*(got[c] for c in ("id", "language", "method_name", "signature", "source")), strict=True) if (found := pair(src, name, lang, sig))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["id", "language", "code", "description"])

    return read.mapInArrow(run, T.StructType([T.StructField(c, T.StringType()) for c in ("id", "language", "code", "description")]))
