"""Java, C#, TypeScript, Go and Scala files as classes, fields, methods and call sites, without a grammar of each language.

Comments and strings are blanked first; what is left is cut at braces and semicolons, and a stack says whether a piece of
text is the head of a package, a type, a member or something within a body. That is enough for declarations, supertypes,
members and calls as written; types of expressions are left to the resolution cascade. Rows have the tagged form of
:mod:`python_code`. Defined results: a null or empty text gives no rows; a text whose braces don't match gives what was found
up to there; anonymous classes and lambdas belong to the member around them; texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .python_code import ROWS

LANGUAGES = {"java": "java", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "scala": "scala"}

_LINE, _BLOCK, _PLAIN = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*(?:"|$)'
_CHARACTER = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_BLANKED = {
    "java": re.compile("|".join((_LINE, _BLOCK, r'"""(?:\\.|.)*?(?:"""|\Z)', _PLAIN, _CHARACTER)), re.S | re.M),
    "scala": re.compile("|".join((_LINE, _BLOCK, r'"""(?:(?!""").)*(?:"""+|\Z)', _PLAIN, _CHARACTER)), re.S | re.M),
    "csharp": re.compile("|".join((_LINE, _BLOCK, r"^[ \t]*#[^\n]*", r'"""(?:(?!""").)*(?:"""+|\Z)', r'(?:\$@|@\$|@)"(?:""|[^"])*(?:"|\Z)', _PLAIN, _CHARACTER)), re.S | re.M),
    "typescript": re.compile("|".join((_LINE, _BLOCK, _PLAIN, r"'(?:\\.|[^'\\\n])*(?:'|$)", r"`(?:\\.|[^`\\])*(?:`|\Z)", r"(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")), re.S | re.M),
    "go": re.compile("|".join((_LINE, _BLOCK, _PLAIN, r"`[^`]*(?:`|\Z)", r"'(?:\\[^'\n]+|[^'\\\n])'")), re.S | re.M),
}
_PACKAGE = re.compile(r"^\s*(?:package|namespace)\s+([\w.]+)", re.M)
_IMPORTS = {
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M),
    "csharp": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M),
    "scala": re.compile(r"^\s*import\s+([\w.]+?(?:\.\{[^}]*\}|\.[*_])?)[ \t]*(?:;|$)", re.M),
    "typescript": re.compile(r"""(?:^\s*(?:import|export)\b[^'"`;]*?\bfrom\s*|\brequire\(\s*|^\s*import\s*)['"]([^'"]+)['"]""", re.M),
    "go": re.compile(r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""", re.M),
}
_TYPE = re.compile(r"\b(class|interface|@interface|enum|record|trait|object|struct)\s+(?:class\s+)?(\w+)\s*(?:<[^{(]*?>|\[[^{(]*?\])?\s*(\((?:[^()]|\([^()]*\))*\))?([^{]*)$", re.S)
_GO_TYPE = re.compile(r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*$")
_GO_FUNCTION = re.compile(r"\bfunc\s+(?:\(\s*(?:(\w+)\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(")
_DEF = re.compile(r"\bdef\s+([\w$]+)\s*(?:\[[^\]]*\])?\s*(\((?:[^()]|\([^()]*\))*\))*\s*(?::\s*([^={\n]+))?")
_ARROW = re.compile(r"(?:\b(?:const|let|var)\s+|^\s*(?:(?:public|private|protected|static|readonly)\s+)*)([\w$]+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?\(?([^()]*)\)?\s*(?::\s*([^=]*?))?\s*=>\s*$", re.S)
_ANNOTATION = re.compile(r"@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?|^\s*\[[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?(?:\s*,\s*[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?)*\]", re.M)
_MODIFIERS = frozenset("public private protected internal static final abstract async override export default sealed virtual readonly synchronized native implicit inline lazy get set unsafe partial extern new declare function case open".split())
_NOT_NAMES = frozenset("if for while switch catch return throw new else do try finally synchronized lock using foreach match case yield await typeof sizeof nameof super this func def function select go defer range with when in is as not and or instanceof assert default fixed checked unchecked import package var val let const".split())
_CALL = re.compile(r"()\b([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.<>?\[\]]*>)?\(")
_FIELD = re.compile(r"^(.*?)\b([\w$]+)\s*(?:=.*)?$", re.S)


def _blank(text: str, language: str) -> str:
    out, at = [], 0
    for m in _BLANKED[language].finditer(text):
        out.append(text[at : m.start()])
        quote = text[m.start()] if text[m.start()] in "\"'`" else " "
        body = m[0][1:]
        out.append(quote + "\n".join(" " * len(x) for x in body.split("\n")) if m[0][0] != "\n" else m[0])
        at = m.end()
    out.append(text[at:])
    return "".join(out)


def _split(text: str) -> list[str]:
    """``text`` at commas outside of brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and (i == 0 or text[i - 1] not in "=-"):
            depth -= 1
        elif c == "," and depth <= 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in (*parts, text[last:]) if p.strip()]


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.start()
    return len(text)


def _parameters(inside: str, language: str) -> tuple[list[str], list[str]]:
    names, types = [], []
    for p in _split(re.sub(r"@[\w.]+(?:\([^()]*\))?|\[[\w.]+(?:\([^()]*\))?\]\s*(?=\w)", "", inside) if language in ("java", "csharp") else inside):
        p = re.sub(r"\s*=[^>].*$", "", p, flags=re.S).strip()
        if language in ("typescript", "scala"):
            name, _, kind = p.partition(":")
            words = name.replace("...", "").replace("?", "").split()
            names.append(words[-1] if words else "")
            types.append(kind.strip())
        elif language == "go":
            words = p.split(None, 1)
            names.append(words[0])
            types.append(words[1].strip() if len(words) > 1 else "")
        else:
            words = re.sub(r"\b(?:final|ref|out|in|params|this)\b", "", p).rsplit(None, 1)
            names.append(words[-1])
            types.append(words[0].strip() if len(words) > 1 else "")
    if language == "go":  # of a, b int the type stands once
        for i in range(len(types) - 2, -1, -1):
            types[i] = types[i] or types[i + 1]
    return names, types


_LEADING = re.compile(r"(?:(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?|\[[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\]|(?!import\b|using\b|package\b)[\w$.<>\[\]?]+,?)[ \t]*\n?[ \t]*)*\Z")


_MODIFIED = re.compile(r"(?:(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?|\[[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\]|\b(?:" + "|".join(sorted(_MODIFIERS)) + r")\b)\s*)*\Z")


def _modified(head: str, place: int) -> int:
    """Where a type's declaration begins: with the annotations and modifiers before it."""
    m = _MODIFIED.search(head, 0, place)
    return m.start() if m else place


def _lead(head: str, place: int) -> int:
    """Where a declaration begins whose own words are at ``place``: with the annotations and modifiers before it."""
    m = _LEADING.search(head, 0, place)
    return m.start() if m else place


class _File:
    def __init__(self, path: str, text: str, language: str) -> None:
        self.path, self.text, self.language = path, text, language
        self.plain = _blank(text, language)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.out: list[tuple[Any, ...]] = []

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def row(self, kind: str, owner: str | None, name: str, start: int, end: int | None, detail: dict[str, Any]) -> None:
        first = self.line(start)
        self.out.append((self.path, kind, owner or None, name, first, self.line(end) if end is not None else None, first, json.dumps(detail)))

    def parse(self) -> list[tuple[Any, ...]]:
        source = self.plain if self.language not in ("typescript", "go") else self.text
        package = _PACKAGE.search(self.plain)
        self.packaged = bool(package) and self.language != "typescript"
        for m in _IMPORTS[self.language].finditer(source):
            stem, brace, inner = m[1].partition(".{")
            for name in [f"{stem}.{x.split('=>')[0].strip()}" for x in inner.rstrip("}").split(",")] if brace else [m[1]]:
                self.row("import", None, name.replace("._", ".*"), m.start(1), None, {})
        self.block(0, len(self.plain), [package[1]] if package else [], None)
        return self.out

    def head_start(self, a: int, b: int) -> int:
        m = re.compile(r"\S").search(self.plain, a, b)
        return m.start() if m else a

    def block(self, start: int, stop: int, names: list[str], type_: str | None) -> None:
        """Declarations between two places, within the type ``type_`` or at the top; an explicit stack of what is open."""
        stack: list[tuple[int, int, list[str], str | None]] = [(start, stop, names, type_)]
        while stack:
            at, stop, names, type_ = stack.pop()
            seg = at
            mark = re.compile(r"[{;}]")
            while (m := mark.search(self.plain, at, stop)) is not None:
                head, here = self.plain[seg : m.start()], m.start()
                at = here + 1
                if m[0] == "}":
                    seg = at
                    continue
                if m[0] == ";":
                    if head.count("(") > head.count(")"):
                        continue
                    if "=>" in head and self.language == "csharp" and (f := self.member(head.split("=>")[0], seg)):
                        self.method(f, seg, here, names, type_, (seg + head.index("=>"), here))
                    elif f := self.member(head, seg):
                        self.method(f, seg, here, names, type_, None)
                    elif type_ and head.strip():
                        self.field(head, seg, names)
                    seg = at
                    continue
                end = min(_closing(self.plain, here), stop)
                space = re.search(r"\b(?:namespace|package)\s+([\w.]+)\s*$", head)
                go = _GO_TYPE.search(head) if self.language == "go" else None
                declared = None if go or self.language == "go" else _TYPE.search(_ANNOTATION.sub(lambda x: " " * len(x[0]), head))
                if head.count("(") > head.count(")") or head.count("[") > head.count("]"):
                    at = end + 1  # a literal among arguments
                    continue
                if space:
                    stack.append((here + 1, end, [space[1]], None))
                elif go:
                    self.type_(go[1], "struct" if go[2] == "struct" else "interface", seg, here, end, names, head, "", None)
                elif declared:
                    self.scala_defs(head[: declared.start()], seg, names, type_)
                    name = self.type_(declared[2], declared[1].lstrip("@"), seg, here, end, names, head, declared[4], declared[3])
                    stack.append((here + 1, end, [*names, declared[2]], name))
                elif f := self.member(head, seg):
                    if self.language == "scala":
                        self.scala_defs(head[: f[4]], seg, names, type_)
                    self.method(f, seg + f[4] if self.language == "scala" else seg, end, names, type_, (here, end))
                else:
                    if type_ and head.strip() and re.search(r"=\s*(?:new\b.*)?$", head, re.S):
                        self.field(head, seg, names)
                    elif type_ and self.language == "csharp" and re.search(r"\w\s+\w+\s*$", head) and re.match(r"\s*(?:\w+\s+)*(?:get|set|init)\b", self.plain[here + 1 : end]):
                        self.field(head, seg, names)
                at = seg = end + 1
            if self.language == "scala":
                self.scala_defs(self.plain[seg:stop], seg, names, type_)
            elif self.language == "typescript" and type_ and self.plain[seg:stop].strip():
                self.field(self.plain[seg:stop], seg, names)

    def scala_defs(self, text: str, at: int, names: list[str], type_: str | None) -> None:
        """Members whose bodies are expressions."""
        if self.language != "scala":
            return
        found = list(_DEF.finditer(text))
        for m, after in zip(found, [*found[1:], None], strict=False):
            end = at + (after.start() if after else len(text.rstrip()))
            self.method(self.scala_member(m), at + m.start(), end, names, type_, (at + m.end(), end))

    def scala_member(self, m: re.Match[str]) -> tuple[str, str, str, str | None, int]:
        whole = m[0]
        inside = whole[whole.find("(") + 1 : whole.rfind(")")] if "(" in whole else ""
        return m[1], inside.replace(")(", ", "), (m[3] or "").strip(), None, m.start()

    def member(self, head: str, at: int) -> tuple[str, str, str, str | None, int] | None:
        """(name, parameters, return type, receiver type, place of the declaration within the head) of a member's head."""
        lang = self.language
        if lang == "go":
            m = _GO_FUNCTION.search(head)
            if not m:
                return None
            end = _closing(head, m.end() - 1)
            return m[3], head[m.end() : end], head[end + 1 :].strip(), m[2] or "", m.start()
        if lang == "scala":
            found = list(_DEF.finditer(head))
            return self.scala_member(found[-1]) if found and not re.search(r"\n\s*\n", head[found[-1].end() :]) else None
        bare = _ANNOTATION.sub(lambda x: " " * len(x[0]), head)
        if lang == "typescript" and (m := _ARROW.search(bare)):
            return m[1], m[2], (m[3] or "").strip(), None, m.start(1)
        for m in re.finditer(r"([\w$#]+)\s*(?:<[\w\s,.<>?\[\]]*>)?\s*\(", bare):
            before = bare[: m.start()]
            if m[1].lower() in _NOT_NAMES or "=" in re.sub(r"[=!<>]=|=>", "", before) or before.rstrip().endswith((".", "new")):
                return None
            end = _closing(bare, m.end() - 1)
            rest = bare[end + 1 :].strip()
            words = [w for w in before.split() if w not in _MODIFIERS]
            if lang == "typescript":
                if words or rest and not rest.startswith(":"):
                    return None
                return m[1].lstrip("#"), bare[m.end() : end], rest.lstrip(":").strip(), None, m.start(1)
            if rest and not re.match(r"(?:throws\b|where\b|:|default\b|->|=>)", rest):
                return None
            return m[1], bare[m.end() : end], " ".join(words), None, m.start(1)
        return None

    def type_(self, name: str, kind: str, seg: int, here: int, end: int, names: list[str], head: str, rest: str, fields: str | None) -> str:
        lang, extends, implements = self.language, None, []
        package, full = (names[0] if names and self.packaged else ""), ".".join([*names, name])
        if lang == "csharp":
            bases = _split(re.split(r"\bwhere\b", rest.split(":", 1)[1])[0]) if ":" in rest else []
            interfaces = [b for b in bases if re.match(r"(?:[\w.]+\.)?I[A-Z]", b)]
            extends = next((b for b in bases if b not in interfaces), None) if kind != "interface" else None
            implements = [b for b in bases if b != extends]
        elif lang == "scala":
            parts = re.split(r"\bwith\b|,", re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", rest.split("extends", 1)[1])) if "extends" in rest else []
            parts = [p.strip() for p in parts if p.strip()]
            extends, implements = (parts[0] if parts else None), parts[1:]
        elif lang != "go":
            e = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", rest, re.S)
            i = re.search(r"\bimplements\s+(.*?)(?=\bextends\b|\bpermits\b|$)", rest, re.S)
            above = _split(e[1]) if e else []
            extends = above[0] if above and kind != "interface" else None
            implements = (above if kind == "interface" else []) + (_split(i[1]) if i else [])
        start = seg + _modified(head, (_GO_TYPE if lang == "go" else _TYPE).search(_ANNOTATION.sub(lambda x: " " * len(x[0]), head)).start())
        words = re.findall(r"\w+", _ANNOTATION.sub(" ", head.split(name)[0]))
        embeds = []
        if lang == "go" and kind == "struct":
            for line in self.plain[here + 1 : end].split("\n"):
                w = line.strip().split()
                if len(w) == 1 and re.fullmatch(r"\*?[\w.]+", w[0]):
                    embeds.append(w[0].lstrip("*"))
                elif len(w) > 1 and re.fullmatch(r"\w+", w[0]):
                    self.row("field", full, w[0], here, None, {"type": w[1], "modifiers": []})
        elif lang == "go":
            embeds = [x.strip() for x in self.plain[here + 1 : end].split("\n") if re.fullmatch(r"\s*[\w.]+\s*", x)]
        kinds = [kind] if kind in ("interface", "enum", "record", "trait", "object", "annotation") else ["abstract"] if "abstract" in words else []
        self.row("class", package, name, start, end, {"full_name": full, "extends": extends, "implements": implements, "embeds": embeds, "modifiers": [w for w in words if w in _MODIFIERS or w == "abstract"], "annotations": [self.text[seg + a.start() : seg + a.end()].strip() for a in _ANNOTATION.finditer(head)], "stereotypes": kinds})
        if fields and lang in ("java", "scala", "csharp"):
            for n, ty in zip(*_parameters(fields.strip()[1:-1], lang), strict=True):
                if n:
                    self.row("field", full, n, start, None, {"type": ty, "modifiers": []})
        return full

    def field(self, head: str, at: int, names: list[str]) -> None:
        bare = _ANNOTATION.sub(lambda x: " " * len(x[0]), head)
        left = re.split(r"=(?!=)", bare, maxsplit=1)[0].strip()
        modifiers = [w for w in left.split() if w in _MODIFIERS]
        if self.language in ("typescript", "scala"):
            name, _, kind = left.partition(":")
            words = name.replace("?", "").replace("!", "").split()
            if words and re.fullmatch(r"#?[\w$]+", words[-1]) and words[-1] not in _NOT_NAMES:
                self.row("field", ".".join(names), words[-1].lstrip("#"), self.head_start(at, at + len(head)), None, {"type": kind.strip(), "modifiers": modifiers})
            return
        words = [w for w in left.split() if w not in _MODIFIERS]
        if len(words) > 1 and re.fullmatch(r"[\w$]+", words[-1]) and words[0] not in _NOT_NAMES and not words[-2].endswith(","):
            self.row("field", ".".join(names), words[-1], self.head_start(at, at + len(head)), None, {"type": " ".join(words[:-1]), "modifiers": modifiers})

    def method(self, found: tuple[str, str, str, str | None, int], seg: int, end: int, names: list[str], type_: str | None, body: tuple[int, int] | None) -> None:
        name, inside, returns, receiver, place = found
        package = names[0] if names and self.packaged else ""
        owner = type_ or (".".join([*names, receiver]) if receiver else ".".join([*names, "_functions" if self.language == "go" else "<module>"]))
        start = seg if self.language == "scala" else seg + _lead(self.plain[seg:end], place)
        head = self.plain[seg : body[0] if body else end]
        params, types = _parameters(inside, self.language)
        marks = [self.text[seg + a.start() : seg + a.end()].strip() for a in _ANNOTATION.finditer(head)]
        detail = {"class": owner, "parameters": params, "types": types, "returns": returns, "annotations": marks, "package": package}
        self.row("function", owner, name, start, end, detail)
        if body is None:
            return
        signature = f"{owner}#{name}({', '.join(types)})"
        at, first = body
        for m in _CALL.finditer(self.plain, body[0], body[1]):
            before = self.plain[max(0, m.start(2) - 8) : m.start(2)].rstrip()
            receiver_text = self.receiver(m.start(2)) if before.endswith(".") else None
            if receiver_text is None and m[2] in _NOT_NAMES:
                continue
            if before.endswith(("func", "def", "function")):
                continue
            close = _closing(self.plain, m.end() - 1)
            count = len(_split(self.plain[m.end() : close]))
            self.row("call", signature, m[2], m.start(2), None, {"receiver": receiver_text, "arguments": count, "column": m.start(2) - (self.breaks[self.line(m.start(2)) - 2] if self.line(m.start(2)) > 1 else -1), "text": (f"{receiver_text}." if receiver_text else "") + self.text[m.start(2) : close + 1], "created": before.endswith("new")})

    def receiver(self, at: int) -> str | None:
        """The text of the expression before a dot, back over brackets and names."""
        i = at
        while i and self.plain[i - 1] in " \t\n.?!":
            i -= 1
        stop, depth = i, 0
        while i:
            c = self.plain[i - 1]
            if c in ")]":
                depth += 1
            elif c in "([":
                if not depth:
                    break
                depth -= 1
            elif not depth and not (c.isalnum() or c in "_$.\"'`"):
                break
            i -= 1
        return self.text[i:stop].strip() or None


def rows_of(path: str, text: str, language: str | None = None) -> list[tuple[Any, ...]]:
    """Tagged rows of one file, by its suffix if no language is given; none for other files."""
    lang = language or LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    return _File(path, text, lang).parse() if lang in _BLANKED and text else []


def parse(files: DataFrame) -> DataFrame:
    """Tagged rows of files (path, text); a narrow step."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()]
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            got = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(p or "", t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, ROWS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a code graph from tagged rows: classes, methods, fields, callsites and inheritance, with content-hash ids."""
    suffix = F.lower(F.substring_index("path", ".", -1))
    language = None
    for s, name in LANGUAGES.items():
        language = F.when(suffix == s, name) if language is None else language.when(suffix == s, name)
    imports = rows.filter("kind = 'import'").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("imports"))
    c = rows.filter("kind = 'class'").withColumn("d", F.from_json("detail", "full_name string, extends string, implements array<string>, embeds array<string>, modifiers array<string>, annotations array<string>, stereotypes array<string>"))
    c = c.join(imports, "path", "left").select(ids.class_id("d.full_name", "path").alias("id"), F.coalesce("owner", F.lit("")).alias("package_name"), "name", "d.full_name", F.col("path").alias("file_path"), "start_line", "end_line", "d.modifiers", "d.annotations", "d.extends", "d.implements", F.to_json("d.implements").alias("implements_json"), "d.embeds", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), "d.stereotypes", language.alias("language"))
    m = rows.filter("kind = 'function'").withColumn("d", F.from_json("detail", "class string, parameters array<string>, types array<string>, returns string, annotations array<string>"))
    sig = ids.signature("d.class", "name", "d.types")
    m = m.select(ids.method_id(sig, "path", "start_line").alias("id"), ids.class_id("d.class", "path").alias("class_id"), F.col("d.class").alias("class_full_name"), F.col("name").alias("method_name"), F.col("d.returns").alias("return_type"), F.col("d.types").alias("parameter_types"), F.col("d.parameters").alias("parameter_names"), sig.alias("signature"), F.col("path").alias("file_path"), "start_line", "end_line", "d.annotations", language.alias("language")).dropDuplicates(["id"])
    f = rows.filter("kind = 'field'").withColumn("d", F.from_json("detail", "type string, modifiers array<string>")).select(F.col("owner").alias("class_full_name"), "name", F.col("d.type").alias("type_name"), "d.modifiers", F.col("path").alias("file_path"), "line")
    k = rows.filter("kind = 'call'").withColumn("d", F.from_json("detail", "receiver string, arguments int, column int, text string"))
    caller = m.groupBy("signature", F.col("file_path").alias("path")).agg(F.min("id").alias("caller_method_id"))
    k = k.join(caller, (k["owner"] == caller["signature"]) & (k["path"] == caller["path"])).select("caller_method_id", F.col("name").alias("callee_name"), "d.receiver", F.col("d.arguments").alias("argument_count"), k["path"].alias("file_path"), "line", F.col("d.column").alias("column_no"), "d.text")
    k = k.select(ids.call_id("caller_method_id", "line", "column_no", "callee_name").alias("id"), *k.columns)
    links = F.concat(F.when(F.col("extends").isNotNull(), F.array(F.struct(F.col("extends").alias("target"), F.lit("extends").alias("relation")))).otherwise(F.array().cast("array<struct<target:string,relation:string>>")), F.transform("implements", lambda x: F.struct(x.alias("target"), F.lit("implements").alias("relation"))), F.transform("embeds", lambda x: F.struct(x.alias("target"), F.lit("embeds").alias("relation"))))
    inheritance = c.select(F.col("id").alias("source_id"), F.col("full_name").alias("source"), F.explode(links).alias("e")).select("source_id", "source", "e.target", "e.relation")
    return {"classes": c, "methods": m, "fields": f, "callsites": k, "inheritance": inheritance}
