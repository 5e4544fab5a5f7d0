"""Files that nobody here wrote by hand: tool output, minified scripts, vendored copies, data kept as code.

Method: a *Re-Pair grammar* is inferred over the token sequences of each file's members together. Pairs of neighbouring
symbols that occur twice or more in the file become rules, the most frequent first, until none is left; the grammars of
many files are inferred at once, round by round, with array operations. From each file's grammar come the reuse of its
rules (how much shorter the sequences became; the number at a name's end and names that the file has but once or twice
count as alike, as members that a program writes differ in these) and the literals that no rule covers (near-incompressible ones). Rules that repeat within a file depend on the
file, so what repositories share is sought with a second grammar of pairs, chosen by the hash of the pair instead of its
frequency: equal runs of tokens then get equal rules, whatever stands around them and wherever they are.

* high reuse over short names on long lines: minified; extreme reuse over many members: written by a program
* mostly literals that no rule covers: data kept as code
* long rules found in ``SHARED_REPOSITORIES`` or more repositories, covering most of a file: a vendored copy

Beside the grammars stand what tools declare: banners above the first declaration, annotations of classes that name a
tool, places in the tree (judged against the repository's own source root, so that a package of one's own that is called
``vendor`` is none) and ``generated``, which is believed only where two or more members that have a source all bear it.

Rows are brought together by file with a rebalancing exchange, which splits a file of very many rows over tasks; evidence
is summed per file, so no file or repository has to fit one task, and a slice of a file is at most ``SLICE`` tokens. Of
rows of one id in one file the one indexed last counts. Defined results: null and empty sources have no grammar; a null
path belongs to no file and gives no row; paths are returned as stored; repeated rows change nothing; texts of any length
are read whole. Only the named columns are read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A grammar needs so many tokens before its shape says anything.
LEAST_TOKENS = 40
#: 1 - (length of the compressed sequences and their rules) / tokens, of a whole file
MINIFIED_REUSE, WRITTEN_REUSE, WRITTEN_TOKENS, WRITTEN_MEMBERS = 0.15, 0.75, 400, 8
LITERAL_SHARE = 0.3
#: Rules of at least so many tokens are compared between repositories; a file shared must have so many tokens.
RULE_TOKENS, SHARED_TOKENS, SHARED_REPOSITORIES = 12, 64, 3
LONG_LINE = 200
#: A name that a file has no more often is a symbol like any other such name.
RARE = 2
#: Members that must bear the flag ``generated``, all of those with a source, before it is believed of the file.
FLAGGED_MEMBERS = 2
#: Tokens of the files whose grammars are inferred at once; of a longer file, the slices' evidence is summed.
SLICE = 1 << 20
#: Characters of a member that are cut into tokens at once.
WINDOW = 1 << 22

_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\S")
_LITERAL = re.compile(r"\d[\w.]*|[\"'][\w+/=.\\-]{5,}[\"']")

# What tools write above the first declaration.
GENERATED_BANNER = re.compile(
    r"^\s*(?:@generated\b|</?auto-?generated\b|code generated\b|auto-?generated\b(?!.*\bstub\b)|generated (?:by|from|with|using)\b(?!.*\bstub\b)|machine[- ](?:written|generated|made)\b"
    r"|this (?:file|code|class|module|source) (?:is|was|has been) (?:\w+ly |auto-?|machine[- ])?(?:generated|created|written|produced|built)\b.*\b(?:by|from|with)\b"
    r"|(?:automatisch|maschinell)\b.*\b(?:erzeugt|generiert|erstellt)|.*\b(?:erzeugt|generiert) (?:von|aus|mit)\b.*nicht|(?:fichier |code )?généré (?:par|automatiquement|à partir)|(?:archivo |código )?generado (?:por|automáticamente|a partir)|(?:файл |код )?сгенерирован|.*自動生成|.*自动生成"
    r"|do not (?:edit|modify)\b.*\b(?:generated|overwritten|regenerated)|.*\b(?:edits|changes) (?:get|will be|are) (?:lost|overwritten)\b.*\b(?:by|run|build|time)\b)",
    re.I,
)
VENDORED_BANNER = re.compile(
    r"copied (?:verbatim |unchanged )?from upstream|originally part of\b|imported unchanged|\bbundled here\b|\bvendored\b|keep in sync with (?:the )?(?:upstream|[\w.-]+ release)|^\s*!?\s*[\w.@/-]+ v?\d+(?:\.\d+)+\s*\|\s*\(c\)|third[- ]party (?:code|copy|source)\b.*\bfrom\b",
    re.I,
)
_COMMENT = re.compile(r"^\s*(?:///?!?|#+|/\*+!?|\*+/?|<!--|--|\(\*)\s?(.*?)\s*(?:\*/|-->|\*\))?\s*$")

# Places where builds, package managers and bundlers put files.
_OUTSIDE_SOURCES = r"(?:_?vendor|third_?party|3rdparty|external|dist|out|obj/(?:debug|release)|build/generated|target/(?:generated-[\w-]+|scala-[^/]+/src_managed)|packages/[a-z][\w-]*(?:\.\d+)+)"
_ANYWHERE = r"(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|\.tox|\.venv|__generated__|generated-sources|src_managed|_vendor)"
_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|[._]pb\.(?:ts|js|go|cc|h)|\.pb(?:\.gw)?\.go|_grpc\.pb\.go|[._]gen\.go|_generated\.go|\.generated\.[a-z]+|\.min\.(?:js|css)|[.-](?:chunk|bundle)\.js|[.-][0-9a-f]{8,}\.js|-\d+\.\d+\.\d+\.js|\.(?:designer|g|g\.i)\.cs)$|/zz_generated[^/]*$"

# Annotations by which compilers and generators sign a class, with or without the name of the tool.
GENERATED_ANNOTATION = r"^[@\[]\s*(?:[\w.]+\.)?(?:(?:auto)?generated(?:code)?(?:attribute)?\s*\(\s*\S|compilergenerated(?:attribute)?\b)"


def _clean(path: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/"))
    return F.regexp_replace(plain, r"^(?:\./)+", "")


def repository(path: Column) -> Column:
    """The first directory of a path."""
    return F.substring_index(_clean(path), "/", 1)


def marked_path(path: Column) -> Column:
    """Whether a path lies where tools put files. Directories with common names count only outside source roots."""
    p = _clean(path)
    before = F.regexp_extract(p, r"^(.*?)(?:(?:^|/)(?:src|internal|lib|tests?)/|[^/]*$)", 1)
    return F.concat(F.lit("/"), before, F.lit("/")).rlike(f"/{_OUTSIDE_SOURCES}/") | F.concat(F.lit("/"), p).rlike(f"/{_ANYWHERE}/") | p.rlike(_NAMES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def grammars(tokens: np.ndarray, members: np.ndarray, files: np.ndarray, hashes: np.ndarray) -> dict[str, Any]:
    """Re-Pair over the files of a slice at once. ``tokens`` are numbers of distinct tokens, ``members`` (rising) the member
    of each, ``files`` (rising) the file of each member, ``hashes`` the 64-bit hash of each distinct token. No pair reaches
    over a member's end; pairs are counted per file. Of equally frequent pairs the one of greater hash goes first, so the
    outcome doesn't depend on the other files of the slice.

    A slice of n tokens has fewer than 2n symbols and n files, so three numbers of 21 bits hold a pair of a file."""
    if len(tokens) > SLICE:
        raise ValueError("a slice is too long")
    symbols, hash_of = tokens.astype(np.int64), hashes.copy()
    count = int(files[-1]) + 1 if len(files) else 0
    rules = np.zeros(count, np.int64)
    while len(symbols) > 1:
        a, b = symbols[:-1], symbols[1:]
        row = files[members[:-1]]
        bits = max(12, int(len(symbols)).bit_length() + 2)
        mixed = ((a * 0x2545F491) ^ (b * 0x9E3779B1) ^ (row * 0x85EBCA6B)) & ((1 << bits) - 1)
        together = members[:-1] == members[1:]
        seen = np.bincount(mixed[together], minlength=1 << bits)  # most pairs occur once: leave them before sorting
        at = np.flatnonzero(together & (seen[mixed] > 1))
        if not len(at):
            break
        kinds, kind, times = np.unique((row[at] << 42) | (a[at] << 21) | b[at], return_inverse=True, return_counts=True)
        keep = times[kind] > 1
        at, kind = at[keep], kind[keep]
        if not len(at):
            break
        x, y = (kinds >> 21) & 0x1FFFFF, kinds & 0x1FFFFF
        with np.errstate(over="ignore"):
            pair_hash = _mixed(hash_of[x] * np.uint64(0xD6E8FEB86659FD93) + hash_of[y])
        # the more frequent of two overlapping pairs wins; of equal ones in a row every other from the left
        score = np.zeros(len(symbols) + 1, np.int64)
        score[at] = (times[kind] << 40) | (pair_hash[kind] >> np.uint64(24)).astype(np.int64)
        here, left, right = score[at], score[at - 1], score[at + 1]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (here[1:] != here[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        taken = ((np.arange(len(at)) - start) % 2 == 0) & ((here > left) | ~fresh) & ((here > right) | (here == right))
        at, kind = at[taken], kind[taken]
        used = np.bincount(kind, minlength=len(kinds))
        keep = used[kind] > 1
        if not keep.any():  # the most frequent pair of a file always wins somewhere; twice or more unless all overlap
            break
        at, kind = at[keep], kind[keep]
        chosen, number = np.unique(kind, return_inverse=True)
        rules += np.bincount(kinds[chosen] >> 42, minlength=count)
        symbols[at] = len(hash_of) + number
        hash_of = np.concatenate([hash_of, pair_hash[chosen]])
        rest = np.ones(len(symbols), bool)
        rest[at + 1] = False
        symbols, members = symbols[rest], members[rest]
    return {"final": np.bincount(files[members], minlength=count), "rules": rules, "symbols": symbols, "members": members}


def phrases(tokens: np.ndarray, members: np.ndarray, files: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """File, hash and length of the rules of ``RULE_TOKENS`` tokens or more, each once a file, with the tokens they cover.

    Rounds of pairing in which a pair is joined if its hash is the greatest among its neighbours': what happens to a run of
    tokens depends on the run alone but for a few symbols at its ends. Each round takes away about a third."""
    h, length = hashes[tokens], np.ones(len(tokens), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(12):
        done = length >= RULE_TOKENS
        if done.any():  # a rule that is long enough is given out and stays as a mark between its neighbours
            out.append((files[members[done]], h[done], length[done]))
        if len(h) < 2:
            break
        run = np.ones(len(h), bool)  # a symbol repeated in a row becomes one
        run[1:] = (h[1:] != h[:-1]) | (members[1:] != members[:-1]) | done[1:] | done[:-1]
        if not run.all():
            first = np.flatnonzero(run)
            times, unit = np.diff(np.append(first, len(h))), length[first]
            # a ruler is as long as its token; runs that are long enough are alike, however long
            length = np.where(unit > 1, unit * times, unit)
            times = np.minimum(times, -(-RULE_TOKENS // unit))
            members, done, h = members[first], done[first], h[first]
            with np.errstate(over="ignore"):
                h = np.where(times > 1, _mixed(h + times.astype(np.uint64)), h)
        with np.errstate(over="ignore"):
            pair = _mixed(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) >> np.uint64(1)
        long = length >= RULE_TOKENS
        pair[(members[:-1] != members[1:]) | long[:-1] | long[1:]] = 0  # at least one symbol is left: h isn't empty
        around = np.concatenate([[np.uint64(0)], pair, [np.uint64(0)]])
        at = np.flatnonzero((pair > around[:-2]) & (pair > around[2:]))
        h[at], rest = pair[at], np.ones(len(h), bool)
        length[at] += length[at + 1]
        rest[at + 1] = False
        rest &= ~done
        # what was given out leaves; members keep their neighbours apart, as the mark would, by a member of their own
        gap = np.cumsum(done)
        members_now = members[rest]
        h, length, split = h[rest], length[rest], gap[rest]
        key = np.stack([members_now, split])
        step = np.ones(len(h), bool)
        step[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        order = np.cumsum(step) - 1
        files, members = files[members_now[step]], order
        if not len(h):
            break
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    f, r, n = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((r, f))
    f, r, n = f[order], r[order], n[order]
    first = np.ones(len(f), bool)
    first[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    return f[at], r[at], np.add.reduceat(n, at) if len(at) else n


class _Lexer(dict):
    """Numbers of distinct tokens within a batch."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self.kinds: list[int] = []  # 1 literal, 2 name of one letter, 3 other name

    def __missing__(self, token: str) -> int:
        if token[-1].isdigit() and (token[0].isalpha() or token[0] in "_$"):
            self[token] = n = self[token.rstrip("0123456789") + "#"]
            return n
        self[token] = n = len(self.kinds)
        self.hashes.append(xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) | 1)
        self.kinds.append(1 if _LITERAL.fullmatch(token) else (2 if len(token) == 1 else 3) if token[0].isalpha() or token[0] in "_$" else 0)
        return n


def banner(source: str) -> int:
    """1 for a tool's banner, 2 for a vendored copy's, 0 for none, in the comments above the first declaration."""
    end = 0
    while end < len(source):
        line_end = source.find("\n", end)
        line = source[end : line_end if line_end >= 0 else len(source)]
        end = len(source) if line_end < 0 else line_end + 1
        if not line.strip():
            continue
        m = _COMMENT.match(line)
        if m is None:
            return 0
        if GENERATED_BANNER.search(m[1]):
            return 1
        if VENDORED_BANNER.search(m[1]):
            return 2
    return 0


def _rare_alike(tokens: np.ndarray, files: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Tokens with the names that a file has once or twice as one symbol (the last number): what a program writes differs in
    just these from member to member."""
    pair = files * len(kinds) + tokens
    _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
    return np.where((times[at] <= RARE) & (kinds[tokens] == 3), len(kinds) - 1, tokens)


_EVIDENCE = "file_path string, members long, flagged long, unflagged long, tokens long, rest long, minified long, data long, tool int, vendored int, rules array<struct<hash:bigint,tokens:bigint>>"


class _Slice:
    """Members of files, in order of files, up to ``SLICE`` tokens."""

    def __init__(self) -> None:
        self.lexer, self.numbers = _Lexer(), array("i")
        self.paths: list[str] = []
        self.members: list[tuple[int, int, int, int, int]] = []  # file, tokens, longest line, banner, flag (1, 0, -1 for none)

    def add(self, path: str, text: str, longest: int, mark: int, flag: int) -> Iterator:
        found = _TOKEN.findall(text)
        for at in range(0, max(len(found), 1), SLICE // 2):
            part = found[at : at + SLICE // 2]
            if len(self.numbers) + len(part) > SLICE:
                yield from self.close()
            if not self.paths or self.paths[-1] != path:
                self.paths.append(path)
            self.numbers.extend(array("i", map(self.lexer.__getitem__, part)))
            self.members.append((len(self.paths) - 1, len(part), longest, mark, flag))
            mark, flag = 0, -1

    def close(self) -> Iterator:
        import pyarrow as pa

        if not self.members:
            return
        file, size, longest, mark, flag = (np.array(x, np.int64) for x in zip(*self.members, strict=True))
        n, tokens = len(self.paths), np.frombuffer(self.numbers, np.int32).copy()
        member = np.repeat(np.arange(len(size)), size)
        kinds = np.array([*self.lexer.kinds, 0], np.int8)
        hashes = np.array([*self.lexer.hashes, 0], np.uint64)
        g = grammars(_rare_alike(tokens, file[member], kinds), member, file, hashes)
        at_end = g["symbols"] < len(kinds)
        literal = at_end & (kinds[np.where(at_end, g["symbols"], len(kinds) - 1)] == 1)
        free = np.bincount(g["members"][literal], minlength=len(size))
        short, named = (np.bincount(member[np.isin(kinds[tokens], k)], minlength=len(size)) for k in ([2], [2, 3]))
        minified = (size >= LEAST_TOKENS) & (longest >= LONG_LINE) & (2 * short >= named) & (named > 0)
        data = (size >= LEAST_TOKENS) & (free >= LITERAL_SHARE * size)
        total = lambda x: np.bincount(file, weights=x, minlength=n).astype(np.int64)
        rules: list[list[dict[str, int]]] = [[] for _ in range(n)]
        for f, h, t in zip(*(x.tolist() for x in phrases(tokens, member, file, hashes)), strict=True):
            rules[f].append({"hash": h - (1 << 63), "tokens": t})
        columns = [total(size > 0), total(flag == 1), total(flag == 0), total(size), g["final"] + 2 * g["rules"], total(minified * size), total(data * size)]
        marks = [total(mark == m) > 0 for m in (1, 2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.paths, pa.string()), *map(pa.array, columns), *(pa.array(m.astype(np.int32)) for m in marks), pa.array(rules, pa.list_(pa.struct([("hash", pa.int64()), ("tokens", pa.int64())])))],
            names=["file_path", "members", "flagged", "unflagged", "tokens", "rest", "minified", "data", "tool", "vendored", "rules"],
        )
        self.__init__()


def _windows(text: str) -> Iterator[str]:
    """A text in parts of at most ``WINDOW`` characters, cut at line ends where there are any."""
    at = 0
    while len(text) - at > WINDOW:
        end = text.rfind("\n", at, at + WINDOW) + 1
        end = end if end > at else at + WINDOW
        yield text[at:end]
        at = end
    yield text[at:]


def evidence(members: DataFrame) -> DataFrame:
    """What the grammars of each file's members, their leading comments and flags say: one or more rows a file, to be summed."""
    read = members.select("file_path", "id", "indexed_at", "source", "generated").filter("file_path is not null and source is not null")
    near = read.hint("rebalance", "file_path").sortWithinPartitions("file_path", "id", F.desc("indexed_at"), "source")

    def run(batches: Iterator) -> Iterator:
        slice_, before = _Slice(), None
        for batch in batches:
            for path, id_, source, flag in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if id_ is not None and (path, id_) == before:
                    continue
                before = (path, id_)
                longest, mark, bears = max(map(len, source.split("\n"))), banner(source), -1 if flag is None or not source else int(flag)
                for part in _windows(source):
                    yield from slice_.add(path, part, longest, mark, bears)
                    mark, bears = 0, -1
        yield from slice_.close()

    return near.mapInArrow(run, _EVIDENCE)


def judged_files(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Each file of either table with its verdicts: file_path, path, tool, vendored, annotated, flagged, minified, written,
    data, shared (booleans) and by_hand."""
    members = cut(evidence(methods))  # the grammars are dear and read three times
    sums = [F.sum(c).alias(c) for c in ("members", "flagged", "unflagged", "tokens", "rest", "minified", "data")]
    files = members.groupBy("file_path").agg(*sums, F.max("tool").alias("tool"), F.max("vendored").alias("vendored"))

    long = members.select("file_path", F.explode("rules").alias("r")).select("file_path", "r.hash", "r.tokens")
    long = long.groupBy("file_path", "hash").agg(F.max("tokens").alias("tokens"))
    wide = long.select("hash", repository(F.col("file_path")).alias("repository")).distinct().groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED_REPOSITORIES)
    shared = long.join(wide, "hash").groupBy("file_path").agg(F.sum("tokens").alias("shared"))

    named = F.exists("annotations", lambda x: F.lower(F.trim(x)).rlike(GENERATED_ANNOTATION))
    annotated = classes.filter("file_path is not null").groupBy("file_path").agg(F.max(F.coalesce(named, F.lit(False))).alias("annotated"))
    paths = methods.filter("file_path is not null").select("file_path").distinct()
    files = paths.join(annotated, "file_path", "full_outer").join(files, "file_path", "left").join(shared, "file_path", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    reuse = 1 - number("rest") / F.greatest(number("tokens"), F.lit(1))
    most = lambda c, times: (number(c) * times >= number("tokens")) & (number("tokens") > 0)
    judged = files.select(
        "file_path",
        F.coalesce(marked_path(F.col("file_path")), F.lit(False)).alias("path"),
        (number("tool") > 0).alias("tool"),
        (number("vendored") > 0).alias("vendored"),
        F.coalesce("annotated", F.lit(False)).alias("annotated"),
        ((number("flagged") >= FLAGGED_MEMBERS) & (number("unflagged") == 0)).alias("flagged"),
        (most("minified", 2) & (reuse >= MINIFIED_REUSE)).alias("minified"),
        ((number("tokens") >= WRITTEN_TOKENS) & (number("members") >= WRITTEN_MEMBERS) & (reuse >= WRITTEN_REUSE)).alias("written"),
        most("data", 3).alias("data"),
        (most("shared", 2) & (number("tokens") >= SHARED_TOKENS)).alias("shared"),
    )
    verdicts = [c for c in judged.columns if c != "file_path"]
    return judged.withColumn("by_hand", ~F.greatest(*verdicts))
