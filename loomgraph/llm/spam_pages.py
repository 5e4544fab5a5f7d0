"""Pages stuffed with keywords, lists of links and lists of tags.

Method: a text is cut into lines, lines of a paragraph are joined and cut into sentences, and each of these units becomes
a handful of features: code or linked or plain, closed by a sentence mark or not, its size, separators, how much of it are
words that the page itself repeats, how varied it is. A hidden Markov model labels the units as prose, structure (code, logs,
tables, configuration), link list, tag list or menu; the labels are the most likely sequence (Viterbi), so that a heading
between sentences stays prose while the same words in a run of short lines are a menu. A page is a case if the lines of
the last three labels hold at least ``SHARE`` of its words.

No feature knows a language: no word list takes part. Emissions and the probability to stay are learned by Baum-Welch from
all units of all pages, beginning with ``PRIOR``, which gives the labels their meaning and goes on to count as ``PRIOR_UNITS``
observed units of each label for ``PAGES`` pages: the evidence of more pages is weighed down to that of so many, and that of
a page of more units to that of ``PAGE_UNITS``, so that neither a large table nor a long page drowns the prior. The units are
taken from the texts once and stored; each round sums up what it expects over them.

Defined results: null, empty, blank and very short texts (fewer than ``LEAST_WORDS`` words) are no cases and have no
labelled words; texts of any length are read whole; repeated rows are judged alike; a table without usable pages keeps
the prior. Only the key and the text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

SHARE, LEAST_WORDS = 0.55, 15
#: Lines shorter than this are code or not as a whole; of longer ones each sentence is.
SHORT_LINE = 120
#: Lines of at least so many characters that no sentence mark closes go on in the next line.
WRAPPED = 50
#: A pair of words is hot with so large a share of the page's pairs, a word with so large a share of its words.
HOT_PAIR, HOT_WORD = 0.05, 0.15
#: What pages, and the units of one, weigh at most when the model is learned; the rounds, and the weight of the prior.
PAGES, PAGE_UNITS, ROUNDS, PRIOR_UNITS = 2048, 64, 4, 4000
#: Units that are summed up at once, and how fine sums are kept: as integers, they don't depend on their order.
UNITS_AT_ONCE, FINE = 1 << 17, 1 << 20

STATES = ("prose", "structure", "links", "tags", "menu")
#: P(value | label) of each feature at the start, labels in the order of STATES.
PRIOR = {
    "kind": ((0.93, 0.04, 0.03), (0.12, 0.86, 0.02), (0.14, 0.01, 0.85), (0.96, 0.02, 0.02), (0.95, 0.02, 0.03)),  # plain, code, linked
    "closed": ((0.15, 0.85), (0.80, 0.20), (0.75, 0.25), (0.60, 0.40), (0.97, 0.03)),  # no, yes
    "size": ((0.08, 0.20, 0.32, 0.35, 0.05), (0.35, 0.35, 0.20, 0.08, 0.02), (0.30, 0.35, 0.25, 0.08, 0.02), (0.08, 0.17, 0.20, 0.30, 0.25), (0.72, 0.25, 0.02, 0.005, 0.005)),  # to 3, 7, 13, 39 words, more
    "separated": ((0.72, 0.22, 0.055, 0.005), (0.45, 0.28, 0.15, 0.12), (0.50, 0.25, 0.15, 0.10), (0.30, 0.20, 0.20, 0.30), (0.76, 0.08, 0.08, 0.08)),  # hardly, some, many, nearly every word
    "repeated": ((0.93, 0.06, 0.01), (0.70, 0.20, 0.10), (0.80, 0.10, 0.10), (0.25, 0.25, 0.50), (0.75, 0.15, 0.10)),  # hardly, some, much
    "monotonous": ((0.93, 0.07), (0.60, 0.40), (0.70, 0.30), (0.30, 0.70), (0.60, 0.40)),  # no, yes
}
SIZES = tuple(len(rows[0]) for rows in PRIOR.values())
#: P(the label stays); the rest is spread evenly over the other labels.
STAY = 0.9
#: P(first label); kept as it is, lest short pages be judged by how many pages of their kind there are.
START = (0.24, 0.19, 0.19, 0.19, 0.19)

# The characters that Unicode calls sentence terminals, of the scripts in use, with the ellipsis and colon.
_ENDS = ".!?…:。！？｡؟۔।॥։።၊။។៕᠃᠉"
_LINES = re.compile(r"[^\n\r\x0b\x0c\u2028\u2029]+|\n[ \t]*\r?\n")
_BREAK = re.compile(r"<br\s*/?>", re.I)
_SENTENCES = re.compile(r"(?:[^.!?…。！？｡؟۔।॥։።။។]+|[.!?…]+(?![\s).!?…]))*(?:[.!?…]+[\s)]+|[.!?…]+$|[。！？｡؟۔।॥։።။។]+|$)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_URL = re.compile(r"(?:https?|ftp)://[^\s\"'<>)\]]*|www\.[^\s\"'<>)\]]+", re.I)
_LINK = re.compile(r"https?://|www\.|\bhref\s*=", re.I)
_BULLET = re.compile(r"^\s*(?:[-*+•>#|]|\d+[.)]\s)")
_CODE = re.compile(
    r"^\s*(?:\d{4}-\d\d-\d\d[ T]\d|\[?\d\d:\d\d|at\s+[\w.$<>]+\(|Caused by|Traceback|File \"|[\w.]+(?:Exception|Error)\b|//|/?\*|#\s*\w.*[;:]$|@\w+\b(?:\(|$)|\||[+|-]{3,}|[-+]\s*[\w.]+\(|import\s|package\s|from\s+\S+\s+import|def\s+\w|func\s|class\s+\w+.*[{:]$|return\b|(?:public|private|protected)\s"
    r"|(?:if|for|while|with|elif|else|try|switch|foreach)\b.*[:{)]\s*$|(?:const|let|var|val|final)\s+\w+.*=|[\w.\"-]+\s*[=:]\s*(?!//)\S*\s*[,;]?$|[}\])]+[;,]?\s*$|\$\s|>>>\s|<\?|<!|\{|\\)"
)
#: What shows code anywhere in a line.
_OPERATORS = (":=", "==", "!=", "&&", "=>", "->", "()", '"""', "'''", " nil", " null", " None")
_MARKS = "{}();=<>[]$"
#: What shows code anywhere in a line.
_OPERATORS = (":=", "==", "!=", "&&", "=>", "->", "()", '"""', "'''", " nil", " null", " None")
_MARKS = "{}();=<>[]$"
_SEPARATORS = re.compile(r"[,|;/·•،#]|\s[-–—]\s")


@dataclass(frozen=True)
class Model:
    """Logarithms: of each combination of features (rows) under each label, of the starts, of staying and of moving."""

    emission: list[list[float]]
    start: list[float]
    stay: float
    move: float


def _model(tables: list[np.ndarray], start: np.ndarray, stay: float) -> Model:
    logs = np.zeros((1, len(STATES)))
    for t in tables:  # the first feature counts slowest
        logs = (logs[:, None, :] + np.log(t.T)[None, :, :]).reshape(-1, len(STATES))
    return Model(logs.tolist(), np.log(start).tolist(), float(np.log(stay)), float(np.log((1 - stay) / (len(STATES) - 1))))


PRIOR_MODEL = _model([np.array(t) for t in PRIOR.values()], np.array(START), STAY)


def expected(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """(combinations + 1, labels): how often each combination of features is expected under each label; in the last row how
    often a label is expected to stay, all moves, and the pages. Of ``sequences`` none is empty."""
    e, start = np.exp(np.array(m.emission)), np.exp(np.array(m.start))
    stay, move = np.exp(m.stay), np.exp(m.move)
    out = np.zeros((len(e) + 1, len(STATES)))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    while order:
        width = len(sequences[order[0]])
        n = max(1, UNITS_AT_ONCE // width)
        part, order = [sequences[i] for i in order[:n]], order[n:]
        lengths = np.array([len(s) for s in part])  # falling, so that at each step the first pages go on
        n, on = len(part), (lengths[None, :] > np.arange(width)[:, None]).sum(1)
        there = np.arange(width)[:, None] < lengths[None, :]
        symbols = np.zeros((width, n), np.int64)
        symbols.T[there.T] = np.concatenate(part)
        emit = e[symbols]
        forward, back = np.zeros((width, n, len(STATES))), np.ones((width, n, len(STATES)))
        forward[0] = emit[0] * start
        forward[0] /= forward[0].sum(1, keepdims=True)
        for t in range(1, width):  # a label is reached from itself or, equally, from the others
            step = (move + (stay - move) * forward[t - 1, : on[t]]) * emit[t, : on[t]]
            forward[t, : on[t]] = step / step.sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            ahead = back[t + 1, : on[t + 1]] * emit[t + 1, : on[t + 1]]
            step = move * ahead.sum(1, keepdims=True) + (stay - move) * ahead
            back[t, : on[t + 1]] = step / step.sum(1, keepdims=True)
        weight = np.minimum(1, PAGE_UNITS / lengths)
        share = forward * back
        share *= (weight[None, :] * there / np.where(there, share.sum(2), 1))[:, :, None]
        flat, there_flat = symbols.ravel(), there.ravel()
        for k in range(len(STATES)):
            out[:-1, k] += np.bincount(flat[there_flat], share[:, :, k].ravel()[there_flat], minlength=len(e))
        ahead, before = back[1:] * emit[1:], forward[:-1]
        both = ((move + (stay - move) * before) * ahead).sum(2)
        stayed = stay * (before * ahead).sum(2) / np.where(there[1:], both, 1)
        out[-1, 0] += (stayed * there[1:] * weight).sum()
        out[-1, 1] += ((lengths - 1) * weight).sum()
        out[-1, 2] += n
    return out


def _fitted(sums: Callable[[Model], np.ndarray]) -> Model:
    """Baum-Welch, with a function that sums up :func:`expected` of a model; PRIOR is the beginning and the Dirichlet prior."""
    priors = [np.array(t) for t in PRIOR.values()]
    model = PRIOR_MODEL
    for _ in range(ROUNDS):
        got = sums(model)
        stayed, moved, pages = got[-1, :3]
        if not pages:
            return PRIOR_MODEL
        scale = min(1.0, PAGES / pages)
        by = got[:-1].reshape(*SIZES, len(STATES)) * scale
        tables = []
        for i, prior in enumerate(priors):
            counts = by.sum(tuple(j for j in range(len(SIZES)) if j != i)).T + PRIOR_UNITS * prior
            tables.append(counts / counts.sum(1, keepdims=True))
        model = _model(tables, np.array(START), (stayed * scale + PRIOR_UNITS * STAY) / (moved * scale + PRIOR_UNITS))
    return model


def fit(sequences: list[list[int]]) -> Model:
    """The model of sequences of feature combinations."""
    seen = [np.array(s, np.int64) for s in sequences if s]
    return _fitted(lambda m: expected(seen, m))


def _weight(words: list[str]) -> int:
    """The number of words; run-together words and scripts without spaces count by length."""
    return max(len(words), sum(map(len, words)) // 6)


def _sentences(line: str) -> Iterator[str]:
    for part in _BREAK.split(line) if "<br" in line else (line,):
        yield from filter(None, _SENTENCES.findall(part))


def _code(line: str, stripped: str) -> bool:
    if stripped[-1] in ";{}" or line[0] == "\t" and line[1:2].isalpha() or _CODE.match(line):
        return True
    for operator in _OPERATORS:
        if operator in line:
            return True
    return sum(map(line.count, _MARKS)) * 12 > len(stripped)


def _closed(stripped: str) -> bool:
    return stripped[-1] in _ENDS or stripped[-1] in ")\"'`*_»”」" and stripped[-2:-1] in _ENDS


def _hot(pages_words: list[list[str]]) -> tuple[set[tuple[str, str]], set[str]]:
    """Pairs of neighbouring words and words that the page repeats far more often than prose in any language does."""
    flat = list(chain.from_iterable(pages_words))
    words, n = Counter(flat), len(flat)
    pairs = Counter(chain.from_iterable(zip(ws, ws[1:], strict=False) for ws in pages_words))
    least_pair, least_word = max(4, HOT_PAIR * n), max(6, HOT_WORD * n)
    return {p for p, c in pairs.items() if c >= least_pair}, {w for w, c in words.items() if c >= least_word}


def _heat(ws: list[str], closed: bool, pairs: set[tuple[str, str]], words: set[str]) -> int:
    """Words of a unit that are hot, by themselves or in a pair. In a closed sentence only what it repeats itself counts, as
    pages also repeat whole sentences."""
    if not pairs and not words:
        return 0
    hot: dict[object, list[int]] = {}
    for i, w in enumerate(ws):
        if w in words:
            hot.setdefault(w, []).append(i)
        if i and (p := (ws[i - 1], w)) in pairs:
            hot.setdefault(p, []).extend((i - 1, i))
    least = 1 if not closed else 2
    return len({i for key, at in hot.items() if len(at) >= least * (1 if isinstance(key, str) else 2) for i in at})


def symbols(text: str) -> tuple[list[int], list[int]]:
    """The feature combination, as one number, and the number of words of each unit."""
    lines: list[tuple[str, bool]] = []  # text, whether it is code
    fenced = going = False
    for whole in _LINES.findall(text):
        stripped = whole.strip()
        if not stripped:
            going = False
            continue
        if stripped[:3] in ("```", "~~~"):
            fenced, going = not fenced, False
            continue
        linked = "http" in whole or "www." in whole or "href" in whole
        if fenced or len(whole) < SHORT_LINE and not linked and _code(whole, stripped):
            lines.append((whole, True))
            going = False
        elif going and not _BULLET.match(whole):
            lines[-1] = (lines[-1][0] + " " + stripped, False)
            going = len(stripped) >= WRAPPED and not _closed(stripped) and not linked
        else:
            lines.append((whole, False))
            going = len(stripped) >= WRAPPED and not _closed(stripped) and not linked
    units: list[tuple[int, bool, list[str], int]] = []  # kind, closed, words, separators; code has no words
    sizes: list[int] = []
    for whole, is_code in lines:
        if is_code:
            units.append((1, _closed(whole.strip()), [], 0))
            sizes.append(whole.count(" ") + 1)
            continue
        linked = "http" in whole or "www." in whole or "href" in whole
        for line in _sentences(whole):
            stripped = line.strip()
            if not stripped:
                continue
            closed = _closed(stripped)
            if not linked and len(whole) >= SHORT_LINE and _code(line, stripped):
                units.append((1, closed, [], 0))
                sizes.append(line.count(" ") + 1)
                continue
            ws = _WORD.findall(line.lower())
            if not ws:
                continue
            kind = 0
            if linked and (links := len(_LINK.findall(line))):
                if stripped[0] == "(" and units and units[-1][1]:
                    continue  # a reference behind a sentence
                rest = _WORD.findall(_URL.sub(" ", line.lower()))
                outside = _weight(rest) - 2 * line.count("</a")
                if outside > 7 * links or closed and outside >= 5 * links:
                    ws = rest
                else:
                    kind = 2
            units.append((kind, closed, ws, 0 if kind == 2 else len(_SEPARATORS.findall(line))))
            sizes.append(_weight(ws))
    pairs, hot = _hot([ws for kind, _, ws, _ in units if kind == 0])
    out = []
    for (kind, closed, ws, separators), n in zip(units, sizes, strict=True):
        size = 0 if n <= 3 else 1 if n <= 7 else 2 if n <= 13 else 3 if n <= 39 else 4
        separated = 0 if separators * 10 < len(ws) or not ws else 1 if separators * 5 < len(ws) else 2 if separators * 2 < len(ws) else 3
        heat = _heat(ws, closed, pairs, hot) if kind == 0 and len(ws) > 2 else 0
        repeated = 0 if heat * 6 < n or not heat else 1 if heat * 3 < n else 2
        monotonous = len(ws) >= 14 and len(set(ws)) * 10 < len(ws) * 7
        number = kind
        for value, values in zip((closed, size, separated, repeated, monotonous), SIZES[1:], strict=True):
            number = number * values + value
        out.append(number)
    return out, sizes


def viterbi(observed: list[int], m: Model = PRIOR_MODEL) -> list[int]:
    """The most likely labels. All moves between labels are equally likely, so a label is reached from itself or from the
    best label, and a step takes as many operations as there are labels. Only differences of scores matter."""
    if not observed:
        return []
    gap = m.stay - m.move
    score = [p + e for p, e in zip(m.start, m.emission[observed[0]], strict=True)]
    back = []
    for symbol in observed[1:]:
        most = max(score)
        best, least = score.index(most), most - gap
        back.append((best, least, score))
        score = [(x if x >= least else least) + e for x, e in zip(score, m.emission[symbol], strict=True)]
    state = score.index(max(score))
    path = [state]
    for best, least, before in reversed(back):
        if before[state] < least:
            state = best
        path.append(state)
    return path[::-1]


def label(text: str | None, m: Model = PRIOR_MODEL) -> list[int]:
    """Words of a text by label, in the order of STATES."""
    out = [0] * len(STATES)
    if text:
        observed, sizes = symbols(text)
        for state, n in zip(viterbi(observed, m), sizes, strict=True):
            out[state] += n
    return out


def units_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, and of each page the feature combinations and words of its units as bytes."""
    read = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pages = [symbols(t) if t else ((), ()) for t in batch.column(1).to_pylist()]
            parts = [pa.array([np.array(p[i], kind).tobytes() for p in pages], pa.binary()) for i, kind in enumerate((np.uint16, np.uint32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=[key, "_units", "_sizes"])

    return read.mapInArrow(run, T.StructType([T.StructField(key, read.schema[0].dataType), T.StructField("_units", T.BinaryType()), T.StructField("_sizes", T.BinaryType())]))


def learned(units: DataFrame) -> Model:
    """The model of all pages of :func:`units_of`: a pass over their units a round."""
    kept = units.select("_units").filter(F.length("_units") > 0)
    names = [f"_{s}" for s in STATES]

    def sums(m: Model) -> np.ndarray:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((len(m.emission) + 1, len(STATES)))
            for batch in batches:
                total += expected([np.frombuffer(b, np.uint16).astype(np.int64) for b in batch.column(0).to_pylist()], m)
            seen = np.flatnonzero(total.any(1))
            fine = np.rint(total[seen] * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *(pa.array(fine[:, k]) for k in range(len(STATES)))], names=["_row", *names])

        rows = kept.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("_row", *names)]))
        got = rows.groupBy("_row").agg(*(F.sum(c).alias(c) for c in names)).collect()  # a row for each combination of features at most
        out = np.zeros((len(m.emission) + 1, len(STATES)))
        for r in got:
            out[r["_row"]] = np.array([r[c] for c in names]) / FINE
        return out

    return _fitted(sums)


def labelled_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the words of each label, their total, ``share`` (of link lists, tag lists and menus) and ``spam``; a narrow
    step behind the fitting of the model."""
    units = cut(units_of(df, key, text))
    m = learned(units)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = np.zeros((batch.num_rows, len(STATES)), np.int64)
            for i, (observed, sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for state, n in zip(viterbi(np.frombuffer(observed, np.uint16).tolist(), m), np.frombuffer(sizes, np.uint32).tolist(), strict=True):
                    counts[i, state] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, s]) for s in range(len(STATES)))], names=[key, *STATES])

    out = units.mapInArrow(run, T.StructType([T.StructField(key, units.schema[0].dataType), *(T.StructField(s, T.LongType(), False) for s in STATES)]))
    words = sum((F.col(s) for s in STATES[1:]), F.col(STATES[0]))
    share = F.when(F.col("words") > 0, (F.col("links") + F.col("tags") + F.col("menu")) / F.col("words")).otherwise(0.0)
    return out.withColumn("words", words).withColumn("share", share).withColumn("spam", (F.col("words") >= LEAST_WORDS) & (F.col("share") >= SHARE))
