"""Secret scans through a trigram inverted index.

Each rule's regular expression is parsed and turned into a Boolean query over trigrams that every match must
contain (after ASCII lower-casing). For each batch of texts a posting list per queried trigram is built in one
vectorised pass, the queries intersect and unite postings, and only the candidate texts are verified with the
full expression. A rule without a mandatory trigram (plain runs of hexadecimal digits) scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import _common as C

try:  # the parser's public name differs between Python versions
    from re import _constants as _k
    from re import _parser as _sre
except ImportError:  # pragma: no cover
    import sre_constants as _k
    import sre_parse as _sre


@dataclass(frozen=True)
class Rule:
    """group: whose length must reach `least` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.IGNORECASE | re.ASCII, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, 0, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, 0, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)

# --- Boolean trigram queries -----------------------------------------------------------------------

#: Queries: True (every text), a trigram, ("and", q...) or ("or", q...).
Query = bool | str | tuple
#: Sets of exact strings, prefixes and suffixes grow no further than this.
MOST = 24


def _and(*qs: Query) -> Query:
    parts: dict[Query, None] = {}
    for q in qs:
        if q is not True:
            parts.update(dict.fromkeys(q[1:] if isinstance(q, tuple) and q[0] == "and" else (q,)))
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", *parts)


def _or(*qs: Query) -> Query:
    parts = dict.fromkeys(x for q in qs for x in (q[1:] if isinstance(q, tuple) and q[0] == "or" else (q,)))
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", *parts)


def _of(strings: frozenset[str]) -> Query:
    """What a text that has one of the strings must have."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass(frozen=True)
class _Info:
    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    match: Query = True


_EMPTY, _ANY = _Info(frozenset([""]), frozenset([""]), frozenset([""])), _Info(None, frozenset([""]), frozenset([""]))


def _exact(strings) -> _Info:
    s = frozenset(strings)
    return _Info(s, s, s)


def _open(x: _Info) -> _Info:
    """x without its exact strings, which become part of the query; ends keep two characters at most."""
    match = _and(x.match, _of(x.exact) if x.exact else True, _of(x.prefix), _of(x.suffix))
    ends = frozenset(s[:2] for s in x.prefix), frozenset(s[-2:] for s in x.suffix)
    return _Info(None, *(e if len(e) <= MOST else frozenset([""]) for e in ends), match)


def _concat(x: _Info, y: _Info) -> _Info:
    cross = lambda a, b: frozenset(s + t for s in a for t in b)
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return _Info(e := cross(x.exact, y.exact), e, e, _and(x.match, y.match))
    left, right = x.exact or x.suffix, y.exact or y.prefix
    over = _of(cross(left, right)) if len(left) * len(right) <= MOST else True
    prefix = cross(x.exact, right) if x.exact is not None and len(x.exact) * len(right) <= MOST else x.exact or x.prefix
    suffix = cross(left, y.exact) if y.exact is not None and len(left) * len(y.exact) <= MOST else y.exact or y.suffix
    return _Info(None, prefix, suffix, _and(x.match, y.match, over, _of(x.exact) if x.exact else True, _of(y.exact) if y.exact else True))


def _either(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST and x.match is True is y.match:
        return _exact(x.exact | y.exact)
    x, y = _open(x), _open(y)
    return _Info(None, x.prefix | y.prefix, x.suffix | y.suffix, _or(x.match, y.match))


def _info(node) -> _Info:
    op, arg = node
    if op is _k.LITERAL:
        return _exact([_low(chr(arg))])
    if op is _k.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is _k.LITERAL:
                chars.add(_low(chr(x)))
            elif kind is _k.RANGE and x[1] - x[0] < MOST:
                chars.update(_low(chr(c)) for c in range(x[0], x[1] + 1))
            else:
                return _ANY
        return _exact(chars) if len(chars) <= 5 else _ANY
    if op is _k.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _k.BRANCH:
        out = _sequence(arg[1][0])
        for x in arg[1][1:]:
            out = _either(out, _sequence(x))
        return out
    if op in (_k.MAX_REPEAT, _k.MIN_REPEAT):
        least, most, body = arg
        x = _sequence(body)
        if (least, most) == (0, 1):
            return _either(x, _EMPTY)
        if not least:
            return _ANY
        out = x
        for _ in range(min(least, 4) - 1):
            out = _concat(out, x)
        return out if least == most <= 4 else _concat(_open(out), _open(_ANY))
    if op is _k.AT:
        return _EMPTY
    return _ANY


def _low(s: str) -> str:
    return s.lower() if s.isascii() else s


def _sequence(nodes) -> _Info:
    out = _EMPTY
    for x in nodes:
        out = _concat(out, _info(x))
    return out


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query that every text with a match of the pattern fulfils, over ASCII lower case."""
    return _open(_sequence(_sre.parse(pattern, flags))).match


def trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1:]))


# --- postings --------------------------------------------------------------------------------------


class Postings:
    """Posting lists of a fixed set of trigrams, as a Boolean matrix of trigrams by texts."""

    def __init__(self, grams: set[str]) -> None:
        self.number = {g: i for i, g in enumerate(sorted(g for g in grams if g.isascii()))}
        self.table = np.zeros(1 << 24, np.int16)
        for g, i in self.number.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = i + 1
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.texts = len(offsets) - 1
        self.has = np.zeros((len(self.number), self.texts), bool)
        if len(data) < 3:
            return
        x = self.lower[data]
        hits = self.table[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        at = np.flatnonzero(hits)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        self.has[hits[at[inside]] - 1, doc[inside]] = True

    def ask(self, q: Query) -> np.ndarray:
        if isinstance(q, str):
            return self.has[self.number[q]] if q in self.number else np.ones(self.texts, bool)
        if q is True:
            return np.ones(self.texts, bool)
        parts = [self.ask(x) for x in q[1:]]
        return (np.logical_and if q[0] == "and" else np.logical_or).reduce(parts)


def scan(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _compiled(rule: Rule) -> re.Pattern:
    # A run of 16 or more is found where it begins, without a match object for each shorter run.
    return re.compile(rule.pattern[:-1] + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern, rule.flags)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in docs(doc_id, text): one row per input row, in code points, ends exclusive.

    A null or empty text has no spans; repeated rows and null ids are kept as they are; other columns of docs
    are ignored. Matches are leftmost and do not overlap within a kind; kinds may overlap. `spans` lists all
    kinds, `base_sha256` covers the base kinds, both by start and then by the order of the rules.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        compiled = [_compiled(r) for r in rules]
        index = Postings(set().union(*map(trigrams, queries)))
        for whole in batches:
            for batch in C.slices(whole):
                column = pc.fill_null(batch.column("text"), "")
                index.build(*C.text_bytes(column))
                found: list[list] = [[] for _ in range(batch.num_rows)]
                texts: dict[int, str] = {}
                for i, (rule, expr, q) in enumerate(zip(rules, compiled, queries)):
                    for d in np.flatnonzero(index.ask(q)).tolist():
                        if d not in texts:
                            texts[d] = column[d].as_py()
                        found[d] += [(a, i, b) for a, b in scan(rule, expr, texts[d])]
                rows = []
                for spans in found:
                    spans.sort()
                    said = [f"{rules[i].kind}:{a}:{b}" for a, i, b in spans]
                    base = ",".join(s for s, (_, i, _) in zip(said, spans) if rules[i].base)
                    kinds = [rules[i].kind for _, i, _ in spans]
                    rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
                cols = list(zip(*rows))
                types = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(C.documents(spark, sf_dir))
