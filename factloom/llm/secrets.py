"""Secret scans by a trigram index over blocks of documents.

Each rule's regular expression is analysed into a Boolean query over folded
trigrams (an AND of ORs of ANDs).  Every block of documents gets an inverted
index from the trigrams of those queries to the documents that hold them; the
postings are combined by the query and only candidates are verified.  A rule
whose expression has no mandatory trigram scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Of the whole match, or of group ``group``, in characters; shorter matches are dropped after matching.
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base kinds, in the order in which spans with one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Well-known formats that the base kinds don't cover.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    # through the END line, past header lines; without one, to the end of the base64 lines
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info): [^\n]*+|[A-Za-z0-9+/=]{16,}+))++(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{1,15}={0,2}(?=\s*\n|\s*\Z|\\[nr]))?)?)",
    ),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}+", ignore_case=True),
    Rule("url_login", r"://[^\s:/@]++:[^\s:/@]{3,}+@"),
)

#: A query: every clause must hold; a clause holds if all trigrams of one of its sets occur.
Query = tuple[tuple[frozenset[str], ...], ...]
_WAYS = 64


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of a pattern meets, in folded case; () if there is none."""
    clauses: list[tuple[frozenset[str], ...]] = []

    def close(run: list[str]) -> None:
        if run and all(len(x) >= 3 for x in run):
            clauses.append(tuple(dict.fromkeys(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run)))

    def close_all(runs: list[str]) -> None:
        close(sorted(runs))

    def exact(items) -> set[str] | None:
        """All strings that a part can be, where they are few."""
        ways = {""}
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                now = {chr(arg).lower()}
            elif op == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
                now = {chr(a).lower() for _, a in arg}
            elif op == "SUBPATTERN":
                now = exact(arg[3])
            elif op == "BRANCH":
                parts = [exact(x) for x in arg[1]]
                now = None if any(p is None for p in parts) else set().union(*parts)
            elif op == "MAX_REPEAT" and arg[1] <= 2 and (inner := exact(arg[2])) is not None:
                now = {""} if arg[0] == 0 else set()
                grown = {""}
                for n in range(1, int(arg[1]) + 1):
                    grown = {a + b for a in grown for b in inner}
                    now |= grown if n >= arg[0] else set()
            else:
                return None
            if now is None or len(ways) * len(now) > _WAYS:
                return None
            ways = {a + b for a in ways for b in now}
        return ways

    def walk(items) -> None:
        run = {""}
        for item in items:
            now = exact([item])
            if now is not None and len(run) * len(now) <= _WAYS:
                run = {a + b for a in run for b in now}
                continue
            close_all(list(run))
            run = {""}
            op, arg = str(item[0]), item[1]
            if op == "SUBPATTERN":
                walk(arg[3])
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                walk(arg[2])
        close_all(list(run))

    walk(list(re._parser.parse(pattern, re.ASCII)))
    return tuple(clauses)


class TrigramIndex:
    """Postings of chosen trigrams over a block of texts."""

    def __init__(self, trigrams: set[str]):
        codes = {t: int.from_bytes(t.encode("ascii"), "big") for t in trigrams if t.isascii()}
        self.slot = {t: i for i, t in enumerate(sorted(codes))}
        self.table = np.full(1 << 21, -1, np.int16)  # 7 bits a character
        for t, i in self.slot.items():
            a, b, c = t.encode("ascii")
            self.table[a << 14 | b << 7 | c] = i

    def postings(self, texts: list[bytes]) -> list[set[int]]:
        """For each slot the numbers of the texts that hold the trigram; ASCII letters are folded."""
        found: list[set[int]] = [set() for _ in self.slot]
        if not texts:
            return found
        joined = b"\xff\xff".join(texts).lower()
        chars = np.frombuffer(joined, np.uint8)
        if len(chars) < 3:
            return found
        ends = np.cumsum([len(t) + 2 for t in texts])
        wide = chars.astype(np.int32)
        code = wide[:-2] << 14 | wide[1:-1] << 7 | wide[2:]
        high = chars >= 128
        code[high[:-2] | high[1:-1] | high[2:]] = 0
        slots = self.table[code]
        at = np.flatnonzero(slots >= 0)
        docs = np.searchsorted(ends, at, side="right")
        for key in np.unique(docs.astype(np.int64) << 16 | slots[at]).tolist():
            found[key & 0xFFFF].add(key >> 16)
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex({t for _, _, q in self.rules for clause in q for way in clause for t in way})

    def candidates(self, texts: list[bytes]) -> list[list[int]]:
        """For each rule the numbers of the texts that can match."""
        postings, every = self.index.postings(texts), set(range(len(texts)))
        out = []
        for _, _, query in self.rules:
            left = every
            for clause in query:
                hit: set[int] = set()
                for way in clause:
                    ordered = sorted((postings[self.index.slot[t]] for t in way), key=len)
                    hit |= left.intersection(*ordered)
                left = left & hit
            out.append(sorted(left))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its ``(start, rule number, end)`` in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        for n, ((rule, pattern, _), docs) in enumerate(zip(self.rules, self.candidates(raw), strict=True)):
            quick = re.compile(r"[0-9a-f]{%d}" % rule.least) if rule.pattern == "[0-9a-f]+" and rule.least else None
            for d in docs:
                t = texts[d]
                if quick and not quick.search(t):
                    continue
                for m in pattern.finditer(t):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), n, m.end()))
        for x in out:
            x.sort()
        return out


def scan_secrets(documents: DataFrame, *, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans array<struct<kind,start,end>>`` in code points, end exclusive.

    Matches are leftmost and non-overlapping within a kind; kinds may overlap.
    Sorted by start, then by the order of the rules.  A null or empty text has
    no spans; whole texts are scanned at any length; repeated rows give
    repeated rows; an empty table gives an empty table; other columns are not
    read.
    """
    kinds = [r.kind for r in rules]
    held: list[Scanner] = []

    def each(keys, texts):
        if not held:
            held.append(Scanner(rules))
        return keys, [[{"kind": kinds[n], "start": a, "end": b} for a, n, b in found] for found in held[0].spans(texts)]

    kind = documents.select(key).schema[0].dataType.simpleString()
    return map_texts(documents, each, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>", key=key, text=text)


def redact_secrets(documents: DataFrame, *, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "<secret>", text: str = "text") -> DataFrame:
    """The documents with each span (overlapping ones merged) replaced by ``mark``; other columns are kept.

    Adds nothing and drops no row; ``n_chars``, where present, follows the new
    text.  A null text stays null.
    """
    held: list[Scanner] = []
    schema = documents.schema
    place = schema.names.index(text)
    count = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches):
        import pyarrow as pa

        from .common import blocks

        for batch in batches:
            for part in blocks(batch, place):
                if not held:
                    held.append(Scanner(rules))
                texts = part.column(place).to_pylist()
                spans = held[0].spans([t or "" for t in texts])
                new = [t if not s else cut(t, s, mark) for t, s in zip(texts, spans, strict=True)]
                arrays = list(part.columns)
                arrays[place] = pa.array(new, part.schema.field(place).type)
                if count is not None:
                    lengths = [c if not s else len(t) for c, s, t in zip(part.column(count).to_pylist(), spans, new, strict=True)]
                    arrays[count] = pa.array(lengths, part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return documents.mapInArrow(run, schema)


def cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(scanned: DataFrame) -> DataFrame:
    """The columns that are compared: counts of the base kinds, the digest of their spans, and all spans as a string."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(col("spans"), lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(col("spans"), lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return scanned.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(col("spans")).alias("spans"),
    )
