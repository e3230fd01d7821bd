"""Secret scanning with one deterministic automaton for all rules.

Rules are regular expressions over bytes. Subset construction joins them into one automaton, refinement
minimises it, and its transition array is run over all texts of a batch at once: the batch is cut into
equal lanes that advance together, one numpy step for each byte of a lane. Lanes start as if nothing went
before; where that was wrong, the few bytes until the states meet again are run anew, so the result is
that of one pass over the bytes. Where a match ended, the rule's own small automata give its ends.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import halves, map_rows, map_same, table


#: Bytes of a text that are worked on at a time.
WINDOW = 4 << 20


@dataclass(frozen=True)
class Rule:
    """kind, pattern, fewest bytes of a match. A match is leftmost and longest; shorter ones than least are dropped once found.

    No match may lie inside another one before that one's first possible end.
    """

    kind: str
    pattern: str
    least: int = 1
    value: int = 0  # fewest bytes behind the first : or = with its spaces and quote
    tail: str = ""  # what belongs to the match where it follows; only the pattern is searched


BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", value=6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: A key's text up to the END line, or where there is none, its headers and lines of base64.
_GAP = r"(?:[\x20\x09\r\n]|\\[rn])"
_CLOSED = r"(?:-{0,4}[^-\xff])*-----END [A-Z ]*PRIVATE KEY-----"
_OPEN = rf"(?:{_GAP}+[A-Za-z-]+:[^\n\xff]*)*(?:{_GAP}*[A-Za-z0-9+/=]{{16,}})+(?:{_GAP}+[A-Za-z0-9+/=]+)?"
#: Private keys, and public formats of tokens that services issue.
ADDED = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=f"(?:{_CLOSED}|{_OPEN})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
]


class Nfa:
    """Thompson's construction from the standard parser's tree; sets of bytes are 256-bit numbers."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []
        self.final: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: str, start: int, rule: int, backward: bool = False) -> None:
        self.final[self.seq(list(_parser.parse(pattern)), start, False, backward)] = rule

    @staticmethod
    def bytes_of(op, arg, fold: bool) -> int:
        if op is C.LITERAL:
            s = 1 << arg
            if fold and chr(arg).isalpha():
                s |= 1 << (arg ^ 32)
            return s
        if op is C.RANGE:
            s = 0
            for b in range(arg[0], arg[1] + 1):
                s |= Nfa.bytes_of(C.LITERAL, b, fold)
            return s
        if op is C.IN:
            s, negate = 0, False
            for o, a in arg:
                if o is C.NEGATE:
                    negate = True
                else:
                    s |= Nfa.bytes_of(o, a, fold)
            return ((1 << 255) - 1) ^ s if negate else s  # 255 parts the texts
        raise ValueError(f"no rule may use {op}")

    def seq(self, items: list, at: int, fold: bool, backward: bool) -> int:
        for op, arg in reversed(items) if backward else items:
            at = self.item(op, arg, at, fold, backward)
        return at

    def item(self, op, arg, at: int, fold: bool, backward: bool) -> int:
        if op is C.SUBPATTERN:
            return self.seq(list(arg[3]), at, fold or bool(arg[1] & 2), backward)
        if op is C.BRANCH:
            end = self.state()
            for way in arg[1]:
                self.empty[self.seq(list(way), at, fold, backward)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.seq(list(body), at, fold, backward)
            if high is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.seq(list(body), loop, fold, backward)].append(loop)
                return loop
            end = self.state()
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.seq(list(body), at, fold, backward)
                self.empty[at].append(end)
            return end
        to = self.state()
        self.moves[at].append((self.bytes_of(op, arg, fold), to))
        return to

    def closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)


class Dfa:
    """move[state * 256 + byte]; hits[state]: bits of the rules that end there; dead: the state without a way on, or -1. State 0 starts."""

    def __init__(self, patterns: list[str], unanchored: bool, backward: bool = False):
        nfa = Nfa()
        start = nfa.state()
        for i, p in enumerate(patterns):
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.add(p, first, i, backward)
        sets = sorted({s for m in nfa.moves for s, _ in m})
        marks = [tuple(bool(s >> b & 1) for s in sets) for b in range(256)]
        classes = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        samples = {i: marks.index(m) for m, i in classes.items()}
        known = {nfa.closed({start}): 0}
        todo, rows = list(known), []
        for now in todo:
            row = []
            for c in range(len(classes)):
                b = samples[c]
                to = {t for s in now for m, t in nfa.moves[s] if m >> b & 1}
                to = nfa.closed(to | {start} if unanchored else to)
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append(known[to])
            rows.append(row)
        hits = np.array([sum({1 << nfa.final[s] for s in now if s in nfa.final}) for now in todo], np.int64)
        table, hits = self.minimal(np.array(rows), hits)
        self.move = np.ascontiguousarray(table[:, [classes[m] for m in marks]]).astype(np.uint32)
        self.hits = hits
        stuck = [s for s in range(len(hits)) if not hits[s] and (table[s] == s).all()]
        self.dead = stuck[0] if stuck and not unanchored else -1

    @staticmethod
    def minimal(table: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moore's refinement: states part until equal ones go to equal ones."""
        block = np.unique(hits, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        order, first = np.unique(block, return_index=True)
        name = np.empty(len(order), int)
        name[order[np.argsort(first)]] = range(len(order))  # in the order found: 0 starts
        keep = np.sort(first)
        return name[block[table[keep]]], hits[keep]


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.all = Dfa([r.pattern for r in rules], unanchored=True)
        self.flat = self.all.move.ravel() * 256  # states times 256
        self.ahead = [Dfa([r.pattern + r.tail], unanchored=False) for r in rules]
        self.back = [Dfa([r.pattern], unanchored=False, backward=True) for r in rules]

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions behind which some match ends, and the bits of the rules; data: bytes, run in windows that hand their state on."""
        found, state = [], 0
        for x in range(0, len(data), WINDOW):
            at, bits, state = self.window(data[x : x + WINDOW], state)
            found.append((at + x, bits))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def window(self, data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(data)
        lanes = max(1, min(8192, n // 512))
        steps = -(-n // lanes)
        padded = np.full(lanes * steps, 255, np.uint8)
        padded[:n] = data
        across = np.ascontiguousarray(padded.reshape(lanes, steps).T).astype(np.uint32)
        states = np.empty((steps, lanes), np.uint32)
        now = np.zeros(lanes, np.uint32)
        now[0] = state
        for j in range(steps):
            now = self.flat[now + across[j]]
            states[j] = now
        flat, before = self.flat, 0
        for i in range(lanes):
            if before:  # this lane began elsewhere
                s, j = before, 0
                while j < steps:
                    s = int(flat[s + int(across[j, i])])
                    if s == states[j, i]:
                        break
                    states[j, i] = s
                    j += 1
            before = int(states[-1, i])
        after = int(states[(n - 1) % steps, (n - 1) // steps])
        states >>= 8
        j, i = np.nonzero((self.all.hits != 0)[states])
        at = i * steps + j
        order = np.argsort(at)
        return at[order] + 1, self.all.hits[states[j, i]][order], after

    def matches(self, rule: int, text: bytes | memoryview, ends: list[int]) -> list[tuple[int, int]]:
        """Leftmost longest matches that don't overlap, from all positions where some match ends."""
        out, past, back, ahead = [], 0, self.back[rule], self.ahead[rule]
        for end in ends:
            if end <= past:
                continue
            s, i, start = 0, end, -1
            while i > past:
                i -= 1
                s = int(back.move[s, text[i]])
                if s == back.dead:
                    break
                if back.hits[s]:
                    start = i
            if start < 0:
                continue
            s, i, stop = 0, start, end
            while i < len(text):
                s = int(ahead.move[s, text[i]])
                if s == ahead.dead:
                    break
                i += 1
                if ahead.hits[s]:
                    stop = i
            past = stop
            r, got = self.rules[rule], bytes(text[start:stop])
            if len(got) >= r.least and len(value(got)) >= r.value:
                out.append((start, stop))
        return out

    def scan(self, batch: list[bytes] | list[memoryview]) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, rule, end) of all matches in bytes, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
        if not batch:
            return out
        data = np.frombuffer(batch[0] if len(batch) == 1 else b"\xff".join(batch) + b"\xff", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in batch])])
        at, bits = self.ends(data)
        doc = np.searchsorted(starts, at - 1, side="right") - 1
        for k in np.unique(doc):
            mine = doc == k if len(batch) == 1 else slice(*np.searchsorted(doc, [k, k + 1]))
            ends, kinds = at[mine] - starts[k], bits[mine]
            for r in range(len(self.rules)):
                if (of := ends[kinds >> r & 1 == 1]).size:
                    out[k] += [(a, r, b) for a, b in self.matches(r, batch[k], of.tolist())]
            out[k].sort()
        return out


def value(match: bytes) -> bytes:
    """What stands behind the first : or =, its spaces and one quote."""
    cut = min((i for c in b":=" if (i := match.find(c)) >= 0), default=-1)
    rest = match[cut + 1 :].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


def in_points(text: bytes | memoryview, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points."""
    if not spans:
        return spans
    data, points, past, before = np.frombuffer(text, np.uint8), {}, 0, 0
    for at in sorted({x for a, _, b in spans for x in (a, b)}):
        before += code_points(data[past:at])
        points[at], past = before, at
    return [(points[a], r, points[b]) for a, r, b in spans]


def code_points(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[x : x + WINDOW] & 0xC0) != 0x80)) for x in range(0, len(data), WINDOW))


def raw_texts(batch: pa.RecordBatch) -> list[memoryview]:
    """The texts' bytes where they lie; null as empty."""
    none = pa.py_buffer(b"")
    return [memoryview(x.as_buffer() if x.is_valid else none).cast("B") for x in batch.column("text")]


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> by start, then kind as listed; positions in code points, end exclusive.

    A row for each input row, in its place, repeated ones too; null and empty texts have no spans. Of a text of any
    length only a window is worked on at a time. Extra columns are ignored, an empty table gives no rows.
    """
    rules = rules or [*BASE, *ADDED]

    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def make():
        scanner = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            raw = raw_texts(batch)
            found = [in_points(t, s) for t, s in zip(raw, scanner.scan(raw), strict=True)]
            return {"doc_id": batch.column("doc_id"), "spans": [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in s] for s in found]}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = joined(F.filter("spans", lambda s: s["kind"].isin(kinds)))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[{kind}]", rules: list[Rule] | None = None) -> DataFrame:
    """The documents with every span replaced by its kind's mask; overlapping spans go under the first one's mask.

    Null texts stay null; n_chars, where there is such a column, counts the new text's code points; all other
    columns stay as they are. One row for each input row.
    """
    rules = rules or [*BASE, *ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def run(batches):
        scanner = shared.value

        for whole in batches:
            for batch in halves(whole):
                raw, there = raw_texts(batch), batch.column("text").is_valid().to_pylist()
                clean = [masked(t, s, rules, mask) if ok else None for t, s, ok in zip(raw, scanner.scan(raw), there, strict=True)]
                size = [None if t is None else code_points(np.frombuffer(t, np.uint8)) for t in clean]
                new = {"text": pa.array(clean, pa.binary()).cast(pa.string()), "n_chars": pa.array(size, pa.int64())}
                cols = [new[n].cast(batch.schema.field(n).type) if n in new else batch.column(n) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_same(docs, run)


def masked(text: bytes | memoryview, spans: list[tuple[int, int, int]], rules: list[Rule], mask: str) -> bytes:
    out, past = [], 0
    for a, r, b in spans:
        if a >= past:
            out += [text[past:a], mask.format(kind=rules[r].kind).encode()]
        past = max(past, b)
    return b"".join([*out, text[past:]])
