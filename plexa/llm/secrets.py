"""Secret scans by one combined deterministic automaton.

All rules' expressions are parsed, joined into one nondeterministic automaton
over bytes, made deterministic by subset construction, minimised by partition
refinement, and laid out as one flat transition array. A text is read once,
byte by byte, for all rules, which finds every rule's matches; the bytes of a
match, and only those, are read again by the rule's own reversed and forward
automata (built the same way), which give its two ends.

A rule's span is the one that ends first, begun as far left and extended as
far right as it can be, and not overlapping the rule's span before it. Null
and empty texts have no spans; texts are scanned whole. Every row gets a result,
also if its doc_id is repeated or null; an empty table gives none.

The expressions know literals, ``\\`` escapes, classes with ranges and ``^``,
groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``.
"""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, flat, plain


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``; spans whose body has under ``least`` bytes are dropped.

    A least length is cheaper than a counted repeat: counters of several rules
    that run side by side multiply the automaton's states.
    """

    kind: str
    head: str
    body: str
    least: int = 0
    ignore_case: bool = False


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{24,}"),
)
#: Published token formats that the base rules don't name.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("pem", "-----BEGIN ", "[A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# ---- expressions: ("set", frozenset of bytes) | ("cat", list) | ("alt", list) | ("rep", x, least, most or None)


def parse(pattern: str, ignore_case: bool = False):
    at = 0

    def fold(found: set[int]) -> frozenset[int]:
        if ignore_case:
            letters = {c for c in found if chr(c).isascii() and chr(c).isalpha()}
            found = found | {c ^ 32 for c in letters}
        return frozenset(found)

    def escape() -> int:
        nonlocal at
        at += 1
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escape()
        at += 1
        return ord(pattern[at - 1])

    def members() -> frozenset[int]:
        nonlocal at
        at += 1
        inverse = pattern[at] == "^"
        at += inverse
        found: set[int] = set()
        while pattern[at] != "]":
            low = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                found.update(range(low, one() + 1))
            else:
                found.add(low)
        at += 1
        found = fold(found)
        return frozenset(range(256)) - found if inverse else found

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            inside = either()
            at += 1
            return inside
        if c == "[":
            return ("set", members())
        if c == ".":
            at += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", fold({one()}))

    def repeated():
        nonlocal at
        x = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                x = ("rep", x, int(low), int(high) if high else None if comma else int(low))
            else:
                x = ("rep", x, int(c == "+"), 1 if c == "?" else None)
        return x

    def joined():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def either():
        nonlocal at
        parts = [joined()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(joined())
        return ("alt", parts)

    return either()


def backwards(x):
    if x[0] == "set":
        return x
    if x[0] == "rep":
        return ("rep", backwards(x[1]), *x[2:])
    parts = [backwards(p) for p in x[1]]
    return (x[0], parts[::-1] if x[0] == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, x, start: int) -> int:
        """The end state of ``x`` begun at ``start``."""
        if x[0] == "set":
            end = self.state()
            self.moves[start].append((x[1], end))
            return end
        if x[0] == "cat":
            for part in x[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if x[0] == "alt":
            for part in x[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(part, own)].append(end)
            return end
        _, inner, least, most = x
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.empty[start].append(end)
        return end


class Automaton:
    """Flat transitions: ``next = table[state + byte]`` with states as multiples of 256.

    States from ``accepting`` on accept; ``mask`` has, by state // 256, the bits
    of the expressions that accept there. ``dead`` leads nowhere (-1: no such state).
    """

    def __init__(self, expressions: list, anchored: bool):
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        if not anchored:
            nfa.moves[start].append((frozenset(range(256)), start))
        for k, x in enumerate(expressions):
            own = nfa.state()
            nfa.empty[start].append(own)
            ends[nfa.add(x, own)] = 1 << k

        # bytes that no set tells apart are one class
        sets = list({s for moves in nfa.moves for s, _ in moves})
        kinds: dict[tuple, int] = {}
        cls = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        sample = [cls.index(c) for c in range(len(kinds))]

        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for q in nfa.empty[todo.pop()]:
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
            return frozenset(seen)

        first = closed([start])
        number, todo, rows, masks = {first: 0}, [first], [], []
        for states in todo:  # grows as it goes
            masks.append(sum({ends[q] for q in states if q in ends}))
            row = []
            for byte in sample:
                to = closed([q for p in states for s, q in nfa.moves[p] if byte in s])
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)

        block = masks[:]  # Moore's refinement, from the accepted masks
        while True:
            names: dict[tuple, int] = {}
            finer = [names.setdefault((block[i], *(block[t] for t in rows[i])), len(names)) for i in range(len(rows))]
            if len(names) == len(set(block)):
                break
            block = finer
        names = {}
        block = [names.setdefault(b, len(names)) for b in block]
        order = sorted(range(len(names)), key=lambda b: masks[block.index(b)] != 0)
        place = {b: i for i, b in enumerate(order)}
        self.table, self.mask = [], []
        for b in order:
            i = block.index(b)
            self.mask.append(masks[i])
            self.table += [place[block[rows[i][cls[byte]]]] * 256 for byte in range(256)]
        self.start = place[block[0]] * 256
        self.accepting = 256 * sum(not m for m in self.mask)
        self.dead = next((256 * s for s, m in enumerate(self.mask) if not m and all(t == 256 * s for t in self.table[256 * s : 256 * s + 256])), -1)

    def longest(self, data: bytes, start: int, stop: int, step: int = 1) -> int:
        """Where the longest match from ``start`` towards ``stop`` ends; -1: none."""
        state, found = self.start, start if self.start >= self.accepting else -1
        for i in range(start, stop, step) if step > 0 else range(start - 1, stop - 1, -1):
            state = self.table[state + data[i]]
            if state == self.dead:
                break
            if state >= self.accepting:
                found = i + 1 if step > 0 else i
        return found


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        whole = [("cat", [parse(r.head, r.ignore_case), parse(r.body, r.ignore_case)]) for r in rules]
        self.all = Automaton(whole, anchored=False)
        self.forward = [Automaton([x], anchored=True) for x in whole]
        self.reverse = [Automaton([backwards(x)], anchored=True) for x in whole]
        self.heads = [Automaton([parse(r.head, r.ignore_case)], anchored=True) for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) in bytes, by start and rule."""
        table, accepting, mask = self.all.table, self.all.accepting, self.all.mask
        state, found, past = self.all.start, [], [0] * len(self.rules)
        for i, byte in enumerate(data):
            state = table[state + byte]
            if state >= accepting:
                hit = mask[state >> 8]
                for k, rule in enumerate(self.rules):
                    if hit >> k & 1 and i >= past[k]:
                        start = self.reverse[k].longest(data, i + 1, past[k], -1)
                        if start < 0:
                            continue
                        end = self.forward[k].longest(data, start, len(data))
                        past[k] = end
                        if end - self.heads[k].longest(data, start, end) >= rule.least:
                            found.append((start, end, k))
        return sorted(found, key=lambda x: (x[0], x[2]))

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        return self.of_bytes(text.encode("utf-8", "surrogatepass"))

    def of_bytes(self, data: bytes) -> list[tuple[str, int, int]]:
        spans = self.spans(data)
        if not spans:
            return []
        point = {}
        at = points = 0
        for edge in sorted({e for s in spans for e in s[:2]}):
            points += len(data[at:edge].decode("utf-8", "replace"))
            at = edge
            point[edge] = points
        return [(self.rules[k].kind, point[s], point[e]) for s, e, k in spans]


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) of every text."""

    def run(batches):
        scanner = Scanner(rules)
        known: dict[bytes, list] = {}
        for chunk in chunks(batches):
            data, off = flat(chunk.column("text"))
            data, known = data.tobytes(), {}
            out = []
            for i in range(len(chunk)):
                text = data[off[i] : off[i + 1]]
                if text not in known:
                    known[text] = [{"kind": k, "start": s, "end": e} for k, s, e in scanner.of_bytes(text)]
                out.append(known[text])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return plain(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[kind]`` and, if there, n_chars
    brought up to date. Spans that overlap are replaced as one, under the first's kind.
    Other columns, and null texts, stay."""
    place = docs.columns.index("text")

    def run(batches):
        scanner = Scanner(rules)
        for chunk in chunks(batches):
            texts = chunk.column("text").to_pylist()
            changed = False
            for i, text in enumerate(texts):
                at, parts = 0, []
                for kind, start, end in scanner.find(text or ""):
                    if start >= at:
                        parts += [text[at:start], f"[{kind}]"]
                    at = max(at, end)
                if parts:
                    texts[i] = "".join(parts) + text[at:]
                    changed = True
            yield chunk.set_column(place, chunk.schema.field(place), pa.array(texts, pa.string())) if changed else chunk

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame, base=tuple(r.kind for r in BASE_RULES)) -> DataFrame:
    """doc_id, counts and SHA-256 of the base kinds' spans, and all spans as one string."""
    as_text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    chosen = F.filter("spans", lambda x: x["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(as_text(chosen), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


__all__ = ["BASE_RULES", "MORE_RULES", "RULES", "Automaton", "Rule", "Scanner", "digest", "parse", "redact", "scan"]
