"""Many words and phrases in one pass over a text: a multi-pattern automaton over tokens.

A text is cut into runs of word characters, runs of white space and single other characters. A pattern is the token sequence of its source, any white space
between its words; a trie over all patterns with failure links (Aho and Corasick) walks each text once, whatever the number of patterns.

What counts as an occurrence is what the pattern's regular expression would match: a source of several words, of word characters only, or of letters,
digits, ``_`` and ``-``, must begin and end at word boundaries; any other source may begin or end inside a word; with ``guard`` no apostrophe may follow. Case is
ignored unless a pattern is ``cased``. Of overlapping occurrences of one pattern the left one counts.

Two ways into Spark. :func:`find` and :func:`count` take one dictionary for all notes: it is cut into slices of bounded size, each slice's automaton is
broadcast, and the hits leave the note as one list. :func:`rewrite` and :func:`choose_spans` take patterns chosen note by note: an automaton is made from the
few patterns of the note, so nothing bounds the number of patterns in all.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.session import cut_lineage

# Workers get the automaton with the task, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = r"[^\S\x1c-\x1f]"
TOKEN = re.compile(rf"\w+|{SPACE}+|[^\w]")
APOSTROPHES = ("'", "’")
WORDISH = re.compile(rf"[0-9{T.LETTERS}_\-]*")
#: A slice of a dictionary: so many patterns and characters at most.
SLICE_ROWS, SLICE_CHARS = 500_000, 16 << 20
PATTERN = "key string, cased boolean, guard boolean"
SPANS = "array<struct<key: string, cased: boolean, guard: boolean, start: long, end: long, matched: string>>"
COUNTS = "array<struct<key: string, cased: boolean, guard: boolean, occ: long>>"


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def token_form(token: str) -> str:
    """A token as patterns have it: lower case, any white space as one space."""
    return " " if token.isspace() else lowered(token)


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


class Pattern:
    """A source: its tokens, what must end the word before and begin the word behind them, and where it may stand."""

    __slots__ = ("source", "tokens", "before", "behind", "bounded", "cased", "guard", "exact")

    def __init__(self, source: str, cased: bool = False, guard: bool = True, bounded: bool | None = None):
        parts = source.split()
        self.source, self.cased, self.guard = source, cased, guard
        self.bounded = len(parts) > 1 or WORDISH.fullmatch(source.strip()) is not None or all(map(is_word, source.strip())) if bounded is None else bounded
        tokens = [" " if t.isspace() else t for t in TOKEN.findall(" ".join(parts))]
        self.exact = "".join(tokens)
        self.before = self.behind = ""
        if not self.bounded and len(tokens) > 1:
            if is_word(tokens[0][0]):
                self.before, tokens = tokens[0], tokens[1:]
            if tokens and len(tokens) > 1 and is_word(tokens[-1][0]):
                self.behind, tokens = tokens[-1], tokens[:-1]
        self.tokens = tuple(lowered(t) for t in tokens)
        self.before, self.behind = lowered(self.before), lowered(self.behind)


class Core:
    """The patterns of one token sequence. They differ by the ends of the words around it, and are looked up by these: many sources of one special character
    between words cost no more than one."""

    __slots__ = ("size", "patterns", "before", "behind")

    def __init__(self, size: int):
        self.size, self.patterns = size, {}
        self.before: tuple[int, ...] = ()
        self.behind: tuple[int, ...] = ()

    def add(self, number: int, pattern: Pattern) -> None:
        self.patterns.setdefault((pattern.before, pattern.behind), []).append(number)
        self.before = tuple(sorted({*self.before, len(pattern.before)}))
        self.behind = tuple(sorted({*self.behind, len(pattern.behind)}))

    def around(self, ahead: str, behind: str) -> Iterable[int]:
        """Numbers of the patterns that fit between two lower-case texts."""
        for b in self.before:
            if b > len(ahead):
                break
            for a in self.behind:
                if a > len(behind):
                    break
                yield from self.patterns.get((ahead[len(ahead) - b:], behind[:a]), ())


class Automaton:
    """Trie over token sequences with failure links; ``scan`` gives (last token, core) wherever the tokens of a core stand."""

    def __init__(self, patterns: Sequence[Pattern]):
        self.patterns = [p for p in patterns if p.tokens]
        self.longest = max((len(p.tokens) for p in self.patterns), default=0)
        self.widest = max((max(len(p.before), len(p.behind)) for p in self.patterns), default=0)
        leaf: dict[str, int] = {}  # shared by all states without a follower
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[Core, ...]] = [()]
        for number, pattern in enumerate(self.patterns):
            state = 0
            for token in pattern.tokens:
                if token not in self.next[state]:
                    if self.next[state] is leaf:
                        self.next[state] = {}
                    self.next[state][token] = len(self.next)
                    self.next.append(leaf)
                    self.ends.append(())
                state = self.next[state][token]
            if not self.ends[state]:
                self.ends[state] = (Core(len(pattern.tokens)),)
            self.ends[state][0].add(number, pattern)
        self.fail = [0] * len(self.next)
        queue = list(self.next[0].values())
        for state in queue:
            for token, child in self.next[state].items():
                back = self.fail[state]
                while back and token not in self.next[back]:
                    back = self.fail[back]
                found = self.next[back].get(token, 0)
                self.fail[child] = found if found != child else 0
                self.ends[child] += self.ends[self.fail[child]]
                queue.append(child)

    def scan(self, tokens: Sequence[str]) -> Iterable[tuple[int, Core]]:
        following, fail, ends, root, done = self.next, self.fail, self.ends, self.next[0], 0
        # Between patterns only tokens that begin one are looked at.
        for first in [at for at, token in enumerate(tokens) if token in root]:
            if first < done:
                continue
            at, state = first, root[tokens[first]]
            while True:
                for core in ends[state]:
                    yield at, core
                at += 1
                if at == len(tokens):
                    break
                token = " " if tokens[at].isspace() else tokens[at]
                while state and token not in following[state]:
                    state = fail[state]
                state = following[state].get(token, 0)
                if not state:
                    break
            done = at


def fits(pattern: Pattern, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span of an occurrence whose tokens stand at ``start`` to ``end``, with what belongs to the words around them; None if it may not stand there."""
    start, end = start - len(pattern.before), end + len(pattern.behind)
    if pattern.cased and " ".join(text[start:end].split()) != pattern.exact:
        return None
    if pattern.bounded:
        for at in (start, end):
            if (at > 0 and is_word(text[at - 1])) == (at < len(text) and is_word(text[at])):
                return None
    if pattern.guard and text[end:end + 1] in APOSTROPHES:
        return None
    return start, end


def spans(automaton: Automaton, text: str, low: str | None = None, tokens: Sequence[str] | None = None) -> list[tuple[int, int, int]]:
    """Occurrences (start, end, pattern) in the order of their ends; those of one pattern do not overlap."""
    low = lowered(text) if low is None else low
    tokens = TOKEN.findall(low) if tokens is None else tokens
    begins: list[int] | None = None
    out, done = [], {}
    for at, core in automaton.scan(tokens):
        begins = begins or list(accumulate(map(len, tokens), initial=0))
        start, end = begins[at + 1 - core.size], begins[at + 1]
        for number in core.around(low[max(0, start - automaton.widest):start], low[end:end + automaton.widest]):
            span = fits(automaton.patterns[number], text, start, end)
            if span and span[0] >= done.get(number, 0):
                done[number] = span[1]
                out.append((*span, number))
    return out


class Dictionary:
    """Patterns of a slice as (key, cased, guard): single words in a hash table, all others in an automaton."""

    def __init__(self, rows: Sequence[tuple[str, bool, bool]]):
        self.key, self.cased, self.guard = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        self.words: dict[str, list[int]] = {}
        self.others: list[int] = []
        for number, key in enumerate(self.key):
            word = key.strip()
            if word.isalnum() or all(map(is_word, word)):
                self.words.setdefault(lowered(word), []).append(number)
            else:
                self.others.append(number)
        self.automaton = Automaton([Pattern(*rows[i]) for i in self.others])

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Occurrences (start, end, number); those of one pattern do not overlap."""
        low, words = lowered(text), self.words
        tokens = TOKEN.findall(low)
        out = [(start, end, self.others[i]) for start, end, i in spans(self.automaton, text, low, tokens)] if self.others else []
        met = [at for at, token in enumerate(tokens) if token in words]
        begins = list(accumulate(map(len, tokens), initial=0)) if met else []
        for at in met:
            start, end = begins[at], begins[at + 1]
            for number in words[tokens[at]]:
                if not (self.guard[number] and text[end:end + 1] in APOSTROPHES) and not (self.cased[number] and text[start:end] != self.key[number].strip()):
                    out.append((start, end, number))
        return out


def settled(found: list[tuple[int, int, int]], order: Sequence) -> list[tuple[int, int, int]]:
    """Of overlapping occurrences the one whose pattern comes first in ``order`` (a sort key per pattern) stays, then the left one. Each span is checked against
    its neighbours among the kept ones only."""
    kept: list[tuple[int, int, int]] = []
    for start, end, number in sorted(found, key=lambda s: (order[s[2]], s[0])):
        at = bisect_left(kept, (start, -1, -1))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            insort(kept, (start, end, number))
    return kept


def longest_first(patterns: Sequence[Pattern]) -> list[tuple[int, str]]:
    """The order in which sources are applied."""
    return [(-len(p.source), p.source) for p in patterns]


# --- one dictionary for all notes ------------------------------------------------------------------------------------------------

def _over(notes: DataFrame, text: str, patterns: DataFrame, alias: str, kind: str, made: Callable[[pa.Array, Dictionary], pa.Array], rows: int, chars: int) -> DataFrame:
    """The notes with a list of what ``made`` gives for every slice of the patterns. One pass; if there are several slices, one pass each, and what was found so
    far is written after it, so that no worker holds more than one."""
    distinct = patterns.select("key", "cased", "guard").where(F.col("key").isNotNull() & (F.trim("key") != "")).distinct()
    n, size = distinct.agg(F.count("*"), F.sum(F.length("key"))).first()
    parts = max(1, math.ceil(n / rows), math.ceil((size or 0) / chars))
    out = notes.withColumn(alias, F.array().cast(kind))
    for part in range(parts if n else 0):
        mine = (distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("key", "cased", "guard"), F.lit(parts)) == part)).collect()
        shared = notes.sparkSession.sparkContext.broadcast(Dictionary(sorted(map(tuple, mine))))

        @F.arrow_udf(kind)
        def scan(texts: pa.Array) -> pa.Array:
            return made(texts, shared.value)

        found = scan.asNondeterministic()(F.col(text))
        out = out.withColumn(alias, F.concat(alias, found) if parts > 1 else found)
        out = cut_lineage(out) if parts > 1 else out
    return out


def _listed(held: Dictionary, lengths: list[int], numbers: Sequence[int], **more: pa.Array) -> pa.Array:
    """Lists of structs, ``lengths`` of them per row, that name the patterns ``numbers``."""
    if not hasattr(held, "named"):
        held.named = {"key": pa.array(held.key, pa.string()), "cased": pa.array(held.cased, pa.bool_()), "guard": pa.array(held.guard, pa.bool_())}
    chosen = pa.array(numbers, pa.int32())
    fields = {name: column.take(chosen) for name, column in held.named.items()} | more
    return pa.ListArray.from_arrays(pa.array(accumulate(lengths, initial=0), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _as_spans(texts: pa.Array, held: Dictionary) -> pa.Array:
    found = [[(i, s, e, t[s:e]) for s, e, i in held.spans(t)] if t else [] for t in texts.to_pylist()]
    numbers, start, end, matched = zip(*(f for row in found for f in row)) if any(found) else ((), (), (), ())
    return _listed(held, list(map(len, found)), numbers, start=pa.array(start, pa.int64()), end=pa.array(end, pa.int64()), matched=pa.array(matched, pa.string()))


def _as_counts(texts: pa.Array, held: Dictionary) -> pa.Array:
    found = [Counter(i for *_, i in held.spans(t)) if t else {} for t in texts.to_pylist()]
    return _listed(held, list(map(len, found)), [i for row in found for i in row], occ=pa.array([n for row in found for n in row.values()], pa.int64()))


def find(notes: DataFrame, text: str, patterns: DataFrame, alias: str, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> DataFrame:
    """The notes with column ``alias`` (``SPANS``): every occurrence of every pattern of a stored table (``PATTERN``)."""
    return _over(notes, text, patterns, alias, SPANS, _as_spans, rows, chars)


def count(notes: DataFrame, text: str, patterns: DataFrame, alias: str, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> DataFrame:
    """The notes with column ``alias`` (``COUNTS``): how often each pattern that occurs does."""
    return _over(notes, text, patterns, alias, COUNTS, _as_counts, rows, chars)


# --- patterns chosen note by note ------------------------------------------------------------------------------------------------

class _Tokens:
    """A text as a linked list of tokens, in which spans are replaced. Node 0 stands before the text, node 1 behind it. Given ``windows`` (ranges of
    tokens, from left to right and apart), what lies between them is one node each, which equals no token until :meth:`clear` takes it apart."""

    def __init__(self, text: str, begins: list[int], windows: Iterable[tuple[int, int]]):
        self.raw, self.low, self.left, self.right, self.place = ["", ""], ["", ""], [0, 0], [1, 1], [(), ()]
        self.dead: set[int] = set()
        last = done = 0
        for begin, end in windows:
            if done < begin:
                last = self.add(last, text[begins[done]:begins[begin]], "", (done,))
            for nth in range(begin, end):
                last = self.insert(last, text[begins[nth]:begins[nth + 1]], (nth,))
            done = end
        if begins[done] < len(text):
            self.add(last, text[begins[done]:], "", (done,))

    def insert(self, after: int, token: str, place: tuple) -> int:
        return self.add(after, token, token_form(token), place)

    def add(self, after: int, raw: str, low: str, place: tuple) -> int:
        node, behind = len(self.raw), self.right[after]
        self.raw.append(raw)
        self.low.append(low)
        self.left.append(after)
        self.right.append(behind)
        self.place.append(place)
        self.right[after] = self.left[behind] = node
        return node

    def nodes(self, first: int = 0, most: int = 1 << 62) -> list[int]:
        """Nodes from ``first`` on (from the start without it)."""
        out, node = [], first or self.right[0]
        while node != 1 and len(out) < most:
            out.append(node)
            node = self.right[node]
        return out

    def clear(self, node: int, reach: int) -> None:
        """Take apart what is not yet tokens among the next ``reach`` nodes on both sides."""
        for side, edge in ((self.left, 0), (self.right, 1)):
            at = side[node]
            for _ in range(reach):
                if at == edge:
                    break
                if not self.low[at]:
                    after, behind = self.left[at], self.right[at]
                    self.right[after], self.left[behind] = behind, after
                    last = after
                    for nth, token in enumerate(TOKEN.findall(self.raw[at]), self.place[at][0]):
                        last = self.insert(last, token, (nth,))
                    at = last if edge == 0 else self.right[after]
                at = side[at]

    def replace(self, first: int, last: int, text: str) -> list[int]:
        """New nodes for ``text`` in place of those from ``first`` to ``last``."""
        place, edge, behind, node = self.place[first], self.left[first], self.right[last], first
        while node != behind:
            self.dead.add(node)
            node = self.right[node]
        self.right[edge], self.left[behind] = behind, edge
        out = []
        for nth, token in enumerate(TOKEN.findall(text)):
            edge = self.insert(edge, token, (*place, nth))
            out.append(edge)
        return out

    def around(self, inner: list[int], reach: int) -> list[int]:
        """Nodes with up to ``reach`` more on both sides."""
        before, node = [], self.left[inner[0]]
        while node != 0 and len(before) < reach:
            before.append(node)
            node = self.left[node]
        return before[::-1] + inner + (self.nodes(self.right[inner[-1]], reach) if self.right[inner[-1]] != 1 else [])


def _merge(left: str, right: str) -> bool:
    """Whether the last token of ``left`` and the first of ``right`` become one when written together."""
    return bool(left and right) and ((is_word(left[-1]) and is_word(right[0])) or (left[-1].isspace() and right[0].isspace()))


def replaced(text: str, automaton: Automaton, values: Sequence[str]) -> str:
    """The text after replacing every pattern in turn, in the order of the automaton's patterns, each by its value: what one regular expression after the other
    gives, values that hold a later pattern included. The text is scanned once; of a replacement only its surroundings are taken apart and scanned again."""
    # A capital sigma is lowered by what stands around it.
    forms = TOKEN.findall(lowered(text)) if "\u03a3" not in text else list(map(lowered, TOKEN.findall(text)))
    reach, windows = 2 * automaton.longest + 4, []
    for at, core in automaton.scan(forms):
        begin, end = max(0, at + 1 - core.size - reach), min(len(forms), at + 1 + reach)
        while windows and begin <= windows[-1][1]:
            begin, end = min(begin, windows[-1][0]), max(end, windows.pop()[1])
        windows.append((begin, end))
    if not windows:
        return text
    chain = _Tokens(text, list(accumulate(map(len, forms), initial=0)), windows)
    queue: list[tuple[int, tuple, int]] = []

    def note(nodes: list[int], later_than: int, touching: set[int] | None) -> None:
        for at, core in automaton.scan([chain.low[n] for n in nodes]):
            mine = nodes[at + 1 - core.size:at + 1]
            ahead, behind = chain.left[mine[0]], chain.right[mine[-1]]
            if touching is None or not touching.isdisjoint((ahead, *mine, behind)):
                for number in core.around(chain.low[ahead], chain.low[behind]):
                    if number > later_than:
                        heapq.heappush(queue, (number, chain.place[mine[0]], mine[0]))

    note(chain.nodes(), -1, None)
    while queue:
        number, _, first = heapq.heappop(queue)
        pattern, value = automaton.patterns[number], values[number]
        if first in chain.dead:
            continue
        chain.clear(first, reach)
        nodes = chain.nodes(first, len(pattern.tokens))
        if tuple(chain.low[n] for n in nodes) != pattern.tokens:
            continue
        last = nodes[-1]
        ahead, body, behind = chain.raw[chain.left[first]], "".join(chain.raw[n] for n in nodes), chain.raw[chain.right[last]]
        near = ahead + body + behind
        start, end = len(ahead), len(ahead) + len(body)
        if not lowered(ahead).endswith(pattern.before) or not lowered(behind).startswith(pattern.behind):
            continue
        span = fits(pattern, near + chain.raw[chain.right[chain.right[last]]], start, end)
        if span is None:
            continue
        # A neighbour goes along if the span reaches into it, or if it becomes one token with the value.
        if span[0] < start or _merge(ahead, value):
            first, value = chain.left[first], near[:span[0]] + value
        if span[1] > end or _merge(value, behind):
            last, value = chain.right[last], value + near[span[1]:]
        made = chain.replace(first, last, value)
        if made:
            note(chain.around(made, automaton.longest), number, set(made))
    return "".join(chain.raw[n] for n in chain.nodes())


PAIRS = "array<struct<src: string, dst: string>>"


def rewrite(text: Column, pairs: Column, cased: bool = False, guard: bool = True, in_order: bool = False) -> Column:
    """The text with all pairs (src, dst) of its row applied one after the other: longest source first, or ``in_order`` of their list."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, held in zip(texts.to_pylist(), lists.to_pylist()):
            chosen = [(p["src"], p["dst"]) for p in held or () if p["src"] and p["src"].strip() and p["dst"]]
            chosen = chosen if in_order else sorted(chosen, key=lambda p: (-len(p[0]), *p))
            patterns = [Pattern(src, cased, guard, True if in_order else None) for src, _ in chosen]
            out.append(t if t is None or not chosen else replaced(t, Automaton(patterns), [dst for _, dst in chosen]))
        return pa.array(out, pa.string())

    return apply.asNondeterministic()(text, pairs)


CHOSEN = "array<struct<start: long, end: long, matched: string, nth: int>>"
_CHOSEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string()), ("nth", pa.int32())]))


def choose_spans(text: Column, sources: Column) -> Column:
    """Spans (``CHOSEN``) of the row's sources, a list of structs (key, cased, guard), in its text; ``nth`` is the source's place in the list. Overlaps are settled
    longest source first, then by source, then from the left."""

    @F.arrow_udf(CHOSEN)
    def choose(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, held in zip(texts.to_pylist(), lists.to_pylist()):
            named = [(nth, s) for nth, s in enumerate(held or ()) if s["key"] and s["key"].strip()]
            machine = Automaton([Pattern(s["key"], s["cased"], s["guard"]) for _, s in named])
            order = longest_first(machine.patterns)
            order = [(*o, i) for i, o in enumerate(order)]
            out.append([] if t is None else [{"start": s, "end": e, "matched": t[s:e], "nth": named[i][0]} for s, e, i in settled(spans(machine, t), order)])
        return pa.array(out, _CHOSEN)

    return choose.asNondeterministic()(text, sources)
