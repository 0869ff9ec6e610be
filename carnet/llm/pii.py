"""Personal data by candidate gradient boosting, in SQL functions only.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns that pass a check (parts up to 255, Luhn, digits).
They are always kept. Beside them, generators of high recall propose overlapping spans: address-like words, and of every run of digits and separators
itself and all sequences of up to six whole groups with as many digits as a phone, card or ip has, so numbers side by side are proposed each. Every candidate has
format and context features of few values each (``FEATURES``); what the base check itself looks at (the plus sign, the check digit, the size of
parts, the dot of a domain) is no feature. Candidates that pass the base check of their kind are the positive cases.

Fit. Candidates of all documents are counted by feature values, in one aggregate whose size the features bound (``CELLS``). Boosted
trees are fitted on these counts of four fifths of the documents; on the other fifth each kind gets the lowest threshold at which at least
``precision`` of the selected candidates are base spans, if it selects ``least`` of them. Trees become one expression, so selecting needs no
Python either. Further candidates from the threshold on are added where they do not overlap a base span or a better candidate.

Positions count code points, ends exclusive. Patterns are written so that Java's matcher runs in linear time without recursion on texts of any
length; they match what the plain patterns match.

Defined cases: a null text is empty and has no spans; overlapping base spans of different kinds are all kept; repeated rows and null ids are rows of
their own; an empty table, or too few base spans to fit, adds nothing. Only the id and the text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.llm.common import fold, fresh
from carnet.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<start: int, nth: int, end: int, kind: string>"

# The contract's patterns (fixed values). \G lets a match begin where the last one ended; the lookbehind only skips starts that a match from
# the beginning of the run would have covered.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators of candidates: address-like words, and runs of digits and separators.
ADDRESS = r"(?<![^\s@<>\"'])[^\s@<>\"']++(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@<>\"']++"
NUMBER = r"(?<![0-9A-Za-z])[(]?[0-9][0-9\x20().\-/]{5,}[0-9](?![0-9A-Za-z])"
CUES = {"email": r"(?i)(e-?mail|contact|write|address)", "ip": r"(?i)(\bip\b|host|server|addr)", "card": r"(?i)(card|visa|master|amex|credit|pay)", "phone": r"(?i)(phone|tel|call|fax|mobile|cell|dial)"}
FEATURES = ("kind", "digits", "groups", "parens", "sep", "lead", "trail", "cue")
#: Upper bound of distinct feature values, from the numbers of values of each feature.
CELLS = 4 * 9 * 6 * 2 * 6 * 5 * 5 * 3
CANDIDATE = "array<struct<kind: string, start: int, end: int, base: boolean, f: struct<" + ", ".join(f"{f}: int" for f in FEATURES) + ">>>"


BLOCK = 256


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, both, zero: Column) -> Column:
    """Running totals of a list under an associative operation, in two levels: lists of ``BLOCK`` items, and the totals of these."""
    def totals(items: Column, first: Column) -> Column:
        grown = F.aggregate(items, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, v: F.struct(both(acc["at"], v).alias("at"), F.array_append(acc["out"], both(acc["at"], v)).alias("out")))
        return grown["out"]

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: totals(F.slice(v, b * BLOCK + 1, BLOCK), zero))
        before = lambda found: F.concat(F.array(zero), totals(F.transform(found, lambda f: F.element_at(f, -1)), zero))
        return once(blocks, lambda found: F.flatten(F.zip_with(found, F.slice(before(found), F.lit(1), F.size(found)), lambda f, start: F.transform(f, lambda x: both(start, x)))))

    return once(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Matches with their place: array of start, end, matched text, and what stands before and after. One pass cuts the text at the matches;
    lengths of the pieces give the places, so no step goes back to the whole text."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def place(p: Column) -> Column:
        before = F.slice(p["gaps"], F.lit(1), F.size(p["found"]))
        ends = sums(F.zip_with(before, p["found"], lambda a, b: F.length(a) + F.length(b)))
        rows = F.arrays_zip(p["found"].alias("found"), before.alias("before"), F.slice(p["gaps"], F.lit(2), F.size(p["found"])).alias("after"), ends.alias("end"))
        return F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["found"])).alias("start"), r["end"].alias("end"), r["found"].alias("m"), F.substring(r["before"], -24, 24).alias("before"), F.substring(r["after"], 1, 2).alias("after")))

    return once(parts, place)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.reverse(digits_of(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
        F.floor(F.substring(back, i, F.lit(1)).cast("int") / 5).cast("int") + (F.substring(back, i, F.lit(1)).cast("int") * 2) % 10))
    return total % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def valid(kind: str, m: Column) -> Column:
    """The check of a base match."""
    n = F.length(digits_of(m))
    checks = {"email": F.lit(True), "ip": m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "card": F.when(n.between(14, 19), luhn(m)).otherwise(False), "phone": n.between(10, 15)}
    return checks[kind]


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    def of(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["m"]))
        found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))
        needed = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")
        return F.when(needed, found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.array_sort(F.concat(*map(of, KINDS)))


def _edge(c: Column) -> Column:
    """Kind of a neighbouring character: none or blank, letter, digit, sign of assignment or quotation, other."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike("^[\"'=:]"), 3).otherwise(4)


def _features(kind: str, c: Column) -> Column:
    m = c["m"]
    n = F.length(digits_of(m))
    size = F.when(n < 7, 0).when(n < 10, 1).when(n == 10, 2).when(n == 11, 3).when(n < 14, 4).when(n < 16, 5).when(n == 16, 6).when(n < 20, 7).otherwise(8)
    kinds = F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[ ./-]"), F.lit(0))))
    sep = F.when(kinds == 0, 0).when(kinds > 1, 5).when(m.contains(" "), 1).when(m.contains("-"), 2).when(m.contains("."), 3).otherwise(4)
    others = "|".join(v for k, v in CUES.items() if k != kind).replace("(?i)", "")
    cue = F.when(c["before"].rlike(CUES[kind]), 1).when(c["before"].rlike(f"(?i){others}"), 2).otherwise(0)
    values = {"kind": F.lit(KINDS.index(kind)), "digits": size, "groups": F.least(F.greatest(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(1)), F.lit(6)) - 1,
              "parens": m.contains("(").cast("int"), "sep": sep, "lead": _edge(F.regexp_replace(F.substring(c["before"], -1, 1), "[+]", "")), "trail": _edge(F.substring(c["after"], 1, 1)), "cue": cue}
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


#: Digits of a phone or a card, groups they are written in at most, and parts of an ip.
DIGITS, GROUPS, PARTS = (7, 19), 6, 4


def numbers_in(run: Column) -> Column:
    """The run, and its sequences of up to ``GROUPS`` whole digit groups, with a fitting number of digits, each with what stands around it. An opening bracket in front belongs to it."""
    def of(found: Column) -> Column:
        upto = sums(F.transform(found, lambda g: g["end"] - g["start"]))

        def from_group(ends: Column) -> Column:
            def written(at: Column, size: Column) -> Column:
                return F.array_join(F.transform(F.slice(found, at + 1, size), lambda g: F.concat(g["before"], g["m"])), "")

            def one(i: Column, j: Column) -> Column:
                first, last = F.get(found, i), F.get(found, j)
                bracket = first["before"].endswith("(").cast("int")
                ahead = F.concat(F.when(i <= 2, run["before"]).otherwise(""), written(F.greatest(i - 2, F.lit(0)), F.least(i, F.lit(2))), F.substring(first["before"], F.lit(1), F.length(first["before"]) - bracket))
                m = F.concat(F.repeat(F.lit("("), bracket), first["m"], written(i + 1, j - i))
                after = F.when(j == F.size(found) - 1, run["after"]).otherwise(last["after"])
                return F.struct((run["start"] + first["start"] - bracket).alias("start"), (run["start"] + last["end"]).alias("end"), m.alias("m"), F.substring(ahead, -24, 24).alias("before"), after.alias("after"))

            def those(i: Column) -> Column:
                had = F.get(ends, i) - (F.get(found, i)["end"] - F.get(found, i)["start"])
                far = F.least(i + GROUPS - 1, F.size(found) - 1)
                fitting = F.filter(F.sequence(i, far), lambda j: (F.get(ends, j) - had).between(*DIGITS) | (j - i == PARTS - 1))
                return F.transform(fitting, lambda j: one(i, j))

            whole = F.filter(F.array(F.size(found) - 1), lambda j: (j >= GROUPS) & F.get(ends, j).between(*DIGITS))
            return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.size(found) - 1), those)), F.transform(whole, lambda j: one(F.lit(0), j)))

        return once(upto, from_group)

    return once(matches(run["m"], "[0-9]+"), of)


def candidates(text: Column) -> Column:
    """Proposed spans with features; ``base`` tells whether a candidate passes the base check of its kind."""
    def propose(found: Column, kind: str, fits) -> Column:
        def one(c: Column) -> Column:
            passes = valid(kind, c["m"])
            if kind == "phone":  # its plus sign stands before the candidate
                passes = passes & c["before"].endswith("+") & ~c["m"].contains("/")
            if kind == "email":
                passes = c["m"].rlike(rf"^[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
            return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.coalesce(passes, F.lit(False)).alias("base"), _features(kind, c).alias("f"))

        return F.transform(F.filter(found, fits), one)

    n = lambda c: F.length(digits_of(c["m"]))
    numbers = once(F.flatten(F.transform(matches(text, NUMBER), numbers_in)), lambda found: F.concat(
        propose(found, "phone", lambda c: n(c).between(7, 15)), propose(found, "card", lambda c: n(c).between(12, 19)),
        propose(found, "ip", lambda c: c["m"].rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))))
    words = propose(matches(text, ADDRESS), "email", lambda c: F.length(c["m"]) > 2)
    empty = F.array().cast(CANDIDATE)
    return F.concat(F.when(text.rlike("[0-9]"), numbers).otherwise(empty), F.when(text.rlike(r"@|[(\[]at[)\]]"), words).otherwise(empty)).cast(CANDIDATE)


# --- boosted trees ---------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Settings:
    """Parameters of the fit."""

    trees: int = 20
    depth: int = 2
    rate: float = 0.3
    precision: float = 0.95
    least: int = 20
    folds: int = 5


@dataclass
class Model:
    """Trees as nested tuples (feature, cut, below, above) or leaf values, the start value, and the threshold of each kind (log-odds)."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def value(self, x: dict[str, int]) -> float:
        def walk(node):
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            return node

        return self.start + sum(walk(t) for t in self.trees)

    def column(self, f: Column) -> Column:
        """The same value as an expression on the features."""
        def walk(node) -> Column:
            return F.when(f[node[0]] <= node[1], walk(node[2])).otherwise(walk(node[3])) if isinstance(node, tuple) else F.lit(float(node))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + walk(t)
        return out


def _grow(cells: list[dict], depth: int, rate: float):
    """A regression tree on gradients and weights of the cells."""
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    best = None
    if depth and len(cells) > 1:
        for name in FEATURES:
            for cut in sorted({c[name] for c in cells})[:-1]:
                low = [c for c in cells if c[name] <= cut]
                gl, hl = sum(c["g"] for c in low), sum(c["h"] for c in low)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, name, cut)
    if best is None:
        return rate * g / (h + 1)
    _, name, cut = best
    return (name, cut, _grow([c for c in cells if c[name] <= cut], depth - 1, rate), _grow([c for c in cells if c[name] > cut], depth - 1, rate))


def boost(cells: list[dict], settings: Settings) -> Model:
    """Fit on counted cells: feature values, ``pos`` and ``neg`` of the fitting folds, ``cpos`` and ``cneg`` of the calibration fold."""
    pos, neg = sum(c["pos"] for c in cells), sum(c["neg"] for c in cells)
    if not pos:
        return Model()
    model = Model(start=math.log((pos + 0.5) / (neg + 0.5)))
    for c in cells:
        c["v"] = model.start
    for _ in range(settings.trees):
        for c in cells:
            p = 1 / (1 + math.exp(-c["v"]))
            c["g"], c["h"] = c["pos"] - (c["pos"] + c["neg"]) * p, (c["pos"] + c["neg"]) * p * (1 - p)
        tree = _grow(cells, settings.depth, settings.rate)
        model.trees.append(tree)
        alone = Model(0.0, [tree])
        for c in cells:
            c["v"] += alone.value(c)
    for nth, kind in enumerate(KINDS):
        hits = total = 0
        ranked = sorted((c for c in cells if c["kind"] == nth), key=lambda c: -c["v"])
        for i, c in enumerate(ranked):
            hits, total = hits + c["cpos"], total + c["cpos"] + c["cneg"]
            last = i + 1 == len(ranked) or ranked[i + 1]["v"] < c["v"]
            if last and hits >= settings.least and hits >= settings.precision * total:
                model.thresholds[kind] = c["v"]
    return model


def prepare(docs: DataFrame, text: str, out: str) -> DataFrame:
    """The documents with column ``out``: base spans and candidates."""
    base, whole = fresh(docs, "base"), F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(base, base_spans(whole)).withColumn(out, F.struct(F.col(base).alias("base"), candidates(whole).alias("proposed"))).drop(base)


def fit(prepared: DataFrame, column: str, doc_id: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Fit on all documents prepared by :func:`prepare`. At most ``CELLS`` rows of counts reach the driver."""
    held = F.when(fold(F.col(doc_id), settings.folds) == 0, 1).otherwise(0).alias("held")
    rows = prepared.select(held, F.explode(F.col(f"{column}.proposed")).alias("c")).select("held", "c.base", "c.f.*")
    count = {"pos": F.col("base") & (F.col("held") == 0), "neg": ~F.col("base") & (F.col("held") == 0), "cpos": F.col("base") & (F.col("held") == 1), "cneg": ~F.col("base") & (F.col("held") == 1)}
    cells = rows.groupBy(*FEATURES).agg(*[F.count_if(c).alias(k) for k, c in count.items()]).orderBy(*FEATURES).collect()
    return boost([c.asDict() for c in cells], settings)


def spans(prepared: Column, model: Model) -> Column:
    """All spans of a document, base and added, by start, then kind."""
    base = prepared["base"]
    if not model.thresholds:
        return base
    least = F.create_map(*[F.lit(x) for kind, v in model.thresholds.items() for x in (kind, v)])
    valued = F.transform(prepared["proposed"], lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("added"), (-model.column(c["f"])).alias("worth"), F.array_position(
        F.array(*[F.lit(k) for k in KINDS]), c["kind"]).cast("int").alias("nth"), c["end"].alias("end"), c["kind"].alias("kind")))
    chosen = F.filter(valued, lambda c: -c["worth"] >= F.coalesce(F.try_element_at(least, c["kind"]), F.lit(float("inf"))))
    fixed = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("added"), F.lit(0.0).alias("worth"), (s["nth"] + 1).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    item = "struct<start: int, added: int, worth: double, nth: int, end: int, kind: string>"
    none = F.lit(None).cast(item)
    zero = F.struct(F.array().cast(f"array<{item}>").alias("out"), none.alias("last"), F.lit(0).alias("reach"))

    def sweep(acc: Column, s: Column) -> Column:
        last, apart = acc["last"], acc["last"]["end"] <= s["start"]
        base_met = F.struct(acc["out"].alias("out"), F.when(apart, last).otherwise(none).alias("last"), F.greatest(acc["reach"], s["end"]).alias("reach"))
        opened = F.struct(F.when(last.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], last)).alias("out"), s.alias("last"), acc["reach"].alias("reach"))
        better = F.struct(acc["out"].alias("out"), s.alias("last"), acc["reach"].alias("reach"))
        add = F.when(s["start"] < acc["reach"], acc).when(last.isNull() | apart, opened).when(s["worth"] < last["worth"], better).otherwise(acc)
        return F.when(s["added"] == 0, base_met).otherwise(add)

    swept = F.aggregate(F.array_sort(F.concat(fixed, chosen)).cast(f"array<{item}>"), zero, sweep, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])))
    kept = F.transform(swept, lambda s: F.struct(s["start"].alias("start"), (s["nth"] - 1).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.when(F.size(chosen) > 0, F.array_sort(F.concat(base, kept))).otherwise(base)


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 1024


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by ``<KIND>``; overlapping spans are replaced together, named by the first. The text is cut into pieces once, and each gap
    between spans is put together from the pieces it touches."""
    def gap(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        touched = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(touched, ""), start - first * PIECE + 1, end - start)

    def rebuilt(held: Column) -> Column:
        spans_, pieces = held["spans"], held["pieces"]
        reach = running(F.transform(spans_, lambda s: s["end"]), F.greatest, F.lit(0))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        heads = F.filter(F.zip_with(spans_, before, lambda s, b: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), b.alias("from"))), lambda h: h["start"] >= h["from"])
        written = F.transform(heads, lambda h: F.concat(gap(pieces, h["from"], h["start"]), F.lit("<"), F.upper(h["kind"]), F.lit(">")))
        return F.concat(F.array_join(written, ""), gap(pieces, F.array_max(reach), held["size"]))

    held = F.struct(found.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).alias("size"))
    return F.when(F.size(found) > 0, once(held, rebuilt)).otherwise(text)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, base, spans), one per document: base spans and all spans. The text is read once."""
    ready = prepare(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "p").select("doc_id", "p")
    ready = cut_lineage(ready)
    return ready.select("doc_id", F.col("p.base").alias("base"), spans(F.col("p"), fit(ready, "p", settings=settings)).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents with every span of personal data replaced; columns and the other texts stay as they are."""
    out, found = fresh(docs, "pii"), fresh(docs, "spans")
    ready = prepare(docs, text, out)
    # The candidates are few and small; they are stored once for the fit, and the texts are not.
    model = fit(cut_lineage(ready.select(F.col(doc_id).alias("doc_id"), F.col(out).alias("p"))), "p", settings=settings)
    return ready.withColumn(found, spans(F.col(out), model)).withColumn(text, redacted(F.col(text), F.col(found))).select(docs.columns)
