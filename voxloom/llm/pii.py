"""Personal data: candidate spans from high-recall generators, judged by boosted trees.

Four kinds, in this order: email, ip, card, phone. *Base* spans follow fixed rules (pattern plus a check on octets,
Luhn digits or the number of digits) and are always kept. The generators propose further, overlapping spans: spelled-out
mail addresses, digit groups with any separators, numbers without a plus sign or of unusual octets. Boosted trees score a candidate by
its format and its context, but not by what the base checks read (plus sign, ``@``, Luhn, octets), or they would only
repeat the base rules; a failed checksum keeps a number out of the proposals for cards; per-kind thresholds, calibrated for precision on scores that every example has from trees fitted
without its document, choose what is added.

Defined results: null text counts as empty and has no spans; texts of any length are read whole (all scans are linear);
repeated rows give repeated results; columns named ``pii_base`` and ``pii_spans`` are replaced, all others are carried
along untouched, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.boosting import BoostedTrees, bin_edges, binned
from voxloom.llm.common import quoted, trimmed, unused, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DOT = r" ?[(\[{<] ?dot ?[)\]}>] ?| dot "
_SPELLED = re.compile(
    rf"(?i)[A-Z0-9._%+-]{{1,64}}(?: ?[(\[{{<] ?at ?[)\]}}>] ?[A-Z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Z0-9-]{{1,63}}){{1,4}}| at [A-Z0-9-]{{1,63}}(?:(?:{_DOT})[A-Z0-9-]{{1,63}}){{1,4}}| ?@ ?[A-Z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Z0-9-]{{1,63}}){{1,4}})"
)
_AT = re.compile(r"(?i)[(\[{<] ?at ?[)\]}>]|@")
_MARKED = re.compile(r"(?i)[(\[{<] ?at ?[)\]}>]|@| dot |[(\[{<] ?dot ?[)\]}>]")
_GROUPS = re.compile(r"\(?[0-9]+(?:[ ()./-]{1,3}[0-9]+)*")
_CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write to|reach"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|ping"),
    "card": re.compile(r"(?i)card|visa|credit|pay|account"),
    "phone": re.compile(r"(?i)tel|phone|call|fax|mobil|ring"),
}
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?![0-9])")
_WORDS = re.compile(r"[A-Za-z]{2,20} [A-Za-z]{2,20} [A-Za-z]{2,20}(?: (?=[a-m])[A-Za-z]{2,20})?")
#: How a base span can be written otherwise: signs for ``at`` and ``dot``, and separators of digit groups.
_SIGNS = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" {at} ", "."), (" @ ", " dot "))
_SEPARATORS = {"ip": (". ", " . "), "card": ("/", ".", " - "), "phone": ("-", " ", ".", "/", " - ")}
_OTHER = re.compile(r"(?i)version|license|section|chapter|page|year|total|token|password|isbn|id\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_emails(text: str) -> list[tuple[int, int]]:
    """Found from each ``@`` outwards, so a long run of address characters is read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # no later match can reach back over this sign
        at = text.find("@", at + 1)
        while 0 <= at < free:
            at = text.find("@", at + 1)
    return out


def base_ips(text: str) -> list[tuple[int, int]]:
    """Maximal dotted runs, cut into fours from the left."""
    out = []
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind as listed, then by start."""
    spans = [("email", s, e) for s, e in base_emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        spans += [("ip", s, e) for s, e in base_ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """High-recall proposals, overlaps allowed: every base span, spelled-out addresses, and every group of seven or
    more digits as each numeric kind that its length could be."""
    out = list(spans)
    if _MARKED.search(text):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGITS.search(text):
        for m in _GROUPS.finditer(text):
            raw = m.group()
            n = sum(map(str.isdigit, raw))
            if n < 7 and raw.count(".") < 3:
                continue
            start = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
            if raw.count(".") >= 3:
                out.append(("ip", m.start(), m.end()))
            if 7 <= n <= 15:
                out.append(("phone", start, m.end()))
            if 13 <= n <= 19 and luhn(re.sub(r"[^0-9]", "", raw)):  # a number whose checksum fails is no card, however it's written
                out.append(("card", m.start(), m.end()))
    return list(dict.fromkeys(out))


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of one candidate."""
    raw = text[start:end]
    digits = re.sub(r"[^0-9]", "", raw)
    groups = [len(g) for g in re.findall(r"[0-9]+", raw)] or [0]
    before, after = text[max(0, start - 32) : start], text[end : end + 16]
    form = kind != "email"  # the length and signs of an address only tell in which form it is written
    return [
        float(KINDS.index(kind)),
        float(form and end - start),
        float(len(digits)),
        float(len(groups)),
        float(max(groups)),
        float(min(groups)),
        float(form and "(" in raw),
        float(form and raw.count("-")),
        float(form and raw.count(".")),
        float(form and raw.count(" ")),
        float(kind == "email" and bool(_AT.search(raw))),
        float(bool(_DATE.match(raw))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "=\"'#$/_" and before != ""),
        float(bool(_CONTEXT[kind].search(before))),
        float(bool(_OTHER.search(before))),
    ]


def piece(text: str, start: int, end: int) -> bool:
    """Whether a candidate is a piece of a longer token or of an assignment; such a one is never added."""
    before = text[max(0, start - 1) : start]
    return before.isalnum() or text[end : end + 1].isalnum() or (before != "" and before in "=\"'#$/_")


def ruled_out(text: str, start: int, end: int) -> bool:
    """Whether something besides the base rules speaks against a candidate: it is a piece, follows a word such as
    version or page, or is a date."""
    return piece(text, start, end) or bool(_OTHER.search(text[max(0, start - 32) : start])) or bool(_DATE.match(text, start))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def apart(start: int, end: int, taken: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps none of the ordered stretches."""
    k = bisect.bisect_left(taken, (end,))
    return k == 0 or taken[k - 1][1] <= start


def rewritten(raw: str, kind: str, turn: int) -> str:
    """A base span in another form, one that only the generators find: ``turn`` picks the form."""
    if kind == "email":
        if turn % 2:  # addresses with and without digits
            plain = re.sub(r"[0-9]+", "", raw)
            raw = plain if base_emails(plain) == [(0, len(plain))] else raw
        name, host = raw.split("@")
        at, dot = _SIGNS[turn // 2 % len(_SIGNS)]
        labels = host.split(".")
        return name + at + dot.join(labels[1:] if turn // 12 % 2 and len(labels) > 2 else labels)
    forms = _SEPARATORS[kind]
    groups = re.findall(r"[0-9]+", raw)
    if kind == "card":
        digits = "".join(groups)
        groups = [digits[k : k + 4] for k in range(0, len(digits), 4)]
    if kind == "phone" and len(groups) > 1 and sum(map(len, groups[1:])) >= 7 and turn % 4:
        groups = groups[1:]  # without the country
        if turn % 4 == 3 and len(groups) > 1:
            return f"({groups[0]}) " + forms[turn // 4 % len(forms)].join(groups[1:])
    return forms[turn // 4 % len(forms)].join(groups)


def examples(text: str) -> list[tuple[list[float], float]]:
    """Features and labels for training. Positive: every base span, as it stands and rewritten once. Negative: what is
    ruled out by more than the base rules, a base span taken as another kind, and plain words or a date put in place
    of an address or number. All other candidates are unlabelled and left out."""
    out, base = [], base_spans(text)
    known, places = set(base), {(s, e) for _, s, e in base}
    covered = merged([c[1:] for c in base])

    def put(kind, start, end, new, label):
        before = text[max(0, start - 40) : start]
        near = before + new + text[end : end + 20]
        c = (kind, len(before), len(before) + len(new))
        if c in candidates(near, []):
            out.append((describe(near, *c), label))

    for c in candidates(text, base):
        if c in known:
            out.append((describe(text, *c), 1.0))
            kind, s, e = c
            if e - s < 200:
                put(kind, s, e, rewritten(text[s:e], kind, zlib.crc32(text[s:e].encode("utf-8", "replace"))), 1.0)
        elif (c[1], c[2]) in places or (ruled_out(text, *c[1:]) and apart(*c[1:], covered)):
            out.append((describe(text, *c), 0.0))
    turn = zlib.crc32(text[:1000].encode("utf-8", "replace"))
    m = _WORDS.search(text, turn % max(1, min(len(text), 1000) - 80))
    if m and turn % 16 == 0:
        first, *rest = m.group().split(" ")
        put("email", *m.span(), f"{first} at {' dot '.join(rest)}", 0.0)
    elif m and turn % 16 == 1:
        year, month, day = 1950 + turn // 16 % 100, 1 + turn // 1600 % 12, 1 + turn // 19200 % 28
        sep = "-/."[turn // 7 % 3]
        put("phone", *m.span(), sep.join([f"{year}", f"{month:02}", f"{day:02}"][:: 1 if turn // 21 % 2 else -1]), 0.0)
    return out


class Judge:
    """Trees and one threshold per kind. ``trees`` is None without training candidates: nothing is added then."""

    def __init__(self, trees: BoostedTrees | None, threshold: dict[str, float]):
        self.trees, self.threshold = trees, threshold

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all chosen ones in the same order of kinds."""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        known = set(base)
        offered = [c for c in candidates(text, base) if c not in known and not piece(text, *c[1:])]
        if not offered:
            return base, base
        p = self.trees.predict(np.array([describe(text, *c) for c in offered]))
        ranked = sorted(zip(p, offered, strict=True), key=lambda x: (-x[0], x[1]))
        taken, added = merged([c[1:] for c in base]), []
        for score, (kind, s, e) in ranked:
            if score >= self.threshold[kind] and apart(s, e, taken):
                added.append((kind, s, e))
                bisect.insort(taken, (s, e))
        return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


FOLDS = 4


def train(docs: DataFrame, text: str = "text", precision: float = 0.95, seed: int = 11) -> Judge:
    """Fit on the ``examples`` of all documents, as often as they occur. Spark counts equal examples, cuts each feature at the
    quantiles of its values and counts again after binning; only the different binned examples come to the driver.

    Documents are dealt into ``FOLDS`` by a hash of their text, and every example is scored by trees fitted on the other
    folds. A kind's threshold is the lowest score from which on at least ``precision`` of these examples are positive
    (lower 95 % bound), or above 1 if there is none: some eighty positives open it. It holds for the mix of examples, as
    unlabelled candidates have no known share.
    """

    def rows(batches):
        for b in batches:
            x, y, fold = [], [], []
            for t in b.column(0).to_pylist():
                got = examples(t) if t else []
                x += [f for f, _ in got]
                y += [label for _, label in got]
                fold += [zlib.crc32(f"{seed}{t}".encode("utf-8", "replace")) % FOLDS] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(fold, pa.int32())], ["x", "y", "fold"])

    def in_bins(batches):
        for b in batches:
            if b.num_rows:
                x = binned(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), edges)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int32())), b.column("y"), b.column("fold"), b.column("n")], ["b", "y", "fold", "n"])

    found = docs.select(quoted(text)).mapInArrow(lambda b: trimmed(rows(b)), "x array<double>, y double, fold int")
    found = written(found.groupBy("x", "y", "fold").agg(F.count("*").alias("n")))
    values = found.select(F.posexplode("x").alias("feature", "value"), "n").groupBy("feature", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["feature", "value"])
    edges = [bin_edges(v.value.to_numpy(), v.n.to_numpy()) for _, v in values.groupby("feature")]
    edges[:1] = [np.arange(1.0, len(KINDS))] * len(edges[:1])  # the kind itself is its bin
    got = found.mapInArrow(lambda b: trimmed(in_bins(b)), "b array<int>, y double, fold int, n long").groupBy("b", "y", "fold").agg(F.sum("n").alias("n")).toPandas()
    if got.y.nunique() < 2:
        return Judge(None, {})
    b = np.stack(got.b.to_numpy())
    order = np.lexsort([got.fold, got.y, *b.T])  # the same order whatever the partitions
    return fit(b[order], got.y.to_numpy()[order], got.n.to_numpy(float)[order], got.fold.to_numpy()[order], edges, precision)


def fit(b: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray, edges: list[np.ndarray], precision: float) -> Judge:
    """Trees on all examples (binned, each ``n`` times), thresholds from the scores of each fold by trees on the others."""
    p, threshold = np.full(len(y), -1.0), {}
    for k in range(FOLDS):
        own = fold == k
        if own.any() and len(np.unique(y[~own])) == 2:
            p[own] = BoostedTrees(edges).fit(b[~own], y[~own], n[~own]).predict_binned(b[own])
    for k, kind in enumerate(KINDS):
        own = (b[:, 0] == k) & (p >= 0)
        order = np.argsort(-p[own], kind="stable")
        ranked, upto = p[own][order], n[own][order].cumsum()
        share = (n * y)[own][order].cumsum() / upto
        low = (share + 1.92 / upto - 1.96 * np.sqrt(share * (1 - share) / upto + 0.96 / upto**2)) / (1 + 3.84 / upto)
        last = np.append(ranked[1:] < ranked[:-1], True)[: len(ranked)]  # equal scores are taken or left together
        good = np.flatnonzero((low >= precision) & last)
        threshold[kind] = float(max(0.5, ranked[good[-1]])) if len(good) else 2.0
    return Judge(BoostedTrees(edges).fit(b, y, n), threshold)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of (kind, start, end), code points, end exclusive."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(judge)

    @F.pandas_udf(T.StructType([T.StructField("base", SPAN), T.StructField("spans", SPAN)]))
    def spans(texts: pd.Series) -> pd.DataFrame:
        both = [shared.value.spans(t) if t else ([], []) for t in texts]
        as_rows = lambda found: [{"kind": k, "start": s, "end": e} for k, s, e in found]
        return pd.DataFrame({"base": [as_rows(b) for b, _ in both], "spans": [as_rows(a) for _, a in both]})

    name = unused(docs, "_pii")
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("pii_base", "pii_spans")]
    # not to be run a second time for a filter on its result
    found = docs.withColumn(name, spans.asNondeterministic()(quoted(text)))
    return found.select(*kept, F.col(f"{name}.base").alias("pii_base"), F.col(f"{name}.spans").alias("pii_spans"))


def redact(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """``docs`` with every chosen span of ``text`` replaced by its kind in brackets; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def one(t: str | None) -> str | None:
        if not t:
            return t
        parts, at = [], 0
        for kind, s, e in sorted(shared.value.spans(t)[1], key=lambda x: (x[1], -x[2])):
            if s >= at:
                parts += [t[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join([*parts, t[at:]])

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(pd.Series([one(t) for t in texts], dtype=object) for texts in batches)

    return docs.withColumn(text, masked.asNondeterministic()(quoted(text)))
