"""Personal data by weak-supervision aggregation.

Candidates are the base spans (fixed patterns, see ``base_spans``) and wider forms that the
base patterns miss: written-out addresses such as ``name (at) host (dot) org``, eight-part
IP addresses, phone numbers without ``+``, cards written with dots or slashes, and every other
group of 7 to 19 digits (up to 12 as a phone, from 13 on as a card), most of which are no personal
data: there the labelers disagree, and the classifier decides. Five
labelers vote +1, -1 or 0 (abstain) on each candidate: pattern, structure, gazetteer,
context words and boundary. Expectation-maximisation over the counted vote patterns
estimates, for each kind, how reliable every labeler is and the chance that a candidate of
a pattern is personal data. Those chances are the soft labels of a logistic classifier
over votes and surface features, which decides on the candidates outside the base. Base
spans always stay.

Counts of (kind, votes, features) cover all documents; they are summed before the shuffle
and reach the driver as one row for each combination that occurs, of at most
4 * 3^5 * 6 * 4 * 4 by construction.

All scans are linear in the text, also in very long runs of digits or letters. Defined
results: a null text counts as empty and has no spans; repeated rows each get their result;
empty tables give no rows; without candidates nothing is added. Where wider forms overlap, the
one that starts first stays, then the kind first in the alphabet, then the shorter one; none
overlaps a base span. Very long texts are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.llm.common import add_columns, fresh, map_batches

# The kinds in their order, with the base patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)

# Wider forms.
_AT = re.compile(r"\x20?[(\[{]at[)\]}]\x20?", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\.)[A-Za-z0-9-]+)+", re.I)
_IP8 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_GROUP = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,}+\)?(?:[\x20./-]?\(?[0-9]{2,}+\)?)*+(?![0-9A-Za-z])")
_CARD_PARTS = re.compile(r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com net org edu gov mil int info io co uk de fr es it nl eu us ca au jp cn in br ch at be".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "35", "37", "6011", "65")
FOR_CUES = {
    "email": re.compile(r"e-?mail|contact|write to|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|client", re.I),
    "card": re.compile(r"card|credit|visa|pay|carte|karte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel\b|tel\.|mobile|fax|telefon|llam", re.I),
}
AGAINST_CUES = re.compile(r"version|\bv\.?\Z|isbn|issn|order|invoice|serial|\bno\.?\Z|\bid\Z|=\s*\"?\Z", re.I)
VOTERS = ("pattern", "structure", "gazetteer", "context", "boundary")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _addresses(text: str, marks, domain) -> list[tuple[int, int]]:
    """Leftmost matches of local part, mark, domain; ``marks`` gives (start, end)."""
    found, past = [], 0
    for start, end in marks:
        if start <= past - 1:
            continue
        at = start  # the run of local characters before the mark
        while at > past and _is_local(text[at - 1]):
            at -= 1
        if at < start and (m := domain.match(text, end)):
            found.append((at, m.end()))
            past = m.end()
        else:
            past = max(past, end)
    return found


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def _at_signs(text: str):
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind."""
    if not _ANY.search(text):
        return []
    found = [(a, "email", b) for a, b in _addresses(text, _at_signs(text), _DOMAIN)]
    found += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), "phone", m.end()))
    return found


def wider_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Candidates outside the base spans."""
    if not _ANY.search(text):
        return []
    found = [(a, "email", b) for a, b in _addresses(text, (m.span() for m in _AT.finditer(text)), _SPELLED)]
    if text.count(":") >= 7:
        found += [(m.start(), "ip", m.end()) for m in _IP8.finditer(text)]
    found += [(m.start(), "card", m.end()) for m in _CARD_PARTS.finditer(text)]
    found += [(m.start(), "phone", m.end()) for m in _LOCAL_PHONE.finditer(text)]
    for m in _GROUP.finditer(text):
        digits = sum("0" <= c <= "9" for c in m[0])
        if 7 <= digits <= 19:
            found.append((m.start(), "phone" if digits <= 12 else "card", m.end()))
    if not found:
        return []
    out, past = [], 0
    starts, ends = [a for a, _, _ in sorted(base)], []
    for _, _, b in sorted(base):  # the furthest end of the base spans so far
        ends.append(max(b, ends[-1]) if ends else b)
    for a, kind, b in sorted(found):
        before = bisect_left(starts, b)  # base spans that start before this one ends
        if a >= past and not (before and ends[before - 1] > a):
            out.append((a, kind, b))
            past = b
    return out


def votes(text: str, start: int, kind: str, end: int, is_base: bool) -> tuple[int, ...]:
    """The vote of each of VOTERS on a candidate."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        top = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]}"))[-1].lower()
        structure = 1 if top.isalpha() and 2 <= len(top) <= 24 else -1
        gazetteer = 1 if top in TOP_DOMAINS else 0
    elif kind == "ip":
        parts = span.split("." if "." in span else ":")
        structure = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) or parts[0] == "0" else 1
        gazetteer = 0 if parts[0] in ("0", "10", "127", "255") or span.startswith("192.168.") else 1
    elif kind == "card":
        structure = 1 if _luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
    else:
        structure = 1 if 10 <= len(digits) <= 15 else 0 if 7 <= len(digits) <= 9 else -1
        code = span.startswith("+") and any(digits[:n] in CALLING_CODES for n in (1, 2, 3))
        gazetteer = 1 if code else 0
    before = text[max(0, start - 30) : start]
    context = 1 if FOR_CUES[kind].search(before) else -1 if AGAINST_CUES.search(before) else 0
    inside = _side(text, start - 1) == 1 or _side(text, end) == 1
    return (1 if is_base else 0, structure, gazetteer, context, -1 if inside else 1)


def _side(text: str, at: int) -> int:
    """0 outside the text, 1 letter or digit, 2 white space, 3 other."""
    if not 0 <= at < len(text):
        return 0
    return 1 if text[at].isalnum() else 2 if text[at].isspace() else 3


def surface(text: str, start: int, end: int) -> tuple[int, int, int]:
    """Length class and the classes of the neighbouring characters."""
    return min(5, (end - start) // 6), _side(text, start - 1), _side(text, end)


def _row(kind: str, vote: tuple, look: tuple) -> np.ndarray:
    """One-hot features of a candidate, for its kind."""
    x = np.zeros((len(KINDS), 1 + 3 * len(VOTERS) + 6 + 4 + 4))
    own = x[KINDS.index(kind)]
    own[0] = 1
    for j, v in enumerate(vote):
        own[1 + 3 * j + v + 1] = 1
    at = 1 + 3 * len(VOTERS)
    own[at + look[0]] = own[at + 6 + look[1]] = own[at + 10 + look[2]] = 1
    return x.ravel()


@dataclass(frozen=True)
class SpanModel:
    """``reliability``: by kind, the chance of each vote (-1, 0, 1) of each labeler on
    candidates that are not, and that are, personal data. ``weights``: the classifier."""

    reliability: dict[str, list] = field(default_factory=dict)
    weights: tuple[float, ...] = ()

    def accepts(self, kind: str, vote: tuple, look: tuple) -> bool:
        return bool(self.weights) and float(_row(kind, vote, look) @ np.array(self.weights)) > 0


def reliabilities(patterns: list[tuple[tuple, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns of one kind: vote tables (labeler, truth, vote) and the
    chance of each pattern to be personal data. Starts from the majority of the votes."""
    vote = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    chance = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1)))
    tables = np.zeros((vote.shape[1], 2, 3))
    for _ in range(rounds):
        prior = (n @ chance + 1) / (n.sum() + 2)
        for j in range(vote.shape[1]):
            for v in range(3):
                hit = vote[:, j] == v
                tables[j, 1, v] = n[hit] @ chance[hit] + 1
                tables[j, 0, v] = n[hit] @ (1 - chance[hit]) + 1
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(
            np.log(tables[j, 1, vote[:, j]] / tables[j, 0, vote[:, j]]) for j in range(vote.shape[1]))
        chance = 1 / (1 + np.exp(-odds.clip(-40, 40)))
    return tables, chance


WEIGHT = 10_000.0  # of all counted spans against the classifier's ridge


def _classifier(rows: list[tuple[str, tuple, tuple, int, float]], rounds: int = 25) -> tuple[float, ...]:
    """Logistic regression on soft labels by damped Newton steps with a ridge."""
    x = np.array([_row(kind, vote, look) for kind, vote, look, _, _ in rows])
    n = np.array([c for *_, c, _ in rows], float)
    n *= WEIGHT / n.sum()  # the ridge weighs the same for every size of the input
    y = np.array([p for *_, p in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        slope = x.T @ (n * (y - p)) - w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return tuple(map(float, w))


def train(docs: DataFrame) -> SpanModel:
    """Labeler reliabilities and the span classifier from all texts."""

    def make():
        def apply(texts):
            seen: Counter = Counter()
            for text in texts.to_pylist():
                text = text or ""
                base = base_spans(text)
                for spans, is_base in ((base, True), (wider_spans(text, base), False)):
                    for a, kind, b in spans:
                        seen[kind, votes(text, a, kind, b, is_base), surface(text, a, b)] += 1
            keys = list(seen)
            return [[k[0] for k in keys], [list(k[1]) for k in keys], [list(k[2]) for k in keys], list(seen.values())]

        return apply

    ints = T.ArrayType(T.IntegerType())
    counted = map_batches(docs.select("text"), make, T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("votes", ints),
        T.StructField("look", ints), T.StructField("n", T.LongType())]))
    rows = [(kind, tuple(v), tuple(s), n) for kind, v, s, n in
            counted.groupBy("kind", "votes", "look").agg(F.sum("n").alias("n")).collect()]
    rows.sort()
    reliability, soft = {}, []
    for kind in KINDS:
        patterns: Counter = Counter()
        for k, v, _, n in rows:
            if k == kind:
                patterns[v] += n
        if not patterns:
            continue
        tables, chance = reliabilities(list(patterns.items()))
        reliability[kind] = tables.tolist()
        of = dict(zip(patterns, chance.tolist()))
        soft += [(k, v, s, n, of[v]) for k, v, s, n in rows if k == kind]
    return SpanModel(reliability, _classifier(soft) if soft else ())


def find(text: str | None, model: SpanModel) -> tuple[list, list]:
    """The base spans and all spans, each by start and kind."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    more = [s for s in wider_spans(text, base)
            if model.accepts(s[1], votes(text, *s, False), surface(text, s[0], s[2]))]
    return base, sorted(base + more, key=order)


def written(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def spans_table(docs: DataFrame, model: SpanModel) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row.

    The counts and the digest are of the base spans; ``spans`` has all."""

    def make():
        def apply(ids, texts):
            counts = {k: [] for k in KINDS}
            sha, every, added = [], [], []
            for text in texts.to_pylist():
                base, spans = find(text, model)
                n = Counter(kind for _, kind, _ in base)
                for k in KINDS:
                    counts[k].append(n[k])
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(spans))
                added.append(len(spans) - len(base))
            return [ids, *counts.values(), sha, every, added]

        return apply

    return map_batches(docs.select("doc_id", "text"), make, T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
           T.StructField("n_added", T.LongType())]))


def masked(text: str | None, model: SpanModel) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become
    one, named after the first."""
    if text is None:
        return None
    out, past = [], 0
    for a, kind, b in find(text, model)[1]:
        if a >= past:
            out += [text[past:a], f"[{kind.upper()}]"]
        past = max(past, b)
    return "".join([*out, text[past:]])


def mask(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, where there is one,
    set to the new length."""

    def make():
        def apply(texts):
            return [[masked(t, model) for t in texts.to_pylist()]]

        return apply

    was = fresh(docs, "was")
    out = add_columns(docs.withColumn(was, F.col("text")), ["text"], make, [T.StructField("text", T.StringType())])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = ~F.col(was).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
