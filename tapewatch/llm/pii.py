"""Personal data: base patterns, and a semi-Markov conditional random field over candidate segments.

The base finds four kinds by pattern. Around digits and at-signs the tokens of
a text form regions. A segmentation of a region splits it into single other
tokens and entities of up to ``MOST_TOKENS`` tokens; its score is the sum of
weights of whole-segment features (shape, digits, check digit, context) and of
neighbouring kinds. Dynamic programming over the bounded segments picks
boundaries and kinds together. The weights maximise the likelihood of the
segmentations that the base gives on a bounded sample of regions, so the field
finds what a pattern loses, such as a number that runs into its neighbour.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import with_columns

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 4  # of one entity
SAMPLE_REGIONS = 3000  # regions the weights are learned from
SAMPLE_TOKENS = 12  # longer regions are not used for learning
EPOCHS, RATE, DECAY = 6, 0.3, 1e-4
SURE = 0.9  # least posterior of an added span

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
_FRONT, _BACK = "([{<\"'", ".,;:!?)]}>\"'"
Span = tuple[int, int, int]  # kind's number, start, end (code points)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind's pattern that pass its check, in linear time."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # the longest local part in front that no earlier match holds
            start = at = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(_small(p) for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def regions(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Runs of neighbouring tokens with a digit or at-sign, as spans without outer punctuation, and the word before."""
    if not _MARK.search(text):
        return
    at = 0
    for line in text.split("\n"):
        if _MARK.search(line):
            run: list[tuple[int, int]] = []
            before = word = ""
            for m in _TOKEN.finditer(line):
                tok = m.group()
                if _MARK.search(tok):
                    if not run:
                        before = word
                    left, right = len(tok) - len(tok.lstrip(_FRONT)), len(tok.rstrip(_BACK))
                    run.append((at + m.start() + left, at + m.start() + max(right, left)))
                elif run:
                    yield run, before
                    run = []
                word = tok
            if run:
                yield run, before
        at += len(line) + 1


def shape(s: str) -> str:
    out = []
    for c in s:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != k or k not in "9a":
            out.append(k)
        if len(out) > 24:
            break
    return "".join(out)


def features(s: str, tokens: int, before: str) -> list[str]:
    """Features of a whole segment."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    out = ["bias", f"shape={shape(s)}", f"digits={min(n, 24)}", f"tokens={tokens}", f"length={min(len(s), 64) // 4}", f"before={before.lower()[-12:]}"]
    letters = any(c.isalpha() for c in s)
    out.append(f"letters={letters}")
    if 13 <= n <= 19 and not letters:
        out.append(f"check={luhn(digits)}")
        out.append(f"check={luhn(digits)},card={16 <= n <= 19}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append(f"octets={all(_small(p) for p in parts)}")
    if "@" in s:
        out.append(f"at={s.count('@')},dot={'.' in s.rsplit('@', 1)[1].strip('.')}")
    if s[:1] == "+":
        out.append(f"plus,range={8 <= n <= 15}")
    return out


class Field:
    """Weights by (kind, feature) and by neighbouring kinds; kind 0 stands for other tokens."""

    def __init__(self):
        self.w: list[dict[str, float]] = [defaultdict(float) for _ in range(len(KINDS) + 1)]
        self.t = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def segments(self, text: str, spans: list[tuple[int, int]], before: str) -> dict[tuple[int, int], list[str]]:
        out = {}
        for i in range(len(spans)):
            for n in range(1, min(MOST_TOKENS, len(spans) - i) + 1):
                out[i, n] = features(text[spans[i][0] : spans[i + n - 1][1]], n, before if i == 0 else "")
        return out

    def scores(self, segs: dict) -> dict[tuple[int, int, int], float]:
        out = {}
        for (i, n), fs in segs.items():
            if n == 1:
                out[i, n, 0] = 0.0
            for k in range(1, len(self.w)):
                w = self.w[k]
                out[i, n, k] = sum([w[f] for f in fs if f in w])
        return out

    def best(self, n: int, score: dict) -> list[tuple[int, int, int]]:
        """Segments (first token, tokens, kind) of the best segmentation."""
        kinds = range(len(self.w))
        top: list[list[tuple[float, tuple | None]]] = [[(0.0 if k == 0 else -math.inf, None) for k in kinds]]
        for j in range(1, n + 1):
            row = []
            for k in kinds:
                cell: tuple[float, tuple | None] = (-math.inf, None)
                for m in range(1, min(MOST_TOKENS if k else 1, j) + 1):
                    s = score[j - m, m, k]
                    for p in kinds:
                        v = top[j - m][p][0] + self.t[p][k] + s
                        if v > cell[0]:
                            cell = (v, (j - m, p, m))
                row.append(cell)
            top.append(row)
        j, k, out = n, max(kinds, key=lambda k: top[n][k][0]), []
        while j:
            i, p, m = top[j][k][1]
            out.append((i, m, k))
            j, k = i, p
        return out[::-1]

    def marginals(self, n: int, score: dict) -> dict[tuple[int, int, int, int], float]:
        """Probability of each segment (first token, tokens, kind) after each kind."""
        kinds = range(len(self.w))

        def total(xs):
            m = max(xs, default=-math.inf)
            return m if m == -math.inf else m + math.log(sum([math.exp(x - m) for x in xs]))

        fore = [[0.0 if k == 0 else -math.inf for k in kinds]]
        for j in range(1, n + 1):
            fore.append([total([fore[j - m][p] + self.t[p][k] + score[j - m, m, k] for m in range(1, min(MOST_TOKENS if k else 1, j) + 1) for p in kinds]) for k in kinds])
        back = [[0.0] * len(kinds) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            back[i] = [total([self.t[p][k] + score[i, m, k] + back[i + m][k] for k in kinds for m in range(1, min(MOST_TOKENS if k else 1, n - i) + 1)]) for p in kinds]
        z = total(fore[n])
        out = {}
        for i, m, k in score:
            for p in kinds:
                v = fore[i][p] + self.t[p][k] + score[i, m, k] + back[i + m][k] - z
                if v > -30:
                    out[i, m, k, p] = math.exp(v)
        return out

    def learn(self, cases: list[tuple[str, list, str, list]]) -> Field:
        """Gradient steps on the likelihood of the given segmentations."""
        made = [(len(spans), self.segments(text, spans, before), gold) for text, spans, before, gold in cases]
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for n, segs, gold in made:
                score = self.scores(segs)
                change: dict[tuple[int, int, int], float] = defaultdict(float)
                for (i, m, k, p), v in self.marginals(n, score).items():
                    change[i, m, k] -= v
                    self.t[p][k] -= rate * v
                p = 0
                for i, m, k in gold:
                    change[i, m, k] += 1
                    self.t[p][k] += rate
                    p = k
                for (i, m, k), v in change.items():
                    if k and abs(v) > 1e-4:
                        w = self.w[k]
                        for f in segs[i, m]:
                            w[f] += rate * (v - DECAY * w[f])
        self.w = [dict(w) for w in self.w]
        return self

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Entities of the best segmentations that overlap no base span of their kind and are sure."""
        out: list[Span] = []
        taken = {k: sorted((a, b) for kk, a, b in base if kk == k) for k in range(len(KINDS))}
        for spans, before in regions(text):
            for lo in range(0, len(spans), 64):
                part = spans[lo : lo + 64]
                score = self.scores(self.segments(text, part, before))
                found = [s for s in self.best(len(part), score) if s[2]]
                new = [(i, m, k) for i, m, k in found if not _touches(taken[k - 1], part[i][0], part[i + m - 1][1])]
                if not new:
                    continue
                sure: dict[tuple[int, int, int], float] = defaultdict(float)
                for (i, m, k, _), v in self.marginals(len(part), score).items():
                    sure[i, m, k] += v
                out += [(k - 1, part[i][0], part[i + m - 1][1]) for i, m, k in new if sure[i, m, k] >= SURE]
        return out


def _touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    import bisect

    i = bisect.bisect_left(spans, (end, -1))
    return i > 0 and spans[i - 1][1] > start


def gold_segments(spans: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int, int]] | None:
    """The base's segmentation of a region; None if an entity has too many tokens."""
    owner = [0] * len(spans)
    group = [-1] * len(spans)
    for no, (k, a, b) in enumerate(sorted(base, key=lambda s: (-s[0], s[1]))):
        inside = [i for i, (x, y) in enumerate(spans) if x < b and y > a]
        if inside and all(group[i] < 0 for i in inside):
            if len(inside) > MOST_TOKENS:
                return None
            for i in inside:
                owner[i], group[i] = k + 1, no
    out, i = [], 0
    while i < len(spans):
        m = 1
        while owner[i] and i + m < len(spans) and group[i + m] == group[i]:
            m += 1
        out.append((i, m, owner[i]))
        i += m
    return out


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(0).to_pylist():
            base = base_spans(text or "")
            for spans, before in regions(text or ""):
                if len(spans) > SAMPLE_TOKENS:
                    continue
                lo, hi = spans[0][0], spans[-1][1]
                if hi - lo > 512:
                    continue
                gold = gold_segments(spans, [s for s in base if s[1] < hi and s[2] > lo])
                if gold:
                    rows.append([text[lo:hi], [x - lo for s in spans for x in s], before[-12:], [x for s in gold for x in s]])
        ints = pa.list_(pa.int32())
        types = [pa.string(), ints, pa.string(), ints]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["text", "spans", "before", "gold"])


def learn_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_REGIONS) -> Field:
    """Weights from at most ``most`` regions: those with the smallest hashes among documents drawn by hash of id."""
    n = docs.count()
    share = min(1.0, 8 * most / max(n, 1))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    cases = drawn.select(F.col(text_col).alias("text")).mapInArrow(_cases, "text string, spans array<int>, before string, gold array<int>")
    rows = cases.orderBy(F.xxhash64("text", "before"), "text", "before").limit(most).collect()
    three = lambda x: [tuple(x[i : i + 3]) for i in range(0, len(x), 3)]
    two = lambda x: [tuple(x[i : i + 2]) for i in range(0, len(x), 2)]
    return Field().learn([(r.text, two(r.spans), r.before, three(r.gold)) for r in rows])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(at: int, field: Field):
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(at).to_pylist():
                base = base_spans(text or "")
                every = base + field.spans(text or "", base)
                rows.append([sum(s[0] == k for s in base) for k in range(len(KINDS))] + [hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)])
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names) if c not in names}
            for i, c in enumerate(names):
                cols[c] = pa.array([r[i] for r in rows], pa.int64() if i < len(KINDS) else pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def find_personal_data(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with counts of base spans by kind, their digest, and all spans.

    ``spans`` and the digest's text are ``kind:start:end`` in the order of
    ``KINDS``, then start, joined by commas; code points, end exclusive. Null
    and empty texts have none: an empty string. Columns of ``docs`` with these
    names are replaced. Rows are independent of each other.
    """
    ddl = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.mapInArrow(_find(docs.columns.index(text_col), field), with_columns(docs, ddl))
