"""Personal data by candidate gradient boosting.

Exact rules find the base spans, which always stay. High-recall generators propose further, overlapping
spans; boosted trees score each from its format and its surroundings, and a span is selected when its
score passes the threshold that was calibrated for its kind. The trees are trained here, on sentences
written by a seeded generator (``TRAINING_ROWS`` rows, a fixed bound), with look-alikes as negatives.

Generators run to the end of what they propose, however long. A kind whose held-out candidates never reach the
precision has no threshold, and nothing is selected of it.

Defined cases: a null text counts as empty and has no spans; texts are read whole, in time n log n of
their length; of overlapping selected spans the one that starts first stays, of these the longest; spans
that overlap a base span are left out; repeated rows give repeated results; an empty table gives an
empty one; further columns are carried through by ``redact_documents`` and ignored by ``find_spans``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "key", "secret", "iban", "id")
ORDER = {k: i for i, k in enumerate(KINDS)}
TRAINING_ROWS, ROUNDS, DEPTH, RATE, PRECISION = 6000, 40, 3, 0.3, 0.99

MAIL_CHARS = re.compile(r"[A-Za-z0-9._%+-]+")
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
MAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9.]*\.[0-9.]*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Goes from @ to @: a match starts where the run of local characters before an @ starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAIL_LOCAL:
            start -= 1
        if start < at and (host := MAIL_HOST.match(text, at + 1)):
            yield "email", start, host.end()
            done = host.end()
            at = text.find("@", done)
        else:
            done = at + 1  # local characters exclude @, so no later match reaches back over it
            at = text.find("@", done)


def addresses(text: str) -> Iterator[Span]:
    """Four dotted numbers, within each run of digits and dots."""
    for run in DOTTED.finditer(text):
        parts, at, i = run[0].split("."), run.start(), 0
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(four):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    yield "ip", starts[i], starts[i + 3] + len(four[3])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += addresses(text)
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Candidate generators: kind and pattern; what group 1 holds, or else the whole match, is the span.
GENERATORS: tuple[tuple[str, re.Pattern], ...] = (
    ("key", re.compile(r"(?<![A-Za-z0-9])([A-Z0-9]{16,})(?![A-Za-z0-9])")),
    ("key", re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z]{2,6}[_-][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[ _-]?key|auth)[\"']?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"',;]{4,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?=[A-Za-z]*[0-9])[A-Za-z0-9+/]{24,}={0,2})(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("id", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9+(])(\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4})(?![0-9-])")),
    ("email", re.compile(r"([A-Za-z0-9._-]{2,64}\s?[\[(](?:at|AT)[\])]\s?[A-Za-z0-9-]{2,63}\s?(?:\.|[\[(](?:dot|DOT)[\])])\s?[A-Za-z]{2,10})")),
)
SECRET_WORD = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential")
CALL_WORD = re.compile(r"(?i)phone|tel|call|mobile|fax|cell|contact")
ID_WORD = re.compile(r"(?i)ssn|social|tax|national|identity|iban|account|bank")
CODE_WORD = re.compile(r"(?i)order|isbn|version|page|commit|hash|sha|md5|checksum|invoice|part|serial|id\b|ref|doi|section|figure")


def candidates(text: str) -> list[tuple[Span, int]]:
    """Spans with the generator that proposed them."""
    digits = DIGIT.search(text) is not None
    out = []
    for g, (kind, pattern) in enumerate(GENERATORS):
        if g in (1, 3, 4, 5, 6) and not digits:
            continue
        if g == 2 and "=" not in text and ":" not in text:
            continue
        if g == 7 and "(" not in text and "[" not in text:
            continue
        out += [((kind, *m.span(1)), g) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span, generator: int) -> list[float]:
    _, a, b = span
    own, before, after = text[a:b], text[max(0, a - 28) : a], text[b : b + 2]
    n = len(own)
    counts = [own.count(c) for c in set(own)]
    digits = sum(c.isdigit() for c in own)
    upper, lower = sum("A" <= c <= "Z" for c in own), sum("a" <= c <= "z" for c in own)
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(own, own[1:]))
    close = before[-3:]
    return [
        n,
        digits,
        digits / n,
        upper / n,
        lower / n,
        -sum(c / n * math.log2(c / n) for c in counts),
        changes / n,
        float(all(c in "0123456789abcdef" for c in own)),
        n - digits - upper - lower,
        float("=" in close or ":" in close),
        float('"' in close or "'" in close),
        float(after[:1] in "\"'") if after else 0.0,
        float(bool(SECRET_WORD.search(before))),
        float(bool(CALL_WORD.search(before))),
        float(bool(ID_WORD.search(before))),
        float(bool(CODE_WORD.search(before))),
        float(own[:4] in ("AKIA", "ASIA")),
        float(own[:1] == "(" or own[:1] == "+"),
        float(bool(digits) and luhn(re.sub(r"[^0-9]", "", own))),
        *[float(generator == g) for g in range(len(GENERATORS))],
    ]


class Trees:
    """Boosted regression trees of a fixed depth on the logistic loss."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.rounds, self.depth, self.rate, self.base, self.trees = rounds, depth, rate, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
        below = [x[:, j : j + 1] <= c[None, :] for j, c in enumerate(cuts)]
        p = y.mean()
        self.base = math.log(p / (1 - p))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            nodes = np.zeros(len(y), int)
            splits = []
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    here = np.flatnonzero(nodes == node)
                    best = (1e-9, 0, math.inf)
                    if len(here) >= 8:
                        gt, ht = g[here].sum(), h[here].sum()
                        for j, c in enumerate(cuts):
                            left = below[j][here]
                            gl, hl = g[here] @ left, h[here] @ left
                            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (float(gain[k]), j, float(c[k]))
                    splits.append(best[1:])
                    nodes[here] = 2 * node + 2 - (x[here, best[1]] <= best[2])
            first = 2**self.depth - 1
            gs = np.bincount(nodes - first, g, 2**self.depth)
            hs = np.bincount(nodes - first, h, 2**self.depth)
            leaves = -self.rate * gs / (hs + 1)
            self.trees.append((splits, leaves.tolist()))
            score = score + leaves[nodes - first]
        return self

    def score(self, row: list[float]) -> float:
        total = self.base
        for splits, leaves in self.trees:
            node = 0
            for _ in range(self.depth):
                j, cut = splits[node]
                node = 2 * node + 2 - (row[j] <= cut)
            total += leaves[node - len(splits)]
        return 1 / (1 + math.exp(-total))


def written(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A sentence of made-up words with one thing that looks private, and its span if it is."""
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9)))
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits, hexed, caps = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    quote = rng.choice(["", '"', "'"])
    name = rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "auth", "Password", "TOKEN"])
    sign = rng.choice(["=", " = ", ": ", ":"])
    positive = [
        ("", "AKIA" + some(caps, 16), ""),
        ("", rng.choice(["ghp_", "sk-", "xoxb-", "pk_"]) + some(alnum, rng.randint(24, 40)), ""),
        (name + sign + quote, some(hexed, rng.randint(12, 48)), quote),
        (name + sign + quote, some(alnum, rng.randint(8, 32)) + some(digits, 2), quote),
        (name + sign + quote, some(alnum + "!#%&*", rng.randint(8, 20)) + some(digits, 1), quote),
        ("IBAN ", "DE" + some(digits, 2) + "".join(" " + some(digits, 4) for _ in range(4)) + " " + some(digits, 2), ""),
        (rng.choice(["SSN ", "social security number ", "", "tax id "]), some(digits, 3) + "-" + some(digits, 2) + "-" + some(digits, 4), ""),
        (rng.choice(["call ", "phone ", "tel. ", "", "mobile: "]), f"({some(digits, 3)}) {some(digits, 3)}-{some(digits, 4)}", ""),
        (rng.choice(["call ", "phone ", "tel. ", "fax "]), f"{some(digits, 3)}-{some(digits, 3)}-{some(digits, 4)}", ""),
        ("", word() + rng.choice([" [at] ", "(at)", " (at) "]) + word() + rng.choice([" [dot] ", "."]) + "com", ""),
    ]
    negative = [
        ("", some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", rng.randint(16, 24)), ""),
        (rng.choice(["commit ", "sha256 ", "md5 checksum ", "hash "]), some(hexed, rng.choice([32, 40, 64])), ""),
        (name + sign, rng.choice([word(), "required", "is", "ring", "none"]), ""),
        (rng.choice(["auth", "secret", "Token", "password"]) + ": ", word(), " " + word()),
        ("ISBN ", f"978-{some(digits, 1)}-{some(digits, 2)}-{some(digits, 6)}-{some(digits, 1)}", ""),
        (rng.choice(["order ", "part ", "ref ", "invoice ", "serial "]), f"{some(digits, 3)}-{some(digits, 3)}-{some(digits, 4)}", ""),
        (rng.choice(["order ", "part ", "ref ", "page "]), f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4)}", ""),
        (rng.choice(["doi ", "serial ", "part "]), some(caps, rng.randint(16, 24)), ""),
        ("", "_".join(word() for _ in range(4)) + "_" + some(digits, 2), ""),
        ("", "-".join(word() for _ in range(5)), ""),
        ("section ", ".".join(some(digits, 1) for _ in range(3)), ""),
        ("", f"{some(digits, 3)} {some(digits, 3)} {some(digits, 3)}", rng.choice([" people", " euros", " miles"])),
        ("/", word() + "/" + word() + some(digits, 2) + "/" + word() + word() + word(), ""),
    ]
    good = rng.random() < 0.5
    left, own, right = rng.choice(positive if good else negative)
    head = " ".join(word() for _ in range(rng.randint(0, 6)))
    head += " " if head else ""
    text = head + left + own + right + rng.choice(["", ".", " "]) + " " + " ".join(word() for _ in range(rng.randint(0, 5)))
    start = len(head) + len(left)
    return text, [(start, start + len(own))] if good else []


class Model:
    def __init__(self, rows: int = TRAINING_ROWS, seed: int = 20):
        rng = random.Random(seed)
        x, y, kinds = [], [], []
        for _ in range(rows):
            text, truth = written(rng)
            for span, g in candidates(text):
                x.append(features(text, span, g))
                y.append(float((span[1], span[2]) in truth))
                kinds.append(span[0])
        data, target = np.array(x), np.array(y)
        fold = np.arange(len(y)) % 4 == 3
        self.trees = Trees().fit(data[~fold], target[~fold])
        self.threshold: dict[str, float] = {}
        held = [(self.trees.score(x[i]), y[i], kinds[i]) for i in np.flatnonzero(fold)]
        for kind in KINDS:
            scores = sorted(((s, t) for s, t, k in held if k == kind), reverse=True)
            right = 0.0
            for n, (s, t) in enumerate(scores, 1):
                right += t
                if right / n >= PRECISION:
                    self.threshold[kind] = max(0.5, s)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and base and selected spans together."""
        base = base_spans(text)
        starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
        chosen = []
        for span, g in candidates(text):
            earlier = bisect_left(starts, span[2])  # base spans that start before the span ends
            if earlier and reach[earlier - 1] > span[1] or span[0] not in self.threshold:
                continue
            if self.trees.score(features(text, span, g)) >= self.threshold[span[0]]:
                chosen.append(span)
        chosen.sort(key=lambda s: (s[1], -s[2], ORDER[s[0]]))
        added, end = [], 0
        for span in chosen:
            if span[1] >= end:
                added.append(span)
                end = span[2]
        return base, sorted(base + added, key=lambda s: (s[1], ORDER[s[0]], s[2])) if added else base


MODELS: dict[int, Model] = {}


def model(rows: int = TRAINING_ROWS) -> Model:
    if rows not in MODELS:
        MODELS[rows] = Model(rows)
    return MODELS[rows]


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, base_sha256, spans, n_spans. No shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()
    found = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [f"n_{k}" for k in BASE_KINDS]
        types = dict.fromkeys(counts, pa.int64()) | {"base_sha256": pa.string(), "spans": pa.string(), "n_spans": pa.int64()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in types}
            for text in batch.column(1).to_pylist():
                base, every = found.spans(text or "")
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(spelled(base).encode()).hexdigest())
                out["spans"].append(spelled(every))
                out["n_spans"].append(len(every))
            yield batch_of({"id": batch.column(0)} | out, types)

    return map_texts(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        run,
        f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long",
    ).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, each span in the text replaced by its kind in brackets. No shuffle."""
    found, names = model(), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            new = [None if t is None else redacted(t, found.spans(t)[1]) for t in texts]
            fields = dict(zip(names, batch.columns)) | {text_col: pa.array(new, pa.string())}
            if chars_col in fields:
                fields[chars_col] = pa.array([None if t is None else len(t) for t in new], fields[chars_col].type)
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    return map_texts(df, run, df.schema)
