"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. A CRF over the tokens that hold a digit or an
``@`` adds to them: neighbouring tokens share a chain potential, and distant
tokens with the same or similar digits share a skip potential, so that a number
recognised in one place is recognised wherever else the document repeats it.
Labels of base spans are observed; marginals of the other tokens come from
loopy belief propagation over every document that has a token outside base
spans, with or without an observed one. All documents of a batch are one graph
of separate parts, in numpy arrays.

Skip edges do not weaken with distance: a token is linked to the nearest
observed token that shares a key with it; a key with tokens that no observed
one is linked to links them through one node of its own. The messages of a
document run until none moves by more than ``STILL``. How far a link outweighs
the token's own features is learned: bare digits, which no base phone has, can
stay without a label beside a recognised number, near or far.

Weights are learned piecewise from ``SAMPLE`` documents at most (those of them
with a digit or an ``@``), chosen by a seeded hash: a softmax layer for the token
potential, and smoothed label counts for the two pair potentials. The patterns
would teach only what they find themselves, so documents with a phone or card
number are learned from a second time with the number also in a form that hides
it from the patterns, under its label.

Defined results: a null or empty text has no spans; offsets are code points;
rows are independent of each other, so repeated rows and null ids do no harm;
added spans never overlap base spans; texts are read whole, however long; columns
named ``base`` or ``spans`` are replaced; an empty table gives no rows, and without
a number or address to learn from the base spans are all there is.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, read_table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SEED = 20_002
SAMPLE = 16_000
#: Text bytes of the sample that pass through the driver at most.
SAMPLE_BYTES = 64 << 20
#: A token is added if its marginal is at least this.
SURE = 0.9
STILL = 1e-4
#: Loops that never settle end here; from a tenth of it on, steps are shorter.
ROUNDS = 1000

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a start inside digits fails where their first fails
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[+(]*[A-Za-z0-9](?:.*[A-Za-z0-9])?\)?", re.DOTALL)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then by start."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(only_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ---------------------------------------------------------------- the graph


def features(token: str, before: str, after: str) -> list[float]:
    digits = only_digits(token)
    n, dots = len(digits), token.count(".")
    plain = token.strip(".,;:!?()[]{}\"'%$#")
    ip = bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain)) and all(int(p) < 256 for p in plain.split("."))
    return [
        1.0,
        "@" in token,
        bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", token)),
        token.startswith("+"),
        before.startswith("+"),
        "(" in token and ")" in token,
        "-" in token and n >= 7,
        ip,
        dots == 3,
        plain.isdigit(),
        n in (1, 2), n in (3, 4), 5 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n > 19,
        16 <= n <= 19 and luhn(digits),
        any(c.isalpha() for c in token),
        bool(_ANY.search(before)),
        bool(_ANY.search(after)),
        "=" in before or '"' in token,
    ]


class Document:
    """Tokens of a text that hold a digit or an @, and the edges between them.

    ``far`` has the successive tokens of each key, to learn from; ``skip`` is what messages go over.
    """

    def __init__(self, text: str):
        self.base = base_spans(text)
        self.at = [m.span() for m in _TOKEN.finditer(text) if _ANY.search(m[0])]
        self.tokens = [text[s:e] for s, e in self.at]
        self.known = self._observed()
        self.near: list[tuple[int, int]] = []
        self.far: list[tuple[int, int]] = []
        places: dict[str, list[int]] = {}
        for i, token in enumerate(self.tokens):
            if i and self.at[i][0] - self.at[i - 1][1] <= 1:
                self.near.append((i - 1, i))
            for key in self._keys(i):
                if key in places:
                    self.far.append((places[key][-1], i))
                places.setdefault(key, []).append(i)
        self.skip: list[tuple[int, int]] = []
        self.hubs = 0
        self._link([np.array(at) for at in places.values() if len(at) > 1])

    def _link(self, groups: list[np.ndarray]) -> None:
        """Skip edges of the tokens of each key; hubs are numbered on from the tokens."""
        told = self.known > 0
        for at in groups:
            fixed, free = at[self.known[at] > 0], at[self.known[at] == 0]
            if len(fixed):
                k = np.searchsorted(fixed, free)
                left, right = fixed[np.maximum(k - 1, 0)], fixed[np.minimum(k, len(fixed) - 1)]
                nearest = np.where(np.abs(free - left) <= np.abs(right - free), left, right)
                self.skip += zip(nearest.tolist(), free.tolist(), strict=True)
                told[free] = True
        for at in groups:
            if told[at].all():  # an observed token tells each of them, by this key or another
                continue
            if len(at) == 2:
                self.skip.append((int(at[0]), int(at[1])))
            else:
                self.skip += [(len(self.tokens) + self.hubs, i) for i in at.tolist()]
                self.hubs += 1

    def _observed(self) -> np.ndarray:
        known = np.zeros(len(self.at), np.int8)
        starts = np.array([s for s, _ in self.at])
        ends = np.array([e for _, e in self.at])
        for kind, s, e in self.base:
            known[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = LABELS.index(kind)
        return known

    def _keys(self, i: int) -> set[str]:
        """Tokens with a key in common are linked."""
        token = self.tokens[i]
        if "@" in token:
            return {"@" + token.strip(".,;:!?()[]{}\"'<>").lower()}
        digits, keys = only_digits(token), set()
        if len(digits) >= 7:
            keys |= {"=" + digits, "7" + digits[-7:]}
        # a number of several tokens: the digits of up to three in a row
        run, j = digits, i
        while j and i - j < 2 and self.at[j][0] - self.at[j - 1][1] <= 1:
            j -= 1
            run = only_digits(self.tokens[j]) + run
            if len(run) >= 7 and len(digits) >= 3:
                keys.add("7" + run[-7:])
        return keys

    def features(self) -> np.ndarray:
        n = len(self.tokens)
        beside = lambda i, k: self.tokens[i + k] if 0 <= i + k < n and abs(self.at[i + k][0 if k > 0 else 1] - self.at[i][1 if k > 0 else 0]) <= 1 else ""
        return np.array([features(t, beside(i, -1), beside(i, 1)) for i, t in enumerate(self.tokens)], np.float64)


def hidden(text: str, rng: random.Random) -> Document | None:
    """``text`` with its first phone or card number said again in a form that no pattern finds."""
    number = next(((k, s, e) for k, s, e in base_spans(text) if k in ("phone", "card")), None)
    if number is None:
        return None
    kind, s, e = number
    digits = only_digits(text[s:e])
    if kind == "phone":
        last = digits[-10:]
        form = rng.choice([last, digits, f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}"])
    else:
        form = "/".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    words = text.split(" ")
    at = rng.randrange(len(words) + 1)
    before = " ".join(words[:at])
    start = len(before) + (at > 0)
    doc = Document(" ".join([*words[:at], form, *words[at:]]))
    for i, (b, f) in enumerate(doc.at):
        if b < start + len(form) and start < f and not doc.known[i]:
            doc.known[i] = LABELS.index(kind)
    return doc


class SkipChain:
    """Weights of the token potential, and log potentials of the pairs."""

    def __init__(self, weights: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.weights, self.near, self.far = weights, near, far

    @classmethod
    def fit(cls, texts: list[str], seed: int = SEED) -> SkipChain | None:
        docs = [d for d in map(Document, texts) if d.tokens]
        if not docs:
            return None
        rng = random.Random(seed)
        docs += [h for text in texts if (h := hidden(text, rng))]
        x = np.concatenate([d.features() for d in docs])
        y = np.concatenate([d.known for d in docs]).astype(int)
        w = np.zeros((x.shape[1], len(LABELS)))
        target = np.eye(len(LABELS))[y]
        for step in range(400):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w -= (2.0 / (1 + step / 200)) * (x.T @ (p - target) / len(x) + 1e-4 * w)

        def pairs(edges: str, prior: np.ndarray) -> np.ndarray:
            n = prior.copy()
            for d in docs:
                for i, j in getattr(d, edges):
                    n[d.known[i], d.known[j]] += 1
            n /= n.sum()
            return np.log(n / np.outer(n.sum(axis=1), n.sum(axis=0)))

        k = len(LABELS)
        #: What distant equal tokens share is label agreement; base spans alone say too little about it.
        return cls(w, pairs("near", np.ones((k, k))), pairs("far", np.full((k, k), 0.5) + np.eye(k) * 20))

    def marginals(self, docs: list[Document]) -> np.ndarray:
        k = len(LABELS)
        x = np.concatenate([d.features() for d in docs])
        known = np.concatenate([d.known for d in docs])
        unary = x @ self.weights
        unary -= unary.max(axis=1, keepdims=True)
        unary[known > 0] = -1e3
        unary[known > 0, known[known > 0]] = 0.0
        unary = np.concatenate([unary, np.zeros((sum(d.hubs for d in docs), k))])
        a, b, pot, of, shift, hub = [], [], [], [], 0, len(x)
        for at, d in enumerate(docs):
            n = len(d.tokens)
            for edges, table in ((d.near, self.near), (d.skip, self.far)):
                for i, j in edges:
                    a.append(i + shift if i < n else i - n + hub)
                    b.append(j + shift)
                    pot.append(table)
                    of.append(at)
            shift += n
            hub += d.hubs
        if a:
            src, dst = np.array(a + b), np.array(b + a)
            table = np.concatenate([np.stack(pot), np.stack(pot).transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            doc, live = np.array(of + of), np.arange(len(src))
            msg = np.zeros((len(src), k))
            for step in range(ROUNDS):
                total = unary.copy()
                np.add.at(total, dst[live], msg[live])
                out = (total[src[live]] - msg[back[live]])[:, :, None] + table[live]
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                moved = np.zeros(len(docs))
                np.maximum.at(moved, doc[live], np.abs(new - msg[live]).max(axis=1))
                msg[live] += (0.5 if step < ROUNDS // 10 else 0.1) * (new - msg[live])
                live = live[moved[doc[live]] > STILL]
                if not len(live):
                    break
            np.add.at(unary, dst, msg)
        unary = unary[: len(x)]
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def find(model: SkipChain | None, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans."""
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    work = [(i, t, Document(t)) for i, t in enumerate(texts) if isinstance(t, str) and _ANY.search(t)]
    for i, _, d in work:
        out[i] = (d.base, d.base)
    open_ = [(i, t, d) for i, t, d in work if d.tokens and not d.known.all()]
    if model is None or not open_:
        return out
    p = model.marginals([d for _, _, d in open_])
    at = 0
    for i, text, d in open_:
        best = p[at : at + len(d.tokens)]
        at += len(d.tokens)
        added: list[list] = []
        for j in np.flatnonzero((d.known == 0) & (best.argmax(axis=1) > 0) & (best.max(axis=1) >= SURE)):
            kind = LABELS[best[j].argmax()]
            core = _CORE.search(d.tokens[j])
            if core is None:
                continue
            s, e = d.at[j][0] + core.start(), d.at[j][0] + core.end()
            longest = {"card": 19, "phone": 15}.get(kind, 0)
            if added and added[-1][0] == kind and s - added[-1][2] <= 1 and len(only_digits(text[added[-1][1] : e])) <= longest:
                added[-1][2] = e
            else:
                added.append([kind, s, e])
        new = [(k, s, e) for k, s, e in added if not any(s < f and b < e for _, b, f in d.base)]
        if new:
            out[i] = (d.base, sorted([*d.base, *new], key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def train(docs: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> SkipChain | None:
    """Learns from at most ``sample`` documents and ``sample_bytes`` of text, chosen by a hash of id and text."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = bounded_sample(docs.select("doc_id", "text"), key, sample)
    rows = rows.where(F.col("text").rlike("[0-9@]")).select("text", F.octet_length("text").cast("long").alias("bytes"), key.alias("key"))
    upto = Window.orderBy("key", "text").rowsBetween(Window.unboundedPreceding, 0)  # over the bounded sample alone
    rows = rows.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= sample_bytes).select("text")
    return SkipChain.fit(sorted(r["text"] for r in rows.collect()))


def detect(docs: DataFrame, model: SkipChain | None) -> DataFrame:
    """``docs`` plus base and spans: arrays of (kind, start, end)."""
    kind = "array<struct<kind:string,start:long,end:long>>"

    @F.pandas_udf(f"base {kind}, spans {kind}")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        row = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for part in parts:
            texts = list(part)
            found = [x for s in range(0, len(texts), 512) for x in find(model, texts[s : s + 512])]
            yield pd.DataFrame({"base": [row(b) for b, _ in found], "spans": [row(a) for _, a in found]})

    docs = docs.drop("base", "spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), spans(F.col("text")).alias("found")).select("row.*", "found.base", "found.spans")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, train(docs)).drop("text")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_found"),
    )
