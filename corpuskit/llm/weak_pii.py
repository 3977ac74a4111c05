"""Personal data by weak supervision.

Exact patterns give the base spans of e-mail addresses, IP addresses, card and phone numbers;
they always stay.  Looser patterns give further candidates: obfuscated addresses, numbers of
similar shape, access tokens.  Labelers vote on every candidate, base ones included: a strict
regex, a checksum or range, a gazetteer (issuer digits, top-level domains, country codes), the
words before it, and its edges.  Expectation-maximisation over the vote patterns estimates
each labeler's reliability per kind and a probability per pattern.  A logistic span classifier
is then trained on the candidates' features with those probabilities as soft labels, and adds
the candidates it accepts unless they touch a base span.

Votes and features take few values each, so the corpus is summed up as counts of patterns: at
most 5 kinds x 3^5 votes x 192 feature rows reach the driver, whatever the number of
documents, and no text does.

Defined cases: a null text is empty and has no spans; repeated rows are scanned one by one;
without candidates nothing is added; other columns are ignored (``mask`` keeps them); an empty
table gives an empty result.  All patterns run in linear time on very long texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.shared import logistic, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser shapes of the same kinds, and access tokens.
LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key)\b {0,3}[=:] {0,3}[\"']?(?P<body>[A-Za-z0-9+/_-]{16,256})", re.I),
}
DIGITS = re.compile(r"[0-9]")
BEFORE = re.compile(r"[^\W\d_]+")
# Words that speak for and against a kind when they stand shortly before it.
SPEAKS_FOR = {
    "email": {"mail", "email", "contact", "write", "to"},
    "ip": {"ip", "host", "address", "server", "from"},
    "card": {"card", "visa", "mastercard", "payment", "credit", "account"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "secret": {"token", "secret", "password", "key"},
}
SPEAKS_AGAINST = {"version", "release", "isbn", "page", "section", "figure", "order", "serial"}
# First digits of card issuers, country calling codes' first digits in use, common top-level domains.
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"}


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost addresses: for every @ the whole run of local characters before it, then the longest domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans of the looser shapes, not touching a base span."""
    out = []
    lower = text.lower()
    if "at)" in lower or "at]" in lower or "at}" in lower:
        out += [(m.start(), m.end(), "email") for m in LOOSE["email"].finditer(text)]
    if any(w in lower for w in ("token", "secret", "passw", "api")):
        out += [(m.start("body"), m.end("body"), "secret") for m in LOOSE["secret"].finditer(text)]
    if DIGITS.search(text):
        out += [(m.start(), m.end(), "phone") for m in LOOSE["phone"].finditer(text)]
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text)]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 13 <= sum(c.isdigit() for c in m[0]) <= 19]
    if not out:
        return out
    # Both lists sorted by start: a sweep finds the candidates that overlap nothing of the base.
    base, kept, reach, i = base_spans(text), [], 0, 0
    for span in sorted(out):
        while i < len(base) and base[i][0] < span[1]:
            reach = max(reach, base[i][1])
            i += 1
        if reach <= span[0]:
            kept.append(span)
    return kept


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Votes of the labelers: 1 for personal data, -1 against, 0 none."""
    body = text[start:end]
    digits = "".join(c for c in body if c.isdigit())
    words = {w.lower() for w in BEFORE.findall(text[max(0, start - 40) : start])}
    context = 1 if words & SPEAKS_FOR[kind] else -1 if words & SPEAKS_AGAINST else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if (left.isalnum() and kind != "email") or right.isalnum() else 1
    if kind == "email":
        last = re.split(r"\W+", body.rstrip(")]}"))[-1].lower()
        return (1 if "@" in body else 0, 0, 1 if last in TOP_DOMAINS else -1, context, edges)
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in body.split(".")]
        fits = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        return (1 if len(body) >= 9 else 0, 1 if fits else -1, -1 if parts[0] in ("0", "1", "2") else 0, context, edges)
    if kind == "card":
        return (1 if len(digits) in (15, 16) else -1, 1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) and len(digits) in (15, 16) else -1, context, edges)
    if kind == "phone":
        return (1 if body.startswith("+") else 0, 1 if 10 <= len(digits) <= 15 else -1, 1 if re.match(r"\+[1-9]", body) else 0, context, edges)
    mixed = any(c.isdigit() for c in body) and any(c.isalpha() for c in body)
    return (1 if len(body) >= 32 else 0, 1 if mixed else -1, 1 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) else 0, context, edges)


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Small discrete features of a span: size, separators, first digit, letters, neighbours."""
    body = text[start:end]
    digits = sum(c.isdigit() for c in body)
    return (min(digits // 5, 3), int(any(c in " -." for c in body)), int(body[:1] in "3456"), int(any(c.isalpha() for c in body)), int(text[start - 1 : start].isspace()) + 2 * int(text[end : end + 1].isalnum()) if start else 1)


def pattern(text: str, start: int, end: int, kind: str) -> str:
    """Kind, votes and features as one short key."""
    return ",".join(map(str, (KINDS.index(kind), *votes(text, start, end, kind), *features(text, start, end))))


def reliabilities(kinds: np.ndarray, given: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability of each pattern by expectation-maximisation, kinds apart; a labeler has one rate of right votes on each class."""
    out = np.zeros(len(kinds))
    for kind in np.unique(kinds):
        at = kinds == kind
        v, n = given[at], counts[at].astype(float)
        p = np.clip(0.5 + 0.2 * v.sum(1), 0.05, 0.95)  # majority vote to begin with
        for _ in range(rounds):
            yes, no = n * p, n * (1 - p)
            share = (yes.sum() + 2) / (n.sum() + 4)
            # Smoothed towards right votes, so that the classes keep their meaning.
            hit = ((v == 1) * yes[:, None]).sum(0), ((v == -1) * no[:, None]).sum(0)
            cast = ((v != 0) * yes[:, None]).sum(0), ((v != 0) * no[:, None]).sum(0)
            right = (hit[0] + 4) / (cast[0] + 5), (hit[1] + 4) / (cast[1] + 5)
            log_yes = np.where(v == 1, np.log(right[0]), np.where(v == -1, np.log(1 - right[0]), 0)).sum(1)
            log_no = np.where(v == -1, np.log(right[1]), np.where(v == 1, np.log(1 - right[1]), 0)).sum(1)
            p = logistic(np.log(share / (1 - share)) + log_yes - log_no)
        out[at] = p
    return out


def design(keys: list[str]) -> np.ndarray:
    """One-hot features of the span classifier, per kind."""
    rows = np.array([list(map(int, k.split(","))) for k in keys]).reshape(len(keys), 11)
    kind, f, v = rows[:, 0], rows[:, 6:], rows[:, 1:6]
    columns = [np.ones(len(keys))]
    for k in range(len(KINDS)):
        columns.append(kind == k)
        columns += [(kind == k) & (v[:, j] == x) for j in range(5) for x in (-1, 1)]
        columns += [(kind == k) & (f[:, j] == x) for j, size in enumerate((4, 2, 2, 2, 4)) for x in range(1, size)]
    return np.column_stack(columns).astype(float)


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    threshold: float

    def accepts(self, keys: list[str]) -> np.ndarray:
        return logistic(design(keys) @ self.weights) >= self.threshold if keys else np.zeros(0, bool)


def train(patterns: DataFrame, threshold: float = 0.7, penalty: float = 0.3, rounds: int = 60) -> Classifier:
    """The span classifier from a table of pattern keys."""
    counts = patterns.groupBy("pattern").count().orderBy("pattern").toPandas()  # bounded, see above
    keys = counts["pattern"].tolist()
    x = design(keys)
    w = np.zeros(x.shape[1])
    if keys:
        rows = np.array([list(map(int, k.split(","))) for k in keys])
        n = counts["count"].to_numpy(float)
        soft = reliabilities(rows[:, 0], rows[:, 1:6], n)
        n = n / n.mean()
        for _ in range(rounds):
            p = logistic(x @ w)
            h = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
            w = w - np.clip(np.linalg.solve(h, x.T @ (n * (p - soft)) + penalty * w), -2, 2)
    return Classifier(w, threshold)


def extracted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans, candidates with their patterns, and the base spans' patterns."""
    span = "array<struct<start: int, end: int, kind: string, pattern: string>>"

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pattern", pa.string())]))
        for b in batches:
            base, more = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                for out, spans in ((base, base_spans(text)), (more, candidates(text))):
                    out.append([{"start": s, "end": e, "kind": k, "pattern": pattern(text, s, e, k)} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], names=["doc_id", "base", "more"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {span}, more {span}")


def chosen(base: list[tuple], more: list[tuple[int, int, str, str]], accepted: dict[str, bool]) -> list[tuple[int, int, str]]:
    """Base spans and the accepted candidates that overlap no other, first come first."""
    out, reach = list(base), 0
    for start, end, kind, key in sorted(more):
        if accepted[key] and start >= reach:
            out.append((start, end, kind))
            reach = end
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def fit(docs: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, Classifier]:
    """Stored spans of every row and the classifier trained on them."""
    rows = stored(extracted(docs))
    patterns = rows.select(F.explode(F.concat("base.pattern", "more.pattern")).alias("pattern"))
    return rows, train(patterns, threshold)


def find(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, number of base spans by kind, the hash of the base spans and all spans."""
    rows, classifier = fit(docs, threshold)

    def run(batches):
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        for b in batches:
            base, more = b.column("base").to_pylist(), b.column("more").to_pylist()
            keys = sorted({m["pattern"] for row in more for m in row})
            accepted = dict(zip(keys, classifier.accepts(keys).tolist()))
            out = [[] for _ in range(6)]
            for own, extra in zip(base, more):
                own = [(s["start"], s["end"], s["kind"]) for s in own]
                for i, k in enumerate(BASE):
                    out[i].append(sum(s[2] == k for s in own))
                out[4].append(hashlib.sha256(joined(own).encode()).hexdigest())
                out[5].append(joined(chosen(own, [tuple(m.values()) for m in extra], accepted)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(o, pa.int64()) for o in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())], names=names)

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def mask_text(text: str, classifier: Classifier) -> str:
    more = [(s, e, k, pattern(text, s, e, k)) for s, e, k in candidates(text)]
    keys = sorted({m[3] for m in more})
    spans = chosen(base_spans(text), more, dict(zip(keys, classifier.accepts(keys).tolist())))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame, threshold: float = 0.7, length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by the name of its kind; overlapping spans become one mark.

    ``length_col``, if the table has it, is set to the new number of characters where the
    text changed; null texts stay null.
    """
    _, classifier = fit(docs, threshold)
    columns = docs.columns
    at, size_at = columns.index("text"), columns.index(length_col) if length_col in columns else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [None if t is None else mask_text(t, classifier) for t in old]
            arrays = list(b.columns)
            arrays[at] = pa.array(new, b.schema.field(at).type)
            if size_at is not None:
                sizes = b.column(size_at).to_pylist()
                arrays[size_at] = pa.array([s if a == n else len(n) for s, a, n in zip(sizes, old, new)], b.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
