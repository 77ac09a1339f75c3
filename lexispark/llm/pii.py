"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The field then labels tokens (words) as one of
these, as a secret (keys, passwords, access tokens), or as nothing. Besides the chain of neighbouring tokens it has skip edges between distant tokens
of a document that repeat or resemble each other: equal after case and punctuation are set aside, of the same digits or last seven digits, or an address's
name before the @. Loopy sum-product message passing, until the messages settle, carries a label that one mention's surroundings give away
to the mentions without such signs: the value of `password = ...` further down, or a number without its country code. Repeats are linked to their first
mention, so edges grow with the tokens and evidence has two steps to go at most. What a token looks like is the same evidence in each of its mentions, so its weight is shared
among them, while the signs around a mention count in full: one cue among fifty mentions decides. Skip potentials reward equal labels, by one trained weight.

Tokens without a digit, @, = or quote, without a cue before them, and unlike any that has, cannot be labelled; they are held at "nothing" and only send that to their
neighbours, which leaves the passing of messages to the few others. All documents of a batch are one graph without edges between documents.

The field is trained on a seeded synthetic corpus of labelled sentences that is generated here, by pseudo-likelihood: each token's label given
those of its neighbours and skip partners. The corpus holds the same bare strings as nothing as often as it does as repeats of an entity, so that their looks decide nothing and
the partner does. The driver trains it once and sends the weights out.

Spans of the field that touch a pattern's span are dropped, and so are cards that fail Luhn and numbers of another form than their kind's; the others are added, without quotes, brackets and symbols at their
ends; all pattern spans stay. Nulls: a null text is empty and has no spans; a null doc_id is allowed. Texts of any length are one graph each. Of labels that tie
the first kind in order counts, "nothing" before all. Repeated rows get equal results. An empty table gives an empty result. Other columns, of any name, are not
read, and the masking passes them on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELS = ("", *KINDS)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits either matches from its start or not at all, so inner starts need no try
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
NUMBER = re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
MARK = re.compile(r'[0-9@="\']')


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            found.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind and then start."""
    found = [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        number = lambda s: "".join(c for c in s if c in "0123456789")
        small = lambda p: len(p := p.lstrip("0")) < 3 or len(p) == 3 and p <= "255"
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := number(m[0])) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(number(m[0])) <= 15]
    return found


FEATURES = ("bias", "at sign", "dotted quad", "four dots", "plus first", "area", "digits 7-8", "digits 16-19", "digits", "luhn", "hex 16", "hex 32", "caps and digits 16", "assigned cue", "cue before", "cue two before", "quoted", "letters only", "short", "long", "equals")
CUES = frozenset(("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "key", "auth"))
EDGE = "\"'`.,;:()[]{}<>!?#*$%&|"
HEX16, HEX32 = re.compile(r"[0-9a-f]{16,31}"), re.compile(r"[0-9a-f]{32,}")
CAPS = re.compile(r"(?=[A-Z0-9]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}")
AREA = re.compile(r"\(\d{3}\)|\d{3}[-.]\d{3}[-.]\d{4}|\d{3}[-.]\d{4}", re.ASCII)


CUE_WORDS = re.compile("|".join(sorted(CUES)), re.IGNORECASE)


def cue(token: str) -> bool:
    return token.strip(EDGE + "=").lower() in CUES


def token_features(t: str, before: str, two_before: str) -> list[bool]:
    core = t.strip(EDGE)
    head, eq, tail = core.partition("=")
    value = tail.strip(EDGE) if eq else core
    digits = sum(c in "0123456789" for c in value)
    number = "".join(c for c in value if c in "0123456789")
    return [
        True, "@" in core and "." in core.rpartition("@")[2], bool(IP.fullmatch(core)), core.count(".") == 3 and digits > 3, t[:1] == "+" and t[1:2].isdigit(), bool(AREA.fullmatch(t.strip("\"'`.,;:"))),
        digits in (7, 8) and digits == len(value.replace("-", "")), 16 <= digits <= 19 and digits >= len(value) - 4, digits > 0, 16 <= digits <= 19 and luhn(number), bool(HEX16.fullmatch(value)) and 0 < digits < len(value), bool(HEX32.fullmatch(value)) and 0 < digits < len(value), bool(CAPS.fullmatch(value)),
        bool(eq) and head.lower() in CUES and len(value) > 3, cue(before) and core.strip("=") != "", cue(two_before) and before in ("=", ":"), t[:1] in "\"'" and len(core) > 3, digits == 0, len(core) < 4, len(core) > 12, bool(eq) and not value,
    ]


def keys(t: str) -> list[str]:
    """What makes tokens resemble each other."""
    core = t.strip(EDGE).lower()
    value = core.partition("=")[2].strip(EDGE) or core
    out = [value] if len(value) > 5 else []
    number = "".join(c for c in value if c in "0123456789")
    if len(number) > 5:
        out.append("#" + number)
    if len(number) > 6:
        out.append("..." + number[-7:])
    name, at, _ = value.partition("@")
    if at and len(name) > 5:
        out.append(name)
    return out


#: Signs that a mention's surroundings give; the other features are the token's own.
AROUND = np.array([n in ("assigned cue", "cue before", "cue two before", "quoted") for n in FEATURES])


def graph(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Places of the tokens that can be labelled, their features, chain edges, skip edges, and how many held neighbours each has.

    What counts once for all mentions of a token is divided by their number.
    """
    signed = [bool(MARK.search(t)) or i > 0 and (cue(tokens[i - 1]) or i > 1 and tokens[i - 1] in ("=", ":") and cue(tokens[i - 2])) for i, t in enumerate(tokens)]
    known = {k for t, yes in zip(tokens, signed, strict=True) if yes for k in keys(t)}
    live = [i for i, t in enumerate(tokens) if signed[i] or known and len(t) > 5 and any(k in known for k in keys(t))]
    found = [keys(tokens[i]) for i in live]
    times = Counter(k for ks in found for k in ks)
    mentions = np.array([max([times[k] for k in ks], default=1) for ks in found], np.float64)
    rows, chain, skip, held, first = [], [], [], [], {}
    for k, i in enumerate(live):
        rows.append(token_features(tokens[i], tokens[i - 1] if i else "", tokens[i - 2] if i > 1 else ""))
        if k and live[k - 1] == i - 1:
            chain.append((k - 1, k))
        held.append(int(i > 0 and not (k and live[k - 1] == i - 1)) + int(i + 1 < len(tokens) and not (k + 1 < len(live) and live[k + 1] == i + 1)))
        skip += [(at, k) for key in found[k] if live[at := first.setdefault(key, k)] < i - 1]
    x = np.array(rows, np.float64).reshape(-1, len(FEATURES))
    return np.array(live, np.int64), np.where(AROUND, x, x / mentions[:, None]), chain, sorted(set(skip)), np.array(held, np.float64) / mentions


def synthetic(n: int = 700, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Sentences with labels: entities of each kind, most of them again later in a bare form, and look-alikes of all forms, bare ones too, that are nothing, repeated as well."""
    r = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    abc, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def card(fits: bool) -> str:
        d = "4" + pick(num, 14)
        return r.choice([d + c for c in num if luhn(d + c) == fits])

    def entity(kind: int) -> tuple[list[str], list[int], str]:
        """Tokens, labels, and the bare form of a later mention."""
        if kind == 1:
            name = f"{pick(abc, 5)}.{pick(num, 2)}"
            return [f"{name}@{pick(abc, 5)}.{pick(abc, 3)}"], [1], name
        if kind == 2:
            ip = ".".join(str(x) for x in r.integers(1, 255, 4))
            return [ip], [2], ip
        if kind == 3:
            d = card(True)
            return [d], [3], d
        if kind == 4:
            area, a, b = pick(num, 3), pick(num, 3), pick(num, 4)
            e = [f"+{r.integers(1, 99)}", f"({area})", f"{a}-{b}"] if r.random() < 0.6 else [f"+{r.integers(1, 99)}{area}{a}{b}"]
            return e, [4] * len(e), (f"{a}-{b}", f"{area}-{a}-{b}", f"{area}{a}{b}")[r.integers(0, 3)]
        form = r.integers(0, 4)
        v = bare()
        if form == 0:
            return [f"{('password', 'pwd', 'secret', 'token', 'api_key')[r.integers(0, 5)]}={v}"], [5], v
        if form == 1:
            return [("token", "password", "secret")[r.integers(0, 3)], ("=", ":")[r.integers(0, 2)], f'"{v}"' if r.random() < 0.5 else v], [0, 0, 5], v
        if form == 2:
            return [("password", "secret", "key")[r.integers(0, 3)] + ":", v], [0, 5], v
        v = "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
        return [v], [5], v

    def bare() -> str:
        """What a password, a commit's name or a product's code may look like."""
        return (pick("0123456789abcdef", int(r.integers(14, 24))), pick("0123456789abcdef", 40), pick(abc, 5) + pick(num, 3), pick(abc, int(r.integers(6, 11))))[r.integers(0, 4)]

    def lookalike() -> str:
        forms = (lambda: pick(num, int(r.integers(1, 7))), lambda: pick(num, 8), lambda: f"{pick(num, 1)}.{pick(num, 2)}", lambda: f"{pick(abc, 4)}={pick(num, 2)}", lambda: f'"{pick(abc, 6)}"', lambda: f"{pick(num, 4)}-{pick(num, 2)}-{pick(num, 2)}", lambda: pick(abc, 3) + pick(num, 2), lambda: "@" + pick(abc, 6))
        same = (bare, bare, bare, lambda: f"{pick(num, 3)}-{pick(num, 4)}", lambda: f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}", lambda: pick(num, 10), lambda: f"{pick(abc, 5)}.{pick(num, 2)}", lambda: card(False))
        return (forms if r.random() < 0.5 else same)[r.integers(0, 8)]()

    out = []
    for _ in range(n):
        tokens, labels, later = [], [], []
        for _ in range(int(r.integers(2, 6))):
            words = [pick(abc, int(r.integers(2, 9))) for _ in range(int(r.integers(1, 6)))]
            tokens, labels = tokens + words, labels + [0] * len(words)
            if r.random() < 0.5:
                run = [lookalike() for _ in range(int(r.choice([1, 2, 6], p=[0.6, 0.2, 0.2])))]
                tokens, labels = tokens + run, labels + [0] * len(run)
                again, kind = run[0], 0
            else:
                kind = int(r.integers(1, 6))
                e, marks, again = entity(kind)
                tokens, labels = tokens + e, labels + marks
            later += [(again, kind)] * int(r.choice([0, 1, 2, 4], p=[0.3, 0.3, 0.2, 0.2]))
        for k in r.permutation(len(later)).tolist():
            words = [pick(abc, int(r.integers(2, 9))) for _ in range(3)]
            tokens, labels = tokens + words + [later[k][0]], labels + [0, 0, 0, later[k][1]]
        if r.random() < 0.5:  # the bare mentions first
            cut = int(r.integers(0, len(tokens) + 1))
            whole = [i for i in range(len(tokens)) if labels[i] == 0 and tokens[i].isalpha() and len(tokens[i]) < 9]
            cut = min(whole, key=lambda i: abs(i - cut)) if whole else 0
            tokens, labels = tokens[cut:] + tokens[:cut], labels[cut:] + labels[:cut]
        out.append((tokens, labels))
    return out


@lru_cache(maxsize=1)
def trained(steps: int = 1000, rate: float = 2.0, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of features (features x labels), neighbours and skip partners (labels x labels), by pseudo-likelihood."""
    k = len(LABELS)
    xs, ys, near, far, size = [], [], [], [], 0
    for tokens, labels in synthetic():
        live, x, chain, skip, held = graph(tokens)
        y = np.array([labels[i] for i in live], np.int64)
        around, beyond = np.zeros((len(live), k)), np.zeros((len(live), k))
        around[:, 0] += held
        for edges, sums in ((chain, around), (skip, beyond)):
            for a, b in edges:
                sums[a, y[b]] += 1
                sums[b, y[a]] += 1
        xs, ys, near, far, size = [*xs, x], [*ys, y], [*near, around], [*far, beyond], size + len(y)
    x, y, near_y, far_y = np.vstack(xs), np.eye(k)[np.concatenate(ys)], np.vstack(near), np.vstack(far)
    w, c, same = np.zeros((x.shape[1], k)), np.zeros((k, k)), 0.0
    speed = [np.zeros_like(w), np.zeros_like(c), 0.0]
    for _ in range(steps):
        z = x @ w + near_y @ c + far_y * same
        p = np.exp(z - z.max(axis=1, keepdims=True))
        miss = y - p / p.sum(axis=1, keepdims=True)
        pairs = near_y.T @ miss
        step = (x.T @ miss, pairs + pairs.T, float((far_y * miss).sum()))
        speed = [0.9 * v + g / size - ridge * part for v, g, part in zip(speed, step, (w, c, same), strict=True)]
        w, c, same = w + rate * speed[0], c + rate * speed[1], same + rate * speed[2]
    return w, c, same * np.eye(k)


def beliefs(unary: np.ndarray, edges: np.ndarray, weights: np.ndarray, kind: np.ndarray, rounds: int = 200, damp: float = 0.3, settled: float = 1e-3) -> np.ndarray:
    """Loopy sum-product: log beliefs of nodes x labels. weights: a table of log potentials for each kind of edge, symmetric.

    Rounds go on until no message moves by more than `settled`; where messages swing without end the last round counts.
    """
    if not len(edges):
        return unary
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    table_of = weights[np.concatenate([kind, kind])]
    m = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, m)
        out = (total[src] - m[back])[:, :, None] + table_of
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = damp * m + (1 - damp) * new
        moved, m = np.abs(new - m).max(), new
        if moved < settled:
            break
    total = unary.copy()
    np.add.at(total, dst, m)
    return total


def field_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of what the field finds in each text."""
    w, c, s = model
    places, xs, chain, skip, held, first = [], [], [], [], [], [0]
    for t in texts:
        found = list(WORDS.finditer(t)) if MARK.search(t) or CUE_WORDS.search(t) else []  # others have no token to label
        live, x, ch, sk, h = graph([m[0] for m in found])
        at = first[-1]
        chain += [(a + at, b + at) for a, b in ch]
        skip += [(a + at, b + at) for a, b in sk]
        places.append([(int(i), *found[i].span()) for i in live])
        xs.append(x)
        held.append(h)
        first.append(at + len(live))
    if not first[-1]:
        return [[] for _ in texts]
    unary = np.vstack(xs) @ w
    unary += np.concatenate(held)[:, None] * c[0][None, :]
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    kind = np.array([0] * len(chain) + [1] * len(skip), np.int64)
    label = beliefs(unary, edges, np.stack([c, s]), kind).argmax(axis=1)
    out = []
    for t, at, n in zip(texts, first, places, strict=False):
        spans: list[list[int]] = []
        before = -2
        for k, (i, a, b) in enumerate(n):
            y = int(label[at + k])
            if y and spans and spans[-1][0] == y - 1 and before == i - 1 and y - 1 == 3:  # phone numbers go on over tokens
                spans[-1][2] = b
            elif y:
                spans.append([y - 1, a, b])
            before = i if y else -2
        for x in spans:
            if x[0] == 4 and "=" in t[x[1] : x[2]]:  # the value alone
                x[1] += t[x[1] : x[2]].index("=") + 1
            while x[1] < x[2] and t[x[1]] in EDGE and not (x[0] == 3 and t[x[1]] == "("):
                x[1] += 1
            while x[1] < x[2] and t[x[2] - 1] in EDGE:
                x[2] -= 1
        out.append([(y, a, b) for y, a, b in spans if b > a and fits(y, t[a:b])])
    return out


def fits(kind: int, span: str) -> bool:
    """Whether a span has the form of its kind: the field marks tokens one by one, and a row of them need not be a number."""
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 1:
        return bool(IP.fullmatch(span)) and all(int(p) < 256 for p in span.split(".") if len(p) < 5) and max(map(len, span.split("."))) < 5
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 7 <= len(digits) <= 15 and bool(NUMBER.fullmatch(span))
    return True


def all_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base spans and those of the field that touch none of them."""
    out = []
    for t, found in zip(texts, field_spans(texts, model or trained()), strict=True):
        base = patterns(t)
        taken = sorted((a, b) for _, a, b in base)
        ends = [b for _, b in taken]
        added = []
        for y, a, b in found:
            if taken and any(p < b and a < q for p, q in taken[max(0, int(np.searchsorted(np.maximum.accumulate(ends), a, "right")) - 1) :][:8]):
                continue
            added.append((y, a, b))
        out.append((base, added))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for y, a, b in sorted(spans))


def text_of(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, base, spans): kind:start:end, comma-joined, ends exclusive, in code points."""

    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("base string, spans string")
    def look(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in bodies:
            rows: list[tuple[str, str]] = []
            for at in range(0, len(s), 512):
                rows += [(joined(b), joined(b + a)) for b, a in all_spans(list(s[at : at + 512]), model.value)]
            yield pd.DataFrame(rows, columns=["base", "spans"])

    return docs.select("doc_id", look(text_of()).alias("r")).select("doc_id", "r.*")


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; n_chars, if there is one, follows. A null text stays null."""

    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def hide(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in bodies:
            out: list[str] = []
            for at in range(0, len(s), 512):
                texts = list(s[at : at + 512])
                for t, (base, added) in zip(texts, all_spans(texts, model.value), strict=True):
                    end, parts = 0, []
                    for a, b, y in sorted((a, b, y) for y, a, b in base + added):
                        if b <= end:
                            continue
                        parts += [t[end : max(a, end)], f"[{KINDS[y].upper()}]"]
                        end = b
                    out.append("".join([*parts, t[end:]]))
            yield pd.Series(out, dtype=object)

    hidden = docs.withColumn("text", F.when(F.col("text").isNotNull(), hide(text_of())))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    n = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")
