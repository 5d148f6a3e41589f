"""Operator 3: secrets by three fixed patterns and by a linear-chain conditional random field.

The field tags the words of a text as begin, inside or outside of a secret. Features are a word's own form (shape, length, character
kinds, or the word itself if it often stands before secrets), the same for the words around it, and facts of the whole text. It is trained here on windows
around the fixed patterns' matches, on windows without any, and on windows that get a generated secret of a further format (prefixed keys, signed
tokens, mixed pass words, key blocks of several words), from a bounded sample of documents (``max_documents``, default 8,000, chosen by a
hash of the id). Words that look random but match no pattern are in no window, as they may be secrets. Decoding is Viterbi: where "outside" leads by more than all transitions and the next word can make up, the path must pass it,
so the words between two such places are decoded on their own, exactly.

Found runs lose quotes and brackets at their ends and what fixed matches cover of them; the parts left over are added. Fixed matches always stay.

Defined results: null is the empty text, without spans. Matches of one kind never overlap; kinds may. Texts of any length
are scanned whole. Without a text in the sample the field adds nothing. Repeated rows give equal results. A result column
replaces an input column of the same name.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import SPACES, map_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The patterns, and the least length of the part that counts.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]
MAX_DOCUMENTS = 8_000
MAX_WINDOWS = 2_000
REACH = 8
TAGS = 3  # outside, begin, inside
EDGE = "\"'`()[]{}<>,;:.!?"
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SUSPECT = re.compile(r"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{24}", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, kind, end) of the fixed patterns, and for assignments the start of the value as a fifth item."""
    found = [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def word_form(word: str, known: frozenset[str]) -> str:
    """What the field sees of a word; few distinct forms for plain words."""
    core = word.strip(EDGE)
    low = core.lower()
    if low in known or word in known:
        return "w=" + (low if low in known else word)
    tail = "." if word[-1] in ".,;:!?" else ""
    if core.isalpha():
        case = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[1:].islower() else "aA"
        return f"plain {case} {min(5, len(core) // 4)}{tail}"
    kinds = "".join(k for k, p in (("d", r"[0-9]"), ("l", r"[a-z]"), ("u", r"[A-Z]"), ("s", r"[+/_=-]"), ("p", r"[^A-Za-z0-9+/_=-]")) if re.search(p, core))
    hexed = "x" if core and re.fullmatch(r"[0-9a-f]+", core) else ""
    runs = len(re.findall(r"[0-9]+|[a-z]+|[A-Z]+", core))
    quoted = "q" if word[0] in "\"'" else ""
    digits = round(4 * sum(map(str.isdigit, core)) / len(core)) if core else 0
    return f"mixed {kinds}{hexed}{quoted} {min(8, len(core) // 4)} {min(6, runs // 2)} {digits}{tail}"


def form_features(form: str) -> list[str]:
    if not form.startswith("mixed"):
        return [form]
    _, kinds, size, runs, rest = form.split(" ")
    return [form, "k=" + kinds, "n=" + size, "r=" + runs, "d=" + rest, f"kn={kinds} {size}"]


def text_facts(words: list[str]) -> np.ndarray:
    """Facts of the whole text: constant, looks like a table or log, has key-value marks."""
    n = max(1, len(words))
    return np.array([1.0, float(10 * words.count("|") > n), float(words.count("=") + words.count(":") > 0)])


@dataclass
class SecretField:
    """Weights by feature for a word itself, as the word before and as the word after; transitions are log scores."""

    known: frozenset[str] = frozenset()
    features: dict[str, int] = field(default_factory=dict)
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, TAGS)))
    before: np.ndarray = field(default_factory=lambda: np.zeros((0, TAGS)))
    after: np.ndarray = field(default_factory=lambda: np.zeros((0, TAGS)))
    facts: np.ndarray = field(default_factory=lambda: np.zeros((3, TAGS)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((TAGS, TAGS)))

    @property
    def empty(self) -> bool:
        return not self.features

    def form_scores(self, form: str) -> np.ndarray:
        at = [self.features[f] for f in form_features(form) if f in self.features]
        return np.concatenate([w[at].sum(axis=0) for w in (self.own, self.before, self.after)])


#: Inside can follow only begin or inside; a text can't start with it.
_BARRED = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def tags_of(words: list[tuple[int, int]], spans: list[tuple]) -> np.ndarray:
    """Tags of word ranges from the values of fixed matches."""
    tags = np.zeros(len(words), dtype=np.int64)
    values = sorted({(s[4], s[3]) for s in spans})
    for start, end in values:
        first = True
        for i, (a, b) in enumerate(words):
            if a < end and b > start and tags[i] == 0:
                tags[i] = 1 if first else 2
                first = False
    return tags


def training_windows(text: str, reach: int = REACH) -> Iterator[tuple[list[str], list[int], list[float]]]:
    """Windows around every match, and two without a match from a fixed place of the text."""
    spots = [(m.start(), m.end()) for m in WORD.finditer(text)]
    if not spots:
        return
    words = [text[a:b] for a, b in spots]
    tags = tags_of(spots, base_spans(text)) if _SUSPECT.search(text) else np.zeros(len(words), dtype=np.int64)
    facts = text_facts(words).tolist()
    hits = np.flatnonzero(tags == 1).tolist()
    open_ = np.array([tag == 0 and looks_random(w) for w, tag in zip(words, tags.tolist())])
    mixed = [i for i, w in enumerate(words) if tags[i] == 0 and not open_[i] and not w.strip(EDGE).isalpha()]
    for centre in [*hits, *mixed[:: max(1, len(mixed) // 2)][:3], len(words) // 3]:
        lo, hi = max(0, centre - reach), min(len(words), centre + reach + 1)
        # words that nobody knows to be secrets or not end the window
        unknown = np.flatnonzero(open_[lo:hi]) + lo
        lo = max([lo, *(unknown[unknown < centre] + 1).tolist()])
        hi = min([hi, *unknown[unknown >= centre].tolist()])
        if lo < hi:
            yield words[lo:hi], tags[lo:hi].tolist(), facts


def looks_random(word: str) -> bool:
    """A long word of mixed kinds that may be a secret of a format no pattern knows."""
    core = word.strip(EDGE)
    kinds = sum(bool(re.search(p, core)) for p in (r"[0-9]", r"[a-z]", r"[A-Z]"))
    return len(core) >= 16 and kinds >= 2 and len(re.findall(r"[0-9]+|[a-z]+|[A-Z]+", core)) >= 5


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LETTERS + _LETTERS.upper() + "0123456789"
_LEADS = [["passcode", "="], ["passcode:"], ["key", "="], ["credential:"], ["Authorization:", "Bearer"], ["auth"], []]


def generated_secret(rng: random.Random) -> tuple[list[str], list[int]]:
    """Words and tags of a secret in a format that the fixed patterns miss, with what may stand before it."""
    draw = lambda n, signs=_MIXED: "".join(rng.choice(signs) for _ in range(n))
    kind = rng.randrange(4)
    if kind == 0:
        value = [rng.choice(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_"]) + draw(rng.randint(20, 44))]
    elif kind == 1:
        value = ["eyJ" + ".".join(draw(rng.randint(16, 60), _MIXED + "-_") for _ in range(3))]
    elif kind == 2:
        value = [draw(rng.randint(16, 48))]
    else:
        name = rng.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----"
        lines = [draw(64, _MIXED + "+/") for _ in range(rng.randint(1, 5))] + [draw(rng.randint(20, 60), _MIXED + "+/") + "=="]
        value = f"-----BEGIN {name}".split() + lines + f"-----END {name}".split()
    lead = [] if kind == 3 else rng.choice(_LEADS)
    quote = rng.choice(["", "", '"']) if kind != 3 else ""
    value = [quote + value[0], *value[1:]] if len(value) > 1 else [quote + value[0] + quote]
    return [*lead, *value], [*[0] * len(lead), 1, *[2] * (len(value) - 1)]


def with_generated(windows: list[tuple], most: int) -> list[tuple]:
    """Windows without a secret, at most ``most`` and evenly over their order, with a generated one put into each."""
    plain, rng, made = [w for w in windows if 1 not in w[1]], random.Random(3), []
    for words, tags, facts in plain[:: max(1, -(-len(plain) // most))]:
        at = rng.randint(0, len(words))
        more, own = generated_secret(rng)
        made.append(((*words[:at], *more, *words[at:]), (*tags[:at], *own, *tags[at:]), facts))
    return made


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_documents: int = MAX_DOCUMENTS,
          max_windows: int = MAX_WINDOWS) -> SecretField:
    """Fits on windows of about ``max_documents`` documents, at most ``max_windows`` with a secret, as many without, and as many with a generated one."""
    n = docs.count()
    share = min(1.0, max_documents / n) if n else 1.0
    few = docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit("secrets")), F.lit(1_000_000)) < int(share * 1_000_000)).where(F.col(text).isNotNull())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [w for t in batch["text"] for w in training_windows(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["words", "tags", "facts"])

    rows = few.select(F.col(text).alias("text")).mapInPandas(cut, "words array<string>, tags array<int>, facts array<double>").collect()
    windows = sorted((tuple(r["words"]), tuple(r["tags"]), tuple(r["facts"])) for r in rows)
    return fit(_bounded(windows, max_windows) + with_generated(windows, max_windows))


def _bounded(windows: list[tuple], most: int) -> list[tuple]:
    """At most ``most`` training windows of each kind, with and without a secret, evenly over their order."""
    with_secret, without = [w for w in windows if 1 in w[1]], [w for w in windows if 1 not in w[1]]
    return [w for own in (with_secret, without) for w in own[:: max(1, -(-len(own) // most))]]


def fit(windows: list[tuple], rounds: int = 150, ridge: float = 5e-5) -> SecretField:
    """Maximum likelihood with a ridge, by Adam over all windows at once."""
    if not any(1 in tags for _, tags, _ in windows):
        return SecretField()
    ahead, common = Counter(), Counter()
    for words, tags, _ in windows:
        for i, word in enumerate(words):
            key = word.strip(EDGE).lower() or word
            common[key] += 1
            ahead[key] += 1 in tags[i + 1 : i + 4] and tags[i] == 0
    known = frozenset(w for w, c in ahead.items() if c >= 5 and 2 * c > common[w])
    forms = sorted({word_form(w, known) for words, _, _ in windows for w in words})
    features = {f: i for i, f in enumerate(sorted({f for form in forms for f in form_features(form)}))}
    at = {form: i for i, form in enumerate(forms)}
    holds = np.zeros((len(forms), len(features)))
    for form, i in at.items():
        holds[i, [features[f] for f in form_features(form)]] = 1
    length = max(len(words) for words, _, _ in windows)
    form = np.full((len(windows), length), -1)
    gold = np.zeros((len(windows), length), dtype=np.int64)
    facts = np.array([f for _, _, f in windows])
    for i, (words, tags, _) in enumerate(windows):
        form[i, : len(words)] = [at[word_form(w, known)] for w in words]
        gold[i, : len(tags)] = tags
    real = form >= 0
    around = (form, np.pad(form, ((0, 0), (1, 0)), constant_values=-1)[:, :-1], np.pad(form, ((0, 0), (0, 1)), constant_values=-1)[:, 1:])
    places = [(shifted.ravel(), (shifted.ravel() >= 0) & real.ravel()) for shifted in around]
    weights = [np.zeros((len(features), TAGS)) for _ in range(3)] + [np.zeros((3, TAGS)), np.zeros((TAGS, TAGS))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    one_hot = np.eye(TAGS)[gold] * real[:, :, None]
    pairs = np.einsum("bti,btj->ij", one_hot[:, :-1], one_hot[:, 1:])
    for step in range(1, rounds + 1):
        scores = _emissions(form, facts, [holds @ w for w in weights[:3]], weights[3])
        p, pp = _marginals(scores, weights[4] + _BARRED, real)
        delta = p - one_hot
        sums = [np.stack([np.bincount(flat[ok], delta[..., tag].ravel()[ok], minlength=len(forms)) for tag in range(TAGS)], axis=1) for flat, ok in places]
        grads = [holds.T @ s for s in sums] + [np.einsum("bf,btj->fj", facts, delta), pp - pairs]
        for w, g, m, v in zip(weights, grads, first, second):
            g = g + ridge * len(windows) * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return SecretField(known, features, *weights)


def _emissions(form: np.ndarray, facts: np.ndarray, by_form: list[np.ndarray], by_fact: np.ndarray) -> np.ndarray:
    own, before, after = (np.vstack([w, np.zeros((1, TAGS))]) for w in by_form)
    left = np.pad(form, ((0, 0), (1, 0)), constant_values=-1)[:, :-1]
    right = np.pad(form, ((0, 0), (0, 1)), constant_values=-1)[:, 1:]
    return own[form] + before[left] + after[right] + (facts @ by_fact)[:, None, :]


def _marginals(scores: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of each word, and expected transitions over all windows."""
    b, t, _ = scores.shape

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    fore, back = np.zeros((b, t, TAGS)), np.zeros((b, t, TAGS))
    fore[:, 0] = scores[:, 0] + np.array([0, 0, -1e9])
    for i in range(1, t):
        fore[:, i] = np.where(real[:, i, None], lse(fore[:, i - 1, :, None] + move, 1) + scores[:, i], fore[:, i - 1])
    for i in range(t - 2, -1, -1):
        back[:, i] = np.where(real[:, i + 1, None], lse(move + (scores[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
    total = lse(fore[:, -1], 1)
    p = np.exp(fore + back - total[:, None, None]) * real[:, :, None]
    pp = np.exp(fore[:, :-1, :, None] + move + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
    return p, pp.sum(axis=(0, 1))


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of one sequence."""
    best, back = scores[0] + np.array([0, 0, -1e9]), []
    for row in scores[1:]:
        step = best[:, None] + move
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    tags = [int(best.argmax())]
    for row in reversed(back):
        tags.append(int(row[tags[-1]]))
    return np.array(tags[::-1])


def _swing(move: np.ndarray) -> float:
    """The most that transitions can speak against putting one word back to "outside", over all legal neighbours and text ends."""
    most = -np.inf
    for before in (None, 0, 1, 2):
        for tag in (1, 2):
            if tag == 2 and before in (None, 0):
                continue
            into = 0.0 if before is None else move[before, tag] - move[before, 0]
            most = max(most, into, *(into + move[tag, after] - move[0, after] for after in (0, 1)))
            carried = into + move[tag, 2] - move[0, 1]
            most = max(most, carried, *(carried + move[2, then] - move[1, then] for then in (0, 1, 2)))
    return float(most)


class Scanner:
    """Scans texts with one field; remembers word forms up to a bound."""

    MOST = 300_000

    def __init__(self, model: SecretField):
        self.model, self.words, self.forms = model, {}, {}
        self.table = np.zeros((0, 3 * TAGS))
        self.fixed: set[str] = set()
        self.swing = _swing(model.move)

    def unsure(self, scores: np.ndarray) -> np.ndarray:
        """Places that the best path may leave "outside".

        Elsewhere, a path off "outside" gets better by going back to it: that alters two transitions, and if an inside follows, that
        one must begin instead, which costs its lead over begin and alters a third transition (see :func:`_swing`).
        """
        lead = scores[:, 0] - scores[:, 1:].max(axis=1)
        after = np.append(np.maximum(0, scores[1:, 2] - scores[1:, 1]), 0)
        return np.flatnonzero(lead <= self.swing + after)

    def _ids(self, words: list[str]) -> list[int]:
        try:
            return [self.words[w] for w in words]
        except KeyError:
            if len(self.words) > self.MOST:
                self.words.clear()
                self.fixed.clear()
            for w in words:
                if w not in self.words:
                    form = word_form(w, self.model.known)
                    if form not in self.forms:
                        self.forms[form] = len(self.forms)
                        self.table = np.vstack([self.table, self.model.form_scores(form)])
                    self.words[w] = self.forms[form]
                    if _SUSPECT.search(w):
                        self.fixed.add(w)
            return [self.words[w] for w in words]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        words = WORD.findall(text) if text else []
        if not words:
            return []
        ids = np.array(self._ids(words))
        base = base_spans(text) if not self.fixed.isdisjoint(words) else []
        found = [(s[0], s[1], s[2], s[3]) for s in base]
        if not self.model.empty:
            scores = self.table[ids, :TAGS] + (text_facts(words) @ self.model.facts)
            scores[1:] += self.table[ids[:-1], TAGS : 2 * TAGS]
            scores[:-1] += self.table[ids[1:], 2 * TAGS :]
            unsure = self.unsure(scores)
            if len(unsure):
                spots = [(m.start(), m.end()) for m in WORD.finditer(text)]
                for start, end in self._runs(text, spots, scores, unsure):
                    found += [(a, 3, "crf", b) for a, b in _left_over(start, end, base) if not _marks_only(text[a:b])]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    def _runs(self, text: str, spots: list, scores: np.ndarray, unsure: np.ndarray) -> Iterator[tuple[int, int]]:
        move = self.model.move + _BARRED
        for part in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
            lo, hi = max(0, part[0] - 1), min(len(scores), part[-1] + 2)
            # the words on either side are surely outside
            held = scores[lo:hi].copy()
            if lo < part[0]:
                held[0, 1:] = -1e9
            if hi - 1 > part[-1]:
                held[-1, 1:] = -1e9
            tags = viterbi(held, move)
            begins = np.flatnonzero(tags == 1)
            for b in begins.tolist():
                e = b + 1
                while e < len(tags) and tags[e] == 2:
                    e += 1
                start, end = spots[lo + b][0], spots[lo + e - 1][1]
                while start < end and text[start] in EDGE:
                    start += 1
                while end > start and text[end - 1] in EDGE:
                    end -= 1
                if end - start >= 6:
                    yield start, end


def _left_over(start: int, end: int, base: list[tuple]) -> list[tuple[int, int]]:
    """The parts of a run that no fixed match covers."""
    parts, at = [], start
    for s in sorted(base):
        if s[3] > at and s[0] < end:
            if s[0] > at:
                parts.append((at, s[0]))
            at = s[3]
    return [*parts, *([(at, end)] if at < end else [])]


def _marks_only(part: str) -> bool:
    return not part.strip(EDGE + SPACES)


def scan(docs: DataFrame, model: SecretField, text: str = "text", spans: str = "spans") -> DataFrame:
    """The input with ``spans array<struct<kind, start, end>>``; ends are exclusive, in code points. The field is small and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scanned(values: list, scanner: Scanner) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(v)] for v in values], _ARROW)]

    return map_column(docs, text, {spans: SPANS}, scanned, lambda: Scanner(shared.value))


def redact(docs: DataFrame, model: SecretField, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with every span of its text replaced by ``mark``; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def cleaned(values: list, scanner: Scanner) -> list[pa.Array]:
        return [pa.array([v if v is None else _without(v, scanner.spans(v), mark) for v in values], pa.string())]

    out = map_column(docs, text, {"__redacted": T.StringType()}, cleaned, lambda: Scanner(shared.value))
    return out.select(*[(F.col("__redacted") if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _without(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])
