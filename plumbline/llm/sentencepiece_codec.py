"""Operator 2: exact SentencePiece BPE encoding in vectorised merge rounds, and decoding.

No piece has a space mark after another character, so a text falls into words (space marks, then other characters) that merge
independently. All words of a batch lie in one flat symbol array. A round finds each word's lowest pair rank by a segmented
minimum, merges that pair's occurrences from the left, and compacts the array; finished words leave it. Where a fresh piece
would pair up at an equal or lower rank, a sequential encoder would take that pair next, so the word's round stops there.
Distinct words are encoded once a task as far as a bounded table holds them.

Defined results: null is encoded as the empty text; the empty text has no ids and decodes to the empty text. Characters
outside the vocabulary become their UTF-8 bytes' pieces. Words of any length are handled by the same rounds. Decoding puts one
replacement character for each byte that is no valid UTF-8; null ids decode to null. Result columns replace columns of the same name.

The model file is read with the sentencepiece library's table accessors; its encoder is not used here. Byte fallback, the identity
normaliser and a leading space mark are required and checked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import map_column

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
RUN_OR_WORD = re.compile(f"{MARK}+(?={MARK})|{MARK}[^{MARK}]*|[^{MARK}]+")
NEVER = np.iinfo(np.int64).max
FREE = np.int64(-1)
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
TABLE_CHARS = 2_500_000
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Vocabulary:
    """``pair_keys`` (left id times size, plus right id) form an open-addressing table with the rank and id of the merged piece.

    Characters without a piece have ids from ``size`` on while merging. ``byte_ids`` are the pieces of the bytes,
    ``special_ids`` the control and unknown pieces. ``runs`` are the ids of 0, 1, 2 ... space marks, when the pieces of marks share the last
    rank and start no other piece: then a run of spaces merges after all else, from the left.
    """

    size: int
    chars: dict[str, int]
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    byte_ids: list[int]
    special_ids: list[int]
    runs: list[list[int]]
    piece_bytes: list[bytes]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (:data:`NEVER` if they don't merge) and merged id of symbol pairs."""
        key = np.where((left < self.size) & (right < self.size), left * np.int64(self.size) + right, -2)
        at = _slot(key)
        held = self.pair_keys[at]
        far = np.flatnonzero((held != key) & (held != FREE))
        while len(far):
            at[far] = (at[far] + 1) & (SLOTS - 1)
            held = self.pair_keys[at[far]]
            far = far[(held != key[far]) & (held != FREE)]
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER), self.pair_ids[at]


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _pair_table(merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ranks and ids by slot; a key that finds its slot taken moves on to the next free one."""
    if 2 * len(merges) > SLOTS:
        raise ValueError("the model has more merges than the pair table is laid out for")
    keys, ranks, ids = np.full(SLOTS, FREE), np.full(SLOTS, NEVER), np.zeros(SLOTS, dtype=np.int64)
    for (key, rank, i), at in zip(merges, _slot(np.array([m[0] for m in merges], dtype=np.int64)).tolist()):
        while keys[at] != FREE:
            at = (at + 1) & (SLOTS - 1)
        keys[at], ranks[at], ids[at] = key, rank, i
    return keys, ranks, ids


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces, scores and byte pieces of a BPE model with byte fallback; raises for models of another kind."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = len(model)
    pieces = [model.id_to_piece(i) for i in range(size)]
    if model.encode("  a", out_type=str)[0][0] != MARK or "".join(model.encode("ﬁ Ω", out_type=str)) == "":
        raise ValueError("the model must keep and prefix spaces")
    plain = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
        raise ValueError("pieces that go beyond a word are not supported")
    bytes_of = {int(m[1], 16): i for i, p in enumerate(pieces) if model.is_byte(i) and (m := BYTE_PIECE.fullmatch(p))}
    if len(bytes_of) != 256:
        raise ValueError("the model has no byte fallback")
    scores = sorted({model.get_score(i) for i in plain.values()}, reverse=True)
    rank = {s: r for r, s in enumerate(scores)}
    merges = [(plain[p[:k]] * size + plain[p[k:]], rank[model.get_score(i)], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
    keys, ranks, ids = _pair_table(merges)
    raw = [p.replace(MARK, " ").encode() for p in pieces]
    for byte, i in bytes_of.items():
        raw[i] = bytes([byte])
    for i in range(size):
        if model.is_control(i):
            raw[i] = b""
        elif model.is_unknown(i):
            raw[i] = " ⁇ ".encode()
    special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i)]
    runs = {len(p): i for p, i in plain.items() if p.strip(MARK) == ""}
    last = all(rank[model.get_score(i)] == len(scores) - 1 for n, i in runs.items() if n > 1)
    apart = last and not any(re.match(f"{MARK}{MARK}+[^{MARK}]", p) for p in plain)
    return Vocabulary(size, {p: i for p, i in plain.items() if len(p) == 1}, keys, ranks, ids, [bytes_of[b] for b in range(256)], special,
                      _run_table(runs) if apart and 1 in runs else [], raw)


def _run_table(runs: dict[int, int]) -> list[list[int]]:
    """Ids of runs of 0, 1, 2 ... marks, up to twice the longest piece; empty if longer runs don't just repeat that piece."""
    most, table = max(runs), []
    for n in range(4 * most):
        held = [1] * n
        while (i := next((i for i in range(len(held) - 1) if held[i] + held[i + 1] in runs), None)) is not None:
            held[i : i + 2] = [held[i] + held[i + 1]]
        table.append([runs[x] for x in held])
    repeats = all(table[n] == [runs[most], *table[n - most]] for n in range(2 * most, 4 * most))
    return table[: 2 * most] if repeats else []


def run_ids(n: int, vocab: Vocabulary) -> list[int]:
    most = len(vocab.runs) // 2
    again = max(0, n // most - 1)
    return vocab.runs[most] * again + vocab.runs[n - again * most]


def split_words(text: str, vocab: Vocabulary) -> list[str]:
    """Words of a text, with all but the last mark of a run of space marks apart where the vocabulary allows it."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return (RUN_OR_WORD if vocab.runs and MARK * 2 in marked else WORD).findall(marked)


def join_ids(words: list[str], table: dict[str, bytes], vocab: Vocabulary) -> np.ndarray:
    """Ids of a text from those of its words; a run takes in the mark of the word after it if that stayed alone."""
    if not (vocab.runs and any(w[-1] == MARK for w in words)):
        return np.frombuffer(b"".join([table[w] for w in words]), dtype=np.int32)
    ids: list[bytes] = []
    held, mark = 0, packed(vocab.runs[1])
    for word in words:
        if word[-1] == MARK:
            held += len(word)
            continue
        own = table[word]
        if held:
            alone = own[:4] == mark
            ids.append(packed(run_ids(held + alone, vocab)))
            own, held = own[4 * alone :], 0
        ids.append(own)
    ids.append(packed(run_ids(held, vocab)))
    return np.frombuffer(b"".join(ids), dtype=np.int32)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


def encode_words(words: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each word as 32-bit numbers in a row; words share nothing but the rounds."""
    if vocab.runs:  # runs of marks are put together by join_ids
        words = ["" if w.startswith(MARK * 2) else w for w in words]
    joined = "".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if not len(joined):
        return [b""] * len(words)
    distinct, code = np.unique(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
    ids = np.array([vocab.chars.get(chr(c), vocab.size + i) for i, c in enumerate(distinct.tolist())], dtype=np.int64)
    as_bytes = {vocab.size + i: [vocab.byte_ids[b] for b in chr(c).encode()] for i, c in enumerate(distinct.tolist()) if chr(c) not in vocab.chars}
    sym, word = ids[code], np.repeat(np.arange(len(words)), lengths)
    out = [b""] * len(words)
    rank, merged = _ranks(sym, word, vocab)
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(sym)])
        over = low == NEVER
        if over.any():
            found, done = np.repeat(over, size), size[over]
            raw, plain = sym[found].astype(np.int32).tobytes(), np.maximum.reduceat(sym, first)[over] < vocab.size
            for w, end, n, ok in zip(word[first[over]].tolist(), np.cumsum(done).tolist(), done.tolist(), plain.tolist()):
                own = raw[4 * (end - n) : 4 * end]
                out[w] = own if ok else packed([x for s in np.frombuffer(own, dtype=np.int32).tolist() for x in as_bytes.get(s, (s,))])
            stay = np.repeat(~over, size)
            sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
            low, size = low[~over], size[~over]
            if not len(sym):
                break
        low = np.repeat(low, size)
        at = np.flatnonzero(rank == low)
        # of occurrences that overlap in a run, every second one is taken
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[nth % 2 == 0]
        at = at[_in_order(sym, word, merged, low, at, vocab)]
        sym[at] = merged[at]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        moved = np.cumsum(stay) - 1
        fresh = moved[at]
        sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
        stale = np.zeros(len(sym), dtype=bool)
        stale[fresh] = True
        stale[fresh[fresh > 0] - 1] = True
        fresh = np.flatnonzero(stale)
        rank[fresh], merged[fresh] = _ranks(sym, word, vocab, fresh)
    return out


def _ranks(sym: np.ndarray, word: np.ndarray, vocab: Vocabulary, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that start at ``at`` (everywhere by default)."""
    at = np.arange(len(sym)) if at is None else at
    right = np.minimum(at + 1, len(sym) - 1)
    rank, merged = vocab.pairs(sym[at], sym[right])
    return np.where((right > at) & (word[at] == word[right]), rank, NEVER), merged


def _in_order(sym: np.ndarray, word: np.ndarray, merged: np.ndarray, low: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """True for the occurrences that a sequential encoder merges before any pair with a fresh piece."""
    own, piece = word[at], merged[at]
    joined = np.r_[False, (at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])]
    before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
    left = np.where(joined, np.r_[0, piece[:-1]], sym[before])
    has_left, has_right = (at > 0) & (word[before] == own), (at + 2 < len(sym)) & (word[after] == own)
    to_left = np.where(has_left, vocab.pairs(left, piece)[0], NEVER)
    to_right = np.where(has_right, vocab.pairs(piece, sym[after])[0], NEVER)
    stops = np.minimum(to_left, to_right) <= low[at]
    if not stops.any():
        return np.ones(len(at), dtype=bool)
    total = np.cumsum(stops) - stops
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return total == np.repeat(total[first], np.diff(np.r_[first, len(at)]))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The input with ``ids array<int>``. ``model`` is a file that each executor has, such as one of an installed package."""

    return map_column(docs, text, {ids: T.ArrayType(T.IntegerType())}, lambda values, state: [_listed(_encoded(values, *state))], lambda: (read_vocabulary(model), {}))


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The input with the text of ``ids``: byte pieces become characters, the leading space mark goes."""
    return map_column(docs, ids, {text: T.StringType()}, lambda values, vocab: [_decoded(values, vocab)], lambda: read_vocabulary(model))


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode`, in one pass over the texts."""

    def both(values: list, state: tuple) -> list[pa.Array]:
        found = _encoded(values, *state)
        return [_listed(found), _decoded(found, state[0])]

    return map_column(docs, text, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, both, lambda: (read_vocabulary(model), {}))


def _encoded(values: list, vocab: Vocabulary, table: dict) -> list[np.ndarray]:
    """Ids of texts; ``table`` remembers words, and under None how many characters they have."""
    split = [split_words(v, vocab) for v in values]
    new = [w for w in set(chain.from_iterable(split)) if w not in table]
    if sum(map(len, new)) + table.get(None, 0) > TABLE_CHARS:
        table.clear()
        new = list(set(chain.from_iterable(split)))
    table.update(zip(new, encode_words(new, vocab)))
    table[None] = table.get(None, 0) + sum(map(len, new))
    return [join_ids(words, table, vocab) for words in split]


def _listed(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))


def _decoded(values: list, vocab: Vocabulary) -> pa.Array:
    return pa.array([None if v is None else decode_ids(v, vocab) for v in values], pa.string())


def decode_ids(ids, vocab: Vocabulary) -> str:
    ids = np.asarray(ids, dtype=np.int64)
    cuts = np.flatnonzero(np.isin(ids, vocab.special_ids))
    if len(cuts):  # bytes on either side of a control or unknown piece form no common character
        parts = np.split(ids, np.unique(np.r_[cuts, cuts + 1]))
        first = next((i for i, part in enumerate(parts) if any(vocab.piece_bytes[x] for x in part.tolist())), 0)
        return "".join(_text(part.tolist(), vocab, i == first) for i, part in enumerate(parts))
    return _text(ids.tolist(), vocab, True)


def _text(ids: list[int], vocab: Vocabulary, is_first: bool) -> str:
    raw = b"".join(map(vocab.piece_bytes.__getitem__, ids))
    if is_first and raw[:1] == b" " and ids[0] not in vocab.byte_ids and ids[0] not in vocab.special_ids:
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _by_bytes(raw)


def _by_bytes(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out, n = [*out, "�"], 1
        i += n
    return "".join(out)
