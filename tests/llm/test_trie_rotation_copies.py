"""Conversation trie, fill-in-middle rotation and exact copies against brute force, with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import block_names, conversation_trie, fill_in_middle, queries
from tests.oracle import compare, connect

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
TURNS = "conv_id long, turn long, role string, text string, key string, depth map<string,int>"


def brute_trie(rows):
    """The contract, read literally."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    turns = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(turns.get(first, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    out = set()
    for p, m in members.items():
        childless = [q for q in below[p] if not any(len(x) == len(q) + 1 for x in below[q])]
        saved = sum((len(members[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below[p] if q)
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below[p]), len(childless), saved, sha(ends)))
    return out


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", {"a": 1}) for r in rows], TURNS)
    nodes, ends = conversation_trie.build(df)
    hashed = nodes.join(conversation_trie.hash_ends(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(conversation_trie.NO_ENDS)))
    got = hashed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_trie_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 70), 139, 141, 9_000_000_019, -5, -40]:
        for turn in range(rng.randint(1, 5)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "no thanks", "well, then", ""])))
    rows += [(7, None, None, None), (8, 2, "user", "twice"), (8, 2, "user", "twice"), (8, 2, "other", "tie"), (None, 0, "user", "lost"), (21, 1, "user", "long " * 30_000)]
    rows += [(c, 0, "u", "alone") for c in range(200, 212)]  # block of ids whose first conversation has fewer turns than are borrowed
    rng.shuffle(rows)
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_collapses_copies(spark):
    """A third of all conversations say the same; their ends span several packs of ids."""
    rows = [(20 * i, t, "user", f"turn {t}") for i in range(900) for t in range(3)] + [(20 * i, 0, "user", f"other {i}") for i in range(900, 1000)]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert max(20 * i for i in range(900)) // conversation_trie.PACK > 3


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == set()
    assert trie_rows(spark, [(None, 0, "user", "no conversation")]) == set()


def test_role_and_text_are_kept_apart(spark):
    rows = [(0, 0, "ab", "c"), (100, 0, "a", "bc"), (200, 0, "", "abc")]
    assert len([r for r in trie_rows(spark, rows) if r[1] == 1]) == len([r for r in brute_trie(rows) if r[1] == 1]) == 3


# 12
def fim_texts():
    rng = random.Random(9)
    odd = [None, "", "a", "é", "\U0001f600", "<P", "has <S> inside", "<M>", "P> <", "\x00\n\t", "word " * 40_000, "中文" * 9_000]
    return odd + ["".join(rng.choice("ab<>PSM é中\U0001f600\n") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_fill_in_middle_against_brute_force(spark):
    texts = fim_texts()
    df = spark.createDataFrame([(i, t, "x", {"k": i}) for i, t in enumerate(texts)] + [(None, "no id", "x", None), (3, "same id, other text", "x", None)],
                               "doc_id long, text string, form string, extra map<string,int>")
    made = fill_in_middle.transform(df, check=True)
    assert made.columns.count("form") == 1 and "extra" in made.columns
    forms = set()
    for r in made.collect():
        text = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        lengths = (None, None) if form == "plain" else (a, b - a)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.restored) == (n, form, *lengths, want, text)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    again = fill_in_middle.restore(fill_in_middle.transform(df))
    assert again.where("restored <> coalesce(text, '')").count() == 0
    assert fill_in_middle.transform(df.limit(0), check=True).count() == 0


def test_fill_in_middle_rates_and_marks(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"))
    assert {r.form for r in fill_in_middle.transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.transform(df, rate=100, spm=100).collect()} == {"spm"}
    marks = fill_in_middle.Sentinels(b"<|pre|>", b"<|suf|>", b"<|mid|>")
    back = fill_in_middle.restore(fill_in_middle.transform(df, rate=100, marks=marks), marks=marks)
    assert back.where("restored <> text OR NOT contains(fim_text, '<|suf|>')").count() == 0
    for wrong in [(b"", b"<S>", b"<M>"), (b"<P>", b"x<P>x", b"<M>"), (b"ab", b"bc", b"<M>"), (b"aXa", b"<S>", b"<M>")]:
        with pytest.raises(ValueError):
            fill_in_middle.Sentinels(*wrong)


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF80FE62C3') AS string) AS text UNION ALL SELECT 2L, cast(unhex('FFFFFF') AS string)")
    made = fill_in_middle.transform(df, rate=100, check=True)
    assert made.where("hex(cast(restored AS binary)) <> hex(cast(text AS binary))").count() == 0


def test_rotation_in_place():
    for n in range(9):
        for start in range(n + 1):
            for cut in range(start, n + 1):
                for end in range(cut, n + 1):
                    view = np.arange(n, dtype=np.uint8)
                    fill_in_middle.rotate(view, start, cut, end)
                    plain = list(range(n))
                    assert view.tolist() == plain[:start] + plain[cut:end] + plain[start:cut] + plain[end:]


# 13
def copies_of(rows):
    groups = defaultdict(list)
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups[fold(t)].append(i)
    return {(i, max((x for x in groups[fold(t)] if x is not None), default=None), len(groups[fold(t)]), sha(fold(t))) for i, t in rows}


def block_texts():
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("abcÉé ") for _ in range(8))
    parts = [part() for _ in range(6)]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    long = "".join(rng.choice(parts) for _ in range(3_000))
    return [None, "", " ", "A", "a", "É", "é", "same text " * 3, "SAME text " * 3, long, long + ".", long.upper(), "x" * 16, "x" * 15, "x" * 17, "x" * 32, *mixed, *mixed[:40]]


def as_rows(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()}


@pytest.mark.parametrize("block, bits", [(16, 128), (1, 128), (1024, 128), (16, 20)])
def test_copies_against_brute_force(spark, block, bits):
    """Blocks of one byte to more than most texts; keys so short that seeds are drawn again."""
    texts = block_texts() if block > 1 else [t for t in block_texts() if t is None or len(t) < 200]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", {"m": 1}, 5, 7) for i, t in rows], "doc_id long, text string, kept string, extra map<string,int>, n int, level int")
    got = block_names.find_copies(df, block=block, key_bits=bits)
    assert as_rows(got) == copies_of(rows) and got.count() == len(rows)
    assert got.where("kept <> (doc_id = keep_id)").count() == 0 and got.where("n <> 5 OR level <> 7").count() == 0


def test_copies_keys_are_drawn_again(spark):
    """With two bits there are more blocks than keys: no seed helps, and the operator says so instead of merging blocks."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        block_names.find_copies(df, key_bits=2)


def test_copies_ties_nulls_and_nothing(spark):
    rows = [(5, "Twice"), (5, "twice"), (3, "TWICE"), (None, "nobody"), (None, "Nobody"), (None, "twice"), (2, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = block_names.find_copies(df).collect()
    assert sorted((str(r.keep_id), r.group_size) for r in got) == sorted([("5", 4)] * 4 + [("None", 2)] * 2 + [("2", 2)] * 2)
    kept = [r for r in got if r.kept]
    assert len(kept) == 3 and {r.doc_id for r in kept} == {5, None, 2}
    empty = block_names.find_copies(df.limit(0))
    assert empty.count() == 0 and isinstance(empty.schema["kept"].dataType, T.BooleanType)


def test_hot_and_rare_keys_meet_their_entry(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = block_names.look_up(rows, table, ["k"])
    assert got.count() == 40_000 and got.where("k = -1").select("top").distinct().count() == 1 and got.where("k <> -1 AND top <> id").count() == 0


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_fill_in_middle", "op13_exact_dedup"])
def test_against_oracle(spark, sf, name):
    from plumbline.llm.oracles import ORACLES

    assert compare(queries.QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
