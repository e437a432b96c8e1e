"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from dupsift.llm import conversations as conv
from dupsift.llm import doubling, queries, spelling

from .conftest import SCHEMA, prose, rows_of

SF = "/root/testdata/sf0.001"


# ---- op13


def plain_removals(texts, length=35):
    """For texts: number of words, removed ones, digest of the kept."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def passages(rng):
    """Texts with passages of 34 to 36 words and longer ones, at the same and at other places, within a text and across texts."""
    shared = [prose(rng, n) for n in (34, 35, 36, 71, 300)]
    out = [None, "", " \n ", shared[1], f"{shared[1]} {shared[1]}", "w " * 34, "w " * 35, "w " * 36, "v " * 200, prose(rng, 9_000)]
    for p in shared * 3:
        out.append(f"{prose(rng, rng.randint(0, 50))}\n{p}\t{prose(rng, rng.randint(0, 50))}")
    return out + [out[-1], out[-1], f"é{out[-2]}", out[9] + " end"]


@pytest.mark.parametrize("block", [1 << 9, 8 << 20])
def test_substring_dedup_is_exact(spark, monkeypatch, block):
    """Blocks of a text or so, and one block."""
    monkeypatch.setattr(doubling, "BLOCK_BYTES", block)
    texts = passages(random.Random(4))
    rows = [(i if i % 7 else None, t, "en", None, 0, "x", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None, None, None)] * 2
    want = sorted(((r[0] or -1, *x) for r, x in zip(rows, plain_removals([r[1] for r in rows]), strict=True)))
    got = doubling.removals(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert all((r["longest"] >= 35) == (r["n_removed"] > 0) for r in got)


def test_substring_dedup_goes_on_until_no_candidates(spark):
    rng = random.Random(1)
    long = prose(rng, 35 * 8 + 3)
    docs = spark.createDataFrame([(1, long), (2, f"a {long}"), (3, prose(rng, 400))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["longest"] for r in doubling.removals(docs).collect()} == {1: 280, 2: 280, 3: 0}
    assert [n for _, n in zip(range(5), doubling.levels(35), strict=False)] == [9, 18, 35, 70, 140]


def test_substring_dedup_strips_other_columns_stay(spark, docs, no_docs):
    got = {(r["doc_id"], r["n_chars"], r["hash"]): r["text"] for r in doubling.strip(docs).collect()}
    rows = docs.collect()
    assert doubling.strip(docs).count() == len(rows) and got[1000, 0, "x"] is None and doubling.strip(docs).columns == docs.columns
    for r, (_, removed, digest) in zip(rows, plain_removals([r["text"] for r in rows]), strict=True):
        t = got[r["doc_id"], r["n_chars"], r["hash"]]
        assert t == r["text"] if removed == 0 else hashlib.sha256(t.encode()).hexdigest() == digest
    assert doubling.removals(no_docs).collect() == [] and doubling.strip(no_docs).collect() == []


def test_words_are_hashed_whole():
    """A word cut by a slice, and equal words of several texts."""
    import numpy as np

    texts = [b"ab  cd", b"", b"cd" * 10, b"ef ab\x0bcd ", b" "]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole, begins = doubling.word_hashes(data, offsets)
    assert np.diff(begins).tolist() == [2, 0, 1, 3, 0] and whole[0] == whole[4] and whole[1] == whole[5] and len(set(whole.tolist())) == 4
    before, doubling.SLICE_BYTES = doubling.SLICE_BYTES, 3
    try:
        assert doubling.word_hashes(data, offsets)[0].tolist() == whole.tolist()
    finally:
        doubling.SLICE_BYTES = before


# ---- op12


def plain_repair(rows):
    """(cost, audit) of rows (role, flag) by all states of an automaton, with whole audits. States: nothing read, s, u, a."""
    states = {0: (0, "")}

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to = 3 if s == 2 else 2
                states[to] = min(states.get(to, (9e9, "")), (c + 2, a + "I"))
        return states

    for role, flag in rows:
        new = {}
        for s, (c, a) in inserted(states).items():
            options = [(s, c + 3, "D")]
            if flag in (0, 3):
                c += flag == 3
                to = 3 if s == 2 else 2
                options.append((to, c + 2, "R"))
                if role[:1] == "ua"[to - 2]:
                    options.append((to, c, "K"))
                if s == 0 and role[:1] == "s":
                    options.append((1, c, "K"))
            for to, cost, e in options:
                new[to] = min(new.get(to, (9e9, "")), (cost, a + e))
        states = new
    states = inserted(states)
    return min(v for s, v in states.items() if s in (0, 3))


def plain_digests(rows):
    """The contract, row by row. rows: (conv_id, turn, role, text)."""
    damaged, out = defaultdict(list), []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        damaged[c]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, flags, turns = set(), [], {t for t, _, _ in own if t is not None}
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\f\r")
            flags.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = plain_repair([(r[1], f) for r, f in zip(own, flags, strict=True)])
        kept, left = [], list(own)
        for e in audit:
            to = "assistant" if kept and kept[-1][:1] == "u" else "user"
            if e == "I":
                kept.append(f"{to}:")
            else:
                _, role, text = left.pop(0)
                if e != "D":
                    kept.append(f"{role if e == 'K' else to}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(k[:1] for k in kept))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *(flags.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_parser_finds_the_cheapest_and_least_audit():
    rng = random.Random(3)
    for n in range(600):
        roles = ["s", "u", "a", "?"] if n % 2 else ["?", "a", "u"]
        rows = [(rng.choice(roles), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 14))]
        assert conv.parse(rows) == plain_repair(rows), rows


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, n bigint, flag string, audit string, m string"


def test_conversation_repair_follows_the_contract(spark):
    rng = random.Random(9)
    says = ["Yes.", "No", "", " \n", "Why?", None, "é!", "x" * 5_000, "Yes. "]
    rows = []
    for c in range(200):
        for t in range(rng.randint(1, 12)):
            rows.append((c if c else None, rng.choice([t, t, t, None, t + 3, 1]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "ultra"]), rng.choice(says)))
    rows += [(500, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(700)] + [(501, 1, "user", "again")] * 300
    got = conv.repair_digests(spark.createDataFrame([(*r, 1, "z", "z", "z") for r in rows], CONVERSATIONS).repartition(5))
    assert rows_of(got, "conv_id") == plain_digests(rows)
    assert conv.repair_digests(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_conversation_repair_on_the_table(spark):
    table = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    want = plain_digests([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table])
    assert rows_of(queries.queries()["op12_conversation_repair"](spark, SF)) == want


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (2, 0, "system", "Be good.")]
    got = conv.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r["conv_id"], r["position"], r["edit"], r["turn"], r["role"], r["text"]) for r in got) == [
        (1, 0, "I", None, "user", ""),
        (1, 1, "K", 0, "assistant", "Hello."),
        (1, 2, "K", 1, "user", "Hi."),
        (1, 3, "I", None, "assistant", ""),
    ]


def test_long_conversations_of_unknown_roles():
    """Audits that never agree: time and memory grow with the rows, not with their square."""
    cost, audit = conv.parse([("?", 0)] * 20_000)
    assert (cost, audit) == (40_000, "R" * 20_000)


# ---- op11


def plain_vocabulary(rows, damage=True):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if damage and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(n):
    """word -> the contract's row, by wildcards of every place."""
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1 :]].add(w)
            by[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for key, own in by.items():
        if "*" in key:
            for w in own:
                near[w] |= own - {w}
        elif key in n:
            near[key] |= own - {key}
            for w in own:
                near[w].add(key)
    for w in n:
        near[w].discard(w)
    form = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda x: (-n[x], x.encode()))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def variant_rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("part", [1, 40, 100_000])
def test_spelling_variants_are_exact(spark, monkeypatch, part):
    """Random words over few letters, in partitions that are dealt again until nothing is left to deal, some, or not at all."""
    monkeypatch.setattr(spelling, "PART_CHARS", part)
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(700)} | {"z" * k for k in range(6, 40)} | {"y" * 3_000, "y" * 2_999, "y" * 1_000 + "x" + "y" * 1_999}
    n = {w: rng.choice([5, 6, 30, 31, 200, 1_500]) for w in words}
    vocab = spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(4)
    assert variant_rows(spelling.variants(vocab)) == plain_variants(n)


def test_spelling_variants_on_the_table(spark, monkeypatch):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = plain_variants(plain_vocabulary([(r["doc_id"], r["text"]) for r in table]))
    assert len(want) > 100 and variant_rows(queries.queries()["op11_spelling_variants"](spark, SF)) == want


def test_vocabulary_of_odd_texts(spark, monkeypatch, no_docs):
    """Nulls, pieces cut between words, hand-overs of counts, upper-case letters beyond A to Z."""
    monkeypatch.setattr(spelling, "PIECE_CHARS", 50)
    rows = [(None, "Straße " * 9), (7, None), (8, ""), (9, "ÀÉÎÕÜßé naïveté÷ ABCdefg abcDEFG " * 6), (9, "letters" * 40), (10, ("x" * 300 + " ") * 5), (11, "longword, " * 400)] * 2
    docs = spark.createDataFrame([(i, t, None, None, 0, "w", 1, 2) for i, t in rows], SCHEMA)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == plain_vocabulary(rows) and "ÀÉÎÕÜßé" in got
    assert "".join(spelling.pieces("ab cd" * 30, 7)) == "ab cd" * 30
    assert spelling.variants_of_documents(no_docs).collect() == []


def test_trie_pairs():
    words = ["abcdef", "abcdeg", "abcdefg", "bcdef", "abcxef", "", "a"]
    got = {(words[i], words[j]) for i, j in spelling.trie_pairs(words)}
    pairs = [("abcdef", "abcdeg"), ("abcdef", "abcdefg"), ("abcdef", "bcdef"), ("abcdef", "abcxef"), ("abcdeg", "abcdefg"), ("", "a")]
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}
