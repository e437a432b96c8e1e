"""Secret scan, byte-level BPE, SimHash, sharding and suffix deduplication against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from dupsift.llm import bpe, secret_scan, sharding, simhash, suffix_dedup

from .conftest import prose, rows_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_spans(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def plain_redact(text):
    """Every rule's expression over the whole text, without an index."""
    scanner = secret_scan.Scanner(secret_scan.RULES)
    spans = sorted((m.start(), k, m.end()) for k, (rule, c, _) in enumerate(scanner.rules) for m in c.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least)
    out, last = "", 0
    for start, k, end in spans:
        if start >= last:
            out += text[last:start] + f"[{secret_scan.RULES[k].kind}]"
        last = max(last, end)
    return out + text[last:]


def test_secret_scan(docs, no_docs):
    want = []
    for r in docs.collect():
        spans = plain_spans(r["text"] or "")
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((r["doc_id"], *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(named.encode()).hexdigest()))
    got = rows_of(secret_scan.scan_digests(docs))
    assert [g[:5] for g in got] == sorted(want, key=lambda r: (r[0] is None, r))
    assert any("forge_token" in g[5] for g in got) and any(g[1] for g in got)
    assert rows_of(secret_scan.scan_digests(no_docs)) == []


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", [("tri", b"aki"), ("tri", b"kia")])
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is True and secret_scan.trigram_query("ab") is True and secret_scan.trigram_query("(abc|[x-z]+)") is True
    assert secret_scan.trigram_query("(?:abcd)?x*") is True


def test_index_loses_no_match():
    """Every rule's candidates hold every document that the expression matches."""
    rng = random.Random(3)
    bits = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", '"', " ", "AKIA", "ABCDEFGHIJKLMNOPQRST", "ghp_", "a" * 36, "eyJ", ".", "xoxb-", "-----BEGIN PRIVATE KEY-----", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    import pyarrow as pa

    scanner = secret_scan.Scanner(secret_scan.RULES)
    for column in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        _, found = scanner.spans(column)
        for text, spans in zip(texts, found, strict=True):
            want = sorted((m.start(), k, m.end()) for k, (r, c, _) in enumerate(scanner.rules) for m in c.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least)
            assert spans == want


def test_redact(docs):
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r["text"] for r in out.collect()]
    assert '[assign]" and [assign]' in texts and None in texts
    assert not any(plain_spans(t or "") for t in texts)


@pytest.fixture(scope="module")
def coder():
    return bpe.load(VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_bpe_documents(docs, no_docs, reference):
    want = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows_of(bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)) == sorted(want, key=lambda r: (r[0] is None, r))
    assert rows_of(bpe.encode_documents(no_docs, VOCABULARY, public_tokenizers.PATTERN)) == []


ALPHABET = [" ", "  ", "\n", "\t", "\x85", "　", "a", "B", "the", "é", "ß", "中文", "😀", "1", "²", "'s", "'re", "'", ".", "!!", "́", "​", "\r\n", "==", "_", "tion"]


def test_bpe_random(coder, reference):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        ids = coder.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_edits(coder, reference):
    rng = random.Random(2)
    for _ in range(700):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        e = bpe.Encoded(coder, text)
        for _ in range(3):
            i = rng.randint(0, len(text))
            j = rng.randint(i, min(len(text), i + 4))
            if rng.random() < 0.3:
                i = j = len(text)
            new = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 4)))
            text = text[:i] + new + text[j:]
            e.replace(i, j, new)
            assert e.ids() == reference.encode_ordinary(text)
    e = bpe.Encoded(coder, "word " * 2000)
    e.replace(5000, 5001, "x")
    assert e.encoded < 10 and e.ids() == reference.encode_ordinary(e.text)


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Component of each position by brute force over (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_simhash(docs, no_docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, classes(rows), strict=True)), key=lambda r: (r[0] is None, r))
    assert rows_of(simhash.simhash_digests(docs)) == want
    assert rows_of(simhash.simhash_digests(no_docs)) == []


@pytest.mark.parametrize("crowded", [0, 16])
def test_links_of_close_fingerprints(spark, monkeypatch, crowded):
    """A chain and a dense group: with and without crowded keys the components are those of all pairs."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for start in list(fps)[:5]:
        at = start
        for _ in range(12):
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(at)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(8)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    from dupsift.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"))).collect()}
    got, want = [found.get(s, s) for s in signed], classes(list(zip(signed, fps, strict=True)))
    assert got == want


def test_keep_first(docs, no_docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes(rows)))
    assert simhash.keep_first(no_docs).count() == 0


def near_classes(texts):
    """The first place of each component of links within two bits or of five-word Jaccard >= 0.8, and how many of the latter are further than two bits."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    fps = [plain_fingerprint(t) for t in texts]
    root, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            bits, shared = (fps[i] ^ fps[j]).bit_count(), len(sets[i] & sets[j])
            near = shared > 0 and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)
            far += near and bits > 2
            if near or bits <= 2:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted(set(root)), far


@pytest.mark.parametrize("common", [1, 30])
def test_keep_first_similar(spark, monkeypatch, common):
    """Near copies many bits apart go, by brute-force Jaccard of five-word shingles; with and without crowded prefixes."""
    monkeypatch.setattr(simhash, "COMMON", common)
    rng = random.Random(11)
    base = [prose(rng, rng.randint(30, 150)).split() for _ in range(25)]
    rows = [" ".join(w) for w in base]
    for w in base:
        for edits in (1, 2, 4):
            copy = list(w)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.randrange(1000))
            rows.append(" ".join(copy))
    rows += [rows[0], "", "one two", "one three", None]
    want, far = near_classes(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert far > 10 and sorted(r["doc_id"] for r in simhash.keep_first(docs, similar=0.8).collect()) == want


def test_similar_long_texts_keep_all_keys():
    """Keys of long sets are the whole prefix, so no pair of Jaccard 0.8 is without a common one, whatever its hashes; sketches never count more than what differs."""
    rng = np.random.default_rng(3)
    for n in (1, 7, 400, 3000):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert len(simhash._prefix(own, np.zeros(0, np.uint64), 0.8)) == len(own) - -(-4 * len(own) // 5) + 1
        for gone in (0, 1, n // 5, n // 2):
            other = np.unique(np.concatenate([own[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            assert simhash._apart(simhash._sketch(own), simhash._sketch(other)) <= len(np.setxor1d(own, other))
            assert simhash._apart(simhash._sketch(own), simhash._sketch(own[gone:])) <= gone
    assert simhash._apart(simhash._sketch(own), simhash._sketch(other)) > 0.2 * 2 * len(own)


@pytest.mark.parametrize("few", [0, 20_000])
def test_keep_first_similar_in_parts(spark, monkeypatch, few):
    """A group of near copies around one text, its pairs verified a few at a time."""
    monkeypatch.setattr(simhash, "FEW_PAIRS", few)
    rng = random.Random(4)
    base = prose(rng, 120).split()
    rows = []
    for _ in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = "zz" + str(rng.randrange(1000))
        rows.append(" ".join(copy))
    want, _ = near_classes(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs, similar=0.8).collect()) == want


def test_pipeline_stage_near_copies(spark):
    """The pipeline's stage against brute force over all pairs."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want, far = near_classes([t for _, t in rows])
    assert far and sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, d).collect()) == [rows[i][0] for i in want]


def check_shards(rows, sources, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in sources), key=str)
    by = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    most = max(r.size for r in rows)
    total = sum(r.size for r in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by.get(s, [])) - total / shards) <= most


def test_sharding(spark, docs, no_docs):
    check_shards(sharding.shard(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 24)
    assert sharding.shard(no_docs).count() == 0
    hot = [(i, "the same text") for i in range(3000)] + [(i, f"text {i} " * (i % 50)) for i in range(3000, 4000)]
    out = sharding.shard(spark.createDataFrame(hot, "doc_id bigint, text string")).collect()
    check_shards(out, hot, 24)
    assert len({r.shard for r in out if r.doc_id < 3000}) > 3


def test_sharding_small_cells(spark, monkeypatch):
    """Groups of copies far larger than a cell, also with equal ids."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rows = [(i, f"copies {i % 3}") for i in range(900)] + [(7, "same row")] * 90 + [(i, f"text {i} " * (i % 50)) for i in range(2000, 2600)]
    check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows, 24)


def test_sharding_of_repeated_rows(spark, monkeypatch):
    """Repeated rows without ids travel as chunks: what the driver collects stays small."""
    from pyspark.sql.classic.dataframe import DataFrame

    collected, collect = [], DataFrame.collect

    def counting(self):
        collected.append(collect(self))
        return collected[-1]

    rows = [(None, "the same text") for _ in range(60_000)] + [(i, f"text {i} " * (i % 50)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(DataFrame, "collect", counting)
    out = sharding.shard(docs)
    most = max(map(len, collected))
    monkeypatch.setattr(DataFrame, "collect", collect)
    check_shards(out.collect(), rows, 24)
    assert most < 5_000


def test_suffix_dedup_of_repeated_rows(spark):
    """Many rows of one id and text, with and without a text before them, beside others."""
    rng = random.Random(8)
    base, other = prose(rng, 60), prose(rng, 60)
    rows = [(5, f"{base} {prose(rng, 20)}")] * 300 + [(None, f"x {other} y")] * 200 + [(2, base), (9, f"{other} z"), (9, "short")] + [(7, base)] * 3
    got = sorted((tuple(r) for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()), key=lambda r: (r[0] is None, r))
    assert got == plain_removals(rows)
    kept = suffix_dedup.strip(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n bigint"))
    assert sorted(r["n"] for r in kept.collect()) == list(range(len(rows)))


def plain_removals(rows):
    last, first, out = (1 << 63) - 1, {}, []
    key = lambda d: last if d is None else d
    data = sorted(((key(d), (t or "").encode(), d) for d, t in rows), key=lambda r: r[:2])
    for k, b, _ in data:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    for k, b, d in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("crowded, run", [(20_000, 20_000), (1, 20_000), (20_000, 5)])
def test_suffix_dedup(docs, monkeypatch, crowded, run):
    """Also with every anchor crowded, and with runs of a few classes merged by binary search."""
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "RUN_CLASSES", run)
    assert rows_of(suffix_dedup.removals(docs)) == plain_removals([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_suffix_dedup_empty(no_docs, docs):
    assert rows_of(suffix_dedup.removals(no_docs)) == []
    out = suffix_dedup.strip(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_suffix_array():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[500:900] = data[1500:1900]
    data[2000:2100] = 97
    raw = data.tobytes() + bytes(80)
    order = suffix_dedup.suffix_array(data, 50)
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(data)))
    for a, b, n in zip(order[:-1], order[1:], suffix_dedup.common_prefixes(data, order, 50)[1:], strict=True):
        assert n == next((k for k in range(50) if raw[a + k] != raw[b + k]), 50)


def test_sorted_run_of_repetitive_snippets():
    """Snippets of few words, of which some differ in one byte only: many strings agree in just over LENGTH bytes."""
    rng = random.Random(3)
    for words in ([b"the ", b"of ", b"a ", b"and "], [b"a", b"ab", b"\0"]):
        base, snippets = b"".join(rng.choices(words, k=400)), set()
        for _ in range(300):
            at, size = rng.randrange(len(base) - 80), rng.randint(50, 79)
            part = bytearray(base[at : at + size])
            if rng.random() < 0.5 and part:
                part[rng.randrange(len(part))] = rng.choice(b"ab \0")
            snippets |= {bytes(part)} if len(part) >= 50 else set()
        snippets = sorted(snippets, key=lambda _: rng.random())
        ids = np.array([rng.randrange(1000) for _ in snippets])
        least = {}
        for s, i in zip(snippets, ids.tolist(), strict=True):
            for at in range(len(s) - 49):
                least[s[at : at + 50]] = min(least.get(s[at : at + 50], i), i)
        _, owner, number = suffix_dedup.run_of(snippets, ids)
        assert owner[number].tolist() == [least[s[at : at + 50]] for s in snippets for at in range(len(s) - 49)]
