"""Spelling variants, packing and alignment against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import align, packing, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTE_PATH, PIECE_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, row string, ids string, word string, n string, pair string, node string, `__x` string"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeé"), 7)) for _ in range(60)]
WORDS += [w[:3] + "x" + w[4:] for w in WORDS[:20]] + [w[:2] + w[3:] for w in WORDS[20:30]] + [w[:4] + "z" + w[4:] for w in WORDS[30:40]]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


RUN = "q" * 40
TEXTS = [None, "", " \n\t ", "Äpfel <|endoftext|> I'll <s> x\n\n y ", " two  spaces and   three ", "▁ reads as a space", "日本語 テキスト🙂 é",
         prose(30_000, 1), prose(300, 2), prose(300, 2), "a" * 6000, "\x00 nul \x7f", "word\nnext\r\nline",
         *(prose(50 + 37 * i, i) for i in range(3, 30)), f"{RUN} {RUN}q {RUN[:-1]}z {RUN} " * 12, "a tail of one"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *"abcdefg") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], (None, prose(80, 77), *"abcdefg")], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize(("small", "hot"), [(32 << 20, 50_000), (0, 50_000), (0, 2)])
def test_spelling_equals_brute_force(docs, plain, monkeypatch, small, hot):
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", small)  # with 0 all depths are joined by node, with few states as hot by salt
    got = spelling.variants(spelling.count_words(docs), hot=hot).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = spelled(plain)
    assert sorted(map(tuple, got)) == want
    assert sum(1 for r in want if r[4]) > 20 and any(len(r[0]) > spelling.DEPTH and r[4] for r in want)


def test_spelling_chains_and_depths(spark):
    rows = [("abcdef", 1000), ("abcdeg", 100), ("abcdgg", 10), ("abcggg", 2), ("abcde", 7), ("zzzzzz", 3), ("bbcdef", 1000)]
    words = spark.createDataFrame(rows, "word string, n bigint")
    want = {"abcdeg": "abcdef", "abcdgg": "abcdef", "abcggg": "abcdef", "abcde": "abcdef", "zzzzzz": "zzzzzz", "abcdef": "abcdef", "bbcdef": "bbcdef"}
    for depth in (spelling.DEPTH, 6, 5, 2):  # the frontier alone, both ways, forms alone
        assert {r.word: r.root for r in spelling.variants(words, depth=depth).collect()} == want
    assert spelling.variants(words.filter("false")).count() == 0


def test_packing_keeps_every_id_once(docs, plain):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(WORD_PATH)
    want = Counter()
    for doc, text in plain:
        want[doc, tuple(hf.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    rows = packing.pack_documents(docs, WORD_PATH, bay_tokens=10_000).collect()
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        assert any(d == r.doc_id and len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4")) == r.ids_crc32 for d, ids in want)
    padding = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.length for r in rows) == total and padding <= 0.01 * total
    for (doc, ids), n in want.items():  # the pieces of each id lie side by side
        mine = sorted((r.start, r.length) for r in rows if r.doc_id == doc)
        ends = Counter(s + k for s, k in mine)
        starts = Counter(s for s, _ in mine)
        assert starts[0] == n and ends[len(ids)] == n and starts - Counter({0: n}) == ends - Counter({len(ids): n})
    assert sorted(map(tuple, packing.pack_documents(docs, WORD_PATH, bay_tokens=10_000).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert packing.pack_documents(docs.filter("false"), WORD_PATH).count() == 0


def test_chunks_encode_as_whole_texts(plain):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(WORD_PATH)
    seeded = ["".join(np.random.default_rng(i).choice(list("aB é'tsſΣς \n\t  ́漢9-<|endoftext|>"), 60)) for i in range(400)]
    texts = [t for _, t in plain] + seeded
    for text, ids in zip(texts, packing.encoder(WORD_PATH).block(texts)):
        assert ids.tolist() == hf.encode(text or "", add_special_tokens=False).ids


def test_nnls_and_pack():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = np.where(rng.random(30) < 0.2, rng.random(30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-5)
    b = rng.normal(size=12)
    got = packing.nnls(a, b)
    gain = a.T @ (b - a @ got)  # the conditions of the least-squares solution
    assert (gain <= 1e-6).all() and np.allclose(gain[got > 0], 0, atol=1e-6)
    assert all(sum(u * k for u, k in c) == 24 for c in packing.combinations(24))
    lengths = rng.integers(1, 4096, 3000)
    plan = packing.solve(Counter(lengths.tolist()))
    seqs = packing.pack(lengths, plan)
    held = Counter()
    for s in seqs:
        assert sum(n for _, _, n in s) <= 4096
        for i, _, n in s:
            held[i] += n
    assert [held[i] for i in range(3000)] == lengths.tolist()
    pieces = Counter(i for s in seqs for i, _, _ in s)
    assert sum(1 for n in pieces.values() if n > 1) < 3000 * 0.05  # few documents are cut
    assert packing.pack(np.array([5]), []) == [[(0, 0, 4)], [(0, 4, 1)]]


def aligned(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, hash) of each text, with quadratic care."""
    from tokenizers import Tokenizer
    import sentencepiece

    from quarry.llm.bpe import byte_letters

    hf = Tokenizer.from_file(BYTE_PATH)
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_PATH)
    back, vocab = {c: b for b, c in enumerate(byte_letters())}, {i: s for s, i in hf.get_vocab().items()}
    count, found = Counter(), []
    for t in texts:
        a, b = (hf.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        bytes_a = [bytes(back[c] for c in vocab[i]) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        owner = np.repeat(np.arange(len(b)), [len(x) for x in bytes_b])
        pairs = [(a[i], b[j]) for i, e in enumerate(ends_a) for j in range(owner[e - len(bytes_a[i])], owner[e - 1] + 1)]
        said, ia, ib = [], 0, 0
        for cut in np.intersect1d(ends_a, ends_b):
            na, nb = np.searchsorted(ends_a, cut) + 1, np.searchsorted(ends_b, cut) + 1
            said.append(",".join(map(str, a[ia:na])) + "|" + ",".join(map(str, b[ib:nb])))
            ia, ib = na, nb
        count.update(pairs)
        found.append((len(a), len(b), len(said), pairs, hashlib.sha256(";".join(said).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(count[p] == most[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("share", [align.SHARE, 50, 1])
def test_alignment_equals_brute_force(docs, plain, share):
    want = sorted(((d, *x) for (d, _), x in zip(plain, aligned([t for _, t in plain]))), key=repr)
    got = align.align(docs, BYTE_PATH, PIECE_PATH, share=share).collect()  # 1: every pair is joined
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(1 for r in want if r[1]) >= 25 and any(r[1] == 0 for r in want)


def test_alignment_of_seeded_texts_and_lanes(monkeypatch):
    from quarry.llm.bpe import load

    merges = load(BYTE_PATH)
    merges.special = {}
    texts = ["".join(np.random.default_rng(i).choice(list("aBe é'ts \n\t漢9-<s>🙂▁ "), 1 + i)) for i in range(300)]
    want = aligned(texts)
    for lane in (3, align.LANE):
        monkeypatch.setattr(align, "LANE", lane)
        got = list(align.Aligner(merges, PIECE_PATH).block(texts))
        assert [g[:5] for g in got] == [(*w[:4], w[6]) for w in want]


def test_alignment_of_an_empty_table(docs):
    assert align.align(docs.filter("false"), BYTE_PATH, PIECE_PATH).count() == 0
    assert [tuple(r)[1:] for r in align.align(docs.filter("text = ''"), BYTE_PATH, PIECE_PATH).collect()] == [(0, 0, 0, 0, 0, 0, "")]
