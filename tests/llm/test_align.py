"""Alignment of two tokenizers against a brute-force version."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidyveil.llm import align, word_bpe

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
LETTERS = {c: b for b, c in enumerate(word_bpe.byte_letters())}
ODD = ["a", "the ", " word", "  ", "é", "中文", "\n", "\t", "1234", "▁", "<0x41>", "<s>", "<|endoftext|>", "\x00", "👍🏽", "ing", "ﬁ", "　"]


def _brute(text):
    """Tokens with their byte ranges, pair by pair."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p := B.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(a_bytes), spans(b_bytes)
    links = [(i, j) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
    cuts = sorted({y for _, y in sa} & {v for _, v in sb})
    groups, low = [], 0
    for cut in cuts:
        inside = lambda ids, where: ",".join(str(i) for i, (x, y) in zip(ids, where) if low < y <= cut)  # noqa: B023, E731
        groups.append(f"{inside(a, sa)}|{inside(b, sb)}")
        low = cut
    return a, b, links, ";".join(groups)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=25).map("".join), st.sampled_from([1, 5, 1000]))
def test_one_text(text, cut):
    found, want = align.aligner(BYTES, PIECES).align(text, cut), _brute(text)
    assert (found is None) == (want is None)
    if want:
        a, b, links, groups = want
        assert found[:5] == (len(a), len(b), groups.count(";") + 1, len(links), groups)
        assert dict(zip(found[5].tolist(), found[6].tolist())) == Counter(a[i] << 32 | b[j] for i, j in links)


def _check(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_a int")
    want = {i: _brute(t) for i, t in enumerate(texts)}
    count = Counter(a[i] << 32 | b[j] for w in want.values() if w for a, b, links, _ in [w] for i, j in links)
    best = {}
    for pair, n in count.items():
        best[pair & 0xFFFFFFFF] = max(n, best.get(pair & 0xFFFFFFFF, 0))
    found = align.alignment_by_document(df, BYTES, PIECES).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    for r in found:
        w = want[r["doc_id"]]
        if w is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, links, groups = w
        pairs = [a[i] << 32 | b[j] for i, j in links]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), groups.count(";") + 1, len(links))
        assert r["n_best"] == sum(count[p] == best[p & 0xFFFFFFFF] for p in pairs)
        assert r["count_sum"] == sum(count[p] for p in pairs)
        assert r["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest()


TEXTS = [None, "", " ", "same text twice", "same text twice", "a▁b", "Ein längerer Satz, 12345 Wörter.", "same text", "中文 und <0x41>", "the the the thethe", "\x00", "tail  two"]


def test_by_document(spark, monkeypatch):
    _check(spark, TEXTS)
    monkeypatch.setattr(align, "FREQUENT", 8)  # now most pairs are joined
    _check(spark, TEXTS)


def test_odd_tables(spark):
    long = "word after word " * 20_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "no id"), (2, None), (2, None)], "doc_id long, text string")
    found = align.alignment_by_document(df, BYTES, PIECES).collect()
    assert len(found) == 5
    ones = [r for r in found if r["doc_id"] == 1]
    a, b = A.encode(" " + long, add_special_tokens=False).ids, B.encode(long)
    assert ones[0] == ones[1] and (ones[0]["n_a"], ones[0]["n_b"]) == (len(a), len(b))
    assert [r["n_a"] for r in found if r["doc_id"] == 2] == [0, 0]
    assert align.alignment_by_document(df.limit(0), BYTES, PIECES).collect() == []
    assert align.alignment_by_document(df.filter("doc_id = 2"), BYTES, PIECES).count() == 2
